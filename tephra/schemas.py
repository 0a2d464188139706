"""Fixed vocabularies and settings, and the dimension tables made of them.

FIXED VALUES: everything in capitals in this module, but for HAZARD_INTERPRETATIONS, must stand exactly as it does for results
to be right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# FIXED VALUES: land regions of the sixth assessment, acronym and name.
REGIONS = {
    "GIC": "Greenland/Iceland",
    "NWN": "North-Western North America",
    "NEN": "North-Eastern North America",
    "WNA": "Western North America",
    "CNA": "Central North America",
    "ENA": "Eastern North America",
    "NCA": "Northern Central America",
    "SCA": "Southern Central America",
    "CAR": "Caribbean",
    "NWS": "North-Western South America",
    "NSA": "Northern South America",
    "NES": "North-Eastern South America",
    "SAM": "South American Monsoon",
    "SWS": "South-Western South America",
    "SES": "South-Eastern South America",
    "SSA": "Southern South America",
    "NEU": "Northern Europe",
    "WCE": "Western and Central Europe",
    "EEU": "Eastern Europe",
    "MED": "Mediterranean",
    "SAH": "Sahara",
    "WAF": "Western Africa",
    "CAF": "Central Africa",
    "NEAF": "North Eastern Africa",
    "SEAF": "South Eastern Africa",
    "WSAF": "West Southern Africa",
    "ESAF": "East Southern Africa",
    "MDG": "Madagascar",
    "RAR": "Russian Arctic",
    "WSB": "West Siberia",
    "ESB": "East Siberia",
    "RFE": "Russian Far East",
    "WCA": "West Central Asia",
    "ECA": "East Central Asia",
    "TIB": "Tibetan Plateau",
    "EAS": "East Asia",
    "ARP": "Arabian Peninsula",
    "SAS": "South Asia",
    "SEA": "South East Asia",
    "NAU": "Northern Australia",
    "CAU": "Central Australia",
    "EAU": "Eastern Australia",
    "SAU": "Southern Australia",
    "NZ": "New Zealand",
}

# FIXED VALUES: hazards, their series, units and texts.
HAZARDS = ("heatwave", "extreme_precip", "wind")
HAZARD_SERIES = {"heatwave": "temperature_2m_max", "extreme_precip": "precipitation_sum", "wind": "wind_gusts_10m_max"}
HAZARD_UNITS = {"heatwave": "°C", "extreme_precip": "mm", "wind": "km/h"}
HAZARD_STATISTICS = {
    "heatwave": "annual maximum of ERA5 daily-maximum 2 m air temperature",
    "extreme_precip": "annual maximum of ERA5 daily precipitation total",
    "wind": "annual maximum of ERA5 daily-maximum 10 m wind gust",
}
FORECAST_SERIES = {"heatwave": "temperature_2m_max", "extreme_precip": "precipitation_sum", "wind": "wind_speed_10m_max"}
EVIDENCE_PHRASES = {
    "heatwave": "hot extremes and extreme heat", "extreme_precip": "heavy precipitation and extreme rainfall",
    "wind": "mean wind speed and wind extremes"
}
EVIDENCE_QUESTION = "How are %s projected to change in intensity and frequency over %s at higher global warming levels?"

#: What the statistic of a hazard can and can't say, in our own words; no result depends on them.
HAZARD_INTERPRETATIONS = {
    "heatwave": "Daily maxima of a reanalysis grid of some 25 km, interpolated to the place. The daily cycle is in them, a station's bias is not taken out: in broken terrain a place can get hotter than they say.",
    "extreme_precip": "Daily totals of a reanalysis grid of some 25 km, interpolated to the place. Local downpours are spread over a cell, so read them as the region's and not as a rain gauge's.",
    "wind": "Daily gusts of a reanalysis grid of some 25 km, interpolated to the place. Sharp gusts of thunderstorms are missed, so the true hazard is at least this.",
}

# FIXED VALUES: severity, confidence and absolute thresholds.
LEVELS = ("LOW", "MODERATE", "HIGH", "SEVERE")
RETURN_PERIODS = (10, 50, 100)
ABSOLUTE_BOUNDS = {"heatwave": (35.0, 40.0, 45.0), "extreme_precip": (20.0, 50.0, 100.0), "wind": (40.0, 62.0, 88.0)}
BONUS = {
    "station_calibrated": 0.35, "point_interpolated_reanalysis": 0.25, "regional_grid_signal": 0.15,
    "not_representative": 0.0
}
BASE_CONFIDENCE, CITED_BONUS, CONFIDENCE_CEILING = 0.3, 0.1, 0.75
KMH_PER_MS = 3.6
MIN_BLOCKS_FOR_TREND = 20
SIGNIFICANCE = 0.05

# FIXED VALUES: ranking.
BM25_K1, BM25_B = 1.5, 0.75
RRF_K, CANDIDATES = 60, 50

# FIXED VALUES: price estimates in USD per million tokens, in and out.
PRICES = {"gemini-3.6-flash": (0.30, 2.50), "gemini-2.5-flash": (0.30, 2.50), "gemini-embedding-2": (0.15, 0.0)}

# FIXED VALUES: evaluation.
SLICES = (
    "single_page", "multi_page", "regional_table", "out_of_scope_hazard", "out_of_corpus", "premise_injection",
    "duplicate_region"
)
RECALL_AT = (3, 5, 10)
REFUSAL_CELLS = ("correct_answer", "correct_refuse", "false_refuse", "false_answer")

PAGE = T.StructType(
    [
        T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()),
        T.StructField("text", T.StringType())
    ]
)
CHUNK = T.StructType([T.StructField("chunk_id", T.StringType()), *PAGE.fields])
TELEMETRY = T.StructType(
    [
        T.StructField("ts", T.TimestampType()), T.StructField("op", T.StringType()),
        T.StructField("model", T.StringType()), T.StructField("latency_ms", T.DoubleType()),
        T.StructField("tokens_in", T.LongType()), T.StructField("tokens_out", T.LongType()),
        T.StructField("retries", T.LongType()), T.StructField("ok", T.BooleanType()),
        T.StructField("cached", T.BooleanType()),
    ]
)
FORECAST = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
        T.StructField("timezone", T.StringType()),
        T.StructField(
            "daily",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.DateType())),
                    *(T.StructField(v, T.ArrayType(T.DoubleType())) for v in FORECAST_SERIES.values())
                ]
            )
        ),
    ]
)
PAGE_REF = T.StructType([T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType())])
GOLD_QUESTION = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("slice", T.StringType()),
        T.StructField("question", T.StringType()), T.StructField("answerable", T.BooleanType()),
        T.StructField("expected_behavior", T.StringType()),
        T.StructField("gold_pages", T.ArrayType(PAGE_REF)), T.StructField("supporting_quote", T.StringType()),
        T.StructField("hazard", T.StringType()), T.StructField("notes", T.StringType()),
    ]
)


def hazard_table(spark: SparkSession) -> DataFrame:
    """One row for each hazard: series, unit and texts."""
    rows = [
        (
            h, HAZARD_SERIES[h], FORECAST_SERIES[h], HAZARD_UNITS[h], HAZARD_STATISTICS[h], HAZARD_INTERPRETATIONS[h],
            EVIDENCE_PHRASES[h], *ABSOLUTE_BOUNDS[h]
        )
        for h in HAZARDS
    ]
    return spark.createDataFrame(
        rows,
        "hazard string, series string, forecast_series string, unit string, statistic_definition string, interpretation string, phrase string, moderate double, high double, severe double"
    )


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m, i, o) for m, (i, o) in PRICES.items()], "model string, price_in double, price_out double"
    )
