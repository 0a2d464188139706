"""Severity, confidence and the assembly of risk reports: one row for each question, refusals included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.functions.text import fixed, shortest
from tephra.schemas import ABSOLUTE_BOUNDS, BASE_CONFIDENCE, BONUS, CITED_BONUS, CONFIDENCE_CEILING, FORECAST_SERIES, HAZARDS, KMH_PER_MS, LEVELS


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def forecast_peak(forecast: DataFrame, horizon: Column | int | None = None) -> DataFrame:
    """(location, variable, peak): the maximum of each series over the first ``horizon`` days of the forecast."""
    rows = forecast if horizon is None else forecast.where(F.col("day_no") <= horizon)
    return rows.groupBy("location", "variable").agg(F.max("value").alias("peak"))


def level_by_return_period(peak: Column, levels: Column) -> Column:
    """Severity from map<period, level>: the largest of 100, 50 and 10 whose level the peak reaches; null if one lacks."""
    at = lambda t: F.try_element_at(levels, F.lit(t))
    known = at(10).isNotNull() & at(50).isNotNull() & at(100).isNotNull()
    low, moderate, high, severe = (F.lit(x) for x in LEVELS)
    return F.when(
        known & peak.isNotNull(),
        F.when(peak >= at(100), severe).when(peak >= at(50), high).when(peak >= at(10), moderate).otherwise(low)
    )


def absolute_level(hazard: Column, metric: Column) -> Column:
    """Severity by fixed thresholds; a metric at a threshold is in the band above it."""
    out = F.lit(None).cast("string")
    for h in HAZARDS:
        moderate, high, severe = ABSOLUTE_BOUNDS[h]
        band = F.when(
            metric < moderate, LEVELS[0]
        ).when(metric < high, LEVELS[1]).when(metric < severe, LEVELS[2]).when(
            metric.isNotNull(), LEVELS[3]
        )
        out = F.when(hazard == h, band).otherwise(out)
    return out


def confidence(representativeness: Column, cited: Column) -> Column:
    """What grounds a report adds up, to a ceiling; two digits."""
    bonus = F.coalesce(F.try_element_at(_map(BONUS), representativeness), F.lit(0.0))
    return F.round(
        F.least(F.lit(BASE_CONFIDENCE) + bonus + F.when(cited, CITED_BONUS).otherwise(0.0), F.lit(CONFIDENCE_CEILING)),
        2
    )


def metres_per_second(kmh: Column) -> Column:
    return kmh / KMH_PER_MS


def levels_text(levels: Column) -> Column:
    """``10yr=1.5, 50yr=2.0`` of array<struct<return_period, level>>."""
    return F.array_join(
        F.transform(
            levels,
            lambda r: F.concat(r["return_period"].cast("string"), F.lit("yr="), shortest(F.round(r["level"], 1)))
        ),
        ", "
    )


def reports(runs: DataFrame) -> DataFrame:
    """Report columns for each run; a run with a refusal keeps it and gets no risk level.

    A run without a peak has no risk level either; its summary and the details that would name the peak are null.

    ``runs`` has location, hazard, horizon_days, refusal, peak, and, null where there is none, variable, unit, n_years,
    return_levels array<struct<return_period, level>>, representativeness, trend struct<significant, slope_per_decade,
    p_value, evaluated_at>, answer and citations array<struct<source, page>>.
    """
    refused = F.col("refusal").isNotNull()
    has_stat = F.col("return_levels").isNotNull()
    matches = has_stat & (F.col("variable") == F.try_element_at(_map(FORECAST_SERIES), F.col("hazard")))
    by_period = F.map_from_entries(F.col("return_levels"))
    grounded = F.when(matches, level_by_return_period(F.col("peak"), F.transform_values(by_period, lambda _, v: v)))
    level = F.coalesce(grounded, absolute_level(F.col("hazard"), F.col("peak")))
    shown, ms = shortest(F.col("peak")), fixed(metres_per_second(F.col("peak")), 1)
    told = lambda *said: F.when(F.col("peak").isNotNull(), F.format_string(*said))
    detail = F.when(
        F.col("hazard") == "extreme_precip", told("max daily %s mm", shown)
    ).when(
        F.col("hazard") == "heatwave", told("max daily %s °C", shown)
    ).otherwise(told("max daily %s km/h (%s m/s)", shown, ms))
    factor = F.element_at(
        _map({"extreme_precip": "precipitation", "heatwave": "temperature", "wind": "wind"}), F.col("hazard")
    )
    text = levels_text(F.col("return_levels"))
    strong = F.coalesce(F.col("trend.significant"), F.lit(False))
    climate = F.when(strong, F.format_string("%s-yr ERA5 non-stationary GEV (%s), levels effective at %s", F.col("n_years"), F.col("variable"), F.col("trend.evaluated_at").cast("long"))).otherwise(
        F.concat(
            F.format_string("%s-yr ERA5 GEV (%s)", "n_years", "variable"),
            F.when(
                F.col("trend").isNotNull(), F.format_string(", no significant trend (p=%s)", fixed(F.col("trend.p_value"), 2))
            ).otherwise("")
        )
    )
    basis = F.when(matches, told("forecast peak %s %s vs GEV return levels (%s) -> %s", shown, F.col("unit"), text, level)).otherwise(
        F.format_string(
            "absolute thresholds (forecast/climatology variable mismatch: %s vs %s)",
            F.try_element_at(_map(FORECAST_SERIES), F.col("hazard")), F.col("variable")
        )
    )
    driver = lambda f, d: F.struct(f.alias("factor"), d.alias("detail"))
    drivers = F.when(
        has_stat,
        F.array(driver(factor, detail), driver(F.lit("climatology"), climate), driver(F.lit("severity_basis"), basis))
    ).otherwise(F.array(driver(factor, detail)))
    sentence = F.when(F.col("hazard") == "extreme_precip", told("Peak daily rainfall of %s mm over %s days.", shown, F.col("horizon_days"))).when(F.col("hazard") == "heatwave", told("Peak daily max temperature of %s °C over %s days.", shown, F.col("horizon_days"))).otherwise(
        told("Peak daily wind of %s km/h (%s m/s) over %s days.", shown, ms, F.col("horizon_days"))
    )
    climate_sentence = F.when(
        strong,
        F.format_string(
            " ERA5 effective return levels at %s (%s; warming trend %s %s/decade, p=%s).",
            F.col("trend.evaluated_at").cast("long"), text, fixed(F.col("trend.slope_per_decade"), 1, signed=True),
            F.col("unit"), fixed(F.col("trend.p_value"), 3)
        )
    ).otherwise(F.concat(F.lit(" ERA5 return levels ("), text, F.lit(").")))
    pages = F.when(
        F.col("answer").isNotNull(),
        F.array_distinct(F.coalesce("citations", F.array().cast("array<struct<source:string,page:int>>")))
    )
    cited = F.coalesce(F.size(pages) > 0, F.lit(False))
    summary = F.concat(
        sentence, F.when(has_stat, climate_sentence).otherwise(""),
        F.when(F.col("answer").isNotNull(), F.concat(F.lit(" IPCC AR6: "), "answer")).otherwise("")
    )
    return runs.select(
        *[c for c in ("qid",) if c in runs.columns], "location", "hazard", "horizon_days",
        F.when(~refused, level).alias("risk_level"), F.when(~refused, summary).alias("summary"),
        F.when(~refused, drivers).alias("drivers"),
        F.when(
            ~refused,
            F.coalesce(
                F.transform(
                    pages,
                    lambda p: F.struct(p["source"].alias("source"), F.concat(F.lit("p"), p["page"]).alias("locator"))
                ),
                F.array().cast("array<struct<source:string,locator:string>>")
            )
        ).alias("citations"),
        F.when(refused, 0.0).otherwise(
            confidence(F.when(has_stat, F.col("representativeness")), cited)
        ).alias("confidence"),
        "refusal",
        F.when(~refused, F.when(F.col("answer").isNotNull(), "grounded").otherwise("ungrounded")).alias("grounding_status"),
    )


def violations(report: DataFrame) -> DataFrame:
    """Reports with ``violations array<string>`` of the report's invariants; empty for a sound one."""
    checks = {
        "exactly_one_of_level_and_refusal": F.col("risk_level").isNull() == F.col("refusal").isNull(),
        "hazard_missing_without_refusal": F.col("hazard").isNull() & F.col("refusal").isNull(),
        "horizon_not_positive": F.coalesce(F.col("horizon_days") <= 0, F.lit(True)),
        "confidence_out_of_range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
    }
    return report.withColumn("violations", F.array_compact(F.array(*(F.when(bad, name) for name, bad in checks.items()))))


def roll_up_checks(report: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Reports with ``failed array<string>`` of the named checks that don't hold; a null check doesn't apply."""
    return report.withColumn("failed", F.array_compact(F.array(*(F.when(~ok, name) for name, ok in checks.items()))))
