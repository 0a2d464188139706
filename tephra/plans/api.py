"""The service surface as functions over tables of requests: a status and a result for each row, no web server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.functions.text import MAX_HORIZON
from tephra.operators import answers, extremes, places, retrieval, telemetry
from tephra.plans import pipeline
from tephra.schemas import HAZARD_SERIES, HAZARDS

# FIXED VALUES: chunks for an answer, and by default for a search.
ANSWER_TOP_K, SEARCH_TOP_K = 8, 5


def key_accepted(given: Column, expected: str | None) -> Column:
    """Every request passes where no key is set; else only those with the key."""
    return F.lit(True) if expected is None else F.coalesce(given == expected, F.lit(False))


def request_status(requests: DataFrame, expected_key: str | None = None) -> DataFrame:
    """Requests (latitude, longitude, horizon_days, hazard, api_key) with ``status`` and ``detail``: 401, 422 or 200."""
    lat, lon, days = F.col("latitude"), F.col("longitude"), F.col("horizon_days")
    detail = (
        F.when(~key_accepted(F.col("api_key"), expected_key), "invalid or missing x-api-key")
        .when(
            ~F.col("hazard").isin(*HAZARDS) | F.col("hazard").isNull(),
            F.concat(F.lit("unknown hazard "), F.coalesce("hazard", F.lit("")))
        )
        .when(
            ~F.coalesce(lat.between(-90, 90), F.lit(False)),
            F.concat(
                F.lit("latitude "), F.coalesce(lat.cast("string"), F.lit("")), F.lit(" outside valid range [-90, 90]")
            )
        )
        .when(
            ~F.coalesce(lon.between(-180, 180), F.lit(False)),
            F.concat(
                F.lit("longitude "), F.coalesce(lon.cast("string"), F.lit("")),
                F.lit(" outside valid range [-180, 180]")
            )
        )
        .when(
            ~places.valid_horizon(days),
            F.concat(
                F.lit("horizon "), F.coalesce(days.cast("string"), F.lit("")),
                F.lit(f" outside valid range [1, {MAX_HORIZON}]")
            )
        )
    )
    status = F.when(detail.isNull(), 200).when(~key_accepted(F.col("api_key"), expected_key), 401).otherwise(422)
    return requests.withColumns({"status": status, "detail": detail})


def query_reports(questions: DataFrame, *tables: DataFrame, **parameters) -> DataFrame:
    """Free-text requests: a refusal is a result like any other, status 200."""
    return pipeline.assess(questions, *tables, **parameters).withColumn("status", F.lit(200))


def health(spark) -> DataFrame:
    return spark.createDataFrame([("ok",)], "status string")


def metrics(events: DataFrame, prices: DataFrame) -> DataFrame:
    return telemetry.summarize(events, prices, ["op"])


def search_evidence(questions: DataFrame, chunks: DataFrame, **retrieval_by) -> DataFrame:
    """(qid, rank, chunk_id, source, page, text, retrieval_mode): the best chunks, fused where there are vectors.

    ``top_k`` of each question, if any, is held to 1..10.
    """
    k = answers.clamped_top_k(
        F.coalesce("top_k", F.lit(SEARCH_TOP_K)) if "top_k" in questions.columns else F.lit(SEARCH_TOP_K)
    )
    found = pipeline.retrieved(questions.select("qid", "text"), chunks, answers.MAX_TOP_K, **retrieval_by)
    ranked = found.join(questions.select("qid", k.alias("k")), "qid").where("rank <= k")
    return ranked.join(chunks, "ord").select("qid", "rank", "chunk_id", "source", "page", "text", "retrieval_mode")


def answer_evidence(
    questions: DataFrame, chunks: DataFrame, model: pipeline.Model, cache: DataFrame | None = None, **more
) -> DataFrame:
    return pipeline.answered(questions, chunks, model, ANSWER_TOP_K, cache, **more)


def climatology(requests: DataFrame, daily: DataFrame, boot: int = extremes.BOOT) -> DataFrame:
    """(latitude, longitude, hazard, …) statistics of each distinct place and hazard asked for; an invalid one has none."""
    asked = requests.where(
        places.valid_coordinates(F.col("latitude"), F.col("longitude"))
    ).select("latitude", "longitude", "hazard").distinct()
    series = F.create_map(*(F.lit(x) for p in HAZARD_SERIES.items() for x in p))
    keyed = asked.withColumns(
        {"variable": series[F.col("hazard")], "location": F.concat_ws("|", "latitude", "longitude", "hazard")}
    )
    found = daily.join(retrieval.small(keyed), ["latitude", "longitude", "variable"])
    return keyed.join(extremes.hazard_statistics(extremes.block_maxima(found), boot=boot), "location").drop("location")
