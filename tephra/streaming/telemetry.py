"""A file-source stream over the telemetry log: the batch roll-up's counts in windows of time. An extension of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.schemas import TELEMETRY


def events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(TELEMETRY).option(
        "maxFilesPerTrigger", files_per_trigger
    ).option("recursiveFileLookup", True).json(path)


def rollup(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Calls, hits, failures and retries by operation and window; events later than ``late`` are dropped with their state."""
    live = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "op")
    return live.agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cache_hits"),
        F.count_if(~F.col("ok")).alias("failures"), F.sum("retries").alias("retries")
    )
