"""Session settings that the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Setting, its default, and bytes of an Arrow batch on the way to Python and back.
_BATCH, _DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` where the session has the default.

    Batches of texts grow to the default of 64 MB, and buffers of that size stay with the JVM and with each Python worker: an
    executor of two cores was up to 0.9 GB larger with them, and no faster. A size that the session has set is left as it is.
    """
    if spark.conf.get(_BATCH, None) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def session(app: str = "tephra", **conf: str) -> SparkSession:
    """A session with UTC days, Arrow transfer and runtime re-planning; further settings by keyword, dots as ``__``."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        _BATCH: str(BATCH_BYTES),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Wrong sums above a union of equally partitioned children where one of their exchanges is reused (see retrieval.fuse).
        "spark.sql.unionOutputPartitioning": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
