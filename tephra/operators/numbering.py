"""Row numbers inside groups of any size: one exchange by ranges, and the counts of the ranges before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tephra.sources.scratch import materialized


def row_numbers(df: DataFrame, by: list[str], order: list[str], name: str = "row_number") -> DataFrame:
    """``df`` with the 1-based place (long) of each row in its group, in the order of ``order``, which tells rows apart.

    A group that holds a third of all rows is dealt over many tasks like any other: a window numbers the rows of one range,
    and a join adds those of the same group in the ranges before.
    """
    dealt = materialized(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    inner = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order))
    counts = dealt.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")
    # Null-safe: rows of a null group are a group like others.
    before = counts.select(
        F.col("__part").alias("__at"), *(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), ahead.alias("__ahead")
    )
    same = F.col("__part") == F.col("__at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    joined = dealt.withColumn("__inner", inner).join(before, same)
    return joined.select(*df.columns, (F.col("__inner") + F.col("__ahead")).cast("long").alias(name))
