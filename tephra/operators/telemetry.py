"""Roll-ups of a log of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tephra.operators.retrieval import small
from tephra.sources.scratch import materialized


def percentile_at(q: float, n: Column) -> Column:
    """1-based place of the empirical percentile among n sorted values."""
    return F.least(F.floor(F.lit(q) * n), n - 1) + 1


def _bin(x: Column) -> Column:
    """Number of a bin of values that grows with them: 64 to a factor of two, on both sides of zero."""
    scaled = F.floor(F.log2(F.abs(x)) * 64).cast("long") + 100_000
    return F.when(x > 0, scaled).when(x < 0, -scaled).otherwise(F.lit(0).cast("long"))


def _percentiles(events: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Empirical percentiles of latency over calls that weren't cached.

    Calls are counted by bins of latency first; a running sum over the bins of a group, which are few whatever its size, tells
    the bin and the place in it of each percentile. Only calls in these bins are looked at again, counted by latency and
    ranked by bin.
    """
    live = events.where("not cached").select(*by, "latency_ms", _bin(F.col("latency_ms")).alias("bin"))
    group = Window.partitionBy(*by)
    bins = live.groupBy(*by, "bin").agg(F.count("*").alias("c"))
    bins = bins.select(
        *by, "bin", "c", F.sum("c").over(group.orderBy("bin")).alias("upto"), F.sum("c").over(group).alias("n")
    )
    places = F.explode(
        F.array(
            *(
                F.struct(F.lit(name).alias("name"), percentile_at(q, F.col("n")).alias("place"))
                for name, q in quantiles.items()
            )
        )
    )
    wanted = bins.select("*", places.alias("p")).where("p.place <= upto and p.place > upto - c")
    wanted = wanted.select(*by, "bin", "p.name", (F.col("p.place") - F.col("upto") + F.col("c")).alias("place"))
    wanted = materialized(wanted, "percentile-bins")
    counted = live.join(
        small(wanted.select(*by, "bin").distinct()), [*by, "bin"], "left_semi"
    ).groupBy(*by, "bin", "latency_ms").agg(F.count("*").alias("c"))
    reach = F.sum("c").over(Window.partitionBy(*by, "bin").orderBy("latency_ms")).alias("upto")
    met = counted.select(*by, "bin", "latency_ms", reach).join(small(wanted), [*by, "bin"]).where("upto >= place")
    return met.groupBy(*by).agg(
        *(F.min(F.when(F.col("name") == name, F.col("latency_ms"))).alias(name) for name in quantiles)
    )


def priced(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Events with ``cost`` (0 where cached or unpriced) and ``unpriced``: a model without a price is unknown, not free."""
    joined = events.join(small(prices), "model", "left")
    cost = F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out")
    return joined.withColumns(
        {
            "cost": F.when(F.col("cached") | F.col("price_in").isNull(), 0.0).otherwise(cost),
            "unpriced": F.col("price_in").isNull()
        }
    )


def summarize(events: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """Calls (cached ones included), cache hits, failures, retries, p50 and p95 latency, cost and unpriced models by group."""
    sums = priced(events, prices).groupBy(*by).agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cache_hits"),
        F.count_if(~F.col("ok")).alias("failures"), F.sum("retries").alias("retries"),
        F.round(F.sum("cost"), 6).alias("est_cost_usd"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("unpriced"), F.col("model")))), ",").alias("unpriced_models"),
    )
    found = _percentiles(events, by, {"p50_ms": 0.50, "p95_ms": 0.95})
    return sums.join(found, by, "left").na.fill(0.0, ["p50_ms", "p95_ms"])


def report(events: DataFrame, prices: DataFrame) -> DataFrame:
    """The roll-up by day and operation, and over all days (day null); percentiles are taken anew for the totals."""
    both = events.withColumn("day", F.explode(F.array(F.date_format("ts", "yyyy-MM-dd"), F.lit(""))))
    rolled = summarize(both, prices, ["day", "op"])
    return rolled.withColumn("day", F.to_date(F.nullif("day", F.lit(""))))


def spans(events: DataFrame, prices: DataFrame, digits: int = 6) -> DataFrame:
    """One row for each span: calls and tokens over live calls, retries and failures over all."""
    live = ~F.col("cached")
    return priced(events, prices).groupBy("span").agg(
        F.count_if(live).alias("calls"), F.count_if("cached").alias("cache_hits"), F.sum("retries").alias("retries"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.coalesce(F.sum(F.when(live, F.col("tokens_in"))), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(F.when(live, F.col("tokens_out"))), F.lit(0)).alias("tokens_out"),
        F.round(F.sum("cost"), digits).alias("est_cost_usd"),
    )


def transient(status: Column, transport_error: Column) -> Column:
    """Whether a failed request is worth another try."""
    return F.coalesce(transport_error, F.lit(False)) | F.coalesce((status == 429) | (status >= 500), F.lit(False))
