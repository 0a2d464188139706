"""Packing into optimal length buckets.

The global histogram of exact lengths (pre-aggregated; a row for each length that occurs) goes to a dynamic programme that
chooses at most ``BUCKETS`` boundaries with the least padding. Each row goes to the first bucket that holds it; inside a
bucket, rows stand by length and id and form batches of ``budget // bucket_len`` slots. Places come from one exchange by
ranges of (length, id) and the counts of the ranges before, not from a sort in one task; rows that agree in everything are
counted first and spread again at the end, so that copies of one row burden no range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranges, written

BUCKETS = 16
#: Tokens in a batch, padding included.
BUDGET = 65_536
#: Rows in one range of the exchange, and copies of one row that are numbered together.
RANGE_ROWS, COPIES = 1_000_000, 10_000


def words_and_end(text_col: str = "text") -> Column:
    """Length in tokens: words of ``[^\\x20\\x09-\\x0D]+`` and one end token; null counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def _layer(best: np.ndarray, lengths: np.ndarray, rows: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least best[i] + padding of lengths i..j-1 in one bucket over i < j, and the first such i.

    The first such i never falls as j grows (the padding is a Monge array), so the middle j of a range bounds those on
    either side. All ranges of one depth are solved together: each depth looks at little more than every i once.
    """
    m = len(lengths)
    value, cut = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    low, high = np.array([1]), np.array([m])
    first, last = np.array([0]), np.array([m - 1])
    while len(low):
        j = (low + high) // 2
        many = np.minimum(last, j - 1) - first + 1
        who = np.repeat(np.arange(len(j)), many)
        i = np.repeat(first, many) + ranges(many)
        cost = best[i] + lengths[j - 1][who] * (rows[j][who] - rows[i]) - (mass[j][who] - mass[i])
        at = np.cumsum(many) - many
        least = np.minimum.reduceat(cost, at)
        hit = np.flatnonzero(cost == least[who])
        chosen = i[hit[np.searchsorted(who[hit], np.arange(len(j)))]]
        value[j], cut[j] = least, chosen
        left, right = low < j, j < high
        low, high, first, last = (
            np.concatenate(x)
            for x in (
                (low[left], j[right] + 1), (j[left] - 1, high[right]), (first[left], chosen[right]),
                (chosen[left], last[right])
            )
        )
    return value, cut


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` ascending boundaries with the least sum of padding; each is a length that occurs.

    Exact: best[k][j] is the least cost of the first j lengths in k buckets; of equal costs the fewest buckets, then the
    lowest boundaries win. Time is ``buckets * m * log(m)`` for m distinct lengths, in numpy.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m = len(lengths)
    if m == 0:
        return []
    rows, mass = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for _ in range(min(buckets, m)):
        value, cut = _layer(best, lengths, rows, mass)
        better = value < best  # else a bucket stays empty
        better[0] = False
        back.append(np.where(better, cut, np.arange(m + 1)))
        best = np.where(better, value, best)
    out, j = [], m
    for cut in reversed(back):
        if cut[j] < j:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def _placed(rows: DataFrame, order: list[str], total: int, range_rows: int, copies: int) -> DataFrame:
    """``rows`` with their place (long, from 0) in the order of these columns, which are all that the rows have.

    Rows that agree in all columns can't be told apart; they are counted, and stand next to each other in any order.
    """
    groups = rows.groupBy(*order).agg(F.count("*").alias("m"))
    # A group goes in parts of at most ``copies`` rows.
    split = groups.select(
        *order, "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / copies))).alias("c")
    )
    split = split.select(*order, "c", F.least(F.lit(copies), F.col("m") - F.col("c") * copies).alias("m"))
    dealt = split.repartitionByRange(total // range_rows + 1, *order, "c").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "packing-rows")
    found = sorted(dealt.groupBy("part").agg(F.sum("m")).collect())  # one row for each range
    before = dict(zip([p for p, _ in found], np.cumsum([0, *(n for _, n in found)]).tolist()))
    starts = rows.sparkSession.createDataFrame([*before.items()] or [(0, 0)], "part int, before long")
    running = F.sum("m").over(
        Window.partitionBy("part").orderBy(*order, "c").rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("m")
    numbered = dealt.withColumn("place", running).join(F.broadcast(starts), "part").withColumn(
        "place", F.col("place") + F.col("before")
    )
    single = numbered.where("m = 1").select(*order, "place")
    many = numbered.where("m > 1").repartition("place").select(
        *order, F.explode(F.sequence(F.col("place"), F.col("place") + F.col("m") - 1)).alias("place")
    )
    return single.unionByName(many)


def pack(
    docs: DataFrame, length: Column, id_col: str = "doc_id", keep: list[str] | None = None, buckets: int = BUCKETS,
    budget: int = BUDGET,
    range_rows: int = RANGE_ROWS, copies: int = COPIES,
) -> DataFrame:
    """The columns ``keep`` (the id by default) and n_tokens, bucket, bucket_len, batch_id, slot, padding (long).

    ``batch_id`` counts from 0 over all buckets, ``slot`` from 0 inside a batch; every batch but a bucket's last is full, and
    ``bucket_len * slots`` never exceeds ``budget`` (a row longer than that has a batch of its own). Rows stand by length, id
    (null first) and the other columns kept, which must be of types that have an order. Null texts have the length that
    ``length`` gives them; null ids and repeated rows are rows like others. An empty table gives an empty one.
    """
    keep = [id_col] if keep is None else keep
    renamed = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(
        length.cast("long").alias("n_tokens"), F.col(id_col).alias("__id"),
        *(F.col(c).alias(r) for c, r in zip(keep, renamed))
    )
    histogram = docs.select(
        length.cast("long").alias("n")
    ).groupBy("n").agg(F.count("*").alias("c")).toPandas().sort_values("n")
    lengths, counts = histogram["n"].to_numpy(np.int64), histogram["c"].to_numpy(np.int64)
    ends = boundaries(lengths, counts, buckets)
    inside = np.bincount(np.searchsorted(ends, lengths), weights=counts, minlength=len(ends)).astype(np.int64)
    slots = [max(1, budget // max(e, 1)) for e in ends]
    base = np.append(0, np.cumsum(inside))
    first = np.append(0, np.cumsum([-(-int(c) // s) for c, s in zip(inside, slots)]))
    bucket = F.lit(len(ends))
    for k in range(len(ends) - 1, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[k], k).otherwise(bucket)
    placed = _placed(rows, rows.columns, int(counts.sum()), range_rows, copies).withColumn("bucket", bucket.cast("long"))
    known = [F.array(*(F.lit(int(x)) for x in xs)) if len(xs) else F.array(F.lit(1)) for xs in (ends, slots, first, base)]
    end, slot, batch, before = (F.get(x, F.col("bucket").cast("int")).cast("long") for x in known)
    at = F.col("place") - before
    return placed.select(
        *(F.col(r).alias(c) for c, r in zip(keep, renamed)), "n_tokens", "bucket", end.alias("bucket_len"),
        (batch + F.floor(at / slot)).cast("long").alias("batch_id"), F.pmod(at, slot).cast("long").alias("slot"),
        (end - F.col("n_tokens")).alias("padding"),
    )
