"""Sharding by histogram sort: shards of near-equal bytes from exact counts below candidate boundaries.

Rows are ordered by (hash of the text, id), so that equal texts are neighbours. Boundary k is sought where k / shards of all
bytes end. Candidates are refined round by round: each round cuts the range of hashes in which a boundary lies at
``2 ** BITS`` probes, counts exact bytes between neighbouring probes across all partitions (pre-aggregated; only rows in
ranges that are still open take part) and keeps the range that holds the boundary, until a probe lies within the tolerance.
Probes on hashes leave equal texts whole. A group of equal texts is cut, by id, only where it holds a boundary whose distance
to either end of the group exceeds ``WHOLE`` of a shard. A round brings the driver at most ``2 ** BITS`` rows for each of the
``shards - 1`` boundaries, whatever the size of the table. Then narrow rows are exchanged by (shard, piece) and numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SHARDS = 16
#: Bits by which a round refines the range of a boundary.
BITS = 12
#: Distance from the exact place, in shares of a shard, within which a probe is taken, and an end of a group.
TOLERANCE, WHOLE = 0.001, 0.05
#: Rows of a piece on average, and copies of one row that are numbered together.
PIECE_ROWS, COPIES = 250_000, 10_000
#: Pieces whose counts may be broadcast (16 bytes each).
BROADCAST_PIECES = 200_000
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _before(h: int, i: int) -> tuple[int, int] | None:
    """The key next below (h, i)."""
    if i > _LEAST:
        return h, i - 1
    return (h - 1, _MOST) if h > _LEAST else None


def _refined(
    keys: DataFrame, column: str, open_: list[dict], fair: float, tolerance: float, whole: float
) -> tuple[dict, list[dict]]:
    """({target: last key of the shard before}, those whose value of ``column`` is single and too far from the target).

    Each open range has target, prefix and before, the bytes in front of it; on ids also the hash h.
    """
    found, stuck, bits = {}, [], 0
    while open_:
        step = min(BITS, 64 - bits)
        cell = F.shiftright(column, 64 - bits - step)
        rows = keys
        if bits:
            rows = rows.where(F.shiftright(column, 64 - bits).isin(sorted({x["prefix"] for x in open_})))
        if column == "id":
            rows = rows.where(F.col("h").isin(sorted({x["h"] for x in open_})))
        by = ["h", "cell"] if column == "id" else ["cell"]
        cells: dict = {}
        counted = rows.withColumn("cell", cell).groupBy(*by).agg(F.sum("size"), F.min(column), F.max(column))
        for *key, size, low, high in counted.orderBy(*by).collect():
            cells.setdefault((*key[:-1], key[-1] >> step), []).append((size, low, high, key[-1]))
        bits += step
        again = []
        for x in open_:
            at, target = x["before"], x["target"]
            own = (x["h"],) if column == "id" else ()
            # In the first round the two halves of the signed range are one open range.
            prefixes = [(*own, x["prefix"])] if bits > step else [(*own, -1), (*own, 0)]
            for size, low, high, prefix in (c for p in prefixes for c in cells.get(p, ())):
                if target <= at + size:
                    break
                at += size
            near = min(target - at, at + size - target)
            single = low == high
            last = column == "id" and single
            if near <= tolerance * fair or single and not last and near <= whole * fair or last:
                end = (high, _MOST) if column == "h" else (x["h"], high)
                start = _before(low, _LEAST) if column == "h" else _before(x["h"], low)
                found[target] = start if start and target - at < at + size - target else end
            elif single:
                stuck.append({"target": target, "before": at, "h": low})
            else:
                again.append({**x, "prefix": prefix, "before": at})
        open_ = again
    return found, stuck


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, whole: float = WHOLE) -> list[tuple[int, int]]:
    """The last key (h, id) of each shard but the last, ascending; shards in one range of equal keys may be empty.

    ``keys`` has h, id and size (long, not null, size at least 1).
    """
    total = keys.agg(F.sum("size")).first()[0]
    if not total or shards < 2:
        return []
    targets = [-(-total * k // shards) for k in range(1, shards)]
    found, stuck = _refined(
        keys, "h", [{"target": t, "prefix": 0, "before": 0} for t in targets], total / shards, tolerance, whole
    )
    inner, _ = _refined(keys, "id", [{**x, "prefix": 0} for x in stuck], total / shards, tolerance, whole)
    return [{**found, **inner}[t] for t in targets]


def shard_of(h: Column, i: Column, ends: list[tuple[int, int]]) -> Column:
    """Number of splitters below the key."""
    out = F.lit(0)
    for a, b in ends:
        out = out + ((h > F.lit(a)) | ((h == F.lit(a)) & (i > F.lit(b)))).cast("int")
    return out


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, shards: int = SHARDS,
    tolerance: float = TOLERANCE, whole: float = WHOLE, piece_rows: int = PIECE_ROWS, copies: int = COPIES,
) -> DataFrame:
    """The columns ``keep`` (the id by default) and size long, text_crc32 long, law string, shard int, slot long, grown_shard int.

    Law ``bytes``: shards hold near-equal bytes. A boundary between two of them lies within ``tolerance`` of a shard from
    its exact place, or at the end of a group of equal texts within ``whole`` of a shard, or, in a larger group, within one
    row of it. ``size`` is UTF-8 bytes plus 1; a null or empty text has 1. A null id is the smallest. Rows that agree in text
    and id can't be told apart and share a shard. An empty table gives an empty one. Which slot of its shard a row has
    depends on the rows alone, not on their partitions. The columns kept must be of types that can be grouped by.
    """
    keep = [id_col] if keep is None else keep
    renamed = [f"__{k}" for k in range(len(keep))]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(
        F.xxhash64(text).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *(F.col(c).alias(r) for c, r in zip(keep, renamed)),
    )
    given = written(given, "sharding-keys")
    ends = splitters(given, shards, tolerance, whole)
    pieces = given.count() // (piece_rows * shards) + 1
    # Copies of one row are counted, and numbered in parts that are spread like other rows.
    groups = given.withColumn(
        "shard", shard_of(F.col("h"), F.col("id"), ends)
    ).groupBy(*given.columns, "shard").agg(F.count("*").alias("m"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / copies)))
    groups = groups.withColumn("c", part).withColumn("m", F.least(F.lit(copies), F.col("m") - F.col("c") * copies))
    groups = written(groups.withColumn("piece", F.pmod(F.xxhash64("h", "id", "c"), F.lit(pieces))), "sharding-rows")
    counts = groups.groupBy("shard", "piece").agg(F.sum("m").alias("n"))
    before = counts.select(
        "shard", "piece", (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("before")
    )
    if pieces * shards <= BROADCAST_PIECES:
        before = F.broadcast(before)
    order = Window.partitionBy("shard", "piece").orderBy("h", "id", *renamed, "c").rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.withColumn("at", F.sum("m").over(order) - F.col("m")).join(before, ["shard", "piece"])
    slot = F.explode(F.sequence(F.col("before") + F.col("at"), F.col("before") + F.col("at") + F.col("m") - 1)).alias("slot")
    out = placed.select(
        *renamed, "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), slot,
        F.lit(None).cast("int").alias("grown_shard")
    )
    return out.withColumnsRenamed(dict(zip(renamed, keep)))
