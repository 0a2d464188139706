"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round; every edge (a, b) has a > b. Hubs never gather their neighbours: minima are pre-aggregated."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a long, b long) undirected edges -> (node long, component long): the smallest node that links reach.

    Nodes without an edge to another node don't appear. Null ends are dropped. Rounds end when a round changes nothing,
    told by counts and sums of the edge set; each round is written to the shared folder.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, name)
    told = None
    for _ in range(ROUNDS):
        before, edges = edges, written(_star(_star(edges, large=True), large=False), name)
        discard(before)  # the new table stands on its own
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == told:
            break
        told = now
    else:
        raise RuntimeError(f"components have not settled in {ROUNDS} rounds")
    hubs = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(hubs)
    out._tephra_path = edges._tephra_path  # the table to keep or to discard
    return out
