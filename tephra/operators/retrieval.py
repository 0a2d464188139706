"""Ranking: BM25, exact cosine, reciprocal-rank fusion, and page rankings of chunk rankings.

Rankings are DataFrames (qid, ord, score, rank); qid is of any type. Scores are rounded to 9 digits before they are ranked and ties go to the
lower ``ord``, so that the order of additions can't flip a rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tephra.functions.text import tokens
from tephra.schemas import BM25_B, BM25_K1, CANDIDATES, RRF_K
from tephra.sources.scratch import materialized

#: Rows and bytes of a side that may be broadcast, proven by a count first.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Queries that BM25 scores in place, and queries of one pass of exact cosine search.
QUERY_BLOCK, COSINE_BLOCK = 1024, 16_384
#: Rows and queries that are multiplied at a time.
_TILE = (2048, 1024)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has few rows and bytes; as it is beyond that."""
    size = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f.name)))), F.lit(0))
    count, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if count <= rows and total <= most_bytes else df


def term_statistics(docs: DataFrame, fold: bool = True) -> DataFrame:
    """(term, df, cf): documents that hold a term, and its occurrences."""
    counted = docs.select("ord", F.explode(tokens("text", fold)).alias("term")).groupBy("ord", "term").count()
    return counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("cf"))


def _top(scored: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _bm25_joined(docs: DataFrame, queries: DataFrame, k: int, fold: bool) -> DataFrame:
    """:func:`bm25` for query sets of any size, by joins.

    Query terms meet the tokens before any exchange, so that only their postings are shuffled, in one pass over the
    documents: an empty term stands in every document for its length. Frequencies, totals and scores all come from these
    postings, which are written once.
    """
    asked = queries.select(
        "qid", F.explode(tokens("text", fold)).alias("term")
    ).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    terms = asked.select("term").unionAll(queries.sparkSession.createDataFrame([("",)], "term string")).distinct()
    # The outer lambda binds the tokens of a text, so that they are found once and not anew for each of them.
    rows = F.transform(
        F.array(tokens("text", fold)),
        lambda ws: F.transform(
            F.concat(ws, F.array(F.lit(""))), lambda w: F.struct(w.alias("term"), F.size(ws).alias("dl"))
        )
    )
    words = docs.select("ord", F.inline(F.flatten(rows)))
    held = materialized(
        words.join(small(terms), "term").groupBy("term", "ord", "dl").agg(F.count("*").alias("tf")), "bm25-postings"
    )
    totals = held.where("term = ''").agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("mean"))
    df = held.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("qtf") * F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (
        F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("mean"))
    )
    # One row of totals joins every term: its size is proven.
    valued = df.join(F.broadcast(totals)).select("term", "mean", idf.alias("idf"))
    matched = held.join(valued, "term").join(small(asked), "term")
    return _top(matched.groupBy("qid", "ord").agg(F.round(F.sum(weight), 9).alias("score")), k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, fold: bool = True) -> DataFrame:
    """(qid, ord, score, rank): the best ``k`` documents of every query.

    ``docs`` has ord and text, ``queries`` qid and text. A term that a query repeats counts as often. Documents that share
    no term with a query aren't ranked. A query set of at most ``QUERY_BLOCK`` rows is scored in place: one pass counts
    document frequencies and lengths, a second scores Arrow batches and puts out each one's own best ``k``, so that no
    posting is shuffled. Larger sets go through joins.
    """
    found = queries.select("qid", tokens("text", fold).alias("words")).limit(QUERY_BLOCK + 1).collect()
    if len(found) > QUERY_BLOCK or len({r["qid"] for r in found}) < len(found):
        return _bm25_joined(docs, queries, k, fold)
    terms = sorted({w for r in found for w in r["words"] or ()})
    if not terms:
        return queries.select(
            "qid", F.lit(0).cast("long").alias("ord"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")
        ).limit(0)
    place = {w: t for t, w in enumerate(terms)}
    kind = queries.schema["qid"].dataType
    ids = pa.array([r["qid"] for r in found], to_arrow_type(kind))
    pairs: dict[tuple[int, int], int] = {}
    for q, r in enumerate(found):
        for w in r["words"] or ():
            pairs[place[w], q] = pairs.get((place[w], q), 0) + 1
    asked = np.array([(t, q, n) for (t, q), n in sorted(pairs.items())], np.int64)
    at = np.searchsorted(asked[:, 0], np.arange(len(terms) + 1))
    known = pa.array(terms)
    words = docs.select(F.col("ord").cast("long").alias("ord"), tokens("text", fold).alias("words"))

    def postings(batch):
        """(row, term, tf) of query terms, and the lengths of the rows."""
        lists = batch.column(1)
        length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        term = pc.index_in(lists.flatten(), value_set=known)
        row = np.repeat(np.arange(len(length)), length)
        hit = term.is_valid().to_numpy(zero_copy_only=False)
        key, tf = np.unique(row[hit] * len(terms) + term.drop_null().to_numpy(), return_counts=True)
        return key // len(terms), key % len(terms), tf, length

    def count(batches):
        df, rows, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            _, term, _, length = postings(batch)
            df += np.bincount(term, minlength=len(terms))
            rows, total = rows + len(length), total + int(length.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(len(terms)), -1, -2]), pa.array([*df.tolist(), rows, total])], names=["term", "n"]
        )

    sums = dict(words.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    df, n = np.array([sums.get(t, 0) for t in range(len(terms))], float), sums.get(-1, 0)
    mean = sums.get(-2, 0) / n if n else 0.0
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)

    def score(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                row, term, tf, length = postings(batch)
                weight = idf[term] * tf * (BM25_K1 + 1) / (
                    tf + BM25_K1 * (1 - BM25_B + BM25_B * length[row] / max(mean, 1e-12))
                )
                many = at[term + 1] - at[term]
                who = np.repeat(np.arange(len(term)), many)
                pair = np.repeat(at[term] - (np.cumsum(many) - many), many) + np.arange(len(who))
                sums = np.bincount(
                    row[who] * len(ids) + asked[pair, 1], weights=weight[who] * asked[pair, 2],
                    minlength=len(length) * len(ids)
                ).reshape(len(length), len(ids))
                sums = np.round(sums, 9)
                ords = batch.column(0).to_numpy()
                best = np.lexsort((np.broadcast_to(ords[:, None], sums.shape), -sums), axis=0)[:k]
                value = np.take_along_axis(sums, best, axis=0).ravel()
                keep = value > 0
                who = ids.take(pa.array(np.tile(np.arange(len(ids)), len(best))[keep]))
                yield pa.RecordBatch.from_arrays(
                    [who, pa.array(ords[best].ravel()[keep]), pa.array(value[keep])], names=["qid", "ord", "score"]
                )

    # Written: a ranking is small, is read several times, and keeps Python out of the plans that build on it.
    return materialized(
        _top(words.mapInArrow(score, f"qid {kind.simpleString()}, ord long, score double"), k), "bm25-ranking"
    )


class _Best:
    """The best ``k`` rows of each query so far; ties go to the lower ord."""

    def __init__(self, queries: int, k: int):
        self.k, self.most = k, max(4 * k * queries, 1 << 18)
        self.least = np.full(queries, -np.inf)  # score that a row must reach
        self.parts, self.held = [], 0

    def add(self, query: np.ndarray, ord_: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, ord_, score))
        self.held += len(query)
        if self.held > self.most:
            self.kept()

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ord_, score = (
            np.concatenate(x) for x in zip(*self.parts)
        ) if self.parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        order = np.lexsort((ord_, -score, query))
        query, ord_, score = query[order], ord_[order], score[order]
        first = np.searchsorted(query, np.arange(len(self.least)))
        place = np.arange(len(query)) - first[query]
        full = place == self.k - 1
        self.least[query[full]] = score[full]
        keep = place < self.k
        self.parts, self.held = [(query[keep], ord_[keep], score[keep])], int(keep.sum())
        return self.parts[0]


def cosine(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(qid, ord, score, rank): exact cosine search of a stated query set against all rows, in blocks.

    ``vectors`` has ord and embedding, ``queries`` qid (of any type) and embedding. Queries are dealt by hash into blocks of
    about ``COSINE_BLOCK``, of which the driver holds one at a time; each block takes one scan of the vectors, in which a task
    multiplies tiles and puts out its own best ``k`` of each query once, at its end. A zero vector scores 0 and is ranked.
    Null vectors are left out; vectors of another length than the query's too.
    """
    asked = queries.where("embedding is not null").select("qid", "embedding")
    blocks = asked.count() // COSINE_BLOCK + 1
    kind = queries.schema["qid"].dataType
    rows = vectors.where("embedding is not null").select(F.col("ord").cast("long"), F.col("embedding").cast("array<double>"))
    context, out = vectors.sparkSession.sparkContext, None
    for i in range(blocks):
        found = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).orderBy("qid").collect()
        for size in sorted({len(r["embedding"]) for r in found}) or [0]:
            mine = [r for r in found if len(r["embedding"]) == size]
            matrix = np.array([r["embedding"] for r in mine], np.float64).reshape(len(mine), size)
            unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
            shared = context.broadcast((pa.array([r["qid"] for r in mine], to_arrow_type(kind)), unit))
            part = rows.mapInArrow(_nearest(shared, k), f"qid {kind.simpleString()}, ord long, score double")
            out = part if out is None else out.unionAll(part)
    return materialized(_top(out, k), "cosine-ranking")


def _nearest(shared, k: int):
    """(ord, embedding) of one task -> its best ``k`` rows for each query of a block."""

    def run(batches):
        ids, unit = shared.value
        best = _Best(len(ids), k)
        for whole in batches:
            for i in range(0, whole.num_rows if len(ids) else 0, _TILE[0]):
                batch = whole.slice(i, _TILE[0])
                ords, lists = batch.column(0).to_numpy(), batch.column(1)
                length = np.diff(lists.offsets.to_numpy())
                right = np.flatnonzero(length == unit.shape[1])
                if not len(right):
                    continue
                rows = lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(right), -1)
                rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
                mine = ords[right]
                for q in range(0, len(ids), _TILE[1]):
                    score = np.round(rows @ unit[q : q + _TILE[1]].T, 9) + 0.0
                    least = best.least[q : q + _TILE[1]]
                    if len(right) > k:
                        least = np.maximum(least, np.partition(score, len(right) - k, axis=0)[len(right) - k])
                    row, query = np.nonzero(score >= least)
                    best.add(query + q, mine[row], score[row, query])
        query, ord_, score = best.kept()
        for i in range(0, len(query), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(query[part])), pa.array(ord_[part]), pa.array(score[part])],
                names=["qid", "ord", "score"]
            )

    return run


def fuse(rankings: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """(qid, ord, score, rank): reciprocal-rank fusion; ties go to the better rank in the earlier ranking."""
    parts = [
        r.select(
            "qid", "ord", "rank", *(F.when(F.lit(i == j), F.col("rank")).alias(f"r{j}") for j in range(len(rankings)))
        )
        for i, r in enumerate(rankings)
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    places = [f"r{j}" for j in range(len(rankings))]
    # The exchange is spelled out. Rankings are partitioned by query, which Spark 4.1 takes for the union's partitioning too,
    # and it then leaves the exchange out; but where a reused exchange stands below, the union no longer has that partitioning
    # when it runs, and sums go wrong.
    union = union.repartition("qid", "ord")
    summed = union.groupBy("qid", "ord").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), *(F.min(p).alias(p) for p in places)
    )
    by = Window.partitionBy("qid").orderBy(F.desc("score"), *(F.asc_nulls_last(p) for p in places), "ord")
    return summed.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("qid", "ord", "score", "rank")


def retrieve(lexical: DataFrame, semantic: DataFrame, k: int = 5) -> DataFrame:
    """(qid, ord, rank, retrieval_mode): fused where a query has a semantic ranking, else the lexical one, flagged."""
    dense = semantic.select("qid").distinct()
    fused = fuse([lexical.join(dense, "qid", "left_semi"), semantic], k).select(
        "qid", "ord", "rank", F.lit("hybrid").alias("retrieval_mode")
    )
    plain = lexical.join(dense, "qid", "left_anti").where(F.col("rank") <= k).select(
        "qid", "ord", "rank", F.lit("bm25_only").alias("retrieval_mode")
    )
    return fused.unionByName(plain).repartition("qid")  # see fuse()


def page_ranking(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(…, source, page, rank): chunk rankings as page rankings; the first hit keeps a page's place, places are renumbered."""
    by = by or ["qid"]
    first = ranked.groupBy(*by, "source", "page").agg(F.min("rank").alias("first"))
    return first.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*by).orderBy("first", "source", "page"))
    ).drop("first")
