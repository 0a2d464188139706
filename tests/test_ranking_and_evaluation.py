import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.operators import evaluation, retrieval, telemetry
from tephra.operators.numbering import row_numbers

DOCS = [(0, "heat heat wave"), (1, "rain rain rain fall"), (2, "heat and rain"), (3, ""), (4, "heat heat wave")]


def ranked(df):
    return [(r.qid, r.ord) for r in df.orderBy("qid", "rank").collect()]


def test_bm25(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "ord long, text string")
    queries = spark.createDataFrame(
        [(1, "heat wave"), (2, "rain rain"), (3, "absent"), (4, "rain")], "qid long, text string"
    )
    got = retrieval.bm25(docs, queries, 10)
    assert ranked(got) == [(1, 0), (1, 4), (1, 2), (2, 1), (2, 2), (4, 1), (4, 2)]
    score = {(r.qid, r.ord): r.score for r in got.collect()}
    mean, idf = 13 / 5, math.log((5 - 2 + 0.5) / 2.5 + 1)
    assert score[4, 1] == pytest.approx(idf * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * 4 / mean)), abs=1e-8)
    assert score[2, 1] == pytest.approx(2 * score[4, 1], abs=1e-8)  # a repeated query term counts twice
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)  # a larger query set goes through joins
    joined = retrieval.bm25(docs, queries, 10)
    assert ranked(joined) == ranked(got) and {
        (r.qid, r.ord): r.score for r in joined.collect()
    } == pytest.approx(score, abs=1e-8)
    assert retrieval.bm25(docs, queries.limit(0), 10).count() == 0


def test_cosine(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 8))
    v[7] = 0
    vectors = spark.createDataFrame(
        [(k, x.tolist()) for k, x in enumerate(v)] + [(99, None), (98, [1.0])], "ord long, embedding array<double>"
    )
    q = rng.normal(size=(5, 8))
    queries = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "qid long, embedding array<double>")
    want = []
    for k in range(5):
        s = np.round((v @ q[k]) / np.maximum(np.linalg.norm(v, axis=1), 1e-12) / np.linalg.norm(q[k]), 9)
        want += [(k, int(i)) for i in sorted(range(50), key=lambda i: (-s[i], i))[:7]]
    assert ranked(retrieval.cosine(vectors, queries, 7)) == want
    monkeypatch.setattr(retrieval, "COSINE_BLOCK", 2)
    monkeypatch.setattr(retrieval, "_TILE", (9, 2))
    assert ranked(retrieval.cosine(vectors, queries, 7)) == want
    named = queries.withColumn("qid", F.concat(F.lit("q"), "qid"))
    assert ranked(retrieval.cosine(vectors, named, 7)) == [(f"q{q}", o) for q, o in want]
    assert retrieval.cosine(vectors, queries.limit(0), 7).count() == 0


def test_cosine_keeps_ties_in_order(spark, monkeypatch):
    """Equal vectors in every batch: the lowest ords win, whatever was kept before."""
    monkeypatch.setattr(retrieval, "_TILE", (4, 2))
    vectors = spark.createDataFrame(
        [(k * 37 % 101, [1.0, float(k % 2)]) for k in range(101)], "ord long, embedding array<double>"
    ).repartition(3)
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "qid long, embedding array<double>")
    even = sorted(k * 37 % 101 for k in range(101) if k % 2 == 0)
    odd = sorted(k * 37 % 101 for k in range(101) if k % 2)
    assert ranked(retrieval.cosine(vectors, queries, 20)) == [(0, o) for o in even[:20]] + [(1, o) for o in odd[:20]]


def test_rankings_of_named_questions(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "ord long, text string")
    queries = spark.createDataFrame([("SP-01", "heat wave"), ("SP-02", "rain")], "qid string, text string")
    want = [("SP-01", 0), ("SP-01", 4), ("SP-01", 2), ("SP-02", 1), ("SP-02", 2)]
    assert ranked(retrieval.bm25(docs, queries, 10)) == want
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    assert ranked(retrieval.bm25(docs, queries, 10)) == want


def test_rankings_may_be_read_twice_without_being_written(spark, monkeypatch):
    """A plan in which a ranking stands by itself and in a fusion; the exchange below it is reused."""
    monkeypatch.setattr(retrieval, "materialized", lambda df, name: df)
    docs = spark.createDataFrame(
        [(k, " ".join(f"t{(k * j) % 7}" for j in range(1, 9))) for k in range(60)], "ord long, text string"
    )
    queries = spark.createDataFrame([(q, f"t{q % 7} t{q % 5}") for q in range(8)], "qid long, text string")
    vectors = docs.select(
        "ord",
        F.array((F.col("ord") % 7).cast("double"), (F.col("ord") % 3).cast("double"), F.lit(1.0)).alias("embedding")
    )
    asked = queries.select("qid", F.array((F.col("qid") % 7).cast("double"), F.lit(1.0), F.lit(0.5)).alias("embedding"))
    lexical, semantic = retrieval.bm25(docs, queries, 20), retrieval.cosine(vectors, asked, 20)
    fused = retrieval.fuse([lexical, semantic], 20)
    part = lambda df, name: df.select(F.lit(name).alias("of"), "qid", "ord", "rank")
    together = part(lexical, "bm25").unionByName(part(semantic, "dense")).unionByName(part(fused, "hybrid")).join(
        queries.select("qid"), "qid", "left_semi"
    ).collect()
    ranks = {}
    for r in together:
        if r.of != "hybrid":
            ranks.setdefault((r.qid, r.ord), {})[r.of] = r["rank"]
    want = []
    for q in range(8):
        mine = [
            (-round(sum(1 / (60 + x) for x in places.values()), 9), places.get("bm25", 99), places.get("dense", 99), o)
            for (qid, o), places in ranks.items() if qid == q
        ]
        want += [(q, o, place) for place, (*_, o) in enumerate(sorted(mine)[:20], 1)]
    assert sorted((r.qid, r.ord, r["rank"]) for r in together if r.of == "hybrid") == sorted(want)


def test_row_numbers(spark):
    rows = [
        (f"s{k % 3}" if k % 10 else None, k * 7919 % 1000) for k in range(1000)
    ] + [("hot", k) for k in range(2000, 4000)]
    got = row_numbers(
        spark.createDataFrame(rows, "source string, id long").repartition(6), ["source"], ["id"], "page"
    ).collect()
    want = {}
    for s in {r[0] for r in rows}:
        want |= {(s, i): n for n, i in enumerate(sorted(i for t, i in rows if t == s), 1)}
    assert {(r.source, r.id): r.page for r in got} == want and len(got) == len(rows)


def test_small_sides_are_proven_by_bytes_too(spark):
    df = spark.createDataFrame([(1, "x" * 1000)] * 10, "k int, text string")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(retrieval.small(df)) and not hinted(
        retrieval.small(df, most_bytes=5000)
    ) and not hinted(retrieval.small(df, rows=9))


def test_percentiles_by_bins(spark):
    rng = np.random.default_rng(2)
    values = [float(x) for x in np.round(np.exp(rng.normal(3, 2, 400)), 2)] + [0.0, 0.0, -1.5, 1e-9, 7.0, 7.0]
    rows = [(v, k % 7 == 0, f"op{k % 3}") for k, v in enumerate(values)] + [(5.0, True, "cached only")]
    events = spark.createDataFrame(rows, "latency_ms double, cached boolean, op string")
    got = {r.op: (r.a, r.b, r.c) for r in telemetry._percentiles(events, ["op"], {"a": 0.5, "b": 0.95, "c": 1.0}).collect()}
    for op in ("op0", "op1", "op2"):
        live = sorted(v for v, cached, o in rows if o == op and not cached)
        assert got[op] == tuple(live[min(int(q * len(live)), len(live) - 1)] for q in (0.5, 0.95, 1.0))
    assert "cached only" not in got


def test_fusion_and_fallback(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "qid long, ord long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "qid long, ord long, rank int")
    assert ranked(retrieval.fuse([a, b], 5)) == [(1, 11), (1, 10), (1, 12), (2, 20)]
    got = retrieval.retrieve(a, b, 2)
    assert {(r.qid, r.ord, r.retrieval_mode) for r in got.collect()} == {
        (1, 11, "hybrid"), (1, 10, "hybrid"), (2, 20, "bm25_only")
    }


def test_page_ranking_and_recall(spark):
    hits = spark.createDataFrame(
        [(1, "a", 5, 1), (1, "a", 5, 2), (1, "b", 1, 3), (2, "c", 1, 1)], "qid long, source string, page int, rank int"
    )
    pages = retrieval.page_ranking(hits)
    assert [(r.source, r["rank"]) for r in pages.where("qid = 1").orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    gold = spark.createDataFrame([(1, "b", 1), (2, "x", 9)], "qid long, source string, page int")
    ranks = evaluation.first_gold_rank(pages, gold)
    (r,) = evaluation.recall_report(ranks.withColumn("slice", F.lit("s")), ["slice"]).collect()
    assert (r.n, r.recall_3, r.mrr) == (2, 0.5, 0.25)


def test_wilson(spark):
    low, high = evaluation.wilson(F.col("s"), F.col("n"))
    got = [
        tuple(r)
        for r in spark.createDataFrame(
            [(28, 34), (0, 0), (0, 10), (10, 10)], "s long, n long"
        ).select(low, high).collect()
    ]
    assert got[0] == (pytest.approx(0.6649, abs=1e-4), pytest.approx(0.9165, abs=1e-4)) and got[1] == (0.0, 1.0)
    assert all(-1e-12 <= a <= b <= 1 + 1e-12 for a, b in got)


def test_refusals_and_gold(spark):
    o = spark.createDataFrame(
        [(True, True), (True, False), (False, True), (False, False), (False, False)],
        "expected_refuse boolean, did_abstain boolean"
    )
    assert evaluation.refusal_matrix(o).first().asDict() == {
        "correct_answer": 2, "correct_refuse": 1, "false_refuse": 1, "false_answer": 1
    }
    page = "array<struct<source:string,page:int>>"
    q = spark.createDataFrame(
        [
            ("a", True, "answer", [("s", 2), ("s", 1), ("s", 2)]), ("b", True, "answer", []),
            ("c", False, "refuse", [("s", 1)]), ("d", False, "answer", None)
        ],
        f"id string, answerable boolean, expected_behavior string, gold_pages {page}"
    )
    got = {r.id: r for r in evaluation.gold_violations(q).collect()}
    assert [tuple(p) for p in got["a"].gold_pages] == [("s", 1), ("s", 2)] and got["a"].violations == []
    assert got["b"].violations == [
        "answerable_without_gold"
    ] and got["c"].violations == ["gold_without_answerable"] and got["d"].violations == [
        "answer_expected_of_unanswerable"
    ]


def test_content_hash_ignores_order(spark):
    kind = "id string, slice string, question string, answerable boolean, expected_behavior string, gold_pages array<struct<source:string,page:int>>, supporting_quote string, hazard string, notes string"
    rows = [
        ("b", "single_page", "é?", True, "answer", [("s", 2), ("s", 1)], "", None, ""),
        ("a", "single_page", "q", False, "refuse", [], "", "x", "")
    ]
    h = lambda r: evaluation.content_hash(spark.createDataFrame(r, kind)).first()[0]
    assert h(rows) == h(rows[::-1]) and h(rows) != h([rows[0], (*rows[1][:2], "other", *rows[1][3:])])


def test_upsert_and_overlap(spark):
    old, new = (
        spark.createDataFrame(x, "id string, question string")
        for x in ([("a", "A b"), ("b", "c")], [("b", "new"), ("c", "a  B")])
    )
    assert {tuple(r) for r in evaluation.upsert(old, new).collect()} == {("a", "A b"), ("b", "new"), ("c", "a  B")}
    assert {tuple(r) for r in evaluation.overlaps(old, new).collect()} == {("id", "b"), ("text", "a b")}
