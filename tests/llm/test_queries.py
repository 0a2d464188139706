"""The registered queries on the smallest tables, and the pipeline against its own parts."""

import os

import duckdb
import pytest

from tephra.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):  # op7 takes a few seconds in DuckDB
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    by = list(want.columns[:1])
    assert got.sort_values(by).reset_index(drop=True).astype(str).equals(
        want.sort_values(by).reset_index(drop=True).astype(str)
    )


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))


def test_pipeline_by_brute_force(spark):
    """Each stage, on what the one before kept, against the plain statement of what it does."""
    import re

    import numpy as np

    import corpus_pipeline as p
    from test_pairs_and_repeats import brute_jaccard, brute_passages

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(p.STAGES)
    ran = {}
    for name, stage in p.STAGES[:-1]:
        before = docs.collect()
        docs = p.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == p.COLUMNS
        ran[name] = before, {r.doc_id: r for r in docs.collect()}

    before, after = ran["language_id"]
    assert set(after) == {r.doc_id for r in before if r.text and re.search(r"[^\W\d_]", r.text)}

    before, after = ran["near_duplicates"]
    component = {i: c for _, i, _, c in brute_jaccard([(r.doc_id, r.text) for r in before])}
    assert set(after) == {i for i, c in component.items() if i == c}

    before, after = ran["repeated_passages"]
    texts = [r.text.encode() for r in before]
    for r, t, gone in zip(before, texts, brute_passages(texts, 51)):
        left = bytes(np.frombuffer(t, np.uint8)[~gone]).decode()  # passages begin and end with whole characters
        assert after[r.doc_id].text == left and after[r.doc_id].n_chars == len(left)

    before, after = ran["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {r.doc_id for r in before if not any(i in r.text for i in items)}

    packed = {r.doc_id: r.n_tokens for r in stages["packing"](spark, docs, SF).collect()}
    assert packed == {k: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) + 1 for k, r in after.items()}
    assert {r.doc_id for r in p.run(spark, SF).collect()} == set(packed)


@pytest.fixture(scope="module")
def odd_folder(tmp_path_factory):
    """documents and benchmark with every case that the stages' docstrings name."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(12)
    syllables = {"aa": "ka lo mi ra tu ben sol".split(), "bb": "scht ung der ich ein ver nd".split()}

    def prose(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    texts = [(k, prose(lang, rng.randrange(30, 120)), lang) for k, lang in enumerate(["aa", "bb"] * 40)]
    twin, item = texts[3][1], prose("bb", 40)
    shared = prose("aa", 60)
    rows = texts + [
        (100, None, "aa"), (101, "", "aa"), (102, " \n\t ", "aa"), (103, "12 34 !?", None),
        (104, "日本語の文章です。これは学習されていません", None),
        (105, twin, "bb"), (3, twin, "bb"), (None, twin, "bb"), (None, prose("aa", 40), "aa"),
        (106, f"{prose('bb', 30)} {item} {prose('bb', 30)}", "bb"),
        (None, f"{prose('bb', 30)} {item} {prose('bb', 30)}", "bb"), (107, prose("aa", 30_000), "aa"),
        (108, f"{prose('aa', 50)} {shared}", "aa"),
        (109, f"{shared}  {prose('aa', 50)}", "aa"), (110, prose("aa", 40), None),
    ]
    alone = prose("bb", 45)
    rows += [(None, alone, "bb"), (None, alone, "bb")]
    folder = str(tmp_path_factory.mktemp("odd"))
    ids, text, lang = zip(*rows)
    extra = {
        c: pa.array(["x"] * len(rows))
        for c in ("score", "kept", "id", "h", "token", "bucket", "lang_pred", "__id", "n_tokens")
    }
    table = pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()), "text": pa.array(text), "lang": pa.array(lang),
            "source": pa.array([None if k % 9 == 0 else "s" for k in range(len(rows))]),
            "n_chars": pa.array([len(t or "") for t in text], pa.int64()), **extra
        }
    )
    pq.write_table(table, f"{folder}/documents.parquet")
    pq.write_table(
        pa.table(
            {
                "item_id": pa.array([1, 1, None, 2, 3], pa.int64()), "text": [item, item, "null id", None, ""],
                "text2": ["a"] * 5
            }
        ),
        f"{folder}/benchmark.parquet"
    )
    return folder, rows, twin, item, shared, alone


def test_stages_on_odd_rows(spark, odd_folder):
    import corpus_pipeline as p
    from collections import Counter

    folder, rows, twin, item, shared, alone = odd_folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    given = Counter((i, t) for i, t, _ in rows)

    out = p.language_id(spark, docs, folder)
    assert out.columns == p.COLUMNS
    got = seen(out)
    assert not [t for _, t in got if not t or not any(c.isalpha() for c in t) or "日" in t]
    assert got <= given and sum(got.values()) > 0.9 * sum(given.values()) - 5
    assert len({got[k] > 0 for k in given if k[1] == twin}) == 1

    out = p.near_duplicates(spark, docs, folder)
    assert out.columns == p.COLUMNS
    got = seen(out)
    assert {k: n for k, n in got.items() if k[1] == twin} == {(3, twin): 1} and got[None, alone] == 1
    assert all(got[i, t] == given[i, t] for i, t in given if not (t or "").split())
    gone = Counter(t for _, t in (given - got))
    assert set(gone) == {twin, alone}

    out = p.repeated_passages(spark, docs, folder)
    assert out.columns == p.COLUMNS and out.count() == len(rows)
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[100][0].text == "" and by[101][0].text == "" and by[102][0].text == " \n\t "
    assert shared not in by[108][0].text and len(by[108][0].text.split()) == 50 and by[109][0].text.startswith("  ")
    assert by[107][0].text == next(t for i, t, _ in rows if i == 107)
    assert all(r.n_chars == len(r.text) for found in by.values() for r in found)
    words = len(twin.split())
    assert {r.text for r in by[3] + by[105]} == ({""} if words > 50 else {twin})

    out = p.decontamination(spark, docs, folder)
    assert out.columns == p.COLUMNS
    assert given - seen(out) == Counter(
        {k: n for k, n in given.items() if item in (k[1] or "")}
    ) and len(given - seen(out)) == 2

    got = p.packing(spark, docs, folder).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == sorted(
        (i is not None, i or 0, len((t or "").split()) + 1) for i, t, _ in rows
    )
    assert len({(r.batch_id, r.slot) for r in got}) == len(rows)


def test_stages_on_an_empty_table(spark, odd_folder, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{odd_folder[0]}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{odd_folder[0]}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in p.STAGES:
        assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).count() == 0
    assert p.run(spark, str(tmp_path)).count() == 0


def test_stages_remove_what_is_planted(spark, tmp_path):
    """Copies, near copies, passages of 51 words and benchmark items in documents of their own; the others stay as they are."""
    import random

    import corpus_pipeline as p
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages, items = [words(51) for _ in range(6)], [words(45) for _ in range(6)]
    rows, kind = [], {}
    for k in range(120):
        w = words(rng.randrange(60, 200))
        if k % 5 == 1:
            w[20:20] = passages[k % 6]
        if k % 10 == 2:
            w[30:30] = items[k % 6]
        kind[k] = "passage" if k % 5 == 1 else "item" if k % 10 == 2 else "clean"
        rows.append((k, " ".join(w)))
    for k in range(0, 40, 4):
        w = rows[k][1].split()
        if k % 8:
            w[len(w) // 2] = "edited"
        rows.append((1000 + k, " ".join(w)))
        kind[1000 + k] = "copy"
    ids, texts = zip(*rows)
    pq.write_table(
        pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * len(rows),
                "source": ["s"] * len(rows), "n_chars": pa.array(map(len, texts), pa.int64())
            }
        ),
        f"{tmp_path}/documents.parquet"
    )
    pq.write_table(
        pa.table({"item_id": pa.array(range(6), pa.int64()), "text": [" ".join(w) for w in items]}),
        f"{tmp_path}/benchmark.parquet"
    )
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = dict(rows)
    left = {r.doc_id: r.text for r in p.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert set(left) == {k for k in kind if kind[k] != "copy"}
    once = spark.createDataFrame(
        [(k, text[k], "en", "s", 1) for k in left], "doc_id long, text string, lang string, source string, n_chars long"
    )
    got = {r.doc_id: r.text for r in p.repeated_passages(spark, once, str(tmp_path)).collect()}
    for k, t in got.items():
        joined = [" ".join(w) for w in passages if " ".join(w) in text[k]]
        assert t == text[k] if kind[k] == "clean" else not any(x in t for x in joined)
    got = {r.doc_id for r in p.decontamination(spark, once, str(tmp_path)).collect()}
    assert got == {k for k in left if kind[k] != "item"}
