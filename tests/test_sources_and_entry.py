import importlib
import os
import subprocess
import sys
from datetime import datetime

import pytest

from tephra.sources import feeds
from tephra.streaming import telemetry as stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_telemetry_log_and_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, 5), "gen", "m", 1.0, 1, 1, h, True, h == 2) for h in range(4)]
    feeds.append_telemetry(spark.createDataFrame(rows, feeds.TELEMETRY), str(tmp_path / "log"))
    (day,) = [d for d in os.listdir(tmp_path / "log") if d.startswith("day=")]
    (tmp_path / "log" / day / "torn.json").write_text('{"ts": "2024-01-01T00:00:00Z", "op": "ge')
    log = feeds.telemetry_log(spark, str(tmp_path / "log"))
    assert log.where("op is not null").count() == 4 and {str(r.day) for r in log.collect()} == {"2024-01-01"}
    # A daily file of the other layout, its last event after midnight.
    line = '{"ts": "2024-03-0%dT23:59:00Z", "op": "gen", "model": "m", "latency_ms": 1.0, "ok": true, "cached": false}\n'
    os.makedirs(tmp_path / "files")
    (tmp_path / "files" / "2024-03-01.jsonl").write_text(line % 1 + line % 2 + '{"torn')
    (tmp_path / "files" / "other.jsonl").write_text(line % 5)
    days = sorted(str(r.day) for r in feeds.telemetry_log(spark, str(tmp_path / "files")).where("op is not null").collect())
    assert days == ["2024-03-01", "2024-03-01", "2024-03-05"]
    query = stream.rollup(
        stream.events(spark, str(tmp_path / "log"))
    ).writeStream.format("memory").queryName("rolled").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(calls), sum(cache_hits), sum(retries) from rolled where op = 'gen'").first()[:] == (4, 1, 6)


def test_forecast_and_archive(spark, tmp_path):
    (tmp_path / "f.json").write_text(
        '{"latitude": 1.5, "longitude": 2.5, "timezone": "UTC", "daily": {"time": ["2024-01-01", "2024-01-02"], "precipitation_sum": [1.0, 2.0], "temperature_2m_max": [30.0, 31.0], "wind_speed_10m_max": [5.0, null]}}'
    )
    rows = feeds.forecast_long(feeds.forecasts(spark, str(tmp_path / "f.json"))).collect()
    assert len(rows) == 6 and {
        (r.day_no, r.value) for r in rows if r.variable == "wind_speed_10m_max"
    } == {(1, 5.0), (2, None)}
    (tmp_path / "a.json").write_text(
        '{"timezone": "x", "daily": {"time": ["1960-01-01", "1961-01-01"], "precipitation_sum": [3.0, null]}}'
    )
    assert [
        r.value
        for r in feeds.archive_long(spark, str(tmp_path / "a.json"), "precipitation_sum").orderBy("day").collect()
    ] == [3.0, None]


def test_fetch_tries_again_where_that_helps(spark):
    def fetch(request):
        if request["id"] == 1:
            return '{"latitude": 1.5, "longitude": 2.5, "timezone": "UTC", "daily": {"time": ["2024-01-01"], "precipitation_sum": [1.0], "temperature_2m_max": [30.0], "wind_speed_10m_max": [5.0]}}'
        raise feeds.RequestError(f"status {request['id']}", request["id"] if request["id"] > 9 else None)

    asked = spark.createDataFrame([(1, 0.5), (2, 0.5), (404, 0.5), (429, 0.5), (503, None)], "id int, latitude double")
    got = {r.id: r for r in feeds.fetched(asked, fetch, pause=lambda n: None).collect()}
    assert {k: (r.error, r.tries) for k, r in got.items()} == {
        1: (None, 1), 2: ("status 2", 3), 404: ("status 404", 1), 429: ("status 429", 3), 503: ("status 503", 3)
    }
    rows = feeds.forecast_long(feeds.forecast_bodies(feeds.fetched(asked, fetch, pause=lambda n: None))).collect()
    assert sorted(r.value for r in rows) == [1.0, 5.0, 30.0]


def test_scratch_tables_need_a_shared_folder_and_are_deleted(spark, monkeypatch, tmp_path):
    from tephra.sources import scratch

    df = scratch.materialized(spark.range(3), "scratch-test")
    path = df._tephra_path.removeprefix("file://").removeprefix("file:")
    assert df.count() == 3 and os.path.isdir(path)
    scratch.discard(df)
    assert not os.path.exists(path)

    with scratch.temporary() as keep:
        gone, kept = scratch.materialized(spark.range(2), "gone"), keep(scratch.materialized(spark.range(5), "kept"))
        assert gone.count() == 2
        with scratch.temporary():
            inner = scratch.materialized(spark.range(1), "inner")
        assert not os.path.exists(inner._tephra_path.removeprefix("file://")) and gone.count() == 2
    assert kept.count() == 5 and not os.path.exists(gone._tephra_path.removeprefix("file://"))

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "spark://somewhere:7077"})

    with pytest.raises(ValueError):
        scratch.shared_folder(Session())
    Session.conf["spark.master"] = "local[2]"
    assert scratch.shared_folder(Session()) == Session.conf["spark.checkpoint.dir"]
    Session.conf = Conf({"spark.master": "spark://somewhere:7077", "spark.checkpoint.dir": "hdfs://x/y/"})
    assert scratch.shared_folder(Session()) == "hdfs://x/y"


def test_artifact(spark, tmp_path):
    feeds.write_artifact(
        spark.createDataFrame([("s", 0.5)], "slice string, mrr double"), str(tmp_path / "a"), set="dev", model="m"
    )
    (r,) = spark.read.json(str(tmp_path / "a")).collect()
    assert (r.slice, r.mrr, r["set"], r.model) == ("s", 0.5, "dev", "m")


def test_gold_set_in_both_forms(spark, tmp_path):
    q = '{"id": "a", "slice": "single_page", "question": "q", "answerable": true, "expected_behavior": "answer", "gold_pages": [{"source": "s", "page": 1}], "supporting_quote": "", "notes": ""}'
    (tmp_path / "object.json").write_text('{"questions": [' + q + "]}")
    (tmp_path / "list.json").write_text("[" + q + "]")
    for name in ("object", "list"):
        (r,) = feeds.gold_set(spark, str(tmp_path / f"{name}.json")).collect()
        assert (r.id, r.gold_pages[0].page, r.hazard) == ("a", 1, None)


def test_chunk_cache(spark, tmp_path):
    pages = spark.createDataFrame([("s", 1, "one two")], "source string, page int, text string")
    first = feeds.cached_chunks(pages, str(tmp_path / "c"))
    again = feeds.cached_chunks(pages, str(tmp_path / "c"))
    assert first.collect() == again.collect() and len(os.listdir(tmp_path / "c")) == 1
    feeds.cached_chunks(pages.union(pages.selectExpr("source", "2", "text")), str(tmp_path / "c"))
    assert len(os.listdir(tmp_path / "c")) == 2


def test_key_cache(spark, tmp_path):
    assert feeds.read_cache(spark, str(tmp_path / "k"), "key string, raw string").count() == 0
    for _ in range(2):
        feeds.append_cache(spark.createDataFrame([("a", "x")], "key string, raw string"), str(tmp_path / "k"))
    assert feeds.read_cache(spark, str(tmp_path / "k"), "key string, raw string").count() == 1


def test_html_pages(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>a <b>b</b></p><script>x()</script>")
    assert [r.text for r in feeds.pages_from_html(spark, str(tmp_path / "p.html")).collect()] == ["a b"]


def test_pdf_pages(spark, tmp_path):
    """The reader is optional and not installed here; a stand-in of its interface shows pages, numbers and sources."""
    stub = tmp_path / "lib" / "pypdf.py"
    os.makedirs(stub.parent)
    stub.write_text(
        "class Page:\n    def __init__(self, t): self.t = t\n    def extract_text(self): return self.t or None\n"
        "class PdfReader:\n    def __init__(self, f): self.pages = [Page(t) for t in f.read().decode().split('\\f')]\n"
    )
    spark.sparkContext.addPyFile(str(stub))
    os.makedirs(tmp_path / "pdf")
    (tmp_path / "pdf" / "a.pdf").write_text("first  pa-\nge\f\fthird", encoding="utf-8")
    (tmp_path / "pdf" / "b.pdf").write_text("\ufffd" * 9 + "x", encoding="utf-8")
    got = [(r.source, r.page, r.text) for r in feeds.pages_from_pdf(spark, str(tmp_path / "pdf")).orderBy("page").collect()]
    assert got == [("a.pdf", 1, "first page"), ("a.pdf", 3, "third")]


def test_entry_without_the_llm_folder(tmp_path):
    """The rest imports and lists its queries where the llm folder and the pipeline are gone."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text(open(os.path.join(ROOT, name)).read())
    os.makedirs(tmp_path / "tephra")
    for d in os.listdir(os.path.join(ROOT, "tephra")):
        if d not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "tephra", d), tmp_path / "tephra" / d)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(set(e.oracle_sql()) - set(q)), any(n.startswith('op') and n[2].isdigit() for n in q))"
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    )
    assert out.returncode == 0, out.stderr
    n, rest = out.stdout.split(" ", 1)
    assert int(n) > 60 and rest.strip() == "[] False"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_sql_agrees_on_the_smallest_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    plans = importlib.import_module("tephra.plans")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else str(x)
    for name in (
        "clean_pages", "rrf_hybrid", "chunk_tables", "block_maxima", "region_lookup", "telemetry_rollup",
        "citation_integrity", "trust_rates", "assess_nl", "forecast_rows"
    ):
        want = con.sql(plans.ORACLES[name]).df()
        got = plans.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
        rows = lambda d: sorted(
            tuple(str(plain(None if x != x else x)) for x in r)
            for r in d.astype(object).where(d.notna(), None).itertuples(index=False)
        )
        norm = lambda rs: [tuple(x.removesuffix(".0") for x in r) for r in rs]
        assert norm(rows(got)) == norm(rows(want)), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_report_text_agrees_with_its_sql_on_ties_large_and_missing_peaks(spark, tmp_path):
    """Peaks that are halves once told in m/s or rounded, of eight digits, and null."""
    duckdb = pytest.importorskip("duckdb")
    plans = importlib.import_module("tephra.plans")
    con = duckdb.connect()
    for name in ("nation", "region", "events"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    con.sql("select n as s_suppkey, n as s_nationkey from range(25) t(n)").write_parquet(str(tmp_path / "supplier.parquet"))
    con.sql(
        """select n as l_suppkey, timestamp '2000-05-01' as l_shipdate, 1.0::double as l_quantity, 50.0::double + n as l_extendedprice from range(25) t(n)
        union all select n, timestamp '2001-05-01', [45, 1000000001, null, 0.17][n % 4 + 1]::double, [66280.885, 23456789.5, null, 100][n % 4 + 1]::double from range(25) t(n)"""
    ).write_parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("nation", "region", "events", "supplier", "lineitem"):
        con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet')")
    want = {r[0]: r[1:] for r in con.sql(plans.ORACLES["report_text"]).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in plans.QUERIES["report_text"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 57
    assert want[2][0].startswith("Peak daily wind of 22.5 km/h (6.2 m/s)") and want[20][:2] == (None, None)
    assert want[10][0].startswith("Peak daily max temperature of 23456789.5 ") and " 66280.88 " in want[0][0]
