import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.functions import gev
from tephra.functions.text import fixed, shortest
from tephra.operators import answers, extremes, places, telemetry, verdict
from tephra.plans import api, pipeline

MAXIMA = [
    42.0, 55.1, 61.3, 48.7, 70.2, 66.5, 52.9, 88.4, 47.3, 59.9, 63.1, 51.2, 75.8, 68.0, 45.6, 57.7, 80.3, 62.2, 49.5,
    71.9, 54.4, 65.0, 58.8, 92.7, 46.1, 60.6, 53.3, 77.1, 69.4, 50.8
]


def test_fit_recovers_parameters():
    for c in (-0.1, 0.0, 0.2):
        y = gev.draws(c, 40, 2, 4000, (1, 2, 3))
        got = gev.fit(y)
        assert got[:3] == (pytest.approx(c, abs=0.05), pytest.approx(40, abs=0.15), pytest.approx(2, abs=0.12))


def test_fit_is_a_local_optimum():
    c, loc, scale, likelihood = gev.fit(np.array(MAXIMA))
    for d in (-0.01, 0.01):
        for shift in ((d, 0, 0), (0, d * 50, 0), (0, 0, d)):
            moved = (np.array([x]) for x in (c + shift[0], loc + shift[1], math.log(scale) + shift[2]))
            assert -gev.negative_log_likelihood(np.array([MAXIMA]), *moved)[0] <= likelihood + 1e-6


def test_likelihood_by_its_density():
    """Against the sum of log densities, value by value."""
    for c in (-0.4, -1e-9, 0.0, 0.2, 0.7):
        loc, scale = 3.0, 1.5
        y = gev.draws(c, loc, scale, 20, (4, 4))
        total = 0.0
        for v in y:
            z = (v - loc) / scale
            t = math.exp(-z) if abs(c) < 1e-8 else (1 - c * z) ** (1 / c)
            total -= math.log(t ** (1 - (0 if abs(c) < 1e-8 else c)) * math.exp(-t) / scale)
        got = gev.negative_log_likelihood(y[None, :], np.array([c]), np.array([loc]), np.array([math.log(scale)]))[0]
        assert got == pytest.approx(total, abs=1e-9)
    assert np.isinf(
        gev.negative_log_likelihood(np.array([[1.0, 99.0]]), np.array([0.5]), np.array([0.0]), np.array([0.0]))
    ).all()


def test_fits_in_company_are_fits_alone():
    rng = np.random.default_rng(5)
    samples = np.array(
        [
            gev.draws(c, 10, 2, 40, (9, k)) for k, c in enumerate(rng.uniform(-0.3, 0.3, 25))
        ] + [np.full(40, 7.0), np.r_[np.zeros(39), 1e6]]
    )
    together = np.array(gev.fits(samples))
    for k, y in enumerate(samples):
        assert np.array(gev.fit(y)) == pytest.approx(together[:, k], nan_ok=True, abs=1e-9)
    x = np.arange(40.0) - 19.5
    found, likelihood = gev.trend_fits(samples[:25], x, [0.0, 10.0, 0.0, 0.7])
    for k in range(25):
        one, least = gev.trend_fits(samples[k : k + 1], x, [0.0, 10.0, 0.0, 0.7])
        assert one[0] == pytest.approx(found[k], abs=1e-9) and least[0] == pytest.approx(likelihood[k], abs=1e-9)


def test_trend():
    years = np.arange(1960, 2023)
    rng = [gev.draws(0.1, 40 + s * (years - 1991), 1.5, 63, (7, k)) for k, s in enumerate((0.06, 0.0))]
    strong, flat = (gev.fit_trend(y, years) for y in rng)
    assert strong["p_value"] < 0.05 < flat["p_value"] and strong["slope"] == pytest.approx(0.06, abs=0.02) and strong["sigma"] == pytest.approx(1.5, abs=0.5)
    assert flat["lr_statistic"] >= 0
    with pytest.raises(ValueError):
        gev.fit_trend([1.0, 2.0], [1.0])


def test_levels_and_periods_invert(spark):
    df = spark.createDataFrame(
        [(c, 40.0, 2.0, float(t)) for c in (-0.2, 0.0, 1e-10, 0.3) for t in (2, 10, 50, 100, 1000)],
        "c double, loc double, scale double, t double"
    )
    level = gev.return_level(F.col("c"), F.col("loc"), F.col("scale"), F.col("t"))
    rows = df.withColumn("level", level).withColumn(
        "back", gev.return_period(F.col("c"), F.col("loc"), F.col("scale"), F.col("level"))
    ).collect()
    assert all(r.back == pytest.approx(r.t, rel=1e-6) for r in rows)
    assert all(a.level < b.level for a, b in zip(rows, rows[1:]) if a.c == b.c)
    beyond = spark.createDataFrame(
        [(0.5, 0.0, 1.0, 3.0), (-0.5, 0.0, 1.0, -3.0)], "c double, loc double, scale double, v double"
    ).select(gev.return_period(F.col("c"), F.col("loc"), F.col("scale"), F.col("v"))).collect()
    assert [r[0] for r in beyond] == [math.inf, 1.0]


def test_bootstrap_band(spark):
    rows = [("a", 1960 + k, v) for k, v in enumerate(MAXIMA)] + [("b", 1960 + k, v) for k, v in enumerate(MAXIMA[:12])]
    maxima = spark.createDataFrame(rows, "location string, block int, value double")
    got = {(r.location, r.return_period): r for r in extremes.return_levels_with_band(maxima, boot=60).collect()}
    again = {
        (r.location, r.return_period): r
        for r in extremes.return_levels_with_band(maxima.repartition(7), boot=60).collect()
    }
    assert got == again
    assert all(r.ci_low <= r.level <= r.ci_high for r in got.values())
    assert got["a", 100].ci_high - got["a", 100].ci_low > got["a", 10].ci_high - got["a", 10].ci_low
    stats = {r.location: r for r in extremes.hazard_statistics(maxima, boot=10, boot_trend=10).collect()}
    assert stats["a"].trend is not None and stats["b"].trend is None and stats["a"].n_blocks == 30 and len(stats["b"].return_levels) == 3


def test_block_maxima_skip_nulls(spark):
    d = spark.sql(
        "select 'x' location, to_date(day) day, value from values ('2001-01-01', 3.0), ('2001-05-01', null), ('2002-01-01', 5.0), ('2003-01-01', null) t(day, value)"
    )
    assert sorted((r.block, r.value) for r in extremes.block_maxima(d).collect()) == [(2001, 3.0), (2002, 5.0)]


@pytest.mark.parametrize("peak, want", [(99.9, "LOW"), (100.0, "MODERATE"), (140.0, "HIGH"), (160.0, "SEVERE")])
def test_level_by_return_period(spark, peak, want):
    df = spark.sql(f"select {peak}D p, map(10, 100D, 50, 140D, 100, 160D) m, map(10, 1D) short")
    assert tuple(
        df.select(
            verdict.level_by_return_period(F.col("p"), F.col("m")),
            verdict.level_by_return_period(F.col("p"), F.col("short"))
        ).first()
    ) == (want, None)


def test_numbers_as_text(spark):
    """As Python writes them."""
    values = [0.0, 7.0, -2.25, 0.15, 0.35, 1.25, 3.75, 8.45, 56.25, 120.05, 0.00012, 9999999.5, 12345678.5, 2.5e15, 1 / 3, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", shortest(F.col("v")), fixed(F.col("v"), 1), fixed(F.col("v"), 2), fixed(F.col("v"), 1, signed=True)
    ).collect()
    for v, *got in rows:
        assert got == ([None] * 4 if v is None else [repr(v), f"{v:.1f}", f"{v:.2f}", f"{v:+.1f}"]), v


def test_report_without_a_peak_names_none(spark):
    kinds = "location string, hazard string, horizon_days int, refusal string, peak double, variable string, unit string, n_years long, return_levels array<struct<return_period: int, level: double>>, representativeness string, trend struct<significant: boolean, slope_per_decade: double, p_value: double, evaluated_at: double>, answer string, citations array<struct<source: string, page: int>>"
    levels, trend = [(10, 1.0), (50, 12345678.5), (100, 3e7)], (True, 0.25, 0.0125, 2022.0)
    run = lambda hazard, peak: ("x", hazard, 3, None, peak, "temperature_2m_max", "°C", 9, levels, None, trend, None, None)
    runs = spark.createDataFrame([run(h, p) for p in (None, 20000002.5) for h in ("heatwave", "extreme_precip", "wind")], kinds)
    *unknown, heat, _, _ = verdict.reports(runs).collect()
    for r in unknown:
        assert r.risk_level is None and r.summary is None and r.drivers[0].detail is None and len(r.drivers) == 3
    assert unknown[0].drivers[2].detail is None
    assert heat.risk_level == "HIGH" and heat.summary == (
        "Peak daily max temperature of 20000002.5 °C over 3 days. ERA5 effective return levels at 2022 (10yr=1.0, "
        "50yr=12345678.5, 100yr=30000000.0; warming trend +0.2 °C/decade, p=0.013)."
    ) and heat.drivers[0].detail == "max daily 20000002.5 °C"



def test_confidence(spark):
    df = spark.createDataFrame(
        [
            ("station_calibrated", True), ("point_interpolated_reanalysis", False), (None, False),
            ("not_representative", True)
        ],
        "r string, c boolean"
    )
    assert [r[0] for r in df.select(verdict.confidence(F.col("r"), F.col("c"))).collect()] == [0.75, 0.55, 0.3, 0.4]


def test_regions_and_boundaries(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    regions = spark.createDataFrame(
        [(1, "B", "Bee", ring), (0, "A", "Ay", [(10.0, 10.0), (12.0, 10.0), (12.0, 12.0), (10.0, 12.0)])],
        "ord int, acronym string, name string, ring array<struct<lon: double, lat: double>>"
    )
    points = spark.createDataFrame(
        [(1, 0.5, 0.5), (2, 3.0, 2.0), (3, 0.0, 1.0), (4, 11.0, 11.0), (5, None, 1.0)],
        "id int, latitude double, longitude double"
    )
    assert {
        r.id: r.acronym for r in places.region_of(points, regions).collect()
    } == {1: "B", 2: None, 3: None, 4: "A", 5: None}


def test_telemetry(spark):
    rows = [
        ("gen", "m0", 10.0, 100, 10, 1, True, False), ("gen", "m0", 20.0, 0, 0, 0, False, False),
        ("gen", "mx", 30.0, 5, 5, 2, True, False), ("gen", "m0", 40.0, 9, 9, 0, True, False),
        ("gen", "m0", 0.0, 9, 9, 0, True, True), ("emb", "m0", 0.0, 9, 9, 0, True, True)
    ]
    e = spark.createDataFrame(
        rows,
        "op string, model string, latency_ms double, tokens_in long, tokens_out long, retries long, ok boolean, cached boolean"
    )
    prices = spark.createDataFrame([("m0", 1.0, 2.0)], "model string, price_in double, price_out double")
    got = {r.op: r for r in telemetry.summarize(e, prices, ["op"]).collect()}
    g = got["gen"]
    assert (
        g.calls, g.cache_hits, g.failures, g.retries, g.p50_ms, g.p95_ms, g.unpriced_models
    ) == (5, 1, 1, 3, 30.0, 40.0, "mx")
    assert g.est_cost_usd == pytest.approx(109 / 1e6 + 38 / 1e6, abs=1e-6) and (
        got["emb"].p50_ms, got["emb"].est_cost_usd
    ) == (0.0, 0.0)
    (s,) = telemetry.spans(e.withColumn("span", F.lit("x")), prices).collect()
    assert (s.calls, s.cache_hits, s.tokens_in, s.retries) == (4, 2, 114, 3)


def test_answers(spark):
    rows = [
        (1, '{"answer": "x", "citations": ["a"], "abstain": false}'),
        (2, '{"answer": "x", "citations": ["z"], "abstain": false}'),
        (3, '{"answer": "x", "citations": [], "abstain": false}'),
        (4, '{"answer": "", "citations": [], "abstain": true}'), (5, "nonsense"), (6, "[1]"), (7, '{"answer": "x"}'),
        (8, None)
    ]
    raw = spark.createDataFrame(rows, "qid int, raw string").withColumn("allowed_ids", F.array(F.lit("a")))
    assert [r.status for r in answers.checked_answers(raw).orderBy("qid").collect()] == [
        "ok", "invalid_citation", "uncited", "ok", "malformed", "malformed", "malformed", "malformed"
    ]


def test_model_seam_retries_rate_limits_only(spark):
    def limited(prompts):
        raise RuntimeError("RESOURCE_EXHAUSTED")

    def broken(prompts):
        raise RuntimeError("no")

    p = spark.createDataFrame([(1, "p")], "qid int, prompt string")
    (r,) = answers.call_model(p, limited, tries=3, pause=lambda n: None).collect()
    assert (r.ok, r.retries, r.raw) == (False, 2, None)
    (r,) = answers.call_model(p, broken, tries=3, pause=lambda n: None).collect()
    assert (r.ok, r.retries) == (False, 0)


def test_api(spark):
    rows = [
        (1, 10.0, 20.0, 7, "wind", "k"), (2, 91.0, 20.0, 7, "wind", "k"), (3, 0.0, 181.0, 7, "wind", "k"),
        (4, 0.0, 0.0, 17, "wind", "k"), (5, 0.0, 0.0, 7, "hail", "k"), (6, 0.0, 0.0, 7, "wind", None)
    ]
    r = spark.createDataFrame(
        rows, "id int, latitude double, longitude double, horizon_days int, hazard string, api_key string"
    )
    assert [x.status for x in api.request_status(r, "k").orderBy("id").collect()] == [200, 422, 422, 422, 422, 401]
    assert [x.status for x in api.request_status(r).orderBy("id").collect()] == [200, 422, 422, 422, 422, 200]
    chunks = spark.createDataFrame([(k, f"s#p{k}#0", "s", k, "heat wave") for k in range(1, 21)], "ord long, chunk_id string, source string, page int, text string")
    q = spark.createDataFrame([(1, "heat", 99), (2, "heat", -3), (3, "heat", None)], "qid long, text string, top_k int")
    found = api.search_evidence(q, chunks).groupBy("qid").count().collect()
    assert {x.qid: x["count"] for x in found} == {1: 10, 2: 1, 3: 5}


def test_answers_use_the_guard_and_the_cache(spark):
    chunks = spark.createDataFrame([(1, "s#p1#0", "s", 1, "rain will rise")], "ord long, chunk_id string, source string, page int, text string")
    q = spark.createDataFrame([(1, "rain?"), (2, "droughts?")], "qid long, text string")
    got = {r.qid: r for r in api.answer_evidence(q, chunks, answers.extractive_model).collect()}
    assert got[1].citations == ["s#p1#0"] and got[2].abstain and "drought" in got[2].abstain_reason
    packed = spark.sql("select 'rain?' q, array(named_struct('chunk_id', 's#p1#0', 'text', 'rain will rise')) c")
    cache = packed.select(answers.answer_key("m1", F.col("q"), F.col("c")).alias("key"), F.lit('{"answer": "cached", "citations": ["s#p1#0"], "abstain": false}').alias("raw"))
    got = {r.qid: r for r in api.answer_evidence(q, chunks, answers.extractive_model, cache, name="m1").collect()}
    assert got[1].answer == "cached"
    got = {r.qid: r for r in api.answer_evidence(q, chunks, answers.extractive_model, cache, name="m2").collect()}
    assert got[1].answer == "rain will rise"  # two models share no answers


def test_evidence_is_fused_where_there_are_vectors(spark):
    def embedder(texts):
        if any("fails" in t for t in texts):
            raise RuntimeError("no vector")
        return [[1.0, 0.0] if "rain" in t else [0.0, 1.0] for t in texts]

    chunks = spark.createDataFrame([(1, "s#p1#0", "s", 1, "rain will rise"), (2, "s#p2#0", "s", 2, "more wet days"), (3, "s#p3#0", "s", 3, "question heat")], "ord long, chunk_id string, source string, page int, text string")
    vectors = spark.createDataFrame([(1, [0.9, 0.1]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "ord long, embedding array<float>")
    q = spark.createDataFrame([("a", "rain rise"), ("b", "heat fails")], "qid string, text string")  # ids of any type
    got = [
        (r.qid, r.chunk_id, r.retrieval_mode)
        for r in api.search_evidence(q, chunks, vectors=vectors, embedder=embedder).orderBy("qid", "rank").collect()
    ]
    assert [x for x in got if x[0] == "a"] == [("a", "s#p1#0", "hybrid"), ("a", "s#p2#0", "hybrid"), ("a", "s#p3#0", "hybrid")]
    assert [x for x in got if x[0] == "b"] == [("b", "s#p3#0", "bm25_only")]  # its vector failed, the others' didn't
    broken = [
        (r.qid, r.retrieval_mode)
        for r in api.search_evidence(q, chunks, vectors=vectors, embedder=lambda xs: 1 / 0).collect()
    ]
    assert {m for _, m in broken} == {"bm25_only"} and answers.embedding_available(lambda xs: 1 / 0)[0] is False
    assert answers.embedding_available(embedder) == (
        True, "dense retrieval available, 2 dimensions"
    ) and not answers.embedding_available(None)[0]
    found = {
        r.qid: r
        for r in pipeline.answered(q, chunks, answers.extractive_model, 2, vectors=vectors, embedder=embedder).collect()
    }
    assert found["a"].answer == "rain will rise" and found["b"].citations == ["s#p3#0"]


def test_a_question_without_evidence_is_answered_too(spark):
    chunks = spark.createDataFrame([(1, "s#p1#0", "s", 1, "rain")], "ord long, chunk_id string, source string, page int, text string")
    q = spark.createDataFrame([(1, "snow"), (2, ""), (3, None)], "qid long, text string")
    got = {r.qid: r for r in pipeline.answered(q, chunks, answers.extractive_model, 2).collect()}
    assert (got[1].status, got[1].abstain, got[1].abstain_reason) == ("ok", True, "no excerpts") and got[2].abstain


def test_embeddings_go_through_the_cache(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id int, text string")
    cache = spark.createDataFrame([("bb", [9.0])], "text string, embedding array<float>").select(
        answers.vector_key(F.col("text"), "T").alias("key"), "embedding"
    )
    rows, new = answers.embedded(texts, lambda xs: [[float(len(x))] for x in xs], "T", cache)
    assert {(r.id, r.embedding[0]) for r in rows.collect()} == {(1, 1.0), (2, 9.0), (3, 1.0)} and new.count() == 1


def test_judge(spark):
    cited = spark.createDataFrame(
        [(1, "ans", 1, "second"), (1, "ans", 0, "first")], "qid int, answer string, pos int, text string"
    )
    prompt = answers.judge_prompts(cited).first().prompt
    assert prompt.endswith("EXCERPTS:\n<excerpt>\nfirst\n</excerpt>\n<excerpt>\nsecond\n</excerpt>\n\nANSWER:\nans")
    raw = spark.createDataFrame(
        [
            (1, '{"claims": [{"claim": "x", "supported": true}, {"claim": "y", "supported": false}]}'),
            (2, '{"claims": []}'), (3, "no")
        ],
        "qid int, raw string"
    )
    from tephra.operators import evaluation

    got = {r.qid: r for r in evaluation.claim_support(answers.judged_claims(raw).where("claims is not null")).collect()}
    assert (
        got[1].n_claims, got[1].n_supported, got[1].all_supported
    ) == (2, 1, False) and got[2].all_supported and 3 not in got


def test_assess_end_to_end(spark):
    q = spark.createDataFrame(
        [
            (1, "Rain in Osaka next 3 days?"), (2, "Heat waves at Nowhere"), (3, "Droughts in Osaka"),
            (4, "winds in Osaka")
        ],
        "qid long, text string"
    )
    gaz = spark.createDataFrame(
        [("Osaka", 0, "Osaka", 34.0, 135.0, "Japan")],
        "place string, ord int, name string, latitude double, longitude double, country string"
    )
    regions = spark.createDataFrame(
        [(0, "EAS", "East Asia", [(100.0, 20.0), (150.0, 20.0), (150.0, 50.0), (100.0, 50.0)])],
        "ord int, acronym string, name string, ring array<struct<lon: double, lat: double>>"
    )
    daily = spark.createDataFrame(
        [(34.0, 135.0, f"{1960 + k}-07-01", "precipitation_sum", v) for k, v in enumerate(MAXIMA)],
        "latitude double, longitude double, day string, variable string, value double"
    ).withColumn("day", F.to_date("day"))
    forecast = spark.createDataFrame(
        [
            (34.0, 135.0, f"2024-01-0{k}", v, x) for k, x in ((1, 10.0), (2, 300.0), (5, 999.0))
            for v in ("precipitation_sum", "wind_speed_10m_max")
        ],
        "latitude double, longitude double, day string, variable string, value double"
    ).withColumn("day", F.to_date("day"))
    chunks = spark.createDataFrame([(0, "s#p1#0", "s", 1, "heavy precipitation over East Asia (EAS)"), (1, "s#p2#0", "s", 2, "other")], "ord long, chunk_id string, source string, page int, text string")
    got = {
        r.qid: r
        for r in pipeline.assess(q, gaz, regions, daily, forecast, chunks, answers.extractive_model, boot=10).collect()
    }
    assert got[1].risk_level == "SEVERE" and got[1].location == "Osaka, East Asia (EAS)" and got[1].confidence == 0.65 and len(got[1].drivers) == 3
    assert [tuple(c) for c in got[1].citations] == [("s", "p1")] and "IPCC AR6" in got[1].summary
    assert got[2].refusal.startswith("could not resolve") and got[3].refusal.startswith("drought is not") and got[3].confidence == 0
    assert got[4].risk_level == "SEVERE" and len(got[4].drivers) == 1


def test_registered_bands_take_the_full_bootstrap(spark, monkeypatch):
    import inspect

    from tephra.plans import climate

    assert (extremes.BOOT, extremes.BOOT_TREND) == (300, 200)
    seen = {}
    monkeypatch.setattr(climate, "_monthly", lambda spark, sf_dir: None)
    monkeypatch.setattr(extremes, "fit_trend", lambda maxima: None)
    for name in ("return_levels_with_band", "trend_return_levels", "hazard_statistics"):
        at = inspect.signature(getattr(extremes, name))

        def noted(*args, _name=name, _at=at, **kwargs):
            bound = _at.bind(*args, **kwargs)
            bound.apply_defaults()
            seen[_name] = {k: v for k, v in bound.arguments.items() if k.startswith("boot")}

        monkeypatch.setattr(extremes, name, noted)
    for query in (climate.return_levels_ci, climate.trend_levels_ci, climate.hazard_stat):
        query(None, "")
    assert seen == {
        "return_levels_with_band": {"boot": 300}, "trend_return_levels": {"boot": 200},
        "hazard_statistics": {"boot": 300, "boot_trend": 200}
    }
