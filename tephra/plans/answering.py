"""Queries on answers, evaluation, telemetry, caches and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tephra.functions import text as t
from tephra.operators import answers, evaluation, telemetry
from tephra.plans.corpus import _lexical
from tephra.sources import tables


def answered_questions(spark, sf_dir):
    """Benchmark items as questions, and some out of scope, through guard, fused retrieval, model and checks.

    Chunks are the cleaned pages; the n-th query vector stands for question n, questions without one are searched by words.
    """
    from tephra.plans import pipeline

    items = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    asked = items.unionByName(
        spark.createDataFrame(
            [(-1, "How do droughts change?"), (-2, "Hail or heat?"), (-3, "")], "qid long, text string"
        )
    )
    pages = tables.cleaned_pages(spark, sf_dir)
    chunks = pages.select(F.col("doc_id").alias("ord"), F.concat("source", F.lit("#p"), "page", F.lit("#0")).alias("chunk_id"), "source", "page", "text")
    vectors = tables.read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ord"), "embedding"
    ).join(chunks.select("ord"), "ord", "left_semi")
    of_questions = tables.read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(
        F.expr("vec_id div 20").alias("qid"), "embedding"
    )
    found = pipeline.answered(asked, chunks, answers.extractive_model, 3, vectors=vectors, question_vectors=of_questions)
    return found.select(
        "qid", "status", "answer", F.array_join("citations", ",").alias("citations"), "abstain", "abstain_reason",
        F.size("unknown").alias("n_unknown")
    )


def evidence_search(spark, sf_dir):
    """The search tool: as many chunks as each question asks for, within its bounds."""
    from tephra.plans import api

    items = tables.read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), "text", (F.col("item_id") % 14 - 2).cast("int").alias("top_k")
    )
    pages = tables.cleaned_pages(spark, sf_dir)
    chunks = pages.select(F.col("doc_id").alias("ord"), F.concat("source", F.lit("#p"), "page", F.lit("#0")).alias("chunk_id"), "source", "page", "text")
    return api.search_evidence(items, chunks).select(
        "qid", "rank", "chunk_id", F.md5("text").alias("digest"), "retrieval_mode"
    )


def number_provenance(spark, sf_dir):
    """Numbers of each page against those of the next page of its source."""
    pages = tables.corpus_pages(spark, sf_dir)
    following = pages.select("source", (F.col("page") - 1).alias("page"), F.col("text").alias("cited"))
    both = pages.join(following, ["source", "page"], "left").withColumn(
        "cited", F.when(F.col("cited").isNull(), F.array().cast("array<string>")).otherwise(F.array("cited"))
    )
    return both.select(
        "doc_id", F.size(t.numbers("text")).alias("n_numbers"),
        evaluation.provenance_ok(F.col("text"), F.col("cited")).alias("ok")
    )


def _raw_answers(spark, sf_dir):
    """Model output of every kind, made from events."""
    e, k = tables.read(spark, sf_dir, "events"), F.col("event_id") % 6
    raw = (
        F.when(
            k == 0,
            F.concat(F.lit('{"answer": "a'), "event_id", F.lit('", "citations": ["c1", "c2"], "abstain": false}'))
        )
        .when(
            k == 1, F.lit('{"answer": "b", "citations": ["c9"], "abstain": false}')
        ).when(k == 2, F.lit('{"answer": "c", "citations": [], "abstain": false}'))
        .when(
            k == 3, F.lit('{"answer": "", "citations": ["c1"], "abstain": true, "abstain_reason": "no"}')
        ).when(k == 4, F.lit("not json")).otherwise(F.lit("[1, 2]"))
    )
    return e.select(
        F.col("event_id").alias("qid"), raw.alias("raw"),
        F.array(F.lit("c1"), F.lit("c2"), F.lit("c3")).alias("allowed_ids")
    )


def citation_integrity(spark, sf_dir):
    return answers.checked_answers(_raw_answers(spark, sf_dir)).select(
        "qid", "status", "answer", "abstain", "abstain_reason", F.size("unknown").alias("n_unknown")
    )


def citation_hits(spark, sf_dir):
    """Whether the best three chunks of a question, by their ids, lie on a gold page."""
    pages = tables.corpus_pages(spark, sf_dir).select(F.col("doc_id").alias("ord"), "source", "page")
    ids = _lexical(spark, sf_dir, 3).join(pages, "ord").select("qid", F.concat("source", F.lit("#p"), "page", F.lit("#0")).alias("chunk_id"))
    hit = ids.select("qid", t.page_of("chunk_id").alias("p")).select("qid", "p.source", "p.page").join(
        tables.benchmark_gold(spark, sf_dir), ["qid", "source", "page"], "left_semi"
    ).select("qid").distinct()
    asked = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return asked.join(hit.withColumn("h", F.lit(True)), "qid", "left").select(
        "qid", F.coalesce("h", F.lit(False)).alias("hit")
    )


def _outcomes(spark, sf_dir):
    return tables.read(spark, sf_dir, "labels").select(
        "doc_id", (F.col("toxic") == 1).alias("expected_refuse"), (F.col("quality") == 0).alias("did_abstain")
    )


def refusal_matrix(spark, sf_dir):
    return evaluation.refusal_matrix(_outcomes(spark, sf_dir))


def trust_rates(spark, sf_dir):
    i = F.col("doc_id")
    return evaluation.trust_rates(
        _outcomes(spark, sf_dir).select(
            F.col("did_abstain").alias("abstain"), "expected_refuse", (i % 3 != 0).alias("has_gold"),
            (i % 5 == 0).alias("by_guard"), (i % 2 == 0).alias("cites_gold"), (i % 7 != 0).alias("numbers_ok"),
            F.when(i % 4 != 0, i % 8 != 1).alias("claims_ok")
        )
    )


def claim_support(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations").where("role <> 'system'")
    return evaluation.claim_support(
        c.groupBy(F.col("conv_id").alias("qid")).agg(
            F.collect_list(
                F.struct(F.col("text").alias("claim"), (F.length("text") % 3 > 0).alias("supported"))
            ).alias("claims")
        )
    )


def slice_quota(spark, sf_dir):
    q = tables.read(spark, sf_dir, "benchmark").select(F.concat(F.lit("s"), F.col("item_id") % 7).alias("slice"))
    return evaluation.quota_gaps(q, spark.createDataFrame([(f"s{k}", 6) for k in range(8)], "slice string, quota long"))


def _questions(spark, sf_dir):
    return tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))


def dataset_overlap(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return evaluation.overlaps(
        q.where("id % 2 = 0"),
        q.where("id % 3 = 0").select(
            (F.col("id") + F.when(F.col("id") % 4 == 0, 1000).otherwise(0)).alias("id"),
            F.upper("question").alias("question")
        )
    )


def batch_upsert(spark, sf_dir):
    q = _questions(spark, sf_dir)
    new = q.where("id % 5 = 0").select((F.col("id") * 3).alias("id"), F.lit("new").alias("question"))
    return evaluation.upsert(q, new)


def _gold(spark, sf_dir):
    i = F.col("item_id")
    page = lambda n: F.struct(F.concat(F.lit("s"), n % 3).alias("source"), (n % 4).cast("int").alias("page"))
    return tables.read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("Q"), "item_id").alias("id"), F.lit("single_page").alias("slice"),
        F.col("text").alias("question"), (i % 3 != 0).alias("answerable"),
        F.when(i % 2 == 0, "answer").otherwise("refuse").alias("expected_behavior"),
        F.when(i % 4 != 1, F.array(page(i), page(i + 2), page(i))).otherwise(
            F.array().cast("array<struct<source:string,page:int>>")
        ).alias("gold_pages"),
        F.lit("").alias("supporting_quote"), F.lit(None).cast("string").alias("hazard"), F.lit("").alias("notes"),
    )


def gold_canonical(spark, sf_dir):
    g = evaluation.gold_violations(_gold(spark, sf_dir))
    return g.select(
        "id",
        F.array_join(
            F.transform("gold_pages", lambda p: F.concat(p["source"], F.lit(":"), p["page"].cast("string"))), ","
        ).alias("pages"),
        F.array_join("violations", ",").alias("violations")
    )


def dataset_hash(spark, sf_dir):
    return evaluation.content_hash(_gold(spark, sf_dir))


def outcome_stability(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    key = evaluation.outcome_key(F.col("event_id") % 2 == 0, F.array(F.lit("b"), F.lit("a")), F.col("event_type"))
    return evaluation.stability(
        e.select(
            "user_id", F.concat(F.lit("m"), F.col("user_id") % 10).alias("model"),
            F.when(F.col("user_id") % 10 < 5, F.lit("same")).otherwise(key).alias("outcome"),
            F.when((F.col("user_id") % 10 == 0) & (F.col("event_id") % 100 == 0), "boom").alias("error")
        )
    )


def outcome_keys(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return e.select(
        "event_id",
        evaluation.outcome_key(
            F.col("event_id") % 2 == 0, F.array(F.lit("b"), F.lit("a")), F.col("event_type")
        ).alias("outcome")
    )


def telemetry_rollup(spark, sf_dir):
    return telemetry.summarize(tables.telemetry(spark, sf_dir), tables.prices(spark), ["op"])


def telemetry_report(spark, sf_dir):
    return telemetry.report(
        tables.telemetry(spark, sf_dir), tables.prices(spark)
    ).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def span_summary(spark, sf_dir):
    return telemetry.spans(tables.telemetry(spark, sf_dir), tables.prices(spark), 9)


def cost_estimate(spark, sf_dir):
    p = telemetry.priced(tables.telemetry(spark, sf_dir), tables.prices(spark))
    return p.groupBy("model").agg(
        F.round(F.sum("cost"), 6).alias("est_cost_usd"), F.count_if("unpriced").alias("unpriced_calls")
    )


def transient_errors(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 5 != 0, 400 + F.col("event_id") % 120)
    return e.select("event_id", telemetry.transient(status, F.when(F.col("event_id") % 10 == 0, True)).alias("retry"))


def cache_hit_miss(spark, sf_dir):
    """Questions keyed by content against a cache that holds the even ones; evidence is the document of the same id."""
    items = tables.read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    docs = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("d"))
    chunk = F.array(F.struct(F.concat(F.lit("d#p1#"), "item_id").alias("chunk_id"), F.col("d").alias("text")))
    wanted = items.join(docs, "item_id").select("item_id", answers.answer_key("model-1", F.col("q"), chunk).alias("key"))
    hits, misses = answers.split_by_cache(
        wanted, wanted.where("item_id % 2 = 0").select("key", F.lit("cached").alias("answer"))
    )
    return hits.select("item_id", "key", F.lit("hit").alias("state")).unionByName(
        misses.select("item_id", "key", F.lit("miss").alias("state"))
    )


def vector_keys(spark, sf_dir):
    return tables.read(spark, sf_dir, "benchmark").select(
        "item_id", answers.vector_key(F.col("text"), "RETRIEVAL_QUERY").alias("key")
    )


def statistic_keys(spark, sf_dir):
    n = tables.read(spark, sf_dir, "nation")
    return n.select(
        "n_nationkey",
        answers.statistic_key(
            F.col("n_nationkey") / 4.0, F.col("n_nationkey") / 8.0, F.lit("wind"), F.lit(1960), F.lit(2022),
            "10,50,100", 300
        ).alias("key")
    )


def prompt_build(spark, sf_dir):
    """Prompts of the three best chunks, by their hash."""
    pages = tables.cleaned_pages(spark, sf_dir).select(F.col("doc_id").alias("ord"), "source", "page", "text", F.concat("source", F.lit("#p"), "page", F.lit("#0")).alias("chunk_id"))
    asked = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return answers.prompts(_lexical(spark, sf_dir, 3).join(pages, "ord").join(asked, "qid")).select(
        "qid", F.length("prompt").alias("n"), F.md5("prompt").alias("digest")
    )


def answer_pages(spark, sf_dir):
    """Citations of the offline stand-in's answers, one a page."""
    pages = tables.cleaned_pages(spark, sf_dir).select(F.col("doc_id").alias("ord"), "source", "page", "text", F.concat("source", F.lit("#p"), "page", F.lit("#0")).alias("chunk_id"))
    asked = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    retrieved = _lexical(spark, sf_dir, 3).join(pages, "ord").join(asked, "qid")
    raw = answers.call_model(answers.prompts(retrieved), answers.extractive_model).select("qid", "raw")
    allowed = retrieved.groupBy("qid").agg(F.collect_list("chunk_id").alias("allowed_ids"))
    return answers.cited_pages(answers.checked_answers(raw.join(allowed, "qid")).where("status = 'ok'"))


def scope_refusals(spark, sf_dir):
    return answers.scope_refusals(tables.questions(spark, sf_dir)).select("qid", "refused", "abstain_reason")


def tool_top_k(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select(
        "event_id", answers.clamped_top_k(F.col("event_id") % 25 - 5).alias("top_k")
    )


def forecast_rows(spark, sf_dir):
    """A forecast's parallel arrays as rows: packed by location first, then opened as its source does."""
    from tephra.sources.feeds import forecast_long

    d = tables.daily(spark, sf_dir).groupBy("location", "day").pivot(
        "variable", ["precipitation_sum", "temperature_2m_max"]
    ).agg(F.max("value"))
    last = d.groupBy("location").agg(F.max("day").alias("last"))
    d = d.join(last, "location").where("datediff(last, day) < 7")
    rows = F.array_sort(
        F.collect_list(F.struct("day", F.col("precipitation_sum").alias("p"), F.col("temperature_2m_max").alias("t")))
    )
    packed = d.groupBy("location").agg(rows.alias("r")).select(
        "location",
        F.struct(
            F.col("r.day").alias("time"), F.col("r.p").alias("precipitation_sum"),
            F.col("r.t").alias("temperature_2m_max"), F.col("r.p").alias("wind_speed_10m_max")
        ).alias("daily")
    )
    return forecast_long(packed).select(
        "location", F.date_format("day", "yyyy-MM-dd").alias("day"), "day_no", "variable",
        F.round("value", 6).alias("value")
    )


QUERIES = {f.__name__: f for f in (
    answered_questions, evidence_search, number_provenance, citation_integrity, citation_hits, refusal_matrix,
    trust_rates, claim_support, slice_quota, dataset_overlap, batch_upsert, gold_canonical, dataset_hash,
    outcome_stability, outcome_keys, telemetry_rollup, telemetry_report,
    span_summary, cost_estimate, transient_errors, cache_hit_miss, vector_keys, statistic_keys, prompt_build,
    answer_pages, scope_refusals, tool_top_k, forecast_rows,
)}

from tephra.plans.climate import _DAILY  # noqa: E402
from tephra.plans.corpus import _CLEAN, _FUSED, _LEXICAL, _PAGES, _SEMANTIC, _lexical_sql  # noqa: E402
from tephra.plans.front import _QUESTIONS, _SCOPE  # noqa: E402

_NUM = "list_distinct(regexp_extract_all({}, '[0-9]+(?:\\.[0-9]+)?'))"
_TEL = """
t as (select ts, event_type as op, 'm' || (event_id % 4) as model, value as latency_ms, cast(json_extract(props, '$.k') as bigint) as k, event_id % 3 as retries, event_type <> 'error' as ok, event_id % 7 = 0 as cached, user_id as span from events),
pr as (select * from (values ('m0', 0.30::double, 2.50::double), ('m1', 0.30, 2.50), ('m2', 0.15, 0.0)) as p(model, i, o)),
tp as (select t.*, pr.i is null as unpriced, case when cached or pr.i is null then 0.0 else k * 10 / 1e6 * pr.i + k / 1e6 * pr.o end as cost from t left join pr using (model))"""


_DAY = "strftime(ts, '%Y-%m-%d')"


def _rollup(by: str) -> str:
    pct = lambda q: f"coalesce((list_sort(list(latency_ms) filter (where not cached)))[least(floor({q} * count(*) filter (where not cached))::bigint, count(*) filter (where not cached) - 1) + 1], 0.0)"
    return f"""count(*) as calls, count(*) filter (where cached) as cache_hits, count(*) filter (where not ok) as failures, sum(retries)::bigint as retries, round(sum(cost), 6) as est_cost_usd,
  coalesce(array_to_string(list_sort(list(distinct model) filter (where unpriced)), ','), '') as unpriced_models, {pct(0.5)} as p50_ms, {pct(0.95)} as p95_ms from tp group by {by}"""


ORACLES = {
    "answered_questions": f"""with {_PAGES}, q as (select item_id as qid, text from benchmark union all select * from (values (-1, 'How do droughts change?'), (-2, 'Hail or heat?'), (-3, ''))),
guard as (select qid, text, {_SCOPE} as oos from q), live as (select qid, text from guard where oos is null), {_lexical_sql("pages", "live")},
{_SEMANTIC.replace("unit q, unit d where q.ord % 20 = 0", "unit q, unit d where q.ord % 20 = 0 and d.ord in (select doc_id from pages)")}, {_FUSED},
top as (select qid, ord from fused where rank = 1 and qid in (select qid from sem) and qid in (select qid from live) union all select qid, ord from lex where rank = 1 and qid not in (select qid from sem))
select qid, 'ok' as status, case when oos is null and ord is not null then left(p.text, 400) else '' end as answer, case when oos is null and ord is not null then source || '#p' || page || '#0' else '' end as citations,
  oos is not null or ord is null as abstain, case when oos is not null then 'Out of scope: this system assesses heatwave, extreme precipitation, wind only, and the question concerns ' || oos || '.' when ord is null then 'no excerpts' else '' end as abstain_reason, 0 as n_unknown
from guard left join top using (qid) left join pages p on p.doc_id = ord""",
    "evidence_search": f"""with {_PAGES}, {_lexical_sql("pages")}
select qid, rank, source || '#p' || page || '#0' as chunk_id, md5(text) as digest, 'bm25_only' as retrieval_mode from lex join pages on doc_id = ord where rank <= greatest(1, least(10, qid % 14 - 2))""",
    "dataset_hash": """with g as (select *, case when item_id % 4 <> 1 then [struct_pack(source := 's' || (item_id % 3), page := item_id % 4), struct_pack(source := 's' || ((item_id + 2) % 3), page := (item_id + 2) % 4)] else [] end as pages from benchmark)
select sha256('[' || string_agg('{"answerable": ' || (item_id % 3 <> 0)::varchar || ', "expected_behavior": "' || case when item_id % 2 = 0 then 'answer' else 'refuse' end || '", "gold_pages": ['
  || array_to_string(list_transform(list_sort(list_distinct(pages)), lambda p: '{"page": ' || p.page || ', "source": "' || p.source || '"}'), ', ') || '], "hazard": null, "id": "Q' || item_id || '", "notes": "", "question": ' || to_json(text)::varchar
  || ', "slice": "single_page", "supporting_quote": ""}', ', ' order by 'Q' || item_id) || ']') as content_hash from g""",
    "number_provenance": f"with p as (select doc_id, source, row_number() over (partition by source order by doc_id) as page, text from documents) select a.doc_id, len({_NUM.format('a.text')}) as n_numbers, len(list_filter({_NUM.format('a.text')}, lambda x: not list_contains(coalesce({_NUM.format('b.text')}, []), x))) = 0 as ok from p a left join p b on a.source = b.source and b.page = a.page + 1",
    "citation_integrity": """select event_id as qid, case event_id % 6 when 0 then 'ok' when 1 then 'invalid_citation' when 2 then 'uncited' when 3 then 'ok' else 'malformed' end as status,
  case event_id % 6 when 0 then 'a' || event_id when 1 then 'b' when 2 then 'c' when 3 then '' end as answer, case event_id % 6 when 0 then false when 1 then false when 2 then false when 3 then true end as abstain,
  case when event_id % 6 = 3 then 'no' else '' end as abstain_reason, case event_id % 6 when 0 then 0 when 1 then 1 when 2 then 0 when 3 then 0 end as n_unknown from events""",
    "citation_hits": f"""with {_LEXICAL}, {_PAGES}, gold as (select distinct item_id as qid, source, page from (select item_id, {_CLEAN} as item from benchmark) join pages on contains(pages.text, item)),
h as (select distinct qid from lex join (select doc_id as ord, source, row_number() over (partition by source order by doc_id) as page from documents) using (ord) join gold using (qid, source, page) where rank <= 3)
select item_id as qid, item_id in (select qid from h) as hit from benchmark""",
    "refusal_matrix": "select count(*) filter (where toxic <> 1 and quality <> 0) as correct_answer, count(*) filter (where toxic = 1 and quality = 0) as correct_refuse, count(*) filter (where toxic <> 1 and quality = 0) as false_refuse, count(*) filter (where toxic = 1 and quality <> 0) as false_answer from labels",
    "trust_rates": """with r as (select quality = 0 as ab, toxic = 1 as ex, doc_id % 3 <> 0 as g, doc_id % 5 = 0 as gu, doc_id % 2 = 0 as ci, doc_id % 7 <> 0 as nu, case when doc_id % 4 <> 0 then doc_id % 8 <> 1 end as cl from labels)
select 'citation_validity' as "check", count(*) filter (where not ab and g and ci) as passed, count(*) filter (where not ab and g) as total from r
union all select 'numeric_provenance', count(*) filter (where not ab and nu), count(*) filter (where not ab) from r
union all select 'grounded_refusals', count(*) filter (where ab and ex and g and not gu and ci), count(*) filter (where ab and ex and g and not gu) from r
union all select 'answers_fully_supported', count(*) filter (where not ab and cl), count(*) filter (where not ab and cl is not null) from r
union all select 'scope_guard_refusals', count(*) filter (where ab and ex and g and gu), count(*) filter (where ab and ex and g and gu) from r""",
    "claim_support": "select conv_id as qid, count(*)::int as n_claims, (count(*) filter (where length(text) % 3 > 0))::int as n_supported, count(*) = count(*) filter (where length(text) % 3 > 0) as all_supported from conversations where role <> 'system' group by conv_id",
    "slice_quota": "with c as (select 's' || (item_id % 7) as slice, count(*) as n from benchmark group by 1), q as (select 's' || k as slice, 6 as quota from range(8) t(k)) select coalesce(c.slice, q.slice) as slice, coalesce(n, 0) as n, coalesce(quota, 0)::bigint as quota from c full join q on c.slice = q.slice where coalesce(n, 0) <> coalesce(quota, 0)",
    "dataset_overlap": r"""with a as (select item_id as id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as t from benchmark where item_id % 2 = 0), b as (select item_id + case when item_id % 4 = 0 then 1000 else 0 end as id, trim(regexp_replace(lower(upper(text)), '\s+', ' ', 'g')) as t from benchmark where item_id % 3 = 0)
select 'id' as kind, id::varchar as value from (select id from a intersect select id from b) union all select 'text', t from (select t from a intersect select t from b)""",
    "batch_upsert": "select item_id as id, text as question from benchmark where item_id not in (select item_id * 3 from benchmark where item_id % 5 = 0) union all select item_id * 3, 'new' from benchmark where item_id % 5 = 0",
    "gold_canonical": """with g as (select item_id as i, case when item_id % 4 <> 1 then list_sort(list_distinct([{'s': 's' || (item_id % 3), 'p': item_id % 4}, {'s': 's' || ((item_id + 2) % 3), 'p': (item_id + 2) % 4}])) else [] end as pages from benchmark)
select 'Q' || i as id, array_to_string(list_transform(pages, lambda p: p.s || ':' || p.p), ',') as pages,
  array_to_string(list_filter([case when i % 3 <> 0 and len(pages) = 0 then 'answerable_without_gold' end, case when i % 3 = 0 and len(pages) > 0 then 'gold_without_answerable' end, case when i % 2 = 0 and i % 3 = 0 then 'answer_expected_of_unanswerable' end, case when len(list_filter(pages, lambda p: p.p < 1)) > 0 then 'page_below_one' end], lambda x: x is not null), ',') as violations from g""",
    "outcome_stability": """with o as (select 'm' || (user_id % 10) as model, case when user_id % 10 < 5 then 'same' else (event_id % 2 = 0)::varchar || event_type end as k, case when user_id % 10 = 0 and event_id % 100 = 0 then 1 end as e from events)
select model, count(*) as repeats, count(distinct k) as distinct_outcomes, count(e) as errors, count(distinct k) <= 1 and count(e) = 0 as deterministic from o group by model""",
    "outcome_keys": """select event_id, '{"abstain":' || (event_id % 2 = 0) || ',"answer_sha":"' || left(sha256(event_type), 12) || '","citations":["a","b"]}' as outcome from events""",
    "telemetry_rollup": f"with {_TEL} select op, {_rollup('op')}",
    "telemetry_report": f"with {_TEL} select strftime(ts, '%Y-%m-%d') as day, op, {_rollup(_DAY + ', op')} union all by name select null as day, op, {_rollup('op')}",
    "span_summary": f"with {_TEL} select span, count(*) filter (where not cached) as calls, count(*) filter (where cached) as cache_hits, sum(retries)::bigint as retries, count(*) filter (where not ok) as failures, coalesce(sum(k * 10) filter (where not cached), 0)::bigint as tokens_in, coalesce(sum(k) filter (where not cached), 0)::bigint as tokens_out, round(sum(cost), 9) as est_cost_usd from tp group by span",
    "cost_estimate": f"with {_TEL} select model, round(sum(cost), 6) as est_cost_usd, count(*) filter (where unpriced) as unpriced_calls from tp group by model",
    "transient_errors": "select event_id, case when event_id % 10 = 0 then true when event_id % 5 = 0 then false else 400 + event_id % 120 = 429 or 400 + event_id % 120 >= 500 end as retry from events",
    "cache_hit_miss": "select item_id, sha256('model-1' || b.text || 'd#p1#' || item_id || sha256(d.text)) as key, case when item_id % 2 = 0 then 'hit' else 'miss' end as state from benchmark b join documents d on d.doc_id = item_id",
    "vector_keys": "select item_id, sha256('gemini-embedding-2|768|RETRIEVAL_QUERY|' || text) as key from benchmark",
    "statistic_keys": "select n_nationkey, sha256(round(n_nationkey / 4.0, 4)::double::varchar || '|' || round(n_nationkey / 8.0, 4)::double::varchar || '|wind|1960|2022|10,50,100|300') as key from nation",
    "prompt_build": f"""with {_LEXICAL}, {_PAGES}, e as (select qid, string_agg('<excerpt chunk_id="' || source || '#p' || page || '#0" source="' || source || '" page="' || page || '">' || chr(10) || text || chr(10) || '</excerpt>', chr(10) order by rank) as x from lex join pages on doc_id = ord where rank <= 3 group by qid),
p as (select qid, '{answers.instructions().replace("'", "''")}' || chr(10) || chr(10) || x || chr(10) || chr(10) || 'Question: ' || text as prompt from e join benchmark on item_id = qid) select qid, length(prompt)::int as n, md5(prompt) as digest from p""",
    "answer_pages": f"with {_LEXICAL}, {_PAGES} select qid, source, page, 0 as pos from lex join pages on doc_id = ord where rank = 1",
    "scope_refusals": f"with {_QUESTIONS} select qid, {_SCOPE} is not null as refused, 'Out of scope: this system assesses heatwave, extreme precipitation, wind only, and the question concerns ' || {_SCOPE} || '.' as abstain_reason from q where qid >= 0",
    "tool_top_k": "select event_id, greatest(1, least(event_id % 25 - 5, 10)) as top_k from events",
    "forecast_rows": f"""with {_DAILY}, w as (select d.*, row_number() over (partition by location order by day)::int as day_no from daily d join (select location, max(day) as last from daily group by 1) using (location) where date_diff('day', day, last) < 7)
select location, strftime(day, '%Y-%m-%d') as day, day_no, v as variable, round(case when v = 'temperature_2m_max' then temp else precip end, 6) as value from w, (select unnest(['precipitation_sum', 'temperature_2m_max', 'wind_speed_10m_max']) as v)""",
}
