"""End-to-end plans: assess questions, retrieve evidence, answer and evaluate."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.functions.text import evidence_question
from tephra.operators import answers, evaluation, extremes, places, retrieval, verdict
from tephra.schemas import FORECAST_SERIES, HAZARD_SERIES, HAZARD_UNITS

Model = Callable[[list[str]], list[str]]
Embedder = Callable[[list[str]], list[list[float]]]
_log = logging.getLogger(__name__)
_TREND = "struct<significant: boolean, slope_per_decade: double, p_value: double, evaluated_at: double>"


def assess(
    questions: DataFrame, gazetteer: DataFrame, regions: DataFrame, daily: DataFrame, forecast: DataFrame,
    chunks: DataFrame | None = None,
    model: Model | None = None, boot: int = extremes.BOOT, top_k: int = 8, **retrieval_by,
) -> DataFrame:
    """One report for each free-text question (qid, text): parse, locate, fit, compare, cite.

    ``daily`` and ``forecast`` have latitude, longitude, day, variable, value; ``chunks`` has ord, chunk_id, source, page and
    text. Refused questions never reach a fit or a model. A location without a series still gets a report, on fixed
    thresholds. What fails without taking the report along: without chunks or a model, or where the model's output can't be
    used, it is ungrounded and says so; ``retrieval_by`` goes to :func:`answered`. Malformed tables fail the whole plan.
    """
    asked = places.located(questions, gazetteer, regions)
    live = asked.where("refusal is null")
    forecast_of = F.create_map(*(F.lit(x) for p in FORECAST_SERIES.items() for x in p))
    archive_of = F.create_map(*(F.lit(x) for p in HAZARD_SERIES.items() for x in p))
    unit_of = F.create_map(*(F.lit(x) for p in HAZARD_UNITS.items() for x in p))
    wanted = live.select("qid", "latitude", "longitude", "horizon_days", forecast_of[F.col("hazard")].alias("variable"))
    day = forecast.groupBy("latitude", "longitude").agg(F.min("day").alias("first"))
    dated = forecast.join(day, ["latitude", "longitude"]).withColumn("day_no", F.datediff("day", "first") + 1)
    peaks = dated.join(
        wanted, ["latitude", "longitude", "variable"]
    ).where("day_no <= horizon_days").groupBy("qid").agg(F.max("value").alias("peak"))

    # Each place and series is fitted once, however many questions ask for it.
    place = F.concat_ws("|", "latitude", "longitude", "variable")
    needed = live.select("latitude", "longitude", archive_of[F.col("hazard")].alias("variable")).distinct()
    series = daily.join(
        retrieval.small(needed), ["latitude", "longitude", "variable"], "left_semi"
    ).withColumn("location", place)
    stats = extremes.hazard_statistics(extremes.block_maxima(series), boot=boot).select(
        "location", F.col("n_blocks").alias("n_years"), "return_levels", "trend"
    )
    keyed = asked.withColumn("variable", archive_of[F.col("hazard")]).withColumn("place_key", place)
    run = keyed.join(peaks, "qid", "left").join(stats.withColumnRenamed("location", "place_key"), "place_key", "left")
    if chunks is not None and model is not None:
        evidence = live.select("qid", evidence_question(F.col("hazard"), F.col("location")).alias("text"))
        found = answered(evidence, chunks, model, top_k, **retrieval_by)
        cited = answers.cited_pages(found.where("status = 'ok' and not abstain"))
        pages = cited.groupBy("qid").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "source", "page"))),
                lambda c: F.struct(c["source"].alias("source"), c["page"].alias("page"))
            ).alias("citations")
        )
        grounded = found.where("status = 'ok' and not abstain").select("qid", "answer").join(pages, "qid")
        run = run.join(grounded, "qid", "left")
    else:
        run = run.withColumns(
            {
                "answer": F.lit(None).cast("string"),
                "citations": F.lit(None).cast("array<struct<source:string,page:int>>")
            }
        )
    return verdict.reports(
        run.select(
            "qid", "location", "hazard", "horizon_days", "refusal", "peak", "variable",
            unit_of[F.col("hazard")].alias("unit"), "n_years",
            F.transform(
                "return_levels",
                lambda r: F.struct(r["return_period"].alias("return_period"), r["level"].alias("level"))
            ).alias("return_levels"),
            F.lit("point_interpolated_reanalysis").alias("representativeness"),
            F.when(
                F.col("trend").isNotNull(),
                F.struct("trend.significant", "trend.slope_per_decade", "trend.p_value", "trend.evaluated_at")
            ).cast(_TREND).alias("trend"),
            "answer", "citations",
        )
    )


def retrieved(
    questions: DataFrame, chunks: DataFrame, top_k: int, vectors: DataFrame | None = None, embedder: Embedder | None = None,
    question_vectors: DataFrame | None = None, vector_cache: DataFrame | None = None,
) -> DataFrame:
    """(qid, ord, rank, retrieval_mode): fused lexical and dense rankings, lexical ones where a question has no vector.

    ``vectors`` has ord and embedding of the chunks. Questions come with ``question_vectors`` (qid, embedding), or an embedder
    makes them, probed first. Without either, or where the probe fails, all rankings are lexical and a warning says why.
    """
    lexical = retrieval.bm25(chunks, questions, max(top_k, retrieval.CANDIDATES))
    if question_vectors is None and vectors is not None:
        ok, detail = answers.embedding_available(embedder)
        if ok:
            question_vectors, _ = answers.embedded(
                questions.select("qid", "text"), embedder, "RETRIEVAL_QUERY", vector_cache
            )
        else:
            _log.warning("%s: retrieval is lexical only", detail)
    if vectors is None or question_vectors is None:
        return lexical.where(F.col("rank") <= top_k).select("qid", "ord", "rank", F.lit("bm25_only").alias("retrieval_mode"))
    asked = question_vectors.join(questions.select("qid"), "qid", "left_semi")
    return retrieval.retrieve(lexical, retrieval.cosine(vectors, asked), top_k)


def answered(
    questions: DataFrame, chunks: DataFrame, model: Model, top_k: int = 8, cache: DataFrame | None = None,
    name: str = "offline", **retrieval_by
) -> DataFrame:
    """(qid, status, answer, citations, abstain, abstain_reason, unknown): guard, retrieve, cache, model, check.

    Questions that the guard refuses abstain before any retrieval. ``cache`` has key and raw; only misses reach the model,
    whose ``name`` is part of the key. ``retrieval_by`` goes to :func:`retrieved`.
    """
    guarded = answers.scope_refusals(questions)
    live = questions.join(guarded.where("not refused").select("qid"), "qid", "left_semi")
    found = retrieved(live, chunks, top_k, **retrieval_by)
    # Questions for which nothing is found reach the model too, with no excerpts.
    ranked = live.withColumnRenamed("text", "question").join(found.join(chunks, "ord"), "qid", "left")
    excerpt = F.when(F.col("chunk_id").isNotNull(), F.struct("rank", "chunk_id", "text"))
    packed = ranked.groupBy("qid", "question").agg(F.array_sort(F.collect_list(excerpt)).alias("c"))
    key = answers.answer_key(name, F.col("question"), F.col("c")).alias("key")
    keyed = packed.select("qid", key, F.transform("c", lambda c: c["chunk_id"]).alias("allowed_ids"))
    prompts = answers.prompts(ranked.select("qid", "question", "rank", "chunk_id", "source", "page", "text"))
    if cache is None:
        raw = answers.call_model(prompts, model, name=name).select("qid", "raw")
    else:
        hits, misses = answers.split_by_cache(keyed.select("qid", "key"), cache)
        asked = prompts.join(misses.select("qid"), "qid", "left_semi")
        raw = hits.select("qid", "raw").unionByName(answers.call_model(asked, model, name=name).select("qid", "raw"))
    checked = answers.checked_answers(raw.join(keyed.select("qid", "allowed_ids"), "qid"))
    refused = guarded.where("refused").select(
        "qid", F.lit("ok").alias("status"), F.lit("").alias("answer"),
        F.array().cast("array<string>").alias("citations"), F.lit(True).alias("abstain"), "abstain_reason",
        F.array().cast("array<string>").alias("unknown")
    )
    return checked.unionByName(refused)


def evaluate(rankings: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """Recall, intervals and reciprocal rank by retriever and slice, and for answered and refused questions as wholes.

    ``rankings`` has retriever, qid, source, page, rank; ``questions`` qid, slice, expected_behavior.
    """
    ranks = evaluation.first_gold_rank(rankings, gold, ["retriever", "qid"]).join(questions, "qid")
    both = F.explode(
        F.array(
            "slice",
            F.when(F.col("expected_behavior") == "answer", "HEADLINE (answer)").otherwise("diagnostic (refuse)")
        )
    )
    return evaluation.recall_report(ranks.withColumn("label", both), ["retriever", "label"])
