"""The corpus pipeline: five stages over ``documents``, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tephra.llm.common import discard, temporary, written
from tephra.llm.decontaminate import contaminated
from tephra.llm.jaccard import ngram_jaccard
from tephra.llm.langid import fit, is_held_out, predict
from tephra.llm.packing import pack, words_and_end
from tephra.llm.suffix import PASSAGES, remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the calibrated classifier accepts; those without letters or below its thresholds go.

    Null, empty and wordless texts have no letters and go. Texts of any length are read whole. Rows of one text, repeated
    rows and rows of null id are judged alike, by the text alone. Null languages teach nothing; without any language in the
    table nothing is accepted. An empty table gives an empty one; columns beside those of documents are left out.
    """
    model = fit(docs.where(~is_held_out()))
    return predict(docs, model, keep=COLUMNS).where("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component of near duplicates; of rows that repeat it, one.

    A row without an id takes part like others, after all that have one: of a component without ids the text of the smallest
    hash stays. Null, empty and wordless texts have no words that could repeat and stay, all of them. Several texts of one
    id stay where one of them does. An empty table gives an empty one; columns beside those of documents are left out.
    """
    ids = F.coalesce("doc_id", F.shiftright(F.xxhash64("text"), 2).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62))
    given = docs.select(*COLUMNS, ids.alias("__id"))
    found = ngram_jaccard(given, id_col="__id")
    stay = found.where("component_id = id or n_shingles = 0").select(
        F.col("id").alias("__id"), (F.col("n_shingles") > 0).alias("full")
    ).distinct()
    kept = given.join(stay.hint("shuffle_hash"), "__id")
    place = F.row_number().over(Window.partitionBy("__id", F.xxhash64("text")).orderBy("n_chars"))
    return kept.withColumn("place", place).where("place = 1 or not full").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words that occur more than once, in one document or in several.

    Words are equal whatever white space parts them. Texts of 50 words or less, null and empty ones lose nothing (a null
    text becomes an empty one); long texts are read whole. Repeated rows, with an id or without, repeat one another and lose
    what is over 50 words. Texts that lose all stay as empty ones. An empty table gives an empty one; columns beside those of
    documents are left out.
    """
    out = remove_repeats(docs, keep=["doc_id", "lang", "source"], rules=(PASSAGES,), as_text=True)
    return out.select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text no benchmark item was found.

    A text decides alone, so rows without an id and rows of one id are judged like others; texts are told apart by a hash of
    64 bits and their length. Null, empty and wordless texts hold no item and stay. Long texts are searched whole. An empty
    table, of documents or of items, removes nothing; columns beside those of documents are left out.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit(""))))
    given = docs.select(*COLUMNS, key.alias("__key"))
    found = contaminated(given, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key")
    return given.join(found.select(F.col("id").alias("__key")).distinct(), "__key", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document, a row for each.

    Null and empty texts are documents of one token, the end. Null ids come first among equal lengths; rows that agree in
    length and id can't be told apart and have slots next to each other. Documents longer than a batch have one of their
    own. An empty table gives an empty one.
    """
    return pack(docs, words_and_end())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Trained models, components and dynamic programmes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage leaves behind goes with the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary() as keep:
            before, docs = docs, keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(before)
    return docs
