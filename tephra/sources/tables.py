"""Tables in a directory of Parquet files, and the views that stand in for pages, series, questions and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.functions.text import clean_text
from tephra.operators.numbering import row_numbers
from tephra.operators.retrieval import small
from tephra.sources.scratch import materialized

#: Stand-in gazetteer and regions: positions by rule, so that no data is shipped.
RINGS = (
    (0, "AAA", "Region of the North-West", ((-180.0, 10.0), (0.0, 10.0), (0.0, 60.0), (-180.0, 60.0))),
    (1, "BBB", "Region of the North-East", ((0.0, 10.0), (180.0, 10.0), (180.0, 60.0), (0.0, 60.0))),
    (2, "CCC", "Region of the South-West", ((-180.0, -60.0), (0.0, -60.0), (0.0, -10.0), (-180.0, -10.0))),
    (
        3, "DDD", "Region of the South-East",
        ((0.0, -60.0), (100.0, -60.0), (100.0, -35.0), (50.0, -35.0), (50.0, -10.0), (0.0, -10.0))
    ),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, page, text): documents as the pages of their source, in order of ids.

    Pages are numbered on ids alone, so that a source with a third of all documents moves no text into one task.
    """
    docs = read(spark, sf_dir, "documents")
    pages = row_numbers(
        docs.select("doc_id", "source"), ["source"], ["doc_id"], "page"
    ).select("doc_id", F.col("page").cast("int").alias("page"))
    return docs.select("doc_id", "source", "text").join(pages, "doc_id").select("doc_id", "source", "page", "text")


def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pages(spark, sf_dir).select(
        "doc_id", "source", "page", clean_text("text").alias("text")
    ).where("text <> ''")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, day, variable, value): two daily series for each nation, from line items of its suppliers."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    series = lines.join(suppliers, "l_suppkey").groupBy(
        F.col("s_nationkey").alias("location"), F.to_date("l_shipdate").alias("day")
    )
    wide = series.agg(F.sum("l_quantity").alias("precipitation_sum"), F.max("l_extendedprice").alias("temperature_2m_max"))
    return wide.unpivot(["location", "day"], ["precipitation_sum", "temperature_2m_max"], "variable", "value")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of model calls."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "ts", F.col("event_type").alias("op"), F.concat(F.lit("m"), F.col("event_id") % 4).alias("model"),
        F.col("value").alias("latency_ms"), (k * 10).alias("tokens_in"), k.alias("tokens_out"),
        (F.col("event_id") % 3).alias("retries"), (F.col("event_type") != "error").alias("ok"),
        (F.col("event_id") % 7 == 0).alias("cached"), F.col("user_id").alias("span"),
    )


def prices(spark: SparkSession) -> DataFrame:
    """Prices of the stand-in models; one of the four has none."""
    return spark.createDataFrame(
        [("m0", 0.30, 2.50), ("m1", 0.30, 2.50), ("m2", 0.15, 0.0)], "model string, price_in double, price_out double"
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, ord, name, latitude, longitude, country) of each nation, twice, the second time further down."""
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("country"))
    one = n.join(r, "n_regionkey").select(
        F.concat(F.lit("Nation"), "n_nationkey").alias("place"), F.lit(0).alias("ord"),
        F.concat(F.lit("Nation"), "n_nationkey").alias("name"),
        (F.col("n_nationkey") * 37 % 120 - 60).cast("double").alias("latitude"),
        (F.col("n_nationkey") * 83 % 340 - 170).cast("double").alias("longitude"), "country",
    )
    return one.unionByName(one.withColumns({"ord": F.lit(1), "latitude": F.col("latitude") + 1}))


def regions(spark: SparkSession) -> DataFrame:
    """(ord, acronym, name, ring) of the stand-in regions, one of them concave."""
    return spark.createDataFrame(
        list(RINGS), "ord int, acronym string, name string, ring array<struct<lon: double, lat: double>>"
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, text): free-text questions over nations and kinds of events."""
    n = read(spark, sf_dir, "nation").select("n_nationkey")
    kinds = read(spark, sf_dir, "events").select("event_type").distinct()
    word = F.when(
        F.col("event_type") == "click", "heat waves"
    ).when(F.col("event_type") == "view", "rainfall").when(F.col("event_type") == "purchase", "winds").when(
        F.col("event_type") == "signup", "droughts"
    ).otherwise("crowds")
    number = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(
        F.col("event_type") == "purchase", 2
    ).when(F.col("event_type") == "signup", 3).otherwise(4)
    span = F.when(
        F.col("n_nationkey") % 5 == 0, F.concat(F.lit("over the next "), F.col("n_nationkey") + 1, F.lit(" days"))
    ).when(F.col("n_nationkey") % 5 == 1, "next two weeks").when(F.col("n_nationkey") % 5 == 2, "tomorrow").when(
        F.col("n_nationkey") % 5 == 3, "within three days"
    ).otherwise("soon")
    place = F.when(F.col("n_nationkey") % 6 == 5, "nowhere").otherwise(
        F.concat(F.lit("Nation"), F.col("n_nationkey") + F.when(F.col("n_nationkey") % 8 == 7, 100).otherwise(0))
    )
    # Twenty-five nations and five kinds: both sides are fixed.
    both = n.join(small(kinds, 100))
    return both.select(
        (F.col("n_nationkey") * 10 + number).cast("long").alias("qid"),
        F.concat(F.lit("How risky are "), word, F.lit(" in "), place, F.lit(" "), span, F.lit("?")).alias("text")
    )


def benchmark_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, source, page): pages that hold a benchmark item word for word.

    Items meet pages on their first five words, told by their hash without the text beside it, then whole texts are compared.
    """
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), clean_text("text").alias("item"))
    items = items.withColumn("k", F.xxhash64(F.slice(F.split("item", " "), 1, 5)))
    pages = cleaned_pages(spark, sf_dir).withColumn("w", F.split("text", " "))
    runs = pages.select(
        "doc_id",
        F.explode(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.xxhash64(F.slice("w", i, 5))))
        ).alias("k")
    )
    met = materialized(runs.join(small(items.select("k", "qid")), "k").select("doc_id", "qid"), "gold-candidates")
    both = pages.select("doc_id", "source", "page", "text").join(small(met), "doc_id").join(
        small(items.select("qid", "item")), "qid"
    )
    return both.where(F.contains("text", "item")).select("qid", "source", "page").distinct()


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, page, text): regional tables made of nations: with a caption, going on without one, prose, and again a table."""
    rows = read(spark, sf_dir, "nation").select(
        "n_regionkey", "n_nationkey",
        F.concat(
            F.lit("Nation "), "n_nationkey", F.lit(" (N"), "n_nationkey", F.lit(") "),
            F.repeat(F.concat("n_name", F.lit(" projected change ")), F.lit(20) + F.col("n_nationkey") * 3)
        ).alias("row")
    )
    packed = rows.groupBy("n_regionkey").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]), ""
        ).alias("rows")
    )
    r = read(spark, sf_dir, "region").join(packed, F.col("r_regionkey") == F.col("n_regionkey"))
    caption = F.concat(
        F.lit("Table 1."), "r_regionkey", F.lit(" | Observed trends of "), "r_name", F.lit(" at two levels | ")
    )
    text = {1: F.concat(caption, "rows"), 2: F.col("rows"), 3: F.concat(F.lit("Prose about "), "r_name"), 4: F.col("rows")}
    pages = r.select(
        F.concat(F.lit("T"), "r_regionkey").alias("source"),
        F.explode(F.map_from_arrays(F.array(*map(F.lit, text)), F.array(*text.values()))).alias("page", "text")
    )
    return pages.select("source", F.col("page").cast("int"), F.trim("text").alias("text"))
