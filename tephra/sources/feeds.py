"""Forecast and archive responses, gold sets, telemetry logs and content-keyed caches as sources and sinks."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.operators.chunking import chunk_pages, pages_of
from tephra.schemas import FORECAST, FORECAST_SERIES, GOLD_QUESTION, TELEMETRY


#: Tries of a request and seconds before the second one, doubled before each further one.
TRIES, PAUSE = 3, 0.5


class RequestError(Exception):
    """What a fetcher raises: the status of a response, or none where the transport failed."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def fetched(
    requests: DataFrame, fetch: Callable[[dict], str], tries: int = TRIES, pause: Callable[[int], None] | None = None
) -> DataFrame:
    """The requests with body, error and tries: one response each through a pluggable fetcher, in Arrow batches.

    ``fetch`` gets a request's columns and returns the body, or raises :class:`RequestError`. A failed transport, status 429
    and statuses from 500 on are tried again, ``tries`` times in all; any other failure, or the last, is a row with an error.
    """
    pause = pause or (lambda n: time.sleep(PAUSE * 2**n))
    columns = requests.columns

    def run(batches):
        for pdf in batches:
            rows = []
            for request in pdf.to_dict("records"):
                body = error = None
                for n in range(tries):
                    try:
                        body, error = fetch(request), None
                        break
                    except RequestError as e:
                        error = str(e)
                        if e.status is not None and e.status != 429 and e.status < 500:
                            break
                        if n + 1 < tries:
                            pause(n)
                rows.append((*(request[c] for c in columns), body, error, n + 1))
            yield pd.DataFrame(rows, columns=[*columns, "body", "error", "tries"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema]
    return requests.mapInPandas(run, ", ".join([*kinds, "body string", "error string", "tries int"]))


def forecast_bodies(responses: DataFrame) -> DataFrame:
    """Forecast responses out of the bodies of :func:`fetched`; rows without one are left out."""
    found = responses.where("body is not null").select(F.from_json("body", FORECAST).alias("r"))
    return found.select("r.*")


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecast responses (JSON, one a line or a file) with the location they answer for."""
    return spark.read.schema(FORECAST).option("multiLine", True).json(path)


def forecast_long(responses: DataFrame) -> DataFrame:
    """(location, day, day_no, variable, value) of responses whose days and series are parallel arrays."""
    key = ["location"] if "location" in responses.columns else ["latitude", "longitude"]
    series = list(FORECAST_SERIES[h] for h in ("extreme_precip", "heatwave", "wind"))
    rows = responses.select(
        *key, F.posexplode(F.arrays_zip(*(F.col(f"daily.{c}").alias(c) for c in ("time", *series)))).alias("i", "r")
    )
    wide = rows.select(
        *key, F.col("r.time").alias("day"), (F.col("i") + 1).alias("day_no"),
        *(F.col(f"r.{v}").alias(v) for v in series)
    )
    return wide.unpivot([*key, "day", "day_no"], series, "variable", "value")


def archive_long(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """(day, variable, value) of an archive response; days are local days and stay so, missing values stay null."""
    response = spark.read.schema(
        f"timezone string, daily struct<time: array<string>, {variable}: array<double>>"
    ).option("multiLine", True).json(path)
    return response.select(
        F.explode(F.arrays_zip(F.col("daily.time").alias("t"), F.col(f"daily.{variable}").alias("v"))).alias("r")
    ).select(F.to_date("r.t").alias("day"), F.lit(variable).alias("variable"), F.col("r.v").alias("value"))


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a gold-set file: an object with ``questions`` or a bare list."""
    raw = spark.read.schema(
        f"questions {GOLD_QUESTION.simpleString().join(['array<', '>'])}"
    ).option("multiLine", True).json(path)
    whole = raw.where("questions is not null").select(F.inline("questions"))
    bare = spark.read.schema(GOLD_QUESTION).option("multiLine", True).json(path).where("id is not null")
    return whole.unionByName(bare)


def append_telemetry(events: DataFrame, path: str) -> None:
    """Append events to the log, a folder for each day."""
    events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.partitionBy("day").mode("append").json(path)


def telemetry_log(spark: SparkSession, path: str) -> DataFrame:
    """All events of the log and their ``day``; lines torn by a crash are passed over.

    Days are told by the names of files or folders (``2024-01-02.jsonl``, ``day=2024-01-02``), as a log is cut by the clock of
    the process that wrote it; a file without a day in its name has those of its events.
    """
    log = spark.read.schema(TELEMETRY).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    named = F.regexp_extract("_metadata.file_path", r"([0-9]{4}-[0-9]{2}-[0-9]{2})[^0-9]*[^/]*(?:/[^/]*)?$", 1)
    return log.withColumn("day", F.coalesce(named.try_cast("date"), F.to_date("ts")))


def append_cache(rows: DataFrame, path: str) -> None:
    """Add (key, …) rows to a cache table."""
    rows.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache's rows, the newest a key being any one of equal keys: keys are content hashes. Empty where there is none."""
    try:
        return spark.read.schema(schema).parquet(path).dropDuplicates(["key"])
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_artifact(metrics: DataFrame, path: str, **about: str) -> None:
    """Write evaluation results as JSON with columns that tell the run: set, model, time."""
    metrics.withColumns({k: F.lit(v) for k, v in about.items()}).coalesce(1).write.mode("overwrite").json(path)


def pages_from_html(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, text): files of a folder as single pages, tags taken out."""
    files = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(
        F.regexp_replace(F.decode("content", "UTF-8"), r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " "
    )
    return pages_of(
        files.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.lit(1).alias("page"), text.alias("text"))
    )


def pages_from_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, text) of PDF files, pages counted from 1; needs a PDF reader on the executors, which is optional."""

    def read(batches):
        from pypdf import PdfReader
        from io import BytesIO

        for pdf in batches:
            rows = [
                (re.split(r"[/\\]", p)[-1], n, page.extract_text() or "")
                for p, content in zip(pdf["path"], pdf["content"])
                for n, page in enumerate(PdfReader(BytesIO(content)).pages, 1)
            ]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    return pages_of(
        spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(
            read, "source string, page int, text string"
        )
    )


def fingerprint(pages: DataFrame, version: str) -> str:
    """Identity of a chunking result: a hash over the pages' hashes, which needs no order, and the chunker's version."""
    row = pages.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("source", "page", "text").cast("decimal(38,0)")).alias("s")
    ).select(F.substring(F.sha2(F.concat_ws("|", "n", "s", F.lit(version)), 256), 1, 16)).first()
    return row[0]


def cached_chunks(pages: DataFrame, path: str, version: str = "1", **parameters) -> DataFrame:
    """Chunks of the pages from the table at ``path``, if its fingerprint is theirs; else chunked anew and written."""
    spark, mark = pages.sparkSession, fingerprint(pages, f"{version}|{sorted(parameters.items())}")
    place = f"{path}/fingerprint={mark}"
    try:
        return spark.read.parquet(place)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    chunk_pages(pages, **parameters).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
