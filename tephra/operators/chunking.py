"""Pages into chunks: row-atomic table segments, carried captions and overlapping windows that end at spaces."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tephra.functions.text import clean_text, is_mostly_unmappable
from tephra.schemas import REGIONS

MAX_CHARS, OVERLAP = 1200, 150
# FIXED VALUE: a table's caption.
CAPTION_PATTERN = r"Table [0-9]+\.[0-9]+\s*\|\s*[^|]{0,160}"


def region_pattern(names: dict[str, str] | None = None) -> str:
    """One pattern for ``Name (ACR)`` of every region; spaces, hyphens and slashes between words are alike."""
    escape = lambda w: "".join(c if c.isalnum() else f"\\{c}" for c in w)
    rows = []
    for acronym, name in (names or REGIONS).items():
        words = name.replace("-", " ").replace("/", " ").split()
        rows.append(r"[\s\-/]+".join(map(escape, words)) + rf"\s*\({acronym}\)")
    return "|".join(rows)


def pages_of(raw: DataFrame, text_col: str = "text") -> DataFrame:
    """(source, page, text): cleaned pages; mostly unmappable and blank ones are dropped."""
    kept = raw.where(~F.coalesce(is_mostly_unmappable(text_col), F.lit(False)))
    return kept.select("source", "page", clean_text(text_col).alias("text")).where("text <> ''")


def segments(text: Column, pattern: str) -> Column:
    """array<struct<label, text>>: the text before the first row, then a segment a row; null below two row labels."""
    labels, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    rows = F.zip_with(
        labels, F.slice(between, 2, F.size(labels)),
        lambda a, b: F.struct(a.alias("label"), F.trim(F.concat(a, b)).alias("text"))
    )
    first = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.trim(between[0]).alias("text")))
    return F.when(
        F.size(labels) >= 2, F.concat(F.when(F.trim(between[0]) != "", first).otherwise(F.slice(first, 1, 0)), rows)
    )


def caption_of(text: Column) -> Column:
    """The first caption, without a last word that the length limit may have cut; null where there is none."""
    found = F.regexp_extract(text, f"({CAPTION_PATTERN})", 1)
    inside = F.position(found, text) + F.length(found) - 1 < F.length(text)
    trimmed = F.trim(found)
    return F.when(
        found != "",
        F.when(inside & F.contains(trimmed, F.lit(" ")), F.regexp_replace(trimmed, r" [^ ]*$", "")).otherwise(trimmed)
    )


def with_captions(pages: DataFrame, pattern: str) -> DataFrame:
    """Pages with ``segments`` and the ``caption`` that holds: a table page without one takes the last of its run of pages.

    A page of prose ends the run. Null outside tables.
    """
    table = segments(F.col("text"), pattern)
    marked = pages.withColumns({"segments": table, "own": F.when(table.isNotNull(), caption_of(F.col("text")))})
    by_page = Window.partitionBy("source").orderBy("page")
    run = F.count_if(F.col("segments").isNull()).over(by_page)
    carried = F.last("own", ignorenulls=True).over(
        Window.partitionBy("source", "run").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    )
    return marked.withColumn("run", run).withColumn(
        "caption", F.when(F.col("segments").isNotNull(), carried)
    ).drop("own", "run")


def windows(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Windows of at most ``most`` characters that begin and end at words; neighbours share about ``overlap``.

    Works on the positions of spaces: a window is cut at the last space in reach, and the next one begins after the last
    space at least ``overlap`` before the cut; without such spaces it is cut, and goes on, at the limit itself.
    """
    n = len(text)
    if n <= most:
        return [text] if text else []
    spaces = [i for i, c in enumerate(text) if c == " "]

    def last_space(lo: int, hi: int) -> int | None:
        at = bisect_left(spaces, hi) - 1
        return spaces[at] if at >= 0 and spaces[at] >= lo else None

    out, start = [], 0
    while start < n:
        reach = min(start + most, n)
        cut = reach
        if reach < n and (at := last_space(start + 1, reach)) is not None:
            cut = at
        if piece := text[start:cut].strip():
            out.append(piece)
        if cut >= n:
            break
        back = cut - overlap if cut - overlap > start else cut
        at = last_space(start, back)
        follow = back if at is None else at + 1
        start = follow if follow > start else cut + 1
    return out


def _windows_udf(most: int, overlap: int):
    @F.pandas_udf("array<array<string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda row: [windows(t or "", most, overlap) for t in row])

    return cut


def chunk_pages(pages: DataFrame, pattern: str | None = None, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, source, page, text): windows of every page, ids counted per page over all its segments.

    Rows of a table keep their label in each window and carry the caption as a suffix, unless the window names a table.
    """
    marked = with_captions(pages, pattern or region_pattern())
    whole = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.col("text").alias("text")))
    marked = marked.withColumn("segments", F.coalesce("segments", whole))
    cut = marked.withColumn("cut", _windows_udf(most, overlap)(F.transform("segments", lambda s: s["text"])))
    pieces = F.flatten(
        F.zip_with(
            "segments", "cut",
            lambda s, w: F.transform(w, lambda x: F.struct(s["label"].alias("label"), x.alias("piece")))
        )
    )
    flat = cut.select("source", "page", "caption", F.posexplode(pieces).alias("i", "p"))
    label, piece = F.col("p.label"), F.col("p.piece")
    labelled = F.when(label.isNotNull() & ~F.startswith(piece, label), F.concat_ws(" ", label, piece)).otherwise(piece)
    full = F.when(
        label.isNotNull() & F.col("caption").isNotNull() & ~F.contains(labelled, F.lit("Table")),
        F.concat(labelled, F.lit(" ["), F.col("caption"), F.lit("]"))
    ).otherwise(labelled)
    return flat.select(F.concat("source", F.lit("#p"), "page", F.lit("#"), "i").alias("chunk_id"), "source", "page", full.alias("text"))
