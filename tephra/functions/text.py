"""Text as columns: cleaning, tokens, numbers, ids and the ordered rules of the question parser."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tephra.schemas import EVIDENCE_PHRASES, EVIDENCE_QUESTION

UNMAPPABLE = "�"

# FIXED VALUES: patterns of the question parser and of the scope guard, each in its order.
HAZARD_PATTERNS = {
    "heatwave": r"\bheat ?waves?\b|\bextreme heat\b|\bhot extremes?\b|\bheat\b|\bhot spells?\b",
    "extreme_precip": r"\brain\w*\b|\bprecipitation\b|\bmonsoons?\b|\bdownpours?\b|\bwet spells?\b",
    "wind": r"\bwinds?\b|\bgusts?\b",
}
MARINE_PATTERN = r"\bmarine heat ?waves?\b|\bocean heat ?waves?\b"
SUPPORTED_PATTERN = r"\bheat ?waves?\b|\bhot extremes?\b|\bheat extremes?\b|\btemperature extremes?\b|\bprecipitation\b|\brainfall\b|\brain\b|\bmonsoon\b|\bwinds?\b|\bgusts?\b"
UNSUPPORTED_PATTERNS = {
    r"\bdroughts?\b|\baridity\b": "drought",
    r"\btropical[ -]cyclones?\b|\bhurricanes?\b|\btyphoons?\b|\bcyclones?\b": "tropical cyclone",
    r"\bsea[ -]levels?\b|\bcoastal flood\w*\b|\bstorm surges?\b": "coastal flooding / sea level",
    r"\bwild ?fires?\b|\bfire weather\b|\bfire seasons?\b|\bburn\w* area\b": "wildfire / fire weather",
    r"\bhail\b|\btornado\w*\b": "severe convective storm",
    r"\blandslides?\b|\bavalanches?\b": "landslide / avalanche",
}
WORD_NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
MAX_HORIZON, DEFAULT_HORIZON = 16, 7
PLACE_PATTERN = r"\b(?:in|near|for|at|around|over)\s+([A-Z][\w'\-]*(?:\s+[A-Z][\w'\-]*)*)"
PLACE_TAIL = r"\s+(?:Next|This|Over|During|The)\b.*$"


def _as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(raw: Column | str) -> Column:
    """Words hyphenated over a line end joined, unmappable glyphs blanked, white space collapsed and trimmed."""
    joined = F.regexp_replace(_as_column(raw), r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    return F.trim(F.regexp_replace(F.replace(joined, F.lit(UNMAPPABLE), F.lit(" ")), r"(?U)\s+", " "))


def is_mostly_unmappable(raw: Column | str, threshold: float = 0.2) -> Column:
    """More than ``threshold`` of the characters are unmappable; false for an empty text."""
    raw = _as_column(raw)
    n = F.length(raw)
    return (n > 0) & ((n - F.length(F.replace(raw, F.lit(UNMAPPABLE), F.lit("")))) > threshold * n)


def _nfkc(text: Column) -> Column:
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(fold, "string")(text)


def folded(text: Column | str) -> Column:
    """NFKC, by Arrow only where a text has other characters than ASCII and accented Latin-1 letters, which stay as they are.

    A Python function sees every row whatever stands around it, so the others go to it as nulls.
    """
    text = _as_column(text)
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]"), text)), text)


def tokens(text: Column | str, fold: bool = True) -> Column:
    """Runs of ``[a-z0-9]`` of the folded, lower-cased text. ``fold=False`` for text known to be in NFKC: stays in the JVM."""
    return F.regexp_extract_all(F.lower(folded(text) if fold else _as_column(text)), F.lit("[a-z0-9]+"), F.lit(0))


def numbers(text: Column | str) -> Column:
    """Distinct number strings; ``7`` and ``7.0`` differ."""
    return F.array_distinct(F.regexp_extract_all(_as_column(text), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def shortest(x: Column) -> Column:
    """The shortest decimals of a double, ``12345678.5`` or ``7.0``: no exponent from 1e-4 to below 1e16, as in Python and SQL.

    Spark's own cast writes an exponent from 1e7 on.
    """
    size = F.abs(x)
    return F.when((size >= 1e16) | ((size > 0) & (size < 1e-4)), x.cast("string")).otherwise(
        F.call_function("format_number", x, F.lit("0.0" + "#" * 19))
    )


def fixed(x: Column, digits: int, signed: bool = False) -> Column:
    """A double with so many decimals, the nearest to its binary value, of two as near the even one: as in Python and SQL.

    Java's ``%.1f`` rounds the shortest decimals instead, halves up: 56.25 to 56.3, 8.45 to 8.5.
    """
    pattern = "0." + "0" * digits
    return F.call_function("format_number", x, F.lit(f"+{pattern};-{pattern}" if signed else pattern))


def page_of(chunk_id: Column | str) -> Column:
    """struct<source, page> of ``source#pN#i``; null where the id hasn't exactly three parts."""
    parts = F.split(_as_column(chunk_id), "#")
    return F.when(
        F.size(parts) == 3,
        F.struct(parts[0].alias("source"), F.substring(parts[1], 2, 20).try_cast("int").alias("page"))
    )


def canonical_question(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_as_column(text)), r"(?U)\s+", " "))


def quote_between(text: Column | str, start: Column | str, end: Column | str, most: int = 400) -> Column:
    """Text from the first ``start`` through the first ``end`` after it; null where either is absent or it is longer than ``most``."""
    text, start, end = _as_column(text), _as_column(start), _as_column(end)
    at = F.position(start, text)
    rest = F.substr(text, at)
    to = F.position(end, rest, F.length(start) + 1)
    found = F.left(rest, to + F.length(end) - 1)
    return F.when((at > 0) & (to > 0) & (F.length(found) <= most), found)


def out_of_scope(question: Column | str) -> Column:
    """The unsupported hazard that a question is about; null where it is in scope. Marine heatwaves come first."""
    q = _as_column(question)
    found = F.when(q.rlike(f"(?iU){MARINE_PATTERN}"), "marine heatwave").when(
        q.rlike(f"(?iU){SUPPORTED_PATTERN}"), F.lit(None).cast("string")
    )
    for pattern, name in UNSUPPORTED_PATTERNS.items():
        found = found.when(q.rlike(f"(?iU){pattern}"), name)
    return found


def hazard_of(question: Column | str) -> Column:
    """The first supported hazard that a question names, before any guard; else null."""
    q = _as_column(question)
    found = None
    for hazard, pattern in HAZARD_PATTERNS.items():
        hit = q.rlike(f"(?iU){pattern}")
        found = F.when(hit, hazard) if found is None else found.when(hit, hazard)
    return found


def parsed_out_of_scope(question: Column | str) -> Column:
    """What the parser reports as out of scope: the guard's finding, only where no supported hazard is named."""
    return F.when(hazard_of(question).isNull(), out_of_scope(question))


def horizon_of(question: Column | str) -> Column:
    """Days asked for, by ordered rules; at most 16, 7 by default."""
    q = F.lower(_as_column(question))
    value = F.create_map(*(F.lit(x) for pair in WORD_NUMBERS.items() for x in pair))
    group = lambda pattern: F.regexp_extract(q, f"(?U){pattern}", 1)
    days = F.when(
        q.rlike(r"(?U)next\s+\d+\s+days?"),
        F.coalesce(group(r"next\s+(\d+)\s+days?").try_cast("decimal(38,0)"), F.lit(MAX_HORIZON))
    )
    weeks, bare = F.try_element_at(value, group(r"next\s+(\w+)\s+weeks?")), F.try_element_at(value, group(r"(\w+)\s+days?"))
    fixed = F.when(q.rlike(r"\bnext week\b|\bthis week\b"), 7).when(
        q.rlike(r"\bfortnight\b|\btwo weeks\b"), 14
    ).when(q.rlike(r"\btomorrow\b"), 2).otherwise(DEFAULT_HORIZON)
    # least() passes over nulls, therefore each rule that doesn't apply is told apart first.
    return F.coalesce(
        *(F.when(x.isNotNull(), F.least(x, F.lit(MAX_HORIZON)).cast("int")) for x in (days, weeks * 7, bare)), fixed
    )


def place_of(question: Column | str) -> Column:
    """The first capitalised run after a preposition of place, without a tail of time words; null where there is none."""
    found = F.regexp_extract_all(_as_column(question), F.lit(f"(?U){PLACE_PATTERN}"), F.lit(1))
    cleaned = F.transform(found, lambda x: F.btrim(F.regexp_replace(x, f"(?U){PLACE_TAIL}", ""), F.lit("?.!, ")))
    return F.get(F.filter(cleaned, lambda x: x != ""), F.lit(0))


def location_label(name: Column, region_label: Column, country: Column) -> Column:
    """``name, region`` where a region is known, else ``name, country`` without a dangling comma."""
    plain = F.rtrim(F.concat(name, F.lit(", "), F.coalesce(country, F.lit(""))))
    return F.when(
        region_label.isNotNull(), F.concat_ws(", ", name, region_label)
    ).otherwise(F.regexp_replace(plain, r"[, ]+$", ""))


def evidence_question(hazard: Column, location: Column) -> Column:
    """The retrieval question for a hazard at a location."""
    phrase = F.create_map(*(F.lit(x) for pair in EVIDENCE_PHRASES.items() for x in pair))
    return F.format_string(EVIDENCE_QUESTION, phrase[hazard], location)
