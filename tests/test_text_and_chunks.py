import random

import pytest
from pyspark.sql import functions as F

from tephra.functions import text as t
from tephra.operators import chunking, evaluation


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("tempera-\nture", "temperature"), ("tempera -\n ture", "tempera - ture"), ("a�b", "a b"),
        ("  a \n\t b  ", "a b"), ("été-\nété", "étéété"), ("well-known", "well-known"), ("", "")
    ]
)
def test_clean_text(spark, raw, want):
    assert one(spark, t.clean_text, raw) == want


@pytest.mark.parametrize("raw, want", [("�" * 3 + "a" * 7, True), ("�" * 2 + "a" * 8, False), ("", False)])
def test_unmappable(spark, raw, want):
    assert one(spark, t.is_mostly_unmappable, raw) is want


@pytest.mark.parametrize(
    "raw, want", [("Ouréaux 1.5", ["our", "aux", "1", "5"]), ("ﬁre ＡＢ", ["fire", "ab"]), ("café", ["caf"]), ("", [])]
)
def test_tokens(spark, raw, want):
    assert one(spark, t.tokens, raw) == want


def test_numbers_and_provenance(spark):
    assert one(spark, t.numbers, "7, 7.0 and 7; 1901.") == ["7", "7.0", "1901"]
    df = spark.createDataFrame(
        [("rose 7%", ["7 percent"]), ("rose 12", ["7"]), ("none", []), ("7.0", ["7"])], "a string, c array<string>"
    )
    assert [
        r[0] for r in df.select(evaluation.provenance_ok(F.col("a"), F.col("c"))).collect()
    ] == [True, False, True, False]


def test_page_of(spark):
    assert tuple(one(spark, t.page_of, "a.pdf#p12#3")) == ("a.pdf", 12)
    assert one(spark, t.page_of, "a#b") is None


@pytest.mark.parametrize("question, hazard, out, days, place", [
    ("Will there be a marine heatwave?", "heatwave", None, 7, None), ("Droughts in Chad", None, "drought", 7, "Chad"),
    ("Rain and hurricanes near New York Next week", "extreme_precip", None, 7, "New York"),
    ("gusts over the next 30 days at Cape Town", "wind", None, 16, "Cape Town"),
    ("Heat for the next two weeks in Oslo?", "heatwave", None, 14, "Oslo"),
    ("wind in three days", "wind", None, 3, None), ("rain tomorrow", "extreme_precip", None, 2, None),
    ("next 0 days", None, None, 0, None), ("a fortnight of rain", "extreme_precip", None, 14, None),
    ("what?", None, None, 7, None), ("floods at Évora", None, None, 7, None),
    ("sea levels at Venice", None, "coastal flooding / sea level", 7, "Venice"),
])
def test_parser(spark, question, hazard, out, days, place):
    row = spark.createDataFrame([(question,)], "x string").select(
        t.hazard_of("x"), t.parsed_out_of_scope("x"), t.horizon_of("x"), t.place_of("x")
    ).first()
    assert tuple(row)[:3] == (hazard, out, days)
    assert row[3] == place


def test_guard_takes_marine_first(spark):
    assert one(spark, t.out_of_scope, "Will the marine heat wave bring rain?") == "marine heatwave"
    assert one(spark, t.out_of_scope, "concurrent heatwaves and droughts") is None


def test_quote(spark):
    df = spark.createDataFrame(
        [("xx start mid end and end", "start", "end"), ("no", "start", "end"), ("end start", "start", "end")],
        "x string, a string, b string"
    )
    assert [r[0] for r in df.select(t.quote_between("x", "a", "b")).collect()] == ["start mid end", None, None]


def test_windows_properties():
    rng = random.Random(1)
    for _ in range(200):
        text = " ".join(f"{k}" + "w" * rng.randrange(1, rng.choice([5, 60])) for k in range(rng.randrange(1, 400)))
        got = chunking.windows(text, 100, 20)
        assert got[0] and text.startswith(got[0]) and text.endswith(got[-1]) and all(len(g) <= 100 for g in got)
        at = 0
        for g in got:
            found = text.index(g)
            assert found <= at + 1 and found + len(g) >= at
            at = found + len(g)
    assert chunking.windows("", 10, 2) == [] and chunking.windows(" a ", 10, 2) == [" a "] and len(
        chunking.windows("x" * 95, 10, 3)
    ) >= 10


LABELS = {"TIB": "Tibetan Plateau", "SAS": "South Asia"}


def pages(spark, *texts):
    return spark.createDataFrame([("s", k + 1, x) for k, x in enumerate(texts)], "source string, page int, text string")


def chunks(spark, *texts, **k):
    rows = chunking.chunk_pages(pages(spark, *texts), chunking.region_pattern(LABELS), **k).collect()
    return {r.chunk_id: r.text for r in rows}


ROWS = "Tibetan Plateau (TIB) warm days rise South-Asia (SAS) wet days rise"


def test_rows_are_atomic(spark):
    got = chunks(spark, "Table 11.1 | Trends at 2°C over land | " + ROWS)
    assert got["s#p1#1"].startswith("Tibetan Plateau (TIB)") and "SAS" not in got["s#p1#1"] and got["s#p1#2"].startswith("South-Asia (SAS)")
    assert "[Table 11.1 | Trends" in got["s#p1#2"] and "[" not in got["s#p1#0"]


def test_caption_is_carried_until_prose(spark):
    got = chunks(spark, "Table 11.1 | Trends at 2C | " + ROWS, ROWS, "prose here", ROWS)
    assert got["s#p2#0"].endswith("[Table 11.1 | Trends at]") and got["s#p4#0"].endswith("warm days rise")


def test_overflowing_rows_keep_their_label(spark):
    got = chunks(spark, ROWS + " more" * 100, most=120, overlap=20)
    mine = [x for x in got.values() if "more" in x]
    assert len(mine) > 3 and all(x.startswith("South-Asia (SAS)") for x in mine)


def test_single_mention_is_prose(spark):
    assert list(chunks(spark, "In South Asia (SAS) it rains.")) == ["s#p1#0"]
