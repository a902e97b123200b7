from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewright.functions import names, text
from casewright.functions.geometry import albers, nice_ticks, ring_area, simplify, svg_path


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [("ON XX/XX/XXXX I WENT TO XXXX XXXX", "on i went to"), ("xxxx1", "xxxx1"), ("XX", ""), (None, ""), ("Café au LAIT!", "caf au lait"), ("  a  b ", "a b")],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, text.normalize) == want


def test_redaction_ratio_counts_runs_over_tokens(spark):
    assert one(spark, "ON XX/XX/XXXX I WENT", text.redaction_ratio) == pytest.approx(1 / 4)
    assert one(spark, "", text.redaction_ratio) == 0


@pytest.mark.parametrize("words, n", [(0, 0), (4, 1), (5, 1), (6, 2)])
def test_shingles(spark, words, n):
    assert len(one(spark, " ".join(f"w{i}" for i in range(words)), text.shingles)) == n


def test_shingles_of_a_long_text_split_it_once(spark):
    words = [f"w{i % 17}x{i % 1009}" for i in range(30_000)]
    want = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}
    start = time.monotonic()
    got = one(spark, " ".join(words), text.shingles)
    assert time.monotonic() - start < 15  # the square of the words took minutes
    assert len(got) == len(want) and set(got) == want


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=60))
def test_normalize_is_idempotent(spark, raw):
    once = one(spark, raw, text.normalize)
    assert re.fullmatch(r"([a-z0-9]+( [a-z0-9]+)*)?", once)
    assert one(spark, once, text.normalize) == re.sub(r"\s+", " ", re.sub(r"\bx{2,}(?:\sx{2,})*\b", " ", once)).strip()


def test_hash_needs_tokens(spark):
    assert one(spark, " ".join(["a"] * 24), text.text_hash) is None
    assert len(one(spark, " ".join(["a"] * 25), text.text_hash)) == 16


@pytest.mark.parametrize(
    "raw, want",
    [("EQUIFAX, INC.", "EQUIFAX"), ("Equifax Information Services LLC", "EQUIFAX INFORMATION SERVICES"), ("The X Corp Inc", "X"), ("FIRST BANK NA", "FIRST"), ("A & B Co.", "A AND B"), ("", ""), (None, "")],
)
def test_company_names(spark, raw, want):
    assert one(spark, raw, names.normalize_company) == want


def test_company_group(spark):
    df = names.with_company_group(spark.createDataFrame([("Trans Union LLC",), ("Nobody Ltd",)], "company string"))
    assert {r.company: r.company_group for r in df.collect()} == {"Trans Union LLC": "TransUnion", "Nobody Ltd": "NOBODY"}


def test_unknown_segment():
    with pytest.raises(KeyError):
        names.raw_labels(["nothing"])
    assert names.raw_labels(["mortgage"]) == ["Mortgage"]


def test_geometry(spark):
    square = spark.sql("select array(struct(0D as x, 0D as y), struct(2D as x, 0D as y), struct(2D as x, 2D as y), struct(0D as x, 2D as y)) as r, -96D as lon, 37.5D as lat")
    assert square.select(ring_area(F.col("r"))).first()[0] == 4.0
    assert [round(v, 9) for v in square.select(*albers(F.col("lon"), F.col("lat"))).first()] == [0.0, 0.0]
    assert simplify([(0, 0), (1, 0.01), (2, 0), (2, 2)]) == [(0, 0), (2, 0), (2, 2)]
    assert svg_path([[(0, 0), (1, 0), (1, 1)]]) == "M0.0,0.0L1.0,0.0L1.0,1.0Z"
    assert nice_ticks(87) == [0, 20, 40, 60, 80]


def test_display_formats(spark):
    from casewright.functions import formats

    rows = spark.createDataFrame([(1234567, 0.25, "2024-03", "<a href='x'>&\""), (None, None, None, None), (0, 12.34, "2024-13", ""), (-5, 0.15, "other", "é")], "n long, x double, m string, t string")
    got = rows.select(formats.grouped(F.col("n")), formats.percent(F.col("x")), formats.percent(F.col("x"), 0), formats.month_label(F.col("m")), formats.escaped(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [
        ("1,234,567", "0.3%", "0%", "March 2024", "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"), ("—", "—", "—", None, None), ("0", "12.3%", "12%", "2024-13", ""), ("-5", "0.1%", "0%", "other", "é"),
    ]


def test_ticks_of_small_and_large_axes():
    assert nice_ticks(0) == [0] and nice_ticks(0.7) == [0]
    assert nice_ticks(5) == [0, 1, 2, 3, 4, 5] and nice_ticks(11) == [0, 2.5, 5, 7.5, 10]
    assert nice_ticks(10_000) == [0, 2000, 4000, 6000, 8000, 10_000]
