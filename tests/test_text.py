from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from vecspark.functions import display, ids, text


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_trim_uses_the_javascript_set(spark):
    rows = ["  hello world  ", "﻿ x　 ", "​x\u0085", "", "\t\n  ", None, "a b"]
    got = [r[0] for r in values(spark, rows, text.trim_text(F.col("c")))]
    assert got == ["hello world", "x", "​x\u0085", "", "", None, "a b"]


def test_utf16_length_counts_pairs_twice(spark):
    rows = ["", "abc", "é", "😀", "😀" * 4000, "x" * 8001]
    c = F.col("c")
    got = values(spark, rows, text.utf16_length(c), text.longer_than(c, 8000))
    assert got == [(0, False), (3, False), (1, False), (2, False), (8000, False), (8001, True)]
    assert values(spark, ["😀" * 4001], text.longer_than(c, 8000)) == [(True,)]
    # Three bytes per character: many bytes, but not many units.
    assert values(spark, ["語" * 8000, "語" * 8001], text.longer_than(c, 8000)) == [(False,), (True,)]


def test_preview_and_prefix(spark):
    rows = ["x" * 80, "y" * 81, "short"]
    got = [r[0] for r in values(spark, rows, text.content_preview(F.col("c")))]
    assert got == ["x" * 80, "y" * 80 + "…", "short"]
    assert values(spark, ["0123456789"], text.id_prefix(F.col("c"))) == [("01234567…",)]


@pytest.mark.parametrize(
    ("given", "number"),
    [("10", 10), (" 10 ", 10), ("", 0), ("1e1", 10), ("-0.5", -0.5), (".5", 0.5), ("5.", 5), ("0x1F", 31), ("0b101", 5),
     ("0o17", 15), ("Infinity", math.inf), ("-Infinity", -math.inf), ("abc", None), ("1d", None), ("1 2", None), ("0x", None)],
)
def test_number_text(spark, given, number):
    got = values(spark, [given], text.js_number(F.col("c")))[0][0]
    assert math.isnan(got) if number is None else got == number


def test_display(spark):
    df = spark.createDataFrame([(0, -0.5), (1, 0.25), (2, 1.5)], "i int, s double")
    shown = display.score_display(F.col("s"))
    rows = df.orderBy("i").select(shown["score"], shown["distance"], shown["percent"]).collect()
    assert [tuple(r) for r in rows] == [(0.0, 1.0, 0.0), (0.25, 0.75, 25.0), (1.0, 0.0, 100.0)]


def test_metadata_source(spark):
    rows = ['{"source":"a"}', '{"source":3}', "{}", None, "[1]", "nope"]
    got = [r[0] for r in values(spark, rows, display.metadata_source(F.col("c")))]
    assert got == ["a", "3", None, None, None, None]


def test_dates(spark):
    df = spark.sql("SELECT timestamp_ntz'2025-01-05 09:30:07.123987' AS t")
    assert tuple(df.select(display.iso_timestamp(F.col("t")), display.short_date(F.col("t"))).first()) == (
        "2025-01-05T09:30:07.123Z",
        "Jan 5, 09:30 AM",
    )


def test_ids(spark):
    pattern = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    df = spark.range(2000).select(ids.keyed_uuid(F.col("id")).alias("k"), ids.keyed_uuid(F.col("id")).alias("again"))
    assert df.filter(~F.col("k").rlike(pattern) | (F.col("k") != F.col("again"))).count() == 0
    assert df.select("k").distinct().count() == 2000
    given = values(spark, ["my-trace-abc-123", None], ids.trace_id(F.col("c")))
    assert given[0][0] == "my-trace-abc-123"
    import re

    assert re.match(pattern, given[1][0])
