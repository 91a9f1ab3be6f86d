"""Boundary rows of the three kinds of requests."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vecspark.operators.requests import parse_create_requests, parse_list_requests, parse_search_requests
from vecspark.operators.validation import (
    clamp_limit,
    dims_rule,
    error_report,
    error_status,
    quarantine,
    text_rules,
    valid,
    with_errors,
)
from vecspark.plans.semantic import check_searches
from vecspark.session import configure

LONG = "x" * 8001

CREATE = [
    ('{"content":"  hello world  "}', None, None),
    ('{"content":"   "}', "content cannot be empty", "content"),
    ('{"content":""}', "Invalid request body", "content"),
    (json.dumps({"content": LONG}), "Invalid request body", "content"),
    (json.dumps({"content": "x" * 8000}), None, None),
    (json.dumps({"content": "x" * 7990 + " " * 20}), "Invalid request body", "content"),
    (json.dumps({"content": "😀" * 4001}), "Invalid request body", "content"),
    (json.dumps({"content": "😀" * 4000}), None, None),
    ("not json", "Invalid JSON in request body", "body"),
    ('{"content":"x"} trailing', "Invalid JSON in request body", "body"),
    ('"a"],["b"', "Invalid JSON in request body", "body"),
    (" ", "Invalid JSON in request body", "body"),
    (None, "Invalid request body", "content"),
    ("", "Invalid request body", "content"),
    ("{}", "Invalid request body", "content"),
    ("null", "Invalid request body", "body"),
    ("[1]", "Invalid request body", "body"),
    ('{"content":5}', "Invalid request body", "content"),
    ('{"content":null}', "Invalid request body", "content"),
    ('{"content":"x","metadata":[1]}', "Invalid request body", "metadata"),
    ('{"content":"x","metadata":null}', "Invalid request body", "metadata"),
    ('{"content":"x","metadata":{"topic":"pets"},"more":1}', None, None),
    ('{"content":1,"content":"x"}', None, None),
]

SEARCH = [
    ('{"query":"q"}', None, 10, None),
    ('{"query":""}', "Invalid request body", None, None),
    ('{"query":"\\u3000"}', "query cannot be empty", 10, None),
    (json.dumps({"query": LONG}), "Invalid request body", None, None),
    ('{"query":"q","limit":0}', "Invalid request body", None, None),
    ('{"query":"q","limit":101}', "Invalid request body", None, None),
    ('{"query":"q","limit":1}', None, 1, None),
    ('{"query":"q","limit":100}', None, 100, None),
    ('{"query":"q","limit":5.0}', None, 5, None),
    ('{"query":"q","limit":1e1}', None, 10, None),
    ('{"query":"q","limit":1.5}', "Invalid request body", None, None),
    ('{"query":"q","limit":1e400}', "Invalid request body", None, None),
    ('{"query":"q","limit":"5"}', "Invalid request body", None, None),
    ('{"query":"q","limit":true}', "Invalid request body", None, None),
    ('{"query":"q","limit":null}', "Invalid request body", None, None),
    ('{"query":"q","threshold":0}', None, 10, 0.0),
    ('{"query":"q","threshold":1}', None, 10, 1.0),
    ('{"query":"q","threshold":-0.1}', "Invalid request body", None, None),
    ('{"query":"q","threshold":1.1}', "Invalid request body", None, None),
    ('{"query":"q","threshold":null}', "Invalid request body", None, None),
]


def bodies(spark, cases):
    configure(spark)
    return spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, body string")


def test_create_requests(spark):
    got = parse_create_requests(bodies(spark, CREATE)).orderBy("i").collect()
    assert [(r.error_message, r.error_field) for r in got] == [c[1:] for c in CREATE]
    assert got[0].content == "  hello world  "
    assert json.loads(got[21].metadata) == {"topic": "pets"}
    assert got[22].content == "x"


def test_all_messages_of_a_body_are_kept(spark):
    rows = [('{"query":5,"limit":0.5,"threshold":"x"}',), ("[]",), ('{"content":5,"metadata":5}',)]
    first, second, _ = parse_search_requests(bodies(spark, rows)).orderBy("i").collect()
    assert first.field_errors.query == ["Expected string, received number"]
    assert first.field_errors.limit == ["Expected integer, received float", "Number must be greater than or equal to 1"]
    assert first.field_errors.threshold == ["Expected number, received string"]
    assert first.error_field == "query"
    assert second.form_errors == ["Expected object, received array"]
    third = parse_create_requests(bodies(spark, rows)).orderBy("i").collect()[2]
    assert third.field_errors.asDict() == {
        "content": ["Expected string, received number"],
        "metadata": ["Expected object, received number"],
    }


def test_search_requests(spark):
    got = parse_search_requests(bodies(spark, SEARCH)).orderBy("i").collect()
    assert [(r.error_message, r.limit, r.threshold) for r in got] == [c[1:] for c in SEARCH]


def test_list_requests(spark):
    cases = [("200", None), ("10", 10), (None, 20), ("0", None), ("1.5", None), ("abc", None), ("", None), (" 7 ", 7)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, limit_text string")
    got = parse_list_requests(df).orderBy("i").collect()
    assert [r.limit for r in got] == [c[1] for c in cases]
    assert [r.error_message for r in got] == [None if c[1] else "Invalid query parameters" for c in cases]


def test_text_level_checks_look_at_the_trimmed_text(spark):
    cases = ["x" * 7990 + " " * 20, LONG, "   ", None, "ok"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, content string")
    checked = with_errors(df, text_rules(F.col("content"), "content"))
    got = [r.error_message for r in checked.orderBy("i").collect()]
    empty = "content cannot be empty"
    assert got == [None, "content exceeds max length of 8000 chars", empty, empty, None]
    assert valid(checked).columns == ["i", "content"]
    assert valid(checked).count() == 2 and quarantine(checked).count() == 3
    counts = {r.error_message: r.n for r in error_report(quarantine(checked)).collect()}
    assert counts == {empty: 2, "content exceeds max length of 8000 chars": 1}


@pytest.mark.parametrize(
    ("limit", "threshold", "message"),
    [(None, None, None), (0.0, None, "limit"), (101.0, None, "limit"), (1.5, None, "limit"), (100.0, 0.0, None),
     (10.0, -0.1, "threshold"), (10.0, 1.1, "threshold"), (float("nan"), None, "limit"), (0.0, 2.0, "limit")],
)
def test_search_checks(spark, limit, threshold, message):
    df = spark.createDataFrame([("a", "q", limit, threshold)], "query_id string, query string, limit double, threshold double")
    assert check_searches(df).first().error_field == message


def test_clamp_dims_and_status(spark):
    df = spark.createDataFrame([(0,), (7,), (1000,)], "n int")
    assert [r[0] for r in df.select(clamp_limit(F.col("n"))).collect()] == [1, 7, 100]
    vectors = [([1.0, 2.0, 3.0],), ([1.0],), ([],), (None,), ([1.0, None, 2.0],)]
    v = with_errors(spark.createDataFrame(vectors, "v array<double>"), [dims_rule(F.col("v"), 3)])
    assert [r.error_code for r in v.collect()] == [None] + ["EXTERNAL_SERVICE_ERROR"] * 4
    codes = [None, "VALIDATION_ERROR", "EXTERNAL_SERVICE_ERROR", "APP_ERROR", "NOT_FOUND", "other"]
    c = spark.createDataFrame([(x,) for x in codes], "c string")
    assert [r[0] for r in c.select(error_status(F.col("c"), success=201)).collect()] == [201, 400, 502, 502, 404, 500]


def test_a_repeated_key_keeps_its_last_value_whatever_the_session_says(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    rows = spark.createDataFrame([("r", '{"content": "a", "content": "b"}')], "request_id string, body string")
    assert [(r.content, r.error_code) for r in parse_create_requests(rows).collect()] == [("b", None)]
