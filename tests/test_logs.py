from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.operators import logs as L
from vecspark.sources.logs import corrupt_lines, parsed_lines, read_log_lines, read_logs

LINES = [
    {"time": "2026-01-01T00:00:00.000Z", "level": 30, "requestId": "a", "correlationId": "c", "method": "POST", "path": "/search", "msg": "request received"},
    {"time": "2026-01-01T00:00:01.500Z", "level": 50, "requestId": "a", "correlationId": "c", "method": "POST", "path": "/search", "statusCode": 502, "latencyMs": 1500, "msg": "application error"},
    {"time": "2026-01-01T00:00:02.000Z", "level": "info", "requestId": "b", "correlationId": "c", "method": "GET", "path": "/", "msg": "request received"},
    {"time": "2026-01-01T00:00:02.010Z", "level": "info", "requestId": "b", "correlationId": "c", "method": "GET", "path": "/", "statusCode": 200, "latencyMs": 10, "msg": "request completed"},
]


@pytest.fixture
def logs(spark, tmp_path):
    (tmp_path / "log.json").write_text("\n".join(json.dumps(x) for x in LINES))
    return read_logs(spark, str(tmp_path))


def test_documented_queries(logs):
    assert [r.msg for r in L.log_error_filter(logs, "POST").collect()] == ["application error"]
    assert [r.msg for r in L.request_lines(logs, "b").collect()] == ["request received", "request completed"]
    c = L.correlation_lifecycle(logs).first()
    assert (c.lines, c.requests) == (4, 2)
    a = {r.requestId: r for r in L.request_lifecycle(logs).collect()}["a"]
    assert (a.lines, a.duration_ms, a.status, a.errors) == (2, 1500.0, 502, 1)
    counts = {(r.method, r.path, r.statusCode): r.requests for r in L.request_status_counts(logs).collect()}
    assert counts == {("POST", "/search", 502): 1, ("GET", "/", 200): 1}


def test_failures_that_name_no_status_are_counted(spark):
    rows = [("request received", None), ("request completed", 200), ("validation error", None), ("unexpected error", None), ("route not found", None)]
    lines = spark.createDataFrame([("POST", "/search", m, s) for m, s in rows], "method string, path string, msg string, statusCode int")
    assert {r.statusCode: r.requests for r in L.request_status_counts(lines).collect()} == {200: 1, 400: 1, 500: 1, 404: 1}


def test_targets(logs):
    got = {r.path: r.within_target for r in L.latency_targets(L.latency_p95(logs), {("POST", "/search"): 500.0}).collect()}
    assert got == {"/search": False, "/": None}


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.95, 0.999, 1.0])
def test_percentile_is_exact(spark, p):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=5000),
        "copies": np.concatenate([np.full(3000, 7.5), rng.normal(size=2000) * 10]),
        "one": np.array([3.0]),
        "two": np.array([1.0, 2.0]),
        None: rng.exponential(size=100),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.percentile for r in L.percentile_by(df, ["g"], "v", p).collect()}
    assert got == pytest.approx({g: float(np.quantile(xs, p)) for g, xs in groups.items()}, rel=1e-12)


def test_sketches_of_parts_merge_to_close_ranks(spark):
    rng = np.random.default_rng(3)
    rows = [("GET" if i % 9 else None, "/a" if i % 3 else "/b", float(v), i % 10) for i, v in enumerate(rng.exponential(size=20_000))]
    lines = spark.createDataFrame(rows, "method string, path string, latencyMs double, day int").repartition(4)
    parts = L.latency_sketches(lines, F.col("day"))
    assert parts.count() == 30
    merged = L.merged_latency(parts)
    for r in merged.collect():
        own = [v for m, p, v, _ in rows if m == r.method and p == r.path]
        assert r.requests == len(own) and r.max_ms == max(own)
        assert abs(np.mean(np.array(own) <= r.p95_ms) - 0.95) <= L.RANK_ERROR
    checked = L.rank_is_close(merged, lines, L.ROUTE)
    assert all(r.p95_close for r in checked.collect())
    wrong = L.rank_is_close(merged.withColumn("p95_ms", F.col("p95_ms") * 2), lines, L.ROUTE)
    assert not any(r.p95_close for r in wrong.collect())


def test_corrupt_lines_are_kept(spark, tmp_path):
    good = [json.dumps(x) for x in LINES]
    bad = ['{"time": "2026-01-01T00', "plain text", '{"latencyMs": "much", "requestId": "z"}']
    (tmp_path / "a.json").write_text("\n".join([good[0], bad[0], *good[1:3]]))
    (tmp_path / "b.json").write_text("\n".join([*bad[1:], good[3]]))
    lines = read_log_lines(spark, str(tmp_path))
    assert sorted(r.requestId for r in parsed_lines(lines).collect()) == ["a", "a", "b", "b"]
    kept = corrupt_lines(lines).collect()
    assert sorted(r.line for r in kept) == sorted(bad) and {r.file[-6:] for r in kept} == {"a.json", "b.json"}
    assert {r.requestId for r in L.request_lifecycle(read_logs(spark, str(tmp_path))).collect()} == {"a", "b"}


def test_sessions_of_requests(spark):
    def line(minute, request, correlation, service, status=None):
        return datetime(2026, 1, 1, minute // 60, minute % 60), request, correlation, service, status, "m"

    rows = [
        line(0, "a", "x", "api"), line(1, "a", "x", "api", 200), line(5, "b", "x", "search"), line(100, "c", "x", "api"), line(104, "c", "x", "api", 500),
        line(200, "d", "y", "api"), line(3, "e", None, "api", 200),
    ]
    lines = spark.createDataFrame(rows, "time timestamp, requestId string, correlationId string, service string, statusCode int, msg string").withColumn("latencyMs", F.lit(None).cast("double"))
    got = {(r.correlationId, r.first_time.minute + 60 * r.first_time.hour): (r.lines, r.requests, r.services, r.open, r.timed_out) for r in L.correlation_sessions(lines, "10 minutes").collect()}
    assert got == {("x", 0): (3, 2, 2, 0, 1), ("x", 100): (2, 1, 1, 0, 0), ("y", 200): (1, 1, 1, 1, 0), (None, 3): (1, 1, 1, 0, 0)}
