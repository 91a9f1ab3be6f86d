"""Queries over the structured request log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROUTE = ("method", "path")
ACCURACY = 10_000  # of the approximate quantiles: their rank is off by at most one row in so many
MARGIN = 3 / ACCURACY
PARTS = 1000


# The status of a line that ends a request without naming one, by its message.
STATUS_OF = {"route not found": 404, "validation error": 400, "application error": 502, "unexpected error": 500}


def with_status(logs: DataFrame) -> DataFrame:
    """Lines with the status they end a request with: the logged one, else that of the message, else NULL."""
    if "msg" not in logs.columns:
        return logs
    status = F.lit(None).cast("int")
    for message, code in STATUS_OF.items():
        status = F.when(F.col("msg") == message, F.lit(code)).otherwise(status)
    return logs.withColumn("statusCode", F.coalesce("statusCode", status))


def milliseconds(interval: Column) -> Column:
    """A day-time interval as milliseconds; zone-free, unlike a difference of epoch values."""
    return (interval.cast("interval second").cast("decimal(20,6)") * 1000).cast("double")


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where NULL matches NULL."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(r, on).drop(*[f"_r_{k}" for k in keys])


def log_error_filter(logs: DataFrame, method: str, level: str = "error") -> DataFrame:
    """Lines of one level and one method."""
    return logs.filter((F.col("level") == level) & (F.col("method") == method))


def request_lines(logs: DataFrame, request_id: str) -> DataFrame:
    """All lines of one request in time order."""
    return logs.filter(F.col("requestId") == request_id).orderBy("time", "msg")


def request_lifecycle(logs: DataFrame) -> DataFrame:
    """One row per request: lines, first and last time, duration, final status and errors."""
    return with_status(logs).groupBy("requestId").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        milliseconds(F.max("time") - F.min("time")).alias("duration_ms"),
        F.max("statusCode").alias("status"),
        F.count_if(F.col("level") == "error").alias("errors"),
    )


def correlation_lifecycle(logs: DataFrame) -> DataFrame:
    """One row per correlation id: lines, requests, first and last time.

    Requests are counted after grouping by request, which spreads a correlation id that
    holds a large share of the log over many tasks.
    """
    per_request = logs.groupBy("correlationId", "requestId").agg(
        F.count(F.lit(1)).alias("_lines"), F.min("time").alias("_first"), F.max("time").alias("_last")
    )
    return per_request.groupBy("correlationId").agg(
        F.sum("_lines").alias("lines"),
        F.count(F.lit(1)).alias("requests"),
        F.min("_first").alias("first_time"),
        F.max("_last").alias("last_time"),
    )


def request_outcomes(logs: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """Per request, and again after a silence of ``timeout``: first and last time, lines, and whether a line has ended it.

    Works on tables and, with a watermark, on streams, where a request comes out once no more
    of its lines can come: one that has not ended by then has timed out.
    """
    ends = with_status(logs).withColumn("_ends", F.col("statusCode").isNotNull() | F.col("latencyMs").isNotNull())
    keys = ["requestId", "correlationId", *(["service"] if "service" in logs.columns else [])]
    out = ends.groupBy(F.session_window("time", timeout).alias("_session"), *keys).agg(
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count(F.lit(1)).alias("lines"), F.max("statusCode").alias("status"), F.bool_or("_ends").alias("ended")
    )
    return out.drop("_session")


def correlation_sessions(logs: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """One row per correlation id and run of requests, across services, that follow each other within ``timeout``.

    A request holds its session open from its first line until ``timeout`` after its last. Those
    that have not ended are ``open`` while the log goes on for less than ``timeout`` after them,
    else ``timed_out``. Requests are put together first, so a correlation id with a large share
    of the lines is spread over many tasks until its requests are merged.
    """
    newest = logs.agg(F.max("time").alias("_newest"))
    requests = request_outcomes(logs, timeout).join(F.broadcast(newest))  # one row
    silent = F.col("_newest") - F.expr(f"INTERVAL {timeout}") >= F.col("last_time")
    open_time = F.expr(f"timestampdiff(MICROSECOND, first_time, last_time + INTERVAL {timeout})")
    session = F.session_window("first_time", F.concat(open_time.cast("string"), F.lit(" microseconds")))
    services = F.count_distinct("service") if "service" in logs.columns else F.lit(1).cast("long")
    return requests.groupBy(session.alias("_session"), "correlationId").agg(
        F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("requests"), services.alias("services"),
        F.count_if(~F.col("ended") & ~silent).alias("open"), F.count_if(~F.col("ended") & silent).alias("timed_out"),
    ).drop("_session")


def request_status_counts(logs: DataFrame) -> DataFrame:
    """Finished requests by route and status."""
    done = with_status(logs).filter(F.col("statusCode").isNotNull())
    return done.groupBy(*ROUTE, "statusCode").agg(F.count(F.lit(1)).alias("requests"))


def percentile_by(df: DataFrame, keys: Sequence[str], value: str, p: float) -> DataFrame:
    """Exact interpolated percentile per group, for groups of any size.

    Spark's ``percentile`` keeps every distinct value of a group in one task. Here values
    are first counted. Approximate quantiles just below and above ``p`` cut them into those
    below, those above, and a narrow middle of ``PARTS`` equal ranges. The counts per part
    say which part holds the wanted positions, and only that part is put in order. The cuts
    decide how much is sorted, never the result.
    """
    keys = list(keys)
    v = F.col(value)
    counts = df.filter(v.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    marks = [max(0.0, p - MARGIN), min(1.0, p + MARGIN)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, marks, ACCURACY).alias("_cuts"))
    low_cut, high_cut = F.col("_cuts")[0], F.col("_cuts")[1]
    share = F.coalesce(F.try_divide(v - low_cut, high_cut - low_cut), F.lit(0.0))
    part = (
        F.when(v < low_cut, 0)
        .when(v > high_cut, PARTS + 1)
        .otherwise(1 + F.least(F.lit(PARTS - 1), F.floor(share * PARTS)))
        .cast("int")
    )
    parted = _same_keys(counts, cuts, keys).withColumn("_part", part).drop("_cuts")

    sizes = parted.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))
    upto = F.sum("_size").over(W.partitionBy(*keys).orderBy("_part"))
    total = F.sum("_size").over(W.partitionBy(*keys))
    sizes = sizes.withColumn("_end", upto).withColumn("_position", (total - 1) * F.lit(float(p)))
    low, high = F.floor("_position"), F.ceil("_position")

    def within(position: Column) -> Column:
        return (F.col("_begin") <= position) & (position < F.col("_end"))

    sizes = sizes.withColumn("_begin", F.col("_end") - F.col("_size")).filter(within(low) | within(high))
    near = _same_keys(parted, sizes.select(*keys, "_part", "_begin", "_position"), [*keys, "_part"])
    running = F.sum("_n").over(W.partitionBy(*keys, "_part").orderBy(value))
    near = near.withColumn("_end", F.col("_begin") + running).withColumn("_begin", F.col("_end") - F.col("_n"))
    ends = near.groupBy(*keys, "_position").agg(
        F.max(F.when(within(low), v)).alias("_low"), F.max(F.when(within(high), v)).alias("_high")
    )
    rest = F.col("_position") - F.floor("_position")
    return ends.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * rest).alias("percentile"))


SKETCH_SIZE = 400  # of the quantile sketches
RANK_ERROR = 0.02  # of their quantiles: well over what a sketch of this size is off by


def latency_sketches(logs: DataFrame, *parts: Column) -> DataFrame:
    """Per route and part, such as a day: how many latencies, the greatest, and a quantile sketch. To be stored and merged."""
    done = logs.filter(F.col("latencyMs").isNotNull())
    return done.groupBy(*ROUTE, *parts).agg(
        F.count(F.lit(1)).alias("requests"), F.max("latencyMs").alias("max_ms"), F.kll_sketch_agg_double("latencyMs", SKETCH_SIZE).alias("latency_sketch")
    )


def merged_latency(sketches: DataFrame, *parts: Column | str, p: float = 0.95) -> DataFrame:
    """Sketches of any parts merged to larger ones, by route; ``p95_ms`` has a rank within ``RANK_ERROR`` of ``p``."""
    merged = sketches.groupBy(*ROUTE, *parts).agg(
        F.sum("requests").alias("requests"), F.max("max_ms").alias("max_ms"), F.kll_merge_agg_double("latency_sketch", SKETCH_SIZE).alias("latency_sketch")
    )
    return merged.withColumn("p95_ms", F.kll_sketch_get_quantile_double("latency_sketch", F.lit(p)))


def rank_is_close(estimates: DataFrame, logs: DataFrame, keys: Sequence[str], value: str = "latencyMs", p: float = 0.95) -> DataFrame:
    """The estimates with ``p95_close``: whether the rank of ``p95_ms`` among all values of its group is within ``RANK_ERROR`` of ``p``."""
    v, e = F.col(value), F.col("_estimate")
    rows = _same_keys(logs.select(*keys, value).filter(v.isNotNull()), estimates.select(*keys, F.col("p95_ms").alias("_estimate")), keys)
    below, upto = F.count_if(v < e) / F.count(F.lit(1)), F.count_if(v <= e) / F.count(F.lit(1))
    ranks = rows.groupBy(*keys).agg(((below <= p + RANK_ERROR) & (upto >= p - RANK_ERROR)).alias("p95_close"))
    return _same_keys(estimates, ranks, keys)


def latency_p95(logs: DataFrame, approximate: bool = False, p: float = 0.95) -> DataFrame:
    """95th percentile of the latency per route; ``approximate`` needs a single pass and keeps a sketch per route."""
    if approximate:
        return merged_latency(latency_sketches(logs), p=p).select(*ROUTE, "p95_ms")
    done = logs.filter(F.col("latencyMs").isNotNull())
    return percentile_by(done, ROUTE, "latencyMs", p).withColumnRenamed("percentile", "p95_ms")


def latency_targets(p95: DataFrame, targets_ms: dict[tuple[str, str], float]) -> DataFrame:
    """Compare each route's p95 with its target; a route without one gives NULL."""
    target = F.lit(None).cast("double")
    for (method, path), ms in targets_ms.items():
        target = F.when((F.col("method") == method) & (F.col("path") == path), F.lit(float(ms))).otherwise(target)
    out = p95.withColumn("target_ms", target)
    return out.withColumn("within_target", F.col("p95_ms") < F.col("target_ms"))
