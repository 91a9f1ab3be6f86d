"""Registered queries over the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators import logs as L
from vecspark.plans import views
from vecspark.plans.registry import query
from vecspark.session import run_folder
from vecspark.sources.logs import stream_log_lines, stream_split_logs


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.request_log(views.table(spark, sf_dir, "events"))


@query(
    "log_error_filter",
    f"""WITH {views.REQUEST_LOG}
    SELECT request_id, correlation_id, path, msg, status::BIGINT AS status, time FROM logs WHERE level = 'error' AND method = 'POST'""",
)
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.with_status(L.log_error_filter(_logs(spark, sf_dir), "POST"))
    return found.select(
        F.col("requestId").alias("request_id"),
        F.col("correlationId").alias("correlation_id"),
        "path",
        "msg",
        F.col("statusCode").cast("bigint").alias("status"),
        "time",
    )


@query(
    "request_lifecycle",
    f"""WITH {views.REQUEST_LOG}
    SELECT request_id, count(*) AS lines, min(time) AS first_time, max(time) AS last_time,
      date_diff('microsecond', min(time), max(time)) / 1000.0::DOUBLE AS duration_ms, max(status)::BIGINT AS status,
      count(*) FILTER (level = 'error') AS errors
    FROM logs GROUP BY request_id""",
)
def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.request_lifecycle(_logs(spark, sf_dir))
    return out.withColumnRenamed("requestId", "request_id").withColumn("status", F.col("status").cast("bigint"))


@query(
    "request_lines",
    f"""WITH {views.REQUEST_LOG}
    SELECT time, level, msg, method, path FROM logs
    WHERE request_id = (SELECT request_id FROM ended ORDER BY latency DESC, request_id LIMIT 1)""",
)
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of one request, the slowest."""
    logs = _logs(spark, sf_dir)
    slowest = logs.filter(F.col("latencyMs").isNotNull()).orderBy(F.desc("latencyMs"), "requestId").first()["requestId"]
    return L.request_lines(logs, slowest).select("time", "level", "msg", "method", "path")


@query(
    "correlation_lifecycle",
    f"""WITH {views.REQUEST_LOG}
    SELECT correlation_id, count(*) AS lines, count(DISTINCT request_id) AS requests,
      min(time) AS first_time, max(time) AS last_time FROM logs GROUP BY correlation_id""",
)
def _correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.correlation_lifecycle(_logs(spark, sf_dir)).withColumnRenamed("correlationId", "correlation_id")


# Three services answer the requests; every eleventh answer is lost.
_SERVED = f"""{views.REQUEST_LOG}, served AS (
  SELECT *, CASE request_id::BIGINT % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'search' ELSE 'ingest' END AS service
  FROM logs WHERE msg = 'request received' OR request_id::BIGINT % 11 <> 3),
requests AS (
  SELECT request_id, correlation_id, service, min(time) AS first_time, max(time) AS last_time, count(*) AS lines, bool_or(msg <> 'request received') AS done
  FROM served GROUP BY ALL)"""


def served_logs(logs: DataFrame) -> DataFrame:
    n = F.col("requestId").cast("long")
    service = F.when(n % 3 == 0, "api").when(n % 3 == 1, "search").otherwise("ingest")
    return logs.withColumn("service", service).filter((F.col("msg") == "request received") | (n % 11 != 3))


@query(
    "correlation_sessions",
    f"""WITH {_SERVED}, marked AS (
      SELECT *, CASE WHEN first_time <= max(last_time + INTERVAL 3 HOUR) OVER (PARTITION BY correlation_id ORDER BY first_time, request_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts, (SELECT max(time) FROM served) AS newest FROM requests),
    islands AS (SELECT *, sum(starts) OVER (PARTITION BY correlation_id ORDER BY first_time, request_id) AS island FROM marked)
    SELECT correlation_id, min(first_time) AS first_time, max(last_time) AS last_time, sum(lines)::BIGINT AS lines, count(*) AS requests, count(DISTINCT service) AS services,
      count(*) FILTER (NOT done AND newest - INTERVAL 3 HOUR < last_time) AS open, count(*) FILTER (NOT done AND newest - INTERVAL 3 HOUR >= last_time) AS timed_out
    FROM islands GROUP BY correlation_id, island""",
)
def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests across services by correlation id, cut where three hours pass without one."""
    return L.correlation_sessions(served_logs(_logs(spark, sf_dir)), "3 hours").withColumnRenamed("correlationId", "correlation_id")


@query(
    "request_status_counts",
    f"""WITH {views.REQUEST_LOG}
    SELECT method, path, status::BIGINT AS status, count(*) AS requests FROM ended GROUP BY ALL""",
)
def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.request_status_counts(_logs(spark, sf_dir))
    return out.select("method", "path", F.col("statusCode").cast("bigint").alias("status"), "requests")


# Stated latency targets in milliseconds.
TARGETS = {("POST", "/embeddings"): 3000.0, ("POST", "/search"): 500.0}


@query(
    "latency_p95",
    f"""WITH {views.REQUEST_LOG}, p AS (
      SELECT method, path, round(quantile_cont(latency, 0.95), 6) AS p95_ms FROM ended GROUP BY ALL)
    SELECT *, CASE path WHEN '/embeddings' THEN p95_ms < 3000 WHEN '/search' THEN p95_ms < 500 ELSE TRUE END AS within_target
    FROM p""",
)
def _p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 95th percentile per route against its target; routes without a target pass."""
    out = L.latency_targets(L.latency_p95(_logs(spark, sf_dir)), TARGETS)
    return out.select(
        "method",
        "path",
        F.round("p95_ms", 6).alias("p95_ms"),
        F.coalesce("within_target", F.lit(True)).alias("within_target"),
    )


@query(
    "latency_p95_approx",
    f"""WITH {views.REQUEST_LOG}
    SELECT method, path, count(latency) AS requests, max(latency) AS max_ms, TRUE AS p95_close FROM logs WHERE latency IS NOT NULL GROUP BY ALL""",
)
def _p95_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile sketches by day, stored, merged by route, and held against exact quantiles."""
    logs = _logs(spark, sf_dir)
    folder = run_folder(spark, "latency")
    L.latency_sketches(logs, F.to_date("time").alias("day")).write.parquet(folder)
    merged = L.merged_latency(spark.read.parquet(folder))
    return L.rank_is_close(merged, logs, L.ROUTE).select("method", "path", "requests", "max_ms", "p95_close")


@query(
    "log_quarantine",
    """SELECT event_id::VARCHAR AS request_id, CASE WHEN event_id % 13 = 5 THEN 'quarantined' ELSE 'parsed' END AS outcome FROM events""",
)
def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as log files of which every thirteenth line is cut off, read by a stream: each line is parsed or kept as it is."""
    run = run_folder(spark, "log-lines")
    n = F.col("event_id")
    line = F.to_json(F.struct(n.cast("string").alias("requestId"), F.lit(30).alias("level"), F.col("value").alias("latencyMs"), F.lit("request completed").alias("msg")))
    cut = F.when(n % 13 == 5, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line)
    views.table(spark, sf_dir, "events").select(cut.alias("value")).write.text(f"{run}/in")
    stream_split_logs(stream_log_lines(spark, f"{run}/in"), f"{run}/lines", f"{run}/corrupt", f"{run}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    parsed = spark.read.parquet(f"{run}/lines").select(F.col("requestId").alias("request_id"), F.lit("parsed").alias("outcome"))
    corrupt = spark.read.parquet(f"{run}/corrupt").select(F.regexp_extract("line", '"requestId":"([0-9]+)"', 1), F.lit("quarantined"))
    return parsed.union(corrupt)
