"""Registered queries that run as streams to their end and read back what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.plans import views
from vecspark.plans.embedding_queries import (
    OUTCOMES_SQL,
    SEARCH_SQL,
    WORDS,
    indexed_documents,
    outcomes,
    shown,
    text_requests,
)
from vecspark.operators.logs import rank_is_close
from vecspark.plans.log_queries import _SERVED, served_logs
from vecspark.plans.registry import query
from vecspark.session import run_folder
from vecspark.streaming.jobs import latest_metrics, stream_ingest, stream_request_metrics, stream_request_outcomes, stream_search


def _finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query("stream_ingest", OUTCOMES_SQL)
def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a stream of JSON bodies."""
    run = run_folder(spark, "stream-ingest")
    body = F.to_json(F.struct(F.col("text").alias("content"), F.struct("source", "lang").alias("metadata")))
    requests = views.stream_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("request_id"), body.alias("body"))
    _finish(stream_ingest(requests, WORDS, f"{run}/corpus", f"{run}/refused", f"{run}/checkpoint"))
    # The body check counts the raw text and has its own message for long ones.
    message = F.when(
        F.col("outcome") == "Invalid request body", F.lit("content exceeds max length of 8000 chars")
    ).otherwise(F.col("outcome"))
    return outcomes(spark, f"{run}/corpus", f"{run}/refused").withColumn("outcome", message)


@query("stream_search", SEARCH_SQL)
def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts as a stream of search requests."""
    run = run_folder(spark, "stream-search")
    requests = text_requests(views.stream_table(spark, sf_dir, "benchmark"))
    _finish(stream_search(requests, indexed_documents(spark, sf_dir), WORDS, run, f"{run}/checkpoint"))
    return shown(spark.read.parquet(f"{run}/ranked"))


@query(
    "stream_request_metrics",
    f"""WITH {views.REQUEST_LOG}
    SELECT time_bucket(INTERVAL 1 HOUR, ended) AS window_start, method, path, count(*) AS requests,
      count(*) FILTER (status >= 400) AS errors, max(latency) AS max_ms, CASE WHEN max(latency) IS NOT NULL THEN TRUE ELSE FALSE END AS p95_close
    FROM ended GROUP BY ALL""",
)
def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly metrics per route of all events as a stream of log lines; percentiles are held against exact ones."""
    run = run_folder(spark, "stream-metrics")
    logs = views.request_log(views.stream_table(spark, sf_dir, "events"))
    logs = logs.withColumn("time", F.col("time").cast("timestamp"))
    _finish(stream_request_metrics(logs, f"{run}/metrics", f"{run}/checkpoint"))
    metrics = latest_metrics(spark.read.parquet(f"{run}/metrics")).drop("latency_sketch")
    metrics = metrics.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    lines = views.request_log(views.table(spark, sf_dir, "events")).withColumn("window_start", F.date_trunc("hour", "time").cast("timestamp_ntz"))
    checked = rank_is_close(metrics.filter("p95_ms IS NOT NULL"), lines.filter("latencyMs IS NOT NULL"), ("window_start", "method", "path"))
    none = metrics.filter("p95_ms IS NULL").withColumn("p95_close", F.lit(False))
    return checked.unionByName(none).drop("p95_ms")


@query(
    "stream_request_outcomes",
    f"""WITH {_SERVED}
    SELECT request_id, correlation_id, service, lines, done AS ended, first_time, last_time FROM requests
    WHERE last_time + INTERVAL 10 MINUTE <= (SELECT max(time) - INTERVAL 10 MINUTE FROM served)""",
)
def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of log lines; a request comes out when no more of its lines can come, ended or not."""
    run = run_folder(spark, "stream-outcomes")
    logs = served_logs(views.request_log(views.stream_table(spark, sf_dir, "events"))).withColumn("time", F.col("time").cast("timestamp"))
    _finish(stream_request_outcomes(logs, f"{run}/outcomes", f"{run}/checkpoint"))
    out = spark.read.parquet(f"{run}/outcomes").withColumnsRenamed({"requestId": "request_id", "correlationId": "correlation_id"})
    return out.drop("status").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_time", "last_time")})
