"""Streams of create requests, search requests and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vecspark.operators.embed import Embedder
from vecspark.operators.logs import SKETCH_SIZE, request_outcomes, with_status
from vecspark.plans.ingest import index_documents
from vecspark.plans.semantic import semantic_search
from vecspark.sources.corpus import read_corpus
from vecspark.sources.vector_index import open_index


def stream_ingest(
    requests: DataFrame,
    embedder: Embedder,
    table: str,
    quarantine_table: str,
    checkpoint: str,
    index: str | None = None,
) -> DataStreamWriter:
    """Ingest a stream of create requests.

    Ids follow from request ids and are looked up in the table's key log, so a batch that is
    run again after a failure adds nothing, and a request that differs from a stored one of
    its id is refused. With the path of an index, stored rows are added to its last version.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        opened = None if index is None else open_index(batch.sparkSession, index)
        index_documents(batch, embedder, table, quarantine_table, index=opened)

    return requests.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def stream_search(
    requests: DataFrame,
    corpus_table: str,
    embedder: Embedder,
    results: str,
    checkpoint: str,
    index: str | None = None,
    nprobe: int | None = None,
) -> DataStreamWriter:
    """Answer a stream of search requests over the corpus as stored when the batch starts.

    Each batch has its own folder and overwrites it when it is run again. With the path of an
    index, its last version is opened for each batch and only the cells the batch needs are read.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if index is None:
            outcome = semantic_search(batch, read_corpus(spark, corpus_table), embedder)
        else:
            outcome = semantic_search(batch, None, embedder, index=open_index(spark, index), nprobe=nprobe)
        outcome.ranked.write.mode("overwrite").parquet(f"{results}/ranked/batch={batch_id}")
        outcome.quarantine.write.mode("overwrite").parquet(f"{results}/quarantine/batch={batch_id}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)


def request_metrics(logs: DataFrame, window: str = "1 hour") -> DataFrame:
    """Requests, errors and latency per route and time window; works on tables and streams."""
    done = with_status(logs).filter(F.col("statusCode").isNotNull())
    metrics = done.groupBy(F.window("time", window).alias("window"), "method", "path").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("statusCode") >= 400).alias("errors"),
        F.max("latencyMs").alias("max_ms"),
        # Can be merged over windows, see ``merged_latency``.
        F.kll_sketch_agg_double("latencyMs", SKETCH_SIZE).alias("latency_sketch"),
    )
    return metrics.withColumn("p95_ms", F.when(F.col("max_ms").isNotNull(), F.kll_sketch_get_quantile_double("latency_sketch", F.lit(0.95))))


def stream_request_metrics(
    logs: DataFrame, output: str, checkpoint: str, window: str = "1 hour", delay: str = "10 minutes"
) -> DataStreamWriter:
    """Keep the metrics of each window up to date; lines later than ``delay`` are dropped.

    Every batch writes the windows it changed. ``latest_metrics`` reads the current state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        flat = batch.select(F.col("window.start").alias("window_start"), "*").drop("window")
        flat.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    metrics = request_metrics(logs.withWatermark("time", delay), window)
    return metrics.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_request_outcomes(logs: DataFrame, output: str, checkpoint: str, timeout: str = "10 minutes", delay: str = "10 minutes") -> DataStreamWriter:
    """Write each request once it can get no more lines; those without an end have timed out.

    The state holds the requests of the last ``timeout`` and ``delay`` only.
    """
    outcomes = request_outcomes(logs.withWatermark("time", delay), timeout)
    return outcomes.writeStream.outputMode("append").format("parquet").option("path", output).option("checkpointLocation", checkpoint)


def latest_metrics(changes: DataFrame, sketches: bool = False) -> DataFrame:
    """The last written state of each window and route; with ``sketches`` also what ``merged_latency`` merges."""
    keys = ["window_start", "method", "path"]
    values = [c for c in changes.columns if c not in (*keys, "batch") and (sketches or c != "latency_sketch")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*")
