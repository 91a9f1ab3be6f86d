"""Search by text: check the requests, embed the queries, find the best rows, build the answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.text import trim_text
from vecspark.operators.ann import approx_topk, bounded_topk
from vecspark.operators.batch_search import batch_topk
from vecspark.operators.embed import Embedder, embed_texts, with_embed_errors
from vecspark.operators.envelope import search_envelope
from vecspark.operators.requests import parse_search_requests
from vecspark.operators.search import FILE, file_of
from vecspark.operators.validation import ERROR_COLUMNS, effective_limit, limit_rule, text_rules, threshold_rule, with_errors
from vecspark.schema import TASK_QUERY
from vecspark.session import configure, run_folder, spread
from vecspark.sources.vector_index import VectorIndex

BROADCAST_BYTES = 64 << 20  # results are sent to the corpus scan up to this measured size
MOST_FILES = 1000  # that a scan is told by name; beyond it all are read


@dataclass(frozen=True)
class SearchOutcome:
    """``requests``: accepted; ``quarantine``: refused; ``numbered``: the results.

    Query ids may repeat or be NULL. The column ``request`` tells requests apart, in
    ``requests`` and in ``numbered``.
    """

    numbered: DataFrame
    requests: DataFrame
    quarantine: DataFrame

    @property
    def ranked(self) -> DataFrame:
        """query_id, rank, id, similarity."""
        return self.numbered.select("query_id", "rank", "id", "similarity")

    def envelope(self, corpus: DataFrame, columns: tuple[str, ...] = ("content", "metadata", "created_at")) -> DataFrame:
        """One row per accepted request with its count and results, with the corpus columns.

        The ids of the corpus tell which files have results, and these columns are read from
        those files only. Results of a checked size are sent to that scan, and the corpus is
        not shuffled.
        """
        ranked = self.numbered.select("request", "rank", "id", "similarity")
        size = ranked.agg(F.sum(F.octet_length(F.col("id").cast("string")) + 32)).first()[0] or 0
        small = size <= BROADCAST_BYTES
        rows = corpus.select("id", *columns)
        file = file_of(corpus)
        if small and "_metadata" in file._jc.toString():
            ids = F.broadcast(ranked.select("id").distinct())
            files = [r[0] for r in corpus.select("id", file).join(ids, "id", "left_semi").select(FILE).distinct().limit(MOST_FILES + 1).collect()]
            if len(files) <= MOST_FILES:
                rows = corpus.filter(F.col("_metadata.file_path").isin(files)).select("id", *columns)
        found = rows.join(F.broadcast(ranked) if small else ranked, "id")
        asked = self.requests.select("request", "query_id", "query")
        return search_envelope(asked, found, ("id", "similarity", *columns), query_id="request").drop("request")


def check_searches(requests: DataFrame) -> DataFrame:
    """Errors for (query_id, query, limit, threshold) rows, in the order a search tests them."""
    rules = [
        *text_rules(F.col("query"), "query"),
        limit_rule(F.col("limit")),
        threshold_rule(F.col("threshold")),
    ]
    return with_errors(requests, rules)


def semantic_search(
    requests: DataFrame,
    corpus: DataFrame | None,
    embedder: Embedder,
    id: str = "id",
    vector: str = "embedding",
    index: VectorIndex | None = None,
    nprobe: int | None = None,
    **sizes,
) -> SearchOutcome:
    """Answer (query_id, query, limit, threshold) or (query_id, body) rows over a corpus.

    With an index, the ``nprobe`` nearest cells of each request are searched, or, without a
    number, as many as it takes to prove the result exact; the corpus is not read then.

    The embedded requests are written once, so that the model runs once per query, and so
    are the results, so that ``ranked`` and ``envelope`` do not search again.
    """
    spark = configure(requests.sparkSession)
    checked = parse_search_requests(requests) if "body" in requests.columns else check_searches(requests)
    accepted = F.col("error_code").isNull()
    text = F.when(accepted, trim_text(F.col("query"))).alias("query_text")
    checked = spread(checked, "query_id", requests.count()).select("query_id", "query", text, "limit", "threshold", *ERROR_COLUMNS)
    embedded = with_embed_errors(
        embed_texts(checked, embedder, "query_text", "query_embedding", TASK_QUERY), embedder, "query_embedding"
    )
    staging = run_folder(spark, "requests")
    embedded.withColumn("request", F.monotonically_increasing_id()).write.parquet(staging)
    staged = spark.read.parquet(staging)
    good = staged.filter(F.col("error_code").isNull())
    if index is None:
        best = batch_topk(corpus, good, embedder.dims, id=id, vector=vector, query_id="request", **sizes)
    elif nprobe is None:
        best, _ = bounded_topk(index, good, query_id="request", **sizes)
    else:
        best = approx_topk(index, good, nprobe, query_id="request", **sizes)
    best = best.withColumnRenamed("query_id", "request").join(good.select("request", "query_id"), "request")
    results = run_folder(spark, "results")
    best.write.parquet(results)
    numbered = spark.read.schema(best.schema).parquet(results)
    plain = good.select("request", "query_id", "query", "query_text", effective_limit(F.col("limit")).cast("int").alias("limit"), "threshold")
    return SearchOutcome(numbered, plain, staged.filter(F.col("error_code").isNotNull()).drop("query_embedding", "request"))
