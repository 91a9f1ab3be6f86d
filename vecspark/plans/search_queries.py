"""Registered queries: similarity, top-k, listings, approximate search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.vector import cosine_distance, cosine_similarity, vector_literal
from vecspark.operators.ann import Cells, approx_topk, bounded_topk, cells_of, recall_at_k, train_cells
from vecspark.operators.batch_search import batch_topk
from vecspark.operators.envelope import list_envelope, search_envelope
from vecspark.operators.search import fetch, file_of, recent_documents, result_rank, threshold_filter, topk_positions, with_similarity
from vecspark.plans import views
from vecspark.plans.registry import query
from vecspark.session import run_folder
from vecspark.sources.vector_index import VectorIndex, create_index, open_index

CELLS = 16
CENTRE_STEP = 31  # every so many of the first vectors is a centre
NPROBE = 12


@query("cosine_distance", f"WITH {views.SCORED_VECTORS} SELECT id, round(1 - similarity, 6) AS distance FROM scored")
def _distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vector_literal(views.first_vector(spark, sf_dir))
    return views.vectors(spark, sf_dir).select("id", F.round(cosine_distance(F.col("embedding"), q), 6).alias("distance"))


@query("cosine_similarity", f"WITH {views.SCORED_VECTORS} SELECT id, round(similarity, 6) AS similarity FROM scored")
def _similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vector_literal(views.first_vector(spark, sf_dir))
    return views.vectors(spark, sf_dir).select("id", F.round(cosine_similarity(F.col("embedding"), q), 6).alias("similarity"))


_PAYLOAD = """SELECT s.id, d.content, d.metadata, d.created_at, round(s.similarity, 6) AS similarity
FROM best s JOIN docs d ON s.id = d.id"""


def _corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents there are, so that every result has its document, with the document's file."""
    documents = views.documents(spark, sf_dir)
    return views.vectors(spark, sf_dir).join(documents.select("id", file_of(documents)), "id")


def _with_documents(best: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of at most 100 results."""
    rows = fetch(views.documents(spark, sf_dir), best)
    return rows.select("id", "content", "metadata", "created_at", F.round("similarity", 6).alias("similarity"))


@query(
    "topk_search",
    f"""WITH {views.DOCUMENTS}, {views.SCORED_VECTORS},
    best AS (SELECT * FROM scored WHERE id IN (SELECT id FROM docs) ORDER BY similarity DESC, id LIMIT 10) {_PAYLOAD}""",
)
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topk_positions(_corpus_vectors(spark, sf_dir), views.first_vector(spark, sf_dir), limit=10)
    return _with_documents(best, spark, sf_dir)


@query(
    "topk_threshold",
    f"""WITH {views.DOCUMENTS}, {views.SCORED_VECTORS},
    best AS (SELECT * FROM scored WHERE similarity >= 0.2 AND id IN (SELECT id FROM docs) ORDER BY similarity DESC, id LIMIT 100) {_PAYLOAD}""",
)
def _topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topk_positions(_corpus_vectors(spark, sf_dir), views.first_vector(spark, sf_dir), limit=100, threshold=0.2)
    return _with_documents(best, spark, sf_dir)


@query(
    "threshold_filter",
    f"WITH {views.SCORED_VECTORS} SELECT id, round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.0",
)
def _threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows at or above 0: a threshold of 0 drops the negative similarities."""
    scored = with_similarity(views.vectors(spark, sf_dir), views.first_vector(spark, sf_dir))
    return threshold_filter(scored, 0.0).select("id", F.round("similarity", 6).alias("similarity"))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_topk(views.vectors(spark, sf_dir), views.vector_requests(spark, sf_dir), views.VECTOR_DIMS)


@query(
    "batch_topk",
    f"WITH {views.RANKED_VECTORS} SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM found",
)
def _batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding searched for among all embeddings."""
    found = _batch(spark, sf_dir)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("similarity", 6).alias("similarity"))


@query(
    "search_envelope",
    f"""WITH {views.RANKED_VECTORS}, per AS (
      SELECT query_id, count(*) AS n, string_agg(rank || ':' || id, ',' ORDER BY rank) AS results FROM found GROUP BY query_id)
    SELECT e.vec_id AS query_id, coalesce(n, 0) AS count, coalesce(results, '') AS results
    FROM embeddings e LEFT JOIN per ON e.vec_id = per.query_id""",
)
def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per request; rank and id of each result as text."""
    requests = views.vector_requests(spark, sf_dir)
    answers = search_envelope(requests.select("query_id"), _batch(spark, sf_dir))
    shown = F.transform("results", lambda r: F.concat_ws(":", r["rank"].cast("string"), r["id"].cast("string")))
    return answers.select("query_id", "count", F.array_join(shown, ",").alias("results"))


@query(
    "result_rank",
    """WITH top AS (
      SELECT source, doc_id AS id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
      FROM documents)
    SELECT source, id, n_chars, rank FROM top""",
)
def _rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions within each group: here the longest documents of each source."""
    scored = views.table(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("id"), "n_chars", F.col("n_chars").cast("double").alias("similarity")
    )
    ranked = result_rank(scored, query="source").withColumn("rank", F.col("rank").cast("bigint"))
    return ranked.select("source", "id", "n_chars", "rank")


@query(
    "recent_documents",
    f"WITH {views.DOCUMENTS} SELECT id, content, metadata, created_at FROM docs ORDER BY created_at DESC, id LIMIT 20",
)
def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_documents(views.documents(spark, sf_dir))


@query(
    "list_envelope",
    f"""WITH {views.DOCUMENTS}, newest AS (SELECT * FROM docs ORDER BY created_at DESC, id LIMIT 100)
    SELECT count(*) AS count, string_agg(id || ' ' || metadata, ',' ORDER BY created_at DESC, id) AS documents FROM newest""",
)
def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = list_envelope(recent_documents(views.documents(spark, sf_dir), limit=100))
    shown = F.transform("documents", lambda d: F.concat_ws(" ", d["id"].cast("string"), d["metadata"]))
    return listing.select("count", F.array_join(shown, ",").alias("documents"))


def _index(spark: SparkSession, sf_dir: str, cells: Cells | None = None) -> VectorIndex:
    """All vectors in an index that is stored in two batches and opened again; given vectors are the centres."""
    corpus = views.vectors(spark, sf_dir)
    if cells is None:
        cells = cells_of(corpus.filter((F.col("id") % CENTRE_STEP == 0) & (F.col("id") < CELLS * CENTRE_STEP)))
    path = run_folder(spark, "index")
    create_index(corpus.filter(F.col("id") % 3 > 0), cells, path).append(corpus)
    return open_index(spark, path)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("similarity", 6).alias("similarity"))


# The cells around given vectors, and how near each is to each vector.
_NEAR = f"""centres AS (
  SELECT vec_id // {CENTRE_STEP} AS cell, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % {CENTRE_STEP} = 0 AND vec_id < {CELLS * CENTRE_STEP}),
near AS (
  SELECT e.vec_id AS id, cell, row_number() OVER (PARTITION BY e.vec_id
    ORDER BY list_dot_product(e.embedding::DOUBLE[], c.v) / sqrt(list_dot_product(c.v, c.v)) DESC, cell) AS place FROM embeddings e, centres c)"""


@query(
    "approx_topk_all_cells",
    f"WITH {views.RANKED_VECTORS} SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM found",
)
def _approx_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing all cells gives the exact result; cells by k-means."""
    index = _index(spark, sf_dir, train_cells(views.vectors(spark, sf_dir), CELLS, views.VECTOR_DIMS))
    return _shown(approx_topk(index, views.vector_requests(spark, sf_dir), nprobe=CELLS))


@query(
    "approx_topk",
    f"""WITH {views.RANKED_VECTORS}, {_NEAR}, probed AS (
      SELECT query_id, r.id, similarity, lim, threshold, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, r.id) AS rank
      FROM ranked r JOIN near own ON own.id = r.id AND own.place = 1 JOIN near asked ON asked.id = query_id AND asked.cell = own.cell AND asked.place <= {NPROBE})
    SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM probed WHERE rank <= lim AND (threshold IS NULL OR similarity >= threshold)""",
)
def _approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cells of each request; see ``recall_at_k`` for what that finds."""
    return _shown(approx_topk(_index(spark, sf_dir), views.vector_requests(spark, sf_dir), nprobe=NPROBE))


@query(
    "approx_topk_join",
    f"WITH {views.RANKED_VECTORS} SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM found",
)
def _approx_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells again, by the join on cells that any number of requests can take."""
    return _shown(approx_topk(_index(spark, sf_dir), views.vector_requests(spark, sf_dir), nprobe=CELLS, broadcast_bytes=0))


@query(
    "bounded_topk",
    f"WITH {views.RANKED_VECTORS} SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM found",
)
def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact result from cells that are read until no other can hold a better row."""
    return _shown(bounded_topk(_index(spark, sf_dir), views.vector_requests(spark, sf_dir), first=2)[0])


_MEASURED = (1, 4, 8, NPROBE, CELLS)


@query(
    "recall_at_k",
    f"""WITH {views.RANKED_VECTORS}, {_NEAR}, hits AS (
      SELECT query_id, nprobe, avg((asked.place <= nprobe)::INT) AS share
      FROM found f JOIN near own ON own.id = f.id AND own.place = 1 JOIN near asked ON asked.id = query_id AND asked.cell = own.cell,
        (SELECT unnest([{", ".join(map(str, _MEASURED))}]) AS nprobe)
      GROUP BY query_id, nprobe)
    SELECT nprobe, count(*) AS queries, round(avg(share), 9) AS recall FROM hits GROUP BY nprobe""",
)
def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact results found, by cells probed."""
    index = _index(spark, sf_dir)
    requests = views.vector_requests(spark, sf_dir)
    exact = _batch(spark, sf_dir)
    rows = None
    for nprobe in _MEASURED:
        row = recall_at_k(exact, approx_topk(index, requests, nprobe)).select(F.lit(nprobe).alias("nprobe"), "queries", F.round("recall", 9).alias("recall"))
        rows = row if rows is None else rows.union(row)
    return rows
