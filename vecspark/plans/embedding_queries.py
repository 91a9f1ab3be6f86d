"""Registered queries: embedding, ingest and search by text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.text import JS_WHITESPACE
from vecspark.operators.embed import HashingEmbedder, ModelEmbedder, embed_texts, embed_weights, with_embed_errors
from vecspark.plans import views
from vecspark.plans.corpus_queries import _uuid_sql
from vecspark.plans.ingest import index_documents
from vecspark.plans.registry import query
from vecspark.plans.semantic import semantic_search
from vecspark.schema import TASK_DOCUMENT, TASK_QUERY
from vecspark.session import run_folder, spread

DIMS = 256
WORDS = HashingEmbedder(DIMS, normalize=False)
_TRIMMED = f"trim(text, '{JS_WHITESPACE}')"


@query(
    "embed_documents",
    f"WITH {views.hashed_words('documents', 'doc_id', _TRIMMED, DIMS)} SELECT id, bucket, weight FROM words",
)
def _embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number weights of every document, one row per non-zero bucket."""
    texts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    long = embed_weights(embed_texts(spread(texts, "id"), WORDS, "text", task=TASK_DOCUMENT), "id")
    return long.select("id", F.col("bucket").cast("bigint").alias("bucket"), F.col("weight").cast("bigint").alias("weight"))


@query(
    "embed_queries",
    f"""WITH {views.hashed_words('benchmark', 'item_id', _TRIMMED, DIMS)}, sizes AS (
      SELECT id, sqrt(sum(weight * weight)::DOUBLE) AS length FROM words GROUP BY id)
    SELECT w.id, bucket, round((weight / length)::FLOAT::DOUBLE, 5) AS weight, '{TASK_QUERY}' AS task
    FROM words w JOIN sizes s ON w.id = s.id""",
)
def _embed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the query texts."""
    texts = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    long = embed_weights(embed_texts(texts, HashingEmbedder(DIMS), "text", task=TASK_QUERY), "id")
    return long.select(
        "id",
        F.col("bucket").cast("bigint").alias("bucket"),
        F.round(F.col("weight").cast("double"), 5).alias("weight"),
        F.lit(TASK_QUERY).alias("task"),
    )


def _load_letter_counter():
    """A stand-in model: it counts letters, refuses long texts and answers short ones wrongly."""

    def embed(texts: Sequence[str], task: str) -> list[list[float]]:
        if any(len(t) > 8000 for t in texts):
            raise ValueError("text is too long for the model")
        return [[float(len(t)), 1.0] if len(t) >= 200 else [float(len(t))] for t in texts]

    return embed


@query(
    "embed_failures",
    f"""SELECT doc_id AS id,
      CASE WHEN n > 8000 OR n < 200 THEN 'EXTERNAL_SERVICE_ERROR' ELSE '' END AS error_code,
      CASE WHEN n > 8000 THEN 'text is too long for the model' WHEN n < 200 THEN 'Expected 2 dims, got 1' ELSE '' END AS error_cause,
      CASE WHEN n > 8000 OR n < 200 THEN -1 ELSE n END AS letters
    FROM (SELECT doc_id, length({_TRIMMED}) AS n FROM documents)""",
)
def _embed_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails for some texts: only those are refused."""
    model = ModelEmbedder(_load_letter_counter, dims=2)
    texts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    checked = with_embed_errors(embed_texts(texts, model, "text"), model)
    return checked.select(
        "id",
        F.coalesce("error_code", F.lit("")).alias("error_code"),
        F.coalesce("error_cause", F.lit("")).alias("error_cause"),
        F.coalesce(F.col("embedding")[0].cast("bigint"), F.lit(-1)).alias("letters"),
    )


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.documents(spark, sf_dir).withColumn("request_id", F.col("id").cast("string")).drop("id")


def outcomes(spark: SparkSession, table: str, quarantine: str) -> DataFrame:
    """What is stored and what was refused."""
    stored = spark.read.parquet(table).select(
        "id",
        F.lit("stored").alias("outcome"),
        F.char_length("content").cast("bigint").alias("chars"),
        F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("buckets"),
    )
    refused = spark.read.parquet(quarantine).select(
        "id", F.col("error_message"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    )
    return stored.union(refused)


OUTCOMES_SQL = f"""WITH {views.hashed_words('documents', 'doc_id', _TRIMMED, DIMS)}, used AS (
      SELECT id, count(*) AS buckets FROM words GROUP BY id)
    SELECT {_uuid_sql('doc_id')} AS id,
      CASE WHEN length({_TRIMMED}) > 8000 THEN 'content exceeds max length of 8000 chars' ELSE 'stored' END AS outcome,
      CASE WHEN length({_TRIMMED}) > 8000 THEN 0 ELSE length({_TRIMMED}) END::BIGINT AS chars,
      CASE WHEN length({_TRIMMED}) > 8000 THEN 0 ELSE buckets END::BIGINT AS buckets
    FROM documents d JOIN used u ON d.doc_id = u.id"""


@query("index_documents", OUTCOMES_SQL)
def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest all documents; run it twice, the second run adds nothing."""
    run = run_folder(spark, "index")
    for _ in range(2):
        index_documents(document_requests(spark, sf_dir), WORDS, f"{run}/corpus", f"{run}/refused", F.col("created_at"))
    return outcomes(spark, f"{run}/corpus", f"{run}/refused")


def indexed_documents(spark: SparkSession, sf_dir: str) -> str:
    """Folder of a corpus table with all accepted documents."""
    run = run_folder(spark, "corpus")
    index_documents(document_requests(spark, sf_dir), WORDS, f"{run}/corpus", f"{run}/refused", F.col("created_at"))
    return f"{run}/corpus"


# Sums of whole numbers are exact, so both sides get the same similarity to the last bit.
SEARCH_SQL = f"""WITH {views.hashed_words('documents', 'doc_id', _TRIMMED, DIMS, 'words')},
    {views.hashed_words('benchmark', 'item_id', _TRIMMED, DIMS, 'asked')},
    dd AS (SELECT id, sum(weight * weight)::DOUBLE AS s FROM words
           WHERE id IN (SELECT doc_id FROM documents WHERE length({_TRIMMED}) <= 8000) GROUP BY id),
    qq AS (SELECT id, sum(weight * weight)::DOUBLE AS s FROM asked GROUP BY id),
    dots AS (SELECT a.id AS q, w.id AS d, sum(a.weight * w.weight)::DOUBLE AS dot
             FROM asked a JOIN words w ON a.bucket = w.bucket GROUP BY a.id, w.id),
    pairs AS (SELECT qq.id AS query_id, dd.id AS doc_id, coalesce(dot, 0) / sqrt(qq.s * dd.s) AS similarity
              FROM qq CROSS JOIN dd LEFT JOIN dots ON dots.q = qq.id AND dots.d = dd.id),
    named AS (SELECT query_id, {_uuid_sql('doc_id')} AS id, similarity FROM pairs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM named)
    SELECT query_id::VARCHAR AS query_id, rank, id, round(similarity, 6) AS similarity FROM ranked
    WHERE rank <= 1 + query_id % 20 AND (query_id % 2 = 0 OR similarity >= 0.25)"""


def text_requests(texts: DataFrame) -> DataFrame:
    """Query texts with limits from 1 to 20 and a threshold on every second one."""
    n = F.col("item_id")
    return texts.select(
        n.cast("string").alias("query_id"),
        F.col("text").alias("query"),
        (1 + n % 20).cast("int").alias("limit"),
        F.when(n % 2 == 1, F.lit(0.25)).alias("threshold"),
    )


def shown(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("similarity", 6).alias("similarity")
    )


@query("semantic_search", SEARCH_SQL)
def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search the indexed documents for every benchmark text."""
    corpus = spark.read.parquet(indexed_documents(spark, sf_dir))
    requests = text_requests(views.table(spark, sf_dir, "benchmark"))
    return shown(semantic_search(requests, corpus, WORDS).ranked)
