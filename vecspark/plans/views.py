"""The given tables seen as a corpus, as requests and as a request log, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.text import JS_WHITESPACE
from vecspark.schema import APP_ERROR, EXTERNAL_SERVICE_ERROR, NOT_FOUND, VALIDATION_ERROR

VECTOR_DIMS = 64


# Types of the given tables; with them a read needs no look at the files first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files, be it one file or a folder of them."""
    # As a pattern: a stream takes the name of a single file for that of a folder.
    return spark.readStream.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parque[t]")


# ---- corpus without vectors: every document ----


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.concat(
            F.lit('{"source":"'), F.col("source"), F.lit('","lang":"'), F.col("lang"), F.lit('"}')
        ).alias("metadata"),
        F.expr("timestampadd(MINUTE, doc_id, timestamp_ntz'2024-01-01 00:00:00')").alias("created_at"),
    )


DOCUMENTS = """docs AS (
  SELECT doc_id AS id, text AS content,
         '{"source":"' || source || '","lang":"' || lang || '"}' AS metadata,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at
  FROM documents)"""


# ---- corpus of vectors: every embedding ----


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of row 0, the query of the single-query searches."""
    return vectors(spark, sf_dir).filter(F.col("id") == 0).first()["embedding"]


def vector_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a request, with a limit of 1..10 and a threshold on every second one."""
    return vectors(spark, sf_dir).select(
        F.col("id").alias("query_id"),
        F.col("embedding").alias("query_embedding"),
        (1 + F.col("id") % 10).cast("int").alias("limit"),
        F.when(F.col("id") % 2 == 1, F.lit(0.2)).alias("threshold"),
    )


# All pairs, scored as dot / sqrt(aa * bb) in double, best first.
RANKED_VECTORS = """vecs AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
ranked AS (
  SELECT q.id AS query_id, c.id AS id,
         list_dot_product(c.v, q.v) / sqrt(list_dot_product(c.v, c.v) * list_dot_product(q.v, q.v)) AS similarity,
         1 + q.id % 10 AS lim, CASE WHEN q.id % 2 = 1 THEN 0.2 END AS threshold,
         row_number() OVER (PARTITION BY q.id ORDER BY
           list_dot_product(c.v, q.v) / sqrt(list_dot_product(c.v, c.v) * list_dot_product(q.v, q.v)) DESC, c.id) AS rank
  FROM vecs q, vecs c),
found AS (
  SELECT query_id, id, similarity, rank FROM ranked
  WHERE rank <= lim AND (threshold IS NULL OR similarity >= threshold))"""

SCORED_VECTORS = """scored AS (
  SELECT c.vec_id AS id,
         list_dot_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[])
         / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])
                * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS similarity
  FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


# ---- texts with blanks of all kinds around them ----


def padded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document plain, inside blanks, inside marks that are no blanks, and as blanks only."""
    pad = F.lit(JS_WHITESPACE)
    kept = F.lit("\u200b\u0085")

    def form(name: str, content: Column) -> Column:
        return F.struct(F.lit(name).alias("form"), content.alias("content"))

    forms = F.array(
        form("plain", F.col("text")),
        form("padded", F.concat(pad, "text", pad)),
        form("marked", F.concat(F.lit(" "), kept, "text", kept, F.lit(" "))),
        form("blank", F.repeat(pad, 1 + F.length("text") % 3)),
        form("emoji", F.concat("text", F.repeat(F.lit("\U0001f600"), F.length("text")))),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(forms).alias("f"))
    return rows.select("doc_id", "f.form", "f.content")


PADDED_TEXTS = f"""padded AS (
  SELECT doc_id, 'plain' AS form, text AS content FROM documents
  UNION ALL SELECT doc_id, 'padded', '{JS_WHITESPACE}' || text || '{JS_WHITESPACE}' FROM documents
  UNION ALL SELECT doc_id, 'marked', ' ' || chr(8203) || chr(133) || text || chr(8203) || chr(133) || ' ' FROM documents
  UNION ALL SELECT doc_id, 'blank', repeat('{JS_WHITESPACE}', 1 + length(text) % 3) FROM documents
  UNION ALL SELECT doc_id, 'emoji', text || repeat(chr(128512), length(text)) FROM documents),
measured AS (
  SELECT doc_id, form, content, trim(content, '{JS_WHITESPACE}') AS trimmed,
         length(trim(content, '{JS_WHITESPACE}'))
         + length(regexp_replace(trim(content, '{JS_WHITESPACE}'), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units
  FROM padded)"""


# ---- JSON request bodies ----


def create_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create requests, good and bad, from seven tables."""

    def bodies(name: str, id: Column, body: Column) -> DataFrame:
        request_id = F.concat(F.lit(f"{name}-"), id.cast("string"))
        return table(spark, sf_dir, name).select(request_id.alias("request_id"), body.alias("body"))

    pad = F.lit(JS_WHITESPACE)
    content = F.col("text").alias("content")
    parts = [
        bodies(
            "documents", F.col("doc_id"), F.to_json(F.struct(content, F.struct("source", "lang").alias("metadata")))
        ),
        bodies("benchmark", F.col("item_id"), F.to_json(F.struct(F.array("text").alias("content")))),
        bodies(
            "customer",
            F.col("c_custkey"),
            F.to_json(F.struct(F.col("c_name").alias("content"), F.array("c_mktsegment").alias("metadata"))),
        ),
        bodies("conversations", F.concat_ws("-", "conv_id", "turn"), F.col("text")),
        bodies("events", F.col("event_id"), F.col("props")),
        bodies("labels", F.col("doc_id"), F.concat(F.lit('{"content":null,"quality":'), F.col("quality"), F.lit("}"))),
        bodies("pages", F.col("page_id"), F.to_json(F.struct(F.concat(pad, F.col("url"), pad).alias("content")))),
        bodies("nation", F.col("n_nationkey"), F.to_json(F.struct(F.repeat(pad, 2).alias("content")))),
        bodies("region", F.col("r_regionkey"), F.lit(None).cast("string")),
        bodies("supplier", F.col("s_suppkey"), F.concat(F.lit('{"content":"'), F.col("s_name"), F.lit('"} "'), F.col("s_name"), F.lit('"'))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_INVALID = "'Invalid request body'"
CREATE_BODIES = f"""creates AS (
  SELECT 'documents-' || doc_id AS request_id, '{{"lang":"' || lang || '","source":"' || source || '"}}' AS metadata,
         text AS content, CASE WHEN length(text) > 8000 THEN {_INVALID} ELSE '' END AS error_message,
         CASE WHEN length(text) > 8000 THEN 'content' ELSE '' END AS error_field,
         CASE WHEN length(text) > 8000 THEN 'String must contain at most 8000 character(s)' ELSE '' END AS issues
  FROM documents
  UNION ALL SELECT 'benchmark-' || item_id, '', '', {_INVALID}, 'content', 'Expected string, received array' FROM benchmark
  UNION ALL SELECT 'customer-' || c_custkey, '', c_name, {_INVALID}, 'metadata', 'Expected object, received array' FROM customer
  UNION ALL SELECT 'conversations-' || conv_id || '-' || turn, '', '', 'Invalid JSON in request body', 'body', '' FROM conversations
  UNION ALL SELECT 'events-' || event_id, '', '', {_INVALID}, 'content', 'Required' FROM events
  UNION ALL SELECT 'labels-' || doc_id, '', '', {_INVALID}, 'content', 'Expected string, received null' FROM labels
  UNION ALL SELECT 'pages-' || page_id, '', '{JS_WHITESPACE}' || url || '{JS_WHITESPACE}', '', '', '' FROM pages
  UNION ALL SELECT 'nation-' || n_nationkey, '', repeat('{JS_WHITESPACE}', 2), 'content cannot be empty', 'content', '' FROM nation
  UNION ALL SELECT 'region-' || r_regionkey, '', '', {_INVALID}, 'content', 'Required' FROM region
  UNION ALL SELECT 'supplier-' || s_suppkey, '', '', 'Invalid JSON in request body', 'body', '' FROM supplier)"""


def search_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests: parts by type with good and bad limits and thresholds, and other tables."""
    name = F.col("p_name").alias("query")
    limit = (F.col("p_size") * 3 - 20).alias("limit")
    threshold = ((F.col("p_size") - 5) / F.lit(40.0)).alias("threshold")
    kind = F.col("p_type")
    body = (
        F.when(kind == "STANDARD", F.to_json(F.struct(name, limit, threshold)))
        .when(kind == "ECONOMY", F.to_json(F.struct(name, F.col("p_retailprice").alias("limit"))))
        .when(kind == "MEDIUM", F.to_json(F.struct(name, F.col("p_brand").alias("limit"))))
        .when(kind == "PROMO", F.to_json(F.struct(F.col("p_size").alias("query"))))
        .when(kind == "LARGE", F.to_json(F.array("p_name")))
        .otherwise(F.to_json(F.struct(F.col("p_size").alias("limit"))))
    )

    def rows(table_name: str, id: str, text: Column) -> DataFrame:
        request_id = F.concat(F.lit(f"{table_name}-"), F.col(id).cast("string"))
        return table(spark, sf_dir, table_name).select(request_id.alias("request_id"), text.alias("body"))

    out = rows("part", "p_partkey", body)
    out = out.union(rows("documents", "doc_id", F.to_json(F.struct(F.col("text").alias("query")))))
    out = out.union(rows("benchmark", "item_id", F.col("text")))
    return out.union(rows("events", "event_id", F.col("props")))


SEARCH_BODIES = """numbers AS (SELECT *, p_size * 3 - 20 AS l, (p_size - 5) / 40.0::DOUBLE AS t FROM part),
searches AS (
  SELECT 'part-' || p_partkey AS request_id,
    CASE WHEN p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM') THEN p_name ELSE '' END AS query,
    CASE WHEN p_type = 'STANDARD' AND l BETWEEN 1 AND 100 AND t BETWEEN 0 AND 1 THEN l ELSE -1 END AS lim,
    CASE WHEN p_type = 'STANDARD' AND l BETWEEN 1 AND 100 AND t BETWEEN 0 AND 1 THEN t ELSE -1 END AS threshold,
    CASE WHEN p_type = 'STANDARD' AND l BETWEEN 1 AND 100 AND t BETWEEN 0 AND 1 THEN '' ELSE 'Invalid request body' END AS error_message,
    CASE p_type
      WHEN 'STANDARD' THEN CASE WHEN l NOT BETWEEN 1 AND 100 THEN 'limit' WHEN t NOT BETWEEN 0 AND 1 THEN 'threshold' ELSE '' END
      WHEN 'ECONOMY' THEN 'limit' WHEN 'MEDIUM' THEN 'limit' WHEN 'PROMO' THEN 'query' WHEN 'LARGE' THEN 'body'
      ELSE 'query' END AS error_field,
    CASE p_type
      WHEN 'STANDARD' THEN
        CASE WHEN l < 1 THEN 'limit: Number must be greater than or equal to 1;'
             WHEN l > 100 THEN 'limit: Number must be less than or equal to 100;' ELSE '' END
        || CASE WHEN t < 0 THEN 'threshold: Number must be greater than or equal to 0;'
                WHEN t > 1 THEN 'threshold: Number must be less than or equal to 1;' ELSE '' END
      WHEN 'ECONOMY' THEN 'limit: ' || CASE WHEN p_retailprice <> floor(p_retailprice) THEN 'Expected integer, received float,' ELSE '' END
        || 'Number must be less than or equal to 100;'
      WHEN 'MEDIUM' THEN 'limit: Expected number, received string;'
      WHEN 'PROMO' THEN 'query: Expected string, received number;'
      WHEN 'LARGE' THEN 'Expected object, received array;'
      ELSE 'query: Required;' END AS issues
  FROM numbers
  UNION ALL SELECT 'documents-' || doc_id, text, CASE WHEN length(text) > 8000 THEN -1 ELSE 10 END, -1,
    CASE WHEN length(text) > 8000 THEN 'Invalid request body' ELSE '' END, CASE WHEN length(text) > 8000 THEN 'query' ELSE '' END,
    CASE WHEN length(text) > 8000 THEN 'query: String must contain at most 8000 character(s);' ELSE '' END FROM documents
  UNION ALL SELECT 'benchmark-' || item_id, '', -1, -1, 'Invalid JSON in request body', 'body', '' FROM benchmark
  UNION ALL SELECT 'events-' || event_id, '', -1, -1, 'Invalid request body', 'query', 'query: Required;' FROM events)"""


# ---- request log: two lines per event ----


def _route_case(parts: list[str]) -> Column:
    key = F.pmod(F.col("event_id"), F.lit(4))
    return F.when(key == 0, parts[0]).when(key == 1, parts[1]).when(key == 2, parts[2]).otherwise(parts[3])


def request_log(events: DataFrame) -> DataFrame:
    """Each event as a request: one line when it arrives, one when it ends.

    Lines of failures name no status, and that of an unknown route names no latency either.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    code = F.when(
        failed,
        F.when(k % 5 == 0, VALIDATION_ERROR).when(k % 5 == 1, EXTERNAL_SERVICE_ERROR).when(k % 5 == 2, NOT_FOUND).when(k % 5 == 3, APP_ERROR).otherwise("UNEXPECTED"),
    )
    e = events.select(
        F.col("ts"),
        F.col("event_id").cast("string").alias("requestId"),
        F.col("user_id").cast("string").alias("correlationId"),
        _route_case(["GET", "POST", "POST", "GET"]).alias("method"),
        _route_case(["/", "/embeddings", "/search", "/documents"]).alias("path"),
        F.col("value").alias("latency"),
        F.expr("timestampadd(MICROSECOND, cast(round(value * 1000) as bigint), ts)").alias("ended"),
        code.alias("error_code"),
    )
    e = e.withColumn(
        "status",
        F.when(F.col("error_code").isNull(), 200)
        .when(F.col("error_code") == VALIDATION_ERROR, 400)
        .when(F.col("error_code") == NOT_FOUND, 404)
        .when(F.col("error_code").isin(EXTERNAL_SERVICE_ERROR, APP_ERROR), 502)
        .otherwise(500),
    )
    arrival = F.struct(
        F.col("ts").alias("time"),
        F.lit("info").alias("level"),
        F.lit(None).cast("int").alias("statusCode"),
        F.lit(None).cast("double").alias("latencyMs"),
        F.lit("request received").alias("msg"),
        F.lit(None).cast("string").alias("error_code"),
    )
    status = F.col("status")
    end = F.struct(
        F.col("ended").alias("time"),
        F.when(status == 200, "info").when(status.isin(400, 404), "warn").otherwise("error").alias("level"),
        F.when(status == 200, status).alias("statusCode"),
        F.when(status != 404, F.col("latency")).alias("latencyMs"),
        F.when(status == 200, "request completed")
        .when(status == 400, "validation error")
        .when(status == 404, "route not found")
        .when(status == 502, "application error")
        .otherwise("unexpected error")
        .alias("msg"),
        F.col("error_code"),
    )
    lines = e.select("requestId", "correlationId", "method", "path", F.explode(F.array(arrival, end)).alias("line"))
    return lines.select("line.*", "requestId", "correlationId", "method", "path")


REQUEST_LOG = """ended AS (
  SELECT ts, event_id::VARCHAR AS request_id, user_id::VARCHAR AS correlation_id,
         CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'POST' ELSE 'GET' END AS method,
         CASE event_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/embeddings' WHEN 2 THEN '/search' ELSE '/documents' END AS path,
         CASE WHEN event_type = 'error' AND (props->>'$.k')::INT % 5 = 2 THEN NULL ELSE value END AS latency,
         ts + to_microseconds(round(value * 1000)::BIGINT) AS ended,
         CASE WHEN event_type = 'error' THEN
           CASE (props->>'$.k')::INT % 5 WHEN 0 THEN 400 WHEN 1 THEN 502 WHEN 2 THEN 404 WHEN 3 THEN 502 ELSE 500 END
         ELSE 200 END AS status
  FROM events),
logs AS (
  SELECT ts AS time, 'info' AS level, NULL::INT AS status, NULL::DOUBLE AS latency, 'request received' AS msg,
         request_id, correlation_id, method, path FROM ended
  UNION ALL
  SELECT ended, CASE status WHEN 200 THEN 'info' WHEN 400 THEN 'warn' WHEN 404 THEN 'warn' ELSE 'error' END, status, latency,
         CASE status WHEN 200 THEN 'request completed' WHEN 400 THEN 'validation error' WHEN 404 THEN 'route not found'
                     WHEN 502 THEN 'application error' ELSE 'unexpected error' END,
         request_id, correlation_id, method, path FROM ended)"""


# ---- hashed bags of words ----

def hashed_words(source: str, id: str, text: str, dims: int, name: str = "words") -> str:
    """SQL for (id, bucket, weight) of the built-in embedder."""
    return f"""{name} AS (
  SELECT id, bucket, sum(sign)::BIGINT AS weight FROM (
    SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dims} AS bucket,
           CASE WHEN substr(md5(t), 9, 1) >= '8' THEN -1 ELSE 1 END AS sign
    FROM (SELECT {id} AS id, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {source})
    WHERE t <> '')
  GROUP BY id, bucket HAVING sum(sign) <> 0)"""
