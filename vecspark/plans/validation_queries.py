"""Registered queries: request parsing, checks, error codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators.requests import parse_create_requests, parse_list_requests, parse_search_requests
from vecspark.operators.validation import (
    clamp_limit,
    dims_rule,
    error_report,
    error_status,
    length_rule,
    limit_rule,
    list_limit,
    list_limit_rule,
    nonblank_rule,
    quarantine,
    text_rules,
    threshold_rule,
    with_errors,
)
from vecspark.plans import views
from vecspark.plans.registry import query
from vecspark.session import configure


def _text(name: str):
    return F.coalesce(F.col(name), F.lit("")).alias(name)


@query(
    "request_parse",
    f"WITH {views.CREATE_BODIES} SELECT request_id, content, metadata, error_message, error_field, issues FROM creates",
)
def _request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create requests: bad JSON, wrong shape, wrong types, long and blank texts."""
    configure(spark)
    parsed = parse_create_requests(views.create_bodies(spark, sf_dir))
    issues = F.array_join(
        F.concat(F.coalesce("field_errors.content", F.array().cast("array<string>")),
                 F.coalesce("field_errors.metadata", F.array().cast("array<string>"))), ","
    )
    return parsed.select(
        "request_id", _text("content"), _text("metadata"), _text("error_message"), _text("error_field"), issues.alias("issues")
    )


@query(
    "validate_request_schema",
    f"""WITH {views.SEARCH_BODIES}
    SELECT request_id, query, lim::BIGINT AS lim, threshold::DOUBLE AS threshold, error_message, error_field, issues FROM searches""",
)
def _request_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests with their typed fields, and all messages of the refused ones."""
    configure(spark)
    parsed = parse_search_requests(views.search_bodies(spark, sf_dir))

    def listed(label: str, messages):
        return F.coalesce(F.concat(F.lit(label), F.array_join(messages, ","), F.lit(";")), F.lit(""))

    issues = F.concat(
        listed("", F.col("form_errors")),
        *[listed(f"{n}: ", F.col(f"field_errors.{n}")) for n in ("query", "limit", "threshold")],
    )
    return parsed.select(
        "request_id",
        _text("query"),
        F.coalesce("limit", F.lit(-1)).cast("bigint").alias("lim"),
        F.coalesce("threshold", F.lit(-1.0)).alias("threshold"),
        _text("error_message"),
        _text("error_field"),
        issues.alias("issues"),
    )


@query(
    "validate_nonblank",
    f"""WITH {views.PADDED_TEXTS}
    SELECT doc_id, form, CASE WHEN trimmed = '' THEN 'content cannot be empty' ELSE '' END AS error_message FROM measured""",
)
def _nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = with_errors(views.padded_texts(spark, sf_dir), [nonblank_rule(F.col("content"), "content")])
    return checked.select("doc_id", "form", _text("error_message"))


@query(
    "validate_length",
    f"""WITH {views.PADDED_TEXTS}
    SELECT doc_id, form, CASE WHEN units > 8000 THEN 'content exceeds max length of 8000 chars' ELSE '' END AS error_message
    FROM measured""",
)
def _length(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = with_errors(views.padded_texts(spark, sf_dir), [length_rule(F.col("content"), "content")])
    return checked.select("doc_id", "form", _text("error_message"))


# List limits as query strings: numbers, names, fractions, padded and hexadecimal numbers, none.
_LIMITS = """limits AS (
  SELECT p_partkey, p_type, p_size,
    CASE p_type WHEN 'STANDARD' THEN (p_size * 3 - 20)::DOUBLE WHEN 'ECONOMY' THEN NULL WHEN 'MEDIUM' THEN p_retailprice
      WHEN 'PROMO' THEN p_size::DOUBLE WHEN 'LARGE' THEN (p_size * 4)::DOUBLE ELSE 20.0 END AS n
  FROM part)"""


def _limit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, kind = F.col("p_size"), F.col("p_type")
    text = (
        F.when(kind == "STANDARD", (size * 3 - 20).cast("string"))
        .when(kind == "ECONOMY", F.col("p_name"))
        .when(kind == "MEDIUM", F.col("p_retailprice").cast("string"))
        .when(kind == "PROMO", F.concat(F.lit(" "), size.cast("string"), F.lit(".0 ")))
        .when(kind == "LARGE", F.concat(F.lit("0x"), F.hex(size * 4)))
    )
    return views.table(spark, sf_dir, "part").select("p_partkey", text.alias("limit_text"))


@query(
    "validate_limit",
    f"""WITH {_LIMITS}
    SELECT p_partkey, coalesce(n, -1000.0) AS n,
      CASE WHEN n BETWEEN 1 AND 100 AND n = floor(n) THEN '' ELSE 'limit must be between 1 and 100' END AS error_message
    FROM limits""",
)
def _limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _limit_texts(spark, sf_dir)
    checked = with_errors(texts, [list_limit_rule(F.col("limit_text"))])
    n = F.nanvl(list_limit(F.col("limit_text")), F.lit(-1000.0))
    return checked.select("p_partkey", n.alias("n"), _text("error_message"))


@query(
    "validate_list_request",
    f"""WITH {_LIMITS}
    SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 100 AND n = floor(n) THEN n::BIGINT ELSE -1 END AS lim,
      CASE WHEN n BETWEEN 1 AND 100 AND n = floor(n) THEN '' ELSE 'Invalid query parameters' END AS error_message,
      CASE WHEN n IS NULL THEN 'Expected number, received nan' ELSE
        concat_ws(',', CASE WHEN n <> floor(n) THEN 'Expected integer, received float' END,
          CASE WHEN n < 1 THEN 'Number must be greater than or equal to 1' END,
          CASE WHEN n > 100 THEN 'Number must be less than or equal to 100' END) END AS issues
    FROM limits""",
)
def _list_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_list_requests(_limit_texts(spark, sf_dir))
    issues = F.array_join(F.coalesce("field_errors.limit", F.array().cast("array<string>")), ",")
    lim = F.coalesce("limit", F.lit(-1)).cast("bigint")
    return parsed.select("p_partkey", lim.alias("lim"), _text("error_message"), issues.alias("issues"))


@query(
    "validate_threshold",
    """SELECT p_partkey, CASE WHEN p_type <> 'SMALL' AND NOT ((p_size - 5) / 40.0::DOUBLE BETWEEN 0 AND 1)
       THEN 'threshold must be between 0 and 1' ELSE '' END AS error_message FROM part""",
)
def _threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from -0.1 to 1.125; small parts have none."""
    threshold = F.when(F.col("p_type") != "SMALL", (F.col("p_size") - 5) / F.lit(40.0))
    rows = views.table(spark, sf_dir, "part").select("p_partkey", threshold.alias("threshold"))
    return with_errors(rows, [threshold_rule(F.col("threshold"))]).select("p_partkey", _text("error_message"))


@query("clamp_limit", "SELECT p_partkey, least(greatest(1, p_size * 3 - 20), 100)::BIGINT AS lim FROM part")
def _clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lim = clamp_limit(F.col("p_size") * 3 - 20).cast("bigint")
    return views.table(spark, sf_dir, "part").select("p_partkey", lim.alias("lim"))


@query(
    "validate_dims",
    """SELECT vec_id, CASE WHEN label = 0 THEN '' ELSE 'EXTERNAL_SERVICE_ERROR' END AS error_code,
       CASE WHEN label = 0 THEN '' ELSE 'Error from external service: embedding model' END AS error_message FROM embeddings""",
)
def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut short by their label; label 1 has none at all."""
    label = F.col("label")
    vector = F.when(label != 1, F.slice("embedding", F.lit(1), views.VECTOR_DIMS - label))
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", vector.alias("embedding"))
    checked = with_errors(rows, [dims_rule(F.col("embedding"), views.VECTOR_DIMS)])
    return checked.select("vec_id", _text("error_code"), _text("error_message"))


@query(
    "error_status",
    f"WITH {views.REQUEST_LOG} SELECT request_id, status::BIGINT AS status FROM ended",
)
def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every logged request from the error code of the line that ends it."""
    logs = views.request_log(views.table(spark, sf_dir, "events")).filter(F.col("msg") != "request received")
    return logs.select(F.col("requestId").alias("request_id"), error_status(F.col("error_code")).cast("bigint").alias("status"))


@query(
    "error_report",
    f"""WITH {views.PADDED_TEXTS}, {_LIMITS}, errors AS (
      SELECT CASE WHEN trimmed = '' THEN 'content cannot be empty' WHEN units > 8000 THEN 'content exceeds max length of 8000 chars' END AS m,
        'content' AS f FROM measured
      UNION ALL SELECT CASE WHEN n BETWEEN 1 AND 100 AND n = floor(n) THEN NULL ELSE 'limit must be between 1 and 100' END, 'limit' FROM limits)
    SELECT 'VALIDATION_ERROR' AS error_code, m AS error_message, f AS error_field, count(*) AS n
    FROM errors WHERE m IS NOT NULL GROUP BY m, f""",
)
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every failure of the texts and of the list limits."""
    texts = with_errors(views.padded_texts(spark, sf_dir), text_rules(F.col("content"), "content"))
    limits = with_errors(_limit_texts(spark, sf_dir), [list_limit_rule(F.col("limit_text"))])
    columns = ("error_code", "error_message", "error_field")
    return error_report(quarantine(texts).select(*columns).union(quarantine(limits).select(*columns)))
