"""Row types of the corpus, the search requests, the results and the request log."""

from __future__ import annotations

from pyspark.sql import types as T

# Sizes, limits and defaults of documents and requests.
DEFAULT_DIMS = 1536
MAX_TEXT_UNITS = 8000
MIN_LIMIT, MAX_LIMIT = 1, 100
DEFAULT_SEARCH_LIMIT, DEFAULT_LIST_LIMIT = 10, 20

# Embedding tasks.
TASK_DOCUMENT = "RETRIEVAL_DOCUMENT"
TASK_QUERY = "RETRIEVAL_QUERY"
TASK_FAQ = "RETRIEVAL_FAQ"

# Error codes of quarantined rows.
VALIDATION_ERROR = "VALIDATION_ERROR"
EXTERNAL_SERVICE_ERROR = "EXTERNAL_SERVICE_ERROR"
APP_ERROR = "APP_ERROR"
NOT_FOUND = "NOT_FOUND"

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("embedding", VECTOR, False),
        T.StructField("metadata", T.StringType(), True),
        T.StructField("created_at", T.TimestampNTZType(), False),
    ]
)

SEARCH_RESULT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("similarity", T.DoubleType(), True),
        T.StructField("metadata", T.StringType(), True),
        T.StructField("created_at", T.TimestampNTZType(), False),
    ]
)

REQUEST_LOG = T.StructType(
    [
        T.StructField("time", T.TimestampType(), True),
        T.StructField("level", T.StringType(), True),
        T.StructField("requestId", T.StringType(), True),
        T.StructField("correlationId", T.StringType(), True),
        T.StructField("method", T.StringType(), True),
        T.StructField("path", T.StringType(), True),
        T.StructField("statusCode", T.IntegerType(), True),
        T.StructField("latencyMs", T.DoubleType(), True),
        T.StructField("msg", T.StringType(), True),
        T.StructField("service", T.StringType(), True),
        T.StructField("env", T.StringType(), True),
    ]
)
