"""JSON request bodies to typed columns, with strict types and per-field errors.

``from_json`` with a schema turns ``{"content": 5}`` into ``'5'``; a request must be
rejected there, so bodies are parsed as variants and their types are tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions.text import js_number, longer_than
from vecspark.operators.validation import Rule, text_rules, with_errors
from vecspark.session import configure
from vecspark.schema import (
    DEFAULT_LIST_LIMIT,
    DEFAULT_SEARCH_LIMIT,
    MAX_LIMIT,
    MAX_TEXT_UNITS,
    MIN_LIMIT,
)

# Messages of refused requests.
INVALID_JSON = "Invalid JSON in request body"
INVALID_BODY = "Invalid request body"
INVALID_PARAMETERS = "Invalid query parameters"


def json_variant(body: Column) -> Column:
    """The body as a variant; NULL when it is not exactly one JSON value.

    The parser stops after the first value, so ``{"a":1} junk`` would pass. The body is
    put in an array before a mark it cannot contain; only a body that is one whole
    value leaves the mark at position 1. A missing or empty body counts as ``{}``.
    """
    text = F.when(body.isNull() | (body == ""), F.lit("{}")).otherwise(body)
    mark = F.md5(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    at_end = F.try_variant_get(pair, "$[1]", "string") == mark
    return F.when(at_end, F.try_variant_get(pair, "$[0]", "variant"))


def json_type(v: Column) -> Column:
    """object, array, string, number, boolean or null; NULL where there is no value."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .when(s.isNotNull(), "number")
    )


def _type_error(kind: Column, expected: str) -> Column:
    return F.concat(F.lit(f"Expected {expected}, received "), kind)


def _issues(*conditions: tuple[Column, str | Column]) -> Column:
    found = [F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in conditions]
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def _text_issues(kind: Column, text: Column) -> Column:
    is_text = F.coalesce(kind == "string", F.lit(False))
    return _issues(
        (kind.isNull(), "Required"),
        (kind.isNotNull() & ~is_text, _type_error(kind, "string")),
        (is_text & (text == ""), "String must contain at least 1 character(s)"),
        (
            is_text & longer_than(text, MAX_TEXT_UNITS),
            f"String must contain at most {MAX_TEXT_UNITS} character(s)",
        ),
    )


def _number_issues(kind: Column, n: Column, low: int, high: int, whole: bool) -> Column:
    is_number = F.coalesce(kind == "number", F.lit(False))
    checks = [(kind.isNotNull() & ~is_number, _type_error(kind, "number"))]
    if whole:
        finite = F.abs(n) != float("inf")
        checks.append((is_number & ~(finite & (n % 1 == 0)), "Expected integer, received float"))
    checks.append((is_number & (n < low), f"Number must be greater than or equal to {low}"))
    checks.append((is_number & (n > high), f"Number must be less than or equal to {high}"))
    return _issues(*checks)


def _parsed(df: DataFrame, body: str, fields: list[str]) -> DataFrame:
    """Add the body as a variant, its type, and the type of each field."""
    configure(df.sparkSession)  # what a repeated key means must not depend on the caller
    out = df.withColumn("_body", json_variant(F.col(body))).withColumn("_kind", json_type(F.col("_body")))
    return out.withColumns({f"_{f}_kind": json_type(_field(f)) for f in fields})


def _field(name: str) -> Column:
    # On a body that is no object there are no fields to look at.
    return F.when(F.col("_kind") == "object", F.try_variant_get("_body", f"$.{name}", "variant"))


def _value(name: str, kind: str, type: str) -> Column:
    """The field's value if its JSON type is ``kind``."""
    return F.when(F.col(f"_{name}_kind") == kind, F.try_variant_get("_body", f"$.{name}", type))


def _with_body_errors(df: DataFrame, issues: dict[str, Column]) -> DataFrame:
    """Body errors in order: bad JSON, wrong root type, then the first field with issues.

    ``field_errors`` keeps all messages, grouped by field.
    """
    is_object = F.coalesce(F.col("_kind") == "object", F.lit(False))
    found = {n: F.when(is_object & (F.size(c) > 0), c) for n, c in issues.items()}
    out = df.withColumns(
        {
            "form_errors": F.when(~is_object & F.col("_kind").isNotNull(), F.array(_type_error(F.col("_kind"), "object"))),
            "field_errors": F.struct(*[c.alias(n) for n, c in found.items()]),
        }
    )
    rules = [
        Rule(F.col("_kind").isNull(), INVALID_JSON, "body"),
        Rule(~is_object, INVALID_BODY, "body"),
        *[Rule(F.col("field_errors")[n].isNotNull(), INVALID_BODY, n) for n in issues],
    ]
    return with_errors(out, rules)


def _drop_scratch(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def parse_create_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Bodies of create requests: adds content, metadata (JSON text) and the errors.

    The raw content must have 1..8000 UTF-16 units, then the trimmed content must too.
    """
    out = _parsed(df, body, ["content", "metadata"]).withColumns(
        {
            "content": _value("content", "string", "string"),
            "metadata": F.to_json(_value("metadata", "object", "variant")),
        }
    )
    meta_kind = F.col("_metadata_kind")
    issues = {
        "content": _text_issues(F.col("_content_kind"), F.col("content")),
        "metadata": _issues((meta_kind.isNotNull() & (meta_kind != "object"), _type_error(meta_kind, "object"))),
    }
    out = _with_body_errors(out, issues)
    return _drop_scratch(with_errors(out, text_rules(F.col("content"), "content")))


def parse_search_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Bodies of search requests: adds query, limit, threshold and the errors."""
    out = _parsed(df, body, ["query", "limit", "threshold"]).withColumns(
        {
            "query": _value("query", "string", "string"),
            "_limit": _value("limit", "number", "double"),
            "_threshold": _value("threshold", "number", "double"),
        }
    )
    issues = {
        "query": _text_issues(F.col("_query_kind"), F.col("query")),
        "limit": _number_issues(F.col("_limit_kind"), F.col("_limit"), MIN_LIMIT, MAX_LIMIT, whole=True),
        "threshold": _number_issues(F.col("_threshold_kind"), F.col("_threshold"), 0, 1, whole=False),
    }
    out = _with_body_errors(out, issues)
    accepted = F.col("error_code").isNull()
    limit = F.coalesce(F.col("_limit"), F.lit(float(DEFAULT_SEARCH_LIMIT))).cast("int")
    out = out.withColumns({"limit": F.when(accepted, limit), "threshold": F.when(accepted, F.col("_threshold"))})
    return _drop_scratch(with_errors(out, text_rules(F.col("query"), "query")))


def parse_list_requests(df: DataFrame, limit_text: str = "limit_text") -> DataFrame:
    """Query-string limits of list requests: adds limit and the errors."""
    n = F.col("_n")
    kind = F.when(F.isnan(n), "nan").when(n.isNotNull(), "number")
    out = df.withColumn("_n", js_number(F.col(limit_text)))
    out = out.withColumn("_issues", _number_issues(kind, n, MIN_LIMIT, MAX_LIMIT, whole=True))
    found = F.when(F.size("_issues") > 0, F.col("_issues"))
    out = out.withColumn("field_errors", F.struct(found.alias("limit")))
    out = with_errors(out, [Rule(F.size("_issues") > 0, INVALID_PARAMETERS, "limit")])
    limit = F.coalesce(n, F.lit(float(DEFAULT_LIST_LIMIT))).cast("int")
    return _drop_scratch(out.withColumn("limit", F.when(F.col("error_code").isNull(), limit)))
