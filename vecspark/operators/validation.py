"""Row checks. A bad row never fails the job: it gets an error and goes to quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions.text import js_number, longer_than, trim_text
from vecspark.schema import (
    APP_ERROR,
    DEFAULT_LIST_LIMIT,
    DEFAULT_SEARCH_LIMIT,
    EXTERNAL_SERVICE_ERROR,
    MAX_LIMIT,
    MAX_TEXT_UNITS,
    MIN_LIMIT,
    NOT_FOUND,
    VALIDATION_ERROR,
)

ERROR_COLUMNS = ("error_code", "error_message", "error_field")


@dataclass(frozen=True)
class Rule:
    """A row that meets ``broken`` fails with this code, message and field."""

    broken: Column
    message: str | Column
    field: str
    code: str = VALIDATION_ERROR


def with_errors(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the error columns; the first broken rule wins, and an earlier error stays."""
    error = None
    for r in rules:
        message = r.message if isinstance(r.message, Column) else F.lit(r.message)
        value = F.struct(
            F.lit(r.code).alias("error_code"),
            message.alias("error_message"),
            F.lit(r.field).alias("error_field"),
        )
        hit = F.coalesce(r.broken, F.lit(False))
        error = F.when(hit, value) if error is None else error.when(hit, value)
    had_error = "error_code" in df.columns

    def column(name: str) -> Column:
        new = F.col("_error")[name]
        return (F.when(F.col("error_code").isNull(), new).otherwise(F.col(name)) if had_error else new).alias(name)

    kept = [c for c in df.columns if c not in ERROR_COLUMNS]
    return df.withColumn("_error", error).select(*kept, *[column(n) for n in ERROR_COLUMNS])


def valid(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error_code").isNull()).drop(*ERROR_COLUMNS)


def quarantine(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error_code").isNotNull())


def nonblank_rule(text: Column, field: str) -> Rule:
    return Rule(F.coalesce(trim_text(text), F.lit("")) == "", f"{field} cannot be empty", field)


def length_rule(text: Column, field: str, units: int = MAX_TEXT_UNITS) -> Rule:
    return Rule(longer_than(trim_text(text), units), f"{field} exceeds max length of {units} chars", field)


def text_rules(text: Column, field: str) -> list[Rule]:
    """Trimmed text must have 1..8000 UTF-16 units."""
    return [nonblank_rule(text, field), length_rule(text, field)]


def effective_limit(limit: Column, default: int = DEFAULT_SEARCH_LIMIT) -> Column:
    return F.coalesce(limit, F.lit(default))


def limit_rule(limit: Column, default: int = DEFAULT_SEARCH_LIMIT) -> Rule:
    """A limit must be a whole number in 1..100; a missing one takes the default."""
    n = effective_limit(limit, default).cast("double")
    ok = n.between(MIN_LIMIT, MAX_LIMIT) & (n == F.floor(n))
    return Rule(~ok, f"limit must be between {MIN_LIMIT} and {MAX_LIMIT}", "limit")


def list_limit(text: Column) -> Column:
    """The list limit from query-string text: a number, or the default when missing."""
    return effective_limit(js_number(text), DEFAULT_LIST_LIMIT)


def list_limit_rule(text: Column) -> Rule:
    return limit_rule(js_number(text), DEFAULT_LIST_LIMIT)


def clamp_limit(limit: Column) -> Column:
    """Force a limit into 1..100."""
    return F.least(F.greatest(F.lit(MIN_LIMIT), limit), F.lit(MAX_LIMIT))


def threshold_rule(threshold: Column) -> Rule:
    """A threshold, if present, must be in 0..1."""
    return Rule(
        threshold.isNotNull() & ~threshold.between(0.0, 1.0),
        "threshold must be between 0 and 1",
        "threshold",
    )


def dims_rule(vector: Column, dims: int, service: str = "embedding model") -> Rule:
    """The vector must be there and have exactly ``dims`` elements, none of them NULL."""
    full = vector.isNotNull() & (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull())
    return Rule(
        ~F.coalesce(full, F.lit(False)),
        f"Error from external service: {service}",
        "embedding",
        EXTERNAL_SERVICE_ERROR,
    )


def error_status(code: Column, success: int = 200) -> Column:
    """Status code of an outcome: 200/201, 400, 404, 502 or 500."""
    return (
        F.when(code.isNull(), F.lit(success))
        .when(code == VALIDATION_ERROR, F.lit(400))
        .when(code == NOT_FOUND, F.lit(404))
        .when(code.isin(EXTERNAL_SERVICE_ERROR, APP_ERROR), F.lit(502))
        .otherwise(F.lit(500))
    )


def error_report(errors: DataFrame) -> DataFrame:
    """How often each field failed, and with which messages (one count per message)."""
    return errors.groupBy(*ERROR_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
