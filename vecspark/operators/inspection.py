"""What is in the corpus: counts, columns, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.functions.text import trim_text


def corpus_count(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count(F.lit(1)).alias("n"))


def corpus_columns(corpus: DataFrame) -> DataFrame:
    """Position, name, type and nullability of each column, from the schema alone."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(corpus.schema.fields, 1)]
    return corpus.sparkSession.createDataFrame(
        rows, "ordinal_position int, column_name string, data_type string, nullable boolean"
    )


HLL_BITS = 12  # of the distinct-count sketches
DISTINCT_ERROR = 3 * 1.04 / 2 ** (HLL_BITS / 2)  # relative; three standard errors of such a sketch
HASHED = ("bigint", "int", "string", "binary")  # types that sketches take as they are


def column_sketches(rows: DataFrame, part: Column | None = None) -> DataFrame:
    """One row per part and column, in one pass: rows, nulls, least and greatest value as text, sketch of the distinct values.

    Parts, such as files or days, are sketched by themselves and can be stored; see
    ``merged_profile``. Columns without an order, such as vectors and maps, have no least value.
    """
    described = []
    for i, f in enumerate(rows.schema.fields, 1):
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        ordered = isinstance(f.dataType, T.AtomicType) and kind not in ("variant", "boolean")
        hashed = c if kind in HASHED else F.to_json(F.struct(c.alias("v"))) if not isinstance(f.dataType, T.AtomicType) else c.cast("string")
        described.append(
            F.struct(
                F.lit(i).alias("ordinal_position"), F.lit(f.name).alias("column_name"), F.lit(kind).alias("data_type"), F.count(F.lit(1)).alias("n_rows"),
                F.count_if(c.isNull()).alias("nulls"), (F.min(c).cast("string") if ordered else F.lit(None).cast("string")).alias("low"),
                (F.max(c).cast("string") if ordered else F.lit(None).cast("string")).alias("high"), F.hll_sketch_agg(F.when(c.isNotNull(), hashed), F.lit(HLL_BITS)).alias("distinct_sketch"),
            )
        )
    grouped = rows.groupBy((F.lit("") if part is None else part.cast("string")).alias("part"))
    return grouped.agg(F.array(*described).alias("_c")).select("part", F.explode("_c").alias("_c")).select("part", "_c.*")


def merged_profile(sketches: DataFrame) -> DataFrame:
    """(ordinal_position, column_name, data_type, n_rows, nulls, n_distinct, low, high) of each column over all parts.

    ``n_distinct`` is off by ``DISTINCT_ERROR`` at most, nearly always; the rest is exact.
    """
    kinds = [r["data_type"] for r in sketches.filter(F.col("low").isNotNull()).select("data_type").distinct().collect()]  # as few as types

    def over(function, name: str) -> Column:
        typed = [function(F.when(F.col("data_type") == k, F.col(name).cast(k))).cast("string") for k in kinds]
        return F.coalesce(*typed, F.lit(None).cast("string")).alias(name)

    return sketches.groupBy("ordinal_position", "column_name", "data_type").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"), over(F.min, "low"), over(F.max, "high")
    )


def corpus_health(
    corpus: DataFrame,
    dims: int,
    content: str = "content",
    vector: str = "embedding",
    created_at: str = "created_at",
) -> DataFrame:
    """One row, one scan: rows, missing or blank content, bad vectors, oldest and newest."""
    text, v = F.col(content), F.col(vector)
    is_zero = (F.size(v) > 0) & ~F.exists(v, lambda x: (x != 0.0) | x.isNull())
    return corpus.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(text.isNull()).alias("null_content"),
        F.count_if(trim_text(text) == "").alias("blank_content"),
        F.count_if(v.isNull() | (F.size(v) != dims)).alias("wrong_dims"),
        F.count_if(is_zero).alias("zero_vectors"),
        F.min(created_at).alias("oldest"),
        F.max(created_at).alias("newest"),
    )
