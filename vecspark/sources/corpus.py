"""The corpus as a parquet table: scan, append under a primary key, evolve the schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.schema import DOCUMENT
from vecspark.session import run_folder

LISTED = ("id", "content", "metadata", "created_at")
BROADCAST_KEYS = 500_000


def corpus_scan(corpus: DataFrame, columns: Sequence[str] = LISTED) -> DataFrame:
    """Every row, chosen columns only; the columns left out are not read from disk."""
    return corpus.select(*columns)


def strip_embedding(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return rows.drop(vector)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The stored corpus, or an empty one where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], DOCUMENT)


def utc_now() -> Column:
    """The clock as a UTC timestamp without zone, whatever the session zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


class KeyStats(NamedTuple):
    rows: int
    most: int  # rows of the most frequent key


def key_stats(staged: DataFrame, key: str = "id") -> KeyStats:
    """Rows and the highest number of rows per key, from the key column alone."""
    counts = staged.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows, most = counts.agg(F.sum("n"), F.max("n")).first()
    return KeyStats(rows or 0, most or 0)


def one_per_key(staged: DataFrame, key: str = "id", stats: KeyStats | None = None) -> DataFrame:
    """One row per key, the same one on every run.

    Whole rows are shuffled only if a key repeats. The minimum is taken in each task first,
    so a key with very many copies does not fill one task.
    """
    if (stats or key_stats(staged, key)).most <= 1:
        return staged
    others = [c for c in staged.columns if c != key]
    if not others:
        return staged.distinct()
    return staged.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*").select(*staged.columns)


def new_rows(
    staged: DataFrame,
    stored: DataFrame,
    key: str = "id",
    broadcast_keys: int = BROADCAST_KEYS,
    stats: KeyStats | None = None,
) -> DataFrame:
    """Staged rows whose key is not stored yet, one per key.

    The keys present on both sides are found first, from the two key columns. If the batch
    is small its keys are sent to the stored table, which is then scanned and not shuffled.
    If few keys are present on both sides, the staged rows are not shuffled either.
    """
    stats = stats or key_stats(staged, key)
    batch, keys, known = one_per_key(staged, key, stats), staged.select(key), stored.select(key)
    if stats.rows <= broadcast_keys:
        present = known.join(F.broadcast(keys.distinct()), key, "left_semi").distinct()
        return batch.join(F.broadcast(present), key, "left_anti")
    folder = run_folder(staged.sparkSession, "present")
    known.join(keys, key, "left_semi").distinct().write.parquet(folder)
    present = staged.sparkSession.read.schema(known.schema).parquet(folder)
    if present.count() <= broadcast_keys:
        present = F.broadcast(present)
    return batch.join(present, key, "left_anti")


def corpus_append(staged: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Append the rows with new keys and return them without their vectors.

    The new rows are written once and read from there, so that nothing is computed twice
    and the rows returned are the rows stored.
    """
    spark = staged.sparkSession
    folder = run_folder(spark, "appended")
    new_rows(staged, read_corpus(spark, path), key).write.parquet(folder)
    added = spark.read.schema(staged.schema).parquet(folder)
    added.write.mode("append").parquet(path)
    return added.drop("embedding")


# ---- schema evolution on plain parquet ----


@dataclass(frozen=True)
class AddColumn:
    """Add a column unless it is there; ``default`` fills it in all rows."""

    name: str
    type: str
    default: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.name in df.columns:
            return df
        return df.withColumn(self.name, F.lit(self.default).cast(self.type))


@dataclass(frozen=True)
class Backfill:
    """Replace NULL by a value."""

    name: str
    value: str

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, F.coalesce(F.col(self.name), F.lit(self.value).cast(df.schema[self.name].dataType)))


@dataclass(frozen=True)
class RequireNotNull:
    """Stop with an error at the first NULL the query meets."""

    name: str

    def apply(self, df: DataFrame) -> DataFrame:
        failed = F.raise_error(F.lit(f"column {self.name} contains null values")).cast(df.schema[self.name].dataType)
        return df.withColumn(self.name, F.coalesce(F.col(self.name), failed))


# The steps the corpus table has gone through, in order.
MIGRATIONS = (
    AddColumn("metadata", "string"),
    Backfill("metadata", "{}"),
    RequireNotNull("metadata"),
    AddColumn("test_field", "string"),
)


def schema_evolve(df: DataFrame, steps: Sequence[AddColumn | Backfill | RequireNotNull] = MIGRATIONS) -> DataFrame:
    """Apply the steps in order; steps that are already done change nothing."""
    for step in steps:
        df = step.apply(df)
    return df


def not_null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows break each not-null rule, in one scan."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
