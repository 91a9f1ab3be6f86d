"""Single-query search and newest-first listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.functions.vector import similarity_to, similarity_to_native
from vecspark.schema import DEFAULT_LIST_LIMIT, DEFAULT_SEARCH_LIMIT, MAX_LIMIT, MIN_LIMIT
from vecspark.session import run_folder

MERGE_SLOTS = 32
FILE = "_file"


def clamped(limit: int) -> int:
    return min(max(MIN_LIMIT, limit), MAX_LIMIT)


def similarity_column(vector: Column, query: Sequence[float], method: str = "arrow") -> Column:
    """Similarity to one query vector.

    ``arrow`` sends only the vector column to Python in batches; ``native`` stays in the
    JVM. Both add the products in the same order, so the values are identical.
    """
    if method == "arrow":
        return similarity_to(vector, query)
    if method == "native":
        return similarity_to_native(vector, query)
    raise ValueError(f"unknown method: {method}")


def with_similarity(
    corpus: DataFrame, query: Sequence[float], vector: str = "embedding", method: str = "arrow"
) -> DataFrame:
    """Add the similarity of each row to one query vector."""
    return corpus.withColumn("similarity", similarity_column(F.col(vector), query, method))


def topk_search(
    corpus: DataFrame,
    query: Sequence[float],
    limit: int = DEFAULT_SEARCH_LIMIT,
    threshold: float | None = None,
    id: str = "id",
    vector: str = "embedding",
    method: str = "arrow",
) -> DataFrame:
    """The ``limit`` most similar rows, most similar first, without their vectors.

    The ranking reads ids and vectors only, and each task keeps its own best rows, so no
    more than ``limit`` small rows per partition are moved. The other columns are fetched for
    the at most 100 results alone: see ``fetch``.
    """
    best = topk_positions(corpus, query, limit, threshold, id, vector, method)
    others = [c for c in corpus.columns if c != vector]
    if others == [id]:
        return best.drop(FILE)
    order = [F.col("similarity").desc_nulls_last(), F.col(id).asc()]
    return fetch(corpus.select(*others), best, id).orderBy(*order).limit(clamped(limit))


def topk_positions(
    corpus: DataFrame,
    query: Sequence[float],
    limit: int = DEFAULT_SEARCH_LIMIT,
    threshold: float | None = None,
    id: str = "id",
    vector: str = "embedding",
    method: str = "arrow",
) -> DataFrame:
    """(id, similarity, _file) of the best rows; ``_file`` is the file a row is in, NULL if the corpus is not read from files.

    The threshold is tested after the limit: the rows that pass are a prefix of the ordered
    result, and testing it before would compute the similarity twice.
    """
    order = [F.col("similarity").desc_nulls_last(), F.col(id).asc()]
    scored = corpus.select(id, similarity_column(F.col(vector), query, method).alias("similarity"), file_of(corpus))
    return threshold_filter(scored.orderBy(*order).limit(clamped(limit)), threshold)


def file_of(rows: DataFrame) -> Column:
    """The file each row is read from, as the column ``_file``; one that the rows bring along is kept."""
    if FILE in rows.columns:
        return F.col(FILE)
    try:
        rows.select("_metadata.file_path").schema  # noqa: B018
    except AnalysisException:
        return F.lit(None).cast("string").alias(FILE)
    return F.col("_metadata.file_path").alias(FILE)


def fetch(rows: DataFrame, best: DataFrame, id: str = "id") -> DataFrame:
    """The rows of at most 100 results with their similarity, read from the files the results are in.

    The results are ranked now, once; their files and ids then prune the scan of everything
    else, so what is read does not grow with the table.
    """
    found = best.collect()
    rows_of = rows.filter(F.col(id).isin([r[id] for r in found]))
    files = {r[FILE] for r in found}
    if files and None not in files and FILE not in rows.columns:
        rows_of = rows_of.filter(F.col("_metadata.file_path").isin(sorted(files)))
    kept = rows.sparkSession.createDataFrame([(r[id], r["similarity"]) for r in found], T.StructType([best.schema[id], best.schema["similarity"]]))
    return rows_of.join(F.broadcast(kept), id)


def threshold_filter(scored: DataFrame, threshold: float | Column | None) -> DataFrame:
    """Rows at or above the threshold; NULL means no threshold, 0 is a real one."""
    if threshold is None:
        return scored
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scored.filter(t.isNull() | (F.col("similarity") >= t))


def result_rank(
    scored: DataFrame, query: str = "query_id", id: str = "id", top: int | None = None, limit: str | None = None
) -> DataFrame:
    """1-based position of each query's results: of all, of the best ``top``, or of its own ``limit``.

    The literal bound lets each task drop rows beyond it before the shuffle. What is left of
    a query that many tasks have rows of is first ranked in a few slots, then as a whole.
    Without a bound all rows are ranked, see ``rank_all``.
    """
    if top is None:
        best = rank_all(scored, query, id)
        return best if limit is None else best.filter(F.col("rank") <= F.col(limit))

    def ranked(df: DataFrame, *keys: str) -> DataFrame:
        order = W.partitionBy(*keys).orderBy(F.col("similarity").desc_nulls_last(), F.col(id).asc())
        best = df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return best if limit is None else best.filter(F.col("rank") <= F.col(limit))

    slots = scored.withColumn("_slot", F.pmod(F.spark_partition_id(), F.lit(MERGE_SLOTS)))
    return ranked(ranked(slots, query, "_slot").drop("_slot", "rank"), query)


def rank_all(scored: DataFrame, query: str, id: str) -> DataFrame:
    """Positions of all rows of each query, however many one query has.

    Rows are sorted over all tasks by range and written; a row's position is the one in its
    task plus the rows the query has in earlier tasks.
    """
    spark = scored.sparkSession
    order = [F.col("similarity").desc_nulls_last(), F.col(id).asc()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = run_folder(spark, "ranked")
    ranges = scored.repartitionByRange(n, F.col(query), *order).withColumn("_range", F.spark_partition_id())
    ranges.write.parquet(folder)
    rows = spark.read.schema(ranges.schema).parquet(folder)
    before = W.partitionBy(query).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(query, "_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    counts = counts.select(F.col(query).alias("_query"), F.col("_range").alias("_of"), "_before")
    joined = rows.join(counts, F.col(query).eqNullSafe(F.col("_query")) & (F.col("_range") == F.col("_of")))
    place = F.row_number().over(W.partitionBy(query, "_range").orderBy(*order))
    return joined.withColumn("rank", (place + F.col("_before")).cast("int")).drop("_range", "_query", "_of", "_before")


def recent_documents(
    corpus: DataFrame,
    limit: int = DEFAULT_LIST_LIMIT,
    columns: Sequence[str] = ("id", "content", "metadata", "created_at"),
    id: str = "id",
    created_at: str = "created_at",
) -> DataFrame:
    """The newest ``limit`` rows without vectors.

    The first scan reads the time column alone and finds the oldest time that can still be
    listed. The second scan takes it as a pushed-down filter, so row groups of older rows
    are skipped and the text of the corpus is not read.
    """
    n = clamped(limit)
    newest = corpus.select(created_at).orderBy(F.col(created_at).desc()).limit(n)
    oldest_listed = newest.agg(F.min(created_at)).scalar()
    return (
        corpus.filter(F.col(created_at) >= oldest_listed)
        .select(*columns)
        .orderBy(F.col(created_at).desc(), F.col(id).asc())
        .limit(n)
    )
