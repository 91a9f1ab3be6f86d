"""Results as one row per request or listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_envelope(
    requests: DataFrame,
    ranked: DataFrame,
    columns: Sequence[str] = ("id", "similarity"),
    query_id: str = "query_id",
) -> DataFrame:
    """Each request with ``count`` and ``results`` in rank order; no match gives count 0.

    A request has at most 100 results, so its array is bounded.
    """
    item = F.struct("rank", *columns)
    grouped = ranked.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(item)).alias("results")
    )
    out = requests.join(grouped, query_id, "left")
    empty = F.array().cast(grouped.schema["results"].dataType)
    return out.withColumn("count", F.coalesce("count", F.lit(0))).withColumn("results", F.coalesce("results", empty))


def list_envelope(
    recent: DataFrame, columns: Sequence[str] = ("id", "content", "metadata", "created_at")
) -> DataFrame:
    """One row with ``count`` and ``documents``, newest first, for a listing of at most 100 rows."""
    item = F.struct(*columns)

    def newest_first(a, b):
        before = (a["created_at"] > b["created_at"]) | ((a["created_at"] == b["created_at"]) & (a["id"] < b["id"]))
        return F.when(before, F.lit(-1)).otherwise(F.lit(1))

    return recent.agg(
        F.count(F.lit(1)).alias("count"),
        F.array_sort(F.collect_list(item), newest_first).alias("documents"),
    )
