"""Columns a result list shows: scores, dates, the metadata source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_clamped(similarity: Column) -> Column:
    """Similarity forced into 0..1 for display; the raw value spans -1..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))


def score_display(similarity: Column) -> dict[str, Column]:
    """Score, distance (3 decimals) and bar width in percent."""
    pct = score_clamped(similarity)
    return {
        "score": F.round(pct, 3),
        "distance": F.round(1 - pct, 3),
        "percent": pct * 100,
    }


def metadata_source(metadata: Column) -> Column:
    """``source`` of a JSON metadata object, as text; NULL when there is none."""
    return F.get_json_object(metadata, "$.source")


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 UTC text with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def short_date(ts: Column) -> Column:
    """Month, day and 12-hour time, such as ``Jan 5, 09:30 AM``."""
    return F.date_format(ts, "MMM d, hh:mm a")
