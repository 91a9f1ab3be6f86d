"""Identifier columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trace_id(c: Column) -> Column:
    """The given id, or a fresh UUID where it is missing."""
    return F.coalesce(c, F.uuid())


def keyed_uuid(*parts: Column) -> Column:
    """A version-4-shaped UUID that is the same on every run for the same key.

    A retried task or a replayed stream batch gives its rows the same ids again.
    """
    h = F.md5(F.to_json(F.array(*[p.cast("string") for p in parts])))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(F.translate(F.substring(h, 17, 1), "01234567cdef", "89ab89ab89ab"), F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )
