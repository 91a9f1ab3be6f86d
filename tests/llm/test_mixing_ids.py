"""Mixing where ids repeat: no more is taken than the target asks for, and reruns agree."""

from __future__ import annotations

from collections import Counter

import pytest

from vecspark.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i % 3, "w " * 10, "a", i) for i in range(100)] + [(200 + i, "w " * (1 + i % 7), "b", i) for i in range(300)] + [(None, "w w", "c", i) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, pos int").repartition(4)


def test_repeated_ids_do_not_overshoot(docs):
    out = mixing.mix(docs).collect()
    assert len(out) == 460
    for source, most in (("a", 10), ("b", 7), ("c", 2)):
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= most / 2 + 1e-6
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_mixed_rows_are_those_that_were_taken(docs):
    taken, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["copies"]
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    for r in rows.collect():
        got[r["doc_id"], r["source"], len(r["text"].split())] += 1
    assert got == +taken
    each = Counter((r["source"], r["pos"]) for r in rows.collect())
    assert max(each.values()) <= 3
