"""The batch search against a plain loop over all pairs, on small and awkward data."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.operators.ann import NO_CELL, approx_topk, recall_at_k, train_cells
from vecspark.operators.batch_search import TopK, batch_topk
from vecspark.session import run_folder
from vecspark.sources.vector_index import create_index

DIMS = 6


def similarity(a, b):
    if a is None or b is None or len(a) != DIMS or len(b) != DIMS or None in a or None in b:
        return None
    def dot(x, y):
        total = 0.0
        for p, q in zip(x, y, strict=True):
            total += float(np.float32(p)) * float(np.float32(q))
        return total
    scale = math.sqrt(dot(a, a) * dot(b, b))
    return dot(a, b) / scale if scale > 0 and math.isfinite(scale) else None


def expected(corpus, requests):
    out = set()
    for q, v, limit, threshold in requests:
        scored = [(id, similarity(c, v)) for id, c in corpus]
        scored.sort(key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
        n = min(max(1, 10 if limit is None else limit), 100)
        for rank, (id, s) in enumerate(scored[:n], 1):
            if threshold is None or (s is not None and s >= threshold):
                out.add((q, rank, id, s))
    return out


def awkward(seed=3, rows=700):
    """A third of the rows share one vector; some have none, a short one, zeros or extreme lengths."""
    rng = np.random.default_rng(seed)
    copy = rng.normal(size=DIMS).tolist()
    corpus = []
    for i in range(rows):
        v = copy if i % 3 == 0 else rng.normal(size=DIMS).tolist()
        if i % 50 == 1:
            v = [0.0] * DIMS
        elif i % 50 == 2:
            v = None
        elif i % 50 == 4:
            v = v[:3]
        elif i % 50 == 5:
            v = [x * 1e-28 for x in v]
        elif i % 50 == 7:
            v = [x * 1e28 for x in v]
        elif i % 50 == 8:
            v = [1.0, None, 0.0, 0.0, 1.0, 2.0]
        corpus.append((f"d{(i * 7919) % 1000:04d}", v))
    requests = [(f"q{i:03d}", rng.normal(size=DIMS).tolist(), [None, 1, 3, 100, 250, 0][i % 6], [None, 0.0, 0.3, 0.99][i % 4]) for i in range(40)]
    requests += [("copy", copy, 100, None), ("copy-cut", copy, 100, 0.9), ("zero", [0.0] * DIMS, 7, None), ("zero-cut", [0.0] * DIMS, 7, 0.0)]
    return corpus, requests


def frames(spark, corpus, requests, partitions=4):
    c = spark.createDataFrame(corpus, "id string, embedding array<float>").repartition(partitions)
    r = spark.createDataFrame(requests, "query_id string, query_embedding array<float>, limit int, threshold double")
    return c, r


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_matches_a_loop_over_all_pairs(spark, partitions):
    corpus, requests = awkward()
    c, r = frames(spark, corpus, requests, partitions)
    assert rows(batch_topk(c, r, DIMS)) == expected(corpus, requests)


def test_blocks_give_the_same_rows(spark):
    corpus, requests = awkward()
    c, r = frames(spark, corpus, requests)
    blocked = batch_topk(c, r, DIMS, broadcast_bytes=0, block_bytes=5000)
    # The corpus goes through one shuffle, however many blocks of requests there are.
    assert blocked._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("hashpartitioning(_slice") == 1
    assert rows(blocked) == expected(corpus, requests)


def test_floors_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr("vecspark.operators.batch_search.SEED_TASKS", 2)
    corpus, requests = awkward()
    c, r = frames(spark, corpus, requests, 8)
    assert rows(batch_topk(c, r, DIMS, seed_over_bytes=0)) == expected(corpus, requests)


def test_small_steps_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr("vecspark.operators.batch_search.BATCH_ROWS", 37)
    monkeypatch.setattr("vecspark.operators.batch_search.SCORE_CELLS", 64)
    import pyarrow as pa

    from vecspark.operators.batch_search import RequestBlock

    corpus, requests = awkward()
    table = pa.table(
        {
            "_query": [q for q, *_ in requests],
            "_vector": pa.array([v for _, v, *_ in requests], pa.list_(pa.float32())),
            "_limit": pa.array([min(max(1, 10 if n is None else n), 100) for *_, n, _ in requests], pa.int32()),
            "_threshold": pa.array([t for *_, t in requests], pa.float64()),
        }
    )
    best = TopK(RequestBlock.from_arrow(table, DIMS))
    best.add(np.array([i for i, _ in corpus], dtype=object), pa.array([v for _, v in corpus], pa.list_(pa.float32())))
    got = {
        (requests[q][0], i, None if math.isnan(s) else s)
        for q, s, i in zip(best.query, best.sims, best.ids, strict=True)
    }
    assert got == {(q, i, s) for q, _, i, s in expected(corpus, requests)}


def test_numbers_as_ids_and_an_empty_corpus(spark):
    c = spark.createDataFrame([(5, [1.0] * DIMS), (3, [1.0] * DIMS)], "id bigint, embedding array<float>")
    r = spark.createDataFrame([(1, [2.0] * DIMS, 1, None)], "query_id int, query_embedding array<float>, limit int, threshold double")
    found = batch_topk(c, r, DIMS).collect()
    assert [(x.query_id, x.rank, x.id) for x in found] == [(1, 1, 3)]
    assert batch_topk(c.limit(0), r, DIMS).count() == 0
    assert batch_topk(c, r.limit(0), DIMS).count() == 0


@pytest.fixture(scope="module")
def indexed(spark):
    corpus, requests = awkward()
    requests = [q for q in requests if q[1] != [0.0] * DIMS]
    c, r = frames(spark, corpus, requests)
    cells = train_cells(c.filter(~F.exists("embedding", lambda x: x.isNull())), 5, DIMS)
    return create_index(c, cells, run_folder(spark, "index")), r, c, expected(corpus, requests)


def test_all_cells_give_the_exact_result(indexed):
    index, r, _, want = indexed
    assert rows(approx_topk(index, r, nprobe=5)) == want
    assert rows(approx_topk(index, r, nprobe=5, broadcast_bytes=0)) == want


def test_recall_rises_with_the_cells_probed(indexed):
    index, r, _, _ = indexed
    exact = approx_topk(index, r, 5)
    recalls = [recall_at_k(exact, approx_topk(index, r, n)).first().recall for n in (1, 2, 4, 5)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0 and 0 < recalls[0] < 1


def test_few_cells_are_read_from_their_folders_only(indexed):
    index, r, _, _ = indexed
    one = approx_topk(index, r.filter("query_id = 'copy'"), nprobe=1)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_cell_of_rows_without_a_direction(spark, indexed):
    cells = indexed[0].cells
    df = spark.createDataFrame([("z", [0.0] * DIMS), ("n", None), ("v", [1.0] * DIMS)], "id string, embedding array<float>")
    got = {x.id: x.at.cell for x in df.withColumn("at", cells.placed(F.col("embedding"))).collect()}
    assert got["z"] == got["n"] == NO_CELL and got["v"] >= 0


def test_size_of_the_centres_is_checked(indexed):
    c = indexed[2]
    with pytest.raises(ValueError, match="centres"):
        train_cells(c, 10_000_000, DIMS)
