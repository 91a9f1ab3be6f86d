"""The stored index: appends, versions, exact search by bounds, recall."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_batch_search import DIMS, awkward, expected, frames, rows
from vecspark.operators.ann import approx_topk, bounded_topk, cells_of, probes_for, recall_at_k, recall_by_probes, train_cells
from vecspark.session import run_folder
from vecspark.sources.vector_index import create_index, open_index

CENTRES, SIZE = 24, 3000


@pytest.fixture(scope="module")
def clustered(spark):
    """Tight clusters, the centres' own vectors first."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(CENTRES, 16))
    v = np.concatenate([centres, centres[rng.integers(0, CENTRES, SIZE)] + 0.15 * rng.normal(size=(SIZE, 16))]).astype(np.float32)
    corpus = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>")
    asked = [(i, [float(x) for x in v[i * 7] + 0.01], 1 + i % 20, 0.5 if i % 3 == 0 else None) for i in range(200)]
    requests = spark.createDataFrame(asked, "query_id long, query_embedding array<float>, limit int, threshold double")
    index = create_index(corpus, cells_of(corpus.filter(F.col("id") < CENTRES)), run_folder(spark, "index"))
    return corpus, requests, index


def exact(index, requests):
    return {tuple(r) for r in approx_topk(index, requests, CENTRES).collect()}


def test_bounds_prove_the_result_with_few_cells(clustered):
    _, requests, index = clustered
    found, read = bounded_topk(index, requests)
    assert {tuple(r) for r in found.collect()} == exact(index, requests)
    r = read.agg(F.sum("cells_read").alias("n"), F.sum("cells").alias("all"), F.count(F.lit(1)).alias("requests")).first()
    assert r.requests == 200 and 200 <= r.n < 0.5 * r["all"]
    joined, _ = bounded_topk(index, requests, broadcast_bytes=0)
    assert {tuple(r) for r in joined.collect()} == exact(index, requests)


@pytest.mark.parametrize("broadcast_bytes", [0, 64 << 20])
def test_bounds_with_awkward_rows_and_requests(spark, broadcast_bytes):
    """Vectors without a direction, copies, thresholds, limits beyond the corpus, requests without a vector."""
    corpus, requests = awkward()
    c, r = frames(spark, corpus, requests)
    index = create_index(c, train_cells(c.filter(~F.exists("embedding", lambda x: x.isNull())), 5, DIMS), run_folder(spark, "index"))
    found, _ = bounded_topk(index, r, first=2, broadcast_bytes=broadcast_bytes)
    assert rows(found) == expected(corpus, requests)


def test_an_index_grows_and_a_repeated_batch_adds_nothing(spark, clustered):
    corpus, requests, whole = clustered
    path = run_folder(spark, "index")
    index = create_index(corpus.filter("id % 4 = 0"), whole.cells, path)
    for part in ("id % 4 = 1", "id % 4 in (1, 2)", "id % 4 = 3", "id % 4 = 3", "false"):
        open_index(spark, path).append(corpus.filter(part))
    again = open_index(spark, path)
    assert again.version == index.version == 1
    assert sorted(map(tuple, again.rows().select("id", "cell").collect())) == sorted(map(tuple, whole.rows().select("id", "cell").collect()))
    assert (again.sizes()[1] <= whole.sizes()[1] + 1e-12).all() and (again.sizes()[0] >= whole.sizes()[0]).all()
    assert {tuple(r) for r in bounded_topk(again, requests)[0].collect()} == exact(whole, requests)


def test_versions(spark, clustered):
    corpus, requests, _ = clustered
    path = run_folder(spark, "index")
    create_index(corpus.filter("id < 1000"), cells_of(corpus.filter("id < 4")), path)
    create_index(corpus, train_cells(corpus, 7, 16), path)
    assert (open_index(spark, path).version, len(open_index(spark, path).cells)) == (2, 7)
    old = open_index(spark, path, 1)
    assert (len(old.cells), old.rows().count(), open_index(spark, path).rows().count()) == (4, 1000, SIZE + CENTRES)
    with pytest.raises(ValueError, match="version 3"):
        open_index(spark, path, 3)


def test_empty_index(spark, clustered):
    corpus, requests, whole = clustered
    index = create_index(corpus.limit(0), whole.cells, run_folder(spark, "index"))
    assert approx_topk(index, requests, 2).count() == 0
    assert bounded_topk(index, requests)[0].count() == 0
    assert bounded_topk(index, requests, broadcast_bytes=0)[0].count() == 0
    assert approx_topk(whole, requests.limit(0), 2).count() == 0


def test_probes_follow_from_the_recall_asked_for(spark, clustered):
    corpus, requests, whole = clustered
    index = create_index(corpus, train_cells(corpus, 40, 16, seed=1), run_folder(spark, "index"))
    curve = {r.nprobe: r.recall for r in recall_by_probes(index, requests).collect()}
    assert list(curve.values()) == sorted(curve.values()) and curve[40] == pytest.approx(1.0) and len(curve) == 40
    n = probes_for(index, requests, 0.9)
    assert curve[n] >= 0.9 and (n == 1 or curve[n - 1] < 0.9)
    full = approx_topk(index, requests, 40)
    assert recall_at_k(full, approx_topk(index, requests, n)).first().recall >= 0.85
    assert probes_for(index, requests, 1.1) == 40
