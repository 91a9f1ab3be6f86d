from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from vecspark.functions.vector import cosine_distance, cosine_similarity, format_vector, parse_vector, vector_literal
from vecspark.operators.envelope import list_envelope, search_envelope
from vecspark.operators.search import recent_documents, topk_search, with_similarity

CASES = [
    ("equal", [1.0, 2.0, 2.0], 1.0),
    ("opposite", [-1.0, -2.0, -2.0], -1.0),
    ("orthogonal", [2.0, -1.0, 0.0], 0.0),
    ("scaled", [10.0, 20.0, 20.0], 1.0),
    ("tie", [1.0, 2.0, 2.0], 1.0),
    ("zero", [0.0, 0.0, 0.0], None),
    ("short", [1.0, 2.0], None),
    ("missing", None, None),
    ("hole", [1.0, None, 2.0], None),
    ("nan", [1.0, math.nan, 2.0], None),
    ("infinite", [1.0, math.inf, 2.0], None),
    ("tiny", [1e-30, 2e-30, 2e-30], 1.0),
    ("huge", [1e30, 2e30, 2e30], 1.0),
]
QUERY = [1.0, 2.0, 2.0]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(n, v) for n, v, _ in CASES], "id string, embedding array<float>")


@pytest.mark.parametrize("method", ["arrow", "native"])
def test_similarity(corpus, method):
    got = {r.id: r.similarity for r in with_similarity(corpus, QUERY, method=method).collect()}
    for name, _, want in CASES:
        assert got[name] == (want if want is None else pytest.approx(want, abs=1e-6)), name


def test_both_methods_agree_to_the_last_bit(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = e.first()["embedding"]
    a = with_similarity(e, q).select("id", F.col("similarity").alias("a"))
    b = with_similarity(e, q, method="native").select("id", F.col("similarity").alias("b"))
    assert a.join(b, "id").filter(F.col("a") != F.col("b")).count() == 0


def test_swapping_and_scaling(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = vector_literal(e.first()["embedding"])
    half = F.transform("embedding", lambda x: x * F.lit(0.5))
    v = F.col("embedding")
    odd = e.filter(
        (cosine_similarity(v, q) != cosine_similarity(q, v))
        | (cosine_similarity(v, q) != cosine_similarity(half, q))
        | (cosine_distance(v, q) != 1 - cosine_similarity(v, q))
    )
    assert odd.count() == 0


@pytest.mark.parametrize("method", ["arrow", "native"])
def test_topk_order_ties_and_missing(corpus, method):
    ids = [r.id for r in topk_search(corpus, QUERY, limit=100, method=method).collect()]
    assert set(ids[:5]) == {"equal", "scaled", "tie", "tiny", "huge"}
    assert ids.index("equal") < ids.index("tie")
    assert ids[5:7] == ["orthogonal", "opposite"]
    # Rows without a similarity come last, by id, and pass no threshold.
    assert ids[7:] == ["hole", "infinite", "missing", "nan", "short", "zero"]
    assert {r.id for r in topk_search(corpus, QUERY, 100, 0.0, method=method).collect()} == {*ids[:5], "orthogonal"}


def test_threshold_result_is_a_prefix_and_limits_append(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = e.filter("id = 3").first()["embedding"]
    whole = [r.id for r in topk_search(e, q, 50).collect()]
    assert whole[0] == 3
    assert [r.id for r in topk_search(e, q, 20).collect()] == whole[:20]
    some = [r.id for r in topk_search(e, q, 50, 0.2).collect()]
    assert 0 < len(some) < 50 and some == whole[: len(some)]
    assert topk_search(e, q, 0).count() == 1 and topk_search(e, q, 1000).count() == 100


def test_topk_returns_the_other_columns(spark):
    rows = [("a", "first", [1.0, 0.0]), ("b", "second", [0.0, 1.0]), ("c", "third", [0.6, 0.8])]
    df = spark.createDataFrame(rows, "id string, content string, embedding array<float>")
    got = topk_search(df, [0.0, 1.0], 2)
    assert got.columns == ["id", "content", "similarity"]
    assert [(r.id, r.content) for r in got.collect()] == [("b", "second"), ("c", "third")]


def test_vector_text(spark):
    texts = ["[0.1, 0.2, 0.3]", "[1]", "[]", "[1,null]", '["a"]', "nope", "[NaN]", '["NaN"]', '["Infinity"]', None, "[[1]]", "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(parse_vector(F.col("t")).alias("v")).collect()]
    assert got[0] == pytest.approx([0.1, 0.2, 0.3]) and got[1] == [1.0]
    assert got[2:] == [None] * 10
    assert df.limit(1).select(format_vector(F.array(F.lit(0.5), F.lit(-2.0)))).first()[0] == "[0.5,-2.0]"


def listing(spark):
    rows = [("b", "two", None, "2026-01-01 00:00:00"), ("a", "one", "{}", "2026-01-02 00:00:00"), ("c", "tie", None, "2026-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id string, content string, metadata string, t string")
    return df.select("id", "content", "metadata", F.col("t").cast("timestamp_ntz").alias("created_at"))


def test_recent_documents(spark):
    df = listing(spark)
    assert [r.id for r in recent_documents(df).collect()] == ["a", "b", "c"]
    assert [r.id for r in recent_documents(df, 2).collect()] == ["a", "b"]
    assert recent_documents(df.limit(0)).count() == 0


def test_envelopes(spark):
    listed = list_envelope(recent_documents(listing(spark))).first()
    assert listed["count"] == 3 and [d.id for d in listed.documents] == ["a", "b", "c"]
    requests = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    ranked = spark.createDataFrame([("q1", 2, "y", 0.5), ("q1", 1, "x", 0.9)], "query_id string, rank int, id string, similarity double")
    got = {r.query_id: r for r in search_envelope(requests, ranked).collect()}
    assert got["q1"]["count"] == 2 and [(r.rank, r.id) for r in got["q1"].results] == [(1, "x"), (2, "y")]
    assert got["q2"]["count"] == 0 and got["q2"].results == []
