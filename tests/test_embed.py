from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.operators.embed import EMPTY, HashingEmbedder, ModelEmbedder, embed_texts, embed_weights, with_embed_errors
from vecspark.schema import TASK_DOCUMENT, TASK_QUERY


def hashed(text: str, dims: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for word in re.findall(r"[^\W_]+", text.lower()):
        h = hashlib.md5(word.encode()).hexdigest()
        b = int(h[:8], 16) % dims
        out[b] = out.get(b, 0) + (-1 if h[8] >= "8" else 1)
    return {b: w for b, w in out.items() if w}


TEXTS = ["The quick brown fox", "the THE the", "  Größe, naïve; l'été 42 ", "a b a", "...", "", None, "x" * 9000, "word " * 5000]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id int, content string")


def test_hashing_matches_a_loop(spark):
    df = embed_texts(frame(spark), HashingEmbedder(32, normalize=False))
    weights: dict[int, dict[int, int]] = {}
    for r in embed_weights(df, "id").collect():
        weights.setdefault(r.id, {})[r.bucket] = int(r.weight)
    assert weights == {i: hashed(t, 32) for i, t in enumerate(TEXTS) if t and hashed(t, 32)}
    errors = {r.id: r.embed_error for r in df.collect()}
    assert {i for i, e in errors.items() if e == EMPTY} == {4, 5, 6}


def test_unit_length_and_task(spark):
    e = HashingEmbedder(64)
    df = frame(spark).filter("id < 4")
    a = {r.id: np.array(r.embedding) for r in embed_texts(df, e, task=TASK_DOCUMENT).collect()}
    b = {r.id: np.array(r.embedding) for r in embed_texts(df, e, task=TASK_QUERY).collect()}
    for i, v in a.items():
        assert len(v) == 64 and np.linalg.norm(v) == pytest.approx(1.0, abs=1e-6)
        assert (v == b[i]).all()


def test_vector_does_not_depend_on_partitions_or_neighbours(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    e = HashingEmbedder(64)
    one = embed_texts(docs.coalesce(1), e).select("id", "embedding")
    many = embed_texts(docs.repartition(13), e).select("id", F.col("embedding").alias("other"))
    assert one.join(many, "id").filter(~F.col("embedding").eqNullSafe(F.col("other"))).count() == 0


def _load():
    def embed(texts, task):
        assert task == TASK_DOCUMENT
        if any("fail" in t for t in texts):
            raise RuntimeError("model down")
        return [None if "none" in t else [1.0] * (2 if "short" in t else 3) for t in texts]

    return embed


def test_failures_stay_with_their_rows(spark):
    texts = ["ok", "fail", "none", "short", " ok too ", None]
    m = ModelEmbedder(_load, dims=3, batch_size=4, service="model x")
    got = with_embed_errors(embed_texts(frame(spark, texts).coalesce(1), m), m).orderBy("id").collect()
    assert [r.error_cause for r in got] == [None, "model down", EMPTY, "Expected 3 dims, got 2", None, EMPTY]
    assert [r.embedding is None for r in got] == [False, True, True, True, False, True]
    assert got[1].error_code == "EXTERNAL_SERVICE_ERROR" and got[1].error_message == "Error from external service: model x"


def test_model_is_loaded_once_per_task_and_called_once_per_text(spark, tmp_path):
    log = str(tmp_path / "calls")

    def load():
        with open(log, "a") as f:
            f.write("load\n")

        def embed(texts, task):
            with open(log, "a") as f:
                f.write("text\n" * len(texts))
            return [[1.0, 0.0]] * len(texts)

        return embed

    m = ModelEmbedder(load, dims=2, batch_size=7)
    df = with_embed_errors(embed_texts(frame(spark, [f"t{i}" for i in range(100)]).repartition(2), m), m)
    assert df.filter(F.col("error_code").isNull()).count() == 100
    calls = open(log).read().split()
    assert calls.count("load") == 2 and calls.count("text") == 100


def test_model_runs_whole_batches_not_single_texts(spark, tmp_path):
    log = str(tmp_path / "sizes")

    def load():
        def embed(texts, task):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return [[1.0]] * len(texts)

        return embed

    m = ModelEmbedder(load, dims=1, batch_size=10)
    embed_texts(frame(spark, ["x"] * 25).coalesce(1), m).write.format("noop").mode("overwrite").save()
    assert sorted(open(log).read().split()) == ["10", "10", "5"]
