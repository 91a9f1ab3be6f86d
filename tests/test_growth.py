"""Tables of several files, and jobs whose tasks must not grow with the input."""

from __future__ import annotations

import __spark_entry__ as contract


def test_a_table_in_several_files_is_streamed_whole(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, f"some words about {i}" if i % 7 else "long " * 2000, "en", "web", 9) for i in range(40)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = contract.queries()["stream_ingest"](spark, str(tmp_path)).collect()
    assert sorted(r["outcome"] == "stored" for r in got) == [False] * 6 + [True] * 34


def test_tiles_stay_bounded_when_both_tables_grow():
    from vecspark.operators.batch_search import BLOCK_BYTES, TILE_PRODUCTS, tile_layout

    for n in (20_000, 100_000, 600_000):
        for sizes in ({0: (n, n)}, {c: (n // 16, n) for c in range(-1, 16)}):
            layout, tiles = tile_layout(sizes, 64, 12, BLOCK_BYTES)
            assert all((sizes[c][0] / slices) * (sizes[c][1] / groups) * 64 <= TILE_PRODUCTS for c, slices, groups, _ in layout)
            assert tiles >= 12
            starts = [first for *_, first in layout]
            assert starts == [sum(s * g for _, s, g, _ in layout[:i]) for i in range(len(layout))]


def test_tiles_give_the_rows_of_the_whole(spark, monkeypatch):
    import numpy as np

    from vecspark.operators.ann import approx_topk, cells_of
    from vecspark.operators.batch_search import batch_topk
    from vecspark.sources.vector_index import create_index

    monkeypatch.setattr("vecspark.operators.batch_search.TILE_SIDE", 30)
    vectors = np.random.default_rng(5).normal(size=(150, 8)).astype(np.float32)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    requests = corpus.selectExpr("id AS query_id", "embedding AS query_embedding", "cast(1 + id % 5 AS int) AS limit", "if(id % 2 = 1, 0.3D, null) AS threshold")
    whole = sorted(map(tuple, batch_topk(corpus, requests, 8).collect()))
    tiled = batch_topk(corpus, requests, 8, broadcast_bytes=0)
    assert sorted(map(tuple, tiled.collect())) == whole
    # More tiles than slices: requests are grouped as well.
    assert tiled.sparkSession.sparkContext.defaultParallelism > 1 and "_group" in tiled._jdf.queryExecution().toString()
    index = create_index(corpus, cells_of(corpus.filter("id < 3")), f"{spark.conf.get('spark.checkpoint.dir')}/tiles")
    assert sorted(map(tuple, approx_topk(index, requests, 3, broadcast_bytes=0).collect())) == whole


def test_texts_are_cut_into_words_some_at_a_time(monkeypatch):
    import pyarrow as pa

    from vecspark.operators import embed

    texts = pa.array([" ".join(f"w{(i * k) % 97}" for k in range(1, 60)) if i % 5 else "" for i in range(300)])
    want = embed._bucket_sums(texts, 16)
    seen = []
    split = embed.pc.split_pattern_regex
    monkeypatch.setattr(embed, "HASH_BYTES", 2000)
    monkeypatch.setattr(embed.pc, "split_pattern_regex", lambda t, **k: (seen.append(sum(map(len, t.to_pylist()))), split(t, **k))[1])
    assert (embed._bucket_sums(texts, 16) == want).all()
    assert max(seen) <= 2000 and len(seen) > 5


def test_texts_of_the_mix_are_not_shuffled_however_many_there_are(spark):
    from vecspark.llm.mixing import mix, mixed

    docs = spark.range(300).selectExpr("id % 40 AS doc_id", "repeat('a b ', 1 + cast(id % 40 AS int)) AS text", "if(id % 40 < 30, concat('s', id % 2), null) AS source", "id AS doc")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if any table were large
    try:
        out = mixed(docs)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        made = {tuple(r) for r in out.groupBy("doc_id", "source").count().collect()}
        want = {tuple(r) for r in mix(docs).groupBy("doc_id", "source").agg({"copies": "sum"}).collect() if r[2]}
        assert made == want and out.select("doc").distinct().count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
