"""Ingest, search by text and their streaming forms."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vecspark.operators.embed import HashingEmbedder, ModelEmbedder
from vecspark.operators.search import topk_search
from vecspark.plans import ingest
from vecspark.plans.ingest import REPEATED_ID, STORED_ID, index_documents
from vecspark.plans.semantic import semantic_search
from vecspark.schema import DOCUMENT, SEARCH_RESULT
from vecspark.session import run_folder
from vecspark.sources.bodies import bodies_table, read_bodies, stream_bodies
from vecspark.sources import key_log
from vecspark.sources.corpus import read_corpus
from vecspark.sources.key_log import KeyLog
from vecspark.streaming.jobs import latest_metrics, request_metrics, stream_ingest, stream_request_metrics, stream_search

WORDS = HashingEmbedder(128, normalize=False)


def bodies(spark, *values):
    rows = [(f"r{i}", v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "request_id string, body string")


@pytest.fixture
def tables(spark):
    run = run_folder(spark, "test")
    return f"{run}/corpus", f"{run}/refused"


def test_ingest_stores_the_good_and_keeps_the_bad(spark, tables):
    requests = bodies(spark, {"content": "  hello world  ", "metadata": {"topic": "pets"}}, {"content": " "}, "nope", {"content": "..."})
    out = {r.request_id: r for r in index_documents(requests, WORDS, *tables).collect()}
    assert out["r0"].embedding_dim == 128 and out["r0"].error_code is None
    stored = spark.read.parquet(tables[0])
    assert stored.columns == ["id", "content", "embedding", "metadata", "created_at"]
    row = stored.first()
    assert stored.count() == 1 and row.content == "hello world" and json.loads(row.metadata) == {"topic": "pets"}
    assert dict(stored.dtypes)["created_at"] == "timestamp_ntz"
    refused = {r.request_id: r.error_message for r in spark.read.parquet(tables[1]).collect()}
    assert refused == {
        "r1": "content cannot be empty",
        "r2": "Invalid JSON in request body",
        "r3": "Error from external service: embedding model",
    }


def test_a_repeated_batch_adds_nothing_and_equal_texts_are_two_documents(spark, tables):
    requests = bodies(spark, {"content": "same"}, {"content": "same"}, {"content": "other"})
    for _ in range(2):
        index_documents(requests, WORDS, *tables)
    assert spark.read.parquet(tables[0]).count() == 3
    index_documents(requests.union(bodies(spark, {"content": "x"}).withColumn("request_id", F.lit("new"))), WORDS, *tables)
    assert spark.read.parquet(tables[0]).count() == 4


def test_every_request_is_stored_or_refused_once(spark, tables):
    rows = [("a", "one"), ("a", "one"), ("a", "two"), ("a", "  "), ("b", "one"), (None, "x"), (None, "y"), (None, "y"), (None, "")]
    requests = spark.createDataFrame([(i, c, "{}") for i, c in rows], "request_id string, content string, metadata string").repartition(3)
    for _ in range(2):
        index_documents(requests, WORDS, *tables)
        stored = spark.read.parquet(tables[0])
        refused = spark.read.parquet(tables[1])
        assert stored.count() + refused.count() == len(set(rows))
        assert stored.select("id").distinct().count() == stored.count()
        assert sorted(r.content for r in stored.collect()) + sorted(r.error_field for r in refused.collect()) in (
            ["one", "one", "x", "y", "content", "request_id", "request_id"],
            ["one", "x", "y", "content", "content", "request_id", "request_id"],
        )


def test_requests_that_differ_from_stored_ones_are_refused_in_later_batches(spark, tables):
    first = [("a", "one"), ("b", " two "), ("c", "three"), ("d", " ")]
    later = [("a", "one"), ("b", "two"), ("c", "other"), ("c", "another"), ("c", "three"), ("c", ""), ("d", "now good"), ("e", "five"), ("e", "six")]
    frame = lambda rows: spark.createDataFrame([(i, c, "{}") for i, c in rows], "request_id string, content string, metadata string")
    index_documents(frame(first), WORDS, *tables)
    for _ in range(2):
        index_documents(frame(later), WORDS, *tables)
        assert sorted(r.content for r in spark.read.parquet(tables[0]).collect()) == ["five", "now good", "one", "three", "two"]
        refused = sorted((r.request_id, r.error_message) for r in spark.read.parquet(tables[1]).collect())
        assert refused == [("c", "content cannot be empty"), ("c", STORED_ID), ("c", STORED_ID), ("d", "content cannot be empty"), ("e", REPEATED_ID)]


@pytest.mark.parametrize("step", ["corpus", "corpus log", "quarantine", "commit"])
def test_a_run_that_is_cut_off_is_finished_by_the_next(spark, tables, monkeypatch, step):
    """Whatever was done last, each request ends up in one of the tables once."""
    requests = bodies(spark, *[{"content": f"text {i}"} for i in range(20)], "nope")
    put, add, commit, calls = ingest._put, KeyLog.add, KeyLog.commit, []

    def stop(*a, **k):
        raise RuntimeError("lost")

    def counted(log, batch, rows, table, *rest, **k):
        calls.append(table)
        if step == "corpus" and len(calls) == 1:
            rows.filter("abs(hash(id)) % 2 = 0").select(*rest[0]).write.mode("append").parquet(table)
            stop()
        if step == "quarantine" and len(calls) == 2:
            stop()
        put(log, batch, rows, table, *rest, **k)

    monkeypatch.setattr(ingest, "_put", counted)
    if step == "corpus log":
        monkeypatch.setattr(KeyLog, "add", stop)
    if step == "commit":
        monkeypatch.setattr(KeyLog, "commit", stop)
    with pytest.raises(RuntimeError):
        index_documents(requests, WORDS, *tables)
    monkeypatch.setattr(ingest, "_put", put)
    monkeypatch.setattr(KeyLog, "add", add)
    monkeypatch.setattr(KeyLog, "commit", commit)
    for again in (bodies(spark, {"content": "text 0"}), requests):
        index_documents(again, WORDS, *tables)
        stored = spark.read.parquet(tables[0])
        assert stored.count() == stored.select("id").distinct().count() == 20
        assert spark.read.parquet(tables[1]).count() == 1


def test_only_folders_of_the_batch_are_looked_into(spark, tables):
    index_documents(bodies(spark, *[{"content": f"text {i}"} for i in range(300)]), WORDS, *tables)
    log = KeyLog(spark, tables[0])
    ids = spark.read.parquet(tables[0]).select("id").limit(1)
    assert log.known(ids).count() == 1
    found = log.entries().join(F.broadcast(ids), "id", "left_semi").filter(F.col("prefix").isin([ids.first()[0][:2]]))
    assert "PartitionFilters: [isnotnull(prefix" in found._jdf.queryExecution().toString()
    assert log.entries().select("prefix").distinct().count() > 100 and found.count() == 1


def test_generations_keep_all_entries(spark, tables, monkeypatch):
    monkeypatch.setattr(key_log, "BATCHES", 2)
    for n in range(3):
        index_documents(bodies(spark, *[{"content": f"text {n} {i}"} for i in range(5)]).withColumn("request_id", F.concat_ws("-", F.lit(n), "request_id")), WORDS, *tables)
    log = KeyLog(spark, tables[0])
    assert log.generation[0] >= 1 and log.entries().count() == 15
    index_documents(bodies(spark, {"content": "other"}).withColumn("request_id", F.lit("0-r0")), WORDS, *tables)
    assert spark.read.parquet(tables[0]).count() == 15 and spark.read.parquet(tables[1]).count() == 1


def test_a_table_without_a_log_gets_one(spark, tables):
    other = run_folder(spark, "old")
    index_documents(bodies(spark, {"content": "a"}, {"content": "b"}), WORDS, f"{other}/corpus", tables[1])
    spark.read.parquet(f"{other}/corpus").write.parquet(tables[0])
    index_documents(bodies(spark, {"content": "a"}, {"content": "changed"}, {"content": "c"}), WORDS, *tables)
    assert sorted(r.content for r in spark.read.parquet(tables[0]).collect()) == ["a", "b", "c"]
    assert [r.error_message for r in spark.read.parquet(tables[1]).collect()] == [STORED_ID]


def test_a_failing_model_stores_nothing_for_its_texts(spark, tables):
    def load():
        def embed(texts, task):
            if any("bad" in t for t in texts):
                raise RuntimeError("502")
            return [[1.0, 2.0] for _ in texts]

        return embed

    model = ModelEmbedder(load, dims=2)
    index_documents(bodies(spark, {"content": "good"}, {"content": "bad"}), model, *tables)
    assert [r.content for r in spark.read.parquet(tables[0]).collect()] == ["good"]
    bad = spark.read.parquet(tables[1]).first()
    assert (bad.content, bad.error_code, bad.error_cause) == ("bad", "EXTERNAL_SERVICE_ERROR", "502")
    # The refused text is tried again later: its id is not stored.
    index_documents(bodies(spark, {"content": "good"}, {"content": "bad"}), HashingEmbedder(2), *tables)
    assert spark.read.parquet(tables[0]).count() == 2


def test_search_finds_a_documents_own_text_first(spark, sf, tables):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("request_id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("metadata")
    )
    index_documents(docs, WORDS, *tables)
    corpus = spark.read.parquet(tables[0])
    asked = corpus.select(F.col("id").alias("query_id"), F.col("content").alias("query"), F.lit(1).alias("limit"), F.lit(None).cast("double").alias("threshold"))
    out = semantic_search(asked, corpus, WORDS)
    first = out.ranked.join(corpus.select("id", "content"), "id").join(asked, "query_id")
    assert first.count() == corpus.count()
    assert first.filter(F.abs(F.col("similarity") - 1) > 1e-9).count() == 0
    assert first.filter(F.col("content") == F.col("query")).count() > 0.95 * corpus.count()


def test_stored_rows_and_results_have_the_declared_columns(spark, tables):
    index_documents(bodies(spark, {"content": "a b"}, {"content": "c d"}), WORDS, *tables)
    corpus = spark.read.parquet(tables[0])
    assert dict(corpus.dtypes) == {f.name: f.dataType.simpleString() for f in DOCUMENT}
    found = topk_search(corpus, corpus.first()["embedding"])
    assert dict(found.dtypes) == {f.name: f.dataType.simpleString() for f in SEARCH_RESULT}


def test_search_answers_and_refusals(spark, tables):
    index_documents(bodies(spark, {"content": "brown fox"}, {"content": "lazy dog"}, {"content": "brown dog"}), WORDS, *tables)
    corpus = spark.read.parquet(tables[0])
    asked = bodies(spark, {"query": " brown fox ", "limit": 2}, {"query": "zebra", "threshold": 0.9}, {"query": "x", "limit": 0}, {"query": "!"})
    out = semantic_search(asked.withColumnRenamed("request_id", "query_id"), corpus, WORDS)
    answers = {r.query_id: r for r in out.envelope(corpus).collect()}
    assert set(answers) == {"r0", "r1"}
    assert answers["r0"].query == " brown fox " and answers["r0"]["count"] == 2
    assert [x.content for x in answers["r0"].results] == ["brown fox", "brown dog"]
    assert answers["r0"].results[0].similarity == pytest.approx(1.0)
    assert answers["r1"]["count"] == 0 and answers["r1"].results == []
    refused = {r.query_id: r.error_code for r in out.quarantine.collect()}
    assert refused == {"r2": "VALIDATION_ERROR", "r3": "EXTERNAL_SERVICE_ERROR"}


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_bytes": 1 << 12}])
def test_requests_with_one_query_id_are_answered_apart(spark, tables, sizes):
    index_documents(bodies(spark, {"content": "red apple"}, {"content": "blue plum"}, {"content": "green pear"}), WORDS, *tables)
    corpus = spark.read.parquet(tables[0])
    asked = spark.createDataFrame(
        [("q", "red apple", 1, None), ("q", "blue plum", 2, None), (None, "green pear", 1, None), (None, "red", 1, None)],
        "query_id string, query string, limit int, threshold double",
    )
    out = semantic_search(asked, corpus, WORDS, **sizes)
    answers = {(r.query_id, r.query): [x.content for x in r.results] for r in out.envelope(corpus).collect()}
    assert answers[("q", "red apple")] == ["red apple"] and answers[(None, "green pear")] == ["green pear"]
    assert answers[("q", "blue plum")][0] == "blue plum" and len(answers[("q", "blue plum")]) == 2
    assert answers[(None, "red")] == ["red apple"]
    assert out.ranked.columns == ["query_id", "rank", "id", "similarity"] and out.ranked.count() == 5


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_stream_ingest_equals_batch_and_replay_adds_nothing(spark, tables, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        lines = [json.dumps({"content": f"text {n} {i % 4}"}) for i in range(10)] + ["nope"]
        (source / f"{n}.json").write_text("\n".join(lines) + "\n")
    requests = stream_bodies(spark, str(source), files_per_batch=1)
    run(stream_ingest(requests, WORDS, *tables, str(tmp_path / "checkpoint")))
    stored = spark.read.parquet(tables[0])
    assert stored.count() == 30
    assert spark.read.parquet(tables[1]).count() == 3
    # A lost checkpoint replays everything.
    run(stream_ingest(requests, WORDS, *tables, str(tmp_path / "fresh")))
    assert spark.read.parquet(tables[0]).count() == 30
    assert spark.read.parquet(tables[1]).count() == 3
    other = run_folder(spark, "batch")
    index_documents(read_bodies(spark, str(source)), WORDS, f"{other}/corpus", f"{other}/refused")
    batch = spark.read.parquet(f"{other}/corpus")
    assert sorted(batch.select("id", "content").collect()) == sorted(stored.select("id", "content").collect())


def test_stream_search_equals_batch(spark, tables, tmp_path):
    index_documents(bodies(spark, *[{"content": f"word{i} word{i % 5}"} for i in range(40)]), WORDS, *tables)
    source = str(tmp_path / "asked")
    asked = bodies(spark, *[{"query": f"word{i}", "limit": 3} for i in range(12)], "nope").repartition(4)
    asked.write.parquet(source)
    stream = spark.readStream.schema("request_id string, body string").option("maxFilesPerTrigger", 1).parquet(source)
    stream = bodies_table(stream, "request_id", "body").withColumnRenamed("request_id", "query_id")
    run(stream_search(stream, tables[0], WORDS, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    got = spark.read.parquet(str(tmp_path / "out/ranked")).drop("batch")
    want = semantic_search(asked.withColumnRenamed("request_id", "query_id"), read_corpus(spark, tables[0]), WORDS).ranked
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 1


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "time timestamp, method string, path string, statusCode int, latencyMs double")


def test_stream_metrics_equal_batch_until_lines_are_late(spark, tmp_path):
    from datetime import datetime

    def rows(hour, n, status=200):
        return [(datetime(2026, 1, 1, hour, m), "POST", "/search", status, float(m)) for m in range(n)]

    source = str(tmp_path / "logs")
    parts = [rows(1, 10), rows(1, 20, 500) + rows(2, 5), rows(8, 3), rows(1, 4)]
    seen = None
    for i, part in enumerate(parts):
        df = log_rows(spark, part).coalesce(1)
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        run(stream_request_metrics(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
        seen = log_rows(spark, sum(parts[: min(i + 1, 3)], []))
    got = latest_metrics(spark.read.parquet(str(tmp_path / "out")))
    want = request_metrics(seen).select(F.col("window.start").alias("window_start"), "method", "path", "requests", "errors", "max_ms", "p95_ms")
    # The last part comes more than the allowed delay after the hour it belongs to.
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
