from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vecspark import session
from vecspark.sources.bodies import read_bodies
from vecspark.sources.corpus import (
    MIGRATIONS,
    AddColumn,
    Backfill,
    RequireNotNull,
    corpus_append,
    corpus_scan,
    new_rows,
    not_null_violations,
    one_per_key,
    read_corpus,
    schema_evolve,
)
from vecspark.operators.inspection import DISTINCT_ERROR, column_sketches, corpus_columns, corpus_count, corpus_health, merged_profile
from vecspark.schema import DOCUMENT
from vecspark.session import run_folder
from vecspark.sources.table_log import NotNullViolation, VersionedTable


def staged(spark, *ids):
    return spark.createDataFrame([(i, f"text {i}", [1.0]) for i in ids], "id string, content string, embedding array<float>")


def test_append_keeps_keys_unique_and_returns_rows_without_vectors(spark):
    path = run_folder(spark, "append")
    first = corpus_append(staged(spark, "a", "b"), path)
    assert first.columns == ["id", "content"] and first.count() == 2
    again = corpus_append(staged(spark, "b", "c", "c"), path)
    assert [r.id for r in again.collect()] == ["c"]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("broadcast_keys", [0, 1000])
def test_new_rows_both_ways(spark, broadcast_keys):
    stored = staged(spark, "a", "b", "b")
    got = new_rows(staged(spark, "b", "c", "d", "d", "d"), stored, broadcast_keys=broadcast_keys)
    assert sorted(r.id for r in got.collect()) == ["c", "d"]


def test_one_per_key_is_the_same_row_every_time(spark):
    df = spark.createDataFrame([("k", i) for i in range(500)] + [("l", 7)], "id string, n int").repartition(7)
    assert sorted(map(tuple, one_per_key(df).collect())) == [("k", 0), ("l", 7)]


def test_missing_table_is_empty(spark):
    empty = read_corpus(spark, run_folder(spark, "none"))
    assert empty.schema == DOCUMENT and empty.count() == 0
    assert [r.n for r in corpus_count(empty).collect()] == [0]


def test_scan_reads_only_its_columns(spark, sf):
    df = corpus_scan(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "lang"])
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in df._jdf.queryExecution().toString()


def test_migrations(spark):
    old = spark.createDataFrame([("a", None), ("b", '{"x":1}')], "id string, metadata string")
    for df in (old, old.select("id"), schema_evolve(old)):
        new = schema_evolve(df, MIGRATIONS)
        assert new.columns == ["id", "metadata", "test_field"]
        assert new.orderBy("id").first().metadata == "{}"
    assert schema_evolve(old).orderBy("id").collect()[1].metadata == '{"x":1}'
    assert not_null_violations(old, ["id", "metadata"]).first() == (0, 1)
    with pytest.raises(Exception, match="metadata contains null"):
        schema_evolve(old, [RequireNotNull("metadata")]).collect()


def test_equal_lines_are_separate_requests(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"content":"x"}\n' * 5)
    (tmp_path / "b.json").write_text('{"content":"x"}\n' * 3)
    first = read_bodies(spark, str(tmp_path))
    assert first.select("request_id").distinct().count() == 8
    assert sorted(first.collect()) == sorted(read_bodies(spark, str(tmp_path)).collect())


def test_health_and_columns(spark):
    rows = [("ok", [1.0, 0.0]), (" 　", [0.0, 0.0]), (None, [1.0]), ("x", None)]
    df = spark.createDataFrame(rows, "content string, embedding array<float>").withColumn("created_at", F.expr("timestamp_ntz'2026-01-01'"))
    r = corpus_health(df, 2).first()
    assert (r.documents, r.null_content, r.blank_content, r.wrong_dims, r.zero_vectors) == (4, 1, 1, 2, 1)
    assert r.oldest == r.newest
    columns = [tuple(x) for x in corpus_columns(df.limit(0)).collect()]
    assert columns[1][:3] == (2, "embedding", "array<float>") and len(columns) == 3


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_task_functions_carry_their_code(tmp_path):
    """An executor has no copy of this package."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from vecspark.functions.vector import row_dots
    from vecspark.operators.batch_search import RequestBlock, TopK
    from vecspark.operators.embed import _bucket_sums, _embed_batch
    from vecspark.sources.bodies import _number_lines

    (tmp_path / "code").write_bytes(cloudpickle.dumps([row_dots, RequestBlock, TopK, _bucket_sums, _embed_batch, _number_lines]))
    check = "import pickle, sys; pickle.load(open('code', 'rb')); assert not any(m.startswith('vecspark') for m in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path, env=env, check=True)


def test_profile_of_parts_equals_that_of_the_whole(spark):
    rows = [(i, None if i % 4 == 0 else f"t{i % 50}", [1.0, float(i % 3)], i % 2 == 0, float(i) / 7, datetime(2024, 1, 1 + i % 28)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, t string, v array<double>, b boolean, x double, at timestamp_ntz")
    whole = merged_profile(column_sketches(df))
    parts = merged_profile(column_sketches(df, F.col("id") % 11))
    assert sorted(map(tuple, whole.drop("n_distinct").collect())) == sorted(map(tuple, parts.drop("n_distinct").collect()))
    got = {r.column_name: r for r in parts.collect()}
    assert [(got[c].n_rows, got[c].nulls) for c in ("id", "t", "v")] == [(900, 0), (900, 225), (900, 0)]
    assert (got["id"].low, got["id"].high, got["t"].low, got["t"].high) == ("0", "899", "t0", "t9") and got["v"].low is None
    want = {"id": 900, "t": 50, "v": 3, "b": 2, "at": 28}
    assert all(abs(got[c].n_distinct - n) <= n * DISTINCT_ERROR for c, n in want.items())
    assert merged_profile(column_sketches(df.limit(0))).count() == 0


def test_versions_of_a_table(spark):
    table = VersionedTable(spark, run_folder(spark, "versions"))
    with pytest.raises(ValueError, match="nothing"):
        table.read()
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert table.append(frame([(1, "a")], "id int, t string")) == 1
    assert table.append(frame([(2, "b")], "id int, t string")) == 2
    with pytest.raises(ValueError, match="no columns m"):
        table.append(frame([(3, "c", "m")], "id int, t string, m string"))
    assert table.evolve(AddColumn("m", "string")) == 3
    assert table.append(frame([(3, "m3")], "id int, m string")) == 4
    with pytest.raises(NotNullViolation, match="column m contains 2 null"):
        table.evolve(RequireNotNull("m"))
    assert table.evolve(Backfill("m", "{}"), RequireNotNull("m")) == 6
    with pytest.raises(NotNullViolation):
        table.append(frame([(4, "d")], "id int, t string"))
    assert table.append(frame([(4, "m4")], "id int, m string")) == 7
    rows = lambda v: sorted(tuple(r) for r in table.read(v).collect())
    assert rows(1) == [(1, "a")] and rows(2) == [(1, "a"), (2, "b")]
    assert rows(4) == [(1, "a", None), (2, "b", None), (3, None, "m3")]
    assert rows(None) == [(1, "a", "{}"), (2, "b", "{}"), (3, None, "m3"), (4, None, "m4")]
    assert VersionedTable(spark, table.path).version() == 7
    # Appends without a step between them are one scan.
    for i in range(4):
        table.append(frame([(10 + i, "x")], "id int, m string"))
    assert table.read()._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan") == 3
