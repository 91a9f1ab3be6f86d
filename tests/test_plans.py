"""What the plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from vecspark.operators.search import recent_documents, threshold_filter, topk_positions, topk_search, with_similarity
from vecspark.plans import views

ALL_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "name", ["topk_search", "batch_topk", "search_envelope", "new_rows", "latency_p95", "correlation_lifecycle", "schema_evolve", "recent_documents"]
)
def test_no_all_pairs_joins(spark, sf, name):
    text = plan(contract.queries()[name](spark, sf))
    assert not any(j in text for j in ALL_PAIRS)


def test_single_search_ranks_ids_and_vectors_only(spark, sf):
    e = views.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    text = plan(topk_positions(e, views.first_vector(spark, sf)))
    assert "TakeOrderedAndProject" in text
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text


def test_results_are_fetched_from_their_files_only(spark, tmp_path):
    """Forty files of texts: one search reads those its results are in, by id."""
    path = str(tmp_path / "corpus")
    rows = spark.range(4000).select("id", F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), 50)).alias("content"), F.array(*[(F.col("id") % m).cast("float") for m in (7, 11, 13, 4001)]).alias("embedding"))
    rows.repartitionByRange(40, "id").write.parquet(path)
    corpus = spark.read.parquet(path)
    found = topk_search(corpus, [1.0, 2.0, 3.0, 500.0], limit=3)
    text = plan(found)
    assert "In(id, [" in text and "ReadSchema: struct<id:bigint,content:string>" in text
    want = topk_positions(corpus, [1.0, 2.0, 3.0, 500.0], limit=3).collect()
    got = found.collect()
    assert [r.id for r in got] == [r.id for r in want] and all(r.content.startswith("text ") for r in got)
    assert len({r["_file"] for r in want}) <= 3
    files = corpus.filter(F.col("_metadata.file_path").isin(sorted({r["_file"] for r in want}))).select("content")
    assert files.rdd.getNumPartitions() <= 3 < corpus.select("content").rdd.getNumPartitions()


def test_native_similarity_is_computed_once_per_row(spark, sf):
    searched = plan(topk_search(views.vectors(spark, sf), views.first_vector(spark, sf), 10, 0.2, method="native"))
    # One dot product with the query and one with itself.
    assert searched.split("== Physical Plan ==")[1].count("zip_with") == 2


def test_batch_search_drops_rows_before_each_shuffle(spark, sf):
    text = plan(contract.queries()["batch_topk"](spark, sf))
    assert "WindowGroupLimit" in text and "MapInArrow" in text
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text


def test_listing_skips_old_row_groups(spark, sf, tmp_path):
    path = str(tmp_path / "corpus")
    docs = views.documents(spark, sf)
    docs.repartitionByRange(4, "created_at").write.parquet(path)
    df = recent_documents(spark.read.parquet(path), 5)
    assert df.count() == 5
    text = plan(df)
    assert "Subquery" in text and "ReadSchema: struct<created_at:timestamp_ntz>" in text
    assert "PushedFilters: [IsNotNull(created_at)" in text


def test_a_filter_does_not_compute_the_similarity_again(spark, sf):
    scored = with_similarity(views.vectors(spark, sf), views.first_vector(spark, sf))
    text = plan(threshold_filter(scored, 0.0)).split("== Physical Plan ==")[1]
    assert text.count("ArrowEvalPython") == 1
