"""The corpus pipeline: five stages, each an operator of ``vecspark.llm`` at work on all its predecessor kept.

``STAGES`` holds (name, function) pairs; a function takes (spark, docs, sf_dir). All but the
last return the columns of ``documents``. ``run`` applies them one after the other; what a
stage returns is written to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from vecspark.llm.common import written

STAGES = [
    ("toxicity", toxicity.stage),  # documents predicted toxic go
    ("ngram_jaccard_join", ngram_join.stage),  # one document of each group of near copies stays
    ("suffix_dedup", suffix_dedup.stage),  # passages that an earlier document has go
    ("mixing", mixing.stage),  # documents are taken as often as the target weights of sources ask
    ("byte_bpe", bpe.stage),  # token counts and digests
]

ORACLE_SQL = None  # the votes of nearest examples are not a thing for SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
