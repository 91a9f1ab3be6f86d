"""Session settings the operators rely on, and the shared folder for written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SMALL_BATCH_ROWS = 500_000
ROWS_PER_TASK = 256  # the least a task of a small batch should have


def configure(spark: SparkSession) -> SparkSession:
    """Set the one SQL option that changes results. Safe to call repeatedly."""
    # A repeated key in a JSON body keeps its last value instead of failing the parse.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster's checkpoint setting."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staging"


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root for one run's tables."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """A small batch over all task slots, ahead of a step that is costly per row.

    A small batch often comes in one file and so in one task. A large one has many tasks
    already and is left as it is: a shuffle of all its texts would gain nothing.
    """
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    if rows > SMALL_BATCH_ROWS:
        return df
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(min(slots, 1 + rows // ROWS_PER_TASK), key)
