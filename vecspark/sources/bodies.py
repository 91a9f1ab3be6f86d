"""JSON request bodies from files, one per line, in batch or as a stream."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name each line by its file split and its position there."""
    seen: Counter[str] = Counter()
    for b in batches:
        splits = b.column(0).dictionary_encode()
        which, position = splits.indices.to_numpy(), np.zeros(b.num_rows, dtype=np.int64)
        for i, name in enumerate(splits.dictionary.to_pylist()):
            own = np.flatnonzero(which == i)
            position[own] = seen[name] + np.arange(len(own))
            seen[name] += len(own)
        names = pc.binary_join_element_wise(b.column(0), pa.array(position).cast(pa.string()), "#")
        yield pa.RecordBatch.from_arrays([names, b.column(1)], ["request_id", "body"])


def _requests(lines: DataFrame) -> DataFrame:
    # Equal bodies are separate requests, so the position is part of the id. A replayed
    # stream batch reads the same files in the same splits and gives the same ids.
    split = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    return lines.select(split.alias("split"), "value").mapInArrow(_number_lines, "request_id string, body string")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    return _requests(spark.read.text(path))


def stream_bodies(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return _requests(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def bodies_table(df: DataFrame, request_id: str, body: str) -> DataFrame:
    """A table or stream that already has ids, such as Kafka records with their keys."""
    return df.select(F.col(request_id).cast("string").alias("request_id"), F.col(body).cast("string").alias("body"))
