"""Structured request logs: JSON lines with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from vecspark.schema import REQUEST_LOG

# Numeric log levels and their names.
LEVELS = {"10": "trace", "20": "debug", "30": "info", "40": "warn", "50": "error", "60": "fatal"}


def _named_levels(df: DataFrame) -> DataFrame:
    level = F.col("level")
    for number, name in LEVELS.items():
        level = F.when(F.col("level") == number, F.lit(name)).otherwise(level)
    return df.withColumn("level", level)


CORRUPT = "_corrupt_record"
WITH_CORRUPT = T.StructType([*REQUEST_LOG.fields, T.StructField(CORRUPT, T.StringType(), True)])


def _all_lines(reader, path: str) -> DataFrame:
    """Every line that is not empty: its fields, or, of one that is no JSON object of these types, its text, and where it is from.

    Lines are parsed as a whole whatever columns are used: a reader of JSON files would look at
    those only, and which lines are corrupt would depend on the query.
    """
    lines = reader.text(path).filter(F.length("value") > 0)
    fields = F.from_json("value", WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start")]
    return _named_levels(lines.select(fields.alias("_line"), *where).select("_line.*", "file", "block_start"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the logs, the corrupt ones too; see ``parsed_lines`` and ``corrupt_lines``."""
    return _all_lines(spark.read, path)


def parsed_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col(CORRUPT).isNull()).select(*REQUEST_LOG.fieldNames())


def corrupt_lines(lines: DataFrame) -> DataFrame:
    """(line, requestId, file, block_start) of lines that could not be parsed: text, id if it was seen, file and start of the part of it they were read in."""
    return lines.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), "requestId", "file", "block_start")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The lines that can be parsed."""
    return parsed_lines(read_log_lines(spark, path))


def stream_log_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return _all_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch), path)


def stream_logs(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return parsed_lines(stream_log_lines(spark, path, files_per_batch))


def stream_split_logs(lines: DataFrame, table: str, quarantine: str, checkpoint: str) -> DataStreamWriter:
    """Write the parsed lines of each batch to one table and the corrupt ones to another, in a folder per batch that a rerun replaces."""

    def split(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # so that the text is parsed once
        parsed_lines(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        corrupt_lines(batch).write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        batch.unpersist()

    return lines.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
