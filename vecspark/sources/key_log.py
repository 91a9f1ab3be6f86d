"""Which requests a table has taken: a log of their ids and what they said, in folders by id prefix.

    <table>-keys/entries/generation=<g>/prefix=<p>   id, said, batch
    <table>-keys/generations                         generation: the last one counts
    <table>-keys/intents                             batch, staging: written before a batch adds anything
    <table>-keys/commits                             batch: written when all of it is there

A batch looks only into the folders of its own ids' prefixes, which it finds by name, and reads
ids and digests there, never the table. A batch that was cut off is found by its intent without
a commit; the next one first adds what is missing of it. So every accepted row is in the table
once, whenever a job ends. Each batch adds a file to some folders; when as many entries have
come as there were, a new generation has one sorted file in each. One writer at a time is
assumed, as for any append under a key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecspark.session import run_folder

PREFIX = 2  # hexadecimal digits: 256 folders
KEY_BYTES = 64 << 20  # ids of a batch are sent to the log's scan up to this measured size
BATCHES = 64  # that a generation takes at least before there is a new one
ENTRY = "id string, said string, batch string, prefix string"
GENERATION = "generation int, rows long, batches long"


def stored(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A table of this schema, or an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def prefix_of(id: Column) -> Column:
    """Of a UUID its first digits, of any other id as many digits of a digest."""
    digits = F.substring(id, 1, PREFIX)
    return F.when(id.rlike(f"^[0-9a-f]{{{PREFIX}}}"), digits).otherwise(F.substring(F.md5(id), 1, PREFIX))


@dataclass
class KeyLog:
    spark: SparkSession
    table: str

    @property
    def path(self) -> str:
        return f"{self.table.rstrip('/')}-keys"

    @cached_property
    def generation(self) -> tuple[int, int, int]:
        """(number, entries it began with, batches before it), as this log was opened."""
        rows = stored(self.spark, GENERATION, f"{self.path}/generations").orderBy(F.desc("generation")).limit(1).collect()
        return tuple(rows[0]) if rows else (0, 0, 0)

    def entries(self) -> DataFrame:
        return stored(self.spark, ENTRY, f"{self.path}/entries/generation={self.generation[0]}")

    def exists(self) -> bool:
        try:
            self.spark.read.schema("batch string").parquet(f"{self.path}/intents")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def compact(self) -> None:
        """Begin a generation if as many entries have been added as the last one began with, over at least ``BATCHES`` batches."""
        number, rows, before = self.generation
        batches = stored(self.spark, "batch string", f"{self.path}/commits").count()
        if batches - before < BATCHES:
            return
        entries = self.entries()
        n = entries.count()
        if n >= 2 * rows:
            self._write(entries, number + 1, "overwrite")
            self._row(generation=number + 1, rows=n, batches=batches).select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(GENERATION)]).write.mode("append").parquet(f"{self.path}/generations")

    def _row(self, **values) -> DataFrame:
        return self.spark.range(0, 1, 1, 1).select(*[F.lit(v).alias(k) for k, v in values.items()])

    def _write(self, entries: DataFrame, generation: int, mode: str) -> None:
        entries = entries.repartition("prefix").sortWithinPartitions("prefix", "id")
        entries.write.mode(mode).partitionBy("prefix").parquet(f"{self.path}/entries/generation={generation}")

    def known(self, ids: DataFrame) -> DataFrame:
        """(id, said) of those ids that the log has, written once: as many rows as there are ids at most."""
        keys = ids.filter(F.col("id").isNotNull()).select("id").distinct()
        size = keys.agg(F.sum(F.octet_length("id") + 16).alias("bytes"), F.collect_set(prefix_of(F.col("id"))).alias("prefixes")).first()
        found = self.entries().filter(F.col("prefix").isin(size["prefixes"])).select("id", "said")
        keys = F.broadcast(keys) if (size["bytes"] or 0) <= KEY_BYTES else keys
        folder = run_folder(self.spark, "known")
        found.join(keys, "id", "left_semi").groupBy("id").agg(F.min("said").alias("said")).write.parquet(folder)
        return self.spark.read.schema("id string, said string").parquet(folder)

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose id the log does not have."""
        return rows.join(broadcast_if_small(self.known(rows.select("id")).select("id")), "id", "left_anti")

    def begin(self, staging: str) -> str:
        """Note that the rows in this folder are going to be added."""
        batch = uuid.uuid4().hex
        self._row(batch=batch, staging=staging).write.mode("append").parquet(f"{self.path}/intents")
        return batch

    def add(self, batch: str, said: DataFrame) -> None:
        """Enter (id, said) rows."""
        rows = said.select("id", "said", F.lit(batch).alias("batch"), prefix_of(F.col("id")).alias("prefix"))
        self._write(rows, self.generation[0], "append")

    def commit(self, batch: str) -> None:
        self._row(batch=batch).write.mode("append").parquet(f"{self.path}/commits")

    def unfinished(self) -> list[tuple[str, str]]:
        """(batch, staging) of batches that were cut off: one at most, unless writers ran side by side."""
        done = stored(self.spark, "batch string", f"{self.path}/commits")
        begun = stored(self.spark, "batch string, staging string", f"{self.path}/intents")
        return [tuple(r) for r in begun.join(done, "batch", "left_anti").collect()]


def broadcast_if_small(keys: DataFrame, row_bytes: int = 80, rows: int | None = None) -> DataFrame:
    return F.broadcast(keys) if (keys.count() if rows is None else rows) * row_bytes <= KEY_BYTES else keys
