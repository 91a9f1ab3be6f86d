"""What the operators of this folder share: tables in the shared folder, row helpers, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.session import run_folder

BLANKS = " \t\n\x0b\x0c\r"  # the characters that part words: 0x20 and 0x09 to 0x0D
BROADCAST_BYTES = 64 << 20  # a side is broadcast only up to this measured size


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the folder all executors share: computed once, lineage cut."""
    folder = run_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(rows: DataFrame, group: str, order: list[Column], tasks: int, name: str, place: str = "pos") -> DataFrame:
    """The rows with ``place``, their place from 0 within the group, which leads the order and is never NULL.

    Rows are ranged over tasks and counted per task and group; only these counts are summed up,
    so a group of any size is spread over many tasks. The order is written once: rows that are
    equal in it keep the places they got.
    """
    keys = [c for c in rows.columns if c != group]
    at, part = fresh(rows, "at"), fresh(rows, "part")
    placed = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = written(placed.withColumn(part, F.shiftright(at, 33)), name)
    counts = placed.groupBy(group, part).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = written(counts.select(group, part, (upto - F.col("n") - F.col("first")).alias("shift")), f"{name}-counts")
    counts = F.broadcast(counts) if counts.count() * 48 <= BROADCAST_BYTES else counts
    return placed.join(counts, [group, part]).select(group, (F.col(at) + F.col("shift")).alias(place), *keys)


def keys_join(df: DataFrame, keys: DataFrame, on: str, how: str, row_bytes: int = 32) -> DataFrame:
    """A join with a table of keys, which is broadcast only if its counted rows are few."""
    if keys.count() * row_bytes <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    return df.join(keys, on, how)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; the sizes of tasks follow from it."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def tasks_for(spark: SparkSession, amount: float, per_task: float) -> int:
    """Enough tasks for the amount, and no fewer than the session's shuffle tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(amount // per_task) + 1)


def row_batches(batches: Iterator[pa.RecordBatch], text: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``limit`` bytes at most, one row at least."""
    for b in batches:
        sizes = np.diff(np.frombuffer(b.column(text).cast(pa.large_binary()).buffers()[1], dtype=np.int64)[b.column(text).offset :][: b.num_rows + 1])
        ends, start, held = [], 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                ends.append((start, i))
                start, held = i, 0
            held += n + 1
        if start < b.num_rows:
            ends.append((start, b.num_rows))
        for s, e in ends:
            yield b.slice(s, e - s)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finaliser of a public 64-bit mixer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes: planes that are all zero vanish under compression."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is the least node reachable.

    Rounds of hooking and pointer jumping. Each node looks at the least root around it, then
    at its root's root, so that long chains end after few rounds. Neighbour minima are taken
    before each shuffle, so a node with very many edges does not fill one task. Each round is
    written to the shared folder; a lost executor does not repeat earlier rounds.
    """
    both = edges.select("a", "b").where("a <> b")
    both = written(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), name)
    while True:
        # The least root among the neighbours, offered to the node and to its present root.
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("near")), "b")
        seen = seen.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")).join(labels, "node")
        offers = seen.where("near < root").select(F.col("root").alias("node"), "near").unionAll(seen.select("node", "near"))
        offers = offers.groupBy("node").agg(F.min("near").alias("near"))
        hooked = labels.join(offers, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hooked = written(hooked, name)
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = hooked.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root"))
        after = written(after, name)
        if after.where("root <> old").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")


def per_batch(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def blank_split(c: Column) -> Column:
    """Words of a text, without UDFs: an empty array for NULL, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
