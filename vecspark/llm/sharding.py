"""Shards by fixed virtual slots: records hash into slots, slots are mapped to shards by their bytes.

The slot of a record never changes. What changes is the map from slots to shards, a small
table with a version. Rebalancing edits the map: only slots that leave an overfull shard, or
that fill a new one, get another shard.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vecspark.llm.common import written
from vecspark.llm.register import query
from vecspark.session import run_folder

SLOTS = 4096  # a slot is the least that moves; its share of the bytes bounds the imbalance
SHARDS = 16
MAP = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("version", T.IntegerType())])


def assign(sizes: list[int], shards: int) -> list[int]:
    """A first map: the largest slot that is left goes to the shard with the fewest bytes."""
    out = [0] * len(sizes)
    heap = [(0, s) for s in range(shards)]
    for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + sizes[slot], shard))
    return out


def rebalance(sizes: list[int], shard_of: list[int], shards: int) -> list[int]:
    """Edit a map for new sizes or more shards, moving few slots.

    As long as it evens them out, a slot goes from the fullest shard to the emptiest: the
    largest slot below their difference. Slots that fit where they are stay there.
    """
    out, held = list(shard_of), [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        held[shard] += sizes[slot]
        own[shard].append(slot)
    while True:
        full, empty = max(range(shards), key=lambda s: (held[s], -s)), min(range(shards), key=lambda s: (held[s], s))
        gap = held[full] - held[empty]
        fitting = [i for i in own[full] if 0 < sizes[i] <= gap / 2]
        if not fitting:
            return out
        slot = max(fitting, key=lambda i: (sizes[i], -i))
        own[full].remove(slot)
        own[empty].append(slot)
        held[full] -= sizes[slot]
        held[empty] += sizes[slot]
        out[slot] = empty


def save_map(spark: SparkSession, folder: str, shard_of: list[int]) -> int:
    """Store a map as the next version under the folder; earlier versions stay readable."""
    try:
        version = spark.read.schema(MAP).parquet(folder).agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        version = 0
    rows = [(slot, shard, version + 1) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(folder)
    return version + 1


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    maps = spark.read.schema(MAP).parquet(folder)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def records(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: its size, the CRC of its text and its virtual slot.

    Id and text are hashed, so that NULL or repeated ids of different texts spread over all
    slots. Rows that repeat both are one record to this operator and share a slot.
    """
    body = F.coalesce(text, F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(doc_id, body), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot: always ``slots`` numbers, summed in each task first."""
    sizes, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect():
        sizes[r["virtual_slot"]], counts[r["virtual_slot"]] = r["bytes"], r["rows"]
    return sizes, counts


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_folder: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) of every row.

    The law is ``bytes``: shards hold nearly equal sizes. If the folder holds a map, it is
    edited, else a first map is made; either is stored as a new version. ``slot`` is the place
    in the shard, from 0 without gaps: slots of a shard follow each other, and rows within a
    slot are ordered by id, size and CRC. Texts are read once and not shuffled.

    NULL texts count as empty (size 1, CRC 0). NULL ids come first within a slot. Repeated
    rows each get a place of their own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = map_folder or run_folder(spark, "slot-map")
    rows = written(records(docs, slots), "shard-records")
    sizes, counts = slot_sizes(rows, slots)
    try:
        old = {r["virtual_slot"]: r["shard"] for r in load_map(spark, folder).collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = {}
    shard_of = rebalance(sizes, [min(old[i], shards - 1) for i in range(slots)], shards) if len(old) == slots else assign(sizes, shards)
    version = save_map(spark, folder, shard_of)
    before, base = [0] * shards, []
    for slot, shard in enumerate(shard_of):
        base.append(before[shard])
        before[shard] += counts[slot]
    table = spark.createDataFrame([(i, shard_of[i], base[i]) for i in range(slots)], "virtual_slot int, shard int, base long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")) - 1
    placed = rows.withColumn("place", place).join(F.broadcast(table), "virtual_slot")  # a row per slot, whatever the data
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
    )


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
