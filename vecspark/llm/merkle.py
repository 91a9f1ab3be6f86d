"""A Merkle manifest of a dataset that stores only every second level, with proofs made from it.

Each row is a leaf. The leaves of a source stand in the order of their ids, every 16 nodes that
follow each other have one node above them, and the sources' top nodes are joined in the same
way under one root. Of all these levels only every ``STEP``-th is kept (checkpoints). Where a
proof needs a level in between, the nodes of one aligned subtree, at most 16 ** STEP stored
ones, are hashed again in one row, their siblings are put out, and they are dropped.

All work is in DataFrame operations. Rows are shuffled as digests, never as texts, and in groups
of one subtree, so the size of a source does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import BROADCAST_BYTES, numbered, tasks_for, written
from vecspark.llm.register import query
from vecspark.session import run_folder

FAN = 16
BITS = 4  # of a position that one level takes away
STEP = 2  # levels from one stored level to the next
ROWS_PER_TASK = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """``-`` for NULL, else the length in bytes, a colon and the value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def above(digests: Column) -> Column:
    """The nodes one level above the nodes of an aligned part of a level, in hex."""
    starts = F.sequence(F.lit(0), F.ceil(F.size(digests) / FAN).cast("int") - 1)
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(digests, i * FAN + 1, F.lit(FAN)), ""), 256))


def siblings(digests: Column, j: Column) -> Column:
    """The others of the run that place ``j`` (from 0) is in, as text: those left of it and those right of it."""
    start = (j - j % FAN).cast("int")
    left = F.slice(digests, start + 1, (j - start).cast("int"))
    right = F.slice(digests, (j + 2).cast("int"), (F.lit(FAN) - 1 - (j - start)).cast("int"))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves: how often runs of 16 must be joined until one is left."""
    return sum((F.when(n > F.lit(FAN**i), 1).otherwise(0) for i in range(15)), F.lit(0))


def stored_levels(leaves: DataFrame, tallest: int, folder: str) -> list[DataFrame]:
    """Write the checkpoints above (tree, height, pos, digest): a table for each ``STEP`` levels.

    Table i has the nodes ``i * STEP`` levels up, or the top of trees that end below that.
    """
    spark, tables = leaves.sparkSession, [leaves]
    for low in range(0, tallest, STEP):
        parts = subtrees(tables[-1].where(F.col("height") > low), ["digest"])
        digests, top = F.transform("kids", lambda k: k["digest"]), None
        for s in range(STEP):
            digests = above(digests)
            top = digests if top is None else F.when(F.col("height") > low + s, digests).otherwise(top)
        parts = parts.select("tree", "height", "pos", F.element_at(top, 1).alias("digest"))
        parts.write.parquet(f"{folder}/level={low + STEP}")
        tables.append(spark.read.schema(parts.schema).parquet(f"{folder}/level={low + STEP}"))
    return tables


def subtrees(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(tree, height, pos, kids): the nodes below each place ``STEP`` levels up, in order; 256 at most."""
    up = F.shiftright("pos", BITS * STEP).alias("pos")
    kids = F.sort_array(F.collect_list(F.struct("pos", *columns)))
    return nodes.groupBy("tree", "height", up).agg(kids.alias("kids"))


def with_paths(tables: list[DataFrame], tops: DataFrame, columns: list[str]) -> DataFrame:
    """(tree, pos, path, and the columns) of the nodes of the lowest table.

    ``path`` is what stands left and right of the node and of each node above it, upwards, and
    goes on with the path of its tree's top in ``tops`` (tree, path). Missing levels of a subtree
    are made from the stored nodes below them and not kept.
    """
    above_paths: DataFrame | None = None
    for i in reversed(range(len(tables))):
        low, own = i * STEP, columns if i == 0 else []
        ended = tables[i].where(F.col("height") <= low).join(tops, "tree").select("tree", "pos", "path", *own)
        if above_paths is None:
            above_paths = ended
            continue
        parts = subtrees(tables[i].where(F.col("height") > low), list(dict.fromkeys(["digest", *own])))
        parts = parts.withColumn("digests0", F.transform("kids", lambda k: k["digest"]))
        for s in range(1, STEP):
            parts = parts.withColumn(f"digests{s}", above(F.col(f"digests{s - 1}")))
        parts = parts.join(above_paths.withColumnRenamed("path", "upper"), ["tree", "pos"])

        def steps(j: Column, low: int = low) -> Column:
            levels = [(s, siblings(F.col(f"digests{s}"), F.floor(j / FAN**s).cast("int"))) for s in range(STEP)]
            some = [F.when(F.col("height") > low + s, F.array(x)).otherwise(F.slice(F.array(x), 1, 0)) for s, x in levels]
            return F.concat(*some, F.col("upper"))

        made = F.transform("kids", lambda k, j: F.struct(k.alias("kid"), steps(j).alias("path")))  # noqa: B023
        made = parts.select("tree", F.explode(made).alias("x"))
        made = made.select("tree", F.col("x.kid.pos").alias("pos"), F.col("x.path").alias("path"), *[F.col(f"x.kid.{c}").alias(c) for c in own])
        above_paths = made.unionByName(ended)
    return above_paths


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and a path."""
    return F.aggregate(path, start, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """Tables in the shared folder: ``levels`` of all sources, ``top_levels`` above them, ``trees`` (tree, source, n, height, subroot).

    ``root`` is None without rows. A tree's number is its source's place among all sources.
    """

    levels: list[DataFrame]
    top_levels: list[DataFrame]
    trees: DataFrame
    root: str | None
    kept: list[str]

    def proofs(self) -> DataFrame:
        """(tree, pos, digest, path, and the columns kept beside the leaves) of every leaf."""
        spark = self.trees.sparkSession
        start = spark.createDataFrame([(0, [])], "tree long, path array<struct<left: string, right: string>>")
        tops = with_paths(self.top_levels, start, []).select(F.col("pos").alias("tree"), "path")
        return with_paths(self.levels, tops, ["digest", *self.kept])


def manifest(docs: DataFrame, kept: dict[str, Column] | None = None, folder: str | None = None) -> Manifest:
    """Build and store the manifest of a table with the columns doc_id, source, lang, n_chars and text.

    ``kept``: more columns to keep beside each leaf, from the table's columns.

    Any of the columns may be NULL. A NULL source is a source of its own and comes first, NULL
    ids come first within it. Rows of one id stand in the order of their leaves; equal rows are
    equal leaves, each with a place of its own. An empty table has no trees and no root.
    """
    spark, kept = docs.sparkSession, kept or {}
    folder = folder or run_folder(spark, "merkle")
    own = {k: f"kept_{k}" for k in kept}
    facts = docs.select(F.col("doc_id").alias("id"), "source", leaf(*map(F.col, FIELDS)).alias("digest"), *[c.alias(own[k]) for k, c in kept.items()])
    facts = written(facts, "merkle-leaves")
    sources = facts.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("source")).alias("bytes"))
    sources = written(sources.withColumn("all", F.lit(0)), "merkle-sources")
    sizes = sources.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("bytes", F.lit(0)) + 48).alias("bytes"), F.max(height(F.col("n"))).alias("tallest"), F.sum("n").alias("n")).first()
    sources = numbered(sources.drop("bytes"), "all", [F.col("all"), F.col("source").asc_nulls_first()], tasks_for(spark, sizes["rows"], ROWS_PER_TASK), "merkle-order")
    trees = written(sources.select(F.col("pos").alias("tree"), "source", "n", height(F.col("n")).alias("height")), "merkle-trees")

    small = F.broadcast(trees) if (sizes["bytes"] or 0) <= BROADCAST_BYTES else trees
    columns = ["digest", "id", *own.values()]
    rows = facts.alias("f").join(small.alias("t"), F.col("f.source").eqNullSafe(F.col("t.source"))).select("tree", "height", *columns)
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # parts equal rows, however many
    order = [F.col("tree"), F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")]
    leaves = numbered(rows, "tree", order, tasks_for(spark, sizes["n"] or 0, ROWS_PER_TASK), "merkle-places").drop("row")
    leaves.write.parquet(f"{folder}/level=0")
    levels = stored_levels(spark.read.schema(leaves.schema).parquet(f"{folder}/level=0"), sizes["tallest"] or 0, folder)

    ends = [t.where(F.col("height") <= i * STEP).select("tree", F.col("digest").alias("subroot")) for i, t in enumerate(levels)]
    subroots = ends[0]
    for e in ends[1:]:
        subroots = subroots.unionByName(e)
    trees = trees.join(subroots, "tree")
    trees.write.parquet(f"{folder}/trees")
    trees = spark.read.schema(trees.schema).parquet(f"{folder}/trees")
    tall = sum(sizes["rows"] > FAN**i for i in range(15))
    first = trees.select(F.lit(0).cast("long").alias("tree"), F.lit(tall).alias("height"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"))
    top_levels = stored_levels(first, tall, f"{folder}/top")
    root = top_levels[-1].select("digest").first()  # the top of one tree: one row
    return Manifest(levels, top_levels, trees, root[0] if root else None, ["id", *own.values()])


def tampered(doc_id: Column, text: Column) -> Column:
    """The text, with A-Z in lower case where 5 divides the CRC of the id; a NULL id or text is left alone."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def audit(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: each leaf is proved after the tampering.

    NULLs, repeated rows and empty tables: see ``manifest``. Other columns are not read.
    """
    rows = docs.select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    values = [F.col(c) for c in FIELDS[:-1]]
    made = manifest(rows, {"now": F.when(hit, leaf(*values, tampered(F.col("doc_id"), F.col("text"))))}, folder)
    small = made.trees.select("tree", "subroot")
    small = F.broadcast(small) if small.count() * 96 <= BROADCAST_BYTES else small
    root = F.lit(made.root).cast("string")
    out = made.proofs().join(small, "tree").withColumn("folded_root", folded(F.coalesce("kept_now", "digest"), F.col("path")))
    return out.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


# CRC-32 of the decimal id, four bits at a time; the sixteen numbers are those of the public polynomial.
SQL = r"""
WITH RECURSIVE crcs AS (
    SELECT *, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda s: ascii(s)::BIGINT)),
        lambda c, b: xor(steps[(xor(steps[(xor(c, b) & 15) + 1], xor(c, b) >> 4) & 15) + 1], xor(steps[(xor(c, b) & 15) + 1], xor(c, b) >> 4) >> 4)) AS crc
    FROM documents, (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888,
                             3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[] AS steps)
), hits AS (
    SELECT *, CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now_text
    FROM crcs
), heads AS (
    SELECT doc_id, source, coalesce(octet_length(doc_id::VARCHAR::BLOB) || ':' || doc_id, '-') || coalesce(octet_length(source::BLOB) || ':' || source, '-')
           || coalesce(octet_length(lang::BLOB) || ':' || lang, '-') || coalesce(octet_length(n_chars::VARCHAR::BLOB) || ':' || n_chars, '-') AS head,
           coalesce(octet_length(encode(text)) || ':' || text, '-') AS t, coalesce(octet_length(encode(now_text)) || ':' || now_text, '-') AS now_t
    FROM hits
), leaves AS (
    SELECT doc_id, source, sha256(head || t) AS leaf, sha256(head || now_t) AS now_leaf FROM heads
), placed AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY source) AS n FROM leaves
), levels AS (
    SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM levels WHERE n > 1 GROUP BY tree, level, pos // 16, n
), subroots AS (
    SELECT tree, level AS height, digest AS subroot, (SELECT count(DISTINCT tree) FROM placed) AS n FROM levels WHERE n = 1
), tops AS (
    SELECT 0 AS level, tree AS pos, n, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 16, n
), all_levels AS (
    SELECT tree, level, pos, n, digest FROM levels UNION ALL SELECT -1, level, pos, n, digest FROM tops
), sides AS (
    SELECT tree, level, pos, coalesce(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM all_levels WHERE n > 1
), walks AS (
    SELECT doc_id, leaf, tree, pos AS start, now_leaf AS node, '' AS proof, tree AS at_tree, 0 AS level, pos, height, 0 AS top FROM placed JOIN subroots USING (tree)
    UNION ALL
    SELECT w.doc_id, w.leaf, w.tree, w.start, CASE WHEN w.level < w.height THEN sha256(s.l || w.node || s.r) ELSE w.node END,
           CASE WHEN w.level < w.height THEN w.proof || s.l || s.r ELSE w.proof END,
           CASE WHEN w.level < w.height THEN w.at_tree ELSE -1 END, CASE WHEN w.level < w.height THEN w.level + 1 ELSE 0 END,
           CASE WHEN w.level < w.height THEN w.pos // 16 ELSE w.tree END,
           CASE WHEN w.level < w.height THEN w.height ELSE (SELECT max(level) FROM tops) END, CASE WHEN w.level < w.height THEN w.top ELSE 1 END
    FROM walks w LEFT JOIN sides s ON s.tree = w.at_tree AND s.level = w.level AND s.pos = w.pos WHERE w.level < w.height OR w.top = 0
)
SELECT w.doc_id, w.leaf, s.subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = t.digest AS verified
FROM walks w JOIN subroots s USING (tree), (SELECT digest FROM tops WHERE n = 1) t WHERE w.top = 1 AND w.level = w.height
"""


@query("op13_merkle_manifest", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
