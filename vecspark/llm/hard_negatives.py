"""Hard negatives by a multiway hyperplane tree (GNAT) whose split points know their sibling subtrees.

A node has a few split points; a row belongs to the subtree of the nearest one, so that
neighbouring subtrees are parted by hyperplanes. Every split point stores, for each of its
sibling subtrees, the least and the greatest distance from it to any row in there.

Scores are inner products, not distances, so every row gets one more number that makes all rows
equally long. Then a window of scores is a window of distances, an annulus around the anchor,
and by the triangle inequality it is an interval of distances around each split point. A
sibling whose stored range misses that interval holds nothing and is dropped, without a look at
its rows. What is left are leaves, where all rows are scored exactly.

The shape of the tree (split points) is fitted on a bounded sample; all rows are indexed and the
ranges are those of all rows, so the sample changes the cost but no result. Rows of the sample
are rows of the table, so their scores also say what the k-th best of an anchor reaches at
least, which narrows the window before the tree is asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.llm.common import tasks_for, written
from vecspark.llm.register import query

SAMPLE = 2048  # rows that split points are chosen from
SPLITS = 8  # split points of a node at most
LEAF_SAMPLE = 24  # a node with so few rows of the sample is a leaf
SLICE_ROWS = 256, 8192  # a leaf is cut into slices of about so many rows at least and at most
BYTES_PER_TASK = 32 << 20
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # hundredths of the positive's score that a negative's score lies between
SCALE = 256
NO_ID = (1 << 63) - 1  # stands for a NULL id, which comes last among ties


def usable(v: Column) -> Column:
    """Not NULL, and neither is any component, and all are finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(row, id, label, q) of the rows that take part: a number of the row's own, the label to use, whole numbers."""
    v = F.col(embedding)
    rows = vectors.where(F.col(label).isNotNull() & usable(v))
    own = F.when(F.col(vec_id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label)).cast("long")
    q = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), own.alias("label"), q.alias("q"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """One row per list, as double. Shorter lists go on with zeros: a missing component adds nothing to a product."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, dtype=np.int64)
    if n and (sizes == dims).all():
        return flat.reshape(n, dims)
    out = np.zeros((n, dims))
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Tree:
    """Split points and ranges. Nodes are numbered; a child is a node's number or, as -1 - number, a leaf's."""

    def __init__(self, points: np.ndarray, largest: float):
        self.largest = largest  # the square of the longest row's length
        self.slack = np.sqrt(max(largest, 1e-300) * max(16, points.shape[1]) * 2.0**-46)
        self.splits: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self.grow(self.lifted(points)) if len(points) else self.leaf()
        self.low = [np.full((len(s), len(s)), np.inf) for s in self.splits]
        self.high = [np.full((len(s), len(s)), -np.inf) for s in self.splits]

    def leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """The rows with one more number that makes them all as long as the longest."""
        return np.column_stack([x, np.sqrt(np.maximum(self.largest - np.einsum("ij,ij->i", x, x), 0.0))])

    @staticmethod
    def away(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", p, p)[None, :] - 2 * (x @ p.T)
        return np.sqrt(np.maximum(square, 0.0))

    def grow(self, x: np.ndarray) -> int:
        if len(x) <= LEAF_SAMPLE:
            return self.leaf()
        chosen = [0]  # each further split point is the row farthest from those there are
        near = self.away(x, x[:1])[:, 0]
        while len(chosen) < SPLITS and near.max() > 2 * self.slack:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, self.away(x, x[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            return self.leaf()  # nothing but copies
        number = len(self.splits)
        self.splits.append(x[chosen])
        self.children.append([])
        of = self.away(x, x[chosen]).argmin(axis=1)
        if np.bincount(of, minlength=len(chosen)).max() == len(x):
            self.children[number] = [self.leaf() for _ in chosen]
        else:
            self.children[number] = [self.grow(x[of == j]) for j in range(len(chosen))]
        return number

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row. On the way the ranges of the nodes are widened to hold the rows."""
        x, out = self.lifted(x), np.zeros(len(x), dtype=np.int64)
        open_ = [(self.root, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            away = self.away(x[rows], self.splits[node])
            of = away.argmin(axis=1)
            for j, child in enumerate(self.children[node]):
                own = of == j
                if own.any():
                    self.low[node][:, j] = np.minimum(self.low[node][:, j], away[own].min(axis=0))
                    self.high[node][:, j] = np.maximum(self.high[node][:, j], away[own].max(axis=0))
                    open_.append((child, rows[own]))
        return out

    def reached(self, a: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, numbers of the windows that may have rows in it). ``a``: the anchor of each window of scores from least to most."""
        size = np.einsum("ij,ij->i", a, a) + self.largest
        inner = np.sqrt(np.maximum(size - 2 * np.minimum(most, size), 0.0))
        outer = np.sqrt(np.maximum(size - 2 * np.maximum(least, -size), 0.0))
        a = np.column_stack([a, np.zeros(len(a))])
        open_ = [(self.root, np.flatnonzero(least <= most))]
        while open_:
            node, who = open_.pop()
            if not len(who):
                continue
            if node < 0:
                yield -1 - node, who
                continue
            splits, alive = self.splits[node], np.ones((len(who), len(self.splits[node])), dtype=bool)
            for i in range(len(splits)):
                ask = np.flatnonzero(alive[:, i])  # a split point that is out is not compared any more
                d = self.away(a[who[ask]], splits[i : i + 1])[:, 0]
                near, far = np.maximum(d - outer[who[ask]], inner[who[ask]] - d) - self.slack, d + outer[who[ask]] + self.slack
                alive[ask] &= (self.high[node][i] >= near[:, None]) & (self.low[node][i] <= far[:, None])
            open_ += [(child, who[alive[:, j]]) for j, child in enumerate(self.children[node])]


PARTS = "row long, id long, label long, q array<double>"
ROUTED = f"leaf int, slice int, asks boolean, {PARTS}, windows array<struct<tag: int, least: double, most: double>>"
FOUND = "anchor long, tag int, row long, id long, score double"


class Forest:
    """A tree over rows written to the shared folder as (leaf, slice, row, id, label, q)."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.rows = written(rows, "negatives-rows")
        squares = F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)
        facts = self.rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(squares)).first()
        self.n, self.dims, largest = facts[0], facts[1] or 0, facts[2] or 0.0
        chosen = self.rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()  # at most SAMPLE rows
        q = matrix(chosen.column("q").combine_chunks(), self.dims)
        self.sample = q, chosen.column("label").to_numpy(), chosen.column("row").to_numpy()
        self.tree = Tree(q, largest)
        self.measure()
        self.cut(spark)

    def state(self) -> dict:
        """What a task needs, as plain data: bounded by the sample."""
        return {"tree": self.tree.__dict__, "sample": self.sample, "dims": self.dims, "slices": getattr(self, "slices", None)}

    def measure(self) -> None:
        """Put all rows into leaves, once; ranges and leaf sizes are gathered per task before they are merged."""
        shared = self.rows.sparkSession.sparkContext.broadcast(self.state())

        def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = Tree.__new__(Tree)
            tree.__dict__ |= {k: [x.copy() for x in v] if k in ("low", "high") else v for k, v in shared.value["tree"].items()}
            held = np.zeros(tree.leaves, dtype=np.int64)
            for b in batches:
                np.add.at(held, tree.place(matrix(b.column(0), shared.value["dims"])), 1)
            out = [(-1, leaf, 0, float(n), 0.0) for leaf, n in enumerate(held.tolist()) if n]
            for node, (low, high) in enumerate(zip(tree.low, tree.high, strict=True)):
                out += [(node, int(i), int(j), float(low[i, j]), float(high[i, j])) for i, j in np.argwhere(np.isfinite(low))]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["node", "i", "j", "low", "high"])

        seen = self.rows.select("q").mapInArrow(ranged, "node int, i int, j int, low double, high double")
        held = np.zeros(self.tree.leaves, dtype=np.int64)
        # A row per pair of split points and per leaf: bounded by the sample.
        for r in seen.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("low").alias("n")).collect():
            if r["node"] < 0:
                held[r["i"]] = int(r["n"])
            else:
                self.tree.low[r["node"]][r["i"], r["j"]], self.tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
        shared.destroy()
        self.held = held

    def cut(self, spark: SparkSession) -> None:
        """Leaves into slices, so that one with a third of all rows is many tasks; a slice is searched like a leaf of its own."""
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        per_slice = min(SLICE_ROWS[1], max(SLICE_ROWS[0], self.n // (2 * tasks)))
        self.slices = np.maximum(1, -(-self.held // per_slice))
        shared = spark.sparkContext.broadcast(self.state())

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = shared.value
            tree = Tree.__new__(Tree)
            tree.__dict__ |= {k: [x.copy() for x in v] if k in ("low", "high") else v for k, v in s["tree"].items()}
            for b in batches:
                leaf = tree.place(matrix(b.column("q"), s["dims"]))
                mixed = (b.column("row").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                part = mixed.astype(np.int64) % s["slices"][leaf]
                none = pa.nulls(b.num_rows, pa.list_(pa.struct([("tag", pa.int32()), ("least", pa.float64()), ("most", pa.float64())])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf, pa.int32()), pa.array(part, pa.int32()), pa.array([False] * b.num_rows), *b.columns, none], ["leaf", "slice", "asks", *b.schema.names, "windows"]
                )

        self.placed = written(self.rows.mapInArrow(placed, ROUTED), "negatives-leaves")

    def search(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor, tag, row, id, score): the k best rows of each window, ties by id, then by row.

        ``asked``: (row, id, label, q, windows). Only rows of the same label, without the anchor
        itself, or only of other labels are looked for.
        """
        spark = asked.sparkSession
        shared = spark.sparkContext.broadcast(self.state())

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = shared.value
            tree = Tree.__new__(Tree)
            tree.__dict__ |= s["tree"]
            sample, labels, rows = s["sample"]
            for b in batches:
                a, label, row = matrix(b.column("q"), s["dims"]), b.column("label").to_numpy(), b.column("row").to_numpy()
                windows = b.column("windows")
                of = np.repeat(np.arange(b.num_rows), np.diff(windows.offsets.to_numpy()))
                tag, least, most = (windows.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
                least = least.copy()
                scores = a @ sample.T
                unsure = 0.0 if tree.largest < 2.0**52 else tree.largest * s["dims"] * 2.0**-50
                # The k-th best of the sample's rows bounds the k-th best of all rows from below.
                for w, x in enumerate(of.tolist()):
                    fits = (labels == label[x]) & (rows != row[x]) if same else labels != label[x]
                    known = scores[x][fits & (scores[x] >= least[w]) & (scores[x] <= most[w])]
                    if len(known) >= k:
                        least[w] = np.partition(known, len(known) - k)[len(known) - k] - unsure
                for leaf, who in tree.reached(a[of], least, most):
                    own, first = np.unique(of[who], return_index=True)
                    ends = np.append(first, len(who)).astype(np.int32)
                    kinds = pa.StructArray.from_arrays([pa.array(tag[who], pa.int32()), pa.array(least[who]), pa.array(most[who])], ["tag", "least", "most"])
                    part, lists = b.take(pa.array(own)), pa.ListArray.from_arrays(pa.array(ends), kinds)
                    for i in range(int(s["slices"][leaf])):
                        at = [pa.array(np.full(len(own), v), t) for v, t in ((leaf, pa.int32()), (i, pa.int32()), (True, pa.bool_()))]
                        yield pa.RecordBatch.from_arrays([*at, *[part.column(c) for c in ("row", "id", "label", "q")], lists], ["leaf", "slice", "asks", "row", "id", "label", "q", "windows"])

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dims = shared.value["dims"]
            key, held, own = None, [], None  # of the slice that is read just now; its rows come before its anchors
            for b in batches:
                leaf, part, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "slice", "asks"))
                change = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
                for s, e in zip([0, *change.tolist()], [*change.tolist(), b.num_rows], strict=True):
                    if s == e:
                        continue
                    x = b.slice(s, e - s)
                    if key != (leaf[s], part[s]):
                        key, held, own = (leaf[s], part[s]), [], None
                    if not asks[s]:
                        held.append(x)
                        continue
                    if not held:
                        continue  # nobody lives here
                    if own is None:
                        own = [np.concatenate([matrix(h.column("q"), dims) for h in held]), *[np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("label", "row", "id")]]
                    q, labels, rows, ids = own
                    scores = matrix(x.column("q"), dims) @ q.T
                    label, row = x.column("label").to_numpy(), x.column("row").to_numpy()
                    out: list[tuple] = []
                    for i, windows in enumerate(x.column("windows").to_pylist()):
                        fits = np.flatnonzero((labels == label[i]) & (rows != row[i]) if same else labels != label[i])
                        mine = scores[i][fits]
                        for w in windows:
                            at = np.flatnonzero((mine >= w["least"]) & (mine <= w["most"]))
                            if len(at) > k:
                                at = at[mine[at] >= np.partition(mine[at], len(at) - k)[len(at) - k]]
                            at = at[np.lexsort((rows[fits[at]], ids[fits[at]], -mine[at]))[:k]]
                            out += [(row[i], w["tag"], rows[f], ids[f], v) for f, v in zip(fits[at].tolist(), mine[at].tolist(), strict=True)]
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], ["anchor", "tag", "row", "id", "score"])

        asking = written(asked.select("row", "id", "label", "q", "windows").mapInArrow(routed, ROUTED), "negatives-routed")
        tasks = tasks_for(spark, (self.n + asking.count()) * (8 * self.dims + 64), BYTES_PER_TASK)
        both = self.placed.unionByName(asking).repartition(tasks, "leaf", "slice").sortWithinPartitions("leaf", "slice", "asks")
        found = both.mapInArrow(scored, FOUND)
        best = Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "id", "row")  # cut to k per task before the shuffle
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Anchors are the rows whose id ``every`` divides. Rows with a NULL label or vector, or with
    a component that is NULL or not finite, take no part. A NULL id is never an anchor's and
    comes last among ties. Rows that repeat an id are rows of their own: each is an anchor,
    and each can be a positive or negative of the others. Vectors of unequal length are compared
    as if the shorter one went on with zeros. Scaled components are held to the range of a long.
    Scores are exact up to 2 ** 52, beyond that those of double arithmetic. Other columns are not read. Empty tables have no rows.
    """
    rows = prepared(vectors, vec_id, embedding, label)
    forest = Forest(rows)
    anchors = forest.rows.where((F.col("id") % every == 0) & (F.col("id") != NO_ID))
    window = F.struct(F.lit(0).alias("tag"), F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most"))
    first = written(forest.search(anchors.withColumn("windows", F.array(window)), True, positives), "negatives-positives")
    least, most = F.ceil(F.col("score") * LOW / 100).cast("double"), F.floor(F.col("score") * HIGH / 100).cast("double")
    spans = first.select("anchor", F.struct(F.col("place").alias("tag"), least.alias("least"), most.alias("most")).alias("w"))
    spans = spans.where("w.least <= w.most").groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("windows"))  # at most ``positives`` each
    asked = anchors.join(spans.withColumnRenamed("anchor", "row"), "row")
    found = forest.search(asked, False, negatives)
    known = first.select("anchor", F.col("place").alias("tag"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    known = known.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    own = {c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c) for c in ("anchor_id", "positive_id", "negative_id")}
    found = found.withColumnRenamed("id", "negative_id").join(known, ["anchor", "tag"])
    return found.select(
        own["anchor_id"], own["positive_id"], F.col("place").alias("rank"), own["negative_id"],
        F.floor("positive_score").alias("positive_score"), F.floor("score").alias("negative_score"),
    )


SQL = """
WITH rows AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM rows a JOIN rows b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT r, anchor_id, vec_id AS positive_id, other, score AS positive_score,
           row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scores WHERE same
), negatives AS (
    SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY r, p.other ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank
    FROM positives p JOIN scores s USING (r)
    WHERE place <= 5 AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""


@query("op12_hard_negatives", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
