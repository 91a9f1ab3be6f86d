"""Top-k search for a whole table of requests, each with its own limit and threshold.

Every corpus vector is scored against the requests inside the task that reads it, as one
matrix product per Arrow batch. A task hands on at most ``limit`` rows per request, so no
pairs are ever written or shuffled.

The matrix product only selects candidates: its rounding depends on the batch shape. A row
is a candidate when its fast score is within a proven error bound of the best ``limit``
scores, and candidates are scored again in a fixed order of additions. The results
therefore do not depend on how the corpus is partitioned, also with any number of ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vecspark.functions.vector import arrow_matrix, cosines, row_dots
from vecspark.operators.search import result_rank
from vecspark.operators.validation import clamp_limit, effective_limit
from vecspark.schema import MAX_LIMIT
from vecspark.session import run_folder

BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 64 << 20
SCORE_CELLS = 4 << 20  # scores held at once by a task
BATCH_ROWS = 4096  # corpus rows scored at once by a task
REQUESTS_AT_ONCE = 2048  # that a slice of the corpus is compared with at once
TILE_PRODUCTS = 1 << 36  # numbers that the rows and requests of a tile are multiplied in: a minute or so of a task
TILE_SIDE = 1024  # rows and requests that a tile is not cut below
SEED_TASKS = 64
SEED_OVER_BYTES = 128 << 30  # of vectors: well over a thousand scan tasks


@dataclass
class RequestBlock:
    """A bounded set of requests as arrays."""

    ids: pa.Array  # as the user gave them: they may repeat or be NULL
    numbers: np.ndarray  # tell the requests apart
    matrix: np.ndarray
    squares: np.ndarray
    limits: np.ndarray
    thresholds: np.ndarray
    probes: list | None  # per request: the cells it looks into
    floors: np.ndarray | None = None  # per request: a similarity its last result will reach at least

    @classmethod
    def from_arrow(cls, t: pa.Table, dims: int) -> RequestBlock:
        matrix = arrow_matrix(t["_vector"], dims)
        return cls(
            ids=t["_query"].combine_chunks(),
            numbers=t["_request"].to_numpy() if "_request" in t.column_names else np.arange(t.num_rows),
            matrix=matrix,
            squares=row_dots(matrix, matrix),
            limits=t["_limit"].to_numpy(),
            thresholds=t["_threshold"].to_numpy(),
            probes=t["_probes"].to_pylist() if "_probes" in t.column_names else None,
        )

    def share(self, spark: SparkSession) -> Broadcast:
        """The arrays as a broadcast variable."""
        return spark.sparkContext.broadcast(vars(self))


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled to length 1 in float32, mask of rows that have a direction)."""
    with np.errstate(all="ignore"):
        squares = np.einsum("ij,ij->i", matrix, matrix)
        unit = matrix * (1.0 / np.sqrt(squares))[:, None].astype(np.float32)
        # Very short and very long rows leave the float32 range when squared.
        odd = np.flatnonzero(~((squares > 1e-20) & (squares < 1e20)))
        usable = np.ones(len(matrix), dtype=bool)
        if len(odd):
            exact = row_dots(matrix[odd], matrix[odd])
            usable[odd] = np.isfinite(exact) & (exact > 0)
            scaled = matrix[odd] / np.sqrt(exact)[:, None]
            unit[odd] = np.where(usable[odd][:, None], scaled, 0.0)
    return unit, usable


def first_copies(matrix: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Mask of the rows that are among the ``k`` lowest ids with the same vector.

    Equal vectors have equal similarities, so ties among them go to the lowest ids and the
    other copies cannot be in any result of up to ``k`` rows.
    """
    bytes_of = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1] * matrix.itemsize))).reshape(-1)
    group = np.unique(bytes_of, return_inverse=True)[1]
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], group))
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order], side="left")
    keep = np.zeros(len(ids), dtype=bool)
    keep[order] = place < k
    return keep


class TopK:
    """The best rows per request seen so far by one task."""

    def __init__(self, block: RequestBlock) -> None:
        self.block = block
        self.query = np.zeros(0, dtype=np.int64)
        self.sims = np.zeros(0)
        self.ids = None
        self.open = np.isnan(block.thresholds)
        # A row below the floor of a request cannot be in its result.
        self.floor = np.where(self.open, -np.inf, block.thresholds)
        if block.floors is not None:
            self.open &= ~np.isfinite(block.floors)
            self.floor = np.maximum(self.floor, block.floors)
        self.count = np.zeros(len(block.ids), dtype=np.int64)
        # Twice the error bound of a float32 dot product of two rounded unit vectors.
        self.slack = (block.matrix.shape[1] + 8) * 2.0**-22
        self.unit, self.usable = unit_rows(block.matrix)
        self.by_cell: dict[int, list[int]] = {}
        for q, cells in enumerate(block.probes or ()):
            for c in cells:
                self.by_cell.setdefault(c, []).append(q)

    def add(self, ids: np.ndarray, vectors: pa.Array, cells: np.ndarray | None = None) -> None:
        """Score one batch of corpus rows; with cells, only against the requests probing them."""
        for i in range(0, len(ids), BATCH_ROWS):
            part = slice(i, i + BATCH_ROWS)
            matrix = arrow_matrix(vectors[part], self.block.matrix.shape[1])
            self._add_rows(ids[part], matrix, None if cells is None else cells[part])

    def _add_rows(self, ids: np.ndarray, matrix: np.ndarray, cells: np.ndarray | None) -> None:
        unit, usable = unit_rows(matrix)
        if cells is None:
            groups = [(np.arange(len(self.block.ids)), np.arange(len(ids)))]
        else:
            groups = [
                (np.asarray(self.by_cell[c], dtype=np.int64), np.flatnonzero(cells == c))
                for c in np.unique(cells)
                if c in self.by_cell
            ]
        for queries, rows in groups:
            live, searching = rows[usable[rows]], queries[self.usable[queries]]
            if len(live):
                live_unit = unit[live]
                step = max(1, SCORE_CELLS // len(live))
                for i in range(0, len(searching), step):
                    self._add_scored(searching[i : i + step], live, ids, matrix, live_unit)
            self._add_unscored(queries, rows, ids, usable)

    def _add_scored(self, queries, rows, ids, matrix, unit) -> None:
        fast = self.unit[queries] @ unit.T
        floor = self.floor[queries] - self.slack
        k = int(self.block.limits[queries].max())
        short = np.flatnonzero(self.count[queries] < self.block.limits[queries])
        if len(short) and k < len(rows):
            # The row at the k-th place may really be up to the slack lower.
            kth = np.partition(fast[short], len(rows) - k, axis=1)[:, len(rows) - k].astype(np.float64)
            floor[short] = np.maximum(floor[short], kth - 2 * self.slack)
        # Rounded down to float32, so that the comparison does not widen all the scores.
        hit = fast >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None]
        if np.count_nonzero(hit) > 8 * self.block.limits[queries].sum() + len(rows):
            hit &= first_copies(matrix[rows], ids[rows], k)
        at = np.flatnonzero(hit)
        if not len(at):
            return
        qi, ri = np.divmod(at, len(rows))
        used = np.unique(ri)
        squares = np.zeros(len(rows))
        squares[used] = row_dots(matrix[rows[used]], matrix[rows[used]])
        step = max(1, SCORE_CELLS // matrix.shape[1])
        for i in range(0, len(qi), step):
            q, r = queries[qi[i : i + step]], ri[i : i + step]
            dots = row_dots(matrix[rows[r]], self.block.matrix[q])
            sims = cosines(dots, squares[r], self.block.squares[q])
            keep = sims >= self.floor[q]
            self._merge(q[keep], sims[keep], ids[rows[r[keep]]])

    def _add_unscored(self, queries, rows, ids, usable) -> None:
        """Rows without a similarity come after all others, in id order, when no threshold is set."""
        unfilled = self.open[queries] & (self.count[queries] < self.block.limits[queries])
        for pool, chosen in (
            (rows[~usable[rows]], queries[unfilled & self.usable[queries]]),
            # A request without a usable vector has no similarity to any row.
            (rows, queries[self.open[queries] & ~self.usable[queries]]),
        ):
            if len(pool) and len(chosen):
                pool = pool[np.argsort(ids[pool], kind="stable")][: int(self.block.limits[chosen].max())]
                q = np.repeat(chosen, len(pool))
                self._merge(q, np.full(len(q), np.nan), ids[np.tile(pool, len(chosen))])

    def _merge(self, query, sims, ids) -> None:
        """Put new rows among the kept ones of their requests and cut at the limits."""
        if not len(query):
            return
        if self.ids is None:
            self.ids = ids[:0]
        changed = np.zeros(len(self.block.ids), dtype=bool)
        changed[query] = True
        mine = changed[self.query]
        query = np.concatenate([self.query[mine], query])
        sims = np.concatenate([self.sims[mine], sims])
        ids = np.concatenate([self.ids[mine], ids])
        id_order = ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((id_order, np.where(np.isnan(sims), np.inf, -sims), query))
        query, sims, ids = query[order], sims[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = place < self.block.limits[query]
        query, sims, ids, place = query[keep], sims[keep], ids[keep], place[keep]
        scored = ~np.isnan(sims)
        self.count[changed] = np.bincount(query[scored], minlength=len(self.count))[changed]
        # A full list raises the floor for later rows; an equal score may still win by its id.
        last = scored & (place == self.block.limits[query] - 1)
        self.floor[query[last]] = np.maximum(self.floor[query[last]], sims[last])
        self.query = np.concatenate([self.query[~mine], query])
        self.sims = np.concatenate([self.sims[~mine], sims])
        self.ids = np.concatenate([self.ids[~mine], ids])

    def result(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = [
            self.block.ids.take(pa.array(self.query)).cast(schema.field(0).type),
            pa.array([] if self.ids is None else self.ids, schema.field(1).type),
            pa.array(self.sims, pa.float64(), mask=np.isnan(self.sims)),
            pa.array(self.block.limits[self.query], pa.int32()),
            pa.array(self.block.numbers[self.query], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _score_partitions(block: Broadcast, schema: T.StructType, tasks: int | None = None):
    """A task function: corpus batches in, the task's best rows per request out.

    With ``tasks``, only that many tasks read their part and the others end at once.
    """
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tasks is not None and TaskContext.get().partitionId() >= tasks:
            return
        best = TopK(RequestBlock(**block.value))
        for b in batches:
            if b.num_rows:
                cells = b.column(2).to_numpy(zero_copy_only=False) if b.num_columns > 2 else None
                best.add(b.column(0).to_numpy(zero_copy_only=False), b.column(1), cells)
        yield best.result(arrow_schema)

    return run


def stream_slices(dims: int, schema: T.StructType):
    """A task function: rows of a tile, then the requests that look into them, block by block."""
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            tile, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_tile", "_asks"))
            change = np.flatnonzero((np.diff(tile) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), b.num_rows], strict=True):
                if s == e:
                    continue
                if key != tile[s]:
                    key, held = tile[s], []
                if not asks[s]:
                    # Without the columns that only requests fill.
                    held.append(b.select(["_id", "_vector"]).slice(s, e - s))
                    continue
                for i in range(s, e, REQUESTS_AT_ONCE):
                    best = TopK(RequestBlock.from_arrow(pa.Table.from_batches([b.slice(i, min(REQUESTS_AT_ONCE, e - i))]), dims))
                    for h in held:
                        best.add(h.column("_id").to_numpy(zero_copy_only=False), h.column("_vector"))
                    if best.ids is not None:
                        yield best.result(arrow_schema)

    return run


def tile_layout(sizes: dict[int, tuple[int, int]], dims: int, slots: int, block_bytes: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """((cell, slices of its rows, groups of its requests, its first tile) for each cell, tiles' worth of work).

    ``sizes`` are the rows and requests of each cell. A tile is a slice of rows and a group of
    requests that meet in one task; both sides are bounded, so a task's work and memory do not
    grow with either table, and there are a few tiles per slot.
    """
    work = sum(n * q for n, q in sizes.values())
    side = max(TILE_SIDE, min(isqrt(TILE_PRODUCTS // dims), isqrt(work // (3 * slots))))
    layout, first = [], 0
    for cell, (n, q) in sorted(sizes.items()):
        slices, groups = 1 + n // max(1, min(side, block_bytes // (dims * 4))), 1 + q // side
        layout.append((cell, slices, groups, first))
        first += slices * groups
    return layout, 1 + work // side**2


def tiled_topk(rows: DataFrame, asks: DataFrame, sizes: dict[int, tuple[int, int]], dims: int, schema: T.StructType, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Best rows of each tile for each of its requests, see ``tile_layout``.

    ``rows`` has _cell, _id and _vector, ``asks`` _cell, _vector, _query, _limit, _threshold and
    _request. A row goes to one slice of its cell and meets all groups of requests there.
    """
    spark, own = rows.sparkSession, ("_query", "_limit", "_threshold", "_request")
    layout, tiles = tile_layout(sizes, dims, spark.sparkContext.defaultParallelism, block_bytes)
    # A row per cell, as few as the centres.
    cells = F.broadcast(spark.createDataFrame(layout, "_cell int, _slices int, _groups int, _first int"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rows = rows.join(cells, "_cell").withColumn("_slice", F.pmod(F.xxhash64("_id", "_vector"), "_slices").cast("int")).withColumn("_group", every("_groups"))
    asks = asks.join(cells, "_cell").withColumn("_group", F.pmod(F.xxhash64("_request"), "_groups").cast("int")).withColumn("_slice", every("_slices"))
    where = ("_cell", "_slice", "_group", (F.col("_first") + F.col("_slice") * F.col("_groups") + F.col("_group")).alias("_tile"))
    left = rows.select(*where, F.lit(False).alias("_asks"), "_id", "_vector", *[F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in own])
    right = asks.select(*where, F.lit(True).alias("_asks"), F.lit(None).cast(rows.schema["_id"].dataType).alias("_id"), "_vector", *own)
    # More tasks than tiles, so that few tiles share one.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * tiles)
    both = left.unionByName(right).repartition(tasks, "_slice", "_group", "_cell").sortWithinPartitions("_tile", "_asks")
    return both.mapInArrow(stream_slices(dims, schema), schema)


def _merged(partial: DataFrame) -> DataFrame:
    """Best rows per request over all tasks."""
    return result_rank(partial, query="_request", top=MAX_LIMIT, limit="_limit").select("_request", "query_id", "rank", "id", "similarity")


def _floors(rows: DataFrame, block: RequestBlock, schema: T.StructType) -> np.ndarray:
    """The similarity of each request's last result in the first tasks; -inf where they have too few."""
    first = rows.mapInArrow(_score_partitions(block.share(rows.sparkSession), schema, SEED_TASKS), schema)
    found = _merged(first).groupBy("_request").agg(F.count("similarity").alias("n"), F.min("similarity").alias("low"))
    seen = {q: (n, low) for q, n, low in zip(*[c.to_pylist() for c in found.toArrow().columns], strict=True)}
    floors = np.full(len(block.ids), -np.inf)
    for i, q in enumerate(block.numbers.tolist()):
        n, low = seen.get(q, (0, None))
        if n >= block.limits[i]:
            floors[i] = low
    return floors


def batch_topk(
    corpus: DataFrame,
    requests: DataFrame,
    dims: int,
    id: str = "id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_embedding",
    limit: str = "limit",
    threshold: str = "threshold",
    cell: str | None = None,
    probes: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    seed_over_bytes: int = SEED_OVER_BYTES,
) -> DataFrame:
    """(query_id, rank, id, similarity) of each request's best rows.

    Requests that fit in ``broadcast_bytes`` are sent to the tasks that scan the corpus,
    which is then read once and not shuffled. A corpus with more than ``seed_over_bytes`` of
    vectors is searched in a few tasks first, so that all other tasks hand on only rows that
    may beat those results. With more requests, slices of the corpus and groups of requests
    meet in tiles of bounded size, which are shuffled to tasks (see ``tile_layout``). Each row of
    requests is answered by itself: query ids are carried along, and may repeat or be NULL.

    With ``cell`` and ``probes`` a request is compared only with rows of the cells it probes;
    such requests must fit (see ``ann.cell_join_topk`` for more).
    """
    wanted = requests.select(
        F.col(query_id).alias("_query"),
        F.col(query_vector).cast("array<float>").alias("_vector"),
        clamp_limit(effective_limit(F.col(limit))).cast("int").alias("_limit"),
        F.col(threshold).cast("double").alias("_threshold"),
        *([F.col(probes).alias("_probes")] if probes else []),
    )
    rows = corpus.select(
        F.col(id).alias("_id"),
        F.col(vector).cast("array<float>").alias("_vector"),
        *([F.col(cell).cast("int").alias("_cell")] if cell else []),
    )
    schema = T.StructType(
        [
            T.StructField("query_id", wanted.schema["_query"].dataType),
            T.StructField("id", rows.schema["_id"].dataType),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("_limit", T.IntegerType()),
            T.StructField("_request", T.LongType()),
        ]
    )
    # A task also holds a float32 copy and the best rows of each request.
    per_request = dims * 4 + MAX_LIMIT * 24
    asked, stored = wanted.count(), rows.count()
    if cell and asked * per_request > broadcast_bytes:
        raise ValueError("too many requests with probes to be sent to all tasks")
    if asked * per_request <= broadcast_bytes:
        block = RequestBlock.from_arrow(wanted.toArrow(), dims)
        if cell and probes:
            # Cells no request looks into are not read when the corpus is stored by cell.
            rows = rows.filter(F.col("_cell").isin(sorted({c for p in block.probes for c in p})))
        if stored * dims * 4 > seed_over_bytes:
            block = replace(block, floors=_floors(rows, block, schema))
        return _merged(rows.mapInArrow(_score_partitions(block.share(corpus.sparkSession), schema), schema)).drop("_request")

    # Written, so that a task that runs again finds the same numbers.
    folder = run_folder(corpus.sparkSession, "requests")
    numbered = wanted.drop("_probes").withColumn("_request", F.monotonically_increasing_id())
    numbered.write.parquet(folder)
    wanted = corpus.sparkSession.read.schema(numbered.schema).parquet(folder)

    # Rows meet requests in tiles of bounded sides: with both tables, tiles get more and not larger.
    cell_0 = F.lit(0).alias("_cell")
    found = tiled_topk(rows.select(cell_0, "_id", "_vector"), wanted.select("*", cell_0), {0: (stored, asked)}, dims, schema, block_bytes)
    return _merged(found).drop("_request")
