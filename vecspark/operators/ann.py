"""Search by cells: corpus rows are put into cells around centres and a request looks into few.

Candidates are scored exactly by the same task-side code as the exact search. A request that
looks into its nearest cells gets an approximate result. ``bounded_topk`` goes on until the
triangle inequality proves that no other cell can hold a better row, and is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.functions.vector import arrow_matrix
from vecspark.operators.batch_search import BROADCAST_BYTES, batch_topk, tiled_topk, unit_rows
from vecspark.operators.search import result_rank
from vecspark.operators.validation import clamp_limit, effective_limit
from vecspark.schema import MAX_LIMIT
from vecspark.session import run_folder

if TYPE_CHECKING:
    from vecspark.sources.vector_index import VectorIndex

NO_CELL = -1  # rows without a usable vector
ASSIGN_ROWS = 4096  # vectors compared with all centres at once by a task
COSINE_SLACK = 1e-6  # more than the cosines of single-precision vectors are off
TUNING_REQUESTS = 1000


def _unit(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    unit, usable = unit_rows(arrow_matrix(vectors, dims))
    return unit.astype(np.float64), usable


@dataclass(frozen=True)
class Cells:
    """The cell centres, one unit vector per row."""

    centres: np.ndarray

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def __len__(self) -> int:
        return len(self.centres)

    def nearest(self, vector: Column, n: int = 1) -> Column:
        """The ``n`` cells nearest to a vector, nearest first; of equally near ones the lower number."""
        centres = self.centres.astype(np.float64)
        n = min(n, len(centres))

        @F.arrow_udf("array<int>")
        def pick(vectors: pa.Array) -> pa.Array:
            order = np.full((len(vectors), n), NO_CELL, dtype=np.int32)
            for i in range(0, len(vectors), ASSIGN_ROWS):
                unit, usable = _unit(vectors[i : i + ASSIGN_ROWS], centres.shape[1])
                nearest = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :n]
                order[i : i + ASSIGN_ROWS] = np.where(usable[:, None], nearest, NO_CELL)
            offsets = np.arange(len(order) + 1, dtype=np.int32) * n
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.ravel()))

        return pick(vector)

    def placed(self, vector: Column) -> Column:
        """A row's cell and the cosine between its vector and the centre."""
        centres = self.centres.astype(np.float64)

        @F.arrow_udf("cell int, cosine double")
        def place(vectors: pa.Array) -> pa.Array:
            cell, cosine = np.full(len(vectors), NO_CELL, dtype=np.int32), np.zeros(len(vectors))
            for i in range(0, len(vectors), ASSIGN_ROWS):
                unit, usable = _unit(vectors[i : i + ASSIGN_ROWS], centres.shape[1])
                near = unit @ centres.T
                best = near.argmax(axis=1)
                cell[i : i + ASSIGN_ROWS] = np.where(usable, best, NO_CELL)
                cosine[i : i + ASSIGN_ROWS] = np.where(usable, near[np.arange(len(near)), best], 0.0)
            return pa.StructArray.from_arrays([pa.array(cell), pa.array(cosine)], ["cell", "cosine"])

        return place(vector)

    def within_reach(self, vector: Column, floor: Column, asked: Column, least_cosine: np.ndarray, rows: np.ndarray) -> Column:
        """The cells not asked yet that may hold a row of this similarity or more.

        A row in a cell is at most as far from the centre as the cell's farthest one, so its
        angle to the request is at least the request's angle to the centre less that radius.
        A request without a usable vector has no similarity to anything and needs all cells,
        as does one whose floor is NULL, because its result is not full.
        """
        centres, radius, n = self.centres.astype(np.float64), np.arccos(np.clip(least_cosine, -1, 1)), rows

        @F.arrow_udf("array<int>")
        def reach(vectors: pa.Array, floors: pa.Array, before: pa.Array) -> pa.Array:
            out: list[list[int]] = []
            floor, seen = floors.to_numpy(zero_copy_only=False).astype(np.float64), before.to_pylist()
            for i in range(0, len(vectors), ASSIGN_ROWS):
                unit, usable = _unit(vectors[i : i + ASSIGN_ROWS], centres.shape[1])
                angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
                bound = np.cos(np.maximum(angle - radius, 0.0)) + COSINE_SLACK
                for j in range(len(unit)):
                    least = floor[i + j]
                    if not usable[j] or np.isnan(least):
                        cells = [NO_CELL, *np.flatnonzero(n > 0).tolist()]
                    else:
                        cells = np.flatnonzero((bound[j] >= least) & (n > 0)).tolist()
                    out.append([c for c in cells if c not in set(seen[i + j])])
            return pa.array(out, pa.list_(pa.int32()))

        return reach(vector, floor, asked)


def cells_of(rows: DataFrame, vector: str = "embedding", key: str = "id") -> Cells:
    """Given vectors as centres, in the order of their keys; each must have a direction."""
    v = F.col(vector)
    found = rows.filter(v.isNotNull()).orderBy(key).select(F.size(v).alias("n"), F.transform(v, lambda x: x.cast("double")).alias("v")).limit(1 + BROADCAST_BYTES // 64).collect()
    centres = np.array([r["v"] for r in found])
    if not len(centres) or centres.size * 8 > BROADCAST_BYTES:
        raise ValueError(f"between one centre and {BROADCAST_BYTES} bytes of them are needed")
    return Cells(centres / np.linalg.norm(centres, axis=1, keepdims=True))


def train_cells(corpus: DataFrame, cells: int, dims: int, vector: str = "embedding", seed: int = 7) -> Cells:
    """Cell centres from k-means on the direction of the vectors.

    All usable vectors are fitted. The centres go to every task, so their size is checked.
    """
    if cells * dims * 4 > BROADCAST_BYTES:
        raise ValueError(f"{cells} centres of {dims} dimensions take more than {BROADCAST_BYTES} bytes")
    v = F.col(vector)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    usable = corpus.select(vector).filter((F.size(v) == dims) & (length > 0))
    unit = usable.select(array_to_vector(F.transform(v, lambda x: x / length)).alias("features"))
    model = KMeans(k=cells, seed=seed, featuresCol="features", maxIter=10).fit(unit)
    centres = np.stack(model.clusterCenters())
    norms = np.linalg.norm(centres, axis=1, keepdims=True)
    return Cells((centres / np.where(norms > 0, norms, 1.0)).astype(np.float32))


# ---- requests as a table of their own ----


def staged_requests(requests: DataFrame, query_id: str = "query_id", query_vector: str = "query_embedding", limit: str = "limit", threshold: str = "threshold") -> DataFrame:
    """Requests with a number of their own, written, so that a task that runs again finds the same numbers."""
    spark = requests.sparkSession
    numbered = requests.select(
        F.col(query_id).alias("_query"), F.col(query_vector).cast("array<float>").alias("_vector"), clamp_limit(effective_limit(F.col(limit))).cast("int").alias("_limit"),
        F.col(threshold).cast("double").alias("_threshold"), F.monotonically_increasing_id().alias("_request"),
    )
    folder = run_folder(spark, "requests")
    numbered.write.parquet(folder)
    return spark.read.schema(numbered.schema).parquet(folder)


def cell_join_topk(index: VectorIndex, staged: DataFrame) -> DataFrame:
    """(_request, query_id, id, similarity, _limit): best rows of the cells each request probes, for any number of requests.

    ``staged`` has the array ``_probes``. Probes are exploded and meet the rows of their cells in
    tiles: a large cell is several slices, and many requests of one are several groups, so
    that no cell is one task; neither side is gathered whole.
    """
    probes = staged.withColumn("_cell", F.explode("_probes")).drop("_probes")
    # A row per cell, as few as the centres.
    asked = {r["_cell"]: r["n"] for r in probes.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {r["cell"]: (r["rows"], asked[r["cell"]]) for r in index.bounds().collect() if r["cell"] in asked}
    rows = index.rows().filter(F.col("cell").isin(sorted(sizes))).select(F.col("cell").alias("_cell"), F.col("id").alias("_id"), F.col("embedding").alias("_vector"))
    schema = T.StructType(
        [
            T.StructField("query_id", staged.schema["_query"].dataType),
            T.StructField("id", T.StructType.fromDDL(f"id {index.id_type}")[0].dataType),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("_limit", T.IntegerType()),
            T.StructField("_request", T.LongType()),
        ]
    )
    return tiled_topk(rows, probes, sizes, index.cells.dims, schema)


def _probed_topk(index: VectorIndex, staged: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(_request, query_id, rank, id, similarity): requests of a checked size go to the tasks that read the probed cells."""
    if staged.count() * (index.cells.dims * 4 + MAX_LIMIT * 24) <= broadcast_bytes:
        found = batch_topk(
            index.rows(), staged, index.cells.dims, query_id="_request", query_vector="_vector", limit="_limit", threshold="_threshold",
            cell="cell", probes="_probes", broadcast_bytes=broadcast_bytes,
        )
        return found.select(F.col("query_id").alias("_request"), "rank", "id", "similarity")
    found = result_rank(cell_join_topk(index, staged), query="_request", top=MAX_LIMIT, limit="_limit")
    return found.select("_request", "rank", "id", "similarity")


def _answers(staged: DataFrame, found: DataFrame) -> DataFrame:
    return found.join(staged.select("_request", F.col("_query").alias("query_id")), "_request").select("query_id", "rank", "id", "similarity")


def approx_topk(index: VectorIndex, requests: DataFrame, nprobe: int, broadcast_bytes: int = BROADCAST_BYTES, **names) -> DataFrame:
    """(query_id, rank, id, similarity) of the best rows in the ``nprobe`` nearest cells of each request.

    With as many probes as cells the result is exact. Each row of requests is answered by
    itself; query ids may repeat or be NULL.
    """
    def probes(vector: str) -> Column:
        if nprobe >= len(index.cells):
            return F.array(*[F.lit(c) for c in range(NO_CELL, len(index.cells))])
        return F.array_distinct(index.cells.nearest(F.col(vector).cast("array<float>"), nprobe))

    if requests.count() * (index.cells.dims * 4 + MAX_LIMIT * 24) <= broadcast_bytes:
        asked = requests.withColumn("_probes", probes(names.get("query_vector", "query_embedding")))
        return batch_topk(index.rows(), asked, index.cells.dims, cell="cell", probes="_probes", broadcast_bytes=broadcast_bytes, **names)
    staged = staged_requests(requests, **names).withColumn("_probes", probes("_vector"))
    return _answers(staged, _probed_topk(index, staged, broadcast_bytes))


def bounded_topk(index: VectorIndex, requests: DataFrame, first: int = 1, broadcast_bytes: int = BROADCAST_BYTES, **names) -> tuple[DataFrame, DataFrame]:
    """The exact result, and (query_id, cells_read, cells) for each request.

    The ``first`` nearest cells are searched. The similarity of the last result found there is
    one that the final result reaches, so only cells whose bound is as high are searched next,
    and no others can change the result.
    """
    spark = index.spark
    staged = staged_requests(requests, **names)
    staged = staged.withColumn("_probes", F.array_distinct(index.cells.nearest(F.col("_vector"), first)))
    folder = run_folder(spark, "first-cells")
    begun = _probed_topk(index, staged, broadcast_bytes)
    begun.write.parquet(folder)
    begun = spark.read.schema(begun.schema).parquet(folder)
    reached = begun.groupBy("_request").agg(F.count("similarity").alias("_n"), F.min("similarity").alias("_low"))
    full = staged.join(reached, "_request", "left")
    full = full.withColumn("_floor", F.greatest(F.when(F.col("_n") >= F.col("_limit"), F.col("_low")), "_threshold"))  # NULLs are passed over
    rows, least = index.sizes()
    more = index.cells.within_reach(F.col("_vector"), F.col("_floor"), F.col("_probes"), least, rows)
    folder = run_folder(spark, "more-cells")
    more = full.withColumn("_more", more).select(*staged.columns, "_more")
    more.write.parquet(folder)
    more = spark.read.schema(more.schema).parquet(folder)
    rest = more.filter(F.size("_more") > 0).withColumn("_probes", F.col("_more")).drop("_more")
    found = begun.drop("rank").unionByName(_probed_topk(index, rest, broadcast_bytes).drop("rank"))
    found = found.join(more.select("_request", "_limit"), "_request")
    best = result_rank(found, query="_request", top=MAX_LIMIT, limit="_limit").select("_request", "rank", "id", "similarity")
    read = more.select(F.col("_query").alias("query_id"), (F.size("_probes") + F.size("_more")).alias("cells_read"), F.lit(len(index.cells)).alias("cells"))
    return _answers(more, best), read


def recall_by_probes(index: VectorIndex, requests: DataFrame, **names) -> DataFrame:
    """(nprobe, recall) for each number of probes: which share of the exact results it would find.

    One exact search answers for all numbers: a result is found from that number of probes on
    at which its cell stands among the request's nearest. At most ``TUNING_REQUESTS`` requests
    are taken, the first by a hash of id and vector.
    """
    query_id, vector = names.get("query_id", "query_id"), names.get("query_vector", "query_embedding")
    asked = requests.orderBy(F.xxhash64(query_id, vector), query_id).limit(TUNING_REQUESTS)
    staged = staged_requests(asked, **names)
    every = F.array(*[F.lit(c) for c in range(NO_CELL, len(index.cells))])
    exact = _probed_topk(index, staged.withColumn("_probes", every), BROADCAST_BYTES).filter("similarity IS NOT NULL")
    places = index.rows().select("id", "cell").join(F.broadcast(exact), "id").join(staged.select("_request", "_vector"), "_request")
    at = F.array_position(index.cells.nearest(F.col("_vector"), len(index.cells)), F.col("cell")).cast("int")
    hits = places.groupBy(at.alias("nprobe")).agg(F.count(F.lit(1)).alias("_n"))
    every = index.spark.range(1, len(index.cells) + 1).select(F.col("id").cast("int").alias("nprobe"))
    hits = every.join(F.broadcast(hits), "nprobe", "left")
    upto = F.sum(F.coalesce("_n", F.lit(0))).over(W.orderBy("nprobe"))  # a row per cell
    total = F.sum("_n").over(W.partitionBy())
    return hits.select("nprobe", (upto / total).alias("recall"))


def probes_for(index: VectorIndex, requests: DataFrame, recall: float = 0.9, **names) -> int:
    """The fewest probes that find this share of the exact results of the requests measured."""
    enough = recall_by_probes(index, requests, **names).filter(F.col("recall") >= recall).agg(F.min("nprobe")).first()[0]
    return len(index.cells) if enough is None else enough


def recall_at_k(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of each request's exact results that the other result has, averaged over requests."""
    hits = found.select("query_id", "id", F.lit(1).alias("_hit"))
    per_query = (
        exact.join(hits, ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg((F.count("_hit") / F.count(F.lit(1))).alias("_recall"))
    )
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.avg("_recall").alias("recall"))
