"""An inverted-file index as tables: centres by version, rows in one folder per cell, bounds per batch.

    <path>/versions                one row per committed version: version, folder, id_type
    <path>/<folder>/centres        cell, centre
    <path>/<folder>/bounds         cell, rows, least_cosine: added by every batch before its rows
    <path>/<folder>/rows/cell=<c>  id, embedding

The index grows by appends. A cell's radius follows from the least cosine of all batches; bounds
are written first, so a batch that fails half-way leaves radii that are too large, never too
small. A batch that is run again adds only ids that its cells do not have yet. A new version is
written beside the old one and counts from the row in ``versions`` on.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.operators.ann import NO_CELL, Cells
from vecspark.session import run_folder
from vecspark.sources.corpus import new_rows

VERSIONS = "version int, folder string, id_type string"
CENTRES = "cell int, centre array<double>"
BOUNDS = "cell int, rows long, least_cosine double"


def _read(spark: SparkSession, schema: str | T.StructType, path: str) -> DataFrame:
    """The table, or an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    version: int
    name: str
    cells: Cells
    id_type: str

    @property
    def folder(self) -> str:
        return f"{self.path}/{self.name}"

    def rows(self) -> DataFrame:
        """(id, embedding, cell) of all rows; a filter on ``cell`` reads only those folders."""
        schema = T.StructType.fromDDL(f"id {self.id_type}, embedding array<float>, cell int")
        return _read(self.spark, schema, f"{self.folder}/rows")

    def bounds(self) -> DataFrame:
        """(cell, rows, least_cosine) of every cell with rows, over all batches."""
        seen = _read(self.spark, BOUNDS, f"{self.folder}/bounds")
        return seen.groupBy("cell").agg(F.sum("rows").alias("rows"), F.min("least_cosine").alias("least_cosine"))

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows at most, least cosine to the centre) by cell. One number per cell: as few as the centres."""
        n, least = np.zeros(len(self.cells), dtype=np.int64), np.ones(len(self.cells))
        for r in self.bounds().filter(F.col("cell") != NO_CELL).toLocalIterator():
            n[r["cell"]], least[r["cell"]] = r["rows"], r["least_cosine"]
        return n, least

    def append(self, corpus: DataFrame, id: str = "id", vector: str = "embedding") -> None:
        """Add the rows whose ids the index does not have. Of rows that share an id one is added.

        Equal vectors fall into equal cells, so a row that is added again is looked for in the
        cells of the batch alone. Rows without a usable vector are kept in a cell of their own.
        """
        placed = self.cells.placed(F.col(vector))
        batch = corpus.select(F.col(id).alias("id"), F.col(vector).cast("array<float>").alias("embedding"), placed.alias("_at"))
        staging = run_folder(self.spark, "index-batch")
        batch.select("id", "embedding", F.col("_at.cell").alias("cell"), F.col("_at.cosine").alias("_cosine")).write.parquet(staging)
        batch = self.spark.read.parquet(staging)
        touched = [r["cell"] for r in batch.select("cell").distinct().collect()]  # as few as the centres
        batch = new_rows(batch, self.rows().filter(F.col("cell").isin(touched)).select("id"))
        added = batch.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("_cosine").alias("least_cosine"))
        added.coalesce(1).write.mode("append").parquet(f"{self.folder}/bounds")
        # The hint gathers the rows of a cell and splits a large cell into files of the advisory size.
        batch.drop("_cosine").hint("rebalance", F.col("cell")).write.mode("append").partitionBy("cell").parquet(f"{self.folder}/rows")


def create_index(corpus: DataFrame, cells: Cells, path: str, id: str = "id", vector: str = "embedding") -> VectorIndex:
    """Put a corpus under these cells, as the next version of the index at the path."""
    spark = corpus.sparkSession
    known = _read(spark, VERSIONS, f"{path}/versions").agg(F.max("version")).first()[0] or 0
    version = known + 1
    index = VectorIndex(spark, path, version, f"v{version}-{uuid.uuid4().hex}", cells, corpus.schema[id].dataType.simpleString())
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(cells.centres)]
    spark.createDataFrame(centres, CENTRES).coalesce(1).write.parquet(f"{index.folder}/centres")
    index.append(corpus, id, vector)
    spark.createDataFrame([(version, index.name, index.id_type)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return index


def open_index(spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
    """The index as stored: the last committed version, or an earlier one."""
    known = spark.read.schema(VERSIONS).parquet(f"{path}/versions")
    known = known if version is None else known.filter(F.col("version") == version)
    found = known.orderBy(F.desc("version"), "folder").first()
    if found is None:
        raise ValueError(f"no version {version} of the index at {path}")
    centres = spark.read.schema(CENTRES).parquet(f"{path}/{found['folder']}/centres").orderBy("cell").collect()  # their size was checked
    return VectorIndex(spark, path, found["version"], found["folder"], Cells(np.array([r["centre"] for r in centres])), found["id_type"])
