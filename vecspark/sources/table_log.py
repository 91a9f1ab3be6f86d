"""A table with a log of versions: appends and schema steps, all earlier versions stay readable.

    <path>/log      version, folder, step: one row per commit
    <path>/data/*   a folder of parquet files per append

A version is what the log says up to it. Files are never rewritten: a step is applied when
files older than it are read, and files written after it have it applied already. Folders
between two steps are of one schema and are read by one scan, so a table has as many scans as
steps, however many appends. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.sources.corpus import AddColumn, Backfill, RequireNotNull, not_null_violations, schema_evolve

ENTRY = "version int, folder string, step string"
STEPS = {c.__name__: c for c in (AddColumn, Backfill, RequireNotNull)}
Step = AddColumn | Backfill | RequireNotNull


def packed(step: Step) -> str:
    return json.dumps([type(step).__name__, asdict(step)])


def unpacked(text: str) -> Step:
    name, fields = json.loads(text)
    return STEPS[name](**fields)


class NotNullViolation(ValueError):
    """A commit that would leave NULLs in a column that must not have any."""


@dataclass(frozen=True)
class VersionedTable:
    spark: SparkSession
    path: str

    def log(self, version: int | None = None) -> list[tuple[int, str | None, str | None]]:
        """(version, folder, step) of all commits up to a version, in order."""
        try:
            rows = self.spark.read.schema(ENTRY).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if version is not None:
            rows = rows.filter(F.col("version") <= version)
        return [tuple(r) for r in rows.orderBy("version").collect()]

    def version(self) -> int:
        log = self.log()
        return log[-1][0] if log else 0

    def _commit(self, version: int, folder: str | None, step: str | None) -> int:
        row = self.spark.range(0, 1, 1, 1).select(F.lit(version).alias("version"), F.lit(folder).cast("string").alias("folder"), F.lit(step).cast("string").alias("step"))
        row.write.mode("append").parquet(f"{self.path}/log")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with the columns of that version."""
        log = self.log(version)
        epochs: list[tuple[list[str], list[Step]]] = []  # folders between two steps, and the steps after them
        for _, folder, step in log:
            if step is not None:
                for _, after in epochs:
                    after.append(unpacked(step))
            elif epochs and not epochs[-1][1]:
                epochs[-1][0].append(f"{self.path}/{folder}")
            else:
                epochs.append(([f"{self.path}/{folder}"], []))
        if not epochs:
            raise ValueError(f"nothing has been appended to {self.path} up to version {version}")
        out = None
        for folders, steps in epochs:
            rows = schema_evolve(self.spark.read.parquet(*folders), [s for s in steps if not isinstance(s, RequireNotNull)])  # those were checked
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def required(self, version: int | None = None) -> list[str]:
        """Columns that must not be NULL."""
        steps = [unpacked(step) for _, _, step in self.log(version) if step is not None]
        return [s.name for s in steps if isinstance(s, RequireNotNull)]

    def append(self, rows: DataFrame) -> int:
        """Write rows and commit them as the next version. Columns that they lack are NULL; ones the table lacks need a step first.

        The rows are written and then checked, so they are computed once; without a commit
        nobody reads them.
        """
        log = self.log()
        if log:
            columns = self.read().columns
            more = [c for c in rows.columns if c not in columns]
            if more:
                raise ValueError(f"the table has no columns {', '.join(more)}")
            known = self.read().schema
            rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(known[c].dataType).alias(c) for c in columns])
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._check(self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}"), self.required())
        return self._commit((log[-1][0] if log else 0) + 1, folder, None)

    def evolve(self, *steps: Step) -> int:
        """Commit schema steps, a version each. A not-null rule is checked on all rows first."""
        version = self.version()
        for step in steps:
            if isinstance(step, RequireNotNull):
                self._check(self.read(), [step.name])
            version = self._commit(version + 1, None, packed(step))
        return version

    @staticmethod
    def _check(rows: DataFrame, columns: list[str]) -> None:
        if columns:
            found = {c: n for c, n in not_null_violations(rows, columns).first().asDict().items() if n}
            if found:
                raise NotNullViolation(", ".join(f"column {c} contains {n} null values" for c, n in found.items()))
