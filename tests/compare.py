"""Run registered queries and their SQL side by side.

    python tests/compare.py <data folder> [query ...]
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns in name order, values as text, sorted."""
    df = df[sorted(df.columns)]
    columns = []
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_float_dtype(s):
            columns.append([repr(float(x)) for x in s])
        elif pd.api.types.is_datetime64_any_dtype(s):
            columns.append([x.isoformat() for x in s])
        else:
            columns.append([repr(x) for x in s.tolist()])
    return sorted(zip(*columns, strict=True)) if columns else []


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in sorted(df.columns)}


def differences(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    out = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} / {sorted(want.columns)}"]
    if kinds(got) != kinds(want):
        out.append(f"types {kinds(got)} / {kinds(want)}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} / {len(want)}")
    a, b = canonical(got), canonical(want)
    if a != b:
        only_got, only_want = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        out.append(f"only Spark: {only_got}\n   only SQL: {only_want}")
    return [o[:1500] for o in out]


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    if os.environ.get("PLAIN"):
        spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").getOrCreate()
    else:
        spark = session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            spark_time = time.time() - t
            t = time.time()
            problems = differences(got, con.execute(oracles[name]).fetchdf()) if name in oracles else []
            note = "ok" if name in oracles else "rows only"
            print(f"{name:26} {len(got):8} rows  spark {spark_time:6.2f}s  sql {time.time() - t:6.2f}s  {'DIFFERENT' if problems else note}", flush=True)
            bad += bool(problems)
            for p in problems:
                print("  ", p)
        except Exception as e:
            bad += 1
            print(f"{name:26} FAILED {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
