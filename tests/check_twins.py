"""Run every query next to its SQL twin and compare the results row by row.

    python tests/check_twins.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v) + 0.0
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    return v


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    columns = sorted(pdf.columns)
    rows = [tuple(_plain(v) for v in r) for r in pdf[columns].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark: SparkSession, con, sf_dir: str, fn, sql: str | None) -> tuple[str, int, float]:
    start = time.time()
    got = fn(spark, sf_dir).toPandas()
    took = time.time() - start
    if sql is None:
        return ("rows only", len(got), took)
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return (f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}", len(got), took)
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        extra = [r for r in a if r not in set(b)][:2]
        lost = [r for r in b if r not in set(a)][:2]
        return (f"ROWS {len(a)} != {len(b)} extra={extra} lost={lost}", len(a), took)
    for x, y in zip(a, b, strict=True):
        if x != y:
            return (f"VALUES {x} != {y}"[:600], len(a), took)
    return ("ok", len(a), took)


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    twins, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            verdict, rows, took = compare(spark, con, sf_dir, fn, twins.get(name))
        except Exception as error:  # report and go on with the next query
            verdict, rows, took = f"ERROR {type(error).__name__}: {str(error)[:700]}", -1, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:28s} {rows:7d} {took:6.2f}s  {verdict}", flush=True)
    print(f"{bad} mismatches")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
