"""Runs a registered query and its oracle text and compares the results.

``python -m tests.compare [sf] [key ...]`` prints the outcome and the time of
each query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def local_session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("reviewfold")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def normalize(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


_SAME_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def differences(spark, con, query, sql, sf_dir, limit=5):
    """Empty list when both results have equal columns, types and rows."""
    df = query(spark, sf_dir)
    relation = con.sql(sql)
    duck_types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    if sorted(df.columns) != sorted(duck_types):
        return [("columns", sorted(df.columns), sorted(duck_types))]
    found = [("type", n, t, duck_types[n]) for n, t in df.dtypes if _SAME_TYPES.get(t) != duck_types[n]]
    _, spark_rows = normalize(df.columns, [tuple(r) for r in df.collect()])
    _, duck_rows = normalize(relation.columns, relation.fetchall())
    if len(spark_rows) != len(duck_rows):
        return [*found, ("rows", len(spark_rows), len(duck_rows), spark_rows[:2], duck_rows[:2])]
    return found + [(a, b) for a, b in zip(spark_rows, duck_rows, strict=True) if a != b][:limit]


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    sf_dir = f"{ROOT}/sf{sf}"
    spark, con = local_session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                diff = differences(spark, con, query, oracles[name], sf_dir)
                state = "ok" if not diff else "DIFF"
            else:
                diff = query(spark, sf_dir).collect()[:2]
                state = "rows" if diff else "EMPTY"
                print("   ", diff)
        except Exception as error:  # noqa: BLE001  report and go on
            state, diff = "ERROR", [str(error)[:900]]
        print(f"{state:6} {time.time() - start:6.2f}s {name}", flush=True)
        if state in ("DIFF", "ERROR", "EMPTY"):
            bad.append(name)
            for line in diff:
                print("       ", str(line)[:1000])
    print(f"{len(bad)} bad: {bad}")
