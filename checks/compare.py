"""Compare registered queries with their SQL: ``python -m checks.compare FOLDER [name ...]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from caseflow.session import local_session
from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def compare(spark: SparkSession, connection, folder: str, name: str) -> tuple[int, str]:
    """Row count, and an empty string or what differs."""
    df = QUERIES[name](spark, folder)
    ours = _rows(df.columns, df.collect())
    cursor = connection.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    theirs = _rows(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return len(ours), f"columns {sorted(set(df.columns) ^ set(columns))}"
    if len(ours) != len(theirs):
        return len(ours), f"{len(ours)} rows, expected {len(theirs)}"
    for mine, other in zip(ours, theirs):
        if mine != other:
            pairs = zip(sorted(columns), mine, other)
            return len(ours), f"{[p for p in pairs if p[1] != p[2]]}"
    return len(ours), ""


def main(folder: str, names: list[str]) -> int:
    spark = local_session("compare")
    connection = connect(folder)
    failed = 0
    for name in names or list(QUERIES):
        began = time.time()
        try:
            count, problem = compare(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            count, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28} {count:8} rows "
              f"{time.time() - began:6.2f}s {problem}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
