"""Run registered queries next to their SQL: python -m tests.oracle SF_DIR [name ...]."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def spark_session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def duck(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, connection, query, sf_dir):
    """Return (rows, list of differences)."""
    df = query(spark, sf_dir)
    got_names, got = table_of(df.columns, [tuple(row) for row in df.collect()])
    if not query.sql:
        return len(got), []
    cursor = connection.execute(query.sql)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    names, want = table_of([d[0] for d in cursor.description], cursor.fetchall())
    wrong = []
    if names != got_names:
        wrong.append(f"columns {got_names} / {names}")
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds.get(name):
            wrong.append(f"type of {name}: {kind} / {kinds.get(name)}")
    if len(got) != len(want):
        wrong.append(f"rows {len(got)} / {len(want)}")
    off = [(a, b) for a, b in zip(got, want) if a != b]
    if off:
        wrong.append(f"{len(off)} rows differ, such as {off[0]}")
    return len(got), wrong


def main() -> int:
    from rankloom.catalog import QUERIES

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark, connection = spark_session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name, query in QUERIES.items():
        if chosen and not any(name == c or (c.endswith("*") and name.startswith(c[:-1])) for c in chosen):
            continue
        start = time.time()
        try:
            rows, wrong = compare(spark, connection, query, sf_dir)
        except Exception as error:  # report and go on with the next query
            rows, wrong = 0, [f"{type(error).__name__}: {str(error)[:600]}"]
            if len(chosen) == 1:
                traceback.print_exc()
        bad += bool(wrong)
        mark = "FAIL" if wrong else ("ok  " if query.sql else "rows")
        print(f"{mark} {name:40s} {rows:7d} rows {time.time() - start:6.2f}s", *wrong, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
