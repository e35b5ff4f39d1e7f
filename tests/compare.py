"""Compare registered queries with their SQL: ``python -m tests.compare [sf_dir] [names]``."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

TYPES = {"int": "int", "bigint": "int", "smallint": "int", "hugeint": "int"}


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return value


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both sides have the same columns, types and rows."""
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    expected = found.fetchall()
    problems = []
    if sorted(columns) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(columns)}"]
    actual = spark_df.collect()
    kinds = {n: TYPES.get(t, t) for n, t in spark_df.dtypes}
    for name, d in zip(columns, found.description):
        kind = {"varchar": "string"}.get(str(d[1]).lower(), str(d[1]).lower())
        kind = TYPES.get(kind, {"integer": "int", "bool": "boolean", "number": kinds[name]}.get(kind, kind))
        if kind != kinds[name]:
            problems.append(f"type of {name}: {kinds[name]} != {d[1]}")
    mine, theirs = rows_of(spark_df.columns, actual), rows_of(columns, expected)
    if mine != theirs:
        problems.append(
            f"{len(actual)} vs {len(expected)} rows; only here {list((mine - theirs).items())[:3]}; "
            f"only there {list((theirs - mine).items())[:3]} of columns {sorted(columns)}"
        )
    return problems


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            if name not in oracle_sql():
                print(f"rows-only {name}: {df.count()}", flush=True)
                continue
            problems = differences(df, con, oracle_sql()[name])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, flush=True)
        failed += [name] if problems else []
    print("failed:", failed)


if __name__ == "__main__":
    main()
