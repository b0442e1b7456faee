"""Runs a query and its SQL oracle on the same tables and compares the rows without regard to order."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """'' when both give the same columns and the same multiset of rows; else what differs."""
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} against {sorted(want.columns)}"
    got, expected = rows_of(df.columns, df.collect()), rows_of(want.columns, want.fetchall())
    if got == expected:
        return ""
    extra, missing = list((got - expected).items())[:3], list((expected - got).items())[:3]
    return f"{sum(got.values())} rows against {sum(expected.values())}; only Spark: {extra}; only SQL: {missing}"


def main() -> None:
    import sys
    import time

    import __spark_entry__ as e

    sf = f"{DATA}/{os.environ.get('SF', 'sf0.01')}"
    spark, con, names = session(), duck(sf), sys.argv[1:] or list(e.queries())
    sqls, queries, bad = e.oracle_sql(), e.queries(), 0
    for name in names:
        began = time.time()
        try:
            df = queries[name](spark, sf)
            if name in sqls:
                said = compare(df, sqls[name], con)
                n = "oracle"
            else:
                rows = df.collect()
                said, n = "" if rows else "no rows", f"{len(rows)} rows {str(rows[0])[:300] if rows else ''}"
        except Exception as error:  # reported, the others go on
            said, n = f"{type(error).__name__}: {str(error)[:1500]}", "-"
        bad += bool(said)
        print(f"{'FAIL' if said else 'ok'} {name} {time.time() - began:.1f}s {n} {said}", flush=True)
    print(f"{bad} failed of {len(names)}")


if __name__ == "__main__":
    main()
