"""Run a registered query on Spark and its SQL twin on DuckDB and compare the rows as multisets."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfgrid.queries import spark_queries, sql_queries  # noqa: E402
from shelfgrid.sources.view_sql import BASE_TABLES  # noqa: E402


def connect(directory: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}" if value else "0"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 10**8 else str(value)
    if hasattr(value, "as_tuple"):
        return f"{float(value):.9g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, directory: str, name: str) -> tuple[bool, str]:
    started = time.time()
    frame = spark_queries()[name](spark, directory)
    spark_cols, spark_rows = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - started
    sql = sql_queries().get(name)
    if sql is None:
        return True, f"rows={sum(spark_rows.values())} (no SQL twin) {took:.1f}s"
    started = time.time()
    cur = con.execute(sql)
    duck_cols, duck_rows = _rows([d[0] for d in cur.description], cur.fetchall())
    text = f"rows={sum(spark_rows.values())}/{sum(duck_rows.values())} {took:.1f}s duck {time.time() - started:.1f}s"
    if spark_cols != duck_cols:
        return False, f"{text} columns {spark_cols} != {duck_cols}"
    if spark_rows != duck_rows:
        left = sorted((spark_rows - duck_rows).items(), key=str)[:3]
        right = sorted((duck_rows - spark_rows).items(), key=str)[:3]
        n = sum((spark_rows - duck_rows).values())
        return False, f"{text} {n} rows differ\n   cols  {spark_cols}\n   spark {left}\n   sql   {right}"
    return True, text


def main() -> None:
    from shelfgrid.session import local_session

    directory = sys.argv[1]
    wanted = sys.argv[2:] or sorted(spark_queries())
    spark, con = local_session(), connect(directory)
    bad = 0
    for name in wanted:
        try:
            ok, text = compare(spark, con, directory, name)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print("ok " if ok else "BAD", name, text, flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} equal")


if __name__ == "__main__":
    main()
