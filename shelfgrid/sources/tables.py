"""Base parquet tables and the views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgrid.sources.view_sql import BASE_TABLES, VIEWS, with_views


def base_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def _dealt(lineitem: DataFrame) -> DataFrame:
    """What the detections are made of, dealt out as their numbering within a frame asks.

    A query reads detections several times, each time with other columns. The rows are shuffled before anything is computed
    from them, so that Spark finds the same shuffle each time and runs it once.
    """
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    return rows.repartition("l_suppkey", F.col("l_orderkey") % 97)


def view(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A derived input, planned from its SQL so that Catalyst prunes down to the parquet scan."""
    if name in BASE_TABLES:
        return base_table(spark, directory, name)
    ctes = with_views([name], "spark")
    text = ", ".join(f"{n} AS ({sql})" for n, sql in ctes.items())
    body = f"WITH {text} SELECT * FROM {name}"
    for table in BASE_TABLES:
        if f"FROM {table}" in body or f"JOIN {table}" in body:
            rows = base_table(spark, directory, table)
            (_dealt(rows) if table == "lineitem" and "det" in ctes else rows).createOrReplaceTempView(table)
    return spark.sql(body)


def known_views() -> list[str]:
    return sorted(VIEWS)


