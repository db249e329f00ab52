"""Named queries: a DataFrame builder and, where SQL can say it, the same question in portable SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfgrid.sources.tables import view
from shelfgrid.sources.view_sql import with_views


class Inputs:
    """Views of one data directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.directory, name)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Inputs], DataFrame]
    reads: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, reads: str = "", sql: str | None = None):
    """Register a builder taking :class:`Inputs`; ``reads`` names the views its SQL twin starts from."""

    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, tuple(reads.split()), sql)
        return build

    return register


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(q: Query):
        return lambda spark, directory: q.build(Inputs(spark, directory))

    return {name: runner(q) for name, q in REGISTRY.items()}


def sql_queries() -> dict[str, str]:
    out = {}
    for name, q in REGISTRY.items():
        if q.sql is None:
            continue
        body = q.sql.strip()
        ctes = ", ".join(f"{n} AS ({sql})" for n, sql in with_views(q.reads, "duckdb").items())
        if body[:4].upper() == "WITH":
            head, rest = ("WITH RECURSIVE ", body[14:]) if body[:14].upper() == "WITH RECURSIVE" else ("WITH ", body[4:])
            out[name] = f"{head}{ctes + ', ' if ctes else ''}{rest.strip()}"
        else:
            out[name] = f"WITH {ctes} {body}" if ctes else body
    return out
