"""The corpus operators as named queries over their whole tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from shelfgrid.llm.registry import QUERIES, SQL

for _module in ("q_urls", "q_tokens", "q_packing", "q_leaks", "q_labels", "q_html", "q_repeats", "q_ngrams", "q_nearest", "q_search", "q_conversations", "q_personal"):
    import_module(f"shelfgrid.llm.{_module}")


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def sql_queries() -> dict[str, str]:
    return dict(SQL)
