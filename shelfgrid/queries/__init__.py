"""Every operator as a named query over the stand-in tables."""

from importlib import import_module

for _module in ("boxes", "values", "scores", "texts", "joins", "aggregates", "rankings", "greedy", "scans", "jobs", "streams"):
    import_module(f"shelfgrid.queries.{_module}")

from shelfgrid.queries.registry import spark_queries, sql_queries  # noqa: E402

__all__ = ["spark_queries", "sql_queries"]
