"""Batch operators: overlap joins, aggregates, rankings, greedy selection, tracking, catalogue matching."""
