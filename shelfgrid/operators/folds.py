"""Ordered folds over groups: Spark shuffles and sorts, a task streams the rows with small state."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame

BATCH = 5_000

_ARROW = {
    "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(),
    "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
}


def fold_groups(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    make: Callable[[], object],
    schema: str,
    dealt: bool = False,
) -> DataFrame:
    """Feed each group's rows, in order, to a fresh folder object.

    ``make()`` returns an object with ``push(row) -> iterable of tuples`` and ``finish() -> iterable of
    tuples``; ``row`` is a plain tuple in the column order of ``df`` and every output tuple follows
    ``schema``. The sort is Spark's external one, so a group is never held as a whole: memory is
    whatever the folder keeps. ``dealt`` says that each group lies in one partition already, as behind another fold.
    """
    names = df.columns
    key_at = [names.index(k) for k in keys]
    out_schema = pa.schema([(n, _ARROW[t]) for n, t in (part.strip().split() for part in schema.split(","))])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, out_schema)], schema=out_schema
        )

    def run(batches: Iterable[pa.RecordBatch]):
        folder, current, buffer = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple(row[i] for i in key_at)
                if key != current:
                    if folder is not None:
                        buffer.extend(folder.finish())
                    folder, current = make(), key
                buffer.extend(folder.push(row))
                if len(buffer) >= BATCH:
                    yield packed(buffer)
                    buffer = []
        if folder is not None:
            buffer.extend(folder.finish())
        for start in range(0, len(buffer), BATCH):
            yield packed(buffer[start : start + BATCH])

    arranged = (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, *order)
    return arranged.mapInArrow(run, schema)


def shuffle_partitions(df: DataFrame) -> int:
    """The session's shuffle partitions, for rows that are small but slow: adaptive execution would join their partitions by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def filter_groups(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], make: Callable[[], object], dealt: bool = False) -> DataFrame:
    """Rows that a fresh object of each group keeps; it is asked ``keep(*columns)`` for the rows in order.

    Only ``keys`` and ``columns`` become Python values; the rows themselves stay in Arrow batches.
    """
    def run(batches: Iterable[pa.RecordBatch]):
        keeper, current = None, None
        for batch in batches:
            asked = zip(zip(*(batch.column(k).to_pylist() for k in keys)), *(batch.column(c).to_pylist() for c in columns))
            mask = []
            for key, *values in asked:
                if key != current:
                    keeper, current = make(), key
                mask.append(keeper.keep(*values))
            yield batch.filter(pa.array(mask, pa.bool_()))

    arranged = (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, *order)
    return arranged.mapInArrow(run, df.schema)
