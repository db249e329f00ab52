"""Joins of boxes that overlap, keyed by frame and grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgrid.functions import geometry as g

FRAME = ["video_id", "frame_index"]
CELL = 512


def _cell(c: Column, cell: int) -> Column:
    return F.floor(c / F.lit(cell)).cast("int")


def cover(df: DataFrame, b: g.Box, cell: int = CELL, reach: int | Column = 0) -> DataFrame:
    """One row per grid cell that the box, grown by ``reach`` pixels, touches."""
    xs = F.sequence(_cell(b.x_min - reach, cell), _cell(F.greatest(b.x_max - 1, b.x_min) + reach, cell))
    ys = F.sequence(_cell(b.y_min - reach, cell), _cell(F.greatest(b.y_max - 1, b.y_min) + reach, cell))
    return df.withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: list[str] = FRAME, cell: int = CELL) -> DataFrame:
    """Pairs of boxes with a common pixel, each pair once.

    ``left`` carries ``l_x_min`` .. ``l_y_max`` and ``right`` ``r_x_min`` .. ``r_y_max``. Rows meet per
    (keys, cell) rather than per frame, so one crowded frame spreads over the tasks of its cells, and
    the pair is kept only in the cell of the corner where the two boxes start to overlap.
    """
    a, b = g.box("l_"), g.box("r_")
    here = (F.col("cell_x") == _cell(F.greatest(a.x_min, b.x_min), cell)) & (
        F.col("cell_y") == _cell(F.greatest(a.y_min, b.y_min), cell)
    )
    touching = (
        (a.x_min < b.x_max) & (b.x_min < a.x_max) & (a.y_min < b.y_max) & (b.y_min < a.y_max)
    )
    joined = cover(left, a, cell).join(cover(right, b, cell), [*keys, "cell_x", "cell_y"])
    return joined.filter(touching & here).drop("cell_x", "cell_y")


def renamed_box(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in ("x_min", "y_min", "x_max", "y_max")})


def cut_at_gaps(df: DataFrame, keys: list[str], position: str, gap: float) -> DataFrame:
    """Number the stretches of each group between position gaps wider than ``gap``.

    Only the distinct positions of a group are ordered (frames, not boxes); the rows then pick their
    stretch up by an equi-join.
    """
    by_group = Window.partitionBy(*keys).orderBy(position)
    stops = df.select(*keys, position).distinct()
    stops = stops.withColumn("_new", (F.col(position) - F.lag(position).over(by_group) > gap).cast("int"))
    stops = stops.withColumn("segment", F.sum(F.coalesce("_new", F.lit(0))).over(by_group).cast("int")).drop("_new")
    return df.join(stops, [*keys, position])
