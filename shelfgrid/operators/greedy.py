"""Greedy, order-dependent selections of boxes.

Suppression of boxes by better ones runs as set-at-a-time rounds for crowded groups and as an ordered
stream for ordinary ones; both give the sequential result. Merging operators stream too, over pieces
of a group that provably cannot touch each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgrid.config import DetectConfig, TrackConfig
from shelfgrid.functions import geometry as g
from shelfgrid.functions.scores import text_region_gate
from shelfgrid.operators.box_grid import BoxGrid
from shelfgrid.operators.folds import filter_groups, fold_groups
from shelfgrid.operators.spatial import FRAME, cover

SIDES = ["x_min", "y_min", "x_max", "y_max"]
FEW = 32  # kept boxes that are asked one by one; more go into a grid
CROWD = 5_000  # rows of one group beyond which it is decided in rounds


def area(b) -> int:
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


class _Suppressor:
    """Keep a box unless a kept one of its ``lane`` overlaps it too much or a kept row has the same ``once`` value."""

    def __init__(self, min_iou: float, min_share: float | None, limit: int | None):
        self.min_iou, self.min_share, self.limit = min_iou, min_share, limit
        self.few: dict[object, list] = {}  # kept boxes of a lane with their areas, until they are FEW
        self.grids: dict[object, BoxGrid] = {}
        self.taken, self.count = set(), 0

    def _free(self, few: list, box, own: int) -> bool:
        x_min, y_min, x_max, y_max = box
        for a, b, c, d, other in few:
            wide = (c if c < x_max else x_max) - (a if a > x_min else x_min)
            if wide <= 0:
                continue
            high = (d if d < y_max else y_max) - (b if b > y_min else y_min)
            if high <= 0:
                continue
            shared = wide * high
            if shared / (own + other - shared) >= self.min_iou:
                return False
            if self.min_share is not None and shared / min(own, other) >= self.min_share:
                return False
        return True

    def _free_in_grid(self, grid: BoxGrid, box, own: int) -> bool:
        ids, shared = grid.near(box)
        if not len(ids):
            return True
        others = grid.areas(ids)
        if (shared / (own + others - shared)).max() >= self.min_iou:
            return False
        return self.min_share is None or (shared / np.minimum(own, others)).max() < self.min_share

    def keep(self, x_min, y_min, x_max, y_max, lane=None, once=None) -> bool:
        if self.limit is not None and self.count >= self.limit:
            return False
        if once is not None and once in self.taken:
            return False
        box = (x_min, y_min, x_max, y_max)
        own, grid = area(box), self.grids.get(lane)
        if grid is not None:
            if not self._free_in_grid(grid, box, own):
                return False
            grid.add(box)
        else:
            few = self.few.setdefault(lane, [])
            if not self._free(few, box, own):
                return False
            few.append((*box, own))
            if len(few) > FEW:
                grid = self.grids[lane] = BoxGrid()
                for known in self.few.pop(lane):
                    grid.add(known[:4])
        self.count += 1
        if once is not None:
            self.taken.add(once)
        return True


def _suppress_rounds(rows: DataFrame, keys, rank_value: Column, cells: Callable, conflict: Callable) -> DataFrame:
    """Exact greedy suppression without gathering a group.

    Per round, a row that is the best of every cell it lies in beats all rows that could conflict with
    it, so it is kept; rows that conflict with a newly kept one leave. A cell holds at most one newly
    kept row, so the join grows with the rows, not with their pairs. Rounds end when nothing is open.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    names = rows.columns
    open_rows = rows.withColumn("_rank", rank_value).withColumn("_id", F.struct(*names)).checkpoint()
    kept = None
    while not open_rows.isEmpty():
        placed = cells(open_rows)
        tops = placed.groupBy(*keys, "_cell").agg(F.max_by("_id", "_rank").alias("_id"), F.count("*").alias("_n"))
        wins = tops.groupBy("_id").agg(F.count("*").alias("_won"))
        spans = placed.groupBy("_id").agg(F.count("*").alias("_cells"))
        winners = spans.join(wins, "_id").filter(F.col("_won") == F.col("_cells")).select("_id").checkpoint()
        new = winners.select("_id.*")
        kept = new if kept is None else kept.unionByName(new)
        placed_new = cells(new.withColumn("_id", F.struct(*names))).select(*keys, "_cell", F.col("_id").alias("_new"))
        beaten = placed.join(placed_new, [*keys, "_cell"]).filter(
            (F.col("_id") == F.col("_new")) | conflict(F.col("_id"), F.col("_new"))
        )
        open_rows = open_rows.join(beaten.select("_id").distinct(), "_id", "left_anti").checkpoint()
    return kept if kept is not None else rows.limit(0)


def ensure_checkpoint_dir(spark) -> None:
    """Use the shared folder the cluster names, else one in the warehouse, which all executors share as well."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def suppress(
    rows: DataFrame, keys: list[str], rank: list[Column], rank_value: Column, limits: tuple[float, float | None], cells, conflict,
    limit: int | None = None, crowd: int | None = None, lanes: tuple[str, ...] = (), dealt: bool = False,
) -> DataFrame:
    """Greedy suppression by group; ``limits`` are the least IoU and share of a conflict, ``lanes`` the columns of lane and once-value.

    Groups stream through a grid of the kept boxes, so a row meets what lies in its cells only; state is the kept boxes.
    ``crowd`` decides groups above that size in rounds over the cluster instead, without gathering them.
    """
    def streamed(some: DataFrame) -> DataFrame:
        return filter_groups(some, keys, rank, [*SIDES, *lanes], lambda: _Suppressor(*limits, limit), dealt)

    if crowd is None:
        return streamed(rows)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size")).filter(F.col("_size") > crowd).select(*keys)
    small = rows.join(sizes, keys, "left_anti")
    large = _suppress_rounds(rows.join(sizes, keys, "left_semi"), keys, rank_value, cells, conflict)
    if limit is not None:
        top = Window.partitionBy(*keys).orderBy(*rank)
        large = large.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= limit).drop("_n")
    return streamed(small).unionByName(large.select(*rows.columns))


def _grid_cells(size: int = 256, extra: Column | None = None):
    """Cells of a box, plus optional further meeting points of rows that conflict without overlapping."""
    def cells(df: DataFrame) -> DataFrame:
        placed = cover(df, g.box(), size)
        placed = placed.withColumn("_cell", F.concat_ws(":", "cell_x", "cell_y")).drop("cell_x", "cell_y")
        if extra is None:
            return placed
        also = df.withColumn("_cell", extra).filter(F.col("_cell").isNotNull())
        return placed.unionByName(also)

    return cells


def _overlap_rule(min_iou: float, min_share: float):
    def rule(a: Column, b: Column) -> Column:
        p, q = g.box_of(a), g.box_of(b)
        return (g.iou(p, q) >= min_iou) | (g.contains_ratio(p, q) >= min_share) | (g.contains_ratio(q, p) >= min_share)

    return rule


def nms_detections(detections: DataFrame, cfg: TrackConfig = TrackConfig(), crowd: int | None = None) -> DataFrame:
    """Per frame, best quality first, drop boxes that overlap a kept one; at most ``max_per_frame``."""
    names = ["video_id", "frame_index", "timestamp_ms", "candidate_index", "source", "score", *SIDES]
    quality = g.detection_quality(g.box(), F.col("score"), F.col("source"))
    rows = detections.select(*names).withColumn("quality", quality)
    limits = (cfg.nms_iou, cfg.nms_containment)
    rank_value = F.struct(F.col("quality"), (-F.col("candidate_index")).alias("c"))
    return suppress(
        rows, FRAME, [F.col("quality").desc(), F.col("candidate_index")], rank_value, limits,
        _grid_cells(), _overlap_rule(*limits), cfg.max_per_frame, crowd,
    ).drop("quality")


def ranking_key() -> Column:
    code = F.col("has_qr") | F.col("has_barcode")
    bonus = F.when(F.col("source") == "promo_color_layout", 0.12).otherwise(0.0)
    bonus = bonus + F.when(F.col("source") == "mixed", 0.08).otherwise(0.0) + F.when(code, 0.10).otherwise(0.0)
    return F.col("score") + bonus


def select_diverse(candidates: DataFrame, cfg: DetectConfig = DetectConfig(), crowd: int | None = None, dealt: bool = False) -> DataFrame:
    """Final candidates of a frame: no two overlap much, one per colour component.

    ``dealt`` says that the candidates of a frame lie in one partition already.
    """
    keys = [*FRAME, "candidate_index"]
    layout = F.col("layout_key") if "layout_key" in candidates.columns else F.lit(None).cast("string")
    rank_by = {"rank_score": ranking_key(), "rank_shape": F.coalesce("rectangularity", F.lit(0.0)), "box_area": g.box().area, "lane": F.lit(0)}
    limits = (cfg.diverse_iou, cfg.diverse_containment)
    column_rule = _overlap_rule(*limits)

    def conflict(a: Column, b: Column) -> Column:
        return F.coalesce(a["layout_key"] == b["layout_key"], F.lit(False)) | column_rule(a, b)

    rank = [F.col("rank_score").desc(), F.col("rank_shape").desc(), F.col("box_area").desc(), F.col("candidate_index")]
    if crowd is None:  # rows stay whole in their batches, so the kept ones need not be looked up
        ranked = candidates.withColumns({**rank_by, "layout_key": layout})
        kept = suppress(ranked, FRAME, rank, None, limits, None, None, cfg.max_candidates, None, ("lane", "layout_key"), dealt)
        return kept.select(*candidates.columns)
    rows = candidates.select(*keys, *SIDES, layout.alias("layout_key"), *(c.alias(n) for n, c in rank_by.items()))
    rank_value = F.struct("rank_score", "rank_shape", "box_area", (-F.col("candidate_index")).alias("c"))
    cells = _grid_cells(extra=F.concat(F.lit("layout:"), F.col("layout_key")))
    kept = suppress(rows, FRAME, rank, rank_value, limits, cells, conflict, cfg.max_candidates, crowd, ("lane", "layout_key"))
    return candidates.join(kept.select(*keys), keys, "left_semi")


def distinct_codes(codes: DataFrame, min_iou: float = 0.50, crowd: int | None = None) -> DataFrame:
    """Per frame, surest first; a code repeats a kept one of its type with the same value or place."""
    names = ["video_id", "frame_index", "code_index", "code_type", "value", "confidence", *SIDES]
    once = F.when(F.col("value") != "", F.concat("code_type", F.lit(":"), "value"))
    rows = codes.select(*names, once.alias("once"))

    def conflict(a: Column, b: Column) -> Column:
        same = (a["value"] != "") & (a["value"] == b["value"])
        return (a["code_type"] == b["code_type"]) & (same | (g.iou(g.box_of(a), g.box_of(b)) >= min_iou))

    rank_value = F.struct("confidence", (-F.col("code_index")).alias("c"))
    cells = _grid_cells(extra=F.when(F.col("value") != "", F.concat(F.lit("v:"), "code_type", F.lit(":"), "value")))
    return suppress(
        rows, FRAME, [F.col("confidence").desc(), F.col("code_index")], rank_value, (min_iou, None), cells, conflict, None, crowd,
        ("code_type", "once"),
    ).drop("once")


def distinct_frame_boxes(boxes: DataFrame, order: str, threshold: float = 0.85, crowd: int | None = None) -> DataFrame:
    """Boxes of a frame in the given order, later near-copies dropped."""
    names = ["video_id", "frame_index", order, *SIDES]
    rows = boxes.select(*names)
    return suppress(
        rows, FRAME, [F.col(order)], -F.col(order), (threshold, None), _grid_cells(),
        lambda a, b: g.iou(g.box_of(a), g.box_of(b)) >= threshold, None, crowd,
    )


def split_by_columns(df: DataFrame, keys: list[str], x_min: str = "x_min", x_max: str = "x_max") -> DataFrame:
    """Number the pieces of each group whose boxes share no pixel column, so no union can bridge them.

    Only the distinct left edges of a group are ordered, at most one per pixel column of the frame.
    """
    edges = df.groupBy(*keys, x_min).agg(F.max(x_max).alias("_right"))
    before = Window.partitionBy(*keys).orderBy(x_min).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(x_min).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = edges.withColumn("_new", F.coalesce((F.col(x_min) >= F.max("_right").over(before)).cast("int"), F.lit(0)))
    edges = edges.withColumn("piece", F.sum("_new").over(upto).cast("int")).drop("_right", "_new")
    return df.join(edges, [*keys, x_min])


def split_by_strips(df: DataFrame, keys: list[str], margin: float, rounds: int = 3) -> DataFrame:
    """Number the strips of each group between gaps that no growing group of boxes can bridge.

    The union of all boxes on one side, grown by ``margin`` of its width, must not meet the grown boxes of the other side.
    Strips that are cut off make the unions smaller, so later rounds find more gaps. Only distinct left edges are ordered.
    """
    edges = df.groupBy(*keys, "x_min").agg(F.max("x_max").alias("_right")).withColumn("strip", F.lit("0"))
    for _ in range(rounds):
        by = Window.partitionBy(*keys, "strip").orderBy("x_min")
        before, upto, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
        whole = Window.partitionBy(*keys, "strip")
        wide = F.col("_right") - F.col("x_min")
        gap = F.col("x_min") - F.max("_right").over(before)
        left_span, right_span = F.max("_right").over(before) - F.min("x_min").over(whole), F.max("_right").over(whole) - F.col("x_min")
        left = gap > F.lit(margin) * (left_span + F.max(wide).over(after)) + 1
        right = gap > F.lit(margin) * (right_span + F.max(wide).over(before)) + 1
        edges = edges.withColumn("_cut", F.coalesce((left & right).cast("int"), F.lit(0)))
        edges = edges.withColumn("_part", F.sum("_cut").over(upto)).withColumn("strip", F.concat_ws(".", "strip", F.col("_part").cast("string")))
    return df.join(edges.select(*keys, "x_min", "strip"), [*keys, "x_min"])


class _GroupFold:
    """Boxes of one strip in order: each open group takes every later box its grown box meets.

    The sequential rule grows one group over all later boxes before the next group starts, so the boxes of the strip are
    kept, as numbers by grid cell; a group asks only the cells it covers.
    """

    def __init__(self, width: int, height: int, margin: float, threshold: float):
        self.width, self.height, self.margin, self.threshold = width, height, margin, threshold
        self.keys, self.order, self.mass, self.boxes, self.reaches = None, [], [], [], None

    def push(self, row):
        self.keys = row[:2]
        self.order.append(row[2])
        self.boxes.append(row[3:7])
        self.mass.append(row[7])
        return ()

    def grow(self, b):
        w, h, m = b[2] - b[0], b[3] - b[1], self.margin
        x1 = min(max(int(b[0] - m * w), 0), self.width - 1)
        y1 = min(max(int(b[1] - m * h), 0), self.height - 1)
        return (
            x1, y1, min(max(int(b[2] + m * w), x1 + 1), self.width), min(max(int(b[3] + m * h), y1 + 1), self.height)
        )

    def finish(self):
        if len(self.boxes) == 1:  # most strips: nothing to meet
            yield (*self.keys, self.order[0], *self.boxes[0], self.mass[0])
            return
        self.reaches, kept = BoxGrid(), BoxGrid()
        for box in self.boxes:
            self.reaches.add(self.grow(box))
        for first in range(len(self.boxes)):
            if not self.reaches.live[first]:
                continue
            union, mass, at = tuple(self.boxes[first]), self.mass[first], first
            reach = self.grow(union)
            met = self.reaches.near(reach, at)[0]
            # The reach only changes when a box joins, so jump to the next free box that it meets.
            while len(met):
                at = int(met[0])
                self.reaches.leave(at)
                b = self.boxes[at]
                union = (min(union[0], b[0]), min(union[1], b[1]), max(union[2], b[2]), max(union[3], b[3]))
                mass += self.mass[at]
                grown = self.grow(union)
                met = met[1:] if grown == reach else self.reaches.near(grown, at)[0]
                reach = grown
            ids, common = kept.near(union)
            if not (common >= self.threshold * (area(union) + kept.areas(ids) - common)).any():
                kept.add(union)
                yield (*self.keys, self.order[first], *union, mass)


def group_near_boxes(
    regions: DataFrame, width: int = 3840, height: int = 2160, margin: float = 0.08, threshold: float = 0.85
) -> DataFrame:
    """Text boxes grown into groups; ``text_fill`` of a group spreads its members' text over the union.

    Copies of a box always end in the group of the first one, so they are counted together before the
    shuffle; a task then holds the distinct gated boxes of one strip of a frame.
    """
    b = g.box()
    rows = regions.withColumn("mass", F.col("text_fill") * b.area).groupBy(*FRAME, *SIDES).agg(
        F.min("region_index").alias("region_index"), F.sum("mass").alias("mass")
    )
    rows = split_by_strips(rows, FRAME, margin).select(*FRAME, "region_index", *SIDES, "mass", "strip")
    out = fold_groups(
        rows, [*FRAME, "strip"], [F.col("region_index")], lambda: _GroupFold(width, height, margin, threshold),
        "video_id string, frame_index int, region_index int, x_min int, y_min int, x_max int, y_max int, mass double",
    )
    return out.select(*FRAME, "region_index", *SIDES, F.least(F.lit(1.0), F.col("mass") / b.area).alias("text_fill"))


def score_text_regions(regions: DataFrame, width: int = 3840, height: int = 2160) -> DataFrame:
    from shelfgrid.functions.scores import score_text_boxes

    text = regions.filter(F.col("kind") == "text")
    clamped = g.clamp(g.box(), width, height)
    text = text.select(*(c for c in text.columns if c not in SIDES), *clamped.columns())
    groups = group_near_boxes(text.filter(text_region_gate(g.box(), width, height)), width, height)
    return score_text_boxes(groups, width, height).select(
        *FRAME, "region_index", F.lit("text_like_region").alias("source"), "score", *SIDES, "text_density"
    )


MERGE_COLUMNS = [
    "video_id", "frame_index", "candidate_index", *SIDES, "source", "score", "text_density", "rectangularity",
    "edge_density", "area_ratio", "has_qr", "has_barcode", "has_text", "has_rect", "code_values",
    "anchor_hypothesis", "anchor_key", "layout_key", "layout_hypothesis", "timestamp_ms",
]
MERGE_SCHEMA = (
    "video_id string, frame_index int, candidate_index int, x_min int, y_min int, x_max int, y_max int, source string,"
    " score double, text_density double, rectangularity double, edge_density double, area_ratio double,"
    " has_qr boolean, has_barcode boolean, has_text boolean, has_rect boolean, code_values string,"
    " anchor_hypothesis int, anchor_key string, layout_key string, layout_hypothesis int, timestamp_ms double"
)
_NUMBERS, _FLAGS = slice(9, 13), slice(13, 17)


class _MergeFold:
    """Score-ordered candidates merge into the first kept one they overlap enough."""

    def __init__(self, min_iou: float, min_share: float, limit: int | None):
        self.min_iou, self.min_share, self.limit = min_iou, min_share, limit
        self.kept: list[list] = []
        self.grid, self.place = BoxGrid(), []  # boxes that may still merge, and where their rows are kept

    @staticmethod
    def values(row) -> list[str]:
        return row[17].split("|") if row[17] else []

    def candidates(self, row) -> list[int]:
        """Kept rows, in order, whose box overlaps enough and would not grow too much."""
        box = row[3:7]
        if self.grid.few is not None:
            return [k for k, shared, held in self.grid.few_near(box) if self.enough(box, held, shared)]
        ids, shared = self.grid.near(box)
        if not len(ids):
            return []
        own, others, held = area(box), self.grid.areas(ids), self.grid.boxes[ids]
        union = (np.maximum(held[:, 2], box[2]) - np.minimum(held[:, 0], box[0])) * (np.maximum(held[:, 3], box[3]) - np.minimum(held[:, 1], box[1]))
        enough = (shared / (own + others - shared) >= self.min_iou) | (shared / others >= self.min_share) | (shared / own >= self.min_share)
        return ids[enough & (union / np.maximum(own, others) <= 1.8)].tolist()

    def enough(self, box, held, shared: int) -> bool:
        own, others = area(box), area(held)
        if not (shared / (own + others - shared) >= self.min_iou or shared / others >= self.min_share or shared / own >= self.min_share):
            return False
        union = (max(held[2], box[2]) - min(held[0], box[0])) * (max(held[3], box[3]) - min(held[1], box[1]))
        return union / max(own, others) <= 1.8

    def agree(self, first, second) -> bool:
        """Whether the codes and anchors of two rows do not speak against merging them."""
        p, q = set(self.values(first)), set(self.values(second))
        if p and q and not p & q:
            return False
        rivals = "anchor" in first[7] and "anchor" in second[7] and first[18] is not None and second[18] is not None
        if rivals and first[18] != second[18]:
            if (p & q) or (first[19] not in (None, "several") and first[19] == second[19]):
                return False
        return True

    @staticmethod
    def largest(a, b):
        return b if a is None else a if b is None else max(a, b)

    def merged(self, a: list, b) -> list:
        out = list(a)
        out[3:7] = [min(a[3], b[3]), min(a[4], b[4]), max(a[5], b[5]), max(a[6], b[6])]
        same = a[7] == b[7]
        out[7] = a[7] if same else "mixed"
        out[8] = min(1.0, max(a[8], b[8]) + (0.03 if same else 0.08))
        for i in range(*_NUMBERS.indices(len(out))):
            out[i] = self.largest(a[i], b[i])
        for i in range(*_FLAGS.indices(len(out))):
            out[i] = bool(a[i]) or bool(b[i])
        out[17] = "|".join(dict.fromkeys(self.values(a) + self.values(b))) or None
        out[18] = self.largest(a[18], b[18])
        if a[19] != b[19]:
            # Two different anchor boxes become a list of both, which identifies no single anchor any more.
            out[19] = b[19] if a[19] is None else a[19] if b[19] is None else "several"
        return out

    def push(self, row):
        if row[20] is None or row[21] is None:
            for k in self.candidates(row):
                i = self.place[k]
                if self.agree(self.kept[i], row):
                    self.kept[i] = self.merged(self.kept[i], row)
                    self.grid.grow(k, self.kept[i][3:7])
                    return ()
            self.grid.add(row[3:7])
            self.place.append(len(self.kept))
        self.kept.append(list(row))  # boxes of a layout neither merge nor are merged into
        return ()

    def finish(self):
        ranked = sorted(self.kept, key=lambda r: -r[8])
        return (tuple(r) for r in (ranked if self.limit is None else ranked[: self.limit]))


def merge_candidates(
    candidates: DataFrame, min_iou: float = 0.45, min_share: float = 0.85, limit: int | None = None, dealt: bool = False
) -> DataFrame:
    """Merge overlapping candidates of a frame, best first. Missing evidence columns count as absent.

    A merged box is the union of its parts, so pieces of a frame without a common pixel column never
    merge; each piece is one ordered stream. All merged boxes are returned; a ``limit`` per frame (the service has 80) is
    applied over the pieces afterwards. Candidates that are ``dealt`` by frame already are merged frame by frame where they lie.
    """
    types = dict(part.strip().split(" ") for part in MERGE_SCHEMA.split(","))

    def column(name: str) -> Column:
        if name not in candidates.columns:
            return F.lit(None).cast(types[name]).alias(name)
        if name == "code_values" and dict(candidates.dtypes)[name].startswith("array"):
            return F.when(F.size(name) > 0, F.array_join(name, "|")).alias(name)
        return F.col(name).cast(types[name]).alias(name)

    rows = candidates.select(*(column(c) for c in MERGE_COLUMNS)).filter((g.box().area > 0) & (F.col("score") > 0))
    pieces = [] if dealt else ["piece"]
    if not dealt:
        rows = split_by_columns(rows, FRAME).select(*MERGE_COLUMNS, "piece")
    merged = fold_groups(
        rows, [*FRAME, *pieces], [F.col("score").desc(), F.col("candidate_index")],
        lambda: _MergeFold(min_iou, min_share, limit), MERGE_SCHEMA + "".join(f", {p} int" for p in pieces), dealt,
    ).drop(*pieces)
    if limit is not None:
        top = Window.partitionBy(*FRAME).orderBy(F.col("score").desc(), "candidate_index")
        merged = merged.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= limit).drop("_n")
    return merged


class _LineFold:
    """Words by height centre join the first line near enough; a line keeps sums, not words."""

    def __init__(self):
        self.lines: list[list] = []

    def push(self, row):
        top, bottom = row[3], row[5]
        center, height = (top + bottom) / 2.0, max(0, bottom - top)
        for i, (n, centers, heights) in enumerate(self.lines):
            if abs(center - centers / n) <= max(8.0, heights / n * 0.55):
                self.lines[i] = [n + 1, centers + center, heights + height]
                return ((*row, i),)
        self.lines.append([1, center, height])
        return ((*row, len(self.lines) - 1),)

    def finish(self):
        return ()


def group_words_into_lines(words: DataFrame, key: str = "tag_id") -> DataFrame:
    """Assign every word the number of its line within the tag."""
    rows = words.select(key, "word_seq", "x_min", "y_min", "x_max", "y_max", "text")
    key_type = dict(words.dtypes)[key]
    center = F.col("y_min") + F.col("y_max")
    return fold_groups(
        rows, [key], [center, F.col("x_min"), F.col("word_seq")], _LineFold,
        f"{key} {key_type}, word_seq int, x_min int, y_min int, x_max int, y_max int, text string, line_index int",
    )
