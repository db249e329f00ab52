"""Half-open pixel boxes as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfgrid.config import TrackConfig
from shelfgrid.functions.numbers import fixed
from shelfgrid.functions.values import let


class Box(NamedTuple):
    x_min: Column
    y_min: Column
    x_max: Column
    y_max: Column

    @property
    def width(self) -> Column:
        return F.greatest(F.lit(0), self.x_max - self.x_min)

    @property
    def height(self) -> Column:
        return F.greatest(F.lit(0), self.y_max - self.y_min)

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def aspect(self) -> Column:
        return F.when(self.height == 0, F.lit(0.0)).otherwise(
            self.width / F.when(self.height == 0, F.lit(1)).otherwise(self.height)
        )

    @property
    def center_x(self) -> Column:
        return (self.x_min + self.x_max) / F.lit(2.0)

    @property
    def center_y(self) -> Column:
        return (self.y_min + self.y_max) / F.lit(2.0)

    def columns(self, prefix: str = "") -> list[Column]:
        return [
            self.x_min.alias(f"{prefix}x_min"),
            self.y_min.alias(f"{prefix}y_min"),
            self.x_max.alias(f"{prefix}x_max"),
            self.y_max.alias(f"{prefix}y_max"),
        ]


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{side}") for side in ("x_min", "y_min", "x_max", "y_max")))


def box_of(struct: Column) -> Box:
    return Box(struct["x_min"], struct["y_min"], struct["x_max"], struct["y_max"])


def clip(value, low, high) -> Column:
    return F.least(F.greatest(_c(value), _c(low)), _c(high))


def clamp(b: Box, width, height) -> Box:
    """Non-empty box inside the frame; an empty frame gives the zero box."""
    w, h = _c(width), _c(height)
    no_frame = (w <= 0) | (h <= 0)
    x_min = clip(b.x_min, 0, w - 1)
    y_min = clip(b.y_min, 0, h - 1)
    x_max = clip(b.x_max, x_min + 1, w)
    y_max = clip(b.y_max, y_min + 1, h)
    return Box(*(F.when(no_frame, F.lit(0)).otherwise(side).cast("int") for side in (x_min, y_min, x_max, y_max)))


def shift_sides(b: Box, left, top, right, bottom) -> Box:
    """Move every side outwards by a ratio of the box size, truncating toward zero."""
    w, h = b.width, b.height
    return Box(
        (b.x_min - _c(left) * w).cast("int"),
        (b.y_min - _c(top) * h).cast("int"),
        (b.x_max + _c(right) * w).cast("int"),
        (b.y_max + _c(bottom) * h).cast("int"),
    )


def expand(b: Box, width, height, left=0.0, top=0.0, right=0.0, bottom=0.0) -> Box:
    return clamp(shift_sides(b, left, top, right, bottom), width, height)


def union(a: Box, b: Box) -> Box:
    return Box(
        F.least(a.x_min, b.x_min),
        F.least(a.y_min, b.y_min),
        F.greatest(a.x_max, b.x_max),
        F.greatest(a.y_max, b.y_max),
    )


def axis_overlap(a_min, a_max, b_min, b_max) -> Column:
    return F.greatest(F.lit(0), F.least(a_max, b_max) - F.greatest(a_min, b_min))


def intersection(a: Box, b: Box) -> Column:
    return axis_overlap(a.x_min, a.x_max, b.x_min, b.x_max) * axis_overlap(a.y_min, a.y_max, b.y_min, b.y_max)


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    total = a.area + b.area - inter
    return F.when(total <= 0, F.lit(0.0)).otherwise(inter / F.greatest(total, F.lit(1)))


def contains_ratio(outer: Box, inner: Box) -> Column:
    """Share of ``inner`` that lies in ``outer``."""
    return F.when(inner.area <= 0, F.lit(0.0)).otherwise(
        intersection(outer, inner) / F.greatest(inner.area, F.lit(1))
    )


def rotate(b: Box, width, height, mode: Column) -> Box:
    """Box in the coordinates of the rotated frame; an unknown mode is an error."""
    w, h = _c(width), _c(height)

    def pick(none, ccw, cw, half) -> Column:
        return (
            F.when(mode.isNull() | mode.isin("none", ""), none)
            .when(mode == "rot90_ccw", ccw)
            .when(mode == "rot90_cw", cw)
            .when(mode == "rot180", half)
            .otherwise(F.raise_error(F.concat(F.lit("unknown rotation mode: "), mode)).cast("int"))
        )

    return Box(
        pick(b.x_min, b.y_min, h - b.y_max, w - b.x_max),
        pick(b.y_min, w - b.x_max, b.x_min, h - b.y_max),
        pick(b.x_max, b.y_max, h - b.y_min, w - b.x_min),
        pick(b.y_max, w - b.x_min, b.x_max, h - b.y_min),
    )


def pad(b: Box, width, height, ratio: float = 0.12, min_pixels: int = 8) -> Box:
    pad_x = F.greatest(F.lit(min_pixels), (b.width * F.lit(ratio)).cast("int"))
    pad_y = F.greatest(F.lit(min_pixels), (b.height * F.lit(ratio)).cast("int"))
    return clamp(Box(b.x_min - pad_x, b.y_min - pad_y, b.x_max + pad_x, b.y_max + pad_y), width, height)


def expand_by_aspect(b: Box, width, height, padding: float) -> Box:
    """Grow flat boxes mostly upwards and tall boxes mostly sideways."""
    side = Box(b.x_min, b.y_min, b.x_min + F.greatest(F.lit(1), b.width), b.y_min + F.greatest(F.lit(1), b.height))
    flat, tall = b.aspect >= 2.2, b.aspect <= 0.45
    horizontal = F.when(flat, max(padding, 0.55)).when(tall, max(padding, 2.4)).otherwise(max(padding, 1.0))
    vertical = F.when(flat, max(padding, 2.4)).when(tall, max(padding, 0.55)).otherwise(max(padding, 1.0))
    grown = Box(
        (b.x_min - horizontal * side.width).cast("int"),
        (b.y_min - vertical * side.height).cast("int"),
        (b.x_max + horizontal * side.width).cast("int"),
        (b.y_max + vertical * side.height).cast("int"),
    )
    return clamp(grown, width, height)


def same_row(a: Box, b: Box, share: float = 0.35) -> Column:
    return axis_overlap(a.y_min, a.y_max, b.y_min, b.y_max) >= F.lit(share) * F.least(a.height, b.height)


def same_column(a: Box, b: Box, share: float = 0.35) -> Column:
    return axis_overlap(a.x_min, a.x_max, b.x_min, b.x_max) >= F.lit(share) * F.least(a.width, b.width)


def near_edge(b: Box, width, height, margin: int) -> Column:
    return (
        (b.x_min <= margin)
        | (b.y_min <= margin)
        | (b.x_max >= _c(width) - margin)
        | (b.y_max >= _c(height) - margin)
    )


def cap_size(b: Box, anchor: Box, width, height, ratio: float = 0.35) -> Box:
    """Shrink an oversize box and centre it on its anchor."""
    max_w = (_c(width) * F.lit(ratio)).cast("int")
    max_h = (_c(height) * F.lit(ratio)).cast("int")
    fits = (b.width <= max_w) & (b.height <= max_h)
    half_w = F.least(b.width, max_w) / F.lit(2)
    half_h = F.least(b.height, max_h) / F.lit(2)
    capped = clamp(
        Box(
            (anchor.center_x - half_w).cast("int"),
            (anchor.center_y - half_h).cast("int"),
            (anchor.center_x + half_w).cast("int"),
            (anchor.center_y + half_h).cast("int"),
        ),
        width,
        height,
    )
    return Box(*(F.when(fits, old).otherwise(new) for old, new in zip(b, capped)))


def clamp_detection(b: Box, width, height) -> Box:
    """Detector output: half-even rounding, both corners inside the frame."""
    def side(value, limit):
        return clip(F.rint(value.cast("double")).cast("int"), 0, _c(limit) - 1)

    return Box(side(b.x_min, width), side(b.y_min, height), side(b.x_max, width), side(b.y_max, height))


def from_points(points: Column, scale=1.0) -> Box:
    """Bounding box of a polygon given as an array of (x, y) structs, truncated to pixels."""
    def axis(name):
        return F.transform(points, lambda p: p[name].cast("double") / _c(scale))

    xs, ys = axis("x"), axis("y")
    return Box(
        F.array_min(xs).cast("int"),
        F.array_min(ys).cast("int"),
        F.array_max(xs).cast("int"),
        F.array_max(ys).cast("int"),
    )


def clip_label(b: Box, width, height) -> Box:
    """Label box inside the frame with inverted sides swapped (doubles)."""
    w, h = _c(width), _c(height)
    x1, x2 = (clip(v.cast("double"), 0.0, w - F.lit(1.0)) for v in (b.x_min, b.x_max))
    y1, y2 = (clip(v.cast("double"), 0.0, h - F.lit(1.0)) for v in (b.y_min, b.y_max))
    return Box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def training_line(b: Box, width, height, class_id: int = 0) -> Column:
    """``class cx cy w h`` in frame fractions."""
    w, h = _c(width), _c(height)
    fractions = (
        ((b.x_min + b.x_max) / F.lit(2.0)) / w,
        ((b.y_min + b.y_max) / F.lit(2.0)) / h,
        (b.x_max - b.x_min) / w,
        (b.y_max - b.y_min) / h,
    )
    return F.concat_ws(" ", F.lit(str(class_id)), *(fixed(f, 6) for f in fractions))


def center_similarity(a: Box, b: Box, factor) -> Column:
    dx, dy = a.center_x - b.center_x, a.center_y - b.center_y
    scale = F.greatest(F.lit(80.0), F.greatest(a.width, a.height, b.width, b.height).cast("double"))
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt(dx * dx + dy * dy) / (scale * _c(factor)))


def size_similarity(a: Box, b: Box) -> Column:
    def ratio(x, y):
        return F.least(x, y) / F.greatest(F.lit(1), F.greatest(x, y))

    return F.lit(0.5) * ratio(a.width, b.width) + F.lit(0.5) * ratio(a.height, b.height)


def match_score(predicted: Box, detected: Box, cfg: TrackConfig = TrackConfig()) -> Column:
    """How well a detection continues a track, 0 when it cannot."""
    edge = near_edge(predicted, cfg.frame_width, cfg.frame_height, cfg.edge_margin) | near_edge(
        detected, cfg.frame_width, cfg.frame_height, cfg.edge_margin
    )

    def score(p: Column, center: Column) -> Column:
        rejected = (p["overlap"] < F.when(p["edge"], 0.0).otherwise(cfg.min_match_iou)) & (
            center < F.when(p["edge"], 0.38).otherwise(0.55)
        )
        return (
            F.when(rejected, F.lit(0.0))
            .when(p["edge"], F.lit(0.45) * p["overlap"] + F.lit(0.45) * center + F.lit(0.10) * p["size"])
            .otherwise(F.lit(0.58) * p["overlap"] + F.lit(0.30) * center + F.lit(0.12) * p["size"])
        )

    def scored(p: Column) -> Column:
        factor = F.when(p["edge"], cfg.distance_factor * 1.9).otherwise(cfg.distance_factor)
        return let(center_similarity(predicted, detected, factor), lambda center: score(p, center))

    # Bound, as written out the parts would fill a method that Java no longer compiles.
    parts = F.struct(edge.alias("edge"), iou(predicted, detected).alias("overlap"), size_similarity(predicted, detected).alias("size"))
    return let(parts, scored)


def detection_quality(b: Box, score: Column, source: Column) -> Column:
    bonus = (
        F.when(source.contains("anchor"), 0.08).when(source == "promo_color_layout", 0.05).otherwise(F.lit(0.0))
    )
    area_bonus = F.least(b.area / F.lit(120000.0), F.lit(1.0)) * F.lit(0.08)
    penalty = F.when((b.aspect < 0.25) | (b.aspect > 5.5), 0.10).otherwise(F.lit(0.0))
    return score + bonus + area_bonus - penalty


def to_global(local: Box, padded: Box, width, height) -> Box:
    """Box found inside a crop, in frame coordinates."""
    return clamp(
        Box(
            local.x_min + padded.x_min,
            local.y_min + padded.y_min,
            local.x_max + padded.x_min,
            local.y_max + padded.y_min,
        ),
        width,
        height,
    )
