"""Overlap and interval joins between boxes, and enumerated hypotheses around a box."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgrid.config import TrackConfig
from shelfgrid.functions import geometry as g
from shelfgrid.functions.numbers import exact_round
from shelfgrid.functions.scores import bottom_band_color, dominant_color, white_region_gate, white_region_score
from shelfgrid.functions.text import normalize_ocr_digits
from shelfgrid.functions.values import file_stem, strip
from shelfgrid.operators.folds import fold_groups
from shelfgrid.operators.spatial import CELL, FRAME, cut_at_gaps, overlapping_pairs, renamed_box

SIDES = ["x_min", "y_min", "x_max", "y_max"]


def codes_to_frame(codes: DataFrame, boxes: DataFrame, width=3840, height=2160, padding=0.10, min_side=40) -> DataFrame:
    """Codes read inside padded crops of ``boxes``, moved to frame coordinates."""
    padded = g.expand(g.box(), width, height, padding, padding, padding, padding)
    crops = boxes.select(*FRAME, "box_id", *padded.columns("p_")).filter(
        (F.col("p_x_max") - F.col("p_x_min") >= min_side) & (F.col("p_y_max") - F.col("p_y_min") >= min_side)
    )
    moved = g.to_global(g.box(), g.box("p_"), width, height)
    return codes.join(crops, [*FRAME, "box_id"]).select(
        *FRAME, "box_id", "code_type", "value",
        F.least(F.lit(1.0), F.col("confidence") + F.lit(0.03)).alias("confidence"),
        F.concat(F.lit("crop_"), F.col("source")).alias("source"),
        *moved.columns(),
    )


def boost_with_text(candidates: DataFrame) -> DataFrame:
    """Rectangles that hold or overlap text regions become ``mixed`` and gain score."""
    keys = [*FRAME, "candidate_index"]
    rectangles = renamed_box(
        candidates.filter(F.col("source") == "rectangular_region").select(*keys, *SIDES), "l_"
    )
    # Copies of one box count together, so they meet each rectangle once.
    texts = renamed_box(candidates.filter(F.col("source") == "text_like_region"), "r_")
    texts = texts.groupBy(*FRAME, *(f"r_{s}" for s in SIDES)).agg(
        F.count("*").alias("copies"), F.max("text_density").alias("density")
    )
    a, b = g.box("l_"), g.box("r_")
    hits = (
        overlapping_pairs(rectangles, texts)
        .filter((g.contains_ratio(a, b) >= 0.45) | (g.iou(a, b) >= 0.10))
        .groupBy(*keys)
        .agg(F.sum("copies").cast("int").alias("text_regions_inside"), F.max("density").alias("max_density"))
    )
    hit = F.col("text_regions_inside").isNotNull() & (F.col("source") == "rectangular_region")
    boosted = F.least(
        F.lit(1.0), F.col("score") + (F.lit(0.15) + F.lit(0.20) * F.least(F.col("max_density"), F.lit(1.0)))
    )
    out = candidates.join(hits, keys, "left").withColumns(
        {
            "score": F.when(hit, boosted).otherwise(F.col("score")),
            "has_text": F.when(hit, True).otherwise(F.col("has_text")),
            "text_density": F.when(hit, F.greatest("text_density", "max_density")).otherwise(F.col("text_density")),
            "text_regions_inside": F.when(hit, F.col("text_regions_inside")),
        }
    )
    return out.withColumn("source", F.when(hit, "mixed").otherwise(F.col("source"))).drop("max_density")


def boost_with_codes(candidates: DataFrame, codes: DataFrame) -> DataFrame:
    """Candidates that hold or overlap decoded codes gain score and the code values."""
    keys = [*FRAME, "candidate_index"]
    left = renamed_box(candidates.select(*keys, *SIDES), "l_")
    right = renamed_box(codes, "r_").groupBy(*FRAME, "code_type", "value", *(f"r_{s}" for s in SIDES)).agg(
        F.min("code_index").alias("code_index")
    )
    a, b = g.box("l_"), g.box("r_")
    hits = (
        overlapping_pairs(left, right)
        .filter((g.contains_ratio(a, b) >= 0.65) | (g.iou(a, b) >= 0.10))
        .select(*keys, "value", "code_index", "code_type")
        .repartition(*keys)  # one shuffle serves both folds and the join with the candidates
        # One row per value first: a candidate over many reads of one code carries it once.
        .groupBy(*keys, "value")
        .agg(
            F.min("code_index").alias("at"), F.bool_or(F.col("code_type") == "qr").alias("qr"),
            F.bool_or(F.col("code_type") == "barcode").alias("barcode"),
        )
        .groupBy(*keys)
        .agg(
            F.bool_or("qr").alias("hit_qr"), F.bool_or("barcode").alias("hit_barcode"),
            F.collect_list(F.when(F.col("value") != "", F.struct("at", "value"))).alias("read"),
        )
    )
    new_values = F.transform(F.array_sort("read"), lambda r: r["value"])
    old_values = F.col("code_values") if "code_values" in candidates.columns else F.array().cast("array<string>")
    hit = F.col("hit_qr").isNotNull()
    boost = (
        F.lit(0.22) + F.when(F.col("hit_qr"), 0.08).otherwise(0.0) + F.when(F.col("hit_barcode"), 0.05).otherwise(0.0)
        + F.when(F.size("read") > 0, 0.08).otherwise(0.0)
    )
    return (
        candidates.join(hits, keys, "left")
        .withColumns(
            {
                "score": F.when(hit, F.least(F.lit(1.0), F.col("score") + boost)).otherwise(F.col("score")),
                "source": F.when(hit, "mixed").otherwise(F.col("source")),
                "has_qr": F.col("has_qr") | F.coalesce("hit_qr", F.lit(False)),
                "has_barcode": F.col("has_barcode") | F.coalesce("hit_barcode", F.lit(False)),
                "code_values": F.when(
                    hit, F.array_distinct(F.concat(F.coalesce(old_values, F.array().cast("array<string>")), new_values))
                ).otherwise(old_values),
                "code_inside": hit,
            }
        )
        .drop("hit_qr", "hit_barcode", "read")
    )


class _BandFold:
    """Running union of a white box with the colour bands it accepts, in band order."""

    def __init__(self, width: int, height: int):
        self.frame = (width, height)
        self.keys = self.area = self.box = None
        self.sides: list[str] = []

    def push(self, row):
        keys, white, band, side = row[:3], row[3:7], row[7:11], row[12]
        if self.box is None:
            self.keys, self.box = keys, list(white)
            self.area = max(0, white[2] - white[0]) * max(0, white[3] - white[1])
        width, height = self.frame
        x1 = min(max(min(self.box[0], band[0]), 0), width - 1)
        y1 = min(max(min(self.box[1], band[1]), 0), height - 1)
        x2 = min(max(max(self.box[2], band[2]), x1 + 1), width)
        y2 = min(max(max(self.box[3], band[3]), y1 + 1), height)
        if (x2 - x1) * (y2 - y1) <= self.area * 2.8:
            self.box = [x1, y1, x2, y2]
            if side not in self.sides:
                self.sides.append(side)
        return ()

    def finish(self):
        yield (*self.keys, *self.box, ",".join(self.sides))


def extend_to_color_band(white: DataFrame, color: DataFrame, width: int = 3840, height: int = 2160) -> DataFrame:
    """White boxes grown over adjacent coloured bands; bands are tried in region order."""
    keys = [*FRAME, "region_index"]
    b = g.box("b_")
    left = renamed_box(white.select(*keys, *SIDES), "b_")
    reach_x = F.greatest(F.lit(8), (b.width * F.lit(0.15)).cast("int"))
    reach_y = F.greatest(F.lit(8), (b.height * F.lit(0.25)).cast("int"))
    left = left.withColumns(
        {
            "l_x_min": b.x_min - reach_x - 1, "l_y_min": b.y_min - reach_y - 1,
            "l_x_max": b.x_max + reach_x + 1, "l_y_max": b.y_max + reach_y + 1,
        }
    )
    c = g.box("r_")
    kind = dominant_color(F.col("red_ratio"), F.col("yellow_ratio"))
    right = renamed_box(color, "r_").filter((c.width >= 15) & (c.height >= 8) & (kind != "none"))
    right = right.groupBy(*FRAME, *(f"r_{s}" for s in SIDES)).agg(F.min("region_index").alias("band_index"))

    cover_x = g.axis_overlap(b.x_min, b.x_max, c.x_min, c.x_max) / F.greatest(F.lit(1), b.width)
    cover_y = g.axis_overlap(b.y_min, b.y_max, c.y_min, c.y_max) / F.greatest(F.lit(1), b.height)
    part_x, part_y = (b.width * F.lit(0.45)).cast("int"), (b.height * F.lit(0.45)).cast("int")
    wide = (cover_x >= 0.55) & (c.aspect >= 1.0)
    tall = (cover_y >= 0.45) & (c.height >= c.width * F.lit(0.5))
    side = (
        F.when((c.y_min - b.y_max <= reach_y) & (c.y_max >= b.y_min + part_y) & wide, "bottom")
        .when((b.y_min - c.y_max <= reach_y) & (c.y_min <= b.y_max - part_y) & wide, "top")
        .when((c.x_min - b.x_max <= reach_x) & (c.x_max >= b.x_min + part_x) & tall, "right")
        .when((b.x_min - c.x_max <= reach_x) & (c.x_min <= b.x_max - part_x) & tall, "left")
    )
    pairs = overlapping_pairs(left, right).withColumn("side", side).filter(F.col("side").isNotNull())
    pairs = pairs.select(*keys, *b.columns("b_"), *c.columns("r_"), "band_index", "side")
    grown = fold_groups(
        pairs, keys, [F.col("band_index")], lambda: _BandFold(width, height),
        "video_id string, frame_index int, region_index int, e_x_min int, e_y_min int, e_x_max int, e_y_max int, sides string",
    )
    out = white.join(grown, keys, "left")
    return out.withColumns(
        {s: F.coalesce(F.col(f"e_{s}"), F.col(s)) for s in SIDES}
        | {"extended": F.coalesce(F.col("sides") != "", F.lit(False)), "extension_sides": F.coalesce("sides", F.lit(""))}
    ).drop(*(f"e_{s}" for s in SIDES), "sides")


def score_white_regions(regions: DataFrame, width: int = 3840, height: int = 2160) -> DataFrame:
    """White regions passing their gates, extended to adjacent bands and scored."""
    clamped = g.clamp(g.box(), width, height)
    rows = regions.select(*(c for c in regions.columns if c not in SIDES), *clamped.columns())
    white = rows.filter(F.col("kind") == "white").withColumn("ratio", g.box().area / F.lit(width * height))
    white = white.filter(white_region_gate(g.box(), F.col("ratio")))
    grown = extend_to_color_band(white, rows.filter(F.col("kind") == "color"), width, height)
    bottom = bottom_band_color(F.col("red_ratio"), F.col("yellow_ratio"))
    side = dominant_color(F.col("red_ratio"), F.col("yellow_ratio"))
    return grown.select(
        *FRAME, "region_index", F.lit("color_region").alias("source"),
        white_region_score(F.col("extended"), bottom, side).alias("score"), *SIDES,
        bottom.alias("bottom_band_color"), side.alias("side_band_color"), "extended",
        exact_round(F.col("white_ratio"), 4).alias("white_ratio"),
        exact_round(F.col("rectangularity"), 4).alias("rectangularity"),
        exact_round(g.box().area / F.lit(width * height), 5).alias("area_ratio"),
    )


def pair_color_white(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Best neighbouring (colour, white) pair per crop and the padded region around it."""
    b = g.box()
    inside = ~g.near_edge(b, width, height, 4) & (b.width >= 12) & (b.height >= 10)
    color = boxes.filter((F.col("kind") == "color") & inside & (b.area >= max(120, int(width * height * 0.003))))
    white = boxes.filter(
        (F.col("kind") == "white") & inside
        & b.area.between(max(180, int(width * height * 0.006)), int(width * height * 0.42))
        & ~((b.width >= int(0.72 * width)) & (b.height >= int(0.72 * height)))
    )

    def unique(df: DataFrame, prefix: str) -> DataFrame:
        named = renamed_box(df, prefix)
        return named.groupBy(*FRAME, *(f"{prefix}{s}" for s in SIDES)).agg(F.min("region_index").alias(f"{prefix}index"))

    c, w = g.box("c_"), g.box("r_")
    grow_x = F.greatest(F.lit(14), (c.width * F.lit(0.75)).cast("int")) + 1
    grow_y = F.greatest(F.lit(14), (c.height * F.lit(0.75)).cast("int")) + 1
    left = unique(color, "c_").withColumns(
        {"l_x_min": c.x_min - grow_x, "l_y_min": c.y_min - grow_y, "l_x_max": c.x_max + grow_x, "l_y_max": c.y_max + grow_y}
    )

    def ratio(p, q):
        return F.greatest(p, q) / F.greatest(F.lit(1), F.least(p, q))

    def gap(p_min, p_max, q_min, q_max):
        return F.greatest(F.lit(0), F.greatest(p_min, q_min) - F.least(p_max, q_max))

    def max_gap(p, q):
        return F.greatest(F.lit(14), (F.least(p, q) * F.lit(0.75)).cast("int"))

    close = ratio(c.area, w.area) <= 5.5
    in_row = (
        g.same_row(c, w) & (ratio(c.height, w.height) <= 3.2)
        & (gap(c.x_min, c.x_max, w.x_min, w.x_max) <= max_gap(c.width, w.width))
    )
    in_column = (
        g.same_column(c, w) & (ratio(c.width, w.width) <= 3.2)
        & (gap(c.y_min, c.y_max, w.y_min, w.y_max) <= max_gap(c.height, w.height))
    )
    both = g.union(c, w)
    compact = (c.area + w.area) / F.greatest(F.lit(1), (both.x_max - both.x_min) * (both.y_max - both.y_min))
    pairs = overlapping_pairs(left, unique(white, "r_")).filter(close & (in_row | in_column) & (compact >= 0.32))
    best = pairs.groupBy(*FRAME).agg(
        F.max_by(
            F.struct(*c.columns("c_"), *w.columns("r_"), "c_index", "r_index"),
            F.struct(((c.area + w.area) * compact).alias("s"), (-F.col("c_index")).alias("c"), (-F.col("r_index")).alias("w")),
        ).alias("p")
    )
    rows = best.select(*FRAME, "p.*")

    def part(share: float, size):
        return (F.lit(share) * size).cast("int")

    roi_w, roi_h = both.x_max - both.x_min, both.y_max - both.y_min
    pad_x, pad_y = F.greatest(F.lit(14), part(0.26, roi_w)), F.greatest(F.lit(12), part(0.34, roi_h))
    column, row = g.same_column(c, w), g.same_row(c, w)
    block_h, block_w = F.greatest(c.height, w.height), F.greatest(c.width, w.width)
    above, left_of = w.center_y < c.center_y, w.center_x < c.center_x
    pad_y = F.when(column, F.greatest(pad_y, part(1.05, block_h))).when(row, F.greatest(pad_y, part(0.58, block_h))).otherwise(pad_y)
    pad_x = F.when(column, F.greatest(pad_x, part(0.48, block_w))).when(row, F.greatest(pad_x, part(1.0, block_w))).otherwise(pad_x)
    up = F.when(column, F.when(above, part(0.95, block_h)).otherwise(part(0.35, block_h))).otherwise(0)
    down = F.when(column, F.when(above, part(0.35, block_h)).otherwise(part(0.95, block_h))).otherwise(0)
    row_only = row & ~column
    west = F.when(row_only, F.when(left_of, part(0.9, block_w)).otherwise(part(0.4, block_w))).otherwise(0)
    east = F.when(row_only, F.when(left_of, part(0.4, block_w)).otherwise(part(0.9, block_w))).otherwise(0)
    return rows.select(
        *FRAME, F.col("c_index").alias("color_index"), F.col("r_index").alias("white_index"),
        F.greatest(F.lit(0), both.x_min - west - pad_x).alias("x_min"),
        F.greatest(F.lit(0), both.y_min - up - pad_y).alias("y_min"),
        F.least(F.lit(width), both.x_max + east + pad_x).alias("x_max"),
        F.least(F.lit(height), both.y_max + down + pad_y).alias("y_max"),
    )


def pair_rub_kop(words: DataFrame, key: str = "tag_id", cell: int = CELL) -> DataFrame:
    """Scored prices from tall rouble words with small kopeck words to their right, and compact digit words."""
    digits = F.regexp_replace(normalize_ocr_digits(F.col("text")), "[^0-9]", "")
    rows = words.select(key, "word_seq", digits.alias("digits"), *SIDES).filter(F.col("digits") != "")
    b = g.box()
    medians = rows.filter(F.length("digits") >= 2).groupBy(key).agg(F.percentile(b.height, F.lit(0.5)).alias("median_height"))
    rub = rows.filter(F.length("digits").between(2, 5) & (F.col("digits").try_cast("int") >= 10)).join(medians, key)
    median = F.greatest(F.col("median_height"), F.lit(1.0))
    cents = F.col("digits").try_cast("int")

    compact = rub.filter((F.length("digits") >= 4) & (cents >= 1000)).select(
        key, "word_seq", F.lit(-1).alias("kop_seq"), cents.alias("cents"),
        (F.lit(0.45) + F.least(b.height / median, F.lit(2.0)) * F.lit(0.12)).alias("score"),
        F.lit("word_compact").alias("source"), *SIDES,
    )

    r, k = g.box("l_"), g.box("r_")
    reach = F.greatest(F.lit(12), (r.height * F.lit(2.8)).cast("int"))
    left = renamed_box(rub.withColumnRenamed("digits", "rub"), "l_")
    # The left edge and mid-height of the kopeck word must fall in a window beside the rouble word.
    xs = F.sequence(F.floor(r.center_x / cell), F.floor((r.x_max + reach) / cell))
    ys = F.sequence(F.floor((r.y_min - r.height) / cell), F.floor((r.y_max + r.height) / cell))
    left = left.filter(r.center_x <= r.x_max + reach).withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))
    right = renamed_box(
        rows.filter(F.length("digits") == 2).select(
            key, F.col("word_seq").alias("kop_seq"), F.col("digits").alias("kop"), *SIDES
        ), "r_",
    ).withColumn("cell_x", F.floor(k.x_min / F.lit(cell))).withColumn("cell_y", F.floor(k.center_y / F.lit(cell)))
    beside = (
        (k.x_min >= r.center_x) & (k.x_min - r.x_max <= reach)
        & (k.center_y <= r.y_max + r.height * F.lit(0.45)) & (k.center_y >= r.y_min - r.height * F.lit(0.80))
        & (k.height <= r.height * F.lit(1.25)) & (F.col("kop_seq") != F.col("word_seq"))
    )
    score = (
        F.lit(0.65) + F.when(r.height >= F.col("median_height") * F.lit(1.4), 0.20).otherwise(0.0)
        + F.when(k.x_min >= r.x_max - (F.lit(0.10) * r.width).cast("int"), 0.10).otherwise(0.0)
        + F.greatest(F.lit(0.0), F.lit(0.10) - F.abs(k.center_y - r.center_y) / F.greatest(r.height * F.lit(6.0), F.lit(1.0)))
    )
    paired = left.join(right, [key, "cell_x", "cell_y"]).filter(beside).select(
        key, "word_seq", "kop_seq", F.concat("rub", "kop").try_cast("int").alias("cents"), score.alias("score"),
        F.lit("rub_kop_pair").alias("source"), *g.union(r, k).columns(),
    )
    return compact.unionByName(paired)


class _LabelMatchFold:
    """Detections in order take their best unused label; the state is the labels used in one segment."""

    def __init__(self):
        self.used: set = set()
        self.current = None

    def push(self, row):
        video, _, frame, candidate, label, overlap = row
        if (frame, candidate) == self.current or label in self.used:
            return ()
        self.current = (frame, candidate)
        self.used.add(label)
        return ((video, frame, candidate, label, overlap),)

    def finish(self):
        return ()


def match_labels(
    detections: DataFrame, labels: DataFrame, max_delta_ms: float = 2000.0, min_iou: float = 0.25
) -> DataFrame:
    """Greedy one-to-one matching of detections, in order, with labels near in time."""
    left = renamed_box(detections.select("video_id", "frame_index", "candidate_index", "timestamp_ms", *SIDES), "l_")
    # A bucket is so wide that most labels reach into one only: a copy in another one is shuffled too.
    wide = F.lit(4.0 * max_delta_ms)
    left = left.withColumn("bucket", F.floor(F.col("timestamp_ms") / wide))
    # Labels more than two windows apart share no detection, so a video is cut there.
    right = cut_at_gaps(labels.select("video_id", "label_id", "frame_timestamp", *SIDES), ["video_id"], "frame_timestamp", 2 * max_delta_ms)
    first, last = (F.floor((F.col("frame_timestamp") + F.lit(k * 1.01 * max_delta_ms)) / wide) for k in (-1, 1))
    right = renamed_box(right, "r_").withColumn("bucket", F.explode(F.sequence(first, last)))
    pairs = overlapping_pairs(left, right, ["video_id", "bucket"]).filter(
        F.abs(F.col("frame_timestamp") - F.col("timestamp_ms")) <= max_delta_ms
    )
    # A detection meets its labels by falling overlap, so those below the threshold change nothing.
    pairs = pairs.withColumn("iou", g.iou(g.box("l_"), g.box("r_"))).filter(F.col("iou") >= min_iou)
    pairs = pairs.select("video_id", "segment", "frame_index", "candidate_index", "label_id", "iou")
    return fold_groups(
        pairs, ["video_id", "segment"], [F.col("frame_index"), F.col("candidate_index"), F.col("iou").desc(), F.col("label_id")],
        _LabelMatchFold,
        "video_id string, frame_index int, candidate_index int, label_id int, match_iou double",
    )


def label_eval(detections: DataFrame, labels: DataFrame, matches: DataFrame) -> DataFrame:
    """True/false positives and misses per video."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("video_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))

    parts = counted(detections, "det").unionByName(counted(labels, "lab")).unionByName(counted(matches, "tp"))
    n = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in ("det", "lab", "tp")}
    sums = parts.groupBy("video_id").agg(n["det"].alias("det"), n["lab"].alias("lab"), n["tp"].alias("tp"))
    return sums.select(
        "video_id", "tp", (F.col("det") - F.col("tp")).alias("fp"), (F.col("lab") - F.col("tp")).alias("fn"),
        F.when(F.col("det") > 0, F.col("tp") / F.col("det")).alias("precision"),
        F.when(F.col("lab") > 0, F.col("tp") / F.col("lab")).alias("recall"),
    )


def unmatched(rows: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(matches.select(*keys), keys, "left_anti")


def matched(rows: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(matches.select(*keys), keys, "left_semi")


def pair_successors(detections: DataFrame, cfg: TrackConfig = TrackConfig(), cell: int = 1024) -> DataFrame:
    """Detections that could continue another one within the frame gap, with their match score."""
    span = cfg.max_frame_gap
    # Boxes apart score 0.45 of their nearness and at most 0.10 for their sizes, at a frame's edge; elsewhere they must be nearer.
    reach_factor = (1.0 - min(0.38, max(0.0, cfg.min_match_score - 0.10) / 0.45) + 1e-6) * cfg.distance_factor * 1.9

    def prepared(df: DataFrame, p: str) -> DataFrame:
        rows = renamed_box(
            df.select(
                "video_id", F.col("frame_index").alias(f"{p}frame"), F.col("candidate_index").alias(f"{p}candidate"), *SIDES
            ), p,
        )
        b = g.box(p)
        scale = F.greatest(F.lit(80), b.width, b.height)
        reach = (scale * F.lit(reach_factor)).cast("int") + 1
        # Whichever box is larger reaches the centre of the other one. Rows meet by columns of cells: reaching over rows of
        # cells too would copy a box several times more, for pairs that the distance rules out as well.
        xs = F.sequence(F.floor((b.center_x - reach) / cell), F.floor((b.center_x + reach) / cell))
        return rows.withColumn("cell_x", F.explode(xs))

    left = prepared(detections, "l_")
    bucket = F.floor(F.col("l_frame") / span)
    left = left.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    right = prepared(detections, "r_").withColumn("bucket", F.floor(F.col("r_frame") / span))
    a, b = g.box("l_"), g.box("r_")
    l_scale, r_scale = (F.greatest(F.lit(80), box.width, box.height) for box in (a, b))
    home = F.col("cell_x") == F.floor(F.when(r_scale <= l_scale, b.center_x).otherwise(a.center_x) / cell)
    reach = F.greatest(l_scale, r_scale) * F.lit(reach_factor) + 1
    near = (F.abs(a.center_x - b.center_x) <= reach) & (F.abs(a.center_y - b.center_y) <= reach)
    gap = F.col("r_frame") - F.col("l_frame")
    pairs = left.join(right, ["video_id", "bucket", "cell_x"]).filter((gap > 0) & (gap <= span) & home & near)
    score = g.match_score(g.box("l_"), g.box("r_"), cfg)
    return pairs.withColumn("match_score", score).filter(F.col("match_score") >= cfg.min_match_score).select(
        "video_id", F.col("l_frame").alias("frame_index"), F.col("l_candidate").alias("candidate_index"),
        F.col("r_frame").alias("next_frame"), F.col("r_candidate").alias("next_candidate"), "match_score",
    )


def match_video(label_files: DataFrame, videos: DataFrame, strict: bool = True) -> DataFrame:
    """Label files joined to videos by file stem; a label file without a video is an error."""
    files = label_files.withColumn("stem", strip(file_stem(F.col("label_path"))))
    found = files.join(videos.withColumn("stem", file_stem(F.col("video_path"))), "stem", "left")
    if not strict:
        return found.filter(F.col("video_path").isNotNull())
    missing = F.raise_error(F.concat(F.lit("no video for "), F.col("label_path"))).cast("string")
    return found.withColumn("video_path", F.coalesce(F.col("video_path"), missing))


def join_track_boxes(track_detections: DataFrame, tracks: DataFrame) -> DataFrame:
    """Boxes of known tracks with their centres and the position in the track's trail."""
    b = g.box()
    rows = track_detections.join(tracks.select("video_id", "track_id"), ["video_id", "track_id"], "left_semi")
    trail = Window.partitionBy("video_id", "track_id").orderBy("frame_index", "candidate_index")
    return rows.select(
        "video_id", "track_id", "frame_index", "candidate_index", *SIDES,
        b.center_x.cast("int").alias("center_x"), b.center_y.cast("int").alias("center_y"),
        F.row_number().over(trail).alias("trail_position"),
    )


# Sides (left, top, right, bottom) by which a code box grows into tag hypotheses.
ANCHOR_PRESETS = (
    (4.0, 0.8, 0.8, 3.0), (4.0, 3.0, 0.8, 0.8), (2.5, 0.8, 2.5, 3.5), (2.5, 3.5, 2.5, 0.8), (1.8, 1.8, 1.8, 1.8),
)

# Fixed values: (near side, top, far side, bottom) growth of a colour component into tag layouts.
LAYOUT_PRESETS = (
    (-0.00, -0.00, 0.80, 0.00), (-0.00, -0.00, 0.90, 0.00), (-0.00, 0.10, 0.80, -0.10), (-0.10, 0.40, 0.90, -0.40),
    (-0.00, -0.00, 0.70, 0.00), (-0.00, -0.00, 0.80, 0.10), (-0.10, -0.00, 0.80, 0.00), (-0.10, 0.10, 0.90, -0.10),
    (-0.00, 0.20, 0.80, -0.20), (0.10, 0.10, 1.00, 0.10), (0.10, 0.10, 1.10, 0.10), (-0.10, 0.40, 0.90, -0.50),
    (-0.10, -0.10, 0.90, 0.10), (-0.00, -0.00, 0.90, 0.10), (-0.10, -0.20, 0.90, 0.00), (-0.10, -0.10, 0.80, 0.10),
    (0.10, -0.20, 1.00, 0.20), (0.10, -0.20, 1.10, 0.30), (-0.00, -0.20, 1.10, 0.20), (0.12, 0.10, 0.95, 0.06),
    (0.12, 0.10, 1.05, 0.06), (0.12, 0.10, 1.15, 0.06), (0.12, 0.10, 1.28, 0.06), (0.00, 0.06, 0.72, -0.10),
    (0.00, 0.06, 0.85, -0.10), (0.00, 0.05, 0.72, 0.05), (-0.07, -0.01, 0.75, -0.01), (0.00, 0.05, 0.85, 0.00),
    (0.00, 0.00, 0.76, 0.00), (0.08, 0.10, 0.72, -0.12), (0.25, 0.05, 1.00, 0.05), (0.20, 0.10, 1.05, 0.16),
)
VERTICAL_RATIOS = (0.85, 1.05, 1.25)


def layout_growth() -> list[tuple[float, float, float, float]]:
    """All (left, top, right, bottom) growths: presets, their mirror images, then downwards and upwards."""
    forward = [(near, top, far, bottom) for near, top, far, bottom in LAYOUT_PRESETS]
    mirrored = [(far, top, near, bottom) for near, top, far, bottom in LAYOUT_PRESETS]
    down = [(0.08, 0.10, 0.08, r) for r in VERTICAL_RATIOS]
    up = [(0.08, r, 0.08, 0.10) for r in VERTICAL_RATIOS]
    return forward + mirrored + down + up


def _as_struct(b: g.Box):
    return F.struct(*b.columns())


def distinct_boxes(boxes, threshold: float):
    """Drop, in array order, every box that overlaps an earlier kept one at ``threshold`` IoU."""
    def repeats(kept, box):
        return F.exists(kept, lambda k: g.iou(g.box_of(k), g.box_of(box)) >= threshold)

    return F.aggregate(
        boxes, F.filter(boxes, lambda b: F.lit(False)),
        lambda kept, b: F.when(repeats(kept, b), kept).otherwise(F.concat(kept, F.array(b))),
    )


def _grown(growth, b: g.Box, width: int, height: int):
    presets = F.array(
        *(F.struct(*(F.lit(v).alias(n) for v, n in zip(p, ("left", "top", "right", "bottom")))) for p in growth)
    )
    return F.transform(
        presets, lambda p: _as_struct(g.expand(b, width, height, p["left"], p["top"], p["right"], p["bottom"]))
    )


def _kept_presets(growth, width: int, height: int, threshold: float, most: float | None = None):
    """Pandas UDF: the grown boxes that repeat no earlier kept one, four sides after each other, per component.

    Boxes larger than the share ``most`` of the frame shrink to it around the component's centre first.
    """
    presets = np.array(growth)

    @F.pandas_udf("array<int>")
    def kept(x_min: pd.Series, y_min: pd.Series, x_max: pd.Series, y_max: pd.Series) -> pd.Series:
        x1, y1, x2, y2 = (s.to_numpy(dtype=np.float64)[:, None] for s in (x_min, y_min, x_max, y_max))
        w, h = np.maximum(x2 - x1, 0), np.maximum(y2 - y1, 0)
        left, top, right, bottom = presets.T
        bx1 = np.clip(np.trunc(x1 - left * w), 0, width - 1)
        by1 = np.clip(np.trunc(y1 - top * h), 0, height - 1)
        bx2 = np.clip(np.trunc(x2 + right * w), bx1 + 1, width)
        by2 = np.clip(np.trunc(y2 + bottom * h), by1 + 1, height)
        if most is not None:
            wide, high = int(width * most), int(height * most)
            fits = (bx2 - bx1 <= wide) & (by2 - by1 <= high)
            half_w, half_h = np.minimum(bx2 - bx1, wide) / 2, np.minimum(by2 - by1, high) / 2
            center_x, center_y = (x1 + x2) / 2.0, (y1 + y2) / 2.0
            cx1, cy1 = np.clip(np.trunc(center_x - half_w), 0, width - 1), np.clip(np.trunc(center_y - half_h), 0, height - 1)
            cx2, cy2 = np.clip(np.trunc(center_x + half_w), cx1 + 1, width), np.clip(np.trunc(center_y + half_h), cy1 + 1, height)
            bx1, by1, bx2, by2 = (np.where(fits, old, new) for old, new in zip((bx1, by1, bx2, by2), (cx1, cy1, cx2, cy2)))
        area = (bx2 - bx1) * (by2 - by1)
        keep = np.ones(area.shape, dtype=bool)
        for i in range(1, presets.shape[0]):
            inter = np.clip(np.minimum(bx2[:, :i], bx2[:, i : i + 1]) - np.maximum(bx1[:, :i], bx1[:, i : i + 1]), 0, None)
            inter = inter * np.clip(
                np.minimum(by2[:, :i], by2[:, i : i + 1]) - np.maximum(by1[:, :i], by1[:, i : i + 1]), 0, None
            )
            overlap = inter / (area[:, :i] + area[:, i : i + 1] - inter)
            keep[:, i] = ~((overlap >= threshold) & keep[:, :i]).any(axis=1)
        sides = np.stack((bx1, by1, bx2, by2), axis=2).astype(np.int32)
        return pd.Series([box[row].ravel() for box, row in zip(sides, keep)])

    return kept


def anchor_hypotheses(codes: DataFrame, width: int = 3840, height: int = 2160) -> DataFrame:
    """Tag boxes guessed around each decoded code."""
    b = g.box()
    sides = _kept_presets(ANCHOR_PRESETS, width, height, 0.85, 0.35)(*(F.coalesce(c, F.lit(0)) for c in b))
    numbers = F.sequence(F.lit(0), (F.size("sides") / 4).cast("int") - 1)
    boxes = F.transform(numbers, lambda n: F.struct(*(F.col("sides")[n * 4 + i].alias(s) for i, s in enumerate(SIDES))))
    # A box without all its sides is left to the column expressions, which pass the missing ones on.
    known = F.lit(True)
    for c in b:
        known = known & c.isNotNull()
    guessed = F.transform(_grown(ANCHOR_PRESETS, b, width, height), lambda s: _as_struct(g.cap_size(g.box_of(s), b, width, height, 0.35)))
    rows = codes.withColumn("sides", sides).withColumn("boxes", F.when(known, boxes).otherwise(distinct_boxes(guessed, 0.85)))
    rows = rows.select(
        *FRAME, "code_index", "code_type", "value", b.columns("anchor_")[0], *b.columns("anchor_")[1:],
        F.posexplode("boxes").alias("anchor_hypothesis", "box"),
    )
    base = F.when(F.col("code_type") == "qr", 0.95).otherwise(0.88)
    return rows.select(
        *FRAME, "code_index", "anchor_hypothesis", F.concat("code_type", F.lit("_anchor")).alias("source"), "value",
        g.clip(base - F.col("anchor_hypothesis") * F.lit(0.06), 0.0, 1.0).alias("score"), "box.*",
        *(f"anchor_{s}" for s in SIDES),
    )


def layout_hypotheses(components: DataFrame, width: int = 3840, height: int = 2160) -> DataFrame:
    """Tag boxes guessed around each colour component, deduplicated, gated and scored."""
    frame = width * height
    clamped = g.clamp(g.box(), width, height)
    rows = components.select(*(c for c in components.columns if c not in SIDES), *clamped.columns())
    b = g.box()
    rows = rows.filter(
        (b.width >= 28) & (b.height >= 22) & (b.area / F.lit(frame)).between(0.00025, 0.035)
        & b.aspect.between(0.18, 3.20) & (F.col("rectangularity") >= 0.28)
    )
    rows = rows.withColumn("kept", _kept_presets(layout_growth(), width, height, 0.995)(*b))
    color = dominant_color(F.col("red_ratio"), F.col("yellow_ratio"))
    color = F.when(color == "none", F.col("component_color")).otherwise(color)
    numbers = F.sequence(F.lit(0), (F.size("kept") / 4).cast("int") - 1)
    boxes = F.transform(numbers, lambda n: F.struct(*(F.col("kept")[n * 4 + i].alias(s) for i, s in enumerate(SIDES))))
    # Only a row's own box goes with it: the array of all of them would be copied into each.
    rows = rows.select(
        *FRAME, F.col("region_index").alias("layout_component_id"), "rectangularity", color.alias("color_band_kind"),
        *b.columns("component_"), F.posexplode(boxes).alias("layout_hypothesis", "box"),
    ).select("*", "box.*").drop("box")
    share = g.box("component_").area / F.greatest(F.lit(1), b.area)
    ratio = b.area / F.lit(frame)
    rows = rows.filter(
        (b.width >= 45) & (b.height >= 30) & ratio.between(0.00045, 0.09) & b.aspect.between(0.25, 5.80) & share.between(0.12, 0.72)
    )
    score = F.lit(0.58) + F.lit(0.12) * F.col("rectangularity")
    score = score + F.when(F.col("color_band_kind") == "red", 0.06).otherwise(0.0)
    score = score + F.when(share.between(0.22, 0.55), 0.08).otherwise(0.0)
    return rows.select(
        *FRAME, "layout_component_id", "layout_hypothesis", F.lit("promo_color_layout").alias("source"),
        g.clip(score, 0.0, 0.82).alias("score"), *SIDES, "color_band_kind", *(f"component_{s}" for s in SIDES),
        exact_round(F.col("rectangularity"), 4).alias("rectangularity"), exact_round(share, 4).alias("color_coverage"),
        exact_round(ratio, 5).alias("area_ratio"),
    )
