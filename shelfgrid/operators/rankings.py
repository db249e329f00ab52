"""Rankings, windows, top-k and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgrid.config import TrackConfig
from shelfgrid.functions import geometry as g
from shelfgrid.functions.scores import is_promising, ocr_candidate_score, promo_score
from shelfgrid.operators.greedy import ensure_checkpoint_dir

SIDES = ["x_min", "y_min", "x_max", "y_max"]


def best_frame_per_window(
    frames: DataFrame, window_sec: float = 1.0, min_quality: float = 0.25, max_frames: int | None = None
) -> DataFrame:
    """Best frame of every time window of a video; the earliest wins ties."""
    size = max(1.0, window_sec * 1000.0)
    best = frames.groupBy("video_id", F.floor(F.col("timestamp_ms") / F.lit(size)).alias("window_id")).agg(
        F.max_by(
            F.struct("frame_index", "timestamp_ms", "quality_score"),
            F.struct(F.col("quality_score"), (-F.col("frame_index")).alias("f")),
        ).alias("best")
    )
    rows = best.select("video_id", "window_id", "best.*").filter(F.col("quality_score") >= min_quality)
    if max_frames is None:
        return rows
    in_time = Window.partitionBy("video_id").orderBy("window_id")
    return rows.withColumn("rk", F.row_number().over(in_time)).filter(F.col("rk") <= max_frames).drop("rk")


def top_candidates_per_frame(candidates: DataFrame, limit: int = 30) -> DataFrame:
    """Best ``limit`` boxes of a frame, renumbered from 0; Spark cuts each task's rows before the shuffle."""
    ranked = Window.partitionBy("video_id", "frame_index").orderBy(F.col("score").desc(), "candidate_index")
    rows = candidates.withColumn("rk", F.row_number().over(ranked)).filter(F.col("rk") <= limit)
    return rows.withColumn("candidate_index", F.col("rk") - 1).drop("rk")


def rank_promising(candidates: DataFrame, max_detections: int | None = None, max_crops: int | None = None) -> DataFrame:
    """The promising boxes by priority; optionally among the first ``max_detections`` and at most ``max_crops`` (the service: 200, 60)."""
    b, source, score = g.box(), F.col("source"), F.col("score")
    priority = (
        F.when(source.contains("anchor"), 3.0).when(source == "promo_color_layout", 2.0)
        .when((source == "mixed") & (b.area <= 180_000), 1.0).otherwise(0.0)
    )
    order = [
        priority.desc(), score.desc(), F.least(b.area / F.lit(500_000.0), F.lit(1.0)).asc(),
        F.col("video_id"), F.col("frame_index"), F.col("candidate_index"),
    ]
    looked_at = candidates if max_detections is None else candidates.orderBy(*order).limit(max_detections)
    found = looked_at.filter(is_promising(b, source, score)).orderBy(*order)
    return found if max_crops is None else found.limit(max_crops)


def best_ocr_variant(variants: DataFrame, key: str = "tag_id", order: str = "variant_index") -> DataFrame:
    """Best-scored text per tag, the first variant on ties."""
    rest = [c for c in variants.columns if c != key]
    score = ocr_candidate_score(F.col("raw_text"), F.col("confidence"), F.col("variant"))
    rows = variants.withColumn("ocr_score", score)
    best = rows.groupBy(key).agg(
        F.max_by(F.struct("ocr_score", *rest), F.struct(F.col("ocr_score"), *_negated(rows, order))).alias("b")
    )
    return best.select(key, "b.*")


def _negated(df: DataFrame, *names: str) -> list[Column]:
    return [(-F.col(n)).alias(f"neg_{n}") for n in names]


def best_promo_result(results: DataFrame, key: str = "tag_id", order: str = "orientation_index") -> DataFrame:
    """Highest promo score per tag, the first variant on ties."""
    score = promo_score(*(F.col(c) for c in ("confidence", "price_card", "price_default", "discount_amount", "variant")))
    rows = results.withColumn("promo_score", score)
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(F.col("promo_score"), *_negated(rows, order))).alias("b")
    )
    return best.select(key, "b.*")


def choose_orientation(results: DataFrame, key: str = "tag_id", order: str = "orientation_index") -> DataFrame:
    """Best orientation up to the first confident one with a card price; later ones were never tried."""
    def has(name: str) -> Column:
        return F.coalesce(F.col(name) != "", F.lit(False))

    stop = results.groupBy(key).agg(
        F.min(F.when((F.col("confidence") >= 0.82) & has("price_card"), F.col(order))).alias("stop_at")
    )
    tried = results.join(stop, key).filter(F.col("stop_at").isNull() | (F.col(order) <= F.col("stop_at")))
    rest = [c for c in results.columns if c != key]
    rank = F.struct(
        F.col("confidence"), has("price_card").alias("c"), has("price_default").alias("d"),
        has("discount_amount").alias("p"), *_negated(results, order),
    )
    best = tried.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("b"))
    return best.select(key, "b.*")


TRACK = ["video_id", "track_id"]


def _track_window():
    return Window.partitionBy(*TRACK).orderBy("frame_index", "candidate_index")


def smoothed_box(track_detections: DataFrame) -> DataFrame:
    """Mean of the last three boxes of a track."""
    last3 = _track_window().rowsBetween(-2, 0)
    return track_detections.withColumns({f"smooth_{s}": F.rint(F.avg(s).over(last3)).cast("int") for s in SIDES})


def predicted_box(track_detections: DataFrame, target_frame: Column) -> DataFrame:
    """Box expected at ``target_frame`` from the last two boxes; the smoothed box for a single one."""
    w = _track_window()
    rows = smoothed_box(track_detections).withColumns(
        {f"prev_{s}": F.lag(s).over(w) for s in (*SIDES, "frame_index")}
    )
    gap = F.greatest(F.lit(1), F.col("frame_index") - F.col("prev_frame_index"))
    multiplier = F.least(F.lit(2.5), F.greatest(F.lit(0), target_frame - F.col("frame_index")) / gap)

    def moved(s: str) -> Column:
        step = (F.col(s) - F.col(f"prev_{s}")) * multiplier
        return F.coalesce(F.rint(F.col(s) + step).cast("int"), F.col(f"smooth_{s}"))

    return rows.withColumns({f"pred_{s}": moved(s) for s in SIDES}).drop(*(f"prev_{s}" for s in (*SIDES, "frame_index")))


def track_gap(track_detections: DataFrame, cfg: TrackConfig = TrackConfig()) -> DataFrame:
    """Cut a track where the pause is longer than an open track may wait (longer near the frame edge)."""
    w = _track_window()
    edge = g.near_edge(g.box(), cfg.frame_width, cfg.frame_height, cfg.edge_margin)
    allowed = F.when(edge, max(cfg.max_frame_gap, cfg.edge_frame_gap)).otherwise(cfg.max_frame_gap)
    rows = track_detections.withColumn("_allowed", allowed)
    expired = F.col("frame_index") - F.lag("frame_index").over(w) > F.lag("_allowed").over(w)
    rows = rows.withColumn("_new", F.coalesce(expired.cast("int"), F.lit(0)))
    return rows.withColumn("part", F.sum("_new").over(w).cast("int")).drop("_new", "_allowed")


def split_train_val(items: DataFrame, name: str = "image_name", val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Seeded split with exactly ``round(n * ratio)`` validation rows.

    Items are ordered by a hash. Only the 65,536 hash prefixes are counted and accumulated; the single
    prefix in which the quota runs out is ranked row by row. The rows are read for the counts, for the clear prefixes and
    for that one, so they are checkpointed: what makes them runs once.
    """
    ensure_checkpoint_dir(items.sparkSession)
    rows = items.checkpoint().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(name)))).withColumn("_p", F.left("_h", F.lit(4)))
    counts = rows.groupBy("_p").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    counts = counts.withColumns(
        {
            "before": F.sum("n").over(everything.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
            "quota": F.rint(F.sum("n").over(everything) * F.lit(val_ratio)).cast("long"),
        }
    ).select("_p", "n", (F.col("quota") - F.coalesce("before", F.lit(0))).alias("left"))
    rows = rows.join(F.broadcast(counts), "_p")
    edge = (F.col("left") > 0) & (F.col("left") < F.col("n"))
    clear = rows.filter(~edge).withColumn("split", F.when(F.col("left") >= F.col("n"), "val").otherwise("train"))
    ranked = rows.filter(edge).withColumn("_rk", F.row_number().over(Window.partitionBy("_p").orderBy("_h", name)))
    ranked = ranked.withColumn("split", F.when(F.col("_rk") <= F.col("left"), "val").otherwise("train")).drop("_rk")
    return clear.unionByName(ranked).drop("_h", "_p", "n", "left")


def order_outputs(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*order)
