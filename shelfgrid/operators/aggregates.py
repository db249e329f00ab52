"""Aggregations. Copies are folded before lists are built, so partial aggregation does most of the work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgrid.functions import geometry as g
from shelfgrid.functions import values as v
from shelfgrid.functions.numbers import exact_round

SIDES = ["x_min", "y_min", "x_max", "y_max"]


def first_seen(position, value, when: Column | None = None) -> Column:
    """Aggregate: values in order of position, NULL values (or rows outside ``when``) left out."""
    position = F.col(position) if isinstance(position, str) else position
    value = F.col(value) if isinstance(value, str) else value
    keep = value.isNotNull() if when is None else when & value.isNotNull()
    pairs = F.collect_list(F.when(keep, F.struct(position.alias("at"), value.alias("value"))))
    return F.transform(F.array_sort(pairs), lambda p: p["value"])


def merge_evidence(
    df: DataFrame, keys: list[str], order: str, flags: list[str], numbers: list[str], lists: str
) -> DataFrame:
    """Evidence of merged candidates: flags are or-ed, numbers maximised, list values united in order."""
    def folded(grouped_df: DataFrame, by: list[str], extra: list[Column]) -> DataFrame:
        return grouped_df.groupBy(*by).agg(
            *(F.bool_or(c).alias(c) for c in flags), *(F.max(c).alias(c) for c in numbers), *extra
        )

    per_value = folded(df, [*keys, lists], [F.min(order).alias(order)])
    return folded(per_value, keys, [first_seen(order, lists).alias(f"{lists}s")])


def summarize_tracks(track_detections: DataFrame) -> DataFrame:
    """One row per track: span, best detection and its box."""
    b = g.box()
    quality = g.detection_quality(b, F.col("score"), F.col("source"))
    rows = track_detections.withColumn("quality", quality)
    place = F.struct("frame_index", "candidate_index")
    best = F.struct(F.col("quality"), (-F.col("frame_index")).alias("f"), (-F.col("candidate_index")).alias("c"))
    tracks = rows.groupBy("video_id", "track_id").agg(
        F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"),
        F.min_by("timestamp_ms", place).alias("start"), F.max_by("timestamp_ms", place).alias("end"),
        F.count("*").cast("int").alias("detections_count"),
        F.max_by(F.struct("frame_index", "timestamp_ms", "candidate_index", "score", "quality", "source", *SIDES), best).alias("best"),
    )
    bb = g.box_of(F.col("best"))
    return tracks.select(
        "video_id", "track_id", "start_frame", "end_frame",
        exact_round(F.col("start"), 2).alias("start_timestamp_ms"), exact_round(F.col("end"), 2).alias("end_timestamp_ms"),
        exact_round(F.col("end") - F.col("start"), 2).alias("duration_ms"), "detections_count",
        F.col("best.frame_index").alias("best_frame_index"),
        exact_round(F.col("best.timestamp_ms"), 2).alias("best_timestamp_ms"),
        F.col("best.candidate_index").alias("best_candidate_index"),
        exact_round(F.col("best.score"), 4).alias("best_detection_score"),
        exact_round(F.col("best.quality"), 4).alias("best_track_score"), F.col("best.source").alias("source"),
        *bb.columns(), bb.width.alias("width"), bb.height.alias("height"), exact_round(bb.aspect, 4).alias("aspect_ratio"),
    )


def group_label_frames(labels: DataFrame, videos: DataFrame, class_id: int = 0) -> DataFrame:
    """Usable label boxes per frame, with the frame's image name and label lines.

    ``labels`` has text columns ``video_id, frame_timestamp`` and box sides plus an ``ordinal``.
    """
    # Behind ``inline`` the filter below reads the numbers; on plain columns Spark would parse each text once more for it.
    rows = labels.select("video_id", "ordinal", F.inline(F.array(F.struct(
        v.parse_number(F.col("frame_timestamp")).alias("frame_timestamp_ms"), *(v.parse_number(F.col(c)).alias(c) for c in SIDES),
    ))))
    complete = reduce(lambda a, c: a & c, (F.col(c).isNotNull() for c in ("frame_timestamp_ms", *SIDES)))
    rows = rows.filter(complete).join(videos, "video_id")
    clipped = g.clip_label(g.box(), F.col("width"), F.col("height"))
    rows = rows.select("video_id", "ordinal", "frame_timestamp_ms", "fps", "frame_count", "width", "height", *clipped.columns())
    rows = rows.filter("x_max - x_min > 2 AND y_max - y_min > 2")
    rows = rows.withColumn("line", g.training_line(g.box(), F.col("width"), F.col("height"), class_id))
    grouped = rows.groupBy("video_id", "frame_timestamp_ms", "fps", "frame_count", "width", "height").agg(
        F.count("*").cast("int").alias("boxes_count"), first_seen("ordinal", "line").alias("lines")
    )
    fps = F.when(F.col("fps") <= 0, 25.0).otherwise(F.col("fps"))
    frame = v.timestamp_to_frame(F.col("frame_timestamp_ms"), fps, F.col("frame_count"))
    image = F.format_string(
        "%s_t_%08d_f_%06d.jpg", v.safe_filename(F.col("video_id")), F.rint("frame_timestamp_ms").cast("long"), F.col("frame_index")
    )
    return grouped.withColumn("frame_index", frame).select(
        image.alias("image_name"), "video_id", "frame_timestamp_ms", "frame_index", "width", "height", "boxes_count", "lines"
    )


def detection_stats(candidates: DataFrame, codes: DataFrame) -> DataFrame:
    """Frames, candidates and codes per video, with the largest frame; one row per frame is aggregated first."""
    per_frame = (
        candidates.groupBy("video_id", "frame_index").agg(F.count("*").alias("candidates"), F.lit(0).alias("codes"))
        .unionByName(codes.groupBy("video_id", "frame_index").agg(F.lit(0).alias("candidates"), F.count("*").alias("codes")))
        .groupBy("video_id", "frame_index").agg(F.sum("candidates").alias("candidates"), F.sum("codes").alias("codes"))
    )
    return per_frame.groupBy("video_id").agg(
        F.count("*").alias("frames"), F.sum("candidates").alias("candidates"), F.sum("codes").alias("codes"),
        F.max("candidates").alias("max_per_frame"),
    )


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median per group from value counts: equal values are counted before the shuffle and nothing is gathered."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("n").over(upto))
    totals = df.groupBy(*keys).agg(F.count("*").alias("total"))
    marked = counts.join(totals, keys)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)

    def covers(rank: Column) -> Column:
        return (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)

    return marked.filter(covers(low) | covers(high)).groupBy(*keys).agg(
        ((F.max(F.when(covers(low), F.col(value))) + F.max(F.when(covers(high), F.col(value)))) / F.lit(2.0)).alias(value),
        F.max("total").alias("points"),
    )


def global_shift(flow: DataFrame, min_points: int = 20) -> DataFrame:
    """Median flow per frame pair with enough points, then the median over the pairs of a video."""
    pair = ["video_id", "pair_index"]
    # An optional ``tracked`` flag marks points the flow solver followed; enough must exist before and after it.
    if "tracked" in flow.columns:
        seen = flow.groupBy(*pair).agg(F.count("*").alias("_all")).filter(F.col("_all") >= min_points)
        flow = flow.join(seen.select(*pair), pair, "left_semi").filter("tracked")

    def axis(name: str) -> DataFrame:
        per_pair = exact_median(flow, pair, name).filter(F.col("points") >= min_points)
        return exact_median(per_pair.drop("points"), ["video_id"], name).select("video_id", name)

    return axis("dx").join(axis("dy"), "video_id")


def probe_summary(findings: DataFrame) -> DataFrame:
    """Distinct values and readers over a probe run, from per-(reader, value) counts."""
    per = findings.groupBy("reader", "value").agg(F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("findings"), F.countDistinct("value").alias("unique_values"),
        F.array_join(F.array_sort(F.collect_set("reader")), ",").alias("readers"),
    )


def line_rollup(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a line joined in x order, with the union box."""
    return words.groupBy(*keys).agg(
        F.array_join(first_seen(F.struct("x_min", "word_seq"), "text"), " ").alias("text"),
        F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"),
    )


def combine_ocr_texts(texts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All variant texts of a tag, exact copies once, in first-seen order."""
    rows = texts.select(key, F.struct(*order).alias("pos"), v.strip(F.col("raw_text")).alias("text")).filter("text != ''")
    rows = rows.groupBy(key, "text").agg(F.min("pos").alias("pos"))
    joined = rows.groupBy(key).agg(F.array_join(first_seen("pos", "text"), "\n").alias("raw_text"))
    return joined.withColumn("confidence", F.lit(0.45))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order, as a partial aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def distinct_findings(findings: DataFrame) -> DataFrame:
    keys = ["video_id", "frame_index", "region_type", "reader", "code_type", "value"]
    return first_per_key(findings, keys, ["finding_index"])


def distinct_words(words: DataFrame, key: str = "tag_id") -> DataFrame:
    rows = words.withColumn("text", v.squeeze(F.col("text")))
    return first_per_key(rows, [key, "text", *SIDES], ["word_seq"])


def distinct_values(reads: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Decoded values of a tag in first-seen order."""
    rows = reads.select(*keys, v.strip(F.col("value")).alias("value"), F.struct(*order).alias("pos")).filter("value != ''")
    rows = rows.groupBy(*keys, "value").agg(F.min("pos").alias("pos"))
    return rows.groupBy(*keys).agg(first_seen("pos", "value").alias("code_values"))


def union_sources(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
