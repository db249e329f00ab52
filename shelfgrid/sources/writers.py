"""Writers of the reports and tables. Every writer leaves one directory of part files, written by tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgrid.functions import geometry as g
from shelfgrid.functions.numbers import exact_round
from shelfgrid.schemas import FINAL_COLUMNS
from shelfgrid.sources.label_files import LabelFiles

SIDES = ["x_min", "y_min", "x_max", "y_max"]
BOM = "\ufeff"

# Column layouts of the reports.
TRACK_COLUMNS = [
    "track_id", "start_frame", "end_frame", "start_timestamp_ms", "end_timestamp_ms", "duration_ms", "detections_count",
    "best_frame_index", "best_timestamp_ms", "best_candidate_index", "best_detection_score", "best_track_score", "source",
    *SIDES, "width", "height", "aspect_ratio",
]
TRACK_DETECTION_COLUMNS = [
    "track_id", "frame_index", "timestamp_ms", "candidate_index", "source", "score", *SIDES, "width", "height",
]
CODE_COLUMNS = [
    "frame_index", "timestamp_ms", "timestamp_sec", "code_index", "code_type", "value", "confidence", "source", *SIDES, "width", "height",
]
PROBE_COLUMNS = [
    "frame_index", "timestamp_ms", "timestamp_sec", "region_type", *SIDES, "width", "height", "reader", "code_type",
    "value", "variant_name", "scale", "crop_path",
]
SERVICE_COLUMNS = [
    "frame_index", "timestamp_ms", "timestamp_sec", "candidate_index", "source", "score", *SIDES, "width", "height",
    "class_id", "class_name", "model_path",
]
HEURISTIC_COLUMNS = [
    "frame_index", "timestamp_ms", "timestamp_sec", "candidate_index", "source", "score", *SIDES, "width", "height",
    "aspect_ratio", "evidence",
]


def write_csv(df: DataFrame, path: str, sep: str = ",", bom: bool = False, partition_by: str | None = None) -> None:
    """CSV part files with a header; ``bom`` marks the first header cell of each file."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    if partition_by:  # rows of a value together, large values split: few files each, no task with all of one
        df = df.hint("rebalance", partition_by)
    writer = df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", "UTF-8")
    # Backslashes are ordinary characters in these files; quotes are doubled.
    writer = writer.option("escape", '"').option("emptyValue", "")
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def final_rows(rows: DataFrame) -> DataFrame:
    """The fixed columns in order; extra ones dropped, missing or unknown ones ``-``."""
    def cell(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("-")).alias(name) if name in rows.columns else F.lit("-").alias(name)

    return rows.select(*(cell(c) for c in FINAL_COLUMNS))


def write_final_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    write_csv(final_rows(rows), path, sep, bom=True)


def _filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def detection_report(df: DataFrame, service: bool = True, evidence: list[str] | None = None) -> DataFrame:
    """Detection report rows in the service layout or the heuristic layout with JSON evidence."""
    b, digits = g.box(), (3, 6) if service else (2, 4)
    stamp = F.col("timestamp_ms")
    rows = df.withColumns(
        {
            "timestamp_sec": exact_round(stamp / F.lit(1000.0), digits[0]), "timestamp_ms": exact_round(stamp, digits[0]),
            "score": exact_round(F.col("score"), digits[1]), "width": b.width, "height": b.height,
        }
    )
    if service:
        return _filled(rows, ["video_id", *SERVICE_COLUMNS])
    fields = evidence if evidence is not None else [c for c in ("text_density", "rectangularity") if c in df.columns]
    rows = rows.withColumns({"aspect_ratio": exact_round(b.aspect, 4), "evidence": F.to_json(F.struct(*fields))})
    return _filled(rows, ["video_id", *HEURISTIC_COLUMNS])


def write_detections(df: DataFrame, path: str, service: bool = True, evidence: list[str] | None = None) -> None:
    write_csv(detection_report(df, service, evidence), path, partition_by="video_id")


def write_recognition(parts: list[DataFrame], path: str) -> None:
    """Ragged parts in one table: columns in first-seen order, absent cells blank."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    write_csv(out.select(*(F.col(c).cast("string").alias(c) for c in out.columns)), path)


def write_tracks(tracks: DataFrame, track_detections: DataFrame, path: str) -> None:
    rows = tracks.select("video_id", *TRACK_COLUMNS).orderBy("video_id", "start_frame", "track_id")
    write_csv(rows, f"{path}/tracks", sep=";", bom=True)
    b = g.box()
    boxes = track_detections.withColumns(
        {
            "timestamp_ms": exact_round(F.col("timestamp_ms"), 2), "score": exact_round(F.col("score"), 4),
            "width": b.width, "height": b.height,
        }
    ).select("video_id", *TRACK_DETECTION_COLUMNS).orderBy("video_id", "frame_index", "track_id")
    write_csv(boxes, f"{path}/track_detections", sep=";", bom=True)


def write_codes(codes: DataFrame, path: str, probe: bool = False) -> None:
    b, stamp = g.box(), F.col("timestamp_ms")
    rows = codes.withColumns(
        {
            "timestamp_sec": exact_round(stamp / F.lit(1000.0), 2), "timestamp_ms": exact_round(stamp, 2),
            "width": b.width, "height": b.height,
        }
    )
    write_csv(_filled(rows, ["video_id", *(PROBE_COLUMNS if probe else CODE_COLUMNS)]), path, partition_by="video_id")


def write_training_labels(items: DataFrame, path: str) -> None:
    """One label file an image, in one directory a split, and the metadata table by split."""
    spark = items.sparkSession
    spark.dataSource.register(LabelFiles)
    files = items.select("split", "image_name", F.array_join("lines", "\n").alias("text"))
    files.write.format(LabelFiles.name()).mode("overwrite").option("path", f"{path}/labels").save()
    items.drop("lines").write.mode("overwrite").partitionBy("split").parquet(f"{path}/metadata")


def write_run_summary(summary: DataFrame, path: str) -> None:
    summary.select(F.col("summary").alias("value")).write.mode("overwrite").text(path)
