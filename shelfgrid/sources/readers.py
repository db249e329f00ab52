"""Readers of the CSV, TSV and JSON files the jobs start from, and table functions over video metadata."""

from __future__ import annotations

import csv
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfgrid.functions import values as v
from shelfgrid.functions.numbers import exact_round

SIDES = ["x_min", "y_min", "x_max", "y_max"]
BOM = "\ufeff"

# Header spellings of the catalogue columns, in order of preference.
PRODUCT_HEADERS = (
    "product_name", "name", "title", "full_name", "fullname", "full name", "product", "товар", "название",
    "наименование", "полное название", "полное_название", "название товара", "наименование товара",
)
BARCODE_HEADERS = (
    "barcode", "bar_code", "ean", "ean13", "gtin", "code", "код", "штрихкод", "штрих-код", "штрих код",
    "штрих_код", "баркод", "barcode_digits",
)
REQUIRED_LABEL_COLUMNS = ["frame_timestamp", *SIDES]


def _number(name: str) -> Column:
    return F.coalesce(F.translate(v.strip(F.col(name)), ",", ".").try_cast("double"), F.lit(0.0))


def scan_detections(
    spark: SparkSession, path: str, min_score: float | None = None, max_rows: int | None = None, sep: str = ","
) -> DataFrame:
    """Detection report with decimal commas; blank numbers are 0 and integers round half to even."""
    raw = spark.read.csv(path, header=True, sep=sep, encoding="UTF-8", inferSchema=False)
    raw = raw.toDF(*(c.lstrip(BOM) for c in raw.columns))
    video = F.col("video_id") if "video_id" in raw.columns else F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)?$", 1)
    rows = raw.select(
        video.alias("video_id"), F.rint(_number("frame_index")).cast("int").alias("frame_index"),
        _number("timestamp_ms").alias("timestamp_ms"), F.rint(_number("candidate_index")).cast("int").alias("candidate_index"),
        F.coalesce("source", F.lit("")).alias("source"), _number("score").alias("score"),
        *(F.rint(_number(c)).cast("int").alias(c) for c in SIDES),
    )
    return first_detections(rows, min_score, max_rows)


def first_detections(rows: DataFrame, min_score: float | None = None, max_rows: int | None = None) -> DataFrame:
    """Rows of a minimum score, the first ``max_rows`` in report order."""
    if min_score is not None:
        rows = rows.filter(F.col("score") >= min_score)
    if max_rows is not None:
        rows = rows.orderBy("video_id", "frame_index", "candidate_index").limit(max_rows)
    return rows


# Separators in the order in which they are tried, for catalogues and labels, and for result tables.
CATALOG_SEPARATORS = (";", ",", "\t")
RESULT_SEPARATORS = (",", ";", "\t")


def csv_cells(spark: SparkSession, paths: str | list[str], separators: tuple[str, ...] = CATALOG_SEPARATORS) -> DataFrame:
    """(file, row, cells): the rows of many CSV files in one distributed read, cells by the header of their file.

    Encoding and separator are decided for each file: UTF-8 if all its lines are valid, else Windows Cyrillic; the first of
    ``separators`` in its header, else a single column. Lines are read byte for byte and judged by Spark where they lie;
    the decisions, one row a file, are joined back. ``row`` orders the rows of a file. A line is a row, so quoted line breaks are torn.
    """
    lines = spark.read.csv(paths, header=False, sep="\x00", quote="", encoding="ISO-8859-1", schema="line string")
    lines = lines.select(
        "line", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("row"),
    ).where("line is not null")
    bytes_ = F.encode("line", "ISO-8859-1")
    files = lines.groupBy("file").agg(
        F.bool_or(~F.is_valid_utf8(bytes_.cast("string"))).alias("cyrillic"), F.min_by("line", "row").alias("head"), F.min("row").alias("first")
    )
    separator = F.coalesce(*(F.when(F.contains("head", F.lit(x)), F.lit(x)) for x in separators), F.lit(separators[0]))
    files = files.select("file", "cyrillic", "head", "first", separator.alias("sep"))

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        headers: dict[tuple, list[str]] = {}

        def cells(line: str, code: str, sep: str) -> list[str]:
            text = line.encode("latin-1").decode(code, errors="replace")
            return next(csv.reader([text], delimiter=sep), [])

        for batch in batches:
            out = []
            for line, cyrillic, head, sep in zip(*(batch.column(c).to_pylist() for c in ("line", "cyrillic", "head", "sep"))):
                code = "cp1251" if cyrillic else "utf-8"
                if (head, code, sep) not in headers:
                    if len(headers) > 1000:
                        headers.clear()
                    headers[head, code, sep] = [h.lstrip(BOM).strip() for h in cells(head, code, sep)]
                out.append(list(dict(zip(headers[head, code, sep], cells(line, code, sep))).items()))
            yield pa.record_batch([batch.column("file"), batch.column("row"), pa.array(out, pa.map_(pa.string(), pa.string()))], names=["file", "row", "cells"])

    rows = lines.join(files, "file").where("row != first").select("file", "row", "line", "cyrillic", "head", "sep")
    return rows.mapInArrow(parsed, "file string, row struct<block: bigint, at: bigint>, cells map<string, string>")


def scan_flexible_csv(spark: SparkSession, path: str | list[str], separators: tuple[str, ...] = CATALOG_SEPARATORS) -> DataFrame:
    """CSV files in UTF-8 or Windows Cyrillic as one table of text columns; a file without a column leaves it NULL.

    The distinct headers of all files are collected; empty cells are NULL.
    """
    rows = csv_cells(spark, path, separators)
    seen = rows.select("file", F.map_keys("cells").alias("names")).groupBy("names").agg(F.min("file").alias("file")).collect()
    names = dict.fromkeys(n for r in sorted(seen, key=lambda r: (r["file"], r["names"])) for n in r["names"])
    return rows.select(*(F.nullif(F.try_element_at("cells", F.lit(n)), F.lit("")).alias(n) for n in names if n))


def _header_column(name: Column) -> Column:
    """As ``_header``, for names in a column."""
    spaced = F.translate(F.lower(v.strip(F.replace(name, F.lit(BOM), F.lit("")))), "_-", "  ")
    return F.trim(F.regexp_replace(spaced, v.SPACES, " "))


def _header(name: str) -> str:
    return " ".join(name.strip().lower().replace(BOM, "").replace("_", " ").replace("-", " ").split())


def catalog_columns(df: DataFrame) -> DataFrame:
    """``product_name`` and ``barcode`` from whatever the file calls them: first filled alias wins."""
    by_header = {_header(c): c for c in df.columns}

    def pick(aliases) -> Column:
        found = [by_header[_header(a)] for a in aliases if _header(a) in by_header]
        filled = [F.when(v.strip(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) for c in dict.fromkeys(found)]
        return F.coalesce(*filled, F.lit("")) if filled else F.lit("")

    keep = [F.col(c) for c in ("entry_id", "source_file") if c in df.columns]
    return df.select(*keep, pick(PRODUCT_HEADERS).alias("product_name"), pick(BARCODE_HEADERS).alias("barcode"))


def union_files(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def scan_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Catalogue files, each with its own encoding, separator and header, as entries in file and row order."""
    from shelfgrid.operators.catalog import build_catalog

    rows = csv_cells(spark, paths)
    by_header = F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(_header_column(e["key"]).alias("key"), e["value"].alias("value"))))

    def pick(aliases) -> Column:
        filled = [F.when(v.strip(c) != "", c) for c in (F.try_element_at("named", F.lit(a)) for a in dict.fromkeys(map(_header, aliases)))]
        return F.coalesce(*filled, F.lit(""))

    rows = rows.withColumn("named", by_header).select("file", "row", pick(PRODUCT_HEADERS).alias("product_name"), pick(BARCODE_HEADERS).alias("barcode"))
    built = build_catalog(rows, ["file", "row"])
    # Numbered by file, one row a file to rank, then by row; row numbers of one read are far below 2**50.
    ranks = built.select("file").distinct().withColumn("rank", F.row_number().over(Window.orderBy("file")) - 1)
    number = F.col("rank").cast("long") * (1 << 50) + F.col("row.at")
    return built.join(ranks, "file").withColumn("entry_id", number).drop("file", "row", "rank")


def check_labels(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED_LABEL_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"label table lacks columns {missing}")
    return df.withColumnRenamed("wholesale_level_1_coun", "wholesale_level_1_count")


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    return check_labels(scan_flexible_csv(spark, path))


def ocr_words(raw: DataFrame, min_confidence: float = 10.0) -> DataFrame:
    """Word rows of an OCR table: blank, unsure and empty-box words dropped."""
    def whole(name: str) -> Column:
        return F.col(name).try_cast("double").cast("int")

    conf = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))
    sides = [whole(c) for c in ("left_px", "top_px", "width", "height")]
    rows = raw.withColumns(
        {"text": v.strip(F.coalesce("text", F.lit(""))), "_conf": conf, "_x": sides[0], "_y": sides[1], "_w": sides[2], "_h": sides[3]}
    )
    rows = rows.filter((F.col("text") != "") & (F.col("_conf") >= min_confidence) & (F.col("_w") > 0) & (F.col("_h") > 0))
    used = {"conf", "left_px", "top_px", "width", "height", "_conf", "_x", "_y", "_w", "_h"}
    return rows.select(
        *(c for c in rows.columns if c not in used), (F.col("_conf") / F.lit(100.0)).alias("confidence"),
        F.col("_x").alias("x_min"), F.col("_y").alias("y_min"),
        (F.col("_x") + F.col("_w")).alias("x_max"), (F.col("_y") + F.col("_h")).alias("y_max"),
    )


def scan_ocr_words(spark: SparkSession, path: str, min_confidence: float = 10.0) -> DataFrame:
    raw = spark.read.csv(path, header=True, sep="\t", quote="", inferSchema=False)
    raw = raw.withColumnRenamed("left", "left_px").withColumnRenamed("top", "top_px")
    return ocr_words(raw.withColumn("source_file", F.input_file_name()), min_confidence)


def _first_path(variant: Column, paths: list[str], kind: str) -> Column:
    return F.coalesce(*(F.try_variant_get(variant, p, kind) for p in paths))


def ocr_blocks(payloads: DataFrame, min_confidence: float = 0.15) -> DataFrame:
    """Text blocks of JSON payloads, in order: containers, key names and box forms vary by engine version."""
    containers = ("$.res.", "$.result.", "$.data.", "$.")
    parsed = payloads.withColumn("_v", F.try_parse_json("payload"))

    def lists(names) -> list[str]:
        return [f"{c}{n}" for c in containers for n in names]

    texts = _first_path(F.col("_v"), lists(("rec_texts", "texts", "text")), "array<string>")
    scores = _first_path(F.col("_v"), lists(("rec_scores", "scores", "score", "confidence")), "array<double>")
    boxes = _first_path(F.col("_v"), lists(("rec_boxes", "rec_polys", "dt_polys", "dt_boxes", "boxes", "polys")), "array<variant>")
    old = F.try_variant_get(F.col("_v"), "$", "array<variant>")
    # The lists are bound before they are walked: inside the function they would be read anew for each text.
    modern = v.let(
        F.struct(texts.alias("texts"), scores.alias("scores"), boxes.alias("boxes")),
        lambda lists: F.transform(
            lists["texts"],
            lambda t, i: F.struct(
                t.alias("text"), F.coalesce(F.get(lists["scores"], i), F.lit(1.0)).alias("confidence"), F.get(lists["boxes"], i).alias("box")
            ),
        ),
    )
    legacy = F.transform(
        old,
        lambda e: F.struct(
            F.try_variant_get(e, "$[1][0]", "string").alias("text"),
            F.coalesce(F.try_variant_get(e, "$[1][1]", "double"), F.lit(1.0)).alias("confidence"),
            F.try_variant_get(e, "$[0]", "variant").alias("box"),
        ),
    )
    keep = [c for c in payloads.columns if c != "payload"]
    rows = parsed.select(*keep, F.posexplode(F.coalesce(modern, legacy)).alias("block_index", "b"))
    flat = F.try_variant_get(F.col("b.box"), "$", "array<double>")
    points = F.try_variant_get(F.col("b.box"), "$", "array<array<double>>")

    def axes(values) -> Column:
        return F.struct(values(0).alias("x"), values(1).alias("y"))

    def from_points(p: Column) -> Column:
        return axes(lambda at: F.transform(p, lambda q: F.get(q, F.lit(at))))

    def from_flat(f: Column) -> Column:
        pairs = axes(lambda at: F.array(F.get(f, F.lit(at)), F.get(f, F.lit(at + 2))))
        return F.when(F.get(f, F.lit(0)).isNotNull(), pairs).otherwise(v.let(points, from_points))

    def sides(a: Column) -> Column:
        picked = (F.array_min(a["x"]), F.array_min(a["y"]), F.array_max(a["x"]), F.array_max(a["y"]))
        return F.struct(*(F.rint(c).cast("int").alias(s) for c, s in zip(picked, SIDES)))

    rows = rows.select(
        *keep, "block_index", v.squeeze(F.col("b.text")).alias("text"), F.col("b.confidence").alias("confidence"),
        v.let(v.let(flat, from_flat), sides).alias("_box"),
    ).select(*keep, "block_index", "text", "confidence", "_box.*")
    real = (F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min"))
    rows = rows.withColumns({c: F.when(real, F.col(c)) for c in SIDES})
    rows = rows.filter((F.coalesce("text", F.lit("")) != "") & (F.col("confidence") >= min_confidence))
    # Copies of one block within a payload keep the first.
    rows = rows.groupBy(*keep, "text", *SIDES).agg(F.min_by(F.struct("block_index", "confidence"), "block_index").alias("f"))
    return rows.select(*keep, "f.block_index", "text", "f.confidence", *SIDES)


def ocr_texts(blocks: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Text and mean confidence by ``keys``, with ``more`` aggregates of the same blocks."""
    from shelfgrid.operators.aggregates import first_seen

    total = exact_round(F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count("*"), 6)
    return blocks.groupBy(*keys).agg(F.array_join(first_seen("block_index", "text"), "\n").alias("raw_text"), total.alias("confidence"), *more)


def expand_frame_index(videos: DataFrame, target_fps: float = 2.0) -> DataFrame:
    """Every ``step``-th frame of a video with its time."""
    fps = F.when(F.col("fps") <= 0, 25.0).otherwise(F.col("fps"))
    step = F.greatest(F.lit(1), F.rint(fps / F.lit(max(target_fps, 0.1))).cast("int"))
    rows = videos.filter(F.col("frame_count") > 0).select("video_id", fps.alias("fps"), F.explode(
        F.sequence(F.lit(0), F.col("frame_count") - 1, step)).alias("frame_index"))
    return rows.select("video_id", "frame_index", (F.col("frame_index") / F.col("fps") * F.lit(1000.0)).alias("timestamp_ms"))


def expand_service_frames(videos: DataFrame, target_fps: float = 2.0, max_frames: int | None = None) -> DataFrame:
    """Sampling of the service: unknown rate means every frame; ``max_frames`` keeps the first ones (the service: 50)."""
    unknown = (F.col("fps") <= 0) | F.lit(target_fps <= 0)
    step = F.when(unknown, 1).otherwise(F.greatest(F.lit(1), F.rint(F.col("fps") / F.lit(target_fps or 1.0)).cast("int")))
    last = F.col("frame_count") - 1
    if max_frames is not None:
        last = F.least(last, (F.lit(max_frames) - 1) * step)
    return videos.filter(F.col("frame_count") > 0).select("video_id", F.explode(F.sequence(F.lit(0), last, step)).alias("frame_index"))


def linspace_frames(videos: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced frame numbers of a video, truncated; 0..n-1 when the length is unknown."""
    rows = videos.select("video_id", "frame_count", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("position"))
    even = F.col("position") * ((F.col("frame_count") - 1) / F.lit(max(1, n - 1)))
    frame = F.when(F.col("frame_count") > 0, even.cast("int")).otherwise(F.col("position"))
    return rows.select("video_id", "position", frame.alias("frame_index"))


def tile_regions(frames: DataFrame, tile: int, overlap: float) -> DataFrame:
    """Overlapping square tiles of a frame; the last row and column sit flush with the far edges."""
    step = max(1, int(tile * (1.0 - min(max(overlap, 0.0), 0.90))))

    def starts(side: Column) -> Column:
        steps = F.sequence(F.lit(0), F.greatest(F.lit(0), side - tile), F.lit(step))
        flush = F.element_at(steps, -1) + tile < side
        return F.when(flush, F.array_append(steps, F.greatest(F.lit(0), side - tile))).otherwise(steps)

    rows = frames.withColumn("x_min", F.explode(starts(F.col("width")))).withColumn("y_min", F.explode(starts(F.col("height"))))
    return rows.withColumns(
        {"x_max": F.least(F.col("width"), F.col("x_min") + tile), "y_max": F.least(F.col("height"), F.col("y_min") + tile)}
    )
