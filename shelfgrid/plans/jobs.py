"""Whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgrid.config import ParserConfig
from shelfgrid.functions import scores as sc
from shelfgrid.functions.numbers import exact_round
from shelfgrid.operators import aggregates as agg
from shelfgrid.operators.catalog import match_catalog
from shelfgrid.operators.joins import match_labels
from shelfgrid.operators.rankings import best_ocr_variant, best_promo_result, split_train_val
from shelfgrid.plans.detection import detect_candidates  # noqa: F401
from shelfgrid.plans.fusion import fuse_final_rows
from shelfgrid.plans.parsing import parse_tag_fields
from shelfgrid.schemas import TAG_FIELDS

def apply_reference(fields: DataFrame, catalog: DataFrame, cfg: ParserConfig = ParserConfig()) -> DataFrame:
    """Matched entries overwrite name and codes; the QR code stays only where a code was really read.

    ``sources``, where rows have it, says so: fields from the catalogue, and a QR code that was not read.
    """
    rows = match_catalog(fields, catalog, cfg.min_reference_score)
    matched = F.col("reference_entry_id").isNotNull()
    code = F.coalesce("reference_barcode", "barcode")
    read = F.size(F.coalesce("code_values", F.array().cast("array<string>"))) > 0 if "code_values" in rows.columns else F.lit(False)
    changed = {
        "product_name": F.coalesce("reference_product_name", "product_name"), "barcode": code,
        "qr_code_barcode": F.when(read, F.coalesce("reference_barcode", "qr_code_barcode")), "reference_matched": matched,
    }
    if "sources" in rows.columns:
        from_code = matched & F.col("reference_barcode").isNotNull()
        said = {
            "product_name": F.when(matched, "product_reference_name_match"), "barcode": F.when(from_code, "product_reference_name_match"),
            "qr_code_barcode": F.when(~read, "not_read_from_image").when(from_code, "product_reference_name_match"),
        }
        new = F.filter(F.array(*(F.struct(F.lit(f).alias("key"), c.alias("value")) for f, c in said.items())), lambda e: e["value"].isNotNull())
        kept = F.map_filter("sources", lambda f, _: ~F.array_contains(F.transform(new, lambda e: e["key"]), f))
        changed["sources"] = F.map_concat(kept, F.map_from_entries(new))
    return rows.withColumns(changed)


def recognize_detections(
    tags: DataFrame, keys: list[str], catalog: DataFrame, codes: DataFrame | None = None,
    promo: DataFrame | None = None, colors: DataFrame | None = None, cfg: ParserConfig = ParserConfig(),
) -> DataFrame:
    """Wide recognition rows. ``tags`` carries ``raw_text`` of the best text variant; the other inputs join on ``keys``.

    ``codes`` has ``code_values`` arrays, ``promo`` the chosen promo result, ``colors`` the colour ratios.
    """
    rows = tags
    if codes is not None:
        rows = rows.join(codes.select(*keys, "code_values"), keys, "left")
    if promo is not None:
        names = ("confidence", "price_card", "price_default", "discount_amount")
        rows = rows.join(promo.select(*keys, *(F.col(c).alias(f"promo_{c}") for c in names)), keys, "left")
    if colors is not None:
        color, confidence = sc.tag_color()
        rows = rows.join(colors.select(*keys, color.alias("detected_color"), confidence.alias("color_confidence")), keys, "left")
    carried = [c for c in rows.columns if c not in (*TAG_FIELDS, "raw_text") and not c.startswith("promo_")]
    fields = parse_tag_fields(rows, carried, cfg)
    out = apply_reference(fields, catalog, cfg)
    if "detected_color" in out.columns:
        out = out.withColumn("color", F.coalesce("color", "detected_color"))
    return out


def recognize_labelled(
    detections: DataFrame, labels: DataFrame, max_delta_ms: float = 2000.0, min_iou: float = 0.25, cfg: ParserConfig = ParserConfig()
) -> DataFrame:
    """Detections with the fields of the label they match, and ``match_iou``; detections without a label are left out.

    ``labels`` has ``video_id, label_id, frame_timestamp``, sides and any of the tag fields; each label is used once.
    """
    keys = ["video_id", "frame_index", "candidate_index"]
    found = match_labels(detections, labels, max_delta_ms, min_iou).withColumn("match_iou", exact_round(F.col("match_iou"), 4))
    fields = labels.select("video_id", "label_id", *(F.col(f).alias(f"label_{f}") for f in TAG_FIELDS if f in labels.columns))
    rows = detections.select(*keys, "timestamp_ms", "source", "score").join(found, keys).join(fields, ["video_id", "label_id"])
    return parse_tag_fields(rows, [*keys, "timestamp_ms", "source", "score", "match_iou"], cfg)


def tags_to_csv(recognized: DataFrame, filename: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Final rows as the sink writes them."""
    rows = recognized
    if "code_values" in rows.columns and dict(rows.dtypes)["code_values"].startswith("array"):
        rows = rows.withColumn("code_values", F.to_json("code_values"))
    return fuse_final_rows(rows, filename, keep, for_sink=True)


def parse_crops(
    crops: DataFrame, keys: list[str], order: list[str], variants: DataFrame, promo: DataFrame, catalog: DataFrame,
    max_rows: int | None = None, codes: DataFrame | None = None,
) -> DataFrame:
    """Crops with any price or code field, in report order; optionally the first ``max_rows``.

    ``codes`` has what was read in a crop, by ``keys``: ``code_values`` in the order of reading.
    """
    texts = best_ocr_variant(variants).select("tag_id", "raw_text")
    best = best_promo_result(promo).select("tag_id", *("confidence", "price_card", "price_default", "discount_amount"))
    rows = crops.join(texts, "tag_id", "left")
    out = recognize_detections(rows, keys, catalog, codes=codes, promo=crops.select(*keys).join(best, "tag_id"))
    out = out.filter(sc.has_signal(out.columns)).orderBy(*order)
    return out if max_rows is None else out.limit(max_rows)


def build_training_set(
    labels: DataFrame, videos: DataFrame, val_ratio: float = 0.2, seed: int = 42, class_id: int = 0
) -> DataFrame:
    """Labelled frames with their label lines and split."""
    return split_train_val(agg.group_label_frames(labels, videos, class_id), "image_name", val_ratio, seed)


def run_summary(items: DataFrame, **parameters) -> DataFrame:
    """One JSON row of counts and parameters."""
    counts = items.agg(
        F.count("*").alias("items_total"), F.count_if(F.col("split") == "train").alias("items_train"),
        F.count_if(F.col("split") == "val").alias("items_val"), F.sum("boxes_count").alias("boxes_total"),
    )
    fixed = [F.lit(value).alias(name) for name, value in sorted(parameters.items())]
    return counts.select(F.to_json(F.struct("*", *fixed)).alias("summary"))
