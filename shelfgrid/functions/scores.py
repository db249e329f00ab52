"""Gates and scores of candidates, codes, frames and recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgrid.config import DetectConfig, TrackConfig
from shelfgrid.functions import geometry as g
from shelfgrid.functions.numbers import exact_round
from shelfgrid.functions.values import strip

# Words that mark a decoded string as a price-tag QR payload.
QR_TOKENS = (
    "barcode", "price", "price1", "price2", "price3", "price4", "p1", "p2", "p3", "p4", "actionprice",
    "actioncode", "wholesale", "wl1", "wl2", "sku", "id", "code",
)
# Fields whose presence makes a parsed tag worth a row.
SIGNAL_FIELDS = (
    "price_default", "price_card", "price_discount", "barcode", "discount_amount", "id_sku", "qr_code_barcode",
    "price1_qr", "price2_qr", "price3_qr", "price4_qr", "action_price_qr", "action_code_qr",
)


def clip01(c: Column, high: float = 1.0) -> Column:
    return g.clip(c, 0.0, high)


def geometry_gate(b: g.Box, width, height, cfg: DetectConfig = DetectConfig()) -> Column:
    frame_area = F.lit(width) * F.lit(height)
    ratio = b.area / F.when(frame_area > 0, frame_area)
    return ratio.between(cfg.min_area_ratio, cfg.max_area_ratio) & b.aspect.between(cfg.min_aspect, cfg.max_aspect)


def filter_by_geometry(df: DataFrame, width: int, height: int, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    return df.filter(geometry_gate(g.box(), width, height, cfg))


def track_gate(b: g.Box, score: Column, cfg: TrackConfig = TrackConfig()) -> Column:
    return (
        (score >= cfg.min_score)
        & (b.width >= cfg.min_width)
        & (b.height >= cfg.min_height)
        & b.area.between(cfg.min_area, cfg.max_area)
        & b.aspect.between(cfg.min_aspect, cfg.max_aspect)
    )


def is_promising(b: g.Box, source: Column, score: Column) -> Column:
    inside = (F.least(b.x_min, b.y_min) >= 12) & (b.x_max <= 3828) & (b.y_max <= 2148)
    kind = (
        source.contains("anchor")
        | ((source == "promo_color_layout") & (score >= 0.74))
        | ((source == "mixed") & (score >= 0.70) & (b.area <= 180_000))
    )
    return inside & (b.width >= 90) & (b.height >= 70) & kind


def is_final_candidate(min_score: float = 0.50) -> Column:
    """Acceptance rules by source, over the flat evidence columns of a candidate."""
    source, score = F.col("source"), F.col("score")
    text, density = F.col("has_text"), F.col("text_density")
    code = F.col("has_qr") | F.col("has_barcode") | source.contains("anchor")
    structured = code | (F.col("has_rect") & text & (density >= 0.12)) | (text & (score >= 0.62))
    return (
        F.when(source == "promo_color_layout", (score >= 0.55) & text)
        .when(~code & (F.col("area_ratio") > 0.07), False)
        .when(code & (score >= 0.45), True)
        .when(source == "mixed", (score >= min_score) & structured)
        .when(
            source == "rectangular_region",
            text & (score >= 0.55) & (density >= 0.18) & (F.col("rectangularity") >= 0.35) & (F.col("edge_density") >= 0.025),
        )
        .when(source == "text_like_region", (score >= 0.62) & (density >= 0.35))
        .when(source.isin("color_region", "color_band_region"), False)
        .otherwise((score >= 0.75) & (code | text))
    )


def gtin_checksum_ok(digits: Column) -> Column:
    """Mod-10 check with weights 3, 1 from the right; lengths 8, 12, 13 and 14."""
    padded = F.lpad(digits, 14, "0")

    def digit_sum(text: Column) -> Column:
        return F.aggregate(F.split(text, ""), F.lit(0), lambda total, d: total + F.coalesce(d.try_cast("int"), F.lit(0)))

    weighted = digit_sum(F.regexp_replace(padded, r"(.).", "$1")) * 3 + digit_sum(F.regexp_replace(padded, r".(.)", "$1"))
    shaped = digits.rlike(r"^(?:[0-9]{8}|[0-9]{12,14})$")
    return F.coalesce(shaped & (weighted % 10 == 0), F.lit(False))


def _barcode_value_ok(value: Column) -> Column:
    compact = F.translate(value, " -", "")
    varied = F.size(F.array_distinct(F.split(compact, ""))) > 2
    return compact.rlike(r"^(?:[0-9]{8}|[0-9]{12,14})$") & varied & ((F.length(compact) == 14) | gtin_checksum_ok(compact))


def code_value_ok(value: Column, code_type: Column) -> Column:
    text = strip(value)
    size = F.length(text)
    printable = F.length(F.regexp_replace(text, r"[\x00-\x08\x0e-\x1f\x7f]", ""))
    low = F.lower(text)
    token = low.rlike("|".join(QR_TOKENS))
    structural = text.rlike(r"[=&?{}:;|]") & (size >= 8)
    letters_and_digits = text.rlike(r"\p{L}") & text.rlike(r"[0-9]") & (size >= 10)
    digits = text.rlike(r"^[0-9]+$") & _barcode_value_ok(text)
    qr = (size >= 6) & (token | structural | letters_and_digits | digits)
    base = size.between(4, 800) & (printable / F.greatest(size, F.lit(1)) >= 0.85) & ~text.contains("\u0000")
    return base & F.when(code_type == "barcode", _barcode_value_ok(text)).when(code_type == "qr", qr).otherwise(True)


def is_valid_code(b: g.Box, value: Column, code_type: Column, width: int, height: int) -> Column:
    ratio = b.area / F.lit(width * height)
    shape = (
        F.when(code_type == "qr", b.aspect.between(0.45, 2.20))
        .when(code_type == "barcode", b.aspect.between(0.45, 15.0))
        .otherwise(True)
    )
    return code_value_ok(value, code_type) & (b.width >= 6) & (b.height >= 6) & ratio.between(0.000005, 0.25) & shape


def has_signal(columns: list[str]) -> Column:
    fields = [f for f in SIGNAL_FIELDS if f in columns]
    return F.exists(F.array(*fields), lambda v: v.isNotNull() & ~v.isin("-", "нет"))


def size_score(ratio: Column) -> Column:
    return (
        F.when(ratio <= 0, 0.0).when(ratio < 0.001, 0.35).when(ratio < 0.01, 1.0).when(ratio < 0.04, 0.75)
        .when(ratio < 0.08, 0.35).otherwise(0.0)
    )


def score_rectangle_regions(regions: DataFrame, width: int, height: int) -> DataFrame:
    rows = _clamped(regions.filter(F.col("kind") == "rectangle"), width, height)
    b, ratio = g.box(), F.col("ratio")
    rows = rows.filter(
        (b.width >= 35) & (b.height >= 20) & ratio.between(0.0004, 0.08) & b.aspect.between(0.25, 5.5)
        & (F.col("edge_density") >= 0.025) & (F.col("rectangularity") >= 0.25)
    )
    score = (
        F.lit(0.12)
        + F.lit(0.40) * F.col("rectangularity")
        + F.lit(0.30) * F.least(F.col("edge_density") / F.lit(0.12), F.lit(1.0))
        + F.lit(0.10) * size_score(ratio)
    )
    return rows.select(
        "video_id", "frame_index", "region_index", F.lit("rectangular_region").alias("source"),
        clip01(score, 0.78).alias("score"), *b.columns(),
        exact_round(F.col("rectangularity"), 4).alias("rectangularity"),
        exact_round(F.col("edge_density"), 4).alias("edge_density"),
        exact_round(ratio, 5).alias("area_ratio"),
    )


def _clamped(regions: DataFrame, width: int, height: int) -> DataFrame:
    b = g.clamp(g.box(), width, height)
    rows = regions.select(
        *(c for c in regions.columns if c not in ("x_min", "y_min", "x_max", "y_max")), *b.columns()
    )
    return rows.withColumn("ratio", g.box().area / F.lit(width * height))


def text_density(fill: Column) -> Column:
    return F.when(fill <= 0, 0.0).when(fill > 0.75, 0.15).otherwise(clip01(fill / F.lit(0.35)))


def text_region_gate(b: g.Box, width: int, height: int) -> Column:
    area = float(width * height)
    return (
        (b.area >= area * 0.0003) & (b.area <= area * 0.12) & (b.width >= 30) & (b.height >= 20)
        & b.aspect.between(0.15, 8.0)
    )


def score_text_boxes(groups: DataFrame, width: int, height: int) -> DataFrame:
    """Score grouped text boxes; ``text_fill`` is the share of the group box covered by text."""
    density = text_density(F.col("text_fill"))
    rows = groups.filter(g.box().area / F.lit(width * height) <= 0.12)
    return rows.withColumn("score", clip01(F.lit(0.25) + F.lit(0.45) * density, 0.72)).withColumn(
        "text_density", exact_round(density, 4)
    )


def dominant_color(red: Column, yellow: Column) -> Column:
    return F.when((red < 0.05) & (yellow < 0.05), "none").when(red >= yellow, "red").otherwise("yellow")


def bottom_band_color(red: Column, yellow: Column) -> Column:
    return (
        F.when((red >= 0.08) & (red >= yellow), "red").when((yellow >= 0.08) & (yellow > red), "yellow").otherwise("none")
    )


def white_region_gate(b: g.Box, ratio: Column) -> Column:
    return (
        ratio.between(0.0005, 0.08) & (b.width >= 35) & (b.height >= 20) & b.aspect.between(0.25, 5.8)
        & (F.col("white_ratio") >= 0.35) & (F.col("rectangularity") >= 0.25)
    )


def white_region_score(extended: Column, bottom: Column, side: Column) -> Column:
    score = F.lit(0.10) + F.lit(0.18) * F.col("rectangularity") + F.lit(0.12) * F.least(
        F.col("white_ratio") / F.lit(0.70), F.lit(1.0)
    )
    score = score + F.when(extended, 0.08).otherwise(0.0)
    score = score + F.when(bottom.isin("red", "yellow"), 0.05).otherwise(0.0)
    score = score + F.when(side.isin("red", "yellow"), 0.04).otherwise(0.0)
    return clip01(score, 0.40)


def score_color_bands(regions: DataFrame, width: int, height: int) -> DataFrame:
    rows = _clamped(regions.filter(F.col("kind") == "color"), width, height)
    b = g.box()
    color = dominant_color(F.col("red_ratio"), F.col("yellow_ratio"))
    rows = rows.filter(
        (b.width >= 35) & (b.height >= 12) & F.col("ratio").between(0.0003, 0.05) & b.aspect.between(1.20, 10.0)
        & (F.col("rectangularity") >= 0.20) & (color != "none")
    )
    grown = g.expand(b, width, height, left=0.10, top=1.40, right=0.10, bottom=0.15)
    return rows.select(
        "video_id", "frame_index", "region_index", F.lit("color_band_region").alias("source"),
        clip01(F.lit(0.18) + F.lit(0.12) * F.col("rectangularity"), 0.34).alias("score"),
        color.alias("color_band_kind"), *grown.columns(),
        exact_round(F.col("rectangularity"), 4).alias("rectangularity"),
        exact_round(grown.area / F.lit(width * height), 5).alias("area_ratio"),
    )


def tag_color() -> tuple[Column, Column]:
    """(colour, confidence) from the colour ratios of a tag crop."""
    white = F.col("white_ratio")
    yellow = F.greatest(F.col("yellow_ratio"), F.col("bottom_yellow_ratio") * F.lit(0.9))
    red = F.greatest(F.col("red_ratio"), F.col("bottom_red_ratio") * F.lit(0.9))
    rules = [
        ((red >= 0.10) & (yellow >= 0.10), "смешанный", red + yellow),
        ((red >= 0.08) & (red >= yellow * F.lit(1.15)), "красный", red * F.lit(2.5)),
        ((yellow >= 0.08) & (yellow >= red * F.lit(1.05)), "желтый", yellow * F.lit(2.5)),
        ((white >= 0.25) & (F.greatest(yellow, red) < 0.08), "белый", white * F.lit(1.5)),
    ]
    color, confidence = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], F.least(F.lit(1.0), rules[0][2]))
    for rule, name, strength in rules[1:]:
        color, confidence = color.when(rule, name), confidence.when(rule, F.least(F.lit(1.0), strength))
    return color, confidence.otherwise(F.greatest(white, yellow, red))


def rotation_mode(dx: Column, dy: Column) -> Column:
    ax, ay = F.abs(dx), F.abs(dy)
    return (
        F.when((ay > ax * F.lit(1.25)) & (ay > 0.30), F.when(dy > 0, "rot90_ccw").otherwise("rot90_cw"))
        .when((ax > ay * F.lit(1.25)) & (ax > 0.30), F.when(dx > 0, "none").otherwise("rot180"))
        .otherwise("none")
    )


def sampler_quality(sharpness: Column, contrast: Column, brightness: Column, exposure: Column) -> Column:
    bright = clip01(F.lit(1.0) - F.abs(brightness - F.lit(128.0)) / F.lit(128.0))
    return clip01(
        F.lit(0.45) * clip01(sharpness / F.lit(500.0))
        + F.lit(0.30) * clip01(contrast / F.lit(64.0))
        + F.lit(0.20) * bright
        + F.lit(0.05) * (F.lit(1.0) - clip01(exposure))
    )


def detailed_quality() -> Column:
    """Quality from the columns of the ``frame_features`` input."""
    sharp = clip01((F.col("sharpness") - F.lit(30.0)) / F.lit(470.0))
    bright = clip01(F.lit(1.0) - F.abs(F.col("brightness") - F.lit(127.0)) / F.lit(127.0))
    contrast = clip01((F.col("contrast") - F.lit(20.0)) / F.lit(60.0))
    glare = clip01(F.col("glare_ratio") * F.lit(3.0))
    dark = clip01(F.col("dark_ratio") * F.lit(2.0))
    base = (
        F.lit(0.45) * sharp + F.lit(0.25) * bright + F.lit(0.20) * contrast + F.lit(0.10) * (F.lit(1.0) - glare)
    ) * (F.lit(1.0) - F.lit(0.5) * dark)
    return clip01(base + F.lit(0.18) * F.least(F.col("price_tag_ratio") / F.lit(0.035), F.lit(1.0)))


def ocr_candidate_score(raw_text: Column, confidence: Column, variant: Column) -> Column:
    text = F.coalesce(raw_text, F.lit(""))
    size = F.length(strip(text))

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    def share(c: Column, full: float) -> Column:
        return F.least(c / F.lit(full), F.lit(1.0))

    bonus = F.when(variant == "crop", 0.05).when(variant == "crop_rot90_ccw", 0.03).otherwise(0.0)
    score = (
        F.lit(0.25) * confidence
        + F.lit(0.25) * share(size, 140.0)
        + F.lit(0.25) * share(count(r"[^0-9]"), 14.0)
        + F.lit(0.15) * share(count("[^А-яЁё]"), 24.0)
        + F.lit(0.05) * share(count("[^A-z]"), 18.0)
        + bonus
        - F.when(size < 4, 0.30).otherwise(0.0)
    )
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), score))


def _flag(c: Column, weight: float) -> Column:
    return F.when(c.isNotNull() & (c != ""), weight).otherwise(0.0)


def promo_score(confidence: Column, card: Column, default: Column, discount: Column, variant: Column) -> Column:
    bonus = F.when(variant == "crop", 0.04).when(variant == "crop_rot90_ccw", 0.03).otherwise(0.0)
    return confidence + _flag(card, 0.18) + _flag(default, 0.12) + _flag(discount, 0.08) + bonus


def promo_confidence(has_box: Column, card: Column, default: Column, discount: Column, w: Column, h: Column) -> Column:
    return clip01(
        F.when(has_box, 0.18).otherwise(0.0) + _flag(card, 0.38) + _flag(default, 0.28) + _flag(discount, 0.16)
        + F.when((w >= 80) & (h >= 45), 0.08).otherwise(0.0)
    )


def parse_confidence(values: dict[str, Column], pair_selected: Column, calc_discount: Column, read_discount: Column) -> Column:
    weights = {
        "product_name": 0.16, "price_card": 0.26, "price_default": 0.22, "discount_amount": 0.12, "barcode": 0.12,
        "id_sku": 0.06, "print_datetime": 0.06,
    }
    score = F.lit(0.0)
    for name, weight in weights.items():
        score = score + _flag(values[name], weight)
    score = score + F.when(pair_selected, 0.08).otherwise(0.0)
    return clip01(score + F.when(F.abs(calc_discount - read_discount) <= 10, 0.08).otherwise(0.0))
