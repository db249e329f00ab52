"""Gates, filters and scores."""

from pyspark.sql import functions as F

from shelfgrid.functions import geometry as g
from shelfgrid.functions import scores as sc
from shelfgrid.queries import sqltext as s
from shelfgrid.queries.boxes import FH, FW, KEY, KEY_SQL
from shelfgrid.queries.registry import query
from shelfgrid.queries.values import KEY as TAG_KEY

K = ", ".join(TAG_KEY)
BOX = "x_min, y_min, x_max, y_max"


def r(x, n):
    """Value as printed with n digits."""
    return f"CAST(printf('%.{n}f', {x}) AS DOUBLE)"


@query("filter_by_geometry", "det", f"""
    SELECT {KEY_SQL}, {BOX} FROM det WHERE {s.area()} / 8294400.0E0 BETWEEN 0.0025 AND 0.18 AND {s.aspect()} BETWEEN 0.20 AND 3.0""")
def filter_by_geometry(t):
    from shelfgrid.config import DetectConfig

    cfg = DetectConfig(min_area_ratio=0.0025, max_aspect=3.0)
    return sc.filter_by_geometry(t.det, FW, FH, cfg).select(*KEY, "x_min", "y_min", "x_max", "y_max")


@query("track_prefilter", "det", f"""
    SELECT {KEY_SQL} FROM det WHERE score >= 0.50 AND {s.w()} >= 55 AND {s.h()} >= 45 AND {s.area()} BETWEEN 2000 AND 500000
           AND {s.aspect()} BETWEEN 0.18 AND 7.0""")
def track_prefilter(t):
    return t.det.filter(sc.track_gate(g.box(), F.col("score"))).select(*KEY)


@query("is_promising", "det", f"""
    SELECT {KEY_SQL} FROM det WHERE least(x_min, y_min) >= 12 AND x_max <= 3828 AND y_max <= 2148 AND {s.w()} >= 90 AND {s.h()} >= 70
       AND (contains(source, 'anchor') OR (source = 'promo_color_layout' AND score >= 0.74) OR (source = 'mixed' AND score >= 0.70 AND {s.area()} <= 180000))""")
def is_promising(t):
    return t.det.filter(sc.is_promising(g.box(), F.col("source"), F.col("score"))).select(*KEY)


@query("filter_final_candidates", "candidates", f"""
    SELECT {KEY_SQL}, score FROM (SELECT *, has_qr OR has_barcode OR contains(source, 'anchor') AS has_code FROM candidates) c WHERE
      CASE WHEN source = 'promo_color_layout' THEN score >= 0.55 AND has_text
           WHEN NOT has_code AND area_ratio > 0.07 THEN FALSE
           WHEN has_code AND score >= 0.45 THEN TRUE
           WHEN source = 'mixed' THEN score >= 0.5 AND (has_code OR (has_rect AND has_text AND text_density >= 0.12) OR (has_text AND score >= 0.62))
           WHEN source = 'rectangular_region' THEN has_text AND score >= 0.55 AND text_density >= 0.18 AND rectangularity >= 0.35 AND edge_density >= 0.025
           WHEN source = 'text_like_region' THEN score >= 0.62 AND text_density >= 0.35
           WHEN source IN ('color_region', 'color_band_region') THEN FALSE
           ELSE score >= 0.75 AND (has_code OR has_text) END""")
def filter_final_candidates(t):
    return t.candidates.filter(sc.is_final_candidate()).select(*KEY, "score")


def gtin_sql(d):
    p = f"lpad({d}, 14, '0')"
    total = " + ".join(f"CAST(substring({p}, {i + 1}, 1) AS INT) * {3 if i % 2 == 0 else 1}" for i in range(13))
    return f"((10 - ({total}) % 10) % 10 = CAST(substring({p}, 14, 1) AS INT))"


@query("is_valid_code", "code_values", f"""
    WITH c AS (SELECT *, CASE WHEN regexp_matches(value, '^[0-9]+$') AND length(value) IN (8, 12, 13, 14) AND len(list_distinct(string_split(value, ''))) > 2
                   THEN length(value) = 14 OR {gtin_sql('value')} ELSE FALSE END AS digits_ok FROM code_values)
    SELECT {K} FROM c WHERE length(value) BETWEEN 4 AND 800
       AND CASE WHEN code_type = 'barcode' THEN digits_ok
                ELSE length(value) >= 6 AND (regexp_matches(value, 'barcode|price|p1|p2|p3|p4|actioncode|wholesale|wl1|wl2|sku|id|code')
                     OR (regexp_matches(value, '[=&?{{}}:;|]') AND length(value) >= 8)
                     OR (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]') AND length(value) >= 10) OR digits_ok) END
       AND {s.w()} >= 6 AND {s.h()} >= 6 AND {s.area()} / 8294400.0E0 BETWEEN 0.000005 AND 0.25
       AND {s.aspect()} BETWEEN 0.45 AND CASE WHEN code_type = 'qr' THEN 2.2 ELSE 15.0 END""")
def is_valid_code(t):
    ok = sc.is_valid_code(g.box(), F.col("value"), F.col("code_type"), FW, FH)
    return t.code_values.filter(ok).select(*TAG_KEY)


@query("has_signal", "promo_results", """
    SELECT tag_id, orientation_index, result_id FROM promo_results
    WHERE (price_card IS NOT NULL AND price_card NOT IN ('-', 'нет')) OR (price_default IS NOT NULL AND price_default NOT IN ('-', 'нет'))
       OR (discount_amount IS NOT NULL AND discount_amount NOT IN ('-', 'нет'))""")
def has_signal(t):
    rows = t.promo_results
    return rows.filter(sc.has_signal(rows.columns)).select("tag_id", "orientation_index", "result_id")


REGION = "video_id, frame_index, region_index"
CLAMPED = f"(SELECT {REGION}, kind, rectangularity, edge_density, text_fill, white_ratio, red_ratio, yellow_ratio, {s.clamp_select('x_min', 'y_min', 'x_max', 'y_max', FW, FH)} FROM regions)"


@query("score_rectangle_regions", "regions", f"""
    SELECT {REGION}, 'rectangular_region' AS source, {BOX}, {r('rectangularity', 4)} AS rectangularity, {r('edge_density', 4)} AS edge_density, {r('ratio', 5)} AS area_ratio,
           least(greatest(0.12E0 + 0.40E0 * rectangularity + 0.30E0 * least(edge_density / 0.12E0, 1.0E0)
             + 0.10E0 * CASE WHEN ratio <= 0 THEN 0.0E0 WHEN ratio < 0.001 THEN 0.35E0 WHEN ratio < 0.01 THEN 1.0E0 WHEN ratio < 0.04 THEN 0.75E0
                             WHEN ratio < 0.08 THEN 0.35E0 ELSE 0.0E0 END, 0.0E0), 0.78E0) AS score
    FROM (SELECT *, {s.area()} / 8294400.0E0 AS ratio FROM {CLAMPED} b WHERE kind = 'rectangle') q
    WHERE {s.w()} >= 35 AND {s.h()} >= 20 AND ratio BETWEEN 0.0004 AND 0.08 AND {s.aspect()} BETWEEN 0.25 AND 5.5 AND edge_density >= 0.025 AND rectangularity >= 0.25""")
def score_rectangle_regions(t):
    return sc.score_rectangle_regions(t.regions, FW, FH)


@query("score_color_bands", "regions", f"""
    WITH gated AS (SELECT *, CASE WHEN red_ratio < 0.05 AND yellow_ratio < 0.05 THEN 'none' WHEN red_ratio >= yellow_ratio THEN 'red' ELSE 'yellow' END AS color
                   FROM {CLAMPED} b WHERE kind = 'color' AND {s.w()} >= 35 AND {s.h()} >= 12 AND {s.area()} / 8294400.0E0 BETWEEN 0.0003 AND 0.05
                     AND {s.aspect()} BETWEEN 1.20 AND 10.0 AND rectangularity >= 0.20),
         grown AS (SELECT {REGION}, color, rectangularity, {s.clamp_select(s.trunc('x_min - 0.10E0 * ' + s.w()), s.trunc('y_min - 1.40E0 * ' + s.h()),
                          s.trunc('x_max + 0.10E0 * ' + s.w()), s.trunc('y_max + 0.15E0 * ' + s.h()), FW, FH)} FROM gated WHERE color <> 'none')
    SELECT {REGION}, 'color_band_region' AS source, color AS color_band_kind, {BOX}, least(greatest(0.18E0 + 0.12E0 * rectangularity, 0.0E0), 0.34E0) AS score,
           {r('rectangularity', 4)} AS rectangularity, {r(s.area() + ' / 8294400.0E0', 5)} AS area_ratio FROM grown""")
def score_color_bands(t):
    return sc.score_color_bands(t.regions, FW, FH)


@query("tag_color", "tag_color_ratios", f"""
    WITH e AS (SELECT {K}, white_ratio AS w, greatest(yellow_ratio, bottom_yellow_ratio * 0.9E0) AS y, greatest(red_ratio, bottom_red_ratio * 0.9E0) AS r FROM tag_color_ratios)
    SELECT {K}, CASE WHEN r >= 0.10 AND y >= 0.10 THEN 'смешанный' WHEN r >= 0.08 AND r >= y * 1.15E0 THEN 'красный'
                     WHEN y >= 0.08 AND y >= r * 1.05E0 THEN 'желтый' WHEN w >= 0.25 AND greatest(y, r) < 0.08 THEN 'белый' END AS color,
           CASE WHEN r >= 0.10 AND y >= 0.10 THEN least(1.0E0, r + y) WHEN r >= 0.08 AND r >= y * 1.15E0 THEN least(1.0E0, r * 2.5E0)
                WHEN y >= 0.08 AND y >= r * 1.05E0 THEN least(1.0E0, y * 2.5E0) WHEN w >= 0.25 AND greatest(y, r) < 0.08 THEN least(1.0E0, w * 1.5E0)
                ELSE greatest(w, y, r) END AS confidence FROM e""")
def tag_color(t):
    color, confidence = sc.tag_color()
    return t.tag_color_ratios.select(*TAG_KEY, color.alias("color"), confidence.alias("confidence"))


@query("frame_quality", "frame_features", """
    WITH p AS (SELECT video_id, frame_index, greatest(0.0E0, least(1.0E0, sharpness / 500.0E0)) AS s1, greatest(0.0E0, least(1.0E0, contrast / 64.0E0)) AS c1,
                      greatest(0.0E0, least(1.0E0, 1.0E0 - abs(brightness - 128.0E0) / 128.0E0)) AS b1, greatest(0.0E0, least(1.0E0, glare_ratio + dark_ratio)) AS e1,
                      greatest(0.0E0, least(1.0E0, (sharpness - 30.0E0) / 470.0E0)) AS s2, greatest(0.0E0, least(1.0E0, 1.0E0 - abs(brightness - 127.0E0) / 127.0E0)) AS b2,
                      greatest(0.0E0, least(1.0E0, (contrast - 20.0E0) / 60.0E0)) AS c2, greatest(0.0E0, least(1.0E0, glare_ratio * 3.0E0)) AS g2,
                      greatest(0.0E0, least(1.0E0, dark_ratio * 2.0E0)) AS d2, least(price_tag_ratio / 0.035E0, 1.0E0) AS t2 FROM frame_features)
    SELECT video_id, frame_index, greatest(0.0E0, least(1.0E0, 0.45E0 * s1 + 0.30E0 * c1 + 0.20E0 * b1 + 0.05E0 * (1.0E0 - e1))) AS sampler_score,
           greatest(0.0E0, least(1.0E0, (0.45E0 * s2 + 0.25E0 * b2 + 0.20E0 * c2 + 0.10E0 * (1.0E0 - g2)) * (1.0E0 - 0.5E0 * d2) + 0.18E0 * t2)) AS detailed_score FROM p""")
def frame_quality(t):
    exposure = F.col("glare_ratio") + F.col("dark_ratio")
    return t.frame_features.select(
        "video_id", "frame_index",
        sc.sampler_quality(F.col("sharpness"), F.col("contrast"), F.col("brightness"), exposure).alias("sampler_score"),
        sc.detailed_quality().alias("detailed_score"),
    )


def ocr_score_sql():
    def count(p):
        return f"length(regexp_replace(raw_text, '{p}', '', 'g'))"

    return (
        "(CASE WHEN length(trim(raw_text)) = 0 THEN 0.0E0 ELSE greatest(0.0E0, 0.25E0 * confidence + 0.25E0 * least(length(trim(raw_text)) / 140.0E0, 1.0E0)"
        f" + 0.25E0 * least({count('[^0-9]')} / 14.0E0, 1.0E0) + 0.15E0 * least({count('[^А-яЁё]')} / 24.0E0, 1.0E0) + 0.05E0 * least({count('[^A-z]')} / 18.0E0, 1.0E0)"
        " + (CASE variant WHEN 'crop' THEN 0.05E0 WHEN 'crop_rot90_ccw' THEN 0.03E0 ELSE 0.0E0 END) - (CASE WHEN length(trim(raw_text)) < 4 THEN 0.30E0 ELSE 0.0E0 END)) END)"
    )


@query("ocr_candidate_score", "ocr_variants", f"""
    SELECT tag_id, variant_index, l_suppkey, l_partkey, {ocr_score_sql()} AS ocr_score FROM ocr_variants""")
def ocr_candidate_score(t):
    score = sc.ocr_candidate_score(F.col("raw_text"), F.col("confidence"), F.col("variant"))
    return t.ocr_variants.select("tag_id", "variant_index", "l_suppkey", "l_partkey", score.alias("ocr_score"))


PROMO_SQL = """(confidence + (CASE WHEN price_card IS NOT NULL THEN 0.18E0 ELSE 0.0E0 END) + (CASE WHEN price_default IS NOT NULL THEN 0.12E0 ELSE 0.0E0 END)
      + (CASE WHEN discount_amount IS NOT NULL THEN 0.08E0 ELSE 0.0E0 END)
      + (CASE variant WHEN 'crop' THEN 0.04E0 WHEN 'crop_rot90_ccw' THEN 0.03E0 ELSE 0.0E0 END))"""


@query("promo_score", "promo_results", f"SELECT tag_id, orientation_index, result_id, {PROMO_SQL} AS promo_score FROM promo_results")
def promo_score(t):
    score = sc.promo_score(*(F.col(c) for c in ("confidence", "price_card", "price_default", "discount_amount", "variant")))
    return t.promo_results.select("tag_id", "orientation_index", "result_id", score.alias("promo_score"))


@query("parse_confidence", "promo_results", """
    SELECT tag_id, orientation_index, result_id,
           least(1.0E0, (CASE WHEN result_id % 2 = 0 THEN 0.18E0 ELSE 0.0E0 END) + (CASE WHEN price_card IS NOT NULL THEN 0.38E0 ELSE 0.0E0 END)
             + (CASE WHEN price_default IS NOT NULL THEN 0.28E0 ELSE 0.0E0 END) + (CASE WHEN discount_amount IS NOT NULL THEN 0.16E0 ELSE 0.0E0 END)
             + (CASE WHEN tag_width >= 80 AND tag_height >= 45 THEN 0.08E0 ELSE 0.0E0 END)) AS promo_confidence,
           least(1.0E0, (CASE WHEN variant = 'crop' THEN 0.16E0 ELSE 0.0E0 END) + (CASE WHEN price_card IS NOT NULL THEN 0.26E0 ELSE 0.0E0 END)
             + (CASE WHEN price_default IS NOT NULL THEN 0.22E0 ELSE 0.0E0 END) + (CASE WHEN discount_amount IS NOT NULL THEN 0.12E0 ELSE 0.0E0 END)
             + (CASE WHEN result_id % 7 = 0 THEN 0.12E0 ELSE 0.0E0 END) + (CASE WHEN result_id % 5 = 1 THEN 0.06E0 ELSE 0.0E0 END) + (CASE WHEN result_id % 3 = 1 THEN 0.06E0 ELSE 0.0E0 END)
             + (CASE WHEN price_card IS NOT NULL AND price_default IS NOT NULL THEN 0.08E0 ELSE 0.0E0 END)
             + (CASE WHEN abs(result_id % 40 - result_id % 25) <= 10 THEN 0.08E0 ELSE 0.0E0 END)) AS parse_confidence FROM promo_results""")
def parse_confidence(t):
    c = F.col
    values = {
        "product_name": F.when(c("variant") == "crop", c("variant")), "price_card": c("price_card"),
        "price_default": c("price_default"), "discount_amount": c("discount_amount"),
        "barcode": F.when(c("result_id") % 7 == 0, "1"), "id_sku": F.when(c("result_id") % 5 == 1, "1"),
        "print_datetime": F.when(c("result_id") % 3 == 1, "1"),
    }
    both = c("price_card").isNotNull() & c("price_default").isNotNull()
    return t.promo_results.select(
        "tag_id", "orientation_index", "result_id",
        sc.promo_confidence(
            c("result_id") % 2 == 0, c("price_card"), c("price_default"), c("discount_amount"), c("tag_width"), c("tag_height")
        ).alias("promo_confidence"),
        sc.parse_confidence(values, both, c("result_id") % 40, c("result_id") % 25).alias("parse_confidence"),
    )
