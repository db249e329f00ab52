"""Overlap, interval and enumerated joins."""

from pyspark.sql import functions as F

from shelfgrid.functions import text as x
from shelfgrid.operators import joins as j
from shelfgrid.queries import sqltext as s
from shelfgrid.queries.boxes import FH, FW, KEY, KEY_SQL
from shelfgrid.queries.registry import query
from shelfgrid.queries.scores import CLAMPED, REGION, r

BOX = "x_min, y_min, x_max, y_max"
SAME_FRAME = "a.video_id = b.video_id AND a.frame_index = b.frame_index"


@query("boost_with_text", "candidates", f"""
    WITH hits AS (SELECT a.video_id, a.frame_index, a.candidate_index, count(*) AS n, max(b.text_density) AS d
                  FROM candidates a JOIN candidates b ON {SAME_FRAME} AND a.source = 'rectangular_region' AND b.source = 'text_like_region'
                   AND ({s.contains('a.', 'b.')} >= 0.45 OR {s.iou('a.', 'b.')} >= 0.10) GROUP BY ALL)
    SELECT c.video_id, c.frame_index, c.candidate_index, CASE WHEN n IS NULL THEN source ELSE 'mixed' END AS source,
           CASE WHEN n IS NULL THEN score ELSE least(1.0E0, score + (0.15E0 + 0.20E0 * least(d, 1.0E0))) END AS score,
           has_text OR n IS NOT NULL AS has_text, CASE WHEN n IS NULL THEN text_density ELSE greatest(text_density, d) END AS text_density, n AS text_regions_inside
    FROM candidates c LEFT JOIN hits USING ({KEY_SQL})""")
def boost_with_text(t):
    return j.boost_with_text(t.candidates).select(*KEY, "source", "score", "has_text", "text_density", "text_regions_inside")


@query("boost_with_codes", "candidates codes", f"""
    WITH hits AS (SELECT b.video_id, b.frame_index, b.candidate_index, bool_or(b.q) AS q, bool_or(b.bc) AS bc,
                         array_to_string(list_transform(list_sort(list(struct_pack(i := b.i, v := b.value))), lambda e: e.v), '|') AS vals
                  FROM (SELECT a.video_id, a.frame_index, a.candidate_index, b.value, min(b.code_index) AS i, bool_or(b.code_type = 'qr') AS q, bool_or(b.code_type = 'barcode') AS bc
                        FROM candidates a JOIN codes b ON {SAME_FRAME} AND ({s.contains('a.', 'b.')} >= 0.65 OR {s.iou('a.', 'b.')} >= 0.10) GROUP BY ALL) b GROUP BY ALL)
    SELECT c.video_id, c.frame_index, c.candidate_index, CASE WHEN q IS NULL THEN source ELSE 'mixed' END AS source,
           CASE WHEN q IS NULL THEN score ELSE least(1.0E0, score + (0.22E0 + CASE WHEN q THEN 0.08E0 ELSE 0.0E0 END + CASE WHEN bc THEN 0.05E0 ELSE 0.0E0 END + 0.08E0)) END AS score,
           has_qr OR coalesce(q, FALSE) AS has_qr, has_barcode OR coalesce(bc, FALSE) AS has_barcode, coalesce(vals, '') AS code_values
    FROM candidates c LEFT JOIN hits USING ({KEY_SQL})""")
def boost_with_codes(t):
    out = j.boost_with_codes(t.candidates, t.codes)
    return out.select(*KEY, "source", "score", "has_qr", "has_barcode", F.array_join("code_values", "|").alias("code_values"))


def band_side():
    gx, gy = f"greatest(8, {s.trunc(s.w('w.') + ' * 0.15E0')})", f"greatest(8, {s.trunc(s.h('w.') + ' * 0.25E0')})"
    px, py = s.trunc(s.w("w.") + " * 0.45E0"), s.trunc(s.h("w.") + " * 0.45E0")
    cx = f"CAST(greatest(0, least(w.x_max, c.x_max) - greatest(w.x_min, c.x_min)) AS DOUBLE) / greatest(1, {s.w('w.')})"
    cy = f"CAST(greatest(0, least(w.y_max, c.y_max) - greatest(w.y_min, c.y_min)) AS DOUBLE) / greatest(1, {s.h('w.')})"
    wide = f"{cx} >= 0.55 AND {s.aspect('c.')} >= 1.0"
    tall = f"{cy} >= 0.45 AND {s.h('c.')} >= {s.w('c.')} * 0.5E0"
    return (
        f"CASE WHEN c.y_min - w.y_max <= {gy} AND c.y_max >= w.y_min + {py} AND {wide} THEN 'bottom'"
        f" WHEN w.y_min - c.y_max <= {gy} AND c.y_min <= w.y_max - {py} AND {wide} THEN 'top'"
        f" WHEN c.x_min - w.x_max <= {gx} AND c.x_max >= w.x_min + {px} AND {tall} THEN 'right'"
        f" WHEN w.x_min - c.x_max <= {gx} AND c.x_min <= w.x_max - {px} AND {tall} THEN 'left' END"
    )


def extension(white):
    """CTEs that fold colour bands into white boxes with a list reduction."""
    ux1, uy1 = "least(acc.x_min, c.x_min)", "least(acc.y_min, c.y_min)"
    ux2, uy2 = "greatest(acc.x_max, c.x_max)", "greatest(acc.y_max, c.y_max)"
    return f"""
    white AS ({white}),
    color AS (SELECT * FROM {CLAMPED} k WHERE kind = 'color' AND {s.w()} >= 15 AND {s.h()} >= 8 AND (red_ratio >= 0.05 OR yellow_ratio >= 0.05)),
    sided AS (SELECT w.video_id, w.frame_index, w.region_index, w.x_min AS wx1, w.y_min AS wy1, w.x_max AS wx2, w.y_max AS wy2,
                     struct_pack(pos := c.region_index, x_min := c.x_min, y_min := c.y_min, x_max := c.x_max, y_max := c.y_max) AS band, {band_side()} AS side
              FROM white w JOIN color c ON w.video_id = c.video_id AND w.frame_index = c.frame_index),
    listed AS (SELECT video_id, frame_index, region_index, wx1, wy1, wx2, wy2, list_sort(list(band)) AS bands FROM sided WHERE side IS NOT NULL GROUP BY ALL),
    folded AS (SELECT video_id, frame_index, region_index, list_reduce(bands, lambda acc, c:
                 CASE WHEN ({ux2} - {ux1}) * ({uy2} - {uy1}) <= (wx2 - wx1) * (wy2 - wy1) * 2.8E0
                      THEN struct_pack(pos := acc.pos + 1, x_min := {ux1}, y_min := {uy1}, x_max := {ux2}, y_max := {uy2}) ELSE acc END,
                 struct_pack(pos := 0, x_min := wx1, y_min := wy1, x_max := wx2, y_max := wy2)) AS f FROM listed),
    grown AS (SELECT w.* EXCLUDE (x_min, y_min, x_max, y_max), coalesce(f.x_min, w.x_min) AS x_min, coalesce(f.y_min, w.y_min) AS y_min,
                     coalesce(f.x_max, w.x_max) AS x_max, coalesce(f.y_max, w.y_max) AS y_max, coalesce(f.pos, 0) > 0 AS extended
              FROM white w LEFT JOIN folded USING ({REGION}))"""


@query("extend_to_color_band", "regions", f"""
    WITH {extension(f"SELECT * FROM {CLAMPED} k WHERE kind = 'white'")} SELECT {REGION}, {BOX}, extended FROM grown""")
def extend_to_color_band(t):
    regions = t.regions
    out = j.extend_to_color_band(regions.filter("kind = 'white'"), regions.filter("kind = 'color'"), FW, FH)
    return out.select("video_id", "frame_index", "region_index", "x_min", "y_min", "x_max", "y_max", "extended")


WHITE = f"""SELECT * FROM {CLAMPED} k WHERE kind = 'white' AND {s.area()} / 8294400.0E0 BETWEEN 0.0005 AND 0.08 AND {s.w()} >= 35 AND {s.h()} >= 20
            AND {s.aspect()} BETWEEN 0.25 AND 5.8 AND white_ratio >= 0.35 AND rectangularity >= 0.25"""


@query("score_white_regions", "regions", f"""
    WITH {extension(WHITE)}, colored AS (SELECT *,
        CASE WHEN red_ratio >= 0.08 AND red_ratio >= yellow_ratio THEN 'red' WHEN yellow_ratio >= 0.08 AND yellow_ratio > red_ratio THEN 'yellow' ELSE 'none' END AS bottom_band_color,
        CASE WHEN red_ratio < 0.05 AND yellow_ratio < 0.05 THEN 'none' WHEN red_ratio >= yellow_ratio THEN 'red' ELSE 'yellow' END AS side_band_color FROM grown)
    SELECT {REGION}, 'color_region' AS source, {BOX}, bottom_band_color, side_band_color, extended, {r('white_ratio', 4)} AS white_ratio,
           {r('rectangularity', 4)} AS rectangularity, {r(s.area() + ' / 8294400.0E0', 5)} AS area_ratio,
           least(greatest(0.10E0 + 0.18E0 * rectangularity + 0.12E0 * least(white_ratio / 0.70E0, 1.0E0) + CASE WHEN extended THEN 0.08E0 ELSE 0.0E0 END
             + CASE WHEN bottom_band_color <> 'none' THEN 0.05E0 ELSE 0.0E0 END + CASE WHEN side_band_color <> 'none' THEN 0.04E0 ELSE 0.0E0 END, 0.0E0), 0.40E0) AS score
    FROM colored""")
def score_white_regions(t):
    return j.score_white_regions(t.regions, FW, FH)


def roi_sql():
    def ratio(p, q):
        return f"CAST(greatest({p}, {q}) AS DOUBLE) / greatest(1, least({p}, {q}))"

    row = f"greatest(0, least(c.y_max, w.y_max) - greatest(c.y_min, w.y_min)) >= 0.35E0 * least({s.h('c.')}, {s.h('w.')})"
    col = f"greatest(0, least(c.x_max, w.x_max) - greatest(c.x_min, w.x_min)) >= 0.35E0 * least({s.w('c.')}, {s.w('w.')})"
    mg = lambda f: f"greatest(14, {s.trunc(f'least({f(chr(99) + chr(46))}, {f(chr(119) + chr(46))}) * 0.75E0')})"
    gap_x = "greatest(0, greatest(c.x_min, w.x_min) - least(c.x_max, w.x_max))"
    gap_y = "greatest(0, greatest(c.y_min, w.y_min) - least(c.y_max, w.y_max))"
    close = f"{ratio(s.area('c.'), s.area('w.'))} <= 5.5"
    near = (
        f"(({row} AND {ratio(s.h('c.'), s.h('w.'))} <= 3.2 AND {close} AND {gap_x} <= {mg(s.h and s.w)})"
        f" OR ({col} AND {ratio(s.w('c.'), s.w('w.'))} <= 3.2 AND {close} AND {gap_y} <= {mg(s.h)}))"
    )
    border = "{0}.x_min > 4 AND {0}.y_min > 4 AND {0}.x_max < 1196 AND {0}.y_max < 896 AND {0}.x_max - {0}.x_min >= 12 AND {0}.y_max - {0}.y_min >= 10"
    return row, col, near, border


ROW, COL, NEAR, BORDER = roi_sql()


@query("pair_color_white", "crop_boxes", f"""
    WITH pairs AS (SELECT c.video_id, c.frame_index, c.region_index AS ci, w.region_index AS wi, c.x_min AS cx1, c.x_max AS cx2, c.y_min AS cy1, c.y_max AS cy2,
                          w.x_min AS wx1, w.x_max AS wx2, w.y_min AS wy1, w.y_max AS wy2, {ROW} AS is_row, {COL} AS is_col, {s.area('c.')} + {s.area('w.')} AS both_area,
                          (greatest(c.x_max, w.x_max) - least(c.x_min, w.x_min)) * (greatest(c.y_max, w.y_max) - least(c.y_min, w.y_min)) AS union_area
                   FROM crop_boxes c JOIN crop_boxes w ON c.video_id = w.video_id AND c.frame_index = w.frame_index AND c.kind = 'color' AND w.kind = 'white'
                    AND {BORDER.format('c')} AND {BORDER.format('w')} AND {s.area('c.')} >= 3240 AND {s.area('w.')} BETWEEN 6480 AND 453600
                    AND NOT ({s.w('w.')} >= 864 AND {s.h('w.')} >= 648) AND {NEAR}),
         best AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY both_area * (CAST(both_area AS DOUBLE) / greatest(1, union_area)) DESC, ci, wi) AS rk
                  FROM pairs WHERE CAST(both_area AS DOUBLE) / greatest(1, union_area) >= 0.32),
         u AS (SELECT *, least(cx1, wx1) AS ux1, greatest(cx2, wx2) AS ux2, least(cy1, wy1) AS uy1, greatest(cy2, wy2) AS uy2,
                      greatest(cx2 - cx1, wx2 - wx1) AS bw, greatest(cy2 - cy1, wy2 - wy1) AS bh FROM best WHERE rk = 1),
         p AS (SELECT *, greatest(14, {s.trunc('0.26E0 * (ux2 - ux1)')}) AS px0, greatest(12, {s.trunc('0.34E0 * (uy2 - uy1)')}) AS py0,
                      wy1 + wy2 < cy1 + cy2 AS above, wx1 + wx2 < cx1 + cx2 AS lefty FROM u),
         q AS (SELECT *, CASE WHEN is_col THEN greatest(px0, {s.trunc('0.48E0 * bw')}) WHEN is_row THEN greatest(px0, bw) ELSE px0 END AS px,
                      CASE WHEN is_col THEN greatest(py0, {s.trunc('1.05E0 * bh')}) WHEN is_row THEN greatest(py0, {s.trunc('0.58E0 * bh')}) ELSE py0 END AS py,
                      CASE WHEN is_col THEN CASE WHEN above THEN {s.trunc('0.95E0 * bh')} ELSE {s.trunc('0.35E0 * bh')} END ELSE 0 END AS up,
                      CASE WHEN is_col THEN CASE WHEN above THEN {s.trunc('0.35E0 * bh')} ELSE {s.trunc('0.95E0 * bh')} END ELSE 0 END AS down,
                      CASE WHEN is_row AND NOT is_col THEN CASE WHEN lefty THEN {s.trunc('0.9E0 * bw')} ELSE {s.trunc('0.4E0 * bw')} END ELSE 0 END AS west,
                      CASE WHEN is_row AND NOT is_col THEN CASE WHEN lefty THEN {s.trunc('0.4E0 * bw')} ELSE {s.trunc('0.9E0 * bw')} END ELSE 0 END AS east FROM p)
    SELECT video_id, frame_index, ci AS color_index, wi AS white_index, greatest(0, ux1 - west - px) AS x_min, greatest(0, uy1 - up - py) AS y_min,
           least(1200, ux2 + east + px) AS x_max, least(900, uy2 + down + py) AS y_max FROM q""")
def pair_color_white(t):
    return j.pair_color_white(t.crop_boxes, 1200, 900)


WORDS = "(SELECT tag_id, word_seq, text, conf, left_px AS x_min, top_px AS y_min, left_px + width AS x_max, top_px + height AS y_max, row_number() OVER (PARTITION BY tag_id ORDER BY word_seq, conf, text, left_px, top_px, width) AS seq FROM ocr_words)"


def words(t):
    from pyspark.sql import Window

    order = Window.partitionBy("tag_id").orderBy("word_seq", "conf", "text", "left_px", "top_px", "width")
    return t.ocr_words.select(
        "tag_id", F.row_number().over(order).alias("word_seq"), "text", "conf", F.col("left_px").alias("x_min"), F.col("top_px").alias("y_min"),
        (F.col("left_px") + F.col("width")).alias("x_max"), (F.col("top_px") + F.col("height")).alias("y_max"),
    )


@query("pair_rub_kop", "ocr_words", f"""
    WITH d AS (SELECT tag_id, seq, text AS digits, {BOX}, y_max - y_min AS h, x_max - x_min AS w, (y_min + y_max) / 2.0E0 AS yc, (x_min + x_max) / 2.0E0 AS xc FROM {WORDS} q),
         m AS (SELECT tag_id, quantile_cont(CAST(h AS DOUBLE), 0.5) AS med FROM d WHERE length(digits) >= 2 GROUP BY tag_id),
         rub AS (SELECT d.*, med FROM d JOIN m USING (tag_id) WHERE length(digits) BETWEEN 2 AND 5 AND CAST(digits AS INT) >= 10)
    SELECT tag_id, seq AS word_seq, -1 AS kop_seq, CAST(digits AS INT) AS cents, 0.45E0 + least(h / greatest(med, 1.0E0), 2.0E0) * 0.12E0 AS score, 'word_compact' AS source, {BOX}
    FROM rub WHERE length(digits) >= 4 AND CAST(digits AS INT) >= 1000
    UNION ALL
    SELECT r.tag_id, r.seq, k.seq, CAST(concat(r.digits, k.digits) AS INT),
           0.65E0 + (CASE WHEN r.h >= r.med * 1.4E0 THEN 0.20E0 ELSE 0.0E0 END) + (CASE WHEN k.x_min >= r.x_max - {s.trunc('0.10E0 * r.w')} THEN 0.10E0 ELSE 0.0E0 END)
             + greatest(0.0E0, 0.10E0 - abs(k.yc - r.yc) / greatest(r.h * 6.0E0, 1.0E0)), 'rub_kop_pair',
           least(r.x_min, k.x_min), least(r.y_min, k.y_min), greatest(r.x_max, k.x_max), greatest(r.y_max, k.y_max)
    FROM rub r JOIN d k ON r.tag_id = k.tag_id AND r.seq <> k.seq AND length(k.digits) = 2 AND k.x_min >= r.xc AND k.x_min - r.x_max <= greatest(12, {s.trunc('r.h * 2.8E0')})
     AND k.yc <= r.y_max + r.h * 0.45E0 AND k.yc >= r.y_min - r.h * 0.80E0 AND k.h <= r.h * 1.25E0""")
def pair_rub_kop(t):
    return j.pair_rub_kop(words(t))


PICKED = """
    picked AS (SELECT tag_id, text, score, pos, row_number() OVER (PARTITION BY tag_id ORDER BY score DESC, pos) AS i FROM priced)"""


@query("choose_price_pair_structured", "promo_results", """
    WITH c AS (SELECT tag_id, orientation_index, result_id, [struct_pack(cents := 1000 + result_id * 37 % 90000, score := 0.85E0), struct_pack(cents := 1500 + result_id * 101 % 70000, score := 0.75E0),
                      struct_pack(cents := 1200 + result_id * 53 % 9000, score := 0.52E0)] AS cs, 1 + result_id % 95 AS pct FROM promo_results),
         i AS (SELECT *, unnest([1, 1, 2]) AS a, unnest([2, 3, 3]) AS b FROM c),
         p AS (SELECT *, greatest(cs[a].cents, cs[b].cents) AS hi, least(cs[a].cents, cs[b].cents) AS lo, CASE WHEN pct BETWEEN 1 AND 90 THEN pct END AS wanted FROM i),
         q AS (SELECT *, round_even((1.0E0 - (lo / 100.0E0) / (hi / 100.0E0)) * 100.0E0, 0) AS calc FROM p WHERE hi > lo AND (hi / 100.0E0) / greatest(lo / 100.0E0, 1.0E0) <= 4.0),
         z AS (SELECT *, cs[a].score + cs[b].score + CASE WHEN wanted IS NOT NULL THEN greatest(0.0E0, 1.0E0 - abs(calc - wanted) / 15.0E0) ELSE 0.0E0 END
                         - CASE WHEN abs(calc - wanted) > 18 THEN 0.75E0 ELSE 0.0E0 END + 0.25E0 AS total FROM q),
         b AS (SELECT tag_id, orientation_index, result_id, max(struct_pack(total := total, na := -a, nb := -b, hi := hi, lo := lo, calc := calc)) AS m FROM z GROUP BY ALL),
         u AS (SELECT DISTINCT tag_id, orientation_index, result_id, cs FROM c)
    SELECT tag_id, orientation_index, result_id, m.hi AS price_default, coalesce(m.lo, cs[1].cents) AS price_card, CAST(m.calc AS INT) AS calc_discount,
           CASE WHEN m IS NULL THEN 'fallback_best_single' ELSE 'pair_selected' END AS reason FROM u LEFT JOIN b USING (tag_id, orientation_index, result_id)""")
def choose_price_pair_structured(t):
    rid = F.col("result_id")

    def c(base, mul, mod, score):
        return F.struct((F.lit(base) + rid * mul % mod).alias("cents"), F.lit(score).alias("score"))

    cands = F.array(c(1000, 37, 90000, 0.85), c(1500, 101, 70000, 0.75), c(1200, 53, 9000, 0.52))
    discount = F.concat(F.lit("-"), (F.lit(1) + rid % 95).cast("string"), F.lit("%"))
    rows = t.promo_results.select("tag_id", "orientation_index", "result_id").distinct()
    rows = rows.select("*", x.choose_price_pair_structured(cands, discount).alias("p"))
    return rows.select("tag_id", "orientation_index", "result_id", "p.price_default", "p.price_card", "p.calc_discount", "p.reason")


LABEL_PAIRS = f"""
    pairs AS (SELECT a.video_id, a.frame_index * 1000 + a.candidate_index AS det, b.label_id AS lab, {s.iou('a.', 'b.')} AS iou
              FROM det a JOIN labels_gt b ON a.video_id = b.video_id AND abs(b.frame_timestamp - a.timestamp_ms) <= 2000
               AND a.x_min < b.x_max AND b.x_min < a.x_max AND a.y_min < b.y_max AND b.y_min < a.y_max),
    listed AS (SELECT video_id, list(struct_pack(det := det, lab := lab, iou := iou) ORDER BY det, iou DESC, lab) AS ps FROM pairs GROUP BY video_id),
    folded AS (SELECT video_id, list_reduce(ps, lambda acc, p: CASE WHEN p.det = acc.det OR list_contains(acc.used, p.lab) THEN acc
                   WHEN p.iou < 0.25 THEN struct_pack(det := p.det, used := acc.used, dets := acc.dets, ious := acc.ious)
                   ELSE struct_pack(det := p.det, used := list_append(acc.used, p.lab), dets := list_append(acc.dets, p.det), ious := list_append(acc.ious, p.iou)) END,
                 struct_pack(det := -1, used := CAST([] AS INT[]), dets := CAST([] AS INT[]), ious := CAST([] AS DOUBLE[]))) AS f FROM listed),
    matches AS (SELECT video_id, unnest(f.dets) AS det, unnest(f.used) AS label_id, unnest(f.ious) AS match_iou FROM folded)"""


@query("match_labels", "det labels_gt", f"""
    WITH {LABEL_PAIRS} SELECT video_id, det // 1000 AS frame_index, det % 1000 AS candidate_index, label_id, match_iou FROM matches""")
def match_labels(t):
    return j.match_labels(t.det, t.labels_gt)


@query("label_eval", "det labels_gt", f"""
    WITH {LABEL_PAIRS}, n AS (SELECT video_id, sum(d) AS d, sum(l) AS l, sum(m) AS tp FROM (
        SELECT video_id, 1 AS d, 0 AS l, 0 AS m FROM det UNION ALL SELECT video_id, 0, 1, 0 FROM labels_gt UNION ALL SELECT video_id, 0, 0, 1 FROM matches) u GROUP BY video_id)
    SELECT video_id, tp, d - tp AS fp, l - tp AS fn, CASE WHEN d > 0 THEN CAST(tp AS DOUBLE) / d END AS precision, CASE WHEN l > 0 THEN CAST(tp AS DOUBLE) / l END AS recall FROM n""")
def label_eval(t):
    det, labels = t.det, t.labels_gt
    return j.label_eval(det, labels, j.match_labels(det, labels))


@query("pair_tracks_detections", "det", f"""
    WITH d AS (SELECT video_id, frame_index, candidate_index, x_min, y_min, x_max, y_max, {s.w()} AS w, {s.h()} AS h, (x_min + x_max) / 2.0E0 AS cx,
                      (y_min + y_max) / 2.0E0 AS cy, {s.near_edge('')} AS e, frame_index // 36 AS bucket FROM det),
         later AS (SELECT *, unnest([bucket, bucket - 1]) AS meet FROM d),
         met AS (SELECT a.video_id, a.frame_index, a.candidate_index, b.frame_index AS next_frame, b.candidate_index AS next_candidate, a.e OR b.e AS edge,
                        CAST({s.inter('a.', 'b.')} AS DOUBLE) AS shared, a.w * a.h + b.w * b.h AS areas, a.cx - b.cx AS dx, a.cy - b.cy AS dy,
                        greatest(80.0E0, CAST(greatest(a.w, a.h, b.w, b.h) AS DOUBLE)) AS reach,
                        CAST(least(a.w, b.w) AS DOUBLE) / CAST(greatest(1, a.w, b.w) AS DOUBLE) AS rw, CAST(least(a.h, b.h) AS DOUBLE) / CAST(greatest(1, a.h, b.h) AS DOUBLE) AS rh
                 FROM d a JOIN later b ON a.video_id = b.video_id AND a.bucket = b.meet AND b.frame_index > a.frame_index AND b.frame_index - a.frame_index <= 36),
         rated AS (SELECT *, CASE WHEN areas - shared <= 0 THEN 0.0E0 ELSE shared / (areas - shared) END AS i,
                          greatest(0.0E0, 1.0E0 - sqrt(dx * dx + dy * dy) / (reach * (CASE WHEN edge THEN 3.2E0 * 1.9E0 ELSE 3.2E0 END))) AS c FROM met),
         scored AS (SELECT *, CASE WHEN i < (CASE WHEN edge THEN 0.0E0 ELSE 0.04E0 END) AND c < (CASE WHEN edge THEN 0.38E0 ELSE 0.55E0 END) THEN 0.0E0
                                   WHEN edge THEN 0.45E0 * i + 0.45E0 * c + 0.10E0 * (0.5E0 * rw + 0.5E0 * rh)
                                   ELSE 0.58E0 * i + 0.30E0 * c + 0.12E0 * (0.5E0 * rw + 0.5E0 * rh) END AS match_score FROM rated)
    SELECT video_id, frame_index, candidate_index, next_frame, next_candidate, match_score FROM scored WHERE match_score >= 0.27""")
def pair_tracks_detections(t):
    return j.pair_successors(t.det)


@query("match_video", "labels_gt videos", """
    WITH files AS (SELECT DISTINCT concat('out/labeled/', video_id, '.csv') AS label_path, video_id FROM labels_gt)
    SELECT label_path, concat('in/videos/', v.video_id, '.mp4') AS video_path, fps, frame_count FROM files f JOIN videos v ON v.video_id = f.video_id""")
def match_video(t):
    files = t.labels_gt.select(F.concat(F.lit("out/labeled/"), "video_id", F.lit(".csv")).alias("label_path")).distinct()
    videos = t.videos.select(F.concat(F.lit("in/videos/"), "video_id", F.lit(".mp4")).alias("video_path"), "fps", "frame_count")
    return j.match_video(files, videos).select("label_path", "video_path", "fps", "frame_count")


@query("join_track_boxes", "det", """
    WITH tracks AS (SELECT video_id, candidate_index AS track_id FROM det GROUP BY ALL HAVING count(*) > 60)
    SELECT d.video_id, d.candidate_index AS track_id, d.frame_index, d.candidate_index, d.x_min, d.y_min, d.x_max, d.y_max,
           CAST(trunc((x_min + x_max) / 2.0E0) AS INT) AS center_x, CAST(trunc((y_min + y_max) / 2.0E0) AS INT) AS center_y,
           row_number() OVER (PARTITION BY d.video_id, d.candidate_index ORDER BY d.frame_index) AS trail_position
    FROM det d JOIN tracks t ON d.video_id = t.video_id AND d.candidate_index = t.track_id""")
def join_track_boxes(t):
    rows = t.det.withColumn("track_id", F.col("candidate_index"))
    tracks = rows.groupBy("video_id", "track_id").count().filter("count > 60")
    return j.join_track_boxes(rows, tracks)


def boxes_list(growth):
    def grown(g):
        left, top, right, bottom = g
        x1, y1 = s.trunc(f"x_min - {left}E0 * w"), s.trunc(f"y_min - {top}E0 * h")
        x2, y2 = s.trunc(f"x_max + {right}E0 * w"), s.trunc(f"y_max + {bottom}E0 * h")
        cx, cy = s.clip(x1, 0, FW - 1), s.clip(y1, 0, FH - 1)
        return f"struct_pack(x_min := {cx}, y_min := {cy}, x_max := {s.clip(x2, cx + ' + 1', FW)}, y_max := {s.clip(y2, cy + ' + 1', FH)})"

    return "[" + ", ".join(grown(g).replace("-0.0E0", "0.0E0").replace("--", "- -") for g in growth) + "]"


def dedupe(boxes, threshold):
    return (
        f"list_reduce({boxes}, lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: {s.iou('k.', 'c.')} >= {threshold})) > 0 THEN acc ELSE list_append(acc, c) END,"
        " CAST([] AS STRUCT(x_min INT, y_min INT, x_max INT, y_max INT)[]))"
    )


CAPPED = f"""list_transform(raw, lambda b: CASE WHEN b.x_max - b.x_min <= 1344 AND b.y_max - b.y_min <= 756 THEN b ELSE struct_pack(
      x_min := {s.clip(s.trunc('ax - least(b.x_max - b.x_min, 1344) / 2.0E0'), 0, FW - 1)}, y_min := {s.clip(s.trunc('ay - least(b.y_max - b.y_min, 756) / 2.0E0'), 0, FH - 1)},
      x_max := {s.clip(s.trunc('ax + least(b.x_max - b.x_min, 1344) / 2.0E0'), 1, FW)}, y_max := {s.clip(s.trunc('ay + least(b.y_max - b.y_min, 756) / 2.0E0'), 1, FH)}) END)"""


@query("anchor_hypotheses", "codes", f"""
    WITH a AS (SELECT video_id, frame_index, code_index, code_type, value, (x_min + x_max) / 2.0E0 AS ax, (y_min + y_max) / 2.0E0 AS ay, {boxes_list(j.ANCHOR_PRESETS)} AS raw
               FROM (SELECT *, {s.w()} AS w, {s.h()} AS h FROM codes) c),
         d AS (SELECT *, {dedupe(CAPPED, 0.85)} AS kept FROM a),
         e AS (SELECT *, unnest(kept) AS b, generate_subscripts(kept, 1) - 1 AS hyp FROM d)
    SELECT video_id, frame_index, code_index, hyp AS anchor_hypothesis, concat(code_type, '_anchor') AS source, value,
           greatest(0.0E0, least(1.0E0, (CASE WHEN code_type = 'qr' THEN 0.95E0 ELSE 0.88E0 END) - hyp * 0.06E0)) AS score, b.x_min AS x_min, b.y_min AS y_min, b.x_max AS x_max, b.y_max AS y_max FROM e""")
def anchor_hypotheses(t):
    out = j.anchor_hypotheses(t.codes, FW, FH)
    return out.select("video_id", "frame_index", "code_index", "anchor_hypothesis", "source", "value", "score", "x_min", "y_min", "x_max", "y_max")


@query("layout_hypotheses", "regions", f"""
    WITH comp AS (SELECT *, {s.w()} AS w, {s.h()} AS h FROM {CLAMPED} k WHERE kind = 'color' AND {s.w()} >= 28 AND {s.h()} >= 22 AND {s.area()} / 8294400.0E0 BETWEEN 0.00025 AND 0.035
                    AND {s.aspect()} BETWEEN 0.18 AND 3.2 AND rectangularity >= 0.28),
         d AS (SELECT *, {dedupe(boxes_list(j.layout_growth()), 0.995)} AS kept FROM comp),
         e AS (SELECT video_id, frame_index, region_index, rectangularity, red_ratio, yellow_ratio, w * h AS carea, unnest(kept) AS b, generate_subscripts(kept, 1) - 1 AS hyp FROM d),
         f AS (SELECT *, b.x_min AS x_min, b.y_min AS y_min, b.x_max AS x_max, b.y_max AS y_max, CASE WHEN red_ratio < 0.05 AND yellow_ratio < 0.05 THEN 'yellow' WHEN red_ratio >= yellow_ratio THEN 'red' ELSE 'yellow' END AS color FROM e),
         q AS (SELECT *, CAST(carea AS DOUBLE) / greatest(1, {s.area()}) AS share FROM f)
    SELECT video_id, frame_index, region_index AS layout_component_id, hyp AS layout_hypothesis, x_min, y_min, x_max, y_max, color AS color_band_kind, {r('share', 4)} AS color_coverage,
           greatest(0.0E0, least(0.82E0, 0.58E0 + 0.12E0 * rectangularity + (CASE WHEN color = 'red' THEN 0.06E0 ELSE 0.0E0 END) + (CASE WHEN share BETWEEN 0.22 AND 0.55 THEN 0.08E0 ELSE 0.0E0 END))) AS score
    FROM q WHERE {s.w()} >= 45 AND {s.h()} >= 30 AND {s.area()} / 8294400.0E0 BETWEEN 0.00045 AND 0.09 AND {s.aspect()} BETWEEN 0.25 AND 5.8 AND share BETWEEN 0.12 AND 0.72""")
def layout_hypotheses(t):
    parts = t.regions.filter("kind = 'color'").withColumn("component_color", F.lit("yellow"))
    out = j.layout_hypotheses(parts, FW, FH)
    return out.select(
        "video_id", "frame_index", "layout_component_id", "layout_hypothesis", "x_min", "y_min", "x_max", "y_max",
        "color_band_kind", "color_coverage", "score",
    )
