"""Box geometry."""

from pyspark.sql import functions as F

from shelfgrid.functions import geometry as g
from shelfgrid.queries import sqltext as s
from shelfgrid.queries.registry import query

KEY = ["video_id", "frame_index", "candidate_index"]
KEY_SQL = "video_id, frame_index, candidate_index"
FW, FH = 3840, 2160

# A second box per row: the first one moved by data-dependent amounts.
OTHER = {
    "o_x_min": "x_min + CAST(text_density * 100 AS INT) - 40",
    "o_y_min": "y_min + candidate_index * 7 - 20",
    "o_x_max": "x_max + CAST(rectangularity * 100 AS INT) - 60",
    "o_y_max": "y_max + candidate_index * 3 - 5",
}
PAIR_SQL = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in OTHER.items())} FROM det) p".replace(
    "CAST(text_density * 100 AS INT)", "CAST(trunc(text_density * 100) AS INT)"
).replace("CAST(rectangularity * 100 AS INT)", "CAST(trunc(rectangularity * 100) AS INT)")


def pairs(t):
    return t.det.select("*", *(F.expr(e).alias(n) for n, e in OTHER.items()))


def ab():
    return g.box(), g.box("o_")


@query("box_measures", "det", f"""
    SELECT {KEY_SQL}, {s.w()} AS width, {s.h()} AS height, {s.area()} AS area, {s.aspect()} AS aspect,
           (x_min + x_max) / 2.0E0 AS center_x, (y_min + y_max) / 2.0E0 AS center_y FROM det""")
def box_measures(t):
    b = g.box()
    return t.det.select(
        *KEY, b.width.alias("width"), b.height.alias("height"), b.area.alias("area"), b.aspect.alias("aspect"),
        b.center_x.alias("center_x"), b.center_y.alias("center_y"),
    )


@query("box_clamp", "det", f"""
    SELECT {KEY_SQL}, {s.clamp_select('x_min - 40', 'y_min - 40', 'x_max + 900', 'y_max + 700', FW, FH)} FROM det""")
def box_clamp(t):
    b = g.box()
    moved = g.Box(b.x_min - 40, b.y_min - 40, b.x_max + 900, b.y_max + 700)
    return t.det.select(*KEY, *g.clamp(moved, FW, FH).columns())


@query("box_expand", "det", f"""
    SELECT {KEY_SQL}, {s.clamp_select('x1', 'y1', 'x2', 'y2', FW, FH)}
    FROM (SELECT {KEY_SQL}, {s.trunc('x_min - 2.5E0 * ' + s.w())} AS x1, {s.trunc('y_min - 0.8E0 * ' + s.h())} AS y1,
                 {s.trunc('x_max + 0.33E0 * ' + s.w())} AS x2, {s.trunc('y_max + 3.5E0 * ' + s.h())} AS y2 FROM det) e""")
def box_expand(t):
    return t.det.select(*KEY, *g.expand(g.box(), FW, FH, left=2.5, top=0.8, right=0.33, bottom=3.5).columns())


@query("box_union", "det", f"""
    SELECT {KEY_SQL}, least(x_min, o_x_min) AS x_min, least(y_min, o_y_min) AS y_min,
           greatest(x_max, o_x_max) AS x_max, greatest(y_max, o_y_max) AS y_max FROM {PAIR_SQL}""")
def box_union(t):
    return pairs(t).select(*KEY, *g.union(*ab()).columns())


@query("box_intersection", "det", f"""
    SELECT {KEY_SQL}, {s.inter('p.', 'p.o_')} AS intersection FROM {PAIR_SQL}""")
def box_intersection(t):
    return pairs(t).select(*KEY, g.intersection(*ab()).alias("intersection"))


@query("box_iou", "det", f"SELECT {KEY_SQL}, {s.iou('p.', 'p.o_')} AS iou FROM {PAIR_SQL}")
def box_iou(t):
    return pairs(t).select(*KEY, g.iou(*ab()).alias("iou"))


@query("box_contains_ratio", "det", f"""
    SELECT {KEY_SQL}, {s.contains('p.', 'p.o_')} AS a_contains_b, {s.contains('p.o_', 'p.')} AS b_contains_a FROM {PAIR_SQL}""")
def box_contains_ratio(t):
    a, b = ab()
    return pairs(t).select(
        *KEY, g.contains_ratio(a, b).alias("a_contains_b"), g.contains_ratio(b, a).alias("b_contains_a")
    )


MODES = ("none", "rot90_ccw", "rot90_cw", "rot180")


@query("box_rotate", "det", f"""
    SELECT {KEY_SQL}, mode,
           CASE mode WHEN 'none' THEN x_min WHEN 'rot90_ccw' THEN y_min WHEN 'rot90_cw' THEN {FH} - y_max ELSE {FW} - x_max END AS x_min,
           CASE mode WHEN 'none' THEN y_min WHEN 'rot90_ccw' THEN {FW} - x_max WHEN 'rot90_cw' THEN x_min ELSE {FH} - y_max END AS y_min,
           CASE mode WHEN 'none' THEN x_max WHEN 'rot90_ccw' THEN y_max WHEN 'rot90_cw' THEN {FH} - y_min ELSE {FW} - x_min END AS x_max,
           CASE mode WHEN 'none' THEN y_max WHEN 'rot90_ccw' THEN {FW} - x_min WHEN 'rot90_cw' THEN x_max ELSE {FH} - y_min END AS y_max
    FROM (SELECT *, CASE candidate_index % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'rot90_ccw' WHEN 2 THEN 'rot90_cw' ELSE 'rot180' END AS mode FROM det) m""")
def box_rotate(t):
    mode = F.element_at(F.array(*(F.lit(m) for m in MODES)), F.col("candidate_index") % 4 + 1)
    rows = t.det.withColumn("mode", mode)
    return rows.select(*KEY, "mode", *g.rotate(g.box(), FW, FH, F.col("mode")).columns())


@query("box_pad", "det", f"""
    SELECT {KEY_SQL}, {s.clamp_select('x_min - px', 'y_min - py', 'x_max + px', 'y_max + py', FW, FH)}
    FROM (SELECT *, greatest(8, {s.trunc(s.w() + ' * 0.12E0')}) AS px, greatest(8, {s.trunc(s.h() + ' * 0.12E0')}) AS py FROM det) e""")
def box_pad(t):
    return t.det.select(*KEY, *g.pad(g.box(), FW, FH).columns())


@query("box_expand_by_aspect", "det", f"""
    SELECT {KEY_SQL}, {s.clamp_select('x1', 'y1', 'x2', 'y2', FW, FH)}
    FROM (SELECT {KEY_SQL}, {s.trunc('x_min - hp * bw')} AS x1, {s.trunc('y_min - vp * bh')} AS y1,
                 {s.trunc('x_max + hp * bw')} AS x2, {s.trunc('y_max + vp * bh')} AS y2
          FROM (SELECT *, greatest(1, {s.w()}) AS bw, greatest(1, {s.h()}) AS bh,
                       CASE WHEN {s.aspect()} >= 2.2 THEN 0.6E0 WHEN {s.aspect()} <= 0.45 THEN 2.4E0 ELSE 1.0E0 END AS hp,
                       CASE WHEN {s.aspect()} >= 2.2 THEN 2.4E0 WHEN {s.aspect()} <= 0.45 THEN 0.6E0 ELSE 1.0E0 END AS vp FROM det) a) e""")
def box_expand_by_aspect(t):
    return t.det.select(*KEY, *g.expand_by_aspect(g.box(), FW, FH, padding=0.6).columns())


def _overlap_sql(axis):
    return f"greatest(0, least({axis}_max, o_{axis}_max) - greatest({axis}_min, o_{axis}_min))"


@query("axis_overlap", "det", f"""
    SELECT {KEY_SQL}, {_overlap_sql('x')} AS overlap_x, {_overlap_sql('y')} AS overlap_y,
           {_overlap_sql('y')} >= 0.35E0 * least({s.h('p.')}, {s.h('p.o_')}) AS same_row,
           {_overlap_sql('x')} >= 0.35E0 * least({s.w('p.')}, {s.w('p.o_')}) AS same_column FROM {PAIR_SQL}""")
def axis_overlap(t):
    a, b = ab()
    return pairs(t).select(
        *KEY,
        g.axis_overlap(a.x_min, a.x_max, b.x_min, b.x_max).alias("overlap_x"),
        g.axis_overlap(a.y_min, a.y_max, b.y_min, b.y_max).alias("overlap_y"),
        g.same_row(a, b).alias("same_row"),
        g.same_column(a, b).alias("same_column"),
    )


@query("near_frame_edge", "det", f"""
    SELECT {KEY_SQL}, {s.near_edge('')} AS near_edge, {s.near_edge('', margin=4)} AS touches_border FROM det""")
def near_frame_edge(t):
    b = g.box()
    return t.det.select(
        *KEY, g.near_edge(b, FW, FH, 180).alias("near_edge"), g.near_edge(b, FW, FH, 4).alias("touches_border")
    )


@query("box_cap_size", "det", f"""
    WITH big AS (SELECT {KEY_SQL}, x_min AS a_x_min, y_min AS a_y_min, x_max AS a_x_max, y_max AS a_y_max,
                        x_min - 500 AS x_min, y_min - 300 AS y_min, x_max + 400 AS x_max, y_max + candidate_index * 90 AS y_max FROM det),
         cut AS (SELECT *, {s.w()} <= 1344 AND {s.h()} <= 756 AS fits, (a_x_min + a_x_max) / 2.0E0 AS cx, (a_y_min + a_y_max) / 2.0E0 AS cy,
                        least({s.w()}, 1344) / 2.0E0 AS hw, least({s.h()}, 756) / 2.0E0 AS hh FROM big),
         cap AS (SELECT {KEY_SQL}, fits, x_min AS bx1, y_min AS by1, x_max AS bx2, y_max AS by2,
                        {s.trunc('cx - hw')} AS x1, {s.trunc('cy - hh')} AS y1, {s.trunc('cx + hw')} AS x2, {s.trunc('cy + hh')} AS y2 FROM cut),
         clamped AS (SELECT *, {s.clamp_select('x1', 'y1', 'x2', 'y2', FW, FH)} FROM cap)
    SELECT {KEY_SQL}, CASE WHEN fits THEN bx1 ELSE x_min END AS x_min, CASE WHEN fits THEN by1 ELSE y_min END AS y_min,
           CASE WHEN fits THEN bx2 ELSE x_max END AS x_max, CASE WHEN fits THEN by2 ELSE y_max END AS y_max FROM clamped""")
def box_cap_size(t):
    b = g.box()
    big = g.Box(b.x_min - 500, b.y_min - 300, b.x_max + 400, b.y_max + F.col("candidate_index") * 90)
    return t.det.select(*KEY, *g.cap_size(big, b, FW, FH).columns())


@query("clamp_detection", "det", f"""
    SELECT * FROM (SELECT {KEY_SQL}, {s.clip("CAST(round_even(x_min + 0.5E0, 0) AS INT)", 0, FW - 1)} AS x_min,
           {s.clip("CAST(round_even(y_min - 9.5E0, 0) AS INT)", 0, FH - 1)} AS y_min,
           {s.clip("CAST(round_even(x_max + 900.5E0, 0) AS INT)", 0, FW - 1)} AS x_max,
           {s.clip("CAST(round_even(y_max + 0.25E0, 0) AS INT)", 0, FH - 1)} AS y_max FROM det) c
    WHERE x_max > x_min AND y_max > y_min""")
def clamp_detection(t):
    b = g.box()
    raw = g.Box(b.x_min + F.lit(0.5), b.y_min - F.lit(9.5), b.x_max + F.lit(900.5), b.y_max + F.lit(0.25))
    out = t.det.select(*KEY, *g.clamp_detection(raw, FW, FH).columns())
    return out.filter("x_max > x_min AND y_max > y_min")


@query("box_from_points", "det", f"""
    SELECT {KEY_SQL}, {s.trunc('least(x_min / 2.0E0, (x_max - 300) / 2.0E0)')} AS x_min, {s.trunc('least(y_min, y_max) / 2.0E0')} AS y_min,
           {s.trunc('greatest(x_max / 2.0E0, (x_max - 300) / 2.0E0)')} AS x_max, {s.trunc('greatest(y_min, y_max) / 2.0E0')} AS y_max FROM det""")
def box_from_points(t):
    b = g.box()
    points = F.array(
        F.struct(b.x_min.alias("x"), b.y_max.alias("y")),
        F.struct(b.x_max.alias("x"), b.y_min.alias("y")),
        F.struct((b.x_max - 300).alias("x"), b.y_min.alias("y")),
    )
    return t.det.select(*KEY, *g.from_points(points, scale=2.0).columns())


@query("label_box_normalize", "det", f"""
    WITH raw AS (SELECT {KEY_SQL}, {s.clip('CAST(x_max - 200 AS DOUBLE)', '0.0E0', '3839.0E0')} AS xa, {s.clip('CAST(x_min AS DOUBLE)', '0.0E0', '3839.0E0')} AS xb,
                        {s.clip('CAST(y_min AS DOUBLE)', '0.0E0', '2159.0E0')} AS ya, {s.clip('CAST(y_max - 90 AS DOUBLE)', '0.0E0', '2159.0E0')} AS yb FROM det),
         b AS (SELECT {KEY_SQL}, least(xa, xb) AS x1, greatest(xa, xb) AS x2, least(ya, yb) AS y1, greatest(ya, yb) AS y2 FROM raw)
    SELECT {KEY_SQL}, x1 AS x_min, y1 AS y_min, x2 AS x_max, y2 AS y_max,
           printf('%d %.6f %.6f %.6f %.6f', 0, ((x1 + x2) / 2.0E0) / 3840, ((y1 + y2) / 2.0E0) / 2160, (x2 - x1) / 3840, (y2 - y1) / 2160) AS line
    FROM b WHERE x2 - x1 > 2 AND y2 - y1 > 2""")
def label_box_normalize(t):
    b = g.box()
    raw = g.Box(b.x_max - 200, b.y_min, b.x_min, b.y_max - 90)
    rows = t.det.select(*KEY, *g.clip_label(raw, FW, FH).columns())
    rows = rows.filter("x_max - x_min > 2 AND y_max - y_min > 2")
    return rows.withColumn("line", g.training_line(g.box(), FW, FH))


@query("match_score", "det", f"SELECT {KEY_SQL}, {s.match_score('p.', 'p.o_')} AS match_score FROM {PAIR_SQL}")
def match_score(t):
    return pairs(t).select(*KEY, g.match_score(*ab()).alias("match_score"))


@query("detection_quality", "det", f"SELECT {KEY_SQL}, {s.quality()} AS quality FROM det")
def detection_quality(t):
    return t.det.select(*KEY, g.detection_quality(g.box(), F.col("score"), F.col("source")).alias("quality"))


@query("to_global_box", "det crop_codes", f"""
    WITH padded AS (SELECT video_id, frame_index, candidate_index AS box_id, {s.clamp_select(s.trunc('x_min - 0.1E0 * ' + s.w()), s.trunc('y_min - 0.1E0 * ' + s.h()),
                           s.trunc('x_max + 0.1E0 * ' + s.w()), s.trunc('y_max + 0.1E0 * ' + s.h()), FW, FH)} FROM det)
    SELECT c.video_id, c.frame_index, c.box_id, c.value, concat('crop_', c.source) AS source, least(1.0E0, c.confidence + 0.03E0) AS confidence,
           {s.clamp_select('c.x_min + p.x_min', 'c.y_min + p.y_min', 'c.x_max + p.x_min', 'c.y_max + p.y_min', FW, FH)}
    FROM crop_codes c JOIN padded p ON c.video_id = p.video_id AND c.frame_index = p.frame_index AND c.box_id = p.box_id
    WHERE p.x_max - p.x_min >= 40 AND p.y_max - p.y_min >= 40""")
def to_global_box(t):
    from shelfgrid.operators.joins import codes_to_frame

    boxes = t.det.select("video_id", "frame_index", F.col("candidate_index").alias("box_id"), "x_min", "y_min", "x_max", "y_max")
    return codes_to_frame(t.crop_codes, boxes).select(
        "video_id", "frame_index", "box_id", "value", "source", "confidence", "x_min", "y_min", "x_max", "y_max"
    )
