"""Aggregations and set operations."""

from pyspark.sql import functions as F

from shelfgrid.functions import scores as sc
from shelfgrid.operators import aggregates as a
from shelfgrid.queries import sqltext as s
from shelfgrid.queries.joins import WORDS, words
from shelfgrid.queries.registry import query
from shelfgrid.queries.scores import r

BOX = "x_min, y_min, x_max, y_max"


@query("merge_evidence", "evidence", """
    WITH v AS (SELECT video_id, frame_index, code_value, min(candidate_index) AS i FROM evidence GROUP BY ALL),
         l AS (SELECT video_id, frame_index, string_agg(code_value, '|' ORDER BY i, code_value) AS code_values FROM v GROUP BY ALL)
    SELECT e.video_id, e.frame_index, bool_or(has_qr) AS has_qr, bool_or(has_text) AS has_text, max(text_density) AS text_density,
           max(rectangularity) AS rectangularity, max(hypothesis) AS hypothesis, any_value(code_values) AS code_values
    FROM evidence e JOIN l ON e.video_id = l.video_id AND e.frame_index = l.frame_index GROUP BY ALL""")
def merge_evidence(t):
    out = a.merge_evidence(
        t.evidence, ["video_id", "frame_index"], "candidate_index", ["has_qr", "has_text"],
        ["text_density", "rectangularity", "hypothesis"], "code_value",
    )
    return out.withColumn("code_values", F.array_join("code_values", "|"))


@query("summarize_tracks", "det", f"""
    WITH q AS (SELECT *, candidate_index AS track_id, {s.quality()} AS quality FROM det),
         k AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY quality DESC, frame_index) AS rk FROM q),
         g AS (SELECT video_id, track_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, min(timestamp_ms) AS t0, max(timestamp_ms) AS t1, count(*) AS detections_count FROM q GROUP BY ALL)
    SELECT g.video_id, g.track_id, start_frame, end_frame, {r('t0', 2)} AS start_timestamp_ms, {r('t1', 2)} AS end_timestamp_ms, {r('t1 - t0', 2)} AS duration_ms, detections_count,
           k.frame_index AS best_frame_index, {r('k.timestamp_ms', 2)} AS best_timestamp_ms, k.candidate_index AS best_candidate_index, {r('k.score', 4)} AS best_detection_score,
           {r('k.quality', 4)} AS best_track_score, k.source, k.x_min, k.y_min, k.x_max, k.y_max, {s.w('k.')} AS width, {s.h('k.')} AS height, {r(s.aspect('k.'), 4)} AS aspect_ratio
    FROM g JOIN k ON g.video_id = k.video_id AND g.track_id = k.track_id AND k.rk = 1""")
def summarize_tracks(t):
    return a.summarize_tracks(t.det.withColumn("track_id", F.col("candidate_index")))


NUM = "TRY_CAST(replace(replace({0}, ' ', ''), ',', '.') AS DOUBLE)"
LABEL_ITEMS = f"""
    parsed AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ordinal, {NUM.format('frame_timestamp')} AS ts,
                      {NUM.format('x_min')} AS a1, {NUM.format('y_min')} AS b1, {NUM.format('x_max')} AS a2, {NUM.format('y_max')} AS b2 FROM label_rows),
    clipped AS (SELECT p.*, v.fps, v.frame_count, least(greatest(a1, 0.0E0), 3839.0E0) AS c1, least(greatest(a2, 0.0E0), 3839.0E0) AS c2,
                       least(greatest(b1, 0.0E0), 2159.0E0) AS d1, least(greatest(b2, 0.0E0), 2159.0E0) AS d2 FROM parsed p JOIN videos v ON p.video_id = v.video_id WHERE ts IS NOT NULL),
    boxes AS (SELECT *, least(c1, c2) AS x1, greatest(c1, c2) AS x2, least(d1, d2) AS y1, greatest(d1, d2) AS y2 FROM clipped),
    lines AS (SELECT *, printf('%d %.6f %.6f %.6f %.6f', 0, ((x1 + x2) / 2.0E0) / 3840, ((y1 + y2) / 2.0E0) / 2160, (x2 - x1) / 3840, (y2 - y1) / 2160) AS line
              FROM boxes WHERE x2 - x1 > 2 AND y2 - y1 > 2),
    items AS (SELECT video_id, ts AS frame_timestamp_ms, count(*) AS boxes_count, string_agg(line, chr(10) ORDER BY ordinal) AS lines,
                     greatest(0, least(CAST(round_even(ts / 1000.0E0 * (CASE WHEN any_value(fps) <= 0 THEN 25.0E0 ELSE any_value(fps) END), 0) AS INT), any_value(frame_count) - 1)) AS frame_index
              FROM lines GROUP BY video_id, ts),
    named AS (SELECT *, printf('%s_t_%08d_f_%06d.jpg', video_id, CAST(round_even(frame_timestamp_ms, 0) AS BIGINT), frame_index) AS image_name FROM items)"""


def label_items(t):
    from pyspark.sql import Window

    order = Window.partitionBy("video_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return a.group_label_frames(t.label_rows.withColumn("ordinal", F.row_number().over(order)), t.videos)


@query("group_label_frames", "label_rows videos", f"""
    WITH {LABEL_ITEMS} SELECT image_name, video_id, frame_timestamp_ms, frame_index, 3840 AS width, 2160 AS height, boxes_count, lines FROM named""")
def group_label_frames(t):
    return label_items(t).withColumn("lines", F.array_join("lines", "\n"))


@query("detection_stats", "det codes", """
    WITH p AS (SELECT video_id, frame_index, count(*) AS n FROM det GROUP BY ALL), c AS (SELECT video_id, count(*) AS codes FROM codes GROUP BY ALL)
    SELECT p.video_id, count(*) AS frames, sum(n) AS candidates, coalesce(any_value(c.codes), 0) AS codes, max(n) AS max_per_frame
    FROM p LEFT JOIN c ON p.video_id = c.video_id GROUP BY p.video_id""")
def detection_stats(t):
    return a.detection_stats(t.det, t.codes)


SHIFT = """
    pair AS (SELECT video_id, pair_index, median(dx) AS dx, median(dy) AS dy FROM flow_points GROUP BY ALL HAVING count(*) >= 20),
    shift AS (SELECT video_id, median(dx) AS dx, median(dy) AS dy FROM pair GROUP BY video_id)"""


@query("global_shift", "flow_points", f"WITH {SHIFT} SELECT video_id, dx, dy FROM shift")
def global_shift(t):
    return a.global_shift(t.flow_points)


@query("rotation_mode", "flow_points", f"""
    WITH {SHIFT} SELECT video_id, CASE WHEN abs(dy) > abs(dx) * 1.25E0 AND abs(dy) > 0.30 THEN CASE WHEN dy > 0 THEN 'rot90_ccw' ELSE 'rot90_cw' END
           WHEN abs(dx) > abs(dy) * 1.25E0 AND abs(dx) > 0.30 THEN CASE WHEN dx > 0 THEN 'none' ELSE 'rot180' END ELSE 'none' END AS rotation_mode FROM shift""")
def rotation_mode(t):
    return a.global_shift(t.flow_points).select("video_id", sc.rotation_mode(F.col("dx"), F.col("dy")).alias("rotation_mode"))


@query("probe_summary", "code_boxes", """
    SELECT count(*) AS findings, count(DISTINCT value) AS unique_values, array_to_string(list_sort(list(DISTINCT reader)), ',') AS readers FROM code_boxes""")
def probe_summary(t):
    return a.probe_summary(t.code_boxes)


@query("line_rollup", "ocr_words", f"""
    SELECT tag_id, string_agg(text, ' ' ORDER BY x_min, seq) AS text, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max FROM {WORDS} w GROUP BY tag_id""")
def line_rollup(t):
    return a.line_rollup(words(t), ["tag_id"])


@query("combine_ocr_texts", "ocr_variants", """
    WITH d AS (SELECT tag_id, trim(raw_text) AS text, min(struct_pack(v := variant_index, s := l_suppkey, p := l_partkey)) AS pos FROM ocr_variants WHERE trim(raw_text) <> '' GROUP BY ALL)
    SELECT tag_id, string_agg(text, chr(10) ORDER BY pos) AS raw_text, 0.45E0 AS confidence FROM d GROUP BY tag_id""")
def combine_ocr_texts(t):
    return a.combine_ocr_texts(t.ocr_variants, "tag_id", ["variant_index", "l_suppkey", "l_partkey"])


@query("distinct_findings", "code_boxes", f"""
    SELECT video_id, frame_index, region_type, reader, code_type, value, finding_index, {BOX}, confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index, region_type, reader, code_type, value ORDER BY finding_index) AS rk FROM code_boxes) q WHERE rk = 1""")
def distinct_findings(t):
    return a.distinct_findings(t.code_boxes)


@query("distinct_words", "ocr_words", f"""
    SELECT tag_id, seq AS word_seq, text, conf, {BOX} FROM (SELECT *, row_number() OVER (PARTITION BY tag_id, text, {BOX} ORDER BY seq) AS rk FROM {WORDS} w) q WHERE rk = 1""")
def distinct_words(t):
    return a.distinct_words(words(t))


@query("distinct_values", "code_boxes", """
    WITH d AS (SELECT video_id, frame_index, value, min(finding_index) AS i FROM code_boxes GROUP BY ALL)
    SELECT video_id, frame_index, string_agg(value, '|' ORDER BY i, value) AS code_values FROM d GROUP BY ALL""")
def distinct_values(t):
    out = a.distinct_values(t.code_boxes, ["video_id", "frame_index"], ["finding_index"])
    return out.withColumn("code_values", F.array_join("code_values", "|"))


@query("union_sources", "det codes", f"""
    SELECT video_id, frame_index, candidate_index, source, score, {BOX}, NULL AS value FROM det WHERE source <> 'qr_anchor'
    UNION ALL SELECT video_id, frame_index, code_index, concat(code_type, '_anchor'), confidence, {BOX}, value FROM codes""")
def union_sources(t):
    keep = ["video_id", "frame_index", "candidate_index", "source", "score", "x_min", "y_min", "x_max", "y_max"]
    boxes = t.det.filter("source <> 'qr_anchor'").select(*keep)
    codes = t.codes.select(
        "video_id", "frame_index", F.col("code_index").alias("candidate_index"), F.concat("code_type", F.lit("_anchor")).alias("source"),
        F.col("confidence").alias("score"), "x_min", "y_min", "x_max", "y_max", "value",
    )
    return a.union_sources(boxes, codes)


@query("array_set_ops", "ocr_variants", """
    WITH s AS (SELECT tag_id, variant_index, l_suppkey, l_partkey, list_distinct(string_split(raw_text, ' ')) AS a, ['small', 'ring', variant] AS b FROM ocr_variants)
    SELECT tag_id, variant_index, l_suppkey, l_partkey, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS together, list_has_any(a, b) AS overlaps FROM s""")
def array_set_ops(t):
    left = F.array_distinct(F.split("raw_text", " "))
    right = F.array(F.lit("small"), F.lit("ring"), F.col("variant"))
    return t.ocr_variants.select(
        "tag_id", "variant_index", "l_suppkey", "l_partkey", F.size(F.array_intersect(left, right)).alias("common"),
        F.size(F.array_union(left, right)).alias("together"), F.arrays_overlap(left, right).alias("overlaps"),
    )
