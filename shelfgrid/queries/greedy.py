"""Greedy selections and tracking."""

from pyspark.sql import functions as F

from shelfgrid.operators import greedy as gr
from shelfgrid.operators import joins as j
from shelfgrid.operators import tracking as tr
from shelfgrid.queries import sqltext as s
from shelfgrid.queries.boxes import FH, FW, KEY, KEY_SQL
from shelfgrid.queries.joins import words
from shelfgrid.queries.registry import query

BOX = "x_min, y_min, x_max, y_max"
SIDES = ["x_min", "y_min", "x_max", "y_max"]


def kept(rows, conflict, fields, limit=None):
    """Greedy suppression as a list reduction; ``rows`` yields (frame keys, rk, fields)."""
    struct = ", ".join(f"{n} := {n}" for n, _ in fields)
    types = ", ".join(f"{n} {t}" for n, t in fields)
    full = f"len(acc) >= {limit} OR " if limit else ""
    return f"""
    ranked AS ({rows}),
    listed AS (SELECT video_id, frame_index, list(struct_pack({struct}) ORDER BY rk) AS xs FROM ranked GROUP BY ALL),
    kept AS (SELECT video_id, frame_index, unnest(list_reduce(xs, lambda acc, c: CASE WHEN {full}len(list_filter(acc, lambda k: {conflict})) > 0 THEN acc ELSE list_append(acc, c) END,
                 CAST([] AS STRUCT({types})[]))) AS e FROM listed)"""


BOX_FIELDS = [("x_min", "INT"), ("y_min", "INT"), ("x_max", "INT"), ("y_max", "INT")]


def hard_overlap(i, c):
    return f"{s.iou('k.', 'c.')} >= {i} OR {s.contains('k.', 'c.')} >= {c} OR {s.contains('c.', 'k.')} >= {c}"


@query("nms_detections", "det", f"""
    WITH {kept(f"SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY {s.quality()} DESC, candidate_index) AS rk FROM det",
               hard_overlap(0.5, 0.86), [("candidate_index", "INT"), *BOX_FIELDS])}
    SELECT video_id, frame_index, e.candidate_index AS candidate_index FROM kept""")
def nms_detections(t):
    return gr.nms_detections(t.det).select(*KEY)


RANK = """score + (CASE WHEN source = 'promo_color_layout' THEN 0.12E0 ELSE 0.0E0 END) + (CASE WHEN source = 'mixed' THEN 0.08E0 ELSE 0.0E0 END)
          + (CASE WHEN has_qr OR has_barcode THEN 0.10E0 ELSE 0.0E0 END)"""
# The boosts are summed before they meet the score.
RANK = RANK.replace("score + (", "score + ((", 1) + ")"


@query("select_diverse", "candidates", f"""
    WITH {kept(f"SELECT *, CASE WHEN source = 'promo_color_layout' THEN x_min % 3 END AS lk, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY {RANK} DESC, rectangularity DESC, {s.area()} DESC, candidate_index) AS rk FROM candidates",
               f"coalesce(k.lk = c.lk, FALSE) OR {hard_overlap(0.5, 0.82)}", [("candidate_index", "INT"), ("lk", "INT"), *BOX_FIELDS])}
    SELECT video_id, frame_index, e.candidate_index AS candidate_index FROM kept""")
def select_diverse(t):
    rows = t.candidates.withColumn(
        "layout_key", F.when(F.col("source") == "promo_color_layout", (F.col("x_min") % 3).cast("string"))
    )
    return gr.select_diverse(rows).select(*KEY)


@query("distinct_codes", "code_boxes", f"""
    WITH {kept("SELECT *, finding_index AS code_index, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY confidence DESC, finding_index) AS rk FROM code_boxes",
               f"k.code_type = c.code_type AND (k.value = c.value OR {s.iou('k.', 'c.')} >= 0.5)", [("code_index", "INT"), ("code_type", "VARCHAR"), ("value", "VARCHAR"), *BOX_FIELDS])}
    SELECT video_id, frame_index, e.code_index AS code_index, e.value AS value FROM kept""")
def distinct_codes(t):
    return gr.distinct_codes(t.code_boxes.withColumnRenamed("finding_index", "code_index")).select("video_id", "frame_index", "code_index", "value")


@query("distinct_boxes", "det", f"""
    WITH {kept("SELECT *, candidate_index AS rk FROM det", f"{s.iou('k.', 'c.')} >= 0.6", [("candidate_index", "INT"), *BOX_FIELDS])}
    SELECT video_id, frame_index, e.candidate_index AS candidate_index FROM kept""")
def distinct_boxes(t):
    return gr.distinct_frame_boxes(t.det, "candidate_index", 0.6).select(*KEY)


@query("merge_candidates", "candidates")
def merge_candidates(t):
    out = gr.merge_candidates(t.candidates)
    return out.select(*KEY, "source", "score", *SIDES, "text_density", "rectangularity", "has_qr", "has_text")


@query("group_near_boxes", "regions")
def group_near_boxes(t):
    return gr.group_near_boxes(t.regions.filter("kind = 'text'"), FW, FH)


@query("score_text_regions", "regions")
def score_text_regions(t):
    return gr.score_text_regions(t.regions, FW, FH)


@query("track_objects", "det")
def track_objects(t):
    return tr.track_objects(t.det)


@query("merge_track_fragments", "det")
def merge_track_fragments(t):
    tracks = tr.track_objects(t.det, merge=False)
    return tr.merge_track_fragments(tracks).groupBy("video_id", "merged_id").agg(
        F.countDistinct("track_id").alias("fragments"), F.count("*").alias("detections")
    )


@query("group_words_into_lines", "ocr_words", """
    WITH w AS (SELECT tag_id, text, left_px, top_px, height, row_number() OVER (PARTITION BY tag_id ORDER BY word_seq, conf, text, left_px, top_px, width) AS seq FROM ocr_words),
         l AS (SELECT tag_id, list(struct_pack(seq := seq, c := top_px + height / 2.0E0, h := height) ORDER BY top_px + height / 2.0E0, left_px, seq) AS ws FROM w GROUP BY tag_id),
         f AS (SELECT tag_id, list_reduce(ws, lambda acc, x: list_append(acc, struct_pack(seq := x.seq, c := x.c, h := x.h, line :=
                 coalesce(list_filter(list_sort(list_distinct(list_transform(acc, lambda k: k.line))), lambda n:
                     abs(x.c - list_avg(list_transform(list_filter(acc, lambda k: k.line = n), lambda k: k.c)))
                     <= greatest(8.0E0, list_avg(list_transform(list_filter(acc, lambda k: k.line = n), lambda k: k.h)) * 0.55E0))[1],
                   len(list_distinct(list_transform(acc, lambda k: k.line))))::INT)), CAST([] AS STRUCT(seq BIGINT, c DOUBLE, h INT, line INT)[])) AS g FROM l)
    SELECT tag_id, e.seq AS word_seq, e.line AS line_index FROM (SELECT tag_id, unnest(g) AS e FROM f) u""")
def group_words_into_lines(t):
    return gr.group_words_into_lines(words(t)).select("tag_id", "word_seq", "line_index")
