"""Greedy operators against plain loops written for the tests."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from shelfgrid.config import TrackConfig
from shelfgrid.functions import text as x
from shelfgrid.operators import catalog as cat
from shelfgrid.operators import greedy as gr
from shelfgrid.operators import tracking as tr

SCHEMA = (
    "video_id string, frame_index int, timestamp_ms double, candidate_index int, source string, score double,"
    " x_min int, y_min int, x_max int, y_max int"
)
SOURCES = ["mixed", "qr_anchor", "promo_color_layout", "rectangular_region"]


def boxes(seed, frames=6, per_frame=14, spread=700):
    rnd, rows = random.Random(seed), []
    for video in ("a", "b"):
        for f in range(frames):
            for c in range(per_frame):
                x0, y0 = rnd.randrange(spread), rnd.randrange(spread)
                rows.append((video, f * 12 + (400 if f > frames // 2 else 0), f * 480.0, c, rnd.choice(SOURCES),
                             rnd.randrange(40, 100) / 100, x0, y0, x0 + rnd.randrange(60, 260), y0 + rnd.randrange(50, 200)))
    return rows


def size(b):
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def inter(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def iou(a, b):
    return inter(a, b) / (size(a) + size(b) - inter(a, b))


def quality(r):
    b = r[6:10]
    bonus = 0.08 if "anchor" in r[4] else 0.05 if r[4] == "promo_color_layout" else 0.0
    aspect = (b[2] - b[0]) / (b[3] - b[1])
    return r[5] + bonus + min(size(b) / 120000.0, 1.0) * 0.08 - (0.10 if aspect < 0.25 or aspect > 5.5 else 0.0)


def plain_nms(rows, limit=40):
    kept = []
    for r in sorted(rows, key=lambda r: (-quality(r), r[3])):
        b = r[6:10]
        if not any(iou(b, k[6:10]) >= 0.5 or inter(b, k[6:10]) / size(b) >= 0.86 or inter(b, k[6:10]) / size(k[6:10]) >= 0.86 for k in kept):
            kept.append(r)
    return kept[:limit]


@pytest.mark.parametrize("crowd", [None, 0])
def test_nms_streamed_and_in_rounds(spark, crowd):
    rows = boxes(1)
    out = gr.nms_detections(spark.createDataFrame(rows, SCHEMA), crowd=crowd)
    got = {(r.video_id, r.frame_index, r.candidate_index) for r in out.collect()}
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[1]), []).append(r)
    want = {(k[0], k[1], r[3]) for k, g in groups.items() for r in plain_nms(g)}
    assert got == want


def test_nms_ignores_input_order(spark):
    rows = boxes(2)
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    a = gr.nms_detections(spark.createDataFrame(rows, SCHEMA)).select("video_id", "frame_index", "candidate_index")
    b = gr.nms_detections(spark.createDataFrame(shuffled, SCHEMA)).select("video_id", "frame_index", "candidate_index")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def plain_merge(rows):
    """Sequential merging of (score, source, box) candidates without codes or layouts."""
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[3])):
        b = r[6:10]
        for i, (source, score, k) in enumerate(kept):
            hit = iou(b, k) >= 0.45 or inter(b, k) / size(b) >= 0.85 or inter(b, k) / size(k) >= 0.85
            u = (min(b[0], k[0]), min(b[1], k[1]), max(b[2], k[2]), max(b[3], k[3]))
            if inter(b, k) and hit and size(u) / max(size(b), size(k)) <= 1.8:
                same = source == r[4]
                kept[i] = (source if same else "mixed", min(1.0, max(score, r[5]) + (0.03 if same else 0.08)), u)
                break
        else:
            kept.append((r[4], r[5], b))
    return kept


def test_merge_candidates(spark):
    rows = [r for r in boxes(4) if r[4] != "promo_color_layout"]
    out = gr.merge_candidates(spark.createDataFrame(rows, SCHEMA), limit=None).collect()
    got = sorted((r.video_id, r.frame_index, r.source, round(r.score, 9), r.x_min, r.y_min, r.x_max, r.y_max) for r in out)
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[1]), []).append(r)
    want = sorted((*k, s, round(p, 9), *b) for k, g in groups.items() for s, p, b in plain_merge(g))
    assert got == want


def test_merge_candidates_keeps_crowded_frames_whole(spark):
    first = boxes(4)[0]
    rows = [(*first[:3], i, "x", 0.5, 20 * i, 10, 20 * i + 10, 20, *first[10:]) for i in range(100)]
    crowded = spark.createDataFrame(rows, SCHEMA)
    assert gr.merge_candidates(crowded).count() == 100
    assert gr.merge_candidates(crowded, limit=80).count() == 80


def test_tracks_do_not_depend_on_cutting(spark):
    rows = boxes(5, frames=12, per_frame=6, spread=1500)
    df = spark.createDataFrame(rows, SCHEMA)
    cut = tr.track_objects(df)

    class Uncut(TrackConfig):
        @property
        def cut_gap(self):
            return 10**6

    whole = tr.track_objects(df, Uncut())
    key = ["video_id", "track_id", "frame_index", "candidate_index"]
    assert cut.select(key).exceptAll(whole.select(key)).count() == 0
    assert whole.select(key).exceptAll(cut.select(key)).count() == 0
    per_box = cut.groupBy("video_id", "frame_index", "candidate_index").count().filter("count > 1")
    assert per_box.count() == 0
    assert cut.groupBy("video_id", "track_id").count().filter("count < 2").count() == 0


def test_group_near_boxes_covers_and_conserves(spark):
    rows = [(r[0], r[1], r[3], *r[6:10], 0.2) for r in boxes(6)]
    df = spark.createDataFrame(rows, "video_id string, frame_index int, region_index int, x_min int, y_min int, x_max int, y_max int, text_fill double")
    out = gr.group_near_boxes(df)
    assert 0 < out.count() <= len(rows)
    assert out.filter("text_fill > 1").count() == 0


def similar(a, b):
    return SequenceMatcher(None, a, b).ratio() >= 0.78 or a in b or b in a


def plain_score(name, tokens, grams, entry, e_tokens, e_grams, garbage):
    m = sum(any(similar(t, e) for e in e_tokens) for t in tokens)
    score = 80.0 * len(tokens & e_tokens) / len(tokens | e_tokens) + 65.0 * m / len(tokens)
    score += 35.0 * (len(grams & e_grams) / len(grams | e_grams) if grams and e_grams else 0.0)
    ratio = SequenceMatcher(None, name, entry).ratio()
    score += 25.0 * ratio if ratio >= 0.25 else 0.0
    score *= 0.0 if m == 0 else 1.0 if m > 1 else (0.35 if max(map(len, tokens)) < 5 else 0.70)
    return score * (0.55 if garbage else 1.0)


@pytest.mark.parametrize("shard_entries", [7, 20_000])
def test_catalog_match_equals_exhaustive_scoring(spark, shard_entries):
    rnd = random.Random(7)
    words = ["молоко", "сметана", "кефир", "творог", "шоколад", "merlot", "blanc", "grand", "batonchik", "prostokvashino"]
    entries = [(i, f"{rnd.choice(words)} {rnd.choice(words)} {rnd.choice(words)} {i % 9}кг общий", str(4600000000000 + i * 7919)) for i in range(60)]
    names = [(" ".join(w if rnd.random() < 0.5 else w[:2] + w[3:] for w in rnd.sample(words, 3)) + rnd.choice([" общий", ""]),) for _ in range(40)]
    catalog = cat.build_catalog(spark.createDataFrame(entries, "entry_id int, product_name string, barcode string"), ["entry_id"])
    df = spark.createDataFrame(names, "product_name string")
    got = {r.product_name: (r.entry_id, round(r.score, 6)) for r in cat.best_catalog_entries(df, catalog, shard_entries=shard_entries).collect()}

    def parts(frame):
        c = F.col("product_name")
        cols = [c, x.normalize_name(c).alias("n"), x.name_tokens(c).alias("t"), x.name_trigrams(c).alias("g"), x.looks_like_garbage(c).alias("bad")]
        return [(r[0], r[1], set(r[2]), set(r[3]), r[4]) for r in frame.select(*cols).collect()]

    refs = [(r.entry_id, r.normalized_name) for r in catalog.orderBy("entry_id").collect()]
    ref_parts = {r[1]: r for r in parts(catalog)}
    want = {}
    for name, norm, tokens, grams, bad in parts(df.distinct()):
        hits = [(i, n) for i, n in refs if tokens & ref_parts[n][2]]
        if not hits:
            pre = {t[:4] for t in tokens if len(t) >= 5}
            hits = [(i, n) for i, n in refs if any(t.startswith(p) for t in ref_parts[n][2] for p in pre)]
        best = max(((plain_score(norm, tokens, grams, n, ref_parts[n][2], ref_parts[n][3], bad), -i) for i, n in hits), default=None)
        if best and best[0] >= 55:
            want[name] = (-best[1], round(best[0], 6))
    assert got == want
