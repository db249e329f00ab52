"""Merging, grouping and suppression of crowded frames: plain loops, and one frame of 200 000 boxes."""

import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_greedy import boxes, inter, iou, size

from shelfgrid.functions.scores import text_region_gate
from shelfgrid.functions import geometry as g
from shelfgrid.operators import greedy as gr
from shelfgrid.operators.box_grid import BoxGrid
from shelfgrid.queries import spark_queries
from shelfgrid.sources.tables import view

DATA = "/root/testdata/sf0.001"
MERGE = "video_id string, frame_index int, candidate_index int, x_min int, y_min int, x_max int, y_max int, source string, score double, has_qr boolean, code_values array<string>, anchor_hypothesis int, anchor_key string, layout_key string, layout_hypothesis int"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 400), st.integers(-50, 400), st.integers(0, 900), st.integers(0, 90)), max_size=30), st.randoms())
def test_grid_finds_what_a_scan_finds(shapes, rng):
    grid, held = BoxGrid(16), {}
    for x, y, w, h in shapes:
        box = (x, y, x + w, y + h)
        ids, shared = grid.near(box)
        want = {k: inter(box, b) for k, b in held.items() if inter(box, b)}
        assert dict(zip(ids.tolist(), shared.tolist())) == want and ids.tolist() == sorted(want)
        k = grid.add(box)
        held[k] = box
        pick = rng.choice(sorted(held))
        if rng.random() < 0.3:
            grown = (held[pick][0] - 40, held[pick][1], held[pick][2] + 5000 * (rng.random() < 0.2), held[pick][3] + 7)
            grid.grow(pick, grown)
            held[pick] = grown
        elif rng.random() < 0.2:
            grid.leave(pick)
            del held[pick]


def plain_groups(rows, width, height, margin=0.08, threshold=0.85):
    """(region_index, box, mass) rows of one frame in order: the sequential rule, box by box."""
    def grown(b):
        w, h = b[2] - b[0], b[3] - b[1]
        x, y = min(max(int(b[0] - margin * w), 0), width - 1), min(max(int(b[1] - margin * h), 0), height - 1)
        return x, y, min(max(int(b[2] + margin * w), x + 1), width), min(max(int(b[3] + margin * h), y + 1), height)

    used, out = [False] * len(rows), []
    for i, (index, box, mass) in enumerate(rows):
        if used[i]:
            continue
        used[i] = True
        for j in range(i + 1, len(rows)):
            if not used[j] and inter(grown(box), grown(rows[j][1])) > 0:
                used[j], b = True, rows[j][1]
                box, mass = (min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])), mass + rows[j][2]
        if not any(iou(box, k) >= threshold for _, k, _ in out if size(box) + size(k)):
            out.append((index, box, mass))
    return out


def frames_of(rows):
    out = {}
    for r in rows:
        out.setdefault((r["video_id"], r["frame_index"]), {}).setdefault((r["x_min"], r["y_min"], r["x_max"], r["y_max"]), []).append(r)
    return out


def expected_groups(rows, width, height):
    want = []
    for key, by_box in frames_of(rows).items():
        merged = sorted((min(r["region_index"] for r in rs), b, sum(r["text_fill"] * size(b) for r in rs)) for b, rs in by_box.items())
        want += [(*key, i, *b, round(min(1.0, m / size(b)), 9)) for i, b, m in plain_groups(merged, width, height)]
    return sorted(want)


def test_groups_equal_the_sequential_rule(spark):
    rng = random.Random(6)
    for spread in (700, 9000, 60_000):  # dense, sparse, and cut into many strips
        width = spread + 300
        rows = [dict(video_id=r[0], frame_index=r[1], region_index=r[3], x_min=x, y_min=r[7], x_max=x + 20 + r[3], y_max=r[9], text_fill=0.2)
                for r in boxes(6, per_frame=40) for x in [rng.randrange(spread)]]
        out = gr.group_near_boxes(spark.createDataFrame(rows), width, 2160)
        got = sorted((r.video_id, r.frame_index, r.region_index, r.x_min, r.y_min, r.x_max, r.y_max, round(r.text_fill, 9)) for r in out.collect())
        assert got == expected_groups(rows, width, 2160)
    cut = gr.split_by_strips(spark.createDataFrame(rows), ["video_id", "frame_index"], 0.08)
    assert cut.select("video_id", "frame_index", "strip").distinct().count() > 3 * 12


def test_group_query_equals_a_loop(spark):
    from shelfgrid.queries.boxes import FH, FW

    text = view(spark, DATA, "regions").filter("kind = 'text'")
    rows = [r.asDict() for r in text.select("video_id", "frame_index", "region_index", "x_min", "y_min", "x_max", "y_max", "text_fill").collect()]
    got = sorted(
        (r.video_id, r.frame_index, r.region_index, r.x_min, r.y_min, r.x_max, r.y_max, round(r.text_fill, 9))
        for r in spark_queries()["group_near_boxes"](spark, DATA).collect()
    )
    assert got == expected_groups(rows, FW, FH)
    b = g.box()
    clamped = text.select("video_id", "frame_index", "region_index", "text_fill", *g.clamp(b, FW, FH).columns()).filter(text_region_gate(b, FW, FH))
    want = {w[:3]: w[3:7] for w in expected_groups([r.asDict() for r in clamped.collect()], FW, FH)}
    scored = spark_queries()["score_text_regions"](spark, DATA).collect()
    assert scored and all(want[r.video_id, r.frame_index, r.region_index] == (r.x_min, r.y_min, r.x_max, r.y_max) for r in scored)


def plain_merge(rows, min_iou=0.45, min_share=0.85, whole=False):
    """The merging rule with codes, anchors and layouts, every kept row compared."""
    kept = []
    for r in sorted(rows, key=lambda r: (-r["score"], r["candidate_index"])):
        r = dict(r, codes=list(r["code_values"] or []), anchors={r["anchor_key"]} - {None}, box=(r["x_min"], r["y_min"], r["x_max"], r["y_max"]))
        laid_out = r["layout_key"] is not None and r["layout_hypothesis"] is not None
        for k in kept if not laid_out else ():
            if k["layout_key"] is not None and k["layout_hypothesis"] is not None:
                continue
            a, b = k["box"], r["box"]
            shared = inter(a, b)
            u = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
            if not shared or not (iou(a, b) >= min_iou or shared / size(a) >= min_share or shared / size(b) >= min_share) or size(u) / max(size(a), size(b)) > 1.8:
                continue
            p, q = set(k["codes"]), set(r["codes"])
            if p and q and not p & q:
                continue
            rivals = "anchor" in k["source"] and "anchor" in r["source"] and None not in (k["anchor_hypothesis"], r["anchor_hypothesis"])
            if rivals and k["anchor_hypothesis"] != r["anchor_hypothesis"] and (p & q or (len(k["anchors"]) == 1 and k["anchors"] == r["anchors"])):
                continue
            same = k["source"] == r["source"]
            hypotheses = [h for h in (k["anchor_hypothesis"], r["anchor_hypothesis"]) if h is not None]
            k.update(
                source=k["source"] if same else "mixed", score=min(1.0, max(k["score"], r["score"]) + (0.03 if same else 0.08)), box=u,
                codes=list(dict.fromkeys(k["codes"] + r["codes"])), anchor_hypothesis=max(hypotheses) if hypotheses else None,
                anchors=k["anchors"] | r["anchors"], has_qr=k["has_qr"] or r["has_qr"],
            )
            for flag in ("has_barcode", "has_text", "has_rect") if whole else ():
                k[flag] = k[flag] or r[flag]
            for number in ("text_density", "rectangularity", "edge_density", "area_ratio") if whole else ():
                k[number] = max((v for v in (k[number], r[number]) if v is not None), default=None)
            break
        else:
            kept.append(r)
    if whole:
        return kept
    return [(k["source"], round(k["score"], 9), *k["box"], "|".join(k["codes"]) or None, k["anchor_hypothesis"], bool(k["has_qr"])) for k in kept]


def test_merging_with_codes_anchors_and_layouts(spark):
    rng, rows = random.Random(12), []
    for frame in range(8):
        for c in range(60):
            x, y = rng.randrange(0, 500, 10), rng.randrange(0, 300, 10)
            anchor = rng.random() < 0.4
            rows.append(dict(
                video_id="v", frame_index=frame, candidate_index=c, x_min=x, y_min=y, x_max=x + rng.randrange(60, 120), y_max=y + rng.randrange(60, 100),
                source=rng.choice(["qr_anchor_a", "barcode_anchor"]) if anchor else rng.choice(["text", "promo_color_layout"]), score=rng.randrange(30, 95) / 100,
                has_qr=rng.random() < 0.3, code_values=rng.choice([None, [], ["A"], ["B"], ["A", "B"]]), anchor_hypothesis=rng.randrange(3) if anchor else None,
                anchor_key=rng.choice(["k1", "k2"]) if anchor else None, layout_key="l" if rng.random() < 0.15 else None, layout_hypothesis=rng.choice([None, 1, 2]),
            ))
    out = gr.merge_candidates(spark.createDataFrame([tuple(r.values()) for r in rows], MERGE)).collect()
    got = sorted(((r.frame_index, r.source, round(r.score, 9), r.x_min, r.y_min, r.x_max, r.y_max, r.code_values, r.anchor_hypothesis, bool(r.has_qr)) for r in out), key=str)
    want = sorted(((f, *m) for f in range(8) for m in plain_merge([r for r in rows if r["frame_index"] == f])), key=str)
    assert got == want and len(want) < len(rows)


def crowd(n, seed=1):
    """Boxes of one frame at the density of a full shelf, mostly in near pairs."""
    rng = np.random.default_rng(seed)
    side = int((n * 60 * 60) ** 0.5)
    x, y = rng.integers(0, side, n), rng.integers(0, side, n)
    w, h = rng.integers(30, 70, n), rng.integers(30, 70, n)
    x[n // 2 :], y[n // 2 :] = x[: n - n // 2] + 3, y[: n - n // 2] + 3
    return side + 80, np.stack((x, y, x + w, y + h), axis=1)


def timed(fold, rows):
    started = time.time()
    out = [r for row in rows for r in fold.push(row)] + list(fold.finish())
    return time.time() - started, out


def test_time_grows_with_the_boxes():
    times = {}
    for n in (50_000, 200_000):
        side, held = crowd(n)
        rows = [("v", 0, i, *b, "text", 1 - i / n, None, None, None, None, False, False, True, False, None, None, None, None, None, None) for i, b in enumerate(held.tolist())]
        times["merge", n], out = timed(gr._MergeFold(0.45, 0.85, None), rows)
        assert n / 2 <= len(out) <= n
        times["group", n], out = timed(gr._GroupFold(side, side, 0.02, 0.85), [("v", 0, i, *b, 1.0) for i, b in enumerate(held[: n // 8].tolist())])
        assert 0 < len(out) < n / 8
        started, keeper = time.time(), gr._Suppressor(0.5, 0.86, None)
        assert n / 2 <= sum(keeper.keep(*b) for b in held.tolist()) <= n
        times["keep", n] = time.time() - started
    for kind in ("merge", "group", "keep"):
        assert times[kind, 200_000] < 7 * times[kind, 50_000] + 1, times
