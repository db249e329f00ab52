"""The whole detection job against a plain loop over frames."""

import pytest
from pyspark.sql import functions as F
from test_crowds import plain_groups, plain_merge
from test_greedy import inter, iou, size

from shelfgrid.operators.joins import ANCHOR_PRESETS, layout_growth
from shelfgrid.plans.detection import detect_candidates
from shelfgrid.sources.tables import view

DATA = "/root/testdata/sf0.001"
W, H = 3840, 2160
FRAME_AREA = W * H


def clamp(b):
    x, y = min(max(int(b[0]), 0), W - 1), min(max(int(b[1]), 0), H - 1)
    return x, y, min(max(int(b[2]), x + 1), W), min(max(int(b[3]), y + 1), H)


def expand(b, left, top, right, bottom):
    w, h = b[2] - b[0], b[3] - b[1]
    return clamp((int(b[0] - left * w), int(b[1] - top * h), int(b[2] + right * w), int(b[3] + bottom * h)))


def aspect(b):
    return (b[2] - b[0]) / max(b[3] - b[1], 1)


def clip01(x, high=1.0):
    return min(max(x, 0.0), high)


def share(outer, inner):
    return inter(outer, inner) / size(inner) if size(inner) else 0.0


def candidate(index, source, score, box, **more):
    empty = dict(
        text_density=None, rectangularity=None, edge_density=None, area_ratio=None, has_qr=False, has_barcode=False, has_text=False, has_rect=False,
        code_values=None, anchor_hypothesis=None, anchor_key=None, layout_key=None, layout_hypothesis=None,
    )
    return dict(empty, candidate_index=index, source=source, score=score, box=box, **more)


def size_score(r):
    return 0.35 if r < 0.001 else 1.0 if r < 0.01 else 0.75 if r < 0.04 else 0.35 if r < 0.08 else 0.0


def dominant(r):
    red, yellow = r["red_ratio"], r["yellow_ratio"]
    return "none" if red < 0.05 and yellow < 0.05 else "red" if red >= yellow else "yellow"


def sources(regions):
    """All candidates of a frame's regions before any boost."""
    out, texts, bands = [], {}, {}
    regions = [dict(r, box=clamp([r[s] for s in ("x_min", "y_min", "x_max", "y_max")])) for r in sorted(regions, key=lambda r: r["region_index"])]
    for r in regions:
        b, i = r["box"], r["region_index"]
        w, h, ratio = b[2] - b[0], b[3] - b[1], size(b) / FRAME_AREA
        if r["kind"] == "rectangle":
            if w >= 35 and h >= 20 and 0.0004 <= ratio <= 0.08 and 0.25 <= aspect(b) <= 5.5 and r["edge_density"] >= 0.025 and r["rectangularity"] >= 0.25:
                score = 0.12 + 0.40 * r["rectangularity"] + 0.30 * min(r["edge_density"] / 0.12, 1.0) + 0.10 * size_score(ratio)
                out.append(candidate(i, "rectangular_region", clip01(score, 0.78), b, rectangularity=round(r["rectangularity"], 4),
                                     edge_density=round(r["edge_density"], 4), area_ratio=round(ratio, 5), has_rect=True))
        elif r["kind"] == "text":
            if FRAME_AREA * 0.0003 <= size(b) <= FRAME_AREA * 0.12 and w >= 30 and h >= 20 and 0.15 <= aspect(b) <= 8.0:
                first, mass = texts.get(b, (i, 0.0))
                texts[b] = (first, mass + r["text_fill"] * size(b))
        elif r["kind"] == "color":
            if w >= 15 and h >= 8 and dominant(r) != "none":
                bands.setdefault(b, i)
            if w >= 35 and h >= 12 and 0.0003 <= ratio <= 0.05 and 1.2 <= aspect(b) <= 10.0 and r["rectangularity"] >= 0.20 and dominant(r) != "none":
                grown = expand(b, 0.10, 1.40, 0.10, 0.15)
                out.append(candidate(400_000_000 + i, "color_band_region", clip01(0.18 + 0.12 * r["rectangularity"], 0.34), grown,
                                     rectangularity=round(r["rectangularity"], 4), area_ratio=round(size(grown) / FRAME_AREA, 5)))
            out += layouts(r, b, i, ratio)
    for index, b, mass in plain_groups(sorted((i, b, m) for b, (i, m) in texts.items()), W, H):
        fill = min(1.0, mass / size(b))
        density = 0.0 if fill <= 0 else 0.15 if fill > 0.75 else clip01(fill / 0.35)
        if size(b) / FRAME_AREA <= 0.12:
            out.append(candidate(100_000_000 + index, "text_like_region", clip01(0.25 + 0.45 * density, 0.72), b, text_density=round(density, 4), has_text=True))
    for r in regions:
        if r["kind"] == "white":
            out += white(r, r["box"], bands)
    return out


def layouts(r, b, i, ratio):
    w, h = b[2] - b[0], b[3] - b[1]
    if not (w >= 28 and h >= 22 and 0.00025 <= ratio <= 0.035 and 0.18 <= aspect(b) <= 3.2 and r["rectangularity"] >= 0.28):
        return []
    color, kept, out = dominant(r), [], []
    for growth in layout_growth():
        grown = expand(b, *growth)
        if not any(iou(grown, k) >= 0.995 for k in kept):
            kept.append(grown)
    for n, grown in enumerate(kept):
        part, q = size(b) / max(1, size(grown)), size(grown) / FRAME_AREA
        if grown[2] - grown[0] >= 45 and grown[3] - grown[1] >= 30 and 0.00045 <= q <= 0.09 and 0.25 <= aspect(grown) <= 5.8 and 0.12 <= part <= 0.72:
            score = 0.58 + 0.12 * r["rectangularity"] + (0.06 if color == "red" else 0.0) + (0.08 if 0.22 <= part <= 0.55 else 0.0)
            out.append(candidate(200_000_000 + i * 100 + n, "promo_color_layout", clip01(score, 0.82), grown, rectangularity=round(r["rectangularity"], 4),
                                 area_ratio=round(q, 5), has_text=True, layout_hypothesis=n, layout_key=f"{i}:{','.join(map(str, b))}"))
    return out


def white(r, b, bands):
    w, h, ratio = b[2] - b[0], b[3] - b[1], size(b) / FRAME_AREA
    if not (0.0005 <= ratio <= 0.08 and w >= 35 and h >= 20 and 0.25 <= aspect(b) <= 5.8 and r["white_ratio"] >= 0.35 and r["rectangularity"] >= 0.25):
        return []
    reach_x, reach_y, box, extended = max(8, int(w * 0.15)), max(8, int(h * 0.25)), b, False
    around = (b[0] - reach_x - 1, b[1] - reach_y - 1, b[2] + reach_x + 1, b[3] + reach_y + 1)
    for c, _ in sorted(bands.items(), key=lambda x: x[1]):
        if not inter(around, c):
            continue
        cw, ch = c[2] - c[0], c[3] - c[1]
        wide = max(0, min(b[2], c[2]) - max(b[0], c[0])) / w >= 0.55 and cw / ch >= 1.0
        tall = max(0, min(b[3], c[3]) - max(b[1], c[1])) / h >= 0.45 and ch >= cw * 0.5
        sides = (
            wide and c[1] - b[3] <= reach_y and c[3] >= b[1] + int(h * 0.45), wide and b[1] - c[3] <= reach_y and c[1] <= b[3] - int(h * 0.45),
            tall and c[0] - b[2] <= reach_x and c[2] >= b[0] + int(w * 0.45), tall and b[0] - c[2] <= reach_x and c[0] <= b[2] - int(w * 0.45),
        )
        grown = clamp((min(box[0], c[0]), min(box[1], c[1]), max(box[2], c[2]), max(box[3], c[3])))
        if any(sides) and size(grown) <= size(b) * 2.8:
            box, extended = grown, True
    red, yellow = r["red_ratio"], r["yellow_ratio"]
    score = 0.10 + 0.18 * r["rectangularity"] + 0.12 * min(r["white_ratio"] / 0.70, 1.0) + (0.08 if extended else 0.0)
    score += (0.05 if red >= 0.08 or yellow >= 0.08 else 0.0) + (0.04 if dominant(r) != "none" else 0.0)
    return [candidate(300_000_000 + r["region_index"], "color_region", clip01(score, 0.40), box, rectangularity=round(r["rectangularity"], 4),
                      area_ratio=round(size(box) / FRAME_AREA, 5))]


def anchors(codes):
    out = []
    for c in codes:
        kept, b = [], c["box"]
        for growth in ANCHOR_PRESETS:
            g = expand(b, *growth)
            max_w, max_h = int(W * 0.35), int(H * 0.35)
            if g[2] - g[0] > max_w or g[3] - g[1] > max_h:
                x, y = b[0] + (b[2] - b[0]) / 2, b[1] + (b[3] - b[1]) / 2
                hw, hh = min(g[2] - g[0], max_w) / 2, min(g[3] - g[1], max_h) / 2
                g = clamp((int(x - hw), int(y - hh), int(x + hw), int(y + hh)))
            if not any(iou(g, k) >= 0.85 for k in kept):
                kept.append(g)
        for n, g in enumerate(kept):
            base = 0.95 if c["code_type"] == "qr" else 0.88
            out.append(candidate(500_000_000 + c["code_index"] * 10 + n, f"{c['code_type']}_anchor", clip01(base - n * 0.06), g, code_values=[c["value"]],
                                 anchor_hypothesis=n, anchor_key=",".join(map(str, b)), has_qr=c["code_type"] == "qr", has_barcode=c["code_type"] == "barcode"))
    return out


def fits(c):
    return 0.0003 <= size(c["box"]) / FRAME_AREA <= 0.18 and 0.20 <= aspect(c["box"]) <= 6.0


def final(c):
    s, code = c["source"], c["has_qr"] or c["has_barcode"] or "anchor" in c["source"]
    text, score, density = c["has_text"], c["score"], c["text_density"] or 0.0
    if s == "promo_color_layout":
        return score >= 0.55 and text
    if not code and (c["area_ratio"] or 0.0) > 0.07:
        return False
    if code and score >= 0.45:
        return True
    if s == "mixed":
        return score >= 0.5 and (code or (c["has_rect"] and text and density >= 0.12) or (text and score >= 0.62))
    if s == "rectangular_region":
        return text and score >= 0.55 and density >= 0.18 and (c["rectangularity"] or 0.0) >= 0.35 and (c["edge_density"] or 0.0) >= 0.025
    return s == "text_like_region" and score >= 0.62 and density >= 0.35


def frame_result(regions, reads):
    codes = []
    for c in sorted(reads, key=lambda c: (-c["confidence"], c["code_index"])):
        c = dict(c, box=tuple(c[s] for s in ("x_min", "y_min", "x_max", "y_max")))
        if not any(k["code_type"] == c["code_type"] and (k["value"] == c["value"] or iou(k["box"], c["box"]) >= 0.5) for k in codes):
            codes.append(c)
    rows = sources(regions)
    texts = [c for c in rows if c["source"] == "text_like_region"]
    for c in rows:
        if c["source"] == "rectangular_region":
            met = [t["text_density"] for t in texts if share(c["box"], t["box"]) >= 0.45 or iou(c["box"], t["box"]) >= 0.10]
            if met:
                c.update(source="mixed", has_text=True, score=min(1.0, c["score"] + (0.15 + 0.20 * min(max(met), 1.0))), text_density=max(met))
    rows = [c for c in rows + anchors(codes) if fits(c)]
    for c in rows:
        met = [k for k in codes if share(c["box"], k["box"]) >= 0.65 or iou(c["box"], k["box"]) >= 0.10]
        if met:
            kinds = {k["code_type"] for k in met}
            boost = 0.22 + (0.08 if "qr" in kinds else 0.0) + (0.05 if "barcode" in kinds else 0.0) + 0.08
            values = [k["value"] for k in sorted(met, key=lambda k: k["code_index"])]
            c.update(score=min(1.0, c["score"] + boost), source="mixed", has_qr=c["has_qr"] or "qr" in kinds, has_barcode=c["has_barcode"] or "barcode" in kinds,
                     code_values=list(dict.fromkeys((c["code_values"] or []) + values)))
    merged = []
    for m in merged_rows([c for c in rows if c["score"] > 0]):
        if final(m):
            merged.append(m)

    def rank(c):
        bonus = (0.12 if c["source"] == "promo_color_layout" else 0.0) + (0.08 if c["source"] == "mixed" else 0.0) + (0.10 if c["has_qr"] or c["has_barcode"] else 0.0)
        return -(c["score"] + bonus), -(c["rectangularity"] or 0.0), -size(c["box"]), c["candidate_index"]

    kept = []
    for c in sorted(merged, key=rank):
        if not any((c["layout_key"] and c["layout_key"] == k["layout_key"]) or iou(c["box"], k["box"]) >= 0.5
                   or share(c["box"], k["box"]) >= 0.82 or share(k["box"], c["box"]) >= 0.82 for k in kept):
            kept.append(c)
    return [(c["candidate_index"], c["source"], round(c["score"], 9), *c["box"]) for c in kept]


def merged_rows(rows):
    return plain_merge([dict(c, x_min=c["box"][0], y_min=c["box"][1], x_max=c["box"][2], y_max=c["box"][3]) for c in rows], whole=True)


def test_detection_equals_a_loop(spark):
    chosen = F.col("frame_index") % 5 == 0
    regions, codes = view(spark, DATA, "regions").where(chosen), view(spark, DATA, "codes").where(chosen)
    got = sorted(
        (r.video_id, r.frame_index, r.candidate_index, r.source, round(r.score, 9), r.x_min, r.y_min, r.x_max, r.y_max)
        for r in detect_candidates(regions, codes).collect()
    )
    frames = {}
    for at, table in enumerate((regions, codes)):
        for r in table.collect():
            frames.setdefault((r.video_id, r.frame_index), ([], []))[at].append(r.asDict())
    want = sorted((*key, *row) for key, (rs, cs) in frames.items() for row in frame_result(rs, cs))
    assert len(want) > 100 and got == want


@pytest.mark.parametrize("dominant_color", ["yellow", "red"])
def test_component_color_is_taken_from_the_regions(spark, dominant_color):
    row = ("v", 0, 1, "color", 100, 100, 260, 200, 0.9, 0.0, 0.1, 0.5, 0.01, 0.01, dominant_color)
    names = "video_id string, frame_index int, region_index int, kind string, x_min int, y_min int, x_max int, y_max int, rectangularity double, text_fill double, edge_density double, white_ratio double, red_ratio double, yellow_ratio double, component_color string"
    out = detect_candidates(spark.createDataFrame([row], names)).collect()
    best = max(r.score for r in out)
    assert round(best, 6) == round(min(0.82, 0.58 + 0.12 * 0.9 + 0.08 + (0.06 if dominant_color == "red" else 0.0)), 6)


def test_layouts_carry_no_array_into_their_rows(spark):
    """A component gives seventy rows; each takes its own box along, not the boxes of all."""
    import re

    from shelfgrid.operators.joins import layout_hypotheses

    rows = spark.createDataFrame(
        [("v", 1, 7, 100, 100, 300, 200, 0.9, 0.3, 0.1, "red")],
        "video_id string, frame_index int, region_index int, x_min int, y_min int, x_max int, y_max int, rectangularity double, "
        "red_ratio double, yellow_ratio double, component_color string",
    )
    out = layout_hypotheses(rows)
    carried = re.search(r"Generate .*\), \[([^\]]*)\], false, \[", out._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "video_id" in carried and "kept" not in carried
    found = out.orderBy("layout_hypothesis").collect()
    assert len(found) > 20 and len({r.layout_hypothesis for r in found}) == len(found)
    assert all(r.layout_component_id == 7 and r.x_min < r.x_max and r.y_min < r.y_max for r in found)
