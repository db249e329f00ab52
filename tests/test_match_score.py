"""The match score of two boxes, as the tracker and the successor join use it."""

import math
import random

from pyspark.sql import functions as F

from shelfgrid.config import TrackConfig
from shelfgrid.functions import geometry as g

SIDES = ("x_min", "y_min", "x_max", "y_max")


def plain(p, q, cfg):
    w, h = [max(0, b[2] - b[0]) for b in (p, q)], [max(0, b[3] - b[1]) for b in (p, q)]
    edge = any(b[0] <= cfg.edge_margin or b[1] <= cfg.edge_margin or b[2] >= cfg.frame_width - cfg.edge_margin or b[3] >= cfg.frame_height - cfg.edge_margin for b in (p, q))
    shared = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
    total = w[0] * h[0] + w[1] * h[1] - shared
    overlap = shared / total if total > 0 else 0.0
    away = math.hypot((p[0] + p[2] - q[0] - q[2]) / 2, (p[1] + p[3] - q[1] - q[3]) / 2)
    center = max(0.0, 1 - away / (max(80.0, *w, *h) * cfg.distance_factor * (1.9 if edge else 1.0)))
    size = 0.5 * min(w) / max(1, *w) + 0.5 * min(h) / max(1, *h)
    if overlap < (0.0 if edge else cfg.min_match_iou) and center < (0.38 if edge else 0.55):
        return 0.0
    return 0.45 * overlap + 0.45 * center + 0.10 * size if edge else 0.58 * overlap + 0.30 * center + 0.12 * size


def test_parts_of_the_score_are_written_once(spark):
    rnd, cfg = random.Random(8), TrackConfig()

    def box():
        x, y = rnd.choice([0, 3, 500, 560, 620, 3700]), rnd.choice([0, 300, 340, 2050])
        return x, y, x + rnd.choice([-2, 0, 90, 140, 139]), y + rnd.choice([0, 70, 109, 110])

    rows = [(*box(), *box()) for _ in range(600)] + [(None, *box()[1:], *box())]
    df = spark.createDataFrame(rows, ", ".join(f"{p}{s} int" for p in ("a_", "b_") for s in SIDES))
    out = df.select(*df.columns, g.match_score(g.box("a_"), g.box("b_"), cfg).alias("score"))
    assert out._jdf.queryExecution().analyzed().toString().upper().count("SQRT(") == 1
    scores = [(r[:8], r["score"]) for r in out.collect()]
    for r, score in scores[:-1]:
        assert abs(score - plain(r[:4], r[4:], cfg)) < 1e-12
    assert len({round(s, 6) for _, s in scores[:-1]}) > 30
    assert df.select(F.count("*")).first()[0] == len(rows)
