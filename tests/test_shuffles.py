"""What joins of boxes shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from shelfgrid.operators import joins as j
from shelfgrid.sources.tables import view


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_detections_are_shuffled_once(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(rnd.randrange(40), rnd.randrange(3), rnd.randrange(3), rnd.randrange(50), float(rnd.randrange(90))) for _ in range(300)]
    rows += rows[:20] + [(None, 1, 1, 1, 1.0), (1, 1, None, 1, 1.0), (1, 1, None, None, None)]
    names = "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long, l_extendedprice double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    det, codes = view(spark, str(tmp_path), "det"), view(spark, str(tmp_path), "codes")
    both = det.join(codes, ["video_id", "frame_index"], "left").groupBy("source").agg(F.max("candidate_index"), F.max("code_index"))
    assert "ReusedExchange" in executed(both)
    numbered = {}
    for order, line, supplier, part, price in sorted(rows, key=lambda r: [(v is not None, v or 0) for v in (r[0], r[1], r[3], r[4])]):
        numbered.setdefault((supplier, None if order is None else order % 97), []).append((order, line, part, price))
    sizes = sorted(len(v) for v in numbered.values())
    found = sorted(r["n"] for r in det.groupBy("video_id", "frame_index").agg((F.max("candidate_index") + 1).alias("n")).collect())
    assert found == sizes and det.count() == len(rows)


def test_code_hits_are_shuffled_once(spark):
    sides = "x_min int, y_min int, x_max int, y_max int"
    candidates = spark.createDataFrame(
        [("v", 1, 0, "mixed", 0.5, False, False, 0, 0, 100, 100), ("v", 1, 1, "mixed", 0.5, False, False, 800, 800, 900, 900)],
        f"video_id string, frame_index int, candidate_index int, source string, score double, has_qr boolean, has_barcode boolean, {sides}",
    )
    codes = spark.createDataFrame(
        [("v", 1, n, "qr" if n % 2 else "barcode", str(n // 2), 0.9, 10 + n, 10, 40 + n, 40) for n in range(6)],
        f"video_id string, frame_index int, code_index int, code_type string, value string, confidence double, {sides}",
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = j.boost_with_codes(candidates, codes)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["candidate_index"]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 5  # candidates, their cells, codes, their cells, hits
    assert got[0]["code_values"] == ["0", "1", "2"] and got[0]["has_qr"] and got[0]["score"] == pytest.approx(0.93)
    assert not got[1]["has_qr"] and got[1]["code_inside"] is False


def test_labels_are_copied_into_few_buckets(spark):
    labels = [("v", n, float(t), 0, 0, 10, 10) for n, t in enumerate(range(0, 400_000, 1000))]
    times = [-2500.0, -2000.0, 0.0, 1999.5, 2000.0, 3999.0, 4000.0, 8000.0, 397_000.0, 401_000.0, 401_000.5, None]
    det = [("v", n, 0, t, 0, 0, 10, 10) for n, t in enumerate(times)]
    d = spark.createDataFrame(det, "video_id string, frame_index int, candidate_index int, timestamp_ms double, x_min int, y_min int, x_max int, y_max int")
    g = spark.createDataFrame(labels, "video_id string, label_id int, frame_timestamp double, x_min int, y_min int, x_max int, y_max int")
    asked = []
    plain = j.overlapping_pairs

    def watched(left, right, keys):
        asked.append(right.count())
        return plain(left, right, keys)

    j.overlapping_pairs = watched
    try:
        found = {r["frame_index"]: r["label_id"] for r in j.match_labels(d, g).collect()}
    finally:
        j.overlapping_pairs = plain
    assert asked[0] < 2 * len(labels)  # three copies each before
    used, expected = set(), {}
    for frame, t in enumerate(times):
        free = [n for _, n, at, *_ in labels if t is not None and abs(at - t) <= 2000 and n not in used]
        if free:
            expected[frame] = free[0]
            used.add(free[0])
    assert found == expected
