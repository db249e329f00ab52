"""Steps whose cost per row must not grow with what a row is repeated over."""

import random
import time

from pyspark.sql import functions as F

from shelfgrid.functions import text as x
from shelfgrid.operators import catalog as cat
from shelfgrid.operators import greedy as gr
from shelfgrid.operators import joins as j
from shelfgrid.operators.rankings import split_train_val
from shelfgrid.sources import readers as rd
from shelfgrid.streaming import tracks as st

DET = "video_id string, frame_index int, timestamp_ms double, candidate_index int, x_min int, y_min int, x_max int, y_max int"
LABEL = "video_id string, label_id int, frame_timestamp double, x_min int, y_min int, x_max int, y_max int"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trigrams_normalise_a_name_once(spark):
    name = "".join(random.Random(1).choice("abcdefgh") for _ in range(40_000))
    df = spark.createDataFrame([(name,), ("Ab",), (None,), ("Сыр ё",)], "s string")
    started = time.time()
    long, short, none, russian = (set(r[0]) for r in df.select(x.name_trigrams(F.col("s"))).collect())
    assert time.time() - started < 15
    assert long == {name[i : i + 3] for i in range(len(name) - 2)}
    assert short == none == set() and russian == {"сыр", "ыре"}


def test_few_kept_boxes_need_no_grid():
    rnd = random.Random(2)
    made = []
    for _ in range(400):
        a, b = rnd.randrange(3000), rnd.randrange(1500)
        made.append((a, b, a + rnd.randrange(0, 400), b + rnd.randrange(0, 300)))

    def conflict(p, q):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        if w <= 0 or h <= 0:
            return False
        shared, one, two = w * h, gr.area(p), gr.area(q)
        return shared / (one + two - shared) >= 0.3 or shared / min(one, two) >= 0.5

    keeper, kept = gr._Suppressor(0.3, 0.5, None), []
    for n, box in enumerate(made):
        free = not any(conflict(box, k) for k in kept)
        assert keeper.keep(*box) == free
        if free:
            kept.append(box)
        assert len(kept) > gr.FEW or not keeper.grids  # an ordinary frame builds no grid
    assert len(kept) > gr.FEW and keeper.grids


def test_labels_meet_detections_in_one_pass(spark):
    rnd = random.Random(3)

    def box():
        a, b = rnd.randrange(600), rnd.randrange(400)
        return (a, b, a + 60 + rnd.randrange(60), b + 60 + rnd.randrange(60))

    det = [(v, f, f * 700.0, c, *box()) for v in "ab" for f in (*range(6), *range(20, 24)) for c in range(12)]
    labels = [(v, 100 * f + n, f * 700.0 + 300, *box()) for v in "ab" for f in (0, 1, 3, 5, 21, 23) for n in range(9)]
    labels.append(("a", 9999, None, *box()))
    out = j.match_labels(spark.createDataFrame(det, DET), spark.createDataFrame(labels, LABEL))
    used, want = set(), set()
    for v, f, t, c, *d in det:
        rated = []
        for lv, n, lt, *b in labels:
            if lv == v and lt is not None and abs(lt - t) <= 2000 and (v, n) not in used:
                w, h = min(d[2], b[2]) - max(d[0], b[0]), min(d[3], b[3]) - max(d[1], b[1])
                if w > 0 and h > 0:
                    rated.append((-w * h / (gr.area(d) + gr.area(b) - w * h), n))
        if rated and -min(rated)[0] >= 0.25:
            used.add((v, min(rated)[1]))
            want.add((v, f, c, min(rated)[1]))
    assert {tuple(r)[:4] for r in out.collect()} == want and want
    assert plan(out).count("Join ") <= 2  # stretches of the labels and the pairs; the pairs are not made again for cutting


def test_successors_meet_once_a_column(spark):
    rnd = random.Random(4)
    det = []
    for f in range(0, 60, 12):
        for c in range(40):
            a, b = rnd.randrange(3600), rnd.randrange(2000)
            det.append(("v", f, f * 40.0, c, a, b, a + rnd.randrange(40, 700), b + rnd.randrange(40, 500)))
    # Equal boxes at a frame's edge, just within 0.6222 of the reach: nearer than the score needs, farther than 0.62 of it.
    det += [("e", 0, 0.0, 0, 100, 0, 1100, 100), ("e", 12, 480.0, 0, 100 + 3780, 0, 1100 + 3780, 100)]
    rows = spark.createDataFrame(det, DET)
    out = j.pair_successors(rows)
    a, b = (rows.select(*(F.col(c).alias(f"{p}_{c}") for c in rows.columns)) for p in "lr")
    pairs = a.join(b, (F.col("l_video_id") == F.col("r_video_id")) & (F.col("r_frame_index") - F.col("l_frame_index")).between(1, 36))
    score = j.g.match_score(j.g.box("l_"), j.g.box("r_"))
    want = pairs.filter(score >= 0.27).select("l_video_id", "l_frame_index", "l_candidate_index", "r_frame_index", "r_candidate_index")
    assert sorted(map(tuple, out.drop("match_score").collect())) == sorted(map(tuple, want.collect()))
    assert plan(out).count("Generate explode") <= 3  # columns of either side and the buckets


def test_anchor_boxes_as_the_expressions_say(spark):
    rnd = random.Random(5)
    rows = [("v", 0, n, "qr" if n % 2 else "barcode", str(n), a := rnd.randrange(3700), b := rnd.randrange(2000), a + rnd.randrange(-40, 500), b + rnd.randrange(-40, 400)) for n in range(300)]
    rows += [("v", 1, 1, "qr", "n", None, 5, 60, 70), ("v", 1, 2, "qr", "m", None, None, None, None)]
    codes = spark.createDataFrame(rows, "video_id string, frame_index int, code_index int, code_type string, value string, x_min int, y_min int, x_max int, y_max int")
    out = j.anchor_hypotheses(codes)
    boxes = F.transform(
        j._grown(j.ANCHOR_PRESETS, j.g.box(), 3840, 2160), lambda s: j._as_struct(j.g.cap_size(j.g.box_of(s), j.g.box(), 3840, 2160, 0.35))
    )
    want = codes.withColumn("boxes", boxes).withColumn("boxes", j.distinct_boxes(F.col("boxes"), 0.85))
    want = want.select("frame_index", "code_index", F.posexplode("boxes").alias("hyp", "b")).select("frame_index", "code_index", "hyp", "b.*")
    got = out.select("frame_index", "code_index", F.col("anchor_hypothesis").alias("hyp"), *j.SIDES)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "ArrowEvalPython" in plan(out)  # boxes with all sides are grown in batches


def test_payload_lists_are_read_once(spark):
    text = ",".join(f'"line {i}"' for i in range(1500))
    scores = ",".join("0.5" for _ in range(1500))
    boxes = ",".join(f"[{i},1,{i + 9},8]" if i % 2 else f"[[{i},1],[{i + 9},1],[{i + 9},8]]" for i in range(1500))
    payload = f'{{"res":{{"rec_texts":[{text}],"rec_scores":[{scores}],"rec_boxes":[{boxes}]}}}}'
    df = spark.createDataFrame([(1, payload)], "tag_id int, payload string")
    started = time.time()
    blocks = rd.ocr_blocks(df)
    assert blocks.count() == 1500
    assert blocks.agg(F.sum("x_min"), F.sum("x_max"), F.sum("y_min"), F.sum("y_max")).head() == (sum(range(1500)), sum(range(9, 1509)), 1500, 12000)
    assert time.time() - started < 30
    out = rd.ocr_texts(blocks, ["tag_id"], F.sum("x_min").alias("total"))
    assert out.select("total").head()[0] == sum(range(1500)) and plan(out).lower().count("parsejson(") == 1


class _Handle:
    """State and timers of one key, with their calls counted."""

    def __init__(self):
        self.timers, self.maps = set(), {}
        self.value = None

    def getMapState(self, *_):
        maps = self.maps

        class State:
            def containsKey(self, k):
                return k in maps

            def getValue(self, k):
                return maps[k]

            def updateValue(self, k, v):
                maps[k] = v

            def removeKey(self, k):
                maps.pop(k)

        return State()

    def getValueState(self, *_):
        handle = self

        class State:
            def exists(self):
                return handle.value is not None

            def get(self):
                return handle.value

            def update(self, v):
                handle.value = v

        return State()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_frames_of_a_slice_share_a_timer():
    import pandas as pd

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

        def getExpiryTimeInMs(self):
            return self.at

    columns = ["at", "frame_index", "quality", "candidate_index", *st.SIDES]
    rows = pd.DataFrame([(1 + 40 * f, f, 0.9, c, 500 + 900 * c, 500, 700 + 900 * c, 640) for f in range(100) for c in range(2)], columns=columns)
    handle, processor = _Handle(), st.TrackProcessor(st.TrackConfig(), 600_000)
    processor.init(handle)
    list(processor.handleInputRows(("v",), iter([rows.sample(frac=1, random_state=1)]), None))
    assert handle.timers == {1}
    first = pd.concat(list(processor.handleExpiredTimer(("v",), Now(2001), Now(1))))
    assert sorted(set(first["frame_index"])) == list(range(50)) and 2001 in handle.timers
    rest = pd.concat(list(processor.handleExpiredTimer(("v",), Now(10**6), Now(2001))))
    assert len(first) + len(rest) == 200 and set(first["track_id"]) == set(rest["track_id"]) == {1, 2}
    # Idle for longer than idle_ms: frames begin anew, ids go on.
    again = rows.assign(at=rows["at"] + 10**7)
    list(processor.handleInputRows(("v",), iter([again]), None))
    third = pd.concat(list(processor.handleExpiredTimer(("v",), Now(10**8), Now(10**7 + 1))))
    assert set(third["track_id"]) == {3, 4}


def test_entries_of_the_same_tokens_meet_names_once(spark):
    rows = [(i, f"молоко простое {'свежее' if i % 2 else ''}", str(4600000000000 + i)) for i in range(600)]
    rows.append((600, "сырок детский", "4600000009999"))
    catalog = cat.build_catalog(spark.createDataFrame(rows, "entry_id int, product_name string, barcode string"), ["entry_id"])
    names = spark.createDataFrame([("Молоко топленое",), ("Сырный соус",), ("Пусто",), (None,)], "product_name string")
    pairs, members = cat.candidate_classes(names, catalog)
    assert pairs.count() == 2 and members.count() == 601
    found = cat.catalog_candidates(names, catalog)
    assert found.count() == 600 and found.select("product_name").distinct().count() == 1


def test_split_makes_its_items_once(spark):
    """Counting the prefixes and dealing out the rows read the same items."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    items = spark.range(1000).selectExpr("concat('frame_', id) AS image_name").mapInArrow(counted, "image_name string")
    out = split_train_val(items, "image_name", 0.2, 42).collect()
    assert made.value == 1000
    assert sum(r["split"] == "val" for r in out) == 200 and len({r["image_name"] for r in out}) == 1000
