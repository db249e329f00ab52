"""Files written by one side and read by the other."""

import codecs

from pyspark.sql import functions as F

from shelfgrid.operators.aggregates import summarize_tracks
from shelfgrid.plans.jobs import build_training_set, run_summary
from shelfgrid.schemas import FINAL_COLUMNS
from shelfgrid.sources import readers as rd
from shelfgrid.sources import writers as wr


def lines(path, pattern="*.csv"):
    return [line for p in sorted(path.rglob(pattern)) if not p.name.startswith(("_", ".")) for line in p.read_text(encoding="utf-8").splitlines()]


def test_catalog_from_mixed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("code;полное название\n4601234567890;Молоко Ёлка\n;нет\n".encode("cp1251"))
    (tmp_path / "b.csv").write_text("fullname,barcode\nСыр Гауда,46O0000000017\nМолоко Ёлка,4601234567890\n", encoding="utf-8-sig")
    rows = rd.scan_catalog(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("entry_id").collect()
    assert [(r.product_name, r.barcode) for r in rows] == [("Молоко Ёлка", "4601234567890"), ("нет", None), ("Сыр Гауда", "4600000000017")]


def test_detection_report_round_trip(spark, tmp_path):
    rows = [("v", 12, 480.0, 0, "mixed", 0.91234567, 1, 2, 101, 82)]
    df = spark.createDataFrame(rows, "video_id string, frame_index int, timestamp_ms double, candidate_index int, source string, score double, x_min int, y_min int, x_max int, y_max int")
    wr.write_detections(df, str(tmp_path / "d"))
    back = rd.scan_detections(spark, str(tmp_path / "d"), min_score=0.5).collect()
    assert [(r.video_id, r.frame_index, r.score, r.x_max) for r in back] == [("v", 12, 0.912346, 101)]
    wr.write_detections(df, str(tmp_path / "h"), service=False, evidence=["score"])
    assert lines(tmp_path / "h")[0].endswith("aspect_ratio,evidence")


def test_final_csv_and_ragged_rows(spark, tmp_path):
    df = spark.createDataFrame([("shelf", "a", 1)], "filename string, product_name string, extra int").coalesce(1)
    wr.write_final_csv(df, str(tmp_path / "f"), sep=";")
    raw = [p for p in (tmp_path / "f").glob("*.csv")][0].read_bytes()
    assert raw.startswith(codecs.BOM_UTF8)
    assert raw.decode("utf-8-sig").splitlines() == [";".join(FINAL_COLUMNS), ";".join(["shelf", "a"] + ["-"] * 27)]
    wr.write_recognition([df, spark.createDataFrame([("b", 2)], "filename string, more int")], str(tmp_path / "r"))
    assert "filename,product_name,extra,more" in lines(tmp_path / "r")


def test_tracks_codes_labels_and_summary(spark, tmp_path):
    rows = [("v", 1, f * 12, f * 480.0, 0, "mixed", 0.9, 10, 10, 110, 90) for f in range(3)]
    det = spark.createDataFrame(rows, "video_id string, track_id int, frame_index int, timestamp_ms double, candidate_index int, source string, score double, x_min int, y_min int, x_max int, y_max int")
    wr.write_tracks(summarize_tracks(det), det, str(tmp_path / "t"))
    assert lines(tmp_path / "t" / "tracks")[1].startswith("v;1;0;24;")
    assert len(lines(tmp_path / "t" / "track_detections")) == 4
    codes = det.withColumns({"code_index": F.lit(0), "code_type": F.lit("qr"), "value": F.lit("x=1"), "confidence": F.lit(0.5)})
    wr.write_codes(codes, str(tmp_path / "c"))
    wr.write_codes(codes, str(tmp_path / "p"), probe=True)
    assert lines(tmp_path / "c")[0].startswith("frame_index,timestamp_ms") and "reader" in lines(tmp_path / "p")[0]

    labels = spark.createDataFrame([("v", "480,0", str(10 * i), "5", str(10 * i + 60), "90", i) for i in range(4)],
                                   "video_id string, frame_timestamp string, x_min string, y_min string, x_max string, y_max string, ordinal int")
    videos = spark.createDataFrame([("v", 25.0, 100, 3840, 2160)], "video_id string, fps double, frame_count int, width int, height int")
    items = build_training_set(rd.check_labels(labels), videos)
    wr.write_training_labels(items, str(tmp_path / "s"))
    made = sorted(p.relative_to(tmp_path / "s" / "labels") for p in (tmp_path / "s" / "labels").rglob("*.txt"))
    want = {(r.split, r.image_name): r.lines for r in items.collect()}
    assert len(made) == len(want) and {len(p.parts) for p in made} == {2}  # one file an image, one directory a split
    for (split, image), text in want.items():
        assert lines(tmp_path / "s" / "labels" / split, image.rsplit(".", 1)[0] + ".txt") == text
    wr.write_training_labels(items.limit(1), str(tmp_path / "s"))  # overwrites, and leaves no unfinished files
    assert len([p for p in (tmp_path / "s" / "labels").rglob("*") if p.is_file()]) == 1
    wr.write_run_summary(run_summary(items, class_id=0), str(tmp_path / "j"))
    assert lines(tmp_path / "j", "*.txt")[0].startswith('{"items_total":1')


def test_word_table_and_labels(spark, tmp_path):
    (tmp_path / "w.tsv").write_text('text\tconf\tleft\ttop\twidth\theight\n12"9\t90\t1\t2\t30\t40\n \t90\t1\t2\t3\t4\nlow\t5\t1\t2\t3\t4\nbad\tx\t1\t2\t3\t4\n', encoding="utf-8")
    got = rd.scan_ocr_words(spark, str(tmp_path / "w.tsv")).collect()
    assert [(r.text, r.confidence, r.x_max, r.y_max) for r in got] == [('12"9', 0.9, 31, 42)]
    (tmp_path / "l.csv").write_text("frame_timestamp;x_min;y_min;x_max;y_max;wholesale_level_1_coun\n1,5;1;2;3;4;2\n", encoding="utf-8")
    assert "wholesale_level_1_count" in rd.scan_labels(spark, str(tmp_path / "l.csv")).columns


def test_legacy_ocr_payload(spark):
    text = '[[[[1,2],[30,2],[30,20],[1,20]],["Сыр",0.9]],[[[1,2],[3,4]],["x",0.05]]]'
    df = spark.createDataFrame([(1, text), (2, "not json")], "tag_id int, payload string")
    got = rd.ocr_blocks(df).collect()
    assert [(r.tag_id, r.text, r.confidence, r.x_min, r.y_max) for r in got] == [(1, "Сыр", 0.9, 1, 20)]


def test_encoding_is_judged_on_the_whole_file(spark, tmp_path):
    from shelfgrid.sources.readers import scan_flexible_csv

    head = "".join(f"name {i};{i}\n" for i in range(8000))
    (tmp_path / "late.csv").write_bytes(("fullname;code\n" + head + "Молоко Ёлка;99999\n").encode("cp1251"))
    (tmp_path / "utf.csv").write_bytes(("fullname;code\n" + head + "Молоко Ёлка;99999\n").encode("utf-8-sig"))
    for name in ("late.csv", "utf.csv"):
        rows = scan_flexible_csv(spark, str(tmp_path / name))
        assert rows.columns == ["fullname", "code"] and rows.count() == 8001
        assert rows.where("code = '99999'").first()["fullname"] == "Молоко Ёлка"


def test_folder_of_files_in_two_encodings_and_separators(spark, tmp_path):
    """Each file by its own encoding, separator and header, in one read."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_bytes("название;код\nМолоко;4600000000017\n\"Сыр; твёрдый\";4600000000024\n".encode("cp1251"))
    (folder / "b.csv").write_text("fullname,barcode\nМолоко безлактозное,4600000000031\n", encoding="utf-8-sig")
    (folder / "c.csv").write_text("title\tean\nКефир\t4600000000048\n", encoding="utf-8")
    rows = rd.scan_flexible_csv(spark, str(folder))
    assert rows.columns == ["название", "код", "fullname", "barcode", "title", "ean"]
    got = {r["название"] or r["fullname"] or r["title"] for r in rows.collect()}
    assert got == {"Молоко", "Сыр; твёрдый", "Молоко безлактозное", "Кефир"}
    entries = rd.scan_catalog(spark, str(folder)).orderBy("entry_id").collect()
    assert [(r.product_name, r.barcode) for r in entries] == [
        ("Молоко", "4600000000017"), ("Сыр; твёрдый", "4600000000024"), ("Молоко безлактозное", "4600000000031"), ("Кефир", "4600000000048")
    ]
    plan = rd.csv_cells(spark, [str(folder / f"{n}.csv") for n in "abc"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2  # the lines and the decisions, however many files there are


def test_results_try_commas_first(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b;c\n1,2;3\n", encoding="utf-8")
    assert rd.scan_flexible_csv(spark, str(tmp_path / "r.csv")).columns == ["a,b", "c"]
    assert rd.scan_flexible_csv(spark, str(tmp_path / "r.csv"), rd.RESULT_SEPARATORS).columns == ["a", "b;c"]
