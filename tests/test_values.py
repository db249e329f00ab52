"""Hand-written cases, Cyrillic ones included."""

import pytest
from pyspark.sql import functions as F

from shelfgrid.functions import geometry as g
from shelfgrid.functions import scores as sc
from shelfgrid.functions import text as x
from shelfgrid.functions import values as v
from shelfgrid.operators import joins as j

CASES = [
    (v.normalize_price, "1 299,90 руб", "1299.90"), (v.normalize_price, "0", None), (v.normalize_price, "нет данных", None),
    (v.normalize_discount, "— 2О %", "-20%"), (v.normalize_discount, "95%", None),
    (v.normalize_datetime, "31.02.2025 10:00", None), (v.normalize_datetime, "01.03.25 9:05", "01.03.2025 09:05"),
    (v.normalize_coordinate, "10.25", "10,2"), (v.normalize_coordinate, "abc", None),
    (v.normalize_timestamp, "1200.50", "1200.5"), (v.normalize_timestamp, "40,0", "40"),
    (v.normalize_barcode, "46О1234567890", "4601234567890"), (v.normalize_barcode, "1111111", None),
    (v.normalize_value, "NONE", "нет"), (v.normalize_value, " — ", None), (v.normalize_text, "  a   b ", "a b"),
    (x.extract_print_datetime, "31.02.2025 10:00", "31.02.2025 10:00"),
    (x.normalize_name, "Молоко «Ёлка» 3,2%", "молоко елка 3 2"),
    (x.promo_price, "12345 7", "123.45"), (x.promo_price, "129 90", "129.90"), (x.promo_price, "129", "129.99"),
    (x.extract_tag_code, "зона 12_3456 - 78 901", "12 3456 - 78 901"),
    (x.product_hint, "цена 100\nМолоко Домик 3,2", "Молоко Домик 3,2"), (x.product_hint, "Молоко Простоквашино 3,2", None),
    (v.file_stem, "a/b/clip.one.mp4", "clip.one"), (v.safe_filename, "dir/25 12-20.mp4", "25_12-20"),
]


@pytest.mark.parametrize("fn,given,expected", CASES)
def test_function(spark, fn, given, expected):
    df = spark.createDataFrame([(given,)], "s string")
    assert df.select(fn(F.col("s"))).head()[0] == expected


def test_normalisers_are_idempotent(spark):
    df = spark.createDataFrame([("1 299,90 руб",), ("- 5 %",), ("01.03.25 9:05",), ("10.25",)], "s string")
    for fn in (v.normalize_price, v.normalize_discount, v.normalize_datetime, v.normalize_coordinate, v.normalize_text):
        once = df.select(fn(F.col("s")).alias("s"))
        assert once.select(fn(F.col("s"))).collect() == once.collect()


def test_price_pair_gtin_and_payload(spark):
    df = spark.createDataFrame([("99.00", "120.00", "4006381333931", "barcode=460123456789")], "d string, c string, g string, p string")
    d, c = v.validate_price_pair(F.col("d"), F.col("c"))
    entries = x.code_entries(F.col("p"))
    row = df.select(d, c, sc.gtin_checksum_ok(F.col("g")), x.entry_value(entries, "barcode")["value"]).head()
    assert tuple(row) == (None, "120.00", True, "0460123456789")


def test_name_tokens(spark):
    df = spark.createDataFrame([("Молоко «Ёлка» 3,2%",)], "s string")
    assert set(df.select(x.name_tokens(F.col("s"))).head()[0]) == {"молоко", "елка"}


def test_geometry_cases(spark):
    df = spark.createDataFrame([(-5, 10, 5000, 10), (10, 20, 30, 40)], "x_min int, y_min int, x_max int, y_max int")
    clamped = df.select(*g.clamp(g.box(), 3840, 2160).columns()).collect()
    assert tuple(clamped[0]) == (0, 10, 3840, 11)
    turned = df.select(*g.rotate(g.box(), 100, 60, F.lit("rot90_ccw")).columns()).collect()
    assert tuple(turned[1]) == (20, 70, 40, 90)
    with pytest.raises(Exception, match="unknown rotation mode"):
        df.select(*g.rotate(g.box(), 100, 60, F.lit("up")).columns()).collect()


def test_missing_video_is_an_error(spark):
    files = spark.createDataFrame([("out/a.csv",), ("out/b.csv",)], "label_path string")
    videos = spark.createDataFrame([("in/a.mp4",)], "video_path string")
    assert j.match_video(files, videos, strict=False).count() == 1
    with pytest.raises(Exception, match="no video for"):
        j.match_video(files, videos).collect()


def test_overlap_joins_are_keyed(spark):
    from shelfgrid.queries.registry import Inputs

    t = Inputs(spark, "/root/testdata/sf0.001")
    for df in (j.boost_with_text(t.candidates), j.boost_with_codes(t.candidates, t.codes), j.match_labels(t.det, t.labels_gt)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("fn,part,times", [
    (x.product_hint, "split(s", 1), (x.extract_tag_code, "regexp_extract(s", 1), (x.extract_print_datetime, "regexp_extract(s", 2),
    (x.strict_barcode, "translate(s", 1), (x.code_entries, "btrim(s", 1), (v.normalize_text, "translate((s", 1),
    (x.extract_discount, "regexp_extract_all(s", 1),
])
def test_text_is_read_once(spark, fn, part, times):
    """What a condition and its branch share is bound, not written twice: Spark would evaluate it twice."""
    df = spark.createDataFrame([("a",)], "s string").select(fn(F.col("s")).alias("o"))
    plan = df._jdf.queryExecution().analyzed().toString().replace("cast(s", "(s")
    assert plan.replace("s#", "s").count(part) == times


def test_hint_keeps_order_of_lines(spark):
    text = "12 34\n[ Сыр  Домик ]\nprice 10.00\nмолоко Домик\nСыр Домик\n|\n"
    df = spark.createDataFrame([(text,), ("",), (None,), ("\n \n12\n",)], "s string")
    assert [r[0] for r in df.select(x.product_hint(F.col("s"))).collect()] == ["молоко Домик Сыр Домик price 10.00", None, None, None]
