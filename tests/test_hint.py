"""Product names out of recognised text."""

from pyspark.sql import functions as F

from shelfgrid.functions import text as x
from shelfgrid.plans.parsing import parse_tag_fields


def test_names_are_read_once(spark):
    """The optimiser must not copy the reading of a name into each filter and expression behind it."""
    rows = spark.createDataFrame([(1, "Молоко Домик\nцена 10.00"), (2, None), (3, "")], "k int, raw_text string")
    fields = parse_tag_fields(rows, ["k"]).filter(F.col("product_name").isNotNull() & ~F.col("product_name").isin("", "-"))
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [(r["k"], r["product_name"]) for r in fields.collect()] == [(1, "Молоко Домик")]


def test_hint_reads_odd_lines(spark):
    texts = {
        "Вино\xa0 Красное  сухое\r\nцена 12": "Вино Красное сухое", "red wine dry sweet\n": None, "merlot wine dry sweet\x85Сыр Ёлка": "merlot wine dry sweet Сыр Ёлка",
        "абв 12345678 где": None, "абв 1234 где": "абв 1234 где", "[|молоко|]": "молоко", "ab cd ef gh dry sweet wine red": None, "молоко 15　% ": None, "Ab1": None,
        "x" * 300: "x" * 240,
    }
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert dict(df.select("s", x.product_hint(F.col("s"))).collect()) == texts
