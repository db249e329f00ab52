"""Tag fields from recognised text, decoded codes, promo zones and label rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgrid.config import ParserConfig
from shelfgrid.functions import scores as sc
from shelfgrid.functions import text as x
from shelfgrid.functions import values as v
from shelfgrid.operators import aggregates as agg
from shelfgrid.operators.folds import fold_groups, shuffle_partitions
from shelfgrid.operators.greedy import group_words_into_lines
from shelfgrid.operators.joins import pair_rub_kop
from shelfgrid.schemas import TAG_FIELDS


def _promo_price(c: Column) -> Column:
    price = F.nullif(F.regexp_extract(F.translate(c, ",", "."), r"[0-9]{1,5}[.][0-9]{2}", 0), F.lit("")).try_cast("double")
    return v.let(price, lambda p: F.when(p.between(10.0, 4999.99), F.format_string("%.2f", p)))


def parse_tag_fields(rows: DataFrame, keep: list[str], cfg: ParserConfig = ParserConfig()) -> DataFrame:
    """The 23 tag fields and their provenance.

    Later sources overwrite earlier ones: ``label_<field>`` columns, ``code_values`` (array), ``raw_text``,
    then ``promo_confidence / promo_price_card / promo_price_default / promo_discount_amount``, which never
    overwrite a label. Missing columns count as empty. A row costs far more to evaluate than to move, so rows are dealt
    out by ``keep`` first: the input may be a single file.
    """
    have = set(rows.columns)
    if keep:
        rows = rows.repartition(shuffle_partitions(rows), *keep)
    none = F.lit(None).cast("string")

    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in have else none

    codes = F.col("code_values") if "code_values" in have else F.array().cast("array<string>")
    entries = F.flatten(F.transform(F.coalesce(codes, F.array().cast("array<string>")), x.code_entries))
    stage = rows.select(
        *keep, column("raw_text").alias("_raw"), entries.alias("_entries"),
        *(v.normalize_value(column(f"label_{f}")).alias(f"_label_{f}") for f in TAG_FIELDS if f"label_{f}" in have),
        column("promo_confidence").try_cast("double").alias("_promo"), column("promo_price_card").alias("_promo_card"),
        column("promo_price_default").alias("_promo_default"), column("promo_discount_amount").alias("_promo_discount"),
    )
    labelled = {f for f in TAG_FIELDS if f"label_{f}" in have}
    stage = stage.withColumns({f"_code_{f}": x.entry_value(F.col("_entries"), f) for f in _code_fields()})

    def base(f: str) -> Column:
        parts = [F.col(f"_code_{f}")["value"]] if f in _code_fields() else []
        parts += [F.col(f"_label_{f}")] if f in labelled else []
        return F.coalesce(*parts, none)

    def base_source(f: str) -> Column:
        source = F.lit(None).cast("string")
        if f in labelled:
            source = F.when(F.col(f"_label_{f}").isNotNull(), "labeled_csv")
        if f in _code_fields():
            source = F.coalesce(F.col(f"_code_{f}")["source"], source)
        return source

    stage = stage.withColumn("_norm", x.normalize_ocr_text(v.squeeze(F.col("_raw"))))
    stage = stage.withColumns(
        {"_discount": x.extract_discount(F.col("_norm")), "_cents": x.extract_price_cents(F.col("_norm"))}
    )
    pair = x.choose_price_pair_text(F.col("_cents"), F.coalesce("_discount", base("discount_amount")))
    stage = stage.withColumn("_pair", pair)
    stage = stage.withColumns(
        {"_ocr_default": x.cents_text(F.col("_pair.price_default")), "_ocr_card": x.cents_text(F.col("_pair.price_card"))}
    )
    price_digits = F.filter(
        F.array(F.translate("_ocr_default", ".", ""), F.translate("_ocr_card", ".", "")), lambda p: p.isNotNull()
    )
    ocr = {
        "discount_amount": F.col("_discount"), "price_default": F.col("_ocr_default"), "price_card": F.col("_ocr_card"),
        "print_datetime": x.extract_print_datetime(F.col("_norm")), "code": x.extract_tag_code(F.col("_norm")),
        "id_sku": x.extract_id_sku(F.col("_norm"), base("barcode"), price_digits),
        "product_name": x.product_hint(F.col("_raw")),
    }
    stage = stage.withColumns({f"_text_{f}": c for f, c in ocr.items()})

    sure = F.coalesce(F.col("_promo") >= cfg.min_promo_confidence, F.lit(False))
    stage = stage.withColumns({"_pc": _promo_price(F.col("_promo_card")), "_pd": _promo_price(F.col("_promo_default"))})
    crossed = F.coalesce(F.col("_pc").cast("double") > F.col("_pd").cast("double"), F.lit(False))
    promo = {
        "price_default": F.when(sure & ~crossed, F.col("_pd")), "price_card": F.when(sure & ~crossed, F.col("_pc")),
        "discount_amount": F.when(
            sure & x.discount_number(F.col("_promo_discount")).isNotNull(), v.normalize_value(F.col("_promo_discount"))
        ),
    }

    value: dict[str, Column] = {}
    source: dict[str, Column] = {}
    for f in TAG_FIELDS:
        value[f], source[f] = base(f), base_source(f)
        if f in ocr:
            found = F.col(f"_text_{f}")
            value[f] = F.coalesce(found, value[f])
            source[f] = F.when(found.isNotNull(), "ocr_text").otherwise(source[f])
        if f in promo:
            usable = promo[f].isNotNull() & ~F.coalesce(source[f] == "labeled_csv", F.lit(False))
            value[f] = F.when(usable, promo[f]).otherwise(value[f])
            source[f] = F.when(usable, "promo_price_parser").otherwise(source[f])
    stage = stage.select(
        *keep, *(value[f].alias(f) for f in TAG_FIELDS), *(source[f].alias(f"_source_{f}") for f in TAG_FIELDS)
    )
    stage = stage.withColumns({"_b": x.strict_barcode(F.col("barcode")), "_q": x.strict_barcode(F.col("qr_code_barcode"))})
    to_qr, to_barcode = F.col("_b").isNotNull() & F.col("_q").isNull(), F.col("_q").isNotNull() & F.col("_b").isNull()
    stage = stage.withColumns(
        {
            "qr_code_barcode": F.when(to_qr, F.col("_b")).otherwise(F.col("qr_code_barcode")),
            "barcode": F.when(to_barcode, F.col("_q")).otherwise(F.col("barcode")),
            "_source_qr_code_barcode": F.when(to_qr, "derived_from_barcode").otherwise(F.col("_source_qr_code_barcode")),
            "_source_barcode": F.when(to_barcode, "derived_from_qr_code_barcode").otherwise(F.col("_source_barcode")),
        }
    )
    known = F.filter(
        F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_source_{f}").alias("source")) for f in TAG_FIELDS)),
        lambda e: e["source"].isNotNull(),
    )
    return stage.select(*keep, *TAG_FIELDS, F.map_from_entries(known).alias("sources"))


def _code_fields() -> list[str]:
    return [f for f in TAG_FIELDS if f in {"barcode", *x.PAYLOAD_FIELDS.values()}]


def product_name_from_lines(lines: DataFrame, sizes: DataFrame, key: str = "tag_id") -> DataFrame:
    """The four best name-like lines of a tag's upper left part."""
    rows = lines.join(sizes, key).withColumn("text", v.squeeze(F.col("text")))
    rows = rows.filter(
        (F.length("text") >= 3) & (F.col("y_min") <= F.col("tag_height") * 0.60) & (F.col("x_min") <= F.col("tag_width") * 0.72)
        & F.col("text").rlike(f"[{x.LETTERS}]") & ~x.service_line(F.col("text"), structured=True)
    )
    rows = rows.withColumn("cleaned", x.clean_line(F.col("text")))
    letters = F.length(F.regexp_replace("cleaned", f"[^{x.LETTERS}]", ""))
    rows = rows.withColumn("letters", letters).filter((F.length("cleaned") >= 3) & (F.col("letters") >= 3))
    score = (
        F.col("letters") + F.when(F.col("y_min") < F.col("tag_height") * 0.35, 15).otherwise(0)
        + F.when(F.col("x_min") < F.col("tag_width") * 0.55, 10).otherwise(0)
    )
    best = Window.partitionBy(key).orderBy(score.desc(), "line_index")
    rows = rows.withColumn("rk", F.row_number().over(best)).filter("rk <= 4")
    return rows.groupBy(key).agg(F.left(F.array_join(agg.first_seen("rk", "cleaned"), " "), F.lit(240)).alias("product_name"))


class _TopPrices:
    """Best-scored prices that are more than a kopeck apart; nothing beyond the limit is kept."""

    def __init__(self, limit: int):
        self.limit, self.kept, self.key = limit, [], None

    def push(self, row):
        self.key = row[0]
        if len(self.kept) < self.limit and all(abs(row[1] / 100.0 - k[1] / 100.0) > 0.01 for k in self.kept):
            self.kept.append(row)
            return ((*row, len(self.kept)),)
        return ()

    def finish(self):
        return ()


def top_prices(candidates: DataFrame, key: str = "tag_id", limit: int = 8) -> DataFrame:
    """Ranked distinct prices per tag; equal prices fold into their best one before the shuffle."""
    key_type = dict(candidates.dtypes)[key]
    rows = candidates.filter(F.col("cents").between(1000, 9999999)).groupBy(key, "cents").agg(
        F.max(F.struct(F.col("score"), (-F.col("position")).alias("neg"), "source")).alias("b")
    )
    rows = rows.select(key, "cents", F.col("b.score").alias("score"), F.col("b.source").alias("source"), (-F.col("b.neg")).alias("position"))
    return fold_groups(
        rows, [key], [F.col("score").desc(), F.col("position")], lambda: _TopPrices(limit),
        f"{key} {key_type}, cents int, score double, source string, position bigint, rk int",
    )


def parse_structured_tags(
    words: DataFrame, sizes: DataFrame, fallback: DataFrame | None = None, key: str = "tag_id"
) -> DataFrame:
    """Fields of a tag from positioned words (``sizes`` holds tag width and height per key)."""
    words = agg.distinct_words(words, key)
    full = words.groupBy(key).agg(F.array_join(agg.first_seen("word_seq", "text"), " ").alias("full_text"), F.count("*").alias("words_count"))
    if fallback is not None:
        full = full.join(fallback.select(key, "raw_text"), key, "left").withColumn(
            "full_text", F.when(F.col("raw_text") != "", F.concat("full_text", F.lit("\n"), "raw_text")).otherwise(F.col("full_text"))
        ).drop("raw_text")
    norm = x.normalize_ocr_digits(F.col("full_text"))
    full = full.withColumn("norm", norm).withColumns(
        {
            "discount_amount": x.extract_discount(F.col("norm")), "print_datetime": x.extract_print_datetime(F.col("norm")),
            "barcode": x.extract_barcode(F.col("full_text")), "code": x.extract_tag_code(F.col("norm")),
        }
    )
    lines = agg.line_rollup(group_words_into_lines(words, key), [key, "line_index"])
    names = product_name_from_lines(lines, sizes, key)

    from_words = pair_rub_kop(words, key).select(
        key, "cents", "score", "source", (F.col("word_seq").cast("long") * 100_000 + F.col("kop_seq") + 1).cast("long").alias("position")
    )
    from_text = full.select(key, F.posexplode(x.text_price_candidates(F.col("full_text"))).alias("p", "c")).select(
        key, "c.cents", "c.score", "c.source", (F.col("p") + F.lit(1 << 40)).cast("long").alias("position")
    )
    ranked = top_prices(from_words.unionByName(from_text), key)
    prices = ranked.groupBy(key).agg(agg.first_seen("rk", F.struct("cents", "score")).alias("candidates"))
    rows = full.join(prices, key, "left").join(names, key, "left")
    rows = rows.withColumn("choice", x.choose_price_pair_structured(F.col("candidates"), F.col("discount_amount")))
    rows = rows.withColumns(
        {"price_default": x.cents_text(F.col("choice.price_default")), "price_card": x.cents_text(F.col("choice.price_card"))}
    )
    digits = F.filter(F.array(F.translate("price_default", ".", ""), F.translate("price_card", ".", "")), lambda p: p.isNotNull())
    rows = rows.withColumn("id_sku", x.extract_id_sku(F.col("norm"), F.col("barcode"), digits, structured=True))
    fields = ("product_name", "price_card", "price_default", "discount_amount", "barcode", "id_sku", "print_datetime")
    confidence = sc.parse_confidence(
        {f: F.col(f) for f in fields}, F.coalesce(F.col("choice.reason") == "pair_selected", F.lit(False)),
        F.col("choice.calc_discount"), x.discount_number(F.col("discount_amount")),
    )
    return rows.select(
        key, *fields, "code", confidence.alias("confidence"), F.col("choice.reason").alias("price_reason"),
        F.col("choice.calc_discount").alias("calc_discount"), "words_count", F.coalesce(F.size("candidates"), F.lit(0)).alias("price_candidates"),
    )
