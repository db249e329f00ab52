"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgrid.llm.common import lower_ascii, text_or_empty, written

#: Runs of these characters separate words (after lower-casing A-Z).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SLOTS = 1 << 17  # bits of the filter over benchmark fingerprints: 16 KB, whatever the benchmark's size


def words_of(text: str) -> Column:
    return F.filter(F.split(lower_ascii(text_or_empty(text)), SEPARATORS), lambda w: w != "")


def _kept(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read and never compute again (a generator keeps projections apart)."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def _starts(words: Column, width: int) -> Column:
    """Positions (from 1) at which ``width`` words begin."""
    n = F.size(words) - width + 1
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, width: int) -> Column:
    return F.transform(_starts(words, width), lambda p: F.xxhash64(F.slice(words, p, width)))


def _bit(hash_: Column, bits: Column) -> Column:
    word = F.element_at(bits, F.shiftright(hash_, 6).bitwiseAND(_SLOTS // 64 - 1).cast("int") + 1)
    return F.call_function("shiftright", word, hash_.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _short_windows(words: Column, width: int, known: Column) -> Column:
    """Runs of ``width`` words that may be a whole short item."""
    maybe = F.filter(_starts(words, width), lambda p: _bit(F.xxhash64(F.slice(words, p, width)), known))
    return F.transform(maybe, lambda p: F.struct(
        p.alias("start"), F.lit(width).alias("width"), F.array_join(F.slice(words, p, width), " ").alias("window")
    ))


def _filter_bits(hashes: DataFrame) -> Column:
    """Which of ``_SLOTS`` slots the hashes fall into, as an array of 64-bit words; at most 2048 numbers reach the driver."""
    slot = F.shiftright("hash", 6).bitwiseAND(_SLOTS // 64 - 1).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("hash").bitwiseAND(63).cast("int"))
    rows = hashes.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect()
    bits = [0] * (_SLOTS // 64)
    for r in rows:
        bits[r["slot"]] = r["bits"]
    return F.lit(bits).cast("array<bigint>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, span: int = 10, gram: int = 4, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``.

    A benchmark window is ``span`` consecutive words of an item, or a whole item of fewer words. A document's word is hit if
    it lies in an occurrence of a window; ``n_items`` counts the items with an occurring window, and ``items_sha256`` is the
    SHA-256 of their ids, sorted as strings and joined by commas. Null and empty texts have no words and no hits; so has
    every document if the benchmark is empty. Each repeated row gets its row. Columns named like a new one are replaced.

    Both sides are winnowed: of the hashes of ``gram`` words, the smallest in each run of ``span - gram + 1`` is a
    fingerprint, so every shared span of ``span`` words has one in common. Documents drop what cannot be in the
    benchmark by a filter of fixed size, then fingerprints are joined, and each hit is extended: the windows around it are
    compared word by word with the benchmark's. Items shorter than a window are looked up whole. A passage that many documents
    share is a skewed join side, which Spark splits; nothing is gathered but what belongs to one document.
    """
    reach = span - gram + 1
    fresh = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    docs = docs.drop(*fresh, "_row", "_words", "_hashes", "_found", "_short")

    items = _kept(benchmark.select("item_id", "text"), "_words", words_of("text")).drop("text")
    lengths = [r[0] for r in items.select(F.size("_words").alias("n")).where(f"n between 1 and {span - 1}").distinct().collect()]
    width = F.least(F.size("_words"), F.lit(span))
    windows = items.where(F.size("_words") > 0).select(
        "item_id", width.alias("width"),
        F.explode(F.transform(
            F.sequence(F.lit(1), F.size("_words") - width + 1), lambda p: F.array_join(F.slice("_words", p, width), " ")
        )).alias("window"),
    ).distinct()
    windows = written(windows, "benchmark-windows")
    hashed = _kept(items.where(F.size("_words") >= span), "_hashes", _grams(F.col("_words"), gram))
    smallest = F.transform(_starts(F.col("_hashes"), reach), lambda p: F.array_min(F.slice("_hashes", p, reach)))
    prints = written(hashed.select(F.explode(F.array_distinct(smallest)).alias("hash")).distinct(), "benchmark-prints")
    bits = _filter_bits(prints)

    read = _kept(docs.withColumn("_row", F.monotonically_increasing_id()), "_words", words_of(text)).drop(text)
    read = _kept(read, "_hashes", _grams(F.col("_words"), gram))
    hashes, words, n = F.col("_hashes"), F.col("_words"), F.size("_words")

    def is_fingerprint(p: Column) -> Column:
        first, last = F.greatest(p - reach + 1, F.lit(1)), F.least(p, F.size(hashes) - reach + 1)
        own = F.element_at(hashes, p)
        return (last >= first) & F.exists(
            F.sequence(first, F.greatest(first, last)), lambda s: F.array_min(F.slice(hashes, s, reach)) == own
        )

    maybe = F.filter(_starts(hashes, 1), lambda p: _bit(F.element_at(hashes, p), bits) & is_fingerprint(p))

    def context(p: Column) -> Column:
        first, last = F.greatest(p - reach + 1, F.lit(1)), F.least(p, n - span + 1)
        return F.struct(F.element_at(hashes, p).alias("hash"), F.transform(
            F.sequence(first, F.greatest(first, last)),
            lambda s: F.struct(s.alias("start"), F.array_join(F.slice(words, s, span), " ").alias("window")),
        ).alias("around"))

    short = F.array().cast("array<struct<start:int,width:int,window:string>>")
    if lengths:
        known = _filter_bits(windows.where(F.col("width") < span).select(F.xxhash64(F.split("window", " ")).alias("hash")))
        short = F.concat(*(_short_windows(words, m, known) for m in sorted(lengths)))
    read = written(_kept(read, "_maybe", maybe).select(
        *docs.drop(text).columns, "_row", n.cast("long").alias("n_words"), F.transform("_maybe", context).alias("_found"),
        short.alias("_short"),
    ), "document-prints")

    hits = read.select("_row", F.inline("_found")).join(prints, "hash", "left_semi")
    long_ = hits.select("_row", F.inline("around")).distinct().select("_row", "start", F.lit(span).alias("width"), "window")
    found = long_.unionByName(read.select("_row", F.inline("_short")))
    found = found.join(windows.withColumnRenamed("item_id", "_item"), ["width", "window"]).drop("window")
    end = F.struct("start", (F.col("start") + F.col("width")).alias("end"))
    union = F.aggregate(
        F.array_sort("_spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["last"]), F.lit(0))).alias("n"),
            F.greatest(a["last"], s["end"]).alias("last"),
        ),
        lambda a: a["n"].cast("long"),
    )
    spans = found.groupBy("_row").agg(F.collect_set(end).alias("_spans")).select("_row", union.alias("n_hit"))
    listed = found.select("_row", F.col("_item").cast("string").alias("_item")).distinct().groupBy("_row").agg(
        F.array_sort(F.collect_list("_item")).alias("_items")
    )
    none = F.coalesce("_items", F.array().cast("array<string>"))
    out = read.drop("_found", "_short").join(spans.join(listed, "_row"), "_row", "left")
    return out.select(
        *docs.drop(text).columns, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(none).cast("long").alias("n_items"), F.sha2(F.array_join(none, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
