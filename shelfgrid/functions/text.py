"""Fields read out of recognised text and decoded code payloads."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfgrid.functions.scores import gtin_checksum_ok
from shelfgrid.functions.values import SPACES, ZERO_ONE_LOOKALIKES, digits_only, let, normalize_value, not_blank, squeeze, strip, to_int

# Look-alikes mapped before digits are searched.
OCR_LOOKALIKES = ("OoОоIl|−— ", "0000111-- ")
DIGIT_LOOKALIKES = ("OoОоЗзБбIl|", "00003366111")

# Words that make a line a service line (text parser; the structured parser's subset below).
SERVICE_WORDS = (
    "без карты", "по карте", "цена", "руб", "коп", "скид", "штрих", "qr", "код", "id", "sku", "печати", "дата",
)
STRUCTURED_SERVICE_WORDS = ("без карты", "по карте", "цена", "руб", "коп", "qr", "код", "штрих", "скид", "id", "sku")

# Words that mark a line as a product name.
PRODUCT_WORDS = (
    "вино", "сыр", "молоко", "йогурт", "кефир", "сок", "чай", "кофе", "напиток", "пиво", "вода", "масло",
    "шоколад", "конфеты", "хлеб", "батон", "pure", "haut", "marin", "altitude", "jardin", "charmes",
    "sauvignon", "merlot", "blanc", "блан", "социньон", "совиньон",
)

# Keys of a code payload and the tag fields they fill.
PAYLOAD_FIELDS = {
    "barcode": "qr_code_barcode", "bar_code": "qr_code_barcode", "ean": "qr_code_barcode",
    "ean13": "qr_code_barcode", "gtin": "qr_code_barcode",
    "sku": "id_sku", "id": "id_sku", "idsku": "id_sku", "id_sku": "id_sku",
    "price": "price1_qr", "price1": "price1_qr", "price_1": "price1_qr",
    "price2": "price2_qr", "price_2": "price2_qr",
    "price3": "price3_qr", "price_3": "price3_qr",
    "price4": "price4_qr", "price_4": "price4_qr",
    "actionprice": "action_price_qr", "action_price": "action_price_qr",
    "actioncode": "action_code_qr", "action_code": "action_code_qr",
    "wl1": "wholesale_level_1_count", "wl1count": "wholesale_level_1_count",
    "wholesale_level_1_count": "wholesale_level_1_count",
    "wl1price": "wholesale_level_1_price", "wholesale_level_1_price": "wholesale_level_1_price",
    "wl2": "wholesale_level_2_count", "wl2count": "wholesale_level_2_count",
    "wholesale_level_2_count": "wholesale_level_2_count",
    "wl2price": "wholesale_level_2_price", "wholesale_level_2_price": "wholesale_level_2_price",
}

# Words ignored when names are compared.
STOP_WORDS = (
    "цен", "цена", "руб", "коп", "скид", "карта", "карты", "код", "qr", "id", "sku", "товар", "товара",
    "штрих", "штрихкод", "без", "для", "при", "или", "the", "and", "with", "from",
)

LETTERS = "A-Za-zА-Яа-яЁё"
ENTRY = "array<struct<field:string,value:string,source:string>>"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def normalize_ocr_text(c: Column) -> Column:
    return F.translate(c, *OCR_LOOKALIKES)


def normalize_ocr_digits(c: Column) -> Column:
    return F.translate(c, *DIGIT_LOOKALIKES)


def repeated_digits(digits: Column) -> Column:
    return F.size(F.array_distinct(F.split(digits, ""))) <= 2


def date_fragment(digits: Column, years=("2024", "2025", "2026")) -> Column:
    ends = digits.rlike(f"(?:{'|'.join(years)})$")
    return F.length(digits).isin(6, 8, 12) & (F.startswith(digits, F.lit("20")) | ends)


def _best_percent(numbers: Column, limit: int) -> Column:
    best = F.array_max(F.filter(F.transform(numbers, lambda n: n.try_cast("int")), lambda n: n.between(1, limit)))
    return let(best, lambda n: F.when(n.isNotNull(), F.format_string("-%d%%", n)))


def extract_discount(normalized: Column) -> Column:
    """Largest 1-90 % figure of look-alike-normalised text."""
    return _best_percent(all_matches(normalized, r"(?U)[-−—]?\s*([0-9]{1,2})\s*[%оo]", 1), 90)


def promo_discount(text: Column) -> Column:
    """Largest 1-99 number of a promo digit zone."""
    return _best_percent(all_matches(F.translate(text, "OoОо", "0000"), "[0-9]{1,2}"), 99)


def discount_number(discount: Column) -> Column:
    return let(to_int(F.regexp_extract(discount, "[0-9]{1,2}", 0)), lambda n: F.when(n.between(1, 90), n))


def extract_print_datetime(normalized: Column) -> Column:
    """First date-time per year format, four digits before two; range checks, no calendar."""

    def read(year_digits: int, century: str) -> Column:
        pattern = (
            rf"(?U)\b([0-9]{{2}})[.]([0-9]{{2}})[.]([0-9]{{{year_digits}}})\s+([0-9]{{1,2}})[:.]([0-9]{{2}})\b"
        )

        def shown(parts: Column) -> Column:
            day, month, year, hour, minute = (F.get(parts, F.lit(i)) for i in range(5))

            def within(digits: Column, low: int, high: int) -> Column:
                return digits.try_cast("int").between(low, high)

            ok = within(day, 1, 31) & within(month, 1, 12) & within(hour, 0, 23) & within(minute, 0, 59)
            text = F.concat(day, F.lit("."), month, F.lit("." + century), year, F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":"), minute)
            return F.when(ok, text)

        parts = F.split(not_blank(F.regexp_extract(normalized, pattern, 0)), r"(?U)[.:]|\s+")
        return let(parts, lambda p: F.when(p.isNotNull(), shown(p)))

    return F.coalesce(read(4, ""), read(2, "20"))


def extract_tag_code(normalized: Column) -> Column:
    pattern = r"(?U)\b[0-9]{2,3}[_\s-][0-9]{3,6}(?:\s*[-–]\s*[0-9]{2,3}[_\s-]?[0-9]{3,6})?\b"
    return not_blank(squeeze(F.translate(F.regexp_extract(normalized, pattern, 0), "_", " ")))


def extract_id_sku(normalized: Column, barcode: Column, price_digits: Column, structured: bool = False) -> Column:
    """First digit run of 6-12 that is neither the barcode, a price, a valid GTIN nor a date."""
    split_runs = F.transform(all_matches(normalized, r"(?U)\b[0-9]{6}\s+[0-9]{6}\b"), digits_only)
    runs = F.concat(split_runs, all_matches(normalized, r"(?U)\b[0-9]{6,12}\b"))
    known_barcode = F.coalesce(barcode if structured else digits_only(barcode), F.lit(""))
    known_prices = F.coalesce(price_digits, F.array().cast("array<string>"))
    years = ("2025", "2026") if structured else ("2024", "2025", "2026")

    def kept(known: Column) -> Column:
        def keep(d: Column) -> Column:
            ok = (
                (d != known["barcode"]) & ~F.array_contains(known["prices"], d) & ~gtin_checksum_ok(d) & ~date_fragment(d, years)
            )
            return ok if structured else ok & ~repeated_digits(d)

        return F.filter(runs, keep)

    known = F.struct(known_barcode.alias("barcode"), known_prices.alias("prices"))
    return F.try_element_at(let(known, kept), F.lit(1))


def cents_text(cents: Column) -> Column:
    return F.when(
        cents.isNotNull(), F.concat(F.floor(cents / 100).cast("int").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    )


def _cents(runs: Column) -> Column:
    return F.transform(runs, lambda m: to_int(digits_only(m)))


def extract_price_cents(normalized: Column) -> Column:
    """Up to six distinct prices of 10.00-4999.99 in kopecks, highest first.

    Dates, long codes and percents are blanked first; a price is ``N,NN``, ``NN NN`` or 4-6 digits whose
    last two are kopecks.
    """
    text = F.regexp_replace(normalized, r"(?U)\b[0-9]{2}[.][0-9]{2}[.][0-9]{2,4}\s+[0-9]{1,2}[:.][0-9]{2}\b", " ")
    text = F.regexp_replace(text, r"(?U)\b[0-9][0-9 ]{7,22}[0-9]\b", " ")
    text = F.regexp_replace(text, r"(?U)[-]?\s*[0-9]{1,2}\s*[%оo]", " ")

    def runs(t: Column) -> Column:
        compact = F.filter(all_matches(t, r"(?U)\b[0-9]{4,6}\b"), lambda d: ~date_fragment(d))
        return F.concat(
            all_matches(t, r"(?U)\b[0-9]{1,5}[,.][0-9]{2}\b"), all_matches(t, r"(?U)\b[0-9]{2,4}\s{1,3}[0-9]{2}\b"), compact
        )

    found = F.array_distinct(_cents(let(text, runs)))
    valid = F.filter(found, lambda c: c.between(1000, 499999))
    return F.slice(F.sort_array(valid, asc=False), 1, 6)


def extract_prices(normalized: Column) -> Column:
    return F.transform(extract_price_cents(normalized), cents_text)


def choose_price_pair_text(cents: Column, discount: Column) -> Column:
    """``struct(price_default, price_card)`` in kopecks from distinct prices, highest first."""

    def scored(wanted: Column, high: Column, low: Column) -> Column:
        h, lo = high / F.lit(100.0), low / F.lit(100.0)
        diff = F.abs(F.rint((F.lit(1.0) - lo / h) * F.lit(100.0)) - wanted)
        agreement = F.when(
            wanted.isNotNull(), F.greatest(F.lit(0.0), F.lit(20.0) - diff) - F.when(diff > 20, 20.0).otherwise(0.0)
        ).otherwise(F.lit(0.0))
        score = agreement + h / F.lit(1000.0) - (h - lo) / F.greatest(h, F.lit(1.0))
        return F.struct(score.alias("score"), high.alias("high"), low.alias("low"))

    def choose(prices: Column, wanted: Column) -> Column:
        def lower(high: Column) -> Column:
            return F.filter(prices, lambda low: (low < high) & (high / F.lit(100.0) / F.greatest(low / F.lit(100.0), F.lit(1.0)) <= 4.0))

        pairs = F.flatten(F.transform(prices, lambda high: F.transform(lower(high), lambda low: scored(wanted, high, low))))
        return let(
            F.array_max(pairs),
            lambda best: F.struct(
                best["high"].alias("price_default"),
                F.coalesce(best["low"], F.try_element_at(prices, F.lit(1))).alias("price_card"),
            ),
        )

    return let(cents, lambda prices: let(discount_number(discount), lambda wanted: choose(prices, wanted)))


def text_price_candidates(text: Column) -> Column:
    """Scored prices of 10.00-99999.99 from running text, decimals before compact digit runs."""
    normalized = normalize_ocr_digits(text)

    def candidates(runs: Column, score: float, source: str) -> Column:
        return F.transform(
            F.filter(_cents(runs), lambda c: c.between(1000, 9999999)),
            lambda c: F.struct(c.alias("cents"), F.lit(score).alias("score"), F.lit(source).alias("source")),
        )

    return F.concat(
        candidates(all_matches(normalized, r"(?U)\b[0-9]{1,5}[,.][0-9]{2}\b"), 0.52, "text_decimal"),
        candidates(all_matches(normalized, r"(?U)\b[0-9]{4,7}\b"), 0.32, "text_compact"),
    )


def distinct_prices(candidates: Column) -> Column:
    """Greedy: best score first, a price within a kopeck of a kept one is dropped."""
    ranked = F.transform(
        F.array_sort(
            F.transform(candidates, lambda c, i: F.struct((-c["score"]).alias("neg"), i.alias("at"), c.alias("item")))
        ),
        lambda r: r["item"],
    )
    empty = F.filter(ranked, lambda c: F.lit(False))

    def near(a: Column, b: Column) -> Column:
        return F.abs(a["cents"] / F.lit(100.0) - b["cents"] / F.lit(100.0)) <= 0.01

    return F.aggregate(
        ranked, empty, lambda kept, c: F.when(F.exists(kept, lambda k: near(k, c)), kept).otherwise(F.concat(kept, F.array(c)))
    )


def choose_price_pair_structured(candidates: Column, discount: Column) -> Column:
    """Best (high, low) pair of deduplicated scored prices, with the reason of the choice."""

    def scored(wanted: Column, a: Column, b: Column) -> Column:
        high = F.greatest(a["cents"], b["cents"]) / F.lit(100.0)
        low = F.least(a["cents"], b["cents"]) / F.lit(100.0)
        calc = F.rint((F.lit(1.0) - low / high) * F.lit(100.0))
        diff = F.abs(calc - wanted)
        score = a["score"] + b["score"]
        score = score + F.when(wanted.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - diff / F.lit(15.0))).otherwise(0.0)
        score = score - F.when(diff > 18, 0.75).otherwise(0.0) + F.lit(0.25)
        ok = (a["i"] < b["i"]) & (high > low) & (high / F.greatest(low, F.lit(1.0)) <= 4.0)
        return F.struct(
            F.when(ok, score).alias("score"), (-a["i"]).alias("a"), (-b["i"]).alias("b"),
            F.greatest(a["cents"], b["cents"]).alias("high"), F.least(a["cents"], b["cents"]).alias("low"),
            calc.cast("int").alias("calc"),
        )

    def choose(prices: Column, wanted: Column) -> Column:
        indexed = F.transform(prices, lambda c, i: F.struct(i.alias("i"), c["cents"].alias("cents"), c["score"].alias("score")))
        pairs = F.flatten(F.transform(indexed, lambda a: F.transform(indexed, lambda b: scored(wanted, a, b))))
        n = F.size(prices)

        def result(best: Column) -> Column:
            reason = (
                F.when(n == 1, "single_price").when(best.isNotNull(), "pair_selected").when(n > 1, "fallback_best_single")
            )
            return F.struct(
                best["high"].alias("price_default"),
                F.coalesce(best["low"], F.try_element_at(prices, F.lit(1))["cents"]).alias("price_card"),
                reason.alias("reason"), best["calc"].alias("calc_discount"), best["score"].alias("pair_score"),
            )

        return let(F.array_max(F.filter(pairs, lambda p: p["score"].isNotNull())), result)

    return let(candidates, lambda prices: let(discount_number(discount), lambda wanted: choose(prices, wanted)))


def digit_text_score(text: Column) -> Column:
    return F.length(digits_only(text)) * 10 + F.length(F.regexp_replace(text, "[^%]", "")) * 3


def _longest_first(runs: Column) -> Column:
    keyed = F.transform(runs, lambda r, i: F.struct((-F.length(r)).alias("neg"), i.alias("at"), r.alias("run")))
    return F.transform(F.array_sort(keyed), lambda k: k["run"])


def _rub_kop(run: Column, kop: Column) -> Column:
    long = F.length(run) >= 5
    rub = F.when(long, F.substring(run, F.lit(1), F.length(run) - 2)).otherwise(run)
    rub = F.nullif(rub, F.lit("")).try_cast("long")
    kopecks = F.when(long, F.right(run, F.lit(2)).try_cast("int")).otherwise(kop)
    return F.when(
        rub.between(10, 9999), F.concat(rub.cast("string"), F.lit("."), F.lpad(kopecks.cast("string"), 2, "0"))
    )


def promo_price(text: Column) -> Column:
    """Longest digit run is the price; 99 kopecks unless another two-digit run gives them."""
    runs = _longest_first(all_matches(text, "[0-9]+"))
    others = F.filter(F.slice(runs, 2, 2**31 - 2), lambda r: F.length(r) == 2)
    kop = F.coalesce(F.try_element_at(others, F.lit(1)).try_cast("int"), F.lit(99))
    return _rub_kop(F.try_element_at(runs, F.lit(1)), kop)


def promo_default_price(text: Column) -> Column:
    runs = _longest_first(all_matches(text, "[0-9]{2,6}"))
    prices = F.transform(runs, lambda r: _rub_kop(r, F.lit(99)))
    return F.try_element_at(F.filter(prices, lambda p: p.isNotNull()), F.lit(1))


def extract_barcode(text: Column) -> Column:
    """Longest GTIN with a right checksum, else a plausible 14-digit run; ties by position."""
    runs = F.transform(all_matches(normalize_ocr_digits(text), r"(?U)\b[0-9][0-9\s]{6,22}[0-9]\b"), digits_only)
    sized = F.filter(F.array_distinct(runs), lambda d: F.length(d).isin(8, 12, 13, 14) & ~repeated_digits(d))
    ranked = _longest_first(sized)
    return F.coalesce(
        F.try_element_at(F.filter(ranked, gtin_checksum_ok), F.lit(1)),
        F.try_element_at(F.filter(ranked, lambda d: F.length(d) == 14), F.lit(1)),
    )


def strict_barcode(c: Column) -> Column:
    """8, 12, 13 or 14 digits, more than two of them different."""
    return let(
        digits_only(normalize_ocr_text(c)), lambda d: F.when(F.length(d).isin(8, 12, 13, 14) & ~repeated_digits(d), d)
    )


def _letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[^{LETTERS}]", ""))


def service_line(line: Column, structured: bool = False) -> Column:
    words = STRUCTURED_SERVICE_WORDS if structured else SERVICE_WORDS
    unify = normalize_ocr_digits if structured else normalize_ocr_text

    def numeric(normalized: Column) -> Column:
        return (
            normalized.rlike(r"[0-9]{2}[.][0-9]{2}[.][0-9]{2,4}")
            | normalized.rlike(r"(?U)[0-9]{1,2}\s*%")
            | (F.length(digits_only(normalized)) >= (6 if structured else 8))
        )

    return let(F.lower(line), lambda low: low.rlike("|".join(words)) | let(unify(low), numeric))


def clean_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, f"[^0-9{LETTERS} .,%/()-]+", " "), " +", " "))


# What the pattern classes of the column expressions mean in Python's own patterns.
_LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\u2028\u2029]"
_SPACES, _BLANKS = re.compile(SPACES), re.compile(" +")
_LETTER, _WORD, _CYRILLIC = re.compile(f"[{LETTERS}]"), re.compile(f"[{LETTERS}]{{3,}}"), re.compile("[А-Яа-яЁё]")
_DIRT = re.compile(f"[^0-9{LETTERS} .,%/()-]+")
_DATE, _PERCENT = re.compile("[0-9]{2}[.][0-9]{2}[.][0-9]{2,4}"), re.compile("[0-9]{1,2}[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*%")
_DIGIT = re.compile("[0-9]")
_AS_DIGITS = {ord(a): b for a, b in reversed(list(zip(*OCR_LOOKALIKES)))}


def _is_service_line(line: str) -> bool:
    """:func:`service_line` of one line, for the text parser."""
    low = line.lower()
    if any(w in low for w in SERVICE_WORDS):
        return True
    low = low.translate(_AS_DIGITS)
    digits = len(_DIGIT.findall(low))
    return digits >= 8 or bool(digits and (_DATE.search(low) or _PERCENT.search(low)))


def _described(line: str) -> tuple[bool, int]:
    """Whether a cleaned line reads like a product name, and its score."""
    words, letters, low = _WORD.findall(line), len(_LETTER.findall(line)), line.lower()
    product = sum(w in low for w in PRODUCT_WORDS)
    cyrillic, n = any(_CYRILLIC.search(w) for w in words), len(words)
    short = sum(len(w) <= 3 for w in words)
    crumbs = n >= 4 and short / n > 0.65
    foreign = n >= 4 and not cyrillic and product == 0  # without a Cyrillic letter all words are Latin
    digits = len(_DIGIT.findall(line))
    score = letters + product * 35 + sum(len(w) >= 4 for w in words) * 8 - (30 if digits >= 6 else 0) + (20 if cyrillic else 0)
    return len(line) >= 4 and letters >= 3 and not crumbs and not foreign, score


def _hint(lines) -> str | None:
    if lines is None:
        return None
    found = []
    for line in lines:
        if not _LETTER.search(line):
            continue
        line = _SPACES.sub(" ", line).strip(" ").strip(" |[]{}()")
        if len(line) < 4 or _is_service_line(line):
            continue
        line = _BLANKS.sub(" ", _DIRT.sub(" ", line)).strip(" ")
        plausible, score = _described(line)
        if plausible:
            found.append((-score, len(found), line))
    best = list(dict.fromkeys(line for _, _, line in sorted(found)))[:3]
    return " ".join(best)[:240] or None


def _hints(lines: pd.Series) -> pd.Series:
    return pd.Series([_hint(of_one) for of_one in lines], dtype=object)


def product_hint(text: Column) -> Column:
    """The up to three best-scored distinct lines that read like a product name.

    One pass in Python over the lines of a batch of texts. It is declared non-deterministic only so that the optimiser does not copy it into each
    expression and filter that uses its result.
    """
    return F.pandas_udf(_hints, "string").asNondeterministic()(F.split(text, _LINE_ENDS))


def unquote(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _pairs_of(chunks: Column, separator: Column | None = None) -> Column:
    """``key=value`` (else ``key:value``) chunks as structs, braces and quotes stripped."""
    kept = F.filter(chunks, lambda s: s.rlike("[=:]"))

    def split_at(s: Column) -> Column:
        at = F.when(s.contains("="), F.locate("=", s)).otherwise(F.locate(":", s))
        return F.struct(
            F.substring(s, F.lit(1), at - 1).alias("key"), F.substring(s, at + 1, F.length(s)).alias("value")
        )

    def clean(c: Column) -> Column:
        return F.regexp_replace(strip(c), r"""^[{}\[\]"']+|[{}\[\]"']+$""", "")

    pairs = F.transform(kept, split_at)
    pairs = F.transform(pairs, lambda p: F.struct(clean(p["key"]).alias("key"), clean(p["value"]).alias("value")))
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def payload_key_values(payload: Column) -> Column:
    """Ordered key/value structs of a payload: URL query first, then delimited chunks; a later value wins."""

    def pairs_in(decoded: Column) -> Column:
        # Query string of a URL: after the first '?', before '#'.
        query = F.regexp_extract(F.regexp_replace(decoded, r"(?s)#.*$", ""), r"(?s)^[^?]*\?(.*)$", 1)
        query_parts = F.filter(F.split(query, "&"), lambda s: s.rlike("(?s)^[^=]*=.+$"))
        query_pairs = F.transform(
            query_parts,
            lambda s: F.struct(
                unquote(F.regexp_extract(s, "(?s)^([^=]*)=", 1)).alias("key"),
                unquote(F.regexp_extract(s, "(?s)^[^=]*=(.*)$", 1)).alias("value"),
            ),
        )
        return F.concat(query_pairs, _pairs_of(F.split(decoded, r"[;&|,\n\r]+")))

    def last_per_key(pairs: Column) -> Column:
        return F.transform(
            F.array_distinct(F.transform(pairs, lambda p: p["key"])),
            lambda k: F.struct(
                k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")
            ),
        )

    return let(let(unquote(payload), pairs_in), last_per_key)


def payload_fields(payload: Column) -> Column:
    """Key/value pairs of a payload mapped to tag fields, in order; unknown values dropped."""
    names = F.create_map(*(F.lit(x) for pair in PAYLOAD_FIELDS.items() for x in pair))

    def entry(p: Column) -> Column:
        key = F.regexp_replace(F.lower(strip(p["key"])), "[^a-z0-9_]", "")
        return F.struct(
            F.try_element_at(names, key).alias("field"), normalize_value(p["value"]).alias("value"),
            F.lit("code_payload").alias("source"),
        )

    return F.filter(
        F.transform(payload_key_values(payload), entry), lambda e: e["field"].isNotNull() & e["value"].isNotNull()
    )


def code_entries(payload: Column) -> Column:
    """What one decoded code contributes, as (field, value, source) in order of assignment."""
    def one(field: str, value: Column, source: str) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(source).alias("source"))

    def both(value: Column, source: str) -> Column:
        return F.array(one("barcode", value, source), one("qr_code_barcode", value, source))

    none = F.array().cast(ENTRY)

    def with_barcode(entries: Column) -> Column:
        last_qr = F.try_element_at(F.filter(entries, lambda e: e["field"] == "qr_code_barcode"), F.lit(-1))["value"]
        return let(
            strict_barcode(last_qr),
            lambda read: F.concat(entries, F.when(read.isNotNull(), both(read, "code_payload")).otherwise(none)),
        )

    def read(text: Column, whole: Column) -> Column:
        raw = F.filter(F.array(one("qr_code_barcode", normalize_value(text), "code_raw")), lambda e: e["value"].isNotNull())
        return (
            F.when(text.isNull() | (text == ""), none)
            .when(whole.isNotNull(), both(whole, "code_raw"))
            .otherwise(let(F.concat(raw, payload_fields(text)), with_barcode))
        )

    return let(strip(payload), lambda text: let(strict_barcode(text), lambda whole: read(text, whole)))


def entry_value(entries: Column, field: str) -> Column:
    """Last assignment of a field as ``struct(field, value, source)``."""
    return F.try_element_at(F.filter(entries, lambda e: e["field"] == field), F.lit(-1))


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), "[^0-9a-zа-я]+", " "))


def name_tokens(c: Column) -> Column:
    words = F.array_distinct(all_matches(normalize_name(c), "[0-9a-zа-я]{3,}"))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & ~w.rlike("^(?:[0-9]+|[a-z]{3})$"))


def name_trigrams(c: Column) -> Column:
    def grams(text: Column) -> Column:
        # Positions run to at least 1 so that short names do not count downwards; their grams are dropped.
        at = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
        return F.array_distinct(F.filter(F.transform(at, lambda i: F.substring(text, i, F.lit(3))), lambda g: F.length(g) == 3))

    # Bound first: inside the function the name would be normalised once a position.
    return let(F.translate(normalize_name(c), " ", ""), grams)


def packed_trigrams(c: Column) -> Column:
    """Trigrams as exact integers (21 bits per character), which compare far faster than strings."""
    def code(gram: Column, at: int) -> Column:
        return F.ascii(F.substring(gram, at, 1)).cast("long")

    return F.transform(name_trigrams(c), lambda g: code(g, 1) * (1 << 42) + code(g, 2) * (1 << 21) + code(g, 3))


def jaccard(a: Column, b: Column) -> Column:
    return let(
        F.size(F.array_intersect(a, b)),
        lambda shared: shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1)),
    )


def looks_like_garbage(c: Column) -> Column:
    words = all_matches(c, f"[{LETTERS}]{{2,}}")
    n = F.size(words)
    short = F.size(F.filter(words, lambda w: F.length(w) <= 3))
    latin = F.size(F.filter(words, lambda w: w.rlike("^[A-Za-z]+$")))
    cyrillic = F.exists(words, lambda w: w.rlike("[А-Яа-яЁё]"))
    return (n == 0) | ((n >= 4) & (short / F.greatest(n, F.lit(1)) > 0.65)) | ((latin >= 4) & ~cyrillic)


def loose_barcode(c: Column) -> Column:
    """Catalogue code: 6-14 digits, not all the same."""
    return let(
        digits_only(F.translate(c, *ZERO_ONE_LOOKALIKES)),
        lambda d: F.when(F.length(d).between(6, 14) & (F.size(F.array_distinct(F.split(d, ""))) > 1), d),
    )
