"""Normalisers of the final table. Unknown is NULL inside Spark; the sink writes ``-``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfgrid.functions.numbers import fixed

UNKNOWN = "-"
ABSENT = "нет"

# Spellings read as "unknown" by the final table, by the field parser and by first-known.
UNKNOWN_WORDS = ("-", "—", "–", "none", "null", "nan", "нет данных", "не распознано")
PARSER_ABSENT_WORDS = ("нет", "no", "none", "null", "nan")
PARSER_UNKNOWN_WORDS = ("-", "—", "–")
FIRST_KNOWN_SKIPPED = ("-", "—", "–", "none", "null", "nan")

# Look-alike characters of digits.
ZERO_ONE_LOOKALIKES = ("OoОоIl|", "0000111")
DISCOUNT_LOOKALIKES = ("оОoO−—–", "0000---")


# Whitespace as Unicode sees it; spelled out because Java's \\s is ASCII and its Unicode mode is slow.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"  # the same, in ranges


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, no-break spaces included."""
    return F.btrim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A condition and the branch that repeats it are evaluated one after the other, and so is all that a higher-order
    function holds: Spark finds no common parts there.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def not_blank(c: Column) -> Column:
    return let(c, lambda t: F.when(t != "", t))


def to_int(digits: Column) -> Column:
    """Integer of digit text; blank gives NULL without the cost of a failed cast."""
    return let(digits, lambda d: F.when(d != "", d.try_cast("int")))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def distinct_chars(c: Column) -> Column:
    return F.size(F.array_distinct(F.split(c, "")))


def is_unknown(c: Column) -> Column:
    return c.isNull() | F.coalesce(F.lower(strip(c)).isin("", *UNKNOWN_WORDS), F.lit(False))


def normalize_unknown(c: Column) -> Column:
    text = strip(F.translate(c.cast("string"), "\u00a0", " "))
    return let(text, lambda t: F.when(~F.lower(t).isin("", *UNKNOWN_WORDS), t))


def normalize_text(c: Column, max_length: int | None = None) -> Column:
    text = squeeze(normalize_unknown(c))
    if max_length is not None:
        text = F.left(text, F.lit(max_length))
    return not_blank(text)


def normalize_price(c: Column) -> Column:
    """First price-like number, 0 < p <= 99999, two decimals."""
    kept = F.regexp_replace(F.translate(normalize_unknown(c), ",", "."), r"[^0-9.]", "")
    price = not_blank(F.regexp_extract(kept, r"[0-9]{1,5}(?:\.[0-9]{1,2})?", 0)).try_cast("double")
    return let(price, lambda p: F.when((p > 0) & (p <= 99999), F.format_string("%.2f", p)))


def normalize_discount(c: Column) -> Column:
    text = F.translate(normalize_unknown(c), *DISCOUNT_LOOKALIKES)
    number = to_int(F.regexp_extract(text, f"-?(?:{SPACES})?([0-9]{{1,2}})(?:{SPACES})?%", 1))
    return let(number, lambda n: F.when(n.between(1, 90), F.concat(F.lit("-"), n.cast("string"), F.lit("%"))))


def normalize_barcode(c: Column, allow_internal: bool = True) -> Column:
    digits = digits_only(F.translate(normalize_unknown(c), *ZERO_ONE_LOOKALIKES))

    def checked(d: Column) -> Column:
        size = F.length(d)
        allowed = size.between(6, 14) if allow_internal else size.isin(8, 12, 13, 14)
        return F.when(allowed & (distinct_chars(d) > 1), d)

    return let(digits, checked)


def normalize_id_sku(c: Column) -> Column:
    return let(
        digits_only(normalize_unknown(c)),
        lambda d: F.when(F.length(d).between(6, 14) & (distinct_chars(d) > 1), d),
    )


def normalize_datetime(c: Column) -> Column:
    """``dd.mm.yyyy h:mm``, else the two-digit year form; impossible dates are unknown."""
    text = squeeze(F.translate(normalize_unknown(c), ",", "."))

    def moment(parts: Column, century: str) -> Column:
        day, month, hour, minute = (to_int(F.get(parts, F.lit(i))) for i in (0, 1, 3, 4))
        year = to_int(F.concat(F.lit(century), F.get(parts, F.lit(2))))
        # The ranges come first: an out-of-range argument costs an exception per row.
        sane = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (year >= 1)
        return F.when(sane, F.date_format(F.try_make_timestamp(year, month, day, hour, minute, F.lit(0)), "dd.MM.yyyy HH:mm"))

    def read(t: Column, year_digits: int, century: str) -> Column:
        pattern = rf"[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{{year_digits}}} [0-9]{{1,2}}[:.][0-9]{{2}}"
        parts = F.split(F.regexp_extract(t, pattern, 0), "[ .:]")
        return let(parts, lambda p: moment(p, century))

    return let(text, lambda t: F.coalesce(read(t, 4, ""), read(t, 2, "20")))


def parse_decimal(c: Column) -> Column:
    """Number with a decimal comma or dot; anything else, and non-finite values, NULL."""
    number = F.translate(normalize_unknown(c), ",", ".").try_cast("double")
    return let(number, lambda n: F.when(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), n))


def normalize_coordinate(c: Column) -> Column:
    return let(parse_decimal(c), lambda n: F.translate(fixed(n, 1), ".", ","))


def normalize_timestamp(c: Column) -> Column:

    def shown(number: Column) -> Column:
        whole = F.abs(number - F.rint(number)) < 1e-6
        text = F.rtrim(F.rtrim(fixed(number, 2), F.lit("0")), F.lit("."))
        return F.when(whole, F.rint(number).cast("long").cast("string")).otherwise(text)

    return let(parse_decimal(c), shown)


def validate_price_pair(default: Column, card: Column) -> tuple[Column, Column]:
    """A card price above the shelf price leaves only the card price."""
    c = normalize_price(card)
    checked = let(
        F.struct(normalize_price(default).alias("d"), c.alias("c")),
        lambda p: F.when(p["d"].isNull() | p["c"].isNull() | (p["c"].cast("double") <= p["d"].cast("double")), p["d"]),
    )
    return checked, c


def normalize_value(c: Column) -> Column:
    """Parser view of a raw value: absent words become ``нет``, dashes and blanks NULL."""
    text = strip(F.translate(c.cast("string"), "\u00a0", " "))
    return let(
        text,
        lambda t: F.when(F.lower(t).isin(*PARSER_ABSENT_WORDS), F.lit(ABSENT)).when(~t.isin("", *PARSER_UNKNOWN_WORDS), t),
    )


def normalize_output(c: Column) -> Column:
    return normalize_unknown(c)


def first_known(*columns: Column) -> Column:
    def known(c: Column) -> Column:
        return let(strip(c.cast("string")), lambda t: F.when(~F.lower(t).isin("", *FIRST_KNOWN_SKIPPED), t))

    return F.coalesce(*(known(c) for c in columns))


def parse_json_list(c: Column) -> Column:
    """JSON array as strings without nulls; anything malformed gives an empty array."""
    text = strip(c)
    parsed = F.from_json(F.when(F.startswith(text, F.lit("[")), text), "array<string>")
    return F.coalesce(F.filter(parsed, lambda v: v.isNotNull()), F.array().cast("array<string>"))


def file_stem(c: Column) -> Column:
    name = F.regexp_extract(c, r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^[^.].*\.[^.]*$") & ~name.rlike(r"\.$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def safe_filename(c: Column) -> Column:
    """File stem with runs of other characters turned into one underscore."""
    text = F.regexp_replace(file_stem(strip(c)), r"[^0-9A-Za-zА-Яа-яЁё_-]+", "_")
    text = F.regexp_replace(text, r"^_+|_+$", "")
    return F.when(text == "", F.lit("video")).otherwise(text)


def parse_number(c: Column) -> Column:
    return not_blank(F.translate(strip(c), ",\u00a0 ", ".")).try_cast("double")


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(strip(F.translate(c.cast("string"), ",", ".")).try_cast("double"), F.lit(default))


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.rint(safe_float(c, float(default))).try_cast("int"), F.lit(default))


def timestamp_to_frame(timestamp_ms: Column, fps: Column, frame_count: Column) -> Column:
    frame = F.rint(timestamp_ms / F.lit(1000.0) * fps).cast("int")
    return F.when(frame_count > 0, F.greatest(F.lit(0), F.least(frame, frame_count - 1))).otherwise(frame)


def flatten_whitespace(df):
    """Collapse whitespace in every string column."""
    return df.select(
        *(squeeze(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema)
    )
