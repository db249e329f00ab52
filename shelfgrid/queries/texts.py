"""Text extraction."""

from pyspark.sql import functions as F

from shelfgrid.functions import text as x
from shelfgrid.functions.values import squeeze
from shelfgrid.queries.registry import query
from shelfgrid.queries.scores import gtin_sql
from shelfgrid.queries.values import KEY

K = ", ".join(KEY)
NORM = "translate(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')), 'OoIl|', '00111')"
TEXTS = f"(SELECT {K}, raw_text, {NORM} AS norm FROM tag_text) q"


def texts(t):
    return t.tag_text.select(*KEY, "raw_text", x.normalize_ocr_text(squeeze(F.col("raw_text"))).alias("norm"))


@query("normalize_ocr_text", "tag_text", f"""
    SELECT {K}, norm, translate(raw_text, 'OoIl|', '00111') AS digits FROM {TEXTS}""")
def normalize_ocr_text(t):
    return texts(t).select(*KEY, "norm", x.normalize_ocr_digits(F.col("raw_text")).alias("digits"))


DISCOUNT = "list_max(list_filter(list_transform(regexp_extract_all(norm, '-?\\s*([0-9]{1,2})\\s*%', 1), lambda v: CAST(v AS INT)), lambda v: v BETWEEN 1 AND 90))"
PROMO_DISCOUNT = "list_max(list_filter(list_transform(regexp_extract_all(norm, '[0-9]{1,2}'), lambda v: CAST(v AS INT)), lambda v: v BETWEEN 1 AND 99))"


@query("extract_discount", "tag_text", f"""
    SELECT {K}, CASE WHEN d IS NOT NULL THEN concat('-', d, '%') END AS discount, CASE WHEN p IS NOT NULL THEN concat('-', p, '%') END AS promo
    FROM (SELECT {K}, {DISCOUNT} AS d, {PROMO_DISCOUNT} AS p FROM {TEXTS}) e""")
def extract_discount(t):
    norm = F.col("norm")
    return texts(t).select(*KEY, x.extract_discount(norm).alias("discount"), x.promo_discount(norm).alias("promo"))


def datetime_sql(c):
    def read(n, century):
        p = f"'\\b([0-9]{{2}})[.]([0-9]{{2}})[.]([0-9]{{{n}}})\\s+([0-9]{{1,2}})[:.]([0-9]{{2}})\\b'"
        g = [f"regexp_extract({c}, {p}, {i})" for i in range(1, 6)]
        i = [f"TRY_CAST({v} AS INT)" for v in g]
        return (
            f"CASE WHEN {i[0]} BETWEEN 1 AND 31 AND {i[1]} BETWEEN 1 AND 12 AND {i[3]} BETWEEN 0 AND 23 AND {i[4]} BETWEEN 0 AND 59"
            f" THEN concat({g[0]}, '.', {g[1]}, '.{century}', {g[2]}, ' ', lpad({g[3]}, 2, '0'), ':', {g[4]}) END"
        )

    return f"coalesce({read(4, '')}, {read(2, '20')})"


@query("extract_print_datetime", "tag_text", f"SELECT {K}, {datetime_sql('norm')} AS print_datetime FROM {TEXTS}")
def extract_print_datetime(t):
    return texts(t).select(*KEY, x.extract_print_datetime(F.col("norm")).alias("print_datetime"))


TAG_CODE = (
    "nullif(trim(regexp_replace(replace(regexp_extract(norm, '\\b[0-9]{2,3}[_\\s-][0-9]{3,6}(?:\\s*[-–]\\s*[0-9]{2,3}[_\\s-]?[0-9]{3,6})?\\b', 0), '_', ' '),"
    " '\\s+', ' ', 'g')), '')"
)


@query("extract_tag_code", "tag_text", f"SELECT {K}, {TAG_CODE} AS code FROM {TEXTS}")
def extract_tag_code(t):
    return texts(t).select(*KEY, x.extract_tag_code(F.col("norm")).alias("code"))


def date_like(d, years="2024|2025|2026"):
    return f"(length({d}) IN (6, 8, 12) AND ({d} LIKE '20%' OR regexp_matches({d}, '({years})$')))"


def few_digits(d):
    return f"(len(list_distinct(string_split({d}, ''))) <= 2)"


def id_sku_sql(barcode, prices):
    runs = (
        "list_concat(list_transform(regexp_extract_all(norm, '\\b[0-9]{6}\\s+[0-9]{6}\\b'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')),"
        " regexp_extract_all(norm, '\\b[0-9]{6,12}\\b'))"
    )
    return (
        f"list_filter({runs}, lambda d: d <> coalesce({barcode}, '') AND NOT list_contains({prices}, d)"
        f" AND NOT (length(d) IN (8, 12, 13, 14) AND {gtin_sql('d')}) AND NOT {date_like('d')} AND NOT {few_digits('d')})[1]"
    )


@query("extract_id_sku", "tag_text", f"""
    SELECT {K}, {id_sku_sql("CAST(100000 + l_orderkey * 31 % 900000 AS STRING)", "[CAST(100000 + l_partkey AS STRING)]")} AS other,
           {id_sku_sql("''", "['999']")} AS id_sku FROM {TEXTS}""")
def extract_id_sku(t):
    own = (F.lit(100000) + F.col("l_orderkey") * 31 % 900000).cast("string")
    part = F.array((F.lit(100000) + F.col("l_partkey")).cast("string"))
    none = F.lit(None).cast("string")
    return texts(t).select(
        *KEY, x.extract_id_sku(F.col("norm"), own, part).alias("other"),
        x.extract_id_sku(F.col("norm"), none, F.array(F.lit("999"))).alias("id_sku"),
    )


@query("gtin_checksum_ok", "code_values", f"""
    SELECT {K}, regexp_matches(value, '^[0-9]+$') AND length(value) IN (8, 12, 13, 14) AND CASE WHEN regexp_matches(value, '^[0-9]+$') THEN {gtin_sql('value')} ELSE FALSE END AS checksum_ok,
           {few_digits('value')} AS repeated, {date_like('value')} AS date_fragment FROM code_values""")
def gtin_checksum_ok(t):
    from shelfgrid.functions.scores import gtin_checksum_ok as ok

    v = F.col("value")
    return t.code_values.select(
        *KEY, ok(v).alias("checksum_ok"), x.repeated_digits(v).alias("repeated"), x.date_fragment(v).alias("date_fragment")
    )


def cents_list(pattern, text):
    return f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda m: CAST(regexp_replace(m, '[^0-9]', '', 'g') AS INT))"


PRICE_TEXT = (
    "regexp_replace(regexp_replace(regexp_replace(norm, '\\b[0-9]{2}[.][0-9]{2}[.][0-9]{2,4}\\s+[0-9]{1,2}[:.][0-9]{2}\\b', ' ', 'g'),"
    " '\\b[0-9][0-9 ]{7,22}[0-9]\\b', ' ', 'g'), '-?\\s*[0-9]{1,2}\\s*%', ' ', 'g')"
)
COMPACT = f"list_transform(list_filter(regexp_extract_all(cleaned, '\\b[0-9]{{4,6}}\\b'), lambda d: NOT {date_like('d')}), lambda d: CAST(d AS INT))"
CENTS = (
    f"list_concat(list_concat({cents_list('\\b[0-9]{1,5}[,.][0-9]{2}\\b', 'cleaned')}, {cents_list('\\b[0-9]{2,4}\\s{1,3}[0-9]{2}\\b', 'cleaned')}), {COMPACT})"
)
PRICES = f"list_slice(list_reverse_sort(list_distinct(list_filter({CENTS}, lambda c: c BETWEEN 1000 AND 499999))), 1, 6)"
PRICED = f"(SELECT {K}, norm, raw_text, {PRICES} AS cents FROM (SELECT *, {PRICE_TEXT} AS cleaned FROM {TEXTS}) c) priced"
MONEY = "printf('%d.%02d', {0} // 100, {0} % 100)"


def money(c):
    return f"(CASE WHEN {c} IS NOT NULL THEN {MONEY.format(c)} END)"


@query("extract_prices", "tag_text", f"""
    SELECT {K}, array_to_string(list_transform(cents, lambda c: {MONEY.format('c')}), ' ') AS prices FROM {PRICED}""")
def extract_prices(t):
    return texts(t).select(*KEY, F.array_join(x.extract_prices(F.col("norm")), " ").alias("prices"))


def pair_sql(wanted):
    diff = f"abs(round_even((1.0E0 - (lo / 100.0E0) / (hi / 100.0E0)) * 100.0E0, 0) - {wanted})"
    score = (
        f"(CASE WHEN {wanted} IS NOT NULL THEN greatest(0.0E0, 20.0E0 - {diff}) - (CASE WHEN {diff} > 20 THEN 20.0E0 ELSE 0.0E0 END) ELSE 0.0E0 END)"
        " + (hi / 100.0E0) / 1000.0E0 - (hi / 100.0E0 - lo / 100.0E0) / greatest(hi / 100.0E0, 1.0E0)"
    )
    return score


PAIRS = f"""
    prices AS (SELECT {K}, norm, raw_text, cents, {DISCOUNT} AS wanted FROM {PRICED}),
    his AS (SELECT *, unnest(cents) AS hi FROM prices), pairs AS (SELECT *, unnest(cents) AS lo FROM his),
    best AS (SELECT {K}, max(struct_pack(score := {pair_sql('wanted')}, hi := hi, lo := lo)) AS b FROM pairs
             WHERE hi > lo AND (hi / 100.0E0) / greatest(lo / 100.0E0, 1.0E0) <= 4.0 GROUP BY {K})"""


@query("choose_price_pair_text", "tag_text", f"""
    WITH {PAIRS}
    SELECT p.l_orderkey, p.l_linenumber, p.l_suppkey, p.l_partkey, {money('b.hi')} AS price_default, {money('coalesce(b.lo, cents[1])')} AS price_card
    FROM prices p LEFT JOIN best USING ({K})""")
def choose_price_pair_text(t):
    norm = F.col("norm")
    pair = x.choose_price_pair_text(x.extract_price_cents(norm), x.extract_discount(norm))
    rows = texts(t).select(*KEY, pair.alias("p"))
    return rows.select(
        *KEY, x.cents_text(F.col("p.price_default")).alias("price_default"), x.cents_text(F.col("p.price_card")).alias("price_card")
    )


@query("extract_text_prices", "tag_text", f"""
    SELECT {K}, array_to_string(list_concat(
             list_transform(list_filter({cents_list('\\b[0-9]{1,5}[,.][0-9]{2}\\b', 'norm')}, lambda c: c BETWEEN 1000 AND 9999999), lambda c: concat({MONEY.format('c')}, '@0.52')),
             list_transform(list_filter({cents_list('\\b[0-9]{4,7}\\b', 'norm')}, lambda c: c BETWEEN 1000 AND 9999999), lambda c: concat({MONEY.format('c')}, '@0.32'))), ' ') AS prices
    FROM {TEXTS}""")
def extract_text_prices(t):
    found = x.text_price_candidates(F.col("norm"))
    shown = F.transform(found, lambda c: F.concat(x.cents_text(c["cents"]), F.lit("@"), c["score"].cast("string")))
    return texts(t).select(*KEY, F.array_join(shown, " ").alias("prices"))


RUNS = "list_transform(list_sort(list_transform({0}, lambda z, i: struct_pack(neg := -length(z), pos := i, run := z))), lambda k: k.run)"


def rub_kop(run, kop):
    rub = f"TRY_CAST(CASE WHEN length({run}) >= 5 THEN substring({run}, 1, length({run}) - 2) ELSE {run} END AS BIGINT)"
    k = f"(CASE WHEN length({run}) >= 5 THEN right({run}, 2) ELSE {kop} END)"
    return f"(CASE WHEN {rub} BETWEEN 10 AND 9999 THEN concat({rub}, '.', {k}) END)"


@query("promo_price_text", "digit_text", f"""
    SELECT {K}, {rub_kop('runs[1]', "coalesce(list_filter(runs[2:], lambda z: length(z) = 2)[1], '99')")} AS price,
           list_filter(list_transform({RUNS.format("regexp_extract_all(raw_text, '[0-9]{2,6}')")}, lambda z: {rub_kop('z', "'99'")}), lambda p: p IS NOT NULL)[1] AS default_price,
           length(regexp_replace(raw_text, '[^0-9]', '', 'g')) * 10 + length(regexp_replace(raw_text, '[^%]', '', 'g')) * 3 AS digit_score
    FROM (SELECT *, {RUNS.format("regexp_extract_all(raw_text, '[0-9]+')")} AS runs FROM digit_text) dt""")
def promo_price_text(t):
    raw = F.col("raw_text")
    return t.digit_text.select(
        *KEY, x.promo_price(raw).alias("price"), x.promo_default_price(raw).alias("default_price"),
        x.digit_text_score(raw).alias("digit_score"),
    )


@query("extract_barcode", "code_values", f"""
    WITH runs AS (SELECT {K}, list_filter(list_distinct(list_transform(regexp_extract_all(concat('n ', translate(value, 'OoIl|', '00111')), '\\b[0-9][0-9\\s]{{6,22}}[0-9]\\b'),
                         lambda m: regexp_replace(m, '[^0-9]', '', 'g'))), lambda d: length(d) IN (8, 12, 13, 14) AND NOT {few_digits('d')}) AS ds FROM code_values)
    SELECT {K}, coalesce(list_filter(ds, lambda d: {gtin_sql('d')})[1], list_filter(ds, lambda d: length(d) = 14)[1]) AS barcode FROM runs""")
def extract_barcode(t):
    return t.code_values.select(*KEY, x.extract_barcode(F.concat(F.lit("n "), F.col("value"))).alias("barcode"))


LET = "A-Za-zА-Яа-яЁё"
PRODUCT = str(list(x.PRODUCT_WORDS))
SERVICE = "|".join(x.SERVICE_WORDS)
HINT = f"""
    lines AS (SELECT {K}, unnest(string_split(raw_text, chr(10))) AS raw, generate_subscripts(string_split(raw_text, chr(10)), 1) AS pos FROM tag_text),
    trimmed AS (SELECT {K}, pos, regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '^[ |\\[\\]{{}}()]+|[ |\\[\\]{{}}()]+$', '', 'g') AS line FROM lines),
    low AS (SELECT *, translate(lower(line), 'ol|', '011') AS lower_digits FROM trimmed WHERE length(line) >= 4 AND regexp_matches(line, '[{LET}]')),
    kept AS (SELECT {K}, pos, trim(regexp_replace(regexp_replace(line, '[^0-9{LET} .,%/()-]+', ' ', 'g'), ' +', ' ', 'g')) AS line FROM low
             WHERE NOT regexp_matches(lower(line), '{SERVICE}')
               AND NOT regexp_matches(lower_digits, '[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{2,4}}') AND NOT regexp_matches(lower_digits, '[0-9]{{1,2}}\\s*%')
               AND length(regexp_replace(lower_digits, '[^0-9]', '', 'g')) < 8),
    words AS (SELECT *, regexp_extract_all(line, '[{LET}]{{3,}}') AS ws, len(list_filter({PRODUCT}, lambda p: contains(lower(line), p))) AS pw FROM kept),
    scored AS (SELECT {K}, pos, line, length(regexp_replace(line, '[^{LET}]', '', 'g')) + 35 * pw + 8 * len(list_filter(ws, lambda w: length(w) >= 4))
                      - (CASE WHEN length(regexp_replace(line, '[^0-9]', '', 'g')) >= 6 THEN 30 ELSE 0 END) AS score FROM words
               WHERE length(line) >= 4 AND length(regexp_replace(line, '[^{LET}]', '', 'g')) >= 3
                 AND NOT (len(ws) >= 4 AND len(list_filter(ws, lambda w: length(w) <= 3)) / greatest(len(ws), 1) > 0.65)
                 AND NOT (len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Za-z]+$'))) >= 4 AND pw = 0)),
    firsts AS (SELECT {K}, line, max(score) AS score, min(pos) AS pos FROM scored GROUP BY {K}, line),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY score DESC, pos) AS rk FROM firsts),
    hint AS (SELECT {K}, left(string_agg(line, ' ' ORDER BY rk), 240) AS product_name FROM ranked WHERE rk <= 3 GROUP BY {K})"""


@query("product_hint", "tag_text", f"""
    WITH {HINT} SELECT t.l_orderkey, t.l_linenumber, t.l_suppkey, t.l_partkey, h.product_name FROM tag_text t LEFT JOIN hint h USING ({K})""")
def product_hint(t):
    return t.tag_text.select(*KEY, x.product_hint(F.col("raw_text")).alias("product_name"))


ALIASES = ", ".join(f"('{k}', '{f}')" for k, f in x.PAYLOAD_FIELDS.items())
PAYLOAD = f"""
    decoded AS (SELECT {K}, payload, replace(url_decode(replace(payload, '+', ' ')), '+', ' ') AS d FROM payloads),
    query_parts AS (SELECT {K}, 0 AS kind, unnest(qs) AS part, generate_subscripts(qs, 1) AS pos
                    FROM (SELECT *, string_split(regexp_extract(regexp_replace(d, '#.*$', ''), '^[^?]*[?](.*)$', 1), '&') AS qs FROM decoded) q),
    chunk_parts AS (SELECT {K}, 1 AS kind, unnest(cs) AS part, generate_subscripts(cs, 1) AS pos FROM (SELECT *, regexp_split_to_array(d, '[;&|,\\n\\r]+') AS cs FROM decoded) c),
    parts AS (SELECT * FROM query_parts WHERE regexp_matches(part, '^[^=]*=.+$') UNION ALL SELECT * FROM chunk_parts WHERE regexp_matches(part, '[=:]')),
    cut AS (SELECT {K}, kind, pos, CASE WHEN contains(part, '=') THEN regexp_extract(part, '^([^=]*)=', 1) ELSE regexp_extract(part, '^([^:]*):', 1) END AS k,
                   CASE WHEN contains(part, '=') THEN regexp_extract(part, '^[^=]*=(.*)$', 1) ELSE regexp_extract(part, '^[^:]*:(.*)$', 1) END AS v FROM parts),
    kv AS (SELECT {K}, kind, pos, CASE kind WHEN 0 THEN k ELSE trim(trim(k), '{{}}[]"''') END AS k, CASE kind WHEN 0 THEN v ELSE trim(trim(v), '{{}}[]"''') END AS v FROM cut),
    final AS (SELECT {K}, k, min(kind * 1000 + pos) AS first_at, max_by(v, kind * 1000 + pos) AS v FROM kv WHERE k <> '' AND v <> '' GROUP BY {K}, k),
    aliases AS (SELECT * FROM (VALUES {ALIASES}) a(name, field)),
    fields AS (SELECT f.l_orderkey, f.l_linenumber, f.l_suppkey, f.l_partkey, field, max_by(v, first_at) AS value
               FROM final f JOIN aliases ON regexp_replace(lower(trim(k)), '[^a-z0-9_]', '', 'g') = name GROUP BY ALL)"""


@query("parse_code_payload", "payloads", f"WITH {PAYLOAD} SELECT {K}, field, value FROM fields")
def parse_code_payload(t):
    rows = t.payloads.select(*KEY, x.payload_fields(F.col("payload")).alias("entries"))
    names = F.array_distinct(F.transform(F.col("entries"), lambda e: e["field"]))
    rows = rows.select(*KEY, "entries", F.explode(names).alias("field"))
    mine = F.filter(F.col("entries"), lambda e: e["field"] == F.col("field"))
    return rows.select(*KEY, "field", F.element_at(mine, -1)["value"].alias("value"))


def strict(c):
    d = f"regexp_replace(translate({c}, 'OoIl|', '00111'), '[^0-9]', '', 'g')"
    return f"(CASE WHEN length({d}) IN (8, 12, 13, 14) AND len(list_distinct(string_split({d}, ''))) > 2 THEN {d} END)"


@query("apply_code_payload", "payloads", f"""
    WITH {PAYLOAD},
    pivoted AS (SELECT {K}, {', '.join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in ('qr_code_barcode', 'id_sku', 'price1_qr', 'price2_qr', 'action_code_qr', 'wholesale_level_1_count', 'wholesale_level_1_price', 'wholesale_level_2_count'))}
                FROM fields GROUP BY {K}),
    joined AS (SELECT p.*, {strict('p.payload')} AS whole, coalesce(v.qr_code_barcode, p.payload) AS qr, v.id_sku, v.price1_qr, v.price2_qr, v.action_code_qr,
                      v.wholesale_level_1_count, v.wholesale_level_1_price, v.wholesale_level_2_count FROM payloads p LEFT JOIN pivoted v USING ({K}))
    SELECT {K}, coalesce(whole, {strict('qr')}) AS barcode, coalesce(whole, {strict('qr')}, qr) AS qr_code_barcode,
           {', '.join(f"CASE WHEN whole IS NULL THEN {f} END AS {f}" for f in ('id_sku', 'price1_qr', 'price2_qr', 'action_code_qr', 'wholesale_level_1_count', 'wholesale_level_1_price', 'wholesale_level_2_count'))}
    FROM joined""")
def apply_code_payload(t):
    fields = (
        "barcode", "qr_code_barcode", "id_sku", "price1_qr", "price2_qr", "action_code_qr", "wholesale_level_1_count",
        "wholesale_level_1_price", "wholesale_level_2_count",
    )
    rows = t.payloads.select(*KEY, x.code_entries(F.col("payload")).alias("entries"))
    return rows.select(*KEY, *(x.entry_value(F.col("entries"), f)["value"].alias(f) for f in fields))


NAME = "trim(regexp_replace(lower({0}), '[^0-9a-zа-я]+', ' ', 'g'))"
TOKENS = "list_filter(list_distinct(regexp_extract_all({0}, '[0-9a-zа-я]{{3,}}')), lambda w: NOT regexp_matches(w, '^([0-9]+|[a-z]{{3}}|with|from)$'))"
TRIGRAMS = "list_distinct(list_filter(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substring({0}, i, 3)), lambda g: length(g) = 3))"


@query("normalize_name", "names", f"SELECT {K}, {NAME.format('product_name')} AS name FROM names")
def normalize_name(t):
    return t.names.select(*KEY, x.normalize_name(F.col("product_name")).alias("name"))


@query("name_tokens", "names", f"""
    SELECT {K}, array_to_string(list_sort({TOKENS.format('n')}), ' ') AS tokens, array_to_string(list_sort({TRIGRAMS.format("replace(n, ' ', '')")}), ' ') AS trigrams
    FROM (SELECT *, {NAME.format('product_name')} AS n FROM names) q""")
def name_tokens(t):
    name = F.col("product_name")
    return t.names.select(
        *KEY, F.array_join(F.array_sort(x.name_tokens(name)), " ").alias("tokens"),
        F.array_join(F.array_sort(x.name_trigrams(name)), " ").alias("trigrams"),
    )


def jac(a, b):
    inter = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0E0 ELSE CAST({inter} AS DOUBLE) / (len({a}) + len({b}) - {inter}) END)"


@query("token_overlap", "names part", f"""
    WITH q AS (SELECT {K}, {NAME.format('product_name')} AS a, {NAME.format("concat(p_name, ' ', p_brand, ' ', p_type)")} AS b FROM names JOIN part ON l_partkey = p_partkey),
         s AS (SELECT {K}, {TOKENS.format('a')} AS ta, {TOKENS.format('b')} AS tb, {TRIGRAMS.format("replace(a, ' ', '')")} AS ga, {TRIGRAMS.format("replace(b, ' ', '')")} AS gb FROM q)
    SELECT {K}, {jac('ta', 'tb')} AS token_overlap, {jac('ga', 'gb')} AS trigram_similarity FROM s""")
def token_overlap(t):
    rows = t.names.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    ref = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    rows = rows.select(
        *KEY, x.name_tokens(F.col("product_name")).alias("ta"), x.name_tokens(ref).alias("tb"),
        x.name_trigrams(F.col("product_name")).alias("ga"), x.name_trigrams(ref).alias("gb"),
    )
    return rows.select(
        *KEY, x.jaccard(F.col("ta"), F.col("tb")).alias("token_overlap"), x.jaccard(F.col("ga"), F.col("gb")).alias("trigram_similarity")
    )


@query("looks_like_garbage", "names", f"""
    SELECT {K}, len(ws) = 0 OR (len(ws) >= 4 AND len(list_filter(ws, lambda w: length(w) <= 3)) / greatest(len(ws), 1) > 0.65)
           OR len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Za-z]+$'))) >= 4 AS garbage
    FROM (SELECT *, regexp_extract_all(product_name, '[{LET}]{{2,}}') AS ws FROM names) q""")
def looks_like_garbage(t):
    return t.names.select(*KEY, x.looks_like_garbage(F.col("product_name")).alias("garbage"))
