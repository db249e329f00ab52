"""Normalisers of single values and the final-row fusion."""

from pyspark.sql import functions as F

from shelfgrid.functions import values as v
from shelfgrid.queries.registry import query

KEY = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
K = ", ".join(KEY)

UNKNOWN_SQL = "('', '-', '—', '–', 'none', 'null', 'nan', 'нет данных', 'не распознано')"


def known(c):
    return f"(CASE WHEN {c} IS NULL OR lower(trim({c})) IN {UNKNOWN_SQL} THEN NULL ELSE trim({c}) END)"


def squeeze(c):
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def price(c):
    kept = f"regexp_replace(replace({known(c)}, ',', '.'), '[^0-9.]', '', 'g')"
    p = f"TRY_CAST(regexp_extract({kept}, '[0-9]{{1,5}}(\\.[0-9]{{1,2}})?', 0) AS DOUBLE)"
    return f"(CASE WHEN {p} > 0 AND {p} <= 99999 THEN printf('%.2f', {p}) END)"


def discount(c):
    n = f"TRY_CAST(regexp_extract({known(c)}, '-?\\s*([0-9]{{1,2}})\\s*%', 1) AS INT)"
    return f"(CASE WHEN {n} BETWEEN 1 AND 90 THEN concat('-', {n}, '%') END)"


def barcode(c, internal=True):
    d = f"regexp_replace(translate({known(c)}, 'OoIl|', '00111'), '[^0-9]', '', 'g')"
    size = f"length({d}) BETWEEN 6 AND 14" if internal else f"length({d}) IN (8, 12, 13, 14)"
    return f"(CASE WHEN {size} AND len(list_distinct(string_split({d}, ''))) > 1 THEN {d} END)"


def id_sku(c):
    d = f"regexp_replace({known(c)}, '[^0-9]', '', 'g')"
    return f"(CASE WHEN length({d}) BETWEEN 6 AND 14 AND len(list_distinct(string_split({d}, ''))) > 1 THEN {d} END)"


def datetime(c):
    t = f"replace({squeeze(known(c))}, ',', '.')"

    def read(n, century):
        p = f"'([0-9]{{2}})[.]([0-9]{{2}})[.]([0-9]{{{n}}})\\s+([0-9]{{1,2}})[:.]([0-9]{{2}})'"
        g = [f"regexp_extract({t}, {p}, {i})" for i in range(1, 6)]
        text = f"concat({century}{g[2]}, '-', {g[1]}, '-', {g[0]}, ' ', lpad({g[3]}, 2, '0'), ':', {g[4]}, ':00')"
        return f"strftime(TRY_CAST({text} AS TIMESTAMP), '%d.%m.%Y %H:%M')"

    return f"coalesce({read(4, '')}, {read(2, chr(39) + '20' + chr(39) + ', ')})"


def coordinate(c):
    n = f"TRY_CAST(replace({known(c)}, ',', '.') AS DOUBLE)"
    return f"replace(printf('%.1f', {n}), '.', ',')"


def timestamp(c):
    n = f"TRY_CAST(replace({known(c)}, ',', '.') AS DOUBLE)"
    return (
        f"(CASE WHEN {n} IS NULL THEN NULL WHEN abs({n} - round_even({n}, 0)) < 1e-6 THEN CAST(CAST({n} AS BIGINT) AS STRING)"
        f" ELSE rtrim(rtrim(printf('%.2f', {n}), '0'), '.') END)"
    )


def text(c, n):
    t = f"left({squeeze(known(c))}, {n})"
    return f"(CASE WHEN {t} = '' THEN NULL ELSE {t} END)"


def tag(t):
    return t.tags_raw


@query("normalize_unknown", "tags_raw", f"""
    SELECT {K}, {known('product_name')} IS NULL AS is_unknown, {known('product_name')} AS product_name FROM tags_raw""")
def normalize_unknown(t):
    name = F.col("product_name")
    return tag(t).select(*KEY, v.is_unknown(name).alias("is_unknown"), v.normalize_unknown(name).alias("product_name"))


@query("normalize_text", "tags_raw", f"SELECT {K}, {text('product_name', 11)} AS product_name FROM tags_raw")
def normalize_text(t):
    return tag(t).select(*KEY, v.normalize_text(F.col("product_name"), 11).alias("product_name"))


@query("normalize_price", "tags_raw", f"""
    SELECT {K}, {price('price_default')} AS price_default, {price('price_card')} AS price_card FROM tags_raw""")
def normalize_price(t):
    return tag(t).select(*KEY, *(v.normalize_price(F.col(c)).alias(c) for c in ("price_default", "price_card")))


@query("normalize_discount", "tags_raw", f"SELECT {K}, {discount('discount_amount')} AS discount_amount FROM tags_raw")
def normalize_discount(t):
    return tag(t).select(*KEY, v.normalize_discount(F.col("discount_amount")).alias("discount_amount"))


@query("normalize_barcode", "tags_raw", f"""
    SELECT {K}, {barcode('barcode')} AS barcode, {barcode('barcode', False)} AS strict_barcode FROM tags_raw""")
def normalize_barcode(t):
    c = F.col("barcode")
    return tag(t).select(
        *KEY, v.normalize_barcode(c).alias("barcode"), v.normalize_barcode(c, allow_internal=False).alias("strict_barcode")
    )


@query("normalize_id_sku", "tags_raw", f"SELECT {K}, {id_sku('code_values')} AS id_sku FROM tags_raw")
def normalize_id_sku(t):
    return tag(t).select(*KEY, v.normalize_id_sku(F.col("code_values")).alias("id_sku"))


@query("normalize_datetime", "tags_raw", f"SELECT {K}, {datetime('print_datetime')} AS print_datetime FROM tags_raw")
def normalize_datetime(t):
    return tag(t).select(*KEY, v.normalize_datetime(F.col("print_datetime")).alias("print_datetime"))


@query("normalize_coordinate", "tags_raw", f"SELECT {K}, {coordinate('x_min')} AS x_min FROM tags_raw")
def normalize_coordinate(t):
    return tag(t).select(*KEY, v.normalize_coordinate(F.col("x_min")).alias("x_min"))


@query("normalize_timestamp", "tags_raw", f"""
    SELECT {K}, {timestamp('x_min')} AS a, {timestamp('price_card')} AS b FROM tags_raw""")
def normalize_timestamp(t):
    return tag(t).select(
        *KEY, v.normalize_timestamp(F.col("x_min")).alias("a"), v.normalize_timestamp(F.col("price_card")).alias("b")
    )


@query("validate_price_pair", "tags_raw", f"""
    SELECT {K}, CASE WHEN d IS NULL OR c IS NULL OR CAST(c AS DOUBLE) <= CAST(d AS DOUBLE) THEN d END AS price_default, c AS price_card
    FROM (SELECT {K}, {price('price_default')} AS d, {price('price_card')} AS c FROM tags_raw) p""")
def validate_price_pair(t):
    default, card = v.validate_price_pair(F.col("price_default"), F.col("price_card"))
    return tag(t).select(*KEY, default.alias("price_default"), card.alias("price_card"))


@query("normalize_value", "tags_raw", f"""
    SELECT {K}, CASE WHEN trim(product_name) = '' THEN NULL WHEN lower(trim(product_name)) IN ('нет', 'no', 'none', 'null', 'nan') THEN 'нет'
           WHEN trim(product_name) IN ('-', '—', '–') THEN NULL ELSE trim(product_name) END AS product_name FROM tags_raw""")
def normalize_value(t):
    return tag(t).select(*KEY, v.normalize_value(F.col("product_name")).alias("product_name"))


@query("first_known", "tags_raw", f"""
    SELECT {K}, coalesce(CASE WHEN lower(trim(product_name)) IN ('', '-', '—', '–', 'none', 'null', 'nan') THEN NULL ELSE trim(product_name) END,
                         CASE WHEN lower(trim(barcode)) IN ('', '-', '—', '–', 'none', 'null', 'nan') THEN NULL ELSE trim(barcode) END) AS value FROM tags_raw""")
def first_known(t):
    return tag(t).select(*KEY, v.first_known(F.col("product_name"), F.col("barcode")).alias("value"))


@query("parse_json_list", "tags_raw", f"""
    SELECT {K}, array_to_string(CAST(CAST(code_values AS JSON) AS STRING[]), '|') AS items FROM tags_raw""")
def parse_json_list(t):
    return tag(t).select(*KEY, F.array_join(v.parse_json_list(F.col("code_values")), "|").alias("items"))


@query("file_stem", "pages", """
    SELECT page_id, CASE WHEN regexp_matches(n, '^[^.].*\\.[^.]*$') AND NOT regexp_matches(n, '\\.$') THEN regexp_replace(n, '\\.[^.]*$', '') ELSE n END AS stem,
           coalesce(nullif(trim(regexp_replace(CASE WHEN regexp_matches(n, '^[^.].*\\.[^.]*$') AND NOT regexp_matches(n, '\\.$')
                    THEN regexp_replace(n, '\\.[^.]*$', '') ELSE n END, '[^0-9A-Za-zА-Яа-яЁё_-]+', '_', 'g'), '_'), ''), 'video') AS safe
    FROM (SELECT page_id, regexp_extract(trim(url), '([^/]*)/*$', 1) AS n FROM pages) p""")
def file_stem(t):
    url = F.col("url")
    return t.pages.select("page_id", v.file_stem(v.strip(url)).alias("stem"), v.safe_filename(url).alias("safe"))


@query("parse_number", "tags_raw", f"""
    SELECT {K}, TRY_CAST(nullif(replace(replace(x_min, ' ', ''), ',', '.'), '') AS DOUBLE) AS number,
           coalesce(TRY_CAST(trim(replace(price_default, ',', '.')) AS DOUBLE), -1.0E0) AS safe,
           coalesce(CAST(round_even(TRY_CAST(trim(replace(x_min, ',', '.')) AS DOUBLE), 0) AS INT), 0) AS whole FROM tags_raw""")
def parse_number(t):
    return tag(t).select(
        *KEY, v.parse_number(F.col("x_min")).alias("number"), v.safe_float(F.col("price_default"), -1.0).alias("safe"),
        v.safe_int(F.col("x_min")).alias("whole"),
    )


@query("timestamp_to_frame", "labels_gt videos", """
    SELECT l.video_id, l.label_id, greatest(0, least(CAST(round_even(frame_timestamp / 1000.0E0 * (CASE WHEN fps <= 0 THEN 25.0E0 ELSE fps END), 0) AS INT), frame_count - 1)) AS frame
    FROM labels_gt l JOIN videos v ON l.video_id = v.video_id""")
def timestamp_to_frame(t):
    fps = F.when(F.col("fps") <= 0, 25.0).otherwise(F.col("fps"))
    frame = v.timestamp_to_frame(F.col("frame_timestamp"), fps, F.col("frame_count"))
    return t.labels_gt.join(t.videos, "video_id").select("video_id", "label_id", frame.alias("frame"))


@query("flatten_whitespace", "tags_raw", f"SELECT {K}, {squeeze('product_name')} AS product_name, {squeeze('discount_amount')} AS discount_amount FROM tags_raw")
def flatten_whitespace(t):
    return v.flatten_whitespace(tag(t).select(*KEY, "product_name", "discount_amount"))


CODE = "(CASE WHEN length(c) BETWEEN 6 AND 14 AND len(list_distinct(string_split(c, ''))) > 1 THEN c END)"


@query("fuse_final_rows", "tags_raw tag_color_ratios", f"""
    WITH src AS (SELECT *, {barcode("coalesce(regexp_extract(code_values, '\"([^\"]*)\"', 1), '')")} AS code FROM tags_raw),
         norm AS (SELECT {K}, {text('product_name', 500)} AS product_name, {price('price_default')} AS d, {price('price_card')} AS c,
                         coalesce(code, {barcode('barcode')}) AS barcode, code AS qr_code_barcode, {discount('discount_amount')} AS discount_amount,
                         {datetime('print_datetime')} AS print_datetime, {coordinate('x_min')} AS x_min,
                         {timestamp("CAST(l_orderkey * 40 AS STRING)")} AS frame_timestamp FROM src)
    SELECT {K}, 'shelf' AS filename, coalesce(product_name, '-') AS product_name,
           coalesce(CASE WHEN d IS NULL OR c IS NULL OR CAST(c AS DOUBLE) <= CAST(d AS DOUBLE) THEN d END, '-') AS price_default, coalesce(c, '-') AS price_card,
           '-' AS price_discount, coalesce(barcode, '-') AS barcode, coalesce(discount_amount, '-') AS discount_amount, '-' AS id_sku,
           coalesce(print_datetime, '-') AS print_datetime, '-' AS code, '-' AS additional_info, '-' AS color, '-' AS special_symbols,
           coalesce(frame_timestamp, '-') AS frame_timestamp, coalesce(x_min, '-') AS x_min, '-' AS y_min, '-' AS x_max, '-' AS y_max,
           coalesce(qr_code_barcode, '-') AS qr_code_barcode, '-' AS price1_qr, '-' AS price2_qr, '-' AS price3_qr, '-' AS price4_qr,
           '-' AS wholesale_level_1_count, '-' AS wholesale_level_1_price, '-' AS wholesale_level_2_count, '-' AS wholesale_level_2_price,
           '-' AS action_price_qr, '-' AS action_code_qr
    FROM norm""")
def fuse_final_rows(t):
    from shelfgrid.plans.fusion import fuse_final_rows as fuse

    rows = tag(t).withColumn("timestamp_ms", F.col("l_orderkey") * 40)
    return fuse(rows, filename="in/shelf.mp4", keep=KEY, for_sink=True)
