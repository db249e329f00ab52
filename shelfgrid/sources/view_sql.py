"""SQL of the stand-in input views, runnable unchanged by any ANSI engine over the base tables."""

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "det": """
        SELECT CAST(l_suppkey AS STRING) AS video_id,
               CAST((l_orderkey % 97) * 12 AS INT) AS frame_index,
               CAST((l_orderkey % 97) * 12 AS DOUBLE) * 40.0 AS timestamp_ms,
               CAST(row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 97
                    ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS INT) AS candidate_index,
               CASE CAST((l_orderkey + l_linenumber) % 5 AS INT) WHEN 0 THEN 'rectangular_region' WHEN 1 THEN 'text_like_region'
                    WHEN 2 THEN 'promo_color_layout' WHEN 3 THEN 'mixed' ELSE 'qr_anchor' END AS source,
               CAST(30 + (l_orderkey * 7 + l_linenumber * 13) % 70 AS DOUBLE) / 100.0 AS score,
               CAST((l_partkey % 4) * 900 + l_orderkey % 41 AS INT) AS x_min,
               CAST((l_partkey % 3) * 700 + l_orderkey % 37 AS INT) AS y_min,
               CAST((l_partkey % 4) * 900 + l_orderkey % 41 + 90 + l_partkey % 160 AS INT) AS x_max,
               CAST((l_partkey % 3) * 700 + l_orderkey % 37 + 70 + l_orderkey % 90 AS INT) AS y_max,
               CAST(l_partkey % 90 AS DOUBLE) / 100.0 AS text_density,
               CAST(25 + l_orderkey % 70 AS DOUBLE) / 100.0 AS rectangularity
        FROM lineitem
    """,
    "codes": """
        SELECT video_id, frame_index, candidate_index AS code_index,
               CASE WHEN candidate_index % 2 = 0 THEN 'qr' ELSE 'barcode' END AS code_type,
               concat('46', lpad(CAST(x_min * 100003 + y_min * 7919 AS STRING), 11, '0')) AS value,
               score AS confidence, x_min + 20 AS x_min, y_min + 15 AS y_min, x_min + 60 AS x_max, y_min + 50 AS y_max
        FROM det WHERE source IN ('mixed', 'qr_anchor')
    """,
    "labels_gt": """
        SELECT video_id, frame_index * 1000 + candidate_index AS label_id, timestamp_ms + 500.0 AS frame_timestamp,
               x_min + 6 AS x_min, y_min - 4 AS y_min, x_max + 6 AS x_max, y_max - 4 AS y_max
        FROM det WHERE candidate_index % 3 = 0
    """,
    "videos": """
        SELECT CAST(s_suppkey AS STRING) AS video_id, CASE WHEN s_suppkey % 4 = 0 THEN 0.0E0 ELSE 24.0E0 + s_suppkey % 7 END AS fps,
               CAST(300 + (s_suppkey * 37) % 900 AS INT) AS frame_count, 3840 AS width, 2160 AS height
        FROM supplier
    """,
    "catalog_src": """
        SELECT p_partkey AS entry_id, concat(p_brand, ' ', p_name, ' ', lower(p_type), ' ', CAST(p_size AS STRING), 'kg') AS fullname,
               CAST(4600000000000 + p_partkey * 7919 AS STRING) AS code
        FROM part
    """,
    "names": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
               CASE CAST(l_orderkey % 4 AS INT) WHEN 0 THEN p_name
                    WHEN 1 THEN concat(substring(p_name, 1, 3), substring(p_name, 5), ' ', p_brand)
                    WHEN 2 THEN concat(lower(p_type), ' ', replace(p_name, 'e', 'c'))
                    ELSE 'TH US al fe hte' END AS product_name
        FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
    "tag_text": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
               concat(p_name, ' ', p_brand, chr(10), 'price ',
                      CAST(10 + l_partkey % 900 AS STRING), CASE WHEN l_orderkey % 2 = 0 THEN '.' ELSE ',' END,
                      lpad(CAST(l_orderkey % 100 AS STRING), 2, '0'), ' ',
                      CAST(10 + l_partkey % 600 AS STRING), ' ', lpad(CAST(l_suppkey % 100 AS STRING), 2, '0'), chr(10),
                      '-', CAST(1 + l_orderkey % 95 AS STRING), '% ', chr(10),
                      lpad(CAST(1 + l_orderkey % 31 AS STRING), 2, '0'), '.', lpad(CAST(1 + l_partkey % 13 AS STRING), 2, '0'),
                      '.2025 ', CAST(l_orderkey % 25 AS STRING), ':', lpad(CAST(l_partkey % 60 AS STRING), 2, '0'), chr(10),
                      CAST(100000 + l_orderkey * 31 % 900000 AS STRING)) AS raw_text
        FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
    "ocr_words": """
        SELECT l_orderkey AS tag_id, CAST(l_linenumber AS INT) AS word_seq,
               CASE CAST(l_linenumber % 3 AS INT) WHEN 1 THEN CAST(10 + l_partkey % 990 AS STRING)
                    WHEN 2 THEN lpad(CAST(l_partkey % 100 AS STRING), 2, '0') ELSE CAST(1000 + l_partkey * 17 % 90000 AS STRING) END AS text,
               CAST(l_partkey % 100 AS DOUBLE) AS conf,
               CAST(20 + l_linenumber * 60 AS INT) AS left_px, CAST(30 + l_partkey % 25 AS INT) AS top_px,
               CAST(40 + l_partkey % 20 AS INT) AS width, CAST(CASE WHEN l_linenumber % 3 = 1 THEN 44 ELSE 24 END AS INT) AS height
        FROM lineitem
    """,
    "tags_raw": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
               CASE WHEN l_partkey % 11 = 0 THEN ' nan ' ELSE concat(' ', p_name, '   ', p_brand) END AS product_name,
               concat(CAST(10 + l_partkey % 900 AS STRING), ',', lpad(CAST(l_orderkey % 100 AS STRING), 2, '0'), ' rub') AS price_default,
               concat(CAST(10 + l_suppkey % 700 AS STRING), '.', lpad(CAST(l_partkey % 100 AS STRING), 2, '0')) AS price_card,
               concat('- ', CAST(l_orderkey % 99 AS STRING), ' %') AS discount_amount,
               concat('46O', CAST(1000000 + l_partkey * 7919 AS STRING)) AS barcode,
               concat('01.', lpad(CAST(1 + l_partkey % 13 AS STRING), 2, '0'), '.25 9:', lpad(CAST(l_orderkey % 60 AS STRING), 2, '0')) AS print_datetime,
               concat(CAST(l_orderkey % 3800 AS STRING), ',5') AS x_min,
               concat('["46', CAST(10000000000 + l_orderkey AS STRING), '"]') AS code_values
        FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
    "regions": """
        SELECT video_id, frame_index, candidate_index AS region_index,
               CASE source WHEN 'rectangular_region' THEN 'rectangle' WHEN 'text_like_region' THEN 'text'
                    WHEN 'promo_color_layout' THEN 'color' ELSE 'white' END AS kind,
               x_min, y_min, x_max, y_max, rectangularity, text_density AS text_fill,
               CAST(x_min % 15 AS DOUBLE) / 100.0 AS edge_density, CAST(y_min % 80 AS DOUBLE) / 100.0 AS white_ratio,
               CAST(x_max % 20 AS DOUBLE) / 100.0 AS red_ratio, CAST(y_max % 20 AS DOUBLE) / 100.0 AS yellow_ratio
        FROM det
    """,
    "tag_color_ratios": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
               CAST(l_orderkey % 60 AS DOUBLE) / 100.0 AS white_ratio, CAST(l_partkey % 16 AS DOUBLE) / 100.0 AS yellow_ratio,
               CAST(l_suppkey % 16 AS DOUBLE) / 100.0 AS red_ratio, CAST(l_orderkey % 14 AS DOUBLE) / 100.0 AS bottom_yellow_ratio,
               CAST(l_partkey % 13 AS DOUBLE) / 100.0 AS bottom_red_ratio
        FROM lineitem
    """,
    "flow_points": """
        SELECT CAST(l_suppkey AS STRING) AS video_id, CAST(l_orderkey % 8 AS INT) AS pair_index,
               CAST(l_partkey % 41 + l_suppkey % 30 - 35 AS DOUBLE) / 4.0 AS dx,
               CAST(l_orderkey % 37 + l_suppkey % 23 - 30 AS DOUBLE) / 4.0 AS dy
        FROM lineitem
    """,
    "frame_features": """
        SELECT CAST(user_id AS STRING) AS video_id, event_id AS frame_index,
               CAST(event_id % 600 AS DOUBLE) AS sharpness, CAST(event_id % 256 AS DOUBLE) AS brightness,
               CAST(event_id % 90 AS DOUBLE) AS contrast, CAST(event_id % 40 AS DOUBLE) / 100.0 AS glare_ratio,
               CAST(event_id % 30 AS DOUBLE) / 100.0 AS dark_ratio, CAST(event_id % 7 AS DOUBLE) / 100.0 AS price_tag_ratio
        FROM events
    """,
    "frames": """
        SELECT CAST(user_id AS STRING) AS video_id, event_id AS frame_index, {epoch_us} / 1000.0E0 AS timestamp_ms,
               value / 500.0E0 AS quality_score
        FROM events
    """,
}

# Further stand-ins, for inputs that the first group does not cover.
VIEWS |= {
    "crop_codes": """
        SELECT video_id, frame_index, candidate_index AS box_id, 'barcode' AS code_type, value, confidence,
               'reader' AS source, code_x1 AS x_min, code_y1 AS y_min, code_x1 + 30 AS x_max, code_y1 + 24 AS y_max
        FROM (SELECT video_id, frame_index, candidate_index, score AS confidence,
                     concat('46', lpad(CAST(x_min * 100003 + y_min * 7919 AS STRING), 11, '0')) AS value,
                     CAST(x_min % 50 AS INT) AS code_x1, CAST(y_min % 40 AS INT) AS code_y1
              FROM det WHERE candidate_index % 2 = 0) t
    """,
    "code_boxes": """
        SELECT video_id, frame_index,
               CASE CAST(candidate_index % 3 AS INT) WHEN 0 THEN 'full_frame' WHEN 1 THEN 'tile' ELSE 'candidate' END AS region_type,
               CASE WHEN x_min % 2 = 0 THEN 'zxing' ELSE 'opencv' END AS reader,
               CASE WHEN candidate_index % 2 = 0 THEN 'qr' ELSE 'barcode' END AS code_type,
               concat('46', lpad(CAST((x_max % 7) * 100003 AS STRING), 11, '0')) AS value,
               candidate_index AS finding_index, x_min, y_min, x_max, y_max, score AS confidence
        FROM det
    """,
    "code_values": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
               CASE WHEN l_orderkey % 2 = 0 THEN 'qr' ELSE 'barcode' END AS code_type,
               CASE CAST(l_partkey % 6 AS INT)
                    WHEN 0 THEN concat('46', lpad(CAST(l_partkey * 7919 + l_orderkey AS STRING), 11, '0'))
                    WHEN 1 THEN concat('https://q.io/p?sku=', CAST(l_orderkey AS STRING), '&price=', CAST(l_partkey AS STRING))
                    WHEN 2 THEN lpad(CAST(l_orderkey * 31 + l_partkey AS STRING), 8, '0')
                    WHEN 3 THEN concat('tag', CAST(l_orderkey AS STRING))
                    WHEN 4 THEN '11111111' ELSE lpad(CAST(l_orderkey * 977 + l_partkey * 13 AS STRING), 12, '4') END AS value,
               CAST(l_partkey % 900 AS INT) AS x_min, CAST(l_suppkey % 700 AS INT) AS y_min,
               CAST(l_partkey % 900 + 4 + l_orderkey % 300 AS INT) AS x_max, CAST(l_suppkey % 700 + 5 + l_linenumber * 30 AS INT) AS y_max
        FROM lineitem
    """,
    "payloads": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
               CASE CAST(l_orderkey % 5 AS INT)
                    WHEN 0 THEN concat('https://q.io/p?barcode=46', lpad(CAST(l_partkey * 7919 AS STRING), 11, '0'), '&price=', CAST(10 + l_partkey % 900 AS STRING), '.90&x=1')
                    WHEN 1 THEN concat('{"sku":"', CAST(100000 + l_orderkey AS STRING), '";"price2":"', CAST(10 + l_partkey % 500 AS STRING), '.50"}')
                    WHEN 2 THEN concat('wl1=', CAST(2 + l_orderkey % 9 AS STRING), '|wl1price=', CAST(20 + l_partkey % 90 AS STRING), '.00,wl2:3;action%5Fcode=A', CAST(l_suppkey AS STRING))
                    WHEN 3 THEN concat('46', lpad(CAST(l_partkey * 7919 + l_orderkey AS STRING), 11, '0'))
                    ELSE concat('promo ', CAST(l_partkey AS STRING)) END AS payload
        FROM lineitem
    """,
    "ocr_variants": """
        SELECT l_orderkey AS tag_id, CAST(l_linenumber AS INT) AS variant_index,
               CASE CAST(l_linenumber % 3 AS INT) WHEN 1 THEN 'crop' WHEN 2 THEN 'crop_rot90_ccw' ELSE 'crop_rot90_cw' END AS variant,
               CASE CAST(l_partkey % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'abc'
                    ELSE concat(p_name, ' ', p_brand, ' ', CAST(l_partkey * 7919 AS STRING), ' [', p_type, ']_') END AS raw_text,
               CAST(l_partkey % 100 AS DOUBLE) / 100.0 AS confidence, l_suppkey, l_partkey
        FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
    "promo_results": """
        SELECT l_orderkey AS tag_id, CAST(l_linenumber AS INT) AS orientation_index,
               CASE CAST(l_linenumber % 3 AS INT) WHEN 1 THEN 'crop' WHEN 2 THEN 'crop_rot90_ccw' ELSE 'crop_rot90_cw' END AS variant,
               CAST(l_partkey % 101 AS DOUBLE) / 100.0 AS confidence,
               CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat(CAST(10 + l_partkey % 500 AS STRING), '.99') END AS price_card,
               CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat(CAST(20 + l_partkey % 700 AS STRING), '.49') END AS price_default,
               CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat('-', CAST(1 + l_partkey % 95 AS STRING), '%') END AS discount_amount,
               CAST(l_partkey AS INT) AS result_id, CAST(40 + l_partkey % 90 AS INT) AS tag_width, CAST(20 + l_partkey % 60 AS INT) AS tag_height
        FROM lineitem
    """,
    "digit_text": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
               concat(CAST(l_partkey AS STRING), ' ', CAST(l_orderkey AS STRING), ' ', lpad(CAST(l_suppkey % 100 AS STRING), 2, '0'),
                      CASE WHEN l_linenumber % 2 = 0 THEN ' -' ELSE ' ' END, CAST(l_orderkey % 99 AS STRING), '%') AS raw_text
        FROM lineitem
    """,
    "ocr_payloads": """
        SELECT l_orderkey AS tag_id, CAST(l_linenumber AS INT) AS payload_index, l_suppkey, l_partkey,
               concat('{"res":{"rec_texts":["', p_name, '"," ', p_brand, ' ","', p_name, '",""],"rec_scores":[0.',
                      lpad(CAST(l_partkey % 100 AS STRING), 2, '0'), ',0.9,0.', lpad(CAST(l_partkey % 100 AS STRING), 2, '0'),
                      '],"rec_boxes":[[', CAST(l_partkey % 90 AS STRING), ',5,', CAST(l_partkey % 90 + 40 AS STRING), ',25],[[8,30],[90,31],[91,60],[7,59]],[',
                      CAST(l_partkey % 90 AS STRING), ',5,', CAST(l_partkey % 90 + 40 AS STRING), ',25]]}}') AS payload
        FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
    "label_rows": """
        SELECT CAST(l_suppkey AS STRING) AS video_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
               CASE WHEN l_partkey % 50 = 0 THEN 'n/a' ELSE concat(CAST((l_orderkey % 97) * 480 AS STRING), ',5') END AS frame_timestamp,
               concat(CAST((l_partkey % 4) * 900 + l_orderkey % 41 AS STRING), ',5') AS x_min, CAST((l_partkey % 3) * 700 AS STRING) AS y_min,
               CAST((l_partkey % 4) * 900 + l_partkey % 160 AS STRING) AS x_max, CAST((l_partkey % 3) * 700 + l_orderkey % 90 AS STRING) AS y_max
        FROM lineitem
    """,
    "evidence": """
        SELECT video_id, frame_index, candidate_index, source IN ('mixed', 'qr_anchor') AS has_qr,
               candidate_index % 2 = 0 AS has_text, text_density, rectangularity,
               concat('46', CAST(x_min % 5 AS STRING)) AS code_value, CAST(y_min % 3 AS INT) AS hypothesis
        FROM det
    """,
    "candidates": """
        SELECT video_id, frame_index, timestamp_ms, candidate_index, source, score, x_min, y_min, x_max, y_max, text_density, rectangularity,
               source = 'qr_anchor' AS has_qr, source = 'qr_anchor' AND candidate_index % 2 = 1 AS has_barcode,
               source IN ('text_like_region', 'promo_color_layout') OR (source IN ('mixed', 'rectangular_region') AND candidate_index % 2 = 0) AS has_text,
               source IN ('rectangular_region', 'mixed') AND candidate_index % 3 < 2 AS has_rect,
               CAST(x_min % 15 AS DOUBLE) / 100.0E0 AS edge_density,
               CAST((x_max - x_min) * (y_max - y_min) AS DOUBLE) / CASE WHEN candidate_index % 4 = 3 THEN 100000.0E0 ELSE 8294400.0E0 END AS area_ratio
        FROM det
    """,
    "crop_boxes": """
        SELECT video_id, frame_index, region_index, kind, x_min % 900 AS x_min, y_min % 700 AS y_min,
               x_min % 900 + (x_max - x_min) AS x_max, y_min % 700 + (y_max - y_min) AS y_max
        FROM regions WHERE kind IN ('color', 'white')
    """,
}

DEPENDS = {
    "codes": ("det",), "labels_gt": ("det",), "regions": ("det",), "crop_codes": ("det",), "code_boxes": ("det",),
    "evidence": ("det",), "candidates": ("det",), "crop_boxes": ("regions",),
}

EPOCH_US = {"spark": "unix_micros(CAST(ts AS TIMESTAMP))", "duckdb": "epoch_us(ts)"}


def with_views(names, engine: str) -> dict[str, str]:
    """The views and everything they read, dependencies first."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name in BASE_TABLES:
            return
        for parent in DEPENDS.get(name, ()):
            add(parent)
        ordered.setdefault(name, VIEWS[name].replace("{epoch_us}", EPOCH_US[engine]).strip())

    for name in names:
        add(name)
    return ordered
