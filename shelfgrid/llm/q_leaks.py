"""op9: benchmark windows in every document."""

from shelfgrid.llm.common import table
from shelfgrid.llm.decontaminate import find_leaks
from shelfgrid.llm.registry import query

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m,
         array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS t
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(p) WHERE len(w) > 0
), dw AS (
  SELECT r, m, p, array_to_string(w[p:p + m - 1], ' ') AS t
  FROM d CROSS JOIN (SELECT DISTINCT m FROM bw) AS ms, unnest(range(1, len(w) - m + 2)) AS u(p)
), hits AS (SELECT r, m, p, item_id FROM dw JOIN bw USING (m, t)),
pos AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, m, p FROM hits) h, unnest(range(p, p + m)) AS u(q) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN items USING (r)
"""


@query("op9_decontamination", _SQL)
def decontamination(spark, directory):
    docs = table(spark, directory, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, directory, "benchmark"))
