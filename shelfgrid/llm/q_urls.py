"""op2: the verdict of every page's url."""

from shelfgrid.llm.common import table
from shelfgrid.llm.registry import query
from shelfgrid.llm.url_filter import filter_urls

RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)

_SQL = f"""
WITH rules(action, rhost, rpath) AS (VALUES {', '.join(str(r) for r in RULES)}),
rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*', 0, 's') AS raw, r FROM rest
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(raw) + 1), '^[^?#]*', 0, 's') AS path, row_number() OVER () AS n
  FROM parts
), fits AS (
  SELECT n, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action DESC) AS best
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM fits WHERE best = 1) f ON split.n = f.n
"""


@query("op2_url_filter", _SQL)
def url_filter(spark, directory):
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    pages = table(spark, directory, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
