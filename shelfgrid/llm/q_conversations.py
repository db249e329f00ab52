"""op12: the trie of rebuilt conversations."""

from shelfgrid.llm.common import table
from shelfgrid.llm.prefix_trie import prefix_trie
from shelfgrid.llm.registry import query

_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                          lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]),
                                                lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

_SQL = f"""
WITH own AS (
  SELECT conv_id, {_CRC} % 9 AS h,
         list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), built AS (
  SELECT o.conv_id, list_concat(coalesce(b.w[1:o.h], []), o.w[o.h + 1:]) AS w
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), members AS (
  SELECT conv_id, CAST(d AS BIGINT) AS d, w[1:d] AS p, len(w) = d AS ends FROM built, unnest(range(0, len(w) + 1)) AS u(d)
), nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].t) END AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY p, d
), kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (p, d)),
under AS (
  SELECT p[1:a] AS p, CAST(a AS BIGINT) AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM counted, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL
)
SELECT c.conv_id, c.d AS depth, up.conv_id AS parent_conv_id, c.n_convs, c.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN under u USING (p, d) LEFT JOIN nodes up ON c.d > 0 AND up.d = c.d - 1 AND up.p = c.p[1:c.d - 1]
"""


@query("op12_prefix_trie", _SQL)
def conversation_trie(spark, directory):
    return prefix_trie(table(spark, directory, "conversations"))
