"""URL filters: host-suffix and path-prefix expressions, equi-joined with rules on short digest prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgrid.llm.common import lower_ascii

_SHORT = 8  # hexadecimal digits, 4 bytes


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + F.lit(3), F.length(url)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + F.lit(1), F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(raw), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, prefix: Column) -> Column:
    # Neither part can hold '#', so the pair is one string without ambiguity.
    return F.sha2(F.concat(host, F.lit("#"), prefix).cast("binary"), 256)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the rule that decides, else null) and ``verdict``.

    ``rules`` has ``action`` (allow or block), ``host`` and ``path``. A rule fits its host and all subdomains where the
    page's path starts with the rule's path. The rule with most characters decides; among equals the one with the longer
    host, then block before allow. Pages without a fitting rule get ``default``, and so do null URLs, URLs without ``://``
    and all pages if there are no rules. Rules with a null part are ignored. Rows are neither lost nor multiplied: each
    repeated row gets its verdict. A column of ``pages`` named like a new one is replaced.

    A rule is indexed by its host and its path up to the last slash, so a page only needs the expressions of its host's
    suffixes and of its path's prefixes that end with a slash (no longer than any rule has). Expressions meet rules on the
    first 4 bytes of their SHA-256; the whole digest and the rest of the rule's path are compared afterwards. All is done once
    for each distinct host and path; a site that holds a third of the pages is a skewed join side, which Spark splits.
    """
    rules = rules.select("action", F.col("host").alias("_rh"), F.col("path").alias("_rp")).dropna().distinct()
    indexed = rules.select(
        "*",
        F.regexp_extract("_rp", r"^(?s:.*)/", 0).alias("_key"),
        (_count(F.col("_rh"), ".") + 1).alias("_labels"),
    ).withColumn("_depth", _count(F.col("_key"), "/"))
    longest = indexed.agg(F.max("_labels"), F.max("_depth")).first()
    labels_max, depth_max = longest[0] or 0, longest[1] or 0
    indexed = indexed.withColumn("_digest", _digest(F.col("_rh"), F.col("_key")))
    indexed = indexed.select("action", "_rh", "_rp", "_digest", F.substring("_digest", 1, _SHORT).alias("_short"))

    host, path = host_and_path(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    sites = pages.select("host", "path").distinct()
    labels, steps = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(
        F.slice(F.sequence(F.lit(1), F.lit(max(labels_max, 1))), F.lit(1), F.least(F.size(labels), F.lit(labels_max))),
        lambda i: F.array_join(F.slice(labels, -i, i), "."),
    )
    prefixes = F.transform(
        F.slice(F.sequence(F.lit(0), F.lit(depth_max)), F.lit(1), F.least(F.size(steps), F.lit(depth_max + 1))),
        lambda i: F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.when(i > 0, F.lit("/")).otherwise(F.lit(""))),
    )
    expressions = (
        sites.withColumn("_suffix", F.explode(suffixes)).withColumn("_prefix", F.explode(prefixes))
        .withColumn("_full", _digest(F.col("_suffix"), F.col("_prefix"))).drop("_prefix")
        .withColumn("_short", F.substring("_full", 1, _SHORT))
    )
    fitting = expressions.join(indexed, "_short").where(
        (F.col("_full") == F.col("_digest")) & (F.col("_suffix") == F.col("_rh")) & F.startswith(F.col("path"), F.col("_rp"))
    )
    rule = F.concat("_rh", "_rp")
    decided = fitting.groupBy("host", "path").agg(
        F.max(F.struct(
            F.length(rule).alias("size"), F.length("_rh").alias("host_size"), F.col("action").alias("verdict"), rule.alias("rule")
        )).alias("_best")
    ).select("host", "path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))
    return pages.join(decided, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
