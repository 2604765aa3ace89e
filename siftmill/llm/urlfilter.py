"""URL verdicts: a blocked Bloom filter of listed canonical prefixes before an exact hash join.

A listed rule is a host and a path; it fits every URL of that host or a subdomain whose path starts
with the rule's. The canonical key of a rule is host + path. A URL's candidate keys are the host
suffixes with as many labels as some rule has, each with the path prefixes as long as that rule's:
the list's different shapes (labels, path length) stand in the plan as one array, however many rules.
Candidates that the Bloom filter passes go to a hash join with the list, which removes the false
positives; the longest key wins (then the longer host; of equal keys with both actions, allow).
A URL that no rule fits gets the method's own verdict, ``default``.

The Bloom filter's size is bounded (see ``bloom``): beyond it more false positives reach the join,
and the result is the same. Whether the list is broadcast is left to
Spark's own size check. Column expressions only.

Defined cases: a null URL or one without "://" has an empty host and path and fits no rule; a URL of any
length is taken whole; repeated rows each keep their row; repeated rules are one; an empty list of rules
leaves every URL to ``default``; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm import bloom

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The listed rules (host, path, action).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The URL's host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The candidate keys of a URL for the (labels, path length) shapes that the list has."""
    listed = F.from_json(F.lit(json.dumps([{"labels": n, "path": m} for n, m in shapes])), "array<struct<labels int, path int>>")
    labels = F.split(host, r"\.")
    fitting = F.filter(listed, lambda s: (s["path"] <= F.length(path)) & (s["labels"] <= F.size(labels)))
    keys = F.transform(fitting, lambda s: F.concat(F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), "."), F.substr(path, F.lit(1), s["path"])))
    return F.array_distinct(keys)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``; rules has host, path and action."""
    rules = rules.select(F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), F.size(F.split("host", r"\.")).alias("labels"), "action")
    shapes = [(r["labels"], r["path_length"]) for r in rules.select("labels", "path_length").distinct().orderBy("labels", "path_length").collect()]
    possible = bloom.test(bloom.build(rules, "rule"))
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumn("hits", F.filter(candidates(F.col("host"), F.col("path"), shapes), possible))
    missed = seen.filter(F.size("hits") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hit = seen.filter(F.size("hits") > 0)
    rank = F.struct(F.length("rule"), "host_length", F.col("action") == "allow", "rule", "action")
    ruled = (
        hit.select("host", "path", "hits").distinct()
        .select("host", "path", F.explode("hits").alias("rule"))
        .join(rules, "rule")
        .groupBy("host", "path").agg(F.max(rank).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    )
    found = hit.join(ruled, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
    return found.unionByName(missed)


SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rhost, rpath, action) AS (VALUES {", ".join(str(x) for x in RULES)}),
fit AS (SELECT h.host, h.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
               arg_max(action, length(rhost || rpath)) AS action
        FROM (SELECT DISTINCT host, path FROM h) h
        JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2)
SELECT h.page_id, h.host, h.path, fit.rule, coalesce(fit.action, 'allow') AS verdict
FROM h LEFT JOIN fit ON h.host = fit.host AND h.path = fit.path
"""
