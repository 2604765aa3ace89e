"""Lookups over a corpus: id lists, feature rows, caches, ordered dedupes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.tokens import strip
from siftmill.sources.writers import not_cached

__all__ = ["chosen", "first_seen", "in_list", "match_rows", "merge_unique", "not_cached"]


def in_list(papers: DataFrame, ids: DataFrame, key: str = "paper_id") -> DataFrame:
    """The papers whose id is listed."""
    return papers.join(ids, key, "left_semi")


def chosen(papers: DataFrame, key: str, pattern: str | None, first: int | None) -> DataFrame:
    """The papers whose id matches, in order of it, only the first so many."""
    out = papers.filter(F.col(key).rlike(pattern)) if pattern else papers
    return out.orderBy(key).limit(first) if first is not None else out


def match_rows(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """For each paper (paper_id, sha256) the first row by ``line`` that has its hash or its id.

    Two equi-joins and a minimum: one join on either key would compare every pair.
    """
    others = [c for c in rows.columns if c not in ("paper_id", "sha256")]
    packed = F.struct("line", *(c for c in others if c != "line")).alias("row")
    by_hash = papers.join(rows.select("sha256", packed), "sha256").select("paper_id", "row")
    by_id = papers.select("paper_id").join(rows.select("paper_id", packed), "paper_id").select("paper_id", "row")
    first = by_hash.unionByName(by_id).groupBy("paper_id").agg(F.min_by("row", "row.line").alias("row"))
    return first.select("paper_id", "row.*")


def content_hash(pages: DataFrame) -> DataFrame:
    """paper_id, sha256 of a paper's page texts, for papers whose file is not at hand."""
    each = pages.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("page", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")))).alias("hs"))
    return each.select("paper_id", F.sha2(F.array_join(F.transform("hs", lambda x: F.concat(x["page"].cast("string"), F.lit(":"), x["h"])), " "), 256).alias("sha256"))


def first_seen(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """group, value, pos: each value of a group once, in the order in which it first came."""
    firsts = rows.groupBy(group, value).agg(F.min(order).alias("first"))
    return firsts.select(group, value, F.row_number().over(Window.partitionBy(group).orderBy("first")).alias("pos"))


def merge_unique(left: Column, right: Column) -> Column:
    """Both arrays' texts in order, trimmed, without blanks, each once."""
    trimmed = F.transform(F.concat(left, right), strip)
    return F.array_distinct(F.filter(trimmed, lambda x: F.length(x) > 0))
