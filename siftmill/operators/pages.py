"""Page scores, page choice and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill import fixed
from siftmill.functions import text


def triage_scores(pages: DataFrame) -> DataFrame:
    """pages (paper_id, page, text) with counts, is_reference and the score by which pages are chosen for table parsing."""
    t = F.coalesce("text", F.lit(""))
    out = pages.withColumns({
        "digit_count": text.digits(t), "star_count": text.stars(t), "table_mentions": text.hits(t, fixed.TABLE),
        "robust_mentions": text.hits(t, fixed.ROBUST), "p_mentions": text.hits(t, fixed.P_MENTION_TRIAGE), "is_reference": text.reference_page(t),
    })
    score = F.col("digit_count") / 2000.0 + 0.8 * F.col("table_mentions") + 0.25 * F.col("robust_mentions") + 0.02 * F.col("star_count") + 0.5 * F.col("p_mentions")
    return out.withColumn("score", score - F.when(F.col("is_reference"), 1.5).otherwise(0.0))


def report_scores(pages: DataFrame) -> DataFrame:
    """pages with counts and the score by which pages are chosen for a report: other weights, other terms."""
    t = F.coalesce("text", F.lit(""))
    out = pages.withColumns({
        "text_head": text.head(t), "text_len": F.length(t), "digit_count": text.digits(t), "star_count": text.stars(t),
        "p_mentions": text.hits(t, fixed.P_MENTION_AGENT), "table_mentions": text.hits(t, fixed.TABLE), "robust_mentions": text.hits(t, fixed.ROBUST_AGENT),
    })
    score = 3.0 * F.col("table_mentions") + 2.0 * F.col("robust_mentions") + 1.5 * F.col("p_mentions") + 0.004 * F.col("digit_count") + 0.02 * F.col("star_count")
    return out.withColumn("score", score + F.when(t.rlike(fixed.TABLE_WORDS), 1.0).otherwise(0.0))


def references_like(scored: Column | None = None) -> Column:
    """Whether a page of ``report_scores`` is a list of references that has no tables, p-values or stars."""
    named = F.lower("text_head").rlike("references|bibliography")
    return named & (F.col("table_mentions") == 0) & (F.col("p_mentions") == 0) & (F.col("star_count") < 10)


def triage_pages(scored: DataFrame, k: int) -> DataFrame:
    """paper_id, page, rank of the k best pages that are no references; page 1 comes first if it is not among them.

    A paper with no page at all has page 1 only where ``scored`` holds a row with a null page for it.
    """
    open_ = scored.filter((F.col("page") == 1) | ~F.coalesce("is_reference", F.lit(False)))
    ranked = open_.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("score"), "page"))).filter((F.col("place") <= k) | (F.col("page") == 1))
    forced = (F.col("page") == 1) & (F.col("place") > k)
    ordered = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.when(forced, 0).otherwise(1), "place"))).filter(F.col("rank") <= k)
    return ordered.select("paper_id", F.coalesce("page", F.lit(1)).alias("page"), "rank", "score")


def report_pages(scored: DataFrame, k: int) -> DataFrame:
    """paper_id, page, role, rank: page 1, then the k - 1 best others that are not like references."""
    others = scored.filter((F.col("page") == 1) | ~references_like())
    first = F.col("page") == 1
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.when(first, 0).otherwise(1), F.desc("score"), "page")))
    return ranked.filter(F.col("rank") <= k).select("paper_id", "page", F.when(first, "title/abstract").otherwise("auto_pick").alias("role"), "rank", "score")


def captions(pages: DataFrame, kind: str) -> DataFrame:
    """paper_id, page, kind, caption: a page's own caption, or for a page that goes on with a panel the last one before."""
    own = pages.select("paper_id", "page", text.caption(F.col("text"), kind).alias("own"), text.panel(F.coalesce("text", F.lit("")), kind).alias("panel"))
    so_far = Window.partitionBy("paper_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.when(F.col("panel"), F.last("own", ignorenulls=True).over(so_far))
    return own.withColumn("caption", F.coalesce("own", carried)).filter("caption IS NOT NULL").select("paper_id", "page", F.lit(kind).alias("kind"), "caption")


#: How many characters on either side of a page's end are looked at together.
BORDER = 160
#: What stands between two pages of a paper.
BETWEEN = "\n\n"


def borders(pages: DataFrame, width: int = BORDER) -> DataFrame:
    """paper_id, before, after: the end of each page but a paper's last, and what follows it, with BETWEEN before each page.

    Only these ends are moved, no whole text. A page that is shorter than ``width`` is followed by the
    next, up to three of them, so that what runs over a short page is seen.
    """
    t = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("paper_id").orderBy("page", "head")
    cut = pages.select("paper_id", "page", F.substring(t, 1, width).alias("head"), F.substring(t, -width, width).alias("before"))
    after = F.lit("")
    for k in (3, 2, 1):
        head = F.col(f"_head{k}")
        after = F.when(head.isNull(), F.lit("")).otherwise(F.concat(F.lit(BETWEEN), head, F.when(F.length(head) < width, after).otherwise(F.lit(""))))
    led = cut.select("paper_id", "before", *(F.lead("head", k).over(order).alias(f"_head{k}") for k in (1, 2, 3)))
    return led.select("paper_id", "before", F.substring(after, 1, width).alias("after")).filter("after <> ''")
