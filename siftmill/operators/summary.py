"""Summaries of tests: by paper, by page and by table, with the entries nearest to a threshold.

``seq`` is the order of tests in their paper; every list is ordered by distance, then seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill import fixed
from siftmill.functions import stats, text
from siftmill.operators.tests import window_aggregates


def effective_abs_t() -> Column:
    """abs_t, or the size of t where it is missing."""
    at = F.when(~F.isnan("abs_t"), F.col("abs_t"))
    return F.coalesce(at, F.abs(F.when(~F.isnan("t"), F.col("t"))))


def paper_summary(tests: DataFrame) -> DataFrame:
    """Window counts, significance, the p-curve and the count of |t| = 2 of each paper."""
    at, p = F.col("at"), F.col("p_approx_2s")
    near_t = F.abs(at - 1.96) <= 0.20
    made = tests.withColumn("at", effective_abs_t()).groupBy("paper_id").agg(F.count("*").alias("tests"), *window_aggregates(at, p), F.count_if(near_t & stats.exactly_two(at) & F.col("page").isNotNull()).alias("exact_2"))
    return made.withColumn("curve_z", stats.caliper_z(F.col("curve_low"), F.col("curve_high")))


def page_counts(tests: DataFrame) -> DataFrame:
    """paper_id, page, p_count, t_count: a full outer join of the counts of either kind."""
    at = tests.withColumn("at", effective_abs_t()).filter("page IS NOT NULL")
    p = at.filter(stats.valid_p(F.col("p_approx_2s")) & (stats.side(F.col("p_approx_2s"), 0.05, 0.005) != 0)).groupBy("paper_id", "page").agg(F.count("*").alias("p_count"))
    t = at.filter(F.abs(F.col("at") - 1.96) <= 0.20).groupBy("paper_id", "page").agg(F.count("*").alias("t_count"))
    both = p.join(t, ["paper_id", "page"], "full")
    return both.select("paper_id", "page", F.coalesce("p_count", F.lit(0)).alias("p_count"), F.coalesce("t_count", F.lit(0)).alias("t_count"))


def examples(tests: DataFrame, kind: str) -> DataFrame:
    """The tests of each paper nearest to p = 0.05 ("p") or |t| = 1.96 ("t"), with rank and truncated."""
    at = tests.withColumn("at", effective_abs_t())
    if kind == "p":
        near = at.filter(stats.valid_p(F.col("p_approx_2s")) & (stats.side(F.col("p_approx_2s"), 0.05, 0.005) != 0)).withColumn("distance", F.abs(F.col("p_approx_2s") - 0.05))
        cap = fixed.P_EXAMPLES
    else:
        near = at.filter(F.col("page").isNotNull()).withColumn("distance", F.abs(F.col("at") - 1.96)).filter(F.col("distance") <= 0.20)
        cap = fixed.T_EXAMPLES
    counts = near.groupBy("paper_id").agg((F.count("*") > cap).alias("truncated"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy("distance", "seq"))).filter(F.col("rank") <= cap)
    return ranked.join(counts, "paper_id")


def page_borderline(tests: DataFrame) -> DataFrame:
    """Up to three tests of each page nearest to either threshold: distance, why_borderline, rank.

    The distance of p counts only where it is smaller than that of t, though the scales differ.
    """
    at = tests.withColumn("at", effective_abs_t()).filter("page IS NOT NULL")
    by_t = F.when(F.abs(F.col("at") - 1.96) <= 0.20, F.abs(F.col("at") - 1.96))
    p = F.when(~F.isnan("p_approx_2s"), F.col("p_approx_2s"))
    by_p = F.when(F.abs(p - 0.05) <= 0.005, F.abs(p - 0.05))
    wins = by_p.isNotNull() & (by_t.isNull() | (by_p < by_t))
    near = at.withColumn("distance", F.when(wins, by_p).otherwise(by_t)).withColumn("why_borderline", F.when(wins, "p≈0.05").otherwise("abs(t)≈1.96")).filter("distance IS NOT NULL")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id", "page").orderBy("distance", "seq"))).filter(F.col("rank") <= fixed.PAGE_EXAMPLES)


def _good_box() -> Column:
    box = F.col("coef_cell_bbox")
    return (F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x))


def table_tops(tests: DataFrame) -> DataFrame:
    """paper_id, page, table_index, top: the least upper edge of a table's coefficient cells."""
    return tests.filter(_good_box() & F.col("page").isNotNull() & F.col("table_index").isNotNull()).groupBy("paper_id", "page", "table_index").agg(F.min(F.col("coef_cell_bbox")[1]).alias("top"))


def with_table_tops(tests: DataFrame) -> DataFrame:
    """Tests with ``top``, as a left join with ``table_tops`` gives it, in one pass over the tests; cells dealt by table are not moved again."""
    known = F.col("paper_id").isNotNull() & F.col("page").isNotNull() & F.col("table_index").isNotNull()
    return tests.withColumn("top", F.min(F.when(_good_box() & known, F.col("coef_cell_bbox")[1])).over(Window.partitionBy("paper_id", "page", "table_index")))


def with_tables(tests: DataFrame, captions: DataFrame) -> DataFrame:
    """Tests with the id and caption of their page's table."""
    of_page = captions.filter("kind = 'table'").select("paper_id", "page", "caption")
    joined = tests.filter("page > 0").join(of_page, ["paper_id", "page"], "left")
    return joined.withColumn("table_id", F.when(F.col("caption").isNull(), F.lit(fixed.UNKNOWN_TABLE)).otherwise(text.artifact_id(F.col("caption"), "table")))


def table_metrics(tests: DataFrame, captions: DataFrame) -> DataFrame:
    """Counts, shares and the p-curve of each table (paper_id, table_id); windows by their literal bounds."""
    at, p = F.col("abs_t"), F.col("p_approx_2s")
    p_side, t_side = F.when(stats.valid_p(p), stats.bin_side(p, *fixed.BINS["p_0_05"])).otherwise(0), stats.bin_side(at, *fixed.BINS["t_1_96"])
    low = F.count_if(stats.valid_p(p) & (p <= fixed.CURVE_SPLIT))
    made = with_tables(tests, captions).groupBy("paper_id", "table_id").agg(
        F.count("*").alias("n_tests"), F.sort_array(F.collect_set("page")).alias("pages"),
        F.min_by("caption", "page").alias("caption"),
        F.count_if(p_side == -1).alias("p_005_left"), F.count_if(p_side == 1).alias("p_005_right"),
        F.count_if(t_side == -1).alias("t_196_left"), F.count_if(t_side == 1).alias("t_196_right"),
        F.count_if(stats.valid_p(p) & (p <= fixed.ALPHA)).alias("sig_p_le_0_05"), F.count_if(stats.valid_p(p) & (p <= fixed.ALPHA_WIDE)).alias("sig_p_le_0_10"),
        low.alias("pcurve_low_half"), F.count_if((t_side != 0) & stats.exactly_two(at)).alias("t_exact_2_count"),
    )
    at_least = lambda c: F.greatest(F.lit(1), F.col(c))
    made = made.withColumn("pcurve_high_half", F.col("sig_p_le_0_05") - F.col("pcurve_low_half"))
    return made.withColumns({
        "p_005_left_over_right": F.col("p_005_left") / at_least("p_005_right"), "t_196_right_over_left": F.col("t_196_right") / at_least("t_196_left"),
        "pcurve_low_over_high": F.col("pcurve_low_half") / at_least("pcurve_high_half"), "pcurve_right_skew_z": stats.caliper_z(F.col("pcurve_low_half"), F.col("pcurve_high_half")),
        "t_exact_2_share_in_t196": F.when(F.col("t_196_left") + F.col("t_196_right") > 0, F.col("t_exact_2_count") / (F.col("t_196_left") + F.col("t_196_right"))).otherwise(0.0),
    })


def table_flagged(tests: DataFrame, captions: DataFrame, kind: str, k: int = fixed.TABLE_EXAMPLES) -> DataFrame:
    """Up to k tests of each table nearest to p = 0.05 ("p") or |t| = 1.96 ("t"), within the literal bounds."""
    value, center = (F.col("p_approx_2s"), 0.05) if kind == "p" else (F.col("abs_t"), 1.96)
    inside = stats.bin_side(value, *fixed.BINS["p_0_05" if kind == "p" else "t_1_96"]) != 0
    near = with_tables(tests, captions).filter(inside).withColumn("distance", F.abs(value - center))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id", "table_id").orderBy("distance", "seq"))).filter(F.col("rank") <= k)


def near_by_title(examples_: DataFrame, captions: DataFrame, kind: str, k: int = 12) -> DataFrame:
    """paper_id, title, left, right of the k tables that have most of the (capped) examples."""
    value, bins = (F.col("p_approx_2s"), fixed.BINS["p_0_05"]) if kind == "p" else (F.col("at"), fixed.BINS["t_1_96"])
    of_page = captions.filter("kind = 'table'").select("paper_id", "page", "caption")
    titled = examples_.drop("caption").join(of_page, ["paper_id", "page"], "left").withColumn("title", F.coalesce("caption", F.lit("(unknown)")))
    where = stats.bin_side(value, *bins)
    counts = titled.groupBy("paper_id", "title").agg(F.count_if(where == -1).alias("left"), F.count_if(where == 1).alias("right"), F.min("rank").alias("first_rank")).filter(F.col("left") + F.col("right") > 0)
    order = Window.partitionBy("paper_id").orderBy(F.desc(F.col("left") + F.col("right")), "first_rank")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("first_rank")
