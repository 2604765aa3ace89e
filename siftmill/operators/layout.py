"""Text lines and the labels of table cells from boxes on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions import stats, text, tokens


def good_box(box: Column) -> Column:
    """Whether a box has four numbers."""
    return F.coalesce((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def model_number(label: Column) -> Column:
    """Whether a label is only a model's number, as (1) or 1."""
    return F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)\s+", "").rlike(r"(?U)^(\(\d+\)|\d+)$")


def lines(words: DataFrame) -> DataFrame:
    """paper_id, page, line_no, text, x0, y0, x1, y1 from words (…, block_no, line_in_block, word_no, text, box edges).

    line_no orders the lines of a page by upper and then left edge, then block and line.
    """
    said = words.filter(F.length(tokens.strip(F.coalesce("text", F.lit("")))) > 0)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"])
    grouped = said.groupBy("paper_id", "page", "block_no", "line_in_block").agg(
        tokens.strip(F.regexp_replace(F.array_join(ordered, " "), r"(?U)\s+", " ")).alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return grouped.withColumn("line_no", F.struct("y0", "x0", "block_no", "line_in_block"))


#: Height of a strip in points; what lies beyond the first and last strip belongs to those.
STRIP, FIRST, LAST = 48.0, -8, 256
#: How many strips above a cell are searched before the whole page is.
NEAR = 2


def _strip(y: Column) -> Column:
    return F.least(F.greatest(F.floor(y / STRIP), F.lit(FIRST)), F.lit(LAST)).cast("int")


def _cells(flagged: DataFrame) -> DataFrame:
    """Flagged cells with good boxes: paper_id, page, cell_id, the table's heights, the cell's edges."""
    return flagged.filter(good_box(F.col("table_bbox")) & good_box(F.col("cell_bbox"))).select(
        "paper_id", "page", "cell_id", F.col("table_bbox")[1].alias("ty0"), F.col("table_bbox")[3].alias("ty1"),
        *(F.col("cell_bbox")[k].alias(n) for k, n in enumerate(("cx0", "cy0", "cx1", "cy1"))), *(c for c in ("top",) if c in flagged.columns),
    )


IN_TABLE = "y1 >= ty0 - 2 AND y0 <= ty1 + 2"


def beside(cells: DataFrame, page_lines: DataFrame, low: Column, high: Column) -> DataFrame:
    """Cells with the lines of their page whose heights share some with low to high, each pair once.

    An interval join by strips: both sides are filed under every strip that they reach into and meet
    by an equi-join; a pair counts in the first strip that both have.
    """
    from_, to = F.sequence(_strip(F.col("low")), _strip(F.col("high"))), F.sequence(_strip(F.col("y0")), _strip(F.col("y1")))
    filed = cells.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("strip", F.explode(from_))
    of_lines = page_lines.filter("y0 <= y1").withColumn("strip", F.explode(to))
    first = F.greatest(_strip(F.col("low")), _strip(F.col("y0")))
    met = filed.join(of_lines, ["paper_id", "page", "strip"]).filter(F.col("strip") == first)
    return met.filter(stats.overlap(F.col("y0"), F.col("y1"), F.col("low"), F.col("high")) > 0).drop("strip", "low", "high")


def row_labels(flagged: DataFrame, page_lines: DataFrame) -> DataFrame:
    """paper_id, page, cell_id, row_label: the best line left of a cell, near its height; lines with letters first."""
    mid = (F.col("cy0") + F.col("cy1")) / 2
    band = F.greatest(F.lit(5.0), (F.col("cy1") - F.col("cy0")) * 0.9)
    left = beside(_cells(flagged), page_lines, mid - band, mid + band).filter(IN_TABLE).filter("x1 <= cx0 - 2")
    score = F.abs((F.col("y0") + F.col("y1")) / 2 - mid) + 0.02 * F.greatest(F.lit(0.0), F.col("cx0") - F.col("x1")) + F.when(F.col("text").rlike("[A-Za-z]"), 0.0).otherwise(8.0)
    return left.groupBy("paper_id", "page", "cell_id").agg(text.markdown_cell(F.min_by("text", F.struct(score.alias("score"), "line_no"))).alias("row_label"))


def column_labels(flagged: DataFrame, page_lines: DataFrame) -> DataFrame:
    """paper_id, page, cell_id, col_label: the nearest line above a cell that it shares width with.

    ``top`` in flagged (the upper edge of the table's coefficients) bounds the header where it is
    known. A mere model number gets the nearest line with letters within 80 points put before it.
    Lines are filed under the strip of their lower edge and searched for NEAR strips upward; a line
    found there is nearer than any above. Only for cells without one the whole page is searched.
    """
    wide = stats.overlap(F.col("x0"), F.col("x1"), F.col("cx0"), F.col("cx1"))
    dy = F.greatest(F.lit(0.0), F.col("cy0") - F.col("y1"))
    key = ["paper_id", "page", "cell_id"]
    cells = _cells(flagged)
    above = F.expr("y1 < cy0 - 1") & (wide > 0)
    headed = F.expr(IN_TABLE) & (F.expr("top IS NULL OR y1 <= top - 1.0") if "top" in flagged.columns else F.lit(True))
    filed = page_lines.withColumn("strip", _strip(F.col("y1")))

    def upward(of: DataFrame, strips: int) -> DataFrame:
        at = _strip(F.col("cy0") - 1)
        return of.withColumn("strip", F.explode(F.sequence(F.greatest(at - strips, F.lit(FIRST)), at))).join(filed, ["paper_id", "page", "strip"]).drop("strip").filter(above)

    def nearest_of(lines: DataFrame) -> DataFrame:
        return lines.groupBy(*key).agg(F.min_by("text", F.struct(dy.alias("dy"), (-wide).alias("wide"), "line_no")).alias("label"))

    near = nearest_of(upward(cells, NEAR).filter(headed))
    far = cells.join(near.select(*key), key, "left_anti").join(page_lines, ["paper_id", "page"]).filter(above & headed)
    nearest = near.unionByName(nearest_of(far))
    numbers = nearest.filter(model_number(F.col("label")))
    every = flagged.select(*key, *(F.col("cell_bbox")[k].alias(n) for k, n in enumerate(("cx0", "cy0", "cx1", "cy1"))))
    named = upward(every.join(numbers.select(*key), key, "left_semi"), NEAR).filter(F.col("text").rlike("[A-Za-z]") & (dy <= 80))
    names = named.groupBy(*key).agg(F.min_by("text", F.struct(dy.alias("dy"), "line_no")).alias("name"))
    joined = nearest.join(names, key, "left")
    label = text.markdown_cell(F.col("label"))
    return joined.select(*key, F.when(F.col("name").isNotNull(), F.concat(text.markdown_cell(F.col("name")), F.lit(" "), label)).otherwise(label).alias("col_label"))


def numeric_region(blocks: DataFrame) -> DataFrame:
    """paper_id, page, x0, y0, x1, y1: the part of a page that holds its numbers, if it is under 75 % of the page.

    blocks: paper_id, page, text, box edges, page_width, page_height.
    """
    t = F.coalesce("text", F.lit(""))
    n = text.digits(t)
    dense = blocks.filter((n >= 30) & ((n / F.greatest(F.lit(1), F.length(t)) >= 0.08) | t.contains("***") | t.contains("Observations")))
    whole = dense.groupBy("paper_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("page_width").alias("w"), F.first("page_height").alias("h"))
    cut = whole.select("paper_id", "page", F.greatest(F.lit(0.0), F.col("x0") - 12).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") - 12).alias("y0"), F.least(F.col("w"), F.col("x1") + 12).alias("x1"), F.least(F.col("h"), F.col("y1") + 12).alias("y1"), "w", "h")
    return cut.filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("w") * F.col("h")) < 0.75).drop("w", "h")
