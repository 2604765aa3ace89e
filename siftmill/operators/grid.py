"""Table grids from word boxes: lines, columns by aligned words, and every cell between them.

All clustering is in one dimension, by gaps and islands: values in order, a new group where the step
from one to the next is over a tolerance. Words of a page form lines by their upper edges, lines form
tables where no gap is over ``TABLE_GAP``. In a table, words that are aligned by their left edges,
right edges or middles (within ``ALIGN``) and are at least ``MIN_WORDS`` propose a column; of proposals
that overlap the one with most words is taken. The columns' left edges and the last right edge, those
within ``SNAP`` made one, cut the table; a word belongs to the column that its middle is in. Each line
has a cell in each column, empty ones too; words outside all columns belong to no cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions import tokens

#: Points within which edges are one, and how many words make a column.
SNAP, ALIGN, MIN_WORDS = 3.0, 1.0, 2
TABLE_GAP = 24.0
PAGE = ("paper_id", "page")
TABLE = (*PAGE, "table_index")


def islands(rows: DataFrame, by: tuple[str, ...], at: str, tolerance: float, name: str) -> DataFrame:
    """rows with ``name``: the number (from 0) of the group of values of ``at`` that steps of at most ``tolerance`` join."""
    order = Window.partitionBy(*by).orderBy(at)
    step = F.col(at) - F.lag(at).over(order)
    return rows.withColumn("_new", F.when(step > tolerance, 1).otherwise(0)).withColumn(name, F.sum("_new").over(order)).drop("_new")


def table_lines(words: DataFrame, gap: float = TABLE_GAP) -> tuple[DataFrame, DataFrame]:
    """words with their line, and the lines: paper_id, page, line, top, bottom, table_index, row_index."""
    said = words.filter(F.length(tokens.strip(F.coalesce("text", F.lit("")))) > 0)
    placed = islands(said, PAGE, "y0", SNAP, "line")
    lines = placed.groupBy(*PAGE, "line").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    order = Window.partitionBy(*PAGE).orderBy("line")
    above = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("_new", F.when(F.col("top") - above > gap, 1).otherwise(0)).withColumn("table_index", F.sum("_new").over(order).cast("int"))
    return placed, lines.withColumn("row_index", (F.row_number().over(Window.partitionBy(*TABLE).orderBy("line")) - 1).cast("int")).drop("_new")


def _apart(proposals: Column) -> Column:
    """Of proposals in their order those that overlap none taken before."""
    kind = "array<struct<low:int,lo:double,hi:double,kind:int>>"

    def step(taken: Column, p: Column) -> Column:
        return F.when(F.exists(taken, lambda t: (t["lo"] < p["hi"]) & (t["hi"] > p["lo"])), taken).otherwise(F.concat(taken, F.array(p)))

    return F.aggregate(proposals.cast(kind), F.array().cast(kind), step)


def column_edges(words: DataFrame) -> DataFrame:
    """paper_id, page, table_index, edges: the cuts between columns of each table that has a column. words: with table_index."""
    sides = F.array(F.struct(F.lit(0).alias("kind"), F.col("x0").alias("at")), F.struct(F.lit(1).alias("kind"), F.col("x1").alias("at")), F.struct(F.lit(2).alias("kind"), ((F.col("x0") + F.col("x1")) / 2).alias("at")))
    placed = islands(words.select(*TABLE, "x0", "x1", F.inline(sides)), (*TABLE, "kind"), "at", ALIGN, "group")
    groups = placed.groupBy(*TABLE, "kind", "group").agg(F.count("*").alias("n"), F.min("x0").alias("lo"), F.max("x1").alias("hi")).filter(F.col("n") >= MIN_WORDS)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).cast("int").alias("low"), "lo", "hi", "kind")))
    taken = groups.groupBy(*TABLE).agg(_apart(ordered).alias("taken"))
    cuts = F.concat(F.transform("taken", lambda t: t["lo"]), F.array(F.array_max(F.transform("taken", lambda t: t["hi"]))))
    snapped = islands(taken.select(*TABLE, F.explode(cuts).alias("cut")), TABLE, "cut", SNAP, "group").groupBy(*TABLE, "group").agg(F.avg("cut").alias("cut"))
    return snapped.groupBy(*TABLE).agg(F.sort_array(F.collect_list("cut")).alias("edges")).filter(F.size("edges") > 1)


def cells(words: DataFrame, gap: float = TABLE_GAP) -> DataFrame:
    """paper_id, page, table_index, row_index, col_index, cell_text, table_bbox, cell_bbox of every cell.

    words: paper_id, page, word_no, text and box edges x0, y0, x1, y1. Words of a cell are in order of
    their left edges, then of word_no. Tables without a column have no cells.
    """
    placed, lines = table_lines(words, gap)
    placed = placed.join(lines.select(*PAGE, "line", "table_index", "row_index"), [*PAGE, "line"])
    edges = column_edges(placed)
    column = F.size(F.filter("edges", lambda e: e <= (F.col("x0") + F.col("x1")) / 2)) - 1
    held = placed.join(edges, list(TABLE)).withColumn("col_index", column).filter((F.col("col_index") >= 0) & (F.col("col_index") < F.size("edges") - 1))
    words_of = F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"])
    said = held.groupBy(*TABLE, "row_index", "col_index").agg(tokens.strip(F.regexp_replace(F.array_join(words_of, " "), r"(?U)\s+", " ")).alias("cell_text"))
    boxes = lines.groupBy(*TABLE).agg(F.min("top").alias("ty0"), F.max("bottom").alias("ty1")).join(edges, list(TABLE))
    table_box = F.array(F.element_at("edges", 1), "ty0", F.element_at("edges", -1), "ty1").alias("table_bbox")
    empty = lines.join(boxes, list(TABLE)).select(*TABLE, "row_index", "top", "bottom", "edges", table_box, F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("col_index"))
    cell_box = F.array(F.get("edges", F.col("col_index")), "top", F.get("edges", F.col("col_index") + 1), "bottom").alias("cell_bbox")
    key = [*TABLE, "row_index", "col_index"]
    return empty.select(*key, "table_bbox", cell_box).join(said, key, "left").select(*key, F.coalesce("cell_text", F.lit("")).alias("cell_text"), "table_bbox", "cell_bbox")
