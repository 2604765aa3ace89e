"""Labels of cells by strips, and mentions by an index of names, against comparisons of all pairs."""

import random
import re

from pyspark.sql import functions as F

from siftmill.operators import artifacts, layout, summary

LINES = "paper_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, line_no int"
CELLS = "paper_id string, page int, cell_id int, table_bbox array<double>, cell_bbox array<double>, top double"


def boxes():
    rng = random.Random(6)
    lines, cells = [], []
    for paper, tall in (("a", 800.0), ("b", 90.0), ("far", 9000.0)):
        for page in (1, 2):
            for k in range(60):
                x, y = rng.uniform(0, 400), rng.uniform(-200, tall)
                h = rng.choice([8.0, 10.0, 200.0]) if k % 20 == 0 else 9.0
                lines.append((paper, page, rng.choice(["(1)", "2", "Income", "age of x", "3.5"]), x, y, x + rng.uniform(5, 200), y + h, len(lines)))
            for _ in range(40):
                x, y, t = rng.uniform(100, 500), rng.uniform(0, tall), rng.uniform(0, tall)
                cells.append((paper, page, len(cells), [0.0, t - 300, 600.0, t + 400], [x, y, x + 40, y + rng.choice([6.0, 10.0, 60.0])], rng.choice([None, y - 5, y - 60])))
    return lines, [*cells, ("a", 1, 9000, [0.0, 0.0, 9.0], [1.0, 1.0, 2.0, 2.0], None), ("a", 1, 9001, [0.0, 0.0, 9.0, 9.0], None, None), ("none", 1, 9002, [0.0, 0.0, 9.0, 9.0], [1.0, 1.0, 2.0, 2.0], None)]


def shared(a, b, c, d):
    return max(0.0, min(b, d) - max(a, c))


def plain(lines, cells):
    rows, cols = {}, {}
    for paper, page, cell, table, box, top in cells:
        if not (table and box and len(table) == 4 and len(box) == 4):
            continue
        own = [x for x in lines if x[:2] == (paper, page) and x[6] >= table[1] - 2 and x[4] <= table[3] + 2]
        mid, band = (box[1] + box[3]) / 2, max(5.0, (box[3] - box[1]) * 0.9)
        left = [(abs((y0 + y1) / 2 - mid) + 0.02 * max(0.0, box[0] - x1) + (0 if re.search("[A-Za-z]", t) else 8.0), n, t) for _, _, t, x0, y0, x1, y1, n in own if x1 <= box[0] - 2 and shared(y0, y1, mid - band, mid + band) > 0]
        if left:
            rows[cell] = min(left)[2]
        above = [(box[1] - y1, -shared(x0, x1, box[0], box[2]), n, t) for _, _, t, x0, y0, x1, y1, n in own if y1 < box[1] - 1 and shared(x0, x1, box[0], box[2]) > 0 and (top is None or y1 <= top - 1)]
        if above:
            cols[cell] = min(above)[3]
            if re.fullmatch(r"\(\d+\)|\d+", cols[cell]):
                names = [(box[1] - y1, n, t) for p, g, t, x0, y0, x1, y1, n in lines if (p, g) == (paper, page) and y1 < box[1] - 1 and shared(x0, x1, box[0], box[2]) > 0 and re.search("[A-Za-z]", t) and box[1] - y1 <= 80]
                if names:
                    cols[cell] = min(names)[2] + " " + cols[cell]
    return rows, cols


def test_labels_by_strips(spark):
    lines, cells = boxes()
    flagged, page_lines = spark.createDataFrame(cells, CELLS), spark.createDataFrame(lines, LINES)
    rows, cols = plain(lines, cells)
    assert len(rows) > 60 and len(cols) > 60
    assert {r["cell_id"]: r["row_label"] for r in layout.row_labels(flagged, page_lines).collect()} == rows
    assert {r["cell_id"]: r["col_label"] for r in layout.column_labels(flagged, page_lines).collect()} == cols
    assert set(layout.column_labels(flagged.drop("top"), page_lines).toPandas()["cell_id"]) >= set(cols)


def test_few_lines_meet_a_cell(spark):
    """On a page of a hundred lines a cell meets those near it only."""
    lines = [("a", 1, f"line {k}", 10.0, 12.0 * k, 50.0, 12.0 * k + 9, k) for k in range(100)]
    cells = [("a", 1, k, [0.0, 0.0, 600.0, 2000.0], [60.0, 12.0 * k, 90.0, 12.0 * k + 9], None) for k in range(100)]
    page_lines, mid = spark.createDataFrame(lines, LINES), (F.col("cy0") + F.col("cy1")) / 2
    flagged = layout._cells(spark.createDataFrame(cells, CELLS))
    filed = flagged.withColumn("strip", F.explode(F.sequence(layout._strip(mid - 9), layout._strip(mid + 9)))).join(page_lines.withColumn("strip", F.explode(F.sequence(layout._strip(F.col("y0")), layout._strip(F.col("y1"))))), ["paper_id", "page", "strip"])
    assert filed.count() < 800  # of 10,000 pairs
    assert layout.beside(flagged, page_lines, mid - 9, mid + 9).count() == 298


def test_mentions_by_an_index_of_names(spark):
    pages = [
        ("a", 1, "Table 1 at the start; table 1 again, TABLE 1. Table 12 is another, and table table 1b too.\nTable\n1 is broken off. Figure A3's trend."),
        ("a", 2, None), ("a", 3, "x" * 300 + " see figure a3, Table 12: " + "y" * 300), ("a", 4, "Balance of the sample, and balance of the sample."), ("b", 1, "Table 1"),
    ]
    items = [("a", "table", "Table 1"), ("a", "table", "Table 1b"), ("a", "table", "Table 12"), ("a", "figure", "Figure A3"), ("a", "table", "Balance of the sample"), ("a", "table", "Table 9"), ("b", "table", "Table 1")]
    frame, own = spark.createDataFrame(pages, "paper_id string, page int, text string"), spark.createDataFrame(items, "paper_id string, kind string, id string")
    got = {}
    for r in artifacts.mentions(own, frame).orderBy("rank").collect():
        got.setdefault((r["paper_id"], r["id"]), []).append((r["page"], r["snippet"]))

    def around(t, name):
        out = []
        for m in re.finditer(r"\b" + re.escape(name) + r"\b", t or "", re.I):
            s = " ".join(t[max(0, m.start() - 140) : m.end() + 140].split())
            s = s if len(s) <= 220 else s[:219].rstrip() + "…"
            if s.lower() not in (x.lower() for x in out):
                out.append(s)
        return out[:2]

    want = {}
    for paper, _, name in items:
        for p, page, t in pages:
            if p == paper and around(t, name):
                want.setdefault((paper, name), []).extend((page, s) for s in around(t, name))
    assert got == want and ("a", "Table 9") not in got


def test_tops_by_window_are_those_of_the_join(spark):
    boxes = ([0.0, 9.0, 1.0, 2.0], [0.0, 4.0, 1.0, 2.0], [0.0, float("nan"), 1.0, 2.0], [0.0, 1.0], None)
    rows = [(paper, page, table, k, box) for paper in ("a", None) for page in (1, None) for table in (0, 1, None) for k, box in enumerate(boxes[table or 0 :])]
    frame = spark.createDataFrame(rows, "paper_id string, page int, table_index int, k int, coef_cell_bbox array<double>")
    got = summary.with_table_tops(frame).select("paper_id", "page", "table_index", "k", "top")
    want = frame.join(summary.table_tops(frame), ["paper_id", "page", "table_index"], "left").select("paper_id", "page", "table_index", "k", "top")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.filter("top = 4").count() == 9  # both tables of the one page that has a place
