"""Grids from word boxes against a plain version and a drawn table."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siftmill.operators import grid, tests

WORDS = "paper_id string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"


def made(spark, words):
    return {(r["paper_id"], r["page"], r["table_index"], r["row_index"], r["col_index"]): (r["cell_text"], tuple(r["cell_bbox"])) for r in grid.cells(spark.createDataFrame(words, WORDS)).collect()}


def drawn(paper, page, table, top=50.0):
    """Words of a table given as rows of texts; columns of even width, words of a cell side by side."""
    out = []
    for r, row in enumerate(table):
        for c, cell in enumerate(row):
            for k, w in enumerate(cell.split()):
                x = 40.0 + 90 * c + 35 * k
                out.append((paper, page, len(out), w, x, top + 12 * r, x + 30, top + 12 * r + 9))
    return out


def test_ragged_and_empty_cells(spark):
    table = [["", "one", "two"], ["income", "0.12**", ""], ["", "(0.05)", "(0.07)"], ["age", "", "0.30"]]
    words = drawn("a", 1, table) + drawn("a", 2, table[1:], 500.0) + drawn("b", 1, [["alone"]]) + [("a", 1, 99, "note", 41.0, 300.0, 70.0, 309.0), ("a", 1, 100, "  ", 5.0, 5.0, 6.0, 6.0), ("c", 1, 1, None, 1.0, 1.0, 2.0, 2.0)]
    got = made(spark, words)
    assert [[got["a", 1, 0, r, c][0] for c in range(3)] for r in range(4)] == table
    assert [[got["a", 2, 0, r, c][0] for c in range(3)] for r in range(3)] == table[1:]
    assert {k[:3] for k in got} == {("a", 1, 0), ("a", 2, 0)}  # neither a line far below nor a lone word is a table
    assert got["a", 1, 0, 1, 1][1] == (130.0, 62.0, 220.0, 71.0)
    cells = grid.cells(spark.createDataFrame(drawn("a", 1, [["0.12**", "0.5"], ["(0.05)", "(0.2)"]]), WORDS))
    pairs = tests.pairs(cells.withColumn("page", cells["page"]))
    assert sorted((r["coef"], r["paren"]) for r in pairs.collect()) == [(0.12, 0.05), (0.5, 0.2)]


def groups(values, tolerance):
    """value -> group number, by gaps."""
    out, k, last = {}, -1, None
    for v in sorted(set(values)):
        k += last is None or v - last > tolerance
        out[v], last = k, v
    return out


def plain(words):
    words = [w for w in words if w[3] and w[3].strip()]
    line = groups([w[5] for w in words], 3)
    lines = {}
    for w in words:
        top, bottom = lines.get(line[w[5]], (w[5], w[7]))
        lines[line[w[5]]] = min(top, w[5]), max(bottom, w[7])
    table, bottom, where = -1, None, {}
    for k in sorted(lines):
        if bottom is None or lines[k][0] - bottom > 24:
            table, row = table + 1, 0
        where[k] = table, row
        row, bottom = row + 1, lines[k][1] if bottom is None else max(bottom, lines[k][1])
    out = {}
    for t in range(table + 1):
        own = [w for w in words if where[line[w[5]]][0] == t]
        proposals = []
        for kind, at in enumerate((lambda w: w[4], lambda w: w[6], lambda w: (w[4] + w[6]) / 2)):
            group = groups([at(w) for w in own], 1)
            for g in set(group.values()):
                of = [w for w in own if group[at(w)] == g]
                if len(of) >= 2:
                    proposals.append((-len(of), min(w[4] for w in of), max(w[6] for w in of), kind))
        taken = []
        for p in sorted(proposals):
            if not any(q[1] < p[2] and q[2] > p[1] for q in taken):
                taken.append(p)
        cuts = [p[1] for p in taken] + [max((p[2] for p in taken), default=0)] * bool(taken)
        snapped = groups(cuts, 3)
        edges = sorted(sum(c for c in cuts if snapped[c] == g) / sum(snapped[c] == g for c in cuts) for g in set(snapped.values()))
        for k, (tt, r) in where.items():
            for c in range(len(edges) - 1) if tt == t else ():
                cell = sorted((w[4], w[2], w[3]) for w in own if line[w[5]] == k and edges[c] <= (w[4] + w[6]) / 2 < edges[c + 1])
                out["p", 1, t, r, c] = (" ".join(w[2].strip() for w in cell), (edges[c], lines[k][0], edges[c + 1], lines[k][1]))
    return out


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 20), st.sampled_from([10, 11, 30]), st.sampled_from(["a", "bb", " "])), min_size=1, max_size=25))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_words(spark, boxes):
    words = [("p", 1, k, text, x * 8.0, y * 7.0, x * 8.0 + w, y * 7.0 + 6) for k, (x, y, w, text) in enumerate(boxes)]
    assert made(spark, words) == plain(words)
