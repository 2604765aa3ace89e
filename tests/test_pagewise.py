"""Counts page by page, with what runs over the ends of pages, against counts over whole texts."""

import random

from pyspark.sql import functions as F

from siftmill import fixed
from siftmill.functions import text
from siftmill.operators import pages as page_ops
from siftmill.operators import tests

PIECES = ["multiple", "testing", "multiple  testing", "p", "p =", "=", "< 0.04", "0.05", "0.051 ", "p-value", "p value = 0.10", "standard", "errors in", "errors", "parentheses", "(standard", "errors)", "t-statistics in", "(t-stat)", "table", "robust", "robustness", "***", "alternative", "specification", "bonferroni", "word", "\n", "x" * 350, "y" * 450]


def papers():
    rng, out = random.Random(4), []
    for k in range(250):
        pages = [" ".join(rng.choices(PIECES, k=rng.choice([0, 1, 2, 3, 8]))) for _ in range(rng.randrange(1, 7))]
        out.append((f"p{k}", pages))
    return [*out, ("none", [None, None]), ("split", ["We use multiple", "testing, where p =", "0.03 and standard", "errors in", "parentheses; p-value <", "", "0.051"])]


def test_as_if_a_paper_were_one_text(spark):
    rows = [(p, k + 1, t) for p, pages in papers() for k, t in enumerate(pages)]
    random.Random(1).shuffle(rows)
    pages = spark.createDataFrame(rows, "paper_id string, page int, text string").repartition(5)
    whole = spark.createDataFrame([(p, "\n\n".join(t or "" for t in own)) for p, own in papers()], "paper_id string, full string")
    got = {r["paper_id"]: r for r in tests.text_features(pages).collect()}
    modes = {r["paper_id"]: r["mode_text"] for r in tests.text_modes(pages).collect()}
    full, values = F.col("full"), text.p_values(F.col("full"))
    counts = [text.hits(full, p).alias(n) for n, p in tests.TERMS.items()]
    mode = text.paren_mode_of(text.hits(full, fixed.PAREN_T_PATTERNS), text.hits(full, fixed.PAREN_SE_PATTERNS))
    want = whole.select("paper_id", F.length(full).alias("text_chars"), values.alias("p_values"), mode.alias("mode"), *counts).collect()
    assert len(got) == len(want) == len(modes)
    for w in want:
        g = got[w["paper_id"]]
        assert g["p_values"] == sorted(w["p_values"])[:30] and g["p_values_found"] == len(w["p_values"]) and modes[w["paper_id"]] == w["mode"]
        assert [g[c] for c in ("text_chars", *tests.TERMS)] == [w[c] for c in ("text_chars", *tests.TERMS)], w
    split = got["split"]
    assert split["multiple_testing_terms"] == 1 and split["p_values"] == [0.03, 0.051] and modes["split"] == "se"
    assert split["text_p_0_05"]["right"] == 1 and split["text_p_0_05"]["left"] == 0 and split["has_correction"]


def test_only_ends_of_pages_are_moved(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 10_000), ("a", 2, "y" * 10_000), ("b", 1, "alone")], "paper_id string, page int, text string")
    moved = page_ops.borders(pages).collect()
    assert [(r["paper_id"], len(r["before"]), len(r["after"])) for r in moved] == [("a", page_ops.BORDER, page_ops.BORDER)]
