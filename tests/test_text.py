import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siftmill.functions import jsons, text, tokens
from siftmill.operators import pages, report, tests


def one(spark, make, *values):
    frame = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return frame.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "cell, want",
    [("- 2 . 1 0", "-2.10"), ("1,234,567", "1234567"), ("0.12 * *", "0.12**"), ("( 0.05 )", "(0.05)"), ("−0.5", "-0.5"), ("a 1 2", "a 1 2"), (None, ""), ("  ", ""), ("1 2 . 5*", "12.5*"), ("x,  y", "x, y")],
)
def test_normal_cell(spark, cell, want):
    assert one(spark, tokens.normal_cell, cell) == want


def test_numeric_tokens(spark):
    got = one(spark, tokens.numeric_tokens, "-0.123*** (1.2) 1234 x1.5 .45* 1.2.3 5****")
    assert [(r["raw"], r["stars"]) for r in got] == [("-0.123***", 3), ("1.2", 0), ("1234", 0), (".45*", 1), ("5***", 3)]


@pytest.mark.parametrize("cell, want", [("0.5 (0.1)", [0.1]), ("-(0.3)", [-0.3]), ("-(-0.3)", [-0.3]), ("(2005) (3)", [3.0]), ("none", []), ("(+1.5)", [1.5])])
def test_paren_tokens(spark, cell, want):
    assert one(spark, tokens.paren_tokens, cell) == want


@pytest.mark.parametrize("cell, want", [("(1) (2)", None), ("a 0.1 b 0.2*", "0.2*"), ("0.1 0.2*", None), ("0.3 (0.1)", "0.3"), ("0.4 (5", "0.4"), ("words", None), ("", None)])
def test_first_coefficient(spark, cell, want):
    got = one(spark, tokens.first_coefficient, cell)
    assert (got and got["raw"]) == want


@pytest.mark.parametrize("cell, want", [("(1999)", True), ("12 (3): 45", True), ("2(4), 264-272", True), ("Journal", True), ("p. 12", True), ("0.12", False), ("", False)])
def test_citation_like(spark, cell, want):
    assert one(spark, tokens.citation_like, cell) is want


@pytest.mark.parametrize("cell, below, raw, want", [("8) (9)", "", "8", True), ("7)", "(9)", "7", True), ("0.5 (0.1)", "", "0.5", False), ("7", "(9)", "7", False)])
def test_label_pair(spark, cell, below, raw, want):
    assert one(spark, lambda a, b, c: tokens.label_pair(a, b, c, F.lit(0)), cell, below, raw) is want


def test_p_values(spark):
    assert one(spark, text.p_values, "p = 0.04, P<0.10; p-value = 0.2, p value ≤ 0.05 p == 0.01") == [0.04, 0.01, 0.10, 0.2, 0.05]


def test_reference_page(spark):
    assert one(spark, text.reference_page, "  References\nA (1999)") is True
    assert one(spark, text.reference_page, "see references: doi www. https://") is True
    assert one(spark, text.reference_page, "(1999) " * 25 + "doi doi") is True
    assert one(spark, text.reference_page, "") is False


def test_caption_carry(spark):
    rows = [(1, 1, "Table 1. A"), (1, 2, "Panel B"), (1, 3, "text"), (1, 4, "PANEL C"), (1, 5, "table A2: B"), (2, 1, "Panel A")]
    got = {(r["paper_id"], r["page"]): r["caption"] for r in pages.captions(spark.createDataFrame(rows, "paper_id int, page int, text string"), "table").collect()}
    assert got == {(1, 1): "Table 1. A", (1, 2): "Table 1. A", (1, 4): "Table 1. A", (1, 5): "Table A2. B"}


def test_artifact_id(spark):
    assert one(spark, lambda c: text.artifact_id(c, "table"), "Table A3b. What") == "Table A3b"
    assert one(spark, lambda c: text.artifact_id(c, "table"), "Something. Else") == "Something"
    assert one(spark, lambda c: text.artifact_id(c, "table"), None) == "Table (unknown)"


def test_names_and_cuts(spark):
    assert one(spark, text.slug, " A b/c  d. ") == "A_b_c_d."
    assert one(spark, text.slug, "") == "paper"
    assert one(spark, lambda c: text.clean_snippet(c, 5), "a  b\nc d e") == "a b…"
    assert one(spark, text.markdown_cell, "a|b\n c") == "a\\|b c"
    assert one(spark, text.masked_key, "sk-12345678") == "*******5678"


def test_snippets(spark):
    got = one(spark, lambda c: text.snippets(c, (r"(?iU)\bone\b", r"(?iU)\btwo\b"), most=2, around=3), "two xx one yy ONE")
    assert got == ["xx one yy", "yy ONE"]


def test_anchor(spark):
    made = spark.range(1).select(text.anchor(F.lit(3), F.lit(0), F.lit("0.5*"), F.lit("(0.1)"), F.lit(-2.014), F.lit(0.0440)).alias("x")).first()["x"]
    assert made == "p.3 · Table#1 · coef=0.5* · paren=(0.1) · |t|≈2.01 · p≈0.044"
    none = F.lit(None).cast("string")
    assert spark.range(1).select(text.anchor(none, none.cast("int"), none, none, none.cast("double"), none.cast("double")).alias("x")).first()["x"] == "(unavailable)"


@pytest.mark.parametrize("said, want", [('{"a":1}', '{"a":1}'), ('```json\n{"a": 1}\n```', '{"a":1}'), ('so: {"a": {"b": 2}} ok', '{"a":{"b":2}}'), ("[1]", None), ("none", None), ("", None)])
def test_json_object(spark, said, want):
    assert one(spark, jsons.json_object, said) == want


def test_borderline_results_quote_their_own_spot(spark):
    got = one(spark, report.borderline_results, "x" * 80 + " p = 0.049 yes, p<0.2 and P = 0.10 end")
    assert [r["why_borderline"] for r in got] == ["p≈0.05", "p≈0.10"]
    assert got[0]["anchor"].startswith("x" * 10) and "p = 0.049" in got[0]["anchor"]


def test_upper_median_and_modes(spark):
    rows = [(1, float(v)) for v in range(1, 9)] + [(2, 0.1)] * 20 + [(3, 3.0)] * 7 + [(4, 2005.0)] * 9 + [(5, 1.6)] * 15
    got = {r["paper_id"]: (r["median"], r["mode_values"]) for r in tests.mode_by_values(spark.createDataFrame(rows, "paper_id int, paren double")).collect()}
    assert got == {1: (5.0, "t"), 2: (0.1, "se"), 3: (3.0, None), 5: (1.6, "t")}


def test_page_evidence_of_empty_page(spark):
    got = report.page_evidence(spark.createDataFrame([Row(paper_id=1, page=1, text="")])).first()
    assert len(got["notes"]) == 2 and got["confidence_0_1"] == 0.25


def test_pages_chosen(spark):
    rows = [(1, p, "table " * p) for p in range(1, 6)] + [(1, 6, "References\n" + "table " * 50)]
    scored = pages.triage_scores(spark.createDataFrame(rows, "paper_id int, page int, text string"))
    assert [r["page"] for r in pages.triage_pages(scored, 3).orderBy("rank").collect()] == [1, 5, 4]
    best = pages.report_pages(pages.report_scores(spark.createDataFrame(rows, "paper_id int, page int, text string")), 3)
    assert [r["page"] for r in best.orderBy("rank").collect()][0] == 1
