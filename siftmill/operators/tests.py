"""From table cells to reconstructed tests, features of papers and the risk score.

Every step is a plan over all papers. A paper's own conventions (what its parentheses hold) are an
aggregate that is joined back; nothing of a paper is gathered on one task beyond its histogram of
values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill import fixed
from siftmill.functions import stats, text, tokens
from siftmill.operators import pages as page_ops

PAIR_KEY = ("paper_id", "page", "table_index", "row_index", "col_index")


def pairs(cells: DataFrame) -> DataFrame:
    """Raw pairs of a coefficient and a number in parentheses, in its own cell or in the next row's of the column.

    cells: paper_id, page, table_index, row_index, col_index, cell_text, table_bbox, cell_bbox, with
    every cell of a table present.
    """
    below = Window.partitionBy("paper_id", "page", "table_index", "col_index").orderBy("row_index")
    cell = cells.withColumn("cell", tokens.normal_cell(F.col("cell_text")))
    follows = F.lead("row_index").over(below) == F.col("row_index") + 1
    cell = cell.withColumn("next_cell", F.when(follows, F.lead("cell").over(below))).withColumn("next_bbox", F.when(follows, F.lead("cell_bbox").over(below)))
    # the cheap test goes first: the others need not run on words
    numeric = cell.filter(tokens.numeric_ratio(F.col("cell")) >= 0.60).filter(~tokens.citation_like(F.col("cell")))

    # a filter on a column would be pushed below it and read the cell again, so what is found comes as a list of none or one
    def beside(coefficient: Column) -> Column:
        def joined(own: Column) -> Column:
            other = F.when(own.isNull() & tokens.usable(F.col("next_cell")), tokens.first_paren(F.col("next_cell")))
            return tokens.let(F.coalesce(own, other), lambda paren: F.when(paren.isNotNull() & (paren != 0), F.array(F.struct(coefficient.alias("coefficient"), own.alias("own"), paren.alias("paren")))))

        return F.when(coefficient.isNotNull(), tokens.let(tokens.first_paren(F.col("cell")), joined))

    found = numeric.select("*", F.inline(tokens.let(tokens.first_coefficient(F.col("cell")), beside)))
    # a cell below that was looked at is the one that is quoted, also where it gave nothing
    in_next = F.col("own").isNull()
    return found.select(
        *PAIR_KEY, "table_bbox",
        F.col("coefficient.raw").alias("coef_raw"), F.col("coefficient.value").alias("coef"), "paren",
        F.when(in_next, "next_row_same_col").otherwise("same_cell").alias("paren_source"),
        F.col("coefficient.stars").alias("stars"),
        F.col("cell_bbox").alias("coef_cell_bbox"), F.when(in_next, F.col("next_bbox")).otherwise(F.col("cell_bbox")).alias("se_cell_bbox"),
        F.substring("cell", 1, 120).alias("cell_text_snippet"),
        F.substring(F.when(in_next, F.col("next_cell")).otherwise(F.col("cell")), 1, 120).alias("se_cell_text_snippet"),
    )


def is_label_pair() -> Column:
    return tokens.label_pair(F.col("cell_text_snippet"), F.col("se_cell_text_snippet"), F.col("coef_raw"), F.col("stars"))


def mode_by_values(values: DataFrame) -> DataFrame:
    """paper_id, mode_values: what the sizes of the numbers in parentheses suggest. values: paper_id, paren.

    The upper median comes from a histogram by paper, which has partial results before the shuffle.
    """
    size = values.select("paper_id", F.abs("paren").alias("v")).filter("v > 0 AND v <= 50").filter(~stats.year_like(F.col("v")))
    counts = size.groupBy("paper_id", "v").agg(F.count("*").alias("c"))
    up = Window.partitionBy("paper_id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.select("paper_id", "v", F.sum("c").over(up).alias("upto"), F.sum("c").over(Window.partitionBy("paper_id")).alias("n"))
    middle = ranked.filter("upto > n DIV 2").groupBy("paper_id").agg(F.min("v").alias("median"), F.first("n").alias("n"))
    mode = (
        F.when((F.col("n") >= 15) & (F.col("median") >= 1.5), "t").when(F.col("n") >= 15, "se")
        .when((F.col("n") >= 8) & (F.col("median") >= 2.5), "t").when((F.col("n") >= 8) & (F.col("median") <= 0.8), "se")
    )
    return middle.select("paper_id", "median", "n", mode.alias("mode_values"))


def text_modes(pages: DataFrame) -> DataFrame:
    """paper_id, mode_text: what a paper's pages say that parentheses hold. pages: paper_id, page, text."""
    patterns = {"t": fixed.PAREN_T_PATTERNS, "se": fixed.PAREN_SE_PATTERNS}
    own = pages.select("paper_id", *(text.hits(F.col("text"), p).alias(n) for n, p in patterns.items()))
    across = page_ops.borders(pages).select("paper_id", *(text.hits_across(F.col("before"), F.col("after"), p).alias(n) for n, p in patterns.items()))
    sums = own.unionByName(across).groupBy("paper_id").agg(F.sum("t").alias("t"), F.sum("se").alias("se"))
    return sums.select("paper_id", text.paren_mode_of(F.col("t"), F.col("se")).alias("mode_text"))


def paren_modes(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """paper_id, paren_mode, paren_mode_source. pages: paper_id, page, text."""
    said = text_modes(pages)
    sized = mode_by_values(raw.filter(~is_label_pair()).select("paper_id", "paren"))
    both = said.join(sized, "paper_id", "left")
    source = F.when(F.col("mode_text").isNotNull(), "text").when(F.col("mode_values").isNotNull(), "values").otherwise("default")
    return both.select("paper_id", F.coalesce("mode_text", "mode_values", F.lit("se")).alias("paren_mode"), source.alias("paren_mode_source"))


def drop_reasons(mode: Column, abs_t: Column, se: Column) -> Column:
    """Array of the reasons for which a pair is no test."""
    by_t, year = mode == "t", stats.year_like
    quoted = tokens.citation_like(F.col("cell_text_snippet")) | tokens.citation_like(F.col("se_cell_text_snippet"))
    named = (
        (is_label_pair(), "column_label_like"),
        (quoted, "citation_like_text"),
        (year(F.col("paren")), "paren_looks_like_year"),
        (year(F.col("coef")) & F.coalesce(F.trim("coef_raw"), F.lit("")).rlike(r"^\d+$"), "coef_looks_like_year"),
        (by_t & (abs_t > fixed.T_MOST_T), "abs_t_gt_30(paren_t)"),
        (~by_t & se.isNull(), "missing_se"),
        (~by_t & (se > fixed.SE_MOST), "se_gt_50"),
        (~by_t & se.isNotNull() & (abs_t > fixed.T_MOST_SE), "abs_t_gt_80(coef_over_se)"),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in named)))


def reconstruct(raw: DataFrame, modes: DataFrame) -> DataFrame:
    """Raw pairs with t, p and the reasons to drop them (none: a test)."""
    both = raw.join(modes.select("paper_id", F.col("paren_mode").alias("paren_mode_assumed")), "paper_id")
    by_t, size = F.col("paren_mode_assumed") == "t", F.abs("paren")
    kind = F.when(by_t, "paren_t").when(size == 0, "invalid_se_zero").otherwise("coef_over_se")
    t = F.when(by_t, F.col("paren")).when(size == 0, F.lit(0.0)).otherwise(F.try_divide("coef", size))
    made = both.withColumn("t_mode", kind).withColumn("se", F.when(kind == "coef_over_se", size)).withColumn("t", t).withColumn("abs_t", F.abs("t"))
    made = made.withColumn("p_approx_2s", stats.p_of_t(F.col("abs_t")))
    reasons = drop_reasons(F.col("paren_mode_assumed"), F.col("abs_t"), F.col("se"))
    valid = stats.valid_p(F.col("p_approx_2s"))
    reasons = tokens.let(reasons, lambda r: F.when((F.size(r) == 0) & ~valid, F.array(F.lit("invalid_p"))).otherwise(r))
    return made.withColumn("reasons", reasons).withColumn("extractor_version", F.lit(fixed.VERSION))


def kept(reconstructed: DataFrame) -> DataFrame:
    return reconstructed.filter(F.size("reasons") == 0).drop("reasons")


def reason_counts(reconstructed: DataFrame) -> DataFrame:
    """paper_id, reason, n: each reason once for each pair."""
    return reconstructed.select("paper_id", F.explode("reasons").alias("reason")).groupBy("paper_id", "reason").agg(F.count("*").alias("n"))


def counters() -> dict[str, Column]:
    """Aggregates over reconstructed pairs: how many are tests, and how many have each reason to be none."""
    out = {"tests": F.count_if(F.size("reasons") == 0)}
    return out | {f"dropped: {r}": F.count_if(F.array_contains("reasons", r)) for r in REASONS}


def dropped_examples(reconstructed: DataFrame, most: int = 20) -> DataFrame:
    """paper_id, dropped_examples: the first pairs of a paper that are no tests, in order of place, with their reasons."""
    shown = ("page", "table_index", "coef", "paren", "cell_text_snippet", "se_cell_text_snippet", "reasons")
    rows = first_of_each(reconstructed.filter(F.size("reasons") > 0), most, list(PAIR_KEY[1:]))
    listed = F.sort_array(F.collect_list(F.struct("rank", *shown)))
    return rows.groupBy("paper_id").agg(F.transform(listed, lambda x: x.dropFields("rank")).alias("dropped_examples"))


def tables_of(reconstructed: DataFrame) -> DataFrame:
    """paper_id, tables_raw, tables_kept: (page, table_index) of the tables with pairs, and of those with tests."""
    each = reconstructed.groupBy("paper_id", "page", "table_index").agg(F.count_if(F.size("reasons") == 0).alias("kept"))
    place = F.array(F.col("page").cast("int"), F.col("table_index").cast("int"))
    return each.groupBy("paper_id").agg(F.sort_array(F.collect_list(place)).alias("tables_raw_list"), F.sort_array(F.collect_list(F.when(F.col("kept") > 0, place))).alias("tables_kept_list"))


def window_aggregates(abs_t: Column, p: Column | None = None) -> list[Column]:
    """Aggregates of tests: counts on either side of each window, significant tests, halves of the p-curve.

    Without stored p-values, bounds on p become bounds on abs_t, and no p is computed.
    """
    out = []
    for name, measure, center, delta in fixed.WINDOWS:
        where = stats.side(abs_t, center, delta) if measure == "abs_t" else stats.p_side(abs_t, center, delta) if p is None else stats.side(p, center, delta)
        out += [F.count_if(where == -1).alias(f"{name}_left"), F.count_if(where == 1).alias(f"{name}_right")]
    below = (lambda a: stats.p_at_most(abs_t, a)) if p is None else (lambda a: stats.valid_p(p) & (p <= a))
    out += [
        F.count_if(below(fixed.ALPHA)).alias("significant_0_05"),
        F.count_if(below(fixed.ALPHA_WIDE)).alias("significant_0_10"),
        F.count_if(below(fixed.CURVE_SPLIT)).alias("curve_low"),
        F.count_if(below(fixed.ALPHA) & ~below(fixed.CURVE_SPLIT)).alias("curve_high"),
    ]
    return out


def with_calipers(counts: DataFrame) -> DataFrame:
    """Window counts with their z and exact p; t windows count what is above, p windows what is below."""
    out = counts
    for name, measure, _, _ in fixed.WINDOWS:
        left, right = F.col(f"{name}_left"), F.col(f"{name}_right")
        out = out.withColumn(f"{name}_z", stats.caliper_z(left, right, "right" if measure == "abs_t" else "left")).withColumn(f"{name}_p", stats.binomial_p(left, left + right))
    low, high = F.col("curve_low"), F.col("curve_high")
    return out.withColumn("curve_z", stats.caliper_z(low, high)).withColumn("curve_p", stats.binomial_p(low, low + high))


TERMS = {"star_count": r"\*", "table_mentions": fixed.TABLE, "robust_terms": fixed.ROBUST, "multiple_testing_terms": fixed.MULTIPLE_TESTING, "specification_terms": fixed.SPECIFICATION}
SAMPLE = 30


def text_features(pages: DataFrame) -> DataFrame:
    """Counts over the texts of each paper, as if its pages were one. pages: paper_id, page, text.

    Every page is counted by itself, and what runs over the end of a page by the ends of both; the
    counts are added before the shuffle, so no paper's text is ever one value. ``p_values`` are the
    SAMPLE least.
    """

    def counted(values: Column, chars: Column, of: Callable[[str | tuple[str, ...]], Column]) -> list[Column]:
        bins = {name: stats.array_side_counts(values, *fixed.BINS[name]) for name in ("p_0_05", "p_0_10")}
        sides = [bins[name][side].alias(f"{name}_{side}") for name in bins for side in ("left", "right")]
        return [chars.cast("long").alias("text_chars"), F.size(values).alias("p_values_found"), text.p_sample(values, SAMPLE).alias("p_values"), *sides, *(of(p).alias(n) for n, p in TERMS.items())]

    t = F.col("text")
    own = pages.select("paper_id", *counted(text.p_values(t), F.length(F.coalesce(t, F.lit(""))), lambda p: text.hits(t, p)))
    before, after = F.col("before"), F.col("after")
    across = page_ops.borders(pages).select("paper_id", *counted(text.p_values_across(before, after), F.lit(len(page_ops.BETWEEN)), lambda p: text.hits_across(before, after, p)))
    sums = [F.sum(c).alias(c) for c in own.columns if c not in ("paper_id", "p_values")]
    out = own.unionByName(across).groupBy("paper_id").agg(*sums, text.p_sample(F.flatten(F.collect_list("p_values")), SAMPLE).alias("p_values"))
    for name in ("p_0_05", "p_0_10"):
        left, right = F.col(f"{name}_left"), F.col(f"{name}_right")
        out = out.withColumn(f"text_{name}", F.struct(left.alias("left"), right.alias("right"), (left + right).alias("total"))).drop(f"{name}_left", f"{name}_right")
        out = out.withColumn(f"text_{name}_z", stats.caliper_z(F.col(f"text_{name}.left"), F.col(f"text_{name}.right")))
        out = out.withColumn(f"text_{name}_p", stats.binomial_p(F.col(f"text_{name}.left"), F.col(f"text_{name}.total")))
    return out.withColumn("has_correction", F.col("multiple_testing_terms") > 0)


def risk_score(features: DataFrame) -> DataFrame:
    """Adds risk_score (0 to 100, half to even), risk_level and risk_components.

    The term counts may be missing (then 0). The fallback to p-values written in the text never
    applies, because the z of reconstructed tests is always a number.
    """
    columns = set(features.columns)
    col = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in columns else F.lit(0.0)
    total, parts = F.lit(float(fixed.BASE_SCORE)), []
    for name, weight in fixed.Z_WEIGHTS.items():
        part = col(name)
        parts.append(part.alias(name))
        total = total + abs(weight) * stats.cap01(F.greatest(F.lit(0.0), part if weight > 0 else -part) / 3.0)
    for name, (weight, scale) in fixed.TERM_WEIGHTS.items():
        part = F.least(F.lit(1.0), col(name) / float(scale))
        parts.append(part.alias(name))
        total = total + weight * part
    correction = F.when(col("multiple_testing_terms") > 0, 1.0).otherwise(0.0)
    total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), total + fixed.CORRECTION_WEIGHT * correction))
    scored = features.withColumn("risk_score", F.bround(total).cast("int")).withColumn("risk_components", F.struct(*parts, correction.alias("has_correction")))
    return scored.withColumn("risk_level", stats.risk_level(F.col("risk_score")))


def _by_paper(pairs_: DataFrame, counts: list[Column]) -> DataFrame:
    """Sums of counts by paper, with pairs_raw, tests, tables_raw and tables; pairs_ has ``ok`` (whether a pair is a test).

    Counts are made by table first and then summed by paper, so that tables are counted in the same
    pass and a paper with very many pairs is spread over its tables.
    """
    by_table = pairs_.groupBy("paper_id", "page", "table_index").agg(F.count("*").alias("pairs_raw"), F.count_if("ok").alias("tests"), *counts)
    sums = [F.sum(c).alias(c) for c in by_table.columns if c not in ("paper_id", "page", "table_index")]
    return by_table.groupBy("paper_id").agg(*sums, F.count("*").alias("tables_raw"), F.count_if(F.col("tests") > 0).alias("tables"))


def test_features(tests: DataFrame) -> DataFrame:
    """Per paper: number of tests and of tables, window counts with calipers. tests: paper_id, page, table_index, abs_t (p_approx_2s)."""
    p = F.col("p_approx_2s") if "p_approx_2s" in tests.columns else None
    made = _by_paper(tests.withColumn("ok", F.lit(True)), window_aggregates(F.col("abs_t"), p))
    return with_calipers(made.drop("pairs_raw", "tables_raw"))


REASONS = ("column_label_like", "citation_like_text", "paren_looks_like_year", "coef_looks_like_year", "abs_t_gt_30(paren_t)", "missing_se", "se_gt_50", "abs_t_gt_80(coef_over_se)", "invalid_p")


def paper_features(papers: DataFrame, pages: DataFrame, reconstructed: DataFrame, modes: DataFrame) -> DataFrame:
    """The feature row of every paper, with its score. papers: paper_id (sha256, … stay); pages: paper_id, page, text.

    One pass over the reconstructed pairs gives all counts.
    """
    ok = F.size("reasons") == 0
    counts = window_aggregates(F.when(ok, F.col("abs_t")), F.when(ok, F.col("p_approx_2s")))
    dropped = [F.count_if(F.array_contains("reasons", r)).alias(f"reason_{k}") for k, r in enumerate(REASONS)]
    counted = with_calipers(_by_paper(reconstructed.withColumn("ok", ok), [*counts, *dropped]))
    every = F.map_from_arrays(F.array(*map(F.lit, REASONS)), F.array(*(f"reason_{k}" for k in range(len(REASONS)))))
    counted = counted.withColumn("filter_counts", F.map_filter(every, lambda _, n: n > 0)).drop(*(f"reason_{k}" for k in range(len(REASONS))))
    out = papers.join(text_features(pages), "paper_id").join(modes, "paper_id", "left").join(counted, "paper_id", "left")
    numbers = [c for c in counted.columns if c.endswith(("_left", "_right", "_z")) or c in ("tests", "tables", "pairs_raw", "tables_raw", "curve_low", "curve_high", "significant_0_05", "significant_0_10")]
    out = out.fillna(0, subset=numbers).withColumn("keep_rate", F.try_divide("tests", "pairs_raw"))
    return risk_score(out)


def skipped(papers: DataFrame, max_pages: int) -> DataFrame:
    """Stub rows of papers that have too many pages. papers: paper_id, pages."""
    return papers.filter(F.col("pages") > max_pages).select("paper_id", "pages", F.concat(F.lit("pages>"), F.lit(max_pages).cast("string")).alias("skipped_reason"))


def first_of_each(tests: DataFrame, k: int, order: list[str], by: str = "paper_id") -> DataFrame:
    """The first k rows of each group in an order."""
    w = Window.partitionBy(by).orderBy(*order)
    return tests.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def row_pairs(rows: DataFrame, most: int = 8) -> DataFrame:
    """Older sampler: the numbers of a row against the parentheses of the next, up to ``most`` each.

    rows: paper_id, page, table_index, row_index, row_text.
    """
    below = Window.partitionBy("paper_id", "page", "table_index").orderBy("row_index")
    # texts are sorted, not tokens, and each is read once: a filter on tokens would be pushed below them and read it again
    both = rows.select("paper_id", "page", "table_index", "row_index", tokens.normal_cell(F.col("row_text")).alias("text")).withColumn("next_text", F.lead("text").over(below))

    def against(values: Column) -> Column:
        def zipped(errors: Column) -> Column:
            k = F.least(F.size(values), F.size(errors), F.lit(most))
            return F.when(F.size(errors) >= 2, F.arrays_zip(F.slice(values, F.lit(1), k).alias("value"), F.slice(errors, F.lit(1), k).alias("se")))

        return F.when(F.size(values) >= 2, tokens.let(tokens.paren_tokens(F.col("next_text")), zipped))

    out = both.select("paper_id", "page", "table_index", "row_index", F.inline(tokens.let(tokens.numeric_tokens(F.col("text")), against))).filter("se <> 0")
    return out.select("paper_id", "page", "table_index", "row_index", F.col("value.raw").alias("coef_raw"), F.col("value.value").alias("coef"), "se", (F.col("value.value") / F.col("se")).alias("t"), F.col("value.stars").alias("stars"))
