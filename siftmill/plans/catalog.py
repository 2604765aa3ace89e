"""Registered queries of the engine's own operators, each beside the SQL that must give the same rows.

Every query runs over the whole of its input. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill import fixed
from siftmill.functions import jsons, stats, text, tokens
from siftmill.operators import artifacts, corpus, grid, layout, pages, report, summary, tests
from siftmill.plans import fixtures as fx
from siftmill.session import table
from siftmill.sources import writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is its oracle after the fixtures that it ``needs``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = fx.oracle(sql, *needs)
        return f

    return add


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _count(pattern: str) -> str:
    """Oracle SQL for the number of hits of a Java pattern in ``text``."""
    return f"len(regexp_extract_all(text, '{_re2(pattern)}'))"


def _re2(pattern: str) -> str:
    flags, _, rest = pattern.partition(")")
    return (f"{flags.replace('U', '')}){rest}" if flags not in ("(?U",) else rest).replace("'", "''")


def _hits(patterns: tuple[str, ...] | str) -> str:
    return "(" + " + ".join(_count(p) for p in ([patterns] if isinstance(patterns, str) else patterns)) + ")"


def _snippets_sql(rows: str, keys: str, patterns: list[str], most: int, around: int, cut: int = 220) -> str:
    """Oracle SQL of common table expressions, the last of which (snips: keys, k, snippet) has what stands around hits; ``rows`` has keys and text."""
    each = " UNION ALL ".join(f"SELECT *, {i} AS nth, string_split_regex(text, {p}) AS between_, regexp_extract_all(text, {p}) AS found FROM {rows}" for i, p in enumerate(patterns))
    size = lambda x: f"CAST(coalesce(list_sum(list_transform({x}, lambda v: length(v))), 0) AS BIGINT)"
    return f"""split_ AS ({each}),
hit_ AS (SELECT *, unnest(range(1, len(found) + 1)) AS h FROM split_),
at_ AS (SELECT *, {size("between_[1:h]")} + {size("found[1:h - 1]")} AS start_ FROM hit_),
raw_ AS (SELECT *, trim(regexp_replace(substr(text, greatest(start_ - {around}, 0) + 1, start_ + length(found[h]) + {around} - greatest(start_ - {around}, 0)), '\\s+', ' ', 'g')) AS c FROM at_),
cut_ AS (SELECT *, CASE WHEN length(c) <= {cut} THEN c ELSE regexp_replace(c[1:{cut - 1}], '\\s+$', '') || '…' END AS snippet FROM raw_),
once_ AS (SELECT {keys}, min(nth * 1000000 + h) AS place, arg_min(snippet, nth * 1000000 + h) AS snippet FROM cut_ WHERE snippet <> '' GROUP BY {keys}, lower(snippet)),
snips AS (SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY place) - 1 AS INT) AS k, snippet FROM once_ QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY place) <= {most})"""


# --- windows and calipers over reconstructed tests -------------------------------------------

Z = fixed.Z_OF_P
SIDES = f"""
sided AS (SELECT *,
  CASE WHEN abs_t >= {1.96 - 0.20!r} AND abs_t <= 1.96 THEN -1 WHEN abs_t > 1.96 AND abs_t <= {1.96 + 0.20!r} THEN 1 ELSE 0 END AS s196,
  CASE WHEN abs_t >= {1.645 - 0.20!r} AND abs_t <= 1.645 THEN -1 WHEN abs_t > 1.645 AND abs_t <= {1.645 + 0.20!r} THEN 1 ELSE 0 END AS s1645,
  CASE WHEN abs_t >= {Z[0.05]!r} AND abs_t <= {Z[0.045]!r} THEN -1 WHEN abs_t < {Z[0.05]!r} AND abs_t >= {Z[0.055]!r} THEN 1 ELSE 0 END AS s05,
  CASE WHEN abs_t >= {Z[0.10]!r} AND abs_t <= {Z[0.095]!r} THEN -1 WHEN abs_t < {Z[0.10]!r} AND abs_t >= {Z[0.105]!r} THEN 1 ELSE 0 END AS s10
  FROM stat_tests)"""
PER_PAPER = f"""
counts AS (SELECT paper_id, count(*) AS tests, count(DISTINCT (page, table_index)) AS tables,
  count(*) FILTER (WHERE s196 = -1) AS t_1_96_left, count(*) FILTER (WHERE s196 = 1) AS t_1_96_right,
  count(*) FILTER (WHERE s1645 = -1) AS t_1_645_left, count(*) FILTER (WHERE s1645 = 1) AS t_1_645_right,
  count(*) FILTER (WHERE s05 = -1) AS p_0_05_left, count(*) FILTER (WHERE s05 = 1) AS p_0_05_right,
  count(*) FILTER (WHERE s10 = -1) AS p_0_10_left, count(*) FILTER (WHERE s10 = 1) AS p_0_10_right,
  count(*) FILTER (WHERE abs_t >= {Z[0.05]!r}) AS significant_0_05, count(*) FILTER (WHERE abs_t >= {Z[0.10]!r}) AS significant_0_10,
  count(*) FILTER (WHERE abs_t >= {Z[0.025]!r}) AS curve_low, count(*) FILTER (WHERE abs_t >= {Z[0.05]!r} AND abs_t < {Z[0.025]!r}) AS curve_high
  FROM sided GROUP BY paper_id)"""


def _z_sql(left: str, right: str) -> str:
    return f"CASE WHEN {left} + {right} <= 0 THEN 0.0 ELSE ({left} - {right}) / sqrt({left} + {right}) END"


# erfc to 1e-7, for p of more than 400 tests and for stored p-values
def _erfc_sql(z: str) -> str:
    t = f"(1 / (1 + 0.5 * ({z})))"
    poly = "-0.82215223 + {t} * 0.17087277"
    for c in (1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = f"{c} + {{t}} * ({poly})"
    return f"({t} * exp(-({z}) * ({z}) - 1.26551223 + {t} * ({poly.format(t=t)})))"


def _binomial_sql(k: str, n: str) -> str:
    exact = f"least(1.0, (SELECT sum(exp(lgamma({n} + 1) - lgamma(x + 1) - lgamma({n} - x + 1) - {n} * ln(2))) FROM (SELECT unnest(range(0, {n} + 1)) AS x) WHERE abs(x - {n} / 2.0) + 1e-12 >= abs({k} - {n} / 2.0)))"
    normal = _erfc_sql(f"abs(2 * {k} - {n}) / sqrt({n}) / sqrt(2)")
    return f"CASE WHEN {n} <= 0 THEN NULL WHEN {n} > 400 THEN {normal} ELSE {exact} END"


@query("flt1_window_sides", f"+{SIDES}\nSELECT s196, s1645, s05, s10, count(*) AS n FROM sided GROUP BY ALL", "stat_tests")
def _(spark, d):
    t = F.col("abs_t")
    made = fx.tests(spark, d, False).select(stats.side(t, 1.96, 0.20).alias("s196"), stats.side(t, 1.645, 0.20).alias("s1645"), stats.p_side(t, 0.05, 0.005).alias("s05"), stats.p_side(t, 0.10, 0.005).alias("s10"))
    return made.groupBy("s196", "s1645", "s05", "s10").agg(F.count("*").alias("n"))


@query("mth2_reconstructed_t", "SELECT paper_id, o, ln, pk, q, ep, round(coef / abs(paren), 9) AS t, round(abs_t, 9) AS abs_t FROM stat_tests", "stat_tests")
def _(spark, d):
    return fx.tests(spark, d, False).select("paper_id", "o", "ln", "pk", "q", "ep", _r("t", 9).alias("t"), _r("abs_t", 9).alias("abs_t"))


@query("mth1_p_approx", f"SELECT abs_t, round({_erfc_sql('abs_t / sqrt(2)')}, 5) AS p, count(*) AS n FROM stat_tests GROUP BY ALL", "stat_tests")
def _(spark, d):
    return fx.tests(spark, d).groupBy("abs_t", _r("p_approx_2s", 5).alias("p")).agg(F.count("*").alias("n"))


@query("agg1_window_counts", f"+{SIDES},{PER_PAPER}\nSELECT paper_id, tests, t_1_96_left, t_1_96_right, t_1_645_left, t_1_645_right, p_0_05_left, p_0_05_right, p_0_10_left, p_0_10_right FROM counts", "stat_tests")
def _(spark, d):
    made = tests.test_features(fx.tests(spark, d, False))
    return made.select("paper_id", "tests", *(f"{w}_{s}" for w, *_ in fixed.WINDOWS for s in ("left", "right")))


@query("agg1_stored_p_counts", f"+{SIDES},{PER_PAPER}\nSELECT paper_id, p_0_05_left, p_0_05_right, p_0_10_left, p_0_10_right, significant_0_05, significant_0_10, curve_low, curve_high FROM counts", "stat_tests")
def _(spark, d):
    made = tests.test_features(fx.tests(spark, d))
    return made.select("paper_id", "p_0_05_left", "p_0_05_right", "p_0_10_left", "p_0_10_right", "significant_0_05", "significant_0_10", "curve_low", "curve_high")


@query("agg3_significance", f"+{SIDES},{PER_PAPER}\nSELECT paper_id, significant_0_05, significant_0_10 FROM counts", "stat_tests")
def _(spark, d):
    return tests.test_features(fx.tests(spark, d, False)).select("paper_id", "significant_0_05", "significant_0_10")


@query("agg4_curve_halves", f"+{SIDES},{PER_PAPER}\nSELECT paper_id, curve_low, curve_high FROM counts", "stat_tests")
def _(spark, d):
    return tests.test_features(fx.tests(spark, d, False)).select("paper_id", "curve_low", "curve_high")


@query("agg5_caliper_z", f"+{SIDES},{PER_PAPER}\nSELECT paper_id, round({_z_sql('t_1_96_right', 't_1_96_left')}, 9) AS t_1_96_z, round({_z_sql('t_1_645_right', 't_1_645_left')}, 9) AS t_1_645_z, round({_z_sql('p_0_05_left', 'p_0_05_right')}, 9) AS p_0_05_z, round({_z_sql('p_0_10_left', 'p_0_10_right')}, 9) AS p_0_10_z FROM counts", "stat_tests")
def _(spark, d):
    return tests.test_features(fx.tests(spark, d, False)).select("paper_id", *(_r(f"{w}_z", 9).alias(f"{w}_z") for w, *_ in fixed.WINDOWS))


@query("agg6_binomial_p", f"+{SIDES},{PER_PAPER}\nSELECT paper_id, round({_binomial_sql('t_1_96_left', '(t_1_96_left + t_1_96_right)')}, 6) AS t_1_96_p, round({_binomial_sql('p_0_05_left', '(p_0_05_left + p_0_05_right)')}, 6) AS p_0_05_p FROM counts", "stat_tests")
def _(spark, d):
    return tests.test_features(fx.tests(spark, d, False)).select("paper_id", _r("t_1_96_p").alias("t_1_96_p"), _r("p_0_05_p").alias("p_0_05_p"))


@query("agg7_curve_skew", f"+{SIDES},{PER_PAPER}\nSELECT paper_id, round({_z_sql('curve_low', 'curve_high')}, 9) AS curve_z, round({_binomial_sql('curve_low', '(curve_low + curve_high)')}, 5) AS curve_p FROM counts", "stat_tests")
def _(spark, d):
    return tests.test_features(fx.tests(spark, d, False)).select("paper_id", _r("curve_z", 9).alias("curve_z"), _r("curve_p", 5).alias("curve_p"))


@query("agg14_distinct_tables", "SELECT paper_id, count(DISTINCT (page, table_index)) AS tables FROM stat_tests GROUP BY 1", "stat_tests")
def _(spark, d):
    return tests.test_features(fx.tests(spark, d, False)).select("paper_id", "tables")


@query("agg26_bunching_ratio", f"+{SIDES},{PER_PAPER}\nSELECT paper_id, round(CASE WHEN t_1_96_left + t_1_96_right > 0 THEN (t_1_96_left - t_1_96_right) / (t_1_96_left + t_1_96_right) ELSE 0.0 END, 9) AS ratio FROM counts", "stat_tests")
def _(spark, d):
    return tests.test_features(fx.tests(spark, d, False)).select("paper_id", _r(stats.normalized_ratio(F.col("t_1_96_left"), F.col("t_1_96_right")), 9).alias("ratio"))


@query("flt12_exactly_two", "SELECT paper_id, count(*) FILTER (WHERE abs(abs_t - 1.96) <= 0.20 AND abs(abs_t - 2.0) < 1e-9) AS exact_2 FROM stat_tests GROUP BY 1", "stat_tests")
def _(spark, d):
    return summary.paper_summary(fx.tests(spark, d)).select("paper_id", "exact_2")


def _score_sql() -> str:
    z = {"p_0_05_z": _z_sql("p_0_05_left", "p_0_05_right"), "p_0_10_z": _z_sql("p_0_10_left", "p_0_10_right"), "t_1_96_z": _z_sql("t_1_96_right", "t_1_96_left"), "t_1_645_z": _z_sql("t_1_645_right", "t_1_645_left"), "curve_z": _z_sql("curve_low", "curve_high")}
    total = str(fixed.BASE_SCORE)
    for name, weight in fixed.Z_WEIGHTS.items():
        total += f" + {abs(weight)} * least(1.0, greatest(0.0, {'-' if weight < 0 else ''}({z[name]}) / 3))"
    return total


TERMS_SQL = f"""
terms AS (SELECT paper_id, {", ".join(f"CAST(sum({_hits(p)}) AS BIGINT) AS {n}" for n, p in (("robust_terms", fixed.ROBUST), ("specification_terms", fixed.SPECIFICATION), ("multiple_testing_terms", fixed.MULTIPLE_TESTING), ("table_mentions", fixed.TABLE)))},
  CAST(sum(length(text) - length(replace(text, '*', ''))) AS BIGINT) AS star_count FROM page_texts GROUP BY 1)"""


@query("cmp6_risk_score", f"+{SIDES},{PER_PAPER},{TERMS_SQL}\nSELECT c.paper_id, tests, CAST(round_even(greatest(0.0, least(100.0, {_score_sql()} + 12 * least(1.0, coalesce(robust_terms, 0) / 10.0) + 10 * least(1.0, coalesce(specification_terms, 0) / 8.0) + 8 * least(1.0, coalesce(multiple_testing_terms, 0) / 4.0) - CASE WHEN coalesce(multiple_testing_terms, 0) > 0 THEN 12 ELSE 0 END)), 0) AS INT) AS risk_score FROM counts c LEFT JOIN terms t ON c.paper_id = t.paper_id", "stat_tests", "page_texts")
def _(spark, d):
    terms = fx.fixture(spark, d, "page_texts").groupBy("paper_id").agg(*(F.sum(text.hits(F.col("text"), p)).alias(n) for n, p in (("robust_terms", fixed.ROBUST), ("specification_terms", fixed.SPECIFICATION), ("multiple_testing_terms", fixed.MULTIPLE_TESTING))))
    counted = tests.test_features(fx.tests(spark, d, False)).join(terms, "paper_id", "left")
    return tests.risk_score(counted).select("paper_id", "tests", "risk_score")


@query("mth5_risk_levels", f"+{SIDES},{PER_PAPER},\nscored AS (SELECT paper_id, round_even({_score_sql()}, 0) AS s FROM counts)\nSELECT paper_id, CASE WHEN s >= 70 THEN 'High' WHEN s >= 40 THEN 'Moderate' ELSE 'Low' END AS risk_level, CASE WHEN s >= 67 THEN 'High' WHEN s >= 34 THEN 'Moderate' ELSE 'Low' END AS expert_level FROM scored", "stat_tests")
def _(spark, d):
    made = tests.risk_score(tests.test_features(fx.tests(spark, d, False)))
    return made.select("paper_id", "risk_level", stats.risk_level(F.col("risk_score"), fixed.EXPERT_LEVELS).alias("expert_level"))


# --- cells and pairs ----------------------------------------------------------------------------

# what the fixture's cells hold, from the numbers that they were made of
TRUE_PAIRS = """
pairs AS (SELECT paper_id, page, table_index, CAST(2 * pair AS INT) AS row_index, kind, c, q,
  CASE kind WHEN 0 THEN c * 7 / 100.0 WHEN 1 THEN c * 7 / 100.0 WHEN 2 THEN c WHEN 3 THEN 2000 + c WHEN 6 THEN -(c + 0.1) ELSE c * 1000 + 234 END AS coef,
  CASE kind WHEN 0 THEN q / 100.0 WHEN 1 THEN q / 100.0 WHEN 2 THEN c + 1 WHEN 3 THEN q / 100.0 WHEN 6 THEN -q / 100.0 ELSE 45 + q END AS paren,
  CASE WHEN kind = 0 THEN 1 + c % 3 ELSE 0 END AS stars, CASE WHEN kind IN (1, 2) THEN 'same_cell' ELSE 'next_row_same_col' END AS paren_source
  FROM grid WHERE kind NOT IN (4, 5))"""
KEPT = """made AS (SELECT *, CASE WHEN by_t THEN paren ELSE coef / abs(paren) END AS t, CASE WHEN kind = 2 THEN 'column_label_like' END AS r1, CASE WHEN kind = 3 THEN 'coef_looks_like_year' END AS r2,
  CASE WHEN NOT by_t AND abs(paren) > 50 THEN 'se_gt_50' END AS r3, CASE WHEN NOT by_t AND abs(coef / paren) > 80 THEN 'abs_t_gt_80(coef_over_se)' END AS r4, CASE WHEN by_t AND abs(paren) > 30 THEN 'abs_t_gt_30(paren_t)' END AS r5
  FROM (SELECT p.*, coalesce(mode_text, mode_values, 'se') = 't' AS by_t FROM pairs p LEFT JOIN said USING (paper_id) LEFT JOIN sized USING (paper_id)))"""


@query("str5_first_coefficients", f"+{TRUE_PAIRS}\nSELECT paper_id, page, table_index, row_index, round(coef, 6) AS coef, CAST(stars AS INT) AS stars FROM pairs", "grid")
def _(spark, d):
    made = fx.fixture(spark, d, "cells").withColumn("cell", tokens.normal_cell(F.col("cell_text"))).filter(tokens.usable(F.col("cell")))
    return made.select("paper_id", "page", "table_index", "row_index", tokens.first_coefficient(F.col("cell")).alias("c")).filter("c IS NOT NULL").select("paper_id", "page", "table_index", "row_index", _r("c.value").alias("coef"), F.col("c.stars").alias("stars"))


# what every cell holds, numbers or not
ALL_CELLS = """every AS (SELECT paper_id, page, table_index, CAST(2 * pair AS INT) AS row_index,
  CASE kind WHEN 0 THEN '0.' || lpad(CAST(c * 7 AS STRING), 2, '0') || repeat('*', 1 + c % 3) WHEN 1 THEN '0.' || lpad(CAST(c * 7 AS STRING), 2, '0') || ' (0.' || lpad(CAST(q AS STRING), 2, '0') || ')'
  WHEN 2 THEN CAST(c AS STRING) || ') (' || CAST(c + 1 AS STRING) || ')' WHEN 3 THEN CAST(2000 + c AS STRING) WHEN 4 THEN '12 (3): 45' || CAST(c AS STRING) WHEN 5 THEN 'Controls ' || CAST(c AS STRING)
  WHEN 6 THEN '-' || CAST(c AS STRING) || '.10' ELSE CAST(c AS STRING) || '234' END AS cell,
  CASE kind WHEN 0 THEN ['0.' || lpad(CAST(c * 7 AS STRING), 2, '0') || repeat('*', 1 + c % 3)] WHEN 1 THEN ['0.' || lpad(CAST(c * 7 AS STRING), 2, '0'), '0.' || lpad(CAST(q AS STRING), 2, '0')]
  WHEN 2 THEN [CAST(c AS STRING), CAST(c + 1 AS STRING)] WHEN 3 THEN [CAST(2000 + c AS STRING)] WHEN 4 THEN ['12', '3', '45' || CAST(c AS STRING)] WHEN 5 THEN [CAST(c AS STRING)]
  WHEN 6 THEN ['-' || CAST(c AS STRING) || '.10'] ELSE [CAST(c AS STRING) || '234'] END AS raws,
  CASE kind WHEN 1 THEN q / 100.0 WHEN 2 THEN c + 1 WHEN 4 THEN 3 END AS paren, kind <> 4 AS usable FROM grid
UNION ALL SELECT paper_id, page, table_index, CAST(2 * pair + 1 AS INT) AS row_index,
  CASE kind WHEN 6 THEN '-(0.' || lpad(CAST(q AS STRING), 2, '0') || ')' WHEN 7 THEN '(' || CAST(45 + q AS STRING) || ')' WHEN 0 THEN '(0.' || lpad(CAST(q AS STRING), 2, '0') || ')' WHEN 3 THEN '(0.' || lpad(CAST(q AS STRING), 2, '0') || ')' ELSE '' END AS cell,
  CASE WHEN kind IN (0, 3, 6) THEN ['0.' || lpad(CAST(q AS STRING), 2, '0')] WHEN kind = 7 THEN [CAST(45 + q AS STRING)] ELSE CAST([] AS STRING[]) END AS raws,
  CASE WHEN kind IN (0, 3) THEN q / 100.0 WHEN kind = 6 THEN -q / 100.0 WHEN kind = 7 THEN 45 + q END AS paren, true AS usable FROM grid)"""


def _all_cells(spark: SparkSession, d: str) -> DataFrame:
    return fx.fixture(spark, d, "cells").select("paper_id", "page", "table_index", "row_index", tokens.normal_cell(F.col("cell_text")).alias("cell"))


@query("str1_normal_cells", f"+{ALL_CELLS}\nSELECT paper_id, page, table_index, row_index, cell FROM every", "grid")
def _(spark, d):
    return _all_cells(spark, d)


@query("str3_numeric_tokens", f"+{ALL_CELLS}\nSELECT paper_id, page, table_index, row_index, raw, round(CAST(rtrim(raw, '*') AS DOUBLE), 6) AS value, CAST(length(raw) - length(rtrim(raw, '*')) AS INT) AS stars FROM (SELECT *, unnest(raws) AS raw FROM every)", "grid")
def _(spark, d):
    found = _all_cells(spark, d).select("paper_id", "page", "table_index", "row_index", F.inline(tokens.numeric_tokens(F.col("cell"))))
    return found.select("paper_id", "page", "table_index", "row_index", "raw", _r("value").alias("value"), "stars")


@query("str4_paren_tokens", f"+{ALL_CELLS}\nSELECT paper_id, page, table_index, row_index, round(paren, 6) AS paren FROM every WHERE paren IS NOT NULL", "grid")
def _(spark, d):
    found = _all_cells(spark, d).select("paper_id", "page", "table_index", "row_index", F.explode(tokens.paren_tokens(F.col("cell"))).alias("paren"))
    return found.withColumn("paren", _r("paren"))


@query("str6_first_paren", f"+{ALL_CELLS}\nSELECT paper_id, page, table_index, row_index, round(paren, 6) AS paren FROM every WHERE usable AND paren IS NOT NULL", "grid")
def _(spark, d):
    made = _all_cells(spark, d).filter(tokens.usable(F.col("cell")))
    return made.select("paper_id", "page", "table_index", "row_index", _r(tokens.first_paren(F.col("cell"))).alias("paren")).filter("paren IS NOT NULL")


@query("flt4_numeric_ratio", "SELECT row_index, cell_text, round(CASE WHEN length(replace(cell_text, ' ', '')) = 0 THEN 0.0 ELSE len(regexp_extract_all(cell_text, '[0-9.+*(),%-]')) / length(replace(cell_text, ' ', '')) END, 9) AS ratio, count(*) AS n FROM cells GROUP BY ALL", "cells")
def _(spark, d):
    return fx.fixture(spark, d, "cells").groupBy("row_index", "cell_text", _r(tokens.numeric_ratio(F.col("cell_text")), 9).alias("ratio")).agg(F.count("*").alias("n"))


@query("flt5_year_like", "SELECT l_partkey, 1700 + l_partkey % 500 + 0.5 AS x, round_even(1700 + l_partkey % 500 + 0.5, 0) BETWEEN 1800 AND 2100 AS year_like, count(*) AS n FROM lineitem GROUP BY ALL", "stat_tests")
def _(spark, d):
    x = F.lit(1700) + F.col("l_partkey") % 500 + F.lit(0.5).cast("double")
    return table(spark, d, "lineitem").groupBy("l_partkey", x.alias("x")).agg(F.count("*").alias("n")).withColumn("year_like", stats.year_like(F.col("x")))


@query("flt6_citation_cells", "SELECT paper_id, page, table_index, CAST(2 * pair AS INT) AS row_index FROM grid WHERE kind = 4", "grid")
def _(spark, d):
    return fx.fixture(spark, d, "cells").filter(tokens.citation_like(F.col("cell_text"))).select("paper_id", "page", "table_index", "row_index")


@query("flt7_label_pairs", f"+{TRUE_PAIRS}\nSELECT paper_id, page, table_index, row_index FROM pairs WHERE kind = 2", "grid")
def _(spark, d):
    return tests.pairs(fx.cells(spark, d)).filter(tests.is_label_pair()).select("paper_id", "page", "table_index", "row_index")


@query("jn5_next_row_cells", "SELECT paper_id, page, table_index, row_index, cell_text, lead(cell_text) OVER (PARTITION BY paper_id, page, table_index, col_index ORDER BY row_index) AS next_cell FROM cells", "cells")
def _(spark, d):
    below = Window.partitionBy("paper_id", "page", "table_index", "col_index").orderBy("row_index")
    return fx.fixture(spark, d, "cells").select("paper_id", "page", "table_index", "row_index", "cell_text", F.lead("cell_text").over(below).alias("next_cell"))


@query("cmp3_pairs", f"+{TRUE_PAIRS}\nSELECT paper_id, page, table_index, row_index, round(coef, 6) AS coef, round(paren, 6) AS paren, CAST(stars AS INT) AS stars, paren_source FROM pairs", "grid")
def _(spark, d):
    return tests.pairs(fx.cells(spark, d)).select("paper_id", "page", "table_index", "row_index", _r("coef").alias("coef"), _r("paren").alias("paren"), "stars", "paren_source")


UPPER_MEDIAN = """
sizes AS (SELECT paper_id, abs(paren) AS v FROM pairs WHERE kind <> 2 AND paren <> 0 AND abs(paren) <= 50 AND NOT (round_even(abs(paren), 0) BETWEEN 1800 AND 2100)),
mids AS (SELECT paper_id, count(*) AS n, list_sort(list(v))[CAST(count(*) // 2 + 1 AS BIGINT)] AS median FROM sizes GROUP BY 1)"""
MODE = "CASE WHEN n >= 15 THEN CASE WHEN median >= 1.5 THEN 't' ELSE 'se' END WHEN n >= 8 AND median >= 2.5 THEN 't' WHEN n >= 8 AND median <= 0.8 THEN 'se' END"


@query("agg17_mode_by_values", f"+{TRUE_PAIRS},{UPPER_MEDIAN}\nSELECT paper_id, n, round(median, 6) AS median, {MODE} AS mode_values FROM mids", "grid")
def _(spark, d):
    raw = tests.pairs(fx.cells(spark, d)).filter(~tests.is_label_pair())
    return tests.mode_by_values(raw.select("paper_id", "paren")).select("paper_id", "n", _r("median").alias("median"), "mode_values")


T_SQL, SE_SQL = (f"CAST(sum({_hits(p)}) AS BIGINT)" for p in (fixed.PAREN_T_PATTERNS, fixed.PAREN_SE_PATTERNS))


@query("agg16_mode_by_text", f"SELECT paper_id, CASE WHEN {T_SQL} > {SE_SQL} THEN 't' WHEN {SE_SQL} > {T_SQL} THEN 'se' END AS mode_text FROM page_texts GROUP BY 1", "page_texts")
def _(spark, d):
    return tests.text_modes(fx.fixture(spark, d, "page_texts"))


SAID = f"said AS (SELECT paper_id, CASE WHEN {T_SQL} > {SE_SQL} THEN 't' WHEN {SE_SQL} > {T_SQL} THEN 'se' END AS mode_text FROM page_texts GROUP BY 1)"
JUDGED = f"{TRUE_PAIRS},{UPPER_MEDIAN},\n{SAID},\nsized AS (SELECT paper_id, {MODE} AS mode_values FROM mids),\n{KEPT}"
IS_TEST = " AND ".join(f"r{k} IS NULL" for k in range(1, 6))


def _reconstructed(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of all papers with cells, read as their own pages and numbers say; papers without pages have none to say it."""
    raw = tests.pairs(fx.cells(spark, d))
    silent = fx.fixture(spark, d, "grid").select("paper_id").distinct().select("paper_id", F.lit(0).alias("page"), F.lit(None).cast("string").alias("text"))
    return tests.reconstruct(raw, tests.paren_modes(raw, fx.fixture(spark, d, "page_texts").select("paper_id", "page", "text").unionByName(silent)))


@query("cmp4_tests", f"+{JUDGED}\nSELECT paper_id, page, table_index, row_index, round(t, 6) AS t, CASE WHEN NOT by_t THEN round(abs(paren), 6) END AS se, CASE WHEN by_t THEN 'paren_t' ELSE 'coef_over_se' END AS t_mode FROM made WHERE {IS_TEST}", "grid", "page_texts")
def _(spark, d):
    return tests.kept(_reconstructed(spark, d)).select("paper_id", "page", "table_index", "row_index", _r("t").alias("t"), _r("se").alias("se"), "t_mode")


@query("agg15_drop_reasons", f"+{JUDGED}\nSELECT paper_id, reason, count(*) AS n FROM (SELECT paper_id, unnest([r1, r2, r3, r4, r5]) AS reason FROM made) WHERE reason IS NOT NULL GROUP BY ALL", "grid", "page_texts")
def _(spark, d):
    return tests.reason_counts(_reconstructed(spark, d))


@query("agg19_keep_rate", f"+{JUDGED}\nSELECT paper_id, round(count(*) FILTER (WHERE {IS_TEST}) / count(*), 9) AS keep_rate FROM made GROUP BY 1", "grid", "page_texts")
def _(spark, d):
    return _reconstructed(spark, d).groupBy("paper_id").agg(_r(F.try_divide(F.count_if(F.size("reasons") == 0), F.count("*")), 9).alias("keep_rate"))


@query("agg18_paren_modes", f"+{TRUE_PAIRS},{UPPER_MEDIAN},\nsaid AS (SELECT paper_id, CASE WHEN {T_SQL} > {SE_SQL} THEN 't' WHEN {SE_SQL} > {T_SQL} THEN 'se' END AS mode_text FROM page_texts GROUP BY 1)\nSELECT s.paper_id, coalesce(mode_text, {MODE}, 'se') AS paren_mode, CASE WHEN mode_text IS NOT NULL THEN 'text' WHEN {MODE} IS NOT NULL THEN 'values' ELSE 'default' END AS paren_mode_source FROM said s LEFT JOIN mids m ON s.paper_id = m.paper_id", "grid", "page_texts")
def _(spark, d):
    return tests.paren_modes(tests.pairs(fx.cells(spark, d)), fx.fixture(spark, d, "page_texts"))


@query("win6_first_tests", "SELECT paper_id, o, ln, pk, q, ep, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY o, ln, pk, sk, q, ep, sd) AS rank FROM stat_tests) WHERE rank <= 50", "stat_tests")
def _(spark, d):
    return tests.first_of_each(fx.tests(spark, d, False), 50, list(fx.SEQ)).select("paper_id", "o", "ln", "pk", "q", "ep", "rank")


@query("agg25_row_pairs", """+rows AS (SELECT paper_id, page, table_index, pair, c, q FROM grid)
SELECT paper_id, page, table_index, CAST(2 * pair AS INT) AS row_index, round(unnest([c * 7 / 100.0, c * 3 / 100.0]), 6) AS coef, round(unnest([q / 100.0, (q + 1) / 100.0]), 6) AS se FROM rows""", "grid")
def _(spark, d):
    two = lambda n: F.lpad((F.col("c") * n).cast("string"), 2, "0")
    g = fx.fixture(spark, d, "grid").repartition("paper_id", "page", "table_index")  # dealt while narrow, and numbered once for both rows
    upper = F.struct((2 * F.col("pair")).cast("int").alias("row_index"), F.concat(F.lit("x 0."), two(7), F.lit("* 0."), two(3)).alias("row_text"))
    lower = F.struct((2 * F.col("pair") + 1).cast("int").alias("row_index"), F.concat(F.lit("(0."), F.lpad(F.col("q").cast("string"), 2, "0"), F.lit(") (0."), F.lpad((F.col("q") + 1).cast("string"), 2, "0"), F.lit(")")).alias("row_text"))
    return tests.row_pairs(g.select("paper_id", "page", "table_index", F.inline(F.array(upper, lower)))).select("paper_id", "page", "table_index", "row_index", _r("coef").alias("coef"), _r("se").alias("se"))


# --- page text ------------------------------------------------------------------------------------

DIGITS = "len(regexp_extract_all(text, '[0-9]'))"
STARS = "length(text) - length(replace(text, '*', ''))"
REFERENCE = f"(regexp_matches(text, '(?im)^\\s*(references|bibliography)\\b') OR (regexp_matches(text, '(?i)\\breferences\\b') AND ({_count(fixed.PAREN_YEAR)} >= 12 OR {_count(fixed.LINK)} >= 3)) OR ({_count(fixed.PAREN_YEAR)} >= 25 AND {_count(fixed.LINK)} >= 2))"
TRIAGE = f"triage AS (SELECT paper_id, page, {DIGITS} AS digit_count, {STARS} AS star_count, {_count(fixed.TABLE)} AS table_mentions, {_count(fixed.ROBUST)} AS robust_mentions, {_count(fixed.P_MENTION_TRIAGE)} AS p_mentions, {REFERENCE} AS is_reference FROM page_texts),\nscored AS (SELECT *, digit_count / 2000.0 + 0.8 * table_mentions + 0.25 * robust_mentions + 0.02 * star_count + 0.5 * p_mentions - CASE WHEN is_reference THEN 1.5 ELSE 0 END AS score FROM triage)"


@query("cmp1_triage_scores", f"+{TRIAGE}\nSELECT paper_id, page, digit_count, star_count, table_mentions, robust_mentions, p_mentions, round(score, 6) AS score FROM scored", "page_texts")
def _(spark, d):
    return pages.triage_scores(fx.fixture(spark, d, "page_texts")).select("paper_id", "page", *(F.col(c).cast("long").alias(c) for c in ("digit_count", "star_count", "table_mentions", "robust_mentions", "p_mentions")), _r("score").alias("score"))


@query("flt2_reference_pages", f"SELECT paper_id, page FROM page_texts WHERE {REFERENCE}", "page_texts")
def _(spark, d):
    return fx.fixture(spark, d, "page_texts").filter(text.reference_page(F.col("text"))).select("paper_id", "page")


AGENT = f"agent AS (SELECT paper_id, page, {DIGITS} AS digit_count, {STARS} AS star_count, {_count(fixed.TABLE)} AS table_mentions, {_count(fixed.ROBUST_AGENT)} AS robust_mentions, {_count(fixed.P_MENTION_AGENT)} AS p_mentions, regexp_matches(text, '{_re2(fixed.TABLE_WORDS)}') AS words, regexp_matches(lower(text), 'references|bibliography') AS refs FROM page_texts),\nscored AS (SELECT *, 3.0 * table_mentions + 2.0 * robust_mentions + 1.5 * p_mentions + 0.004 * digit_count + 0.02 * star_count + CASE WHEN words THEN 1 ELSE 0 END AS score, refs AND table_mentions = 0 AND p_mentions = 0 AND star_count < 10 AS refs_like FROM agent)"


@query("cmp2_report_scores", f"+{AGENT}\nSELECT paper_id, page, table_mentions, robust_mentions, p_mentions, round(score, 6) AS score FROM scored", "page_texts")
def _(spark, d):
    return pages.report_scores(fx.fixture(spark, d, "page_texts")).select("paper_id", "page", *(F.col(c).cast("long").alias(c) for c in ("table_mentions", "robust_mentions", "p_mentions")), _r("score").alias("score"))


@query("flt3_references_like", f"+{AGENT}\nSELECT paper_id, page FROM scored WHERE refs_like", "page_texts")
def _(spark, d):
    return pages.report_scores(fx.fixture(spark, d, "page_texts")).filter(pages.references_like()).select("paper_id", "page")


@query("top1_triage_pages", f"""+{TRIAGE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY round(score, 9) DESC, page) AS place FROM scored WHERE page = 1 OR NOT is_reference),
picked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN page = 1 AND place > 12 THEN 0 ELSE 1 END, place) AS rank FROM ranked WHERE place <= 12 OR page = 1)
SELECT paper_id, page, CAST(rank AS INT) AS rank FROM picked WHERE rank <= 12""", "page_texts")
def _(spark, d):
    scored = pages.triage_scores(fx.fixture(spark, d, "page_texts")).withColumn("score", F.round("score", 9))
    return pages.triage_pages(scored, 12).select("paper_id", "page", "rank")


@query("top2_report_pages", f"""+{AGENT},
ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN page = 1 THEN 0 ELSE 1 END, round(score, 9) DESC, page) AS rank FROM scored WHERE page = 1 OR NOT refs_like)
SELECT paper_id, page, CASE WHEN page = 1 THEN 'title/abstract' ELSE 'auto_pick' END AS role, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 8""", "page_texts")
def _(spark, d):
    scored = pages.report_scores(fx.fixture(spark, d, "page_texts")).withColumn("score", F.round("score", 9))
    return pages.report_pages(scored, 8).select("paper_id", "page", "role", "rank")


QUERIES["win4_page_ranks"], ORACLES["win4_page_ranks"] = QUERIES["top1_triage_pages"], ORACLES["top1_triage_pages"]


@query("agg8_term_counts", f"+{TERMS_SQL}\nSELECT * FROM terms", "page_texts")
def _(spark, d):
    made = tests.text_features(fx.fixture(spark, d, "page_texts"))
    return made.select("paper_id", *(F.col(c).cast("long").alias(c) for c in ("robust_terms", "specification_terms", "multiple_testing_terms", "table_mentions", "star_count")))


P_VALUES = " UNION ALL ".join(f"SELECT paper_id, CAST(unnest(regexp_extract_all(text, '{_re2(p)}', 1)) AS DOUBLE) AS p FROM page_texts" for p in fixed.P_VALUE_PATTERNS)


@query("agg9_written_p_values", f"SELECT paper_id, p, count(*) AS n FROM ({P_VALUES}) WHERE p BETWEEN 0 AND 1 GROUP BY ALL", "page_texts")
def _(spark, d):
    return fx.fixture(spark, d, "page_texts").select("paper_id", F.explode(text.p_values(F.col("text"))).alias("p")).groupBy("paper_id", "p").agg(F.count("*").alias("n"))


@query("agg2_bin_counts", f"SELECT paper_id, CAST(count(*) FILTER (WHERE p >= 0.045 AND p <= 0.05) AS BIGINT) AS p05_left, CAST(count(*) FILTER (WHERE p > 0.05 AND p <= 0.055) AS BIGINT) AS p05_right, CAST(count(*) FILTER (WHERE p >= 0.095 AND p <= 0.10) AS BIGINT) AS p10_left, CAST(count(*) FILTER (WHERE p > 0.10 AND p <= 0.105) AS BIGINT) AS p10_right FROM ({P_VALUES}) GROUP BY 1", "page_texts")
def _(spark, d):
    made = tests.text_features(fx.fixture(spark, d, "page_texts")).filter("p_values_found > 0")
    return made.select("paper_id", F.col("text_p_0_05.left").alias("p05_left"), F.col("text_p_0_05.right").alias("p05_right"), F.col("text_p_0_10.left").alias("p10_left"), F.col("text_p_0_10.right").alias("p10_right"))


COUNTED = ("tests", "tables", "t_1_96_left", "t_1_96_right", "t_1_645_left", "t_1_645_right", "p_0_05_left", "p_0_05_right", "p_0_10_left", "p_0_10_right", "significant_0_05", "significant_0_10", "curve_low", "curve_high")
TERMS = ("robust_terms", "specification_terms", "multiple_testing_terms", "table_mentions", "star_count")


@query("cmp5_paper_features", f"""+{TRUE_PAIRS},{UPPER_MEDIAN},{TERMS_SQL},
said AS (SELECT paper_id, CASE WHEN {T_SQL} > {SE_SQL} THEN 't' WHEN {SE_SQL} > {T_SQL} THEN 'se' END AS mode_text FROM page_texts GROUP BY 1),
modes AS (SELECT s.paper_id, coalesce(mode_text, {MODE}, 'se') AS paren_mode, CASE WHEN mode_text IS NOT NULL THEN 'text' WHEN {MODE} IS NOT NULL THEN 'values' ELSE 'default' END AS paren_mode_source FROM said s LEFT JOIN mids m ON s.paper_id = m.paper_id),
timed AS (SELECT p.*, paren_mode, CASE WHEN paren_mode = 't' THEN paren ELSE coef / abs(paren) END AS t FROM pairs p JOIN modes USING (paper_id)),
judged AS (SELECT *, abs(t) AS abs_t, kind <> 2 AND kind <> 3 AND CASE WHEN paren_mode = 't' THEN abs(t) <= 30 ELSE abs(paren) <= 50 AND abs(t) <= 80 END AS ok FROM timed),
raws AS (SELECT paper_id, count(*) AS pairs_raw, count(DISTINCT (page, table_index)) AS tables_raw FROM judged GROUP BY 1),
oks AS (SELECT * FROM judged WHERE ok),{SIDES.replace("stat_tests", "oks")},{PER_PAPER},
written AS (SELECT paper_id, count(*) AS p_values_found FROM ({{P_VALUES}}) WHERE p BETWEEN 0 AND 1 GROUP BY 1),
filled AS (SELECT m.paper_id, paren_mode, paren_mode_source, coalesce(pairs_raw, 0) AS pairs_raw, coalesce(tables_raw, 0) AS tables_raw, {", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTED)}, {", ".join(TERMS)}, coalesce(p_values_found, 0) AS p_values_found
  FROM modes m JOIN terms USING (paper_id) LEFT JOIN raws USING (paper_id) LEFT JOIN counts USING (paper_id) LEFT JOIN written USING (paper_id))
SELECT *, round(CASE WHEN pairs_raw > 0 THEN tests / pairs_raw END, 9) AS keep_rate, CAST(round_even(greatest(0.0, least(100.0, {_score_sql()} + 12 * least(1.0, robust_terms / 10.0) + 10 * least(1.0, specification_terms / 8.0) + 8 * least(1.0, multiple_testing_terms / 4.0) - CASE WHEN multiple_testing_terms > 0 THEN 12 ELSE 0 END)), 0) AS INT) AS risk_score FROM filled""".replace("{P_VALUES}", P_VALUES), "grid", "page_texts")
def _(spark, d):
    texts, raw = fx.fixture(spark, d, "page_texts"), tests.pairs(fx.cells(spark, d))
    modes = tests.paren_modes(raw, texts)
    made = tests.paper_features(texts.select("paper_id").distinct(), texts, tests.reconstruct(raw, modes), modes)
    whole = ("pairs_raw", "tables_raw", *COUNTED, *TERMS, "p_values_found")
    return made.select("paper_id", "paren_mode", "paren_mode_source", *(F.col(c).cast("long").alias(c) for c in whole), _r("keep_rate", 9).alias("keep_rate"), "risk_score")


@query("top9_p_samples", f"SELECT paper_id, array_to_string(list_transform(list_sort(list(p))[1:30], lambda v: CAST(CAST(round(v * 1000) AS INT) AS STRING)), ' ') AS sample FROM ({P_VALUES}) GROUP BY 1", "page_texts")
def _(spark, d):
    made = tests.text_features(fx.fixture(spark, d, "page_texts")).filter("p_values_found > 0")
    return made.select("paper_id", F.concat_ws(" ", F.transform(text.p_sample(F.col("p_values")), lambda v: F.round(v * 1000).cast("int").cast("string"))).alias("sample"))


CAPTIONS = """
own AS (SELECT paper_id, page, nullif(regexp_extract(text, '(?im)^(table\\s+[a-z]{0,3}\\d+[\\.:]\\s*.+)$', 1), '') AS line_t, nullif(regexp_extract(text, '(?im)^(figure\\s+[a-z]{0,3}\\d+[\\.:]\\s*.+)$', 1), '') AS line_f, regexp_matches(lower(text), 'panel [abc]') AS panel FROM page_texts),
named AS (SELECT *, regexp_replace(line_t, '^(?i:table)\\s+(\\w+)[\\.:]\\s*(.+)$', 'Table \\1. \\2') AS cap_t, regexp_replace(line_f, '^(?i:figure)\\s+(\\w+)[\\.:]\\s*(.+)$', 'Figure \\1. \\2') AS cap_f FROM own),
carried AS (SELECT paper_id, page,
  coalesce(cap_t, CASE WHEN panel THEN last_value(cap_t IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END) AS cap_t,
  coalesce(cap_f, CASE WHEN panel THEN last_value(cap_f IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END) AS cap_f FROM named),
captions AS (SELECT paper_id, page, 'table' AS kind, cap_t AS caption FROM carried WHERE cap_t IS NOT NULL UNION ALL SELECT paper_id, page, 'figure' AS kind, cap_f AS caption FROM carried WHERE cap_f IS NOT NULL)"""


def _captions(spark: SparkSession, d: str) -> DataFrame:
    texts = fx.fixture(spark, d, "page_texts")
    return pages.captions(texts, "table").unionByName(pages.captions(texts, "figure"))


@query("win1_captions", f"+{CAPTIONS}\nSELECT * FROM captions", "page_texts")
def _(spark, d):
    return _captions(spark, d)


INVENTORY = """
ids AS (SELECT *, CASE kind WHEN 'table' THEN 'Table ' ELSE 'Figure ' END || regexp_extract(caption, '^\\w+ (\\w+)', 1) AS id FROM captions),
items AS (SELECT paper_id, kind, id, arg_min(caption, page) AS caption, list_sort(list(DISTINCT page)) AS pages FROM ids GROUP BY ALL),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY pages[1], CASE kind WHEN 'table' THEN 0 ELSE 1 END, id) AS INT) AS place FROM items)"""


@query("cmp9_inventory", f"+{CAPTIONS},{INVENTORY}\nSELECT paper_id, kind, id, caption, len(pages) AS n_pages, pages[1] AS first_page, place FROM placed", "page_texts")
def _(spark, d):
    return artifacts.inventory(_captions(spark, d)).select("paper_id", "kind", "id", "caption", F.size("pages").cast("long").alias("n_pages"), F.col("pages")[0].alias("first_page"), "place")


@query("top6_capped_inventory", f"+{CAPTIONS},{INVENTORY}\nSELECT paper_id, kind, id, place FROM placed WHERE place <= 3", "page_texts")
def _(spark, d):
    return artifacts.inventory(_captions(spark, d), 3).select("paper_id", "kind", "id", "place")


@query("str13_artifact_ids", f"+{CAPTIONS},{INVENTORY}\nSELECT kind, caption, id, count(*) AS n FROM ids GROUP BY ALL", "page_texts")
def _(spark, d):
    c = _captions(spark, d)
    ids = F.when(F.col("kind") == "table", text.artifact_id(F.col("caption"), "table")).otherwise(text.artifact_id(F.col("caption"), "figure"))
    return c.withColumn("id", ids).groupBy("kind", "caption", "id").agg(F.count("*").alias("n"))


@query("set1_union_all_artifacts", f"+{CAPTIONS}\nSELECT kind, count(*) AS n FROM captions GROUP BY 1", "page_texts")
def _(spark, d):
    return _captions(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


MENTIONED = f"""named_pages AS (SELECT p.paper_id, i.kind, i.id, p.page, p.text FROM placed i JOIN page_texts p ON p.paper_id = i.paper_id),
{_snippets_sql("named_pages", "paper_id, kind, id, page", ["'(?i)\\b' || id || '\\b'"], 2, 140)},
mentions AS (SELECT paper_id, kind, id, page, snippet, CAST(row_number() OVER (PARTITION BY paper_id, kind, id ORDER BY page, k) AS INT) AS rank FROM snips QUALIFY row_number() OVER (PARTITION BY paper_id, kind, id ORDER BY page, k) <= 8)"""


@query("jn15_mentions", f"+{CAPTIONS},{INVENTORY},\n{MENTIONED}\nSELECT * FROM mentions", "page_texts")
def _(spark, d):
    texts = fx.fixture(spark, d, "page_texts")
    return artifacts.mentions(artifacts.inventory(_captions(spark, d)), texts).select("paper_id", "kind", "id", "page", "snippet", "rank")


@query("str12_excerpts", f"+{CAPTIONS},{INVENTORY},\nwanted AS (SELECT paper_id, kind, id, unnest(pages[1:4]) AS page FROM placed)\nSELECT w.paper_id, kind, id, w.page, CASE WHEN length(trim(text, ' ' || chr(10))) <= 40 THEN trim(text, ' ' || chr(10)) ELSE regexp_replace(trim(text, ' ' || chr(10))[1:39], '\\s+$', '') || '…' END AS excerpt FROM wanted w JOIN page_texts p ON p.paper_id = w.paper_id AND p.page = w.page", "page_texts")
def _(spark, d):
    return artifacts.excerpts(artifacts.inventory(_captions(spark, d)), fx.fixture(spark, d, "page_texts").withColumn("text", F.col("text")), 4, 40)


@query("str19_heads", "SELECT paper_id, page, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0)[1:6], chr(10))[1:600] AS text_head FROM page_texts", "page_texts")
def _(spark, d):
    return fx.fixture(spark, d, "page_texts").select("paper_id", "page", text.head(F.col("text")).alias("text_head"))


@query("str7_clean_snippets", "SELECT paper_id, page, CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(t[1:59], '\\s+$', '') || '…' END AS snippet FROM (SELECT paper_id, page, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM page_texts)", "page_texts")
def _(spark, d):
    return fx.fixture(spark, d, "page_texts").select("paper_id", "page", text.clean_snippet(F.col("text"), 60).alias("snippet"))


@query("str9_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(s), '\\s+|[^\\w\\-. ]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')[1:80] AS slug FROM (SELECT p_partkey, p_name || ' (' || p_brand || ')/' || p_type AS s FROM part)", "stat_tests")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")/"), F.col("p_type"))).alias("slug"))


@query("str10_markdown_cells", "SELECT p_partkey, replace(trim(regexp_replace(p_name || ' | ' || chr(10) || ' ' || p_type, '\\s+', ' ', 'g')), '|', chr(92) || '|') AS cell FROM part", "stat_tests")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.markdown_cell(F.concat(F.col("p_name"), F.lit(" | \n "), F.col("p_type"))).alias("cell"))


@query("str11_contains_forms", "SELECT paper_id, page, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS form FROM page_texts", "page_texts")
def _(spark, d):
    return fx.fixture(spark, d, "page_texts").select("paper_id", "page", text.contains_form(F.col("text")).alias("form"))


@query("str8_snippets", f"""+{_snippets_sql("page_texts", "paper_id, page", [f"'{_re2(p)}'" for p in (fixed.ROBUST, fixed.TABLE)], 6, 80)}\nSELECT * FROM snips""", "page_texts")
def _(spark, d):
    return fx.fixture(spark, d, "page_texts").select("paper_id", "page", F.posexplode(text.snippets(F.col("text"), (fixed.ROBUST, fixed.TABLE))).alias("k", "snippet"))


@query("str17_cache_keys", "SELECT p_partkey, 'mp' || greatest(1, p_size - 10) || '_pdfp' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS STRING) ELSE 'None' END AS cache_key FROM part", "stat_tests")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.cache_key(F.col("p_size") - 10, F.when(F.col("p_size") % 2 == 0, F.col("p_size"))).alias("cache_key"))


@query("str18_masked_keys", "SELECT c_custkey, CASE WHEN length(c_name) > 4 THEN repeat('*', length(c_name) - 4) || right(c_name, 4) ELSE c_name END AS masked FROM customer", "stat_tests")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.masked_key(F.col("c_name")).alias("masked"))


@query("hsh1_file_hashes", "SELECT doc_id, sha256(text) AS sha256 FROM documents", "stat_tests")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.file_hash(F.encode("text", "UTF-8"), None).alias("sha256"))


@query("jsn1_json_objects", "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM events", "stat_tests")
def _(spark, d):
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.get_json_object(jsons.json_object(wrapped), "$.k").cast("int").alias("k"))


# --- summaries ------------------------------------------------------------------------------------

P_SQL = _erfc_sql("abs_t / sqrt(2)")


@query("cmp7_paper_summary", f"+{SIDES},{PER_PAPER}\nSELECT c.paper_id, tests, t_1_96_left, t_1_96_right, p_0_05_left, p_0_05_right, curve_low, curve_high, round({_z_sql('curve_low', 'curve_high')}, 9) AS curve_z, x.exact_2 FROM counts c JOIN (SELECT paper_id, count(*) FILTER (WHERE abs(abs_t - 1.96) <= 0.20 AND abs(abs_t - 2.0) < 1e-9) AS exact_2 FROM stat_tests GROUP BY 1) x ON c.paper_id = x.paper_id", "stat_tests")
def _(spark, d):
    made = summary.paper_summary(fx.tests(spark, d))
    return made.select("paper_id", "tests", "t_1_96_left", "t_1_96_right", "p_0_05_left", "p_0_05_right", "curve_low", "curve_high", _r("curve_z", 9).alias("curve_z"), "exact_2")


PAGE_COUNTS = f"+{SIDES},\np AS (SELECT paper_id, page, count(*) AS p_count FROM sided WHERE s05 <> 0 GROUP BY ALL), t AS (SELECT paper_id, page, count(*) AS t_count FROM stat_tests WHERE abs(abs_t - 1.96) <= 0.20 GROUP BY ALL)\nSELECT coalesce(p.paper_id, t.paper_id) AS paper_id, coalesce(p.page, t.page) AS page, coalesce(p_count, 0) AS p_count, coalesce(t_count, 0) AS t_count FROM p FULL JOIN t ON p.paper_id = t.paper_id AND p.page = t.page"


@query("jn14_page_counts", PAGE_COUNTS, "stat_tests")
def _(spark, d):
    return summary.page_counts(fx.tests(spark, d))


QUERIES["agg13_page_counts"], ORACLES["agg13_page_counts"] = QUERIES["jn14_page_counts"], ORACLES["jn14_page_counts"]


@query("top10_page_order", PAGE_COUNTS.replace("\nSELECT coalesce(p.paper_id", ",\nboth_ AS (SELECT coalesce(p.paper_id", 1) + ")\nSELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY p_count + t_count DESC, page) AS INT) AS rank FROM both_ WHERE p_count + t_count > 0", "stat_tests")
def _(spark, d):
    return report.page_order(summary.page_counts(fx.tests(spark, d)))


@query("set5_one_header", "SELECT paper_id, count(*) AS tests, NULL AS pages, NULL AS skipped_reason FROM stat_tests GROUP BY 1 UNION ALL SELECT paper_id, NULL, max(page), 'pages>370' FROM page_texts GROUP BY 1 HAVING max(page) > 370", "stat_tests", "page_texts")
def _(spark, d):
    counted = fx.tests(spark, d, False).groupBy("paper_id").agg(F.count("*").alias("tests"))
    skipped = tests.skipped(fx.fixture(spark, d, "page_texts").groupBy("paper_id").agg(F.max("page").alias("pages")), 370)
    return writers.under_one_header([counted, skipped])


@query("set2_page_keys", f"+{SIDES}\nSELECT paper_id, page FROM sided WHERE s05 <> 0 UNION SELECT paper_id, page FROM stat_tests WHERE abs(abs_t - 1.96) <= 0.20", "stat_tests")
def _(spark, d):
    t = fx.tests(spark, d, False)
    return t.filter(stats.p_side(F.col("abs_t"), 0.05, 0.005) != 0).select("paper_id", "page").union(t.filter(F.abs(F.col("abs_t") - 1.96) <= 0.20).select("paper_id", "page")).distinct()


ORDERED = "o, ln, pk, sk, q, ep, sd"


@query("top3_t_examples", f"SELECT paper_id, o, ln, pk, q, ep, round(abs_t, 9) AS abs_t, CAST(rank AS INT) AS rank, truncated FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY abs(abs_t - 1.96), {ORDERED}) AS rank, count(*) OVER (PARTITION BY paper_id) > 80 AS truncated FROM stat_tests WHERE abs(abs_t - 1.96) <= 0.20) WHERE rank <= 80", "stat_tests")
def _(spark, d):
    return summary.examples(fx.tests(spark, d), "t").select("paper_id", "o", "ln", "pk", "q", "ep", _r("abs_t", 9).alias("abs_t"), "rank", "truncated")


@query("top3_p_examples", f"+{SIDES}\nSELECT paper_id, o, ln, pk, q, ep, round(abs_t, 9) AS abs_t, CAST(rank AS INT) AS rank, truncated FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY abs(round({P_SQL}, 6) - 0.05), {ORDERED}) AS rank, count(*) OVER (PARTITION BY paper_id) > 60 AS truncated FROM sided WHERE s05 <> 0) WHERE rank <= 60", "stat_tests")
def _(spark, d):
    return summary.examples(fx.tests(spark, d), "p").select("paper_id", "o", "ln", "pk", "q", "ep", _r("abs_t", 9).alias("abs_t"), "rank", "truncated")


@query("top4_page_borderline", f"""+dist AS (SELECT *, CASE WHEN abs(abs_t - 1.96) <= 0.20 THEN abs(abs_t - 1.96) END AS dt, CASE WHEN abs({P_SQL} - 0.05) <= 0.005 THEN abs({P_SQL} - 0.05) END AS dp FROM stat_tests),
best AS (SELECT *, CASE WHEN dp IS NOT NULL AND (dt IS NULL OR dp < dt) THEN dp ELSE dt END AS dist, CASE WHEN dp IS NOT NULL AND (dt IS NULL OR dp < dt) THEN 'p≈0.05' ELSE 'abs(t)≈1.96' END AS why_borderline FROM dist)
SELECT paper_id, page, o, ln, pk, q, ep, why_borderline, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, page ORDER BY dist, {ORDERED}) AS rank FROM best WHERE dist IS NOT NULL) WHERE rank <= 3""", "stat_tests")
def _(spark, d):
    return summary.page_borderline(fx.tests(spark, d)).select("paper_id", "page", "o", "ln", "pk", "q", "ep", "why_borderline", "rank")


TABLED = f"""{CAPTIONS},
tabled AS (SELECT t.*, c.caption, CASE WHEN c.caption IS NULL THEN 'Table (unknown)' ELSE 'Table ' || regexp_extract(c.caption, '^\\w+ (\\w+)', 1) END AS table_id, {_erfc_sql("t.abs_t / sqrt(2)")} AS p
  FROM stat_tests t LEFT JOIN (SELECT * FROM captions WHERE kind = 'table') c ON t.paper_id = c.paper_id AND t.page = c.page)"""


@query("jn4_tests_with_captions", f"+{TABLED}\nSELECT paper_id, table_id, count(*) AS n FROM tabled GROUP BY ALL", "stat_tests", "page_texts")
def _(spark, d):
    return summary.with_tables(fx.tests(spark, d, False), _captions(spark, d)).groupBy("paper_id", "table_id").agg(F.count("*").alias("n"))


@query("agg10_table_metrics", f"""+{TABLED},
m AS (SELECT paper_id, table_id, count(*) AS n_tests, count(DISTINCT page) AS n_pages, count(*) FILTER (WHERE p >= 0.045 AND p <= 0.05) AS p_005_left, count(*) FILTER (WHERE p > 0.05 AND p <= 0.055) AS p_005_right,
 count(*) FILTER (WHERE abs_t >= 1.76 AND abs_t <= 1.96) AS t_196_left, count(*) FILTER (WHERE abs_t > 1.96 AND abs_t <= 2.16) AS t_196_right, count(*) FILTER (WHERE p <= 0.05) AS sig_p_le_0_05, count(*) FILTER (WHERE p <= 0.10) AS sig_p_le_0_10,
 count(*) FILTER (WHERE p <= 0.025) AS pcurve_low_half, count(*) FILTER (WHERE p > 0.025 AND p <= 0.05) AS pcurve_high_half, count(*) FILTER (WHERE abs_t >= 1.76 AND abs_t <= 2.16 AND abs(abs_t - 2.0) < 1e-9) AS t_exact_2_count FROM tabled GROUP BY ALL)
SELECT *, round(p_005_left / greatest(1, p_005_right), 6) AS p_005_left_over_right, round(t_196_right / greatest(1, t_196_left), 6) AS t_196_right_over_left, round({_z_sql('pcurve_low_half', 'pcurve_high_half')}, 6) AS pcurve_right_skew_z,
 round(CASE WHEN t_196_left + t_196_right > 0 THEN t_exact_2_count / (t_196_left + t_196_right) ELSE 0.0 END, 6) AS t_exact_2_share FROM m""", "stat_tests", "page_texts")
def _(spark, d):
    m = summary.table_metrics(fx.tests(spark, d), _captions(spark, d))
    return m.select("paper_id", "table_id", "n_tests", F.size("pages").cast("long").alias("n_pages"), "p_005_left", "p_005_right", "t_196_left", "t_196_right", "sig_p_le_0_05", "sig_p_le_0_10", "pcurve_low_half", "pcurve_high_half", "t_exact_2_count", _r("p_005_left_over_right").alias("p_005_left_over_right"), _r("t_196_right_over_left").alias("t_196_right_over_left"), _r("pcurve_right_skew_z").alias("pcurve_right_skew_z"), _r("t_exact_2_share_in_t196").alias("t_exact_2_share"))


QUERIES["agg11_table_ratios"], ORACLES["agg11_table_ratios"] = QUERIES["agg10_table_metrics"], ORACLES["agg10_table_metrics"]
QUERIES["cmp8_table_summary"], ORACLES["cmp8_table_summary"] = QUERIES["agg10_table_metrics"], ORACLES["agg10_table_metrics"]


# the composite that users read, with its nested columns as text
@query("cmp10_enriched_artifacts", f"""+{TABLED},{INVENTORY},
{MENTIONED},
said AS (SELECT paper_id, kind, id, count(*) AS n_mentions, string_agg(page || ': ' || snippet, ' / ' ORDER BY rank) AS mentions FROM mentions GROUP BY ALL),
shown AS (SELECT w.paper_id, kind, id, count(*) AS n_excerpts, string_agg(w.page || ': ' || trim(text, ' ' || chr(10)), ' / ' ORDER BY w.page) AS excerpts FROM (SELECT paper_id, kind, id, unnest(pages[1:4]) AS page FROM placed) w JOIN page_texts p ON p.paper_id = w.paper_id AND p.page = w.page GROUP BY ALL),
m AS (SELECT paper_id, 'table' AS kind, table_id AS id, count(*) AS n_tests, count(*) FILTER (WHERE abs_t >= 1.76 AND abs_t <= 1.96) AS t_196_left, count(*) FILTER (WHERE p > 0.05 AND p <= 0.055) AS p_005_right FROM tabled GROUP BY ALL)
SELECT i.paper_id, i.kind, i.id, i.place, i.caption, n_mentions, mentions, n_excerpts, excerpts, n_tests, t_196_left, p_005_right FROM placed i
LEFT JOIN said s ON s.paper_id = i.paper_id AND s.kind = i.kind AND s.id = i.id LEFT JOIN shown e ON e.paper_id = i.paper_id AND e.kind = i.kind AND e.id = i.id LEFT JOIN m ON m.paper_id = i.paper_id AND m.kind = i.kind AND m.id = i.id""", "stat_tests", "page_texts")
def _(spark, d):
    texts, caps = fx.fixture(spark, d, "page_texts"), _captions(spark, d)
    made = artifacts.enriched(artifacts.inventory(caps), texts, summary.table_metrics(fx.tests(spark, d), caps))
    pages_shown = F.array_sort(F.map_keys("page_text_excerpts"))
    excerpts = F.array_join(F.transform(pages_shown, lambda p: F.concat(p.cast("string"), F.lit(": "), F.element_at("page_text_excerpts", p))), " / ")
    mentions = F.array_join(F.transform("mentions", lambda m: F.concat(m["page"].cast("string"), F.lit(": "), m["snippet"])), " / ")
    return made.select("paper_id", "kind", "id", "place", "caption", F.when(F.col("mentions").isNotNull(), F.size("mentions")).cast("long").alias("n_mentions"), mentions.alias("mentions"), F.size(pages_shown).cast("long").alias("n_excerpts"), excerpts.alias("excerpts"), "table_metrics.n_tests", "table_metrics.t_196_left", "table_metrics.p_005_right")


@query("win3_flagged_by_table", f"+{TABLED}\nSELECT paper_id, table_id, o, ln, pk, q, ep, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, table_id ORDER BY abs(abs_t - 1.96), {ORDERED}) AS rank FROM tabled WHERE abs_t >= 1.76 AND abs_t <= 2.16) WHERE rank <= 25", "stat_tests", "page_texts")
def _(spark, d):
    return summary.table_flagged(fx.tests(spark, d, False).withColumn("p_approx_2s", F.lit(None).cast("double")), _captions(spark, d), "t").select("paper_id", "table_id", "o", "ln", "pk", "q", "ep", "rank")


@query("agg22_near_by_title", f"""+{CAPTIONS},
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY abs(abs_t - 1.96), {ORDERED}) AS rank FROM stat_tests WHERE abs(abs_t - 1.96) <= 0.20) WHERE rank <= 80),
counts AS (SELECT ex.paper_id, coalesce(c.caption, '(unknown)') AS title, count(*) FILTER (WHERE abs_t >= 1.76 AND abs_t <= 1.96) AS left_n, count(*) FILTER (WHERE abs_t > 1.96 AND abs_t <= 2.16) AS right_n, min(rank) AS first_rank FROM ex LEFT JOIN (SELECT * FROM captions WHERE kind = 'table') c ON ex.paper_id = c.paper_id AND ex.page = c.page GROUP BY ALL)
SELECT paper_id, title, left_n, right_n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY left_n + right_n DESC, first_rank) AS rank FROM counts WHERE left_n + right_n > 0) WHERE rank <= 12""", "stat_tests", "page_texts")
def _(spark, d):
    made = summary.near_by_title(summary.examples(fx.tests(spark, d), "t"), _captions(spark, d), "t")
    return made.select("paper_id", "title", F.col("left").alias("left_n"), F.col("right").alias("right_n"), "rank")


@query("agg23_fallback_scores", f"+{SIDES},{PER_PAPER}\nSELECT paper_id, CAST(greatest(0, least(100, 20 + CASE WHEN t_1_96_left + t_1_96_right < 30 THEN 0 WHEN t_1_96_right >= t_1_96_left + 6 THEN 14 WHEN t_1_96_right >= t_1_96_left + 2 THEN 8 ELSE 0 END + CASE WHEN p_0_05_left + p_0_05_right < 10 THEN 0 WHEN p_0_05_left >= p_0_05_right + 4 THEN 12 WHEN p_0_05_left >= p_0_05_right + 1 THEN 6 ELSE 0 END + CASE WHEN {_z_sql('curve_low', 'curve_high')} < -1.0 THEN 6 ELSE 0 END)) AS INT) AS fallback_score FROM counts", "stat_tests")
def _(spark, d):
    return report.fallback_score(summary.paper_summary(fx.tests(spark, d))).select("paper_id", "fallback_score")


@query("str14_anchors", "SELECT paper_id, page, o, ln, pk, q, ep, 'p.' || page || ' · Table#' || (table_index + 1) || ' · coef=' || CAST(CAST(coef AS INT) AS STRING) AS anchor FROM stat_tests", "stat_tests")
def _(spark, d):
    t = fx.tests(spark, d, False)
    none = F.lit(None).cast("double")
    return t.select("paper_id", "page", "o", "ln", "pk", "q", "ep", text.anchor(F.col("page"), F.col("table_index"), F.col("coef").cast("int").cast("string"), F.lit(""), none, none).alias("anchor"))


# --- audits and the metrics object ------------------------------------------------------------------

AUDITS = """
audits AS (SELECT l_suppkey % 40 AS paper_id, 'Table ' || CAST(1 + l_partkey % 4 AS STRING) AS id, l_orderkey * 10 + l_linenumber + l_partkey / 100000.0 + l_quantity / 1e8 + l_extendedprice / 1e14 AS place,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 101 AS DOUBLE) END AS score, 'concern ' || CAST(l_partkey % 6 AS STRING) AS concern FROM lineitem),
last AS (SELECT paper_id, id, arg_max(coalesce(score, -1), place) AS score, arg_max(concern, place) AS concern FROM audits GROUP BY ALL)"""


def _audits(spark: SparkSession, d: str) -> DataFrame:
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_partkey") / 100000.0 + F.col("l_quantity") / 1e8 + F.col("l_extendedprice") / 1e14
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 40).alias("paper_id"), F.concat(F.lit("Table "), (1 + F.col("l_partkey") % 4).cast("string")).alias("id"), place.alias("place"),
        F.when(F.col("l_partkey") % 3 != 0, (F.col("l_partkey") % 101).cast("double")).alias("score"), F.lit(None).cast("string").alias("level"),
        F.array(F.concat(F.lit("concern "), (F.col("l_partkey") % 6).cast("string"))).alias("concerns"),
    )


@query("jn7_last_audits", f"+{AUDITS}\nSELECT paper_id, id, nullif(score, -1) AS score, concern FROM last", "stat_tests")
def _(spark, d):
    made = artifacts.last_audit(_audits(spark, d))
    return made.select("paper_id", "id", "audit.score", F.col("audit.concerns")[0].alias("concern"))


@query("agg21_fallback_metrics", f"+{CAPTIONS},{INVENTORY},{AUDITS},\nj AS (SELECT p.paper_id, nullif(l.score, -1) AS score FROM placed p LEFT JOIN last l ON p.paper_id = l.paper_id AND p.id = l.id),\no AS (SELECT paper_id, coalesce(avg(score), 0.0) AS mean FROM j GROUP BY 1)\nSELECT paper_id, round_even(mean, 2) AS overall_risk_score_0_100, CASE WHEN mean >= 67 THEN 'High' WHEN mean >= 34 THEN 'Moderate' ELSE 'Low' END AS overall_risk_level FROM o", "page_texts", "stat_tests")
def _(spark, d):
    caps = _captions(spark, d)
    made = artifacts.fallback_metrics(artifacts.inventory(caps), _audits(spark, d), summary.table_metrics(fx.tests(spark, d), caps))
    return artifacts.fallback_paper(made).select("paper_id", "overall_risk_score_0_100", "overall_risk_level")


@query("jn6_inventory_with_metrics", f"+{TABLED},{INVENTORY.replace('ids AS (SELECT *', 'ids AS (SELECT *')}\nSELECT p.paper_id, p.kind, p.id, m.n FROM placed p LEFT JOIN (SELECT paper_id, table_id, count(*) AS n FROM tabled GROUP BY ALL) m ON p.paper_id = m.paper_id AND p.id = m.table_id AND p.kind = 'table'", "stat_tests", "page_texts")
def _(spark, d):
    caps = _captions(spark, d)
    made = artifacts.enriched(artifacts.inventory(caps), fx.fixture(spark, d, "page_texts"), summary.table_metrics(fx.tests(spark, d), caps))
    return made.select("paper_id", "kind", "id", F.col("table_metrics.n_tests").alias("n"))


QUERIES["jn8_inventory_with_table_metrics"], ORACLES["jn8_inventory_with_table_metrics"] = QUERIES["jn6_inventory_with_metrics"], ORACLES["jn6_inventory_with_metrics"]


@query("jn9_audits_by_position", f"+{CAPTIONS},{INVENTORY}\nSELECT paper_id, place, kind, id FROM placed", "page_texts")
def _(spark, d):
    items = artifacts.inventory(_captions(spark, d))
    audits = items.select("paper_id", "place", F.lit("?").alias("id"), F.lit(1.0).alias("score"))
    return artifacts.by_position(audits, items).select("paper_id", "place", "kind", "id")


@query("jn16_missing_artifacts", f"+{CAPTIONS},{INVENTORY},{AUDITS}\nSELECT paper_id, kind, id FROM placed p WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.paper_id = p.paper_id AND l.id = p.id)", "page_texts", "stat_tests")
def _(spark, d):
    return artifacts.missing(artifacts.inventory(_captions(spark, d)), _audits(spark, d)).select("paper_id", "kind", "id")


@query("set3_missing_ids", f"+{CAPTIONS},{INVENTORY},{AUDITS}\nSELECT paper_id, id FROM placed EXCEPT SELECT paper_id, id FROM last", "page_texts", "stat_tests")
def _(spark, d):
    return artifacts.inventory(_captions(spark, d)).select("paper_id", "id").exceptAll(_audits(spark, d).select("paper_id", "id").distinct()).distinct()


@query("flt17_valid_metrics", f"+{CAPTIONS},{INVENTORY}\nSELECT DISTINCT paper_id, CASE WHEN paper_id % 3 = 0 THEN false WHEN paper_id % 3 = 1 THEN false ELSE true END AS ok, CASE WHEN paper_id % 3 = 0 THEN 'missing/invalid paper' WHEN paper_id % 3 = 1 THEN 'missing paper.key_artifacts' ELSE 'ok' END AS why FROM placed", "page_texts")
def _(spark, d):
    items = artifacts.inventory(_captions(spark, d))
    listed = items.groupBy("paper_id").agg(F.to_json(F.collect_list(F.struct("kind", "id", "pages"))).alias("artifacts"))
    keys = [k for k in fixed.METRIC_PAPER if k != "key_artifacts"]
    some, every = ("{" + ", ".join(f'"{k}": 1' for k in names) + "}" for names in (keys, fixed.METRIC_PAPER))
    paper = F.when(F.col("paper_id") % 3 == 0, "7").when(F.col("paper_id") % 3 == 1, some).otherwise(every)
    return artifacts.validate(listed.select("paper_id", F.concat(F.lit('{"paper": '), paper, F.lit(', "artifacts": '), F.col("artifacts"), F.lit("}")).alias("object")), items)


# --- corpus lookups -----------------------------------------------------------------------------------

@query("jn1_papers_in_list", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)", "stat_tests")
def _(spark, d):
    ids = table(spark, d, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return corpus.in_list(table(spark, d, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query("jn2_feature_rows", "SELECT paper_id, line FROM (SELECT p.c_custkey AS paper_id, f.o_orderkey AS line, row_number() OVER (PARTITION BY p.c_custkey ORDER BY f.o_orderkey) AS r FROM customer p JOIN orders f ON f.o_custkey = p.c_custkey OR f.o_orderkey = p.c_custkey * 3) WHERE r = 1", "stat_tests")
def _(spark, d):
    papers = table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"), (F.col("c_custkey") * 3).alias("sha256"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("sha256"), F.col("o_orderkey").alias("line"))
    return corpus.match_rows(papers, rows).select("paper_id", "line")


@query("jn3_not_cached", "SELECT c_custkey AS paper_id FROM customer WHERE c_custkey % 3 <> 0", "stat_tests")
def _(spark, d):
    papers = table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"), F.sha2("c_name", 256).alias("sha256"), F.lit("mp12_pdfpNone").alias("cache_key"))
    cached = papers.filter("paper_id % 3 = 0").withColumn("sha12", F.substring("sha256", 1, 12)).withColumn("extractor_version", F.lit(fixed.VERSION))
    return corpus.not_cached(papers, cached).select("paper_id")


@query("flt10_page_guard", "SELECT paper_id, max(page) AS pages, 'pages>370' AS skipped_reason FROM page_texts GROUP BY 1 HAVING max(page) > 370", "page_texts")
def _(spark, d):
    return tests.skipped(fx.fixture(spark, d, "page_texts").groupBy("paper_id").agg(F.max("page").alias("pages")), 370)


@query("flt11_pattern_and_limit", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[02468]$') ORDER BY c_name LIMIT 25", "stat_tests")
def _(spark, d):
    return corpus.chosen(table(spark, d, "customer"), "c_name", "[02468]$", 25).select("c_custkey", "c_name")


@query("flt15_small_int_like", "SELECT q, q <= 30 AS small, count(*) AS n FROM stat_tests GROUP BY ALL", "stat_tests")
def _(spark, d):
    return fx.tests(spark, d, False).groupBy("q", stats.small_int_like(F.col("q")).alias("small")).agg(F.count("*").alias("n"))


# p-values as they are (the oracle's approximation held to its range), missing, no numbers, negative and over 1; the ends belong to the range
@query("flt9_valid_p", f"""+p AS (SELECT pk % 7 AS kind, CASE pk % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN -0.25 WHEN 3 THEN 1.5 WHEN 4 THEN 0.0 WHEN 5 THEN 1.0 ELSE greatest(0.0, least(1.0, {P_SQL})) END AS p FROM stat_tests)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE p IS NOT NULL AND NOT isnan(p) AND p >= 0 AND p <= 1) AS valid FROM p GROUP BY kind""", "stat_tests")
def _(spark, d):
    kind = F.col("pk") % 7
    p = F.when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.lit(-0.25)).when(kind == 3, F.lit(1.5)).when(kind == 4, F.lit(0.0)).when(kind == 5, F.lit(1.0)).when(kind == 6, F.col("p_approx_2s"))
    return fx.tests(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(stats.valid_p(p)).alias("valid"))


@query("mth3_cap01", "SELECT o, ln, pk, q, ep, round(greatest(0.0, least(1.0, coef / 3)), 9) AS capped FROM stat_tests", "stat_tests")
def _(spark, d):
    return fx.tests(spark, d, False).select("o", "ln", "pk", "q", "ep", _r(stats.cap01(F.col("coef") / 3), 9).alias("capped"))


@query("mth4_overlap", "SELECT paper_id, page, word_no, greatest(0.0, least(x1, 200.0) - greatest(x0, 100.0)) AS shared FROM words", "words")
def _(spark, d):
    return fx.fixture(spark, d, "words").select("paper_id", "page", "word_no", stats.overlap(F.col("x0"), F.col("x1"), F.lit(100.0), F.lit(200.0)).alias("shared"))


# --- layout -------------------------------------------------------------------------------------------

@query("src3_table_cells", """+said AS (SELECT *, sum(fresh) OVER (PARTITION BY paper_id, page ORDER BY y0) AS line FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY paper_id, page ORDER BY y0) > 3 THEN 1 ELSE 0 END AS fresh FROM table_words WHERE trim(text) <> '')),
line AS (SELECT *, row_number() OVER (PARTITION BY paper_id, page, table_index ORDER BY line) - 1 AS row_index FROM (SELECT *, sum(fresh) OVER (PARTITION BY paper_id, page ORDER BY line) AS table_index FROM (
  SELECT *, CASE WHEN top - max(bottom) OVER (PARTITION BY paper_id, page ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 24 THEN 1 ELSE 0 END AS fresh FROM (
    SELECT paper_id, page, line, min(y0) AS top, max(y1) AS bottom FROM said GROUP BY ALL)))),
placed AS (SELECT s.*, l.table_index, l.row_index FROM said s JOIN line l ON s.paper_id = l.paper_id AND s.page = l.page AND s.line = l.line),
side AS (SELECT paper_id, page, table_index, x0, x1, 0 AS kind, x0 AS pos FROM placed UNION ALL SELECT paper_id, page, table_index, x0, x1, 1, x1 FROM placed UNION ALL SELECT paper_id, page, table_index, x0, x1, 2, (x0 + x1) / 2 FROM placed),
grouped AS (SELECT paper_id, page, table_index, kind, g, count(*) AS n, min(x0) AS lo, max(x1) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY paper_id, page, table_index, kind ORDER BY pos) AS g FROM (
  SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY paper_id, page, table_index, kind ORDER BY pos) > 1 THEN 1 ELSE 0 END AS fresh FROM side)) GROUP BY ALL HAVING count(*) >= 2),
taken AS (SELECT paper_id, page, table_index, list_reduce(list([{'lo': lo, 'hi': hi}] ORDER BY n DESC, lo, hi, kind), lambda a, b: CASE WHEN len(list_filter(a, lambda t: t.lo < b[1].hi AND t.hi > b[1].lo)) > 0 THEN a ELSE list_concat(a, b) END) AS t FROM grouped GROUP BY ALL),
cut AS (SELECT paper_id, page, table_index, unnest(list_append(list_transform(t, lambda x: x.lo), list_max(list_transform(t, lambda x: x.hi)))) AS c FROM taken),
edge AS (SELECT paper_id, page, table_index, avg(c) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY paper_id, page, table_index ORDER BY c) AS g FROM (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY paper_id, page, table_index ORDER BY c) > 3 THEN 1 ELSE 0 END AS fresh FROM cut)) GROUP BY paper_id, page, table_index, g),
col AS (SELECT * FROM (SELECT paper_id, page, table_index, row_number() OVER w - 1 AS col_index, e AS lo, lead(e) OVER w AS hi FROM edge WINDOW w AS (PARTITION BY paper_id, page, table_index ORDER BY e)) WHERE hi IS NOT NULL),
held AS (SELECT p.paper_id, p.page, p.table_index, p.row_index, c.col_index, string_agg(trim(p.text), ' ' ORDER BY p.x0, p.word_no, p.text) AS cell_text FROM placed p JOIN col c ON p.paper_id = c.paper_id AND p.page = c.page AND p.table_index = c.table_index AND (p.x0 + p.x1) / 2 >= c.lo AND (p.x0 + p.x1) / 2 < c.hi GROUP BY ALL)
SELECT l.paper_id, l.page, CAST(l.table_index AS INT) AS table_index, CAST(l.row_index AS INT) AS row_index, CAST(c.col_index AS INT) AS col_index, coalesce(h.cell_text, '') AS cell_text, c.lo AS x0, l.top AS y0, c.hi AS x1, l.bottom AS y1,
  min(c.lo) OVER (PARTITION BY l.paper_id, l.page, l.table_index) AS table_x0, max(l.bottom) OVER (PARTITION BY l.paper_id, l.page, l.table_index) AS table_y1
FROM line l JOIN col c ON l.paper_id = c.paper_id AND l.page = c.page AND l.table_index = c.table_index
LEFT JOIN held h ON h.paper_id = l.paper_id AND h.page = l.page AND h.table_index = l.table_index AND h.row_index = l.row_index AND h.col_index = c.col_index""", "table_words")
def _(spark, d):
    box, whole = F.col("cell_bbox"), F.col("table_bbox")
    return grid.cells(fx.fixture(spark, d, "table_words")).select("paper_id", "page", "table_index", "row_index", "col_index", "cell_text", *(box[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))), whole[0].alias("table_x0"), whole[3].alias("table_y1"))



LINES = "lines AS (SELECT paper_id, page, block_no, line_in_block, string_agg(text, ' ' ORDER BY word_no, text) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY ALL)"


@query("lay1_lines", f"+{LINES}\nSELECT * FROM lines", "words")
def _(spark, d):
    return layout.lines(fx.fixture(spark, d, "words")).drop("line_no")


QUERIES["agg24_line_boxes"], ORACLES["agg24_line_boxes"] = QUERIES["lay1_lines"], ORACLES["lay1_lines"]


@query("top8_line_order", f"+{LINES}\nSELECT paper_id, page, block_no, line_in_block, CAST(row_number() OVER (PARTITION BY paper_id, page ORDER BY y0, x0, block_no, line_in_block) AS INT) AS place FROM lines", "words")
def _(spark, d):
    made = layout.lines(fx.fixture(spark, d, "words"))
    return made.select("paper_id", "page", "block_no", "line_in_block", F.row_number().over(Window.partitionBy("paper_id", "page").orderBy("line_no")).alias("place"))


FLAGGED = "flagged AS (SELECT l_suppkey AS paper_id, CAST(1 + (l_orderkey % 12) AS INT) AS page, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS cell_id, min(CAST(l_linenumber * 12 AS DOUBLE)) AS y0 FROM lineitem GROUP BY ALL)"


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("paper_id"), (1 + F.col("l_orderkey") % 12).cast("int").alias("page"), (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("cell_id")).agg(F.min((F.col("l_linenumber") * 12).cast("double")).alias("y0"))
    return made.select("paper_id", "page", "cell_id", F.array(F.lit(0.0), F.lit(0.0), F.lit(600.0), F.lit(200.0)).alias("table_bbox"), F.array(F.lit(535.0), F.col("y0"), F.lit(560.0), F.col("y0") + 10).alias("cell_bbox"))


@query("lay2_row_labels", f"""+{LINES},{FLAGGED},
cand AS (SELECT f.paper_id, f.page, f.cell_id, l.text, abs((l.y0 + l.y1) / 2 - (f.y0 + 5)) + 0.02 * greatest(0.0, 535.0 - l.x1) AS score, l.y0, l.x0, l.block_no, l.line_in_block FROM flagged f JOIN lines l ON f.paper_id = l.paper_id AND f.page = l.page
  WHERE l.x1 <= 533 AND l.y1 >= -2 AND l.y0 <= 202 AND least(l.y1, f.y0 + 5 + 9.0) - greatest(l.y0, f.y0 + 5 - 9.0) > 0)
SELECT paper_id, page, cell_id, text AS row_label FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, page, cell_id ORDER BY score, y0, x0, block_no, line_in_block) AS r FROM cand) WHERE r = 1""", "words")
def _(spark, d):
    return layout.row_labels(_flagged(spark, d), layout.lines(fx.fixture(spark, d, "words")))


QUERIES["jn10_row_labels"], ORACLES["jn10_row_labels"] = QUERIES["lay2_row_labels"], ORACLES["lay2_row_labels"]


@query("lay3_column_labels", f"""+{LINES},{FLAGGED},
cand AS (SELECT f.paper_id, f.page, f.cell_id, l.text, greatest(0.0, f.y0 - l.y1) AS dy, least(l.x1, 560.0) - greatest(l.x0, 300.0) AS wide, l.y0, l.x0, l.block_no, l.line_in_block FROM flagged f JOIN lines l ON f.paper_id = l.paper_id AND f.page = l.page
  WHERE l.y1 < f.y0 - 1 AND least(l.x1, 560.0) - greatest(l.x0, 300.0) > 0)
SELECT paper_id, page, cell_id, text AS col_label FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, page, cell_id ORDER BY dy, -wide, y0, x0, block_no, line_in_block) AS r FROM cand) WHERE r = 1""", "words")
def _(spark, d):
    cells = _flagged(spark, d).withColumn("cell_bbox", F.array(F.lit(300.0), F.col("cell_bbox")[1], F.lit(560.0), F.col("cell_bbox")[3]))
    return layout.column_labels(cells, layout.lines(fx.fixture(spark, d, "words")))


QUERIES["jn11_column_labels"], ORACLES["jn11_column_labels"] = QUERIES["lay3_column_labels"], ORACLES["lay3_column_labels"]


@query("agg12_table_tops", f"+{TRUE_PAIRS}\nSELECT paper_id, page, table_index, CAST(min(row_index) * 12 AS DOUBLE) AS top FROM pairs GROUP BY ALL", "grid")
def _(spark, d):
    return summary.table_tops(tests.pairs(fx.cells(spark, d)))


@query("jn12_pairs_with_table_tops", f"+{TRUE_PAIRS}\nSELECT paper_id, page, table_index, row_index, CAST(min(row_index) OVER (PARTITION BY paper_id, page, table_index) * 12 AS DOUBLE) AS top FROM pairs", "grid")
def _(spark, d):
    raw = tests.pairs(fx.cells(spark, d, "paper_id", "page", "table_index"))
    return summary.with_table_tops(raw).select("paper_id", "page", "table_index", "row_index", "top")


@query("flt13_good_boxes", "SELECT count(*) AS n, count(*) FILTER (WHERE row_index % 3 <> 0) AS good FROM cells", "cells")
def _(spark, d):
    box = F.when(F.col("row_index") % 3 == 0, F.array(F.lit(1.0), F.lit(float("nan")), F.lit(2.0), F.lit(3.0))).otherwise(F.col("cell_bbox"))
    return fx.cells(spark, d).agg(F.count("*").alias("n"), F.count_if(layout.good_box(box)).alias("good"))


@query("flt14_model_numbers", "SELECT p_partkey, p_partkey % 3 <> 2 AS number FROM part", "stat_tests")
def _(spark, d):
    n = (F.col("p_partkey") % 12).cast("string")
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("( "), n, F.lit(" )"))).when(F.col("p_partkey") % 3 == 1, n).otherwise(F.concat(F.lit("("), n))
    return table(spark, d, "part").select("p_partkey", layout.model_number(label).alias("number"))


# lines with thirty digits, with few among many letters, with stars, with a word that names a row, and with too few
@query("snk8_numeric_regions", f"""+{LINES},
blocks AS (SELECT paper_id, page, x0, y0, x1, y1, CASE block_no WHEN 0 THEN repeat('0123456789', 3) WHEN 1 THEN repeat('0123456789', 3) || repeat('x', 400) WHEN 2 THEN repeat('0123456789', 3) || repeat('x', 400) || '***' WHEN 3 THEN 'Observations' || repeat('12345', 6) || repeat('x', 400) ELSE '0123456789' END AS text FROM lines WHERE paper_id % 4 > 0 OR block_no > 2),
dense AS (SELECT *, len(regexp_extract_all(text, '[0-9]')) AS n FROM blocks),
r AS (SELECT paper_id, page, greatest(0.0, min(x0) - 12) AS x0, greatest(0.0, min(y0) - 12) AS y0, least(600.0, max(x1) + 12) AS x1, least(90.0, max(y1) + 12) AS y1 FROM dense WHERE n >= 30 AND (n / length(text) >= 0.08 OR contains(text, '***') OR contains(text, 'Observations')) GROUP BY ALL)
SELECT * FROM r WHERE (x1 - x0) * (y1 - y0) / 54000.0 < 0.75""", "words")
def _(spark, d):
    tens = F.lit("0123456789" * 3)
    filled = F.concat(tens, F.lit("x" * 400))
    said = F.when(F.col("block_no") == 0, tens).when(F.col("block_no") == 1, filled).when(F.col("block_no") == 2, F.concat(filled, F.lit("***"))).when(F.col("block_no") == 3, F.lit("Observations" + "12345" * 6 + "x" * 400)).otherwise("0123456789")
    blocks = layout.lines(fx.fixture(spark, d, "words")).filter("paper_id % 4 > 0 OR block_no > 2").withColumn("text", said)
    return layout.numeric_region(blocks.withColumn("page_width", F.lit(600.0)).withColumn("page_height", F.lit(90.0)))


# --- evidence and reports -------------------------------------------------------------------------------

NAMES = f"list_sort(list_distinct(regexp_extract_all(text, '{_re2(fixed.NAMES_TABLE)}')))[1:6]", f"list_sort(list_distinct(regexp_extract_all(text, '{_re2(fixed.NAMES_FIGURE)}')))[1:6]"


@query("set6_artifact_names", f"SELECT paper_id, page, list_concat({NAMES[0]}, {NAMES[1]})[1:6] AS names FROM page_texts", "page_texts")
def _(spark, d):
    return report.page_evidence(fx.fixture(spark, d, "page_texts")).select("paper_id", "page", F.col("table_or_figure_names").alias("names"))


BORDER = f"list_filter(list_transform(regexp_extract_all(text, '{_re2(fixed.BORDERLINE_P)}', 1), lambda x: CAST(x AS DOUBLE)), lambda v: (v >= 0.045 AND v <= 0.055) OR (v >= 0.095 AND v <= 0.105))[1:3]"
SIGNAL_TESTS = ", ".join(f"({' OR '.join(f"regexp_matches(text, '{_re2(p)}')" for p in patterns)}) AS s{k}" for k, (_, _, patterns) in enumerate(fixed.SIGNALS))


@query("off1_page_evidence", f"SELECT paper_id, page, len({BORDER}) AS n_borderline, {SIGNAL_TESTS} FROM page_texts", "page_texts")
def _(spark, d):
    made = report.page_evidence(fx.fixture(spark, d, "page_texts"))
    return made.select("paper_id", "page", F.size("borderline_results").cast("long").alias("n_borderline"), *(F.array_contains(F.transform("signals", lambda s: s["signal"]), name).alias(f"s{k}") for k, (name, _, _) in enumerate(fixed.SIGNALS)))


@query("jn13_evidence_with_tests", f"""+ex AS (SELECT paper_id % 40 AS paper_id, page, count(*) AS n FROM stat_tests WHERE abs(abs_t - 1.96) <= 0.20 AND paper_id < 40 GROUP BY ALL)
SELECT p.paper_id, p.page, CAST(least(3, len({BORDER}) + least(3, coalesce(n, 0))) AS BIGINT) AS n_borderline, CASE WHEN n > 0 THEN 0.35 ELSE 0.25 END AS confidence FROM page_texts p LEFT JOIN ex ON p.paper_id = ex.paper_id AND p.page = ex.page""", "stat_tests", "page_texts")
def _(spark, d):
    t = fx.tests(spark, d).filter(F.abs(F.col("abs_t") - 1.96) <= 0.20)
    ex = summary.page_borderline(t).withColumn("anchor", F.lit("x")).select("paper_id", "page", "rank", "anchor", "why_borderline")
    made = report.with_test_examples(report.page_evidence(fx.fixture(spark, d, "page_texts")), ex)
    return made.select("paper_id", "page", F.size("borderline_results").cast("long").alias("n_borderline"), F.col("confidence_0_1").alias("confidence"))


@query("jn18_page_titles", f"+{CAPTIONS}\nSELECT p.paper_id, p.page, coalesce(c.caption, list_concat({NAMES[0].replace('text', 'p.text')}, {NAMES[1].replace('text', 'p.text')})[1], '') AS title FROM page_texts p LEFT JOIN (SELECT * FROM captions WHERE kind = 'table') c ON p.paper_id = c.paper_id AND p.page = c.page", "page_texts")
def _(spark, d):
    texts = fx.fixture(spark, d, "page_texts")
    return report.page_titles(texts, _captions(spark, d), report.page_evidence(texts))


@query("off2_reports", f"""+{SIDES},{PER_PAPER},
exact AS (SELECT paper_id, count(*) FILTER (WHERE abs(abs_t - 1.96) <= 0.20 AND abs(abs_t - 2.0) < 1e-9) AS exact_2 FROM stat_tests GROUP BY 1),
scored AS (SELECT c.*, exact_2, CAST(round_even(greatest(0.0, least(100.0, {_score_sql()})), 0) AS INT) AS score, count_p, count_t FROM counts c JOIN exact USING (paper_id)
  JOIN (SELECT paper_id, least(60, count(*) FILTER (WHERE s05 <> 0)) AS count_p, least(25, count(*) FILTER (WHERE abs(abs_t - 1.96) <= 0.20)) AS count_t FROM sided GROUP BY 1) USING (paper_id))
SELECT paper_id, 'Paper ' || paper_id AS title, score, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Moderate' ELSE 'Low' END AS level,
  concat_ws(' ', CASE WHEN p_0_05_left + p_0_05_right > 0 THEN p_0_05_left || '/' || p_0_05_right END, CASE WHEN t_1_96_left + t_1_96_right > 0 THEN t_1_96_left || '/' || t_1_96_right END) AS counts,
  CAST(CASE WHEN p_0_05_left + p_0_05_right > 0 THEN count_p ELSE 0 END + CASE WHEN t_1_96_left + t_1_96_right > 0 THEN count_t ELSE 0 END AS BIGINT) AS entries,
  CASE WHEN t_1_96_left + t_1_96_right > 0 AND exact_2 > 0 THEN CAST(exact_2 AS STRING) ELSE '' END AS exactly_2 FROM scored""", "stat_tests")
def _(spark, d):
    t, caps, texts = fx.tests(spark, d), _captions(spark, d), fx.fixture(spark, d, "page_texts")
    t = t.withColumn("coef_raw", F.col("coef").cast("int").cast("string")).withColumn("se_cell_text_snippet", F.concat(F.lit("("), F.format_number("paren", 2), F.lit(")")))
    papers = tests.risk_score(tests.test_features(t)).select("paper_id", F.concat(F.lit("Paper "), F.col("paper_id").cast("string")).alias("title"), "risk_score")
    p_ex, t_ex = summary.examples(t, "p"), summary.examples(t, "t")
    titles = report.page_titles(texts, caps, report.page_evidence(texts))
    made = report.report(papers, summary.paper_summary(t), summary.near_by_title(p_ex, caps, "p"), summary.near_by_title(t_ex, caps, "t"), p_ex, t_ex, summary.page_counts(t), titles)
    r = F.col("report")  # what the text says, read back from it
    counts = F.transform(F.regexp_extract_all(r, F.lit(r"- Counts: left=(\d+, right=\d+)"), F.lit(1)), lambda x: F.replace(x, F.lit(", right="), F.lit("/")))
    entries = F.regexp_count(r, F.lit(r"(?m)^\| \d+ \| .* \| `.*` \| `.*` \| "))
    return made.select("paper_id", F.regexp_extract(r, r"^# Screening report: (.*)\n", 1).alias("title"), F.regexp_extract(r, r"Risk score: (\d+)/100", 1).cast("int").alias("score"), F.regexp_extract(r, r"Risk level: (\w+)", 1).alias("level"), F.array_join(counts, " ").alias("counts"), entries.cast("long").alias("entries"), F.regexp_extract(r, r"abs t is exactly 2 in (\d+) of", 1).alias("exactly_2"))


REFS = ("Smith (2001) Title", "jones (2002)")


@query("jn17_reports_with_references", """+r AS (SELECT p_partkey AS paper_id, 'Report on ' || p_name || '.' || CASE p_partkey % 4 WHEN 0 THEN '  SMITH  (2001)' || chr(10) || 'title' WHEN 1 THEN ' Smith (2001) Titles' ELSE ' Smith 2001' END
  || CASE WHEN p_size % 3 = 0 THEN ', Jones' || chr(9) || '(2002)  ' ELSE ' ' || p_brand || chr(10) END AS body FROM part),
f AS (SELECT *, lower(trim(regexp_replace(body, '\\s+', ' ', 'g'))) AS form FROM r)
SELECT paper_id, CASE WHEN contains(form, 'smith (2001) title') AND contains(form, 'jones (2002)') THEN body
  ELSE regexp_replace(body, '\\s+$', '') || chr(10) || chr(10) || '## Sources of the methods' || chr(10) || chr(10) || '- Smith (2001) Title' || chr(10) || '- jones (2002)' || chr(10) END AS report FROM f""", "stat_tests")
def _(spark, d):
    kind = F.col("p_partkey") % 4
    first = F.when(kind == 0, "  SMITH  (2001)\ntitle").when(kind == 1, " Smith (2001) Titles").otherwise(" Smith 2001")
    second = F.when(F.col("p_size") % 3 == 0, F.lit(", Jones\t(2002)  ")).otherwise(F.concat(F.lit(" "), F.col("p_brand"), F.lit("\n")))
    body = F.concat(F.lit("Report on "), F.col("p_name"), F.lit("."), first, second)
    return report.with_references(table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), body.alias("report")), list(REFS))


# a note for each customer: bullets of their orders, some on two lines, some twice, between other sections
@query("src9_reference_lists", """+lines_ AS (SELECT o_custkey AS doc_id, o_orderkey AS n, 'Author ' || o_orderkey % 7 || ' (' || (1990 + o_orderkey % 5) || ')' || CASE WHEN o_orderkey % 3 = 0 THEN ' and so on' ELSE '' END AS ref FROM orders),
once AS (SELECT doc_id, ref, min(n) AS n FROM lines_ GROUP BY ALL) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS pos, ref FROM once""", "stat_tests")
def _(spark, d):
    key = F.col("o_orderkey")
    line = F.concat(F.when(key % 2 == 0, "- ").otherwise("  -  "), F.lit("Author "), (key % 7).cast("string"), F.lit("  ("), (1990 + key % 5).cast("string"), F.lit(")"), F.when(key % 3 == 0, "\n   and so  on").otherwise(" "), F.when(key % 4 == 0, "\n").otherwise(""))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("n"), line.alias("line")))), lambda x: x["line"]), "\n")
    notes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(listed.alias("body"))
    text_ = F.concat(F.lit("# Notes\n- no\n## Other\n- no\n\n## References (APA, with DOI)\n\n"), F.col("body"), F.lit("\n## Next\n- no\n"))
    return report.references(notes.select("doc_id", text_.alias("text"))).select("doc_id", "pos", "ref")


@query("win5_first_seen", "SELECT o_custkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY first) AS INT) AS pos FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL)", "stat_tests")
def _(spark, d):
    return corpus.first_seen(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


# names of a customer's orders in order, with blanks and spaces, merged with the segment's
@query("set4_ordered_merge", """+p AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS a, list(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END ORDER BY o_orderkey DESC) AS b FROM orders GROUP BY 1),
u AS (SELECT o_custkey, list_concat(a, b) AS both_ FROM p),
e AS (SELECT o_custkey, unnest(both_) AS v, unnest(range(len(both_))) AS k FROM u), f AS (SELECT o_custkey, v, min(k) AS k FROM e WHERE v <> '' GROUP BY ALL)
SELECT o_custkey, string_agg(v, '|' ORDER BY k) AS merged FROM f GROUP BY 1""", "stat_tests")
def _(spark, d):
    key, by = F.col("o_orderkey"), lambda x: F.transform(x, lambda e: e["v"])
    left = by(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("v")))))
    right = by(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.when(key % 3 == 0, F.lit("  ")).otherwise(F.concat(F.col("o_orderstatus"), F.lit(" "))).alias("v"))), False))
    return table(spark, d, "orders").groupBy("o_custkey").agg(left.alias("a"), right.alias("b")).select("o_custkey", F.array_join(corpus.merge_unique(F.col("a"), F.col("b")), "|").alias("merged"))


# titles, years and DOIs in several places, or nowhere
@query("meta1_paper_meta", """+s AS (SELECT p_partkey AS paper_id, CASE WHEN p_size % 5 = 0 THEN '  ' ELSE p_name || ' ' END AS title, CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || p_brand END AS author,
  CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type || '. ' END || CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(1890 + p_partkey % 250 AS STRING) || '. ' END AS said, p_partkey % 4 AS kind, '10.1000/x' || p_partkey AS doi FROM part)
SELECT paper_id, CASE WHEN trim(title) <> '' THEN trim(title) ELSE CAST(paper_id AS STRING) END AS title, trim(author) AS authors,
  CAST(nullif(regexp_extract(said || CASE WHEN kind < 2 THEN doi ELSE '' END, '((?:19|20)[0-9]{2})', 1), '') AS INT) AS year,
  nullif(trim(split_part(said || CASE kind WHEN 0 THEN 'doi: ' || doi WHEN 1 THEN 'see ' || doi ELSE '' END, '.', 1)), '') AS venue,
  CASE WHEN kind < 3 THEN 'https://doi.org/' || doi END AS doi_or_url FROM s""", "stat_tests")
def _(spark, d):
    kind, doi, size = F.col("p_partkey") % 4, F.concat(F.lit("10.1000/x"), F.col("p_partkey").cast("string")), F.col("p_size")
    said = F.concat(F.when(size % 7 == 0, "").otherwise(F.concat(F.col("p_type"), F.lit(". "))), F.when(size % 3 == 0, "").otherwise(F.concat((1890 + F.col("p_partkey") % 250).cast("string"), F.lit(". "))))
    subject = F.concat(said, F.when(kind == 0, F.concat(F.lit("doi: "), doi)).when(kind == 1, F.concat(F.lit("see "), doi)).otherwise(""))
    first_page = F.when(kind == 2, F.concat(F.lit("A title\nDOI "), doi, F.lit("\ntext"))).otherwise("no number here")
    papers = table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.when(size % 5 == 0, "  ").otherwise(F.concat("p_name", F.lit(" "))).alias("title"), F.when(size % 2 == 0, "").otherwise(F.concat(F.lit(" "), "p_brand")).alias("author"), subject.alias("subject"), first_page.alias("first_page"))
    return report.paper_meta(papers).select("paper_id", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "doi_or_url")


# names under which the queries over whole inputs were registered before
for _name in ("str1_normal_cells", "str3_numeric_tokens", "str4_paren_tokens", "str6_first_paren", "lay2_row_labels", "lay3_column_labels"):
    QUERIES[_name + "_of_all"], ORACLES[_name + "_of_all"] = QUERIES[_name], ORACLES[_name]
