import math

import pytest
from pyspark.sql import functions as F

from siftmill import fixed
from siftmill.functions import stats
from siftmill.operators import tests as ops


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "x, center, delta, want",
    [(0.045, 0.05, 0.005, 0), (0.05, 0.05, 0.005, -1), (0.0500001, 0.05, 0.005, 1), (0.105, 0.10, 0.005, 1), (2.16, 1.96, 0.20, 1), (1.96, 1.96, 0.20, -1), (2.17, 1.96, 0.20, 0)],
)
def test_side(spark, x, center, delta, want):
    assert one(spark, stats.side(F.col("v"), center, delta), v=x) == want


def test_side_of_nothing(spark):
    assert one(spark, stats.side(F.col("v"), 0.05, 0.005), v=float("nan")) == 0
    assert spark.range(1).select(stats.side(F.lit(None).cast("double"), 0.05, 0.005).alias("x")).first()["x"] == 0


def test_bin_side_takes_its_bounds_as_given(spark):
    assert one(spark, stats.bin_side(F.col("v"), *fixed.BINS["p_0_05"]), v=0.045) == -1


@pytest.mark.parametrize("k, n, want", [(0, 1, 1.0), (5, 10, 1.0), (0, 0, None), (200, 400, 1.0), (3, 2, None)])
def test_binomial_edges(spark, k, n, want):
    assert one(spark, stats.binomial_p(F.col("k"), F.col("n")), k=k, n=n) == want


def test_binomial_is_exact_and_symmetric(spark):
    pairs = [(k, n) for n in (1, 2, 7, 30, 101, 400) for k in {0, 1, n // 3, n // 2, n}]
    rows = spark.createDataFrame(pairs, "k int, n int").select("k", "n", stats.binomial_p(F.col("k"), F.col("n")).alias("p"), stats.binomial_p(F.col("n") - F.col("k"), F.col("n")).alias("q")).collect()
    for r in rows:
        far = abs(r["k"] - r["n"] / 2)
        want = sum(math.comb(r["n"], x) for x in range(r["n"] + 1) if abs(x - r["n"] / 2) >= far) / 2 ** r["n"]
        assert r["p"] == pytest.approx(min(1.0, want), abs=1e-12)
        assert r["p"] == pytest.approx(r["q"], abs=1e-12)


def test_binomial_beyond_exact(spark):
    z = (2 * 230 - 420) / math.sqrt(420)
    assert one(spark, stats.binomial_p(F.col("k"), F.col("n")), k=230, n=420) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-10)


def test_erfc(spark):
    values = [0.0, 0.3, 1.0, 1.39, 2.9, 3.0, 4.5, 8.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", stats.erfc(F.col("v")).alias("a")).collect()
    for r in rows:
        assert r["a"] == pytest.approx(math.erfc(r["v"]), rel=2e-14, abs=1e-300)


def test_bounds_on_t_are_bounds_on_p(spark):
    values = [i / 1000 for i in range(0, 4000, 7)]
    t = F.col("v")
    p = stats.p_of_t(t)
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        stats.p_side(t, 0.05, 0.005).alias("a"), stats.side(p, 0.05, 0.005).alias("b"), stats.p_at_most(t, 0.025).alias("c"), (p <= 0.025).alias("d")
    )
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows.collect())


def test_small_functions(spark):
    assert one(spark, stats.cap01(F.col("v")), v=float("nan")) == 0.0
    assert one(spark, stats.cap01(F.col("v")), v=7.0) == 1.0
    assert one(spark, stats.caliper_z(F.col("l"), F.col("r")), l=0, r=0) == 0.0
    assert one(spark, stats.caliper_z(F.col("l"), F.col("r"), "right"), l=1, r=3) == 1.0
    assert one(spark, stats.year_like(F.col("v")), v=1799.5) is True  # half to even: 1800
    assert one(spark, stats.year_like(F.col("v")), v=2100.5) is True  # half to even: 2100
    assert one(spark, stats.small_int_like(F.col("v")), v=30.0) is True
    assert one(spark, stats.small_int_like(F.col("v")), v=0.5) is False
    assert one(spark, stats.overlap(F.lit(0.0), F.lit(10.0), F.lit(8.0), F.lit(20.0))) == 2.0
    assert [one(spark, stats.risk_level(F.col("v")), v=v) for v in (70, 69, 40, 39)] == ["High", "Moderate", "Moderate", "Low"]
    assert one(spark, stats.risk_level(F.col("v"), fixed.EXPERT_LEVELS), v=34) == "Moderate"
    assert stats.retry_delay(1) == 1.0 and stats.retry_delay(9) == 20.0


def test_risk_score(spark):
    empty = {c: 0.0 for c in fixed.Z_WEIGHTS}
    rows = [(1, 0, 0, 0), (2, 1, 0, 0), (3, 0, 10, 8), (4, 8, 0, 0)]
    frame = spark.createDataFrame(rows, "paper_id int, multiple_testing_terms int, robust_terms int, specification_terms int")
    for name, v in empty.items():
        frame = frame.withColumn(name, F.lit(v))
    got = {r["paper_id"]: (r["risk_score"], r["risk_level"]) for r in ops.risk_score(frame).collect()}
    assert got == {1: (20, "Low"), 2: (10, "Low"), 3: (42, "Moderate"), 4: (16, "Low")}
    top = frame.filter("paper_id = 3")
    for name, w in fixed.Z_WEIGHTS.items():
        top = top.withColumn(name, F.lit(99.0 if w > 0 else -99.0))
    assert ops.risk_score(top).first()["risk_score"] == 75  # the greatest that can be reached


def test_sides_and_halves_add_up(spark, sf):
    from siftmill.plans import fixtures

    made = ops.test_features(fixtures.tests(spark, sf))
    for r in made.collect():
        assert r["curve_low"] + r["curve_high"] == r["significant_0_05"] <= r["significant_0_10"] <= r["tests"]
