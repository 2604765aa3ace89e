"""Whitening against a plain eigen-decomposition of exactly centred rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from siftmill.llm import catalog, whitening
from siftmill.llm.shared import table

SCHEMA = "vec_id long, embedding array<float>, label int, component string, x string, whitened string, exact string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c", "d") for i, v in rows], SCHEMA)


def plain(rows, components=32):
    """vec_id -> list of (deviation, |projections|), eigenvalues' shares; by exact fractions and numpy's eigh."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in kept]
    n = len(x)
    sums = [sum(r[k] for r in x) for k in range(width)]
    deviations = [sum((n * r[k] - sums[k]) ** 2 for k in range(width)) for r in x]
    centred = np.array([[float(Fraction(n * r[k] - sums[k], n)) for k in range(width)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [i for i, _ in kept], deviations, centred @ vectors / np.sqrt(values), values / (sum(deviations) / n**3)


def compare(got, rows, components=32):
    ids, deviations, projected, shares = plain(rows, components)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    assert len(got) == len(ids) * len(shares)
    want = {}
    for k, key in enumerate(zip(ids, deviations)):
        want.setdefault(key, []).append(k)
    assert set(by) == set(want)
    signs = {}
    for key, at in want.items():
        for r in by[key]:
            j = r["component"] - 1
            assert r["n"] == len(ids) and abs(r["explained"] - shares[j]) <= 1e-9 * shares[j] and r["identity_error"] < 1e-9
            p = projected[at[0], j]
            if abs(p) > 1e-3 and j not in signs:
                signs[j] = np.sign(p) * np.sign(r["whitened"])
            assert abs(abs(r["whitened"]) - abs(p)) < 1e-6
    for key, at in want.items():
        assert all(abs(r["whitened"] * signs.get(r["component"] - 1, 1) - projected[at[0], r["component"] - 1]) < 1e-6 for r in by[key])


def test_query_on_the_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    compare(catalog.QUERIES["op13_embedding_whitening"](spark, sf).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(1, rows[0][1]), (1, rows[0][1]), (None, rng.normal(size=6).tolist()), (50, None), (51, [1.0] * 5 + [None]), (52, [math.nan] * 6), (53, [math.inf] + [0.0] * 5), (54, [0.5, -0.5]), (55, [])]
    got = whitening.whiten(frame(spark, rows)).collect()
    compare(got, rows)
    assert {r["component"] for r in got} == {1, 2, 3, 4, 5, 6} and not {50, 51, 52, 53} & {r["vec_id"] for r in got}


@pytest.mark.parametrize("rows", [[], [(1, [0.25] * 4)], [(i, [0.25] * 4) for i in range(5)], [(1, None)], [(1, []), (2, [])]])
def test_tables_without_components(spark, rows):
    made = whitening.whiten(frame(spark, rows))
    assert made.count() == 0 and made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "exact"]


def test_equal_dimensions_leave_fewer_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [a, a, b]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)).tolist())]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2}
    compare(got, rows, 2)


def test_beyond_a_long(spark):
    """Deviations that no long holds are null there and exact beside; infinite ones cannot be."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * 1e12).tolist()) for i in range(30)] + [(99, [3e38, 0.0, 0.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    kept = [[max(min(math.floor(64 * float(np.float32(c))), 1 << 61), -(1 << 61)) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(r[k] for r in kept) for k in range(3)]
    want = {i: sum((31 * r[k] - sums[k]) ** 2 for k in range(3)) for (i, _), r in zip(rows, kept)}
    assert {r["vec_id"]: int(r["exact"]) for r in got} == want and all(r["deviation"] is None for r in got)
    small, n = rng.integers(-5, 6, size=(7, 4)), 7
    sums = small.sum(axis=0).tolist()
    fast, slow = whitening.centred(small, n, sums), whitening.centred(small + (1 << 60), n, [s + n * (1 << 60) for s in sums])
    assert np.allclose(fast[0], slow[0]) and fast[1] == slow[1]
