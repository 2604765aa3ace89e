"""The near-duplicate stage of the pipeline against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from helpers import ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmill.llm import nearcopies, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows):
    """The indexes of rows in components of pairs with Jaccard >= 0.8, by comparing all."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def near_rows():
    """Texts with copies of 1 to 9 edits in 60 to 400 words, on both sides of Jaccard 0.8, with chains and a dense group."""
    rng = random.Random(5)
    rows = []
    for size in (60, 100, 200, 400):
        for edits in (1, 2, 4, 9):
            for _ in range(4):
                words = [f"w{rng.randrange(3000)}" for _ in range(size)]
                rows.append(words)
                for _ in range(3):
                    words = edited(rng, words, edits)
                    rows.append(words)
    base = [f"d{i}" for i in range(300)]
    rows += [edited(rng, base, 3) for _ in range(40)]
    ids = rng.sample(range(10_000), len(rows))
    return [(i, " ".join(w)) for i, w in zip(ids, rows)]


def test_stage_keeps_one_of_each_component(spark, tmp_path):
    rows = near_rows()
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.no_near_duplicates(spark, docs(spark, rows).repartition(5), str(tmp_path)).collect()]
    want = [min(rows[i] for i in group) for group in plain_groups(rows)]
    assert len(want) < len(rows) // 2
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("most", [4000, 20_000])
def test_buckets_that_are_too_large_are_dealt_out(spark, most):
    """A spread group of near copies, few of which are near one another, whose buckets are over the limit again and again."""
    rng = random.Random(9)
    base = [f"d{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(1, 4)))) for i in range(120)] + [(500 + i, t) for i, (_, t) in enumerate(near_rows()[:40])]
    want = sorted(min(rows[i] for i in group) for group in plain_groups(rows))
    assert 25 < len(want) < 130
    got = nearcopies.keep_one(docs(spark, rows).repartition(3), most).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == want


@given(st.lists(st.tuples(st.frozensets(st.integers(0, 14), min_size=1, max_size=12), st.integers(0, 30)), min_size=2, max_size=14))
@settings(max_examples=300, deadline=None)
def test_forests_join_what_all_pairs_join(nodes):
    sets = [np.array(sorted(s), np.uint64) for s, _ in nodes]
    roots = [r for _, r in nodes]

    def joined(edges):
        at = list(range(len(nodes)))
        for i, j in [*edges, *((i, roots.index(r)) for i, r in enumerate(roots))]:
            at = [at[i] if x == at[j] else x for x in at]
        return [at.index(x) for x in at]

    near = [(i, j) for i, (a, _) in enumerate(nodes) for j, (b, _) in enumerate(nodes) if i < j and 5 * len(a & b) >= 4 * len(a | b)]
    made = nearcopies.forest(list(range(len(nodes))), roots, sets)
    assert all((min(e), max(e)) in near for e in made) and len(made) < len(set(roots))
    assert joined(made) == joined(near)


def test_sets_of_one_name_are_told_apart(spark):
    """With three names for all sets, different sets get different ones."""
    rows = near_rows()[:60]
    made = [(i, t, nearcopies.shingle_set(t.encode())) for i, t in rows]
    frame = spark.createDataFrame([(i, t, k % 3, nearcopies.node(s)[1], len(s), nearcopies.buckets(s).tolist()) for k, (i, t, s) in enumerate(made)], "doc_id long, text string, m long, m_other long, m_size long, m_buckets array<long>")
    named = nearcopies.told_apart(frame, "m", nearcopies.Shelf(spark, "names")).select("m", "m_other").distinct().collect()
    assert len({r["m"] for r in named}) == len(named) >= len({s.tobytes() for _, _, s in made}) > 3


def test_a_pair_that_shares_two_buckets_meets_again():
    """Of any two bands one is among those that the other's too large bucket is dealt to."""
    n, dealt = nearcopies.BANDS, nearcopies.DEALT
    onward = {b: {(b + i) % n for i in range(1, n)} if dealt >= n else {(b + i) % n for i in range(1, dealt + 1)} for b in range(n)}
    assert all(a in onward[b] or b in onward[a] for a in range(n) for b in range(a))


def test_simhash_alone_joins_what_is_within_its_bits(spark):
    """Without a single min-hash bucket the SimHash search still joins near copies of few bits, and nothing that is not near."""
    rng = random.Random(3)
    rows = [(10 * k + i, " ".join(w)) for k in range(30) for base in [[f"k{k}w{n}" for n in range(600)]] for i, w in enumerate((base, base, edited(rng, base, 1), edited(rng, base, 60)))]
    sets = {i: nearcopies.shingle_set(t.encode()) for i, t in rows}
    names, prints = {i: nearcopies.node(s)[0] for i, s in sets.items()}, {i: simhash.fingerprint_of(s) for i, s in sets.items()}
    mark = nearcopies.PRINT
    made = [(i, t, names[i], len(sets[i]), prints[i] - (prints[i] >> 63 << 64), []) for i, t in rows]
    frame = spark.createDataFrame(made, f"doc_id long, text string, {mark} long, {mark}_size long, {mark}_simhash long, {mark}_buckets array<long>")
    shelf = nearcopies.Shelf(spark, "simhash-alone")
    nodes = frame.select(nearcopies.F.col(mark).alias("fp"), nearcopies.F.col(mark + "_size").alias("size"), nearcopies.F.col(mark + "_simhash").alias("print")).distinct()
    links = {frozenset((r["a"], r["b"])) for r in nearcopies.by_simhash(nodes, frame, shelf).collect()}
    within = {k for k in range(30) if (prints[10 * k] ^ prints[10 * k + 2]).bit_count() <= nearcopies.TAU}
    assert len(within) > 10
    assert links == {frozenset((names[10 * k], names[10 * k + 2])) for k in within}
    roots = {r["fp"] for r in nearcopies.components(frame, shelf).collect()}
    assert roots == {max(names[10 * k], names[10 * k + 2]) for k in within}


def test_sums_of_buckets_are_not_sorted(spark):
    """A sort of all filed rows takes pages of an executor's memory for each task."""
    rows = spark.createDataFrame([(1, 2, 3, 2), (1, 4, 3, 4), (5, 2, 3, 2), (5, 4, 3, 4), (6, 2, 3, 2)], "g long, fp long, size long, root long")
    made = nearcopies._buckets_of(rows)
    assert [tuple(r) for r in made.collect()] == [(1, 6, 2)]
    assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_odd_rows(spark):
    rows = [*ODD, (None, "quite another text without an id here")]
    made = nearcopies.keep_one(docs(spark, rows))
    assert made.columns == docs(spark, rows).columns
    want = [min((rows[i] for i in group), key=lambda r: (r[0] is None, r[0] or 0)) for group in plain_groups(rows)]
    assert sorted((r["doc_id"] for r in made.collect()), key=str) == sorted((k for k, _ in want), key=str)
    assert nearcopies.keep_one(docs(spark, [])).count() == 0
