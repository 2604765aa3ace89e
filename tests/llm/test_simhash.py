import numpy as np
import pytest
import xxhash
from helpers import LONG, ODD, docs

from siftmill.llm import components, shared, simhash


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, tau=3):
    """(fingerprint, least id reachable) of each row, by comparing all."""
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= tau:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, f"{p:016x}", least.get(find(i))) for i, ((k, _), p) in enumerate(zip(rows, prints))]


def as_rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_odd_rows(spark):
    assert as_rows(simhash.near_duplicates(docs(spark, ODD))) == sorted(plain_components(ODD), key=str)


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0


def near_prints(seed=1, groups=40, size=30):
    """Fingerprints in groups of near ones, with chains, by random flips."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        at = int(rng.integers(0, 2**63))
        for _ in range(size):
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                at ^= 1 << int(b)
            out.append(at if at < 2**63 else at - 2**64)
    return sorted(set(out))


@pytest.mark.parametrize("hot", [simhash.HOT_BUCKET, 5])
def test_links_have_the_components_of_all_pairs(spark, hot):
    prints = near_prints()
    frame = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(5)
    shelf = shared.Shelf(spark, "test")
    links = simhash.links(frame, 3, hot)
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    unsigned = lambda v: v % 2**64
    assert all((unsigned(a) ^ unsigned(b)).bit_count() <= 3 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in components.connect(links, shelf).collect()}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    array = np.array(prints, np.int64).view(np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 3):
            root[find(p)] = find(prints[i + 1 + int(j)])
    groups = {}
    for p in prints:
        groups.setdefault(find(p), set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_dense_group_gives_a_forest(spark):
    base = 0x123456789ABCDEF
    prints = [base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)]
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long").repartition(4))
    assert links.count() < 40 * len(prints)  # not the square


@pytest.mark.parametrize("tau", [3])
def test_plan_obeys_the_pigeonhole(tau):
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (5000, 64))
    together = bits.T @ bits
    parts = simhash.plan(5000, together, tau)
    for m in simhash.PART_COUNTS:
        groups = simhash.group_bits(5000, together, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, thresholds = simhash.allocate(5000, together, groups, tau)
        assert sum(thresholds) == tau - m + 1
    assert len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components.connect(frame, shared.Shelf(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 300)}}


def test_keep_one(spark):
    rows = [*ODD, (9, LONG), (8, LONG)]
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=str)
    groups = {}
    for (k, t), (_, p, c) in zip(rows, plain_components(rows)):
        groups.setdefault(c if c is not None else p, []).append(k)
    assert len(got) == len(groups)
    assert got == sorted((c if not isinstance(c, str) else None for c in groups), key=str)


def test_keep_one_of_components_without_ids_or_with_the_same_least_id(spark):
    a, b, c, d = (" ".join(f"{letter}{i * i}" for i in range(60)) for letter in "abcd")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (9, d), (None, c)]
    assert len({plain_print(t) for t in (a, b, c, d)}) == 4
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (7, c), (7, d)], key=str)
