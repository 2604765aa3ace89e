"""Decontamination against its SQL, all windows compared, and plain suffix comparisons."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from helpers import LONG, ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmill.llm import decontaminate, terms

NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return [w for some in terms.runs(None if text is None else text.encode()) for w in some]


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def plain(rows, items):
    """The contract's columns with the longest match from a hit place, by comparing every window with every place."""
    tests = [("" if i is None else str(i), words(t)) for i, t in items]
    windows = [(name, test[k:], min(10, len(test))) for name, test in tests if test for k in range(len(test) - min(10, len(test)) + 1)]
    first = {}
    for w in windows:
        first.setdefault(w[1][0], []).append(w)
    out = []
    for doc_id, text in rows:
        own, hit, named, longest = words(text), set(), set(), (0, None)
        for p in range(len(own)):
            agree = [(common(own[p : p + 300], rest), size, name) for name, rest, size in first.get(own[p], ())]
            for n, size, name in agree:
                if n >= size:
                    hit.update(range(p, p + size))
                    named.add(name)
            if (most := max((n for n, size, _ in agree if n >= size), default=0)) > longest[0]:
                longest = (most, p)
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(named), digest, bool(hit), *longest))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, words string, spans string")


def planted():
    rng = random.Random(8)
    lexicon = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(lexicon, k=rng.choice([1, 4, 9, 10, 11, 30])))) for k in range(25)]
    items += [(3, "ONE more, of the Same id: with ten words and a tail"), (None, "No id has this item, of more than ten words in all"), (90, ""), (91, None), (92, "!?"), (93, items[5][1]), (94, items[5][1] + " w1 w2"), (95, "Ünï cödé 漢字")]
    rows = list(ODD)
    for k in range(60):
        parts = [" ".join(rng.choices(lexicon, k=rng.randrange(40)))]
        for _ in range(rng.randrange(3)):
            cut = words(rng.choice(items)[1])
            parts += [b" ".join(cut[: rng.randrange(len(cut) + 1)]).decode().upper(), "x" * rng.randrange(3)]
        rows.append((100 + k % 50, " ".join(parts)))
    return [*rows, (200, LONG + items[3][1] + " " + LONG), (201, "it has cödé here, ÜNÏ ünï cödé 漢字")], items


@pytest.mark.parametrize("part", [decontaminate.PART, 400])
def test_all_windows(spark, part):
    rows, items = planted()
    want = plain(rows, items)
    assert 10 < sum(r[5] for r in want) < len(want) - 5
    got = decontaminate.report(docs(spark, rows).repartition(3), bench(spark, items), part)
    assert got.columns == [*NAMES, "longest", "longest_at"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    clean = decontaminate.decontaminated(docs(spark, rows), bench(spark, items), part)
    assert clean.columns == docs(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted((r for r in rows if not plain([r], items)[0][5]), key=str)


@pytest.mark.parametrize("items", [[], [(1, None), (2, " -- ")]])
def test_without_windows_or_documents(spark, items):
    got = decontaminate.report(docs(spark, ODD), bench(spark, items)).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in got if r["doc_id"] is not None) == sorted((i, len(words(t))) for i, t in ODD if i is not None)
    assert not any(r["contaminated"] for r in got) and {r["items_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert decontaminate.report(docs(spark, []), bench(spark, [(1, "a b")])).count() == 0


def test_sql_on_odd_rows(spark):
    rows, items = planted()
    rows = [(i, t[:3000] if t else t) for i, t in rows]  # the SQL takes a copy of a text's words for each of its places
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", [list(r) for r in items])
    want = sorted(c.sql(decontaminate.SQL).select(*NAMES).fetchall(), key=str)
    assert want == sorted((r[:6] for r in plain(rows, items)), key=str)


def test_small_pieces_and_shards_lose_nothing(monkeypatch):
    """A text longer than a piece, an item longer than its pieces, and shards that end within a document."""
    rng = random.Random(2)
    monkeypatch.setattr(terms, "PIECE", 64)
    monkeypatch.setattr(decontaminate, "SHARD", 50)
    item = [f"t{rng.randrange(9)}".encode() for _ in range(200)]
    tests = decontaminate.tests_of([("a", item)])
    text = b" ".join([f"t{rng.randrange(9)}".encode() for _ in range(150)] + item[20:120] + [b"zz"] + item)
    shard, hit, best = decontaminate.Shard(tests), set(), 0

    def flush():
        nonlocal best
        for _, place, window, longest in zip(*(x.tolist() for x in shard.matches())):
            hit.update(range(place, place + int(tests.length[window])))
            best = max(best, longest)

    n = shard.add(0, text, flush)
    flush()
    want = plain([(0, text.decode())], [("a", b" ".join(item).decode())])[0]
    assert (n, len(hit), best) == (want[1], want[2], want[6]) and best == 200


@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=12), min_size=1, max_size=6), st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=6), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_suffix_arrays(stretches, queries):
    text = np.array([w for s in stretches for w in (*s, -1)], np.int32)
    starts = np.flatnonzero(text >= 0)

    def suffix(i):
        return text[i : i + int(np.argmax(text[i:] < 0))].tolist()

    order = decontaminate.suffix_array(text, starts, 13)
    assert sorted(order.tolist()) == starts.tolist()
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in starts)
    flat = np.array([w for q in queries for w in (*q, -1)], np.int32)
    lengths = np.array(list(map(len, queries)))
    begin = np.cumsum(lengths + 1) - lengths - 1
    low, high = (decontaminate.search(text, order, flat, begin, lengths, u) for u in (False, True))
    for k, q in enumerate(queries):
        assert sorted(order[low[k] : high[k]].tolist()) == [i for i in starts.tolist() if suffix(i)[: len(q)] == q]
