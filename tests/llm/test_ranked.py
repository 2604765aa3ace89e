"""Ranked search against scores of all documents; graph bisection; its SQL on odd rows."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import LONG, ODD, docs

from siftmill.llm import bisection, catalog, ranked, terms
from siftmill.llm.shared import table


def words(text):
    return [w for some in terms.runs(None if text is None else text.encode()) for w in some]


def plain(rows, items, top=10):
    """(item, rank, doc, score), by scoring every document."""
    counts = [(i, c, sum(c.values())) for i, t in rows if (c := Counter(words(t)))]
    n, tokens = len(counts), sum(k for _, _, k in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, own in asked.items():
        scores = []
        for doc, c, size in counts:
            m = 100 - 90 + 90 * size * n // tokens
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s:
                scores.append((-s, doc is not None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in items], "item_id long, text string, terms string, shard string, rank string")


def rows_and_items():
    rng = random.Random(12)
    lexicons = [[f"{c}{k}" for k in range(80)] for c in "abcd"]
    rows = list(ODD)
    for k in range(400):
        own = lexicons[k % 4] + [f"common{j}" for j in range(10)]
        rows.append((1000 - k, " ".join(rng.choices(own, k=rng.randrange(1, 90))).title()))
    rows += [(5000 + k, "a1 a2 a3 copies of one text that ties") for k in range(60)] + [(7, "a1 a2 a3 copies of one text that ties")] * 3 + [(None, "a1 a2 a3 copies of one text that ties"), (8, LONG + "a7 b7")]
    items = [(k, " ".join(rng.choices(lexicons[k % 4] + lexicons[(k + 1) % 4], k=rng.randrange(1, 25)))) for k in range(40)]
    items += [(90, "copies of one text, that ties"), (91, None), (92, ""), (93, "zzz unknown"), (None, "c1 c2 c3"), (3, "more A1 of the same item"), (94, "common1 common2 common1"), (95, "漢字 Ünïcode")]
    return rows, items


@pytest.mark.parametrize("size", [ranked.DOCS, 7])
def test_against_scores_of_all_documents(spark, monkeypatch, size):
    rows, items = rows_and_items()
    want = plain(rows, items)
    monkeypatch.setattr(ranked, "DOCS", size)
    own = ranked.index(docs(spark, rows).repartition(5))
    if size == 7:  # tasks have the module's own size; so small shards come of many ranges
        spark.conf.set("spark.sql.shuffle.partitions", 60)
        try:
            own = ranked.index(docs(spark, rows).repartition(5))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert own.shards.count() > 40
    got = ranked.search(own, bench(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_only_shards_that_may_count_are_visited(spark, monkeypatch):
    """With a group of texts that alone answer a query, shards of other texts stay closed."""
    rows = [(k, f"only{k % 3} here there") for k in range(12)] + [(100 + k, f"there noise{k % 9} more{k % 5} " * 4) for k in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        own = ranked.index(docs(spark, rows).repartition(4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    items = [(1, "only0 only1 only2 here there")]
    opened = []
    kept = ranked.Shelf.put
    monkeypatch.setattr(ranked.Shelf, "put", lambda self, df: (out := kept(self, df), "queries" in df.columns and opened.extend(r["shard"] for r in out.select("shard").collect()))[0])
    got = ranked.search(own, bench(spark, items)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, items)
    assert len(set(opened)) < own.shards.count() / 2


def test_empty_tables(spark):
    assert ranked.ranked(docs(spark, []), bench(spark, [(1, "a")])).count() == 0
    assert ranked.ranked(docs(spark, [(1, None), (2, " ")]), bench(spark, [(1, "a")])).count() == 0
    none = ranked.ranked(docs(spark, ODD), bench(spark, []))
    assert none.count() == 0 and [t for _, t in none.dtypes] == ["bigint", "int", "bigint", "bigint"]


def test_query_on_the_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    got = catalog.QUERIES["op11_ranked_lexical_search"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, items)


def test_sql_on_odd_rows():
    rows, items = rows_and_items()
    rows = [r for r in dict.fromkeys(rows) if r[0] is not None]  # of equal rows and null ids the SQL has its own order
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", [list(r) for r in items])
    got = c.sql(ranked.SQL).select("item_id", "rank", "doc_id", "score").fetchall()
    assert sorted((r for r in got if r[0] is not None), key=str) == [r for r in plain(rows, items) if r[0] is not None]


def test_bisection_brings_like_documents_together():
    rng = random.Random(3)
    lexicons = [[f"{c}{k}".encode() for k in range(40)] for c in "abcd"]
    kinds = [rng.randrange(4) for _ in range(800)]
    sample = [sorted(set(rng.choices(lexicons[k], k=12))) for k in kinds]
    tree = bisection.fit(sample, 3)
    leaf = tree.leaves(sample)
    assert tree.depth == 3 and leaf.min() == 0 and leaf.max() == 7
    pure = sum(max(Counter(k for k, x in zip(kinds, leaf.tolist()) if x == n).values()) for n in set(leaf.tolist()))
    assert pure > 0.95 * len(kinds)
    sizes = np.bincount(leaf)
    assert sizes.max() < 2.5 * len(kinds) / 8
    assert bisection.fit([], 4).leaves([[b"x"]]).tolist() == [0]
    assert bisection.fit([[b"x"]] * 50, 4).leaves([[b"x"], []]).tolist() == [0, 0]  # one text has no halves
