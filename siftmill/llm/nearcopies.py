"""Near copies by word shingles: texts whose sets of five-word shingles have Jaccard >= 0.8.

Search by SimHash: each set's 64-bit SimHash goes through the operator's search (``simhash.links``, the
generalised pigeonhole with its hot buckets), which gives a spanning forest of the fingerprints within
``TAU`` bits; nodes of one fingerprint are tied to the least of them. Each of these pairs is verified by the
exact Jaccard of its sets, and what is near joins components before anything else is looked at.

What lies further apart: at Jaccard 0.8 two SimHashes differ in 9.7 of 64 bits on average (standard
deviation 2.9), so that a threshold which misses one pair in a thousand is about 19 bits, where the
pigeonhole principle no longer sifts. So pairs that SimHash leaves apart come from min-hashes: ``BANDS``
buckets of ``ROWS`` minima each, which a pair at Jaccard j shares none of with chance
(1 - j ** ROWS) ** BANDS, about 5e-8 at 0.8 and less above. A bucket of one component is passed over; each
candidate pair that could join two components is verified by the exact Jaccard of its sets.

Texts with the same set are one node. A bucket's sets meet in one task, which gives out a spanning
forest of the near pairs (breadth first: a node that is reached is compared with those that are not),
never its pairs; buckets with the same members are one. A bucket of more than ``MOST`` shingles is not
gathered: its members are compared with its least one, which joins what is nearly equal, and where
components remain they are dealt out by ``DEALT`` further buckets each, again until none is too large. Dealt
by half of the bands in their circular order, a pair that shares two buckets always meets again: of any two
bands one is among the next half after the other. At 0.8 one pair in a million shares just one bucket; it is
lost where that one is too large.

A set's name is 64 bits of a hash of 128; where two different sets have one name (the other 64 bits
tell), all but one of them get another.

Defined cases: words are lower-case (ASCII) runs between white space; texts of fewer than five words
are one shingle; the shingles of a text of any length all count; null and word-less texts have the
empty set and are copies of one another; an empty table gives an empty result; columns of any name are
kept as they are; which row of a group stays is defined for ties and repeated rows too.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm import bloom, simhash
from siftmill.llm.components import connect
from siftmill.llm.shared import Shelf, columns, quoted, small, unused, utf8_list
from siftmill.llm.simhash import PRINT, one_of_each, shingles

WORDS = 5
#: The least Jaccard of near copies as a fraction.
NEAR = (4, 5)
#: Within how many bits SimHashes are searched. Two more find three times as many pairs, and file twice as many rows.
TAU = 5
BANDS, ROWS = 32, 4
#: The greatest number of shingles, over all its sets, of a bucket that meets in one task, and into how many others a member of a greater one goes.
MOST, DEALT = 1 << 19, BANDS // 2
BLOCK = 2048

_draw = np.random.default_rng(42)
_FACTORS = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFTS = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The different shingles of a UTF-8 text, in ascending order."""
    return np.unique(shingles(text, WORDS))


def node(members: np.ndarray) -> tuple[int, int]:
    """The name of a set and what tells sets of one name apart: both halves of a hash of 128 bits, signed."""
    digest = xxhash.xxh3_128_digest(members.tobytes())
    return int.from_bytes(digest[8:], "big", signed=True), int.from_bytes(digest[:8], "big", signed=True)


def buckets(members: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of a set; none of the empty one."""
    if not len(members):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), BLOCK):
        np.minimum(least, (members[at : at + BLOCK, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    keys = [xxhash.xxh3_64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have Jaccard of at least NEAR."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * NEAR[1] >= (len(a) + len(b) - shared) * NEAR[0]


#: What is added to a row's columns: the name of its set, what tells sets of one name apart, its size, SimHash and buckets.
ENDS = ("", "_other", "_size", "_simhash", "_buckets")


def _print(mark: str):
    """Adds the columns of ENDS to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_set(t) for t in utf8_list(columns(batch, "text")[0])]
            names, others = zip(*map(node, sets)) if sets else ((), ())
            prints = np.array([simhash.fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
            made = (pa.array(names, pa.int64()), pa.array(others, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()), pa.array([buckets(s) for s in sets], pa.list_(pa.int64())))
            yield pa.record_batch([*batch.columns, *made], names=[*batch.schema.names, *(mark + end for end in ENDS)])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        fp, texts = columns(batch, "fp", "text")
        yield pa.record_batch([fp, pa.array([shingle_set(t).tobytes() for t in utf8_list(texts)], pa.binary())], names=["fp", "members"])


def forest(names: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Near pairs that join all that near pairs join, of nodes of which those with one root are joined already."""
    whole = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    parts: dict[int, list[int]] = {}
    for i, root in enumerate(roots):
        parts.setdefault(root, []).append(i)
    left = np.ones(len(sets), bool)
    rest, of = whole, owner  # the shingles of the nodes that are left, and whose they are
    found: list[tuple[int, int]] = []
    for members in sorted(parts.values(), key=len, reverse=True):
        if not left[members[0]]:
            continue
        left[members] = False
        queue = list(members)
        keep = left[of]
        rest, of = rest[keep], of[keep]
        while queue and len(rest):
            i = queue.pop()
            mine = sets[i]
            at = np.minimum(np.searchsorted(mine, rest), len(mine) - 1)
            shared = np.bincount(of[mine[at] == rest], minlength=len(sets))
            near_ = np.flatnonzero(left & (shared * NEAR[1] >= (sizes + sizes[i] - shared) * NEAR[0]))
            for j in near_.tolist():
                if left[j]:
                    found.append((names[i], names[j]))
                    left[parts[roots[j]]] = False
                    queue.extend(parts[roots[j]])
            if len(near_):
                keep = left[of]
                rest, of = rest[keep], of[keep]
    return found


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket."""
    group: object = None
    held: tuple[list, list, list] = ([], [], [])
    for batch in small(batches, 256):
        edges: list[tuple[int, int]] = []
        for g, fp, root, members in zip(*(c.to_pylist() for c in columns(batch, "g", "fp", "root", "members"))):
            if g != group:
                if len(held[0]) > 1:
                    edges += forest(*held)
                group, held = g, ([], [], [])
            for to, x in zip(held, (fp, root, np.frombuffer(members, np.uint64))):
                to.append(x)
        a, b = zip(*edges) if edges else ((), ())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    if len(held[0]) > 1:
        a, b = zip(*edges) if (edges := forest(*held)) else ((), ())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        a, b, left, right = columns(batch, "a", "b", "left", "right")
        kept = pa.array([near(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(left, right)], pa.bool_())
        yield pa.record_batch([a.filter(kept), b.filter(kept)], names=["a", "b"])


def _sets_of(wanted: DataFrame, printed: DataFrame, shelf: Shelf) -> DataFrame:
    """fp, members of the nodes that are ``wanted`` (fp): copies are one before anything is moved."""
    wanted = shelf.put(wanted.distinct())
    likely = bloom.test(bloom.build(wanted, "fp"))
    texts = printed.select(F.col(PRINT).alias("fp"), "text").filter(likely(F.col("fp"))).groupBy("fp").agg(F.first("text").alias("text"))
    return shelf.put(texts.join(wanted, "fp", "left_semi").mapInArrow(_sets, "fp long, members binary"))


def _verified(pairs: DataFrame, printed: DataFrame, shelf: Shelf) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are near."""
    pairs = shelf.put(pairs.distinct())
    sets = _sets_of(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")), printed, shelf)
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("members").alias("left")), "a").join(sets.select(F.col("fp").alias("b"), F.col("members").alias("right")), "b")
    return shelf.put(both.select("a", "b", "left", "right").mapInArrow(_near, "a long, b long"))


def _buckets_of(rows: DataFrame) -> DataFrame:
    """g, weight, least of the buckets that hold several components; of those with the same members one. rows: g, fp, size, root."""
    sums = rows.groupBy("g").agg(
        F.count("*").alias("n"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "fp")).alias("y"),
        F.min("fp").alias("least"), F.min("root").alias("low"), F.max("root").alias("high"),
    )
    return sums.filter("low <> high").groupBy("n", "weight", "x", "y").agg(F.min("g").alias("g"), F.min("least").alias("least")).select("g", "weight", "least")


def _sizes_fit(x: str, y: str) -> Column:
    x, y = F.col(x), F.col(y)
    return (x * NEAR[1] >= y * NEAR[0]) & (y * NEAR[1] >= x * NEAR[0])


def by_simhash(nodes: DataFrame, printed: DataFrame, shelf: Shelf) -> DataFrame:
    """Near pairs (a, b) of nodes that the search of SimHashes within TAU bits finds. nodes: fp, size, print."""
    least = shelf.put(nodes.groupBy("print").agg(F.min("fp").alias("fp"), F.count("*").alias("n")))
    links = simhash.links(least.select(F.col("print").alias("fp")), TAU, shelf=shelf)
    of = [least.select(F.col("print").alias(end), F.col("fp").alias("node_" + end)) for end in ("a", "b")]
    across = links.distinct().join(of[0], "a").join(of[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    within = nodes.select("print", F.col("fp").alias("b")).join(least.filter("n > 1").select("print", F.col("fp").alias("a")), "print").filter("a <> b").select("a", "b")
    sizes = [nodes.select(F.col("fp").alias(end), F.col("size").alias("size_" + end)) for end in ("a", "b")]
    fit = across.unionByName(within).join(sizes[0], "a").join(sizes[1], "b").filter(_sizes_fit("size_a", "size_b"))
    return _verified(fit.select("a", "b"), printed, shelf)


def components(printed: DataFrame, shelf: Shelf, most: int = MOST) -> DataFrame:
    """fp, root of every node that is near another and not its component's root."""
    own = [F.first(PRINT + end).alias(name) for end, name in (("_size", "size"), ("_simhash", "print"), ("_buckets", "keys"))]
    nodes = shelf.put(printed.groupBy(F.col(PRINT).alias("fp")).agg(*own))
    links = by_simhash(nodes.select("fp", "size", "print"), printed, shelf)
    placed = nodes.join(connect(links, shelf).withColumnRenamed("node", "fp"), "fp", "left")
    filed = placed.select("fp", "size", F.coalesce("root", "fp").alias("root"), F.posexplode("keys").alias("band", "key"))
    rows = filed.select(F.xxhash64("band", "key").alias("g"), "fp", "size", "root", "band", F.expr("shiftleft(1L, band)").alias("used"))
    ready = []
    while True:
        kinds = shelf.put(_buckets_of(rows))
        ready.append(rows.join(kinds.filter(F.col("weight") <= most).select("g"), "g", "left_semi").select("g", "fp", "root"))
        hot = kinds.filter(F.col("weight") > most)
        if not hot.limit(1).collect():
            break
        hot = hot.join(nodes.select(F.col("fp").alias("least"), F.col("size").alias("least_size")), "least").select("g", "least", "least_size")
        members = shelf.put(rows.join(hot, "g"))
        stars = members.filter((F.col("fp") != F.col("least")) & _sizes_fit("size", "least_size")).select(F.col("least").alias("a"), F.col("fp").alias("b"))
        links = links.unionByName(_verified(stars, printed, shelf))
        roots = connect(links, shelf)
        placed = members.drop("root", "least", "least_size").join(roots, members["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
        apart = placed.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("g")
        onward = F.expr(f"slice(filter(transform(sequence(1, {BANDS - 1}), i -> (band + i) % {BANDS}), b -> shiftrightunsigned(used, b) % 2 = 0), 1, {DEALT})")
        dealt = placed.join(apart, "g", "left_semi").join(nodes.select("fp", "keys"), "fp").select("g", "fp", "size", "root", "used", "keys", F.explode(onward).alias("next"))
        rows = shelf.put(dealt.select(F.xxhash64("g", "next", F.col("keys")[F.col("next")]).alias("g"), "fp", "size", "root", F.col("next").alias("band"), F.expr("used | shiftleft(1L, next)").alias("used")))
    met = shelf.put(functools.reduce(DataFrame.unionByName, ready))
    sets = _sets_of(met.select("fp"), printed, shelf)
    ordered = met.join(sets, "fp").repartition("g").sortWithinPartitions("g", "root", "fp")
    found = shelf.put(ordered.mapInArrow(_forests, "a long, b long"))
    return connect(found.unionByName(links), shelf).withColumnRenamed("node", "fp")


def told_apart(printed: DataFrame, mark: str, shelf: Shelf) -> DataFrame:
    """``printed`` in which different sets have different names."""
    other = F.col(mark + "_other")
    shared = printed.groupBy(mark).agg(F.min(other).alias("low"), F.max(other).alias("high")).filter("low <> high")
    shared = shelf.put(shared.select(F.col(mark).alias("siftmill_name"), "low"))
    if shared.isEmpty():
        return printed
    low = mark + "_low"
    named = printed.join(shared.select(F.col("siftmill_name").alias(mark), F.col("low").alias(low)), mark, "left")
    return shelf.put(named.withColumn(mark, F.when(other != F.col(low), F.xxhash64(mark, other)).otherwise(F.col(mark))).select(*(quoted(c) for c in printed.columns)))


def keep_one(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` (all columns) without near copies: one row of each component stays, as ``simhash.one_of_each`` says."""
    shelf, mark = Shelf(docs.sparkSession, "nearcopies"), unused(docs.columns, PRINT)
    more = [*(T.StructField(mark + end, T.LongType()) for end in ENDS[:-1]), T.StructField(mark + ENDS[-1], T.ArrayType(T.LongType()))]
    printed = told_apart(shelf.put(docs.mapInArrow(_print(mark), T.StructType([*docs.schema.fields, *more]))), mark, shelf)
    own = printed.select("doc_id", "text", *(F.col(mark + end).alias(PRINT + end) for end in ENDS if end != "_other"))
    roots = components(own, shelf, most)
    rows = own.select("doc_id", F.col(PRINT).alias("fp")).join(roots, "fp", "left")
    groups = rows.select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))
    return one_of_each(printed.drop(*(mark + end for end in ENDS[1:])), groups, docs.columns, mark)
