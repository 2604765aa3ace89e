"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit SimHashes of 3-word shingles. Two link when at most ``tau`` bits differ.

Search: the 64 bits are grouped so that correlated bits stand together, the groups get unequal
thresholds t_i with sum(t_i) = tau - m + 1 (t_i = -1 leaves a group out), chosen by dynamic
programming on estimated candidate counts, and every distinct fingerprint is filed once exactly and
once for each flip of up to t_i bits of group i. If two fingerprints differ in at most tau bits,
then in some group i they differ in at most t_i, so they meet in a bucket. Each bucket is verified.

Skew: exact copies are one fingerprint before the search. A bucket reports a spanning forest of its
verified links, not its pairs, so a dense group of n near copies yields n - 1 rows. The forest is
found by breadth-first search that compares a member only with members not yet reached. Buckets of
over ``HOT_BUCKET`` members are first dealt out by the same principle over the bits that their members
need not share, again and again until none is above it.

Defined cases: null and word-less texts have fingerprint 0 and link like any other; texts of one or
two words are one shingle; the shingles of a text of any length all count; repeated rows and repeated
ids each keep their row; a null doc_id is never a component id unless its whole component has none; an
empty table gives an empty result; further columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.components import connect
from siftmill.llm.shared import Shelf, columns, quoted, small, unused, utf8_list

PRINT = "siftmill_print"
SEED = 42
WORDS = 3
TAU = 3
HOT_BUCKET = 200_000
PART_COUNTS = (2, 3, 4)
#: Bits are counted for so many shingles at a time.
COUNT_BLOCK = 1 << 16


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a UTF-8 text's word shingles, in order and with repeats; a text of fewer words is one shingle."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    return fingerprint_of(shingles(text, words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of shingles."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_BLOCK):
        block = hashes[at : at + COUNT_BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        ids, texts = columns(batch, "doc_id", "text")
        prints = np.array([fingerprint(t) for t in utf8_list(texts)], np.uint64).view(np.int64)
        yield pa.record_batch([ids.cast(pa.int64()), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


# --- plan: bit groups and thresholds -------------------------------------------------


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per cell of this task's 64 x 64 table of bits that are set together."""
    together = np.zeros((64, 64), np.float64)
    for batch in batches:
        prints = columns(batch, "fp")[0].to_numpy(zero_copy_only=False).astype("<i8")
        for at in range(0, len(prints), COUNT_BLOCK):
            bits = np.unpackbits(prints[at : at + COUNT_BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            together += bits.T @ bits
    yield pa.record_batch([pa.array(np.arange(4096), pa.int32()), pa.array(together.ravel().astype(np.int64))], names=["cell", "n"])


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of distinct fingerprints and how often each two bits are set together, over all of them."""
    cells = distinct.select("fp").mapInArrow(_bit_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    together = np.zeros(4096, np.int64)
    for row in cells.collect():  # 4096 rows at any size
        together[row["cell"]] = row["n"]
    return distinct.count(), together.reshape(64, 64)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal width, each grown from a seed bit by correlation."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tied = np.abs((together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    free, groups = set(range(64)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        seed = max(free, key=lambda b: (tied[b, list(free)].sum(), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < width:
            best = max(free, key=lambda b: (tied[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(n: int, together: np.ndarray, groups: list[list[int]], tau: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost (rows filed plus pairs to verify), by dynamic programming."""
    share = np.diag(together) / max(n, 1)
    differ = 2 * share * (1 - share)
    costs = []
    for group in groups:
        within = np.zeros(tau + 1)
        within[0] = 1
        for b in group:  # the chance that two unrelated fingerprints differ in k bits of the group
            within[1:] = within[1:] * (1 - differ[b]) + within[:-1] * differ[b]
            within[0] *= 1 - differ[b]
        near, cost, filed = np.cumsum(within), {-1: 0.0}, 0
        for t in range(tau + 1):
            filed += len(list(combinations(group, t))) if t < 3 else len(group) ** 3 / 6
            cost[t] = n * filed + n * n / 2 * near[t] / 8  # a comparison in numpy costs about an eighth of a filed row
        costs.append(cost)
    total = tau - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (sofar, picks) in best.items():
            for t, c in cost.items():
                if (k := spent + t) not in step or sofar + c < step[k][0]:
                    step[k] = (sofar + c, [*picks, t])
        best = step
    return best[total]


def plan(n: int, together: np.ndarray, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group in use, for the number of groups that costs least."""
    options = []
    for parts in PART_COUNTS:
        groups = group_bits(n, together, parts)
        cost, thresholds = allocate(n, together, groups, tau)
        options.append((cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


# --- probe and verify -----------------------------------------------------------------


def _mask(bits: list[int] | tuple[int, ...]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _file(parts: list[tuple[list[int], int]]):
    """Files each fingerprint in its buckets: key parts (part, value), the fingerprint, and whether it stands there exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = columns(batch, "fp")[0].to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (bits, t) in enumerate(parts):
                values = prints & _mask(bits)
                for size in range(t + 1):
                    for flips in combinations(bits, size):
                        rows = (np.full(len(prints), k, np.int32), (values ^ _mask(flips)).view(np.int64), prints.view(np.int64), np.full(len(prints), size == 0))
                        yield pa.record_batch([pa.array(x) for x in rows], names=["part", "value", "fp", "exact"])

    return run


def _forest(exact: np.ndarray, probes: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one bucket: members that stand there exactly, and probes against them.

    Probes are compared with exact members only; two probes that are near meet elsewhere.
    """
    left, right = [], []
    free_e, free_p = exact.copy(), probes.copy()
    while len(free_e):
        queue, free_e = [(free_e[0], True)], free_e[1:]
        while queue and (len(free_e) or len(free_p)):
            node, is_exact = queue.pop()
            near = np.bitwise_count(free_e ^ node) <= tau
            found = [(free_e[near], True)]
            free_e = free_e[~near]
            if is_exact and len(free_p):
                near = np.bitwise_count(free_p ^ node) <= tau
                found.append((free_p[near], False))
                free_p = free_p[~near]
            for members, kind in found:
                if len(members):
                    left.append(np.full(len(members), node))
                    right.append(members)
                    queue.extend((m, kind) for m in members)
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _verify(tau: int):
    """Links of the buckets of a task's rows, which come sorted by bucket."""

    def links(keys: np.ndarray, prints: np.ndarray, exact: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(prints)]
        sizes = ends - starts
        left, right = [], []
        pair = starts[sizes == 2]  # most buckets that have company
        if len(pair):
            ok = (np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= tau) & (exact[pair] | exact[pair + 1])
            left.append(prints[pair[ok]])
            right.append(prints[pair[ok] + 1])
        for a, b in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            p, e = prints[a:b], exact[a:b]
            x, y = _forest(np.unique(p[e]), np.unique(p[~e]), tau)
            left.append(x)
            right.append(y)
        x, y = (np.concatenate(s) if s else np.empty(0, np.uint64) for s in (left, right))
        keep = x != y
        return pa.record_batch([pa.array(x[keep].view(np.int64)), pa.array(y[keep].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part, value, sub, fp, exact = (c.to_numpy(zero_copy_only=False) for c in columns(batch, "part", "value", "sub", "fp", "exact"))
            keys = np.column_stack([part.astype(np.int64), value, sub])
            last = int(np.flatnonzero(np.any(keys != keys[-1], axis=1))[-1]) + 1 if np.any(keys != keys[-1]) else 0
            rows = (keys, fp.view(np.uint64), exact)
            if held and (last or np.any(held[-1][0][-1] != keys[0])):
                held.append(tuple(x[:last] for x in rows))
                yield links(*(np.concatenate(x) for x in zip(*held)))
                held = [tuple(x[last:] for x in rows)]
            elif last:
                yield links(*(x[:last] for x in rows))
                held = [tuple(x[last:] for x in rows)]
            else:
                held.append(rows)
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


BUCKET = ("part", "value", "sub")


def _deal_again(tau: int):
    """Deals the members of hot buckets out by tau + 1 groups of the bits not yet ``used``: two that are near are equal in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, value, sub, used, fp, exact = (c.to_numpy(zero_copy_only=False) for c in columns(batch, *BUCKET, "used", "fp", "exact"))
            prints, spent = fp.view(np.uint64), used.view(np.uint64)
            for seen in np.unique(spent):  # as many as there are groups of groups
                here = spent == seen
                free = [b for b in range(64) if not int(seen) >> b & 1]
                for j in range(tau + 1):
                    mask = _mask(free[j :: tau + 1])
                    keys = zip(sub[here].tolist(), (prints[here] & mask).tolist())
                    deeper = np.array([xxhash.xxh3_64_intdigest(b"%d %d %d" % (j, a, b)) for a, b in keys], np.uint64).view(np.int64)
                    now = np.full(len(deeper), seen | mask, np.uint64).view(np.int64)
                    yield pa.record_batch([pa.array(x) for x in (part[here], value[here], deeper, now, fp[here], exact[here])], names=[*BUCKET, "used", "fp", "exact"])

    return run


def links(distinct: DataFrame, tau: int = TAU, hot_bucket: int = HOT_BUCKET, shelf: Shelf | None = None) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``tau`` bits whose transitive closure is that of all such pairs."""
    shelf = shelf or Shelf(distinct.sparkSession, "links")
    n, together = bit_statistics(distinct)
    parts = plan(n, together, tau)
    filed = distinct.select("fp").mapInArrow(_file(parts), "part int, value long, fp long, exact boolean")
    own = F.element_at(F.array(*(F.lit(int(_mask(bits).view(np.int64))) for bits, _ in parts)), F.col("part") + 1)
    rows = filed.select("part", "value", F.lit(0).cast("long").alias("sub"), own.alias("used"), "fp", "exact")
    while True:
        open_ = rows.filter(F.bit_count("used") < 64 - tau)  # tau free bits tell 2 ** tau fingerprints apart: such a bucket is never hot
        hot = open_.groupBy(*BUCKET).agg(F.count("*").alias("size")).filter(F.col("size") > hot_bucket).select(*BUCKET)
        if not hot.limit(1).collect():
            break
        hot = shelf.put(hot)
        again = rows.join(hot, list(BUCKET), "left_semi").select(*BUCKET, "used", "fp", "exact").mapInArrow(_deal_again(tau), "part int, value long, sub long, used long, fp long, exact boolean")
        rows = shelf.put(rows.join(hot, list(BUCKET), "left_anti").select(*BUCKET, "used", "fp", "exact").unionByName(again))
    rows = rows.select(*BUCKET, "fp", "exact").repartition(*BUCKET).sortWithinPartitions(*BUCKET)
    return rows.mapInArrow(_verify(tau), "a long, b long")


def _placed(docs: DataFrame, tau: int, hot_bucket: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of every row (doc_id, fp), and of each fingerprint its least doc_id and its component (fp, first, root)."""
    shelf = Shelf(docs.sparkSession, "simhash")
    prints = shelf.put(fingerprints(docs))
    distinct = shelf.put(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connect(links(distinct, tau, hot_bucket, shelf), shelf)
    return prints, distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, tau: int = TAU, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links) of every row."""
    prints, placed = _placed(docs, tau, hot_bucket)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of = placed.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _append(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            prints = np.array([fingerprint(t) for t in utf8_list(columns(batch, "text")[0])], np.uint64).view(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(prints, pa.int64())], names=[*batch.schema.names, name])

    return run


def one_of_each(printed: DataFrame, groups: DataFrame, names: list[str], mark: str) -> DataFrame:
    """The columns ``names`` of one row of ``printed`` (which has ``mark`` beside them) for each root of ``groups`` (doc_id, fp, root).

    It is a row of the least doc_id (null comes last); of several rows with that id, one of the least
    fingerprint, of those the one with the least text, and of those the one whose other columns have
    the least JSON. Rows that share id and fingerprint are collapsed before the shuffle. A fingerprint
    has one root, so no two roots ask for the same id and fingerprint. No column may begin with ``mark``.
    """
    key = F.coalesce("doc_id", F.lit(-(2**63)))  # with the flag, one key for each id and for null: what is joined by it need not be dealt again
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("fp").bitwiseXOR(F.lit(-(2**63))).alias("unsigned"), "fp")
    least = groups.groupBy("root").agg(F.min(order).alias("least")).select("least.*")
    wanted = least.select(key.alias(mark + "_id"), F.col("none").alias(mark + "_null"), F.col("fp").alias(mark))
    keyed = printed.withColumn(mark + "_id", key).withColumn(mark + "_null", F.col("doc_id").isNull())
    kept = keyed.join(wanted, [mark + "_id", mark + "_null", mark], "left_semi")
    row = F.struct(*(F.col(quoted(c)) for c in names))
    others = [F.col(quoted(c)) for c in names if c.lower() not in ("doc_id", "text")]
    tie = F.struct(F.coalesce("text", F.lit("")), F.to_json(F.struct(*others)) if others else F.lit(""), F.col("text").isNull())
    one = kept.groupBy(mark + "_id", mark + "_null", mark).agg(F.min_by(row, tie).alias(mark + "_row"))
    return one.select(mark + "_row.*")


def keep_one(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """The rows of ``docs`` (all columns) without near-duplicates: one row of each component stays, as ``one_of_each`` says."""
    prints, placed = _placed(docs, tau, HOT_BUCKET)
    groups = prints.join(placed.select("fp", "root"), "fp")
    mark = unused(docs.columns, PRINT)
    printed = docs.mapInArrow(_append(mark), T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())]))
    return one_of_each(printed, groups, docs.columns, mark)
