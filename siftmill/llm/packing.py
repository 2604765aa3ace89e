"""Best-fit packing of token sequences by bin completion.

Documents longer than the capacity are cut from the end into full pieces, so that only a first piece
is shorter. Pieces have at most ``capacity`` different lengths, so the packing is planned on the
histogram of lengths: the driver holds that many counts, at any corpus size.

Bin completion: the longest piece left opens a sequence; the undominated fillings of the rest are
enumerated, fullest first and of equal ones those with longer pieces first; a filling is repeated
as often as the counts allow. Branch-and-bound revises the choices within the waste that an
improvement may have left, with a best-fit-decreasing solution and each better one found as the
incumbent, until ``least_sequences`` (a lower bound) is met or the search ends: ``NODES`` choices in
all, the first ``BRANCHES`` fillings of each, and the greatest repetition only. These limits can cost
optimality, never a piece; a plan above the bound is logged.

Pieces then get the slots of their length: pieces of a length are ranked by (bucket, doc_id, piece),
bucket sizes summed before, so a length that a third of all documents have is ranked in many tasks.

Defined cases: a null or empty text is the end id alone; the string of an added token is that token's
id, as the tokenizers library has it; a text of any length is encoded whole and cut; repeated rows are
packed each; rows that tie in id, piece and ids are interchangeable; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import json
import logging
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.bpe import Codec
from siftmill.llm.chunks import SPACE
from siftmill.llm.shared import Shelf, columns, small

LOG = logging.getLogger(__name__)
CAPACITY = 1024
END_ID = 2
NODES = 2_000
BRANCHES = 4
ROWS_PER_BUCKET = 2_000
MAX_BUCKETS = 4_096
#: White space of so many characters in a row is too long for the fast encoder's pattern matcher (its limit is about twice that).
LONG_RUN = 500_000
LONG_SPACE = re.compile(f"[{SPACE}]{{{LONG_RUN}}}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# --- the plan -------------------------------------------------------------------------

Plan = list[tuple[tuple[int, ...], int]]  # (lengths of a sequence, how many sequences)


def fillings(room: int, counts: dict[int, int], least: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` with at least ``least`` tokens, fullest first.

    A filling is dominated if a piece left over would fit in addition or in place of a shorter one
    of the filling; the fullest are not, and of equal ones the longer pieces come first.
    """
    sizes = sorted((s for s in counts if s <= room and counts[s] > 0), reverse=True)
    full = (1 << room + 1) - 1
    reach = [1]  # bit t: tokens t can be made of the sizes from a place on; built from the shortest up
    for s in reversed(sizes):
        bits, many, step = reach[-1], min(counts[s], room // s), 1
        while many > 0:
            take = min(step, many)
            bits |= bits << take * s & full
            many -= take
            step *= 2
        reach.append(bits)
    reach.reverse()

    def fill(whole: int) -> Iterator[tuple[int, ...]]:
        open_ = [(0, whole, ())]  # the last is continued first: no recursion, however many lengths
        while open_:
            i, total, taken = open_.pop()
            if not total:
                yield taken
                continue
            while i < len(sizes) and not reach[i + 1] >> total & 1 and sizes[i] > total:
                i += 1
            if i == len(sizes):
                continue
            s = sizes[i]
            for k in range(min(counts[s], total // s) + 1):
                if reach[i + 1] >> total - k * s & 1:
                    open_.append((i + 1, total - k * s, taken + (s,) * k))

    for total in range(room, max(least, 0) - 1, -1):
        if reach[0] >> total & 1:
            for filling in fill(total):
                left = dict(counts)
                for s in filling:
                    left[s] -= 1
                slack, spare = room - total, [s for s in left if left[s] > 0]
                if not any(s <= slack or any(f < s <= f + slack for f in set(filling)) for s in spare):
                    yield filling


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts: each sequence takes the longest piece that fits, again and again."""
    left, plan = {s: n for s, n in counts.items() if n}, []
    while left:
        sizes = sorted(left, reverse=True)
        room, used = capacity, []
        for s in sizes:
            take = min(room // s, left[s])
            used += [s] * take
            room -= take * s
        many = min(left[s] // used.count(s) for s in set(used))
        plan.append((tuple(used), many))
        for s in set(used):
            left[s] -= many * used.count(s)
            if not left[s]:
                del left[s]
    return plan


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: for each k, what is longer than capacity - k stands without any piece of k or more; the rest of them is filled up."""
    sizes = [(s, n) for s, n in counts.items() if n]
    best = 0
    for k in {1, *(s for s, _ in sizes if 2 * s <= capacity)}:
        alone = sum(n for s, n in sizes if s > capacity - k)
        halves = [(s, n) for s, n in sizes if capacity - k >= s > capacity / 2]
        pairs = sum(n for _, n in halves)
        room = pairs * capacity - sum(s * n for s, n in halves)
        rest = sum(s * n for s, n in sizes if k <= s <= capacity / 2)
        best = max(best, alone + pairs + max(0, -(-(rest - room) // capacity)))
    return best


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Sequences for a histogram of lengths, by bin completion with branch-and-bound."""
    tokens = sum(s * n for s, n in counts.items())
    bound = max(-(-tokens // capacity), least_sequences(counts, capacity))
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    if best_n == bound or not tokens:
        return best
    tried = 0

    def choices(left: dict[int, int], waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings around the longest piece left, that waste no more than may be wasted, with how often they can be repeated."""
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        for i, filling in enumerate(fillings(capacity - longest, rest, capacity - longest - waste)):
            if i == BRANCHES:
                return
            used = (longest, *filling)
            many = min(left[s] // used.count(s) for s in set(used))
            lost = capacity - sum(used)
            yield used, min(many, waste // lost) if lost and waste < many * lost else many

    # depth-first with the open choices on a list: no recursion, however many sequences
    start = {s: n for s, n in counts.items() if n}
    spare = (best_n - 1) * capacity - tokens
    trail: list[tuple[Iterator, dict[int, int], int, Plan]] = [(choices(start, spare), start, spare, [])]
    while trail and tried < nodes and best_n > bound:
        options, left, waste, plan = trail[-1]
        step = next(options, None)
        if step is None:
            trail.pop()
            continue
        used, many = step
        if many < 1:
            continue
        tried += 1
        after = dict(left)
        for s in set(used):
            after[s] -= many * used.count(s)
            if not after[s]:
                del after[s]
        waste -= many * (capacity - sum(used))
        if after:
            trail.append((choices(after, waste), after, waste, [*plan, (used, many)]))
        else:
            found = [*plan, (used, many)]
            n = sum(m for _, m in found)
            if n < best_n:
                best, best_n = found, n
                spare = (best_n - 1) * capacity - tokens
                trail = [(choices(start, spare), start, spare, [])] if best_n > bound else []
    if best_n > bound:
        LOG.info("packing: %d sequences, lower bound %d, %d choices tried: fewer may be possible", best_n, bound, tried)
    return best


def slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of a run of ranks (ascending), the sequence of that rank, the place in it.

    Within a run, one rank more is one sequence more. As many runs as the plan has pieces in its
    different sequences.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for used, many in plan:
        offset = 0
        for s in used:
            runs.setdefault(s, []).append((given.get(s, 0), sequence, offset))
            given[s] = given.get(s, 0) + many
            offset += s
        sequence += many
    return {s: tuple(np.array(x, np.int64) for x in zip(*r)) for s, r in runs.items()}


# --- tokens, ranks, places --------------------------------------------------------------


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it can be printed, else the next free letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def vocabulary(path: str) -> dict[bytes, int]:
    """The tokens of a tokenizers file of byte-level BPE, as bytes with their ids. Merges must come in the order of ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = byte_of_letter()
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"{path}: a merge does not come in the order of ids")
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}


def added_tokens(path: str) -> dict[str, int]:
    """The strings that a tokenizers file takes as one token before anything else, with their ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError(f"{path}: an added token that takes more than its own string")
    return {t["content"]: t["id"] for t in tokens if t["content"]}


class Ids:
    """The ids that the tokenizers library gives a text, by the same vocabulary, pattern and added tokens.

    The merging is tiktoken's: ids are the same where merges come in the order of ids, and it takes
    about half the time that remembering the ids of chunks took, without the memory. White-space
    runs too long for its pattern matcher are encoded by the rank queue of ``bpe``.
    """

    def __init__(self, path: str):
        self.ranks = vocabulary(path)
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.slow: Codec | None = None
        self.added = added_tokens(path)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def of(self, text: str) -> bytes:
        """Four bytes, little-endian, for each id."""
        if self.split is None or not any(t in text for t in self.added):
            return self.ordinary(text)
        parts = self.split.split(text)  # every second one is an added token
        return b"".join(np.array([self.added[x]], "<u4").tobytes() if i % 2 else self.ordinary(x) for i, x in enumerate(parts))

    def ordinary(self, text: str) -> bytes:
        """The same for a text in which added tokens' strings have no meaning."""
        if len(text) >= LONG_RUN and LONG_SPACE.search(text):
            self.slow = self.slow or Codec(self.ranks)
            return self.slow.encode(text).tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


@lru_cache(2)
def ids_by(path: str) -> Ids:
    """One encoder for each Python worker and file."""
    return Ids(path)


def cut(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, four bytes each."""
    n = len(ids) // 4
    start, piece = 0, 0
    to = n % capacity or capacity
    while start < n:
        yield piece, start, to - start, zlib.crc32(ids[4 * start : 4 * to])
        start, piece, to = to, piece + 1, to + capacity


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: the columns of PIECES."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids_by(path)
        for batch in small(batches):
            ids, texts = columns(batch, "doc_id", "text")
            rows = [(i, *p) for i, t in zip(ids.to_pylist(), texts) for p in cut(encoder.of(t.as_py() or "") + end, capacity)]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def _place(table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (c.to_numpy(zero_copy_only=False) for c in columns(batch, "length", "rank"))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for s in np.unique(lengths).tolist():
                here = lengths == s
                first, base, at = table[s]
                k = np.searchsorted(first, ranks[here], "right") - 1
                sequence[here] = base[k] + ranks[here] - first[k]
                offset[here] = at[k]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.record_batch([*columns(batch, *kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The columns of PIECES with sequence_id and offset, for every piece of every row of ``docs``."""
    shelf = Shelf(docs.sparkSession, "packing")
    cut_up = pieces(docs, path, capacity, end_id)
    made = shelf.put(cut_up)
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = slots(complete(counts, capacity))
    buckets = max(1, min(MAX_BUCKETS, sum(counts.values()) // ROWS_PER_BUCKET))
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lower"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("k", F.row_number().over(within)).join(sizes, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("lower") + F.col("k") - 1).alias("rank"))
    return ranked.mapInArrow(_place(table), PIECES + ", sequence_id long, offset long")
