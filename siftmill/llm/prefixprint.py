"""Document fingerprints from prefix polynomial hashes.

For code points c_0 .. c_(n-1) the prefix array of a modulus p is P[k] = sum over j < k of
(c_j + 1) * B^j mod p. Any two spans are equal, but for a chance of about 2^-62, when
(P[j] - P[i]) * B^-i matches (P'[j'] - P'[i']) * B^-i' for both moduli; longest common extensions
from either end are found by binary search. The printed fingerprint is the end of both arrays with
the length.

Likeness: in either text, code points are common that lie in the longest common extension from the
front, in that from the back (without overlap), or in a span of ``SPAN`` code points that the other
text has anywhere, looked up by its hash. The lesser number of common code points over the length of
the longer text is the likeness: scattered edits cost little more than themselves.

Every document meets its successor. Rows are ordered by doc_id, then the first ``HEAD`` code points of
the text, its hash and the row's place in the input, dealt by Spark to ranges of that order, and a
range is read as a stream. The last row of a range meets the first of the next in a join of these
rows alone. So the texts are shuffled once, ranges grow in number with the corpus, no task holds more
than two texts with their arrays, and rows of one id (or of none) are split like others.

Defined cases: a null text is empty; a null doc_id comes before all others; rows with equal ids are
in the order above; a single row is its own successor; two empty texts have likeness 1; texts of any
length are hashed whole; repeated rows each keep their row; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.shared import Shelf, columns, small

MODULI = (2147483647, 2147483629)  # primes below 2^31
BASES = (911382323, 972663749)
SPAN = 32
HEAD = 32
BYTES_PER_RANGE = 1 << 30
BLOCK = 1 << 20
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGES = SCHEMA + ", range long, is_first boolean, text string"

_powers = [np.ones(1, np.uint64) for _ in MODULI]
_inverses = [np.ones(1, np.uint64) for _ in MODULI]


def _grown(tables: list[np.ndarray], base: int, which: int, upto: int) -> np.ndarray:
    """base^0 .. base^upto of a modulus; the table doubles when it is too short."""
    p = np.uint64(MODULI[which])
    while len(tables[which]) <= upto:
        have = tables[which]
        step = np.uint64(pow(base, len(have), MODULI[which]))
        tables[which] = np.concatenate([have, have * step % p])
    return tables[which]


def powers(which: int, upto: int) -> np.ndarray:
    return _grown(_powers, BASES[which], which, upto)


def inverses(which: int, upto: int) -> np.ndarray:
    return _grown(_inverses, pow(BASES[which], -1, MODULI[which]), which, upto)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, points: np.ndarray, shared: "Prefixes | None" = None, keep: int = 0):
        """``shared`` and ``keep``: the first ``keep`` points are those of another text, whose arrays serve for them."""
        self.n, self.shared, self.keep = len(points), shared, keep
        self.arrays = []
        for which, p in enumerate(MODULI):
            out = np.empty(self.n + 1, np.uint32)
            out[: keep + 1] = shared.arrays[which][: keep + 1] if shared is not None else 0
            pw = powers(which, self.n)
            for at in range(keep, self.n, BLOCK):
                to = min(self.n, at + BLOCK)
                terms = (points[at:to].astype(np.uint64) + np.uint64(1)) * pw[at:to] % np.uint64(p)
                out[at + 1 : to + 1] = (np.cumsum(terms) + np.uint64(out[at])) % np.uint64(p)
            self.arrays.append(out)

    def __str__(self) -> str:
        return "".join(f"{int(a[-1]):08x}" for a in self.arrays) + f"-{self.n:x}"

    def span(self, which: int, i: int, j: int) -> int:
        """The hash of points i to j - 1, times B^i."""
        return (int(self.arrays[which][j]) - int(self.arrays[which][i])) % MODULI[which]

    def same(self, i: int, other: "Prefixes", k: int, length: int) -> bool:
        """Whether ``length`` points from i here equal those from k there."""
        return all(
            self.span(w, i, i + length) * int(powers(w, k)[k]) % p == other.span(w, k, k + length) * int(powers(w, i)[i]) % p
            for w, p in enumerate(MODULI)
        )

    def common_front(self, other: "Prefixes") -> int:
        low, high = 0, min(self.n, other.n)
        a, b = self.arrays, other.arrays
        while low < high:
            mid = (low + high + 1) // 2
            if a[0][mid] == b[0][mid] and a[1][mid] == b[1][mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def common_back(self, other: "Prefixes", most: int) -> int:
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(self.n - mid, other, other.n - mid, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def _hashes(self, which: int, starts: np.ndarray) -> np.ndarray:
        """The hashes of the spans of SPAN points at some starts by one modulus; equal spans have equal ones wherever they stand."""
        a, p = self.arrays[which], MODULI[which]
        between = a[starts + SPAN].astype(np.int64) - a[starts]
        between += (between >> 63) & p
        return (between.astype(np.uint64) * inverses(which, self.n)[starts] % np.uint64(p)).astype(np.uint32)

    @cached_property
    def spans(self) -> np.ndarray:
        """The hashes of all spans by the first modulus, by their start."""
        count = max(0, self.n - SPAN + 1)
        known = min(count, max(0, self.keep - SPAN + 1)) if self.shared is not None else 0
        out = np.empty(count, np.uint32)
        if known:
            out[:known] = self.shared.spans[:known]
        for at in range(known, count, BLOCK):
            to = min(count, at + BLOCK)
            out[at:to] = self._hashes(0, np.arange(at, to))
        return out

    def _like(self, low: int, high: int, wanted: np.ndarray) -> np.ndarray:
        """The starts from low to high of spans that may be wanted: all that are, and few others."""
        bits = max(12, min(26, (16 * len(wanted)).bit_length()))
        table, mask = np.zeros(1 << bits, bool), np.uint32((1 << bits) - 1)
        table[wanted & mask] = True
        return np.flatnonzero(table[self.spans[low:high] & mask]) + low

    def _keys(self, starts: np.ndarray) -> np.ndarray:
        return self.spans[starts].astype(np.uint64) << np.uint64(31) | self._hashes(1, starts)

    def common(self, other: "Prefixes", front: int, back: int) -> int:
        """How many points are in the extensions from both ends or in a span that the other text has."""
        low, high = max(0, front - SPAN + 1), min(self.n - back, len(self.spans))  # starts of spans that reach between the ends
        if high <= low or not len(other.spans):
            return front + back
        found = self._like(low, high, other.spans)
        if len(found):
            theirs = other._like(0, len(other.spans), self.spans[found])
            found = found[np.isin(self._keys(found), other._keys(theirs))]
        if not len(found):
            return front + back
        marks = np.zeros(self.n + 1, np.int32)
        marks[found] += 1
        marks[found + SPAN] -= 1
        covered = np.cumsum(marks[:-1]) > 0
        return front + back + int(np.count_nonzero(covered[front : self.n - back]))

    def likeness(self, other: "Prefixes") -> float:
        longer = max(self.n, other.n)
        if not longer:
            return 1.0
        front = self.common_front(other)
        back = self.common_back(other, min(self.n, other.n) - front)
        if front + back == min(self.n, other.n):
            return (front + back) / longer
        return min(self.common(other, front, back), other.common(self, front, back)) / longer


def _row(doc_id: int | None, text: str, own: Prefixes, after: str, following: Prefixes) -> tuple:
    cut = own.n // 4
    edited = text[: own.n - cut] + after[:cut]
    changed = Prefixes(codes(edited), own, own.n - cut)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, own.n, digest, str(own), str(changed), own.likeness(changed), own.likeness(following)


NAMES = [c.split()[0] for c in EDGES.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in EDGES.split(", ")]
WIDTH = len(SCHEMA.split(", "))


def _block(rows: list[tuple], width: int) -> pa.RecordBatch:
    cells = zip(*rows) if rows else [[]] * width
    return pa.record_batch([pa.array(x, t) for x, t in zip(cells, TYPES)], names=NAMES[:width])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document but the range's last, whose text is given out like that of the first."""
    here, empty = TaskContext.get().partitionId(), (None,) * (WIDTH - 1)
    held: tuple | None = None
    for batch in small(batches):
        out: list[tuple] = []
        for doc_id, text in zip(*(c.to_pylist() for c in columns(batch, "doc_id", "text"))):
            own = Prefixes(codes(text))
            out.append((*_row(*held, text, own), None, None, None) if held else (doc_id, *empty, here, True, text))
            held = (doc_id, text, own)
        yield _block(out, len(NAMES))
    if held:
        yield _block([(held[0], *empty, here, False, held[1])], len(NAMES))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = zip(*(c.to_pylist() for c in columns(batch, "doc_id", "text", "after")))
        yield _block([_row(i, text, Prefixes(codes(text)), after, Prefixes(codes(after))) for i, text, after in rows], WIDTH)


def fingerprints(docs: DataFrame, bytes_per_range: int = BYTES_PER_RANGE) -> DataFrame:
    """The columns of SCHEMA for every row of ``docs``."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "prefixprint")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // bytes_per_range)
    order = {"k": F.coalesce("doc_id", F.lit(-(2**63))), "head": F.substring("text", 1, HEAD), "h": F.xxhash64("text"), "place": F.monotonically_increasing_id()}
    dealt = rows.withColumns(order).repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = shelf.put(dealt.mapInArrow(_pairs, EDGES))
    edges = made.filter(F.col("range").isNotNull()).select("doc_id", "range", "is_first", "text")
    lasts, firsts = edges.filter(~F.col("is_first")).drop("is_first"), edges.filter("is_first").select(F.col("range").alias("follows"), F.col("text").alias("after"))
    all_ranges = Window.orderBy("range")  # a number for each range is all that comes together
    following = lasts.select("range").withColumn("follows", F.coalesce(F.lead("range").over(all_ranges), F.first("range").over(all_ranges)))
    across = lasts.join(following, "range").join(firsts, "follows").select("doc_id", "text", "after").mapInArrow(_across, SCHEMA)
    return made.filter(F.col("range").isNull()).select(*NAMES[:WIDTH]).unionByName(across)
