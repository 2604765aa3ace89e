"""Benchmark decontamination by suffix arrays over shards of the training texts.

A task reads its documents as a stream and cuts it into shards of about ``SHARD`` words. Of a shard
the suffix array is made (by prefix doubling) over the words that the benchmark has too, and every
benchmark suffix that begins a window is binary-searched in it: the suffixes that start with the
window's words are one range of the array, and that range names every place where it stands. From
each such place the longest verbatim match is found by a binary search in the sorted suffixes of the
benchmark. A window is ``WINDOW`` consecutive words of an item, or all of an item that has fewer.

Words that no benchmark text has can be in no match, so a shard's text is cut at them, and stretches
shorter than the shortest window are left out. A text of any length is read in pieces which overlap
by the longest item, so a shard is bounded and no place is lost. Nothing is shuffled: the documents'
rows stay where they were read.

The benchmark goes to the tasks in parts of at most about ``PART`` bytes (its items in pieces of
``ITEM`` words that overlap by a window), whose number grows with it: each part is a pass over the
documents that carries what the passes before have found.

Defined cases: a null text has no words; an item without words has no window; a null item_id is the
empty name; rows with one item_id are one item; equal texts of several items are searched once and
name them all; repeated documents each keep their row; columns of any name are kept as they are; an
empty table or an empty benchmark leaves every document clean. The longest match of a document is
the first of those that are longest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.shared import Shelf, columns, quoted, small, unused, utf8_list
from siftmill.llm.terms import runs

WINDOW = 10
SHARD = 1 << 19
PART = 4 << 20
ITEM = 1 << 12
#: Words compared at a time, and searches made at a time.
STEP, AT_ONCE = 10, 1 << 15
FOUND = {"words": "long", "spans": "array<long>", "items": "array<string>", "longest": "long", "longest_at": "long"}
_TYPES = {"long": T.LongType(), "array<long>": T.ArrayType(T.LongType()), "array<string>": T.ArrayType(T.StringType())}
_ARROW = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


# --- suffix arrays


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of their suffixes; those that agree in ``depth`` words stay in text order. Words are >= 0, -1 ends a stretch."""
    _, rank = np.unique(text, return_inverse=True)
    known = 1
    while known < depth:
        after = np.zeros_like(rank)
        after[:-known] = rank[known:]
        after[text < 0] = 0  # what follows the end of a stretch does not count
        _, now = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
        known *= 2
        if now.max() == rank.max():  # no order is left to find
            break
        rank = now
    return starts[np.argsort(rank[starts], kind="stable")]


def agreement(text: np.ndarray, at: np.ndarray, query: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the ``length`` words from ``start`` of the query agree with those from ``at``, and whether the text's next word is less. Both end in -1."""
    agree, less, live = np.zeros(len(at), np.int64), np.zeros(len(at), bool), np.flatnonzero(length > 0)
    while len(live):
        k = agree[live, None] + np.arange(STEP)
        a = text[np.minimum(at[live, None] + k, len(text) - 1)]
        b = query[np.minimum(start[live, None] + k, len(query) - 1)]
        differ = ((a != b) | (b < 0)) & (k < length[live, None])  # the ends of two stretches are not alike
        some, first = differ.any(axis=1), differ.argmax(axis=1)
        agree[live] = np.minimum(agree[live] + np.where(some, first, STEP), length[live])
        less[live[some]] = a[some, first[some]] < b[some, first[some]]
        live = live[~some & (agree[live] < length[live])]
    return agree, less


def search(text: np.ndarray, order: np.ndarray, query: np.ndarray, start: np.ndarray, length: np.ndarray, upper: bool = False) -> np.ndarray:
    """For each query the number of suffixes of ``order`` that are less than its ``length`` words (``upper``: or begin with them)."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) // 2
        agree, less = agreement(text, order[mid], query, start[live], length[live])
        right = less | ((agree == length[live]) & upper)
        low[live[right]] = mid[right] + 1
        high[live[~right]] = mid[~right]
        live = live[low[live] < high[live]]
    return low


# --- the benchmark's side


@dataclass
class Tests:
    """A part of the benchmark: its words, its different windows with their items, its suffixes in order."""

    ids: dict[bytes, int]
    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    suffixes: np.ndarray
    names: list[str]
    #: The windows' items, as places in ``names``: those of window w from bounds[w] to bounds[w + 1].
    items: np.ndarray
    bounds: np.ndarray
    shortest: int
    longest: int


def tests_of(pieces: list[tuple[str, list[bytes]]]) -> Tests:
    """What tasks need of (item, words) pieces."""
    pieces = sorted(p for p in pieces if p[1])
    ids: dict[bytes, int] = {}
    text = np.array([n for _, own in pieces for n in (*(ids.setdefault(w, len(ids)) for w in own), -1)] or [-1], np.int32)
    names = sorted({item for item, _ in pieces})
    place = {name: k for k, name in enumerate(names)}
    sizes = np.array([len(own) for _, own in pieces], np.int64)
    counts = np.maximum(sizes - WINDOW, 0) + 1 if len(sizes) else sizes
    first = np.repeat(np.cumsum(sizes + 1) - sizes - 1, counts)
    start = first + np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.repeat(np.minimum(sizes, WINDOW), counts)
    owner = np.repeat(np.array([place[i] for i, _ in pieces], np.int64), counts)
    k = np.arange(WINDOW)
    words = np.where(k < length[:, None], text[np.minimum(start[:, None] + k, len(text) - 1)], -2)
    _, one, window = np.unique(words, axis=0, return_index=True, return_inverse=True)
    tied = np.unique(np.stack([window.ravel(), owner], axis=1), axis=0)
    return Tests(
        ids, text, start[one], length[one], suffix_array(text, start, int(sizes.max(initial=0)) + 1), names, tied[:, 1], np.searchsorted(tied[:, 0], np.arange(len(one) + 1)),
        int(length.min(initial=1 << 30)), int(sizes.max(initial=1)),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = []
        for item, text in zip(*map(utf8_list, columns(batch, "item", "text"))):
            held: list[bytes] = []
            for some in runs(text):
                held += some
                while len(held) > ITEM:
                    rows.append((item, b" ".join(held[:ITEM])))
                    held = held[ITEM - WINDOW + 1 :]
            rows.append((item, b" ".join(held)))
        item, text = zip(*rows) if rows else ((), ())
        yield pa.record_batch([pa.array(item, pa.binary()).cast(pa.string()), pa.array(text, pa.binary()).cast(pa.string())], names=["item", "words"])


def parts_of(benchmark: DataFrame, size: int = PART) -> Iterator[Tests]:
    """The benchmark in parts of about ``size`` bytes, one at least; only one of them is on the driver at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text"))
    pieces = Shelf(benchmark.sparkSession, "benchmark").put(rows.mapInArrow(_pieces, "item string, words string").filter("words <> ''").distinct())
    total = pieces.agg(F.coalesce(F.sum(F.length("words") + F.length("item")), F.lit(0))).first()[0]
    parts = max(1, -(-total // size))
    for k in range(parts):
        own = pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k).collect()
        if own or not k:
            yield tests_of([(r["item"], r["words"].encode().split()) for r in own])


# --- the documents' side


class Shard:
    """Stretches of documents that may hold matches, until they are searched together."""

    def __init__(self, tests: Tests):
        self.tests, self.size = tests, 0
        self.held: list[tuple[int, int, np.ndarray]] = []  # row, place of the first word, word numbers

    def add(self, row: int, text: bytes | None, flush: Callable[[], None]) -> int:
        """Adds a document's words and gives their number; ``flush`` searches what is held when it is much."""
        get, at, tail = self.tests.ids.get, 0, np.empty(0, np.int32)
        for some in runs(text):
            numbers = np.fromiter(map(get, some, repeat(-1)), np.int32, len(some))
            self._stretches(row, at - len(tail), np.concatenate([tail, numbers]) if len(tail) else numbers)
            at += len(numbers)
            tail = np.concatenate([tail, numbers])[-(self.tests.longest - 1) :] if self.tests.longest > 1 else tail
            self.size += len(some)
            if self.size >= SHARD:
                flush()
        return at

    def _stretches(self, row: int, at: int, numbers: np.ndarray) -> None:
        ends = np.flatnonzero(np.concatenate([[True], numbers < 0, [True]]))
        sizes = np.diff(ends) - 1
        for k in np.flatnonzero(sizes >= self.tests.shortest).tolist():
            start = int(ends[k])
            self.held.append((row, at + start, numbers[start : start + int(sizes[k])]))

    def matches(self) -> tuple[np.ndarray, ...]:
        """Arrays of the row, place, window and longest match from there of every place of every window; the shard is empty then."""
        tests, held = self.tests, self.held
        self.held, self.size = [], 0
        if not held:
            return (np.empty(0, np.int64),) * 4
        gap = np.array([-1], np.int32)
        text = np.concatenate([x for _, _, numbers in held for x in (numbers, gap)])
        sizes = np.array([len(numbers) for _, _, numbers in held])
        begins = np.cumsum(sizes + 1) - sizes - 1
        starts = np.concatenate([np.arange(b, b + s - tests.shortest + 1) for b, s in zip(begins.tolist(), sizes.tolist())])
        order = suffix_array(text, starts, WINDOW)
        low, high = (in_blocks(lambda s, n, u=upper: search(text, order, tests.text, s, n, u), tests.start, tests.length) for upper in (False, True))
        count = high - low
        window = np.repeat(np.arange(len(count)), count)
        places = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(window))]
        stretch = np.searchsorted(begins, places, "right") - 1
        rows, firsts = (np.array(x, np.int64)[stretch] for x in list(zip(*held))[:2])
        one, back = np.unique(places, return_inverse=True)
        longest = in_blocks(lambda p: self._longest(text, p), one)[back]
        longest = np.where(longest >= WINDOW, longest, tests.length[window])  # what is shorter than a window is a match if it is a whole item
        return rows, firsts + places - begins[stretch], window, longest

    def _longest(self, text: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The length of the longest match with any benchmark suffix from each place: with one of the two that it stands between."""
        tests = self.tests
        length = np.full(len(places), tests.longest, np.int64)
        at = search(tests.text, tests.suffixes, text, places, length)
        sides = [agreement(tests.text, tests.suffixes[np.clip(at + d, 0, len(tests.suffixes) - 1)], text, places, length)[0] for d in (-1, 0)]
        return np.maximum(*sides)


def in_blocks(of: Callable[..., np.ndarray], *arrays: np.ndarray) -> np.ndarray:
    """``of`` for AT_ONCE entries at a time."""
    parts = [of(*(a[at : at + AT_ONCE] for a in arrays)) for at in range(0, len(arrays[0]), AT_ONCE)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """The union of [start, end) spans, flat and in order."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _searched(sent: Broadcast, names: dict[str, str], keep: list[str], again: bool):
    """Adds what a part of the benchmark finds in each row; ``again``: to what parts before have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Tests = sent.value
        shard = Shard(tests)
        waiting: list[pa.RecordBatch] = []
        words: list[int] = []
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        most: dict[int, tuple[int, int]] = {}
        held = list(dict.fromkeys([*keep, *(names.values() if again else ())]))

        def flush() -> None:
            for row, place, window, longest in zip(*(x.tolist() for x in shard.matches())):
                spans.setdefault(row, []).append((place, place + int(tests.length[window])))
                items.setdefault(row, set()).add(window)
                most[row] = max(most.get(row, (0, 0)), (longest, -place))
            for row, own in spans.items():
                flat = merged(own)
                spans[row] = list(zip(flat[::2], flat[1::2]))

        def finished() -> Iterator[pa.RecordBatch]:
            flush()
            first = 0
            for batch in waiting:
                own = range(first, first + batch.num_rows)
                found = {
                    "words": words[own.start : own.stop],
                    "spans": [merged(spans.get(i, [])) for i in own],
                    "items": [sorted({tests.names[k] for w in items.get(i, ()) for k in tests.items[tests.bounds[w] : tests.bounds[w + 1]].tolist()}) for i in own],
                    "longest": [most.get(i, (0, 0))[0] for i in own],
                    "longest_at": [-most[i][1] if i in most else None for i in own],
                }
                if again:
                    before = {n: c.to_pylist() for n, c in zip(FOUND, columns(batch, *(names[n] for n in FOUND)))}
                    for i, (s, x, m, a) in enumerate(zip(*(before[n] for n in ("spans", "items", "longest", "longest_at")))):
                        found["spans"][i] = merged([*zip(s[::2], s[1::2]), *zip(found["spans"][i][::2], found["spans"][i][1::2])])
                        found["items"][i] = sorted({*x, *found["items"][i]})
                        if (m, -(a or 0)) > (found["longest"][i], -(found["longest_at"][i] or 0)):
                            found["longest"][i], found["longest_at"][i] = m, a
                made = [pa.array(found[n], _ARROW[t]) for n, t in FOUND.items()]
                yield pa.record_batch([*columns(batch, *keep), *made], names=[*keep, *(names[n] for n in FOUND)])
                first += batch.num_rows
            for kept in (waiting, words, spans, items, most):
                kept.clear()

        for batch in small(batches):
            for text in utf8_list(columns(batch, "text")[0]):
                words.append(shard.add(len(words), text, flush))
            waiting.append(batch.select(held))
            if shard.size >= SHARD // 2 or len(words) >= SHARD // 100:
                yield from finished()
        yield from finished()

    return run


def matched(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, part: int = PART) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` of every row (all of them if None), what was found (see FOUND), and the names of the columns that hold it.

    ``spans`` are the hit words as flat [start, end) pairs, ``items`` the ids of the benchmark items
    that occur, ``longest`` and ``longest_at`` the length and place of the longest verbatim match.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    names = {n: unused(docs.columns, f"siftmill_{n}") for n in FOUND}
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    shelf, rows, again = Shelf(spark, "decontaminate"), docs.select(*(quoted(c) for c in dict.fromkeys([*keep, "text"]))), False
    parts = parts_of(benchmark, part)
    now = next(parts)
    while now is not None:
        following = next(parts, None)
        own = keep if following is None else [c for c in rows.columns if c not in names.values()]
        schema = T.StructType([*(T.StructField(c, kinds[c]) for c in own), *(T.StructField(names[n], _TYPES[t]) for n, t in FOUND.items())])
        found = rows.mapInArrow(_searched(spark.sparkContext.broadcast(now), names, own, again), schema)
        if following is not None:
            found, before = shelf.put(found), rows if again else None
            if before is not None:
                shelf.drop(before)
        rows, again, now = found, True, following
    return rows, names


def report(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at of every row of ``docs``."""
    found, at = matched(docs.select("doc_id", "text"), benchmark, ["doc_id"], part)
    spans = F.col(at["spans"])
    hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(at["words"]).alias("n_words"), hit.alias("n_hit"), F.size(at["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(at["items"])).cast("binary"), 256).alias("items_sha256"), (F.size(at["items"]) > 0).alias("contaminated"),
        F.col(at["longest"]).alias("longest"), F.col(at["longest_at"]).alias("longest_at"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no window of the benchmark occurs."""
    found, at = matched(docs, benchmark, part=part)
    return found.filter(F.size(at["items"]) == 0).select(*(quoted(c) for c in docs.columns))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, k, array_to_string(w[p : p + k - 1], ' ') AS s
         FROM (SELECT item, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
places AS (SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, n - k + 2)) AS p FROM d, sizes WHERE n >= k)),
hits AS (SELECT DISTINCT r, p, k, item FROM places JOIN wins USING (k, s)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, d.n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
