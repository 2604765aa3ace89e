"""Byte-level BPE by a hierarchical-bitmap rank queue, and decoding.

A pre-token's bytes form a linked list. Each adjacent pair that has a rank puts the position of its
left end into the bucket of that rank; a bitmap over the ranks, with a bitmap over its words above it,
tells the least rank in use by two find-first-set steps. Positions of a bucket leave
it leftmost first (a heap). A merge changes the ranks of the pairs beside it; entries that no longer
hold are skipped when they come up. The work is n log n in the bytes of a pre-token, however long.

Text is cut by the vocabulary's pattern; equal chunks of text are encoded once (see ``chunks``).

Defined cases: a null text is empty and has no ids; special tokens' strings are ordinary text; texts and
pre-tokens of any length are encoded whole; of pairs of one rank the leftmost is merged first;
repeated rows each keep their row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siftmill.llm.chunks import Memo
from siftmill.llm.shared import columns, small

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White_Space by name: the same class in every regular-expression library.
PATTERN = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+")
#: Ranks to a word of the lower bitmap; one word of the upper bitmap tells which of those are not empty.
WORD_BITS = 8
WORD = 1 << WORD_BITS
BIT = [1 << i for i in range(WORD)]


class Codec:
    """Encoder and decoder by ranks: a token's bytes and its rank, which is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.words = [0] * (len(self.bytes_of) // WORD + 1)  # the lower bitmap: empty between two pre-tokens
        self.split = regex.compile(PATTERN).findall
        self.memo = Memo(self.encode_chunks)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n, rank_of = len(piece), ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # starts of the neighbours; after[i] is also i's end
        current = [-1] * n  # rank of the pair that starts here; -1: none, or i is no start any more
        words, upper = self.words, 0
        buckets: dict[int, int | list[int]] = {}  # positions of a rank: one, or a heap
        fresh = [(i, piece[i : i + 2]) for i in range(n - 1)]  # pairs to be filed
        while True:
            for i, pair in fresh:
                r = current[i] = rank_of(pair, -1)
                if r < 0:
                    continue
                held = buckets.get(r)
                if held is None:
                    buckets[r] = i
                    w = r >> WORD_BITS
                    if not words[w]:
                        upper |= 1 << w
                    words[w] |= BIT[r & WORD - 1]
                elif isinstance(held, int):
                    buckets[r] = [held, i] if held < i else [i, held]
                else:
                    heappush(held, i)
            i = -1
            while upper:  # the next entry that still holds
                w = (upper & -upper).bit_length() - 1
                word = words[w]
                r = w << WORD_BITS | (word & -word).bit_length() - 1
                held = buckets[r]
                if isinstance(held, int):
                    i, held = held, None
                else:
                    i = heappop(held)
                if not held:
                    del buckets[r]
                    words[w] = word = word & word - 1
                    if not word:
                        upper &= upper - 1
                if current[i] == r:
                    break
                i = -1
            if i < 0:
                break
            j = after[i]
            end = after[i] = after[j]
            current[i] = current[j] = -1
            h = before[i]
            fresh = [(h, piece[h:end])] if h >= 0 else []
            if end < n:
                before[end] = i
                fresh.append((i, piece[i : after[end]]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def encode_chunks(self, chunks: list[str]) -> Iterator[bytes]:
        for chunk in chunks:
            ids: list[int] = []
            for piece in self.split(chunk):
                ids += self.merge(piece.encode("utf-8", "replace"))
            yield np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.memo.ids(text), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def rank_file(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines of a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec for each Python worker and file."""
    return Codec(rank_file(path))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """The columns of SCHEMA: every text encoded by the ranks in ``path`` and decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in small(batches):
            doc_ids, texts = columns(batch, "doc_id", "text")
            sizes, printed, back = [], [], []
            for text in texts:
                ids = own.encode(text.as_py() or "").tolist()
                sizes.append(len(ids))
                printed.append(hashlib.sha256(" ".join(map(own.text_of.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.record_batch([doc_ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(printed, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
