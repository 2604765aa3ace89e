"""Recursive graph bisection: an order of documents in which those with the same terms stand together.

The tree is fitted on a sample of documents of bounded size. A node halves its documents at random
and then swaps pairs across while that lowers the estimated bits of the gaps in the terms' posting
lists; the terms' shares in both halves become weights, and a document goes the way that its terms
weigh, against the median of the node's documents, so that any document can be sent down the tree.
The leaf it comes to, counted from the left, is its place in the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

ROUNDS = 12
#: The most terms that a tree weighs (those in most of the sample's documents), and its greatest depth.
TERMS, DEPTH = 1 << 14, 8


@dataclass
class Tree:
    """weights[node, term] and thresholds[node] for nodes in heap order from 1; terms by their bytes."""

    depth: int
    terms: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def leaves(self, docs: Sequence[Sequence[bytes]]) -> np.ndarray:
        """The leaf of each document, given its different terms."""
        node = np.ones(len(docs), np.int64)
        if not self.depth or not len(docs):
            return node - 1
        known = [[n for t in own if (n := self.terms.get(t)) is not None] for own in docs]
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter((n for own in known for n in own), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(docs)), sizes)
        for _ in range(self.depth):
            pull = np.bincount(owner, self.weights[node[owner], flat], len(docs))
            node = 2 * node + (pull > self.thresholds[node])
        return node - (1 << self.depth)


def _bits(count: np.ndarray, size: int) -> np.ndarray:
    """The estimated bits of the gaps of terms that ``count`` of ``size`` documents have."""
    return count * np.log2(size / (count + 1) + 1e-12)


def halves(owner: np.ndarray, term: np.ndarray, size: int, terms: int, rng: np.random.Generator) -> np.ndarray:
    """For each of ``size`` documents whether it is in the second half; (owner, term) are its different terms."""
    second = np.zeros(size, bool)
    second[rng.permutation(size)[: size // 2]] = True
    m, k = size - size // 2, size // 2
    all_ = np.bincount(term, minlength=terms).astype(np.float64)
    for _ in range(ROUNDS):
        b = np.bincount(term[second[owner]], minlength=terms).astype(np.float64)
        a = all_ - b
        now = _bits(a, m) + _bits(b, k)
        there = now - _bits(np.maximum(a - 1, 0), m) - _bits(b + 1, k)
        back = now - _bits(a + 1, m) - _bits(np.maximum(b - 1, 0), k)
        gain = np.bincount(owner, np.where(second[owner], back[term], there[term]), size)
        left, right = (np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")] for side in (~second, second))
        pairs = min(len(left), len(right))
        swaps = int(np.count_nonzero(gain[left[:pairs]] + gain[right[:pairs]] > 0))
        if not swaps:
            break
        second[left[:swaps]], second[right[:swaps]] = True, False
    return second


def fit(docs: Sequence[Sequence[bytes]], depth: int, seed: int = 7) -> Tree:
    """A tree of at most ``depth`` levels from the different terms of each document of a sample."""
    counts: dict[bytes, int] = {}
    for own in docs:
        for t in own:
            counts[t] = counts.get(t, 0) + 1
    chosen = sorted((t for t, n in counts.items() if 1 < n < len(docs)), key=lambda t: (-counts[t], t))[:TERMS]
    terms = {t: k for k, t in enumerate(chosen)}
    depth = max(0, min(depth, DEPTH, (len(docs) // 4).bit_length() - 1)) if terms else 0
    tree = Tree(depth, terms, np.zeros((1 << depth, len(terms)), np.float32), np.zeros(1 << depth))
    known = [np.array([terms[t] for t in own if t in terms], np.int32) for own in docs]
    rng, members = np.random.default_rng(seed), {1: np.arange(len(docs))}
    for node in range(1, 1 << depth):
        own = members.pop(node)
        if len(own) < 2:
            members |= {2 * node: own, 2 * node + 1: own[:0]}
            continue
        sizes = np.array([len(known[i]) for i in own])
        flat, owner = np.concatenate([known[i] for i in own]), np.repeat(np.arange(len(own)), sizes)
        second = halves(owner, flat, len(own), len(terms), rng)
        b = np.bincount(flat[second[owner]], minlength=len(terms))
        a = np.bincount(flat, minlength=len(terms)) - b
        weights = np.log2((b + 1) / (len(own) // 2 + 1)) - np.log2((a + 1) / (len(own) - len(own) // 2 + 1))
        weights[(a + b) == 0] = 0
        tree.weights[node] = weights
        pull = np.bincount(owner, tree.weights[node][flat], len(own))
        tree.thresholds[node] = np.sort(pull)[(len(own) - 1) // 2]
        right = pull > tree.thresholds[node]
        members |= {2 * node: own[~right], 2 * node + 1: own[right]}
    return tree
