"""Simple tree matching: the greatest number of nodes that two ordered trees share from the root down.

A node matches a node of its sign; of two lists of children any number match in order, each with the
number that their own children match. Equal trees are one object, so equal heads and tails of two
lists match at once (no other choice is better) and a pair of trees is compared once. What is left
is dynamic programming over rows of numpy arrays. No recursion.

Lists whose product is over ``WIDE`` are cut first: trees that stand once in either list and are equal
match, as many as can in order, and what is between them is matched by itself. A part that is still
over ``WIDE`` is matched within ``BAND`` places of its diagonal, by how many of their children's signs two
trees share; their own children are compared only where they match. So time and memory grow with
the lists' lengths, whatever the page; such a match may be less than the greatest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np

#: Trees and results that a worker remembers; forgotten ones are made again.
MEMORY = 200_000
WIDE, BAND = 1 << 14, 64


class Shape:
    """A tree of signs. Made by ``shape`` only; equal ones that are remembered are the same object."""

    __slots__ = ("kids", "sign", "signs", "size")

    def __init__(self, sign: str, kids: tuple["Shape", ...]):
        self.sign, self.kids, self.size = sign, kids, 1 + sum(k.size for k in kids)
        self.signs: Counter | None = None  # of the children, once asked for


_shapes: dict[tuple, Shape] = {}
_matched: dict[tuple[Shape, Shape], int] = {}

Trees = tuple[Shape, ...]


def shape(sign: str, kids: Trees) -> Shape:
    if len(_shapes) > MEMORY:
        _shapes.clear()
    found = _shapes.get((sign, kids))
    if found is None:
        found = _shapes[sign, kids] = Shape(sign, kids)
    return found


def _trim(x: Trees, y: Trees) -> tuple[int, int]:
    """How many of the first and of the last trees are equal."""
    most = min(len(x), len(y))
    lo = 0
    while lo < most and x[lo] is y[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and x[-1 - hi] is y[-1 - hi]:
        hi += 1
    return lo, hi


def _middle(x: Trees, y: Trees) -> tuple[Trees, Trees, int]:
    lo, hi = _trim(x, y)
    return x[lo : len(x) - hi], y[lo : len(y) - hi], lo


def _possible(x: Trees, y: Trees) -> list[tuple[Shape, Shape]]:
    """The different pairs of trees of one sign."""
    by_sign: dict[str, list[Shape]] = defaultdict(list)
    for b in dict.fromkeys(y):
        by_sign[b.sign].append(b)
    return [(a, b) for a in dict.fromkeys(x) for b in by_sign.get(a.sign, ())]


def _solve(todo: list[tuple[Shape, Shape]]) -> None:
    """Fills in how many nodes the pairs match."""
    while todo:
        pair = todo[-1]
        a, b = pair
        if pair in _matched:
            todo.pop()
        elif a is b:
            _matched[pair] = a.size
        else:
            x, y, _ = _middle(a.kids, b.kids)
            if len(x) * len(y) > WIDE:
                _matched[pair] = 1 + sum(k.size for k in a.kids) - sum(k.size for k in x) + sum(_alike(x[i], y[j]) for i, j in _wide(x, y))
                continue
            before = [p for p in _possible(x, y) if p not in _matched]
            if before:
                todo.extend(before)
            else:
                _matched[pair] = 1 + sum(k.size for k in a.kids) - sum(k.size for k in x) + _best(x, y)


def _weights(x: Trees, y: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each tree of either list, and how much two kinds match."""
    kinds = [{t: i for i, t in enumerate(dict.fromkeys(trees))} for trees in (x, y)]
    table = np.zeros((len(kinds[0]), len(kinds[1])), np.int64)
    for a, b in _possible(x, y):
        table[kinds[0][a], kinds[1][b]] = _matched[a, b]
    return np.array([kinds[0][a] for a in x]), np.array([kinds[1][b] for b in y]), table


def _row(before: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The next row of the table of best sums."""
    now = before.copy()
    np.maximum(before[1:], before[:-1] + weights, out=now[1:])
    return np.maximum.accumulate(now)


def _best(x: Trees, y: Trees) -> int:
    if not x or not y:
        return 0
    a, b, table = _weights(x, y)
    row = np.zeros(len(y) + 1, np.int64)
    for kind in a.tolist():
        row = _row(row, table[kind][b])
    return int(row[-1])


def pairs(x: Trees, y: Trees) -> list[tuple[int, int]]:
    """Which trees of the lists match: (place in x, place in y), ascending."""
    if len(_matched) > MEMORY:
        _matched.clear()
    left, right, lo = _middle(x, y)
    out = [(i, i) for i in range(lo)]
    if left and right:
        out.extend((lo + i, lo + j) for i, j in (_exact if len(left) * len(right) <= WIDE else _wide)(left, right))
    tail = len(x) - lo - len(left)
    out.extend((len(x) - tail + k, len(y) - tail + k) for k in range(tail))
    return sorted(out)


def _exact(x: Trees, y: Trees) -> list[tuple[int, int]]:
    _solve(_possible(x, y))
    a, b, table = _weights(x, y)
    return _trace(a, b, table, 0, 0)


# --- long lists


def _anchors(x: Trees, y: Trees) -> list[tuple[int, int]]:
    """Equal trees that stand once in either list, as many as are in one order in both."""
    once = [Counter(trees) for trees in (x, y)]
    place = {t: j for j, t in enumerate(y) if once[1][t] == 1}
    common = [(i, place[t]) for i, t in enumerate(x) if once[0][t] == 1 and t in place]
    ends: list[int] = []  # the least end of an ascending row of each length, and who ends it
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(common):
        at = bisect_left(ends, j)
        before.append(last[at - 1] if at else -1)
        if at == len(ends):
            ends.append(j)
            last.append(k)
        else:
            ends[at], last[at] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(common[k])
        k = before[k]
    return out[::-1]


def _wide(x: Trees, y: Trees) -> list[tuple[int, int]]:
    """A match of long lists: the anchors, and the parts between them."""
    out: list[tuple[int, int]] = []
    i = j = 0
    for p, q in [*_anchors(x, y), (len(x), len(y))]:
        left, right, lo = _middle(x[i:p], y[j:q])
        out.extend((i + k, j + k) for k in range(lo))
        tail = p - i - lo - len(left)
        if left and right:
            few = len(left) * len(right) <= WIDE and _flat(left) and _flat(right)
            out.extend((i + lo + a, j + lo + b) for a, b in (_exact if few else _banded)(left, right))
        out.extend((p - tail + k, q - tail + k) for k in range(tail))
        if p < len(x):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def _flat(trees: Trees) -> bool:
    """Whether no tree has many children, so that comparing all pairs is cheap."""
    return all(len(t.kids) <= BAND for t in trees)


def _alike(a: Shape, b: Shape) -> int:
    """A lower bound of what two trees match by their roots and their children's signs; 0 if the roots differ."""
    if a is b:
        return a.size
    if a.sign != b.sign:
        return 0
    for t in (a, b):
        if t.signs is None:
            t.signs = Counter(k.sign for k in t.kids)
    few, many = (a.signs, b.signs) if len(a.signs) <= len(b.signs) else (b.signs, a.signs)
    return 1 + sum(min(n, many[sign]) for sign, n in few.items() if sign in many)


def _banded(x: Trees, y: Trees) -> list[tuple[int, int]]:
    """The best match in which places are at most BAND from the diagonal, by ``_alike``."""
    n, m = len(x), len(y)
    start = np.array([max(0, min(m, i * m // n) - BAND) for i in range(n + 1)])  # the first column of each row that is held
    width = 2 * BAND + m // n + 3
    row = np.zeros(width, np.int64)
    steps = np.zeros((n, width), np.int8)  # 0: x[i] is passed over, 1: y[j - 1] is, 2: both match
    for i in range(n):
        at = int(start[i + 1])
        shift = at - int(start[i])
        cells = np.arange(at, at + width)  # columns j: the first j of y are used
        over = np.concatenate([row[shift:], np.full(min(shift, width), row[-1])])[:width]
        before = np.concatenate([row[shift - 1 :], np.full(max(0, shift - 1), row[-1])])[:width] if shift else np.concatenate([[0], row[:-1]])
        gain = np.fromiter((_alike(x[i], y[j - 1]) if 0 < j <= m else 0 for j in cells.tolist()), np.int64, width)
        took = np.where(gain > 0, before + gain, 0)
        best = np.maximum(over, took)
        row = np.maximum.accumulate(best)
        steps[i] = np.where(row > best, 1, np.where((took == best) & (gain > 0), 2, 0))
    out, i, j = [], n, m
    while i and j:
        k = j - int(start[i])
        if not 0 <= k < width:
            i, j = (i - 1, j) if k < 0 else (i, j - 1)
        elif steps[i - 1][k] == 1:
            j -= 1
        elif steps[i - 1][k] == 2:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            i -= 1
    return out[::-1]


def _trace(a: np.ndarray, b: np.ndarray, table: np.ndarray, i0: int, j0: int) -> list[tuple[int, int]]:
    rows = [np.zeros(len(b) + 1, np.int64)]
    for kind in a.tolist():
        rows.append(_row(rows[-1], table[kind][b]))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i0 + i, j0 + j))
    return out
