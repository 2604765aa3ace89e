"""Document quality by attention-based multiple-instance learning, in numpy.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from its words (means of
word-shape features and of learnt vectors of hashed shapes) and of its own make-up (repeats, variety,
length); an encoder layer gives its representation h. Gated attention weighs the passages,
a_k = softmax(w . (tanh(V h_k) * sigmoid(U h_k))), and a logistic unit scores the weighted sum. Only
documents have labels. ``attention`` returns the passages' weights.

Training (driver, bounded sample, see ``labelled``): Adam on documents. Scoring reads whole texts:
passages are encoded in blocks and a document's weighted sum is kept as running sums, so that a text
of any length needs the memory of a block. A worker remembers at most ``MEMORY`` words.

Defined cases: a null or word-less text is one empty passage; without labels of both classes all
scores are the share of good labels (1 if there are none); repeated rows each keep their row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.labelled import SCORE, held_out, sample, with_scores

PASSAGE = 64
SHAPES = 512
EMBED = 6
HIDDEN = 16
ATTENTION = 8
PER_CLASS = 2500
CUTOFF = 0.7
MEMORY = 200_000
BLOCK = 4096
#: Rounds over the documents: at least, at most, and documents over all rounds in between.
ROUNDS = (30, 200, 60_000)
FEATURES = 14
EXTRA = 6
TURNS = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))


def shape_of(word: bytes) -> int:
    """The hash bucket of a word's shape: runs of capitals, of other letters and of digits become A, a and 0."""
    for pattern, mark in TURNS:
        word = pattern.sub(mark, word)
    return crc32(word) % SHAPES


def features_of(word: bytes) -> tuple[float, ...]:
    size = len(word)
    lower = sum(97 <= c <= 122 for c in word)
    upper = sum(65 <= c <= 90 for c in word)
    digits = sum(48 <= c <= 57 for c in word)
    other = sum(c > 127 for c in word)
    marks = size - lower - upper - digits - other
    return (
        1.0, min(size, 30) / 10, float(size <= 2), float(size > 15), lower / size, upper / size, digits / size, other / size, marks / size,
        float(upper == size - marks and upper > 1), float(marks >= 3), float(marks == size), float(word[-1:] in b".,;:?!"), float(word[:1].isupper()),
    )


class Words:
    """Numbers, features and shapes of words; number 0 is no word."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.features = np.zeros((1024, FEATURES), np.float32)
        self.shapes = np.zeros(1024, np.int64)

    def numbers(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        found = list(map(self.known.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, x in zip(words, found) if x is None))
            at, to = len(self.known), len(self.known) + len(new)
            if to > len(self.shapes):
                self.features = np.concatenate([self.features, np.zeros((2 * to - len(self.shapes), FEATURES), np.float32)])
                self.shapes = np.concatenate([self.shapes, np.zeros(2 * to - len(self.shapes), np.int64)])
            self.features[at:to] = [features_of(w) for w in new]
            self.shapes[at:to] = [shape_of(w) for w in new]
            self.known.update(zip(new, range(at, to)))
            found = list(map(self.known.get, words))
        return np.array(found, np.int32)


def passages(numbers: np.ndarray) -> np.ndarray:
    """A document's words in rows of PASSAGE, 0 beyond its end."""
    n = max(1, -(-len(numbers) // PASSAGE))
    out = np.zeros(n * PASSAGE, np.int32)
    out[: len(numbers)] = numbers
    return out.reshape(n, PASSAGE)


def describe(rows: np.ndarray, words: Words) -> np.ndarray:
    """Features of passages: means over their words, and how they repeat."""
    sizes = (rows > 0).sum(axis=1)
    per = np.maximum(sizes, 1)[:, None].astype(np.float32)
    means = words.features[rows].sum(axis=1) / per
    ordered = np.sort(rows, axis=1)
    distinct = ((ordered[:, 1:] != ordered[:, :-1]) & (ordered[:, 1:] > 0)).sum(axis=1) + (ordered[:, 0] > 0)
    there = rows[:, 1:] > 0
    twice = ((rows[:, 1:] == rows[:, :-1]) & there).sum(axis=1)
    near = ((rows[:, 2:] == rows[:, :-2]) & (rows[:, 2:] > 0)).sum(axis=1)
    extra = np.column_stack([sizes / PASSAGE, sizes < 20, distinct / per[:, 0], twice / per[:, 0], near / per[:, 0], sizes == 0])
    return np.concatenate([means, extra.astype(np.float32)], axis=1)


def start(seed: int = 8) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def draw(a: int, *b: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(a), (a, *b)).astype(np.float32)

    return {
        "shapes": (0.1 * rng.normal(size=(SHAPES, EMBED))).astype(np.float32),
        "enc": draw(FEATURES + EXTRA + EMBED, HIDDEN), "eb": np.zeros(HIDDEN, np.float32),
        "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "o": draw(HIDDEN), "b": np.zeros(1, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def shares(rows: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shape buckets of the passages' words, and the weight of each in its passage's mean (0 for no word)."""
    there = rows > 0
    return words.shapes[rows], (there / np.maximum(there.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def mixed(rows: np.ndarray, words: Words) -> np.ndarray:
    """The passages' shares of shape buckets, as a matrix."""
    buckets, weight = shares(rows, words)
    cells = np.arange(len(rows))[:, None] * SHAPES + buckets
    return np.bincount(cells.ravel(), weight.ravel(), len(rows) * SHAPES).reshape(len(rows), SHAPES).astype(np.float32)


def encode(described: np.ndarray, mean_shape: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The encoder's input and the representations of passages."""
    x = np.concatenate([described, mean_shape], axis=1)
    return x, np.tanh(x @ p["enc"] + p["eb"])


def gate(h: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tanh and sigmoid parts of the gated attention, and its logits."""
    t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    return t, s, (t * s) @ p["w"]


def fit(texts: list[bytes], labels: np.ndarray, share: float | None = None, seed: int = 8) -> dict[str, np.ndarray]:
    """The trained parameters. share: of good documents at large, where the sample has another one."""
    p, words, rng = start(seed), Words(), np.random.default_rng(seed)
    rows = [passages(words.numbers(t)) for t in texts]
    sizes = np.array([len(r) for r in rows])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    described = np.concatenate([describe(r, words) for r in rows])
    every = np.concatenate(rows)
    weight = np.ones(len(labels), np.float32)
    if share is not None and 0 < share < 1 and 0 < labels.mean() < 1:
        weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean())).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    steps = 0
    rounds = min(ROUNDS[1], max(ROUNDS[0], ROUNDS[2] // len(texts)))
    for k in range(rounds):
        rate = 0.02 / (1 + 4 * k / rounds)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 64):
            docs = order[at : at + 64]
            n = sizes[docs]
            place = np.concatenate([np.arange(firsts[d], firsts[d] + sizes[d]) for d in docs])
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            owner = np.repeat(np.arange(len(docs)), n)
            mix = mixed(every[place], words)
            x, h = encode(described[place], mix @ p["shapes"], p)
            t, s, e = gate(h, p)
            a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
            a /= np.add.reduceat(a, starts)[owner]
            z = np.add.reduceat(a[:, None] * h, starts, axis=0)
            logit = z @ p["o"] + p["b"]
            d = ((_sigmoid(logit) - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            dz = d[:, None] * p["o"]
            da = (h * dz[owner]).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, starts)[owner])
            dts = de[:, None] * p["w"]
            dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
            dh = a[:, None] * dz[owner] + dt @ p["V"].T + ds @ p["U"].T
            dpre = dh * (1 - h * h)
            dx = dpre @ p["enc"].T
            g = {"o": z.T @ d, "b": np.array([d.sum()]), "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "enc": x.T @ dpre, "eb": dpre.sum(axis=0), "shapes": mix.T @ dx[:, -EMBED:]}
            steps += 1
            for name, grad in g.items():
                grad = grad + 1e-5 * p[name]
                m1, m2 = moment[name]
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                p[name] -= (rate * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
    return p


class Scorer:
    """Scores texts in a worker."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.words = p, Words()

    def _passages(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representations and attention logits of passages."""
        buckets, weight = shares(rows, self.words)
        mean = np.einsum("pw,pwe->pe", weight, self.p["shapes"][buckets])
        _, h = encode(describe(rows, self.words), mean, self.p)
        return h, gate(h, self.p)[2]

    def attention(self, text: bytes) -> np.ndarray:
        """The weights of a text's passages."""
        e = self._passages(passages(self.words.numbers(text)))[1]
        a = np.exp(e - e.max())
        return a / a.sum()

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if len(self.words.known) > MEMORY:
            self.words.reset()
        # attention logits are bounded by the sum of |w|, so exp needs no running maximum
        top = np.zeros((len(texts), HIDDEN))
        low = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        count = 0
        for d, text in enumerate(texts):
            rows = passages(self.words.numbers(text))
            held.append(rows)
            owner.append(np.full(len(rows), d))
            count += len(rows)
            if count >= BLOCK or d == len(texts) - 1:
                all_rows, all_owner = np.concatenate(held), np.concatenate(owner)
                for at in range(0, len(all_rows), BLOCK):
                    h, e = self._passages(all_rows[at : at + BLOCK])
                    a = np.exp(e.astype(np.float64))
                    own = all_owner[at : at + BLOCK]
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    top[own[first]] += np.add.reduceat(a[:, None] * h, first, axis=0)
                    low[own[first]] += np.add.reduceat(a, first)
                held, owner, count = [], [], 0
        return _sigmoid((top / low[:, None]) @ self.p["o"].astype(np.float64) + self.p["b"][0])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> "dict[str, np.ndarray] | float":
    """Parameters, or the share of good labels where they have one class only."""
    known = sample(docs, labels, "quality", per_class)
    y = known["label"].to_numpy(np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 1.0
    counts = {r["quality"]: r["count"] for r in labels.filter(~held_out()).groupBy("quality").count().collect()}
    return fit([t.encode() for t in known["text"]], y, counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0)))


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = train(docs, labels, per_class)

    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), Scorer, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= cutoff).cast("int").alias("predicted"))
