"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs: a word is the sum of a learnt vector of its hash bucket and of learnt vectors of its
character runs' buckets (3, 4 and 6 bytes; over the root of their number), after lower-casing and
stripping marks at its ends. In training half of the words (``FORGOTTEN``) show their characters only. The texts are cut
into windows of ``WINDOW`` words that overlap by half. Two gated recurrent units read a window in
either direction; attention over the words pools their states; a logistic unit gives the window's
probability. A document's score is the greatest of its windows'.

Training (driver, bounded sample, see ``labelled``): Adam on windows. The first rounds take random
windows of each document with the document's label; later ones take the window that scores highest,
so that a toxic document teaches by its toxic passage only, and a clean one by its worst.

Scoring reads whole texts. A worker remembers the input projections of at most ``MEMORY`` words.

Defined cases: a null or word-less text scores as one empty window; a text of any length is scored in
all its windows; without labels of both classes
all scores are the share of toxic labels (0 if there are none); repeated rows each keep their row;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.labelled import SCORE, held_out, sample, with_scores

WINDOW, STEP = 32, 16
BUCKETS = 1 << 14
GRAM_BUCKETS = 1 << 15
GRAMS = (3, 4, 6)
WIDTH = 12
HIDDEN = 8
ATTENTION = 8
PER_CLASS = 2500
#: The share of words in a training step of which only the characters are seen, so that those learn what words seldom show.
FORGOTTEN = 0.5
CUTOFF = 0.3
MEMORY = 200_000
BLOCK = 2048
VECTOR_BLOCK = 8192
#: Rounds with random windows and with the highest: at least, at most, and texts over all rounds in between.
ROUNDS = ((2, 12, 8_000), (6, 60, 24_000))
EDGES = b" \t\n\v\f\r.,;:!?\"'()[]{}<>|#*$%&@~_-+=/\\`^"


class Inputs:
    """Buckets of a list of different words and of their runs of GRAMS bytes, with marks at a word's ends."""

    def __init__(self, words: list[bytes]):
        bare = [b"^" + (w.lower() if w.isascii() else w.decode("utf-8", "replace").lower().encode()).strip(EDGES) + b"$" for w in words]
        self.word = np.fromiter(map(crc32, bare), np.int64, len(bare)) % BUCKETS
        sizes = np.fromiter(map(len, bare), np.int64, len(bare))
        pad = max(GRAMS) - 1
        letters = np.frombuffer((b"\0" * pad).join([*bare, b""]), np.uint8).astype(np.uint32)
        begins = np.cumsum(sizes + pad) - sizes - pad
        each = [np.maximum(1, sizes - n + 1) for n in GRAMS]  # a word shorter than a run is one run
        self.counts = sum(each)
        self.starts = np.cumsum(self.counts) - self.counts
        self.gram = np.empty(int(self.counts.sum()), np.int32)
        shift = np.zeros(len(bare), np.int64)
        for n, counts in zip(GRAMS, each):
            nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.repeat(begins, counts) + nth
            h = np.full(len(at), 2166136261 + n, np.uint32)
            for k in range(n):
                h = (h ^ letters[at + k]) * np.uint32(16777619)
            h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            self.gram[np.repeat(self.starts + shift, counts) + nth] = (h ^ h >> np.uint32(12)) % np.uint32(GRAM_BUCKETS)
            shift += counts

    def part(self, types: np.ndarray) -> "Inputs":
        """The inputs of some of the words."""
        out = Inputs.__new__(Inputs)
        out.word, out.counts = self.word[types], self.counts[types]
        out.starts = np.cumsum(out.counts) - out.counts
        shift = np.repeat(self.starts[types] - out.starts, out.counts)
        out.gram = self.gram[np.arange(len(shift)) + shift]
        return out

    def vectors(self, p: dict[str, np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
        """A vector for each word. known: whether a word may be known as a whole, else by its characters only."""
        out = np.empty((len(self.word), WIDTH), np.float32)
        for at in range(0, len(out), VECTOR_BLOCK):
            to = min(len(out), at + VECTOR_BLOCK)
            first, last = self.starts[at], self.starts[to - 1] + self.counts[to - 1]
            sums = np.add.reduceat(p["grams"][self.gram[first:last]], self.starts[at:to] - first, axis=0)
            whole = p["words"][self.word[at:to]]
            out[at:to] = (whole if known is None else whole * known[at:to, None]) + sums / np.sqrt(self.counts[at:to, None])
        return out


def windows(n: int) -> list[int]:
    """Starts of the windows of a text of n words: all that are not wholly inside the one before."""
    return [0, *range(STEP, n - WINDOW + STEP, STEP)] if n > WINDOW else [0]


def start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[-2] if len(shape) > 1 else shape[0]), shape).astype(np.float32)

    def small(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.1, shape).astype(np.float32)

    return {
        "words": small(BUCKETS, WIDTH), "grams": small(GRAM_BUCKETS, WIDTH),
        "wx": draw(2, WIDTH, 3 * HIDDEN), "bx": np.zeros((2, 1, 3 * HIDDEN), np.float32),
        "u": draw(2, HIDDEN, 3 * HIDDEN), "bn": np.zeros((2, 1, HIDDEN), np.float32),
        "a": draw(2 * HIDDEN, ATTENTION), "v": draw(ATTENTION), "o": draw(2 * HIDDEN), "b": np.full(1, -1.0, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def project(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Input projections of word vectors, for both directions: (2, words, 3 * HIDDEN)."""
    return x @ p["wx"] + p["bx"]


def forward(proj: np.ndarray, rows: np.ndarray, mask: np.ndarray, p: dict[str, np.ndarray], keep: list | None = None) -> tuple[np.ndarray, dict]:
    """Logits of windows. rows: (windows, WINDOW) into proj, mask: which are there. keep: gets what the way back needs."""
    n, h2 = len(rows), 2 * HIDDEN
    states = np.empty((WINDOW, n, h2), np.float32)
    h = np.zeros((2, n, HIDDEN), np.float32)
    u = p["u"]
    there = mask.astype(np.float32)
    for s in range(WINDOW):
        at = (s, WINDOW - 1 - s)
        x = np.stack([proj[0].take(rows[:, at[0]], axis=0), proj[1].take(rows[:, at[1]], axis=0)])
        g = h @ u
        zr = _sigmoid(x[:, :, :h2] + g[:, :, :h2])
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        gn = g[:, :, h2:] + p["bn"]
        c = np.tanh(x[:, :, h2:] + r * gn)
        m = np.stack([there[:, at[0]], there[:, at[1]]])[:, :, None]
        step = (1 - z) * (c - h) * m
        if keep is not None:
            keep.append((h, z, r, gn, c, m))
        h = h + step
        states[at[0], :, :HIDDEN] = h[0]
        states[at[1], :, HIDDEN:] = h[1]
    t = np.tanh(states @ p["a"])
    e = t @ p["v"]
    e = np.where(mask.T, e, -1e9)
    e[0][~mask[:, 0]] = 0  # an empty window attends to its first place
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", w, states)
    return pooled @ p["o"] + p["b"], {"states": states, "t": t, "w": w, "pooled": pooled}


def infer(proj: np.ndarray, rows: np.ndarray, mask: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """The logits of ``forward``, for scoring: features before windows and in place, so that every pass over memory is long."""
    n, full = len(rows), bool(mask.all())
    ut = np.ascontiguousarray(p["u"].transpose(0, 2, 1))
    bn, at, v = p["bn"].transpose(0, 2, 1), np.ascontiguousarray(p["a"].T), p["v"]
    h = np.zeros((2, HIDDEN, n), np.float32)
    g = np.empty((2, 3 * HIDDEN, n), np.float32)
    gates, cand = np.empty((2 * HIDDEN, n), np.float32), np.empty((HIDDEN, n), np.float32)
    states = np.empty((WINDOW, 2 * HIDDEN, n), np.float32)
    columns_of = np.ascontiguousarray(rows.T)
    there = mask.T.astype(np.float32)
    picked = np.empty((n, 3 * HIDDEN), np.float32)
    for s in range(WINDOW):
        np.matmul(ut, h, out=g)
        for k, place in enumerate((s, WINDOW - 1 - s)):
            proj[k].take(columns_of[place], axis=0, out=picked, mode="clip")
            x = picked.T
            np.add(g[k, : 2 * HIDDEN], x[: 2 * HIDDEN], out=gates)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.add(g[k, 2 * HIDDEN :], bn[k], out=cand)
            cand *= gates[HIDDEN:]
            cand += x[2 * HIDDEN :]
            np.tanh(cand, out=cand)
            cand -= h[k]
            np.subtract(1, gates[:HIDDEN], out=gates[:HIDDEN])
            cand *= gates[:HIDDEN]
            if not full:
                cand *= there[place]
            h[k] += cand
            states[place, k * HIDDEN : (k + 1) * HIDDEN] = h[k]
    e = np.empty((WINDOW, n), np.float32)
    for s in range(WINDOW):
        e[s] = v @ np.tanh(at @ states[s])
    e[~mask.T] = -1e9
    e[0][~mask[:, 0]] = 0  # an empty window attends to its first place
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.zeros((2 * HIDDEN, n), np.float32)
    for s in range(WINDOW):
        states[s] *= w[s]
        pooled += states[s]
    return p["o"] @ pooled + p["b"]


def backward(dlogit: np.ndarray, kept: list, made: dict, rows: np.ndarray, n_types: int, p: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters above the word vectors, and of the projections."""
    states, t, w, pooled = made["states"], made["t"], made["w"], made["pooled"]
    g = {"o": pooled.T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * p["o"]
    dw = np.einsum("tnh,nh->tn", states, dpool)
    de = w * (dw - (w * dw).sum(axis=0))
    dt = de[:, :, None] * p["v"] * (1 - t * t)
    g["v"] = np.einsum("tn,tna->a", de, t)
    g["a"] = np.einsum("tnh,tna->ha", states, dt)
    dstates = w[:, :, None] * dpool + dt @ p["a"].T
    g["u"], g["bn"] = np.zeros_like(p["u"]), np.zeros_like(p["bn"])
    dproj = np.zeros((2, n_types, 3 * HIDDEN), np.float32)
    dh = np.zeros((2, len(rows), HIDDEN), np.float32)
    for s in range(WINDOW - 1, -1, -1):
        at = (s, WINDOW - 1 - s)
        h, z, r, gn, c, m = kept[s]
        dh = dh + np.stack([dstates[at[0], :, :HIDDEN], dstates[at[1], :, HIDDEN:]])
        dstep = dh * m
        dc = dstep * (1 - z) * (1 - c * c)
        dz = -dstep * (c - h) * z * (1 - z)
        dr = dc * gn * r * (1 - r)
        dx = np.concatenate([dz, dr, dc], axis=2)
        dg = np.concatenate([dz, dr, dc * r], axis=2)
        g["u"] += h.transpose(0, 2, 1) @ dg
        g["bn"] += (dc * r).sum(axis=1, keepdims=True)
        for k in (0, 1):
            np.add.at(dproj[k], rows[:, at[k]], dx[k])
        dh = dh - dstep * (1 - z) + dg @ p["u"].transpose(0, 2, 1)
    return g, dproj


class Corpus:
    """The training texts' words as numbers of a list of different words."""

    def __init__(self, texts: list[bytes]):
        known: dict[bytes, int] = {b"": 0}
        self.docs = [np.array([known.setdefault(w, len(known)) for w in t.split()], np.int32) for t in texts]
        self.inputs = Inputs(list(known))

    def rows(self, picks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.zeros((len(picks), WINDOW), np.int64)
        mask = np.zeros((len(picks), WINDOW), bool)
        for i, (d, at) in enumerate(picks):
            part = self.docs[d][at : at + WINDOW]
            rows[i, : len(part)] = part
            mask[i, : len(part)] = True
        return rows, mask


def fit(texts: list[bytes], labels: np.ndarray, share: float | None = None, seed: int = 5) -> dict[str, np.ndarray]:
    """The trained parameters. share: of toxic documents at large, where the sample has another one."""
    p = start(seed)
    rng = np.random.default_rng(seed)
    corpus = Corpus(texts)
    all_picks = [(d, at) for d in range(len(texts)) for at in windows(len(corpus.docs[d]))]
    owner = np.array([d for d, _ in all_picks])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    weight = np.ones(len(labels), np.float32)
    if share is not None and 0 < share < 1 and 0 < labels.mean() < 1:
        weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean())).astype(np.float32)
    steps = 0

    def learn(picks: list[tuple[int, int]], rate: float) -> None:
        nonlocal steps
        for at in range(0, len(picks), 128):
            part = picks[at : at + 128]
            rows, mask = corpus.rows(part)
            types, rows = np.unique(rows, return_inverse=True)
            rows = rows.reshape(mask.shape)
            sub = corpus.inputs.part(types)
            known = rng.random(len(types)) >= FORGOTTEN
            x = sub.vectors(p, known)
            kept: list = []
            logit, made = forward(project(x, p), rows, mask, p, kept)
            docs = [d for d, _ in part]
            dlogit = ((_sigmoid(logit) - labels[docs]) * weight[docs] / len(part)).astype(np.float32)
            g, dproj = backward(dlogit, kept, made, rows, len(types), p)
            g["wx"] = x.T @ dproj
            g["bx"] = dproj.sum(axis=1, keepdims=True)
            dx = (dproj @ p["wx"].transpose(0, 2, 1)).sum(axis=0)
            steps += 1
            sparse = {"words": (sub.word, dx * known[:, None]), "grams": (sub.gram, np.repeat(dx / np.sqrt(sub.counts)[:, None], sub.counts, axis=0))}
            for name in p:
                if name in sparse:
                    where, values = sparse[name]
                    rows_of, back = np.unique(where, return_inverse=True)
                    grad = np.zeros((len(rows_of), WIDTH), np.float32)
                    np.add.at(grad, back, values)
                else:
                    rows_of, grad = slice(None), g[name]
                m1, m2 = moment[name]
                m1[rows_of] = 0.9 * m1[rows_of] + 0.1 * grad
                m2[rows_of] = 0.99 * m2[rows_of] + 0.01 * grad * grad
                p[name][rows_of] -= rate * (m1[rows_of] / (1 - 0.9**steps)) / (np.sqrt(m2[rows_of] / (1 - 0.99**steps)) + 1e-6)

    random_rounds, best_rounds = (min(most, max(least, total // len(texts))) for least, most, total in ROUNDS)
    for _ in range(random_rounds):
        order = rng.permutation(len(all_picks))
        taken: dict[int, int] = {}
        picks = []
        for i in order:
            if taken.setdefault(owner[i], 0) < 3:
                taken[owner[i]] += 1
                picks.append(all_picks[i])
        learn(picks, 0.01)
    for k in range(best_rounds):
        proj = project(corpus.inputs.vectors(p), p)
        scores = np.concatenate([infer(proj, *corpus.rows(all_picks[at : at + BLOCK]), p) for at in range(0, len(all_picks), BLOCK)])
        best = np.full(len(texts), -1)
        for i in np.argsort(scores, kind="stable"):
            best[owner[i]] = i
        learn([all_picks[i] for i in rng.permutation(best)], 0.01 / (1 + 3 * k / best_rounds))
    return p


class Scorer:
    """Scores texts in a worker; remembers the projections of words."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.proj = np.empty((2, 1024, 3 * HIDDEN), np.float32)
        self.proj[:, :1] = project(Inputs([b""]).vectors(self.p), self.p)

    def _learn(self, words: list[bytes]) -> None:
        at, to = len(self.known), len(self.known) + len(words)
        if to > self.proj.shape[1]:
            bigger = np.empty((2, to + to // 4, 3 * HIDDEN), np.float32)
            bigger[:, :at] = self.proj[:, :at]
            self.proj = bigger
        self.proj[:, at:to] = project(Inputs(words).vectors(self.p), self.p)
        self.known.update(zip(words, range(at, to)))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """The greatest window probability of each text."""
        if len(self.known) > MEMORY:
            self._reset()
        best = np.full(len(texts), -np.inf, np.float32)
        rows, sizes, owner = [], [], []
        for d, text in enumerate(texts):
            words = (text or b"").split()
            found = list(map(self.known.get, words))
            if None in found:
                self._learn(list(dict.fromkeys(w for w, x in zip(words, found) if x is None)))
                found = list(map(self.known.get, words))
            starts = np.array(windows(len(found)), np.int64)
            padded = np.zeros(starts[-1] + WINDOW, np.int32)
            padded[: len(found)] = found
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts])
            sizes.append(np.minimum(WINDOW, len(found) - starts))
            owner.append(np.full(len(starts), d))
            if sum(map(len, sizes[-1:])) and sum(map(len, sizes)) >= BLOCK or d == len(texts) - 1:
                self._flush(np.concatenate(rows), np.concatenate(sizes), np.concatenate(owner), best)
                rows, sizes, owner = [], [], []
        return _sigmoid(best.astype(np.float64))

    def _flush(self, rows: np.ndarray, sizes: np.ndarray, owner: np.ndarray, best: np.ndarray) -> None:
        for at in range(0, len(rows), BLOCK):
            part = slice(at, at + BLOCK)
            mask = np.arange(WINDOW) < sizes[part, None]
            np.maximum.at(best, owner[part], infer(self.proj, rows[part], mask, self.p))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> "dict[str, np.ndarray] | float":
    """Parameters, or the share of toxic labels where they have one class only."""
    known = sample(docs, labels, "toxic", per_class)
    y = known["label"].to_numpy(np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    counts = {r["toxic"]: r["count"] for r in labels.filter(~held_out()).groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    return fit([t.encode() for t in known["text"]], y, share)


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = train(docs, labels, per_class)

    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), Scorer, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= cutoff).cast("int").alias("predicted"))
