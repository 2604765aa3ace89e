"""Quality rules combined by weak supervision.

Each rule votes good or bad on a document or abstains. The documents' vote patterns are counted (at
most 3^9 patterns, whatever the corpus), expectation-maximisation over the counts estimates how
often a rule that votes is right on good and on bad documents, and a document is kept when the
posterior probability of being good is at least ``KEEP``. Patterns and posteriors are all that
reaches the driver or is broadcast.

Measures count words ``[^\\x20\\x09-\\x0D]+`` of the whole text; a repeated word stands in an 8-word
window that the text holds twice or more. Windows are found by hash and confirmed word by word.

Defined cases: a null or empty text has no words and fails the base rule; the words of a text of any
length all count; texts that tie in their votes tie in the verdict; repeated rows and ids each
keep their row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import Shelf, columns, small, utf8_list

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
KEEP = 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_marked", "n_closed")
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
SPACES = b" \t\n\v\f\r"
ROUNDS = 200


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    if len(seen) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    for k in range(window):  # equal hashes, but other words
        a, b = ids[order[1:] + k], ids[order[:-1] + k]
        if not np.array_equal(a[same], b[same]):
            return _repeated_plainly(ids, window)
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


def _repeated_plainly(ids: np.ndarray, window: int) -> int:
    where: dict[tuple, list[int]] = {}
    plain = ids.tolist()
    for i in range(len(plain) - window + 1):
        where.setdefault(tuple(plain[i : i + window]), []).append(i)
    covered = np.zeros(len(plain), bool)
    for starts in where.values():
        if len(starts) > 1:
            for i in starts:
                covered[i : i + window] = True
    return int(covered.sum())


def measure(text: bytes | None) -> tuple:
    """The MEASURES of a UTF-8 text."""
    text = text or b""
    words = text.split()
    body = text.translate(None, SPACES)
    letters = len(body.translate(None, UPPER))
    upper = len(body) - letters
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    chars = sum(map(len, (body.decode("utf-8", "replace"),)))
    lower = letters - len(body.translate(None, UPPER + LOWER))
    marked = len(words) - sum(w[-1:].isalpha() or w[-1] in b".,;:?'\")" or w[-1] > 127 or w[-1:].isdigit() for w in words)
    closed = sum(line.rstrip(SPACES)[-1:] in (b".", b"!", b"?", b'"', b":") for line in lines)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, upper + lower, len(set(words)), marked, closed


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        ids, texts = columns(batch, "doc_id", "text")
        rows = [measure(t) for t in utf8_list(texts)]
        cols = zip(*rows) if rows else [[]] * len(MEASURES)
        yield pa.record_batch([ids.cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *MEASURES])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the MEASURES of every row."""
    return docs.select("doc_id", "text").mapInArrow(_measures, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def _vote(bad: str, good: str):
    return F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0))


#: name: (bad when, good when); in between, or where the text is too short to tell, the rule abstains.
RULES = {
    "length": ("n_words < 20", "n_words >= 40"),
    "repeats": ("n_words >= 16 AND 100 * n_repeat_words > 30 * n_words", "n_words >= 16 AND 100 * n_repeat_words <= 10 * n_words"),
    "symbols": ("n_symbols * 100 > 8 * word_chars", "n_symbols * 100 <= 1 * word_chars"),
    "capitals": ("n_letters >= 20 AND n_upper * 100 > 60 * n_letters", "n_letters >= 20 AND n_upper * 100 <= 25 * n_letters"),
    "marks": ("n_words >= 10 AND n_marked * 100 > 40 * n_words", "n_words >= 10 AND n_marked * 100 <= 10 * n_words"),
    "word_size": ("n_words > 0 AND (word_chars > 14 * n_words OR word_chars < 2 * n_words)", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words AND n_words > 0"),
    "variety": ("n_words BETWEEN 30 AND 2000 AND n_distinct * 100 < 15 * n_words", "n_words BETWEEN 30 AND 2000 AND n_distinct * 100 >= 30 * n_words"),
    "lines": ("n_lines >= 5 AND n_dup_lines * 100 > 50 * n_lines", "n_lines >= 2 AND n_dup_lines * 100 <= 10 * n_lines"),
    "endings": ("n_lines >= 4 AND n_closed * 100 < 20 * n_lines", "n_lines >= 1 AND n_closed * 100 >= 60 * n_lines"),
}


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, chance of a bad vote by class and rule), by EM over pattern counts.

    An abstention is no evidence. The start takes any bad vote as a sign of a bad document.
    Pseudo-counts of a hundredth of the documents, at most 10, keep chances from 0 and 1: a rule
    that votes, votes bad on 2 % of good documents and on 50 % of bad ones.
    """
    weight = counts.astype(float)
    bad, voted = (patterns == -1).astype(float), (patterns != 0).astype(float)
    good = np.where(bad.any(axis=1), 0.1, 0.95)
    strength = min(10.0, weight.sum() / 100)
    chance = np.zeros((2, patterns.shape[1]))
    for _ in range(ROUNDS):
        for k, (share, prior) in enumerate(((1 - good, 0.5), (good, 0.02))):
            chance[k] = ((weight * share) @ bad + prior * strength) / ((weight * share) @ voted + strength)
        base = ((weight * good).sum() + 0.8 * strength) / (weight.sum() + strength)
        ratio = bad @ np.log(chance[1] / chance[0]) + (voted - bad) @ np.log((1 - chance[1]) / (1 - chance[0]))
        new = 1 / (1 + np.exp(-np.clip(ratio + np.log(base / (1 - base)), -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            return new, chance
        good = new
    return good, chance


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the MEASURES, base_failed, quality (posterior) and kept of every row."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "rules")
    names = list(RULES)
    pattern = F.array(*(_vote(*RULES[r]) for r in names))
    voted = shelf.put(measures(docs).withColumn("votes", F.array_join(pattern.cast("array<string>"), " ")))
    counted = voted.groupBy("votes").count().orderBy("votes").collect()  # at most 3 to the number of rules
    table = np.array([[int(v) for v in row["votes"].split()] for row in counted], int).reshape(len(counted), len(names))
    quality, _ = estimate(table, np.array([row["count"] for row in counted])) if counted else (np.empty(0), None)
    known = spark.createDataFrame([(row["votes"], float(q)) for row, q in zip(counted, quality)], "votes string, quality double")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = voted.join(F.broadcast(known), "votes")  # a row for each pattern
    return judged.select("doc_id", *MEASURES, base.alias("base_failed"), "quality", (~base & (F.col("quality") >= keep)).alias("kept"))
