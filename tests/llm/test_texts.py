"""Fingerprints, packing, byte-level BPE and quality rules."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import LONG, ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftmill.llm import bpe, chunks, packing, prefixprint, rules

RANKS, JSON = (public_tokenizers.path(f"byte_bpe_50k.{e}") for e in ("tiktoken", "json"))


# --- prefix fingerprints


def plain_likeness(a, b, span=prefixprint.SPAN):
    m = min(len(a), len(b))
    front = next((i for i in range(m) if a[i] != b[i]), m)
    back = next((i for i in range(m - front) if a[-1 - i] != b[-1 - i]), m - front)

    def common(x, y):
        within = {*range(front), *range(len(x) - back, len(x))}
        for i in range(len(x) - span + 1):
            if x[i : i + span] in y:
                within |= {*range(i, i + span)}
        return len(within)

    return min(common(a, b), common(b, a)) / max(len(a), len(b)) if a or b else 1.0


@pytest.mark.parametrize("per_range", [1 << 25, 16])
def test_fingerprints(spark, per_range):
    odd = [(k, t[:3000] if t else t) for k, t in ODD]  # the plain version is slow; the whole long text is in the next test
    rows = sorted(((k, t or "") for k, t in odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, likeness = [], lru_cache(None)(plain_likeness)
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(t, edited), likeness(t, after)))
    got = prefixprint.fingerprints(docs(spark, odd), per_range).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got), key=str) == sorted(want, key=str)
    by_size = defaultdict(set)
    for r in got:
        by_size[(r["n_chars"], r["doc_id"])].add(r["fingerprint"])
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 23}) == 1  # the same text three times


def test_fingerprints_of_one_row_and_none(spark):
    only = prefixprint.fingerprints(docs(spark, [(1, "abcdefgh")])).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and only["near_next"] == 1.0
    assert prefixprint.fingerprints(docs(spark, [])).count() == 0
    long = prefixprint.fingerprints(docs(spark, [(1, LONG), (2, LONG)])).collect()
    assert [r["near_next"] for r in long] == [1.0, 1.0] and all(r["n_chars"] == len(LONG) for r in long)


def test_many_rows_without_an_id_are_split(spark):
    frame = docs(spark, [(None, f"text {i % 7} of many") for i in range(600)]).repartition(8)
    got = prefixprint.fingerprints(frame, 400).collect()
    assert len(got) == 600 and sum(r["near_next"] < 1 for r in got) == 7  # seven runs of equal texts
    sizes = prefixprint.fingerprints(frame, 400).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 200


def test_scattered_edits_cost_little():
    rng = random.Random(4)
    a = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    b = list(a)
    for at in range(200, 4000, 400):
        b[at] = "#"
    own, other = (prefixprint.Prefixes(prefixprint.codes(x)) for x in (a, "".join(b)))
    assert own.likeness(other) == 1 - 10 / 4000 == other.likeness(own)
    far = prefixprint.Prefixes(prefixprint.codes("".join(rng.choice("abcdefgh ") for _ in range(4000))))
    assert own.likeness(far) < 0.01
    repeated = prefixprint.Prefixes(prefixprint.codes(a[:40] * 50))
    assert own.likeness(repeated) < 0.02


@given(st.text(alphabet="ab", max_size=90), st.text(alphabet="ab", max_size=90), st.integers(0, 90))
@settings(max_examples=150, deadline=None)
def test_likeness_of_edited_texts(a, b, at):
    edited = a[:at] + b[: at // 9] + a[at + at // 11 :]
    own = prefixprint.Prefixes(prefixprint.codes(a))
    shared = next((i for i in range(min(len(a), len(edited))) if a[i] != edited[i]), min(len(a), len(edited)))
    for changed in (prefixprint.Prefixes(prefixprint.codes(edited)), prefixprint.Prefixes(prefixprint.codes(edited), own, shared)):
        assert own.likeness(changed) == plain_likeness(a, edited) == changed.likeness(own)


@given(st.text(alphabet="ab", max_size=60), st.text(alphabet="ab", max_size=60))
@settings(max_examples=200, deadline=None)
def test_spans_and_extensions(a, b):
    pa_, pb = (prefixprint.Prefixes(prefixprint.codes(x)) for x in (a, b))
    assert pa_.likeness(pb) == plain_likeness(a, b)
    assert (str(pa_) == str(pb)) == (a == b)
    for i in range(0, len(a), 7):
        for k in range(0, len(b), 5):
            size = min(4, len(a) - i, len(b) - k)
            assert pa_.same(i, pb, k, size) == (a[i : i + size] == b[k : k + size])


# --- packing


def check_plan(counts, plan, capacity=1024):
    used = Counter()
    for lengths, many in plan:
        assert sum(lengths) <= capacity and many > 0
        for s in lengths:
            used[s] += many
    assert used == Counter({s: n for s, n in counts.items() if n})
    return sum(n for _, n in plan)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6))
@settings(max_examples=100, deadline=None)
def test_plans_hold_all_and_beat_best_fit(counts):
    n = check_plan(counts, packing.complete(counts, 40), 40)
    assert -(-sum(s * c for s, c in counts.items()) // 40) <= n <= check_plan(counts, packing.best_fit(counts, 40), 40)


def least_bins(sizes, capacity):
    """The least number of bins, by trying all."""
    sizes = sorted(sizes, reverse=True)

    def fits(bins, i):
        if i == len(sizes):
            return True
        for b in {tuple(bins)[j]: j for j in range(len(bins))}.values():
            if bins[b] + sizes[i] <= capacity:
                bins[b] += sizes[i]
                if fits(bins, i + 1):
                    return True
                bins[b] -= sizes[i]
        return False

    n = -(-sum(sizes) // capacity)
    while not fits([0] * n, 0):
        n += 1
    return n


def test_branch_and_bound_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(3, 17) for _ in range(rng.randint(4, 11))]
        counts = dict(Counter(sizes))
        n = check_plan(counts, packing.complete(counts, 20), 20)
        assert n == least_bins(sizes, 20)
    assert check_plan({4: 2, 3: 4}, packing.best_fit({4: 2, 3: 4}, 10), 10) == 3
    assert check_plan({4: 2, 3: 4}, packing.complete({4: 2, 3: 4}, 10), 10) == 2


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=100, deadline=None)
def test_lower_bound_is_one(sizes):
    assert packing.least_sequences(dict(Counter(sizes)), 20) <= least_bins(sizes, 20)


def test_large_capacity_without_recursion():
    first = next(packing.fillings(4095, {s: 1 for s in range(1, 4096)}, 0))
    assert sum(first) == 4095
    counts = {s: 1 for s in range(1, 4097, 3)}
    assert check_plan(counts, packing.complete(counts, 4096, 50), 4096) >= packing.least_sequences(counts, 4096)


def test_fillings_are_undominated():
    made = list(packing.fillings(10, {7: 1, 5: 2, 3: 2, 2: 1}, 8))
    assert made[0] == (7, 3) and set(made) >= {(5, 5), (5, 3, 2)} and all(sum(f) == 10 for f in made)


@given(st.text(max_size=40) | st.lists(st.sampled_from(["a", " ", "  ", "\n", "'s", "'", ".", "#", "1", "é", "\xa0", "word", " the", "<|endoftext|>", "²", "漢"]), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_ids_are_those_of_the_tokenizers_library(text):
    cache = test_ids_are_those_of_the_tokenizers_library.__dict__
    if "library" not in cache:
        cache["library"] = Tokenizer.from_file(JSON)
    text = text.encode("utf-8", "ignore").decode()
    want = cache["library"].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.ids_by(JSON).of(text), "<u4").tolist() == want


def test_ids_of_very_long_white_space():
    tokenizer = Tokenizer.from_file(JSON)
    text = "a" + " " * 1_500_000 + "b\n"
    assert np.frombuffer(packing.ids_by(JSON).of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pack(spark):
    tokenizer = Tokenizer.from_file(JSON)
    marked = [(8, "<|endoftext|>"), (9, "hello <|endoftext|> world <|endoftext|><|endof<|endoftext|>text|>")]
    got = packing.pack(docs(spark, [*ODD, *marked]), JSON).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in pieces.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter()
    for k, t in [*ODD, *marked]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(k, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert packing.pack(docs(spark, []), JSON).count() == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def known():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_runs(known):
    own = bpe.codec(RANKS)
    for s in ("a" * 5000, "ab" * 3000, "Aa1!" * 1500, " " * 3000 + "x", "\n" * 2000, "漢" * 900, LONG):
        assert own.encode(s).tolist() == known.encode_ordinary(s)
        assert own.decode(own.encode(s).tolist()) == s.encode()


PARTS = st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "'", "s", "'s", "'ll", ".", ",", "#", "1", "é", "\t", "\xa0", "ß", "word", " the", "-", '"', "|", "ſ", "漢", "x", "!?", "\u2003", "²"]), max_size=14).map("".join)


@given(PARTS)
@settings(max_examples=600, deadline=None)
def test_bpe_equals_the_library(text):
    with open(RANKS, "rb") as f:
        ranks = test_bpe_equals_the_library.__dict__.setdefault("ranks", {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    library = test_bpe_equals_the_library.__dict__.setdefault("library", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    own = bpe.codec(RANKS)
    assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_memory_is_bounded_and_harmless(known):
    own = bpe.Codec(bpe.rank_file(RANKS))
    own.memo = chunks.Memo(own.encode_chunks, 10)
    text = " ".join(f"w{i}" for i in range(200))
    assert own.encode(text).tolist() == own.encode(text).tolist() == known.encode_ordinary(text)
    assert len(own.memo.young) <= 10


def test_round_trip(spark, known):
    got = bpe.round_trip(docs(spark, ODD), RANKS).collect()
    want = Counter()
    for k, t in ODD:
        ids = known.encode_ordinary(t or "")
        want[(k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert bpe.round_trip(docs(spark, []), RANKS).count() == 0


# --- quality rules


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    where = defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    covered = {i + j for starts in where.values() if len(starts) > 1 for i in starts for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@given(st.lists(st.sampled_from(["a", "b", "# c", "d|e", "\n", "é", " "]), max_size=60).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_measures(text):
    assert rules.measure(text.encode())[:5] == plain_measures(text)


def test_hash_collisions_of_windows_are_resolved():
    ids = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    assert rules._repeated_plainly(ids, 3) == 6


def test_rules(spark):
    rng = random.Random(0)
    fine = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(i) for i in range(60)) + "."
    bad = "AB### " * 60
    rows = [*ODD, *((100 + i, fine + f" end{i}.") for i in range(30)), *((200 + i, bad + str(i)) for i in range(8))]
    got = {(r["doc_id"], r["n_chars_"] if "n_chars_" in r else r["word_chars"]): r for r in rules.judge(docs(spark, rows)).collect()}
    assert rules.judge(docs(spark, rows)).count() == len(rows)
    for r in got.values():
        if 100 <= (r["doc_id"] or 0) < 200:
            assert r["kept"] and not r["base_failed"]
        if (r["doc_id"] or 0) >= 200:
            assert not r["kept"]
        if r["n_words"] < 20:
            assert r["base_failed"] and not r["kept"]
    assert rules.judge(docs(spark, [])).count() == 0


def test_estimate_ignores_abstentions():
    patterns = np.array([[1, 1, 1], [1, 0, 1], [0, 0, 0], [-1, 1, 1], [-1, -1, 0]])
    quality, chance = rules.estimate(patterns, np.array([900, 50, 5, 20, 25]))
    assert quality[0] > 0.9 and quality[1] > 0.9 and quality[4] < 0.5
    assert (chance[0] > chance[1])[0]
