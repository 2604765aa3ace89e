"""Ranked lexical search over a clustered index, with exact stopping.

Documents are put in an order by recursive graph bisection (``bisection``, fitted on a sample of at
most about ``SAMPLE`` documents; every document is placed), within a leaf of the tree by length and
id, and cut into shards of at most ``DOCS`` consecutive documents. A shard is one row of the index:
its terms with the documents that hold them and the most that each term adds to a score there. For a
query the sum of weight times that most is a shard's bound. Shards are visited by falling bound, in
rounds that grow; a query is done as soon as no shard that is left can hold a document that would
come among its first, counting an equal score with a lesser doc_id. So results do not depend on how
good the clusters are, only the work does. Each shard's best come back under their doc_id, which
settles ties.

Scores: a term's weight w is floor(1000 * ln((2N + 2) / (2 df + 1))); a document of n terms has
m = 10 + (90 n N) div L; the score sums w * ((1000000000 tf) div (1000 tf + 8 m)) over the query's
different terms. N counts documents with a term, L all their terms.

Everything that grows is a table: the shards, their bounds, the queries and the visits; a shard's
size is bounded by its documents and its postings (one very long document may be a shard), a visit's
by ``QUERIES`` queries. Range partitions of the order split copies and hot leaves, since the id and the
place of a row are part of it.

Defined cases: a null text has no terms, is in no result and counts in no figure; rows with one id
are each ranked, equal ones next to each other; a null id comes before all others among equal
scores; a query is all the rows of one item_id, with the different terms of all of them (null is an
item like others); an item without terms, or whose terms no document has, has no result; texts of any
length count whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm import bisection
from siftmill.llm.shared import Shelf, columns, small, utf8_list
from siftmill.llm.terms import runs

TOP = 10
SAMPLE = 4096
DOCS, POSTINGS = 2048, 1 << 20
#: Queries that one visit of a shard answers; shards that the first round visits, and how many times as many each next.
QUERIES, FIRST, GROWTH = 1024, 2, 8
NO_ID = -(1 << 63)
RESULT = "item_id long, rank int, doc_id long, score long"
SHARD = "shard long, low long, ids array<long>, lengths array<int>, terms array<string>, most array<long>, df array<int>, docs binary, tfs binary"
_NAMES = [c.split()[0] for c in SHARD.split(", ")]


def _counts(text: bytes | None) -> Counter:
    out: Counter = Counter()
    for some in runs(text):
        out.update(some)
    return out


def _sampled(depth: int):
    """The tree, in one row, from the sample's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: dict[bytes, bytes] = {}  # each term is held once
        docs = [[one.setdefault(w, w) for w in _counts(t)] for batch in small(batches) for t in utf8_list(columns(batch, "text")[0])]
        tree = bisection.fit(sorted(filter(None, docs)), depth)
        terms = sorted(tree.terms, key=tree.terms.get)
        yield pa.record_batch(
            [pa.array([tree.depth], pa.int32()), pa.array([b" ".join(terms)]), pa.array([tree.weights.astype(np.float16).tobytes()]), pa.array([tree.thresholds.tobytes()])],
            names=["depth", "terms", "weights", "thresholds"],
        )

    return run


def tree_of(docs: DataFrame, rows: int) -> bisection.Tree:
    """A bisection tree as deep as there are shards, from a sample of about SAMPLE documents, fitted in one task."""
    depth = min(bisection.DEPTH, max(0, (-(-rows // DOCS) - 1).bit_length()))
    sample = docs.select("text").sample(min(1.0, SAMPLE / max(rows, 1)), seed=11).coalesce(1)
    made = sample.mapInArrow(_sampled(depth), "depth int, terms binary, weights binary, thresholds binary").first()
    terms = made["terms"].split()
    weights = np.frombuffer(made["weights"], np.float16).astype(np.float32).reshape(1 << made["depth"], len(terms))
    return bisection.Tree(made["depth"], {t: k for k, t in enumerate(terms)}, weights, np.frombuffer(made["thresholds"]))


def _forward(sent: Broadcast):
    """doc_id, leaf, n and the different terms with their counts of every document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: bisection.Tree = sent.value
        for batch in small(batches):
            ids, texts = columns(batch, "doc_id", "text")
            counts = [_counts(t) for t in utf8_list(texts)]
            some = pa.array([bool(c) for c in counts], pa.bool_())
            counts = [c for c in counts if c]
            leaf = tree.leaves([list(c) for c in counts])
            tfs = [np.fromiter(c.values(), np.uint32, len(c)) for c in counts]
            made = (pa.array(leaf, pa.int32()), pa.array([int(t.sum()) for t in tfs], pa.int64()), pa.array([b" ".join(c) for c in counts], pa.binary()), pa.array([t.tobytes() for t in tfs], pa.binary()))
            yield pa.record_batch([ids.filter(some), *made], names=["doc_id", "leaf", "n", "terms", "tfs"])

    return run


def impact(tf: np.ndarray, n: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 8 m) of documents of n terms."""
    m = 100 - 90 + 90 * n * documents // tokens
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _shards(documents: int, tokens: int):
    """A task's documents, which come in the order, as shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, made = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple[int | None, int, bytes, bytes]] = []
        size = 0
        for batch in small(batches):
            for row in zip(*(c.to_pylist() for c in columns(batch, "doc_id", "n", "terms", "tfs"))):
                many = len(row[3]) // 4
                if rows and (len(rows) >= DOCS or size + many > POSTINGS):
                    yield _shard(here + made, rows, documents, tokens)
                    made, rows, size = made + 1, [], 0
                rows.append(row)
                size += many
        if rows:
            yield _shard(here + made, rows, documents, tokens)

    return run


def _shard(number: int, rows: list[tuple[int | None, int, bytes, bytes]], documents: int, tokens: int) -> pa.RecordBatch:
    ids, lengths, terms, tfs = zip(*rows)
    known: dict[bytes, int] = {}
    numbers = [np.array([known.setdefault(t, len(known)) for t in own.split()], np.int32) for own in terms]
    term, doc = np.concatenate(numbers), np.repeat(np.arange(len(rows), dtype=np.uint16), list(map(len, numbers)))
    names = sorted(known)
    place = np.empty(len(names), np.int32)
    place[[known[t] for t in names]] = np.arange(len(names))
    order = np.argsort(place[term], kind="stable")
    term, doc, tf = place[term][order], doc[order], np.concatenate([np.frombuffer(t, np.uint32) for t in tfs])[order]
    df = np.bincount(term, minlength=len(names))
    adds = impact(tf.astype(np.int64), np.array(lengths, np.int64)[doc], documents, tokens)
    most = np.maximum.reduceat(adds, np.cumsum(df) - df)
    cells = [
        pa.array([number], pa.int64()), pa.array([min(NO_ID if i is None else i for i in ids)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
        pa.array([names], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([most], pa.list_(pa.int64())), pa.array([df], pa.list_(pa.int32())), pa.array([doc.tobytes()], pa.binary()), pa.array([tf.tobytes()], pa.binary()),
    ]
    return pa.record_batch(cells, names=_NAMES)


@dataclass
class Index:
    """The shards (see SHARD), the number of documents with a term and of all their terms."""

    shards: DataFrame
    documents: int
    tokens: int


def index(docs: DataFrame) -> Index:
    """The clustered index of all of ``docs`` (doc_id, text), written to the shared folder."""
    spark = docs.sparkSession
    shelf, docs = Shelf(spark, "ranked"), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.count()
    sent = spark.sparkContext.broadcast(tree_of(docs, rows))
    forward = shelf.put(docs.mapInArrow(_forward(sent), "doc_id long, leaf int, n long, terms binary, tfs binary"))
    documents, tokens = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents // (4 * DOCS)))
    order = ["leaf", "n", F.coalesce("doc_id", F.lit(NO_ID)), F.monotonically_increasing_id()]
    keyed = forward.select("*", *(F.expr(c).alias(f"k{i}") if isinstance(c, str) else c.alias(f"k{i}") for i, c in enumerate(order)))
    dealt = keyed.repartitionByRange(parts, "k0", "k1", "k2", "k3").sortWithinPartitions("k0", "k1", "k2", "k3").select("doc_id", "n", "terms", "tfs")
    shards = shelf.put(dealt.mapInArrow(_shards(documents, max(tokens, 1)), SHARD))
    shelf.drop(forward)
    return Index(shards, documents, tokens)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        ids, texts = columns(batch, "item_id", "text")
        yield pa.record_batch([ids, pa.array([list(_counts(t)) for t in utf8_list(texts)], pa.list_(pa.binary())).cast(pa.list_(pa.string()))], names=["item_id", "terms"])


def _best(documents: int, tokens: int, top: int):
    """The best documents of each shard for each of the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            if not batch.num_rows:
                continue
            ids, lengths, terms, df, docs, tfs, queries = (c[0] for c in columns(batch, "ids", "lengths", "terms", "df", "docs", "tfs", "queries"))
            own = ids.values.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n = lengths.values.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(df.values.to_numpy(zero_copy_only=False))
            docs, tfs = np.frombuffer(docs.as_py(), np.uint16), np.frombuffer(tfs.as_py(), np.uint32)
            asked = queries.values
            items, lists, weights = asked.field("item_id").to_pylist(), asked.field("terms"), asked.field("weights")
            at = pc.index_in(lists.flatten(), value_set=terms.values).fill_null(-1).to_numpy(zero_copy_only=False)
            weight, cuts = weights.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
            adds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            out: list[tuple[int | None, int | None, int]] = []
            for k, item in enumerate(items):
                score = np.zeros(len(own), np.int64)
                for t, w in zip(at[cuts[k] : cuts[k + 1]].tolist(), weight[cuts[k] : cuts[k + 1]].tolist()):
                    if t < 0:
                        continue
                    if t not in adds:
                        span = slice(int(ends[t - 1]) if t else 0, int(ends[t]))
                        adds[t] = docs[span], impact(tfs[span].astype(np.int64), n[docs[span]], documents, tokens)
                    score[adds[t][0]] += w * adds[t][1]
                some = np.flatnonzero(score)
                if len(some) > top:
                    some = some[score[some] >= np.partition(score[some], -top)[-top]]
                some = some[np.lexsort((own[some], -score[some]))][:top]
                out += zip(repeat(item), (None if i == NO_ID else i for i in own[some].tolist()), score[some].tolist())
            cells = zip(*out) if out else [[]] * 3
            yield pa.record_batch([pa.array(x, pa.int64()) for x in cells], names=["item_id", "doc_id", "score"])

    return run


def search(own: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """The columns of RESULT: the ``top`` documents of each of ``items`` (item_id, text)."""
    spark = items.sparkSession
    shelf, n = Shelf(spark, "search"), own.documents
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_terms, "item_id long, terms array<string>")
    asked = shelf.put(asked.select("item_id", F.explode("terms").alias("term")).distinct())
    listed = own.shards.select("shard", "low", F.explode(F.arrays_zip("terms", "df", "most")).alias("t")).select("shard", "low", F.col("t.terms").alias("term"), F.col("t.df").alias("df"), F.col("t.most").alias("most"))
    found = shelf.put(listed.join(asked.select("term").distinct(), "term"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1)))
    weights = found.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.cast("long").alias("w")).filter("w > 0")
    asked = shelf.put(asked.join(weights, "term"))
    sums = asked.join(found, "term").groupBy("item_id", "shard").agg(F.sum(F.col("w") * F.col("most")).alias("bound"), F.min("low").alias("low"))
    by_bound = Window.partitionBy("item_id").orderBy(F.desc("bound"), "low", "shard")
    bounds = shelf.put(sums.withColumn("turn", F.row_number().over(by_bound)))
    queries = shelf.put(asked.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("t")).select("item_id", F.col("t.term").alias("terms"), F.col("t.w").alias("weights")))
    chunks = max(1, -(-queries.count() // QUERIES))
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best, done, upto = None, 0, FIRST
    while True:
        left = bounds.filter(F.col("turn") > done)
        if best is not None:  # what could still come among the first
            last = best.filter(F.col("rank") == top).select(F.col("item_id").alias("of"), F.col("score").alias("least"), F.coalesce("doc_id", F.lit(NO_ID)).alias("last"))
            left = left.join(last, F.col("item_id").eqNullSafe(F.col("of")), "left").filter(F.col("least").isNull() | (F.col("bound") > F.col("least")) | ((F.col("bound") == F.col("least")) & (F.col("low") < F.col("last"))))
        visits = left.filter(F.col("turn") <= upto).select(F.col("item_id").alias("of"), "shard")
        visits = visits.join(queries, F.col("of").eqNullSafe(F.col("item_id"))).groupBy("shard", F.pmod(F.xxhash64("item_id"), F.lit(chunks)).alias("chunk"))
        visits = shelf.put(visits.agg(F.collect_list(F.struct("item_id", "terms", "weights")).alias("queries")))
        if visits.isEmpty():
            if left.isEmpty():
                break
            done, upto = upto, upto * GROWTH
            continue
        rows = own.shards.select("shard", "ids", "lengths", "terms", "df", "docs", "tfs").join(visits.drop("chunk"), "shard").drop("shard")
        more = rows.mapInArrow(_best(n, max(own.tokens, 1), top), "item_id long, doc_id long, score long")
        both = more if best is None else best.drop("rank").unionByName(more)
        best = shelf.put(both.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top))
        done, upto = upto, upto * GROWTH
    if best is None:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Indexes ``docs`` and searches for ``items``."""
    return search(index(docs), items, top)


_WORDS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
t AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, n_docs),
i AS (SELECT p.r, p.term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)) AS adds FROM p JOIN d ON p.r = d.r, s),
x AS (SELECT item_id, i.r, CAST(sum(weight * adds) AS BIGINT) AS score FROM q JOIN t ON q.term = t.term JOIN i ON i.term = q.term GROUP BY item_id, i.r HAVING sum(weight * adds) > 0),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x JOIN d ON x.r = d.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
