"""The corpus pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread
as the next stage's docs. All but the last return the columns of documents; rows keep theirs.

A row is a document's unit here: rows that share a doc_id are judged each by its own text in the
classifiers; of a near-duplicate group one row stays, that of the least doc_id (of several such rows
one of the least set of shingles by its hash, of those the one with the least text, and of those the
one whose other columns have the least JSON). Null texts are scored as empty ones, are near copies of
each other and packed as the end id alone; null ids are kept like others; columns of any name, and
texts of any length, go through whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import nearcopies, packing, quality, toxicity
from siftmill.llm.labelled import SCORE, with_scores
from siftmill.llm.shared import Shelf, ship, table, unused

#: No stage but the last can be expressed in SQL.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier predicts to be good."""
    ship(spark)
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = unused(docs.columns, SCORE)
    return with_scores(docs, quality.Scorer, model, score).filter(F.col(score) >= quality.CUTOFF).drop(score)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity classifier does not predict to be toxic."""
    ship(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = unused(docs.columns, SCORE)
    return with_scores(docs, toxicity.Scorer, model, score).filter(F.col(score) < toxicity.CUTOFF).drop(score)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, Jaccard >= 0.8, by SimHash and then min-hash): that of the least doc_id."""
    ship(spark)
    return nearcopies.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("near-dedup by word shingles", no_near_duplicates),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is written and reread, and what it was made of removed."""
    docs, shelf, last = table(spark, sf_dir, "documents"), Shelf(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        mark = Shelf.mark()
        docs = shelf.put(stage(spark, docs, sf_dir))
        for own in Shelf.since(mark):
            own.clear()
        if last is not None:
            shelf.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
