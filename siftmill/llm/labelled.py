"""Labelled documents for fitting a classifier on the driver, and scoring of all documents.

Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2. Of those, at most
``per_class`` documents of each class are taken, by least hash of the id; of a text of more than
``TRAIN_CHARS`` code points ``TRAIN_PARTS`` spans of equal length, evenly spread over the whole of it,
come together in its place: documented bounds of what reaches the driver. Scoring has none.

Defined cases: a null id has no label and is not held out; a label other than 0 and 1 is none; a
document with several labels has the greatest; a document that stands in several rows gives its least
text; a null text teaches nothing and is scored as the model says; repeated rows each keep their row;
columns of any name are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.shared import columns, small, utf8_list

HELD_OUT = 2
SCORE = "siftmill_score"
TRAIN_CHARS = 20_000
TRAIN_PARTS = 10


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label must not be learnt (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def _spans(text: Column) -> Column:
    """The text, or if it is too long its spans."""
    size = TRAIN_CHARS // TRAIN_PARTS
    stride = (F.length(text) - size) / (TRAIN_PARTS - 1)
    parts = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_PARTS - 1)), lambda i: F.substring(text, (i * stride).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) <= TRAIN_CHARS, text).otherwise(F.array_join(parts, " "))


def sample(docs: DataFrame, labels: DataFrame, name: str, per_class: int) -> pd.DataFrame:
    """text and label (0 or 1) of the training documents, in a fixed order.

    A document with several labels has the greatest; a document that stands in several rows gives one.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(name).alias("label"))
    ranked = known.withColumn("h", F.xxhash64("doc_id"))
    parts = [ranked.filter(F.col("label") == k).orderBy("h", "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 x per_class rows
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(chosen, "doc_id")
    texts = found.select("doc_id", "label", _spans(F.col("text")).alias("text")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return texts.toPandas().sort_values("doc_id").reset_index(drop=True)


def with_scores(docs: DataFrame, scorer: Callable, model: "dict[str, np.ndarray] | float", name: str = SCORE) -> DataFrame:
    """``docs`` with every column it has and the column ``name``, which it must lack; ``model`` as ``train`` returns it (a number is everyone's score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if isinstance(model, float) else scorer(model)
        for batch in small(batches):
            if own is None or not batch.num_rows:
                made = np.full(batch.num_rows, model if own is None else 0.0)
            else:
                made = own.scores(utf8_list(columns(batch, "text")[0])).astype(np.float64)
            yield pa.record_batch([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)
