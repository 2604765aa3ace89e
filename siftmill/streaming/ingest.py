"""Streaming ingest of tests: an extension of the engine, which by itself works on tables.

New lines of tests, as they land in a folder, become reconstructed window counts of papers, kept up
to date in a table of one row for each micro-batch and paper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftmill.functions import jsons
from siftmill.functions.tokens import strip
from siftmill.operators.tests import window_aggregates, with_calipers
from siftmill.sources.readers import TESTS


def test_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of tests from JSON lines that land in a folder; malformed lines are passed over."""
    lines = spark.readStream.text(folder).filter(F.length(strip(F.col("value"))) > 0).filter(jsons.is_object(F.col("value")))
    return lines.select(*(jsons.field(F.col("value"), name, kind).alias(name) for name, kind in TESTS.items()))


def running_counts(tests: DataFrame) -> DataFrame:
    """Window counts of each paper over all that came so far (output mode complete or update)."""
    return tests.groupBy("paper_id").agg(F.count("*").alias("tests"), *window_aggregates(F.col("abs_t"), F.col("p_approx_2s")))


def keep_counts(tests: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's counts with its number: a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        running_counts(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return tests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, table: str) -> DataFrame:
    """The counts of all micro-batches together, with their calipers."""
    parts = spark.read.parquet(table)
    sums = [F.sum(c).alias(c) for c, kind in parts.dtypes if kind == "bigint"]
    return with_calipers(parts.groupBy("paper_id").agg(*sums))
