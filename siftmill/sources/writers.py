"""Writers of results, and the feature cache."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftmill import fixed

CACHE_KEY = ("paper_id", "sha12", "cache_key", "extractor_version")
#: Folders of the cache; a paper's rows are in one of them.
BUCKETS = 256


def holder(folder: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a table under a name in ``folder`` and rereads it, so that what follows does not work it out again."""

    def hold(frame: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return frame.sparkSession.read.schema(frame.schema).parquet(path)

    return hold


def by_paper(frame: DataFrame, path: str, **counts: Column) -> dict[str, int]:
    """A table as Parquet whose files are of even size and sorted by paper, so that one paper's rows are found by the files' statistics.

    Gives the number of its rows and the ``counts`` (aggregates), which are observed while it is written.
    """
    seen = Observation()
    watched = frame.observe(seen, F.count("*").alias("rows"), *(c.alias(n) for n, c in counts.items()))
    watched.hint("rebalance", F.col("paper_id")).sortWithinPartitions("paper_id").write.mode("overwrite").parquet(path)
    return seen.get


def watched(hold: Callable[[DataFrame, str], DataFrame], frame: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """A held table with its number of rows and the ``counts``, observed while it is written."""
    seen = Observation()
    held = hold(frame.observe(seen, F.count("*").alias("rows"), *(c.alias(n) for n, c in counts.items())), name)
    return held, seen.get


def tests_json(tests: DataFrame, path: str) -> None:
    """Tests as JSON lines, a folder for each paper: an export for few papers."""
    tests.repartition("paper_id").write.mode("overwrite").partitionBy("paper_id").json(path)


def meta_json(meta: DataFrame, path: str) -> None:
    meta.write.mode("overwrite").json(path)


def flat(features: DataFrame) -> DataFrame:
    """Features with nested columns as JSON text, ready for CSV."""
    nested = ("struct", "array", "map")
    return features.select(*(F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c) for c, kind in features.dtypes))


def under_one_header(parts: list[DataFrame]) -> DataFrame:
    """Tables one after another, with every column of any of them."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(flat, parts))


def features_csv(parts: list[DataFrame], path: str) -> None:
    """Feature tables under one header that has every column of any of them."""
    under_one_header(parts).write.mode("overwrite").csv(path, header=True, escape='"')


def objects(frame: DataFrame, path: str) -> None:
    """One JSON object for each row, as text (reports, run records, intermediate results)."""
    frame.select(F.to_json(F.struct(*frame.columns)).alias("value")).write.mode("overwrite").text(path)


def reports(frame: DataFrame, path: str) -> None:
    """Markdown reports (paper_id, report), a folder for each paper: an export for few papers."""
    frame.select("paper_id", F.col("report").alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy("paper_id").text(path)


def run_record(spark: SparkSession, path: str, **facts: object) -> None:
    """What a run was asked to do and what it made, as one JSON object."""
    spark.createDataFrame([(json.dumps(facts, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def keyed(papers: DataFrame) -> DataFrame:
    """papers (paper_id, sha256, cache_key) with the columns of CACHE_KEY."""
    return papers.withColumn("sha12", F.substring("sha256", 1, 12)).withColumn("extractor_version", F.lit(fixed.VERSION))


def bucket(paper_id: Column) -> Column:
    return F.pmod(F.xxhash64(paper_id.cast("string")), F.lit(BUCKETS)).cast("int")


def buckets_of(rows: DataFrame) -> list[int]:
    """The buckets that rows (paper_id) are in: BUCKETS at most."""
    return sorted(r["bucket"] for r in rows.select(bucket(F.col("paper_id")).alias("bucket")).distinct().collect())


def cache(rows: DataFrame, path: str, hold: Callable[[DataFrame, str], DataFrame], name: str) -> None:
    """Puts rows (with CACHE_KEY columns) into the cache, in place of those of the same key: only the buckets that they are in are read and written.

    A bucket is written anew as a whole, so it never piles up files of earlier runs.
    """
    rows = hold(rows, f"cache_{name}")
    touched = buckets_of(rows)
    if not touched:
        return
    old = read_cache(rows.sparkSession, path, touched)
    if old is not None:
        rows = old.join(rows.select(*CACHE_KEY).distinct(), list(CACHE_KEY), "left_anti").unionByName(rows, allowMissingColumns=True)
    merged = hold(rows.withColumn("bucket", bucket(F.col("paper_id"))), f"cache_{name}_merged")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def not_cached(papers: DataFrame, cached: DataFrame) -> DataFrame:
    """Papers (paper_id, sha256, cache_key) that the cache has no row of, for the same file, settings and version."""
    return keyed(papers).join(cached.select(*CACHE_KEY).distinct(), list(CACHE_KEY), "left_anti").drop("sha12", "extractor_version")


def read_cache(spark: SparkSession, path: str, touched: list[int] | None = None) -> DataFrame | None:
    """The rows of the cache in some buckets (all if None), whichever columns the runs had that wrote them; None if there are none."""
    folders = [f"{path}/bucket={b}" for b in (range(BUCKETS) if touched is None else touched)]
    folders = [f for f in folders if has_cache(spark, f)]
    return spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None


def has_cache(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
