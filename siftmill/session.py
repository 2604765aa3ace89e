"""Session construction and small helpers that every layer shares."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the submitter's own settings hold."""
    return (
        SparkSession.builder.master(master)
        .appName("siftmill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_siftmill_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # not where the package itself was loaded from a zip file
        to = Path(tempfile.mkdtemp()) / "siftmill_package.zip"
        with zipfile.ZipFile(to, "w") as out:
            for p in sorted(package.rglob("*.py")):
                out.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(to))
    sc._siftmill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of an input folder, through Spark's reader only (the folder may be in any store)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
