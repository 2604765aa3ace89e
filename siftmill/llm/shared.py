"""What the corpus operators share: tables, durable intermediate results, Arrow helpers."""

from __future__ import annotations

import atexit
import itertools
import re
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from siftmill.session import ship, table

__all__ = ["Shelf", "checkpoint_dir", "columns", "quoted", "ship", "small", "table", "unused", "utf8_list"]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is set and one process does all (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.gettempdir() + "/siftmill-checkpoints"


class Shelf:
    """Intermediate tables written to the shared folder, so that a lost executor costs no lineage.

    ``put`` writes a DataFrame as Parquet and returns the reread table; ``drop`` removes a table
    that nothing reads any more, ``clear`` all of a shelf. An operator's result may still read its
    shelf, so the shelf stays until the caller clears it (``Shelf.since``) or the program ends.
    """

    opened: list["Shelf"] = []
    _serials = itertools.count()

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n, self.serial, self.thread = 0, next(Shelf._serials), threading.get_ident()
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()  # outlive a session that is stopped
        Shelf.opened.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n:03d}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.shelf_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._remove(df.shelf_path)

    def _remove(self, folder: str) -> None:
        path = self._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self._conf).delete(path, True)

    def clear(self) -> None:
        """Removes every table of the shelf."""
        if self in Shelf.opened:
            Shelf.opened.remove(self)
            self._remove(self.base)

    @staticmethod
    def mark() -> int:
        """A point in time for ``since``."""
        return next(Shelf._serials)

    @staticmethod
    def since(mark: int) -> list["Shelf"]:
        """The shelves that this thread has opened after ``mark`` and that are still there."""
        return [s for s in Shelf.opened if s.serial > mark and s.thread == threading.get_ident()]


@atexit.register
def _clear_all() -> None:
    for shelf in list(Shelf.opened):
        try:
            shelf.clear()
        except (Py4JError, ConnectionError):  # the JVM has gone first
            return


def unused(names: Iterable[str], wanted: str) -> str:
    """``wanted``, or that with underscores after it, so that no column of a table has the name (Spark's names know no case)."""
    taken = {n.lower() for n in names}
    while any(n.startswith(wanted.lower()) for n in taken):
        wanted += "_"
    return wanted


def quoted(name: str) -> str:
    """A column's name as Spark's expressions take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what Python makes of texts is held for few of them; unused memory goes back."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def utf8_list(column: pa.Array) -> list:
    """The UTF-8 bytes of a string column (None for null), without decoding."""
    return column.cast(pa.binary()).to_pylist()


def columns(batch: pa.RecordBatch, *names: str) -> list:
    """The named columns of a batch, by position of first occurrence."""
    return [batch.column(batch.schema.names.index(n)) for n in names]
