"""Whitening of embeddings by the singular values of their centred rows.

An entry c counts as x = floor(64 * c) + 1000000. The sums of x in each dimension are exact, so every
row is centred exactly (n * x - S, divided by n only then) before anything is multiplied. MLlib's
``computeSVD`` on these rows, which stay distributed, gives the components (right singular vectors)
and singular values s; with the divisor n an eigenvalue of the covariance is s * s / n. The total
variance is computed apart from that, from the rows' exact deviations. The whitened rows' covariance
is measured again on all rows.

What reaches the driver is bounded by the dimension d: d sums, d singular values, d x k components.

Defined cases: rows whose vector is null or holds a null or non-finite entry are left out; a vector
that is shorter than the longest counts as 0 where it has no entry; x is held to +-2^62 where 64 * c is
beyond; a deviation that no long holds is null (``exact`` has it); components are those whose
eigenvalue is above ``LEAST`` of the greatest, so that a table of equal rows, or of one, has none and
gives an empty result like an empty table; fewer dimensions than components give as many; repeated
rows each keep their row; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import Shelf, columns, small

COMPONENTS = 32
#: What makes an entry an integer.
SCALE, SHIFT = 64, 1_000_000
#: The least share of the greatest eigenvalue that a component may have: below it double precision knows no direction.
LEAST = 1e-11
MOST = 1 << 62
WHOLE = pa.decimal128(38, 0)


def fit_list(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (long entries) of the rows that remain."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))  # Spark's NaN is above infinity
    held = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(MOST // 2))), F.lit(-float(MOST // 2)))) + SHIFT)
    return embeddings.filter(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), held.cast("array<long>").alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column; those that are shorter hold SHIFT (an entry of 0) behind their end."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.full((len(column), width), SHIFT, np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _sums(width: int):
    """The sums of each dimension over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in small(batches, 4096):
            x = _matrix(columns(batch, "x")[0], width)
            low, high = x & 0xFFFFFFFF, x >> 32  # no sum of halves overflows
            total = [t + int(a) + (int(b) << 32) for t, a, b in zip(total, low.sum(axis=0), high.sum(axis=0))]
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([Decimal(t) for t in total], WHOLE)], names=["dimension", "total"])

    return run


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """The rows x - S/n, and the exact sum of squares of n * x - S of each."""
    if n * (int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) // n + 1) < 1 << 61:
        apart = n * x - np.array(sums, np.int64)
        if len(apart) and x.shape[1] * int(np.abs(apart).max(initial=0)) ** 2 < 1 << 62:
            return apart / n, (apart * apart).sum(axis=1).tolist()
        whole = apart.astype(object)
    else:
        whole = x.astype(object) * n - np.array(sums, object)
    return (whole / n).astype(np.float64), [int(v) for v in (whole * whole).sum(axis=1)] if x.shape[1] else [0] * len(x)


@dataclass
class Fit:
    """n, S, the components as columns and their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray


def _centred(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            rows, deviations = centred(_matrix(columns(batch, "x")[0], len(sums)), n, sums)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(sums), pa.int32()), pa.array(rows.ravel()))
            yield pa.record_batch([flat, pa.array([str(d) for d in deviations])], names=["row", "exact"])

    return run


def _whitened(fit: Fit):
    """A vector's whitened entries with its exact deviation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        onto = fit.components / np.sqrt(fit.eigenvalues)
        k = onto.shape[1]
        for batch in small(batches, 4096):
            ids, x = columns(batch, "vec_id", "x")
            rows, deviations = centred(_matrix(x, len(fit.sums)), fit.n, fit.sums)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array((rows @ onto).ravel()))
            long = pa.array([d if d < 1 << 63 else None for d in deviations], pa.int64())
            yield pa.record_batch([ids, long, pa.array([str(d) for d in deviations]), made], names=["vec_id", "deviation", "exact", "whitened"])

    return run


def _products(k: int):
    """The sums of products of whitened entries, and of the entries, over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in small(batches, 4096):
            w = columns(batch, "whitened")[0].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.record_batch([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "total"])

    return run


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Fit:
    """The components of ``rows`` (vec_id, x)."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    sums = [0] * width
    if not n or not width:
        return Fit(n, sums, np.empty((width, 0)), np.empty(0))
    for r in rows.mapInArrow(_sums(width), "dimension int, total decimal(38,0)").groupBy("dimension").agg(F.sum("total").alias("total")).collect():
        sums[r["dimension"]] = int(r["total"])
    vectors = rows.mapInArrow(_centred(n, sums), "row array<double>, exact string").select(array_to_vector("row").alias("row"))
    # so many values that MLlib works them out from all products at once, to double precision, and not by iteration
    wanted = min(width, max(components, width // 2 + 1))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "row")).computeSVD(wanted, computeU=False, rCond=1e-9)
    eigenvalues = svd.s.toArray() ** 2 / n
    keep = np.flatnonzero(eigenvalues > LEAST * eigenvalues[0])[:components]
    return Fit(n, sums, svd.V.toArray()[:, keep], eigenvalues[keep])


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, exact of every remaining row and component."""
    shelf = Shelf(embeddings.sparkSession, "whitening")
    rows = shelf.put(fit_list(embeddings))
    fit = fitted(rows, components)
    k = len(fit.eigenvalues)
    made = shelf.put(rows.mapInArrow(_whitened(fit), "vec_id long, deviation long, exact string, whitened array<double>")) if k else None
    if made is None:
        return rows.limit(0).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"), ("exact", "string"))))
    totals = np.zeros((k + 1) * k)
    for r in made.mapInArrow(_products(k), "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        totals[r["cell"]] = r["total"]
    products, means = totals.reshape(k + 1, k)[:k] / fit.n, totals[k * k :] / fit.n
    error = float(np.abs(products - np.outer(means, means) - np.eye(k)).max())
    trace = total_deviation(made) / fit.n**3
    out = made.select("vec_id", "deviation", "exact", F.posexplode("whitened").alias("component", "whitened"))
    explained = F.array(*(F.lit(float(e / trace)) for e in fit.eigenvalues))
    return out.select("vec_id", (F.col("component") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("component")].alias("explained"), F.lit(error).alias("identity_error"), "exact")


def total_deviation(made: DataFrame) -> int:
    """The exact sum of all deviations: that of their thousands' digits, since a decimal has but 38."""
    parts = made.select(F.expr("transform(sequence(0, CAST((length(exact) - 1) DIV 9 AS int)), i -> struct(i AS place, CAST(right(substring(exact, 1, length(exact) - 9 * i), 9) AS long) AS digits))").alias("parts"))
    sums = parts.select(F.explode("parts").alias("p")).groupBy("p.place").agg(F.sum(F.col("p.digits").cast("decimal(38,0)")).alias("total")).collect()
    return sum(int(r["total"]) * 10 ** (9 * r["place"]) for r in sums)
