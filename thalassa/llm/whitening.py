"""Whitening of embeddings by the singular vectors of the centred distributed rows.

Each entry c becomes the integer x = floor(64 c) + 1000000. Every distinct x vector is fitted once. The rows x - S/n,
centred from exact integers (n x - S), go to MLlib's RowMatrix as they lie on the executors; its singular values s are
rescaled by the divisor n (e = s * s / n is an eigenvalue of the covariance), its right singular vectors are the
components. All singular values are asked for, not the first ones only, so that MLlib solves its Gram matrix directly
and not by iterations to a tolerance. The total variance does not come from these singular values: it is the sum over
the fitted rows of the exact integers sum((n x - S)^2), divided by n^3.

What reaches the driver or all tasks is S, the components and Gram matrices: as many numbers as the square of the
dimensions, whatever the number of rows.

Cases: vectors that are null or hold null or non-finite entries take no part; shorter vectors count as padded with zeros,
an empty one too. Repeated rows and ids are rows of their own in the result and one in the fit; a null id is kept.
Directions of no variance (e below 1e-14 of the greatest) are no components: with fewer than 16 others there are fewer
rows for each vector, and none where all vectors are equal or the table is empty. Entries beyond 2^40 are refused, and so
are sums beyond 64 bits in the query's deviation. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
RCOND = 1e-7
_FITS = 2**62


def _rows(column) -> np.ndarray:
    """The rows of a list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), flat.dtype)


def quantised(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x array<long>: the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fit = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", e.alias("e")).where(F.col("e").isNotNull() & fit)
    size = rows.agg(F.max(F.size("e")), F.min(F.size("e")), F.max(F.array_max(F.transform("e", F.abs)))).first()
    if (size[2] or 0) * scale > 2**40:
        raise ValueError(f"entries above {2**40 // scale} can't be quantised")
    if size[0] != size[1]:
        rows = rows.withColumn("e", F.concat("e", F.array_repeat(F.lit(0.0), F.lit(size[0]) - F.size("e"))))
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c * scale) + F.lit(shift)).alias("x"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # entries have 41 bits, so a batch of 10,000 rows sums within 64
    for b in batches:
        x = _rows(b.column("x"))
        if len(x):
            yield pa.record_batch({"at": np.arange(x.shape[1], dtype=np.int32), "s": x.sum(0)})


def _sent(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < _FITS:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _squares(y: np.ndarray) -> list[int]:
    """Exact sum(y^2) of each row."""
    top = int(np.abs(y).max(initial=0))
    if y.dtype == object or y.shape[1] >= 2**30:
        return [int(v) for v in (y.astype(object) ** 2).sum(1)]
    if top * top * y.shape[1] < _FITS:
        return (y * y).sum(1).tolist()
    # halves of 31 bits whose sums of squares fit each: the limbs are put together as Python integers
    hi, lo = y >> 31, y & (2**31 - 1)
    limbs = [(p.astype(object) if int(np.abs(p).max(initial=0)) ** 2 * y.shape[1] >= _FITS else p) for p in (hi, lo)]
    a, b, c = (limbs[0] * limbs[0]).sum(1), (hi.astype(object) * lo).sum(1), (limbs[1] * limbs[1]).sum(1)
    return [(int(p) << 62) + (int(q) << 32) + int(r) for p, q, r in zip(a, b, c, strict=True)]


def _centred(n: int, sums: np.ndarray):
    def run(batches):
        for b in batches:
            y = _sent(_rows(b.column("x")), n, sums)
            if len(y):
                centred = (y / n).astype(np.float64)
                cut = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
                yield pa.record_batch({"c": pa.ListArray.from_arrays(cut, centred.reshape(-1)), "d": pa.array([Decimal(v) for v in _squares(y)], pa.decimal128(38, 0))})

    return run


def _matrix(df: DataFrame, column: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(F.col(column)).alias("v")), "v"))


class Whitening:
    """The fitted transformation: n, sums (S), variances e, components (columns), total (trace of the covariance)."""

    def __init__(self, rows: DataFrame, k: int = COMPONENTS):
        """rows: x array<long>, as quantised() gives them."""
        fitted = scratch.materialize(rows.select("x").distinct())
        self.n = fitted.count()
        sums = fitted.mapInArrow(_sums, "at int, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect()
        self.sums = np.array([int(v) for _, v in sorted(sums)], object)
        self.variances, self.components, self.total, self.identity_error = np.zeros(0), np.zeros((len(sums), 0)), 0.0, None
        if self.n < 2 or not len(sums):
            return
        centred = scratch.materialize(fitted.mapInArrow(_centred(self.n, self.sums), "c array<double>, d decimal(38,0)"))
        deviations = centred.agg(F.sum("d")).first()[0]
        self.total = float(Decimal(deviations) / Decimal(self.n) ** 3)
        svd = _matrix(centred, "c").computeSVD(len(sums), computeU=False, rCond=RCOND)
        s, v = svd.s.toArray()[:k], svd.V.toArray()[:, :k]
        keep = s > 0
        self.variances, self.components = s[keep] ** 2 / self.n, v[:, keep]
        gram = _matrix(self._applied(fitted, []), "w").computeGramianMatrix().toArray() / self.n
        # the rows are centred, so the whitened ones are: their Gram matrix over n is their covariance
        self.identity_error = float(np.abs(gram - np.eye(len(gram))).max())
        scratch.drop(fitted, centred)

    def _applied(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        n, sums, scale = self.n, self.sums, self.components / np.sqrt(self.variances)

        def run(batches):
            for b in batches:
                y = _sent(_rows(b.column("x")), n, sums)
                if len(y):
                    w = (y / n).astype(np.float64) @ scale
                    cut = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
                    yield pa.record_batch({**{c: b.column(c) for c in keep}, "deviation": pa.array([Decimal(v) for v in _squares(y)], pa.decimal128(38, 0)), "w": pa.ListArray.from_arrays(cut, w.reshape(-1))})

        kinds = dict(rows.dtypes)
        return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "deviation decimal(38,0)", "w array<double>"]))

    def transform(self, rows: DataFrame) -> DataFrame:
        """vec_id, deviation decimal(38,0), w array<double>: the whitened rows."""
        return self._applied(rows, ["vec_id"])


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> tuple[Whitening, DataFrame]:
    """The fit and the whitened rows of (vec_id, embedding)."""
    scratch.ship(vectors.sparkSession)
    rows = scratch.materialize(quantised(vectors, scale, shift))
    fit = Whitening(rows, k)
    return fit, fit.transform(rows)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fit, rows = whiten(vectors)
    explained = F.array(*[F.lit(float(e / fit.total)) for e in fit.variances]) if len(fit.variances) else F.array().cast("array<double>")
    rows = rows.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(fit.identity_error).cast("double").alias("identity_error")
    )
