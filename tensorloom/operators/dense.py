"""Dense matrices by rows. R x R results are small by declaration and live on the driver as numpy arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.ieee import divide
from tensorloom.types import DenseMatrix, ShapeMismatchError, maybe_broadcast


def from_rows(spark: SparkSession, rows: Sequence[Sequence[float]]) -> DenseMatrix:
    width = len(rows[0]) if len(rows) else 0
    return DenseMatrix(spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "i long, row array<double>"), len(rows), width)


def _made(spark: SparkSession, nrows: int, ncols: int, cell) -> DenseMatrix:
    row = F.array(*[cell(F.col("id"), r).cast("double") for r in range(ncols)])
    return DenseMatrix(spark.range(nrows).select(F.col("id").alias("i"), row.alias("row")), nrows, ncols)


def constant(spark: SparkSession, nrows: int, ncols: int, value: float) -> DenseMatrix:
    return _made(spark, nrows, ncols, lambda i, r: F.lit(float(value)))


def identity(spark: SparkSession, n: int) -> DenseMatrix:
    return _made(spark, n, n, lambda i, r: F.when(i == r, 1.0).otherwise(0.0))


def ramp(spark: SparkSession, nrows: int, ncols: int) -> DenseMatrix:
    """Row i, column r holds i + r + 1."""
    return _made(spark, nrows, ncols, lambda i, r: i + (r + 1))


def random(spark: SparkSession, nrows: int, ncols: int, seed: int = 0) -> DenseMatrix:
    """Values in [0, 1) that depend on seed and place only."""
    return _made(spark, nrows, ncols, lambda i, r: F.pmod(F.xxhash64(F.lit(seed), i, F.lit(r)), F.lit(1 << 52)) / float(1 << 52))


def long_form(a: DenseMatrix) -> DataFrame:
    """i, r and val of each cell."""
    return a.df.select("i", F.posexplode("row").alias("r", "val")).select("i", F.col("r").cast("long").alias("r"), "val")


def append_row(a: DenseMatrix, row: Sequence[float]) -> DenseMatrix:
    if len(row) != a.ncols:
        raise ShapeMismatchError(f"{len(row)} values for {a.ncols} columns")
    one = a.spark.createDataFrame([(a.nrows, list(map(float, row)))], "i long, row array<double>")
    return DenseMatrix(a.df.unionByName(one), a.nrows + 1, a.ncols)


def resize(a: DenseMatrix, nrows: int, ncols: int) -> DenseMatrix:
    """Cut, or filled up with zeros."""
    row = F.concat(F.slice("row", 1, min(ncols, a.ncols)), F.array_repeat(F.lit(0.0), max(0, ncols - a.ncols)))
    own = a.df.filter(F.col("i") < nrows).select("i", row.alias("row"))
    if nrows > a.nrows:
        own = own.unionByName(a.spark.range(a.nrows, nrows).select(F.col("id").alias("i"), F.array_repeat(F.lit(0.0), ncols).alias("row")))
    return DenseMatrix(own, nrows, ncols)


def _map(a: DenseMatrix, cell) -> DenseMatrix:
    row = F.array(*[cell(F.get("row", F.lit(r)), r) for r in range(a.ncols)])
    return DenseMatrix(a.df.select("i", row.alias("row")), a.nrows, a.ncols)


def _sums(a: DenseMatrix, terms: list[Column]) -> list[float]:
    found = a.df.agg(*[F.sum(t).alias(f"s{k}") for k, t in enumerate(terms)]).first()
    return [float(v or 0.0) for v in found]


def gram(a: DenseMatrix) -> np.ndarray:
    """A'A in one aggregation: R (R + 1) / 2 sums."""
    cell = lambda r: F.get("row", F.lit(r))
    pairs = [(p, q) for p in range(a.ncols) for q in range(p, a.ncols)]
    out = np.zeros((a.ncols, a.ncols))
    for (p, q), v in zip(pairs, _sums(a, [cell(p) * cell(q) for p, q in pairs]), strict=True):
        out[p, q] = out[q, p] = v
    return out


def normalize_2norm(a: DenseMatrix) -> tuple[DenseMatrix, list[float]]:
    """Columns of length 1, and their lengths; a zero column becomes NaN."""
    norms = [v**0.5 for v in _sums(a, [F.get("row", F.lit(r)) * F.get("row", F.lit(r)) for r in range(a.ncols)])]
    return _map(a, lambda v, r: divide(v, F.lit(norms[r]))), norms


def normalize_maxnorm(a: DenseMatrix) -> tuple[DenseMatrix, list[float]]:
    """Columns over the greater of 1 and their largest (signed) value, and these divisors."""
    tops = a.df.agg(*[F.greatest(F.lit(1.0), F.max(F.get("row", F.lit(r)))).alias(f"m{r}") for r in range(a.ncols)]).first()
    tops = [float(v) if v is not None else 1.0 for v in tops]
    return _map(a, lambda v, r: v / F.lit(tops[r])), tops


def hadamard(a: DenseMatrix, b: DenseMatrix) -> DenseMatrix:
    """Element-wise product."""
    if (a.nrows, a.ncols) != (b.nrows, b.ncols):
        raise ShapeMismatchError(f"{a.nrows} x {a.ncols} and {b.nrows} x {b.ncols}")
    right = maybe_broadcast(b.df.select("i", F.col("row").alias("other")), b.nrows, b.row_bytes)
    row = F.array(*[F.get("row", F.lit(r)) * F.get("other", F.lit(r)) for r in range(a.ncols)])
    return DenseMatrix(a.df.join(right, "i").select("i", row.alias("row")), a.nrows, a.ncols)


def hadamard_except(grams: Sequence[np.ndarray], mode: int) -> np.ndarray:
    """Product of all but one of the R x R matrices."""
    out = np.ones_like(grams[0])
    for m, g in enumerate(grams):
        if m != mode:
            out = out * g
    return out


def times_small(a: DenseMatrix, v: np.ndarray) -> DenseMatrix:
    """A V with a small V, as an expression of each row."""
    if v.shape[0] != a.ncols:
        raise ShapeMismatchError(f"{a.ncols} columns, {v.shape[0]} rows")
    cell = lambda q: sum((F.get("row", F.lit(p)) * F.lit(float(v[p, q])) for p in range(a.ncols)), F.lit(0.0))
    return DenseMatrix(a.df.select("i", F.array(*map(cell, range(v.shape[1]))).alias("row")), a.nrows, v.shape[1])


def inverse_normals(v: np.ndarray) -> np.ndarray:
    """Inverse by Cholesky, else by LU, else the pseudo-inverse of a singular matrix."""
    if not np.isfinite(v).all():
        return np.linalg.pinv(np.nan_to_num(v))
    if np.linalg.cond(v) < 1e13:
        try:
            low = np.linalg.inv(np.linalg.cholesky(v))
            return low.T @ low
        except np.linalg.LinAlgError:
            return np.linalg.inv(v)
    return np.linalg.pinv(v, rcond=1e-12)


def solve_normals(m: DenseMatrix, grams: Sequence[np.ndarray], mode: int) -> DenseMatrix:
    """The A of A V = M, V being the Hadamard product of the other modes' Gram matrices."""
    return times_small(m, inverse_normals(hadamard_except(grams, mode)))


def inverse_shuffle(a: DenseMatrix, own: DataFrame) -> DenseMatrix:
    """Rows by a map: row i of the result is row map[i] of a."""
    right = maybe_broadcast(own.select(F.col("old").alias("_i"), F.col("new").alias("i")), a.nrows, 40)
    return DenseMatrix(a.df.join(right, "i").select(F.col("_i").alias("i"), "row"), a.nrows, a.ncols)


def from_array_column(df: DataFrame, key: str, values: str, nrows: int, ncols: int) -> DenseMatrix:
    """A table with an index and an array column as a matrix."""
    return DenseMatrix(df.select(F.col(key).cast("long").alias("i"), F.col(values).cast("array<double>").alias("row")), nrows, ncols)
