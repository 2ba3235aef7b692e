"""Data model: coordinate relations with a declared shape.

A tensor is a DataFrame ``i0 … iN-1 long, val double`` with ``dims``; a matrix
is one with columns ``i, j, val``. Shapes are always declared and carried
along, never inferred from the largest index. Objects are immutable: every
operator returns a new one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1
#: A side of a join is broadcast only if its declared shape bounds it by so many bytes.
BROADCAST_BYTES = 32 << 20


class TensorError(Exception):
    """Base of the library's errors."""


class ShapeMismatchError(TensorError, ValueError):
    """Operands whose shapes do not go together."""


class ValueRangeError(TensorError, ValueError):
    """A value, index or option outside what is allowed."""


class ZeroDivisorError(TensorError, ZeroDivisionError):
    """Division by the scalar zero."""


def coords(n: int) -> list[str]:
    return [f"i{m}" for m in range(n)]


def check_mode(mode: int, nmodes: int) -> None:
    if not 0 <= mode < nmodes:
        raise ShapeMismatchError(f"mode {mode} of a tensor with {nmodes} modes")


def check_dims(dims: Sequence[int]) -> tuple[int, ...]:
    """Dims as a tuple; each from 0 to the largest long."""
    dims = tuple(int(d) for d in dims)
    if any(d < 0 or d > LONG_MAX for d in dims):
        raise ValueRangeError(f"dims {dims}")
    return dims


def checked_product(*factors: int) -> int:
    """Product of dims; an error where an index would leave the longs."""
    size = prod(factors)
    if size > LONG_MAX:
        raise ValueRangeError(f"{' x '.join(map(str, factors))} exceeds 2^63-1")
    return size


def fits_broadcast(rows: int, row_bytes: int, limit: int | None = None) -> bool:
    return rows * row_bytes <= (BROADCAST_BYTES if limit is None else limit)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint where the declared shape proves the side small; else Spark's own choice."""
    return F.broadcast(df) if fits_broadcast(rows, row_bytes) else df


def nonzero(df: DataFrame) -> DataFrame:
    """Without explicit zeros; NaN stays."""
    return df.filter(F.col("val") != 0)


class _Methods:
    """Operators as methods: looked up by name in the operator modules."""

    _modules: tuple[str, ...] = ()

    def __getattr__(self, name: str):
        from importlib import import_module

        if not name.startswith("_"):
            for module in type(self)._modules:
                found = getattr(import_module(f"tensorloom.operators.{module}"), name, None)
                if callable(found) and getattr(found, "__module__", "").startswith("tensorloom.operators"):
                    return lambda *a, **k: found(self, *a, **k)
        raise AttributeError(f"{type(self).__name__} has no {name}")


@dataclass(frozen=True)
class SparseTensor(_Methods):
    """Coordinate tensor. ``sort_order``: modes the rows are sorted by, if known."""

    df: DataFrame
    dims: tuple[int, ...]
    sort_order: tuple[int, ...] | None = None
    _modules = ("elementwise", "products", "layout", "sorting", "reorder", "split", "stats", "cpd")

    @property
    def nmodes(self) -> int:
        return len(self.dims)

    @property
    def modes(self) -> list[str]:
        return coords(self.nmodes)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @classmethod
    def empty(cls, spark: SparkSession, dims: Sequence[int]) -> SparseTensor:
        dims = check_dims(dims)
        schema = ", ".join([*(f"{c} long" for c in coords(len(dims))), "val double"])
        return cls(spark.createDataFrame([], schema), dims, tuple(range(len(dims))))

    @classmethod
    def from_rows(cls, spark: SparkSession, rows, dims: Sequence[int], coalesce: bool = True) -> SparseTensor:
        """From (i0, …, iN-1, val) tuples."""
        dims = check_dims(dims)
        schema = ", ".join([*(f"{c} long" for c in coords(len(dims))), "val double"])
        made = cls(spark.createDataFrame([(*map(int, r[:-1]), float(r[-1])) for r in rows], schema), dims)
        return made.coalesce() if coalesce else made

    @classmethod
    def from_table(cls, df: DataFrame, mode_cols: Sequence[str | Column], value: str | Column, dims: Sequence[int], coalesce: bool = True) -> SparseTensor:
        """A relation as a tensor: ``mode_cols`` are the coordinates, rows of equal coordinates are summed.

        Rows with a null coordinate or value are left out.
        """
        as_col = lambda c: F.expr(c) if isinstance(c, str) else c
        cols = [as_col(c).cast("long").alias(f"i{m}") for m, c in enumerate(mode_cols)]
        known = as_col(value).isNotNull()
        for c in mode_cols:
            known = known & as_col(c).isNotNull()  # plain conditions, which scans can take
        own = df.filter(known).select(*cols, as_col(value).cast("double").alias("val"))
        made = cls(own, check_dims(dims))
        return made.coalesce() if coalesce else made

    def coalesce(self) -> SparseTensor:
        """Sum the values of equal coordinates."""
        return SparseTensor(self.df.groupBy(*self.modes).agg(F.sum("val").alias("val")), self.dims)

    def with_df(self, df: DataFrame, sort_order: tuple[int, ...] | None = None) -> SparseTensor:
        return SparseTensor(df.select(*self.modes, "val"), self.dims, sort_order)

    def copy(self) -> SparseTensor:
        return SparseTensor(self.df, self.dims, self.sort_order)

    def nnz(self) -> int:
        return self.df.count()

    def require_same_shape(self, other: SparseTensor) -> None:
        if self.dims != other.dims:
            raise ShapeMismatchError(f"{self.dims} and {other.dims}")

    def has_duplicates(self) -> bool:
        return not self.df.groupBy(*self.modes).count().filter("count > 1").isEmpty()

    def out_of_range(self) -> DataFrame:
        """Rows with a coordinate outside the declared shape."""
        bad = F.lit(False)
        for m, d in enumerate(self.dims):
            bad = bad | (F.col(f"i{m}") < 0) | (F.col(f"i{m}") >= d)
        return self.df.filter(bad)

    def collect(self) -> list[tuple]:
        """All rows, sorted: for small results and tests."""
        return sorted(tuple(r) for r in self.df.select(*self.modes, "val").collect())

    def __add__(self, other):
        return self.add(other)

    def __sub__(self, other):
        return self.sub(other)

    def __mul__(self, other):
        """Tensor times scalar; the element-wise product of tensors is dot_mul."""
        if isinstance(other, SparseTensor):
            raise TypeError("use dot_mul for the element-wise product of two tensors")
        return self.mul_scalar(other)

    __rmul__ = __mul__

    def __truediv__(self, other):
        return self.dot_div(other) if isinstance(other, SparseTensor) else self.div_scalar(other)

    def __neg__(self):
        return self.mul_scalar(-1.0)


@dataclass(frozen=True)
class SemiSparseTensor(_Methods):
    """One dense mode: rows of the other modes' coordinates and ``fiber array<double>``.

    ``stored``, where known: the same rows with the fibers' ``cells`` (k, val),
    ascending, without the zeros between them. What needs no zeros reads
    these; fibers are formed for whoever reads ``fiber``.
    """

    df: DataFrame
    dims: tuple[int, ...]
    mode: int
    stored: DataFrame | None = None
    _modules = ("layout", "products", "stats", "sorting")

    def __post_init__(self):
        if len(self.dims) < 2:
            raise ShapeMismatchError("a semi-sparse tensor has two modes or more")
        check_mode(self.mode, len(self.dims))

    @property
    def others(self) -> list[str]:
        return [c for m, c in enumerate(coords(len(self.dims))) if m != self.mode]

    def collect(self) -> list[tuple]:
        return sorted((*tuple(r)[:-1], tuple(r[-1])) for r in self.df.select(*self.others, "fiber").collect())


@dataclass(frozen=True)
class GeneralSemiSparseTensor:
    """Several dense modes: coordinates of the sparse modes and one flattened ``fiber``, last dense mode fastest."""

    df: DataFrame
    dims: tuple[int, ...]
    dense_modes: tuple[int, ...]

    @property
    def strides(self) -> tuple[int, ...]:
        out, step = [], 1
        for m in reversed(self.dense_modes):
            out.append(step)
            step *= self.dims[m]
        return tuple(reversed(out))

    @classmethod
    def empty(cls, spark: SparkSession, dims: Sequence[int], dense_modes: Sequence[int]) -> GeneralSemiSparseTensor:
        dims = check_dims(dims)
        for m in dense_modes:
            check_mode(m, len(dims))
        schema = ", ".join([*(f"i{m} long" for m in range(len(dims)) if m not in dense_modes), "fiber array<double>"])
        return cls(spark.createDataFrame([], schema), dims, tuple(dense_modes))


@dataclass(frozen=True)
class HiCOOTensor(_Methods):
    """Blocked tensor, one row a block: kernel k0…, block b0…, chunk, entries (offsets e0… and val)."""

    df: DataFrame
    dims: tuple[int, ...]
    sb_bits: int
    sk_bits: int
    sc_bits: int
    _modules = ("layout", "products", "stats", "cpd")

    @property
    def nmodes(self) -> int:
        return len(self.dims)


@dataclass(frozen=True)
class SparseMatrix(_Methods):
    """Coordinate matrix i, j, val."""

    df: DataFrame
    nrows: int
    ncols: int
    _modules = ("matrix", "stats")

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @classmethod
    def from_rows(cls, spark: SparkSession, rows, nrows: int, ncols: int) -> SparseMatrix:
        return cls(spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in rows], "i long, j long, val double"), nrows, ncols)

    @classmethod
    def empty(cls, spark: SparkSession, nrows: int, ncols: int) -> SparseMatrix:
        return cls(spark.createDataFrame([], "i long, j long, val double"), nrows, ncols)

    def copy(self) -> SparseMatrix:
        return SparseMatrix(self.df, self.nrows, self.ncols)

    def nnz(self) -> int:
        return self.df.count()

    def as_tensor(self) -> SparseTensor:
        return SparseTensor(self.df.select(F.col("i").alias("i0"), F.col("j").alias("i1"), "val"), (self.nrows, self.ncols))

    def collect(self) -> list[tuple]:
        return sorted(tuple(r) for r in self.df.select("i", "j", "val").collect())


@dataclass(frozen=True)
class CSRMatrix(_Methods):
    """One row a matrix row: i, rowptr (entries before it), cols, vals."""

    df: DataFrame
    nrows: int
    ncols: int
    _modules = ("matrix", "stats")


@dataclass(frozen=True)
class HiCOOMatrix(_Methods):
    """Blocked matrix, one row a block: ki, kj, bi, bj, entries (ei, ej, val)."""

    df: DataFrame
    nrows: int
    ncols: int
    sb_bits: int
    sk_bits: int
    _modules = ("matrix", "stats")


@dataclass(frozen=True)
class DenseMatrix(_Methods):
    """Rows i, row array<double>; every row from 0 to nrows - 1 is there."""

    df: DataFrame
    nrows: int
    ncols: int
    _modules = ("dense",)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def row_bytes(self) -> int:
        return 8 * (self.ncols + 4)

    def small(self) -> DataFrame:
        """The rows, with a broadcast hint if nrows x ncols proves them small."""
        return maybe_broadcast(self.df, self.nrows, self.row_bytes)

    def collect(self) -> list[list[float]]:
        return [list(r["row"]) for r in sorted(self.df.collect(), key=lambda r: r["i"])]


@dataclass(frozen=True)
class Vector(_Methods):
    """Dense vector: rows i, val from 0 to size - 1."""

    df: DataFrame
    size: int
    _modules = ("vectors",)

    def small(self) -> DataFrame:
        return maybe_broadcast(self.df, self.size, 40)

    def collect(self) -> list[float]:
        return [r["val"] for r in sorted(self.df.collect(), key=lambda r: r["i"])]


@dataclass
class KruskalTensor:
    """Result of a CP decomposition: weights, factor matrices, fit and its course over the iterations."""

    factors: list[DenseMatrix]
    weights: list[float]
    fit: float = 0.0
    trace: list[float] = field(default_factory=list)

    @property
    def rank(self) -> int:
        return len(self.weights)

    @property
    def dims(self) -> tuple[int, ...]:
        return tuple(f.nrows for f in self.factors)

    @classmethod
    def empty(cls, spark: SparkSession, dims: Sequence[int], rank: int) -> KruskalTensor:
        from tensorloom.operators.dense import constant

        return cls([constant(spark, d, rank, 0.0) for d in dims], [0.0] * rank)
