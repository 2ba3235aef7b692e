"""Element-wise and scalar operators on coordinate tensors.

Coordinates of an operand must be unique; ``SparseTensor.coalesce`` makes them so.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.functions.ieee import divide
from tensorloom.types import ShapeMismatchError, SparseTensor, ZeroDivisorError, nonzero


def _summed(x: SparseTensor, y: SparseTensor, sign: int) -> SparseTensor:
    """Union and one aggregation: half the shuffles of a full outer join, and no join to skew."""
    x.require_same_shape(y)
    right = y.df.select(*y.modes, (F.lit(sign) * F.col("val")).alias("val"))
    both = x.df.select(*x.modes, "val").unionByName(right)
    return x.with_df(nonzero(both.groupBy(*x.modes).agg(F.sum("val").alias("val"))))


def add(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """x + y; zeros are dropped."""
    return _summed(x, y, 1)


def sub(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """x - y; what only y has is negated, zeros are dropped."""
    return _summed(x, y, -1)


def _matched(x: SparseTensor, y: SparseTensor, value) -> SparseTensor:
    x.require_same_shape(y)
    right = y.df.select(*y.modes, F.col("val").alias("other"))
    both = x.df.select(*x.modes, "val").join(right, x.modes)
    return x.with_df(both.withColumn("val", value(F.col("val"), F.col("other"))))


def dot_mul(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """Products where both have an entry; zeros are dropped."""
    out = _matched(x, y, lambda a, b: a * b)
    return out.with_df(nonzero(out.df))


def dot_mul_eq(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """dot_mul of tensors with the same pattern; an error if the patterns differ."""
    x.require_same_shape(y)
    right = y.df.select(*y.modes, F.lit(1).alias("there"))
    if x.nnz() != y.nnz() or not x.df.join(right, x.modes, "left_anti").isEmpty():
        raise ShapeMismatchError("the tensors have different entries")
    return dot_mul(x, y)


def dot_div(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """Quotients where both have an entry; zeros stay, a zero divisor gives an infinity or NaN."""
    return _matched(x, y, divide)


def mul_scalar(x: SparseTensor, a: float) -> SparseTensor:
    """x times a number; times zero it is empty."""
    if a == 0:
        return SparseTensor.empty(x.spark, x.dims)
    return x.with_df(x.df.withColumn("val", F.col("val") * F.lit(float(a))), x.sort_order)


def div_scalar(x: SparseTensor, a: float) -> SparseTensor:
    """x over a number other than zero."""
    if a == 0:
        raise ZeroDivisorError("division of a tensor by zero")
    return x.with_df(x.df.withColumn("val", F.col("val") / F.lit(float(a))), x.sort_order)


def left_div_scalar(x: SparseTensor, a: float) -> SparseTensor:
    r"""a \ x: the tensor that a times gives x, for a number other than zero."""
    return div_scalar(x, a)


def collect_zeros(x: SparseTensor) -> SparseTensor:
    """Without explicit zeros; NaN stays."""
    return x.with_df(nonzero(x.df), x.sort_order)
