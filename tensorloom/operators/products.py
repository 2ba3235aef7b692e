"""Products: an equi-join on the contracted index, then sums over the free ones.

Dense operands are rows with an array; products of ranks are single
expressions, so that sums stay in generated code and a nonzero stays one row.
An operand is broadcast only if its declared shape bounds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.blocked import mttkrp_blocks
from tensorloom.types import (
    DenseMatrix,
    HiCOOTensor,
    SemiSparseTensor,
    ShapeMismatchError,
    SparseTensor,
    Vector,
    check_mode,
    checked_product,
    maybe_broadcast,
    nonzero,
)

#: Above this rank sums go through one row a rank instead of one expression a rank.
UNROLL = 64


def rank_sums(df: DataFrame, keys: list[str], terms, rank: int, name: str, every: DataFrame | None = None) -> DataFrame:
    """Sum ``terms(r)`` by the keys for each r into an array column.

    ``every``: keys that must be there; they join the aggregation as zeros,
    which takes no join and no sort.
    """
    out = None
    for a in range(0, rank, UNROLL):
        part = range(a, min(a + UNROLL, rank))
        one = df.select(*keys, *[terms(r).alias(f"_s{r}") for r in part])
        if every is not None:
            one = one.unionByName(every.select(*keys, *[F.lit(0.0).alias(f"_s{r}") for r in part]))
        one = one.groupBy(*keys).agg(*[F.sum(f"_s{r}").alias(f"_s{r}") for r in part])
        one = one.select(*keys, F.array(*[F.col(f"_s{r}") for r in part]).alias(name))
        out = one if out is None else out.join(one.withColumnRenamed(name, "_more"), keys).select(*keys, F.concat(name, "_more").alias(name))
    return out


def ttv(x: SparseTensor, v: Vector, mode: int) -> SparseTensor:
    """Tensor times vector; the mode stays, with size 1."""
    check_mode(mode, x.nmodes)
    if x.dims[mode] != v.size:
        raise ShapeMismatchError(f"mode {mode} has size {x.dims[mode]}, the vector {v.size}")
    others = [c for c in x.modes if c != f"i{mode}"]
    right = maybe_broadcast(v.df.select(F.col("i").alias(f"i{mode}"), F.col("val").alias("_v")), v.size, 40)
    total = F.sum(F.col("val") * F.col("_v")).alias("val")
    joined = x.df.join(right, f"i{mode}")
    summed = joined.groupBy(*others).agg(total) if others else joined.agg(total).dropna()
    dims = tuple(1 if m == mode else d for m, d in enumerate(x.dims))
    return SparseTensor(summed.withColumn(f"i{mode}", F.lit(0).cast("long")).select(*x.modes, "val"), dims)


def ttm(x: SparseTensor, u: DenseMatrix, mode: int) -> SemiSparseTensor:
    """Tensor times matrix (rows of u match the mode); the mode becomes dense with u's columns."""
    check_mode(mode, x.nmodes)
    if x.nmodes < 2:
        raise ShapeMismatchError("tensor times matrix needs two modes or more")
    if x.dims[mode] != u.nrows:
        raise ShapeMismatchError(f"mode {mode} has size {x.dims[mode]}, the matrix {u.nrows} rows")
    others = [c for c in x.modes if c != f"i{mode}"]
    right = maybe_broadcast(u.df.select(F.col("i").alias(f"i{mode}"), "row"), u.nrows, u.row_bytes)
    sums = rank_sums(x.df.join(right, f"i{mode}"), others, lambda r: F.col("val") * F.get("row", F.lit(r)), u.ncols, "fiber")
    return SemiSparseTensor(sums, tuple(u.ncols if m == mode else d for m, d in enumerate(x.dims)), mode)


def ttm_chain(x: SparseTensor, matrices: dict[int, DenseMatrix], order: Sequence[int] | None = None) -> SparseTensor:
    """Several modes in turn; by default those that shrink their mode most come first."""
    order = sorted(matrices, key=lambda m: matrices[m].ncols / max(1, x.dims[m])) if order is None else order
    for m in order:
        x = ttm(x, matrices[m], m).to_coo(0.0)
    return x


def ttm_semi_sparse(y: SemiSparseTensor, u: DenseMatrix, mode: int) -> SemiSparseTensor:
    """Fibers times matrix, along the dense mode only."""
    if mode != y.mode:
        raise ShapeMismatchError(f"mode {mode} is not the dense mode {y.mode}")
    return ttm(y.to_coo(0.0), u, mode)


def ttm_hicoo(x: HiCOOTensor, u: DenseMatrix, mode: int) -> SemiSparseTensor:
    """Tensor times matrix on the blocked layout."""
    return ttm(x.to_coo(), u, mode)


def mttkrp_rows(x: SparseTensor, factors: Sequence[DenseMatrix], mode: int, every: DataFrame | None = None) -> DataFrame:
    """i and row of the rows that have a nonzero (or are in ``every``): matricised tensor times Khatri-Rao product."""
    check_mode(mode, x.nmodes)
    if len(factors) != x.nmodes:
        raise ShapeMismatchError(f"{len(factors)} factors for {x.nmodes} modes")
    ranks = {f.ncols for f in factors}
    if len(ranks) != 1:
        raise ShapeMismatchError(f"factors of {sorted(ranks)} columns")
    df, rank = x.df, ranks.pop()
    for k, f in enumerate(factors):
        if k == mode:
            continue
        if f.nrows != x.dims[k]:
            raise ShapeMismatchError(f"mode {k} has size {x.dims[k]}, the factor {f.nrows} rows")
        df = df.join(maybe_broadcast(f.df.select(F.col("i").alias(f"i{k}"), F.col("row").alias(f"_f{k}")), f.nrows, f.row_bytes), f"i{k}")

    def term(r: int) -> Column:
        out = F.col("val")
        for k in range(x.nmodes):
            if k != mode:
                out = out * F.get(f"_f{k}", F.lit(r))
        return out

    return rank_sums(df, [f"i{mode}"], term, rank, "row", every).withColumnRenamed(f"i{mode}", "i")


def mttkrp(x: SparseTensor | HiCOOTensor, factors: Sequence[DenseMatrix], mode: int) -> DenseMatrix:
    """All rows of the product; rows without a nonzero are zero. Blocked tensors are summed block by block."""
    if isinstance(x, HiCOOTensor):
        return mttkrp_blocks(x, factors, mode)
    check_mode(mode, x.nmodes)
    every = x.spark.range(x.dims[mode]).select(F.col("id").alias(f"i{mode}"))
    return DenseMatrix(mttkrp_rows(x, factors, mode, every), x.dims[mode], factors[0].ncols)


def mttkrp_split(x: SparseTensor, factors: Sequence[DenseMatrix], mode: int, limits: Sequence[int]) -> DenseMatrix:
    """MTTKRP of each part of ``split`` in one plan, summed."""
    return mttkrp(x.with_df(x.split(limits).drop("split_id")), factors, mode)


def contract(x: SparseTensor, y: SparseTensor, modes_x: Sequence[int], modes_y: Sequence[int]) -> SparseTensor:
    """Sum over paired modes; x's free modes come first, then y's. Zeros are dropped."""
    if len(modes_x) != len(modes_y) or len(set(modes_x)) != len(modes_x) or len(set(modes_y)) != len(modes_y):
        raise ShapeMismatchError(f"modes {modes_x} against {modes_y}")
    for a, b in zip(modes_x, modes_y, strict=True):
        check_mode(a, x.nmodes)
        check_mode(b, y.nmodes)
        if x.dims[a] != y.dims[b]:
            raise ShapeMismatchError(f"mode {a} has size {x.dims[a]}, mode {b} has {y.dims[b]}")
    if not modes_x:
        raise ShapeMismatchError("no modes to contract")
    free_x = [m for m in range(x.nmodes) if m not in modes_x]
    free_y = [m for m in range(y.nmodes) if m not in modes_y]
    if not free_x and not free_y:
        raise ShapeMismatchError("a full contraction is a number: use inner")
    keys = [f"_k{n}" for n in range(len(modes_x))]
    out = [f"i{n}" for n in range(len(free_x) + len(free_y))]
    left = x.df.select(*[F.col(f"i{m}").alias(k) for m, k in zip(modes_x, keys, strict=True)], *[F.col(f"i{m}").alias(o) for m, o in zip(free_x, out, strict=False)], F.col("val").alias("_a"))
    right = y.df.select(*[F.col(f"i{m}").alias(k) for m, k in zip(modes_y, keys, strict=True)], *[F.col(f"i{m}").alias(o) for m, o in zip(free_y, out[len(free_x) :], strict=True)], F.col("val").alias("_b"))
    summed = left.join(right, keys).groupBy(*out).agg(F.sum(F.col("_a") * F.col("_b")).alias("val"))
    dims = tuple([x.dims[m] for m in free_x] + [y.dims[m] for m in free_y])
    return SparseTensor(nonzero(summed), dims)


def inner(x: SparseTensor, y: SparseTensor) -> float:
    """Sum of the products of matching entries."""
    return float(x.dot_mul(y).df.agg(F.sum("val")).first()[0] or 0.0)


def _paired(a: SparseTensor, b: SparseTensor, modes: range) -> list[Column]:
    return [(F.col(f"i{m}") * F.lit(b.dims[m]) + F.col(f"_j{m}")).alias(f"i{m}") for m in modes]


def kronecker(a: SparseTensor, b: SparseTensor) -> SparseTensor:
    """All pairs of entries: the product's own size is nnz(a) x nnz(b)."""
    if a.nmodes != b.nmodes:
        raise ShapeMismatchError(f"{a.nmodes} and {b.nmodes} modes")
    dims = tuple(checked_product(p, q) for p, q in zip(a.dims, b.dims, strict=True))
    right = b.df.select(*[F.col(f"i{m}").alias(f"_j{m}") for m in range(b.nmodes)], F.col("val").alias("_b"))
    pairs = a.df.crossJoin(right)
    return SparseTensor(pairs.select(*_paired(a, b, range(a.nmodes)), (F.col("val") * F.col("_b")).alias("val")), dims)


def khatri_rao(a: SparseTensor, b: SparseTensor) -> SparseTensor:
    """Kronecker product within equal indices of the last mode."""
    if a.nmodes != b.nmodes or a.dims[-1] != b.dims[-1]:
        raise ShapeMismatchError(f"{a.dims} and {b.dims}")
    last = a.nmodes - 1
    dims = (*(checked_product(p, q) for p, q in zip(a.dims[:-1], b.dims[:-1], strict=True)), a.dims[-1])
    right = b.df.select(*[F.col(f"i{m}").alias(f"_j{m}") for m in range(last)], F.col(f"i{last}"), F.col("val").alias("_b"))
    pairs = a.df.join(right, f"i{last}")
    return SparseTensor(pairs.select(*_paired(a, b, range(last)), f"i{last}", (F.col("val") * F.col("_b")).alias("val")), dims)
