"""Decompositions: CP by alternating least squares, and Tucker by higher-order orthogonal iteration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import product as cartesian
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.lineage import settle
from tensorloom.operators import dense
from tensorloom.operators.products import mttkrp, mttkrp_rows, rank_sums
from tensorloom.operators.stats import frob_norm_sq
from tensorloom.types import DenseMatrix, HiCOOTensor, KruskalTensor, ShapeMismatchError, SparseTensor, ValueRangeError, fits_broadcast, maybe_broadcast


def kruskal_norm_sq(weights: Sequence[float], grams: Sequence[np.ndarray]) -> float:
    """|w' (product of all Gram matrices) w|."""
    w = np.asarray(weights)
    return float(abs(w @ dense.hadamard_except(grams, -1) @ w))


def kruskal_inner(weights: Sequence[float], last: DenseMatrix, product: DenseMatrix) -> float:
    """Inner product with the tensor whose last-mode MTTKRP is ``product``."""
    sums = dense._sums(dense.hadamard(last, product), [F.get("row", F.lit(r)) for r in range(last.ncols)])
    return float(np.dot(weights, sums))


def fit_of(norm_sq: float, model_sq: float, cross: float) -> float:
    """1 - |X - M| / |X|; a residual below zero is taken as it is."""
    if norm_sq == 0:
        return 0.0
    residual = norm_sq + model_sq - 2 * cross
    return 1 - (residual**0.5 if residual > 0 else residual) / norm_sq**0.5


#: A factor of a declared size up to this is settled on the driver.
SMALL_FACTOR = 8 << 20


def _settle(a: DenseMatrix, checkpoint: bool) -> DenseMatrix:
    """Cut a large factor's lineage by a reliable checkpoint, where the session has a folder for it."""
    return DenseMatrix(a.df.checkpoint() if checkpoint else a.df.persist(), a.nrows, a.ncols)


def _small_step(product: DenseMatrix, inverse: np.ndarray, first: bool) -> tuple[DenseMatrix, list[float], np.ndarray, np.ndarray]:
    """Factor, divisors, Gram matrix and column-wise products with ``product``: one job brings the rows, the rest is R-wide algebra."""
    p = np.array([r["row"] for r in sorted(product.df.collect(), key=lambda r: r["i"])], float).reshape(product.nrows, product.ncols)
    a = p @ inverse
    norms = np.sqrt((a * a).sum(axis=0)) if first else np.maximum(1.0, a.max(axis=0, initial=1.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        a = a / norms
    made = product.spark.createDataFrame(list(enumerate(a.tolist())), "i long, row array<double>")
    return DenseMatrix(made, product.nrows, product.ncols), norms.tolist(), a.T @ a, (a * p).sum(axis=0)


def cp_als(x: SparseTensor | HiCOOTensor, rank: int, niters: int = 50, tol: float = 1e-5, init: str | Sequence[DenseMatrix] = "random", seed: int = 0) -> KruskalTensor:
    """CP decomposition. ``init``: "random", "ramp" (i + r + 1) or factor matrices.

    Stops once the fit moves by less than ``tol``. Columns are normalised by
    their length in the first round, by their maximum after. A blocked tensor
    stays in its blocks.
    """
    if rank < 1 or niters < 1:
        raise ValueRangeError(f"rank {rank}, {niters} rounds")
    spark = x.df.sparkSession
    checkpoint = spark.sparkContext.getCheckpointDir() is not None
    own = replace(x, df=x.df.persist())
    try:
        if isinstance(init, str):
            made = {"ramp": lambda m, d: dense.ramp(spark, d, rank), "random": lambda m, d: dense.random(spark, d, rank, seed + m)}
            if init not in made:
                raise ValueRangeError(f"start {init}")
            factors = [made[init](m, d) for m, d in enumerate(x.dims)]
        else:
            factors = list(init)
            if len(factors) != x.nmodes or any((f.nrows, f.ncols) != (d, rank) for f, d in zip(factors, x.dims, strict=True)):
                raise ShapeMismatchError("start factors")
        grams = [dense.gram(f) for f in factors]
        norm_sq, weights, trace = frob_norm_sq(own), [1.0] * rank, []
        for it in range(niters):
            for m in range(x.nmodes):
                product = mttkrp(own, factors, m)
                if fits_broadcast(product.nrows, product.row_bytes, SMALL_FACTOR):
                    inverse = dense.inverse_normals(dense.hadamard_except(grams, m))
                    factors[m], weights, grams[m], sums = _small_step(product, inverse, it == 0)
                    cross = float(np.dot(weights, sums))
                    continue
                product = _settle(product, checkpoint)
                solved = dense.solve_normals(product, grams, m)
                a, weights = dense.normalize_maxnorm(solved) if it else dense.normalize_2norm(solved)
                factors[m] = _settle(a, checkpoint)
                grams[m] = dense.gram(factors[m])
                cross = kruskal_inner(weights, factors[m], product) if m == x.nmodes - 1 else 0.0
            trace.append(fit_of(norm_sq, kruskal_norm_sq(weights, grams), cross))
            if it and abs(trace[-1] - trace[-2]) < tol:
                break
        for m, a in enumerate(factors):
            factors[m], norms = dense.normalize_2norm(a)
            weights = [w * n for w, n in zip(weights, norms, strict=True)]
        return KruskalTensor(factors, weights, trace[-1], trace)
    finally:
        own.df.unpersist()


def inverse_shuffle(k: KruskalTensor, maps: Sequence[DataFrame]) -> KruskalTensor:
    """Factors of a relabelled tensor in the old order."""
    return KruskalTensor([dense.inverse_shuffle(f, m) for f, m in zip(k.factors, maps, strict=True)], k.weights, k.fit, k.trace)


def values_at(k: KruskalTensor, x: SparseTensor) -> DataFrame:
    """The model's value at each entry of x."""
    df = x.df
    for m, f in enumerate(k.factors):
        df = df.join(f.small().select(F.col("i").alias(f"i{m}"), F.col("row").alias(f"_f{m}")), f"i{m}")
    total = F.lit(0.0)
    for r, w in enumerate(k.weights):
        term = F.lit(float(w))
        for m in range(len(k.factors)):
            term = term * F.get(f"_f{m}", F.lit(r))
        total = total + term
    return df.select(*x.modes, total.alias("val"))


def _triangle(cols: int):
    """Batches of rows (i, row) or of triangles (row) to one triangle R of their stack's QR decomposition, flattened."""

    def run(batches):
        r = np.zeros((0, cols))
        for batch in batches:
            flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            r = np.linalg.qr(np.vstack([r, flat.reshape(-1, cols)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["row"])

    return run


#: Triangles that one task, or the driver, stacks.
STACK = 32


def tall_skinny_r(rows: DataFrame, cols: int) -> np.ndarray:
    """R of the QR decomposition of a matrix (i, row) of any number of rows: triangles of parts, then of STACK triangles at a time."""
    parts = rows.select("i", "row").mapInArrow(_triangle(cols), "row array<double>")
    found = settle(parts, "triangles")
    while (n := found.count()) > STACK:
        n = -(-n // STACK)
        found = settle(found.repartition(n).mapInArrow(_triangle(cols), "row array<double>"), "triangles")
    stack = [np.array(r["row"]).reshape(-1, cols) for r in found.collect()]
    return np.linalg.qr(np.vstack([np.zeros((0, cols)), *stack]), mode="r")


def _projected(x: SparseTensor, factors: Sequence[DenseMatrix], mode: int) -> DataFrame:
    """(i, row): the unfolding along ``mode`` of x times all other factors, the last mode fastest; rows with an entry only."""
    df, others = x.df, [k for k in range(x.nmodes) if k != mode]
    for k in others:
        f = factors[k]
        df = df.join(maybe_broadcast(f.df.select(F.col("i").alias(f"i{k}"), F.col("row").alias(f"_f{k}")), f.nrows, f.row_bytes), f"i{k}")
    places = list(cartesian(*[range(factors[k].ncols) for k in others]))

    def term(c: int):
        out = F.col("val")
        for k, r in zip(others, places[c], strict=True):
            out = out * F.get(f"_f{k}", F.lit(r))
        return out

    return rank_sums(df, [f"i{mode}"], term, len(places), "row").select(F.col(f"i{mode}").alias("i"), "row")


def _leading(rows: DataFrame, cols: int, rank: int, nrows: int) -> tuple[DenseMatrix, np.ndarray]:
    """The leading left singular vectors of a tall matrix, and its part of the small side: singular values times right vectors."""
    rows = settle(rows, "unfolding")
    s, v = np.linalg.svd(tall_skinny_r(rows, cols), full_matrices=False)[1:]
    rank = min(rank, len(s))
    v = v[:rank] * np.sign(v[np.arange(rank), np.abs(v[:rank]).argmax(axis=1)])[:, None]
    keep = s[:rank] > s[:1] * 1e-12
    inverse = np.where(keep, 1 / np.where(keep, s[:rank], 1.0), 0.0)
    found = dense.times_small(DenseMatrix(rows, nrows, cols), v.T * inverse)
    zero = F.array_repeat(F.lit(0.0), rank)
    full = rows.sparkSession.range(nrows).select(F.col("id").alias("i")).join(found.df, "i", "left").select("i", F.coalesce("row", zero).alias("row"))
    if fits_broadcast(nrows, 8 * (rank + 4), SMALL_FACTOR):
        return dense.from_rows(rows.sparkSession, [list(r["row"]) for r in full.orderBy("i").collect()]), s[:rank, None] * v
    return DenseMatrix(settle(full, "factor"), nrows, rank), s[:rank, None] * v


def tucker(x: SparseTensor, ranks: Sequence[int], niters: int = 10, tol: float = 1e-6, seed: int = 0, more: int = 4) -> tuple[SparseTensor, list[DenseMatrix], float]:
    """Core, orthonormal factors and fit, by higher-order orthogonal iteration; modes may be of any size.

    Starts are ranges of random sketches: the tensor's unfolding times a
    Khatri-Rao product of random factors, ``more`` columns wider than the rank.
    A basis is then the leading left singular vectors of the tensor
    times all other factors, a matrix of as many rows as the mode and as many
    columns as the other ranks' product: QR decompositions of parts of rows
    are stacked until one small triangle is left, whose singular
    vectors the driver finds. Where the tensor's own rank is lower, columns
    beyond it are zero.
    """
    if len(ranks) != x.nmodes or any(not 0 < r <= d for r, d in zip(ranks, x.dims, strict=True)):
        raise ShapeMismatchError(f"ranks {ranks} of {x.dims}")
    spark, norm_sq = x.spark, frob_norm_sq(x)
    own, fit, last = SparseTensor(x.df.persist(), x.dims), 0.0, x.nmodes - 1
    try:
        wide = max(ranks) + more
        sketch = [dense.random(spark, d, wide, seed + m) for m, d in enumerate(x.dims)]
        factors = [_leading(mttkrp_rows(own, sketch, m), wide, ranks[m], x.dims[m])[0] for m in range(x.nmodes)]
        for it in range(niters):
            for m in range(x.nmodes):
                factors[m], core = _leading(_projected(own, factors, m), prod(f.ncols for k, f in enumerate(factors) if k != m), ranks[m], x.dims[m])
            new = 1 - max(0.0, norm_sq - float((core * core).sum())) ** 0.5 / norm_sq**0.5 if norm_sq else 0.0
            done, fit = it > 0 and abs(new - fit) < tol, new
            if done:
                break
        cells = core.reshape(core.shape[0], *[f.ncols for f in factors[:last]])
        rows = [(*at[1:], at[0], float(v)) for at, v in np.ndenumerate(cells)]
        return SparseTensor.from_rows(spark, rows, tuple(ranks)), factors, fit
    finally:
        own.df.unpersist()
