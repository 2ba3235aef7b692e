"""Norms, bounds and status of tensors and matrices."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.ieee import bytes_string
from tensorloom.types import CSRMatrix, HiCOOMatrix, HiCOOTensor, SemiSparseTensor, SparseMatrix, SparseTensor, check_mode


def _coo(x):
    return x if isinstance(x, (SparseTensor, SparseMatrix)) else x.to_coo()


def frob_norm_sq(x: SparseTensor | HiCOOTensor) -> float:
    """Sum of squares."""
    return float(_coo(x).df.agg(F.sum(F.col("val") * F.col("val"))).first()[0] or 0.0)


def norm(x: SparseTensor | HiCOOTensor | SemiSparseTensor) -> float:
    """Square root of the sum of squares; of fibers for a semi-sparse tensor."""
    if isinstance(x, SemiSparseTensor):
        squares = F.aggregate("fiber", F.lit(0.0), lambda s, v: s + v * v)
        return float(x.df.agg(F.sum(squares)).first()[0] or 0.0) ** 0.5
    return frob_norm_sq(x) ** 0.5


def slice_sizes(x: SparseTensor, mode: int) -> DataFrame:
    """i and nnz of every index of a mode, zeros included."""
    check_mode(mode, x.nmodes)
    counts = x.df.groupBy(F.col(f"i{mode}").alias("i")).agg(F.count("*").alias("nnz"))
    every = x.spark.range(x.dims[mode]).select(F.col("id").alias("i"))
    return every.join(counts, "i", "left").select("i", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def index_bounds(x: SparseTensor) -> DataFrame:
    """One row: lo_m and hi_m (least index, greatest plus one) of each mode; zeros for an empty tensor."""
    cols = [F.coalesce(f, F.lit(0)).alias(f"{n}{m}") for m in range(x.nmodes) for f, n in ((F.min(f"i{m}"), "lo"), (F.max(f"i{m}") + 1, "hi"))]
    return x.df.agg(*cols)


def density_of(nnz: int, dims) -> float:
    """nnz over the product of dims, as a product of roots, which does not overflow."""
    return prod(nnz ** (1 / len(dims)) / d for d in dims) if nnz and all(dims) else 0.0


def density(x: SparseTensor | SparseMatrix) -> float:
    dims = x.dims if isinstance(x, SparseTensor) else (x.nrows, x.ncols)
    return density_of(x.nnz(), dims)


def status(x) -> dict:
    """Shape, entries, density and storage; for blocked layouts the blocks' statistics too."""
    if isinstance(x, (HiCOOTensor, HiCOOMatrix)):
        return hicoo_status(x).first().asDict()
    if isinstance(x, CSRMatrix):
        n = x.df.agg(F.sum(F.size("cols"))).first()[0] or 0
        size = 8 * (x.nrows + 1) + 16 * n
        return {"nrows": x.nrows, "ncols": x.ncols, "nnz": n, "density": density_of(n, (x.nrows, x.ncols)), "bytes": size, "storage": bytes_string(size)}
    n = x.nnz()
    if isinstance(x, SparseMatrix):
        size = 24 * n
        return {"nrows": x.nrows, "ncols": x.ncols, "nnz": n, "density": density_of(n, (x.nrows, x.ncols)), "bytes": size, "storage": bytes_string(size)}
    size = (8 * x.nmodes + 8) * n
    return {"dims": x.dims, "nnz": n, "density": density_of(n, x.dims), "slice_length": tuple(n / d if d else 0.0 for d in x.dims), "bytes": size, "storage": bytes_string(size)}


def hicoo_status(x: HiCOOTensor | HiCOOMatrix) -> DataFrame:
    """One row: blocks, kernels, chunks; entries a kernel and a block; fill of blocks; blocks over entries."""
    kernel = [f"k{m}" for m in range(x.nmodes)] if isinstance(x, HiCOOTensor) else ["ki", "kj"]
    modes = len(kernel)
    chunk = F.col("chunk") if isinstance(x, HiCOOTensor) else F.lit(0)
    sized = x.df.select(*kernel, chunk.alias("chunk"), F.size("entries").alias("n"))
    by_kernel = sized.groupBy(*kernel).agg(
        F.sum("n").alias("kn"), F.count("*").alias("kb"), F.countDistinct("chunk").alias("kc"), F.max("n").alias("most"), F.min("n").alias("least"),
        F.sum(F.log(F.col("n").cast("double"))).alias("logs"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    total, blocks = F.sum("kn"), F.sum("kb")
    out = by_kernel.agg(
        zero(blocks).alias("nb"), F.count("*").alias("nk"), zero(F.sum("kc")).alias("nc"), zero(total).alias("nnz"),
        zero(F.max("kn")).alias("max_nnzk"), zero(F.min("kn")).alias("min_nnzk"), F.coalesce(F.avg("kn"), F.lit(0.0)).alias("avg_nnzk"), F.coalesce(F.stddev_pop("kn"), F.lit(0.0)).alias("std_nnzk"),
        zero(F.max("most")).alias("max_nnzb"), zero(F.min("least")).alias("min_nnzb"), F.coalesce(F.try_divide(total, blocks), F.lit(0.0)).alias("avg_nnzb"),
        F.coalesce(F.exp(F.try_divide(F.sum("logs"), blocks)) / float(1 << x.sb_bits), F.lit(0.0)).alias("geo_cb"),
        F.coalesce(F.try_divide(blocks, total), F.lit(0.0)).alias("alpha_b"),
    )
    return out.withColumn("bytes", F.col("nb") * (8 + 4 * modes) + F.col("nnz") * (2 * modes + 8))


def block_sizes(x: HiCOOTensor | HiCOOMatrix) -> DataFrame:
    """One row: median, least and greatest fill of the blocks, over their edge."""
    edge = float(1 << x.sb_bits)
    n = F.size("entries") / edge
    return x.df.agg(F.percentile(n, 0.5).alias("median_cb"), F.min(n).alias("min_cb"), F.max(n).alias("max_cb"))


def kernel_stats(x: HiCOOTensor) -> DataFrame:
    """Blocks and entries of each kernel."""
    kernel = [f"k{m}" for m in range(x.nmodes)]
    return x.df.groupBy(*kernel).agg(F.count("*").alias("blocks"), F.sum(F.size("entries")).alias("nnz"))
