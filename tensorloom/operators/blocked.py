"""Products on blocked layouts, block by block.

Blocks stay rows until their entries are summed: a task multiplies and sums
whole batches of blocks as arrays, and only the sums of what its blocks give to
one output row are shuffled: of all blocks of the task where the output's
declared shape bounds them, else of a batch, in which blocks of one kernel
lie together as they were made.

A dense operand whose declared shape bounds it is one array in each worker,
where a block's number and an entry's offset are the address of a row. A larger
one is dealt into blocks of as many rows as a block has indices, which
meet the blocks by block number, once each; a block of many entries takes the
operand's block along, one of few entries the rows that it needs, so a
block is never wider than 2^sb_bits rows an operand.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.types import DenseMatrix, HiCOOMatrix, HiCOOTensor, ShapeMismatchError, Vector, check_mode, fits_broadcast


def whole(df: DataFrame, nrows: int, rank: int):
    """All rows (i, row) of an operand that its declared shape bounds, as a broadcast array."""
    table = df.select("i", "row").toArrow()
    out = np.zeros((nrows, rank))
    out[table.column("i").to_numpy()] = table.column("row").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)
    return df.sparkSession.sparkContext.broadcast(out)


def operand_blocks(df: DataFrame, sb_bits: int, block: str, cells: str) -> DataFrame:
    """``block`` number and ``cells``, its rows in order, of a dense operand (i, row) that has every row."""
    dealt = df.groupBy(F.shiftright("i", sb_bits).alias(block)).agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias(cells))
    return dealt.select(block, F.transform(cells, lambda c: c["row"]).alias(cells))


def _place(field: str):
    return lambda e: e[field].cast("int")


def _rows(i: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    row = pa.ListArray.from_arrays(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32), pa.array(total.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(i), row], ["i", "row"])


def _sums(sb_bits: int, out: str, operands: list[tuple], rank: int, nrows: int | None):
    """Batches of blocks to (i, row): the sums of each output row over a batch, or over the task where ``nrows`` of the output bounds them.

    Columns: entries, output block, and of each operand its block or cells.
    """

    def run(batches):
        held_sums, touched = None if nrows is None else np.zeros((nrows, rank)), None if nrows is None else np.zeros(nrows, bool)
        for batch in batches:
            entries = batch.column(0)
            sizes = pc.list_value_length(entries).to_numpy(zero_copy_only=False).astype(np.int64)
            if not sizes.sum():
                continue
            cells = entries.flatten()
            field = lambda name, cells=cells: pc.struct_field(cells, name).to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.repeat(np.arange(len(sizes)), sizes)
            product = pc.struct_field(cells, "val").to_numpy(zero_copy_only=False)[:, None]
            for k, (name, held) in enumerate(operands):
                column, at = batch.column(2 + k), field(name)
                if held is not None:
                    product = product * held.value[(column.to_numpy()[own] << sb_bits) + at]
                    continue
                start = np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))][:-1]
                place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                rows = column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)
                product = product * rows[start[own] + np.where(sizes[own] > 1 << sb_bits, at, place)]
            i = (batch.column(1).to_numpy()[own] << sb_bits) + field(out)
            order = np.argsort(i, kind="stable")
            first = np.flatnonzero(np.diff(i[order], prepend=-1))
            total = np.add.reduceat(product[order], first, axis=0)
            if nrows is None:
                yield _rows(i[order][first], total)
                continue
            held_sums[i[order][first]] += total
            touched[i[order][first]] = True
        if nrows is not None and touched.any():
            at = np.flatnonzero(touched)
            yield _rows(at, held_sums[at])

    return run


def block_products(blocks: DataFrame, sb_bits: int, out: tuple[str, str], operands: Sequence[tuple[str, str, DataFrame, int, int]], rank: int, nrows: int) -> DataFrame:
    """(i, row) partial sums of value x operand rows over a task's blocks.

    ``out``: block column and entry field of the result's ``nrows`` rows; ``operands``:
    block column, entry field, rows (i, row), their number and size each.
    """
    df, asked, names = blocks, [], []
    bound = nrows if fits_broadcast(nrows, 8 * (rank + 4)) else None
    for k, (block, field, rows, size, row_bytes) in enumerate(operands):
        if fits_broadcast(size, row_bytes):
            asked.append((field, whole(rows, size, rank)))
            names.append(F.col(block).alias(f"_op{k}"))
            continue
        needed = F.when(F.size("entries") > (1 << sb_bits), F.col("_cells")).otherwise(F.transform(F.transform("entries", _place(field)), lambda j: F.get("_cells", j)))
        df = df.join(operand_blocks(rows, sb_bits, block, "_cells"), block).withColumn(f"_op{k}", needed).drop("_cells")
        asked.append((field, None))
        names.append(F.col(f"_op{k}"))
    return df.select("entries", F.col(out[0]).alias("_out"), *names).mapInArrow(_sums(sb_bits, out[1], asked, rank, bound), "i long, row array<double>")


def _all_rows(partial: DataFrame, nrows: int, rank: int, addend: DataFrame | None = None) -> DataFrame:
    from tensorloom.operators.products import rank_sums

    every = partial.sparkSession.range(nrows).select(F.col("id").alias("i"))
    rows = partial if addend is None else partial.unionByName(addend.select("i", "row"))
    return rank_sums(rows, ["i"], lambda r: F.get("row", F.lit(r)), rank, "row", every)


def mttkrp_blocks(x: HiCOOTensor, factors: Sequence[DenseMatrix], mode: int) -> DenseMatrix:
    """Matricised tensor times Khatri-Rao product; rows without a nonzero are zero."""
    check_mode(mode, x.nmodes)
    if len(factors) != x.nmodes:
        raise ShapeMismatchError(f"{len(factors)} factors for {x.nmodes} modes")
    ranks = {f.ncols for f in factors}
    if len(ranks) != 1:
        raise ShapeMismatchError(f"factors of {sorted(ranks)} columns")
    for k, f in enumerate(factors):
        if k != mode and f.nrows != x.dims[k]:
            raise ShapeMismatchError(f"mode {k} has size {x.dims[k]}, the factor {f.nrows} rows")
    rank = ranks.pop()
    operands = [(f"b{k}", f"e{k}", f.df, f.nrows, f.row_bytes) for k, f in enumerate(factors) if k != mode]
    partial = block_products(x.df.select(*[f"b{k}" for k in range(x.nmodes)], "entries"), x.sb_bits, (f"b{mode}", f"e{mode}"), operands, rank, x.dims[mode])
    return DenseMatrix(_all_rows(partial, x.dims[mode], rank), x.dims[mode], rank)


def vector_blocks_product(a: HiCOOMatrix, x: Vector, y0: Vector | None = None) -> Vector:
    """a x, plus y0 if given, for a blocked matrix; every row is there."""
    as_rows = lambda v: v.df.select("i", F.array("val").alias("row"))
    partial = block_products(a.df.select("bi", "bj", "entries"), a.sb_bits, ("bi", "ei"), [("bj", "ej", as_rows(x), x.size, 40)], 1, a.nrows)
    sums = _all_rows(partial, a.nrows, 1, None if y0 is None else as_rows(y0))
    return Vector(sums.select("i", F.get("row", F.lit(0)).alias("val")), a.nrows)


def matrix_blocks_product(a: HiCOOMatrix, b: DenseMatrix, c0: DenseMatrix | None = None) -> DenseMatrix:
    """a b with dense b, plus c0 if given, for a blocked matrix; every row is there."""
    partial = block_products(a.df.select("bi", "bj", "entries"), a.sb_bits, ("bi", "ei"), [("bj", "ej", b.df, b.nrows, b.row_bytes)], b.ncols, a.nrows)
    return DenseMatrix(_all_rows(partial, a.nrows, b.ncols, None if c0 is None else c0.df), a.nrows, b.ncols)
