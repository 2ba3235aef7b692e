"""Sparse matrices: layouts, products, sorts and relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.functions import bits as B
from tensorloom.functions.ranks import running_totals
from tensorloom.operators.blocked import matrix_blocks_product, vector_blocks_product
from tensorloom.operators.products import rank_sums
from tensorloom.types import CSRMatrix, DenseMatrix, HiCOOMatrix, ShapeMismatchError, SparseMatrix, ValueRangeError, Vector, fits_broadcast

#: A dense operand of declared size up to this is one array in one row.
WHOLE_BYTES = 8 << 20
#: Fewer runs of rows than this, by the declared shape, are summed in one task.
FEW_RUNS = 100_000
AnyMatrix = SparseMatrix | CSRMatrix | HiCOOMatrix


def to_coo(a: AnyMatrix) -> SparseMatrix:
    """Coordinates of a matrix in any layout."""
    if isinstance(a, SparseMatrix):
        return a
    if isinstance(a, CSRMatrix):
        cells = a.df.select("i", F.explode(F.arrays_zip("cols", "vals")).alias("e"))
        return SparseMatrix(cells.select("i", F.col("e.cols").alias("j"), F.col("e.vals").alias("val")), a.nrows, a.ncols)
    cells = a.df.select("bi", "bj", F.explode("entries").alias("e"))
    index = lambda b, e: F.shiftleft(F.col(b), a.sb_bits) + F.col(f"e.{e}").cast("long")
    return SparseMatrix(cells.select(index("bi", "ei").alias("i"), index("bj", "ej").alias("j"), F.col("e.val").alias("val")), a.nrows, a.ncols)


def to_csr(a: SparseMatrix) -> CSRMatrix:
    """A row for each matrix row, columns ascending; rowptr counts the entries before it.

    Running sums go by runs of rows and then over the runs' totals.
    """
    rows = a.df.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "val"))).alias("cells"))
    empty = F.array().cast("array<struct<j:bigint,val:double>>")
    full = a.spark.range(a.nrows).select(F.col("id").alias("i")).join(rows, "i", "left").withColumn("cells", F.coalesce("cells", empty))
    sized = full.withColumns({"n": F.size("cells").cast("long"), "run": F.floor(F.col("i") / 4096)})
    own = F.coalesce(F.sum("n").over(Window.partitionBy("run").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.select(F.floor(F.col("i") / 4096).alias("run"), F.size("cells").alias("n")).groupBy("run").agg(F.sum("n").alias("total"))
    runs = a.spark.range(a.nrows // 4096 + 1).select(F.col("id").alias("run")).join(totals, "run", "left").fillna(0, ["total"])
    if a.nrows // 4096 < FEW_RUNS:
        runs = runs.withColumn("upto", F.sum("total").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        runs = running_totals(runs, [F.col("run")], "total", "upto")
    base = runs.select("run", (F.col("upto") - F.col("total")).alias("base"))
    out = sized.withColumn("own", own).join(base, "run")
    return CSRMatrix(out.select("i", (F.col("base") + F.col("own")).alias("rowptr"), F.col("cells.j").alias("cols"), F.col("cells.val").alias("vals")), a.nrows, a.ncols)


def to_hicoo(a: SparseMatrix, sb_bits: int, sk_bits: int) -> HiCOOMatrix:
    """Blocks of 2^sb_bits rows and columns in kernels of 2^sk_bits; entries in Z-order."""
    if not 0 < sb_bits <= sk_bits or sb_bits > 15:
        raise ValueRangeError(f"bits {sb_bits}, {sk_bits}")
    keys = [shift(F.col(c), n).alias(name) for shift, n, name, c in ((B.block, sk_bits, "ki", "i"), (B.block, sk_bits, "kj", "j"), (B.block, sb_bits, "bi", "i"), (B.block, sb_bits, "bj", "j"))]
    ei, ej = B.offset(F.col("i"), sb_bits), B.offset(F.col("j"), sb_bits)
    entry = F.struct(B.morton_key([ei, ej], sb_bits).alias("z"), ei.cast("short").alias("ei"), ej.cast("short").alias("ej"), F.col("val").alias("val"))
    blocks = a.df.select(*keys, entry.alias("entry")).groupBy("ki", "kj", "bi", "bj").agg(F.array_sort(F.collect_list("entry")).alias("sorted"))
    plain = F.transform("sorted", lambda e: F.struct(e["ei"].alias("ei"), e["ej"].alias("ej"), e["val"].alias("val")))
    return HiCOOMatrix(blocks.select("ki", "kj", "bi", "bj", plain.alias("entries")), a.nrows, a.ncols, sb_bits, sk_bits)


def to_dense(a: AnyMatrix) -> DenseMatrix:
    return to_coo(a).as_tensor().to_dense()


def convert(a: AnyMatrix, kind: str, **bits):
    """To "coo", "csr", "hicoo" (sb_bits, sk_bits) or "dense"."""
    own = to_coo(a)
    made = {"coo": lambda: own, "csr": lambda: to_csr(own), "hicoo": lambda: to_hicoo(own, bits.get("sb_bits", 7), bits.get("sk_bits", 20)), "dense": lambda: to_dense(own)}
    if kind not in made:
        raise ValueRangeError(f"layout {kind}")
    return made[kind]()


def _whole(df: DataFrame, cell: str) -> DataFrame:
    """All rows (i and ``cell``) as one array in one row, for a broadcast: of shapes that are known to be small."""
    ordered = F.array_sort(F.collect_list(F.struct("i", cell)))
    return F.broadcast(df.agg(F.transform(ordered, lambda c: c[cell]).alias("_all")))


def _by_rows(term) -> Column:
    """Sum of ``term`` (value, what is at its column) over a row's entries: rows stay where they are."""
    return F.aggregate(F.zip_with("cols", "vals", lambda j, v: term(v, F.get("_all", j.cast("int")))), F.lit(0.0), lambda s, t: s + t)


def multiply_vector(a: AnyMatrix, x: Vector, y0: Vector | None = None) -> Vector:
    """a x, plus y0 if given; every row is there.

    Compressed rows are summed in place if the vector's size allows to send it
    whole, blocked matrices block by block.
    """
    if a.ncols != x.size:
        raise ShapeMismatchError(f"{a.ncols} columns, vector of {x.size}")
    if isinstance(a, HiCOOMatrix):
        if y0 is not None and y0.size != a.nrows:
            raise ShapeMismatchError(f"{a.nrows} rows, addend of {y0.size}")
        return vector_blocks_product(a, x, y0)
    if isinstance(a, CSRMatrix) and fits_broadcast(x.size, 8, WHOLE_BYTES):
        if y0 is not None and y0.size != a.nrows:
            raise ShapeMismatchError(f"{a.nrows} rows, addend of {y0.size}")
        whole = _whole(x.df, "val")
        sums = a.df.crossJoin(whole).select("i", _by_rows(lambda v, u: v * u).alias("val"))
        return Vector(sums if y0 is None else sums.unionByName(y0.df.select("i", "val")).groupBy("i").agg(F.sum("val").alias("val")), a.nrows)
    own = to_coo(a).df.join(x.small().select(F.col("i").alias("j"), F.col("val").alias("_x")), "j")
    sums = own.select("i", (F.col("val") * F.col("_x")).alias("val"))
    if y0 is not None and y0.size != a.nrows:
        raise ShapeMismatchError(f"{a.nrows} rows, addend of {y0.size}")
    # The addend, or zeros, join the aggregation: every row is there without a join.
    rest = a.df.sparkSession.range(a.nrows).select(F.col("id").alias("i"), F.lit(0.0).alias("val")) if y0 is None else y0.df
    return Vector(sums.unionByName(rest).groupBy("i").agg(F.sum("val").alias("val")), a.nrows)


def multiply_matrix(a: AnyMatrix, b: DenseMatrix, c0: DenseMatrix | None = None) -> DenseMatrix:
    """a b with dense b, plus c0 if given; every row is there."""
    if a.ncols != b.nrows:
        raise ShapeMismatchError(f"{a.ncols} columns, {b.nrows} rows")
    if isinstance(a, HiCOOMatrix):
        if c0 is not None and (c0.nrows, c0.ncols) != (a.nrows, b.ncols):
            raise ShapeMismatchError(f"addend of {c0.nrows} x {c0.ncols}")
        return matrix_blocks_product(a, b, c0)
    if isinstance(a, CSRMatrix) and c0 is None and fits_broadcast(b.nrows, b.row_bytes, WHOLE_BYTES):
        whole = _whole(b.df, "row")
        cells = [_by_rows(lambda v, u, r=r: v * F.get(u, F.lit(r))) for r in range(b.ncols)]
        return DenseMatrix(a.df.crossJoin(whole).select("i", F.array(*cells).alias("row")), a.nrows, b.ncols)
    own = to_coo(a).df.join(b.small().select(F.col("i").alias("j"), "row"), "j").select("i", "val", "row")
    if c0 is not None:
        if (c0.nrows, c0.ncols) != (a.nrows, b.ncols):
            raise ShapeMismatchError(f"addend of {c0.nrows} x {c0.ncols}")
        own = own.unionByName(c0.df.select("i", F.lit(1.0).alias("val"), "row"))
    every = a.df.sparkSession.range(a.nrows).select(F.col("id").alias("i"))
    return DenseMatrix(rank_sums(own, ["i"], lambda r: F.col("val") * F.get("row", F.lit(r)), b.ncols, "row", every), a.nrows, b.ncols)


def multiply_vector_buff(a: AnyMatrix, x: Vector, y0: Vector | None = None) -> Vector:
    """multiply_vector: partial aggregation stands in for private buffers."""
    return multiply_vector(a, x, y0)


def row_block_keys(a: SparseMatrix, bits: int) -> DataFrame:
    return a.df.withColumns({"bi": B.block(F.col("i"), bits), "bj": B.block(F.col("j"), bits)})


def sort(a: SparseMatrix, kind: str = "row", bits: int = 7) -> SparseMatrix:
    """By "row", "column", row-major "block", or "morton": block row-major, then Z-order inside."""
    block = [B.block(F.col("i"), bits), B.block(F.col("j"), bits)]
    inside = [B.offset(F.col("i"), bits), B.offset(F.col("j"), bits)]
    orders = {"row": [F.col("i")], "column": [F.col("j")], "block": block, "morton": [*block, *B.morton_words(inside, bits)]}
    if kind not in orders:
        raise ValueRangeError(f"order {kind}")
    return SparseMatrix(a.df.orderBy(*orders[kind], "i", "j"), a.nrows, a.ncols)


def relabel(a: SparseMatrix, rows: DataFrame, cols: DataFrame) -> SparseMatrix:
    """New indices by maps (old, new)."""
    t = a.as_tensor().relabel([rows, cols])
    return SparseMatrix(t.df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), "val"), a.nrows, a.ncols)


def reorder(a: SparseMatrix, kind: str = "lexi", iterations: int = 1, seed: int = 0) -> tuple[SparseMatrix, list[DataFrame]]:
    """Relabelled by "lexi", "bfs" or "random" order, and the maps."""
    t, maps = a.as_tensor().reorder_by(kind, iterations, seed)
    return SparseMatrix(t.df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), "val"), a.nrows, a.ncols), maps
