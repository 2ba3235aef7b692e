"""Layouts of tensors: semi-sparse, blocked, dense and unfolded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.functions import bits as B
from tensorloom.functions.ieee import significant
from tensorloom.types import (
    CSRMatrix,
    DenseMatrix,
    HiCOOTensor,
    SemiSparseTensor,
    ShapeMismatchError,
    SparseMatrix,
    SparseTensor,
    ValueRangeError,
    check_mode,
    checked_product,
    coords,
)


def _stored(x: SparseTensor, mode: int) -> DataFrame:
    """The other modes' coordinates and ``cells`` (k, val) of their fiber, ascending; x has no duplicates."""
    own = F.col(f"i{mode}").alias("k"), F.coalesce("val", F.lit(0.0)).alias("val")
    cells = F.sort_array(F.collect_list(F.struct(*own)))
    inside = F.filter(cells, lambda e: (e["k"] >= 0) & (e["k"] < x.dims[mode]))
    return x.df.groupBy(*[c for c in x.modes if c != f"i{mode}"]).agg(inside.alias("cells"))


def _fiber(width: int) -> Column:
    """Column ``cells`` with the zeros between: each value follows its gap, so time is in proportion to the width."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    after = lambda e: F.coalesce(e["k"] + 1, F.lit(0))
    pieces = F.transform("cells", lambda e, n: F.concat(zeros(e["k"] - after(F.get("cells", n - 1))), F.array(e["val"])))
    return F.concat(F.flatten(pieces), zeros(F.lit(width) - after(F.try_element_at("cells", F.lit(-1)))))


def _of_stored(cells: DataFrame, dims: tuple[int, ...], mode: int) -> SemiSparseTensor:
    others = [c for m, c in enumerate(coords(len(dims))) if m != mode]
    return SemiSparseTensor(cells.select(*others, _fiber(dims[mode]).alias("fiber")), dims, mode, cells)


def to_semi_sparse(x: SparseTensor, mode: int) -> SemiSparseTensor:
    """One dense fiber for each coordinate of the other modes that has an entry; duplicates are summed."""
    check_mode(mode, x.nmodes)
    if x.nmodes < 2:
        raise ShapeMismatchError("a semi-sparse tensor has two modes or more")
    return _of_stored(_stored(x.coalesce(), mode), x.dims, mode)


def set_mode(y: SemiSparseTensor, mode: int, epsilon: float = 0.0) -> SemiSparseTensor:
    """Another dense mode."""
    x = to_coo(y, epsilon)
    if y.stored is None:
        return to_semi_sparse(x, mode)
    check_mode(mode, x.nmodes)
    return _of_stored(_stored(x, mode), x.dims, mode)


def fiber_sums(y: SemiSparseTensor, weight: Callable[[Column], Column]) -> DataFrame:
    """The other modes' coordinates, ``n`` (length of a fiber) and ``total``: the sum of each fiber's values times the finite weight of their place.

    Zeros add nothing: where the cells are stored, fibers are not formed.
    """
    n = F.lit(y.dims[y.mode]).cast("long").alias("n")
    if y.stored is None:
        total = F.aggregate(F.transform("fiber", lambda v, k: v * weight(k)), F.lit(0.0), lambda s, v: s + v)
        return y.df.select(*y.others, n, total.alias("total"))
    total = F.aggregate("cells", F.lit(0.0), lambda s, e: s + e["val"] * weight(e["k"]))
    return y.stored.select(*y.others, n, total.alias("total"))


def append_element(y: SemiSparseTensor, at: tuple[int, ...], value: float) -> SemiSparseTensor:
    """With one element set; an entry already there is replaced."""
    if len(at) != len(y.dims) or any(not 0 <= i < d for i, d in zip(at, y.dims, strict=True)):
        raise ShapeMismatchError(f"{at} in {y.dims}")
    spark = y.df.sparkSession
    old = to_coo(y, 0.0).df
    here = F.lit(True)
    for m, i in enumerate(at):
        here = here & (F.col(f"i{m}") == i)
    one = SparseTensor.from_rows(spark, [(*at, value)], y.dims).df
    return to_semi_sparse(SparseTensor(old.filter(~here).unionByName(one), y.dims), y.mode)


def to_hicoo(x: SparseTensor, sb_bits: int, sk_bits: int, sc_bits: int | None = None) -> HiCOOTensor:
    """Blocks of 2^sb_bits indices a mode, in kernels of 2^sk_bits; entries of a block in Z-order.

    A chunk is the running number of entries of its kernel, in blocks' order,
    over 2^sc_bits; the running sum is taken within a kernel, so kernels stay
    independent tasks.
    """
    sc_bits = sk_bits if sc_bits is None else sc_bits
    if not 0 < sb_bits <= min(sk_bits, sc_bits) or sb_bits > 15:
        raise ValueRangeError(f"bits {sb_bits}, {sk_bits}, {sc_bits}")
    n = x.nmodes
    offsets = [B.offset(F.col(c), sb_bits) for c in x.modes]
    entry = F.struct(*B.morton_words(offsets, sb_bits), *[o.cast("short").alias(f"e{m}") for m, o in enumerate(offsets)], F.col("val").alias("val"))
    blocked = [B.block(F.col(c), sb_bits).alias(f"b{m}") for m, c in enumerate(x.modes)]
    names = [f"b{m}" for m in range(n)]
    dealt = x.df.repartition(*blocked)  # plain rows move, not lists of entries
    blocks = dealt.groupBy(*blocked).agg(F.array_sort(F.collect_list(entry)).alias("sorted"))
    plain = F.transform("sorted", lambda e: F.struct(*[e[f"e{m}"].alias(f"e{m}") for m in range(n)], e["val"].alias("val")))
    kernels = [B.block(F.col(b), sk_bits - sb_bits).alias(f"k{m}") for m, b in enumerate(names)]
    blocks = blocks.select(*kernels, *names, plain.alias("entries"))
    levels = max(1, sk_bits - sb_bits)
    inside = [B.offset(F.col(f"b{m}"), levels) for m in range(n)]
    order = Window.partitionBy(*[f"k{m}" for m in range(n)]).orderBy(*B.morton_words(inside, levels)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("entries")).over(order), F.lit(0))
    return HiCOOTensor(blocks.withColumn("chunk", F.shiftright(before.cast("long"), sc_bits)), x.dims, sb_bits, sk_bits, sc_bits)


def to_coo(y: SemiSparseTensor | HiCOOTensor, epsilon: float = 1e-9) -> SparseTensor:
    """Coordinates of a semi-sparse tensor (values of at least ``epsilon``, NaN and infinities) or of a blocked one (all)."""
    if isinstance(y, SemiSparseTensor) and y.stored is not None:
        cells = y.stored.select(*y.others, F.explode("cells").alias("e")).select(*y.others, F.col("e.k").alias(f"i{y.mode}"), F.col("e.val").alias("val"))
        return SparseTensor(cells.filter(significant(F.col("val"), epsilon)).select(*coords(len(y.dims)), "val"), y.dims)
    if isinstance(y, SemiSparseTensor):
        cells = y.df.select(*y.others, F.posexplode("fiber").alias("pos", "val"))
        cells = cells.filter(significant(F.col("val"), epsilon)).withColumn(f"i{y.mode}", F.col("pos").cast("long"))
        return SparseTensor(cells.select(*coords(len(y.dims)), "val"), y.dims)
    n = y.nmodes
    cells = y.df.select(*[f"b{m}" for m in range(n)], F.explode("entries").alias("e"))
    index = [(F.shiftleft(F.col(f"b{m}"), y.sb_bits) + F.col(f"e.e{m}").cast("long")).alias(f"i{m}") for m in range(n)]
    return SparseTensor(cells.select(*index, F.col("e.val").alias("val")), y.dims)


def to_dense(x: SparseTensor) -> DenseMatrix:
    """A two-mode tensor as a dense matrix. Rows are formed one by one after the join with all indices, which moves and sorts cells only."""
    if x.nmodes != 2:
        raise ShapeMismatchError(f"{x.nmodes} modes")
    cells = _stored(x.coalesce(), 1).withColumnRenamed("i0", "i")
    full = x.spark.range(x.dims[0]).select(F.col("id").alias("i")).join(cells, "i", "left")
    none = F.array().cast("array<struct<k: bigint, val: double>>")
    full = full.select("i", F.coalesce("cells", none).alias("cells"))
    return DenseMatrix(full.select("i", _fiber(x.dims[1]).alias("row")), *x.dims)


def semi_sparse_to_csr(y: SemiSparseTensor) -> CSRMatrix:
    """One matrix row a fiber, in the fibers' order, zeros kept."""
    from tensorloom.functions.ranks import row_numbers

    width = y.dims[y.mode]
    rows = row_numbers(y.df, [F.col(c) for c in y.others], "i")
    cols = F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))
    df = rows.select("i", (F.col("i") * width).alias("rowptr"), cols.alias("cols"), F.col("fiber").alias("vals"))
    return CSRMatrix(df, y.df.count(), width)


def unfolding_order(nmodes: int, mode: int) -> list[int]:
    """The other modes of an unfolding, the last fastest."""
    return [(mode + k) % nmodes for k in range(1, nmodes)]


def matricize(x: SparseTensor, mode: int, transpose: int = 1) -> SparseMatrix:
    """Unfolding: the mode on the rows (transpose 1) or on the columns (0)."""
    check_mode(mode, x.nmodes)
    if transpose not in (0, 1):
        raise ValueRangeError(f"transpose {transpose}")
    order = unfolding_order(x.nmodes, mode)
    width, other = 1, F.lit(0).cast("long")
    for m in reversed(order):
        other = F.col(f"i{m}") * F.lit(width) + other
        width = checked_product(width, x.dims[m])
    row, col = (F.col(f"i{mode}"), other) if transpose else (other, F.col(f"i{mode}"))
    shape = (x.dims[mode], width) if transpose else (width, x.dims[mode])
    return SparseMatrix(x.df.select(row.alias("i"), col.alias("j"), "val"), *shape)


def shuffle_modes(x: SparseTensor, order: list[int]) -> SparseTensor:
    """Modes in another order: mode m of the result is order[m] of x."""
    if sorted(order) != list(range(x.nmodes)):
        raise ShapeMismatchError(f"order {order}")
    return SparseTensor(x.df.select(*[F.col(f"i{m}").alias(f"i{k}") for k, m in enumerate(order)], "val"), tuple(x.dims[m] for m in order))


def fibers(x: SparseTensor, mode: int):
    """Distinct coordinates of the other modes with their number of entries and the entries before them."""
    from tensorloom.functions.ranks import row_numbers, running_totals

    others = [c for c in x.modes if c != f"i{mode}"]
    counted = row_numbers(x.df.groupBy(*others).agg(F.count("*").alias("n")), [F.col(c) for c in others], "fiber")
    step = 4096  # running sums are taken by runs of fibers, then the runs' totals are added
    runs = counted.withColumn("run", F.floor(F.col("fiber") / step))
    totals = runs.groupBy("run").agg(F.sum("n").alias("total"))
    before = running_totals(totals, [F.col("run")], "total", "upto").select("run", (F.col("upto") - F.col("total")).alias("base"))
    own = F.sum("n").over(Window.partitionBy("run").orderBy("fiber").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("own", F.coalesce(own, F.lit(0))).join(before, "run").select(*others, "n", (F.coalesce("base", F.lit(0)) + F.col("own")).alias("start"))
