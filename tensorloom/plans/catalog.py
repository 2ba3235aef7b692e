"""Registry of the tensor queries and of their SQL.

Results are flat rows: coordinates or row and rank as longs, values as doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions import bits
from tensorloom.functions.ranks import row_numbers
from tensorloom.operators import cpd, dense, layout, reorder, vectors
from tensorloom.plans.inputs import C2_SQL, M_SQL, N2_SQL, PART_SQL, SHIFTED_SQL, SUPPLIER_SQL, T3_SQL, T3B_SQL, T4_SQL, c2, m2, n2, ramps, shifted, t3, t3b, t4, table, totals
from tensorloom.types import SparseTensor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RANK = 2
RS = "(SELECT 0 AS r UNION ALL SELECT 1 AS r)"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _long(a) -> DataFrame:
    return dense.long_form(a)


def _rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _semi(y) -> DataFrame:
    """A semi-sparse tensor as one row a cell."""
    cells = y.df.select(*y.others, F.posexplode("fiber").alias("r", "val"))
    return cells.select(*y.others, F.col("r").cast("long").alias("r"), "val")


# --- element-wise and scalar --------------------------------------------------

B = f"WITH x AS ({T3B_SQL}), y AS ({SHIFTED_SQL}) "


def _two(spark, sf, coalesce: bool = True) -> tuple[SparseTensor, SparseTensor]:
    return t3b(spark, sf, coalesce), shifted(spark, sf, coalesce)


@query(B + "SELECT i0, i1, i2, SUM(val) AS val FROM (SELECT * FROM x UNION ALL SELECT * FROM y) u GROUP BY 1, 2, 3 HAVING SUM(val) <> 0")
def tensor_add(spark, sf):
    x, y = _two(spark, sf, coalesce=False)
    return x.add(y).df


@query(B + "SELECT i0, i1, i2, SUM(val) AS val FROM (SELECT * FROM x UNION ALL SELECT i0, i1, i2, -val FROM y) u GROUP BY 1, 2, 3 HAVING SUM(val) <> 0")
def tensor_sub(spark, sf):
    x, y = _two(spark, sf, coalesce=False)
    return x.sub(y).df


@query(B + "SELECT x.i0, x.i1, x.i2, x.val * y.val AS val FROM x JOIN y ON x.i0 = y.i0 AND x.i1 = y.i1 AND x.i2 = y.i2 WHERE x.val * y.val <> 0")
def tensor_dot_mul(spark, sf):
    x, y = _two(spark, sf)
    return x.dot_mul(y).df


@query(f"WITH t AS ({T3B_SQL}) SELECT i0, i1, i2, val * 3 * val AS val FROM t WHERE val <> 0")
def tensor_dot_mul_eq(spark, sf):
    t = t3b(spark, sf)
    return t.dot_mul_eq(t.mul_scalar(3)).df


@query(B + "SELECT x.i0, x.i1, x.i2, x.val / y.val AS val FROM x JOIN y ON x.i0 = y.i0 AND x.i1 = y.i1 AND x.i2 = y.i2")
def tensor_dot_div(spark, sf):
    x, y = _two(spark, sf)
    return x.dot_div(y).df


@query(f"WITH t AS ({T3_SQL}) SELECT i0, i1, i2, val * 3 AS val FROM t")
def scalar_mul(spark, sf):
    return t3(spark, sf).mul_scalar(3).df


@query(f"WITH t AS ({T3_SQL}) SELECT i0, i1, i2, val FROM t WHERE 1 = 0")
def scalar_mul_zero(spark, sf):
    return t3(spark, sf).mul_scalar(0).df


@query(f"WITH t AS ({T3_SQL}) SELECT i0, i1, i2, val / 4 AS val FROM t")
def scalar_div(spark, sf):
    return t3(spark, sf).div_scalar(4).df


@query(f"WITH t AS ({T3B_SQL}) SELECT i0, i1, i2, val - 25 AS val FROM t WHERE val <> 25")
def collect_zeros(spark, sf):
    t = t3b(spark, sf)
    return t.with_df(t.df.withColumn("val", F.col("val") - 25)).collect_zeros().df


# --- slices, bounds, modes ----------------------------------------------------


@query(f"WITH t AS ({T3B_SQL}) SELECT * FROM t WHERE i0 >= 10 AND i0 < 150 AND i1 >= 2 AND i1 < 60 AND i2 < 4")
def slice_range(spark, sf):
    return t3b(spark, sf).slice([10, 2, 0], [150, 60, 4]).df


@query(f"WITH t AS ({T3B_SQL}) SELECT p.p_partkey AS i, COUNT(t.i0) AS nnz FROM part p LEFT JOIN t ON t.i0 = p.p_partkey GROUP BY 1")
def slice_sizes(spark, sf):
    return t3b(spark, sf).slice_sizes(0)


@query(f"WITH t AS ({T3B_SQL}) SELECT MIN(i0) AS lo0, MAX(i0) + 1 AS hi0, MIN(i1) AS lo1, MAX(i1) + 1 AS hi1, MIN(i2) AS lo2, MAX(i2) + 1 AS hi2 FROM t")
def index_bounds(spark, sf):
    return t3b(spark, sf).index_bounds()


@query(f"WITH t AS ({T3B_SQL}) SELECT i2 AS i0, i0 AS i1, i1 AS i2, val FROM t")
def shuffle_modes(spark, sf):
    return t3b(spark, sf).shuffle_modes([2, 0, 1]).df


@query(f"WITH t AS ({T3B_SQL}), g AS (SELECT i0, i1, COUNT(*) AS n FROM t GROUP BY 1, 2) SELECT i0, i1, n, CAST(SUM(n) OVER (ORDER BY i0, i1 ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS start FROM g")
def fibers(spark, sf):
    return layout.fibers(t3b(spark, sf), 2)


# --- products -----------------------------------------------------------------


@query(f"WITH t AS ({T3_SQL}) SELECT CAST(0 AS BIGINT) AS i0, i1, i2, SUM(val * (i0 % 7 + 1)) AS val FROM t GROUP BY i1, i2")
def ttv(spark, sf):
    t = t3(spark, sf, coalesce=False)
    v = vectors.Vector(spark.range(t.dims[0]).select(F.col("id").alias("i"), (F.col("id") % 7 + 1).cast("double").alias("val")), t.dims[0])
    return t.ttv(v, 0).df


TTM = f"WITH t AS ({T3B_SQL}) SELECT i0, i1, CAST(r AS BIGINT) AS r, SUM(val * (i2 + r + 1)) AS val FROM t, {RS} rs GROUP BY i0, i1, r"


@query(TTM)
def ttm(spark, sf):
    t = t3b(spark, sf, coalesce=False)
    return _semi(t.ttm(dense.ramp(spark, t.dims[2], RANK), 2))


@query(TTM)
def ttm_hicoo(spark, sf):
    t = t3b(spark, sf)
    return _semi(t.to_hicoo(3, 6).ttm_hicoo(dense.ramp(spark, t.dims[2], RANK), 2))


@query(f"WITH t AS ({T3B_SQL}), y AS (SELECT i0, i1, q.r AS q, SUM(val * (i2 + q.r + 1)) AS val FROM t, {RS} q GROUP BY 1, 2, 3) SELECT i0, i1, CAST(s.r AS BIGINT) AS r, SUM(val * (q + s.r + 1)) AS val FROM y, {RS} s GROUP BY i0, i1, s.r")
def ttm_semisparse(spark, sf):
    t = t3b(spark, sf, coalesce=False)
    return _semi(t.ttm(dense.ramp(spark, t.dims[2], RANK), 2).ttm_semi_sparse(dense.ramp(spark, RANK, RANK), 2))


@query(f"WITH t AS ({T3B_SQL}) SELECT i0, CAST(a.r AS BIGINT) AS i1, CAST(b.r AS BIGINT) AS i2, SUM(val * (i1 + a.r + 1) * (i2 + b.r + 1)) AS val FROM t, {RS} a, {RS} b GROUP BY i0, a.r, b.r")
def ttm_chain(spark, sf):
    t = t3b(spark, sf, coalesce=False)
    return t.ttm_chain({1: dense.ramp(spark, t.dims[1], RANK), 2: dense.ramp(spark, t.dims[2], RANK)}).df


def _mttkrp_sql(base: str, mode: int, modes: int, domain: str) -> str:
    weights = " * ".join(f"(t.i{k} + r + 1)" for k in range(modes) if k != mode)
    return f"WITH t AS ({base}), d AS ({domain}) SELECT d.i, CAST(r AS BIGINT) AS r, COALESCE(SUM(t.val * {weights}), 0) AS val FROM d CROSS JOIN {RS} rs LEFT JOIN t ON t.i{mode} = d.i GROUP BY d.i, r"


ORDERS, PARTS, SUPPLIERS = "SELECT o_orderkey AS i FROM orders", "SELECT p_partkey AS i FROM part", "SELECT s_suppkey AS i FROM supplier"


@query(_mttkrp_sql(T3_SQL, 0, 3, ORDERS))
def mttkrp_mode0(spark, sf):
    t = t3(spark, sf, coalesce=False)
    return _long(t.mttkrp(ramps(spark, t.dims), 0))


@query(_mttkrp_sql(T3_SQL, 1, 3, PARTS))
def mttkrp_mode1(spark, sf):
    t = t3(spark, sf, coalesce=False)
    return _long(t.mttkrp(ramps(spark, t.dims), 1))


@query(_mttkrp_sql(T3_SQL, 2, 3, SUPPLIERS))
def mttkrp_mode2(spark, sf):
    t = t3(spark, sf, coalesce=False)
    return _long(t.mttkrp(ramps(spark, t.dims), 2))


@query(_mttkrp_sql(T4_SQL, 1, 4, SUPPLIERS))
def mttkrp_4d(spark, sf):
    t = t4(spark, sf, coalesce=False)
    return _long(t.mttkrp(ramps(spark, t.dims), 1))


@query(_mttkrp_sql(T3_SQL, 1, 3, PARTS))
def mttkrp_hicoo(spark, sf):
    t = t3(spark, sf)
    return _long(t.to_hicoo(7, 10).mttkrp(ramps(spark, t.dims), 1))


@query(f"WITH x AS ({T3_SQL}), y AS ({M_SQL}) SELECT x.i0, SUM(x.val * y.val) AS val FROM x JOIN y ON x.i1 = y.i AND x.i2 = y.j GROUP BY 1")
def contract(spark, sf):
    return t3(spark, sf, coalesce=False).contract(m2(spark, sf).as_tensor(), [1, 2], [0, 1]).df


PAIR = f"WITH a AS ({C2_SQL}), b AS ({N2_SQL}), n AS (SELECT (SELECT COUNT(*) FROM region) AS nr, (SELECT COUNT(*) FROM nation) AS nn) "
COUNTS = "(SELECT COUNT(*) FROM part) AS np, (SELECT COUNT(*) FROM supplier) AS ns"


@query(PAIR + "SELECT a.i0 * nr + b.i0 AS i0, a.i1 * nn + b.i1 AS i1, a.val * b.val AS val FROM a, b, n")
def kronecker(spark, sf):
    return c2(spark, sf).kronecker(n2(spark, sf)).df


@query(PAIR + "SELECT a.i0 * nr + b.i0 AS i0, a.i1, a.val * b.val AS val FROM a JOIN b ON a.i1 = b.i1, n")
def khatri_rao(spark, sf):
    return c2(spark, sf).khatri_rao(n2(spark, sf)).df


@query(f"WITH t AS ({T3B_SQL}) SELECT i1 AS i, i2 * np + i0 AS j, val FROM t, (SELECT COUNT(*) AS np FROM part) n")
def matricize_row(spark, sf):
    return t3b(spark, sf).matricize(1).df


@query(f"WITH t AS ({T3B_SQL}) SELECT i2 * np + i0 AS i, i1 AS j, val FROM t, (SELECT COUNT(*) AS np FROM part) n")
def matricize_col(spark, sf):
    return t3b(spark, sf).matricize(1, 0).df


SPMV = f"WITH m AS ({M_SQL}) SELECT p.p_partkey AS i, COALESCE(SUM(m.val * (m.j + 1)), 0) AS val FROM part p LEFT JOIN m ON m.i = p.p_partkey GROUP BY 1"
SPMM = f"WITH m AS ({M_SQL}) SELECT p.p_partkey AS i, CAST(r AS BIGINT) AS r, COALESCE(SUM(m.val * (m.j + r + 1)), 0) AS val FROM part p CROSS JOIN {RS} rs LEFT JOIN m ON m.i = p.p_partkey GROUP BY 1, r"


def _spmv(spark, sf, kind):
    a = m2(spark, sf, coalesce=False)
    x = vectors.Vector(spark.range(a.ncols).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("val")), a.ncols)
    return a.convert(kind, sb_bits=5, sk_bits=8).multiply_vector(x).df


def _spmm(spark, sf, kind):
    a = m2(spark, sf, coalesce=False)
    return _long(a.convert(kind, sb_bits=5, sk_bits=8).multiply_matrix(dense.ramp(spark, a.ncols, RANK)))


def _register(name: str, sql: str, make, kind: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = (lambda spark, sf: make(spark, sf, kind)), sql


for _kind in ("coo", "csr", "hicoo"):
    _register(f"spmv_{_kind}", SPMV, _spmv, _kind)
    _register(f"spmm_{_kind}", SPMM, _spmm, _kind)


# --- layouts ------------------------------------------------------------------


@query(f"WITH m AS ({M_SQL}), n AS (SELECT p.p_partkey AS i, COUNT(m.i) AS n FROM part p LEFT JOIN m ON m.i = p.p_partkey GROUP BY 1) SELECT i, CAST(SUM(n) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS rowptr, n FROM n")
def to_csr_rowptr(spark, sf):
    return m2(spark, sf).to_csr().df.select("i", "rowptr", F.size("cols").cast("long").alias("n"))


@query(f"WITH t AS ({T3B_SQL}), f AS (SELECT DISTINCT i0, i1 FROM t), k AS (SELECT DISTINCT CAST(l_linenumber - 1 AS BIGINT) AS r FROM lineitem) SELECT f.i0, f.i1, k.r, COALESCE(t.val, 0) AS val FROM f CROSS JOIN k LEFT JOIN t ON t.i0 = f.i0 AND t.i1 = f.i1 AND t.i2 = k.r")
def to_semisparse(spark, sf):
    return _semi(t3b(spark, sf).to_semi_sparse(2))


@query(f"WITH t AS ({T3B_SQL}) SELECT * FROM t WHERE val >= 30")
def from_semisparse(spark, sf):
    return t3b(spark, sf).to_semi_sparse(2).to_coo(30.0).df


@query(f"WITH t AS ({T3B_SQL}) SELECT * FROM t")
def semisparse_set_mode(spark, sf):
    return t3b(spark, sf).to_semi_sparse(2).set_mode(1).to_coo(0.0).df


@query(f"WITH c AS ({C2_SQL}), k AS (SELECT DISTINCT i0 FROM c) SELECT k.i0 AS i, CAST(n_nationkey AS BIGINT) AS r, COALESCE(c.val, 0) AS val FROM k CROSS JOIN nation LEFT JOIN c ON c.i0 = k.i0 AND c.i1 = n_nationkey")
def to_dense(spark, sf):
    return _long(c2(spark, sf).to_dense())


@query(f"WITH t AS ({T3B_SQL}) SELECT i0 // 8 AS b0, i1 // 8 AS b1, i2 // 8 AS b2, i0 // 64 AS k0, i1 // 64 AS k1, i2 // 64 AS k2, COUNT(*) AS nnz, SUM(val) AS total FROM t GROUP BY 1, 2, 3, 4, 5, 6")
def to_hicoo_blocks(spark, sf):
    h = t3b(spark, sf).to_hicoo(3, 6)
    total = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["val"])
    return h.df.select(*[f"b{m}" for m in range(3)], *[f"k{m}" for m in range(3)], F.size("entries").cast("long").alias("nnz"), total.alias("total"))


@query(f"WITH t AS ({T3B_SQL}) SELECT * FROM t")
def from_hicoo(spark, sf):
    return t3b(spark, sf).to_hicoo(3, 6).to_coo().df


@query(f"WITH m AS ({M_SQL}) SELECT i // 32 AS bi, j // 32 AS bj, COUNT(*) AS nnz FROM m GROUP BY 1, 2")
def hicoo_matrix_blocks(spark, sf):
    return m2(spark, sf).to_hicoo(5, 8).df.select("bi", "bj", F.size("entries").cast("long").alias("nnz"))


@query(f"WITH t AS ({T3B_SQL}), b AS (SELECT i0 // 64 AS k0, i1 // 64 AS k1, i0 // 8 AS b0, i1 // 8 AS b1, COUNT(*) AS n FROM t GROUP BY 1, 2, 3, 4), k AS (SELECT k0, k1, SUM(n) AS kn FROM b GROUP BY 1, 2) SELECT (SELECT COUNT(*) FROM b) AS nb, (SELECT COUNT(*) FROM k) AS nk, CAST((SELECT SUM(n) FROM b) AS BIGINT) AS nnz, CAST((SELECT MAX(kn) FROM k) AS BIGINT) AS max_nnzk, CAST((SELECT MIN(kn) FROM k) AS BIGINT) AS min_nnzk, (SELECT MAX(n) FROM b) AS max_nnzb, (SELECT MIN(n) FROM b) AS min_nnzb")
def hicoo_status(spark, sf):
    found = t3b(spark, sf).to_hicoo(3, 6).hicoo_status()
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("nb", "nk", "nnz", "max_nnzk", "min_nnzk", "max_nnzb", "min_nnzb")])


# --- keys and orders ----------------------------------------------------------

Z = " + ".join(f"((i{m} >> {b}) & 1) * {1 << (3 * b + 2 - m)}" for m in range(3) for b in range(18))


@query(f"WITH t AS ({T3_SQL}) SELECT i0, i1, i2, CAST({Z} AS BIGINT) AS z FROM t")
def morton_key_3d(spark, sf):
    return t3(spark, sf).df.select("i0", "i1", "i2", bits.morton_key([F.col(f"i{m}") for m in range(3)], 18).alias("z"))


@query(f"WITH t AS ({T3_SQL}) SELECT i0, i1, i2, val, i0 // 128 AS k0, i1 // 128 AS k1, i2 // 128 AS k2 FROM t")
def rowblock_key(spark, sf):
    return t3(spark, sf).row_block_key(7)


ZIN = " + ".join(f"((i{m} >> {b}) & 1) * {1 << (3 * b + 2 - m)}" for m in range(3) for b in range(6))


@query(f"WITH t AS ({T3B_SQL}), z AS (SELECT *, {ZIN} AS z FROM t) SELECT i0, i1, i2, ROW_NUMBER() OVER (ORDER BY i0 // 64, i1 // 64, i2 // 64, z) - 1 AS rn FROM z")
def mixed_order(spark, sf):
    from tensorloom.operators.sorting import mixed_order_keys

    t = t3b(spark, sf)
    return row_numbers(t.df.select(*t.modes), mixed_order_keys(t, 3, 6))


@query(f"WITH t AS ({T3B_SQL}) SELECT i0, i1, i2, ROW_NUMBER() OVER (ORDER BY i1, i2, i0) - 1 AS rn FROM t")
def sort_custom_order(spark, sf):
    t = t3b(spark, sf)
    return row_numbers(t.df.select(*t.modes), [F.col("i1"), F.col("i2"), F.col("i0")])


# --- norms, statistics, dense algebra ------------------------------------------


@query(f"WITH t AS ({T3_SQL}) SELECT SUM(val * val) AS norm_sq, SQRT(SUM(val * val)) AS norm FROM t")
def frob_norm_sq(spark, sf):
    t = t3(spark, sf)
    return t.df.agg(F.sum(F.col("val") * F.col("val")).alias("norm_sq")).select("norm_sq", F.sqrt("norm_sq").alias("norm"))


@query(f"WITH t AS ({T3B_SQL}) SELECT COUNT(*) AS nnz, COUNT(*) * 32 AS bytes, (SELECT COUNT(*) FROM part) AS d0, (SELECT COUNT(*) FROM supplier) AS d1, CAST(7 AS BIGINT) AS d2 FROM t")
def status_coo(spark, sf):
    st = t3b(spark, sf).status()
    return _rows(spark, [(st["nnz"], st["bytes"], *st["dims"])], "nnz long, bytes long, d0 long, d1 long, d2 long")


@query(f"WITH t AS ({T3B_SQL}) SELECT ROUND(COUNT(*) / ((SELECT COUNT(*) FROM part) * (SELECT COUNT(*) FROM supplier) * 7.0), 9) AS density FROM t")
def density(spark, sf):
    return _rows(spark, [(round(t3b(spark, sf).density(), 9),)], "density double")


#: Quantity (r = 0) and number of lines (r = 1) of each part, one row a cell.
PARTS_LONG = f"c AS (SELECT i, CAST(r AS BIGINT) AS r, CASE r WHEN 0 THEN x ELSE y END AS val FROM ({PART_SQL}) f, {RS} rs)"


@query(f"WITH {PARTS_LONG} SELECT a.r AS p, b.r AS q, SUM(a.val * b.val) AS val FROM c a JOIN c b ON a.i = b.i GROUP BY 1, 2")
def gram(spark, sf):
    g = dense.gram(totals(spark, sf, "part"))
    return _rows(spark, [(p, q, float(g[p, q])) for p in range(RANK) for q in range(RANK)], "p long, q long, val double")


@query(f"WITH {PARTS_LONG}, n AS (SELECT r, SQRT(SUM(val * val)) AS norm FROM c GROUP BY r) SELECT i, r, ROUND(val / norm, 9) AS val FROM c JOIN n USING (r)")
def col_norm2(spark, sf):
    return _long(dense.normalize_2norm(totals(spark, sf, "part"))[0]).withColumn("val", F.round("val", 9))


@query(f"WITH {PARTS_LONG}, n AS (SELECT r, GREATEST(1, MAX(val)) AS norm FROM c GROUP BY r) SELECT i, r, ROUND(val / norm, 9) AS val FROM c JOIN n USING (r)")
def col_maxnorm(spark, sf):
    return _long(dense.normalize_maxnorm(totals(spark, sf, "part"))[0]).withColumn("val", F.round("val", 9))


@query(f"WITH {PARTS_LONG} SELECT i, r, val * val AS val FROM c")
def matrix_hadamard(spark, sf):
    a = totals(spark, sf, "part")
    return _long(a.hadamard(a))


@query(f"WITH {PARTS_LONG} SELECT i, r, val * (i + r + 1) AS val FROM c")
def matrix_ramp(spark, sf):
    a = totals(spark, sf, "part")
    return _long(a.hadamard(dense.ramp(spark, a.nrows, RANK)))


@query(f"WITH t AS ({T3B_SQL}) SELECT CAST(r AS BIGINT) AS r, SUM(val * (i0 + r + 1) * (i1 + r + 1) * (i2 + r + 1)) AS val FROM t, {RS} rs GROUP BY r")
def kruskal_inner(spark, sf):
    t = t3b(spark, sf, coalesce=False)
    factors = ramps(spark, t.dims)
    product = t.mttkrp(factors, 2)
    both = dense.hadamard(factors[2], product)
    return _long(both).groupBy("r").agg(F.sum("val").alias("val"))


@query(
    f"WITH a AS ({PART_SQL}), b AS ({SUPPLIER_SQL}), g AS (SELECT 4 * SUM(x * x) AS xx, 2 * 3 * SUM(x * y) AS xy, 9 * SUM(y * y) AS yy FROM a), h AS (SELECT SUM(x * x) AS xx, SUM(x * y) AS xy, SUM(y * y) AS yy FROM b) "
    "SELECT ROUND(LN(g.xx * h.xx + 2 * g.xy * h.xy + g.yy * h.yy), 9) AS log_norm_sq FROM g, h"
)
def kruskal_norm(spark, sf):
    """With weights 2 and 3, as a logarithm: the sums leave the doubles' whole numbers."""
    grams = [dense.gram(totals(spark, sf, n)) for n in ("part", "supplier")]
    return _rows(spark, [(round(log(cpd.kruskal_norm_sq([2.0, 3.0], grams)), 9),)], "log_norm_sq double")


@query("WITH c AS (SELECT vec_id, UNNEST(embedding) AS v FROM embeddings) SELECT vec_id, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), 4) AS norm_sq FROM c GROUP BY 1")
def dense_row_norms(spark, sf):
    e = table(spark, sf, "embeddings")
    a = dense.from_array_column(e, "vec_id", "embedding", 0, 64)
    square = F.aggregate("row", F.lit(0.0), lambda s, v: s + v * v)
    return a.df.select(F.col("i").alias("vec_id"), F.size("row").cast("long").alias("n"), F.round(square, 4).alias("norm_sq"))


@query("SELECT user_id AS i0, CAST(DENSE_RANK() OVER (ORDER BY event_type) - 1 AS BIGINT) AS i1, val FROM (SELECT user_id, event_type, CAST(COUNT(*) AS DOUBLE) AS val FROM events GROUP BY 1, 2) e")
def events_tensor(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type")
    types = row_numbers(e.select("event_type").distinct(), [F.col("event_type")], "kind")
    users = e.agg(F.max("user_id")).first()[0] + 1
    own = e.join(F.broadcast(types), "event_type")  # a row an event type
    return SparseTensor.from_table(own, ["user_id", "kind"], "1", (users, types.count())).df


# --- relabelling ----------------------------------------------------------------


def _affine(spark, dim, step):
    return spark.range(dim).select(F.col("id").alias("old"), ((F.col("id") * step + 3) % dim).alias("new"))


def _maps(spark, dims):
    from math import gcd

    return [_affine(spark, d, next(s for s in (7, 11, 13, 17, 19) if gcd(s, d) == 1)) for d in dims[:2]] + [reorder.identity_map(spark, d) for d in dims[2:]]


@query(f"WITH t AS ({T3B_SQL}) SELECT (i0 * 7 + 3) % np AS i0, (i1 * 7 + 3) % ns AS i1, i2, val FROM t, (SELECT {COUNTS}) n")
def relabel(spark, sf):
    t = t3b(spark, sf)
    return t.relabel(_maps(spark, t.dims)).df


@query(f"WITH t AS ({T3B_SQL}) SELECT * FROM t")
def inverse_map(spark, sf):
    t = t3b(spark, sf)
    maps = _maps(spark, t.dims)
    return t.relabel(maps).relabel(reorder.inverse_maps(maps)).df


@query(
    f"WITH t AS ({T3B_SQL}), r AS (SELECT i1, i2, ROW_NUMBER() OVER (ORDER BY i1, i2) - 1 AS rid FROM (SELECT DISTINCT i1, i2 FROM t) d), "
    "l AS (SELECT t.i0, list_append(list(rid ORDER BY rid), 9223372036854775807) AS k FROM t JOIN r ON t.i1 = r.i1 AND t.i2 = r.i2 GROUP BY 1) "
    "SELECT p.p_partkey AS old, ROW_NUMBER() OVER (ORDER BY COALESCE(l.k, [9223372036854775807]), p.p_partkey) - 1 AS new FROM part p LEFT JOIN l ON l.i0 = p.p_partkey"
)
def lexi_order(spark, sf):
    return reorder.lexi_map(t3b(spark, sf), 0)


def _lexi_sql(rounds: int) -> str:
    """Map of mode 0 after rounds over all modes: each step relabels the tensor of the one before."""
    steps, k = [f"t0 AS ({T3B_SQL})", "m0 AS (SELECT p_partkey AS old, p_partkey AS new FROM part)"], 0
    every = ("SELECT p_partkey AS i FROM part", "SELECT s_suppkey AS i FROM supplier", "SELECT unnest(range(7)) AS i")
    for _ in range(rounds):
        for m in range(3):
            a, b = (c for c in ("i0", "i1", "i2") if c != f"i{m}")
            moved = ", ".join("s.new AS " + c if c == f"i{m}" else "t." + c for c in ("i0", "i1", "i2"))
            steps += [
                f"r{k} AS (SELECT {a}, {b}, ROW_NUMBER() OVER (ORDER BY {a}, {b}) - 1 AS rid FROM (SELECT DISTINCT {a}, {b} FROM t{k}) d)",
                f"l{k} AS (SELECT t.i{m} AS i, list_append(list(rid ORDER BY rid), 9223372036854775807) AS key FROM t{k} t JOIN r{k} r ON t.{a} = r.{a} AND t.{b} = r.{b} GROUP BY 1)",
                f"s{k} AS (SELECT e.i AS old, CAST(ROW_NUMBER() OVER (ORDER BY COALESCE(l.key, [9223372036854775807]), e.i) - 1 AS BIGINT) AS new FROM ({every[m]}) e LEFT JOIN l{k} l ON l.i = e.i)",
                f"t{k + 1} AS (SELECT {moved}, t.val FROM t{k} t JOIN s{k} s ON s.old = t.i{m})",
                f"m{k + 1} AS (SELECT x.old, s.new FROM m{k} x JOIN s{k} s ON s.old = x.new)" if m == 0 else f"m{k + 1} AS (SELECT * FROM m{k})",
            ]
            k += 1
    return f"WITH {', '.join(steps)} SELECT old, new FROM m{k}"


@query(_lexi_sql(2))
def lexi_order_two_rounds(spark, sf):
    return reorder.lexi_order(t3b(spark, sf), 2)[0]


#: Least (start, steps) over neighbours in one order, round by round; twelve rounds are more than parts of common orders need.
BFS_SQL = """
WITH RECURSIVE cells AS (
  SELECT DISTINCT l_partkey AS i, l_orderkey AS r FROM lineitem
), near AS (
  SELECT DISTINCT x.i AS i, y.i AS j, CASE WHEN x.i = y.i THEN 0 ELSE 1 END AS step FROM cells x JOIN cells y ON x.r = y.r
), places AS (
  SELECT 0 AS k, i, i * 1048576 AS place FROM (SELECT DISTINCT i FROM cells) c
  UNION ALL
  SELECT p.k + 1, n.j, min(p.place + n.step) FROM places p JOIN near n ON n.i = p.i WHERE p.k < 12 GROUP BY p.k + 1, n.j
), levels AS (
  SELECT i, place // 1048576 AS start, place % 1048576 AS level FROM places WHERE k = 12
), firsts AS (
  SELECT r, min(level) AS level FROM cells JOIN levels USING (i) GROUP BY r
), links AS (
  SELECT c.i, count(*) AS n FROM cells c JOIN levels l ON l.i = c.i JOIN firsts f ON f.r = c.r WHERE f.level = l.level - 1 GROUP BY c.i
)
SELECT p_partkey AS old, CAST(ROW_NUMBER() OVER (ORDER BY l.start NULLS LAST, l.level, COALESCE(n.n, 0) DESC, p_partkey) - 1 AS BIGINT) AS new
FROM part LEFT JOIN levels l ON l.i = p_partkey LEFT JOIN links n ON n.i = p_partkey
"""


@query(BFS_SQL)
def bfs_order(spark, sf):
    dims = [table(spark, sf, n).count() for n in ("part", "orders")]
    return reorder.bfs_map(SparseTensor.from_table(table(spark, sf, "lineitem"), ["l_partkey", "l_orderkey"], "l_quantity", dims, coalesce=False), 0)


# --- what SQL does not express ----------------------------------------------------


@query()
def random_shuffle(spark, sf):
    return reorder.random_map(spark, table(spark, sf, "part").count(), 7)


@query()
def cpd_als(spark, sf):
    k = cpd.cp_als(t3b(spark, sf), 3, niters=3, seed=1)
    return _rows(spark, [(i, float(f)) for i, f in enumerate(k.trace)], "iteration long, fit double")


def _tucker_sql(rounds: int) -> str:
    """The best product of three unit vectors: each in turn becomes the tensor times the two others, at its length."""
    return f"""
WITH RECURSIVE t AS ({T3B_SQL}), starts AS (
  SELECT 0 AS m, i0 AS i FROM t UNION SELECT 1, i1 FROM t UNION SELECT 2, i2 FROM t
), turned AS (
  SELECT 0 AS m, i0 AS i, 1 AS ma, i1 AS a, 2 AS mb, i2 AS b, val FROM t UNION ALL SELECT 1, i1, 2, i2, 0, i0, val FROM t UNION ALL SELECT 2, i2, 0, i0, 1, i1, val FROM t
), places AS (
  SELECT 0 AS k, m, i, CAST(1 AS DOUBLE) / sqrt(count(*) OVER (PARTITION BY m)) AS v, CAST(0 AS DOUBLE) AS size FROM starts
  UNION ALL
  SELECT k, m, i, CASE WHEN fresh THEN v / sqrt(sum(v * v) OVER (PARTITION BY m)) ELSE v END, sqrt(sum(CASE WHEN fresh THEN v * v ELSE 0 END) OVER ()) FROM (
    SELECT n.k + 1 AS k, t.m, t.i, sum(t.val * n.v * o.v) AS v, TRUE AS fresh
    FROM turned t JOIN places n ON n.m = t.ma AND n.i = t.a JOIN places o ON o.m = t.mb AND o.i = t.b
    WHERE n.k < {rounds} AND t.m = n.k % 3 GROUP BY 1, 2, 3
    UNION ALL SELECT k + 1, m, i, v, FALSE FROM places WHERE k < {rounds} AND m <> k % 3
  ) x
)
SELECT CAST(m AS BIGINT) AS m, i, round(v, 5) AS val FROM places WHERE k = {rounds} UNION ALL SELECT 3, 0, round(max(size), 4) FROM places WHERE k = {rounds}
"""


@query(_tucker_sql(18))
def tucker(spark, sf):
    """Vectors of the modes and, as mode 3, the core of part x supplier x line at ranks of one."""
    t = t3b(spark, sf)
    core, factors, _ = cpd.tucker(t, (1, 1, 1), 6, 0.0)
    out = core.df.select(F.lit(3).cast("long").alias("m"), F.col("i0").alias("i"), F.round(F.abs("val"), 4).alias("val"))
    for m, f in enumerate(factors):
        cells = f.df.select(F.lit(m).cast("long").alias("m"), "i", F.round(F.abs(F.get("row", F.lit(0))), 5).alias("val"))
        out = out.unionByName(cells.filter("val <> 0"))
    return out


from tensorloom.plans import catalog_more  # noqa: E402, F401  registers further queries here
