"""Tensors and matrices over the star-schema tables, and the same relations as SQL.

Coordinates are 0-based keys, values are summed quantities: whole numbers,
whose sums and products are exact. Shapes come from the dimension tables' row
counts. Linear products sum equal coordinates anyway: they take the rows as
they come (``coalesce=False``) and save a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.ranks import row_numbers
from tensorloom.operators.dense import ramp
from tensorloom.types import DenseMatrix, SparseMatrix, SparseTensor, maybe_broadcast

LINES = 7
FLAGS = ("A", "N", "R")

T3_SQL = "SELECT l_orderkey AS i0, l_partkey AS i1, l_suppkey AS i2, SUM(l_quantity) AS val FROM lineitem GROUP BY 1, 2, 3"
T3B_SQL = "SELECT l_partkey AS i0, l_suppkey AS i1, CAST(l_linenumber - 1 AS BIGINT) AS i2, SUM(l_quantity) AS val FROM lineitem GROUP BY 1, 2, 3"
T4_SQL = (
    "SELECT l_partkey AS i0, l_suppkey AS i1, CAST(l_linenumber - 1 AS BIGINT) AS i2, "
    "CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS i3, SUM(l_quantity) AS val FROM lineitem GROUP BY 1, 2, 3, 4"
)
M_SQL = "SELECT l_partkey AS i, l_suppkey AS j, SUM(l_quantity) AS val FROM lineitem GROUP BY 1, 2"
SHIFTED_SQL = "SELECT l_partkey AS i0, l_suppkey AS i1, CAST(l_linenumber % 7 AS BIGINT) AS i2, 2 * SUM(l_quantity) AS val FROM lineitem GROUP BY 1, 2, 3"
C2_SQL = "SELECT CAST(DENSE_RANK() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS i0, CAST(c_nationkey AS BIGINT) AS i1, CAST(COUNT(*) AS DOUBLE) AS val FROM customer GROUP BY c_mktsegment, c_nationkey"
N2_SQL = "SELECT CAST(n_regionkey AS BIGINT) AS i0, CAST(n_nationkey AS BIGINT) AS i1, CAST(1 AS DOUBLE) AS val FROM nation"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, name).count()


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def t3(spark: SparkSession, sf_dir: str, coalesce: bool = True) -> SparseTensor:
    """order x part x supplier."""
    dims = [size(spark, sf_dir, n) for n in ("orders", "part", "supplier")]
    return SparseTensor.from_table(lineitem(spark, sf_dir), ["l_orderkey", "l_partkey", "l_suppkey"], "l_quantity", dims, coalesce)


def t3b(spark: SparkSession, sf_dir: str, coalesce: bool = True) -> SparseTensor:
    """part x supplier x line."""
    dims = [size(spark, sf_dir, n) for n in ("part", "supplier")]
    return SparseTensor.from_table(lineitem(spark, sf_dir), ["l_partkey", "l_suppkey", "l_linenumber - 1"], "l_quantity", (*dims, LINES), coalesce)


def shifted(spark: SparkSession, sf_dir: str, coalesce: bool = True) -> SparseTensor:
    """part x supplier x next line, doubled: it meets t3b in a part of its entries."""
    dims = [size(spark, sf_dir, n) for n in ("part", "supplier")]
    return SparseTensor.from_table(lineitem(spark, sf_dir), ["l_partkey", "l_suppkey", f"l_linenumber % {LINES}"], "l_quantity", (*dims, LINES), coalesce).mul_scalar(2)


def c2(spark: SparkSession, sf_dir: str) -> SparseTensor:
    """market segment x nation: customers."""
    own = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey")
    kinds = row_numbers(own.select("c_mktsegment").distinct(), [F.col("c_mktsegment")], "kind")
    n = kinds.count()
    return SparseTensor.from_table(own.join(maybe_broadcast(kinds, n, 64), "c_mktsegment"), ["kind", "c_nationkey"], "1", (n, size(spark, sf_dir, "nation")))


def n2(spark: SparkSession, sf_dir: str) -> SparseTensor:
    """region x nation: ones."""
    dims = [size(spark, sf_dir, n) for n in ("region", "nation")]
    return SparseTensor.from_table(table(spark, sf_dir, "nation"), ["n_regionkey", "n_nationkey"], "1", dims)


def t4(spark: SparkSession, sf_dir: str, coalesce: bool = True) -> SparseTensor:
    """part x supplier x line x return flag."""
    dims = [size(spark, sf_dir, n) for n in ("part", "supplier")]
    flag = F.array_position(F.array(*map(F.lit, FLAGS)), F.col("l_returnflag")) - 1
    flag = F.when(flag < 0, len(FLAGS) - 1).otherwise(flag)
    return SparseTensor.from_table(lineitem(spark, sf_dir), ["l_partkey", "l_suppkey", "l_linenumber - 1", flag], "l_quantity", (*dims, LINES, len(FLAGS)), coalesce)


def m2(spark: SparkSession, sf_dir: str, coalesce: bool = True) -> SparseMatrix:
    """part x supplier."""
    dims = [size(spark, sf_dir, n) for n in ("part", "supplier")]
    t = SparseTensor.from_table(lineitem(spark, sf_dir), ["l_partkey", "l_suppkey"], "l_quantity", dims, coalesce)
    return SparseMatrix(t.df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), "val"), *dims)


def ramps(spark: SparkSession, dims, rank: int = 2) -> list[DenseMatrix]:
    return [ramp(spark, d, rank) for d in dims]


def _totals_sql(name: str, key: str, line: str) -> str:
    return f"SELECT {key} AS i, CAST(COALESCE(SUM(l_quantity), 0) AS DOUBLE) AS x, CAST(COUNT(l_quantity) AS DOUBLE) AS y FROM {name} LEFT JOIN lineitem ON {line} = {key} GROUP BY 1"


PART_SQL, SUPPLIER_SQL = _totals_sql("part", "p_partkey", "l_partkey"), _totals_sql("supplier", "s_suppkey", "l_suppkey")


def totals(spark: SparkSession, sf_dir: str, name: str) -> DenseMatrix:
    """Quantity and number of lines of each part or supplier."""
    line = {"part": "l_partkey", "supplier": "l_suppkey"}[name]
    n = size(spark, sf_dir, name)
    sums = lineitem(spark, sf_dir).groupBy(F.col(line).cast("long").alias("i")).agg(F.sum("l_quantity").cast("double").alias("x"), F.count("l_quantity").cast("double").alias("y"))
    full = spark.range(n).select(F.col("id").alias("i")).join(maybe_broadcast(sums, n, 40), "i", "left")
    return DenseMatrix(full.select("i", F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("x", "y")]).alias("row")), n, 2)
