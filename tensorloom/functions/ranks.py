"""Global row numbers without a single task for all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions.lineage import Tables


def _offsets(df: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """(_part, _before): what lies before each partition, from the partitions' sizes."""
    before = [0, *accumulate(n for _, n in sizes)]
    starts = [(p, b) for (p, _), b in zip(sizes, before, strict=False)]
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])
    return F.broadcast(df.sparkSession.createDataFrame(starts, schema))


def row_numbers(df: DataFrame, order: list[Column], name: str = "rn", tables: Tables | None = None, keep: list[str] | None = None) -> DataFrame:
    """Number rows from 0 in the given order; ``keep``: the columns to return, all by default.

    Rows are range-partitioned and sorted; a number is the rows of earlier
    partitions plus the place in its own. One count a partition is collected.
    So that both uses see the same partitions, the sorted rows become one of
    ``tables``, which its owner drops, or else are persisted.
    """
    names = df.columns if keep is None else keep
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*names, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    parts = tables.write(parts) if tables else parts.persist()
    offsets = _offsets(df, sorted(tuple(r) for r in parts.groupBy("_part").count().collect()))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.join(offsets, "_part").select(*names, (F.col("_before") + place).alias(name))


def running_totals(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """With the sum of ``value`` over the rows up to each, in the given order (of keys without ties): ranges of keys first, then the ranges' totals."""
    tables = Tables(df.sparkSession, "totals")
    parts = tables.write(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    offsets = _offsets(df, sorted(tuple(r) for r in parts.groupBy("_part").agg(F.sum(value)).collect()))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = tables.write(parts.withColumn(name, own).join(offsets, "_part").select(*df.columns, (F.col("_before") + F.col(name)).alias(name)))
    tables.drop(1)
    return out
