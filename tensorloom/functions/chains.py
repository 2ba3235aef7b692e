"""Greedy chains over sorted points without a sequential scan.

Points are distinct numbers, such as running totals of slices; each has a
successor, and a chain follows successors from its start. Successors are
found in ranges of values, chains by doubling the jumps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.functions.lineage import Tables

#: Ranges of values in which successors are looked up; what meets in one place is one row a range.
RANGES = 4096


def with_next(df: DataFrame, point: str, query: Column, highest: int) -> DataFrame:
    """``df`` with ``next``: the least point of any row above ``query``, null if there is none.

    Points and queries are sorted together within each of RANGES ranges of
    values; where a range holds no such point, it is the first point of a later one.
    """
    width = max(1, -(-(highest + 1) // RANGES))
    span = lambda c: F.least(F.floor(c / F.lit(width)).cast("long"), F.lit(RANGES))
    names = df.columns
    points = df.select(F.col(point).alias("_v"), F.col(point).alias("_p"))
    asked = df.withColumn("_v", query.cast("long"))
    both = points.select(span(F.col("_v")).alias("_r"), "_v", "_p", F.lit(0).alias("_kind"), *[F.lit(None).cast(t).alias(n) for n, t in df.dtypes])
    both = both.unionByName(asked.select(span(F.col("_v")).alias("_r"), "_v", F.lit(None).cast("long").alias("_p"), F.lit(1).alias("_kind"), *names))
    # From the highest value down, a query before a point of the same value.
    down = Window.partitionBy("_r").orderBy(F.desc("_v"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_near", F.last("_p", ignorenulls=True).over(down)).filter("_kind = 1")
    firsts = points.groupBy(span(F.col("_v")).alias("_r")).agg(F.min("_p").alias("_first"))
    every = df.sparkSession.range(RANGES + 1).select(F.col("id").alias("_r")).join(firsts, "_r", "left")
    later = every.withColumn("_later", F.last("_first", ignorenulls=True).over(Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)))
    found = near.join(F.broadcast(later.select("_r", "_later")), "_r")
    return found.select(*names, F.coalesce("_near", "_later").alias("next"))


def reached(jumps: DataFrame, starts: DataFrame) -> DataFrame:
    """Points (point) of the chains from ``starts`` by ``jumps`` (point, next): each round doubles how far a jump goes."""
    spark = jumps.sparkSession
    far, near = Tables(spark, "jumps"), Tables(spark, "marks")
    jumps, marks = far.write(jumps.filter("next IS NOT NULL").select("point", "next")), near.write(starts.select("point"))
    while not jumps.isEmpty():
        marks = near.write(marks.unionByName(marks.join(jumps, "point").select(F.col("next").alias("point"))))
        onward = jumps.select(F.col("point").alias("next"), F.col("next").alias("_to"))
        jumps = far.write(jumps.join(onward, "next").select("point", F.col("_to").alias("next")))
        far.drop(1)
        near.drop(1)
    return marks
