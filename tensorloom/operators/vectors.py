"""Dense vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tensorloom.types import Vector


def vector(spark: SparkSession, values: Sequence[float]) -> Vector:
    return Vector(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, val double"), len(values))


def constant_vector(spark: SparkSession, size: int, value: float) -> Vector:
    return Vector(spark.range(size).select(F.col("id").alias("i"), F.lit(float(value)).alias("val")), size)


def random_vector(spark: SparkSession, size: int, seed: int = 0) -> Vector:
    """Whole numbers from 1 to 10."""
    return Vector(spark.range(size).select(F.col("id").alias("i"), (F.floor(F.rand(seed) * 10) + 1).cast("double").alias("val")), size)


def append(v: Vector, value: float) -> Vector:
    one = v.df.sparkSession.createDataFrame([(v.size, float(value))], "i long, val double")
    return Vector(v.df.unionByName(one), v.size + 1)


def append_vector(v: Vector, w: Vector) -> Vector:
    return Vector(v.df.unionByName(w.df.withColumn("i", F.col("i") + v.size)), v.size + w.size)


def resize(v: Vector, size: int) -> Vector:
    """Cut, or filled up with zeros."""
    own = v.df.filter(F.col("i") < size)
    if size > v.size:
        own = own.unionByName(v.df.sparkSession.range(v.size, size).select(F.col("id").alias("i"), F.lit(0.0).alias("val")))
    return Vector(own, size)


def add(v: Vector, w: Vector) -> Vector:
    both = v.df.unionByName(w.df).groupBy("i").agg(F.sum("val").alias("val"))
    return Vector(both, max(v.size, w.size))


def largest(v: Vector) -> float:
    return v.df.agg(F.max("val")).first()[0]


def find(v: Vector, value: float) -> int:
    """First position of a value, or -1."""
    at = v.df.filter(F.col("val") == value).agg(F.min("i")).first()[0]
    return -1 if at is None else at


def sorted_values(v: Vector) -> Vector:
    from tensorloom.functions.ranks import row_numbers

    return Vector(row_numbers(v.df.select("val"), [F.col("val")], "i").select("i", "val"), v.size)


def sort_pairs(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Key-value pairs by value."""
    return sorted(pairs, key=lambda p: (p[1], p[0]))
