"""Shared helpers: shared-folder tables that cut lineage, and Arrow text access."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.lineage import settle, shared_dir

def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors, ends the lineage.

    The table goes when the application ends.
    """
    return settle(df, name)


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions for ``size`` bytes of about ``each``, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def bucketed(df: DataFrame, key: str, name: str, buckets: int) -> DataFrame:
    """As cut, with the rows dealt by ``key`` once: later joins on it read the buckets without moving them."""
    spark = df.sparkSession
    named = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{named}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.repartition(buckets, key).write.option("compression", "zstd").bucketBy(buckets, key).option("path", path).saveAsTable(named)
    return spark.table(named)


#: A key with more than one in so many of all rows is hot: there are fewer hot keys than this.
HOT_KEYS = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join on ``key`` with a side that has each key once and, in ``count``, its rows on the left.

    Hot keys, fewer than HOT_KEYS by their definition, are broadcast; the rows
    of the others, none of which holds much of the whole, are shuffled.
    """
    limit = max(1, total // HOT_KEYS)
    hot = F.broadcast(right.filter(F.col(count) > limit))
    cold = left.join(F.broadcast(right.filter(F.col(count) > limit).select(key)), key, "left_anti").join(right.filter(F.col(count) <= limit), key)
    return left.join(hot, key).unionByName(cold)


def salted_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, spread: str) -> DataFrame:
    """As hot_join where the right side's rows have no size bound: hot keys are dealt over several tasks.

    ``counts``: key and count of the left rows. The left rows of a hot key are
    salted by column ``spread``, its right row is copied for each salt. What
    is broadcast is one number for each of the fewer than HOT_KEYS hot keys.
    """
    limit = max(1, total // HOT_KEYS)
    parts = F.broadcast(counts.filter(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).alias("_parts")))
    n = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = left.join(parts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), n)).drop("_parts")
    copies = right.join(parts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("_parts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and their len+1 offsets; null counts as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if not len(arr) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches, name: str, limit: int = 4 << 20):
    """Record batches cut so that column ``name`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        arr = column(batch, name)
        _, at = utf8(arr)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i)
            i = j
