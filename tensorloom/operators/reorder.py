"""Relabelling: maps of old to new indices, a DataFrame (old, new) for each mode."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.lineage import Tables, settle
from tensorloom.functions.ranks import row_numbers
from tensorloom.types import LONG_MAX, ShapeMismatchError, SparseTensor, ValueRangeError, check_mode, fits_broadcast, maybe_broadcast


def shuffle_elements(x: SparseTensor, seed: int = 0) -> SparseTensor:
    """Rows in a random order."""
    return x.with_df(x.df.orderBy(F.xxhash64(F.lit(seed), *x.modes)))


def identity_map(spark: SparkSession, dim: int) -> DataFrame:
    return spark.range(dim).select(F.col("id").alias("old"), F.col("id").alias("new"))


def random_map(spark: SparkSession, dim: int, seed: int = 0) -> DataFrame:
    """A permutation that depends on the seed only."""
    ids = spark.range(dim).select(F.col("id").alias("old"))
    return row_numbers(ids, [F.xxhash64(F.lit(seed), "old"), F.col("old")], "new")


def random_maps(x: SparseTensor, seed: int = 0) -> list[DataFrame]:
    return [random_map(x.spark, d, seed + m) for m, d in enumerate(x.dims)]


def relabel(x: SparseTensor, maps: Sequence[DataFrame]) -> SparseTensor:
    """New coordinates by one map a mode."""
    if len(maps) != x.nmodes:
        raise ShapeMismatchError(f"{len(maps)} maps for {x.nmodes} modes")
    df = x.df
    for m, own in enumerate(maps):
        right = maybe_broadcast(own.select(F.col("old").alias(f"i{m}"), F.col("new").alias("_new")), x.dims[m], 40)
        df = df.join(right, f"i{m}").drop(f"i{m}").withColumnRenamed("_new", f"i{m}")
    return x.with_df(df)


def inverse_map(own: DataFrame) -> DataFrame:
    return own.select(F.col("new").alias("old"), F.col("old").alias("new"))


def inverse_maps(maps: Sequence[DataFrame]) -> list[DataFrame]:
    return [inverse_map(m) for m in maps]


#: Entries of an index that are compared as one array.
CHUNK = 1024


def _ranked(df: DataFrame, keys: list[str], name: str, tables: Tables) -> DataFrame:
    """With the rank of the keys among the distinct ones."""
    return df.join(row_numbers(df.select(*keys).distinct(), [F.col(k) for k in keys], name, tables), keys)


def _list_ranks(numbered: DataFrame) -> DataFrame:
    """(old, rank): indices by their ascending lists of row numbers (old, rid), however long.

    Lists are cut into arrays of CHUNK entries, which are ranked; then ranks
    of 1, 2, 4 … arrays are pairs of the ranks before, until no two indices
    share a rank or all arrays are compared. A row is never longer than CHUNK.
    """
    tables, own = Tables(numbered.sparkSession, "lists"), Tables(numbered.sparkSession, "lists")
    placed = row_numbers(numbered, [F.col("old"), F.col("rid")], "at", own)
    spans = placed.groupBy("old").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    part = F.floor((F.col("at") - F.col("first")) / CHUNK).alias("part")
    arrays = placed.join(spans, "old").select("old", part, "rid", "n").groupBy("old", "part").agg(F.sort_array(F.collect_list("rid")).alias("rids"), F.first("n").alias("n"))
    last = (F.col("part") + 1) * CHUNK >= F.col("n")
    keyed = arrays.select("old", "part", F.when(last, F.concat("rids", F.array(F.lit(LONG_MAX)))).otherwise(F.col("rids")).alias("key"))
    keyed = tables.write(keyed)
    own.drop(0)
    ranks = tables.write(_ranked(keyed, ["key"], "rank", own).select("old", "part", "rank"))
    span = 1
    while True:
        tables.drop(1)
        own.drop(0)
        heads = ranks.filter("part = 0").select("old", "rank")
        parts, indices, told = (*ranks.agg(F.max("part") + 1).first(), *heads.agg(F.count("*"), F.countDistinct("rank")).first())
        if span >= (parts or 0) or told == indices:
            return heads
        onward = ranks.select("old", (F.col("part") - span).alias("part"), F.col("rank").alias("onward"))
        pairs = ranks.join(onward, ["old", "part"], "left").withColumn("onward", F.coalesce("onward", F.lit(-1)))
        pairs = tables.write(pairs.withColumnRenamed("rank", "own"))
        ranks = tables.write(_ranked(pairs, ["own", "onward"], "rank", own).select("old", "part", "rank"))
        span *= 2


def _numbered(x: SparseTensor, mode: int, ranges: list[tuple[int, int]], tables: Tables) -> DataFrame:
    """(old, rid): each entry's index and a number of its row that is in the order of the rows.

    ``ranges``: least and greatest index of each other mode. Rows are numbers
    of mixed base where these fit a long, else numbered among the distinct ones.
    """
    others = [c for c in x.modes if c != f"i{mode}"]
    old = F.col(f"i{mode}").alias("old")
    widths = [high - low + 1 for low, high in ranges]
    if prod(widths) > LONG_MAX:
        rows = row_numbers(x.df.select(*others).distinct(), [F.col(c) for c in others], "rid", tables)
        return x.df.join(rows, others).select(old, "rid")
    rid = F.lit(0).cast("long")
    for c, (low, _), width in zip(others, ranges, widths, strict=True):
        rid = rid * width + (F.col(c) - low)
    return x.df.select(old, rid.alias("rid"))


def lexi_map(x: SparseTensor, mode: int, tables: Tables | None = None) -> DataFrame:
    """Doubly lexical order of one mode: indices by their ascending lists of row numbers.

    Rows are the distinct coordinates of the other modes, in order. A list
    ends with a number above all, so longer lists precede their prefixes, and
    indices without an entry come last; ties keep the old order. Where an
    index has more than CHUNK entries, lists are ranked piece by piece. The
    result reads ``tables``, which its owner drops.
    """
    check_mode(mode, x.nmodes)
    tables = Tables(x.spark, "lexi") if tables is None else tables
    others = [c for c in x.modes if c != f"i{mode}"]
    ends = [f(c) for c in others for f in (F.min, F.max)]
    own = x.df.groupBy(f"i{mode}").agg(F.count("*"), *ends).toDF("i", "n", *[f"e{k}" for k in range(len(ends))])
    longest, *found = own.agg(F.max("n"), *[(F.max if k % 2 else F.min)(f"e{k}") for k in range(len(ends))]).first()
    ranges = list(zip(found[::2], found[1::2], strict=True)) if longest else [(0, 0)] * len(others)
    numbered = _numbered(x, mode, ranges, tables)
    every = x.spark.range(x.dims[mode]).select(F.col("id").alias("old"))
    if (longest or 0) > CHUNK:
        ranks = _list_ranks(tables.write(numbered.distinct()))
        keyed = every.join(ranks, "old", "left").withColumn("key", F.coalesce("rank", F.lit(LONG_MAX)))
    else:
        lists = numbered.repartition("old").distinct().groupBy("old").agg(F.sort_array(F.collect_list("rid")).alias("rids"))
        end = F.array(F.lit(LONG_MAX))
        keyed = every.join(lists, "old", "left").withColumn("key", F.when(F.col("rids").isNull(), end).otherwise(F.concat("rids", end)))
    return row_numbers(keyed.select("old", "key"), [F.col("key"), F.col("old")], "new", tables, ["old"])


def settle_map(own: DataFrame, dim: int) -> DataFrame:
    """A map without its lineage: through the driver if the mode's size bounds it, else as a table."""
    if fits_broadcast(dim, 16, 8 << 20):
        rows = [tuple(r) for r in own.select("old", "new").collect()]
        return own.sparkSession.createDataFrame(rows, "old long, new long")
    return settle(own, "map")


def lexi_order(x: SparseTensor, iterations: int = 1) -> list[DataFrame]:
    """Maps after rounds of doubly lexical ordering, mode after mode.

    Coordinates under the maps so far are a table that each step writes anew
    with its own mode relabelled, so plans and disk do not grow.
    """
    maps = [identity_map(x.spark, d) for d in x.dims]
    cells, own = Tables(x.spark, "lexi"), Tables(x.spark, "lexi")
    now = cells.write(x.df.select(*x.modes).distinct()) if iterations > 0 else None
    for left in reversed(range(iterations)):
        for mode, dim in enumerate(x.dims):
            step = settle_map(lexi_map(SparseTensor(now.withColumn("val", F.lit(1.0)), x.dims), mode, own), dim)
            own.drop(0)
            moved = step.select(F.col("old").alias("new"), F.col("new").alias("_to"))
            maps[mode] = settle_map(maps[mode].join(moved, "new").select("old", F.col("_to").alias("new")), dim)
            if left or mode < x.nmodes - 1:
                right = maybe_broadcast(step.select(F.col("old").alias(f"i{mode}"), F.col("new").alias("_new")), dim, 40)
                now = cells.write(now.join(right, f"i{mode}").drop(f"i{mode}").withColumnRenamed("_new", f"i{mode}"))
                cells.drop(1)
    cells.drop(0)
    return maps


def _levels(cells: DataFrame) -> DataFrame:
    """(index, start, level): of each index of the incidences (index, row) the least index it is connected with, and the steps from there.

    Rounds of (start, level) minima over rows; only rows of indices that
    changed in the round before are looked at.
    """
    tables = Tables(cells.sparkSession, "levels")
    state = tables.write(cells.select("index").distinct().select("index", F.col("index").alias("start"), F.lit(0).cast("long").alias("level")))
    changed = state
    while not changed.isEmpty():
        place = F.struct("start", "level")
        rows = cells.join(changed, "index").groupBy("row").agg(F.min(place).alias("_of_row"))
        offered = cells.join(rows, "row").groupBy("index").agg(F.min("_of_row").alias("_least"))
        both = state.join(offered, "index", "left")
        better = F.struct(F.col("_least.start").alias("start"), (F.col("_least.level") + 1).alias("level"))
        moved = F.col("_least").isNotNull() & (better < place)
        new = F.when(moved, better).otherwise(place)
        state = tables.write(both.select("index", new["start"].alias("start"), new["level"].alias("level"), F.coalesce(moved, F.lit(False)).alias("_moved")))
        changed = state.filter("_moved").drop("_moved")
        state = state.drop("_moved")
        tables.drop(1)
    return state


def bfs_map(x: SparseTensor, mode: int) -> DataFrame:
    """Breadth-first order of one mode over the hypergraph of its entries.

    Indices that have an entry in one row (coordinates of the other modes)
    are neighbours. Connected indices lie together, the groups by their least
    index; a group is ordered by the steps from its least index, then by the
    number of rows shared with the step before (most first), then by index.
    Indices without an entry come last.
    """
    check_mode(mode, x.nmodes)
    others = [c for c in x.modes if c != f"i{mode}"]
    cells = settle(x.df.select(F.col(f"i{mode}").alias("index"), F.struct(*others).alias("row")).distinct(), "cells")
    levels = _levels(cells)
    placed = cells.join(levels, "index")
    first = placed.groupBy("row").agg(F.min("level").alias("_first"))
    links = placed.join(first, "row").filter(F.col("_first") == F.col("level") - 1).groupBy("index").agg(F.count("*").alias("links"))
    every = x.spark.range(x.dims[mode]).select(F.col("id").alias("old"))
    known = levels.join(links, "index", "left").select(F.col("index").alias("old"), "start", "level", F.coalesce("links", F.lit(0)).alias("links"))
    order = [F.asc_nulls_last("start"), F.col("level"), F.desc("links"), F.col("old")]
    return row_numbers(every.join(known, "old", "left"), order, "new").select("old", "new")


def bfs_order(x: SparseTensor) -> list[DataFrame]:
    """Breadth-first maps of all modes, in rounds over the whole tensor."""
    return [bfs_map(x, m) for m in range(x.nmodes)]


def reorder_by(x: SparseTensor, kind: str = "lexi", iterations: int = 1, seed: int = 0) -> tuple[SparseTensor, list[DataFrame]]:
    """Relabelled by "lexi", "bfs" or "random" order, and the maps."""
    if kind == "lexi":
        maps = lexi_order(x, iterations)
    elif kind == "bfs":
        maps = bfs_order(x)
    elif kind == "random":
        maps = random_maps(x, seed)
    else:
        raise ValueRangeError(f"order {kind}")
    return relabel(x, maps), maps
