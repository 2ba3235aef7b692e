"""Slices and splits by coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.functions.chains import reached, with_next
from tensorloom.functions.ranks import running_totals
from tensorloom.types import ShapeMismatchError, SparseTensor, check_mode


def in_range(x: SparseTensor, low: Sequence[int], high: Sequence[int]):
    """Whether low <= i < high in every mode."""
    if len(low) != x.nmodes or len(high) != x.nmodes:
        raise ShapeMismatchError(f"bounds {low}, {high} of {x.nmodes} modes")
    ok = F.lit(True)
    for m, (a, z) in enumerate(zip(low, high, strict=True)):
        ok = ok & (F.col(f"i{m}") >= a) & (F.col(f"i{m}") < z)
    return ok


def slice(x: SparseTensor, low: Sequence[int], high: Sequence[int]) -> SparseTensor:  # noqa: A001
    """The part within the bounds; shape and coordinates stay."""
    return x.with_df(x.df.filter(in_range(x, low, high)), x.sort_order)


def _greedy_parts(counts: DataFrame, most: int) -> DataFrame:
    """split_id, i and _part of slices (split_id, i, n): consecutive slices share a part while it holds at most ``most``."""
    order = [F.col("split_id"), F.col("i")]
    slices = running_totals(counts, order, "n", "point")  # n > 0, so a total tells its slice
    highest = slices.agg(F.max("point")).first()[0] or 0
    asked = F.greatest(F.col("point") - F.col("n") + F.lit(most), F.col("point"))
    nexts = with_next(slices.select("point", "n", "split_id"), "point", asked, highest)
    # A successor in another parent ends the chain.
    owner = slices.select(F.col("point").alias("next"), F.col("split_id").alias("_owner"))
    jumps = nexts.join(owner, "next").filter("split_id = _owner").select("point", "next")
    starts = slices.groupBy("split_id").agg(F.min("point").alias("point")).select("point")
    marks = reached(jumps, starts).withColumn("_mark", F.lit(1))
    flagged = slices.join(marks, "point", "left").select("split_id", "i", "point", F.coalesce("_mark", F.lit(0)).cast("long").alias("_mark"))
    numbered = running_totals(flagged, [F.col("point")], "_mark", "_number")
    parts = numbered.filter("_mark = 1").select("_number", (F.row_number().over(Window.partitionBy("split_id").orderBy("point")) - 1).cast("long").alias("_part"))
    return numbered.join(parts, "_number").select("split_id", "i", "_part")


def split(x: SparseTensor, limits: Sequence[int]) -> DataFrame:
    """Rows with split_id: modes are cut in turn into parts of at most limits[m] x the later limits' nonzeros.

    A limit of 0 leaves a mode whole. No slice is cut, so a part may exceed
    the limit by one slice. Each level works on the slices' counts: every
    slice has a successor, the first slice that no part beginning with it
    could take, found on running totals; the parts begin at the slices that
    the chains of successors from the parents' first slices reach.
    """
    if len(limits) != x.nmodes:
        raise ShapeMismatchError(f"{len(limits)} limits for {x.nmodes} modes")
    df = x.df.withColumn("split_id", F.lit("0"))
    for m, own in enumerate(limits):
        if not own:
            continue
        most = own
        for later in limits[m + 1 :]:
            most *= max(1, later)
        counts = df.groupBy("split_id", F.col(f"i{m}").alias("i")).agg(F.count("*").alias("n"))
        parts = _greedy_parts(counts, most).withColumnRenamed("i", f"i{m}")
        df = df.join(parts, ["split_id", f"i{m}"]).withColumn("split_id", F.concat_ws(".", "split_id", F.col("_part").cast("string"))).drop("_part")
    return df.select(*x.modes, "val", "split_id")


def split_bounds(x: SparseTensor, limits: Sequence[int]) -> DataFrame:
    """split_id, nnz and the bounds lo_m, hi_m of each part."""
    bounds = [f(f"i{m}").alias(f"{n}{m}") for m in range(x.nmodes) for f, n in ((F.min, "lo"), (lambda c: F.max(c) + 1, "hi"))]
    return split(x, limits).groupBy("split_id").agg(F.count("*").alias("nnz"), *bounds)


def distribute(x: SparseTensor, parts: int, mode: int = 0) -> DataFrame:
    """part, nnz and rows: whole slices of a mode dealt to parts, each closed once it holds nnz / parts."""
    check_mode(mode, x.nmodes)
    counts = x.df.groupBy(f"i{mode}").agg(F.count("*").alias("n"))
    upto = running_totals(counts, [F.col(f"i{mode}")], "n", "upto")
    total = upto.agg(F.max("upto")).first()[0] or 0
    # A part ends with the first slice that brings it to its share.
    share = -(-total // parts)
    nexts = with_next(upto.select(F.col("upto").alias("point")), "point", F.col("point") + F.lit(share - 1), total)
    first = upto.filter(F.col("upto") >= share).agg(F.min("upto").alias("point")).dropna()
    found = reached(nexts, first).filter(F.col("point") < total).orderBy("point").limit(max(0, parts - 1))
    ends = [r.point for r in found.collect()]  # fewer than the parts asked for
    part = F.size(F.filter(F.array(*map(F.lit, ends)).cast("array<bigint>"), lambda e: e < F.col("upto"))).cast("long")
    return upto.select(part.alias("part"), "n").groupBy("part").agg(F.sum("n").alias("nnz"), F.count("*").alias("rows"))
