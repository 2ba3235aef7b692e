"""Coordinate text files of tensors, and permutation files.

The text holds the number of modes, their sizes, then rows of indices and a
value, separated by white space.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.functions.lineage import settle
from tensorloom.types import SparseTensor, ValueRangeError, check_dims


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).filter("t[0] <> ''")


def read_header(spark: SparkSession, path: str) -> tuple[int, tuple[int, ...]]:
    """Modes and sizes: a file's first two lines.

    A folder's parts have no fixed order; there the header is told by its
    numbers of tokens, as rows have one more than there are modes.
    """
    head = [r["t"] for r in _lines(spark, path).head(2)]
    if len(head) == 2 and len(head[0]) == 1 and head[0][0].isdigit() and len(head[1]) != int(head[0][0]):
        raise ValueRangeError(f"{path} has no header of modes and sizes")
    if len(head) < 2 or len(head[0]) != 1:
        single = [r["t"][0] for r in _lines(spark, path).filter(F.size("t") == 1).head(2)]
        if not single or not single[0].isdigit():
            raise ValueRangeError(f"{path} has no header of modes and sizes")
        n = int(single[0])
        sizes = single[1:] if n == 1 else [t for r in _lines(spark, path).filter(F.size("t") == n).head(1) for t in r["t"]]
        head = [[single[0]], sizes]
    try:
        n, dims = int(head[0][0]), check_dims(map(int, head[1]))
    except ValueError as error:
        raise ValueRangeError(f"{path} has no header of modes and sizes") from error
    if len(dims) != n:
        raise ValueRangeError(f"{path} has no header of modes and sizes")
    return n, dims


def read_tensor(spark: SparkSession, path: str, start_index: int = 1, header: bool = True, dims: Sequence[int] | None = None, mode: str = "strict", coalesce: bool = True) -> SparseTensor:
    """Load a text tensor; ``start_index`` is subtracted from the indices.

    Without a header, ``dims`` are given. Only lines of one more token than
    modes are rows, which leaves out both header lines. ``mode``: "strict"
    fails on a row that does not parse or lies outside the shape, "drop"
    leaves such rows out, "tokens" reads the numbers as one stream
    (read_tokens). Rows are split and cast in the scan.
    """
    if mode == "tokens":
        return read_tokens(spark, path, start_index, header, dims, coalesce)
    if mode not in ("strict", "drop"):
        raise ValueRangeError(f"mode {mode}")
    if header:
        n, dims = read_header(spark, path)
    elif dims is None:
        raise ValueRangeError("a file without header needs dims")
    else:
        dims = check_dims(dims)
        n = len(dims)
    tokens = _lines(spark, path)
    rows = tokens.filter(F.size("t") == n + 1)
    index = [(F.col("t")[m].try_cast("long") - start_index).alias(f"i{m}") for m in range(n)]
    parsed = rows.select(*index, F.col("t")[n].try_cast("double").alias("val"))
    bad = F.col("val").isNull()
    for m, d in enumerate(dims):
        bad = bad | F.col(f"i{m}").isNull() | (F.col(f"i{m}") < 0) | (F.col(f"i{m}") >= d)
    if mode == "drop":
        parsed = parsed.filter(~bad)
    else:
        odd = (F.size("t") != n + 1) & ~((F.size("t") == 1) | (F.size("t") == n)) if header else F.size("t") != n + 1
        # One scan counts both; the rows are read once more by what uses them.
        values = {f"i{m}": c for m, c in enumerate(index)} | {"val": F.col("t")[n].try_cast("double")}
        wrong = tokens.withColumns({"_odd": odd, "_row": F.size("t") == n + 1} | values).filter(F.col("_odd") | (F.col("_row") & bad))
        if not wrong.isEmpty():
            raise ValueRangeError(f"{path} has rows that are no entries of {dims}")
    made = SparseTensor(parsed, dims)
    return made.coalesce() if coalesce else made


def numbered_lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """Lines as tokens (t), with the number in the whole file of the first of them; files of a folder follow by name. Lines that begin with ``comment`` are left out.

    Each range of a file that a task reads counts its own tokens; one count a
    range meets on the driver.
    """
    place = ["file", "start"]
    source = spark.read.text(path) if comment is None else spark.read.text(path).filter(~F.col("value").startswith(comment))
    raw = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.split(F.trim("value"), r"\s+").alias("t"))
    lines = raw.filter("t[0] <> ''").withColumn("n", F.size("t").cast("long"))
    counts = sorted((*r[:2], r[2]) for r in lines.groupBy(*place).agg(F.sum("n")).collect())
    bases = [(f, start, base) for (f, start, _), base in zip(counts, accumulate((n for *_, n in counts), initial=0), strict=False)]
    ranges = F.broadcast(spark.createDataFrame(bases, "file string, start long, base long"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy(*place).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("own", own).join(ranges, place).select((F.col("base") + F.col("own")).alias("first"), "t")


def read_tokens(spark: SparkSession, path: str, start_index: int = 1, header: bool = True, dims: Sequence[int] | None = None, coalesce: bool = True) -> SparseTensor:
    """Load a text tensor as one stream of numbers, whatever its lines: rows may run over line ends, lines may hold several.

    Reading stops at the first token that is no number, and a row that is not
    whole then, or at the end, is left out; an index outside the shape is an
    error. Lines of whole rows are cut where they are; only tokens of
    other lines are gathered by row.
    """
    lines = numbered_lines(spark, path)
    if header:
        head = [t for r in lines.orderBy("first").head(1) for t in r["t"]]
        n = int(head[0]) if head and head[0].isdigit() else 0
        found = {r["first"] + k: t for r in lines.filter(F.col("first") <= n).collect() for k, t in enumerate(r["t"])}
        sizes = [found.get(k, "") for k in range(1, n + 1)]
        if not n or not all(t.isdigit() for t in sizes):
            raise ValueRangeError(f"{path} has no header of modes and sizes")
        dims = check_dims(map(int, sizes))
    elif dims is None:
        raise ValueRangeError("a file without header needs dims")
    dims = check_dims(dims)
    n, skip = len(dims), len(dims) + 1 if header else 0
    width, at = n + 1, F.col("first") - skip
    whole = (at >= 0) & (at % width == 0) & (F.size("t") % width == 0)
    many = F.explode(F.sequence(F.lit(0), F.floor(F.size("t") / width).cast("int") - 1)).alias("q")
    cut = lines.filter(whole).select("t", F.floor(at / width).alias("row"), many)
    cut = cut.select((F.col("row") + F.col("q")).alias("row"), *[F.get("t", F.col("q") * width + c).alias(f"c{c}") for c in range(width)])
    loose = lines.filter(~whole).select(at.alias("at"), F.posexplode("t").alias("pos", "token")).withColumn("at", F.col("at") + F.col("pos")).filter("at >= 0")
    gathered = loose.groupBy(F.floor(F.col("at") / width).alias("row")).agg(*[F.max(F.when(F.col("at") % width == c, F.col("token"))).alias(f"c{c}") for c in range(width)])
    rows = cut.unionByName(gathered)
    values = [(F.col(f"c{m}").try_cast("long") - start_index).alias(f"i{m}") for m in range(n)] + [F.col(f"c{n}").try_cast("double").alias("val")]
    parsed = rows.select("row", *values)
    bad, outside = F.col("val").isNull(), F.lit(False)
    for m, d in enumerate(dims):
        bad = bad | F.col(f"i{m}").isNull()
        outside = outside | (F.col(f"i{m}") < 0) | (F.col(f"i{m}") >= d)
    stop, wrong = parsed.agg(F.min(F.when(bad, F.col("row"))), F.min(F.when(~bad & outside, F.col("row")))).first()
    if wrong is not None and (stop is None or wrong < stop):
        raise ValueRangeError(f"{path} has rows that are no entries of {dims}")
    made = SparseTensor((parsed if stop is None else parsed.filter(F.col("row") < stop)).drop("row"), dims)
    return made.coalesce() if coalesce else made


def tensor_lines(x: SparseTensor, start_index: int = 1) -> DataFrame:
    """Row lines: indices by tabs, then the value with six decimals."""
    form = "%d\t" * x.nmodes + "%f"
    return x.df.orderBy(*x.modes).select(F.format_string(form, *[F.col(c) + start_index for c in x.modes], "val").alias("value"))


def dump_tensor(x: SparseTensor, path: str, start_index: int = 1) -> None:
    """One local text file, header first; rows come partition by partition."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as out:
        out.write(f"{x.nmodes}\n{' '.join(map(str, x.dims))}\n")
        for r in tensor_lines(x, start_index).toLocalIterator():
            out.write(r["value"] + "\n")


def write_tensor(x: SparseTensor, path: str, start_index: int = 1) -> None:
    """A folder of text parts, sorted, with the header in the first: no single task writes all."""
    spark = x.spark
    head = spark.createDataFrame([(f"{x.nmodes}\n{' '.join(map(str, x.dims))}",)], "value string").coalesce(1)
    head.unionByName(tensor_lines(x, start_index)).write.mode("overwrite").text(path)


def read_maps(spark: SparkSession, path: str, dims: Sequence[int]) -> list[DataFrame]:
    """A file of 1-based permutations, one a mode, concatenated: maps (old, new). Lines may break anywhere."""
    cells = numbered_lines(spark, path).select("first", F.posexplode("t").alias("pos", "token"))
    cells = settle(cells.select((F.col("first") + F.col("pos")).alias("n"), (F.col("token").try_cast("long") - 1).alias("new")), "maps")
    count = cells.count()
    if count != sum(dims):
        raise ValueRangeError(f"{count} numbers for modes of {dims}")
    out, at = [], 0
    for d in dims:
        own = cells.filter((F.col("n") >= at) & (F.col("n") < at + d)).select((F.col("n") - at).alias("old"), "new")
        found = own.filter(F.col("new").between(0, d - 1)).agg(F.countDistinct("new")).first()[0]
        if found != d:
            raise ValueRangeError(f"{path} has no permutation of {d}")
        out.append(own)
        at += d
    return out


def load(spark: SparkSession, path: str, start_index: int = 1, **options) -> SparseTensor:
    """By extension: .bin is binary, all else text."""
    if path.endswith(".bin"):
        from tensorloom.sources.binary import read_binary

        return read_binary(spark, path)
    return read_tensor(spark, path, start_index, **options)


def save_parquet(x: SparseTensor, path: str, keys=None) -> None:
    """Parquet, clustered by range of the keys (coordinates by default), so that range filters skip row groups."""
    keys = [F.col(c) for c in x.modes] if keys is None else keys
    x.cluster(keys).df.write.mode("overwrite").parquet(path)


def load_parquet(spark: SparkSession, path: str, dims: Sequence[int]) -> SparseTensor:
    return SparseTensor(spark.read.parquet(path), check_dims(dims))
