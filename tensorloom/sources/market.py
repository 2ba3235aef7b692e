"""Matrix Market files: coordinates, and arrays in the order of columns."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tensorloom.sources.text import numbered_lines
from tensorloom.types import SparseMatrix, ValueRangeError

MAGIC = "%%MatrixMarket"
FIELDS = ("real", "integer", "pattern", "complex")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


@dataclass(frozen=True)
class Kind:
    layout: str
    field: str
    symmetry: str

    @property
    def banner(self) -> str:
        return f"{MAGIC} matrix {self.layout} {self.field} {self.symmetry}"

    def valid(self) -> bool:
        """Which combinations the format allows."""
        if self.layout == "array" and self.field == "pattern" or self.field == "real" and self.symmetry == "hermitian":
            return False
        return not (self.field == "pattern" and self.symmetry in ("hermitian", "skew-symmetric"))

    def readable(self) -> bool:
        return self.valid() and self.field in ("real", "integer", "pattern")


def parse_banner(line: str) -> Kind:
    words = line.split()
    if len(words) != 5 or words[0] != MAGIC or words[1].lower() != "matrix":
        raise ValueRangeError(f"no banner: {line[:80]}")
    kind = Kind(*(w.lower() for w in words[2:]))
    if kind.layout not in ("coordinate", "array") or kind.field not in FIELDS or kind.symmetry not in SYMMETRIES:
        raise ValueRangeError(f"banner {line[:80]}")
    return kind


def _banner(spark: SparkSession, path: str) -> Kind:
    """Of a file its first line; of a folder the first of the first part that has lines."""
    found = spark.read.text(path).filter(F.col("value").startswith("%%")).select("_metadata.file_path", "value").orderBy("file_path").head(1)
    if not found:
        first = spark.read.text(path).head(1)
        raise ValueRangeError(f"no banner: {first[0]['value'][:80]}" if first else f"{path} is empty")
    return parse_banner(found[0]["value"])


def _array_place(k: Column, nrows: int, ncols: int, symmetry: str) -> tuple[Column, Column]:
    """Row and column of the k-th value: by columns, of symmetric matrices what is on and below the diagonal (skew: below)."""
    if symmetry == "general":
        return k % nrows, F.floor(k / nrows)
    top = nrows - (1 if symmetry == "skew-symmetric" else 0)  # values of column 0; each later one has one less
    before = lambda j: j * F.lit(top) - F.floor(j * (j - 1) / 2)
    root = F.floor((F.lit(2.0 * top + 1) - F.sqrt(F.lit((2.0 * top + 1) ** 2) - 8.0 * k)) / 2).cast("long")
    j = F.when(before(root) > k, root - 1).when(before(root + 1) <= k, root + 1).otherwise(root)
    return k - before(j) + j + (nrows - top), j


def read_matrix(spark: SparkSession, path: str, skew: str = "plain") -> SparseMatrix:
    """Load a file or a folder of parts: real, integer or pattern (1.0). Indices are 1-based.

    "symmetric" mirrors what is off the diagonal. A skew-symmetric coordinate
    file stays as it is ("plain"), or its mirror is negated (skew="mirror").
    An array's values are placed by their number in the whole file, its
    zeros left out.
    """
    kind = _banner(spark, path)
    if not kind.readable():
        raise ValueRangeError(f"{kind.banner} is not read")
    tokens = numbered_lines(spark, path, "%")
    head = tokens.filter("first = 0").head(1)
    size = [int(t) for t in head[0]["t"]] if head else []
    if len(size) != (3 if kind.layout == "coordinate" else 2):
        raise ValueRangeError(f"sizes {size}")
    nrows, ncols = size[:2]
    own = tokens.filter("first > 0")
    if kind.layout == "array":
        cells = own.select("first", F.posexplode("t").alias("pos", "token")).select((F.col("first") + F.col("pos") - 2).alias("k"), F.col("token").cast("double").alias("val"))
        i, j = _array_place(F.col("k"), nrows, ncols, kind.symmetry)
        cells = cells.filter(F.col("val") != 0).select(i.cast("long").alias("i"), j.cast("long").alias("j"), "val")
        skew = "mirror"
    else:
        value = F.lit(1.0) if kind.field == "pattern" else F.col("t")[2].cast("double")
        own = own.filter(F.size("t") == (2 if kind.field == "pattern" else 3))
        cells = own.select((F.col("t")[0].cast("long") - 1).alias("i"), (F.col("t")[1].cast("long") - 1).alias("j"), value.alias("val"))
    if kind.symmetry == "symmetric" or kind.symmetry == "skew-symmetric" and skew == "mirror":
        sign = -1 if kind.symmetry == "skew-symmetric" else 1
        cells = cells.unionByName(cells.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("val") * sign).alias("val")))
    return SparseMatrix(cells, nrows, ncols)


def write_matrix(a: SparseMatrix, path: str, symmetry: str = "general") -> None:
    """A folder of text parts by rows, with banner and sizes in the first. Of a symmetric matrix the cells above the diagonal are left out."""
    kind = Kind("coordinate", "real", symmetry)
    if not kind.readable():
        raise ValueRangeError(f"{kind.banner} is not written")
    own = a.df if symmetry == "general" else a.df.filter("i >= j")
    lines = own.orderBy("i", "j").select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("val").cast("string")).alias("value"))
    head = a.spark.createDataFrame([(f"{kind.banner}\n{a.nrows} {a.ncols} {own.count()}",)], "value string").coalesce(1)
    head.unionByName(lines).write.mode("overwrite").text(path)


def dump_matrix(a: SparseMatrix, path: str, banner: bool = True, start_index: int = 1) -> None:
    """One local text file; with a banner read_matrix reads it again."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as out:
        if banner:
            out.write(Kind("coordinate", "real", "general").banner + "\n")
        out.write(f"{a.nrows} {a.ncols} {a.nnz()}\n")
        for r in a.df.orderBy("i", "j").toLocalIterator():
            out.write(f"{r['i'] + start_index}\t{r['j'] + start_index}\t{r['val']!r}\n")
