"""Binary coordinate files: a header of widths, modes, sizes and count, one array a mode, then the values.

Header: magic (int32), index and value widths (uint64). Numbers after it
have these widths. Indices are 0-based.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tensorloom.types import SparseTensor, ValueRangeError, check_dims, coords

HEADER = struct.Struct("<iQQ")
INDEX = {4: np.dtype("<u4"), 8: np.dtype("<u8")}
VALUE = {4: np.dtype("<f4"), 8: np.dtype("<f8")}
#: Tasks that read ranges, at most; a task takes any number of them.
PARTS = 10_000


def parse_header(data: bytes) -> tuple[np.dtype, np.dtype, tuple[int, ...], int, int]:
    """Index and value types, dims, number of entries, and where the arrays begin."""
    if len(data) < HEADER.size:
        raise ValueRangeError("the file ends in its header")
    _, index_width, value_width = HEADER.unpack_from(data)
    if index_width not in INDEX or value_width not in VALUE:
        raise ValueRangeError(f"widths {index_width} and {value_width}")
    kind, at = INDEX[index_width], HEADER.size
    if len(data) < at + kind.itemsize:
        raise ValueRangeError("the file ends in its header")
    n = int(np.frombuffer(data, kind, 1, at)[0])
    if len(data) < at + kind.itemsize * (n + 2):
        raise ValueRangeError("the file ends in its header")
    numbers = np.frombuffer(data, kind, n + 2, at)
    return kind, VALUE[value_width], check_dims(numbers[1 : n + 1].tolist()), int(numbers[n + 1]), at + kind.itemsize * (n + 2)


def _system(path: str):
    """File system and place of a path or URI; None where pyarrow has no file system for it."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))
    except pa.ArrowInvalid:
        return None


def _files(path: str) -> list[tuple[str, int]]:
    """Files at a path (its own or a folder's, without hidden ones) and their sizes."""
    from pyarrow import fs

    system, place = _system(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise ValueRangeError(f"{path} is missing")
    if info.is_file:
        return [(place, info.size)]
    return sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(place)) if f.is_file and not f.base_name.startswith((".", "_")))


def _ranges(path: str, names: list[str]):
    """Rows (file, first, last, header's end, widths, entries) to the entries from first to last: each array is read at its place."""

    def run(batches):
        system, _ = _system(path)
        for batch in batches:
            for r in batch.to_pylist():
                kind, value = INDEX[r["index_width"]], VALUE[r["value_width"]]
                n, size = r["last"] - r["first"], r["entries"]
                with system.open_input_file(r["file"]) as f:
                    arrays = []
                    for m in range(len(names) + 1):
                        own = kind if m < len(names) else value
                        f.seek(r["begin"] + min(m, len(names)) * size * kind.itemsize + r["first"] * own.itemsize)
                        arrays.append(np.frombuffer(f.read(n * own.itemsize), own))
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in arrays[:-1]), pa.array(arrays[-1].astype(np.float64))], [*names, "val"])

    return run


def read_binary(spark: SparkSession, path: str, step: int = 1 << 20) -> SparseTensor:
    """Load a binary tensor, a file or a folder of them, in ranges of ``step`` entries: a task seeks to its part of each array.

    The driver reads the headers only. Where pyarrow has no file system for
    the path, Spark reads files whole.
    """
    if _system(path) is None:
        return _read_whole(spark, path, step)
    system, _ = _system(path)
    heads, dims = [], None
    for name, size in _files(path):
        with system.open_input_file(name) as f:
            kind, value, own, nnz, begin = parse_header(f.read(4096))
        if dims not in (None, own):
            raise ValueRangeError(f"{name} has another shape than the files before")
        if size < begin + nnz * (len(own) * kind.itemsize + value.itemsize):
            raise ValueRangeError("the file ends before its values")
        dims = own
        heads.append((name, nnz, begin, kind.itemsize, value.itemsize))
    if dims is None:
        raise ValueRangeError(f"{path} is missing")
    files = spark.createDataFrame(heads, "file string, entries long, begin long, index_width long, value_width long").filter("entries > 0")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("entries") - 1, F.lit(step).cast("long"))).alias("first")
    ranges = files.select("*", first).withColumn("last", F.least(F.col("first") + step, F.col("entries")))
    total = sum(-(-h[1] // step) for h in heads)
    names = coords(len(dims))
    rows = ranges.repartition(max(1, min(total, PARTS))).mapInArrow(_ranges(path, names), ", ".join([*(f"{c} long" for c in names), "val double"]))
    return SparseTensor(rows, dims).coalesce()


def _read_whole(spark: SparkSession, path: str, step: int) -> SparseTensor:
    """One task a file decodes it in steps."""
    head = spark.read.format("binaryFile").load(path).selectExpr("substring(content, 1, 4096) AS head").first()
    if head is None:
        raise ValueRangeError(f"{path} is missing")
    _, _, dims, _, _ = parse_header(bytes(head["head"]))
    names = coords(len(dims))

    def decode(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                kind, value, own, nnz, at = parse_header(data)
                if len(data) < at + nnz * (len(own) * kind.itemsize + value.itemsize):
                    raise ValueRangeError("the file ends before its values")
                arrays = [np.frombuffer(data, kind, nnz, at + m * nnz * kind.itemsize) for m in range(len(own))]
                values = np.frombuffer(data, value, nnz, at + len(own) * nnz * kind.itemsize)
                for a in range(0, nnz, step):
                    yield pd.DataFrame({c: x[a : a + step].astype(np.int64) for c, x in zip(names, arrays, strict=True)} | {"val": values[a : a + step].astype(np.float64)})

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInPandas(decode, ", ".join([*(f"{c} long" for c in names), "val double"]))
    return SparseTensor(rows, dims).coalesce()


def packed(dims: Sequence[int], indices: Sequence[Sequence[int]], values: Sequence[float], index_width: int = 8, value_width: int = 8) -> bytes:
    """A whole file's bytes."""
    kind, value = INDEX[index_width], VALUE[value_width]
    head = HEADER.pack(0, index_width, value_width) + np.array([len(dims), *dims, len(values)], kind).tobytes()
    return head + b"".join(np.asarray(own, kind).tobytes() for own in indices) + np.asarray(values, value).tobytes()


def write_binary_parts(x: SparseTensor, path: str, index_width: int = 8, value_width: int = 8) -> None:
    """A folder of binary files, each whole: tasks write what they hold, a batch a file, under names that a task tried again takes again."""
    dims, names = x.dims, x.modes
    if _system(path) is None:
        raise ValueRangeError(f"no file system for {path}")

    def run(batches):
        from pyspark import TaskContext

        system, place = _system(path)
        system.create_dir(place, recursive=True)
        for k, batch in enumerate(batches):
            data = packed(dims, [batch.column(m).to_numpy() for m in range(len(names))], batch.column(len(names)).to_numpy(), index_width, value_width)
            with system.open_output_stream(f"{place}/part-{TaskContext.get().partitionId():06d}-{k:06d}.bin") as out:
                out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    x.df.select(*names, "val").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_binary(path: str, dims: Sequence[int], indices: Sequence[Sequence[int]], values: Sequence[float], index_width: int = 8, value_width: int = 8) -> None:
    """One local file."""
    with open(path, "wb") as out:
        out.write(packed(dims, indices, values, index_width, value_width))
