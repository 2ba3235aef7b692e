"""Text dumps for people of every layout. Rows come partition by partition."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.functions import bits as B
from tensorloom.functions.lineage import Tables, own_shuffles
from tensorloom.functions.ranks import row_numbers, running_totals
from tensorloom.types import CSRMatrix, DenseMatrix, HiCOOMatrix, HiCOOTensor, KruskalTensor, SparseTensor, Vector


def vector_text(v: Vector) -> str:
    """Length, then the values by tabs."""
    return f"{v.size}\n" + "\t".join(f"{r['val']:.6f}" for r in v.df.orderBy("i").toLocalIterator()) + "\n"


def dense_text(a: DenseMatrix) -> str:
    rows = ["\t".join(f"{v:.2f}" for v in r["row"]) for r in a.df.orderBy("i").toLocalIterator()]
    return "\n".join([f"{a.nrows} x {a.ncols} matrix", *rows]) + "\n"


def csr_text(a: CSRMatrix) -> str:
    rows = a.df.orderBy("i").collect()
    nnz = sum(len(r["cols"]) for r in rows)
    tabs = lambda xs: "\t".join(map(str, xs))
    parts = [f"{a.nrows} {a.ncols} {nnz}", tabs([*(r["rowptr"] for r in rows), nnz]), tabs(c for r in rows for c in r["cols"]), tabs(v for r in rows for v in r["vals"])]
    return "\n".join(parts) + "\n"


def hicoo_text(x: HiCOOTensor | HiCOOMatrix) -> str:
    """Shape and bits, then one JSON line a block."""
    shape = x.dims if isinstance(x, HiCOOTensor) else (x.nrows, x.ncols)
    keys = [c for c in x.df.columns if c != "entries"]
    lines = [r["j"] for r in x.df.orderBy(*keys).select(F.to_json(F.struct(*x.df.columns)).alias("j")).toLocalIterator()]
    return "\n".join([" ".join(map(str, shape)), f"{x.sb_bits} {x.sk_bits}", *lines]) + "\n"


def _write(df: DataFrame, path: str, head: str, order: list[str], line: Column) -> None:
    """A folder of text parts in order, ``head`` in the first."""
    first = df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1)
    first.unionByName(df.orderBy(*order).select(line.alias("value"))).write.mode("overwrite").text(path)


def write_csr(a: CSRMatrix, path: str) -> None:
    """Sizes, then a line for each row: its number, the entries before it, columns and values, by tabs; columns and values by blanks."""
    lists = [F.array_join(F.transform(c, lambda v: v.cast("string")), " ") for c in ("cols", "vals")]
    _write(a.df, path, f"{a.nrows} {a.ncols}", ["i"], F.concat_ws("\t", F.col("i").cast("string"), F.col("rowptr").cast("string"), *lists))


def write_dense(a: DenseMatrix, path: str) -> None:
    """Sizes, then a line for each row: its number and its values by tabs."""
    _write(a.df, path, f"{a.nrows} {a.ncols}", ["i"], F.concat_ws("\t", F.col("i").cast("string"), F.transform("row", lambda v: v.cast("string"))))


def write_vector(v: Vector, path: str) -> None:
    """Length, then a line for each value: its number and itself."""
    _write(v.df, path, str(v.size), ["i"], F.concat_ws("\t", F.col("i").cast("string"), F.col("val").cast("string")))


def hicoo_pointers(x: HiCOOTensor, tables: Tables | None = None) -> DataFrame:
    """level, n and place of a blocked tensor's pointers: first block of each kernel (0) and chunk (1), first entry of each block (2).

    Kernels follow one another by their coordinates, blocks of a kernel in
    Z-order. Each level ends with what comes after its last: numbers of blocks,
    blocks and entries. The result reads ``tables``, which its owner drops.
    """
    m = range(x.nmodes)
    levels = max(1, x.sk_bits - x.sb_bits)
    inside = B.morton_words([B.offset(F.col(f"b{k}"), levels) for k in m], levels)
    kernel = [f"k{k}" for k in m]
    blocks = x.df.select(*kernel, *[z.alias(f"z{k}") for k, z in enumerate(inside)], "chunk", F.size("entries").cast("long").alias("nnz"))
    tables = Tables(x.df.sparkSession, "pointers") if tables is None else tables
    placed = row_numbers(blocks, [F.col(c) for c in blocks.columns[:-2]], "block", tables, [*kernel, "chunk", "nnz"])
    step = 4096  # running sums are taken by runs of blocks, then the runs' totals are added
    runs = placed.select("block", "nnz", F.floor(F.col("block") / step).alias("run"))
    totals = tables.write(running_totals(runs.groupBy("run").agg(F.sum("nnz").alias("total")), [F.col("run")], "total", "upto"))
    own = F.sum("nnz").over(Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    entries = runs.withColumn("own", F.coalesce(own, F.lit(0))).join(totals, "run")
    entries = entries.select(F.lit(2).alias("level"), F.col("block").alias("n"), (F.col("upto") - F.col("total") + F.col("own")).alias("place"))
    # A kernel begins with its first chunk.
    chunks = tables.write(placed.groupBy(*kernel, "chunk").agg(F.min("block").alias("place")).select((F.col("chunk") == 0).alias("first"), "place"))
    firsts = [row_numbers(own, [F.col("place")], "n", tables) for own in (chunks.filter("first").select("place"), chunks.select("place"))]
    rows = entries
    for level, own in enumerate(firsts):
        rows = rows.unionByName(own.select(F.lit(level).alias("level"), "n", "place"))
    nblocks, nnz = placed.agg(F.count("*"), F.coalesce(F.sum("nnz"), F.lit(0))).first()
    ends = [*((level, own.count(), nblocks) for level, own in enumerate(firsts)), (2, nblocks, nnz)]
    return rows.unionByName(x.df.sparkSession.createDataFrame(ends, "level int, n long, place long"))


def write_hicoo(x: HiCOOTensor, path: str) -> None:
    """A folder: shape and bits, pointers as lines of level, number and place, and blocks as JSON lines in the pointers' order, each in parts; the blocks' parts are compressed."""
    spark = x.df.sparkSession
    spark.createDataFrame([(" ".join(map(str, x.dims)),), (f"{x.sb_bits} {x.sk_bits} {x.sc_bits}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    tables, own = Tables(spark, "pointers"), Tables(spark, "blocks")
    x = replace(x, df=own.write(x.df))
    m = range(x.nmodes)
    levels = max(1, x.sk_bits - x.sb_bits)
    order = [*[F.col(f"k{k}") for k in m], *B.morton_words([B.offset(F.col(f"b{k}"), levels) for k in m], levels)]
    pointers = hicoo_pointers(x, tables).orderBy("level", "n").select(F.concat_ws(" ", "level", "n", "place").alias("value"))
    with own_shuffles(spark):
        pointers.write.mode("overwrite").text(f"{path}/pointers")
        tables.drop(0)
        x.df.orderBy(*order).select(F.to_json(F.struct(*x.df.columns)).alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{path}/blocks")
    own.drop(0)


def kruskal_text(k: KruskalTensor) -> str:
    head = [str(len(k.factors)), str(k.rank), " ".join(map(str, k.dims)), f"{k.fit:.6f}", "\t".join(f"{w:.6f}" for w in k.weights)]
    return "\n".join(head) + "\n" + "".join(dense_text(f) for f in k.factors)


def save_kruskal(k: KruskalTensor, path: str) -> None:
    """Weights and factors as Parquet."""
    spark = k.factors[0].spark
    spark.createDataFrame(list(enumerate(k.weights)), "r int, weight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    for m, f in enumerate(k.factors):
        f.df.write.mode("overwrite").parquet(f"{path}/factor{m}")


def splits_text(x: SparseTensor, limits) -> str:
    """Bounds and entries of each part of a split."""
    bounds = {r["split_id"]: r for r in x.split_bounds(limits).collect()}
    out, last = [], None
    for r in x.split(limits).orderBy("split_id", *x.modes).toLocalIterator():
        if r["split_id"] != last:
            last, b = r["split_id"], bounds[r["split_id"]]
            out.append(f"part {last}: {b['nnz']} entries, " + " x ".join(f"[{b[f'lo{m}']}, {b[f'hi{m}']})" for m in range(x.nmodes)))
        out.append("\t".join([*(str(r[c]) for c in x.modes), f"{r['val']:.6f}"]))
    return "\n".join(out) + "\n"
