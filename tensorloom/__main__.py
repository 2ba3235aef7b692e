"""Command line: one operator on files. ``python -m tensorloom OPERATOR -i X.tns [-o OUT] …``

Tensors are text or .bin coordinate files, matrices Matrix Market files. A
result is printed, or written to the file given by -o.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tensorloom.operators import dense, vectors
from tensorloom.operators.cpd import cp_als, tucker
from tensorloom.sources import dump, market, text
from tensorloom.types import DenseMatrix, SemiSparseTensor, SparseMatrix, SparseTensor, Vector

TENSOR_OPS = "status sort reorder add sub dotmul dotdiv smul sdiv ttv ttm mttkrp kronecker khatri-rao matricize slice split convert cpd tucker".split()
MATRIX_OPS = "mstatus msort mreorder spmv spmm mconvert".split()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tensorloom", description=__doc__)
    p.add_argument("operator", choices=[*TENSOR_OPS, *MATRIX_OPS])
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-j", "--second", help="second operand of a binary operator")
    p.add_argument("-o", "--output")
    p.add_argument("-m", "--mode", type=int, default=0)
    p.add_argument("-r", "--rank", type=int, default=16)
    p.add_argument("-n", "--niters", type=int, default=10)
    p.add_argument("-t", "--tol", type=float, default=1e-5)
    p.add_argument("-a", "--scalar", type=float, default=1.0)
    p.add_argument("-s", "--start-index", type=int, default=1)
    p.add_argument("-b", "--sb-bits", type=int, default=7)
    p.add_argument("-k", "--sk-bits", type=int, default=10)
    p.add_argument("-c", "--sc-bits", type=int, default=14)
    p.add_argument("-e", "--order", default="lexi", help="lexi, bfs or random; for msort row, column, block or morton")
    p.add_argument("--kind", default="hicoo", help="target of convert")
    p.add_argument("--low", type=int, nargs="*")
    p.add_argument("--high", type=int, nargs="*")
    p.add_argument("--limits", type=int, nargs="*")
    p.add_argument("--master", default="local[*]")
    return p


def tensor_result(spark: SparkSession, a: argparse.Namespace):
    x = text.load(spark, a.input, a.start_index)
    y = text.load(spark, a.second, a.start_index) if a.second else x
    ramps = lambda: [dense.ramp(spark, d, a.rank) for d in x.dims]
    made = {
        "status": lambda: x.status(),
        "sort": lambda: x.sort_at_mode(a.mode),
        "reorder": lambda: x.reorder_by(a.order, 1)[0],
        "add": lambda: x.add(y),
        "sub": lambda: x.sub(y),
        "dotmul": lambda: x.dot_mul(y),
        "dotdiv": lambda: x.dot_div(y),
        "smul": lambda: x.mul_scalar(a.scalar),
        "sdiv": lambda: x.div_scalar(a.scalar),
        "ttv": lambda: x.ttv(vectors.constant_vector(spark, x.dims[a.mode], 1.0), a.mode),
        "ttm": lambda: x.ttm(dense.constant(spark, x.dims[a.mode], a.rank, 1.0), a.mode),
        "mttkrp": lambda: x.mttkrp(ramps(), a.mode),
        "kronecker": lambda: x.kronecker(y),
        "khatri-rao": lambda: x.khatri_rao(y),
        "matricize": lambda: x.matricize(a.mode),
        "slice": lambda: x.slice(a.low or [0] * x.nmodes, a.high or list(x.dims)),
        "split": lambda: dump.splits_text(x, a.limits or [0] * x.nmodes),
        "convert": lambda: x.to_semi_sparse(a.mode) if a.kind == "scoo" else x.to_hicoo(a.sb_bits, a.sk_bits, a.sc_bits),
        "cpd": lambda: dump.kruskal_text(cp_als(x, a.rank, a.niters, a.tol, "ramp" if a.rank <= 2 else "random")),
        "tucker": lambda: tucker(x, [min(a.rank, d) for d in x.dims], a.niters, a.tol)[0],
    }
    return made[a.operator]()


def matrix_result(spark: SparkSession, a: argparse.Namespace):
    x = market.read_matrix(spark, a.input)
    made = {
        "mstatus": lambda: x.status(),
        "msort": lambda: x.sort(a.order if a.order != "lexi" else "row", a.sb_bits),
        "mreorder": lambda: x.reorder(a.order)[0],
        "spmv": lambda: x.multiply_vector(vectors.constant_vector(spark, x.ncols, 1.0)),
        "spmm": lambda: x.multiply_matrix(dense.constant(spark, x.ncols, a.rank, 1.0)),
        "mconvert": lambda: x.convert(a.kind, sb_bits=a.sb_bits, sk_bits=a.sk_bits),
    }
    return made[a.operator]()


def as_text(found, start_index: int) -> str:
    """A result as text."""
    if isinstance(found, str):
        return found
    if isinstance(found, dict):
        return "".join(f"{k}: {v}\n" for k, v in found.items())
    if isinstance(found, SemiSparseTensor):
        found = found.to_coo()
    if isinstance(found, SparseTensor):
        head = f"{found.nmodes}\n{' '.join(map(str, found.dims))}\n"
        return head + "".join(r["value"] + "\n" for r in text.tensor_lines(found, start_index).toLocalIterator())
    if isinstance(found, SparseMatrix):
        rows = found.df.toLocalIterator()
        return f"{found.nrows} {found.ncols} {found.nnz()}\n" + "".join(f"{r['i'] + start_index}\t{r['j'] + start_index}\t{r['val']}\n" for r in rows)
    if isinstance(found, DenseMatrix):
        return dump.dense_text(found)
    if isinstance(found, Vector):
        return dump.vector_text(found)
    return dump.csr_text(found) if hasattr(found, "nrows") and not hasattr(found, "sb_bits") else dump.hicoo_text(found)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    own = spark or SparkSession.builder.master(a.master).appName("tensorloom").config("spark.ui.enabled", "false").getOrCreate()
    found = as_text((tensor_result if a.operator in TENSOR_OPS else matrix_result)(own, a), a.start_index)
    if a.output:
        with open(a.output, "w") as out:
            out.write(found)
    return found


if __name__ == "__main__":
    sys.stdout.write(main())
