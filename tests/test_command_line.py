import pytest

from tensorloom.__main__ import MATRIX_OPS, TENSOR_OPS, main
from tensorloom.sources import market, text
from tensorloom.types import SparseMatrix, SparseTensor

from .data import T337, T337_DIMS, TINY


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    text.dump_tensor(SparseTensor.from_rows(spark, T337, T337_DIMS), str(d / "x.tns"))
    market.dump_matrix(SparseMatrix.from_rows(spark, TINY, 4, 4), str(d / "a.mtx"))
    return d


@pytest.mark.parametrize("op", TENSOR_OPS)
def test_tensor_operators(spark, files, op):
    found = main([op, "-i", str(files / "x.tns"), "-r", "2", "-n", "1", "-b", "1", "-k", "2", "-c", "3", "-o", str(files / "out")], spark)
    assert found and (files / "out").read_text() == found
    if op == "mttkrp":
        assert found.split("\n")[1] == "45.00\t116.00"
    if op == "kronecker":
        assert found.startswith("3\n16 16 9\n")


@pytest.mark.parametrize("op", MATRIX_OPS)
def test_matrix_operators(spark, files, op):
    found = main([op, "-i", str(files / "a.mtx"), "-r", "2", "-b", "1", "-k", "2"], spark)
    assert found
    if op == "spmv":
        assert found == "4\n13.000000\t21.000000\t7.000000\t5.000000\n"


def test_load_again(spark, files):
    main(["add", "-i", str(files / "x.tns"), "-o", str(files / "sum.tns")], spark)
    assert text.load(spark, str(files / "sum.tns")).collect() == sorted((*r[:3], 2.0 * r[3]) for r in T337)
