import numpy as np
import pytest

from tensorloom.operators import dense, vectors
from tensorloom.operators.cpd import cp_als
from tensorloom.sources import binary, dump, market, text
from tensorloom.types import SparseMatrix, SparseTensor, ValueRangeError

from .data import T337, T337_DIMS, TINY

ROWS = sorted((*r[:3], float(r[3])) for r in T337)


def test_text_round_trip(spark, tmp_path):
    x = SparseTensor.from_rows(spark, T337, T337_DIMS)
    path = str(tmp_path / "x.tns")
    text.dump_tensor(x, path, 1)
    assert open(path).read().startswith("3\n4 4 3\n1\t1\t1\t1.000000\n")
    y = text.load(spark, path)
    assert y.dims == T337_DIMS and y.collect() == ROWS
    text.write_tensor(x, str(tmp_path / "parts"), 0)
    z = text.read_tensor(spark, str(tmp_path / "parts"), 0)
    assert z.collect() == ROWS
    text.save_parquet(x, str(tmp_path / "pq"))
    assert text.load_parquet(spark, str(tmp_path / "pq"), T337_DIMS).collect() == ROWS


def test_text_variants(spark, tmp_path):
    path = tmp_path / "y.tns"
    path.write_text("2\n3 3\n 1 1  2.5e0\n1\t1 1\n3 2 -1")
    assert text.read_tensor(spark, str(path)).collect() == [(0, 0, 3.5), (2, 1, -1.0)]
    assert text.read_tensor(spark, str(path), coalesce=False).nnz() == 3
    path.write_text("1 1 2\n2 2 3\n")
    assert text.read_tensor(spark, str(path), header=False, dims=(2, 2)).collect() == [(0, 0, 2.0), (1, 1, 3.0)]
    with pytest.raises(ValueRangeError):
        text.read_tensor(spark, str(path))
    path.write_text("2\n3 3\n1 1 2\n4 1 1\nx 1 1\n")
    with pytest.raises(ValueRangeError):
        text.read_tensor(spark, str(path))
    assert text.read_tensor(spark, str(path), mode="drop").collect() == [(0, 0, 2.0)]
    with pytest.raises(ValueRangeError):
        text.read_tensor(spark, str(path), 2)
    path.write_text("1\n3\n1 5\n3 6\n")
    assert text.read_tensor(spark, str(path)).collect() == [(0, 5.0), (2, 6.0)]
    maps = tmp_path / "maps"
    maps.write_text("2 1\n3 1 2\n")
    got = text.read_maps(spark, str(maps), (2, 3))
    assert [r.new for r in got[1].orderBy("old").collect()] == [2, 0, 1]
    with pytest.raises(ValueRangeError):
        text.read_maps(spark, str(maps), (3, 3))


@pytest.mark.parametrize("index,value", [(4, 4), (8, 8), (4, 8)])
def test_binary(spark, tmp_path, index, value):
    path = str(tmp_path / "x.bin")
    binary.write_binary(path, T337_DIMS, list(zip(*[r[:3] for r in T337], strict=True)), [r[3] for r in T337], index, value)
    x = text.load(spark, path)
    assert x.dims == T337_DIMS and x.collect() == ROWS
    short = tmp_path / "short.bin"
    short.write_bytes(open(path, "rb").read()[:10])
    with pytest.raises(ValueRangeError):
        binary.read_binary(spark, str(short))


def test_market(spark, tmp_path):
    a = SparseMatrix.from_rows(spark, TINY, 4, 4)
    path = str(tmp_path / "a.mtx")
    market.dump_matrix(a, path)
    assert market.read_matrix(spark, path).collect() == a.collect()
    p = tmp_path / "b.mtx"
    p.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% c\n3 3 3\n1 1\n2 1\n3 3\n")
    assert market.read_matrix(spark, str(p)).collect() == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0)]
    p.write_text("%%MatrixMarket MATRIX Coordinate Integer skew-symmetric\n3 3 1\n2 1 5\n")
    assert market.read_matrix(spark, str(p)).collect() == [(1, 0, 5.0)]
    assert market.read_matrix(spark, str(p), skew="mirror").collect() == [(0, 1, -5.0), (1, 0, 5.0)]
    for banner in ("matrix array real general", "matrix coordinate real hermitian", "matrix coordinate complex general", "matrix coordinate pattern skew-symmetric", "vector coordinate real general"):
        p.write_text(f"%%MatrixMarket {banner}\n1 1 1\n1 1 1\n")
        with pytest.raises(ValueRangeError):
            market.read_matrix(spark, str(p))


def test_dumps(spark):
    x = SparseTensor.from_rows(spark, T337, T337_DIMS)
    a = SparseMatrix.from_rows(spark, TINY, 4, 4)
    assert dump.vector_text(vectors.vector(spark, [1, 2])) == "2\n1.000000\t2.000000\n"
    assert dump.dense_text(dense.ramp(spark, 2, 2)) == "2 x 2 matrix\n1.00\t2.00\n2.00\t3.00\n"
    assert dump.csr_text(a.to_csr()).split("\n")[:2] == ["4 4 9", "0\t3\t6\t8\t9"]
    assert len(dump.hicoo_text(x.to_hicoo(1, 2)).strip().split("\n")) == 2 + 5
    assert len(dump.hicoo_text(a.to_hicoo(1, 2)).strip().split("\n")) > 3
    k = cp_als(x, 2, niters=1, init="ramp")
    assert dump.kruskal_text(k).startswith("3\n2\n4 4 3\n")
    assert dump.splits_text(x, [3, 0, 0]).startswith("part 0")


def test_from_table(spark):
    df = spark.createDataFrame([(1, 2, 3.0), (1, 2, 4.0), (None, 1, 1.0), (0, 0, None)], "a long, b int, v double")
    x = SparseTensor.from_table(df, ["a", "b - 1"], "v", (2, 3))
    assert x.collect() == [(1, 1, 7.0)]
    assert np.isclose(x.norm(), 7)
