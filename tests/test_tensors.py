import math
import random

import numpy as np
import pytest

from tensorloom.operators import cpd, dense, reorder, sorting, vectors
from tensorloom.operators import matrix as mx
from tensorloom.types import GeneralSemiSparseTensor, KruskalTensor, ShapeMismatchError, SparseMatrix, SparseTensor, ValueRangeError, ZeroDivisorError

from .data import T337, T337_DIMS, TINY, ramp


@pytest.fixture(scope="module")
def x(spark):
    return SparseTensor.from_rows(spark, T337, T337_DIMS)


def as_array(t):
    out = np.zeros(t.dims)
    for *at, v in t.collect():
        out[tuple(at)] += v
    return out


def some(spark, dims, n, seed):
    rnd = random.Random(seed)
    cells = {tuple(rnd.randrange(d) for d in dims): rnd.randint(1, 9) for _ in range(n)}
    return SparseTensor.from_rows(spark, [(*k, v) for k, v in cells.items()], dims)


def test_elementwise(spark, x):
    y = some(spark, T337_DIMS, 12, 1)
    a, b = as_array(x), as_array(y)
    assert np.array_equal(as_array(x + y), a + b) and np.array_equal(as_array(x - y), a - b)
    assert np.array_equal(as_array(x.dot_mul(y)), a * b)
    assert (x - x).nnz() == 0 and np.array_equal(as_array(x + x), 2 * a) and np.array_equal(as_array(x.dot_mul(x)), a * a)
    assert {v for *_, v in (x / x).collect()} == {1.0} and (2 * x / 2).collect() == x.collect()
    assert ((x + y) - y).collect() == x.collect()
    assert x.mul_scalar(0).nnz() == 0 and np.array_equal(as_array(-x), -a)
    assert x.dot_mul_eq(x.mul_scalar(2)).collect() == x.dot_mul(x.mul_scalar(2)).collect()
    with pytest.raises(ShapeMismatchError):
        x.dot_mul_eq(y)
    with pytest.raises(ZeroDivisorError):
        x / 0
    with pytest.raises(ShapeMismatchError):
        x + SparseTensor.empty(spark, (4, 4, 4))
    with pytest.raises(TypeError):
        x * y


def test_division_by_zero_and_special_values(spark):
    a = SparseTensor.from_rows(spark, [(0, 1.0), (1, -1.0), (2, 0.0), (3, float("nan")), (4, 4.0)], (6,))
    b = SparseTensor.from_rows(spark, [(0, 0.0), (1, 0.0), (2, 0.0), (3, 2.0), (4, 2.0), (5, 1.0)], (6,))
    got = {i: v for i, v in a.dot_div(b).collect()}
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == 2.0 and 5 not in got
    assert [i for i, _ in a.collect_zeros().collect()] == [0, 1, 3, 4]


def test_ttv_ttm(spark, x):
    a = as_array(x)
    want = {0: {(0, 0): 1, (0, 1): 12, (0, 2): 3, (1, 0): 10, (2, 0): 10, (3, 0): 10}}
    for m in range(3):
        v = vectors.vector(spark, [1.0] * T337_DIMS[m])
        y = x.ttv(v, m)
        assert y.dims == tuple(1 if k == m else d for k, d in enumerate(T337_DIMS))
        assert np.array_equal(as_array(y), a.sum(axis=m, keepdims=True))
        if m in want:
            assert {(r[1], r[2]): r[3] for r in y.collect()} == want[m]
        u = dense.ramp(spark, T337_DIMS[m], 3)
        z = x.ttm(u, m)
        full = np.moveaxis(np.tensordot(a, np.array(ramp(T337_DIMS[m], 3)), (m, 0)), -1, m)
        assert np.array_equal(as_array(z.to_coo()), full)
        assert z.df.count() == {0: 6, 1: 6, 2: 9}[m]
        assert np.array_equal(as_array(x.to_hicoo(1, 2).ttm_hicoo(u, m).to_coo()), full)
        w = dense.ramp(spark, 3, 2)
        assert np.array_equal(as_array(z.ttm_semi_sparse(w, m).to_coo()), np.moveaxis(np.tensordot(full, np.array(ramp(3)), (m, 0)), -1, m))
        with pytest.raises(ShapeMismatchError):
            z.ttm_semi_sparse(w, (m + 1) % 3)
    with pytest.raises(ShapeMismatchError):
        x.ttv(vectors.vector(spark, [1.0]), 0)
    wide = dense.constant(spark, 4, 70, 1.0)
    assert all(len(r[-1]) == 70 for r in x.ttm(wide, 0).collect())


def test_mttkrp(spark, x):
    want = {0: [[45, 116], [48, 138], [21, 56], [10, 30]], 1: [[96, 190], [18, 56], [24, 68], [10, 40]], 2: [[149, 324], [34, 92], [9, 24]]}
    factors = [dense.ramp(spark, d, 2) for d in T337_DIMS]
    for m, rows in want.items():
        assert x.mttkrp(factors, m).collect() == rows
        assert x.to_hicoo(1, 2).mttkrp(factors, m).collect() == rows
    assert x.mttkrp_split(factors, 0, [2, 0, 0]).collect() == want[0]
    y = some(spark, (3, 4, 5, 2), 30, 2)
    f4 = [dense.ramp(spark, d, 3) for d in y.dims]
    full = np.einsum("abcd,ar,cr,dr->br", as_array(y), *[np.array(ramp(d, 3)) for k, d in enumerate(y.dims) if k != 1])
    assert np.array_equal(y.mttkrp(f4, 1).collect(), full)
    with pytest.raises(ShapeMismatchError):
        x.mttkrp(factors[:2], 0)


def test_contract_kronecker_khatri_rao_matricize(spark, x):
    y = some(spark, (3, 5), 9, 3)
    z = x.contract(y, [2], [0])
    assert z.dims == (4, 4, 5) and np.array_equal(as_array(z), np.tensordot(as_array(x), as_array(y), (2, 0)))
    assert x.inner(x) == 304.0
    k = x.kronecker(x)
    assert k.dims == (16, 16, 9) and k.nnz() == 81 and sum(r[-1] for r in k.collect()) == 2116
    assert np.array_equal(as_array(k), np.kron(as_array(x), as_array(x)))
    r = x.khatri_rao(x)
    assert r.dims == (16, 16, 3) and r.nnz() == 41 and sum(v[-1] for v in r.collect()) == 1114
    a = as_array(x)
    for m, (p, q) in {0: (1, 2), 1: (2, 0), 2: (0, 1)}.items():
        full = np.transpose(a, (m, p, q)).reshape(T337_DIMS[m], -1)
        row, col = x.matricize(m), x.matricize(m, 0)
        assert np.array_equal(as_array(row.as_tensor()), full) and np.array_equal(as_array(col.as_tensor()), full.T)
    with pytest.raises(ValueRangeError):
        x.matricize(0, 2)
    with pytest.raises(ValueRangeError):
        SparseTensor.empty(spark, (1 << 40, 1)).kronecker(SparseTensor.empty(spark, (1 << 40, 1)))


def test_layouts(spark, x):
    for m in range(3):
        s = x.to_semi_sparse(m)
        assert s.to_coo().collect() == x.collect() and s.norm() == pytest.approx(304**0.5)
        assert s.set_mode((m + 1) % 3).to_coo().collect() == x.collect()
    for bits, blocks in {1: 5, 2: 1, 3: 1}.items():
        h = x.to_hicoo(bits, 3, 3)
        assert h.df.count() == blocks and h.to_coo().collect() == x.collect()
    st = x.to_hicoo(1, 2).status()
    assert (st["nb"], st["nnz"], st["nk"], st["max_nnzb"]) == (5, 9, 1, 4) and st["alpha_b"] == pytest.approx(5 / 9)
    assert SparseTensor.empty(spark, (4, 4, 3)).to_hicoo(1, 2).status()["nb"] == 0
    y = some(spark, (70, 50, 40, 30), 200, 4)
    assert y.to_hicoo(3, 5, 4).to_coo().collect() == y.collect()
    with pytest.raises(ValueRangeError):
        x.to_hicoo(3, 2)
    e = x.to_semi_sparse(2).append_element((0, 0, 0), 5.0).append_element((3, 3, 2), 1.0)
    assert as_array(e.to_coo())[0, 0, 0] == 5 and as_array(e.to_coo())[3, 3, 2] == 1
    c = x.to_semi_sparse(2).semi_sparse_to_csr()
    assert (c.nrows, c.ncols) == (9, 3) and [r.rowptr for r in c.df.orderBy("i").collect()] == [3 * k for k in range(9)]
    f = x.fibers(0).orderBy("start").collect()
    assert [r.start for r in f] == np.r_[0, np.cumsum([r.n for r in f])[:-1]].tolist() and len(f) == 6
    assert x.shuffle_modes([2, 0, 1]).dims == (3, 4, 4) and np.array_equal(as_array(x.shuffle_modes([2, 0, 1])), np.transpose(as_array(x), (2, 0, 1)))
    assert GeneralSemiSparseTensor.empty(spark, (2, 3, 4), (1, 2)).strides == (4, 1)


def test_matrices(spark):
    a = SparseMatrix.from_rows(spark, TINY, 4, 4)
    ones, up = vectors.constant_vector(spark, 4, 1.0), vectors.vector(spark, [1, 2, 3, 4])
    for kind in ("coo", "csr", "hicoo"):
        b = a.convert(kind, sb_bits=1, sk_bits=2)
        assert b.multiply_vector(ones).collect() == [13, 21, 7, 5] and b.multiply_vector_buff(up).collect() == [45, 41, 15, 5]
        assert b.multiply_vector(ones, up).collect() == [14, 23, 10, 9]
        assert b.multiply_matrix(dense.ramp(spark, 4, 2)).collect() == [[45, 58], [41, 62], [15, 22], [5, 10]]
        assert b.multiply_matrix(dense.ramp(spark, 4, 2), dense.constant(spark, 4, 2, 1)).collect()[0] == [46, 59]
        assert mx.to_coo(b).collect() == sorted((i, j, float(v)) for i, j, v in TINY)
        assert b.status()["nnz"] == 9
    assert [r.rowptr for r in a.to_csr().df.orderBy("i").collect()] == [0, 3, 6, 8]
    assert a.convert("dense").collect() == [[1, 2, 0, 10], [7, 8, 6, 0], [3, 0, 4, 0], [5, 0, 0, 0]]
    for kind in ("row", "column", "block", "morton"):
        assert a.sort(kind, 1).collect() == a.collect()
    assert [tuple(r)[:2] for r in a.sort("morton", 1).df.collect()][:4] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    for kind in ("lexi", "bfs", "random"):
        b, maps = a.reorder(kind)
        back = mx.relabel(b, *reorder.inverse_maps(maps))
        assert back.collect() == a.collect()
    with pytest.raises(ShapeMismatchError):
        a.multiply_vector(vectors.vector(spark, [1]))


def test_sorts_and_keys(spark, x):
    assert [tuple(r) for r in x.sort([2, 0, 1]).df.collect()] == sorted((tuple(r) for r in x.df.collect()), key=lambda r: (r[2], r[0], r[1]))
    assert x.sort([2, 0, 1]).sort([2, 0]).sort_order == (2, 0, 1)
    assert [r[0] for r in x.sort_at_mode(0).df.select("i0").collect()] and x.sort_at_mode(1).sort_order == (0, 2, 1)
    for y in (x.sort_single_mode(1), x.sort_except_mode([0, 2]), x.sort_row_block(1), x.sort_row_block_except_mode([0, 1], 1), x.sort_morton(), x.sort_morton_except_mode([0, 1], 1), x.sort_mixed(1, 2), x.sort_partial([0, 1, 2], 1), x.cluster([x.df["i0"]])):
        assert y.collect() == x.collect()

    def z(at, bits=2):
        return sum((c >> b & 1) << (3 * b + 2 - m) for m, c in enumerate(at) for b in range(bits))

    rows = [tuple(r)[:3] for r in x.sort_morton().df.collect()]
    assert rows == sorted(rows, key=z) and z((1, 2, 3)) == 29
    one = SparseTensor.from_rows(spark, [(1, 2, 3, 1)], (4, 4, 4)).z_keys().first()
    assert one.z0 == 29
    big = SparseTensor.from_rows(spark, [(1 << 30, 5, (1 << 33) + 1, 1), (3, 1 << 32, 7, 2)], (1 << 31, 1 << 33, 1 << 34))
    assert "z1" in big.z_keys().columns and big.sort_morton().nnz() == 2
    assert sorting.best_mode_order((6, 9, 10), 1) == [1, 0, 2] and sorting.worst_mode_order((6, 9, 10), 1) == [2, 0, 1]


def slow_lexi(t, mode):
    others = sorted({(*r[:mode], *r[mode + 1 : t.nmodes]) for r in t.collect()})
    lists = {i: [] for i in range(t.dims[mode])}
    for r in t.collect():
        lists[r[mode]].append(others.index((*r[:mode], *r[mode + 1 : t.nmodes])))
    order = sorted(lists, key=lambda i: ([*sorted(lists[i]), 1 << 63], i))
    return {old: new for new, old in enumerate(order)}


def test_reorder(spark, x):
    for maps in (x.lexi_order(1), x.random_maps(7), x.bfs_order()):
        for m, own in enumerate(maps):
            got = sorted((r.old, r.new) for r in own.collect())
            assert [o for o, _ in got] == list(range(T337_DIMS[m])) and sorted(n for _, n in got) == list(range(T337_DIMS[m]))
        y = x.relabel(maps)
        assert y.norm() == pytest.approx(x.norm()) and y.relabel(reorder.inverse_maps(maps)).collect() == x.collect()
    big = some(spark, (12, 15, 6), 60, 5)
    for m in (0, 2):
        assert {r.old: r.new for r in big.lexi_map(m).collect()} == slow_lexi(big, m)
    assert x.shuffle_elements(3).collect() == x.collect()


def test_split_and_stats(spark, x):
    y = some(spark, (20, 10, 8), 150, 6)
    for limits in ([30, 0, 0], [2, 10, 0], [0, 0, 25], [2, 2, 5]):
        parts = y.split(limits)
        assert sorted(tuple(r)[:-1] for r in parts.collect()) == y.collect()
        bounds = y.split_bounds(limits).collect()
        assert sum(b.nnz for b in bounds) == y.nnz()
        if limits == [30, 0, 0]:
            assert all(b.nnz <= 30 or b.hi0 - b.lo0 == 1 for b in bounds)
            spans = sorted((b.lo0, b.hi0) for b in bounds)
            assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:], strict=False))
    dealt = y.distribute(3).collect()
    assert sum(d.nnz for d in dealt) == y.nnz() and len(dealt) <= 3
    assert y.slice([2, 0, 0], [9, 10, 4]).collect() == [r for r in y.collect() if 2 <= r[0] < 9 and r[2] < 4]
    assert [r.nnz for r in x.slice_sizes(2).orderBy("i").collect()] == [6, 2, 1]
    assert tuple(x.index_bounds().first()) == (0, 4, 0, 4, 0, 3)
    assert tuple(SparseTensor.empty(spark, (2, 2)).index_bounds().first()) == (0, 0, 0, 0)
    assert x.density() == pytest.approx(0.1875) and x.frob_norm_sq() == 304 and x.status()["nnz"] == 9
    dup = SparseTensor.from_rows(spark, [(0, 0, 1), (0, 0, 2)], (2, 2), coalesce=False)
    assert dup.has_duplicates() and not dup.coalesce().has_duplicates() and dup.out_of_range().isEmpty()


def test_dense(spark):
    a = dense.ramp(spark, 5, 3)
    n = np.array(ramp(5, 3))
    assert np.array_equal(a.gram(), n.T @ n)
    b, norms = a.normalize_2norm()
    assert np.allclose(norms, np.linalg.norm(n, axis=0)) and np.allclose(b.collect(), n / np.linalg.norm(n, axis=0))
    c, tops = dense.from_rows(spark, [[-5, 0.5], [2, 0.25]]).normalize_maxnorm()
    assert tops == [2.0, 1.0] and c.collect() == [[-2.5, 0.5], [1.0, 0.25]]
    z, _ = dense.constant(spark, 2, 1, 0).normalize_2norm()
    assert all(math.isnan(v) for r in z.collect() for v in r)
    assert dense.identity(spark, 3).collect() == np.eye(3).tolist()
    assert np.array_equal(a.hadamard(a).collect(), n * n)
    assert a.append_row([1, 2, 3]).collect()[-1] == [1, 2, 3] and a.resize(6, 2).collect()[5] == [0, 0] and a.resize(2, 4).collect() == [[1, 2, 3, 0], [2, 3, 4, 0]]
    v = np.array([[2.0, 1], [1, 3]])
    assert np.allclose(dense.inverse_normals(v) @ v, np.eye(2)) and np.allclose(dense.inverse_normals(np.ones((2, 2))), np.linalg.pinv(np.ones((2, 2))))
    own = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (3, 3), (4, 4)], "old long, new long")
    assert a.inverse_shuffle(own).collect() == [ramp(5, 3)[k] for k in (2, 0, 1, 3, 4)]
    assert a.long_form().count() == 15
    r = vectors.random_vector(spark, 50, 1).collect()
    assert set(r) <= set(map(float, range(1, 11)))
    w = vectors.vector(spark, [3, 1, 2])
    assert w.append(9).collect() == [3, 1, 2, 9] and w.append_vector(w).size == 6 and w.resize(5).collect() == [3, 1, 2, 0, 0] and w.resize(1).collect() == [3]
    assert w.largest() == 3 and w.find(2) == 2 and w.find(7) == -1 and w.sorted_values().collect() == [1, 2, 3] and vectors.sort_pairs([(1, 5), (2, 3)]) == [(2, 3), (1, 5)]


def test_cp_als(spark, x):
    k = cpd.cp_als(x, 2, niters=5, tol=0, init="ramp")
    assert np.allclose(k.trace, [0.297491, 0.321129, 0.327973, 0.334710, 0.343851], atol=1e-4)
    assert k.dims == T337_DIMS and k.rank == 2
    model = np.einsum("r,ar,br,cr->abc", k.weights, *[np.array(f.collect()) for f in k.factors])
    assert 1 - np.linalg.norm(as_array(x) - model) / np.linalg.norm(as_array(x)) == pytest.approx(k.fit, abs=1e-6)
    got = {tuple(r)[:3]: r[3] for r in cpd.values_at(k, x).collect()}
    assert all(v == pytest.approx(model[at]) for at, v in got.items())
    h = cpd.cp_als(x.to_hicoo(1, 2), 2, niters=2, tol=0, init="ramp")
    assert np.allclose(h.trace, k.trace[:2], atol=1e-9)
    assert KruskalTensor.empty(spark, (2, 3), 2).dims == (2, 3)


def test_tucker(spark, x):
    core, factors, fit = cpd.tucker(x, (4, 4, 3), 1)
    assert fit == pytest.approx(1, abs=1e-6)
    full = np.einsum("pqr,ap,bq,cr->abc", as_array(core), *[np.array(f.collect()) for f in factors])
    assert np.allclose(full, as_array(x), atol=1e-8)
    _, _, less = cpd.tucker(x, (2, 2, 2), 3)
    assert 0.3 < less < 1


def test_cp_takes_one_course_for_small_and_large_factors(spark, monkeypatch):
    from tensorloom.operators import cpd

    x = SparseTensor.from_rows(spark, [(0, 0, 0, 1), (0, 1, 0, 2), (0, 3, 0, 10), (1, 0, 1, 7), (1, 1, 0, 8), (1, 2, 0, 6), (2, 0, 2, 3), (2, 2, 0, 4), (3, 0, 1, 5)], (4, 4, 3))
    small = cpd.cp_als(x, 2, niters=2, init="ramp")
    monkeypatch.setattr(cpd, "SMALL_FACTOR", 0)
    large = cpd.cp_als(x, 2, niters=2, init="ramp")
    assert large.trace == pytest.approx(small.trace, abs=1e-9) and large.weights == pytest.approx(small.weights, rel=1e-9)
