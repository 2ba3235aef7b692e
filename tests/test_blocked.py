import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import types
from tensorloom.operators import blocked, matrix
from tensorloom.operators.cpd import cp_als
from tensorloom.operators.dense import ramp
from tensorloom.operators.products import mttkrp
from tensorloom.types import SparseMatrix, SparseTensor, Vector


def tensor(spark, dims, n, seed):
    rng = random.Random(seed)
    cells = {tuple(min(rng.randrange(d), rng.randrange(d)) for d in dims): float(rng.randint(-4, 9)) for _ in range(n)}
    return SparseTensor.from_rows(spark, [(*k, v) for k, v in cells.items()], dims), cells


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [32 << 20, 600, 0])
@pytest.mark.parametrize("dims,bits", [((9, 20, 33), 2), ((5, 6, 7, 8), 1), ((70, 3), 3)])
def test_mttkrp_by_blocks(spark, monkeypatch, limit, dims, bits):
    monkeypatch.setattr(types, "BROADCAST_BYTES", limit)  # operands whole, some dealt, all dealt
    x, cells = tensor(spark, dims, 300, len(dims))
    factors = [ramp(spark, d, 3) for d in dims]
    for mode in range(len(dims)):
        want = np.zeros((dims[mode], 3))
        for k, v in cells.items():
            want[k[mode]] += v * np.prod([np.arange(3) + i + 1.0 for m, i in enumerate(k) if m != mode], axis=0)
        found = mttkrp(x.to_hicoo(bits, bits + 1), factors, mode)
        assert np.allclose(found.collect(), want)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_matrix_products_by_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(types, "BROADCAST_BYTES", limit)
    rng = random.Random(4)
    a = np.zeros((37, 21))
    for _ in range(200):
        a[rng.randrange(37), min(rng.randrange(21), rng.randrange(21))] = rng.randint(1, 9)
    own = SparseMatrix.from_rows(spark, [(i, j, a[i, j]) for i, j in zip(*a.nonzero(), strict=True)], *a.shape).to_hicoo(2, 3)
    x = Vector(spark.range(21).select(F.col("id").alias("i"), (F.col("id") * 2.0).alias("val")), 21)
    y = Vector(spark.range(37).select(F.col("id").alias("i"), F.lit(1.0).alias("val")), 37)
    assert np.allclose(matrix.multiply_vector(own, x).collect(), a @ (2.0 * np.arange(21)))
    assert np.allclose(matrix.multiply_vector(own, x, y).collect(), a @ (2.0 * np.arange(21)) + 1)
    b, c = ramp(spark, 21, 4), ramp(spark, 37, 4)
    assert np.allclose(matrix.multiply_matrix(own, b).collect(), a @ np.array(b.collect()))
    assert np.allclose(matrix.multiply_matrix(own, b, c).collect(), a @ np.array(b.collect()) + np.array(c.collect()))


def test_no_entry_leaves_its_block_before_the_sums(spark, monkeypatch):
    x, _ = tensor(spark, (9, 20, 33), 100, 1)
    factors = [ramp(spark, d, 2) for d in x.dims]
    for limit in (32 << 20, 0):
        monkeypatch.setattr(types, "BROADCAST_BYTES", limit)
        text = plan(mttkrp(x.to_hicoo(2, 4), factors, 1).df)
        assert "MapInArrow" in text and "explode" not in text and "Generate" not in text


def test_large_block_takes_the_operands_block_along(spark, monkeypatch):
    monkeypatch.setattr(types, "BROADCAST_BYTES", 0)
    x = SparseTensor.from_rows(spark, [(i, j, 1.0 + i) for i in range(4) for j in range(4)], (4, 4))  # 16 entries in a block of 4 rows
    assert np.allclose(blocked.mttkrp_blocks(x.to_hicoo(2, 2), [ramp(spark, 4, 2)] * 2, 0).collect(), [[(1 + i) * 10.0, (1 + i) * 14.0] for i in range(4)])


def test_empty_tensor(spark):
    x = SparseTensor.empty(spark, (3, 4))
    assert mttkrp(x.to_hicoo(1, 1), [ramp(spark, 3, 2), ramp(spark, 4, 2)], 0).collect() == [[0.0, 0.0]] * 3


def test_cp_stays_in_blocks(spark):
    x, _ = tensor(spark, (6, 9, 10), 60, 3)
    plain, own = cp_als(x, 2, 4, init="ramp"), cp_als(x.to_hicoo(1, 2), 2, 4, init="ramp")
    assert np.allclose(plain.trace, own.trace) and np.allclose(plain.weights, own.weights)
