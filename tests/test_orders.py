import random

import pytest

from tensorloom.operators import reorder
from tensorloom.types import SparseTensor


def random_tensor(spark, seed, dims=(12, 7, 5), n=90):
    rng = random.Random(seed)
    cells = {tuple(min(rng.randrange(d), rng.randrange(d)) for d in dims) for _ in range(n)}
    return SparseTensor.from_rows(spark, [(*c, 1.0) for c in cells], dims), cells


def as_map(df) -> dict:
    return {r.old: r.new for r in df.collect()}


def lexi(cells, dims, mode):
    rows = {r: k for k, r in enumerate(sorted({c[:mode] + c[mode + 1 :] for c in cells}))}
    lists = {i: sorted({rows[c[:mode] + c[mode + 1 :]] for c in cells if c[mode] == i}) + [1 << 62] for i in range(dims[mode])}
    return {old: new for new, old in enumerate(sorted(lists, key=lambda i: (lists[i], i)))}


@pytest.mark.parametrize("chunk", [1, 2, 5, 1024])
@pytest.mark.parametrize("seed", [0, 1])
def test_lists_of_any_length_are_ordered_alike(spark, monkeypatch, chunk, seed):
    monkeypatch.setattr(reorder, "CHUNK", chunk)
    x, cells = random_tensor(spark, seed)
    for mode in (0, 2):
        assert as_map(reorder.lexi_map(x, mode)) == lexi(cells, x.dims, mode)


def test_equal_long_lists_are_told_apart_in_a_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(reorder, "CHUNK", 2)
    cells = {(i, k) for i in range(3) for k in range(40)} | {(3, k) for k in range(39)} | {(4, k) for k in range(41)}
    x = SparseTensor.from_rows(spark, [(*c, 1.0) for c in cells], (6, 50))
    assert as_map(reorder.lexi_map(x, 0)) == lexi(cells, x.dims, 0) == {4: 0, 0: 1, 1: 2, 2: 3, 3: 4, 5: 5}


def breadth(cells, dims, mode):
    rows, of = {}, {}
    for c in cells:
        r = c[:mode] + c[mode + 1 :]
        rows.setdefault(r, set()).add(c[mode])
        of.setdefault(c[mode], set()).add(r)
    level, start = {}, {}
    for seed in sorted(of):
        front, k = ([seed], 0) if seed not in level else ([], 0)
        while front:
            level.update(dict.fromkeys(front, k))
            start.update(dict.fromkeys(front, seed))
            front, k = sorted({j for i in front for r in of[i] for j in rows[r] if j not in level}), k + 1
    links = {i: sum(min(level[j] for j in rows[r]) == level[i] - 1 for r in of[i]) for i in of}
    order = sorted(of, key=lambda i: (start[i], level[i], -links[i], i)) + [i for i in range(dims[mode]) if i not in of]
    return {old: new for new, old in enumerate(order)}


@pytest.mark.parametrize("seed,n", [(0, 25), (1, 60), (2, 12)])
def test_breadth_first_order_against_a_search(spark, seed, n):
    x, cells = random_tensor(spark, seed, (20, 9, 8), n)
    for mode in (0, 1):
        assert as_map(reorder.bfs_map(x, mode)) == breadth(cells, x.dims, mode)


def test_breadth_first_order_of_a_chain_and_of_nothing(spark):
    cells = {(i, i) for i in range(9)} | {(i, i + 1) for i in range(9)}
    x = SparseTensor.from_rows(spark, [(*c, 1.0) for c in cells], (10, 10))
    assert as_map(reorder.bfs_map(x, 0)) == {i: i for i in range(10)}
    assert as_map(reorder.bfs_map(SparseTensor.empty(spark, (3, 2)), 0)) == {0: 0, 1: 1, 2: 2}
