import random

import pytest
from pyspark.sql import functions as F

from tensorloom.functions.chains import reached, with_next
from tensorloom.operators.split import distribute, split
from tensorloom.types import SparseTensor


def test_next_points_over_all_ranges(spark):
    rng = random.Random(1)
    points = sorted(rng.sample(range(1, 200_000), 300))
    df = spark.createDataFrame([(p, p + rng.choice([0, 1, 5, 900, 50_000])) for p in points], "point long, q long").repartition(5)
    for r in with_next(df, "point", F.col("q"), points[-1]).collect():
        assert r.next == next((p for p in points if p > r.q), None)


def test_chains_of_several_starts(spark):
    jumps = spark.createDataFrame([(i, i + 3 if i + 3 < 40 else None) for i in range(40)], "point long, next long")
    starts = spark.createDataFrame([(1,), (36,)], "point long")
    assert sorted(r.point for r in reached(jumps, starts).collect()) == sorted({*range(1, 40, 3), 36, 39})
    assert reached(jumps.limit(0), starts).count() == 2


def greedy(cells, limits):
    """Rows with split ids by a scan of each part."""
    parts = {"0": cells}
    for m, own in enumerate(limits):
        if not own:
            continue
        most = own
        for later in limits[m + 1 :]:
            most *= max(1, later)
        new = {}
        for key, rows in parts.items():
            part, held = 0, 0
            for i in sorted({r[m] for r in rows}):
                slice_ = [r for r in rows if r[m] == i]
                if held and held + len(slice_) > most:
                    part, held = part + 1, 0
                held += len(slice_)
                new.setdefault(f"{key}.{part}", []).extend(slice_)
        parts = new
    return {(*r[:3], key) for key, rows in parts.items() for r in rows}


@pytest.mark.parametrize("seed,limits", [(0, [2, 3, 4]), (1, [0, 5, 2]), (2, [40, 0, 0]), (3, [1, 1, 1])])
def test_split_against_a_scan(spark, seed, limits):
    rng = random.Random(seed)
    cells = {(min(rng.randint(0, 14), rng.randint(0, 14)), rng.randint(0, 9), rng.randint(0, 5)): 1.0 for _ in range(200)}
    x = SparseTensor.from_rows(spark, [(*k, v) for k, v in cells.items()], (15, 10, 6))
    found = split(x, limits)
    assert {(r.i0, r.i1, r.i2, r.split_id) for r in found.collect()} == greedy(list(cells), limits)
    assert "Pandas" not in found._jdf.queryExecution().toString()


def test_split_of_nothing(spark):
    assert split(SparseTensor.empty(spark, (4, 5)), [1, 1]).collect() == []


@pytest.mark.parametrize("parts", [1, 3, 7, 50])
def test_distribute_against_a_scan(spark, parts):
    rng = random.Random(parts)
    cells = {(min(rng.randint(0, 30), rng.randint(0, 30)), rng.randint(0, 9)) for _ in range(150)}
    x = SparseTensor.from_rows(spark, [(*k, 1.0) for k in cells], (31, 10))
    share, want = -(-len(cells) // parts), [[0, 0]]
    for i in sorted({c[0] for c in cells}):
        if want[-1][0] >= share and len(want) < parts:
            want.append([0, 0])
        want[-1][0] += sum(c[0] == i for c in cells)
        want[-1][1] += 1
    assert sorted(tuple(r) for r in distribute(x, parts).select("part", "nnz", "rows").collect()) == [(k, *w) for k, w in enumerate(want)]
