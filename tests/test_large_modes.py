"""Modes wider than the test tables have: queries on a few lines against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tensorloom.operators import reorder
from tensorloom.sources import dump
from tensorloom.types import SemiSparseTensor, SparseMatrix, SparseTensor

PARTS, SUPPLIERS = 300_000, 3_000


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A folder of part, supplier and lineitem: parts beyond 2^18, lines that share a part, supplier or both."""
    path = str(tmp_path_factory.mktemp("wide"))
    spark.range(PARTS).select(F.col("id").alias("p_partkey")).write.parquet(f"{path}/part.parquet")
    spark.range(SUPPLIERS).select(F.col("id").alias("s_suppkey")).write.parquet(f"{path}/supplier.parquet")
    lines = [(k % 40, part, supplier, k % 7 + 1, float(k % 5 + 1), "ANR"[k % 3]) for k, (part, supplier) in enumerate((p, s) for p in (0, 7, 262_145, 262_150, PARTS - 1) for s in (0, 1, 1500, SUPPLIERS - 1) for _ in range(5))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    return path


def same_as_sql(spark, path, name):
    db = duckdb.connect()
    for t in ("part", "supplier", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    found = entry.queries()[name](spark, path)
    expected = db.execute(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    return found


def test_morton_order_has_the_keys_of_its_sql(spark, wide):
    same_as_sql(spark, wide, "sort_morton")


@pytest.mark.parametrize("name", ["semisparse_other_mode", "semisparse_set_mode"])
def test_fibers_of_a_wide_mode_are_not_formed_for_their_cells(spark, wide, name):
    plan = same_as_sql(spark, wide, name)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" not in plan and "sequence" not in plan


def test_fibers_by_cells_are_the_whole_fibers(spark):
    rows = [(0, 0, 5, 2.0), (0, 0, 2, 3.0), (0, 0, 2, -1.0), (0, 1, 0, 4.0), (1, 1, 3, float("nan")), (1, 0, 4, 1.0), (1, 0, 4, -1.0)]
    x = SparseTensor.from_rows(spark, rows, (2, 2, 6), coalesce=False)
    y = x.to_semi_sparse(2)
    assert str(y.collect()) == str([(0, 0, (0.0, 0.0, 2.0, 0.0, 0.0, 2.0)), (0, 1, (4.0, 0.0, 0.0, 0.0, 0.0, 0.0)), (1, 0, (0.0,) * 6), (1, 1, (0.0, 0.0, 0.0, float("nan"), 0.0, 0.0))])
    plain = SemiSparseTensor(y.df, y.dims, y.mode)
    for a in (y, plain):
        assert str(a.to_coo(0.0).collect()) == str([(0, 0, 2, 2.0), (0, 0, 5, 2.0), (0, 1, 0, 4.0), (1, 1, 3, float("nan"))])
        assert str(a.set_mode(0).collect()) == str(plain.set_mode(0).collect())
        sums = {(r.i0, r.i1): (r.n, str(r.total)) for r in a.fiber_sums(lambda k: k + 1).collect()}
        assert sums == {(0, 0): (6, "18.0"), (0, 1): (6, "4.0"), (1, 0): (6, "0.0"), (1, 1): (6, "nan")}


def test_dense_rows_are_formed_after_the_join(spark):
    a = SparseMatrix.from_rows(spark, [(1, 4, 2.0), (1, 0, 3.0), (3, 2, 1.0), (3, 2, 1.5)], 5, 5).to_dense()
    assert a.collect() == [[0.0] * 5, [3.0, 0.0, 0.0, 0.0, 2.0], [0.0] * 5, [0.0, 0.0, 2.5, 0.0, 0.0], [0.0] * 5]
    assert SparseMatrix.empty(spark, 2, 0).to_dense().collect() == [[], []]
    above, join, below = a.df._jdf.queryExecution().optimizedPlan().toString().partition("Join")
    assert join and "flatten" in above and not any(f in below for f in ("array_repeat", "sequence"))


def held(spark):
    """Persisted data, and tables in the session's folder but for those of maps and files."""
    import os

    from tensorloom.functions.lineage import shared_dir

    return spark.sparkContext._jsc.getPersistentRDDs().size(), {n for n in os.listdir(shared_dir(spark)) if n.startswith(("pointers", "blocks", "lexi", "lists", "totals"))}


def test_pointers_and_blocks_leave_only_their_files(spark, tmp_path):
    x = SparseTensor.from_rows(spark, [(i % 40, i * 7 % 50, i * 3 % 30, float(i % 5 + 1)) for i in range(400)], (40, 50, 30))
    h = x.to_hicoo(2, 3, 3)
    before, old = held(spark)
    dump.write_hicoo(h, str(tmp_path / "h"))
    after, new = held(spark)
    assert after == before and {n.split("-")[0] for n in new - old} <= {"totals"}
    blocks = spark.read.text(str(tmp_path / "h/blocks")).count()
    places = [tuple(map(int, r.value.split())) for r in spark.read.text(str(tmp_path / "h/pointers")).collect()]
    assert blocks == h.df.count() and max(p for level, _, p in places if level == 2) == x.nnz() and max(p for level, _, p in places if level < 2) == blocks
    for level in range(3):
        own = sorted((n, p) for k, n, p in places if k == level)
        assert [n for n, _ in own] == list(range(len(own))) and [p for _, p in own] == sorted({p for _, p in own})


@pytest.mark.parametrize("chunk", [4, 1024])
def test_orders_leave_no_sorted_rows_behind(spark, monkeypatch, chunk):
    monkeypatch.setattr(reorder, "CHUNK", chunk)
    rows = [(i * 3 % 12, i * 5 % 9, i % 4, 1.0) for i in range(60)]
    x = SparseTensor.from_rows(spark, rows, (14, 9, 4))
    before, old = held(spark)
    got = [{r.old: r.new for r in m.collect()} for m in reorder.lexi_order(x, 2)]
    after, new = held(spark)
    assert after == before and {n.split("-")[0] for n in new - old} <= {"lists"}
    cells, maps = {r[:3] for r in x.collect()}, [{i: i for i in range(d)} for d in x.dims]
    for _ in range(2):
        for mode in range(3):
            moved = {tuple(maps[m][i] for m, i in enumerate(c)) for c in cells}
            lists = {i: sorted((c[:mode] + c[mode + 1 :] for c in moved if c[mode] == i)) + [(99,)] for i in range(x.dims[mode])}
            step = {i: k for k, i in enumerate(sorted(lists, key=lambda i: (lists[i], i)))}
            maps[mode] = {a: step[b] for a, b in maps[mode].items()}
    assert got == maps


def test_rows_beyond_a_long_are_numbered(spark):
    wide = 1 << 40
    x = SparseTensor.from_rows(spark, [(0, wide - 1, 0, 1.0), (1, 0, wide - 1, 1.0), (2, 0, 0, 1.0), (2, wide - 1, wide - 1, 1.0)], (4, wide, wide))
    assert {r.old: r.new for r in x.lexi_map(0).collect()} == {2: 0, 1: 1, 0: 2, 3: 3}
