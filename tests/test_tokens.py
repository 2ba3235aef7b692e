import pytest

from tensorloom.sources import text
from tensorloom.types import ValueRangeError


def file(tmp_path, content):
    path = tmp_path / "x.tns"
    path.write_text(content)
    return str(path)


def test_rows_over_line_ends(spark, tmp_path):
    path = file(tmp_path, "2 4\n 5 1 2\n3.5 4\n\n5 -1e2 2 2 7 3 3 8\n 1")
    assert text.read_tokens(spark, path).collect() == [(0, 1, 3.5), (1, 1, 7.0), (2, 2, 8.0), (3, 4, -100.0)]


def test_stops_at_the_first_bad_token(spark, tmp_path):
    assert text.read_tokens(spark, file(tmp_path, "2\n4 5\n1 2 3.5\n4 x 1\n2 2 7\n9 9 9\n")).collect() == [(0, 1, 3.5)]
    assert text.read_tokens(spark, file(tmp_path, "2\n4 5\n")).collect() == []


def test_lines_of_several_rows_and_no_header(spark, tmp_path):
    path = file(tmp_path, "0 1 2 1 1 3\n2 2 4\n")
    assert text.read_tokens(spark, path, 0, header=False, dims=[3, 3]).collect() == [(0, 1, 2.0), (1, 1, 3.0), (2, 2, 4.0)]


def test_outside_the_shape_and_without_header(spark, tmp_path):
    with pytest.raises(ValueRangeError):
        text.read_tokens(spark, file(tmp_path, "2\n4 5\n5 1 1\n"))
    for content in ("", "x 1 2", "2 4"):
        with pytest.raises(ValueRangeError):
            text.read_tokens(spark, file(tmp_path, content))


def test_numbers_go_on_over_ranges_and_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        (tmp_path / "f").mkdir()
        for k in range(3):
            (tmp_path / "f" / f"part-{k}").write_text("".join(f"{k * 1000 + i} \n" for i in range(1000)))
        lines = text.numbered_lines(spark, str(tmp_path / "f"))
        assert lines.rdd.getNumPartitions() >= 1
        assert all(str(r["first"]) == r["t"][0] for r in lines.collect()) and lines.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_maps_over_line_ends(spark, tmp_path):
    maps = text.read_maps(spark, file(tmp_path, "3 1\n2 2 1\n"), [3, 2])
    assert [sorted(tuple(r) for r in m.collect()) for m in maps] == [[(0, 2), (1, 0), (2, 1)], [(0, 1), (1, 0)]]
    for content in ("1 1 2 1 2", "1 2 3 1"):
        with pytest.raises(ValueRangeError):
            text.read_maps(spark, file(tmp_path, content), [3, 2])


def test_binary_file_in_ranges(spark, tmp_path):
    from tensorloom.sources.binary import read_binary, write_binary, write_binary_parts

    path = str(tmp_path / "x.bin")
    for widths in ((8, 8), (4, 4), (4, 8)):
        write_binary(path, (50, 7), [[k for k in range(50)], [k % 7 for k in range(50)]], [k / 2 for k in range(50)], *widths)
        for step in (1, 7, 50, 1 << 20):
            found = read_binary(spark, path, step)
            assert found.dims == (50, 7) and found.collect() == [(k, k % 7, k / 2) for k in range(50)]
    write_binary_parts(found, str(tmp_path / "parts"))
    assert read_binary(spark, str(tmp_path / "parts"), 9).collect() == found.collect()
    assert read_binary(spark, f"file://{tmp_path}/parts").collect() == found.collect()
    write_binary(path, (3, 3), [[], []], [])
    assert read_binary(spark, path).collect() == []
    (tmp_path / "x.bin").write_bytes((tmp_path / "x.bin").read_bytes()[:-9])
    with pytest.raises(ValueRangeError):
        read_binary(spark, path)


@pytest.mark.parametrize("symmetry", ["general", "symmetric", "skew-symmetric"])
def test_matrix_array_files(spark, tmp_path, symmetry):
    import numpy as np

    from tensorloom.sources.market import read_matrix

    n = 23
    a = np.arange(1.0, n * n + 1).reshape(n, n) % 7
    a = {"general": a, "symmetric": a + a.T, "skew-symmetric": a - a.T}[symmetry]
    low = {"general": 0, "symmetric": None, "skew-symmetric": 1}[symmetry]
    values = [a[i, j] for j in range(n) for i in range(0 if symmetry == "general" else j + (low or 0), n)]
    lines = [" ".join(map(str, values[k : k + 5])) for k in range(0, len(values), 5)]
    path = file(tmp_path, f"%%MatrixMarket matrix array real {symmetry}\n% a comment 1 2\n{n} {n}\n" + "\n".join(lines))
    assert read_matrix(spark, path).collect() == sorted((i, j, v) for (i, j), v in np.ndenumerate(a) if v)
