import random

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import linedup

LINES = [f"line number {i} with some words" for i in range(60)]


def test_patience():
    assert linedup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert linedup.patience([5, 1, 2, 5], [1, 2]) == [(1, 0), (2, 1)]
    assert linedup.patience([], [1]) == []
    rnd = random.Random(2)
    for _ in range(300):
        a = [rnd.randint(0, 12) for _ in range(rnd.randint(0, 25))]
        b = [rnd.randint(0, 12) for _ in range(rnd.randint(0, 25))]
        m = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))


def test_longest_increasing_run():
    rnd = random.Random(3)
    for _ in range(100):
        seconds = rnd.sample(range(30), rnd.randint(0, 9))
        pairs = list(enumerate(seconds))
        best = max((sum(1 for k in range(len(pairs)) if s >> k & 1) for s in range(1 << len(pairs)) if all(x[1] < y[1] for x, y in zip([pairs[k] for k in range(len(pairs)) if s >> k & 1], [pairs[k] for k in range(len(pairs)) if s >> k & 1][1:], strict=False))), default=0)
        got = linedup._increasing(pairs)
        assert len(got) == best and all(x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def slow(rows):
    """Text left and lines deleted, by row: all pairs of documents, all their common blocks."""
    lines = [[x.strip() for x in (t or "").split("\n")] for _, t in rows]
    out = []
    for (d, t), own in zip(rows, lines, strict=True):
        gone = set()
        for (e, _), other in zip(rows, lines, strict=True):
            if d is None or e is None or e >= d:
                continue
            for i in range(len(own)):
                for j in range(len(other)):
                    # Only where no longer block begins before both.
                    if own[i] != other[j] or (i and j and own[i - 1] == other[j - 1]):
                        continue
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    block = list(range(i, i + n))
                    while block and not own[block[0]]:
                        block.pop(0)
                    while block and not own[block[-1]]:
                        block.pop()
                    if sum(len(own[k].split()) for k in block) >= linedup.WORDS:
                        gone.update(block)
        out.append((d, "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone), len(gone)))
    return out


def compare(docs, rows):
    found = linedup.remove_blocks(docs).collect()
    assert sorted((str(r.doc_id), r.text or "", r.n_deleted) for r in found) == sorted((str(d), t, n) for d, t, n in slow(rows))
    assert all(r.n_lines == (len(t.split("\n")) if t else 0) for r in found for t in [dict(rows)[r.doc_id]] if [d for d, _ in rows].count(r.doc_id) == 1)
    return found


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for d in range(120):
        own = [rnd.choice(LINES) if rnd.random() < 0.4 else f"only {d} {k} of this text" for k in range(rnd.randint(1, 14))]
        if rows and rnd.random() < 0.4:
            old = rnd.choice(rows)[1].split("\n")
            a = rnd.randint(0, len(old))
            own[1:1] = ["", *old[a : a + 5], ""]
        own += ["common footer line that all of these have"] * (rnd.random() < 0.5)
        rows.append((d * 2, "\n".join(own)))
    rows += [(500 + k, rows[4][1]) for k in range(30)] + [(900, None), (901, ""), (902, "\n\n"), (None, rows[4][1]), (903, "a b"), (904, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "gone", "lines", "run", "shared")}).repartition(4)
    by = {r.doc_id: r for r in compare(docs, rows)}
    assert all(by[500 + k].text == "" and by[500 + k].n_deleted for k in range(30))
    assert by[904].text == "a b" and by[None].n_deleted == 0
    full = linedup.clean(docs.withColumn("n_chars", F.length("text").cast("long")))
    assert full.columns == [*docs.columns, "n_chars"]
    got = full.collect()
    assert len(got) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert next(r for r in got if r.doc_id == 510).text == ""


def test_repeated_rows_and_empty_table(spark):
    text = "first line of five words\nsecond line of five words"
    docs = spark.createDataFrame([(1, text), (1, text), (1, text + "\nmore"), (2, text), (2, text)], "doc_id long, text string")
    found = sorted((r.doc_id, r.n_deleted) for r in linedup.remove_blocks(docs).collect())
    assert found == [(1, 0), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert linedup.remove_blocks(docs.limit(0)).collect() == []
    assert linedup.clean(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [5, 6])
def test_short_moved_and_repeated_lines(spark, seed):
    """Blocks of short lines that no single owner holds whole, blocks in other order, and lines that stand twice."""
    rnd = random.Random(seed)
    short = [f"s{i} t" for i in range(9)] + ["x", "", "five words are in this", "so are six in this one"]
    rows = [(1, "Home page"), (2, "About us"), (3, "Contact now"), (10, "Home page\nAbout us\nContact now"), (11, "Home page\nAbout us\nContact now")]
    rows += [(12, "Home page\nz"), (13, "y\nAbout us"), (14, "q q q\nHome page\nAbout us\nq"), (15, "v\nq q q\nHome page\nw"), (16, "k\nq q q\nHome page\nu")]
    rows += [(20, "one line of five words\nother line of five words"), (21, "other line of five words\nz\none line of five words"), (22, "y\nother line of five words\nx\none line of five words")]
    rows += [(30, "twice a line of words\nq\ntwice a line of words"), (31, "v\ntwice a line of words"), (32, "u\ntwice a line of words\nw\ntwice a line of words")]
    rows += [(100 + d // 2, "\n".join(rnd.choice(short) for _ in range(rnd.randint(1, 12)))) for d in range(240)]
    docs = spark.createDataFrame([*rows, (None, rows[3][1])], "doc_id long, text string").repartition(3)
    by = {r.doc_id: r.n_deleted for r in compare(docs, [*rows, (None, rows[3][1])]) if r.doc_id is not None and r.doc_id < 100}
    assert by[11] == 3 and by[22] == 2 and by[32] == 2 and by[16] == 2


def test_reversed_and_repetitive_documents_end_soon():
    n = 20_000
    lines = [k + 1 for k in range(n)]
    assert linedup.aligned([([n - 1 - k], k, [h], [h]) for k, h in enumerate(lines)]) == set(range(n))
    assert linedup.aligned([(list(range(n)), 0, [7, 7, 7], [7, 7, 7])]) == set(range(n + 2))
    assert linedup.aligned([]) == set()


def test_runs_that_only_met_by_hash_are_not_aligned():
    """Both documents' lines decide: a union of the runs that met would take all of these."""
    assert linedup.aligned([([0], 4, [1, 2], [1, 3])]) == set()
    assert linedup.aligned([([0], 4, [1, 2], [1, 2, 3]), ([5], 9, [8], [8])]) == {5}
    rnd = random.Random(8)
    for _ in range(300):
        shared, want = [], set()
        for k in range(rnd.randint(1, 8)):
            held = [rnd.randint(1, 6) for _ in range(rnd.randint(1, 3))]
            same = rnd.random() < 0.6
            begin, at = 10 * k, 10 * rnd.randint(0, 8)
            if any(x[1] == at for x in shared):
                continue
            shared.append(([begin], at, held, held if same else [h + 10 for h in held]))
            want |= set(range(begin, begin + len(held))) if same else set()
        assert linedup.aligned(shared) == want


def test_chains_run_in_order_and_lose_nothing():
    rnd = random.Random(9)
    for _ in range(200):
        left = [(rnd.randint(0, 30), rnd.randint(0, 30), [1] * n, [1] * n) for n in (rnd.randint(1, 3) for _ in range(rnd.randint(0, 20)))]
        parts = linedup._chains(left)
        assert sorted(x for p in parts for x in p) == sorted(left)
        for p in parts:
            for (i, at, a, b), (j, there, _, _) in zip(p, p[1:], strict=False):
                assert j - i == there - at or (j >= i + len(a) and there >= at + len(b))


def test_colliding_run_hashes_delete_nothing_unequal(monkeypatch):
    """With a run hash of three values nearly all runs meet; only equal lines may go."""
    real = linedup.run_hash
    monkeypatch.setattr(linedup, "run_hash", lambda lines: bytes([real(lines)[0] % 3]))
    texts = [(d, "\n".join(f"line {d} {k} of its own here" for k in range(4))) for d in range(30)]
    docs = {d: linedup.runs([linedup.xxh64_intdigest(x) - (1 << 63) for x in t.split("\n")], [7] * 4) for d, t in texts}
    assert set(docs[3]) & set(docs[4])
    lines = {d: [linedup.xxh64_intdigest(x) - (1 << 63) for x in t.split("\n")] for d, t in texts}
    for d in range(1, 30):
        met = [([i for i, _ in places], docs[0][run][0][0], lines[d][places[0][0] : places[0][1] + 1], lines[0][docs[0][run][0][0] : docs[0][run][0][1] + 1]) for run, places in docs[d].items() if run in docs[0]]
        assert linedup.aligned(met) == set()
    met = [([i for i, _ in places], places[0][0], lines[5][places[0][0] : places[0][1] + 1], lines[5][places[0][0] : places[0][1] + 1]) for places in docs[5].values()]
    assert linedup.aligned(met) <= {0, 1, 2, 3}


def test_query_against_sql(spark, tmp_path):
    import duckdb

    from tensorloom.llm import queries

    rows = [(1, " a b c d e \nq\n"), (2, "x\na b c d e\n\nz z z z z"), (3, None), (4, ""), (5, "\n"), (6, "a b c d e\n\t\nz z z z z"), (7, "k\na b c d e\n\nz z z z z\nk")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op8_patience_lines"]).fetchall()
    got = [tuple(r) for r in queries.op8_patience_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(rows)
