import hashlib

import numpy as np
from pyspark.sql import functions as F

from tensorloom.llm import minhash


def jaccard(a, b):
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{i}" for i in rng.integers(0, 900, int(rng.integers(1, 400)))) + "é" * int(rng.integers(0, 3)) for _ in range(n)]


def test_edited_texts_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP_ROWS", 7)
    rows = [(i * 3 - 40, t) for i, t in enumerate(texts(90))] + [(1000, None), (1001, ""), (1002, " \n "), (2000, "one two"), (2001, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(0)).withColumn("next_text", F.lit("x")).repartition(5)
    found = {r.doc_id: r for r in minhash.edited_likeness(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    off, plain = [], {d: t or "" for d, t in rows}
    assert len(found) == len(rows)
    for k, (d, text) in enumerate(order):
        text = text or ""
        after = order[(k + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        r = found[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == 2 * minhash.BINS and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        off += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
        same = r.fingerprint == r.edited_fingerprint
        assert not same or r.near_edited == 1
    assert np.abs(off).mean() < 0.03 and np.abs(off).max() < 0.3
    assert found[2000].fingerprint == found[2001].fingerprint and plain[2000] == plain[2001]
    assert found[1000].fingerprint == found[1001].fingerprint == found[1002].fingerprint


def test_estimate_is_unbiased_when_bins_are_empty(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for k in range(150):
        a = [f"a{k}_{i}" for i in range(40)]
        b = list(a)
        cut = int(rng.integers(5, 35))
        b[cut:] = [f"b{k}_{i}" for i in range(40 - cut)]
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(minhash.likeness(minhash.signature(F.col("a")), minhash.signature(F.col("b")))).collect()]
    off = [g - jaccard(*p) for g, p in zip(got, pairs, strict=True)]
    assert abs(np.mean(off)) < 0.03 and np.abs(off).mean() < 0.1


def test_one_row_repeats_and_none(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h i")], "doc_id long, text string")
    r = minhash.edited_likeness(one).collect()[0]
    assert r.edited_sha256 == hashlib.sha256(b"a b c d e f a b c").hexdigest()
    odd = spark.createDataFrame([(None, "x y z"), (3, "p q r"), (3, "p q r"), (3, "p q s")], "doc_id long, text string")
    assert minhash.edited_likeness(odd).count() == 4
    assert minhash.edited_likeness(one.limit(0)).collect() == []
    assert minhash.fingerprint(one.withColumn("fingerprint", F.lit(1))).columns == ["doc_id", "fingerprint"]
