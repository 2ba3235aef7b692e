import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tensorloom.llm import simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    ids = sorted(fps)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("seed,n,spread", [(0, 300, 4), (1, 500, 2), (2, 40, 1)])
def test_trie_links_find_all_pairs(seed, n, spread):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = base[rng.integers(0, 12, n)]
    for _ in range(spread):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    values = np.unique(values)
    labels = np.arange(len(values))
    for i, j in simhash.trie_links(values, 0):
        assert (np.bitwise_count(values[i] ^ values[j]) <= 3).all()
        labels = simhash.merge(labels, i, j)
    want = slow_components(dict(enumerate(int(v) for v in values)))
    assert labels.tolist() == [want[i] for i in range(len(values))]


def test_rows_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (1005, "a b"), (1006, "É é ZZ top")]
    for k in range(60):
        text = [words[i] for i in rng.integers(0, 400, 120)]
        rows.append((k * 3, " ".join(text)))
        text[int(rng.integers(0, 120))] = "edited"
        rows.append((k * 3 + 1, " \n".join(text)))
    rows.append(rows[9])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    found = simhash.near_duplicates(docs).collect()
    fps = {d: slow_fingerprint(t) for d, t in rows}
    want = slow_components(fps)
    assert len(found) == len(rows)
    for r in found:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    assert len(set(want.values())) < len(set(fps))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_missing_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, None), (7, "a b c d")], "doc_id long, text string")
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(found) == 3 and sorted(map(str, found.values())) == ["7", "None", "None"]
    assert simhash.keep_one(docs).count() == 3
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
