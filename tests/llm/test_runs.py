import random
from zlib import crc32

import pytest

from tensorloom.llm import runs


def plain(words: list) -> list[tuple]:
    """Runs by their definition, one period after another."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        j = 0
        while j + q < n:
            s = j
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - s + q >= max(24, 3 * q):
                out.setdefault((s, j - s + q), q)
            j += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def mixed(rng: random.Random) -> list[bytes]:
    words: list[bytes] = []
    for _ in range(rng.randint(0, 8)):
        if rng.random() < 0.5:
            base = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh").encode() for _ in range(rng.randint(1, 40))]
            words += [base[i % len(base)] for i in range(rng.randint(1, 5 * len(base) + 30))]
        else:
            words += [rng.choice("ab").encode() for _ in range(rng.randint(0, 60))]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_random_texts_against_the_definition(seed):
    rng = random.Random(seed)
    texts = [mixed(rng) for _ in range(rng.randint(1, 6))]
    assert [[tuple(r) for r in x.tolist()] for x in runs.texts_runs(texts)] == [plain(w) for w in texts]


def test_small_chunks_find_the_same(monkeypatch):
    rng = random.Random(7)
    texts = [mixed(rng) for _ in range(12)]
    want = [x.tolist() for x in runs.texts_runs(texts)]
    monkeypatch.setattr(runs, "CHUNK", 3)
    assert [x.tolist() for x in runs.texts_runs(texts)] == want


def test_edges_of_length_and_period():
    assert runs.texts_runs([[b"x"] * 23])[0].tolist() == []
    assert runs.texts_runs([[b"x"] * 24])[0].tolist() == [[0, 24, 1]]
    words = [str(i % 9).encode() for i in range(27)]
    assert runs.texts_runs([words])[0].tolist() == [[0, 27, 9]]
    assert runs.texts_runs([words[:-1]])[0].tolist() == []
    assert runs.texts_runs([[b"x"] * 12, [b"x"] * 12])[0].tolist() == []  # texts do not run on into one another


def test_long_text_of_one_word():
    assert runs.texts_runs([[b"x"] * 30_000])[0].tolist() == [[0, 30_000, 1]]


def test_runs_and_collapse(spark):
    text = "start\t" + "a b\n" * 20 + "end"
    docs = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, None, 5), (3, "", 5), (None, "x " * 30, 5)], "doc_id long, text string, length int")
    found = sorted(tuple(r) for r in runs.runs(docs).fillna(-1).collect())
    assert found == [(-1, 0, 30, 1), (1, 1, 40, 2), (1, 1, 40, 2)]
    left = {r.doc_id: (r.n_words, r.n_dropped, r.text) for r in runs.collapse(docs).collect()}
    assert left == {1: (42, 38, "start a b end"), 2: (0, 0, ""), 3: (0, 0, ""), None: (30, 29, "x")}
    assert runs.digest(docs).count() == 5


def test_one_document_in_ten_is_made_periodic():
    words = [str(i).encode() for i in range(400)]
    for doc_id in range(200):
        h, out = crc32(str(doc_id).encode()), runs.periodic(words, doc_id)
        if h % 10:
            assert out == words
            continue
        a, g = h // 10 % 400, h // 10
        p = 1 + (400 - a) // (3 + g % 8)
        assert all(out[i] == words[i if i < a else a + (i - a) % p] for i in range(400))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert runs.digest(docs).collect() == [] and runs.runs(docs).collect() == [] and runs.collapse(docs).collect() == []
