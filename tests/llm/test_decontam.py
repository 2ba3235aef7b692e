import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import decontam, tokens


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISS
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
    return int(h.max())


def test_alignment_score():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, int(rng.integers(1, 25))).astype(np.uint64), rng.integers(0, 4, int(rng.integers(1, 40))).astype(np.uint64)
        score, s, e, equal = decontam.align(a, b)
        assert score == slow_align(a, b) == decontam.top_score(a, b) and 0 <= s <= e <= len(b) and equal * decontam.MATCH >= score
        assert equal <= min(len(a), e - s)
        assert slow_align(a, b[s:e]) == score


def test_words():
    texts = ["The cat's 9 lives", "", "é É the", "..", "cat"]
    data = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    h, b, e, d = tokens.words(np.frombuffer(data, np.uint8), at)
    assert [data[x:y].decode() for x, y in zip(b, e, strict=True)] == ["The", "cat", "s", "9", "lives", "é", "É", "the", "cat"]
    assert d.tolist() == [0, 0, 0, 0, 0, 2, 2, 2, 4]
    assert h[0] == h[7] and h[1] == h[8] and h[5] == h[6] and len(set(h.tolist())) == 6


def words_of(text):
    data = text.encode()
    h, b, e, _ = tokens.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return [data[x:y].decode() for x, y in zip(b, e, strict=True)]


def test_words_of_other_scripts():
    assert words_of("“Don’t—stop”, she said…") == ["Don", "t", "stop", "she", "said"]
    assert words_of("日本、語。カナ abc漢x") == ["日", "本", "語", "カ", "ナ", "abc", "漢", "x"]
    assert words_of("हिन्दी भाषा\u00a0привет «мир»") == ["हिन्दी", "भाषा", "привет", "мир"]
    assert words_of("a𝔘b 😀 c") == ["a𝔘b", "c"]


def test_punctuation_does_not_hide_a_copy_and_copies_are_told_apart(spark):
    item = " ".join(f"word{k}" for k in range(30))
    cjk = "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多少"
    rows = [(1, "“" + item.replace(" ", "”—“") + "”"), (2, f"{item} {item}"), (3, f"{item} filler {item}, and {item}"), (4, "。".join(cjk[i : i + 5] for i in range(0, 20, 5))), (5, "x " * 300 + item)]
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, cjk)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 7), (2, 7), (2, 7), (3, 7), (3, 7), (3, 7), (4, 8), (5, 7)]
    text = dict(rows)
    assert all(text[r.doc_id][r.start : r.end] == item and r.score == 1 for r in found if r.doc_id in (2, 3, 5))


def test_long_repetitive_text_and_long_item_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    item = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    items = decontam.Items([(1, " ".join(f"w{k % 97}" for k in range(400)))])
    h = np.tile(items.words[0], 60)
    tracemalloc.start()
    found = list(decontam.passages(items, items.flags(), h, np.zeros(len(h), np.int64), 1))
    big = rng.integers(1, 1 << 60, 3000).astype(np.uint64)
    score, s, e, equal = decontam.align(big, np.r_[item, big, item])
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (score, s, e, equal) == (2 * 3000, 400, 3400, 3000) and top < 100 << 20
    spans = sorted((a, z) for *_, a, z in found)
    assert len(found) >= 58 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: [vocabulary[i] for i in rng.integers(0, 500, n)]
    items = [(k, " ".join(text(int(rng.integers(20, 50))))) for k in range(12)]
    rows, want = [], set()
    for d in range(150):
        words = text(int(rng.integers(30, 200)))
        if d % 3 == 0:
            k = d % 12
            leak = items[k][1].split()
            for _ in range(len(leak) // 6 if d % 2 else 0):
                leak[int(rng.integers(0, len(leak)))] = "edit"
            cut = int(rng.integers(0, len(words)))
            words[cut:cut] = [w.upper() + "," for w in leak]
            want.add((d, k))
        rows.append((d, " ".join(words)))
    return items, rows, want


@pytest.mark.parametrize("seed,block", [(0, 16 << 20), (3, 900)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    items, rows, planted = corpus(seed)
    items += [(100, None), (101, ""), (102, "w1 w2"), (2, items[3][1])]
    rows += [(900, None), (901, ""), (902, "..."), (903, "x w1 w2 y"), (rows[0][0], rows[0][1]), (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("score", F.lit("s")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    found = decontam.contaminated(docs, bench).collect()
    hash_of = lambda t: tokens.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    want = set()
    for d, t in rows:
        for k, q in items:
            a, b = hash_of(q or ""), hash_of(t or "")
            if len(a) and len(b) and decontam.align(a, b)[0] >= decontam.needed(len(a)):
                want.add((d, k))
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert planted <= want and (903, 102) in want
    for r in found:
        text = next(t for d, t in rows if d == r.doc_id)
        assert 0 < r.score <= 1 and 0 <= r.start < r.end <= len(text)
    bad = {d for d, _ in want}
    clean = decontam.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in rows if d not in bad)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, none).collect() == []
    assert decontam.keep_clean(docs, none).count() == 1
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.contaminated(docs.limit(0), bench).collect() == []
    assert decontam.contaminated(docs, bench).count() == 1


def test_part_of_an_item_in_very_many_documents(spark):
    item = " ".join(f"i{k}" for k in range(59))
    short = " ".join(f"s{k}" for k in range(15))
    part, half = " ".join(item.split()[20:46]), " ".join(short.split()[:8])
    rows = [(d, f"a{d} b{d} {part} c{d}") for d in range(40)] + [(100 + d, f"d{d} e{d} {half} f{d}") for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(d, 1 if d < 100 else 2) for d, _ in rows}
    assert decontam.keep_clean(docs, bench).count() == 0


def own_words(text):
    """A splitter of its own, for ASCII."""
    return re.findall("[0-9a-z]+", text.lower())


def slow_score(a, b):
    """Best Smith-Waterman score, cell by cell over words."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (decontam.MATCH if x == y else decontam.MISS), row[j + 1] + decontam.GAP, new[j] + decontam.GAP))
        row = new
        best = max(best, max(row))
    return best


def edited(words, every, kind, rng):
    """A copy with each ``every``-th word replaced, left out, or followed by another."""
    out = []
    for k, w in enumerate(words):
        if k % every != every - 1:
            out.append(w)
        elif kind == "replace":
            out.append(f"e{rng.integers(1000)}")
        elif kind == "insert":
            out += [w, f"e{rng.integers(1000)}"]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_dense_edits_against_full_alignment(spark, seed):
    """Every second to fifth word edited, frequent words among them: pairs as by full alignment, and no stretch left over that reaches the score."""
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, 401)
    text = lambda n: [f"w{i}" for i in rng.choice(400, n, p=weights / weights.sum())]
    items = [text(n) for n in (5, 6, 9, 14, 21, 30, 44, 60, 90, 130)]
    docs, planted = [], set()
    for k, item in enumerate(items):
        for every in (2, 3, 4, 5):
            for kind in ("replace", "insert", "drop"):
                copy = edited(item, every, kind, rng)
                docs.append(text(30) + copy + text(20))
                if slow_score(item, copy) >= decontam.needed(len(item)):
                    planted.add((len(docs) - 1, k))
    docs += [text(150) for _ in range(10)]
    assert {(d, k) for d, k in planted if d % 12 < 3}, "some with each second word edited"
    found = decontam.contaminated(
        spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string").repartition(2),
        spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string"),
    ).collect()
    want = {(d, k) for d, t in enumerate(docs) for k, item in enumerate(items) if slow_score(item, t) >= decontam.needed(len(item))}
    assert planted <= want and {(r.doc_id, r.item_id) for r in found} == want
    spans: dict = {}
    for r in found:
        t = " ".join(docs[r.doc_id])
        a, z = len(own_words(t[: r.start])), len(own_words(t[: r.end]))
        spans.setdefault((r.doc_id, r.item_id), []).append((a, z))
        item = items[r.item_id]
        assert slow_score(item, docs[r.doc_id][a:z]) == round(r.score * decontam.MATCH * len(item))
    for (d, k), of in spans.items():
        edges = [0, *(x for span in sorted(of) for x in span), len(docs[d])]
        assert edges == sorted(edges)
        for a, z in zip(edges[::2], edges[1::2], strict=True):
            assert slow_score(items[k], docs[d][a:z]) < decontam.needed(len(items[k]))


@pytest.mark.parametrize("size,times", [(20, 50), (61, 50), (6, 300)])
def test_copies_in_a_row_are_all_whole(spark, size, times):
    item = " ".join(f"word{k}" for k in range(size))
    rows = [(1, " ".join([item] * times)), (2, "start " + ", and ".join([item] * times))]
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (7, item), (8, None)], "item_id long, text string")).collect()
    text = dict(rows)
    assert len(found) == 4 * times  # the item has two rows
    assert all(text[r.doc_id][r.start : r.end] == item and r.score == 1 and r.n_equal == size for r in found)


def test_seeds_in_repetitive_items_and_in_ranges(monkeypatch):
    """Hits taken a few at a time give the same stretches; a word repeated in text and item makes no product of the two."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{i}" for i in rng.integers(0, 60, 20))) for k in range(30)] + [(99, "same " * 400)]
    items = decontam.Items(rows)
    h = np.concatenate([items.words[k] for k in (3, 30, 7, 30)])
    doc = np.repeat([0, 1], [len(h) // 2, len(h) - len(h) // 2])
    whole = list(decontam.passages(items, items.flags(), h, doc, 2))
    assert {(t, k) for t, k, *_ in whole} >= {(0, 3), (0, 30), (1, 7), (1, 30)}
    monkeypatch.setattr(decontam, "PAIRS", 50)
    assert sorted(decontam.passages(items, items.flags(), h, doc, 2)) == sorted(whole)
    assert len(items.grams.item) < 30 * 20
