import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import suffixlm

END = "<end>"


class Plain:
    """The tree by dictionaries of tuples of words."""

    def __init__(self, docs, depth=3, least=3):
        self.docs = [(i, (t or "").encode().lower().decode().split(), crc32(("" if i is None else str(i)).encode()) % 10 == 0) for i, t in docs]
        train = [[*w, END] for _, w, held in self.docs if not held]
        self.c = [Counter(tuple(t[i : i + n]) for t in train for i in range(len(t) - n + 1)) for n in range(1, depth + 2)]
        self.n = sum(self.c[0].values())
        self.norm = self.n + 0.1 * (len(self.c[0]) + 1)
        self.frequent = [{g for g, n in c.items() if n >= least} for c in self.c]
        self.follow = {}
        for n in range(1, depth + 1):
            for g in self.frequent[n]:
                self.follow.setdefault(g[:-1], []).append(g[-1])
        self.states = set()
        for s, words in self.follow.items():
            total, rest = self.count(s), self.count(s) - sum(self.count((*s, w)) for w in words)
            gain = sum(self.count((*s, w)) * math.log(self.p(w, s) / self.p(w, s[1:])) for w in words)
            gain += rest * math.log((rest + 0.5 * len(words)) / total) if rest else 0
            if gain >= 0.5 * (len(words) + 1) * math.log(max(2, self.n)):
                self.states |= {s[k:] for k in range(len(s))}

    def count(self, g):
        return self.c[len(g) - 1][g]

    def p(self, w, s):
        if not s:
            return (self.c[0][(w,)] + 0.1) / self.norm
        words = self.follow[s]
        rest = (self.count(s) - sum(self.count((*s, x)) - 0.5 for x in words)) / self.count(s)
        return (max(0, self.count((*s, w)) - 0.5) / self.count(s) if w in words else 0) + rest * self.p(w, s[1:])

    def rows(self):
        for i, words, held in self.docs:
            t, base, score = [*words, END], 0.0, 0.0
            for k, w in enumerate(t):
                base += math.log10(self.p(w, ()))
                score += math.log10(self.p(w, max((tuple(t[k - n : k]) for n in range(min(k, 3) + 1) if n == 0 or tuple(t[k - n : k]) in self.states), key=len)))
            yield i, held, len(t), sum(self.c[0][(w,)] > 0 for w in t), self.n, base, score


def corpus(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["The", "the", "É", "é", "a", "dog", "ran,"] + [f"w{i}" for i in range(60)]
    fixed = [" ".join(rng.choice(words) for _ in range(7)) for _ in range(4)] + [f"{x} and same {y}" for x, y in zip("pqrs", "tuvw", strict=True)]
    rows = [(i, " ".join(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words[: rng.randint(3, 60)]) for _ in range(rng.randint(0, 25)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, "the dog"), (0, rows[0][1]), (n + 2, "\t".join(f"new{i}" for i in range(30)))]


@pytest.mark.parametrize("seed,n", [(0, 150), (1, 400)])
def test_scores_against_plain_dictionaries(spark, seed, n):
    docs = corpus(seed, n)
    plain = Plain(docs)
    assert len(plain.states) > 20 and {len(s) for s in plain.states} == {1, 2, 3}
    found = suffixlm.learn_and_score(spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("h", F.lit("x")))
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x if x is not None else -1 for x in r)
    assert sorted(map(key, found.collect())) == sorted(map(key, plain.rows()))


def rounded(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x if x is not None else -1 for x in r) for r in rows)


@pytest.mark.parametrize("p_min,positions,seed", [(0.01, 1 << 20, 0), (1.0, 150, 1), (2e-7, 60, 3)])
def test_scores_whatever_the_tasks_hold_and_the_buckets(spark, p_min, positions, seed):
    docs = corpus(seed, 250)
    held = suffixlm.Corpus(spark.createDataFrame(docs, "doc_id long, text string"), p_min, positions)
    assert (held.least > 3) == (p_min > 2e-7) and (len(held.plan.wide) > 5) == (positions < 1000)
    assert rounded(suffixlm.score(held).collect()) == rounded(Plain(docs).rows())


@pytest.mark.parametrize("most,positions,seed", [(1, 1 << 20, 4), (15, 60, 5), (10**6, 60, 6)])
def test_scores_however_few_words_are_held(spark, most, positions, seed):
    docs = corpus(seed, 250)
    held = suffixlm.Corpus(spark.createDataFrame(docs, "doc_id long, text string"), positions=positions, most=most)
    assert held.plan.whole == (held.least == 3) == (most > 15) and len(held.plan.keys) <= most + len(held.plan.wide)
    assert rounded(suffixlm.score(held).collect()) == rounded(Plain(docs).rows())


def test_rows_between_stages_are_not_documents_times_buckets(spark):
    docs = [(i, " ".join(f"a{(i + k) % 97} b{k % 7}" for k in range(100))) for i in range(3000)]
    held = suffixlm.Corpus(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), positions=30_000)
    assert held.plan.buckets >= 12 and held.rows.count() <= 4  # documents lie in slices and aren't joined
    made = suffixlm.gained(held, 3)
    assert made.filter("n_tokens IS NOT NULL").count() == 3000 and made.count() < 2 * 3000
    assert all(r.score > r.base_score for r in suffixlm.score(held).collect())


def test_dealt_word_that_is_a_state_by_its_extensions_alone(spark):
    rng = random.Random(7)
    docs = []
    for i in range(300):
        words = []
        while len(words) < 40:
            words.append("z" if words[-2:] == ["q", "the"] else rng.choice(["q", "the", "z", *(f"v{k}" for k in range(17))]))
        docs.append((i, " ".join(words)))
    held = suffixlm.Corpus(spark.createDataFrame(docs, "doc_id long, text string"), positions=200)
    assert int(suffixlm.symbols(["the"])[2][1]) in held.plan.wide
    plain = Plain(docs)
    assert ("the",) in plain.states and len(plain.states) < 20
    assert rounded(suffixlm.score(held).collect()) == rounded(plain.rows())


def test_phrases_count_however_large_the_corpus(spark):
    """Three times of each of 20 phrases, beside sixteen million other words."""
    ids = [i for i in range(10**6, 10**6 + 400) if crc32(str(i).encode()) % 10]
    phrases = [" ".join(f"p{k}x{j}" for j in range(8)) for k in range(20)]
    small = [(ids[3 * k + j], phrases[k]) for k in range(20) for j in range(3)]
    filler = spark.range(0, 1800, 1, 8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("f "), 10000).alias("text"))
    found = suffixlm.learn_and_score(filler.unionByName(spark.createDataFrame(small, "doc_id long, text string"))).filter(F.col("doc_id") >= 10**6).collect()
    assert len(found) == 60 and found[0].train_tokens > 15_500_000
    assert all(r.score > r.base_score + 20 for r in found)


def test_blocks_come_back():
    arrays = [np.arange(-5, 40, dtype=np.int32), np.zeros(0, np.int64), np.array([-1, 1 << 60]), np.array([1, 0, 1], np.int8)]
    back = suffixlm.unpacked(suffixlm.packed(arrays), [a.dtype for a in arrays])
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))


def test_distributions_sum_to_one():
    plain = Plain(corpus(2, 300))
    words = [w for (w,) in plain.c[0]]
    for s in [(), *sorted(plain.states)[:40]]:
        unknown = 0.1 / plain.norm
        for k in range(len(s)):
            unknown *= (plain.count(s[k:]) - sum(plain.count((*s[k:], x)) - 0.5 for x in plain.follow[s[k:]])) / plain.count(s[k:])
        assert abs(sum(plain.p(w, s) for w in words) + unknown - 1) < 1e-9


def test_higher_scores_than_single_words_where_order_tells(spark):
    rng = random.Random(5)
    phrases = [[f"p{i}x{k}" for k in range(6)] for i in range(40)]
    docs = [(i, " ".join(w for _ in range(20) for w in rng.choice(phrases))) for i in range(400)]
    found = suffixlm.learn_and_score(spark.createDataFrame(docs, "doc_id long, text string")).filter("held_out").collect()
    assert found and all(r.score > 0.5 * r.base_score for r in found)


def test_word_that_only_held_out_documents_hold_is_dealt(spark):
    held = next(i for i in range(100) if crc32(str(i).encode()) % 10 == 0)
    docs = [(held, "zeta " * 5)] * 3000 + [(i, "some words here") for i in range(200, 230)]
    found = suffixlm.learn_and_score(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).filter(F.col("doc_id") == held)
    assert {(r.n_tokens, r.n_known) for r in found.collect()} == {(6, 1)} and found.count() == 3000


def test_no_training_texts(spark):
    held = next(i for i in range(100) if crc32(str(i).encode()) % 10 == 0)
    schema = "doc_id long, text string"
    assert [tuple(r) for r in suffixlm.learn_and_score(spark.createDataFrame([(held, "a b")], schema)).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert suffixlm.learn_and_score(spark.createDataFrame([], schema)).collect() == []


def test_lookup():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 40, 5000))
    index = suffixlm.Index(keys)
    assert index.of(keys).tolist() == list(range(len(keys)))
    assert (index.of(keys[1:] - 1) == np.where(keys[1:] - 1 == keys[:-1], np.arange(len(keys) - 1), -1)).all()
    assert suffixlm.Index(keys[:0]).of(keys[:9]).tolist() == [-1] * 9
