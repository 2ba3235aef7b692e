import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def small(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(docs: list[tuple], top: int = 200) -> set[tuple]:
    """(text, lang, source) rows, each pair of sources over all kept terms."""
    docs = [tuple(x or "" for x in d) for d in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        own = [(TERM.findall(small(t)), s) for t, g, s in docs if g == lang]
        held = Counter(w for words, _ in own for w in set(words))
        kept = {w for w, n in held.items() if n >= 3}
        groups = {s: Counter() for _, s in own}
        for words, s in own:
            groups[s].update(w for w in words if w in kept)
        every = sum(groups.values(), Counter())
        size = lambda c: max(1, sum(c.values()) + len(kept))
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // size(c)
        f = lambda x, y: (x - y) ** 2 // y
        for s, c in groups.items():
            pairs = [(-sum(f(p(c, w), p(o, w)) for w in kept), x.encode(), x) for x, o in groups.items() if x != s]
            terms = [(-f(p(c, w), p(every, w)), w.encode(), w) for w in c if c[w] and p(c, w) > p(every, w)]
            out |= {(lang, s, "pair", x, -v, k + 1) for k, (v, _, x) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", x, -v, k + 1) for k, (v, _, x) in enumerate(sorted(terms)) if k < top}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


@pytest.mark.parametrize("seed", range(3))
def test_random_documents_against_the_definition(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "Él", "él", "x1y", "日本", "a-b", "ZZ", "naïve"] + [f"w{chr(97 + i)}" for i in range(15)]
    rows = [
        (" ".join(rng.choice(vocabulary[: rng.randint(2, 24)]) for _ in range(rng.randint(0, 30))) if rng.random() < 0.9 else None, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "ü3", None, "s4"]))
        for _ in range(120)
    ]
    rows += [("only once", "xx", "a"), ("and twice", "xx", "b"), (None, "yy", "alone")]
    found = divergence.audit(table(spark, rows)).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == plain(rows)


def test_only_the_first_ranks_of_terms(spark):
    rows = [(" ".join(f"t{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)), "en", "s")] * 3 + [("other words", "en", "r")] * 4
    found = {tuple(r) for r in divergence.audit(table(spark, rows), top=7).collect()}
    assert found == plain(rows, 7) and len([r for r in found if r[2] == "term" and r[1] == "s"]) == 7


def test_hot_group_and_clashing_columns(spark):
    rows = [("alpha beta", "en", "hot")] * 60 + [("alpha gamma", "en", "s2"), ("gamma", "en", "s3"), ("gamma delta", "en", "s3")]
    docs = table(spark, rows).withColumn("term", F.lit(1)).withColumn("n", F.lit("x")).withColumn("group", F.lit(2)).withColumn("value", F.lit(0))
    assert {tuple(r) for r in divergence.audit(docs).collect()} == plain(rows)


def test_counts_beyond_the_longs(spark):
    row = spark.range(1).select(divergence.probability(F.lit(10**13), F.lit(3 * 10**13)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**13 + 1) // (3 * 10**13)


def test_empty_table(spark):
    assert divergence.audit(table(spark, [])).collect() == []
