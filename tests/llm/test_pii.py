import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def slow(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PIECES = ["a.b@c.example.com", "@", "x@y", "x@y.z_w@q.de", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "2390409500648960", "+1 (377) 555-0271", "+12", "+49.30.12345678", "(377) 555-0271", "é", "\n", " ", "tel ", "card: ", "version ", "joe [at] example [dot] org", "..", "5" * 30, "--", "-", "7"]


def test_base_and_spans(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", *PIECES, "a" * 60_000, "1" * 60_000, "1." * 30_000, "a@" * 5000 + "b.c", "x.@" + "b." * 20_000 + "c", "+" + "1 " * 20_000]
    texts += ["".join(PIECES[i] for i in rng.integers(0, len(PIECES), int(rng.integers(1, 14)))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, None), (None, "a@b.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cands", F.lit(1)).withColumn("base", F.lit(1)).repartition(4)
    found = pii.find(docs).collect()
    assert len(found) == len(rows)
    text_of = dict(rows)
    for r in found:
        want = slow(text_of[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text_of[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        got = r.spans.split(",") if r.spans else []
        assert set(want) <= set(got) and len(got) == len(want) + r.n_added
        ends = sorted((int(a), int(b)) for _, a, b in (g.split(":") for g in got if g not in want))
        assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False))
    assert pii.find(docs.limit(0)).collect() == []


def test_added_spans(spark):
    rows = [(i, f"mail me at user{i}@mail.example.com now") for i in range(40)]
    rows += [(100 + i, f"tel: +1 (377) 555-02{i:02}") for i in range(40)]
    rows += [(200, "please write to joe [at] example [dot] org soon"), (201, "phone (377) 555-0271"), (202, "No contact here, 2390409500648960 atat and 12 34")]
    rows += [(300 + i, "Of atst offer version 1.2.3.999 ref 1234567890123456 x") for i in range(40)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[200].spans == "email:16:39" or found[200].n_added == 1
    assert found[201].spans == "phone:6:20"
    assert all(found[d].spans == "" for d in [202, *range(300, 340)])


def test_expectation_maximisation_recovers_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(6000) < 0.4
    good = (0.9, 0.8, 0.75, 0.7)
    votes = np.stack([np.where(rng.random(6000) < g, np.where(truth, 1, -1), np.where(truth, -1, 1)) for g in good], axis=1)
    counts = {}
    for v in votes:
        counts[("ip", *map(int, v))] = counts.get(("ip", *map(int, v)), 0) + 1
    p = pii.estimate(counts)
    right = np.mean([(p[("ip", *map(int, v))] > 0.5) == t for v, t in zip(votes, truth, strict=True)])
    assert right > 0.9


def test_classifier_learns_from_features():
    rng = np.random.default_rng(1)
    sizes = list(pii.FEATURES.values())
    counts = {}
    for _ in range(300):
        v = tuple(int(rng.integers(0, n)) for n in sizes)
        counts[("secret", *v)] = (10.0, 9.5 if v[0] >= 3 and v[3] != 2 else 0.5)
    w = np.array(pii.train(counts)["secret"])
    for k, (n, y) in counts.items():
        z = 1 / (1 + np.exp(-np.dot(pii.encoded(k[1:]), w)))
        assert (z > 0.5) == (y > n / 2)
    assert all(x == 0 for x in pii.train(counts)["ip"])


def test_secrets_are_added_and_look_alikes_are_not(spark):
    rng = np.random.default_rng(2)
    code = lambda n: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, n))
    words = ["alpha", "ring", "to", "the", "stone", "over"]
    prose = lambda: " ".join(words[i] for i in rng.integers(0, 6, 30))
    made = [lambda: f'token = "{code(40)}"', lambda: f"api_key: {code(32)}", lambda: f"password={code(32)}"]
    other = [lambda: f"commit {code(40)}", lambda: f"md5: {code(32)}", lambda: "=" * 40, lambda: "a" * 50 + "1", lambda: f"image-{rng.integers(1, 99)}-of-the-old-town-hall", lambda: "1" * 30]
    rows = [(i, f"{prose()} {made[i % 3]()} {prose()}") for i in range(60)] + [(100 + i, f"{prose()} {other[i % 6]()} {prose()}") for i in range(120)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {d for d, r in found.items() if r.n_private}
    right = len([d for d in hit if d < 100])
    assert right >= 57 and right / len(hit) >= 0.95
    for d in range(0, 60, 3):
        if d in hit:
            _, s, e = found[d].spans.split(":")
            assert len(dict(rows)[d][int(s) : int(e)]) == 40


def test_running_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-5, 9, n)]) for i, n in enumerate([0, 1, 2, 63, 64, 65, 128, 4095, 4096, 4097, 9000])]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    plus, top = lambda a, b: a + b, lambda a, b: F.greatest(a, b)
    for r in df.select("v", pii.running(F.col("v"), F.lit(0), plus).alias("sum"), pii.running(F.col("v"), F.lit(0), top).alias("top")).collect():
        assert r["sum"] == [sum(r.v[:k]) for k in range(len(r.v))] if len(r.v) < 200 else r["sum"] == [0, *np.cumsum(r.v)[:-1].tolist()]
        assert r["top"] == [max([0, *r.v[:k]]) for k in range(len(r.v))] if len(r.v) < 200 else r["top"] == [0, *np.maximum.accumulate([0, *r.v])[1:-1].tolist()]


def test_very_many_matches_in_one_text(spark):
    text = "1.2.3.4 tel +1 (377) 555-0271 " * 10_000
    rows = [(1, text), (2, "1.2.3.4"), *[(k, f'x token = "{k:040x}" y') for k in range(3, 60)], (60, 'token = "0123456789abcdef0123456789abcdef01234567" ' * 3000)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1].n_ip, found[1].n_phone) == (10_000, 10_000)
    assert found[1].base_sha256 == hashlib.sha256(",".join(slow(text)).encode()).hexdigest()
    assert found[60].n_added == 3000


def test_overlaps(spark):
    """The rule for added spans against its plain form."""
    rng = np.random.default_rng(5)
    kinds = list(pii.KINDS)
    span = lambda: (kinds[int(rng.integers(0, 5))], (s := int(rng.integers(0, 60))), s + int(rng.integers(1, 9)))
    rows = [([span() for _ in range(int(rng.integers(0, 5)))], [span() for _ in range(int(rng.integers(0, 8)))]) for _ in range(150)]
    one = "array<struct<kind:string,s:int,e:int>>"
    got = spark.createDataFrame(rows, f"base {one}, more {one}").select("base", "more", pii._free(F.col("base"), F.col("more")).alias("free")).collect()
    for r in got:
        base, want = [tuple(b) for b in r.base], []
        more = sorted({tuple(m) for m in r.more}, key=lambda m: (m[1], -m[2], kinds.index(m[0])))
        for i, (k, s, e) in enumerate(more):
            if all(b[2] <= s or b[1] >= e for b in base) and all(m[2] <= s for m in more[:i]):
                want.append((k, s, e))
        assert sorted({tuple(x) for x in r.free}) == sorted(want) or len({tuple(m) for m in r.more}) < len(r.more)


def test_luhn(spark):
    cards = ["4111111111111111", "4111111111111112", "6011000990139424", "79927398713"]
    df = spark.createDataFrame([(c,) for c in cards], "d string")
    assert [r[0] for r in df.select(pii.luhn(F.col("d"))).collect()] == [luhn(c) for c in cards]
