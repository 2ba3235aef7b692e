"""Weak-supervision PII detection in DataFrame functions only.

1. Every whole text is searched once for base patterns and for looser
   candidates. Labelers vote on each: a regex labeler, a gazetteer labeler, a
   context labeler (words before the span) and a shape labeler; 1 for, -1
   against, 0 no opinion. The candidates go to the shared folder.
2. Candidates are counted by kind and votes: a table bounded by the number of
   labelers, whatever the input. Expectation-maximisation over these counts
   estimates each labeler's reliability by kind, and so a probability for
   each row of the table.
3. A logistic span classifier is trained on these probabilities. It doesn't
   see the votes but features of the span: its length, digits, marks and
   check digits, the characters about it and the words near it. Candidates
   are counted by their features (a table bounded by the features' values);
   the classifier is scored as a SQL expression.
Base spans always stay. A candidate is added if its score reaches THRESHOLD
and it overlaps neither a base span nor another such candidate that begins
before it (of those that begin together: than which the other is longer, then
of an earlier kind). Beyond the base kinds, ``secret`` stands for tokens and
keys; its spans are only ever added.

Cases: null text counts as empty. Repeated rows stay repeated; a row without
id is searched as any other. Other columns are ignored. An empty table gives
no rows. Patterns are possessive and begin only where a run begins; positions
and overlaps are running sums and maxima, taken in blocks. So time grows with
a text's length (and, but for a sort, with its matches).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Base patterns; each matches what the plain pattern matches from left to right.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = dict(zip(BASE_KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: Looser candidates of a kind.
MASKED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9.-])"
TOKEN = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}"
LOOSE = {"email": MASKED_EMAIL, "phone": LOCAL_PHONE, "secret": TOKEN}
#: Formats of known keys (bare hexadecimal numbers prove nothing): fixed values.
KEYS = r"^(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,})$"
#: Gazetteers: fixed values.
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|de|fr|es|it|uk|eu|ch|at|nl|be|pl|us|ca|br|mx|ar|jp|cn|in|au"
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|62|35)"
CALLING = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\("
NAMED_KEY = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer|credential)[\"']?\s{0,2}[:=]?\s{0,2}[\"']?$"
NAMED_OTHER = r"(?i)(?:sha-?(?:1|256|512)?|md5|checksum|digest|etag|commit|uuid|href|src|https?:)[\"']?\s{0,2}[:=]?\s{0,2}[\"']?$"
NOT_HOSTS = r"^0*(0|127|255|22[4-9]|23[0-9])\."
#: Context words before a span, for and against each kind.
NEAR = {
    "email": (r"(?i)(e-?mail|contact|write|mailto|courriel|correo)", r"(?i)(commit|regex|pattern)"),
    "ip": (r"(?i)\b(ip|host|server|address|login|from)\b", r"(?i)\b(v|version|release|section|chapter|fig)\b"),
    "card": (r"(?i)(card|visa|credit|debit|payment|karte|carte|tarjeta)", r"(?i)(isbn|order|serial|tracking|sum|total|hash)"),
    "phone": (r"(?i)(phone|tel|call|fax|mobile|cell|anruf|t[ée]l[ée]fono?)", r"(?i)(isbn|order|serial|tracking|version|score)"),
    "secret": (r"(?i)(token|secret|passw|pwd|key|bearer|credential|auth|login)", r"(?i)(commit|sha|md5|hash|checksum|revision|image|href|url|uuid)"),
}
CONTEXT = 40
LABELERS = ("regex_vote", "gazetteer_vote", "context_vote", "shape_vote")
ROUNDS = 40
THRESHOLD = 0.9
SPAN = "array<struct<s:int,e:int,m:string,l:string,r:string>>"
#: Features of a span, and how many values each has (0 to one less).
FEATURES = {"f_length": 6, "f_digits": 5, "f_marks": 8, "f_check": 3, "f_left": 5, "f_right": 5, "f_near": 4}
#: Elements that a running sum takes at once.
STEP = 64


def let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _run_within(values: Column, zero: Column, plus) -> Column:
    """All elements together, and all before each: of few elements, as the list is copied for each."""
    begin = F.struct(zero.alias("all"), F.array().cast("array<int>").alias("before"))
    step = lambda acc, x: F.struct(plus(acc["all"], x).alias("all"), F.concat(acc["before"], F.array(acc["all"])).alias("before"))
    return F.aggregate(values, begin, step)


def running(values: Column, zero: Column, plus, levels: int = 2) -> Column:
    """What ``plus`` makes of all elements before each, from ``zero``. In blocks, and blocks of blocks, as whole lists would be copied for each element."""
    if not levels:
        return _run_within(values, zero, plus)["before"]

    def cut_up(v):
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda b: _run_within(F.slice(v, b * STEP + 1, F.lit(STEP)), zero, plus))

    def joined(parts):
        ahead = running(parts["all"], zero, plus, levels - 1)
        return F.flatten(F.zip_with(parts, ahead, lambda part, a: F.transform(part["before"], lambda x: plus(a, x))))

    return let(let(values, cut_up), joined)


def spans(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` from left to right: start, end (code points), the matched string, and the text on either side up to the next match, CONTEXT characters at most."""

    def placed(found):
        # The text on a match's left and the match, in turn.
        def pieces(gaps):
            return F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("l"), F.substring(F.get(gaps, i + 1), 1, CONTEXT).alias("r")))

        def at(z):
            ahead = running(F.transform(z, lambda x: F.length(x["l"]) + F.length(x["m"])), F.lit(0), lambda a, b: a + b)

            def span(x, a):
                s = a + F.length(x["l"])
                # Of a short string, substring from beyond its begin takes too little.
                near = F.when(F.length(x["l"]) > CONTEXT, F.substring(x["l"], -CONTEXT, CONTEXT)).otherwise(x["l"])
                return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), near.alias("l"), x["r"].alias("r"))

            return F.zip_with(z, ahead, span)

        return let(let(F.split(text, pattern, -1), pieces), at)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(SPAN)))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)

    def add(total, i):
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """Whether a base match counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return let(digits(m), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    return F.length(digits(m)).between(8, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        known = F.lower(m).rlike(rf"[.)\]] ?({TOP_DOMAINS})$")
        return _vote(known, ~known)
    if kind == "ip":
        return _vote(F.lit(False), m.rlike(NOT_HOSTS))
    if kind == "card":
        known = digits(m).rlike(ISSUERS)
        return _vote(known, ~known)
    return _vote(m.rlike(CALLING), F.lit(False))


def context(kind: str, x: Column) -> Column:
    yes, no = NEAR[kind]
    return _vote(x["l"].rlike(yes), x["l"].rlike(no))


def shape(kind: str, m: Column) -> Column:
    if kind == "email":
        return _vote(m.rlike(r"^[A-Za-z0-9][^@\[(]*[A-Za-z0-9] ?[@\[(]"), m.rlike(r"\.\.|^\."))
    if kind == "ip":
        return _vote(m.rlike(r"^[1-9][0-9]{0,2}\."), m.rlike(r"(^|\.)0[0-9]|[0-9]{4}"))
    n = F.length(digits(m))
    if kind == "secret":
        mixed = m.rlike("[0-9].*[0-9].*[0-9].*[0-9]") & m.rlike("[A-Za-z].*[A-Za-z]")
        return _vote(mixed & m.rlike("[A-Za-z0-9]{16}"), ~m.rlike("[0-9]") | ~m.rlike("[A-Za-z]"))
    if kind == "card":
        return _vote(m.rlike(r"^[0-9]{4}([ -]?[0-9]{4}){3}"), ~n.between(13, 19))
    return _vote(n.between(9, 13) & m.rlike(r"[ ().-]"), ~n.between(7, 15))


def _side(c: Column) -> Column:
    """Class of a character beside a span; none at the text's ends."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[\"'`]"), 2).when(c.rlike("^[:=]"), 3).otherwise(4)


def span_features(kind: str, x: Column, check: Column) -> tuple[Column, ...]:
    """Values of FEATURES."""
    m, n = x["m"], x["e"] - x["s"]
    d = F.length(digits(m))
    length = F.when(n < 8, 0).when(n < 12, 1).when(n < 16, 2).when(n < 20, 3).when(n < 33, 4).otherwise(5)
    share = F.when(d == 0, 0).when(d * 3 < n, 1).when(d * 3 < n * 2, 2).when(d < n, 3).otherwise(4)
    marks = sum(F.when(m.rlike(p), w).otherwise(0) for p, w in ((r"\s", 1), ("[-_+/=]", 2), (r"[.()\[\]]", 4)))
    yes, no = NEAR[kind]
    near = F.when(x["l"].rlike(no), 1).when(x["l"].rlike(yes), 2).when(x["r"].rlike(yes), 3).otherwise(0)
    return length, share, marks, check, _side(F.substring(x["l"], -1, 1)), _side(F.substring(x["r"], 1, 1)), near


def regex(kind: str, x: Column, ok: Column) -> Column:
    """The regex labeler: the base pattern with its check, or the formats of keys."""
    if kind == "secret":
        return _vote(x["m"].rlike(KEYS), F.lit(False))
    return _vote(ok, ~ok)


def _voted(kind: str, found: Column, base: bool) -> Column:
    """Candidates with votes and features. ``base``: of the base pattern, which passes or fails."""

    def one(x):
        ok = passes(kind, x["m"]) if base else F.lit(False)
        words = gazetteer(kind, x["m"]) if kind != "secret" else _vote(x["l"].rlike(NAMED_KEY), x["l"].rlike(NAMED_OTHER))
        votes = (regex(kind, x, ok) if base or kind == "secret" else F.lit(0), words, context(kind, x), shape(kind, x["m"]))
        more = span_features(kind, x, F.when(ok, 1).otherwise(2) if base else F.lit(0))
        return F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), ok.alias("base"),
            *[v.cast("int").alias(n) for v, n in zip(votes, LABELERS, strict=True)],
            *[v.cast("int").alias(n) for v, n in zip(more, FEATURES, strict=True)],
        )

    return F.transform(found, one)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and cands: all candidate spans of the whole text with their votes and features."""
    text = F.col("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast(SPAN)
    gate = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+")}
    parts = {f"base_{k}": F.when(gate[k], spans(text, BASE[k])).otherwise(none) for k in BASE_KINDS}
    parts["loose_email"] = F.when(text.rlike(r"(?:\[at\]|\(at\))"), spans(text, MASKED_EMAIL)).otherwise(none)
    parts["loose_phone"] = spans(text, LOCAL_PHONE)
    parts["loose_secret"] = F.filter(spans(text, TOKEN), lambda x: x["m"].rlike("[0-9]"))
    found = own.select("doc_id", "text", *[v.alias(k) for k, v in parts.items()])
    voted = [_voted(k.split("_")[1], F.col(k), k.startswith("base")) for k in parts]
    return found.select("doc_id", F.concat(*voted).alias("cands"))


def estimate(counts: dict[tuple, int], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Expectation-maximisation: probability that a (kind, votes...) row is true.

    Votes are independent given the truth; each labeler has, for each kind, its
    own chances of each vote under truth and under falsehood, smoothed.
    """
    out = {}
    for kind in sorted({k[0] for k in counts}):
        rows = [(k[1:], n) for k, n in counts.items() if k[0] == kind]
        votes, n = np.array([v for v, _ in rows]), np.array([c for _, c in rows], float)
        p = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))  # majority to begin with
        for _ in range(rounds):
            prior = (p @ n + 1) / (n.sum() + 2)
            score = np.full(len(n), math.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                for v in (-1, 0, 1):
                    hit = votes[:, j] == v
                    # Smoothing leans to labelers that are better than chance.
                    yes = (n[hit] @ p[hit] + 2 + v) / (n @ p + 6)
                    no = (n[hit] @ (1 - p[hit]) + 2 - v) / (n @ (1 - p) + 6)
                    score[hit] += math.log(yes / no)
            p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        out |= {(kind, *v): float(q) for (v, _), q in zip(rows, p, strict=True)}
    return out


def encoded(values: tuple) -> list[float]:
    """A bias, and each feature's values as zeros and ones."""
    return [1.0, *[float(v == k) for v, n in zip(values, FEATURES.values(), strict=True) for k in range(n)]]


def train(counts: dict[tuple, tuple[float, float]], ridge: float = 0.1, rounds: int = 25) -> dict[str, list[float]]:
    """Weights of the logistic span classifier by kind, by Newton's method.

    ``counts``: of each (kind, features...), how many candidates and the sum of their probabilities.
    """
    out = {}
    for kind in KINDS:
        rows = [(k[1:], n) for k, n in counts.items() if k[0] == kind]
        w = np.zeros(1 + sum(FEATURES.values()))
        if rows:
            x, n, y = np.array([encoded(v) for v, _ in rows]), np.array([c for _, (c, _) in rows], float), np.array([p / c for _, (c, p) in rows])
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                gradient = x.T @ (n * (p - y)) + ridge * w
                hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
                w -= np.clip(np.linalg.solve(hessian, gradient), -4, 4)
        out[kind] = w.tolist()
    return out


def score(c: Column, weights: dict[str, list[float]]) -> Column:
    """The classifier as an expression over one candidate."""
    total = F.lit(0.0)
    for kind, w in weights.items():
        own, at = F.lit(w[0]), 1
        for name, n in FEATURES.items():
            own = own + F.element_at(F.array(*[F.lit(x) for x in w[at : at + n]]), c[name] + 1)
            at += n
        total = F.when(c["kind"] == kind, own).otherwise(total)
    return 1 / (1 + F.exp(-total))


def fit(cands: DataFrame) -> dict[str, list[float]]:
    """Classifier weights from all candidates; what reaches the driver is counts by kind and votes, and by kind and features."""
    spread = cands.select(F.explode("cands").alias("c")).select("c.*")
    table = spread.groupBy("kind", *LABELERS).count()
    truth = estimate({tuple(r)[:-1]: r["count"] for r in sorted(table.collect())})
    if not truth:
        return train({})
    name = F.concat_ws(",", "kind", *LABELERS)
    known = F.create_map(*[F.lit(x) for k, p in truth.items() for x in (",".join(map(str, k)), p)])
    by = spread.withColumn("p", F.element_at(known, name)).groupBy("kind", *FEATURES).agg(F.count("*").alias("n"), F.sum("p").alias("p"))
    return train({tuple(r)[:-2]: (r["n"], r["p"]) for r in sorted(by.collect())})


def _free(base: Column, more: Column) -> Column:
    """Candidates that overlap no base span, nor a candidate that begins before: by running maxima over all, in order."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"])
    put = lambda c, own: F.struct(c["s"].alias("s"), (-c["e"]).alias("back"), F.lit(own).alias("own"), rank(c).alias("rank"), c["kind"].alias("kind"))
    both = F.sort_array(F.concat(F.transform(base, lambda c: put(c, 0)), F.transform(more, lambda c: put(c, 1))))
    far = F.lit(2**31 - 1)

    def free(z):
        ends = lambda own: running(F.transform(z, lambda x: F.when(x["own"] == own, -x["back"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        nexts = F.reverse(running(F.reverse(F.transform(z, lambda x: F.when(x["own"] == 0, x["s"]).otherwise(far))), far, lambda a, b: F.least(a, b)))
        rows = F.arrays_zip(z.alias("x"), ends(0).alias("base"), ends(1).alias("more"), nexts.alias("next"))
        kept = F.filter(rows, lambda r: (r["x"]["own"] == 1) & (r["base"] <= r["x"]["s"]) & (r["more"] <= r["x"]["s"]) & (r["next"] >= -r["x"]["back"]))
        return F.transform(kept, lambda r: F.struct(r["x"]["kind"].alias("kind"), r["x"]["s"].alias("s"), (-r["x"]["back"]).alias("e")))

    return let(both, free)


def _listed(found: Column) -> Column:
    rank = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"])
    ordered = F.sort_array(F.transform(found, lambda c: F.struct(rank(c).alias("rank"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added and n_private (all spans) of each document."""
    cands = cut(candidates(docs), "candidates")
    weights = fit(cands)
    base = F.transform(F.filter("cands", lambda c: c["base"]), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    more = F.filter("cands", lambda c: ~c["base"] & (score(c, weights) >= threshold))
    none = F.filter("base", lambda c: F.lit(False))
    taken = cands.select("doc_id", base.alias("base"), F.when(F.exists("cands", lambda c: ~c["base"]), more).otherwise(F.filter("cands", lambda c: F.lit(False))).alias("more"))
    taken = taken.withColumn("added", F.when(F.size("more") > 0, _free(F.col("base"), F.col("more"))).otherwise(none))
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    return taken.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_private"),
    )
