"""Divergence of sources: how far the word use of each source is from that of the others and of its language.

Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII. A
language keeps the terms that at least ``min_docs`` of its documents hold, V
of them. A group is a source within a language; it gives each kept term
p = 1 + floor(SCALE * (count + 1) / (N + V)), and two groups differ by the sum
over all kept terms of floor((p - q)^2 / q).

That sum is not formed over V terms a pair, but by inclusion and exclusion
over the groups' supports. With p0 and q0, the values of terms that a group
lacks, as constants:

    sum f(p, q) = V f(p0, q0)                                  all terms as if in neither
                + sum over A's terms  f(p, q0) - f(p0, q0)     from A's histogram of counts
                + sum over B's terms  f(p0, q) - f(p0, q0)     from B's histogram of counts
                + sum over terms in both  f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

Only the last needs terms of two groups together: a join of the sparse
postings (term, source, count) on language and term, each unordered pair of
sources once, whose rows are summed by pair before they are shuffled.

All values are integers: p is computed in decimals, as counts times SCALE
leave the longs, and sums are exact while a language keeps fewer than 10^9
terms (beyond that an overflow is an error, never a wrong value).

Cases: null text, lang and source count as empty strings, and an empty string
is a language or source as any other. A group without terms has N = 0; where a
language keeps no term, pairs have value 0. A source alone in its language
has no pairs. Repeated rows count as documents each; no column but text, lang
and source is read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, cut, salted_join, slices

SCALE = 1_000_000_000
MIN_DOCS, TOP = 3, 200
#: What parts terms becomes a blank and A-Z small; bytes of characters beyond ASCII stay.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text whose terms are counted together.
SLICE = 16 << 20


def probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total); ``total`` is N + V."""
    share = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), F.greatest(total, F.lit(1)).cast("decimal(20,0)"))
    return share + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _term_counts(batches):
    for batch in slices(batches, "text", SLICE):
        number = defaultdict(count().__next__)
        groups = {g: k for k, g in enumerate(dict.fromkeys(zip(column(batch, "lang").to_pylist(), column(batch, "source").to_pylist(), strict=True)))}
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for text, *group in zip(*(column(batch, c).to_pylist() for c in ("text", "lang", "source")), strict=True):
            words = text.encode().translate(TERMS).split()
            term, n = np.unique(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), return_counts=True)
            keys.append(term * len(groups) + groups[tuple(group)])
            times.append(n)
        keys, times = np.concatenate(keys), np.concatenate(times)
        if not len(keys):
            continue
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        terms, (langs, sources) = pa.array(list(number), pa.binary()).cast(pa.string()), (pa.array(x, pa.string()) for x in zip(*groups, strict=True))
        term, group = (pa.array(x) for x in np.divmod(keys[first], len(groups)))
        sums = [pa.array(np.add.reduceat(times, first)), pa.array(np.diff(np.r_[first, len(keys)]))]
        yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(term), *sums], ["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences and docs, the documents that hold it; counted by slices of the texts first."""
    own = docs.select("text", "lang", "source").mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long")
    return own.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Postings:
    """Kept terms by group, and each group's numbers: the tables that the parts of an audit share."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
        own = docs.select(text("text"), text("lang"), text("source"))
        of_term = Window.partitionBy("lang", "term")
        every = counts(own).select(
            "lang", "term", "source", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("lang_n"), (F.min("source").over(of_term) == F.col("source")).cast("long").alias("lead")
        )
        rows = cut(every.filter(F.col("docs") >= min_docs).drop("docs"), "postings")
        languages = rows.groupBy("lang").agg(F.sum("lead").alias("v"), F.sum("n").alias("lang_total"))
        sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("count"))
        groups = own.select("lang", "source").distinct().join(languages, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "lang_total", "total", "count"])
        groups = groups.withColumn("size", F.col("total") + F.col("v")).withColumn("p0", probability(F.lit(0), F.col("size")))
        self.groups = cut(groups, "groups")
        self.rows = rows
        self.count = self.groups.agg(F.sum("count")).first()[0] or 0

    def priced(self) -> DataFrame:
        """lang, term, source, n and lang_n with p, and the group's p0, v and the language's size."""
        own = F.struct("lang", "source").alias("group")
        of_group = self.groups.filter("count > 0").select(own, "size", "p0", (F.col("lang_total") + F.col("v")).alias("lang_size"))
        rows = salted_join(self.rows.select(own, "lang", "source", "term", "n", "lang_n"), of_group, "group", self.groups.select(own, "count"), self.count, "term")
        return rows.drop("group").withColumn("p", probability(F.col("n"), F.col("size")))

    def histograms(self) -> DataFrame:
        """lang, source and p with the number of the group's terms of that value."""
        own = self.rows.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
        return own.join(self.groups.select("lang", "source", "size"), ["lang", "source"]).select("lang", "source", "terms", probability(F.col("n"), F.col("size")).alias("p"))


def ranked(found: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out = found.withColumn("rank", F.row_number().over(order))
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")


def pairs(postings: Postings) -> DataFrame:
    """lang, source, part, item, value and rank of each other source of each source's language."""
    own = postings.groups.select("lang", "source", "v", "p0")
    other = postings.groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    every = own.join(other, "lang").filter("source <> item")
    none = gap(F.col("p0"), F.col("q0"))
    constant = every.select("lang", "source", "item", (F.col("v") * none).alias("value"))

    bars = postings.histograms()
    held = every.join(bars, ["lang", "source"])
    left = held.select("lang", "source", "item", (F.col("terms") * (gap(F.col("p"), F.col("q0")) - none)).alias("value"))
    right = every.join(bars.withColumnRenamed("source", "item").withColumnRenamed("p", "q"), ["lang", "item"])
    right = right.select("lang", "source", "item", (F.col("terms") * (gap(F.col("p0"), F.col("q")) - none)).alias("value"))

    priced = postings.priced()
    side = lambda x: priced.select("lang", "term", *[F.col(c).alias(c + x) for c in ("source", "p", "p0")])
    both = side("_a").join(side("_b"), ["lang", "term"]).filter("source_a < source_b")

    def over(p: str, p0: str, q: str, q0: str) -> Column:
        p, p0, q, q0 = F.col(p), F.col(p0), F.col(q), F.col(q0)
        return F.sum(gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0))

    both = both.groupBy("lang", "source_a", "source_b").agg(over("p_a", "p0_a", "p_b", "p0_b").alias("a_b"), over("p_b", "p0_b", "p_a", "p0_a").alias("b_a"))
    way = lambda x, y: F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item"), F.col(f"{x}_{y}").alias("value"))
    ways = F.inline(F.array(way("a", "b"), way("b", "a")))
    parts = constant.unionByName(left).unionByName(right).unionByName(both.select("lang", ways))
    return ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


def terms(postings: Postings, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank of the ``top`` terms that a group uses most beyond its language."""
    q = probability(F.col("lang_n"), F.col("lang_size"))
    found = postings.priced().select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).filter("p > q")
    return ranked(found.select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value")), "term", top)


def audit(docs: DataFrame, top: int = TOP, min_docs: int = MIN_DOCS) -> DataFrame:
    """Both parts: each pair of sources of a language, and each group's most excessive terms."""
    postings = Postings(docs, min_docs)
    return pairs(postings).unionByName(terms(postings, top))
