"""URL filter: rules first, then link-graph propagation over hosts.

Pages without a fitting rule get their host's verdict. The share of a host's
pages that rules allow (block) seeds trust (distrust). Trust is a personalised
PageRank along host edges; distrust is one against them, from a blocked host
to those that link to it. Links of all pages are counted by host pair before
they move; a host without links to others keeps its score.

A score is set in relation to what the host would have had if every host were
a seed of 1 (the same propagation from uniform seeds): the outcome, 0 to 1, is
the seed's share of all that reaches the host, however many hosts there are
and however many link to it. As others' links must not clear a host, it counts
no less than the host's own seed. A host is blocked if its distrust, so taken,
reaches ``threshold`` and exceeds its trust.

The rounds end when no score moves by ``tolerance``. All moves of a round are
``damping`` times those of the last in sum, at most, so they come to an end,
after log(tolerance / hosts) / log(damping) rounds at most.

Cases: a null url or one without "://" has an empty host and path, fits no
rule and is allowed. Null html has no links. Repeated rows stay. A null
page_id stays null. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.lineage import Tables

from .common import cut, salted_join

DAMPING, THRESHOLD, TOLERANCE = 0.85, 0.5, 1e-6
#: Rounds after which it is asked whether scores still move.
EVERY = 4
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(host), path


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and w: links between different hosts, counted."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    return links.withColumn("dst", lower_ascii(F.col("dst"))).filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def personalised_rank(seeds: DataFrame, edges: DataFrame, names: tuple[str, ...], damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """way, host and a score by each name, from seeds (way, host and the names) along edges (way, src, dst, w).

    Ways are graphs of their own. The scores of all ways and names move
    together: one pass over the edges a round. The score of a host without
    edges out stays with it.
    """
    total = edges.groupBy("way", "src").agg(F.sum("w").alias("all"))
    share = cut(edges.join(total, ["way", "src"]).select("way", "src", "dst", (F.col("w") / F.col("all")).alias("p")), "shares")
    ends = share.select("way", F.col("src").alias("host"), F.lit(True).alias("leads")).unionByName(share.select("way", F.col("dst").alias("host"), F.lit(False).alias("leads")))
    hosts = seeds.select("way", "host", *names, F.lit(False).alias("leads")).unionByName(ends.select("way", "host", *[F.lit(0.0).alias(n) for n in names], "leads"))
    hosts = hosts.groupBy("way", "host").agg(*[F.sum(n).alias(n) for n in names], F.max("leads").alias("leads"))
    ranks = Tables(edges.sparkSession, "rank")
    rank = ranks.write(hosts.select("way", "host", "leads", *[F.struct(F.col(n).alias("seed"), F.col(n).alias("score")).alias(n) for n in names]))
    final = lambda: rank.select("way", "host", *[F.col(n)["score"].alias(n) for n in names])
    if share.isEmpty():
        return final()

    def moved(n: str):
        stays = F.when(F.col("leads"), 0.0).otherwise(F.col(n)["score"])
        score = (1 - damping) * F.col(n)["seed"] + damping * (F.coalesce(f"got_{n}", F.lit(0.0)) + stays)
        return F.struct(F.col(n)["seed"].alias("seed"), score.alias("score")).alias(n), F.abs(score - F.col(n)["score"])

    columns = [moved(n) for n in names]
    step = F.greatest(*[m for _, m in columns], F.lit(0.0)).alias("moved")
    k = 0
    while True:
        k += 1
        sent = share.withColumnRenamed("src", "host").join(rank, ["way", "host"])
        sent = sent.groupBy("way", F.col("dst").alias("host")).agg(*[F.sum(F.col("p") * F.col(n)["score"]).alias(f"got_{n}") for n in names])
        # A table a round: the plan of the next one does not hold this one's, and takes its place on disk.
        now = ranks.write(rank.join(sent, ["way", "host"], "left").select("way", "host", "leads", *[c for c, _ in columns], step))
        ranks.drop(1)
        rank = now.drop("moved")
        if k % EVERY == 0 and (now.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            return final()


def standing(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust_share and distrust_share from seeds (host, allowed, blocked): each no less than the host's own seed."""
    ways = edges.select(F.lit("trust").alias("way"), "src", "dst", "w").unionByName(edges.select(F.lit("distrust").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    linked = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host")))
    both = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("allowed"), F.lit("distrust"), F.col("blocked"))).alias("way", "own"))
    both = both.unionByName(linked.select("host", F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("way"), F.lit(0.0).alias("own")))
    own = cut(both.groupBy("way", "host").agg(F.max("own").alias("own"), F.lit(1.0).alias("every")), "own")
    scores = personalised_rank(own, ways, ("own", "every"), tolerance=tolerance).join(own.select("way", "host", F.col("own").alias("seed")), ["way", "host"])
    share = F.greatest(F.col("own") / F.col("every"), F.col("seed"))
    of = lambda way: F.max(F.when(F.col("way") == way, share)).alias(f"{way}_share")
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust_share and distrust_share (0 to 1, of its host) of each page."""
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    own = own.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    name, verdict = fitting(F.col("host"), F.col("path"), rules)
    ruled = own.withColumns({"rule": name, "ruled": verdict})
    edges = cut(host_edges(own), "edges")
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = cut(ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"), F.count("*").alias("count")), "seeds")
    scores = cut(standing(seeds, edges, tolerance), "scores")
    # A hot host's pages are dealt over several tasks; pages without a host have no score.
    pages_of = seeds.select("host", "count")
    total = pages_of.agg(F.sum("count")).first()[0] or 0
    listed = ruled.select("page_id", "host", "path", "rule", "ruled")
    scored = salted_join(listed.filter("host <> ''"), scores, "host", pages_of, total, "path")
    without = listed.filter("host = ''").withColumns({"trust_share": F.lit(0.0), "distrust_share": F.lit(0.0)})
    bad = (F.col("distrust_share") >= threshold) & (F.col("distrust_share") > F.col("trust_share"))
    return scored.unionByName(without).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust_share", "distrust_share")
