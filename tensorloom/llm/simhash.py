"""SimHash near-dedup: binary trie self-join under a Hamming budget.

Distinct fingerprints are dealt by each of budget + 1 bit blocks: two
fingerprints with at most ``budget`` differing bits agree on one block. In
each task the fingerprints, rotated so that the block leads, form a binary
trie (a sorted array; a node is a range). Pairs of nodes are traversed
together; a pair's differing bits add up and it is dropped beyond the budget.
Links are merged by union-find inside the task, so a dense group of n
fingerprints leaves n - 1 rows, not n * n / 2. A fingerprint of very many
documents reaches them by broadcast, the others by a shuffle. Components over all tasks come
from alternating large-star and small-star rounds.

Cases: null or wordless texts have fingerprint zero and link as any other.
Documents without id have a fingerprint, but no component (null). Repeated
rows stay repeated. Other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tensorloom.functions.lineage import Tables

from .common import column, cut, hot_join, parts_for

WIDTH = 3
SEED = 42
BUDGET = 3
BITS = 64


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of UTF-8 ``text`` (A-Z lower-cased, repeats included)."""
    words = text.lower().split()  # bytes: splits at 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return 0
    if n <= width:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    hashes = [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]
    total = len(hashes)
    counts = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(total, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = column(batch, "text").cast(pa.binary())
        found = np.array([fingerprint(x.as_py() or b"") for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _expand(alo, ahi, blo, bhi):
    """All index pairs (i, j) of the node pairs; i < j within a node and itself."""
    na, nb = ahi - alo, bhi - blo
    size = na * nb
    at = np.repeat(np.cumsum(size) - size, size)
    k = np.arange(int(size.sum())) - at
    wide = np.repeat(nb, size)
    i, j = np.repeat(alo, size) + k // wide, np.repeat(blo, size) + k % wide
    keep = (i < j) | np.repeat(alo != blo, size)
    return i[keep], j[keep]


def trie_links(values: np.ndarray, shared: int, budget: int = BUDGET, small: int = 16, chunk: int = 1 << 17):
    """Yield index pairs of sorted, distinct ``values`` that differ in at most ``budget`` bits.

    Only values with the same first ``shared`` bits meet. All pairs are found;
    of a node pair whose remaining bits cannot exceed the budget, a star stands for all.
    """
    n = len(values)
    if n < 2:
        return
    head = values >> np.uint64(BITS - shared) if shared else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
    hi = np.r_[lo[1:], n]
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    stack = [(shared, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > chunk:
            for i in range(0, len(alo), chunk):
                stack.append((depth, *(x[i : i + chunk] for x in (alo, ahi, blo, bhi, err))))
            continue
        sure = err + (BITS - depth) <= budget
        if sure.any():
            for x, y, u, v in zip(alo[sure], ahi[sure], blo[sure], bhi[sure], strict=True):
                rest = np.unique(np.r_[x:y, u:v])[1:]
                yield np.full(len(rest), x), rest
        few = ((ahi - alo) * (bhi - blo) <= small) & ~sure
        if few.any():
            i, j = _expand(alo[few], ahi[few], blo[few], bhi[few])
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            yield i[near], j[near]
        rest = ~(few | sure)
        if not rest.any():
            continue
        alo, ahi, blo, bhi, err = (x[rest] for x in (alo, ahi, blo, bhi, err))
        shift, bit = np.uint64(BITS - depth), np.uint64(1) << np.uint64(BITS - 1 - depth)

        def middle(start, shift=shift, bit=bit, depth=depth):
            prefix = (values[start] >> shift) << shift if depth else np.zeros(len(start), np.uint64)
            return np.searchsorted(values, prefix | bit)

        am, bm = np.clip(middle(alo), alo, ahi), np.clip(middle(blo), blo, bhi)
        same = alo == blo
        parts = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1), *([(am[~same], ahi[~same], blo[~same], bm[~same], err[~same] + 1)])]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (ahi > alo) & (bhi > blo) & (err <= budget) & ~((alo == blo) & (ahi - alo == 1))
        if live.any():
            stack.append((depth + 1, *(x[live] for x in (alo, ahi, blo, bhi, err))))


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union: ``labels`` point at the least index of a group so far; joins the groups of all i and j."""
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def _trie_join(budget: int):
    width = BITS // (budget + 1)

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        turn, value, rep = (np.concatenate([column(b, c).to_numpy() for b in batches]) for c in ("turn", "value", "rep"))
        value = value.view(np.uint64)
        for t in np.unique(turn):
            own = np.flatnonzero(turn == t)
            own = own[np.argsort(value[own], kind="stable")]
            v, r = value[own], rep[own]
            labels = np.arange(len(v))
            for i, j in trie_links(v, width, budget):
                labels = merge(labels, i, j)
            least = np.full(len(v), np.iinfo(np.int64).max)
            np.minimum.at(least, labels, r)
            to = least[labels]
            out = to != r
            yield pa.RecordBatch.from_arrays([pa.array(r[out]), pa.array(to[out])], ["u", "v"])

    return run


#: Bytes of a rotated fingerprint, and of those that a task should hold.
ROW_BYTES, PART_BYTES = 24, 32 << 20


def links(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (u, v), v < u, whose components are those of all links. ``nodes``: distinct fp, and rep."""
    width = BITS // (budget + 1)
    turns = nodes.select("fp", "rep", F.explode(F.array(*[F.lit(k) for k in range(budget + 1)])).alias("turn"))
    rotated = F.expr(f"shiftleft(fp, turn * {width}) | CASE WHEN turn = 0 THEN 0L ELSE shiftrightunsigned(fp, {BITS} - turn * {width}) END")
    dealt = turns.select("turn", rotated.alias("value"), "rep").withColumn("block", F.expr(f"shiftrightunsigned(value, {BITS - width})"))
    # A task holds its rows at once: their number follows the nodes'.
    spark, size = nodes.sparkSession, nodes.count() * (budget + 1) * ROW_BYTES
    parts = parts_for(spark, size, PART_BYTES)
    spread = dealt.repartition("turn", "block") if size <= PART_BYTES else dealt.repartition(parts, "turn", "block")
    return spread.select("turn", "value", "rep").mapInArrow(_trie_join(budget), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u and root, the least node it reaches, for each node that has a smaller one in reach.

    Alternating large-star and small-star rounds; each round's edges go to the
    shared folder in place of those before. A node's edges are pre-aggregated to their minimum before they move.
    """

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    rounds = Tables(edges.sparkSession, "edges")
    edges = rounds.write(edges.filter("v < u").distinct())
    seen = None
    while True:
        now = state(edges)
        if now == seen or not now[0]:
            return edges.select("u", F.col("v").alias("root"))
        seen = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("v < u").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("v < u").distinct()
        edges = rounds.write(small)
        rounds.drop(1)


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of each document."""
    fps = cut(fingerprints(docs), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.filter("rep IS NOT NULL"), budget))
    named = nodes.join(roots, F.col("rep") == F.col("u"), "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id"))
    return hot_join(fps, named, "fp", "n", fps.count()).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The documents that are the least of their component; a document without id stays."""
    found = near_duplicates(docs.select("doc_id", "text"), budget)
    gone = found.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
