"""Benchmark decontamination: rare words and word n-grams seed local alignments.

A passage is what Smith-Waterman aligns with a test item, word by word, at
SHARE of the item's perfect score or more, or ENOUGH words' worth of it.

1. Seeds. All word trigrams of the items, whatever their frequency. A passage
   without any is edited so densely that its score asks for most of the item:
   runs of at most two equal words with an edit between each leave all but few
   of the item's words unmatched (``scattered``). So a bounded number more of
   the item's rarest words than may be missing must occur near one another,
   and these are its other seeds. Rarity is counted over all documents.
2. A pass over all whole texts joins texts to items on seeds. What an
   alignment through a seed can reach at most makes a stretch, which is taken
   if it shares enough words with the item.
3. Stretches are aligned from left to right, in pieces that overlap by as much
   as an alignment can be long: of those that overlap the first one to reach
   the score the best is reported, and what follows it is aligned anew. So each
   copy is reported whole, and no stretch that reaches the score is left over.

Items are held by each task; they are taken in blocks of at most BLOCK bytes
of text, one run of the passes each, so that what is sent stays bounded.
Words are runs of letters, digits and marks of any script, whatever marks of
punctuation part them; ideographs and kana are words each. Case is ignored
where UTF-8 takes one or two bytes a character (Latin, Greek, Cyrillic).

Cases: null or wordless texts and items match nothing. An item of fewer words
than an n-gram and two must occur whole. Repeated rows and repeated items each
have their results. A document without id is reported without one. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import tokens
from .common import column, slices, utf8

GRAM = 3
MATCH, MISS, GAP = 2, -1, -1
SHARE, ENOUGH = 0.5, 25
BLOCK = 16 << 20
TABLE_BITS = 22
#: Bytes of text whose words are held at once.
SLICE = 1 << 20
#: Pairs of seed hits and items that are held at once; more are taken item by item.
PAIRS = 1 << 21


class Seeds:
    """Hashes (sorted), the items that have each, and where in the item first and last."""

    def __init__(self, codes: list, item: list, place: list):
        codes, item, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((codes, np.uint64), (item, np.int64), (place, np.int64)))
        order = np.lexsort((place, item, codes))
        codes, item, place = codes[order], item[order], place[order]
        fresh = np.r_[True, (codes[1:] != codes[:-1]) | (item[1:] != item[:-1])][: len(codes)]
        begin = np.flatnonzero(fresh)
        self.item, self.head = item[begin], place[begin]
        self.tail = place[np.r_[begin[1:], len(place)] - 1] if len(place) else place
        self.codes, first = np.unique(codes[begin], return_index=True)
        self.first = np.r_[first, len(begin)]

    def flags(self) -> np.ndarray:
        """A table by low bits that says of most other hashes that they are no seed."""
        table = np.zeros(1 << TABLE_BITS, bool)
        table[self.codes & np.uint64((1 << TABLE_BITS) - 1)] = True
        return table

    def find(self, h: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``h`` is a seed, and the seed's index."""
        at = np.flatnonzero(flags[h & np.uint64((1 << TABLE_BITS) - 1)])
        if not len(self.codes):
            return at[:0], at[:0]
        k = np.searchsorted(self.codes, h[at])
        k[k == len(self.codes)] = 0
        real = self.codes[k] == h[at]
        return at[real], k[real]

    def pairs(self, at: np.ndarray, code: np.ndarray, items: int):
        """Yield (position, item, first and last place), a range of items at a time, each with all its hits."""
        total = int((self.first[code + 1] - self.first[code]).sum())
        of = np.repeat(np.arange(len(self.codes)), np.diff(self.first)) * (items + 1) + self.item
        edges = np.linspace(0, items, min(items, -(-total // PAIRS)) + 1).astype(np.int64)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            a, z = (np.searchsorted(of, np.arange(len(self.codes)) * (items + 1) + x) for x in (low, high))
            times = (z - a)[code]
            ref = np.repeat(a[code], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            if len(ref):
                yield np.repeat(at, times), self.item[ref], self.head[ref], self.tail[ref]


class Items:
    """Test items as word hashes, with their seeds."""

    def __init__(self, rows: list[tuple], counts: tuple[np.ndarray, np.ndarray] | None = None):
        """``counts``: word hashes (sorted) and how often the documents hold each."""
        self.ids = [r[0] for r in rows]
        grams: tuple[list, list, list] = ([], [], [])
        rare: tuple[list, list, list] = ([], [], [])
        self.words, self.sets, self.short = [], [], set()
        known, often = counts if counts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.joint = np.ones(len(rows), np.int64)
        for k, (_, text) in enumerate(rows):
            data = np.frombuffer((text or "").encode(), np.uint8)
            h = tokens.words(data, np.array([0, len(data)]))[0]
            self.words.append(h)
            self.sets.append(np.unique(h, return_counts=True))
            if not len(h):
                continue
            n = min(GRAM, len(h))
            self.short |= {n} - {GRAM}
            places = np.arange(len(h) - n + 1)
            for part, x in zip(grams, (tokens.grams(h, n), np.full(len(places), k), places), strict=True):
                part.append(x)
            if len(h) < GRAM + 2:
                continue
            may_miss = len(h) - scattered(len(h))
            self.joint[k] = max(1, scattered(len(h)) // 4)
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            times = np.where(known[at] == h, often[at], 0) if len(known) else np.zeros(len(h), np.int64)
            chosen = np.sort(np.lexsort((h, times))[: may_miss + self.joint[k]])
            # A word that the item has twice is one seed; each text position of it counts once, as in any alignment.
            for part, x in zip(rare, (h[chosen], np.full(len(chosen), k), chosen), strict=True):
                part.append(x)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.grams, self.rare = Seeds(*grams), Seeds(*rare)

    def flags(self) -> tuple[np.ndarray, np.ndarray]:
        return self.grams.flags(), self.rare.flags()

    def stretches(self, h: np.ndarray, doc: np.ndarray, docs: int, flags: tuple[np.ndarray, np.ndarray]):
        """Yield (text, item, first word, end word) of all that an alignment may lie in; those of a text and item are apart."""
        begin = np.searchsorted(doc, np.arange(docs + 1))
        found: list[tuple] = []
        for n in {GRAM} | self.short:
            g = tokens.grams(h, n)
            at, code = self.grams.find(g, flags[0])
            same = doc[at] == doc[at + n - 1]
            for at, item, head, tail in self.grams.pairs(at[same], code[same], len(self.ids)):
                # Each side of a seed in an alignment scores 0 at least, so it is three times as long as the item's words there, at most.
                found.append((doc[at], item, at - 3 * tail, at + 3 * (self.size[item] - head)))
        at, code = self.rare.find(h, flags[1])
        for at, item, _, _ in self.rare.pairs(at, code, len(self.ids)):
            order = np.lexsort((at, item, doc[at]))
            at, item = at[order], item[order]
            last = np.arange(len(at)) + self.joint[item] - 1
            real = last < len(at)
            end = np.minimum(last, len(at) - 1)
            near = real & (item[end] == item) & (doc[at[end]] == doc[at]) & (at[end] - at < 3 * self.size[item])
            at, end, item = at[near], at[end[near]], item[near]
            found.append((doc[at], item, end - 3 * self.size[item], at + 3 * self.size[item] + 1))
        if not found:
            return
        text, item, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(text):
            return
        low, high = np.maximum(low, begin[text]), np.minimum(high, begin[text + 1])
        order = np.lexsort((low, item, text))
        text, item, low, high = text[order], item[order], low[order], high[order]
        fresh = np.r_[True, (item[1:] != item[:-1]) | (text[1:] != text[:-1])]
        # The furthest end so far of each text and item: groups are lifted apart so that one running maximum serves all.
        lift = np.cumsum(fresh) * (len(h) + 1)
        furthest = np.maximum.accumulate(high + lift) - lift
        cut = np.r_[True, fresh[1:] | (low[1:] >= furthest[:-1])]
        starts = np.flatnonzero(cut)
        for a, z in zip(starts.tolist(), np.r_[starts[1:], len(cut)].tolist(), strict=True):
            yield int(text[a]), int(item[a]), int(low[a]), int(furthest[z - 1])

    def shares(self, k: int, text: np.ndarray, least: int) -> bool:
        """Whether a text has so many words of item ``k``, none more often than the item does."""
        own, times = self.sets[k]
        at = np.searchsorted(own, text)
        at[at == len(own)] = 0
        at = at[own[at] == text]
        return len(at) >= least and int(np.minimum(np.bincount(at, minlength=len(own)), times).sum()) >= least


def top_score(item: np.ndarray, text: np.ndarray) -> int:
    """The best Smith-Waterman score alone."""
    # Scores are held with what the gaps from the left edge on cost added, so that a running maximum spreads them.
    steps = np.arange(len(text) + 1, dtype=np.int32) * -GAP
    row, top = steps.copy(), steps.copy()
    for word in item:
        slant = row[:-1] + (text == word) * np.int32(MATCH - MISS) + np.int32(MISS - GAP)
        row += GAP
        np.maximum(row, steps, out=row)
        np.maximum(row[1:], slant, out=row[1:])
        np.maximum.accumulate(row, out=row)
        np.maximum(top, row, out=top)
    return int((top - steps).max())


def ends(item: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over words: of the best alignment that ends before each position of ``text``, the score, the begin and how many words are equal.

    A row at a time: each cell carries where its alignment began and how many
    words are equal, so no matrix is held and nothing is traced back.
    """
    m = len(text)
    steps, at = np.arange(m + 1) * -GAP, np.arange(m + 1)
    row, start, equal = np.zeros(m + 1, np.int64), at.copy(), np.zeros(m + 1, np.int64)
    best, begin, count = row.copy(), at.copy(), equal.copy()
    for word in item:
        same = np.r_[False, text == word]
        up = row + GAP
        slant = np.r_[0, row[:-1] + np.where(same[1:], MATCH, MISS)]
        new = np.maximum(np.maximum(up, slant), 0)
        from_slant = (slant == new) & (new > 0)
        begun = np.where(new == 0, at, np.where(from_slant, np.r_[0, start[:-1]], start))
        kept = np.where(new == 0, 0, np.where(from_slant, np.r_[0, equal[:-1]] + same, equal))
        # Gaps in the item: the cell to the left that is best after what the steps between cost.
        level = new + steps
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, at, 0))
        row, start, equal = top - steps, begun[source], kept[source]
        more = row > best
        best[more], begin[more], count[more] = row[more], start[more], equal[more]
    return best, begin, count


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """The best score, its begin and end in ``text``, and how many words are equal."""
    best, begin, count = ends(item, text)
    k = int(best.argmax())
    return (int(best[k]), int(begin[k]), k, int(count[k])) if best[k] else (0, 0, 0, 0)


def needed(words: int) -> int:
    """Score from which a passage counts as a copy of an item of so many words."""
    if words < GRAM + 2:
        return MATCH * words
    return MATCH * min(int(np.ceil(SHARE * words)), ENOUGH)


def scattered(words: int) -> int:
    """Equal words that a passage of ``needed`` score has at least if no three of them follow one another in both.

    With e equal words there are e / 2 runs or more and an edit between each two, so the score is at most 2 e - (e / 2 - 1).
    """
    return -(-(2 * needed(words) - 2) // 3)


def copies(own: np.ndarray, text: np.ndarray, least: int):
    """Yield (score, equal, first word, end word) of the passages of a text, from left to right, none overlapping.

    What is between them reaches the score nowhere. No alignment is longer than
    3 items: each match pays for at most MATCH words of gap.
    """
    reach = 3 * len(own)
    low, piece = 0, 4 * reach
    while low < len(text):
        high = min(len(text), low + piece)
        if top_score(own, text[low:high]) < least:
            if high == len(text):
                return
            low, piece = high - reach, 4 * reach
            continue
        best, begin, count = ends(own, text[low:high])
        over = np.flatnonzero(best >= least)
        first = int(over[0])
        if low + first + reach > high and high < len(text):
            # Its rivals may end beyond the piece; none ends before it, so the next piece begins where they can.
            low += first - reach
            continue
        rivals = over[begin[over] < first]
        k = int(rivals[best[rivals].argmax()])
        yield int(best[k]), int(count[k]), low + int(begin[k]), low + k
        low, piece = low + k, 2 * reach + 1


def passages(items: Items, flags: tuple[np.ndarray, np.ndarray], h: np.ndarray, doc: np.ndarray, docs: int, once: bool = False):
    """Yield (text, item, score, equal, first word, end word) of each contaminated passage; passages of an item do not overlap.

    ``once``: a passage of each text is enough.
    """
    known: dict = {}
    bad = -1
    for t, k, low, high in items.stretches(h, doc, docs, flags):
        if once and t == bad:
            continue
        own, least = items.words[k], needed(int(items.size[k]))
        text = h[low:high]
        if not items.shares(k, text, least // MATCH):
            continue
        key = (k, xxh3_128_digest(text.tobytes()))
        if key not in known:
            known[key] = list(copies(own, text, least))
        for score, equal, s, e in known[key]:
            bad = t
            yield t, k, score / (MATCH * len(own)), equal, low + s, low + e


SCHEMA = "doc_id long, item_id long, score double, n_equal long, start long, end long"


def _found(items: Items):
    def run(batches):
        flags = items.flags()
        for batch in slices(batches, "text", SLICE):
            data, at = utf8(column(batch, "text"))
            h, begin, end, doc = tokens.words(data, at)
            ids = column(batch, "doc_id").to_pylist()
            rows = []
            for t, k, score, equal, a, z in passages(items, flags, h, doc, batch.num_rows):
                point = lambda byte, t=t: len(data[at[t] : byte].tobytes().decode())
                item_id, times = items.ids[k]
                rows += [(ids[t], item_id, score, equal, point(begin[a]), point(end[z - 1]))] * times
            if rows:
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "score", "n_equal", "start", "end"])

    return run


def _clean(items: Items, names: list[str]):
    def run(batches):
        flags = items.flags()
        at_text = names.index("text")
        for batch in slices(batches, "text", SLICE):
            data, at = utf8(batch.column(at_text))
            h, _, _, doc = tokens.words(data, at)
            bad = np.zeros(batch.num_rows, bool)
            for t, *_ in passages(items, flags, h, doc, batch.num_rows, once=True):
                bad[t] = True
            yield batch.filter(pa.array(~bad))

    return run


def _counted(own: np.ndarray):
    """How often the texts of a task hold each of some words (sorted)."""

    def run(batches):
        times = np.zeros(len(own), np.int64)
        for batch in slices(batches, "text", SLICE):
            h = tokens.words(*utf8(column(batch, "text")))[0]
            at = np.searchsorted(own, h)
            at[at == len(own)] = 0
            times += np.bincount(at[own[at] == h], minlength=len(own))
        held = np.flatnonzero(times)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(own[held].view(np.int64)), pa.array(times[held])], ["word", "times"])

    return run


def _rarity(docs: DataFrame, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The words of some items and how often all documents hold each; as many as the items have, which are bounded."""
    data, at = utf8(pa.array([text for _, text in rows], pa.string()))
    own = np.unique(tokens.words(data, at)[0])
    if not len(own):
        return own, np.zeros(0, np.int64)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_counted(own), "word long, times long").groupBy("word").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(len(own), np.int64)
    times[np.searchsorted(own, found["word"].to_numpy().view(np.uint64))] = found["times"].to_numpy()
    return own, times


def _blocks(docs: DataFrame, benchmark: DataFrame):
    """Items with their seeds, a bounded block at a time. Equal items are one, with its rows' number."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    items = items.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // BLOCK))
    for k in range(count):
        rows = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(count)) == k).collect()
        rows = sorted(((r.item_id, r.times), r.text) for r in rows) if all(r.item_id is not None for r in rows) else sorted((((r.item_id, r.times), r.text) for r in rows), key=str)
        own = Items(rows, _rarity(docs, rows))
        if len(own.grams.codes):
            yield own


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score (0 to 1), n_equal words, start and end (code points) of each copied passage."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for items in _blocks(docs, benchmark):
        out = out.unionByName(own.mapInArrow(_found(items), SCHEMA))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no copied passage, with all their columns."""
    out = docs
    for items in _blocks(docs, benchmark):
        out = out.mapInArrow(_clean(items, docs.columns), docs.schema)
    return out
