"""Language-model scores from a probabilistic suffix tree over words.

Symbols are the words of a text (A-Z lower-cased) and one end a text. The tree
has a state for each context, of up to DEPTH words, that its own next-symbol
distribution tells apart from that of its suffix, the context one word shorter.

1. Words are counted over all training texts. An n-gram is frequent if it occurs
   MIN_COUNT times there, whatever the size of the corpus.
2. Smoothing: a context gives each frequent continuation its count less
   DISCOUNT over the context's count, and what is left, in the proportions of
   its suffix, to every symbol; the root is add-ALPHA over all words and one
   unknown. All distributions sum to one.
3. Divergence test: a context is a state if the log-likelihood that it gains
   on its own occurrences over its suffix (count times divergence) is
   at least half the log of all tokens for each continuation it lists and one
   more. Suffixes of states are states.
4. Scoring: each token is given by the longest state that ends before it.

Contexts that end in the same word are a branch of the tree. Each token goes, with
the three words before it, to the bucket of the word before it; a bucket counts,
tests and smooths its branches and scores its tokens. Buckets are of about
POSITIONS tokens. Branches larger than that are dealt over several buckets by the
word one further back; the pairs at their root are counted apart and sent to each.
Whether that root is a state may hang on any of them: where a bucket can't tell,
it gives what the tokens gain if so, and the others' answer decides. Gains are sent
packed by groups of documents, not a row for each document and bucket.

The most frequent words, HELD at most, are held by each task. The others go by
their hashes: what the root gives them is looked up in the table of all words by a
salted join, once a document and word, and summed by document; a bucket counts
them itself where they end a context, and is sent their counts with the pairs that
end in them. So documents stay where they are. Which words are held decides where
a count is found, never a score.

Words are known by 64-bit hashes; two words of one hash would count as one
(with ten million words, odds of one in 370,000 that there is any such pair).

Cases: null and empty texts are one end token. A document without id is
held out and scored. Repeated rows count and are scored each. Without training
texts every token is unknown and of probability one. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, parts_for, salted_join, slices

DEPTH = 3
MIN_COUNT = 3
DISCOUNT, ALPHA = 0.5, 0.1
FOLDS = 10
#: Words that each task holds at most, and tokens a bucket.
HELD, POSITIONS = 2_000_000, 2_000_000
#: Bytes of text worked on at once.
SLICE = 4 << 20
#: No word holds a blank.
END = xxhash.xxh3_64_intdigest(b" ")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts (0: end), each text's offset, and the hashes of the distinct symbols."""
    number = defaultdict(count(1).__next__)
    parts, sizes, end = [], [], np.zeros(1, np.int32)
    for t in texts:
        words = (t or "").encode().lower().split()  # bytes: A-Z alone, and at [\x20\x09-\x0D]
        parts += [np.fromiter(map(number.__getitem__, words), np.int32, len(words)), end]
        sizes.append(len(words) + 1)
    hashes = np.array([END, *map(xxhash.xxh3_64_intdigest, number)], np.uint64).view(np.int64)
    return np.concatenate(parts) if parts else end[:0], np.r_[0, np.cumsum(sizes, dtype=np.int64)], hashes


class Index:
    """Place of values among distinct keys: open addressing, half full at most, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self.first(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.mask

    def first(self, x: np.ndarray) -> np.ndarray:
        return ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted value, or -1."""
        out, todo, at = np.full(len(wanted), -1, np.int32), np.arange(len(wanted)), self.first(wanted)
        while len(todo):
            found = self.slots[at]
            there = found >= 0
            todo, at, found = todo[there], at[there], found[there]
            hit = self.keys[found] == wanted[todo]
            out[todo[hit]] = found[hit]
            todo, at = todo[~hit], (at[~hit] + 1) & self.mask
        return out


def _word_counts(batches):
    for batch in slices(batches, "text", SLICE):
        seq, at, hashes = symbols(column(batch, "text").to_pylist())
        learn = np.repeat(~np.array(column(batch, "held_out")), np.diff(at))
        n, every = np.bincount(seq[learn], minlength=len(hashes)), np.bincount(seq, minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n), pa.array(every)], ["h", "n", "every"])


#: A slice of documents: word numbers (-1 - k: the k-th of the slice's others), tokens, ids, lack of an id, folds and rows of documents, others by rising hashes.
TEXTS = [np.int32, np.int64, np.int64, np.int8, np.int8, np.int64, np.int64]


def _encoded(plan):
    """Documents as the numbers of held words, and the hashes of the others, a row for each slice."""

    def run(batches):
        index = Index(plan.value.keys)
        for batch in slices(batches, "text", SLICE):
            seq, at, hashes = symbols(column(batch, "text").to_pylist())
            number = index.of(hashes)
            low = np.flatnonzero(number < 0)
            low = low[np.argsort(hashes[low])]
            number[low] = -1 - np.arange(len(low), dtype=np.int32)
            ids = column(batch, "doc_id")
            none, held = (np.array(x, np.int8) for x in (pc.is_null(ids), column(batch, "held_out")))
            data = packed([number[seq], np.diff(at), pc.fill_null(ids, 0).to_numpy(), none, held, column(batch, "row").to_numpy(), np.diff(hashes[low], prepend=0)])
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    return run


def _decoded(batches):
    """Word numbers, offsets, ids, folds and rows of a slice's documents, and the hashes of its others."""
    for batch in batches:
        for data in column(batch, "data"):
            words, sizes, ids, none, held, row, others = unpacked(data.as_py(), TEXTS)
            yield words, np.r_[0, np.cumsum(sizes)], pa.array(ids, mask=none.astype(bool)), held.astype(bool), row, np.cumsum(others)


def _others(batches):
    """The words of each document that no task holds, and the times of each."""
    for words, at, _, _, row, others in _decoded(batches):
        where = np.flatnonzero(words < 0)
        doc = np.searchsorted(at, where, "right") - 1
        key, n = np.unique(pair(doc, -1 - words[where]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(row[key >> 32]), pa.array(others[key & LOW]), pa.array(n)], ["row", "h", "times"])


@dataclass
class Plan:
    """What each task holds: held words, by falling count, with their counts; corpus totals; the words whose branches are dealt over several buckets; whether all words of frequent n-grams are held."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    buckets: int
    wide: np.ndarray
    parts: np.ndarray
    whole: bool

    @property
    def norm(self) -> float:
        return self.tokens + ALPHA * (self.distinct + 1)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64)

    def parts_of(self, hashes: np.ndarray) -> np.ndarray:
        """Buckets over which the branch of each word is dealt."""
        at = Index(self.wide).of(hashes)
        return np.where(at >= 0, self.parts[at], 1) if len(self.wide) else np.ones(len(hashes), np.int64)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays by planes of bytes, compressed."""
    planes = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return np.array([len(a) for a in arrays], np.int64).tobytes() + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(data: bytes, kinds: list) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds))
    planes = pa.Codec("zstd").decompress(data[8 * len(kinds) :], int(sum(n * np.dtype(k).itemsize for n, k in zip(sizes, kinds, strict=True))), asbytes=True)
    out, at = [], 0
    for n, k in zip(sizes, kinds, strict=True):
        width = np.dtype(k).itemsize
        out.append(np.frombuffer(planes, np.uint8, n * width, at).reshape(width, n).T.copy().view(k).ravel())
        at += n * width
    return out


#: A block: symbols and the two words before the one before; that one, as a place in a list, by falling times, that follows; where documents begin, rows and folds of these, hashes of words that are not held.
BLOCK = [np.int32, np.int32, np.int32, np.int8, np.int64, np.int8, np.int64]
SENT = "bucket int, doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, block binary, h1 long, h2 long, n long, n2 long"


def _blocks(plan):
    """Each document's own figures, and its tokens in blocks, one a bucket. Word numbers: 0 in no frequent n-gram, then held words, then others."""

    def run(batches):
        p = plan.value
        held = len(p.keys)
        logs, places, parts = np.log10((p.counts + ALPHA) / p.norm), p.place(p.keys), p.parts_of(p.keys)
        for words, at, doc_id, held_out, ids, others in _decoded(batches):
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(at))
            high = words >= 0
            code = np.where(high, words + np.int32(1), np.int32(0) if p.whole else np.int32(held) - words)
            value = np.zeros(len(words))
            value[high] = logs[words[high]]
            n_known, base = np.add.reduceat(high.astype(np.int64), at[:-1]), np.add.reduceat(value, at[:-1])
            yield sent({"bucket": ids % p.buckets, "doc_id": doc_id, "held_out": held_out, "row": ids, "n_tokens": np.diff(at), "n_known": n_known, "base": base})
            del high, value

            since = (np.arange(len(words)) - at[:-1][doc]).astype(np.int32)
            where = np.flatnonzero(since > 0).astype(np.int32)
            where = where[code[where - 1] > 0]
            near = [code[where], code[where - 1]]
            for back in (2, 3):
                near.append(np.where((since[where] >= back) & (near[-1] > 0), code[where - back], np.int32(0)))
            place, part = np.r_[0, places, p.place(others)], np.r_[1, parts, np.ones(len(others), np.int64)]
            bucket = (place % p.buckets).astype(np.int32)[near[1]]
            far = np.flatnonzero(part[near[1]] > 1)
            bucket[far] = (place[near[1][far]] + place[near[2][far]] % part[near[1][far]]) % p.buckets
            order = np.argsort(bucket, kind="stable").astype(np.int32)
            cuts = np.searchsorted(bucket[order], np.arange(p.buckets + 1))
            del since, code, bucket, far
            learn = (~held_out).astype(np.int8)
            doc = doc[where[order]]
            for k in range(4):
                near[k] = near[k][order]
            full = np.flatnonzero(np.diff(cuts))
            made = []
            for b in full:
                x, d = np.concatenate([x[cuts[b] : cuts[b + 1]] for x in near]), doc[cuts[b] : cuts[b + 1]]
                size = len(d)
                low = np.flatnonzero(x > held)
                some, kind = np.unique(x[low], return_inverse=True)
                x[low] = kind + held + 1
                some = some - held - 1
                new = np.r_[True, d[1:] != d[:-1]]
                docs = d[new]
                list_, kind, n = np.unique(x[size : 2 * size], return_inverse=True, return_counts=True)
                falling = np.argsort(-n, kind="stable")
                kind = np.argsort(falling).astype(np.int32)[kind]
                made.append(packed([np.r_[x[:size], x[2 * size :]], kind, list_[falling], new.astype(np.int8), np.diff(ids[docs], prepend=0), learn[docs], np.diff(others[some], prepend=0)]))
            yield sent({"bucket": full, "block": pa.array(made, pa.binary())})

    return run


def sent(columns: dict, schema: str = SENT) -> pa.RecordBatch:
    """Record batch of these columns, the schema's others null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    n = len(next(iter(columns.values())))
    out = {}
    for name, kind in (x.split() for x in schema.split(", ")):
        c = columns.get(name)
        out[name] = pa.nulls(n, kinds[kind]) if c is None else c if isinstance(c, pa.Array) else pa.array(c, kinds[kind])
    return pa.RecordBatch.from_pydict(out)


def _pairs(plan):
    """Pairs of words that their bucket can't tell all about, and their times in training: the first has its branch dealt over several, or no task holds the second."""

    def run(batches):
        p = plan.value
        held = len(p.keys)
        wide = p.parts_of(p.keys) > 1
        for words, at, _, held_out, _, others in _decoded(batches):
            asked = np.append(words[1:] < 0, False) if not p.whole else np.zeros(len(words), bool)
            high = np.flatnonzero(words >= 0)
            asked[high] |= wide[words[high]]
            asked &= np.repeat(~held_out, np.diff(at))
            asked[at[1:] - 1] = False
            where = np.flatnonzero(asked)
            number = np.where(words < 0, held - 1 - words, words)
            key, n = np.unique(pair(number[where], number[where + 1]), return_counts=True)
            hashes = np.r_[p.keys, others]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[key >> 32]), pa.array(hashes[key & LOW]), pa.array(n)], ["h1", "h2", "n"])

    return run


def _to_buckets(plan):
    """Pairs, for each bucket of the first word's branch."""

    def run(batches):
        p = plan.value
        for batch in batches:
            h1 = column(batch, "h1").to_numpy()
            parts = p.parts_of(h1)
            row = np.repeat(np.arange(len(h1)), parts)
            bucket = (p.place(h1)[row] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) % p.buckets
            yield sent({"bucket": bucket.astype(np.int32), **{c: column(batch, c).take(pa.array(row)) for c in ("h1", "h2", "n", "n2")}})

    return run


LOW = 0xFFFFFFFF
#: Gains of a document in a bucket are sent as whole billionths.
UNIT = 1e9
TURNS = 6
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, group int, sums binary, wide long, state boolean"


class Level:
    """Contexts of one length and their frequent continuations: log probabilities, weights of the suffix, states by their own test."""

    def __init__(self, keys: np.ndarray, times: np.ndarray, total: np.ndarray, suffix: np.ndarray, tokens: int):
        self.keys, context, size = keys, keys >> 32, len(total)
        times, total = times.astype(float), total.astype(float)
        self.listed = np.bincount(context, minlength=size)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(self.listed > 0, (total - np.bincount(context, times - DISCOUNT, size)) / total, 1.0)
            self.logs = np.log((times - DISCOUNT) / total[context] + weight[context] * np.exp(suffix))
            rest = total - np.bincount(context, times, size)
            gain = np.bincount(context, times * (self.logs - suffix), size) + np.where(rest > 0, rest * np.log(weight), 0.0)
        self.weights = np.log(weight)
        self.states = (self.listed > 0) & (gain >= 0.5 * (self.listed + 1) * np.log(max(tokens, 2)))


def frequent(key: np.ndarray, learn: np.ndarray, usable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that occur MIN_COUNT times in training, their counts, and the place of each row's key among them or -1."""
    keys, kind = np.unique(key, return_inverse=True)
    n = np.bincount(kind[learn], minlength=len(keys))
    good = (n >= MIN_COUNT) & usable(keys)
    return keys[good], n[good], np.where(good, np.cumsum(good) - 1, -1).astype(np.int32)[kind]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b


def gains(p: Plan, count: np.ndarray, near: np.ndarray, learn: np.ndarray, wide: np.ndarray, pairs: np.ndarray, pair_times: np.ndarray, depth: int):
    """What each token's log probability gains over the root's; the tokens that gain only if their word before is a state, by other buckets' contexts; such words that are states by this bucket's."""
    root = np.log((count + ALPHA) / p.norm)
    root[0] = 0.0  # of words in no frequent n-gram only the weights count
    there = np.zeros(len(count), bool)
    there[near[1]] = there[pairs >> 32] = True
    dense, word = np.cumsum(there, dtype=np.int32) - 1, np.flatnonzero(there)
    x, split = dense[near[1]], wide[word]
    keys, times, e = frequent(pair(x, near[0]), learn, lambda k: (k & LOW > 0) & ~split[k >> 32])
    if len(pairs):  # those of dealt branches, counted
        pairs = pair(dense[pairs >> 32], pairs & LOW)
        sorts = np.argsort(keys := np.r_[keys, pairs])
        e = np.where(e >= 0, np.argsort(sorts).astype(np.int32)[e], np.int32(-1))
        keys, times = keys[sorts], np.r_[times, pair_times][sorts]
        own = np.flatnonzero(split[x])
        k = pair(x[own], near[0][own])
        j = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        e[own] = np.where(keys[j] == k, j, -1)
    levels, rows = [Level(keys, times, count[word], root[keys & LOW], p.tokens)], [(np.arange(near.shape[1], dtype=np.int32), x, e)]
    parents = []
    for n in range(2, depth + 1):
        at, x, e = rows[-1]
        go = np.flatnonzero((levels[-1].listed[x] > 0) & (near[n][at] > 0))
        at, before = at[go].astype(np.int32), e[go]
        contexts, x = np.unique(pair(x[go], near[n][at]), return_inverse=True)
        x = x.astype(np.int32)
        total = np.bincount(x[learn[at]], minlength=len(contexts))
        some = np.flatnonzero(before >= 0)
        keys, times, found = frequent(pair(x[some], before[some]), learn[at[some]], lambda k: True)
        e = np.full(len(at), -1, np.int32)
        e[some] = found
        levels.append(Level(keys, times, total, levels[-1].logs[keys & LOW], p.tokens))
        rows.append((at, x, e))
        parents.append(contexts >> 32)
    own = levels[0].states.copy()
    for n in range(len(parents) - 1, -1, -1):
        levels[n].states[parents[n][levels[n + 1].states]] = True
    first = out = root[near[0]]
    for k, (level, (at, x, e)) in enumerate(zip(levels, rows, strict=True)):
        last = level.logs[e] if len(level.logs) else np.zeros(len(e))
        given = np.where(e >= 0, last, out[at] + level.weights[x])
        if not k:
            open_ = split[x] & ~level.states[x] & (level.listed[x] > 0)
            maybe = np.where(open_, given - first, 0.0)
        out = out.copy()
        hit = level.states[x]
        out[at[hit]] = given[hit]
    told = word[split & levels[0].states & ~own]
    return (out - first) / np.log(10), maybe / np.log(10), open_, told


def dealt(p: Plan, ids: np.ndarray, gain: np.ndarray, wide: int | None = None) -> pa.RecordBatch:
    """What documents gain, packed for each group of them; on the condition that word ``wide`` is a state, if one is given."""
    part = np.rint(gain * UNIT).astype(np.int64)
    some = np.flatnonzero(part)
    some = some[np.lexsort((ids[some], ids[some] % p.buckets))]
    ids, part = ids[some], part[some]
    cuts = np.searchsorted(ids % p.buckets, np.arange(p.buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    sums = [packed([np.diff(ids[cuts[g] : cuts[g + 1]], prepend=0), part[cuts[g] : cuts[g + 1]]]) for g in full]
    return sent({"group": full, "sums": pa.array(sums, pa.binary()), **({} if wide is None else {"wide": np.full(len(full), wide)})}, SCORED)


def _sums(batches):
    """What each document of a group gains in all buckets."""
    found = [unpacked(x.as_py(), [np.int64, np.int64]) for batch in batches for x in column(batch, "sums")]
    if found:
        row, kind = np.unique(np.concatenate([np.cumsum(ids) for ids, _ in found]), return_inverse=True)
        part = np.zeros(len(row), np.int64)
        np.add.at(part, kind, np.concatenate([x for _, x in found]))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(part)], ["row", "part"])


def _branches(plan, depth: int):
    """Gains of a bucket's tokens, summed by document."""

    def run(batches):
        p = plan.value
        blocks, pairs = [], []
        for batch in batches:
            own = batch.filter(pc.is_valid(column(batch, "row")))
            if own.num_rows:
                yield sent({c: column(own, c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base")}, SCORED)
            blocks += [unpacked(x.as_py(), BLOCK) for x in column(batch, "block").drop_null()]
            pairs.append(np.stack([column(batch, c).drop_null().to_numpy() for c in ("h1", "h2", "n", "n2")]))
        if not blocks:
            return
        held = len(p.keys)
        near = [np.insert(b[0].reshape(3, -1), 1, b[2][b[1]], axis=0) for b in blocks]
        ids = np.concatenate([np.cumsum(b[4]) for b in blocks])
        doc = np.cumsum(np.concatenate([b[3] for b in blocks]), dtype=np.int32) - 1
        learn = np.concatenate([b[5] for b in blocks]).astype(bool)[doc]
        others = np.concatenate([np.cumsum(b[6]) for b in blocks])
        sizes = [len(b[6]) for b in blocks]
        del blocks
        h1, h2, n, n2 = np.concatenate(pairs, 1)
        a, b = np.split(Index(p.keys).of(np.r_[h1, h2]).astype(np.int64) + 1 if len(h1) else np.zeros(0, np.int64), 2)
        # Words that are not held have a block's own numbers: numbered anew by hash.
        first, new = a == 0, b == 0
        known, kind = np.unique(np.r_[others, h1[first], h2[new]], return_inverse=True)
        at = 0
        for x, size in zip(near, sizes, strict=True):
            low = x > held
            x[low] = kind[at + x[low] - held - 1] + held + 1
            at += size
        near = np.concatenate(near, 1)
        a[first], b[new] = np.split(kind[at:] + held + 1, [first.sum()])
        # All that follow such a word are here; where one ends a frequent pair, its count came with the pair.
        low = near[1][learn & (near[1] > held)] - held - 1
        count = np.r_[0, p.counts, np.bincount(low, minlength=len(known))]
        count[b[new]] = n2[new]
        wide = np.r_[False, p.parts_of(p.keys) > 1, np.zeros(len(known), bool)]
        a, b, n = (x[wide[a]] for x in (a, b, n))
        keys, once = np.unique(a << 32 | b, return_index=True)
        n, sums = n[once], np.zeros(len(ids))
        # Branches in turns, so that a task works on a part of its bucket at once.
        for turn in range(TURNS):
            at, own = np.flatnonzero(near[1] % TURNS == turn), (keys >> 32) % TURNS == turn
            docs = doc[at]
            gain, maybe, undecided, told = gains(p, count, near[:, at], learn[at], wide, keys[own], n[own], depth)
            sums += np.bincount(docs, gain, len(ids))
            k = np.flatnonzero(undecided)
            first = near[1][at[k]]
            for word in np.unique(first):
                own = k[first == word]
                of, kind = np.unique(docs[own], return_inverse=True)
                yield dealt(p, ids[of], np.bincount(kind, maybe[own], len(of)), p.keys[word - 1])
            yield sent({"wide": p.keys[told - 1], "state": np.ones(len(told), bool)}, SCORED)
        yield dealt(p, ids, sums)

    return run


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"))


def words_of(docs: DataFrame) -> DataFrame:
    """h, n training occurrences and every occurrence of each word of all documents."""
    counted = _typed(docs).select("text", "held_out").mapInArrow(_word_counts, "h long, n long, every long")
    return cut(counted.groupBy("h").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "words")


class Corpus:
    """Word counts of all documents, and the documents as numbers of words."""

    def __init__(self, docs: DataFrame, p_min: float = 0.0, positions: int = POSITIONS, most: int = HELD):
        self.spark = docs.sparkSession
        self.words = words_of(docs)
        self.tokens, self.distinct, self.every = self.words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", (F.col("n") > 0).cast("long"), "every")]).first()
        self.least = max(MIN_COUNT, ceil(self.tokens * p_min), self._least(most))
        buckets = parts_for(self.spark, self.every, positions)
        # Words with branches larger than a bucket, fewer than there are buckets, are held as well.
        end = int(np.uint64(END).astype(np.int64))
        wide = (F.col("n") >= MIN_COUNT) & (F.col("every") * buckets > self.every) & (F.col("h") != end)
        self.held = wide | (F.col("n") >= self.least)
        table = self.words.filter(self.held).select("h", "n", "every", wide.alias("wide")).toArrow()
        keys, counts, every, wide = (table.column(c).to_numpy() for c in ("h", "n", "every", "wide"))
        order = np.lexsort((keys, -counts))
        self.plan = Plan(keys[order], counts[order], self.tokens, self.distinct, buckets, keys[wide], -(-every[wide] * buckets // max(1, self.every)), self.least == MIN_COUNT)
        self.sent = self.spark.sparkContext.broadcast(self.plan)
        asked = _typed(docs).withColumn("row", F.monotonically_increasing_id())
        self.rows = cut(asked.mapInArrow(_encoded(self.sent), "data binary"), "symbols")

    def _least(self, most: int) -> int:
        """Least count of which, and above, there are no more than so many words."""
        top = max(100_000, self.tokens // most + 1)  # fewer words than that are as frequent, and so are the rows here
        n = F.least("n", F.lit(top))
        words, least = 0, top + 1
        for r in self.words.filter(F.col("n") >= MIN_COUNT).groupBy(n.alias("n")).count().orderBy(F.desc("n")).collect():
            words += r["count"]
            if words > most:
                return least
            least = r["n"]
        return 0

    def rest(self) -> DataFrame:
        """The root's part of the words that no task holds, and how many of them are known, by document."""
        # A word that very many documents hold may still be rare in training.
        others = self.words.filter(~self.held)
        asked = self.rows.mapInArrow(_others, "row long, h long, times long")
        found = salted_join(asked, others.select("h", "n"), "h", others.select("h", F.col("every").alias("count")), self.every, "row")
        value = F.log10((F.col("n") + ALPHA) / self.plan.norm)
        return found.groupBy("row").agg(F.sum(F.col("times") * value).alias("root"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))

    def pairs(self) -> DataFrame:
        """The frequent pairs of _pairs with the second word's count, for each bucket that needs them."""
        counted = self.rows.mapInArrow(_pairs(self.sent), "h1 long, h2 long, n long")
        pairs = counted.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
        seconds = self.words.filter(F.col("n") >= MIN_COUNT).select(F.col("h").alias("h2"), F.col("n").alias("n2"))
        return pairs.join(seconds, "h2").mapInArrow(_to_buckets(self.sent), SENT)


def gained(corpus: Corpus, depth: int) -> DataFrame:
    """What the buckets give: the documents' own figures, gains by groups of documents, and words that are states."""
    sent_ = corpus.rows.mapInArrow(_blocks(corpus.sent), SENT)
    if len(corpus.plan.wide) or not corpus.plan.whole:
        sent_ = sent_.unionByName(corpus.pairs())
    return cut(sent_.repartitionById(corpus.plan.buckets, F.col("bucket")).mapInArrow(_branches(corpus.sent, depth), SCORED), "gains")


def score(corpus: Corpus, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    found = gained(corpus, depth)
    states = found.filter("state").select("wide").distinct()
    gains_ = found.filter("sums IS NOT NULL").select("group", "sums", "wide")
    gains_ = gains_.filter("wide IS NULL").unionByName(gains_.join(F.broadcast(states), "wide", "left_semi").select("group", "sums", "wide"))
    parts = gains_.select("group", "sums").repartitionById(corpus.plan.buckets, F.col("group")).mapInArrow(_sums, "row long, part long")
    sums = parts.unionByName(corpus.rest(), allowMissingColumns=True).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("part", "root", "known")])
    out = found.filter("n_tokens IS NOT NULL").drop("group", "sums", "wide", "state").join(sums, "row", "left").fillna(0, ["part", "root", "known"])
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("known")).alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("root")).alias("base_score"),
        (F.col("base") + F.col("root") + F.col("part") / UNIT).alias("score"),
    )


def learn_and_score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Scores of all documents by a tree of those not held out."""
    return score(Corpus(docs), depth)
