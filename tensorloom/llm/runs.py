"""Periodic runs of words by names of power-of-two blocks.

A run is a stretch of words that repeats with smallest period q (words q apart
are equal), at least LEAST words and REPEATS periods long, and that no word
on either side extends.

1. Karp-Miller-Rosenberg names: level 0 numbers the distinct words of a text,
   level k + 1 the distinct pairs of level-k names that lie 2^k apart, so equal
   names mean equal blocks of 2^k words, with no hash to trust. A block that
   occurs once needs no rank; levels end where no block repeats.
2. Candidates: a run of period q holds at least ``need(q)`` places whose word
   equals the one q further. Of each such stretch, one point of a grid of
   period need - T + 1 begins a block of T = 2^k equal words, so a look at the
   names of the grid points j and j + q finds each run.
3. Each candidate is extended both ways by descending name levels (longest
   common extension). Of the same stretch, the least period stays.

Texts of one slice are worked on together: words are numbered by text, so no
block of one equals a block of another. Memory is in proportion to a slice's
words times the levels, and a text of any length is one slice.

Cases: null or empty texts have no words and no runs. A document without id
keeps its words as they are in ``digest``. Repeated rows each have their
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from itertools import compress, count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices

LEAST, REPEATS = 24, 3
#: Candidates looked at together.
CHUNK = 1 << 20


def need(q):
    """Fewest places in a run of period q whose word equals the one q further."""
    return np.maximum(LEAST, REPEATS * q) - q


def levels(ids: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4 … words at each place; those that occur once are negative and differ."""
    n = len(ids)
    alone = -1 - np.arange(n, dtype=np.int64)
    out = []
    name = _ranked(ids, np.arange(n), alone)
    while name is not None:
        out.append(name)
        step = 1 << (len(out) - 1)
        if 2 * step > n:
            break
        left, right = name[:-step], name[step:]
        at = np.flatnonzero((left >= 0) & (right >= 0))
        name = _ranked(left[at].astype(np.int64) * n + right[at], at, alone)
    return out


def _ranked(keys: np.ndarray, at: np.ndarray, alone: np.ndarray) -> np.ndarray | None:
    """Ranks of the keys at the places ``at`` that occur twice or more; None where there are none."""
    if not len(keys):
        return None
    order = np.argsort(keys, kind="stable")
    fresh = np.r_[True, np.diff(keys[order]) != 0]
    rank = np.cumsum(fresh) - 1
    many = np.diff(np.r_[np.flatnonzero(fresh), len(keys)]) > 1
    if not many.any():
        return None
    out = alone.copy()
    twice = many[rank]
    out[at[order[twice]]] = rank[twice]
    return out


def _extended(names: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many equal words precede x and y, and how many begin there (x < y)."""
    n = len(names[0])
    back, ahead = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for k in range(len(names) - 1, -1, -1):
        step, name = 1 << k, names[k]
        a = x - back - step
        same = (a >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(y - back - step, 0)])
        back[same] += step
        b = y + ahead
        same = (b < n) & (name[np.minimum(x + ahead, n - 1)] == name[np.minimum(b, n - 1)])
        ahead[same] += step
    return back, ahead


def find(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of texts whose words are numbered apart; ``bounds``: the texts' offsets."""
    size = np.diff(bounds)
    names = levels(ids)
    found = [np.zeros((0, 3), np.int64)]
    for k, name in enumerate(names):
        low = 1 if k == 3 else 1 << k
        if k < 3:  # shorter blocks serve no period
            continue
        # Periods of this level: T = 2^k is the largest power of two up to half of what they need.
        repeats = np.add.reduceat(name >= 0, bounds[:-1][size > 0])
        texts = np.flatnonzero(size > 0)[repeats > 0]
        periods = np.minimum((2 << k) - 1, size[texts] // REPEATS) - low + 1
        texts, periods = texts[(periods > 0) & (size[texts] >= LEAST)], periods[(periods > 0) & (size[texts] >= LEAST)]
        if not len(texts):
            continue
        doc = np.repeat(texts, periods)
        q = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + low
        grid = need(q) - (1 << k) + 1
        points = np.maximum(0, (size[doc] - q - (1 << k)) // grid + 1)
        upto = np.cumsum(points)
        edge = 0
        while edge < len(doc):
            before = upto[edge - 1] if edge else 0
            end = max(edge + 1, int(np.searchsorted(upto, before + CHUNK, "right")))
            part = slice(edge, end)
            p = points[part]
            j = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
            x = np.repeat(bounds[doc[part]], p) + j * np.repeat(grid[part], p)
            period = np.repeat(q[part], p)
            real = name[x] >= 0
            real[real] = name[x[real]] == name[x[real] + period[real]]
            x, period = x[real], period[real]
            if len(x):
                back, ahead = _extended(names, x, x + period)
                long = back + ahead >= need(period)
                start = (x - back)[long]
                found.append(np.unique(np.c_[start, (x + period + ahead)[long], period[long]], axis=0))
            edge = end
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    if len(every):
        # A multiple of the period gives the same stretch.
        every = every[np.r_[True, (np.diff(every[:, :2], axis=0) != 0).any(axis=1)]]
    return every[:, 0], every[:, 1], every[:, 2]


def periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of one document in ten, by its id, repeat from some place on."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def texts_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Of each text, an array of its runs: start, length, period, in order of start, then period."""
    ids, sizes, base = [], [], 0
    for words in texts:
        number = dict.fromkeys(words)
        number = dict(zip(number, count(base), strict=False))
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
        base += len(number)
    bounds = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    if bounds[-1] < LEAST:
        return [np.zeros((0, 3), np.int64)] * len(texts)
    start, end, period = find(np.concatenate(ids), bounds)
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    cut = np.searchsorted(start, bounds)
    return [np.c_[start[a:z] - at, end[a:z] - start[a:z], period[a:z]] for a, z, at in zip(cut[:-1], cut[1:], bounds[:-1], strict=True)]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay if each run is cut to its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


RUNS = "doc_id long, start long, length long, period long"
COLLAPSED = "doc_id long, n_words long, n_dropped long, text string"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _batches(batches, planted: bool):
    for batch in slices(batches, "text"):
        ids = column(batch, "doc_id").to_pylist()
        texts = [(t or "").encode().split() for t in column(batch, "text").to_pylist()]  # at [\x20\x09-\x0D], as bytes split
        if planted:
            texts = [periodic(w, i) for w, i in zip(texts, ids, strict=True)]
        yield ids, texts, texts_runs(texts)


def _table(rows: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(columns, schema, strict=True)], [name for name, _ in schema])


def _schema(text: str) -> list[tuple]:
    return [(name, {"long": pa.int64(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in text.split(", "))]


def _runs(batches):
    for ids, _, runs in _batches(batches, False):
        yield _table([(i, *row) for i, r in zip(ids, runs, strict=True) for row in r.tolist()], _schema(RUNS))


def _collapsed(batches):
    for ids, texts, runs in _batches(batches, False):
        rows = []
        for i, words, r in zip(ids, texts, runs, strict=True):
            stay = kept(len(words), r)
            rows.append((i, len(words), len(words) - int(stay.sum()), b" ".join(compress(words, stay)).decode()))
        yield _table(rows, _schema(COLLAPSED))


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _digest(batches):
    for ids, texts, runs in _batches(batches, True):
        rows = []
        for i, words, r in zip(ids, texts, runs, strict=True):
            listed = r.tolist()
            s, n, q = min(listed, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if listed else (None, None, None)
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in listed)
            left = b" ".join(compress(words, kept(len(words), r)) if listed else words)
            rows.append((i, len(listed), s, n, q, 1000 * n // q if listed else None, _sha(lines.encode()), _sha(left)))
        yield _table(rows, _schema(DIGEST))


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, start (word), length (words) and period of each run of each text."""
    return _typed(docs).mapInArrow(_runs, RUNS)


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_dropped and the text with each run cut to its first period, words joined by spaces."""
    return _typed(docs).mapInArrow(_collapsed, COLLAPSED)


def digest(docs: DataFrame) -> DataFrame:
    """Of each document, once one in ten is made periodic: number of runs, the run of most periods, digests of all runs and of the collapsed text."""
    return _typed(docs).mapInArrow(_digest, DIGEST)
