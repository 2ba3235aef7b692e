"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become classes by a table; a class is a transition function on a
small state set. Functions compose associatively, so a batch of texts is laid
out as rows of equal length: one pass composes each row's function, the rows'
functions are chained, and a second pass fills in the states. States and at
most three code points ahead give the token starts; no regex runs. The slices
between starts feed a cache of merged pieces. Each piece keeps its ids and
their bytes; lengths of the bytes are the offsets kept for decoding.

Cases: null text counts as empty and gives no tokens. Any valid code point is
allowed. Very long pieces are merged with a heap, in n log n. Repeated rows
and other columns are kept apart: each row is coded by itself, and only the
named columns are read. A row without id is coded as any other.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices

# Classes of code points.
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE, LETTER_1, LETTER_R, LETTER_V, LETTER_L, LETTER_E, BREAK = range(12)
# States: what the last code point was part of. FRESH: a text begins. TICK: a quote that began a token.
FRESH, IN_OTHER, IN_LETTER, IN_NUMBER, AFTER_BLANK, AFTER_SPACE, TICK = range(7)
LETTERS = (LETTER, LETTER_1, LETTER_R, LETTER_V, LETTER_L, LETTER_E)
ROW = 256


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point; the Unicode categories L*, N* and the white space of the split pattern."""
    table = np.zeros(sys.maxunicode + 2, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    blanks = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[blanks] = BLANK
    table[0x20] = SPACE
    table[ord("'")] = QUOTE
    for c in "stmd":
        table[ord(c)] = LETTER_1
    for c, kind in (("r", LETTER_R), ("v", LETTER_V), ("l", LETTER_L), ("e", LETTER_E)):
        table[ord(c)] = kind
    table[-1] = BREAK  # stands between texts
    return table


def _transitions() -> np.ndarray:
    """next state by class and state."""
    to = np.zeros((12, 7), np.uint8)
    to[OTHER] = IN_OTHER
    to[list(LETTERS)] = IN_LETTER
    to[NUMBER] = IN_NUMBER
    to[BLANK] = AFTER_BLANK
    to[SPACE] = AFTER_SPACE
    to[BREAK] = FRESH
    to[QUOTE] = TICK
    to[QUOTE, [IN_OTHER, AFTER_SPACE, TICK]] = IN_OTHER  # the quote goes on with a token
    return to


TRANSITIONS = _transitions()


def scan(classes: np.ndarray, row: int = ROW) -> np.ndarray:
    """State after each position, from FRESH, by composing transition functions."""
    n, states = len(classes), TRANSITIONS.shape[1]
    rows = -(-n // row)
    grid = np.full(rows * row, BREAK, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, row).T)
    flat = TRANSITIONS.reshape(-1)
    whole = np.broadcast_to(np.arange(states, dtype=np.uint8)[:, None], (states, rows)).copy()
    base = grid.astype(np.uint16) * states
    for j in range(row):  # a row's function: state before it -> state after it
        whole = flat[base[j] + whole]
    before = np.empty(rows, np.uint8)
    now = FRESH
    for k in range(rows):
        before[k] = now
        now = whole[now, k]
    out = np.empty((row, rows), np.uint8)
    state = before
    for j in range(row):
        out[j] = state = flat[base[j] + state]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def token_starts(points: np.ndarray) -> np.ndarray:
    """Positions where tokens begin. ``points``: code points of texts, each followed by a separator 0x110000."""
    kind = class_table()[points]
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64)
    state = scan(kind)
    was = np.r_[np.uint8(FRESH), state[:-1]]
    ahead = np.r_[kind[1:], np.uint8(BREAK)]
    blank = (kind == BLANK) | (kind == SPACE)
    was_blank = (was == AFTER_BLANK) | (was == AFTER_SPACE)
    ahead_blank = (ahead == BLANK) | (ahead == SPACE) | (ahead == BREAK)
    group = np.where(state == TICK, np.uint8(IN_OTHER), state)
    was_group = np.where(was == TICK, np.uint8(IN_OTHER), was)
    start = np.where(blank, ~was_blank | ~ahead_blank, (group != was_group) & (was != AFTER_SPACE))
    start |= was == FRESH
    tick = np.flatnonzero(state == TICK)
    if len(tick):
        k = np.r_[kind, np.full(3, BREAK, np.uint8)]
        one, two = k[tick + 1], k[tick + 2]
        short = one == LETTER_1
        long = ((one == LETTER_R) | (one == LETTER_V)) & (two == LETTER_E) | (one == LETTER_L) & (two == LETTER_L)
        start[tick[short | long] + 1] = False
        ends = np.r_[tick[short] + 2, tick[long] + 3]
        follow = ends[ends < n]
        # After a contraction letters go on as a token of their own; other classes began one anyway.
        start[follow[~blank[follow]]] = True
    start &= kind != BREAK
    return np.flatnonzero(start)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_pairs(piece: bytes, ranks: dict[bytes, int], long: int = 96) -> list[int]:
    """Ids of a piece: the adjacent pair of least rank, the leftmost of equals, is merged until none has one."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > long:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 60
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge_pairs, over a linked list with a heap of pairs."""
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i], right[i] = stop, right[j]
        if right[j] < n:
            left[right[j]] = i
            k = end[right[i]]
            if (r := ranks.get(piece[i:k])) is not None:
                heapq.heappush(heap, (r, i, k))
        if left[i] >= 0 and (r := ranks.get(piece[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


class Coder:
    """Encodes and decodes by the ranks; pieces are cached up to ``limit``, then the cache starts anew."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 400_000):
        self.ranks, self.limit, self.cache = ranks, limit, {}
        self.bytes_of = {i: b for b, i in ranks.items()}

    def piece(self, text: str) -> tuple[str, int, bytes, tuple[int, ...]]:
        """Decimal ids joined by commas, their number, the bytes they decode to, and the ids."""
        if len(self.cache) >= self.limit:
            self.cache.clear()
        ids = merge_pairs(text.encode(), self.ranks)
        found = (",".join(map(str, ids)), len(ids), self.decode(ids), tuple(ids))
        if len(text) <= 64:
            self.cache[text] = found
        return found

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def pieces(self, texts: list[str]) -> list[list[tuple]]:
        """For each text its pieces in order."""
        joined = "".join([f"{t}\0" for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        stop = np.cumsum(size)
        points[stop - 1] = sys.maxunicode + 1
        starts = token_starts(points)
        first = np.searchsorted(starts, np.r_[0, stop])
        ends = np.r_[starts[1:], 0][: len(starts)]
        some = first[1:] > first[:-1]
        ends[first[1:][some] - 1] = stop[some] - 1
        cut = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        get, piece = self.cache.get, self.piece
        found = [get(x) or piece(x) for x in cut]
        return [found[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces([text])[0] for i in p[3]]


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder a worker process and rank file."""
    if path not in _coders:
        _coders[path] = Coder(read_ranks(path))
    return _coders[path]


def _encoded(path: str, digests: bool):
    def run(batches):
        own = coder(path)
        for batch in slices(batches, "text", 1 << 20):
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            coded = own.pieces(texts)
            count = [sum([p[1] for p in x]) for x in coded]
            decoded = [b"".join([p[2] for p in x]) for x in coded]
            if digests:
                ids = [hashlib.sha256(",".join([p[0] for p in x]).encode()).hexdigest() for x in coded]
                decoded = [hashlib.sha256(x).hexdigest() for x in decoded]
                arrays = [column(batch, "doc_id"), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                ids = [[i for p in x for i in p[3]] for x in coded]
                offsets = [np.cumsum([0, *(len(own.bytes_of[i]) for i in x)])[:-1].tolist() for x in ids]
                arrays = [column(batch, "doc_id"), pa.array(count, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32())), pa.array([x.decode() for x in decoded], pa.string())]
                names = ["doc_id", "n_tokens", "ids", "offsets", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, offsets (byte where each token begins) and decoded (text of the decoded ids).

    ``path``: a rank file that every executor has.
    """
    return _two(docs).mapInArrow(_encoded(path, False), "doc_id long, n_tokens long, ids array<int>, offsets array<int>, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes, made beside the coding."""
    return _two(docs).mapInArrow(_encoded(path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
