"""Word hashes of many UTF-8 texts at once."""

from __future__ import annotations

from functools import cache

import numpy as np

_BYTES = np.arange(256)
#: Letters and digits of ASCII, and bytes of other characters until these are looked at, make words; the rest separates.
WORD = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
VALUE = np.where(WORD, (LOWER + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))


def _pairs() -> np.ndarray:
    """Two-byte characters (first byte high) with their lower-case forms, where these have two bytes too."""
    table = np.arange(1 << 16, dtype=np.uint16)
    for c in range(0x80, 0x800):
        small = chr(c).lower().encode()
        if len(small) == 2:
            table[int.from_bytes(chr(c).encode(), "big")] = int.from_bytes(small, "big")
    return table


PAIRS = _pairs()
_powers = np.ones(1, np.uint64)


def folded(data: np.ndarray) -> np.ndarray:
    """Characters of two bytes in lower case; the others as they are."""
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    lead = lead[lead < len(data) - 1]
    if not len(lead):
        return data
    pair = PAIRS[data[lead].astype(np.uint16) << 8 | data[lead + 1]]
    out = data.copy()
    out[lead], out[lead + 1] = pair >> 8, pair & 0xFF
    return out


@cache
def classes() -> np.ndarray:
    """Of each code point: 0 separates, 1 is of a word (letter, digit or mark), 2 a word of its own (of scripts without spaces)."""
    import unicodedata

    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = 0  # surrogates stand in no UTF-8 text
    out = np.char.isalnum(points.view("U1")).astype(np.uint8)
    marks = [c for c in [*range(0x300, 0x20000), *range(0xE0100, 0xE01F0)] if unicodedata.category(chr(c))[0] == "M"]
    out[marks] = 1
    for low, high in ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000)):
        out[low:high][out[low:high] == 1] = 2
    return out


def shapes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of UTF-8 text: whether it is of a word, and whether a word begins with it whatever is before."""
    inside, fresh = WORD[data], np.zeros(len(data) + 1, bool)
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return inside, fresh
    first = data[lead].astype(np.uint32)
    size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
    at = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.uint32) & 0x3F
    two, three = (first & 0x1F) << 6 | at(1), (first & 0x0F) << 12 | at(1) << 6 | at(2)
    point = np.where(size == 2, two, np.where(size == 3, three, (first & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
    kind = classes()[np.minimum(point, 0x10FFFF)]
    for k in range(4):
        here = (size > k) & (lead + k < len(data))
        inside[lead[here] + k] = kind[here] > 0
    alone = lead[kind == 2]
    fresh[alone] = True
    fresh[np.minimum(alone + size[kind == 2], len(data))] = True
    return inside, fresh


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd factor modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 256), 0xD6E8FEB86659FD93, np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def words(data: np.ndarray, at: np.ndarray):
    """Hash, begin, end and text (index) of each word; ``at``: the texts' offsets.

    Words are runs of letters, digits and marks of any script; an ideograph or kana is a word. Case is ignored for characters of one or two bytes.
    """
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none, none
    inside, fresh = shapes(data)
    edge = at[:-1][np.diff(at) > 0]
    fresh[edge] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | fresh[:-1]))
    if not len(begin):
        return none.astype(np.uint64), none, none, none
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:] & ~fresh[1:-1]
    end = np.flatnonzero(inside & ~after) + 1
    size = end - begin
    place = np.arange(len(data)) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, len(data)]))
    place[~inside] = 0
    value = VALUE[folded(data)] * powers(int(size.max()))[place]
    value[~inside] = 0
    return mix(np.add.reduceat(value, begin)), begin, end, np.searchsorted(at, begin, "right") - 1


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (n - 1 fewer entries)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k]
    return mix(out)
