"""Index arithmetic: blocks, offsets and Z-order keys as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorloom.types import ValueRangeError


def block(c: Column, bits: int) -> Column:
    """Block number of an index: index >> bits."""
    return F.shiftright(c, bits)


def offset(c: Column, bits: int) -> Column:
    """Place of an index within its block."""
    return c.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def index_bits(dim: int) -> int:
    """Bits that the largest index of a mode needs."""
    return max(1, (max(1, dim) - 1).bit_length())


def morton_words(cols: list[Column], bits: int, word: int = 62) -> list[Column]:
    """Z-order key of the indices' low ``bits``, as longs from high to low of at most ``word`` bits each.

    Mode 0 has the highest bit of each group. One long is enough while
    modes x bits stay within ``word``.
    """
    if not cols or bits < 1:
        raise ValueRangeError("a Z-order key needs indices and bits")
    n = len(cols)
    per = max(1, word // n)  # levels in a word
    out = []
    for top in range(bits, 0, -per):
        low = max(0, top - per)
        key = F.lit(0).cast("long")
        for level in range(low, top):
            for m, c in enumerate(cols):
                bit = F.shiftright(c, level).bitwiseAND(F.lit(1).cast("long"))
                key = key.bitwiseOR(F.shiftleft(bit, (level - low) * n + (n - 1 - m)))
        out.append(key)
    return out


def morton_key(cols: list[Column], bits: int) -> Column:
    """Z-order key in one long; an error where it would not fit."""
    if len(cols) * bits > 63:
        raise ValueRangeError(f"{len(cols)} indices of {bits} bits exceed one long: use morton_words")
    return morton_words(cols, bits, 63)[0]
