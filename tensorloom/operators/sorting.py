"""Orders of nonzeros. Results never depend on physical order; sorts serve sinks and layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import bits as B
from tensorloom.types import SemiSparseTensor, ShapeMismatchError, SparseTensor, ValueRangeError, check_mode


def sort(x: SparseTensor, order: Sequence[int] | None = None, force: bool = False) -> SparseTensor:
    """Lexicographic in the given order of modes (all, or a part); skipped if known to hold."""
    order = tuple(range(x.nmodes)) if order is None else tuple(order)
    for m in order:
        check_mode(m, x.nmodes)
    if len(set(order)) != len(order):
        raise ShapeMismatchError(f"order {order}")
    if not force and x.sort_order is not None and x.sort_order[: len(order)] == order:
        return x
    return x.with_df(x.df.orderBy(*[f"i{m}" for m in order]), order)


def sort_at_mode(x: SparseTensor, mode: int, force: bool = False) -> SparseTensor:
    """Lexicographic with ``mode`` last."""
    check_mode(mode, x.nmodes)
    return sort(x, [*(m for m in range(x.nmodes) if m != mode), mode], force)


def sort_single_mode(x: SparseTensor, mode: int) -> SparseTensor:
    return sort(x, [mode])


def sort_except_mode(x: SparseTensor, order: Sequence[int]) -> SparseTensor:
    """By the N-1 listed modes."""
    if len(order) != x.nmodes - 1:
        raise ShapeMismatchError(f"order {order} of {x.nmodes} modes")
    return sort(x, order)


def block_columns(x: SparseTensor, bits: int, modes: Sequence[int] | None = None) -> list[Column]:
    return [B.block(F.col(f"i{m}"), bits) for m in (range(x.nmodes) if modes is None else modes)]


def row_block_key(x: SparseTensor, sk_bits: int) -> DataFrame:
    """Rows with the kernels' numbers k0…."""
    return x.df.select("*", *[c.alias(f"k{m}") for m, c in enumerate(block_columns(x, sk_bits))])


def sort_row_block(x: SparseTensor, sk_bits: int) -> SparseTensor:
    """By kernels row-major; modes settle the order inside."""
    return x.with_df(x.df.orderBy(*block_columns(x, sk_bits), *x.modes))


def sort_row_block_except_mode(x: SparseTensor, order: Sequence[int], sk_bits: int) -> SparseTensor:
    keys = [c for m in order for c in (B.block(F.col(f"i{m}"), sk_bits), F.col(f"i{m}"))]
    return x.with_df(x.df.orderBy(*keys))


def z_bits(x: SparseTensor) -> int:
    return max(B.index_bits(d) for d in x.dims)


def z_keys(x: SparseTensor) -> DataFrame:
    """Rows with their Z-order key z0… over whole coordinates, high words first."""
    words = B.morton_words([F.col(c) for c in x.modes], z_bits(x))
    return x.df.select("*", *[w.alias(f"z{k}") for k, w in enumerate(words)])


def sort_morton(x: SparseTensor, bits: int | None = None) -> SparseTensor:
    """By the Z-order key of whole coordinates, or of their low ``bits``: what these leave equal is in order of the modes."""
    words = B.morton_words([F.col(c) for c in x.modes], z_bits(x) if bits is None else bits)
    return x.with_df(x.df.orderBy(*words, *([] if bits is None else x.modes)))


def sort_morton_except_mode(x: SparseTensor, order: Sequence[int], sb_bits: int) -> SparseTensor:
    """By blocks of the listed modes row-major, then Z-order inside the blocks."""
    inside = [B.offset(F.col(f"i{m}"), sb_bits) for m in order]
    return x.with_df(x.df.orderBy(*block_columns(x, sb_bits, order), *B.morton_words(inside, sb_bits)))


def mixed_order_keys(x: SparseTensor, sb_bits: int, sk_bits: int) -> list[Column]:
    """Kernels row-major, then Z-order of blocks, then Z-order inside a block."""
    if not 0 < sb_bits <= sk_bits:
        raise ValueRangeError(f"bits {sb_bits}, {sk_bits}")
    inside = [B.offset(F.col(c), sk_bits) for c in x.modes]
    return [*block_columns(x, sk_bits), *B.morton_words(inside, sk_bits)]


def sort_mixed(x: SparseTensor, sb_bits: int, sk_bits: int) -> SparseTensor:
    return x.with_df(x.df.orderBy(*mixed_order_keys(x, sb_bits, sk_bits)))


def sort_partial(x: SparseTensor, order: Sequence[int], sb_bits: int) -> SparseTensor:
    """By the first listed mode, then by blocks of the others, then lexicographic."""
    first, *rest = order
    return x.with_df(x.df.orderBy(f"i{first}", *block_columns(x, sb_bits, rest), *[f"i{m}" for m in rest]))


def sort_fibers(y: SemiSparseTensor) -> SemiSparseTensor:
    return SemiSparseTensor(y.df.orderBy(*y.others), y.dims, y.mode)


def cluster(x: SparseTensor, keys: list[Column], partitions: int | None = None) -> SparseTensor:
    """Range-partitioned and sorted by the keys: an order for files that needs no single task."""
    parts = x.df.repartitionByRange(partitions, *keys) if partitions else x.df.repartitionByRange(*keys)
    return x.with_df(parts.sortWithinPartitions(*keys))


def best_mode_order(dims: Sequence[int], mode: int) -> list[int]:
    """``mode``, then the others by ascending size."""
    check_mode(mode, len(dims))
    return [mode, *sorted((m for m in range(len(dims)) if m != mode), key=lambda m: (dims[m], m))]


def worst_mode_order(dims: Sequence[int], mode: int) -> list[int]:
    """The others by descending size, ``mode`` last."""
    check_mode(mode, len(dims))
    return [*sorted((m for m in range(len(dims)) if m != mode), key=lambda m: (-dims[m], m)), mode]
