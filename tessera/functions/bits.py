"""Filters as bits: folding, packing, counting, and base64 text. Position 0 is the highest bit of the first byte."""

from __future__ import annotations

import base64
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Bits(NamedTuple):
    """A filter of ``length`` bits; unused bits of the last byte are 0."""

    data: bytes
    length: int

    @classmethod
    def of(cls, mask: int, length: int) -> Bits:
        size = -(-length // 8)
        return cls((mask << (8 * size - length)).to_bytes(size, "big"), length)

    @property
    def mask(self) -> int:
        return int.from_bytes(self.data, "big") >> (8 * len(self.data) - self.length)

    def count(self) -> int:
        return self.mask.bit_count()

    def __getitem__(self, i: int) -> int:  # type: ignore[override]
        return self.mask >> (self.length - 1 - i) & 1

    def to01(self) -> str:
        return f"{self.mask:0{self.length}b}" if self.length else ""


def fold_mask(mask: int, length: int, folds: int) -> int:
    """Halves and XORs ``folds`` times; ``length`` is the length before."""
    if length % (1 << folds):
        raise ValueError(f"a filter of {length} bits cannot be folded {folds} times")
    for _ in range(folds):
        length //= 2
        mask = (mask >> length) ^ (mask & ((1 << length) - 1))
    return mask


def fold_xor(bits: Bits, folds: int) -> Bits:
    return Bits.of(fold_mask(bits.mask, bits.length, folds), bits.length >> folds)


def serialize_bitarray(bits: Bits | bytes) -> str:
    return base64.b64encode(bits if isinstance(bits, bytes) else bits.data).decode()


def deserialize_bitarray(text: str) -> Bits:
    """The length becomes a multiple of 8: padding cannot be told from content."""
    data = base64.b64decode(text)
    return Bits(data, 8 * len(data))


# ---- Column forms --------------------------------------------------------------------------------------


def fold_positions(positions: Column, length: int, folds: int) -> Column:
    """Distinct positions of a filter of ``length`` bits to those of the folded one: residues met an odd number of times."""
    if length % (1 << folds):
        raise ValueError(f"a filter of {length} bits cannot be folded {folds} times")
    if not folds:
        return positions
    residues = F.transform(positions, lambda p: p % (length >> folds))
    return F.filter(F.array_distinct(residues), lambda r: F.size(F.filter(residues, lambda x: x == r)) % 2 == 1)


def _bit_text(positions: Column, length: int) -> Column:
    """Distinct positions as a text of 0 and 1, in one pass over them in order."""
    gap = lambda s, p, i: F.repeat(F.lit("0"), (p - F.coalesce(F.get(s, i - 1), F.lit(-1)) - 1).cast("int"))
    text = lambda s: F.array_join(F.transform(s, lambda p, i: F.concat(gap(s, p, i), F.lit("1"))), "")
    # the sorted array is computed once and then used by every position
    return F.rpad(F.element_at(F.transform(F.array(F.sort_array(positions)), text), 1), length, "0")


def _odd(positions: Column) -> Column:
    """The positions met an odd number of times, once each."""
    last = lambda s, p, i: ~F.get(s, i + 1).eqNullSafe(p)
    kept = lambda s: F.filter(s, lambda p, i: last(s, p, i) & ((i + 2 - F.array_position(s, p)) % 2 == 1))
    return F.element_at(F.transform(F.array(F.sort_array(positions)), kept), 1)


def words_of(positions: Column, length: int, folds: int = 0) -> Column:
    """array<long> of the filter's 64-bit words, the last one filled up with 0; ``length`` is the length before folding, positions are distinct."""
    if length % (1 << folds):
        raise ValueError(f"a filter of {length} bits cannot be folded {folds} times")
    small = length >> folds

    def word(text: Column, at: int) -> Column:
        n = min(64, small - at)
        each = [F.conv(F.rpad(F.substring(text, f * small + at + 1, n), 64, "0"), 2, -10).cast("long") for f in range(1 << folds)]
        return reduce(lambda x, y: x.bitwiseXOR(y), each)

    text = F.array(_bit_text(positions, length))
    return F.element_at(F.transform(text, lambda t: F.array(*[word(t, at) for at in range(0, small, 64)])), 1)


def pack_words(words: Column, length: int) -> Column:
    """The words of a filter of ``length`` bits to binary."""
    whole = F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))
    return whole if length % 64 == 0 else F.substring(whole, 1, -(-length // 8))


def count_words(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def pack_positions(positions: Column, length: int, xor: bool = False) -> Column:
    """Positions to binary. They must be distinct; with ``xor`` they may repeat, and those met an even number of times vanish."""
    return pack_words(words_of(_odd(positions) if xor else positions, length), length)


def popcount(data: Column) -> Column:
    """Set bits of a binary column, eight bytes at a time."""
    def count(digits: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)), F.lit(16))
        return F.aggregate(starts, F.lit(0), lambda acc, i: acc + F.coalesce(F.bit_count(F.conv(digits.substr(i, F.lit(16)), 16, -10).cast("long")), F.lit(0)))

    # the digits are written once and then read by every step
    return F.element_at(F.transform(F.array(F.hex(data)), count), 1)


def to_base64(data: Column) -> Column:
    """One line, whatever the session's line breaks."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def from_base64(text: Column) -> Column:
    return F.unbase64(text)
