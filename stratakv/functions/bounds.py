"""Bounds of key ranges as column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(col: Column, low=None, high=None, low_inclusive: bool = True, high_inclusive: bool = True) -> Column:
    """Keys within the bounds; None is unbounded, and a start beyond the end fits nothing."""
    out = F.lit(True)
    if low is not None:
        out = (col >= F.lit(low)) if low_inclusive else (col > F.lit(low))
    if high is not None:
        out = out & ((col <= F.lit(high)) if high_inclusive else (col < F.lit(high)))
    return out


def prefix_successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def prefix_end(prefix: str) -> str | None:
    """The least string, in the order of code points, above all with the prefix; None if there is none. UTF-8 sorts alike."""
    kept = prefix.rstrip("\U0010ffff")
    if not kept:
        return None
    after = ord(kept[-1]) + 1
    return kept[:-1] + chr(0xE000 if after == 0xD800 else after)  # surrogates are no characters


def prefix_range(col: Column, prefix: str | bytes) -> Column:
    """Keys with the prefix, as the range up to its successor; strings by code points, binary keys by bytes."""
    end = prefix_successor(prefix) if isinstance(prefix, bytes) else prefix_end(prefix)
    return between(col, prefix, end, True, False)


def overlap(a_lo: Column, a_lo_inc: Column, a_hi: Column, a_hi_inc: Column, b_lo: Column, b_lo_inc: Column, b_hi: Column, b_hi_inc: Column) -> Column:
    """Whether two ranges share a point; a null end is unbounded, and a common end counts if both include it."""

    def reaches(hi: Column, hi_inc: Column, lo: Column, lo_inc: Column) -> Column:
        return hi.isNull() | lo.isNull() | (hi > lo) | ((hi == lo) & hi_inc & lo_inc)

    return reaches(a_hi, a_hi_inc, b_lo, b_lo_inc) & reaches(b_hi, b_hi_inc, a_lo, a_lo_inc)


def contains(key: Column, lo: Column, lo_inc: Column, hi: Column, hi_inc: Column) -> Column:
    above = lo.isNull() | (key > lo) | ((key == lo) & lo_inc)
    return above & (hi.isNull() | (key < hi) | ((key == hi) & hi_inc))
