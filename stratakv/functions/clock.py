"""Hybrid timestamps: milliseconds, then a counter in the low bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LOGICAL_BITS


def compose(millis: Column, logical: Column) -> Column:
    return F.shiftleft(millis.cast("long"), LOGICAL_BITS).bitwiseOR(logical.cast("long"))


def physical(ts: Column) -> Column:
    return F.shiftright(ts, LOGICAL_BITS)


def logical(ts: Column) -> Column:
    return ts.bitwiseAND((1 << LOGICAL_BITS) - 1)
