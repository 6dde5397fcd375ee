"""Stretches of an ordered table that hold about equally many rows, whatever values the order takes.

A hot key, a burst of rows at one moment and a row with a far-off moment leave the stretches equal:
their borders are taken from the rows themselves. Borders only decide which task does what; no
result depends on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most stretches of a table, and rows that are looked at for each.
SLICES, LOOKED_AT = 4096, 32


def cut_points(df: DataFrame, order: Sequence[str], slices: int, n: int | None = None) -> list[tuple]:
    """Up to ``slices`` - 1 rising values of the numeric ``order`` columns that part the rows evenly; a null is no value.

    They are taken from about LOOKED_AT * slices of the ``n`` rows (counted if not given), chosen by a hash;
    the driver gets no more than these.
    """
    slices = min(slices, SLICES)
    if slices < 2:
        return []
    n = df.count() if n is None else n
    rows = df.select(*order).dropna()
    if n > LOOKED_AT * slices:
        hash_ = F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(1 << 40))
        rows = rows.filter(hash_ < F.lit((LOOKED_AT * slices << 40) // n))
    some = sorted(tuple(r) for r in rows.collect())
    return sorted({some[len(some) * i // slices] for i in range(1, slices)}) if some else []


def _literal(v: int | Decimal) -> str:
    return f"{v}L" if isinstance(v, int) else f"{v}BD"


def slice_at(order: Sequence[str], cuts: Sequence[tuple]) -> Column:
    """The number of the cuts that are not above a row's place in ``order``, by binary search: its stretch."""
    if not cuts:
        return F.lit(0)
    one = len(order) == 1
    row = F.col(order[0]) if one else F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    text = ",".join(_literal(c[0]) if one else "named_struct(" + ",".join(f"'c{i}',{_literal(v)}" for i, v in enumerate(c)) + ")" for c in cuts)
    # the zero hides the search from the optimizer: behind a join of slices it may put it where ``order`` is not known
    return search(F.expr(f"array({text})"), F.lit(len(cuts)), row, len(cuts), lambda a, b: a <= b) + (F.monotonically_increasing_id() * F.lit(0)).cast("int")


def search(values: Column, size: Column, x: Column, most: int, before) -> Column:
    """How many leading elements of a sorted array are ``before`` x; the array has ``size`` <= ``most`` elements."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))])
    hop = lambda at, s: F.when((at + s <= size) & before(F.get(values, at + s - 1), x), at + s).otherwise(at)
    return F.aggregate(steps, F.lit(0), hop)
