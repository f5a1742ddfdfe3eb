"""Values that an expression works out once and uses in several places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(make: Callable[[Column], Column], **values: Column) -> Column:
    """``make`` applied to a struct of ``values``; inside it they are bound variables, not repeated expressions."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), make)[0]


def floor_div(a: Column, b: int) -> Column:
    """a / b towards minus infinity, for b a power of two: an arithmetic shift."""
    return F.shiftright(a, b.bit_length() - 1)


def clamp(x: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def total(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out
