"""Scalar column functions with pinned null and zero rules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """Quotient as double; null where the denominator is zero or null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole 24-hour days from one moment to a later one."""
    return F.timestamp_diff("DAY", col(earlier), col(later)).cast("long")


def same_flag(a: str | Column, b: str | Column) -> Column:
    """1 where both are known and equal, else 0."""
    return F.coalesce((col(a) == col(b)).cast("int"), F.lit(0)).cast("long")


def width_bin(value: str | Column, width: float) -> Column:
    """Number of the left-closed bin of fixed width."""
    return F.floor(col(value) / F.lit(width)).cast("long")


def right_bin(value: str | Column, edges: list[float]) -> Column:
    """Label ``(a, b]`` of the right-closed bin between consecutive edges, the last open above; null below the first."""
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, [*edges[1:], math.inf], strict=True))):
        inside = col(value) > low
        if high != math.inf:
            inside = inside & (col(value) <= high)
        out = F.when(inside, F.lit(f"({low:g}, {'inf' if high == math.inf else f'{high:g}'}]")).otherwise(out)
    return out


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a period."""
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def weekday(ts: str | Column) -> Column:
    """Day of the week, Monday 0."""
    return F.weekday(col(ts)).cast("long")


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded double."""
    return F.round(col(c).cast("double"), digits)
