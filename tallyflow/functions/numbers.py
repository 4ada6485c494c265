"""Conditional sums, and rounding that does not depend on the order a sum was added in."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE_DIGITS = 6


def tidy(col: Column | str, digits: int) -> Column:
    """Half-up rounding of the value after the noise of floating-point addition is removed."""
    return F.round(F.round(col, max(NOISE_DIGITS, digits + 3)), digits)


def tidied(expr: str, digits: int) -> str:
    """:func:`tidy` as SQL text."""
    return f"round(round({expr}, {max(NOISE_DIGITS, digits + 3)}), {digits})"


def sum_where(cond: str, value: str) -> str:
    """SQL text of the sum of ``value`` over rows that meet ``cond``; 0 where there are none."""
    return f"coalesce(sum(CASE WHEN {cond} THEN {value} END), 0D)"


def sum_if(cond: str | Column, value: str) -> Column:
    """:func:`sum_where` as a column; ``cond`` may be a column too."""
    if isinstance(cond, str):
        return F.expr(sum_where(cond, value))
    return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0))


def exprs(*texts: str | Iterable[str]) -> list[Column]:
    """SQL texts, single or in lists, as columns."""
    flat = [t for x in texts for t in ([x] if isinstance(x, str) else x)]
    return [F.expr(t) for t in flat]


def quoted(values: Iterable[str]) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
