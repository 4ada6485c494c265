"""Time literals, windows and text keys. Ledger times are UTC wall clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(when: datetime) -> str:
    """SQL literal without a time zone, so comparisons with ``ts`` reach the Parquet scan."""
    return f"TIMESTAMP_NTZ '{when:%Y-%m-%d %H:%M:%S.%f}'"


def at(when: datetime) -> Column:
    return F.expr(moment(when))


def within(lo: datetime | None = None, hi: datetime | None = None, ts: str = "ts") -> str:
    """FLT1 as SQL text: strictly after ``lo`` and up to ``hi`` inclusive."""
    parts = [f"{ts} > {moment(lo)}"] if lo is not None else []
    parts += [f"{ts} <= {moment(hi)}"] if hi is not None else []
    return " AND ".join(parts) or "true"


def in_window(ts: str, lo: datetime | None = None, hi: datetime | None = None) -> Column:
    """FLT1: half-open time window."""
    return F.expr(within(lo, hi, ts))


def day_text(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def month_text(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM")


def hour_text(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH")
