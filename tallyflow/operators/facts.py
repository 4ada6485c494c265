"""Flow facts over windows, months, days and hours (AGG1-AGG7, AGG32-AGG33, WIN18-WIN19)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions import Scheme, band_names, day_text, exprs, hour_text, month_text, quoted, size_band, sum_where, tidied, tidy, within
from tallyflow.session import settle

Span = tuple[str, datetime | None, datetime | None]



def standard_windows(as_of: datetime) -> list[Span]:
    """PRJ5: the trailing windows every report shows, and the day before the last."""
    ago = lambda **kw: as_of - timedelta(**kw)
    return [
        ("24h", ago(hours=24), None),
        ("7d", ago(days=7), None),
        ("30d", ago(days=30), None),
        ("all history", None, None),
        ("prev 24h", ago(hours=48), ago(hours=24)),
    ]


OUT, IN = "direction = 'OUT'", "direction = 'IN'"


def rows_in(df: DataFrame) -> str:
    """How many transfers a row stands for: its ``n`` in a rollup, otherwise one."""
    return "n" if "n" in df.columns else "1L"


def count_where(cond: str, rows: str) -> str:
    return f"coalesce(sum(CASE WHEN {cond} THEN {rows} END), 0L)"


#: A transfer as a number of 31 bits; sums of it hold eight billion rows a day.
_TRANSFER = "pmod(xxhash64(direction, asset, cp, band, fine, cat, usd, val), 2147483648L)"


def rollup(ledger: DataFrame) -> DataFrame:
    """Transfers of a classified ledger counted per day, counterparty and class.

    Monthly, daily, leaderboard and class figures read this table as they read
    the ledger. A closed day never changes, so it is rolled up once. ``mark`` adds up a hash of each
    transfer, by which :func:`roll_forward` knows a day again.
    """
    return ledger.groupBy("day", "direction", "asset", "cp", "band", "fine", "cat").agg(
        *exprs("count(*) AS n", "sum(usd) AS usd", "sum(val) AS val", f"sum({_TRANSFER}) AS mark")
    )


def roll_forward(state: DataFrame, ledger: DataFrame) -> DataFrame:
    """A stored rollup brought up to date with the ledger.

    Days whose row count or sum of hashes is not the stored one (new, still open when they
    were stored, with late rows, or with rows corrected or gone) are rolled up anew; the others stay as stored.
    Of those the hashed columns are read from the ledger, and a row per day is shuffled.
    """
    if "mark" not in state.columns:  # stored before there were marks: every day moves
        state = state.withColumn("mark", F.lit(None).cast("long"))
    stored = state.groupBy("day").agg(F.struct(F.sum("n").alias("n"), F.sum("mark").alias("mark")).alias("stored"))
    found = ledger.groupBy("day").agg(F.expr(f"struct(count(*) AS n, sum({_TRANSFER}) AS mark)").alias("found"))
    moved = found.join(stored, "day", "full")
    moved = settle(moved.filter(~F.col("found").eqNullSafe(F.col("stored"))).select("day"), "moved_days")
    tail = settle(rollup(ledger.join(moved, "day", "left_semi")), "rollup_tail")
    return state.join(moved, "day", "left_anti").unionByName(tail)


def _per_counterparty(assets: Sequence[str], rows: str, cond: str = "true") -> list[str]:
    """Measures of one counterparty's rows, all of one direction."""
    by_asset = [
        f"{sum_where(f'{cond} AND asset = {quoted([a])}', col)} AS {name}_{a}" for a in assets for name, col in (("usd", "usd"), ("raw", "val"))
    ]
    return [f"{count_where(cond, rows)} AS n", f"{sum_where(cond, 'usd')} AS usd", *by_asset]


def _finish(rows: DataFrame, by: str, assets: Sequence[str], recycle_src: str | None, *more: str) -> DataFrame:
    """Facts from rows that hold one (group, direction, counterparty) each."""
    recycled = f"{IN} AND cp = {quoted([(recycle_src or '').lower()])}"
    per_asset = [
        f"{tidied(sum_where(way, f'{col}_{a}'), digits)} AS {name}_{a}"
        for name, way, col, digits in (("out_usd", OUT, "usd", 2), ("out_raw", OUT, "raw", 1), ("in_raw", IN, "raw", 1))
        for a in assets
    ]
    out, inn, rec = (sum_where(cond, "usd") for cond in (OUT, IN, recycled))
    return rows.groupBy(by).agg(
        *exprs(
            f"{tidied(out, 2)} AS out_usd",
            f"{tidied(inn, 2)} AS in_usd",
            f"{tidied(rec, 2)} AS in_recycled_usd",
            f"{tidied(f'{inn} - {rec}', 2)} AS in_external_usd",
            f"{tidied(f'{inn} - {out}', 2)} AS net_usd",
            f"coalesce(sum(n) FILTER (WHERE {OUT}), 0L) AS out_tx",
            f"coalesce(sum(n) FILTER (WHERE {IN}), 0L) AS in_tx",
            f"count_if({OUT}) AS out_wallets",
            f"count_if({IN}) AS in_sources",
            per_asset,
            more,
        )
    )


def flow_facts(ledger: DataFrame, windows: Sequence[Span], assets: Sequence[str], recycle_src: str | None = None) -> DataFrame:
    """AGG1: facts of overlapping windows in one pass over the ledger.

    The ledger is reduced to one row per counterparty holding every window's
    measures, combined before the only large shuffle. Windows become rows after
    that, and distinct counterparties are then plain counts.
    """
    rows = ledger
    if all(lo is not None for _, lo, _ in windows):
        rows = ledger.filter(within(min(lo for _, lo, _ in windows)))
    measures = [
        f"struct({quoted([label])} AS label, {', '.join(_per_counterparty(assets, rows_in(ledger), within(lo, hi)))}) AS w{i}"
        for i, (label, lo, hi) in enumerate(windows)
    ]
    wide = rows.groupBy("direction", "cp").agg(*exprs(measures))
    long = wide.selectExpr("direction", "cp", f"inline(array({', '.join(f'w{i}' for i in range(len(windows)))}))").filter("n > 0")
    return _finish(long, "label", assets, recycle_src)


def monthly_facts(ledger: DataFrame, as_of: datetime, assets: Sequence[str], recycle_src: str | None = None) -> DataFrame:
    """AGG2: the same facts per month; an unfinished or late-starting month says so."""
    rows = ledger.groupBy(F.trunc("day", "month").alias("month"), "direction", "cp").agg(
        *exprs(f"min(day) FILTER (WHERE {OUT}) AS first_out", _per_counterparty(assets, rows_in(ledger)))
    )
    facts = _finish(rows, "month", assets, recycle_src, "min(first_out) AS first_out")
    every_month = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = facts.withColumn("start", F.min("first_out").over(every_month)).withColumn("name", month_text("month"))
    label = f"""CASE WHEN name = '{as_of:%Y-%m}' THEN name || ' (partial)'
        WHEN trunc(start, 'month') = month AND dayofmonth(start) <> 1 THEN name || ' (from ' || date_format(start, 'yyyy-MM-dd') || ')'
        ELSE name END"""
    return named.withColumn("label", F.expr(label)).drop("month", "first_out", "start", "name")


def daily_facts(ledger: DataFrame, as_of: datetime, assets: Sequence[str], scheme: Scheme) -> DataFrame:
    """AGG3: per day flows, counts, wallets, raw amounts and a map of size bands.

    One row per (day, direction, counterparty) first, with each band's count and
    amount beside it; distinct wallets per day and per band are counts of those.
    """
    bands = list(enumerate(band_names(scheme)))
    n, size = rows_in(ledger), "band" if "band" in ledger.columns else size_band(scheme=scheme)
    banded = ledger.selectExpr("*", f"CASE WHEN {OUT} THEN {size} END AS size")
    per_band = []
    for i, b in bands:
        hit = f"size = {quoted([b])}"
        per_band += [f"{count_where(hit, n)} AS n{i}", f"{sum_where(hit, 'usd')} AS u{i}"]
    rows = banded.groupBy("day", "direction", "cp").agg(*exprs(_per_counterparty(assets, n), per_band))
    entries = ", ".join(
        f"struct({quoted([b])} AS band, struct(sum(n{i}) AS n, {tidied(f'sum(u{i})', 2)} AS usd, count_if(n{i} > 0) AS w) AS v)" for i, b in bands
    )
    out, inn = sum_where(OUT, "usd"), sum_where(IN, "usd")
    return rows.groupBy("day").agg(
        *exprs(
            f"{tidied(out, 2)} AS out_usd",
            f"{tidied(inn, 2)} AS in_usd",
            f"{tidied(f'{inn} - {out}', 2)} AS net_usd",
            f"coalesce(sum(n) FILTER (WHERE {OUT}), 0L) AS out_tx",
            f"count_if({OUT}) AS wallets",
            [f"{tidied(sum_where(OUT, f'raw_{a}'), 1)} AS raw_{a}" for a in assets],
            f"map_from_entries(filter(array({entries}), e -> e.v.n > 0)) AS bands",
            f"day = DATE '{as_of:%Y-%m-%d}' AS partial",
        )
    )


def band_rows(daily: DataFrame) -> DataFrame:
    """The band map of :func:`daily_facts` as rows."""
    return daily.select("day", F.explode("bands").alias("band", "v")).select("day", "band", "v.n", "v.usd", "v.w")


def entity_days(ledger: DataFrame) -> DataFrame:
    """AGG4: wallets paid, and those paid on two days or more."""
    days = ledger.filter(F.col("direction") == "OUT").select("cp", "day").distinct().groupBy("cp").agg(F.count("*").alias("days"))
    return days.agg(F.count("*").alias("wallets_all"), F.count_if(F.col("days") >= 2).alias("wallets_repeat"))


def with_label(df: DataFrame, labels: DataFrame, column: str = "cp") -> DataFrame:
    """JN5: label by lower-case address; null where none is known."""
    known = labels.select(F.lower("cp").alias("_key"), "label")
    return df.join(known, F.lower(F.col(column)) == F.col("_key"), "left").drop("_key")


def leaderboard(ledger: DataFrame, direction: str, k: int, labels: DataFrame | None = None) -> DataFrame:
    """AGG5, AGG6, SRT2: the ``k`` largest counterparties by USD.

    The board has one row per counterparty and is written once: the top rows and
    the total behind the share both come from it, so the ledger is read once and
    no window runs over all counterparties. Labels are joined to the top rows.
    """
    side = ledger.filter(F.col("direction") == direction)
    per_day = side.groupBy("cp", "day").agg(*exprs(f"sum({rows_in(ledger)}) AS n", "sum(usd) AS usd"))
    board = per_day.groupBy("cp").agg(
        F.sum("n").alias("n"), F.sum("usd").alias("usd"), F.count("*").alias("days"),
        F.min("day").alias("first"), F.max("day").alias("last"),
    )
    board = settle(board, "board")
    total = board.agg(F.sum("usd")).scalar()
    top = board.orderBy(tidy("usd", 2).desc(), "cp").limit(k)
    top = with_label(top, labels) if labels is not None else top.withColumn("label", F.lit(None).cast("string"))
    return top.select(
        "cp", "label", "n", tidy("usd", 2).alias("usd"), "days",
        day_text("first").alias("first"), day_text("last").alias("last"),
        tidy(F.col("usd") / F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0)) * 100, 1).alias("share"),
    )


def hourly_counts(ledger: DataFrame, as_of: datetime, assets: Sequence[str], days: int = 7) -> DataFrame:
    """AGG7: outgoing transfers per hour and asset; hours without any are zero.

    Empty hours come from a sequence added as zero rows, not from a join. The
    first hour holds only the part after the cut.
    """
    cut = as_of - timedelta(days=days)
    recent = ledger.filter(f"{OUT} AND {within(cut)}")
    hour = F.expr("date_trunc('hour', CAST(ts AS TIMESTAMP))").alias("hour")
    counted = recent.groupBy(hour).agg(*exprs([f"count_if(asset = {quoted([a])}) AS {a}" for a in assets]))
    first, last = (f"TIMESTAMP '{t:%Y-%m-%d %H:00:00}'" for t in (cut, as_of))
    blank = ledger.sparkSession.range(1).selectExpr(f"explode(sequence({first}, {last}, INTERVAL 1 HOUR)) AS hour", *(f"0L AS {a}" for a in assets))
    return counted.unionByName(blank).groupBy("hour").agg(*(F.sum(a).alias(a) for a in assets)).select(hour_text("hour").alias("h"), *assets)


def share(df: DataFrame, column: str, alias: str = "share") -> DataFrame:
    """WIN19: percent of the total, for an aggregate of a few rows."""
    total = F.sum(column).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn(alias, tidy(F.col(column) / F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0)) * 100, 1))


def flow_ratios(facts: DataFrame, consumed_usd: Column | float | None = None, span_days: Column | float = 7.0) -> DataFrame:
    """AGG32, AGG33: recycled share and consumption ratio of all history, daily pace of the last week.

    ``span_days`` is how much of that week the ledger covers (:func:`tallyflow.operators.balance.burn`).
    """
    row = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c)))
    used = F.lit(None).cast("double") if consumed_usd is None else (
        F.lit(consumed_usd) if isinstance(consumed_usd, (int, float)) else consumed_usd
    )
    flat = facts.agg(
        row("all history", "in_recycled_usd").alias("rec"),
        row("all history", "in_usd").alias("inn"),
        row("all history", "out_usd").alias("out"),
        row("7d", "out_usd").alias("week"),
    )
    return flat.select(
        F.coalesce(tidy(F.try_divide("rec", "inn") * 100, 0), F.lit(0.0)).alias("recycled_share"),
        tidy(F.try_divide(used, F.col("out")) * 100, 0).alias("consumption_ratio"),
        tidy(F.col("week") / span_days, 2).alias("dist_pace"),
    )


def project_day(daily: DataFrame, as_of: datetime, measures: Sequence[str]) -> DataFrame:
    """WIN18: today's measures scaled to a full day; null on closed days and late in the day."""
    passed = min(max((as_of.hour * 60 + as_of.minute) / 1440, 0.02), 1.0)
    running = (F.col("day") == F.lit(as_of.date())) & F.lit(passed < 0.98)
    return daily.withColumns({f"projected_{m}": F.when(running, F.col(m) / passed) for m in measures})
