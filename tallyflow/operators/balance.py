"""Balances: pinned reconciliation, backward series, trend, burn and runway (AGG15, AGG20-AGG22, AGG37, WIN8-WIN12)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions import Scheme, exprs, is_unbacked, moment, quoted, sum_where, tidy, within
from tallyflow.operators.facts import IN, OUT


def pin_block(ledger: DataFrame) -> DataFrame:
    """SRC15: the newest block that both directions are known to reach; zero blocks do not count."""
    newest = ledger.filter(F.col("blk") > 0).groupBy("direction").agg(F.max("blk").alias("blk"))
    return newest.agg(F.coalesce(F.min("blk"), F.lit(0)).alias("pin"))


def pinned(ledger: DataFrame) -> DataFrame:
    """FLT3: rows up to the pinned block."""
    return ledger.filter(F.col("blk") <= pin_block(ledger).scalar())


def balance_at(balances: DataFrame, pin: Column) -> DataFrame:
    """SRC15: balances recorded at the pinned block; the live one, marked degraded, where none is."""
    exact = F.when(F.col("block") == pin, F.col("balance"))
    live = F.max_by("balance", "block")
    return balances.groupBy("asset").agg(
        F.coalesce(F.max(exact), live).alias("balance"), F.max(exact).isNull().alias("degraded")
    )


def signed(col: str = "val") -> Column:
    return F.when(F.col("direction") == "IN", F.col(col)).otherwise(-F.col(col))


def reconcile(
    ledger: DataFrame, balances: DataFrame, prev: DataFrame, complete: bool = True, hi: float = 30, lo: float = -150
) -> DataFrame:
    """AGG15, JN14: balance minus ledger net per asset, and how far that moved since last time.

    ``balances`` is ``(asset, balance, degraded)``, ``prev`` is ``(asset, delta)``.
    """
    return reconcile_net(pinned(ledger).groupBy("asset").agg(F.sum(signed()).alias("net")), balances, prev, complete, hi, lo)


def reconcile_net(
    net: DataFrame, balances: DataFrame, prev: DataFrame, complete: bool = True, hi: float = 30, lo: float = -150
) -> DataFrame:
    """:func:`reconcile` from the pinned ``(asset, net)``; assets without one have moved nothing."""
    every = balances.select("asset").join(net, "asset", "left").select("asset", F.coalesce("net", F.lit(0.0)).alias("net"))
    return judge_net(every, balances, prev, complete, hi, lo)


def judge_net(
    net: DataFrame, balances: DataFrame, prev: DataFrame, complete: bool = True, hi: float = 30, lo: float = -150
) -> DataFrame:
    """The rules of :func:`reconcile` for the assets in ``(asset, net)``, however that was summed."""
    stored = prev.select("asset", F.col("delta").alias("prev"))
    clean = F.lit(complete) & ~F.col("degraded")
    delta = tidy(F.col("balance") - F.col("net"), 1)
    return (
        balances.join(net, "asset").join(stored, "asset", "left")
        .withColumn("delta", delta)
        .withColumn("drift", F.when(clean, tidy(F.col("delta") - F.col("prev"), 1)))
        .select(
            "asset",
            tidy("net", 1).alias("net_cached"),
            tidy("balance", 1).alias("balance"),
            "delta", "drift", "degraded",
            F.coalesce((F.col("drift") > hi) | (F.col("drift") < lo), F.lit(False)).alias("warn"),
        )
    )


def stored_deltas(recon: DataFrame, prev: DataFrame, complete: bool = True) -> DataFrame:
    """JN14: the ``(asset, delta)`` the next run compares with: this run's where it was clean, else what was stored."""
    fresh = recon.filter(F.lit(complete) & ~F.col("degraded")).select("asset", "delta")
    return fresh.unionByName(prev.select("asset", "delta").join(fresh, "asset", "left_anti"))


def day_moves(ledger: DataFrame, assets: Sequence[str], recycle_src: str | None = None) -> DataFrame:
    """Out, recycled-in and external-in per day for every listed asset, zero where nothing moved.

    Assets are columns of one aggregate and become rows afterwards, so every
    asset has every day of the ledger without crossing the two sets.
    """
    src = quoted([(recycle_src or "").lower()])

    def measures(asset: str) -> str:
        mine = f"asset = {quoted([asset])}"
        parts = {"out": f"{mine} AND {OUT}", "in_rec": f"{mine} AND {IN} AND cp = {src}", "in_ext": f"{mine} AND {IN} AND cp <> {src}"}
        sums = ", ".join(f"{sum_where(cond, 'val')} AS {name}" for name, cond in parts.items())
        return f"struct({quoted([asset])} AS asset, {sums})"

    wide = ledger.groupBy("day").agg(*exprs([f"{measures(a)} AS a{i}" for i, a in enumerate(assets)]))
    return wide.selectExpr("day", f"inline(array({', '.join(f'a{i}' for i in range(len(assets)))}))")


def balance_series(
    ledger: DataFrame,
    balances: DataFrame,
    assets: Sequence[str],
    min_day: date | None = None,
    recycle_src: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """WIN8, WIN9: end-of-day balances, walked back from the pinned balance.

    A day's balance is the pinned one minus what moved on later days. The window
    orders one row per day within an asset.
    """
    moves = day_moves(pinned(ledger), assets, recycle_src)
    if min_day is not None:
        moves = moves.filter(F.col("day") >= F.lit(min_day))
    net = F.col("in_rec") + F.col("in_ext") - F.col("out")
    later = W.partitionBy("asset").orderBy("day").rowsBetween(1, W.unboundedFollowing)
    after = F.coalesce(F.sum(net).over(later), F.lit(0.0))
    today = None if as_of is None else as_of.date()
    return moves.join(balances.select("asset", "balance"), "asset").select(
        "asset", "day",
        tidy(F.col("balance") - after, 1).alias("qty"),
        tidy("out", 1).alias("out"),
        tidy("in_rec", 1).alias("in_rec"),
        tidy("in_ext", 1).alias("in_ext"),
        tidy(net, 1).alias("delta"),
        (F.lit(False) if today is None else F.col("day") == F.lit(today)).alias("partial"),
    )


def value_series(series: DataFrame, valued) -> DataFrame:
    """WIN9: the series in USD; ``valued`` adds ``rate`` and ``rate_src`` from ``(asset, day, val)``."""
    priced = valued(series.withColumn("val", F.col("qty")))
    return priced.withColumn("usd", tidy("usd", 0)).drop("val", "rate")


def live_row(balances: DataFrame, live: DataFrame, as_of: datetime) -> DataFrame:
    """WIN9: today's running balance at the live rate, marked partial."""
    return balances.join(live.select("asset", "rate"), "asset").select(
        "asset", F.lit(as_of.date()).alias("day"), tidy("balance", 1).alias("qty"),
        tidy(F.col("balance") * F.col("rate"), 0).alias("usd"), F.lit(True).alias("partial"),
    )


def trend_state(series: DataFrame, balances: DataFrame | None = None, flat_eps: float = 1, min_days: int = 8) -> DataFrame:
    """WIN10, WIN11: trailing flat run, weekly change and state per asset over closed days."""
    closed = series.filter(~F.col("partial"))
    newest = W.partitionBy("asset").orderBy(F.col("day").desc())
    every = W.partitionBy("asset")
    ranked = closed.withColumn("rn", F.row_number().over(newest)).withColumn("days", F.count("*").over(every))
    first_move = F.min(F.when(F.abs("delta") >= flat_eps, F.col("rn"))).over(every)
    ranked = ranked.withColumn("flat", F.coalesce(first_move - 1, F.col("days")))
    qty_at = lambda k: F.max(F.when(F.col("rn") == F.col("flat") + k, F.col("qty")))
    per = ranked.groupBy("asset").agg(
        F.max("days").alias("days"),
        F.max("flat").alias("flat_run"),
        tidy((qty_at(1) - qty_at(min_days)) / float(min_days - 1), 1).alias("slope"),
        F.max(F.when(F.col("rn") == 1, F.col("qty"))).alias("closed_qty"),
    )
    if balances is not None:
        per = per.join(balances.select("asset", F.col("balance").alias("live_qty")), "asset", "left")
    else:
        per = per.withColumn("live_qty", F.lit(None).cast("double"))
    enough = F.col("days") >= min_days
    moving = enough & (F.col("flat_run") < 3) & (F.col("days") - F.col("flat_run") >= min_days)
    change = F.when(moving, F.col("slope"))
    now = F.coalesce(F.nullif("live_qty", F.lit(0.0)), "closed_qty")
    return per.select(
        "asset", "days",
        F.when(enough, F.col("flat_run")).otherwise(0).alias("flat_days"),
        change.alias("change"),
        F.when(~enough, F.lit(None))
        .when(F.col("flat_run") >= 3, "frozen")
        .when(moving, F.when(F.col("slope") < 0, "declining").otherwise("growing"))
        .when(F.col("flat_run") > 0, "frozen")
        .otherwise("declining").alias("status"),
        F.when(change < 0, F.try_divide(now, -change).cast("long")).alias("days_to_zero"),
    )


def last_moves(ledger: DataFrame, recycle_src: str | None = None) -> DataFrame:
    """WIN12: per asset, the last day with any inflow, recycled inflow, and outflow."""
    inward = F.col("direction") == "IN"
    return ledger.groupBy("asset").agg(
        F.max(F.when(inward, F.col("day"))).alias("last_in"),
        F.max(F.when(inward & (F.col("cp") == F.lit((recycle_src or "").lower())), F.col("day"))).alias("last_recycle"),
        F.max(F.when(~inward, F.col("day"))).alias("last_out"),
        F.min(F.when(~inward, F.col("day"))).alias("first_out"),
    )


def burn(ledger: DataFrame, as_of: datetime, scheme: Scheme) -> DataFrame:
    """AGG20, AGG21: unbacked burn and outflow; daily averages over at most 7, at least 1 day.

    Only the last week is read. Whether anything older exists takes one row.
    """
    ago = lambda **kw: as_of - timedelta(**kw)
    week, unbacked = within(ago(days=7)), is_unbacked(scheme)
    day, before = within(ago(hours=24)), within(ago(hours=48), ago(hours=24))
    older = ledger.filter(f"{OUT} AND {within(hi=ago(days=7))}").limit(1).selectExpr("7D AS span").scalar()
    sums = ledger.filter(f"{OUT} AND {week}").agg(
        *exprs(
            f"(unix_seconds(CAST({moment(as_of)} AS TIMESTAMP)) - unix_seconds(CAST(min(ts) AS TIMESTAMP))) / 86400 AS age",
            f"{sum_where(f'{unbacked} AND {day}', 'usd')} AS burn24",
            f"{sum_where(f'{unbacked} AND {before}', 'usd')} AS burn_prev",
            f"{sum_where(unbacked, 'usd')} AS burn7",
            f"{sum_where('true', 'usd')} AS out7",
        )
    )
    spanned = sums.withColumn("span_days", F.coalesce(older, F.expr("CASE WHEN age IS NULL THEN 7D ELSE greatest(age, 1D) END")))
    return spanned.selectExpr("burn24", "burn_prev", "span_days", "burn7 / span_days AS burn7avg", "out7 / span_days AS out7avg")


def value_balances(balances: DataFrame, live: DataFrame) -> DataFrame:
    """AGG37: balance and its value at the live rate, per asset."""
    return balances.join(live.select("asset", "rate"), "asset", "left").select(
        "asset", tidy("balance", 0).alias("balance"), (F.col("balance") * F.col("rate")).alias("usd")
    )


def ledger_range(ledger: DataFrame) -> DataFrame:
    """AGG37: first day and last time of the outgoing ledger."""
    return ledger.filter(F.col("direction") == "OUT").agg(F.min("day").alias("first_day"), F.max("ts").alias("last_ts"))


def runway(burned: DataFrame, balance_usd: Column) -> DataFrame:
    """AGG22: days the balance lasts at each pace; null where nothing burns."""
    last = lambda pace: F.when(F.col(pace) > 0, tidy(balance_usd / F.col(pace), 1))
    return burned.select(
        tidy(balance_usd, 0).alias("bal_usd"),
        tidy("burn24", 2).alias("burn24"), tidy("burn_prev", 2).alias("burn_prev"),
        tidy("burn7avg", 2).alias("burn7avg"), tidy("span_days", 4).alias("span_days"),
        last("burn24").alias("runway24"), last("burn7avg").alias("runway7"), last("out7avg").alias("runway_total"),
    )
