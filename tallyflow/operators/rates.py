"""Rates: as-of valuation and market checks (JN2-JN4, JN6, AGG16, FLT6, WIN16, WIN17)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions import at, tidy
from tallyflow.session import settle


def rates_on(days: DataFrame, rates: DataFrame, open_rate: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """The known rate nearest to each ``(asset, day)`` of ``days``: the latest up to it, else the earliest after it.

    One row per asset and day that ``days`` or the rates hold, whatever lies
    between them. Columns: asset, day, rate, rate_day, open_rate, live_rate.
    """
    none = F.lit(None).cast("double")
    marks = rates.select("asset", "day", "rate", none.alias("open_rate"))
    if open_rate is not None:
        marks = marks.unionByName(open_rate.select("asset", "day", none.alias("rate"), F.col("rate").alias("open_rate")))
    wanted = days.select("asset", "day").distinct().select("asset", "day", none.alias("rate"), none.alias("open_rate"))
    dense = wanted.unionByName(marks).groupBy("asset", "day").agg(F.max("rate").alias("rate"), F.max("open_rate").alias("open_rate"))
    by_day = W.partitionBy("asset").orderBy("day")
    known = F.when(F.col("rate").isNotNull(), F.struct("rate", F.col("day").alias("rate_day")))
    back = F.last(known, ignorenulls=True).over(by_day.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(by_day.rowsBetween(0, W.unboundedFollowing))
    filled = dense.withColumn("near", F.coalesce(back, ahead)).select(
        "asset", "day", F.col("near.rate").alias("rate"), F.col("near.rate_day").alias("rate_day"), "open_rate"
    )
    if live is None:
        return filled.withColumn("live_rate", none)
    return filled.join(live.select("asset", F.col("rate").alias("live_rate")), "asset", "left")


def asof_rate(
    ledger: DataFrame, rates: DataFrame, open_rate: DataFrame | None = None, live: DataFrame | None = None
) -> DataFrame:
    """JN2: each row's rate and where it came from, plus ``usd``.

    Exact day, else the open day's own rate, else the latest earlier day, else
    the earliest later day, else the live rate. The ledger's distinct days are
    combined before their shuffle and get their rates first, so the two-sided
    as-of search becomes one equality join. Their table is written before it:
    Catalyst then knows its size and leaves the ledger unshuffled when it is small enough.
    """
    placed = ledger.drop("rate", "rate_src", "usd")
    found = settle(rates_on(placed, rates, open_rate, live), "day_rates")
    exact = F.col("rate_day") == F.col("day")
    is_open = F.col("open_rate").isNotNull()
    source = (
        F.when(exact, "day-implied")
        .when(is_open, "day-implied (open)")
        .when(F.col("rate_day") < F.col("day"), "carry-forward")
        .when(F.col("rate_day") > F.col("day"), "carry-back")
        .otherwise("live")
    )
    chosen = F.when(exact, F.col("rate")).when(is_open, F.col("open_rate")).otherwise(F.coalesce("rate", "live_rate"))
    return (
        placed.join(found, ["asset", "day"], "left").withColumn("rate_src", source)
        .withColumn("rate", chosen)
        .withColumn("usd", F.col("val") * F.col("rate"))
        .drop("rate_day", "open_rate", "live_rate")
    )


def day_rate(df: DataFrame, rates: DataFrame, default: Column | float) -> DataFrame:
    """JN3, JN4: the rate of exactly that day, or ``default``; a zero rate counts as missing."""
    found = rates.select("asset", "day", F.col("rate").alias("_rate"))
    fallback = F.lit(default) if isinstance(default, (int, float)) else default
    return df.join(found, ["asset", "day"], "left").withColumn(
        "rate", F.coalesce(F.nullif("_rate", F.lit(0.0)), fallback)
    ).drop("_rate")


def market_deviation(rates: DataFrame, market: DataFrame, pct: float = 15) -> DataFrame:
    """JN6, AGG16: how far implied rates sit from market closes, per asset.

    The median is the upper one: the element at position n/2 in ascending order.
    """
    both = rates.select("asset", "day", "rate").join(market.select("asset", "day", "close"), ["asset", "day"])
    dev = F.abs(F.col("rate") - F.col("close")) / F.col("close") * 100
    return (
        both.filter(F.col("close") != 0)
        .select("asset", dev.alias("dev"))
        .groupBy("asset")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("dev") <= pct).alias("within"),
            tidy(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY dev DESC)"), 1).alias("median_dev"),
            tidy(F.max("dev"), 1).alias("max_dev"),
        )
    )


def daily_close(ohlcv: DataFrame, before: datetime | None = None) -> DataFrame:
    """WIN17: each day's close from the pool with most volume, the earlier pool on a tie.

    ``max`` of a struct combines before the shuffle, where a ranking window
    would move every candle. Days not yet over are left out.
    """
    if before is not None:
        ohlcv = ohlcv.filter(F.col("day") < F.lit(before.date()))
    best = F.max(F.struct("volume", (-F.col("pool_rank")).alias("rank"), "close")).alias("best")
    return (
        ohlcv.groupBy("asset", "day").agg(best)
        .filter(F.col("best.close") != 0)
        .select("asset", "day", F.round("best.close", 8).alias("close"))
    )


def sane_quotes(quotes: DataFrame, anchors: DataFrame, factor: float = 5) -> DataFrame:
    """FLT6: pairs that price our own token within ``factor`` of its anchor.

    ``anchors`` is ``(asset, base, anchor)``.
    """
    known = anchors.select("asset", F.lower("base").alias("base"), "anchor")
    price, anchor = F.col("price"), F.col("anchor")
    return quotes.join(known, ["asset", "base"]).filter((price > anchor / factor) & (price < anchor * factor))


def best_pair(quotes: DataFrame, by: Sequence[str] = ("asset", "ts")) -> DataFrame:
    """WIN16: the most liquid pair per asset and time, the earlier listed on a tie.

    ``by`` with ``list_id`` chooses within each list, for lists that may share asset and time.
    """
    best = F.max(F.struct("liquidity", (-F.col("pair_rank")).alias("rank"), "price")).alias("best")
    return quotes.groupBy(*by).agg(best).select(
        *by, F.col("best.price").alias("price"), F.col("best.liquidity").alias("liquidity")
    )
