"""Who funded what: consumption, funding split, archive, sweeps and audits (AGG11-AGG14, AGG18, AGG19, JN7-JN10)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions import at, exprs, month_text, sum_if, sum_where, tidied, tidy
from tallyflow.operators.facts import IN, OUT
from tallyflow.operators.rates import day_rate


def without_self(ledger: DataFrame, own: str) -> DataFrame:
    """FLT5: drops transfers from the ledger's own wallet."""
    return ledger.filter(F.lower("cp") != own.lower())


def spends(consumed: DataFrame, ledger: DataFrame, as_of: datetime, own: str) -> DataFrame:
    """JN7: consumption by wallets this ledger has paid, one row per wallet and day.

    Consumption is reduced per wallet and day before the semi-join, so a wallet
    that spends most of it brings only its days to the join.
    """
    cut24, cut7 = (F.col("ts") > at(as_of - timedelta(hours=h)) for h in (24, 24 * 7))
    per_day = without_self(consumed, own).groupBy("asset", "cp", "day").agg(
        F.count("*").alias("n"), F.sum("val").alias("val"), F.count_if(cut24).alias("n_24h"),
        F.count_if(cut7).alias("n_7d"), sum_if(cut7, "val").alias("val_7d"),
    )
    paid = ledger.filter(F.col("direction") == "OUT").select("cp").distinct()
    return per_day.join(paid, "cp", "left_semi")


def consumption(
    consumed: DataFrame, ledger: DataFrame, rates: DataFrame, live: float, as_of: datetime, own: str
) -> DataFrame:
    """AGG11: one row of totals; USD at the exact day's rate, else the live one."""
    priced = day_rate(spends(consumed, ledger, as_of, own), rates, live)
    per_wallet = priced.groupBy("cp").agg(
        F.sum("n").alias("n"), F.sum("val").alias("val"), F.sum(F.col("val") * F.col("rate")).alias("usd"),
        F.sum(F.col("val_7d") * F.col("rate")).alias("usd_7d"), F.sum("n_24h").alias("n_24h"),
        F.sum("n_7d").alias("n_7d"), F.min("day").alias("first"),
    )
    return per_wallet.agg(
        F.sum("n").alias("total_n"), tidy(F.sum("val"), 0).alias("total_val"),
        tidy(F.sum("usd"), 2).alias("total_usd"), tidy(F.sum("usd_7d"), 2).alias("usd_7d"),
        F.sum("n_24h").alias("n_24h"), F.count("*").alias("spenders_all"),
        F.count_if(F.col("n_7d") > 0).alias("spenders_7d"), F.min("first").alias("first_day"),
    )


def consumption_daily(consumed: DataFrame, ledger: DataFrame, as_of: datetime, own: str, k: int = 30) -> DataFrame:
    """AGG11, SRT4: the last ``k`` days of consumption."""
    per_day = spends(consumed, ledger, as_of, own).groupBy("day").agg(
        F.sum("n").alias("n"), tidy(F.sum("val"), 1).alias("val"), F.countDistinct("cp").alias("spenders")
    )
    return per_day.orderBy(F.col("day").desc()).limit(k)


def crawl_complete(consumed_totals: DataFrame, reaches: datetime) -> DataFrame:
    """AGG11: whether consumption reaches back to the given day."""
    return consumed_totals.withColumn(
        "crawl_complete", F.coalesce(F.col("first_day") <= F.lit(reaches.date()), F.lit(False))
    )


def funding_split(consumed: DataFrame, ledger: DataFrame, own: str = "", eps: float = 0.01) -> DataFrame:
    """JN8, AGG12, AGG13: how much of the spending credits can explain.

    Credits count as spent first, so the user-funded part is a lower bound.
    Both sides are summed in one aggregate per wallet instead of being joined.
    """
    zero = F.lit(0.0)
    spent = without_self(consumed, own).select("cp", F.col("usd").alias("spend"), zero.alias("credit"), F.lit(1).alias("spent"))
    paid = ledger.filter(F.col("direction") == "OUT").select("cp", zero.alias("spend"), F.col("usd").alias("credit"), F.lit(0).alias("spent"))
    per = spent.unionByName(paid).groupBy("cp").agg(
        F.sum("spend").alias("spend"), F.sum("credit").alias("credit"), F.max("spent").alias("spent")
    ).filter(F.col("spent") == 1)
    per = per.withColumn("user", F.greatest(zero, F.col("spend") - F.col("credit")))
    excess = F.col("user") > eps
    return per.agg(
        tidy(F.sum("spend"), 0).alias("consumed_usd"),
        F.count("*").alias("spenders"),
        tidy(F.sum(F.col("spend") - F.col("user")), 0).alias("backed_usd"),
        tidy(F.sum("user"), 0).alias("user_usd"),
        F.coalesce(tidy(F.try_divide(F.sum("user"), F.sum("spend")) * 100, 1), zero).alias("user_pct"),
        F.count_if(excess).alias("excess_n"),
        F.count_if(excess & (F.col("credit") == 0)).alias("never_credited_n"),
    )


def _priced_archive(archive: DataFrame, prices: DataFrame, default: float) -> DataFrame:
    return day_rate(archive, prices, default).withColumn("usd", F.col("val") * F.col("rate"))


def _sides() -> list[str]:
    return [f"{sum_where(way, col)} AS {side}_{col}" for side, way in (("out", OUT), ("in", IN)) for col in ("val", "usd")]


def archive_rollup(archive: DataFrame, prices: DataFrame, default: float = 0.001) -> DataFrame:
    """JN4, AGG14, SET2: totals of the closed ledger; wallets on both sides from one aggregate."""
    per = _priced_archive(archive, prices, default).groupBy("cp").agg(
        *exprs(
            _sides(),
            f"count_if({OUT}) AS out_n", f"count_if({IN}) AS in_n",
            f"min(day) FILTER (WHERE {IN}) AS first", f"max(day) FILTER (WHERE {IN}) AS last",
        )
    )
    return per.agg(
        *exprs(
            f"{tidied('sum(out_val)', 0)} AS out_val", f"{tidied('sum(in_val)', 0)} AS in_val",
            f"{tidied('sum(out_usd)', 2)} AS out_usd", f"{tidied('sum(in_usd)', 2)} AS in_usd",
            "sum(out_n) AS out_tx", "sum(in_n) AS in_tx",
            "count_if(out_n > 0) AS topped_n", "count_if(in_n > 0) AS spent_n", "count_if(out_n > 0 AND in_n > 0) AS both_n",
            "min(first) AS first_spend", "max(last) AS last_spend",
        )
    )


def archive_split(archive: DataFrame, prices: DataFrame, default: float = 0.001) -> DataFrame:
    """AGG13: :func:`funding_split` of a closed ledger at each day's price, its own credits against its spending."""
    priced = _priced_archive(archive, prices, default)
    return funding_split(priced.filter(F.col("direction") == "IN"), priced).drop("never_credited_n")


def archive_monthly(archive: DataFrame, prices: DataFrame, default: float = 0.001) -> DataFrame:
    """JN9, AGG14: in and out per month; a missing side is zero."""
    months = _priced_archive(archive, prices, default).groupBy(F.trunc("day", "month").alias("first")).agg(*exprs(_sides()))
    return months.select(
        month_text("first").alias("month"), *(tidy(c, d).alias(c) for c, d in (("out_val", 0), ("in_val", 0), ("out_usd", 2), ("in_usd", 2)))
    )


def sweep_series(sweep: DataFrame, recycle: DataFrame, intake: DataFrame) -> DataFrame:
    """JN9, SET1: intake and both outgoing legs per day, as ``(day, i, r, s)`` and row counts.

    Each input needs ``day`` and ``val``. One aggregate over tagged rows stands
    in for two full outer joins.
    """
    tagged = [df.select("day", "val", F.lit(t).alias("leg")) for df, t in ((intake, "i"), (recycle, "r"), (sweep, "s"))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    legs = [text for t in "irs" for text in (f"{sum_where(f"leg = '{t}'", 'val')} AS {t}", f"count_if(leg = '{t}') AS n_{t}")]
    return rows.groupBy("day").agg(*exprs(legs))


def lagged_share(series: DataFrame, days: int = 1) -> DataFrame:
    """JN10: each sweep over the intake of exactly ``days`` days earlier; days without intake drop out.

    Every day hands its intake on to the later day, so the two meet in one
    aggregate and the series is not computed twice for a self-join.
    """
    none = F.lit(None).cast("double")
    own = F.struct("day", F.when(F.col("n_s") > 0, F.col("s")).alias("s"), none.alias("base"))
    later = F.struct(F.date_add("day", days).alias("day"), none.alias("s"), F.nullif("i", F.lit(0.0)).alias("base"))
    met = series.select(F.inline(F.array(own, later))).groupBy("day").agg(F.max("s").alias("s"), F.max("base").alias("base"))
    return met.filter(F.col("s").isNotNull() & F.col("base").isNotNull()).withColumn("share", F.col("s") / F.col("base"))


def _bounded(series: DataFrame) -> DataFrame:
    """Adds the first and last day of each outgoing leg; one row per day goes in."""
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edge = lambda fn, leg: fn(F.when(F.col(f"n_{leg}") > 0, F.col("day"))).over(whole)
    return series.select(
        "*", edge(F.min, "s").alias("s0"), edge(F.max, "s").alias("s1"), edge(F.min, "r").alias("r0"), edge(F.max, "r").alias("r1")
    )


def since_recycling(series: DataFrame) -> DataFrame:
    """AGG18: the series from the first day of the recycling leg on; empty without one."""
    return _bounded(series).filter(F.col("day") >= F.col("r0")).drop("s0", "s1", "r0", "r1")


def daily_phase(series: DataFrame) -> DataFrame:
    """AGG18: ``phase_first, phase_last, phase_days`` of the longest run of consecutive days with recycling, the earliest of equal ones.

    A day minus its number among such days is the same all along a run.
    """
    days = series.filter("n_r > 0").select("day", F.row_number().over(W.orderBy("day")).alias("nth"))
    runs = days.groupBy(F.expr("date_sub(day, nth)").alias("run")).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n"))
    best = F.max(F.struct("n", F.datediff(F.lit("1970-01-01").cast("date"), F.col("first")).alias("early"), "first", "last"))
    return runs.agg(best.alias("best")).select(
        F.col("best.first").alias("phase_first"), F.col("best.last").alias("phase_last"), F.coalesce("best.n", F.lit(0)).cast("long").alias("phase_days")
    )


def sweep_summary(series: DataFrame, outflow: DataFrame, collector_balance: Column) -> DataFrame:
    """AGG18: totals, spans, cumulative and median previous-day shares, mean intake before and after.

    ``outflow`` holds what the sweep's destination sent on (``val``). The mean intake before is taken
    from the start of the recycling leg's daily phase to its last day.
    """
    d = F.col("day")
    old = (d >= F.col("r0")) & (d <= F.col("r1"))
    new = d >= F.col("s0")
    has_i = F.col("n_i") > 0
    phase = daily_phase(series)
    from_phase = (d >= phase.select("phase_first").scalar()) & (d <= F.col("r1"))
    pct = lambda a, b: tidy(F.try_divide(a, b) * 100, 1)
    flat = _bounded(series).agg(
        F.count_if(F.col("n_s") > 0).alias("days"),
        F.max("s0").alias("first"), F.max("s1").alias("last"), F.max("r0").alias("recycle_first"), F.max("r1").alias("recycle_last"),
        tidy(F.sum("s"), 2).alias("total"),
        pct(F.sum("s"), sum_if(new, "i")).alias("share_cum"),
        F.count_if(F.col("n_r") > 0).alias("recycle_n"),
        tidy(F.sum("r"), 2).alias("recycle_total"),
        pct(F.sum("r"), sum_if(old, "i")).alias("recycle_share_cum"),
        (F.datediff(F.max("r1"), F.max("r0")) + 1).cast("long").alias("recycle_span_days"),
        tidy(F.avg(F.when(from_phase & has_i, F.col("i"))), 0).alias("intake_pre"),
        tidy(F.avg(F.when(new & has_i, F.col("i"))), 0).alias("intake_post"),
    )
    median = lagged_share(series).agg(tidy(F.median("share") * 100, 1)).scalar()
    sent = outflow.agg(F.count("*").alias("n"), tidy(F.coalesce(F.sum("val"), F.lit(0.0)), 2).alias("val"))
    scalars = {
        "share_median": median, "phase_first": phase.select("phase_first").scalar(), "phase_days": phase.select("phase_days").scalar(),
        "out_n": sent.select("n").scalar(), "out_total": sent.select("val").scalar(), "collector_bal": tidy(collector_balance, 2),
    }
    return flat.withColumns(scalars)


def contract_audit(series: DataFrame, pct: float = 0.40, rate: float = 1.0) -> DataFrame:
    """AGG19: delivered against owed share of intake since the first sweep, in total."""
    flat = _bounded(series).agg(
        sum_if(F.col("day") >= F.col("s0"), "i").alias("base"), F.sum("s").alias("got"),
        sum_if((F.col("day") >= F.col("r0")) & (F.col("day") <= F.col("r1")), "i").alias("base_old"), F.sum("r").alias("got_old"),
    )
    owed = F.col("base") * pct
    share = lambda a, b: tidy(F.try_divide(F.col(a), F.nullif(b, F.lit(0.0))) * 100, 1)
    return flat.select(
        share("got_old", "base_old").alias("old_pct"), share("got", "base").alias("new_pct"),
        tidy(owed, 0).alias("expected"), tidy("got", 0).alias("actual"),
        tidy(F.col("got") - owed, 0).alias("variance"), tidy((F.col("got") - owed) * rate, 0).alias("variance_usd"),
    )


def contract_months(series: DataFrame, pct: float = 0.40) -> DataFrame:
    """AGG19: delivered percent and shortfall per month; months without intake drop out."""
    since = _bounded(series).filter(F.col("day") >= F.col("s0"))
    per = since.groupBy(month_text("day").alias("month")).agg(F.sum("s").alias("got"), F.sum("i").alias("base"))
    return per.filter(F.col("base") != 0).select(
        "month", tidy(F.col("got") / F.col("base") * 100, 1).alias("pct"),
        tidy(F.col("base") * pct - F.col("got"), 0).alias("short"),
    )
