"""The older single-asset view and its figures (AGG34, AGG35, SET5)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import EARNING, Scheme, at, bucket_of, exprs, folded_class, hour_text, quoted, sum_if, sum_where, tidied, tidy, within
from tallyflow.operators.facts import IN, OUT

FOLDED = ("invoke", "equip", "growth", "micro")


def single_asset(ledger: DataFrame, asset: str, scheme: Scheme) -> DataFrame:
    """Rows of one asset with the folded class ``lcat`` and the bucket."""
    return (
        ledger.filter(F.col("asset") == asset)
        .selectExpr("*", f"{folded_class(scheme=scheme)} AS lcat", f"{bucket_of(scheme=scheme)} AS bucket")
    )


def _out(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("direction") == "OUT")


def asset_totals(rows: DataFrame, as_of: datetime) -> DataFrame:
    """AGG34: count, amount and last-24-hours count per folded class."""
    return _out(rows).groupBy("lcat").agg(
        F.count("*").alias("n"), tidy(F.sum("val"), 1).alias("val"),
        F.count_if(F.col("ts") > at(as_of - timedelta(hours=24))).alias("n_24h"),
    )


def asset_hourly(rows: DataFrame, as_of: datetime) -> DataFrame:
    """AGG34: every hour since the first transfer, counts per folded class and the amount."""
    out = _out(rows)
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    counted = out.groupBy(hour.alias("hour")).agg(
        *(F.count_if(F.col("lcat") == c).alias(c) for c in FOLDED), F.sum("val").alias("val")
    )
    until = F.to_timestamp(F.lit(as_of.strftime("%Y-%m-%d %H:00:00")))
    start = out.agg(F.date_trunc("hour", F.min("ts").cast("timestamp")).alias("h0"))
    hours = start.select(F.explode(F.sequence(F.col("h0"), until, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    blank = hours.select("hour", *(F.lit(0).cast("long").alias(c) for c in FOLDED), F.lit(0.0).alias("val"))
    return counted.unionByName(blank).groupBy("hour").agg(
        *(F.sum(c).alias(c) for c in FOLDED), tidy(F.sum("val"), 1).alias("val")
    ).select(hour_text("hour").alias("h"), *FOLDED, "val")


def asset_daily(rows: DataFrame, as_of: datetime) -> DataFrame:
    """AGG34, SET5: counts per folded class and day; today is there even when empty."""
    earning = F.col("lcat").isin(*EARNING)
    out = _out(rows)
    counted = out.groupBy("day").agg(
        *(F.count_if(F.col("lcat") == c).alias(c) for c in FOLDED),
        sum_if(earning, "val").alias("earned"), sum_if(~earning, "val").alias("other"),
    )
    today = rows.sparkSession.range(1).select(
        F.lit(as_of.date()).alias("day"), *(F.lit(0).cast("long").alias(c) for c in FOLDED), F.lit(0.0).alias("earned"), F.lit(0.0).alias("other")
    )
    return counted.unionByName(today).groupBy("day").agg(
        *(F.sum(c).alias(c) for c in FOLDED), tidy(F.sum("earned"), 1).alias("earned"), tidy(F.sum("other"), 1).alias("other")
    )


def asset_earners(rows: DataFrame) -> DataFrame:
    """AGG34: recipients of the earning classes in the asset's own amount."""
    earned = _out(rows).filter(F.col("lcat").isin(*EARNING))
    return earned.groupBy("cp").agg(
        *(F.count_if(F.col("lcat") == c).alias(c) for c in EARNING), tidy(F.sum("val"), 1).alias("val")
    )


def asset_treasury(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """AGG34: out, in and net per day with USD and distinct wallets per bucket.

    One row per day and wallet first, so wallets per bucket are counts.
    """
    names = list(enumerate([*dict.fromkeys(scheme.buckets.values()), "other"]))
    hit = lambda b: f"{OUT} AND bucket = {quoted([b])}"
    per = rows.groupBy("day", "cp").agg(
        *exprs(
            f"{sum_where(OUT, 'val')} AS out", f"{sum_where(OUT, 'usd')} AS out_usd", f"{sum_where(IN, 'val')} AS inn",
            [text for i, b in names for text in (f"{sum_where(hit(b), 'usd')} AS u{i}", f"count_if({hit(b)}) AS n{i}")],
        )
    )
    entries = ", ".join(
        f"struct({quoted([b])} AS bucket, struct({tidied(f'sum(u{i})', 2)} AS usd, count_if(n{i} > 0) AS w) AS v)" for i, b in names
    )
    return per.groupBy("day").agg(
        *exprs(
            f"{tidied('sum(out)', 1)} AS out", f"{tidied('sum(out_usd)', 2)} AS out_usd",
            f"{tidied('sum(inn)', 1)} AS inn", f"{tidied('sum(inn) - sum(out)', 1)} AS net",
            f"map_from_entries(filter(array({entries}), e -> e.v.w > 0)) AS buckets",
        )
    )


def asset_guard(
    rows: DataFrame, as_of: datetime, rate: float, scheme: Scheme, balance: Column, at_risk_usd: Column | None = None
) -> DataFrame:
    """AGG35: organic share, promised against settled value, runway, refill need and flows of a day.

    ``balance`` is the asset's live balance. The burn average takes the last
    seven days that had any movement before today.
    """
    ago = lambda **kw: as_of - timedelta(**kw)
    day, before = within(ago(hours=24)), within(ago(hours=48), ago(hours=24))
    earning = f"lcat IN ({quoted(EARNING)})"
    unbacked = f"{OUT} AND ({earning} OR fine IN ({quoted(scheme.incentives)}))"
    listed = " ".join(f"WHEN {quoted([fine])} THEN {float(price)}D" for fine, price in scheme.price_of.items())
    measures = {
        "burn24": f"{sum_where(f'{unbacked} AND {day}', 'val')} * {rate}D",
        "burn_prev": f"{sum_where(f'{unbacked} AND {before}', 'val')} * {rate}D",
        "out24": sum_where(f"{OUT} AND {day}", "val"),
        "in24": sum_where(f"{IN} AND {day}", "val"),
        "topup24": sum_where(f"{IN} AND {day} AND val >= 100", "val"),
        "promised": sum_where(OUT, f"CASE fine {listed} ELSE val * {rate}D END"),
        "settled": f"{sum_where(OUT, 'val')} * {rate}D",
        "earned": sum_where(f"{OUT} AND {earning}", "val"),
    }
    flat = rows.agg(*exprs([f"{text} AS {name}" for name, text in measures.items()]))
    per_day = rows.filter(F.col("day") < F.lit(as_of.date())).groupBy("day").agg(sum_if(OUT, "usd").alias("usd"))
    burn7 = per_day.orderBy(F.col("day").desc()).limit(7).agg(tidy(F.coalesce(F.avg("usd"), F.lit(0.0)), 2)).scalar()
    c = F.col
    growth = F.when(c("burn_prev") > 0, F.least(c("burn24") / c("burn_prev"), F.lit(2.0))).otherwise(1.0)
    funded = (balance > 0) & (c("burn24") > 0)
    risk = (F.lit(0.0) if at_risk_usd is None else F.coalesce(at_risk_usd, F.lit(0.0))) / rate
    base = F.coalesce(F.nullif(c("earned"), F.lit(0.0)), F.lit(1.0))
    return flat.select(
        tidy((base - risk) / base * 100, 1).alias("organic_share"),
        tidy(risk * rate, 2).alias("at_risk_usd"),
        tidy(c("in24") - c("out24"), 0).alias("bal_delta24"),
        tidy("topup24", 0).alias("topup24"),
        F.when(funded, tidy(F.greatest(F.lit(0.0), 7 * c("burn24") - balance * rate) / rate, 0)).alias("topup_needed"),
        F.when(funded, tidy(balance * rate / c("burn24"), 1)).alias("runway_days"),
        F.when(funded, tidy(balance * rate / (c("burn24") * growth), 1)).alias("runway_adj"),
        tidy("burn24", 2).alias("burn24"), tidy("burn_prev", 2).alias("burn_prev"),
        tidy("promised", 2).alias("promised_usd"),
        F.when(c("promised") != 0, tidy((c("settled") - c("promised")) / c("promised") * 100, 1)).otherwise(0.0).alias("fx_drift_pct"),
        burn7.alias("burn7_usd"),
    )
