"""As-of statistics and the alert rules on them (AGG30, WIN13-WIN15)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions import exprs, quoted, range_band, sum_where, tidied, within
from tallyflow.operators.facts import OUT

# Edges of the quick classifier and the look-back hours.
EDGES = (0.06, 0.4, 2, 7)
NAMES = ("micro", "invoke", "equip", "incentive", "topup")
LOOKBACK = {"now": 0, "1h": 1, "24h": 24, "7d": 24 * 7}


@dataclass(frozen=True)
class AlertRules:
    """Thresholds of the alerts. Defaults are fixed values."""

    low: float = 7
    steps: tuple[float, ...] = (1, 0.5)
    acceleration: float = 2
    repeat_hours: int = 6
    missing: float = 99


def asof_stats(
    ledger: DataFrame,
    as_of: datetime,
    rate: float,
    lookback: Mapping[str, int] = LOOKBACK,
    edges: Sequence[float] = EDGES,
    names: Sequence[str] = NAMES,
) -> DataFrame:
    """AGG30: cumulative figures at several cutoffs, one row each.

    One aggregate per recipient holds every cutoff, so the ledger is read and
    shuffled once and distinct earners are counts.
    """
    micro, first, second, incentive, topup = names
    rows = ledger.filter(f"{OUT} AND {within(hi=as_of)}").selectExpr("*", f"{range_band(f'val * {rate}D', edges, names)} AS kind")

    def block(label: str, hours: int) -> str:
        upto = within(hi=as_of - timedelta(hours=hours))
        is_kind = lambda *kinds: f"{upto} AND kind IN ({quoted(kinds)})"
        parts = [f"count_if({is_kind(k)}) AS {k}" for k in (first, second, incentive)]
        parts += [f"count_if({is_kind(first, second)}) AS earned"]
        sums = {"earned_val": (first, second), "incentive_val": (incentive, micro), "topup_val": (topup,)}
        parts += [f"{sum_where(is_kind(*kinds), 'val')} AS {name}" for name, kinds in sums.items()]
        return f"struct({quoted([label])} AS label, {', '.join(parts)})"

    wide = rows.groupBy("cp").agg(*exprs([f"{block(*item)} AS c{i}" for i, item in enumerate(lookback.items())]))
    long = wide.selectExpr(f"inline(array({', '.join(f'c{i}' for i in range(len(lookback)))}))")
    return long.groupBy("label").agg(
        *exprs(
            [f"sum({k}) AS {k}" for k in (first, second, incentive)],
            "count_if(earned > 0) AS earners",
            [f"{tidied(f'sum({c})', 2)} AS {c}" for c in ("earned_val", "incentive_val", "topup_val")],
        )
    )


def stat_deltas(stats: DataFrame, measures: Sequence[str], now: str = "now") -> DataFrame:
    """AGG30: how far each measure moved between a cutoff and now."""
    current = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    value = lambda m: F.max(F.when(F.col("label") == now, F.col(m))).over(current)
    return stats.select("label", *((value(m) - F.col(m)).alias(f"{m}_delta") for m in measures)).filter(F.col("label") != now)


def runway_alerts(history: DataFrame, rules: AlertRules = AlertRules(), every: bool = False) -> DataFrame:
    """WIN13: low-runway snapshots and whether each newly crossed a threshold.

    ``history`` has one row per run: ``ts, runway24, runway7, runway_adj``.
    ``every`` reports all low snapshots, as a daily or weekly mode does.
    """
    order = W.orderBy("ts")
    days = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(rules.missing))
    prev = F.lag(F.coalesce("runway7", "runway_adj")).over(order)
    low = history.select(
        "ts", F.least(days("runway7"), days("runway24")).alias("runway"), prev.alias("prev")
    ).filter(F.col("runway") < rules.low)
    crossed = F.col("prev").isNull() | (F.col("prev") >= rules.low)
    for step in rules.steps:
        crossed = crossed | ((F.col("runway") < step) & (F.col("prev") >= step))
    due = F.lit(every) | (F.hour("ts") % rules.repeat_hours == 0)
    return low.withColumn("crossed", crossed).withColumn("send", F.col("crossed") | due)


def burn_alerts(history: DataFrame, rules: AlertRules = AlertRules()) -> DataFrame:
    """WIN14: snapshots whose burn is more than ``acceleration`` times the day before."""
    growth = F.try_divide(F.col("burn24"), F.col("burn_prev"))
    return history.withColumn("growth", growth).filter((F.col("burn_prev") > 0) & (F.col("growth") > rules.acceleration))


def drift_alerts(recon: DataFrame) -> DataFrame:
    """WIN15: assets whose reconciliation delta moved too far."""
    return recon.filter("warn").select("asset", "drift")


#: The columns of :func:`alerts`.
DUE = "ts timestamp_ntz, rule string, subject string, value double"


def alerts(history: DataFrame, recon: DataFrame, rules: AlertRules = AlertRules(), every: bool = False) -> DataFrame:
    """WIN13-WIN15: alerts due at the newest snapshot, as ``(ts, rule, subject, value)``."""
    newest = history.agg(F.max("ts")).scalar()
    latest = F.col("ts") == newest
    runway = runway_alerts(history, rules, every).filter(latest & F.col("send"))
    rows = runway.select("ts", F.lit("low runway").alias("rule"), F.lit("").alias("subject"), F.col("runway").alias("value"))
    if every:
        fast = burn_alerts(history, rules).filter(latest)
        rows = rows.unionByName(fast.select("ts", F.lit("burn accelerating").alias("rule"), F.lit("").alias("subject"), F.col("growth").alias("value")))
    moved = drift_alerts(recon).select(newest.alias("ts"), F.lit("reconciliation drift").alias("rule"), F.col("asset").alias("subject"), F.col("drift").alias("value"))
    return rows.unionByName(moved)
