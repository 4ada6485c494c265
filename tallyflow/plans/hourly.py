"""The three recurring reports, composed from the operators. Tables that several sections read are written while a report is built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import DEFAULT_SCHEME, EARNING, Scheme, classified, sum_if
from tallyflow.operators import alerts, balance, behaviour, earners, facts, platform
from tallyflow.operators.rates import asof_rate
from tallyflow.session import settle
from tallyflow.sources.sinks import bank_days


@dataclass(frozen=True)
class Inputs:
    """What an hourly run reads. Small tables are joined by their own file size."""

    ledger: DataFrame
    rates: DataFrame
    live: DataFrame
    balances: DataFrame
    prev_recon: DataFrame
    labels: DataFrame
    assets: Sequence[str]
    open_rate: DataFrame | None = None
    rollup: DataFrame | None = None
    recycle_src: str | None = None


def hourly_report(inputs: Inputs, as_of: datetime, scheme: Scheme = DEFAULT_SCHEME) -> Mapping[str, DataFrame]:
    """One frame per section of the report.

    Sections over all history read the rollup. Given a stored one, only days
    after it are read from the ledger; the trailing windows read 30 days of it,
    and balances and fingerprints the columns they need.
    """
    valued = asof_rate(inputs.ledger, inputs.rates, inputs.open_rate, inputs.live)
    ledger = classified(valued, scheme)
    history = settle(facts.rollup(ledger), "rollup") if inputs.rollup is None else facts.roll_forward(inputs.rollup, ledger)
    trailing = [w for w in facts.standard_windows(as_of) if w[1] is not None]
    assets, src = inputs.assets, inputs.recycle_src
    series = balance.balance_series(ledger, inputs.balances, assets, recycle_src=src, as_of=as_of)
    burned = balance.burn(ledger, as_of, scheme)
    worth = balance.value_balances(inputs.balances, inputs.live)
    prints = behaviour.fingerprints(ledger, scheme.incentives, labels=inputs.labels)
    earned = earners.outgoing(history).filter(F.col("cat").isin(*EARNING)).agg(sum_if("true", "usd")).scalar()
    return {
        "windows": facts.flow_facts(ledger, trailing, assets, src).unionByName(
            facts.flow_facts(history, [("all history", None, None)], assets, src)
        ),
        "monthly": facts.monthly_facts(history, as_of, assets, src),
        "daily": facts.daily_facts(history, as_of, assets, scheme),
        "hourly": facts.hourly_counts(ledger, as_of, assets),
        "top_recipients": facts.leaderboard(history, "OUT", 25, inputs.labels),
        "in_sources": facts.leaderboard(history, "IN", 10, inputs.labels),
        "wallets": facts.entity_days(history),
        "totals": earners.class_totals(history),
        "earners": earners.top_earners(history, 25, labels=inputs.labels),
        "fine_table": earners.fine_table(history),
        "loop": earners.earn_loop(history, scheme),
        "fingerprints": prints,
        "guard": earners.guard(prints, earned),
        "recon": balance.reconcile(ledger, inputs.balances, inputs.prev_recon),
        "balance_series": series,
        "trend": balance.trend_state(series, inputs.balances),
        "runway": balance.runway(burned, worth.agg(F.sum("usd")).scalar()),
    }


def kpi_snapshot(
    ledger: DataFrame, balances: DataFrame, runway: DataFrame, as_of: datetime, rate: float, asset: str, second: str | None = None
) -> DataFrame:
    """SNK2: the one-row history entry of a run, with the balances of its asset and a second one (null where unknown)."""
    out = earners.outgoing(ledger)
    held, beside = (balances.filter(F.col("asset") == F.lit(a)).agg(F.max("balance")).scalar() for a in (asset, second))
    days = {c: runway.select(c).scalar() for c in ("runway24", "runway7", "burn24", "burn_prev")}
    counts = out.groupBy("cp").agg(
        *(F.count_if(F.col("cat") == c).alias(c) for c in ("invoke", "equip", "growth")),
        sum_if(F.col("asset") == asset, "val").alias("amount"),
    )
    return counts.agg(
        *(F.sum(c).alias(c) for c in ("invoke", "equip", "growth")),
        F.round(F.sum("amount"), 1).alias("amount"),
        F.count_if((F.col("invoke") > 0) | (F.col("equip") > 0)).alias("creators"),
    ).select(
        F.lit(as_of).cast("timestamp_ntz").alias("ts"), "*",
        F.lit(rate).alias("rate"), F.round(held, 1).alias("balance"), F.round(beside, 1).alias("second_balance"), *(v.alias(k) for k, v in days.items()),
        days["runway7"].alias("runway_adj"),
    )


def telemetry(
    events: DataFrame, spec: Mapping[str, platform.EventMeasure], bank: DataFrame, as_of: datetime, lookback_days: int = 35
) -> Mapping[str, DataFrame]:
    """Refreshed day bank and active users."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    days = platform.event_days(events, spec, midnight - timedelta(days=lookback_days))
    return {"days": bank_days(days, bank, as_of), "active": platform.active_users(events, as_of)}


def notification(
    ledger: DataFrame, history: DataFrame, recon: DataFrame, as_of: datetime, rate: float, every: bool = False
) -> Mapping[str, DataFrame]:
    """As-of statistics with their deltas, and the alerts that are due."""
    stats = alerts.asof_stats(ledger, as_of, rate)
    measures = [c for c in stats.columns if c != "label"]
    return {
        "stats": stats,
        "deltas": alerts.stat_deltas(stats, measures),
        "alerts": alerts.alerts(history, recon, every=every),
    }
