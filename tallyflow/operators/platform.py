"""Platform telemetry against the ledger (AGG25-AGG29, JN11, JN15)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions import Scheme, at, exprs, is_unbacked, moment, quoted, sum_if, sum_where, tidied, tidy


@dataclass(frozen=True)
class EventMeasure:
    """Counts events of some types; with ``paths`` it sums the first JSON field present."""

    types: tuple[str, ...]
    paths: tuple[str, ...] = ()


def _number(properties: str, paths: Sequence[str]) -> str:
    fields = [f"try_cast(get_json_object({properties}, {quoted([p])}) AS DOUBLE)" for p in paths]
    return f"coalesce({', '.join(fields)}, 0D)"


def event_days(
    events: DataFrame,
    spec: Mapping[str, EventMeasure],
    since: datetime,
    ts: str = "ts",
    kind: str = "event_type",
    properties: str = "props",
) -> DataFrame:
    """SRC11, AGG28: daily counts and sums; time and type filters reach the scan."""
    types = sorted({t for m in spec.values() for t in m.types})
    wanted = events.filter(f"{ts} >= {moment(since)} AND {kind} IN ({quoted(types)})")

    def measure(m: EventMeasure) -> str:
        hit = f"{kind} IN ({quoted(m.types)})"
        return tidied(sum_where(hit, _number(properties, m.paths)), 2) if m.paths else f"count_if({hit})"

    return wanted.groupBy(F.to_date(ts).alias("day")).agg(*exprs([f"{measure(m)} AS {name}" for name, m in spec.items()]))


def active_users(
    events: DataFrame, as_of: datetime, days: Sequence[int] = (7, 30), approx: bool = False, user: str = "user_id", ts: str = "ts"
) -> DataFrame:
    """AGG29: distinct users in trailing windows, strictly after each cut.

    A user's last event answers every window, so the exact form is one small
    aggregate per user; ``approx`` counts with a sketch and no per-user shuffle.
    """
    cuts = {d: at(as_of - timedelta(days=d)) for d in days}
    recent = events.filter(F.col(ts) > cuts[max(days)])
    if approx:
        return recent.agg(*(F.approx_count_distinct(F.when(F.col(ts) > cut, F.col(user))).alias(f"active_{d}d") for d, cut in cuts.items()))
    last = recent.groupBy(user).agg(F.max(ts).alias("last"))
    return last.agg(*(F.count_if(F.col("last") > cut).alias(f"active_{d}d") for d, cut in cuts.items()))


def user_days(events: DataFrame, user: str = "user_id", ts: str = "ts", lg_k: int = 14) -> DataFrame:
    """AGG29, AGG4: one sketch of the users of each day, to be stored and merged later.

    A sketch has at most ``2 ** lg_k`` bytes whatever the users, and is off by about
    ``1.04 / 2 ** (lg_k / 2)`` of the count, 0.8 % for 14.
    """
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(user, F.lit(lg_k)).alias("users"))


def active_from_days(
    stored: DataFrame, last: date, days: Sequence[int] = (1, 7, 30), user: str | None = None
) -> DataFrame:
    """AGG29 over stored days: users of the last ``days`` whole days up to ``last``, as ``(days, users)``.

    ``stored`` has the sketches of :func:`user_days`, so events are not read again; with
    ``user`` it has a row per day and user and the count is exact.
    """
    spans = F.explode(F.array(*(F.lit(d) for d in days))).alias("days")
    widest = stored.filter((F.col("day") <= F.lit(last)) & (F.col("day") > F.lit(last - timedelta(days=max(days)))))
    if user:
        newest = widest.groupBy(user).agg(F.max("day").alias("day"))
        per = newest.filter(F.col(user).isNotNull()).groupBy("day").agg(F.count("*").alias("n"))
        value = F.sum("n")
    else:
        per, value = widest, F.hll_sketch_estimate(F.hll_union_agg("users"))
    covered = per.select(spans, "*").filter(F.date_diff(F.lit(last), F.col("day")) < F.col("days"))
    return covered.groupBy("days").agg(value.alias("users"))


def ledger_days(ledger: DataFrame, scheme: Scheme) -> DataFrame:
    """Unbacked and purchase-backed payouts per day."""
    out = ledger.filter(F.col("direction") == "OUT")
    return out.groupBy("day").agg(
        sum_if(is_unbacked(scheme), "usd").alias("unbacked"),
        sum_if(f"fine IN ({quoted(scheme.backed)})", "usd").alias("backed"),
    )


def period_ratio(ledger: DataFrame, snapshot: DataFrame, scheme: Scheme) -> DataFrame:
    """JN15, AGG25, FLT2: unbacked payouts of a revenue period over its proceeds.

    ``snapshot`` is one row ``(first_day, last_day, net_proceeds, net, fees)``.
    Its days enter the ledger filter as scalars, so there is no join.
    """
    first, last = (snapshot.select(c).scalar() for c in ("first_day", "last_day"))
    period = ledger.filter((F.col("direction") == "OUT") & F.col("day").between(first, last))
    paid = period.agg(sum_if(is_unbacked(scheme), "usd")).scalar()
    proceeds = F.coalesce(F.nullif("net_proceeds", F.lit(0.0)), F.col("net") - F.col("fees"))
    return snapshot.select(
        tidy(paid, 2).alias("unbacked_usd"),
        tidy(proceeds, 2).alias("proceeds"),
        F.when(proceeds != 0, tidy(paid / proceeds, 1)).alias("ratio"),
    )


def settled_tier(
    days: DataFrame, ledger: DataFrame, scheme: Scheme, n: int = 7, burn7avg: Column | None = None, wau: Column | None = None
) -> DataFrame:
    """JN11, AGG26: the last ``n`` settled days of the platform beside the ledger.

    ``days`` is a day bank with ``topups``, ``topup_usd``, ``awakens``, ``settled``.
    """
    closed = days.filter("settled").orderBy(F.col("day").desc()).limit(n)
    both = closed.join(ledger_days(ledger, scheme), "day", "left")
    flat = both.agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.sum("topup_usd").alias("topup"), F.sum("topups").alias("topups"), F.sum("awakens").alias("awakens"),
        F.coalesce(F.sum("backed"), F.lit(0.0)).alias("backed"), F.coalesce(F.sum("unbacked"), F.lit(0.0)).alias("unbacked"),
    )
    cost = F.lit(None).cast("double") if burn7avg is None or wau is None else F.when(wau > 0, tidy(burn7avg * 7 / wau, 2))
    return flat.select(
        "first_day", "last_day", tidy("topup", 2).alias("topup_usd"), "topups", "awakens",
        tidy("backed", 2).alias("backed_out_usd"),
        tidy(tidy("backed", 2) - tidy("topup", 2), 2).alias("diverge_usd"),
        tidy("unbacked", 2).alias("unbacked_usd"),
        F.when(tidy("topup", 2) != 0, tidy(tidy("unbacked", 2) / tidy("topup", 2), 1)).alias("subsidy_ratio"),
        cost.alias("cost_per_user"),
    )


def ratio_weeks(days: DataFrame, ledger: DataFrame, scheme: Scheme, size: int = 7) -> DataFrame:
    """JN11, AGG27: runs of ``size`` settled days counted back from the newest; a short oldest run is left out."""
    rank = F.row_number().over(W.orderBy(F.col("day").desc()))
    settled = days.filter("settled").withColumn("run", F.floor((rank - 1) / size))
    both = settled.join(ledger_days(ledger, scheme), "day", "left")
    per = both.groupBy("run").agg(
        F.count("*").alias("days"), F.max("day").alias("end_day"), F.sum("topup_usd").alias("topup"),
        tidy(F.coalesce(F.sum("unbacked"), F.lit(0.0)), 2).alias("unbacked"),
    )
    return per.filter(F.col("days") == size).select(
        "end_day", tidy("topup", 2).alias("topup"), "unbacked",
        F.when(F.col("topup") != 0, tidy(F.col("unbacked") / F.col("topup"), 1)).alias("ratio"),
    )
