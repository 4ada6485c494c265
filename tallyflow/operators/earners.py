"""Classified payouts: totals, earners, incentive loop, guard (AGG8-AGG10, AGG23, AGG24, AGG36).

Every function takes a ledger with ``fine`` and ``cat`` and reads its outgoing rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import EARNING, Scheme, at, exprs, folded_class, quoted, sum_if, tidied, tidy
from tallyflow.operators.facts import count_where, rows_in, share, with_label
from tallyflow.session import settle


def outgoing(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("direction") == "OUT")


def category_totals(ledger: DataFrame, as_of: datetime) -> DataFrame:
    """AGG8: count, USD and last-24-hours count per coarse class."""
    recent = F.col("ts") > at(as_of - timedelta(hours=24))
    return outgoing(ledger).groupBy("cat").agg(
        F.count("*").alias("n"), tidy(F.sum("usd"), 2).alias("usd"), F.count_if(recent).alias("n_24h")
    )


def class_totals(ledger: DataFrame) -> DataFrame:
    """AGG8: count and USD per coarse class, from a ledger or a rollup."""
    return outgoing(ledger).groupBy("cat").agg(*exprs(f"sum({rows_in(ledger)}) AS n", f"{tidied('sum(usd)', 2)} AS usd"))


def earners(ledger: DataFrame, cats: Sequence[str] = EARNING) -> DataFrame:
    """AGG9: per recipient, the count of each earning class and their USD."""
    return (
        outgoing(ledger).filter(F.col("cat").isin(*cats))
        .groupBy("cp")
        .agg(*exprs([f"{count_where(f'cat = {quoted([c])}', rows_in(ledger))} AS {c}" for c in cats], "sum(usd) AS usd"))
    )


def top_earners(ledger: DataFrame, k: int, cats: Sequence[str] = EARNING, labels: DataFrame | None = None) -> DataFrame:
    """AGG9, AGG36, JN5: the ``k`` largest earners with their share of all earnings, and their labels if given."""
    board = settle(earners(ledger, cats), "earners")
    total = board.agg(F.sum("usd")).scalar()
    top = board.orderBy(tidy("usd", 2).desc(), "cp").limit(k)
    top = top if labels is None else with_label(top, labels)
    return top.withColumn("share", tidy(F.col("usd") / total * 100, 1)).withColumn("usd", tidy("usd", 2))


def earner_totals(ledger: DataFrame, cats: Sequence[str] = EARNING) -> DataFrame:
    """AGG9, AGG36: number of earners, their USD, and how many of the first class per second class."""
    first, second = cats[0], cats[1]
    return earners(ledger, cats).agg(
        F.count("*").alias("earners"),
        tidy(F.sum("usd"), 2).alias("usd"),
        F.coalesce(tidy(F.try_divide(F.sum(first), F.sum(second)), 0), F.lit(0.0)).alias(f"{first}_per_{second}"),
    )


def unclassified(ledger: DataFrame, scheme: Scheme) -> DataFrame:
    """AGG36: payouts whose folded class is no earning one; small amounts off the grid fold into the first class."""
    return ledger.filter(~F.expr(folded_class(scheme=scheme)).isin(*EARNING))


def unclassified_summary(ledger: DataFrame, scheme: Scheme) -> DataFrame:
    """AGG36: the fine classes of unclassified payouts, with their share of that rest."""
    return fine_table(unclassified(ledger, scheme))


def fine_table(ledger: DataFrame) -> DataFrame:
    """AGG10, AGG36: fine classes with count, USD and share."""
    table = outgoing(ledger).groupBy("fine").agg(*exprs(f"sum({rows_in(ledger)}) AS n", "sum(usd) AS usd"))
    return share(table, "usd").withColumn("usd", tidy("usd", 2))


def earn_loop(ledger: DataFrame, scheme: Scheme, over: Sequence[float] = (10, 50)) -> DataFrame:
    """AGG23: wallets that received the credit and also earn.

    One aggregate per recipient answers both set tests, so there is no join.
    """
    earning = F.col("cat").isin(*EARNING)
    both = (
        outgoing(ledger).groupBy("cp")
        .agg(
            F.count_if(F.col("fine") == scheme.credit).alias("credits"),
            F.count_if(earning).alias("earned"),
            sum_if(earning, "usd").alias("usd"),
        )
        .filter(F.col("credits") > 0)
    )
    loop = F.col("earned") > 0
    return both.agg(
        F.count("*").alias("credit_recip_n"),
        F.count_if(loop).alias("loop_n"),
        tidy(sum_if(loop, "usd"), 2).alias("loop_usd"),
        *(F.count_if(loop & (tidy("usd", 2) > float(x))).alias(f"loop_gt{x:g}") for x in over),
    )


def guard(fingerprints: DataFrame, earned_usd) -> DataFrame:
    """AGG24: flagged against monitored earners and the USD at risk."""
    flagged = F.col("status") == "review"
    return fingerprints.agg(
        F.count_if(flagged).alias("flagged_n"),
        F.count("*").alias("monitored_n"),
        tidy(sum_if(flagged, "usd"), 2).alias("at_risk_usd"),
    ).withColumn("total_usd", tidy(earned_usd, 2))


def latest_unclassified(ledger: DataFrame, scheme: Scheme, k: int = 40) -> DataFrame:
    """SRT5: the newest unclassified payouts."""
    rest = unclassified(outgoing(ledger), scheme)
    return rest.orderBy(F.col("ts").desc(), "key").limit(k).select("ts", "key", "cp", tidy("usd", 2).alias("usd"), "fine")
