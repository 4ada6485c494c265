"""Derived frames that put the benchmark tables into the roles the queries need."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions import Scheme, classified
from tallyflow.operators.platform import EventMeasure
from tallyflow.session import scratch_path
from tallyflow.sources.adapters import event_ledger, table

AS_OF = datetime(2024, 1, 31)
ASSETS = ("A0", "A1")
RECYCLE = "3"

EVENTS = Scheme(
    grid=((5, "b5"), (10, "b10"), (25, "b25"), (50, "b50"), (100, "b100")),
    floor=2,
    tolerance=0.08,
    fine={"b5": "invoke", "b10": "equip", "b25": "credit", "b50": "referral", "b100": "purchase", "micro": "test"},
    coarse={"invoke": "invoke", "equip": "equip", "test": "micro"},
    small_below=20,
    backed=("purchase",),
    incentives=("credit", "referral"),
    credit="credit",
    buckets={"invoke": "c5", "equip": "c10", "credit": "c25", "referral": "c50", "purchase": "backed"},
)

TELEMETRY = {
    "topups": EventMeasure(("purchase",)),
    "topup_usd": EventMeasure(("purchase",), ("$.amount", "$.k")),
    "topup_intents": EventMeasure(("click",)),
    "awakens": EventMeasure(("view",)),
    "logins": EventMeasure(("signup", "error")),
}


def classified_events(spark: SparkSession, folder: str) -> DataFrame:
    return classified(event_ledger(spark, folder), EVENTS)


def behaviour_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event types stand for classes, which gives users enough events to judge a cadence."""
    kind = F.col("event_type")
    return (
        event_ledger(spark, folder)
        .withColumn("cat", F.when(kind.isin("view", "click"), "invoke").when(kind == "signup", "equip").otherwise("growth"))
        .withColumn("fine", F.when((kind == "error") & (F.col("usd") > 60), "credit").otherwise(F.col("cat")))
    )


def names(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as labels of users."""
    return table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("cp"), F.col("c_name").alias("label"))


def sparse_rates(spark: SparkSession, folder: str) -> DataFrame:
    """A rate per asset on odd days; even days must be carried."""
    odd = event_ledger(spark, folder).filter(F.day("day") % 2 == 1)
    return odd.groupBy("asset", "day").agg((F.avg("val") / 1000).alias("rate"))


def pool_candles(spark: SparkSession, folder: str) -> DataFrame:
    """Event types as pools: volume, first and last value by block per asset and day."""
    rank = F.when(F.col("pool") == "click", 0).when(F.col("pool") == "view", 1).otherwise(2)
    return (
        event_ledger(spark, folder).withColumnRenamed("event_type", "pool")
        .groupBy("asset", "pool", "day")
        .agg(
            F.min_by("val", "blk").alias("open"), F.max("val").alias("high"), F.min("val").alias("low"),
            (F.max_by("val", "blk") / 1000).alias("close"), F.round(F.sum("val"), 2).alias("volume"),
        )
        .withColumn("pool_rank", rank)
    )


def day_bank(spark: SparkSession, folder: str) -> DataFrame:
    """Telemetry of all users as stored up to a day, some measures higher, so a kept day differs from a refreshed one."""
    from tallyflow.operators.platform import event_days

    days = event_days(table(spark, folder, "events"), TELEMETRY, datetime(2024, 1, 1))
    stored = days.filter(F.day("day") <= 25).withColumns({"topups": F.col("topups") + 3, "topup_usd": F.col("topup_usd") + 10.5, "logins": F.col("logins") + 1})
    return stored.withColumn("settled", F.day("day") <= 20).withColumn("partial", F.lit(False))


def balances(spark: SparkSession, folder: str) -> DataFrame:
    """A balance per asset: all value ever seen, so reconciliation has something to explain."""
    per = event_ledger(spark, folder).groupBy("asset").agg(F.round(F.sum("val"), 2).alias("balance"))
    return per.withColumn("degraded", F.lit(False))


def hourly_history(spark: SparkSession, folder: str) -> DataFrame:
    """One KPI row per hour of the ledger: burn of the day and the day before, and runway of a fixed float."""
    from pyspark.sql import Window as W

    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    per = event_ledger(spark, folder).filter("direction = 'OUT'").groupBy(hour.alias("ts")).agg(F.sum("usd").alias("usd"))
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    order = W.orderBy(sec)
    trailing = lambda h0, h1: F.round(F.sum("usd").over(order.rangeBetween(-h0 * 3600, -h1 * 3600)), 2)
    rolled = per.select("ts", trailing(23, 0).alias("burn24"), trailing(47, 24).alias("burn_prev"), trailing(167, 0).alias("week"))
    return rolled.select(
        "ts", "burn24", "burn_prev",
        F.round(F.lit(40.0) * F.day("ts") / F.col("burn24") * F.col("week") / 1000, 1).alias("runway24"),
        F.round(F.lit(280.0) * F.day("ts") / F.col("week"), 1).alias("runway7"),
        F.lit(None).cast("double").alias("runway_adj"),
    )


def quote_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Event values as quotes: some missing, some zero, some with a fallback price."""
    ev = event_ledger(spark, folder)
    return ev.select(
        "asset", "ts", F.col("key"),
        F.when(F.col("blk") % 11 == 0, F.lit(None)).when(F.col("blk") % 13 == 0, 0.0).otherwise(F.col("val")).cast("double").alias("price"),
        F.when(F.col("blk") % 3 == 0, F.col("val") / 2 + 10).alias("fallback"),
    )


def raw_transfer_files(spark: SparkSession, folder: str) -> str:
    """Events written as nested transfer logs, amounts as 18-decimal strings."""
    ev = table(spark, folder, "events")
    cents = F.round(F.col("value") * 100, 0).cast("long").cast("string")
    sender = F.concat(F.lit("0xUSER"), F.col("user_id").cast("string"))
    raw = ev.select(
        F.concat(F.lit("0xTX"), F.col("event_id").cast("string")).alias("transaction_hash"),
        (F.col("event_id") % 7).alias("log_index"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("block_number"),
        F.struct(F.concat(F.lit("0xTOK"), (F.col("user_id") % 3).cast("string")).alias("address_hash")).alias("token"),
        F.struct(
            F.concat(cents, F.lit("0000000000000000")).alias("value"),
            F.when(F.col("event_id") % 4 != 0, "18").alias("decimals"),
        ).alias("total"),
        F.struct(sender.alias("hash")).alias("from"),
        F.struct(F.lit("0xHUB").alias("hash")).alias("to"),
    )
    path = scratch_path(spark, "raw_transfers")
    raw.write.json(path)
    return path


def token_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("0xtok0", "A0", 18), ("0xtok1", "A1", None)], "address string, asset string, decimals int")
