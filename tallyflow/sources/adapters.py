"""The benchmark tables in the roles this library works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def event_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Platform events as a valued ledger: purchases flow in, all else flows out."""
    is_in = F.col("event_type") == "purchase"
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("key"),
        F.when(is_in, "IN").otherwise("OUT").alias("direction"),
        "ts",
        F.to_date("ts").alias("day"),
        F.concat(F.lit("A"), (F.col("user_id") % 2).cast("string")).alias("asset"),
        F.col("value").alias("val"),
        F.col("event_id").alias("blk"),
        F.col("user_id").cast("string").alias("cp"),
        F.col("value").alias("usd"),
        "event_type",
    )


def order_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Shipments to suppliers flow out, customer orders flow in."""
    out = table(spark, folder, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key"),
        F.lit("OUT").alias("direction"),
        F.col("l_shipdate").alias("ts"),
        F.to_date("l_shipdate").alias("day"),
        F.lit("B").alias("asset"),
        F.col("l_quantity").alias("val"),
        F.col("l_orderkey").alias("blk"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("cp"),
        F.col("l_extendedprice").alias("usd"),
    )
    inward = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.lit("IN").alias("direction"),
        F.col("o_orderdate").alias("ts"),
        F.to_date("o_orderdate").alias("day"),
        F.lit("B").alias("asset"),
        F.lit(1.0).alias("val"),
        F.col("o_orderkey").alias("blk"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cp"),
        F.col("o_totalprice").alias("usd"),
    )
    return out.unionByName(inward)
