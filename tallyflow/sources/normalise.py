"""Raw transfers to ledger rows (PRJ1, PRJ2, SRC6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keyed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("address", F.lower("token.address_hash"))


def normalise(raw: DataFrame, assets: DataFrame, direction: str) -> DataFrame:
    """PRJ1: transfers of listed assets as ledger rows, cut to whole seconds.

    ``assets`` is ``(address, asset, decimals)``. Amounts may exceed 38 digits,
    so they become doubles and the raw text is kept beside them in ``raw_val``.
    """
    decimals = F.coalesce(
        F.expr("try_cast(nullif(total.decimals, '') AS int)"), F.col("decimals"), F.lit(18)
    )
    ts = F.substring("timestamp", 1, 19).cast("timestamp_ntz")
    counterparty = "from.hash" if direction == "IN" else "to.hash"
    known = _keyed(raw).join(assets.select(F.lower("address").alias("address"), "asset", "decimals"), "address")
    return known.select(
        F.concat_ws(":", "transaction_hash", "log_index").alias("key"),
        F.lit(direction).alias("direction"),
        ts.alias("ts"),
        F.to_date(ts).alias("day"),
        "asset",
        (F.expr("try_cast(total.value AS double)") / F.pow(F.lit(10.0), decimals)).alias("val"),
        F.coalesce("block_number", F.lit(0)).cast("long").alias("blk"),
        F.lower(counterparty).alias("cp"),
        F.lower("from.hash").alias("src"),
        F.lower("to.hash").alias("dst"),
        F.col("transaction_hash").alias("tx"),
        F.col("total.value").alias("raw_val"),
    )


def excluded(raw: DataFrame, assets: DataFrame) -> DataFrame:
    """PRJ2: how many transfers PRJ1 leaves out."""
    listed = assets.select(F.lower("address").alias("address"))
    return _keyed(raw).join(listed, "address", "left_anti").agg(F.count("*").alias("excluded"))
