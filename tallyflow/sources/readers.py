"""Scans of landed files (SRC1, SRC5-SRC10, SRC12-SRC14).

Every JSON scan takes a fixed schema. ``multi_line=True`` reads one document
per file; the default reads JSON lines, which Spark can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HASH = T.StructType([T.StructField("hash", T.StringType())])

RAW_TRANSFER = T.StructType(
    [
        T.StructField("transaction_hash", T.StringType()),
        T.StructField("log_index", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("token", T.StructType([T.StructField("address_hash", T.StringType())])),
        T.StructField(
            "total",
            T.StructType([T.StructField("value", T.StringType()), T.StructField("decimals", T.StringType())]),
        ),
        T.StructField("from", _HASH),
        T.StructField("to", _HASH),
        T.StructField("_corrupt", T.StringType()),
    ]
)

_ARCHIVE_ROW = "array<struct<ts: string, val: double, cp: string>>"
_PAIR = (
    "array<struct<baseToken: struct<address: string>, priceUsd: string, "
    "liquidity: struct<usd: double>>>"
)


def _json(spark: SparkSession, path: str, schema, multi_line: bool) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path, multiLine=multi_line)
    )


def read_transfers(
    spark: SparkSession,
    path: str,
    token: str | None = None,
    to: str | None = None,
    sender: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """SRC1 nested transfer log; ``token`` and ``to`` narrow it to one role (SRC5, SRC6)."""
    raw = _json(spark, path, RAW_TRANSFER, multi_line)
    wanted = {"token.address_hash": token, "to.hash": to, "from.hash": sender}
    for column, value in wanted.items():
        if value is not None:
            raw = raw.filter(F.lower(column) == value.lower())
    return raw


def read_archive(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC7: ``{in: [...], out: [...]}`` documents as one signed ledger."""
    docs = _json(spark, path, f"`in` {_ARCHIVE_ROW}, `out` {_ARCHIVE_ROW}", multi_line)
    tagged = F.concat(
        F.transform(F.coalesce("in", F.array().cast(_ARCHIVE_ROW)), lambda r: F.struct(F.lit("IN").alias("direction"), r.alias("r"))),
        F.transform(F.coalesce("out", F.array().cast(_ARCHIVE_ROW)), lambda r: F.struct(F.lit("OUT").alias("direction"), r.alias("r"))),
    )
    rows = docs.select(F.explode(tagged).alias("e"))
    ts = F.substring("e.r.ts", 1, 19).cast("timestamp_ntz")
    return rows.select(
        "e.direction", ts.alias("ts"), F.to_date(ts).alias("day"),
        F.col("e.r.val").alias("val"), F.lower("e.r.cp").alias("cp"),
    )


def read_price_map(spark: SparkSession, path: str, asset: str, multi_line: bool = False) -> DataFrame:
    """SRC8: a JSON object of day to price as ``(asset, day, rate)``."""
    text = spark.read.text(path, wholetext=multi_line)
    prices = F.from_json("value", "map<string,double>")
    return text.select(F.explode(prices).alias("d", "rate")).select(
        F.lit(asset).alias("asset"), F.to_date("d").alias("day"), "rate"
    )


def read_ohlcv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC9: positional ``[epoch, open, high, low, close, volume]`` arrays per pool."""
    schema = "asset string, pool string, pool_rank int, ohlcv array<array<double>>"
    rows = _json(spark, path, schema, multi_line).withColumn("c", F.explode("ohlcv"))
    names = ["open", "high", "low", "close", "volume"]
    return rows.select(
        "asset", "pool", "pool_rank",
        F.to_date(F.timestamp_seconds(F.col("c").getItem(0))).alias("day"),
        *(F.col("c").getItem(i + 1).alias(n) for i, n in enumerate(names)),
    )


def read_labels(
    spark: SparkSession,
    path: str,
    key_aliases: Sequence[str] = ("wallet", "wallet_address", "address"),
    name_aliases: Sequence[str] = ("mind_name", "name", "mind"),
    existing: DataFrame | None = None,
    prefix: str = "0x",
    suffix: str = "",
) -> DataFrame:
    """SRC10: CSV labels under any accepted header; known keys keep their label."""
    rows = spark.read.csv(path, header=True)
    headers = {c.strip().lower(): c for c in rows.columns}
    key = next((headers[a] for a in key_aliases if a in headers), None)
    name = next((headers[a] for a in name_aliases if a in headers), None)
    if key is None or name is None:
        return spark.createDataFrame([], "cp string, label string") if existing is None else existing.select("cp", "label")
    found = (
        rows.select(F.lower(F.trim(F.col(f"`{key}`"))).alias("cp"), F.trim(F.col(f"`{name}`")).alias("label"))
        .filter(F.col("cp").startswith(prefix) & (F.col("label") != ""))
        .groupBy("cp").agg(F.min("label").alias("label"))
        .withColumn("label", F.concat("label", F.lit(suffix)))
    )
    if existing is None:
        return found
    return existing.select("cp", "label").unionByName(found.join(existing.select(F.lower("cp").alias("cp")), "cp", "left_anti"))


def read_document(spark: SparkSession, path: str, schema, multi_line: bool = True) -> DataFrame:
    """SRC12: one nested JSON document per file."""
    return _json(spark, path, schema, multi_line)


def read_revenue(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: a revenue snapshot document as one row with the days it covers."""
    schema = "period array<date>, net_usd double, fees_est_usd double, net_proceeds_est_usd double, tiers map<string, long>"
    return read_document(spark, path, schema).select(
        F.col("period")[0].alias("first_day"), F.col("period")[1].alias("last_day"),
        F.col("net_proceeds_est_usd").alias("net_proceeds"), F.col("net_usd").alias("net"), F.col("fees_est_usd").alias("fees"), "tiers",
    )


def read_state(spark: SparkSession, path: str, field: str, multi_line: bool = True) -> DataFrame:
    """SRC13: ``{field: {asset: {day: rate}}}`` as ``(asset, day, rate)``."""
    schema = f"`{field}` map<string, map<string, double>>"
    by_asset = _json(spark, path, schema, multi_line).select(F.explode(field).alias("asset", "by_day"))
    return by_asset.select("asset", F.explode("by_day").alias("d", "rate")).select(
        "asset", F.to_date("d").alias("day"), "rate"
    )


def read_quotes(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC14: market pair lists, one row per listed pair, its place in the list and the list's number.

    Two lists may share asset and time; ``list_id`` tells them apart within one scan.
    """
    docs = _json(spark, path, f"asset string, ts string, pairs {_PAIR}", multi_line)
    return docs.select(
        F.monotonically_increasing_id().alias("list_id"), "asset", F.col("ts").cast("timestamp_ntz").alias("ts"), "pairs"
    ).select(
        "list_id", "asset", "ts", F.posexplode("pairs").alias("pair_rank", "p")
    ).select(
        "list_id", "asset", "ts", "pair_rank",
        F.lower("p.baseToken.address").alias("base"),
        F.expr("try_cast(p.priceUsd AS double)").alias("price"),
        F.coalesce("p.liquidity.usd", F.lit(0.0)).alias("liquidity"),
    )
