"""The hourly job as streams: ingest, settlement, counts, KPIs, publishing, alerts (ST1-ST4, ST6, ST7)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions import exprs, sum_where
from tallyflow.operators.alerts import AlertRules, alerts
from tallyflow.operators.balance import signed
from tallyflow.operators.facts import IN, OUT
from tallyflow.session import settle
from tallyflow.sources.ingest import unseen
from tallyflow.sources.sinks import publish_closed


def stream_ledger(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    keys: Sequence[str],
    delay: str = "1 day",
    glob: str | None = None,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """ST1: landed files as a stream in which each key arrives once within the watermark."""
    timed = landed(spark, folder, schema, delay, glob, fmt, files_per_trigger)
    return timed.dropDuplicatesWithinWatermark(list(keys))


def landed(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    delay: str = "1 day",
    glob: str | None = None,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Files of a folder as a stream with event time; ``glob`` picks files by name."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def settled_days(stream: DataFrame, **measures: Column) -> DataFrame:
    """ST2: one row per day. Append mode emits a day once it is final; update mode also shows open days."""
    named = [column.alias(name) for name, column in measures.items()]
    return stream.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), *named).select(
        F.to_date("window.start").alias("day"), "n", *measures
    )


def tumbling_counts(stream: DataFrame, width: str = "1 hour", by: Sequence[str] = ("asset",)) -> DataFrame:
    """ST3: counts and amounts per hour or day and group."""
    return stream.groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.sum("usd").alias("usd")).select(
        F.col("window.start").alias("start"), *by, "n", "usd"
    )


def sliding_kpis(stream: DataFrame, width: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """ST4: trailing flows, refreshed every ``step``.

    Rows are summed per step first and only those sums enter the overlapping
    windows, so a row is not copied into every window that covers it.
    """
    steps = stream.groupBy(F.window("ts", step)).agg(
        *exprs(
            f"{sum_where(OUT, 'usd')} AS out_usd", f"{sum_where(IN, 'usd')} AS in_usd", f"count_if({OUT}) AS out_tx"
        )
    )
    sums = [F.sum(c).alias(c) for c in ("out_usd", "in_usd", "out_tx")]
    return steps.groupBy(F.window("window", width, step).alias("span")).agg(*sums).select(
        F.col("span.end").alias("as_of"), "out_usd", "in_usd", "out_tx"
    )


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what has landed, write it as a table, and return a scan of the table."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_updates(stream: DataFrame, path: str) -> DataFrame:
    """Like :func:`drain` for update mode: each batch replaces its own folder, so a retry changes nothing."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each_batch(stream, path, keep, "update", stream.schema)


def each_batch(stream: DataFrame, path: str, fn: Callable[[DataFrame, int], None], mode: str, schema: T.StructType | str) -> DataFrame:
    """Run ``fn`` on every batch that has landed and return a scan of ``path``: ``schema`` and ``batch``, no rows if nothing landed."""
    query = (
        stream.writeStream.foreachBatch(fn).outputMode(mode)
        .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    columns = spark.createDataFrame([], schema).schema
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.read.schema(T.StructType([*columns, T.StructField("batch", T.IntegerType())])).parquet(path)


def latest_updates(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of every key from :func:`drain_updates`."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def publish_batch(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """ST6: a batch function that adds unseen keys to the table at ``path`` and never changes stored ones.

    Each batch owns one folder and compares with the other folders only, so a
    batch that runs twice writes the same rows.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.limit(0).write.mode("ignore").parquet(f"{path}/batch=-1")
        stored = batch.sparkSession.read.parquet(path).filter(F.col("batch") != batch_id)
        publish_closed(batch, stored, keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return publish


def ingest_batch(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """ST1 without a watermark: a batch function that adds records the table at ``path`` does not hold.

    Copies of a key combine before they are shuffled, however many there are;
    of the stored records only the keys are read.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        batch.limit(0).write.mode("ignore").parquet(f"{path}/batch=-1")
        stored = batch.sparkSession.read.parquet(path).filter(F.col("batch") != batch_id)
        unseen(batch, stored, keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return ingest


def pinned_batch(path: str, then: Callable[[DataFrame, int], None], val: str = "usd") -> Callable[[DataFrame, int], None]:
    """AGG15, FLT3 in a stream: a batch function that gives ``then`` each asset's net up to the pinned block.

    The pin is the smaller of the two directions' newest blocks, so a side that lags
    holds it back; while only one direction has come, it is that one's. Kept at ``path`` are one sum per
    asset at or below the pin of both, one per asset and block above it, which leaves when the
    pin passes it, and the newest blocks. Rows without a block do not count. A late row
    below the pin counts at once. A batch reads what the one before it left and owns its
    folder, so one that runs twice leaves the same. Rows are ``(asset, direction, blk)`` and ``val``.
    """
    none = "CAST(NULL AS STRING)"

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        empty = batch.limit(0).selectExpr("asset", "direction", "blk", "0D AS net")
        empty.write.mode("ignore").parquet(f"{path}/batch=-1")
        versions = spark.read.parquet(path).filter(F.col("batch") < batch_id)
        before = versions.filter(F.col("batch") == versions.agg(F.max("batch")).scalar()).drop("batch")
        fresh = batch.filter("blk IS NOT NULL").groupBy("asset", "direction", "blk").agg(F.sum(signed(val)).alias("net"))
        rows = settle(before.unionByName(fresh), "pinned")
        newest = rows.filter("direction IS NOT NULL AND blk > 0").groupBy("direction").agg(F.max("blk").alias("blk"))
        pin = F.coalesce(newest.agg(F.min("blk")).scalar(), F.lit(0))
        passed = F.when(newest.agg(F.count("*")).scalar() > 1, pin).otherwise(0)
        above = F.when(F.col("blk") > passed, F.col("blk"))
        sums = rows.filter("asset IS NOT NULL").groupBy("asset", above.alias("blk")).agg(F.sum("net").alias("net"))
        marks = newest.selectExpr(f"{none} AS asset", "direction", "blk", "0D AS net")
        kept = sums.selectExpr("asset", f"{none} AS direction", "blk", "net").unionByName(marks)
        kept.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        state = spark.read.schema(empty.schema).parquet(f"{path}/batch={batch_id}").filter("asset IS NOT NULL")
        due = F.when(F.col("blk").isNull() | (F.col("blk") <= pin), F.col("net")).otherwise(0.0)
        then(state.groupBy("asset").agg(F.sum(due).alias("net")), batch_id)

    return publish


def alert_batch(
    path: str,
    history: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    rules: AlertRules = AlertRules(),
    every: bool = False,
) -> Callable[[DataFrame, int], None]:
    """ST7: a batch function that reconciles what arrived and writes the alerts then due.

    ``judge`` turns a batch of ``(asset, net)`` into reconciliation rows; behind
    :func:`pinned_batch` the net is that at the pinned block.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        alerts(history, judge(batch), rules, every).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return publish
