"""The quote state machine on a stream (ST5): in slices batch by batch, or keyed by asset."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyflow.operators.quotemaps import QuoteState
from tallyflow.operators.quotes import STATE, run_quotes, walk_quotes

OUTPUT_SCHEMA = "asset string, ts timestamp, key string, price double, rate double, source string, anchor double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def quote_batch(
    path: str, anchors: DataFrame, factor: float = 5, confirm: float = 2, rows_per_slice: int = 20_000
) -> Callable[[DataFrame, int], None]:
    """ST5: a batch function that writes judged quotes to ``path`` and where each asset then stands beside it.

    A batch is cut into slices like :func:`tallyflow.operators.quotes.validate_quotes` does, so
    one asset may have all of a batch of any size. A batch begins where those before it
    ended and owns its folders, so one that runs twice writes the same rows. ``anchors`` is
    ``(asset, anchor)``, for assets that no batch has met.
    """
    kept = f"{path}-states"

    def publish(batch: DataFrame, batch_id: int) -> None:
        opening = anchors.selectExpr("asset", "anchor", "CAST(NULL AS DOUBLE) AS pending", "false AS accepted")
        opening.limit(0).write.mode("ignore").parquet(f"{kept}/batch=-1")
        stored = batch.sparkSession.read.parquet(kept).filter(F.col("batch") < batch_id)
        versions = opening.withColumn("batch", F.lit(-1)).unionByName(stored)
        newest = versions.groupBy("asset").agg(F.max_by(F.struct("anchor", "pending", "accepted"), "batch").alias("s"))
        quotes = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        judged, ends = walk_quotes(quotes, newest.select("asset", "s.*"), factor, confirm, rows_per_slice)
        judged.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        ends.write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")

    return publish


class QuoteProcessor(StatefulProcessor):
    """Keeps each asset's anchor and pending quote between batches."""

    def __init__(self, anchors: dict[str, float], factor: float, confirm: float) -> None:
        self.anchors, self.factor, self.confirm = anchors, factor, confirm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("quote", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (asset,) = key
        stored = self.state.get() if self.state.exists() else (self.anchors.get(asset), None, False)
        quotes = pd.concat(list(rows)).sort_values(["ts", "key"])
        end, out = run_quotes(QuoteState(*stored), quotes, self.factor, self.confirm)
        self.state.update(tuple(end))
        result = quotes[["asset", "ts", "key", "price"]].copy()
        result[["rate", "source", "anchor"]] = pd.DataFrame(out, index=quotes.index)
        yield result

    def close(self) -> None:
        pass


def validate_quotes_stream(quotes: DataFrame, anchors: dict[str, float], factor: float = 5, confirm: float = 2) -> DataFrame:
    """ST5: :func:`tallyflow.operators.quotes.validate_quotes` on a stream of quotes.

    ``quotes`` is ``(asset, ts, key, price, fallback)``; an asset without an anchor
    gets no rate. A batch holds one
    asset's quotes in memory, so size it with the source's files-per-trigger, or use
    :func:`quote_batch`. The session's state store must be RocksDB.
    """
    if quotes.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", None) != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return quotes.groupBy("asset").transformWithStateInPandas(
        statefulProcessor=QuoteProcessor(anchors, factor, confirm),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="None",
    )
