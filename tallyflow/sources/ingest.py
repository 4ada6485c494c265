"""Idempotent ingest with a completeness gate (SRC2-SRC4, JN1)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import at
from tallyflow.session import settle


def one_per_key(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One record per key, always the same one, combined before the shuffle."""
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.distinct()
    return batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*batch.columns)


def unseen(batch: DataFrame, bank: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN1: batch records whose key the bank does not hold, each key once.

    The whole bank is compared, whatever times the records carry; of the bank only
    the key columns are read. The batch is written first, so that its true size decides how
    the bank is cut down to the batch's keys: where they are under the broadcast threshold, the bank
    is filtered where it lies, and only keys of the batch are shuffled. For batches above it keep
    the bank with :func:`store_bank_by_key`, which is joined without being shuffled either.
    """
    fresh = settle(one_per_key(batch, keys), "batch")
    known = bank.select(*keys).join(fresh.select(*keys), list(keys), "left_semi")
    return fresh.join(known, list(keys), "left_anti")


def store_bank_by_key(rows: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str) -> DataFrame:
    """A bank as a table in ``buckets`` parts by its keys' hash, each sorted: joins by these keys leave it where it is."""
    written = rows.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option("path", path)
    written.saveAsTable(table)
    return rows.sparkSession.table(table)


def gap_check(bank: DataFrame, batch: DataFrame, ts: str = "ts", exhausted: bool = False) -> DataFrame:
    """SRC3: one row telling whether the batch reaches back past the bank's newest time."""
    newest = bank.agg(F.max(ts)).scalar()
    return batch.agg(F.min(ts).alias("batch_oldest")).select(
        "batch_oldest",
        newest.alias("bank_newest"),
        F.coalesce(F.lit(exhausted) | newest.isNull() | (F.col("batch_oldest") < newest), F.lit(True)).alias("complete"),
    )


def ingest_increment(
    bank: DataFrame, batch: DataFrame, keys: Sequence[str], ts: str = "ts", exhausted: bool = False
) -> DataFrame:
    """SRC2: the bank plus unseen records; an incomplete batch changes nothing.

    Only the high-water mark of the bank is read before the join. Append the
    result of :func:`unseen` instead of rewriting where the bank is a table.
    """
    complete = gap_check(bank, batch, ts, exhausted).select("complete").scalar()
    return bank.unionByName(unseen(batch, bank, keys).filter(complete))


def backfill(bank: DataFrame, history: DataFrame, keys: Sequence[str], cutoff: datetime, ts: str = "ts") -> DataFrame:
    """SRC4: extend the bank back to ``cutoff``; nothing older enters, reruns add nothing."""
    return bank.unionByName(unseen(history.filter(F.col(ts) >= at(cutoff)), bank, keys))
