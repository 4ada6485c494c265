"""Exports, snapshots and insert-only state (SNK1-SNK5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.sources.ingest import one_per_key
from tallyflow.sources.runs import Runs


def export_rows(ledger: DataFrame, labels: DataFrame, band_labels: Mapping[str, str] | None = None) -> DataFrame:
    """SNK1: the per-transfer export, OUT before IN and newest first.

    The sort is a range partitioning on a unique key, so the part files are in
    order and no key can fill one task. Write it with ``write.csv(header=True)``.
    """
    band = F.col("band")
    if band_labels:
        band = F.create_map(*[F.lit(x) for pair in band_labels.items() for x in pair])[band]
    is_out = F.col("direction") == "OUT"
    return (
        ledger.join(labels.select(F.lower("cp").alias("_cp"), "label"), F.lower("cp") == F.col("_cp"), "left")
        .orderBy(F.col("direction").desc(), F.col("ts").desc(), "key")
        .select(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp_utc"),
            "direction",
            F.col("asset").alias("token"),
            F.format_string("%.6f", "val").alias("amount"),
            F.format_string("%.8f", "rate").alias("rate_usd"),
            F.col("rate_src").alias("rate_source"),
            F.format_string("%.4f", "usd").alias("usd"),
            F.when(is_out, band).otherwise("").alias("size_band"),
            F.col("cp").alias("counterparty"),
            F.coalesce("label", F.lit("")).alias("counterparty_label"),
            F.col("tx" if "tx" in ledger.columns else "key").alias("tx_hash"),
        )
    )


def append_snapshot(row: DataFrame, runs: Runs, run: str) -> bool:
    """SNK2: add the KPI row of a run, once however often the run is repeated; read the history with ``runs.read``."""
    return runs.append(run, row)


def publish_closed(new: DataFrame, state: DataFrame, keys: Sequence[str], runs: Runs | None = None, run: str = "") -> DataFrame:
    """SNK3: rows whose key the state lacks, one per key; stored keys never change.

    With ``runs`` they are stored as those of ``run``.
    """
    fresh = one_per_key(new, keys).join(state.select(*keys), list(keys), "left_anti")
    if runs is not None:
        runs.append(run, fresh)
    return fresh


def bank_days(new: DataFrame, bank: DataFrame, as_of: datetime, settle_days: int = 2) -> DataFrame:
    """SNK4: refresh the day bank; a settled day stays as it was first stored."""
    cut = (as_of - timedelta(days=settle_days)).date()
    measures = [c for c in new.columns if c not in ("day", "settled", "partial")]
    fresh = new.select("day", *measures).withColumn("settled", F.col("day") <= F.lit(cut)).withColumn(
        "partial", F.col("day") == F.lit(as_of.date())
    )
    both = bank.alias("o").join(fresh.alias("n"), "day", "full_outer")
    keep = F.coalesce(F.col("o.settled") & (F.col("day") <= F.lit(cut)), F.lit(False)) | F.col("n.settled").isNull()
    columns = [*measures, "settled", "partial"]
    return both.select("day", *(F.when(keep, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in columns))


def store_bank(new: DataFrame, runs: Runs, run: str, as_of: datetime, settle_days: int = 2) -> DataFrame:
    """SNK4: the refreshed bank, stored as a version of its own; the newest committed version is the bank.

    ``run`` sorts by time, such as ``2024-01-31T05``. A run that is repeated starts from the version
    before its own and changes nothing once it is committed.
    """
    name = runs.name(run)
    earlier = [folder for version, folder in runs.committed().items() if version < name]
    schema = new.limit(0).selectExpr("*", "false AS settled", "false AS partial").schema
    refreshed = bank_days(new, runs.read(schema, earlier[-1:] or []), as_of, settle_days)
    runs.append(run, refreshed)
    return runs.read(schema, [runs.committed()[name]])


def to_document(rows: DataFrame, section: str) -> DataFrame:
    """SNK5: rows of one section as JSON texts, written in parallel."""
    return rows.select(F.lit(section).alias("section"), F.to_json(F.struct(*rows.columns)).alias("body"))


def write_document(sections: Mapping[str, DataFrame], path: str) -> None:
    """SNK5: every section in one folder, partitioned by section name."""
    parts = [to_document(df, name) for name, df in sections.items()]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged.write.mode("overwrite").partitionBy("section").json(path)
