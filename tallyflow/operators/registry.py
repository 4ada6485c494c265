"""Participant registry and look-alike short addresses (AGG31, JN12, SET3, SET4)."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import short_key
from tallyflow.session import settle


def extend_registry(
    registry: DataFrame, leaders: Sequence[DataFrame], labels: DataFrame, left_out: str | None = None, **forms: Any
) -> DataFrame:
    """JN12: unlabelled leaders not yet listed, then labels not yet listed, as ``(cp, role, grp, warn, collision)``.

    ``registry`` is ``(cp, role, grp, warn)``, each of ``leaders`` is ``(cp, label, role, grp)``,
    such as recipients, then sources, and ``labels`` is ``(cp, label)``, without those that contain ``left_out``. An
    address enters once, by the first that has it. ``collision`` is that of :func:`short_collisions`
    among all that are listed or lead, labelled leaders included; ``forms`` are its arguments.
    """
    key = F.lower("cp").alias("key")
    listed = registry.select(key, F.lit(0).alias("turn"), "cp", "role", "grp", F.coalesce("warn", F.lit(False)).alias("warn"))
    offered = [df.select(key, F.lit(i + 1).alias("turn"), "cp", "role", "grp", F.lit(False).alias("warn"), "label") for i, df in enumerate(leaders)]
    known = labels if left_out is None else labels.filter(~F.contains(F.coalesce("label", F.lit("")), F.lit(left_out)))
    rest = known.select(key, F.lit(len(leaders) + 1).alias("turn"), "cp", F.col("label").alias("role"), F.lit("Other labeled").alias("grp"), F.lit(False).alias("warn"))
    led = functools.reduce(DataFrame.unionAll, [df.filter("label is null").drop("label") for df in offered], listed.limit(0))
    entry = F.struct("turn", "grp", "role", "cp", "warn")
    new = led.unionAll(rest).groupBy("key").agg(F.min(entry).alias("r")).join(listed.select("key"), "key", "left_anti")
    rows = settle(listed.unionAll(new.select("key", "r.turn", "r.cp", "r.role", "r.grp", "r.warn")), "registry")
    shown = functools.reduce(DataFrame.unionAll, [df.select("cp") for df in offered], rows.select("cp"))
    collisions = short_collisions(shown, **forms).select(F.col("cp").alias("key"), "collision")
    return rows.join(collisions, "key", "left").select("cp", "role", "grp", "warn", "collision")


def split_keys(rows: DataFrame, form: str, heavy: DataFrame) -> DataFrame:
    """``rows`` with ``salt``: one of as many splits as ``heavy`` (``form, splits``) gives its form, else 0."""
    parts = rows.join(heavy, form, "left")
    return parts.withColumn("salt", F.pmod(F.xxhash64("cp"), F.coalesce("splits", F.lit(1))).cast("int")).drop("splits")


def short_collisions(addresses: DataFrame, short: tuple[int, int] = (6, 4), long: tuple[int, int] = (8, 4), per_split: int = 100_000) -> DataFrame:
    """AGG31: addresses whose short forms belong to more than one address.

    "table" if even the longer short form is shared, "short" if only the
    shorter one is. Counts combine before their shuffle. Only the shared forms
    come back to the addresses; one that more than ``per_split`` addresses share comes
    back in as many splits as its count asks for. Such forms are at most one in ``per_split`` of
    the addresses, and are written, so that their true size says how they meet the addresses.
    """
    one = addresses.select(F.lower("cp").alias("cp")).filter("cp is not null").distinct().select(
        "cp", short_key(F.col("cp"), *short).alias("short_key"), short_key(F.col("cp"), *long).alias("long_key")
    )
    one = settle(one, "addresses")

    def shared(rows: DataFrame, form: str, mark: str) -> DataFrame:
        many = settle(rows.groupBy(form).agg(F.count("*").alias("n")).filter("n > 1"), "forms")
        many = many.withColumn("splits", F.ceil(F.col("n") / per_split).cast("int")).drop("n")
        heavy = settle(many.filter("splits > 1"), "heavy")
        back = many.select(form, F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"), F.lit(True).alias(mark))
        return split_keys(rows, form, heavy).join(back, [form, "salt"], "left").drop("salt")

    marked = shared(one, "short_key", "by_short").filter("by_short")
    marked = shared(settle(marked, "shared"), "long_key", "by_long")
    return marked.select("cp", "short_key", "long_key", F.when(F.col("by_long"), "table").otherwise("short").alias("collision"))
