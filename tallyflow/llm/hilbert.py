"""Shards along a Hilbert curve through several metadata dimensions, with DataFrame functions only."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.session import settle


@cache
def curve(dims: int) -> tuple[int, ...]:
    """One step of the curve as a table: at ``state * 2**dims + corner`` the next state times ``2**dims`` plus the corner's rank.

    Made from the rule of the curve: a state is an entry corner and a direction;
    corners are ranked by the inverse Gray code after reflection and rotation.
    """
    n, corners = dims, 1 << dims

    def rotated(x, k):
        k %= n
        return (x << k | x >> (n - k)) & (corners - 1)

    def rank(gray):
        out = 0
        while gray:
            out, gray = out ^ gray, gray >> 1
        return out

    def trailing_ones(i):
        return (~i & (i + 1)).bit_length() - 1

    def entry(w):
        return 0 if w == 0 else (e := 2 * ((w - 1) // 2)) ^ e >> 1

    def direction(w):
        return 0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % n

    table = []
    for state in range(corners * n):
        e, d = divmod(state, n)
        for corner in range(corners):
            w = rank(rotated(corner ^ e, -(d + 1)))
            after = (e ^ rotated(entry(w), d + 1)) * n + (d + direction(w) + 1) % n
            table.append(after * corners + w)
    return tuple(table)


def index(coordinates: list[Column], bits: int) -> Column:
    """Place on the curve of a point whose coordinates are whole numbers below ``2**bits``."""
    n = len(coordinates)
    steps = F.array(*(F.lit(x) for x in curve(n)))
    bit = lambda c, level: F.getbit(c, F.lit(level)).cast("int")
    corners = F.array(*(sum(bit(c, level) * (1 << (n - 1 - i)) for i, c in enumerate(coordinates)) for level in range(bits - 1, -1, -1)))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("h"))

    def step(acc, c):
        found = F.get(steps, acc["state"] * (1 << n) + c)
        return F.struct(F.shiftright(found, n).alias("state"), (acc["h"] * (1 << n) + found.bitwiseAND((1 << n) - 1)).alias("h"))

    return F.aggregate(corners, start, step, lambda acc: acc["h"])


def by_depth(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """``column, at``: the place of each value among all rows in the values' order, in ``2**bits`` steps. A row per value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    upto = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(column, (2 * F.coalesce(F.sum("n").over(upto), F.lit(0)) + F.col("n")).alias("twice_middle"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return settle(counts.select(column, F.expr(f"(twice_middle * {1 << bits}) div (2 * total)").cast("int").alias("at")), "depth")


def points(docs: DataFrame, bits: int = 8) -> DataFrame:
    """``row`` (all columns of ``docs``), ``doc_id, size, crc, uid`` and ``h``, the place on the curve by source, language and size.

    Source and language are quantised by depth, the size (bytes of the text and 1)
    by eighths of a power of two. Null is a value of its own; a null text has no bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(c)))
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
        named("source").alias("of_source"), named("lang").alias("of_lang"), F.monotonically_increasing_id().alias("uid"),
    )
    for c in ("of_source", "of_lang"):
        places = by_depth(rows.select(c), c, bits).withColumnRenamed("at", f"{c}_at")
        rows = rows.join(places, c)
    eighths = F.least(F.lit((1 << bits) - 1), F.floor(F.log2("size") * 8).cast("int"))
    return rows.select("row", "doc_id", "size", "crc", "uid", index([F.col("of_source_at"), F.col("of_lang_at"), eighths], bits).alias("h"))


def along_curve(docs: DataFrame, bits: int = 8) -> DataFrame:
    """The rows of ``docs`` range-partitioned and sorted along the curve: written as files, each has narrow ranges in all dimensions."""
    return _sorted(points(docs, bits)).select("row.*")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("h", "doc_id", "uid").sortWithinPartitions("h", "doc_id", "uid")


def shards(docs: DataFrame, number: int = 8, bits: int = 8) -> DataFrame:
    """Cuts the curve into ``number`` runs whose row counts are at most one apart: ``doc_id, size, text_crc32, shard, slot``.

    A row's place is its place in its range partition and the rows of the partitions
    before (one row per partition), so no window holds more than that. Rows that
    repeat are apart by their scan number, so a third of them alike is cut like any other run.
    """
    rows = _sorted(points(docs.select("doc_id", "text", "lang", "source"), bits).drop("row"))
    rows = settle(rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.monotonically_increasing_id().alias("place")), "curve")
    rows = rows.withColumns({"part": F.shiftright("place", 33), "nth": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rows = rows.join(settle(counts, "parts"), "part").withColumn("rank", F.col("before") + F.col("nth"))
    rows = rows.withColumn("shard", F.expr(f"(rank * {number}) div total"))
    return rows.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.expr(f"rank - (shard * total + {number - 1}) div {number}").alias("slot"))
