"""Mixing sources to target weights on a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1. Its integral, scaled
to the source's target, is the source's cumulative demand in words; the inverse
gives every copy of a document the time at which the mix reaches its first word.
Sorting by that time is the training order.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.session import settle

#: Word count of a text as the contracts define words.
WORD = r"[^\x20\x09-\x0D]+"
AT_MOST = 3


@dataclass(frozen=True)
class Schedule:
    """Weight of a source over time: straight lines through ``(time, weight)`` knots from time 0 to 1, weights above 0.

    ``of`` picks the knots by the source's place in code point order, repeating.
    """

    knots: tuple[tuple[tuple[float, float], ...], ...] = (
        ((0.0, 1.0), (1.0, 1.0)),
        ((0.0, 1.5), (0.6, 1.0), (1.0, 0.5)),
        ((0.0, 0.5), (0.4, 1.0), (1.0, 1.5)),
    )


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``key, source, source_size`` per source to ``key, source, place, source_size, target``.

    Sources weigh 1, 2, 3, repeating in code point order, null last, and share the
    total; no target is above three times its source's size, and what that frees is
    shared by weight again. The limits bind for the smallest ratios of limit to
    weight, so the level of the others is the largest of the levels found by
    taking the limits one after another in that order. One row per source.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.select("key", "source", "source_size", (F.row_number().over(order) - 1).alias("place"))
    rows = rows.select("*", (F.col("place") % 3 + 1).alias("weight"), (AT_MOST * F.col("source_size")).alias("most"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weigh = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.select("*", (left / weigh).alias("level"))
    rows = rows.select("*", F.max("level").over(everything).alias("top"))
    return rows.select("key", "source", "place", "source_size", F.least(F.col("most").cast("double"), F.col("top") * F.col("weight")).alias("target"))


def time_of(share: Column, place: Column, schedule: Schedule) -> Column:
    """The time at which a schedule has used ``share`` (0 to 1) of its integral."""

    def inverse(knots):
        area, pieces = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            pieces.append((area, t0, w0, (w1 - w0) / (t1 - t0)))
            area += (w0 + w1) / 2 * (t1 - t0)
        need, found = share * area, None
        for start, t0, w0, slope in pieces:  # w0 * d + slope * d * d / 2 = need - start
            rest = F.greatest(need - start, F.lit(0.0))
            within = t0 + 2 * rest / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))))
            found = within if found is None else F.when(need >= start, within).otherwise(found)
        return F.least(found, F.lit(1.0))

    kinds, chosen = len(schedule.knots), None
    for i, knots in enumerate(schedule.knots):
        chosen = inverse(knots) if chosen is None else F.when(place % kinds == i, inverse(knots)).otherwise(chosen)
    return chosen


def _lean(docs: DataFrame, slices: int, *carried: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    turn = F.xxhash64("doc_id", F.crc32(text))
    n = slices * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leading = F.shiftright((F.shiftright(turn, 32) + 2**31) * F.lit(n).cast("long"), 32).cast("int")  # slices in the order of the hash, whatever their number
    key = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source"))
    return docs.select(
        *carried, F.col("doc_id").alias("id"), F.col("source").alias("source"), key.alias("key"), words(F.col("text")).alias("size"),
        turn.alias("turn"), leading.alias("slice"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Each row's place in its source's slice and the words up to and with it."""
    order = Window.partitionBy("key", "slice").orderBy("turn", "size")
    rows = rows.withColumns({"nth": F.row_number().over(order), "stop": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rows


def _starts(numbered: DataFrame) -> DataFrame:
    """One row per source and slice: what comes before it, the source's target, and how many copies its documents get."""
    sums = settle(numbered.groupBy("key", "source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    sources = sums.groupBy("key", "source").agg(F.sum("slice_size").alias("source_size"))
    aims = settle(targets(sources), "targets")
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))).drop("source", "slice_size")
    starts = starts.join(aims.drop("source"), "key")
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")
    starts = starts.withColumn("whole", whole)
    return settle(starts.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "starts")


def _limited(numbered: DataFrame, starts: DataFrame) -> DataFrame:
    """With each row, whether it takes a share of the rest: its size is at most the gap at the last step before it."""
    rows = numbered.join(starts, ["key", "slice"])
    limit = F.aggregate("steps", F.col("limit"), lambda now, s: F.when(s["nth"] <= F.col("nth"), s["limit"]).otherwise(now))
    return rows.withColumn("fits", (F.col("size") <= limit) & (F.col("whole") < AT_MOST))


def _placed(numbered: DataFrame, starts: DataFrame) -> DataFrame:
    """With each row, the words of its source before it: of all, and of those that fit."""
    rows = _limited(numbered, starts).withColumn("begin", F.col("before") + F.col("stop") - F.col("size"))
    order = Window.partitionBy("key", "slice").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(order), F.lit(0))
    return rows.withColumn("filled", F.col("begun") + earlier)


STEP = "struct<slice:int,nth:int,limit:bigint>"


def _walked(docs: Column, gap: Column, limit: Column) -> Column:
    """Takes the documents of an ordered array as they fit into a gap: what is left of it, and a step for each that was too large."""

    def walk(now, doc):
        fits, too_large = doc["size"] <= now["gap"], (doc["size"] > now["gap"]) & (doc["size"] <= now["limit"])
        step = F.array(F.struct(doc["slice"].alias("slice"), doc["nth"].alias("nth"), now["gap"].alias("limit")).cast(STEP))
        return F.struct(
            F.when(fits, now["gap"] - doc["size"]).otherwise(now["gap"]).alias("gap"), F.when(too_large, now["gap"]).otherwise(now["limit"]).alias("limit"),
            F.when(too_large, F.concat(now["steps"], step)).otherwise(now["steps"]).alias("steps"),
        )

    none = F.array().cast(f"array<{STEP}>")
    return F.aggregate(docs, F.struct(gap.alias("gap"), limit.alias("limit"), none.alias("steps")), walk)


def _filled(numbered: DataFrame, starts: DataFrame, at_once: int) -> DataFrame:
    """Adds to ``starts`` which documents fill the rest of a source's target, going through them in order and leaving out what does not fit.

    All that fit into the gap are taken up to the document where their running size
    crosses it: a sum per slice finds the slice, a running sum within it the document. From there the walk takes
    ``at_once`` of them one by one; then the same begins behind them with what is
    left of the gap, until no untaken document fits.
    """
    rows = numbered.filter("size > 0").select("key", "slice", "nth", "size")
    whole_gap = F.when(F.col("whole") < AT_MOST, F.greatest(F.floor("rest"), F.lit(0))).otherwise(0).cast("long")
    none = F.array().cast(f"array<{STEP}>")
    state = settle(starts.select("key", F.lit(-1).alias("at"), F.lit(0).alias("at_nth"), whole_gap.alias("gap"), none.alias("steps")).distinct(), "gaps")
    past, order = [state], Window.partitionBy("key").orderBy("slice")
    upto = Window.partitionBy("key").orderBy("slice", "nth").rowsBetween(Window.unboundedPreceding, 0)
    behind = "slice > at or slice = at and nth > at_nth"
    while True:
        open_ = rows.join(state.select("key", "at", "at_nth", "gap"), "key").filter(behind).filter("size <= gap")
        sums = open_.groupBy("key", "gap", "at", "at_nth", "slice").agg(F.sum("size").alias("n_words"), F.count("*").alias("n"))
        sums = sums.withColumn("sofar", F.sum("n_words").over(order)).filter("sofar > gap")
        ahead = F.sum("n").over(order) - F.col("n") - F.first("n").over(order)
        sums = sums.withColumns({"ahead": ahead, "first": F.first(F.col("gap") - F.col("sofar") + F.col("n_words")).over(order)})
        walks = settle(sums.filter(F.col("ahead") < at_once).select("key", "slice", "at", "at_nth", "first"), "walks")
        of = rows.join(walks, ["key", "slice"]).filter(behind).filter("size <= first")
        of = of.withColumn("run", F.sum("size").over(upto)).withColumn("crossed", F.count_if(F.col("run") > F.col("first")).over(upto))
        doc = F.struct("slice", "nth", "size")
        of = of.groupBy("key").agg(
            F.sum(F.when(F.col("crossed") == 0, F.col("size"))).alias("taken"),
            F.sort_array(F.collect_list(F.when((F.col("crossed") > 0) & (F.col("crossed") <= at_once), doc))).alias("docs"),
            (F.max("crossed") > at_once).alias("more"),
        )
        of = walks.groupBy("key", "at", "at_nth", "first").agg(F.min("slice").alias("from"), F.max("slice").alias("to")).join(of, "key", "left")
        of = of.withColumn("docs", F.coalesce("docs", F.array().cast("array<struct<slice:int,nth:int,size:bigint>>")))
        of = of.withColumn("end", _walked(F.col("docs"), F.col("first") - F.coalesce("taken", F.lit(0)), F.col("first")))
        last = F.when(F.col("more"), F.element_at("docs", -1)).otherwise(F.struct(F.col("to").alias("slice"), F.lit(2**31 - 2).alias("nth"), F.lit(0).cast("long").alias("size")))
        begin = F.struct("from", F.when(F.col("from") == F.col("at"), F.col("at_nth") + 1).otherwise(0).alias("nth"), F.col("first").alias("limit")).cast(STEP)
        of = of.withColumn("last", last)
        end = F.array(F.struct("last.slice", F.col("last.nth") + 1, F.col("end.gap")).cast(STEP), F.struct(F.col("last.slice") + 1, F.lit(0), F.col("end.gap")).cast(STEP))
        steps = F.concat(F.array(begin), "end.steps", end).alias("steps")
        state = settle(of.select("key", F.col("last.slice").alias("at"), F.col("last.nth").alias("at_nth"), F.col("end.gap").alias("gap"), steps), "gaps")
        if state.isEmpty():
            break
        past.append(state)
    steps = functools.reduce(DataFrame.unionAll, (s.select("key", F.lit(i).alias("i"), "gap", "steps") for i, s in enumerate(past)))
    steps = steps.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "gap", "steps"))).alias("all"))
    steps = steps.select("key", F.col("all")[0]["gap"].alias("whole_gap"), F.flatten("all.steps").alias("all"))
    starts = starts.join(steps, "key")
    earlier = F.filter("all", lambda s: s["slice"] < F.col("slice"))
    starts = starts.withColumn("limit", F.coalesce(F.get(earlier, F.size(earlier) - 1)["limit"], "whole_gap"))
    starts = settle(starts.withColumn("steps", F.filter("all", lambda s: s["slice"] == F.col("slice"))).drop("all", "whole_gap"), "limits")
    used = _limited(numbered, starts).groupBy("key", "slice").agg(F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("used"))
    begun = used.select("key", "slice", F.coalesce(F.sum("used").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begun"))
    return settle(starts.join(begun, ["key", "slice"]), "starts")


def _decided(rows: DataFrame, schedule: Schedule) -> DataFrame:
    copies = F.col("whole") + F.when(F.col("fits"), 1).otherwise(0)
    rows = rows.withColumns({"copies": copies, "taken": copies * F.col("size")})

    def at(k: Column) -> Column:
        offset = k * F.col("source_size") + F.when(k < F.col("whole"), F.col("begin")).otherwise(F.col("filled"))
        return time_of(F.coalesce(F.try_divide(offset, "target"), F.lit(0.0)), F.col("place"), schedule)

    none = F.array().cast("array<double>")
    return rows.withColumn("times", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(none))


def plan(docs: DataFrame, schedule: Schedule = Schedule(), slices: int = 8, at_once: int = 256) -> tuple[DataFrame, DataFrame]:
    """One row per document, ``doc_id, source, size, source_size, target, copies, taken, times``; and what :func:`training_order` needs.

    A source whose target is r times its size gives every document floor(r) copies.
    The rest of the target takes whole documents in the order of a hash; one that does
    not fit is left out and the next ones go on. So a document has three copies at
    most, and a source misses less words than its smallest document that was left
    out has. ``times`` has the training time of each copy.

    A document's place in its source is the running size in its slice of hash
    values, cut by their leading bits (a window), after that of the slices before (a row per source and slice;
    ``slices`` times the shuffle partitions of them). So a source with most of all
    rows is spread over all tasks. Null sources are one source; documents without
    words (null, empty) take 0; repeated rows may trade their copies.
    """
    numbered = settle(_numbered(_lean(docs, slices)), "numbered")
    starts = _filled(numbered, _starts(numbered), at_once)
    rows = _decided(_placed(numbered, starts), schedule)
    return rows.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", "taken", "times"), starts


def training_order(docs: DataFrame, schedule: Schedule = Schedule(), slices: int = 8, at_once: int = 256) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-partitioned and sorted by training time.

    Same columns as ``docs``. The whole rows are shuffled twice: to their slice and to their time.
    """
    _, starts = plan(docs, schedule, slices, at_once)
    rows = _numbered(_lean(docs, slices, F.struct("*").alias("row")))
    rows = _decided(_placed(rows, starts), schedule).select("row", "turn", F.explode("times").alias("time"))
    return rows.repartitionByRange("time", "turn").sortWithinPartitions("time", "turn").select("row.*")
