"""Rates implied by clusters of fixed-price payouts (AGG17)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.session import settle

BINS = 4096


def group_median(values: DataFrame, keys: Sequence[str], place: Column, levels: int = 2) -> DataFrame:
    """Exact median of ``val`` counted ``n`` times, per ``keys``, with the count.

    ``place`` is a number in [0, 1) that grows with ``val``. Counts per bin of
    ``place`` show which bin holds the middle, counts per part of that bin which
    part does, ``levels`` times; only that part is ordered, so neither a large
    group nor amounts that lie close together are gathered in one task.
    """
    keys = list(keys)
    rows = values.withColumns({"place": place, "bin0": F.lit(0).cast("long")})
    middle = rows.groupBy(*keys, "bin0").agg(F.sum("n").alias("total")).select(
        *keys, "bin0", F.lit(0).cast("long").alias("before"), "total",
        F.expr("(total - 1) div 2").alias("lo_rank"), F.expr("total div 2").alias("hi_rank"),
    )
    kept = ["total", "lo_rank", "hi_rank"]
    for level in range(1, levels + 1):
        above, bin_ = f"bin{level - 1}", f"bin{level}"
        rows = rows.withColumn(bin_, F.floor(F.col("place") * float(BINS) ** level))
        counts = rows.join(middle, [*keys, above]).groupBy(*keys, above, bin_, "before", *kept).agg(F.sum("n").alias("in_bin"))
        upto = F.sum("in_bin").over(W.partitionBy(*keys, above).orderBy(bin_))
        counts = counts.withColumn("before", F.col("before") + upto - F.col("in_bin"))
        holds = [(F.col("before") <= F.col(r)) & (F.col(r) < F.col("before") + F.col("in_bin")) for r in ("lo_rank", "hi_rank")]
        middle = settle(counts.filter(holds[0] | holds[1]).select(*keys, bin_, "before", *kept), "median_bins")
    last = f"bin{levels}"
    inside = rows.join(middle, [*keys, last])
    picked = inside.withColumn("end", F.col("before") + F.sum("n").over(W.partitionBy(*keys, last).orderBy("val")))

    def value_at(rank: str) -> Column:
        return F.max(F.when((F.col("end") - F.col("n") <= F.col(rank)) & (F.col(rank) < F.col("end")), F.col("val")))

    return picked.groupBy(*keys).agg(
        F.max("total").alias("seeds"), ((value_at("lo_rank") + value_at("hi_rank")) / 2).alias("median")
    )


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _day_rate(amounts: Column, ref: Column, notional: float, factor: float, min_seeds: int) -> Column:
    """The rate that a day's sorted ``amounts`` (``val, n, upto``) imply, judged by ``ref``; null without enough seeds."""

    def middle(seeds: Column) -> Column:
        before, last = seeds[0]["upto"] - seeds[0]["n"], F.element_at(seeds, -1)["upto"]
        at = lambda rank: F.get(F.filter(seeds, lambda s: s["upto"] > before + rank), F.lit(0))["val"]
        n = last - before
        return F.when(n >= min_seeds, F.lit(2 * notional) / (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))))

    def seeds(target: Column) -> Column:
        return F.filter(amounts, lambda a: (a["val"] > target / factor) & (a["val"] < target * factor))

    found = _bound(F.lit(notional) / ref, lambda target: _bound(seeds(target), lambda s: F.when(F.size(s) > 0, middle(s))))
    return F.when(ref.isNotNull() & (ref != 0), found)


def _walk(days: Column, start: Column, notional: float, factor: float, min_seeds: int) -> Column:
    """``ref`` after a slice's days, newest first, and the ``rates`` on the way."""

    def step(state: Column, day: Column) -> Column:
        rate = F.coalesce(day["kept"], _day_rate(day["amounts"], state["ref"], notional, factor, min_seeds))
        return _bound(rate, lambda r: F.struct(
            F.coalesce(r, state["ref"]).alias("ref"),
            F.concat(state["rates"], F.array(F.struct(day["day"].alias("day"), day["kept"].alias("kept"), r.alias("rate")))).alias("rates"),
        ))

    return F.aggregate(days, F.struct(start.alias("ref"), F.array().cast(RATES).alias("rates")), step)


RATES = "array<struct<day:date,kept:double,rate:double>>"
#: What a day without amounts would count in a slice, so that a slice's days are bounded as well.
DAY_COST = 32


def sliced_days(amounts: DataFrame, days: DataFrame, slice_amounts: int) -> DataFrame:
    """``days`` with ``newest``, the first day of its slice, and ``large``.

    A slice is a run of an asset's days, newest first, with about ``slice_amounts``
    different amounts. A day above that is ``large`` and a slice of its own.
    """
    sizes = amounts.groupBy("asset", "day").agg((F.count("*") + DAY_COST).alias("size"))
    back = W.partitionBy("asset").orderBy(F.col("day").desc())
    rows = days.join(sizes, ["asset", "day"]).withColumn("large", F.col("size") > slice_amounts)
    own = F.when(F.col("large"), 0).otherwise(F.col("size"))
    rows = rows.withColumns({"turn": F.floor((F.sum(own).over(back) - own) / slice_amounts), "larges": F.sum(F.col("large").cast("int")).over(back)})
    of = W.partitionBy("asset", "turn", "larges", "large")
    return settle(rows.withColumn("newest", F.max("day").over(of)).drop("turn", "larges", "size"), "days")


def _large_rates(amounts: DataFrame, due: DataFrame, notional: float, factor: float, min_seeds: int) -> DataFrame:
    """``asset, newest, rate`` of days that are slices of their own, by counts per bin."""
    target = F.lit(notional) / F.col("start")
    windows = due.select("asset", F.col("newest").alias("day"), (target / factor).alias("low"), (target * factor).alias("high"))
    seeds = amounts.join(windows, ["asset", "day"]).filter((F.col("val") > F.col("low")) & (F.col("val") < F.col("high")))
    place = F.log(F.col("val") / F.col("low")) / F.log(F.col("high") / F.col("low"))
    medians = group_median(seeds, ["asset", "day"], place).filter(F.col("seeds") >= min_seeds)
    return medians.select("asset", F.col("day").alias("newest"), (F.lit(notional) / F.col("median")).alias("found"))


def _rounds(amounts: DataFrame, days: DataFrame, slice_amounts: int, *rule: float) -> tuple[DataFrame, int]:
    """Rates of all days, and the rounds it took: all slices at once from assumed starts, those whose start moved again, until none does."""
    days = sliced_days(amounts, days, slice_amounts)
    upto = F.sum("n").over(W.partitionBy("asset", "day").orderBy("val"))
    of_day = amounts.join(days.filter("not large").select("asset", "day"), ["asset", "day"]).withColumn("upto", upto)
    of_day = of_day.groupBy("asset", "day").agg(F.sort_array(F.collect_list(F.struct("val", "n", "upto"))).alias("amounts"))
    digest = days.filter("not large").join(of_day, ["asset", "day"])
    one = F.struct("day", "kept", "amounts")
    digest = digest.groupBy("asset", "newest").agg(F.sort_array(F.collect_list(one), asc=False).alias("days"))
    digest = settle(digest, "digest")
    has_large = not days.filter("large").isEmpty()

    back = W.partitionBy("asset").orderBy(F.col("newest").desc())
    slices = days.groupBy("asset", "newest", "large", "live").agg(F.max_by("kept", "day").alias("kept"))
    state = slices.select("*", F.col("live").alias("start"), F.lit(True).alias("stale"), F.lit(None).cast("double").alias("end"), F.lit(None).cast(RATES).alias("rates"))
    rounds = 0
    while rounds == 0 or not state.filter("stale").isEmpty():
        rounds += 1
        due = state.filter("stale")
        walked = due.filter("not large").select("asset", "newest", "start").join(digest, ["asset", "newest"])
        results = walked.select("asset", "newest", _walk(F.col("days"), F.col("start"), *rule).alias("w"))
        if has_large:
            alone = due.filter("large").select("asset", "newest", "start", F.col("kept").alias("was"))
            alone = alone.join(_large_rates(amounts, alone.filter("was is null"), *rule), ["asset", "newest"], "left")
            rate = F.coalesce("was", "found")
            made = F.array(F.struct(F.col("newest").alias("day"), F.col("was").alias("kept"), rate.alias("rate"))).cast(RATES)
            results = results.unionAll(alone.select("asset", "newest", F.struct(F.coalesce(rate, "start").alias("ref"), made.alias("rates"))))
        ran = state.join(results, ["asset", "newest"], "left")
        ran = ran.withColumns({"end": F.when(F.col("stale"), F.col("w.ref")).otherwise(F.col("end")), "rates": F.when(F.col("stale"), F.col("w.rates")).otherwise(F.col("rates"))})
        later = F.lag(F.struct("end")).over(back)
        ran = ran.drop("w", "stale").withColumn("next", F.when(later.isNull(), F.col("live")).otherwise(later["end"]))
        state = settle(ran.withColumn("stale", ~F.col("next").eqNullSafe(F.col("start"))).drop("start").withColumnRenamed("next", "start"), "implied")
    return state.select("asset", F.explode("rates").alias("r")).select("asset", "r.*").filter("rate is not null"), rounds


def implied_rates(
    ledger: DataFrame,
    ref: DataFrame,
    persisted: DataFrame | None = None,
    as_of: datetime | None = None,
    notional: float = 0.10,
    factor: float = 2.5,
    min_seeds: int = 5,
    slice_amounts: int = 100_000,
) -> DataFrame:
    """AGG17: ``(asset, day, rate, is_open)`` for days with enough fixed-price payouts.

    ``ref`` is ``(asset, rate)``; ``persisted`` is ``(asset, day, rate)`` and
    never changes. A day's seeds are the amounts near ``notional`` priced at the
    nearest later day's rate, so each day depends on the one after it.

    Amounts are first counted per asset, day and value. Runs of days with about
    ``slice_amounts`` values are walked day by day, all runs at once from an assumed
    rate, then those whose later neighbour ended at another one again, until none is
    left. Each round makes at least one more run final, counted from the newest, and
    the only point where nothing moves is the sequential answer. An asset whose days
    fit in one run takes one round. A day with more values is a run of its own, its median found from
    counts per bin. An asset without a reference rate has
    rates from its first persisted day on, going back.
    """
    amounts = settle(ledger.groupBy("asset", "day", "val").agg(F.count("*").alias("n")), "amounts")
    known = ref.select("asset", F.col("rate").alias("live"))
    days = amounts.select("asset", "day").distinct().join(known, "asset", "left")
    if persisted is None:
        days = days.withColumn("kept", F.lit(None).cast("double"))
    else:
        days = days.join(persisted.select("asset", "day", F.col("rate").alias("kept")), ["asset", "day"], "left")
    found, _ = _rounds(amounts, days, slice_amounts, notional, factor, min_seeds)
    is_open = F.lit(False) if as_of is None else F.col("day") == F.lit(as_of.date())
    return found.select(
        "asset", "day", F.round("rate", 10).alias("rate"), (is_open & F.col("kept").isNull()).alias("is_open")
    )
