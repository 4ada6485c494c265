import math
import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyflow.operators import implied, quotemaps
from tallyflow.operators import quotes as q
from tallyflow.operators.implied import implied_rates
from tallyflow.operators.rates import asof_rate, day_rate, market_deviation
from tests.conftest import T0, by, one

RATES = "asset string, day date, rate double"


def day(n):
    return date(2024, 1, n)


def test_asof_sources(spark, ledger):
    rows = ledger([("OUT", 86400 * (d - 1), a, 2, "x") for a in "TUV" for d in (1, 5, 6, 9, 12, 13)])
    rates = spark.createDataFrame([("T", day(5), 1.0), ("T", day(9), 3.0), ("U", day(6), 7.0)], RATES)
    opening = spark.createDataFrame([("T", day(12), 4.0)], RATES)
    live = spark.createDataFrame([("T", 99.0), ("V", 8.0)], "asset string, rate double")
    got = {(r.asset, r.day.day): (r.rate, r.rate_src, r.usd) for r in asof_rate(rows, rates, opening, live).collect()}
    assert len(got) == 18
    implied, opened, forward, back, market = "day-implied", "day-implied (open)", "carry-forward", "carry-back", "live"
    want = {
        ("T", 1): (1.0, back), ("T", 5): (1.0, implied), ("T", 6): (1.0, forward), ("T", 9): (3.0, implied), ("T", 12): (4.0, opened), ("T", 13): (3.0, forward),
        ("U", 1): (7.0, back), ("U", 5): (7.0, back), ("U", 6): (7.0, implied), ("U", 9): (7.0, forward), ("U", 12): (7.0, forward), ("U", 13): (7.0, forward),
        ("V", 1): (8.0, market), ("V", 5): (8.0, market), ("V", 6): (8.0, market), ("V", 9): (8.0, market), ("V", 12): (8.0, market), ("V", 13): (8.0, market),
    }
    assert got == {k: (rate, source, 2 * rate) for k, (rate, source) in want.items()}


def test_asof_leaves_the_ledger_unshuffled(spark, ledger):
    rates = spark.createDataFrame([("T", day(5), 1.0)], RATES)
    plan = asof_rate(ledger([("OUT", 0, "T", 2, "x")]), rates)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_day_rate_treats_zero_as_missing(spark, ledger):
    rates = spark.createDataFrame([("T", day(1), 0.0), ("T", day(2), 5.0)], RATES)
    got = by(day_rate(ledger([("OUT", 86400 * d, "T", 1, "x") for d in range(3)]), rates, 0.001), "day")
    assert [got[day(d)]["rate"] for d in (1, 2, 3)] == [0.001, 5.0, 0.001]


def test_market_deviation_takes_the_upper_median(spark):
    rates = spark.createDataFrame([("T", day(i + 1), 100.0 + i) for i in range(4)], RATES)
    market = spark.createDataFrame([("T", day(i + 1), 100.0) for i in range(4)], "asset string, day date, close double")
    assert one(market_deviation(rates, market, pct=2)) == {"asset": "T", "n": 4, "within": 3, "median_dev": 2.0, "max_dev": 3.0}


def test_implied_rates_by_hand(spark, ledger):
    """Notional 0.10, factor 2.5: at rate r the seeds lie between 0.04 / r and 0.25 / r."""
    days = {
        ("T", 12): [8, 9, 10, 11, 12, 4, 25],  # r 0.01: 4 and 25 are outside; median 10
        ("T", 11): [5, 5, 5, 6, 6, 100],  # r 0.01: median 5
        ("T", 10): [2.5] * 5 + [20] * 5,  # r 0.02: 2 to 12.5, median 2.5
        ("T", 9): [2.5] * 4,  # too few
        ("T", 8): [1.25] * 3 + [2] * 3,  # r 0.04: median 1.625
        ("U", 7): [5] * 9,  # kept
        ("U", 6): [0.1 / 0.018] * 3 + [6] * 2,  # r 0.018
        ("W", 5): [10] * 9,  # no reference rate
        ("Z", 4): [10] * 9,  # none either, but kept on that day
        ("Z", 3): [0.1 / 0.02] * 5,
    }
    frame = ledger([("OUT", 86400 * (d - 1), a, v, "x") for (a, d), vs in days.items() for v in vs])
    ref = spark.createDataFrame([("T", 0.01), ("U", 0.02)], "asset string, rate double")
    kept = spark.createDataFrame([("U", day(7), 0.018), ("T", day(30), 5.0), ("Z", day(4), 0.019)], RATES)
    got = implied_rates(frame, ref, kept, as_of=datetime(2024, 1, 12, 5)).collect()
    want = {("T", 12): 0.01, ("T", 11): 0.02, ("T", 10): 0.04, ("T", 8): 0.1 / 1.625, ("U", 7): 0.018, ("U", 6): 0.018, ("Z", 4): 0.019, ("Z", 3): 0.02}
    assert {(r.asset, r.day.day): r.rate for r in got} == pytest.approx(want)
    assert {(r.asset, r.day.day) for r in got if r.is_open} == {("T", 12)}


def test_amounts_that_fall_in_one_bin_keep_their_order(spark, ledger):
    amounts = [10 + i * 1e-9 for i in range(999)]
    frame = ledger([("OUT", 0, "T", v, "x") for v in random.Random(2).sample(amounts, 999)])
    ref = spark.createDataFrame([("T", 0.01)], "asset string, rate double")
    (row,) = implied_rates(frame, ref).collect()
    assert row.rate == round(0.1 / amounts[499], 10)


def test_each_day_may_move_the_next(spark, ledger):
    frame = ledger([("OUT", 86400 * (20 - k), "T", 10.0 * 2**k, "x") for k in range(20) for _ in range(5)])
    got = implied_rates(frame, spark.createDataFrame([("T", 0.01)], "asset string, rate double")).collect()
    assert {r.day.day: r.rate for r in got} == pytest.approx({21 - k: round(0.01 / 2**k, 10) for k in range(20)})


def in_turn(rows, ref, kept):
    """Day by day from the newest, with the median of sorted seeds."""
    out = {}
    for asset in {a for _, _, a, _, _ in rows}:
        rate = ref.get(asset)
        for d in sorted({s // 86400 for _, s, a, _, _ in rows if a == asset}, reverse=True):
            if (asset, d) in kept:
                rate = out[asset, d] = kept[asset, d]
            elif rate:
                seeds = sorted(v for _, s, a, v, _ in rows if (a, s // 86400) == (asset, d) and 0.1 / rate / 2.5 < v < 0.1 / rate * 2.5)
                if len(seeds) >= 5:
                    rate = out[asset, d] = 0.1 / statistics.median(seeds)
    return {k: round(v, 10) for k, v in out.items()}


@pytest.mark.parametrize("slice_amounts", [1, 45, 110, 20_000])
def test_implied_rates_do_not_depend_on_the_slices(spark, ledger, slice_amounts):
    rnd = random.Random(6)
    rows = [("OUT", 86400 * d, a, round(10 * 1.6 ** rnd.randint(0, d % 9) * rnd.uniform(0.7, 1.4), 3), "x") for a in "TUVW" for d in range(24) for _ in range(rnd.choice([3, 9, 30, 60]))]
    ref, kept = {"T": 0.01, "U": 0.002, "V": 0.01}, {("U", 7): 0.004, ("W", 20): 0.01, ("T", 0): 0.5}
    frames = spark.createDataFrame(list(ref.items()), "asset string, rate double"), spark.createDataFrame([(a, day(d + 1), r) for (a, d), r in kept.items()], RATES)
    got = implied_rates(ledger(rows), *frames, slice_amounts=slice_amounts).collect()
    assert {(r.asset, r.day.day - 1): r.rate for r in got} == pytest.approx(in_turn(rows, ref, kept))


def test_a_slice_walks_its_days_in_one_round(spark, ledger):
    rows = ledger([("OUT", 86400 * (20 - k), "T", 10.0 * 2**k, "x") for k in range(20) for _ in range(5)])
    amounts = rows.groupBy("asset", "day", "val").agg(F.count("*").alias("n"))
    days = amounts.select("asset", "day", F.lit(0.01).alias("live"), F.lit(None).cast("double").alias("kept"))
    rounds = {size: implied._rounds(amounts, days, size, 0.1, 2.5, 5)[1] for size in (20_000, 200, 66)}
    assert rounds[20_000] == 1 and rounds[200] <= 5 and rounds[66] <= 11


def frame_of(spark, feeds):
    rows = [(a, T0 + timedelta(seconds=60 * i), f"{i:04}", p, f) for a, feed in feeds.items() for i, (p, f) in enumerate(feed)]
    return spark.createDataFrame(rows, "asset string, ts timestamp_ntz, key string, price double, fallback double")


def test_quotes_by_hand(spark):
    feed = [
        (1.0, None), (1.5, None), (9.0, None), (1.2, None), (None, None), (1.3, None), (5.0, None), (6.5, None), (0.0, 1.1), (1.0, None),
    ]
    want = [  # rate, source, anchor afterwards
        (1.0, "primary", 1.0), (1.5, "primary", 1.5), (1.5, "last-accepted", 1.5), (1.2, "primary", 1.5), (1.5, "last-accepted", 1.5),
        (1.3, "primary", 1.3), (5.0, "primary", 1.3), (1.3, "last-accepted", 1.3), (1.1, "secondary", 1.1), (1.0, "primary", 1.1),
    ]
    start = spark.createDataFrame([("U", 1.0)], "asset string, anchor double")
    for rows_per_slice in (2, 10_000):
        got = q.validate_quotes(frame_of(spark, {"U": feed, "X": feed[:2]}), start, rows_per_slice=rows_per_slice).orderBy("asset", "key").collect()
        assert [(r.rate, r.source, r.anchor) for r in got if r.asset == "U"] == want
        assert [(r.rate, r.source, r.anchor) for r in got if r.asset == "X"] == [(None, "no-anchor", None)] * 2


def test_quotes_are_the_same_in_slices_of_any_length(spark):
    rnd = random.Random(5)
    feed = [(rnd.choice([None, 0.0, 10.0 * rnd.lognormvariate(0, 1)]), rnd.choice([None, 10.0 * rnd.lognormvariate(0, 0.7)])) for _ in range(120)]
    start = spark.createDataFrame([("T", 10.0)], "asset string, anchor double")
    runs = [q.validate_quotes(frame_of(spark, {"T": feed}), start, rows_per_slice=n).orderBy("key").collect() for n in (7, 50, 10_000)]
    assert runs[0] == runs[1] == runs[2]


def test_quotes_take_rounds_by_the_logarithm_of_slices(spark):
    feed = [(10.0, None), (11.0, None)] + [(None, None)] * 60 + [(12.0, None), (None, 13.0)]
    start = spark.createDataFrame([("T", 10.0)], "asset string, anchor double")
    frame = frame_of(spark, {"T": feed})
    want = q.validate_quotes(frame, start).orderBy("key").collect()
    assert q.validate_quotes(frame, start, rows_per_slice=2, fan=3).orderBy("key").collect() == want
    maps = []
    for row in q.sliced(frame, 2).select("slice").distinct().collect():
        maps.append(("T", row.slice, None, [True, False], [-math.inf] * 2, [math.inf] * 2, [None, None], [None, None]))
    states = start.selectExpr("asset", "anchor", "CAST(NULL AS DOUBLE) AS pending", "false AS accepted")
    starts, rounds = q._slice_starts(spark.createDataFrame(maps, q._MAP), states, 2, 2)
    assert starts.count() == 32 and rounds <= 2 * 5


def test_quotes_of_one_second_are_cut_too(spark):
    rnd = random.Random(6)
    rows = [("T", T0 + timedelta(microseconds=i // 3), f"{i:04}", rnd.lognormvariate(2, 0.8), None) for i in range(300)]
    frame = spark.createDataFrame(rows, "asset string, ts timestamp_ntz, key string, price double, fallback double")
    start = spark.createDataFrame([("T", 10.0)], "asset string, anchor double")
    sizes = [r["count"] for r in q.sliced(frame, 7).groupBy("slice").count().collect()]
    assert sum(sizes) == 300 and max(sizes) < 14
    runs = [q.validate_quotes(frame, start, rows_per_slice=n).orderBy("key").collect() for n in (7, 1000)]
    assert runs[0] == runs[1] and len(runs[0]) == 300
    none = q.validate_quotes(frame.limit(0), start)
    assert none.count() == 0 and none.columns == ["asset", "ts", "key", "price", "rate", "source", "anchor"]


VALUES = st.one_of(st.none(), st.sampled_from([0.0, -1.0, 0.2, 0.5, 1.0, 2.0, 5.0, 25.0]), st.floats(0.01, 100))
QUOTES = st.lists(st.tuples(VALUES, VALUES), max_size=12)


@settings(max_examples=300, deadline=None)
@given(QUOTES, st.integers(0, 12), VALUES, VALUES, st.booleans())
def test_a_map_says_what_the_walk_does_from_any_state(quotes, cut, anchor, pending, accepted):
    start = q.QuoteState(anchor, pending, accepted)
    want = start
    for price, fallback in quotes:
        want = q.quote_step(want, price, fallback, 5, 2)[0]
    parts = [quotemaps.quote_map([p for p, _ in part], [f for _, f in part], 5, 2) for part in (quotes, quotes[:cut], quotes[cut:])]
    assert quotemaps.applied(parts[0], start, 2) == want
    assert quotemaps.applied(quotemaps.chained(*parts[1:], 2), start, 2) == want


def test_anchor_moves_only_after_two_close_quotes():
    step = lambda s, p, f=None: q.quote_step(s, p, f, 5, 2)
    s0 = q.QuoteState(1.0, None, False)
    s1, rate, source = step(s0, 4.9)
    assert (s1.anchor, rate, source) == (1.0, 4.9, "primary")
    assert step(s1, 4.0)[0].anchor == 4.0
    assert step(s0, 5.0)[2] == "fallback"
    assert step(s1, 50.0)[0].pending is None and step(s1, None)[0].pending == 4.9
    assert step(s0, 50.0, 2.0)[0] == q.QuoteState(2.0, None, True)
