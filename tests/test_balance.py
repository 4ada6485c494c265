import random
from datetime import date, datetime

import pytest

from tallyflow.operators import balance as bal
from tests.conftest import by, one


def rows_of(rnd, days=15):
    return [
        (rnd.choice(["IN", "OUT"]), 86400 * rnd.randrange(days) + rnd.randrange(86400), rnd.choice("TU"), rnd.randrange(1, 500) / 4, rnd.choice(["x", "hub"]))
        for _ in range(300)
    ]


def test_backward_series(spark, ledger):
    rows = ledger(rows_of(random.Random(2)))
    held = spark.createDataFrame([("T", 1000.0, False), ("U", 50.0, False)], "asset string, balance double, degraded boolean")
    pin = one(bal.pin_block(rows))["pin"]
    newest = {d: max(r.blk for r in rows.collect() if r.direction == d) for d in ("IN", "OUT")}
    assert pin == min(newest.values())
    series = by(bal.balance_series(rows, held, ("T", "U"), recycle_src="HUB"), "asset", "day")
    used = [r for r in rows.collect() if r.blk <= pin]
    days = sorted({r.day for r in used})
    for asset, held_now in (("T", 1000.0), ("U", 50.0)):
        assert series[asset, days[-1]]["qty"] == held_now
        for before, after in zip(days, days[1:]):
            net = sum((1 if r.direction == "IN" else -1) * r.val for r in used if r.asset == asset and r.day == after)
            assert series[asset, after]["qty"] - series[asset, before]["qty"] == pytest.approx(net, abs=0.11)
            assert series[asset, after]["delta"] == pytest.approx(net, abs=0.051)
        recycled = sum(r.val for r in used if r.asset == asset and r.direction == "IN" and r.cp == "hub")
        assert sum(v["in_rec"] for k, v in series.items() if k[0] == asset) == pytest.approx(recycled, abs=1)


def test_missing_row_shows_as_drift(spark, ledger):
    rows = ledger([("IN", 1, "T", 500, "x"), ("OUT", 2, "T", 40, "x"), ("OUT", 3, "T", 60, "x"), ("IN", 4, "T", 1, "x"), ("OUT", 5, "T", 1, "x")])
    held = spark.createDataFrame([("T", 400.0, False), ("V", 5.0, True)], "asset string, balance double, degraded boolean")
    none = spark.createDataFrame([], "asset string, delta double")
    first = by(bal.reconcile(rows, held, none), "asset")
    assert first["T"]["drift"] is None and not first["T"]["warn"] and first["V"]["delta"] == 5.0
    prev = spark.createDataFrame([("T", first["T"]["delta"]), ("V", 0.0)], "asset string, delta double")
    lost = by(bal.reconcile(rows.filter("blk <> 3"), held, prev), "asset")
    assert lost["T"]["drift"] == -60.0 and not lost["T"]["warn"]
    assert by(bal.reconcile(rows.filter("blk <> 1"), held, prev), "asset")["T"]["warn"]
    assert lost["V"]["drift"] is None
    assert by(bal.reconcile(rows, held, prev, complete=False), "asset")["T"]["drift"] is None


def test_balance_at_the_pin(spark):
    held = spark.createDataFrame([("T", 5, 1.0), ("T", 9, 2.0), ("U", 9, 3.0)], "asset string, block long, balance double")
    from pyspark.sql import functions as F

    got = by(bal.balance_at(held, F.lit(5)), "asset")
    assert (got["T"]["balance"], got["T"]["degraded"]) == (1.0, False) and (got["U"]["balance"], got["U"]["degraded"]) == (3.0, True)


@pytest.mark.parametrize(
    "deltas, status, flat, change",
    [
        ([5] * 7, None, 0, None),
        ([5] * 8, "growing", 0, 5.0),
        ([-5] * 10, "declining", 0, -5.0),
        ([5] * 9 + [0, 0, 0], "frozen", 3, None),
        ([5] * 9 + [0, 0.5], "growing", 2, 5.0),
        ([5] * 7 + [0], "frozen", 1, None),
        ([0] * 9, "frozen", 9, None),
    ],
)
def test_trend(spark, deltas, status, flat, change):
    rows, qty = [], 100.0
    for i, delta in enumerate(deltas):
        qty += delta
        rows.append(("T", date(2024, 1, i + 1), qty, float(delta), False))
    rows.append(("T", date(2024, 2, 1), 7.0, 0.0, True))
    got = one(bal.trend_state(spark.createDataFrame(rows, "asset string, day date, qty double, delta double, partial boolean")))
    assert (got["status"], got["flat_days"], got["change"]) == (status, flat, change)
    if change and change < 0:
        assert got["days_to_zero"] == int(qty / 5)


@pytest.mark.parametrize("oldest, span", [(9 * 86400, 7.0), (3 * 86400, 3.0), (3600, 1.0)])
def test_burn_span_and_runway(ledger, oldest, span):
    from pyspark.sql import functions as F

    from tallyflow.functions import DEFAULT_SCHEME, classified

    as_of = datetime(2024, 1, 11)
    end = 10 * 86400
    rows = classified(ledger([("OUT", end - oldest, "T", 0.1, "x"), ("OUT", end - 60, "T", 1, "x"), ("OUT", end - 50, "T", 10, "x"), ("IN", 0, "T", 10, "x")]), DEFAULT_SCHEME)
    burned = one(bal.burn(rows, as_of, DEFAULT_SCHEME))
    recent = 1.1 if oldest < 7 * 86400 else 1.0
    assert burned["span_days"] == pytest.approx(span)
    assert burned["burn7avg"] == pytest.approx(recent / span) and burned["out7avg"] == pytest.approx((recent + 10) / span)
    left = one(bal.runway(bal.burn(rows, as_of, DEFAULT_SCHEME), F.lit(100.0)))
    assert left["runway7"] == round(100 / (recent / span), 1)
    assert one(bal.runway(bal.burn(rows.filter("direction = 'IN'"), as_of, DEFAULT_SCHEME), F.lit(1.0)))["runway24"] is None


def test_an_empty_ledger_spans_a_week(ledger):
    from datetime import datetime

    from tallyflow.functions import DEFAULT_SCHEME, classified

    nothing = classified(ledger([("IN", 0, "T", 1, "x")]), DEFAULT_SCHEME).filter("blk < 0")
    assert one(bal.burn(nothing, datetime(2024, 1, 31), DEFAULT_SCHEME))["span_days"] == 7.0


def test_stored_delta_moves_only_in_a_clean_run(spark):
    recon = spark.createDataFrame([("T", 5.0, False), ("U", 7.0, True), ("V", 9.0, True)], "asset string, delta double, degraded boolean")
    prev = spark.createDataFrame([("T", 1.0), ("U", 2.0), ("gone", 3.0)], "asset string, delta double")
    state = lambda complete: {r.asset: r.delta for r in bal.stored_deltas(recon, prev, complete).collect()}
    assert state(True) == {"T": 5.0, "U": 2.0, "gone": 3.0}
    assert state(False) == {"T": 1.0, "U": 2.0, "gone": 3.0}
