import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import DEFAULT_SCHEME
from tallyflow.operators import facts
from tests.conftest import T0, by, one


@pytest.fixture(scope="module")
def rows(ledger):
    rnd = random.Random(4)
    data = [
        (rnd.choice(["OUT", "OUT", "IN"]), rnd.randrange(40 * 86400), rnd.choice("TU"), rnd.choice([0.05, 0.1, 1.0, 3.0, 0.7, 25.0]), rnd.choice(["a", "b", "hub", "c"]))
        for _ in range(500)
    ]
    cut = 39 * 86400
    data += [("OUT", cut, "T", 1, "edge"), ("OUT", cut + 1, "T", 1, "edge2"), ("OUT", 40 * 86400, "T", 1, "edge3")]
    return ledger(data)


def test_windows_are_half_open_and_nested(rows):
    as_of = T0 + timedelta(days=40)
    got = by(facts.flow_facts(rows, facts.standard_windows(as_of), ("T", "U"), "HUB"), "label")
    data = rows.collect()
    for label, lo, hi in facts.standard_windows(as_of):
        mine = [r for r in data if (lo is None or r.ts > lo) and (hi is None or r.ts <= hi)]
        out, inn = [r for r in mine if r.direction == "OUT"], [r for r in mine if r.direction == "IN"]
        g = got[label]
        assert (g["out_tx"], g["in_tx"]) == (len(out), len(inn))
        assert (g["out_wallets"], g["in_sources"]) == (len({r.cp for r in out}), len({r.cp for r in inn}))
        assert g["out_usd"] == pytest.approx(sum(r.usd for r in out), abs=0.006)
        assert g["in_recycled_usd"] == pytest.approx(sum(r.usd for r in inn if r.cp == "hub"), abs=0.006)
        assert g["net_usd"] == pytest.approx(g["in_usd"] - g["out_usd"], abs=0.011)
        assert g["out_usd_T"] + g["out_usd_U"] == pytest.approx(g["out_usd"], abs=0.011)
    assert got["24h"]["out_tx"] <= got["7d"]["out_tx"] <= got["30d"]["out_tx"] <= got["all history"]["out_tx"]
    assert facts.flow_facts(rows, facts.standard_windows(as_of)[:1], ("T",)).first().out_tx == got["24h"]["out_tx"]


def test_daily_bands_add_up(rows):
    daily = facts.daily_facts(rows, T0 + timedelta(days=39, hours=3), ("T", "U"), DEFAULT_SCHEME)
    days = by(daily, "day")
    bands = {}
    for r in facts.band_rows(daily).collect():
        bands.setdefault(r.day, []).append(r)
    for day, row in days.items():
        assert sum(b.n for b in bands.get(day, [])) == row["out_tx"]
        assert sum(b.usd for b in bands.get(day, [])) == pytest.approx(row["out_usd"], abs=0.02)
        assert row["partial"] == (day == date(2024, 2, 9))
    assert sum(r["out_tx"] for r in days.values()) == rows.filter("direction = 'OUT'").count()


def test_month_labels(ledger):
    frame = ledger([("IN", 0, "T", 1, "a"), ("OUT", 4 * 86400, "T", 1, "a"), ("OUT", 33 * 86400, "T", 2, "a"), ("OUT", 62 * 86400, "T", 2, "a")])
    labels = {r.label for r in facts.monthly_facts(frame, datetime(2024, 3, 9), ("T",)).collect()}
    assert labels == {"2024-01 (from 2024-01-05)", "2024-02", "2024-03 (partial)"}


def test_hourly_fills_gaps(ledger):
    as_of = T0 + timedelta(days=8, hours=2, minutes=30)
    frame = ledger([("OUT", 86400 + 2 * 3600 + 1800, "T", 1, "a"), ("OUT", 86400 + 2 * 3600 + 1801, "T", 1, "a"), ("OUT", 8 * 86400, "U", 1, "a")])
    got = by(facts.hourly_counts(frame, as_of, ("T", "U")), "h")
    assert len(got) == 7 * 24 + 1
    assert got["2024-01-02 02"]["T"] == 1 and got["2024-01-09 00"]["U"] == 1
    assert sum(r["T"] + r["U"] for r in got.values()) == 2


def test_leaderboard_ties_and_labels(spark, ledger):
    frame = ledger([("OUT", 86400 * d, "T", v, cp) for d, v, cp in [(0, 5, "a"), (1, 5, "a"), (0, 10, "b"), (3, 30, "c"), (3, 1, "d")]])
    labels = spark.createDataFrame([("B", "Bee")], "cp string, label string")
    got = facts.leaderboard(frame, "OUT", 3, labels).orderBy("usd", "cp").collect()
    assert [(r.cp, r.label, r.n, r.days, r.share) for r in got] == [("a", None, 2, 2, 19.6), ("b", "Bee", 1, 1, 19.6), ("c", None, 1, 1, 58.8)]


def test_repeat_entities_and_projection(ledger):
    frame = ledger([("OUT", 0, "T", 1, "a"), ("OUT", 5, "T", 1, "a"), ("OUT", 0, "T", 1, "b"), ("OUT", 86400, "T", 1, "b")])
    assert one(facts.entity_days(frame)) == {"wallets_all": 2, "wallets_repeat": 1}
    daily = facts.daily_facts(frame, datetime(2024, 1, 2, 12), ("T",), DEFAULT_SCHEME).select("day", "out_tx")
    got = by(facts.project_day(daily, datetime(2024, 1, 2, 12), ["out_tx"]), "day")
    assert got[date(2024, 1, 2)]["projected_out_tx"] == 2.0 and got[date(2024, 1, 1)]["projected_out_tx"] is None
    assert by(facts.project_day(daily, datetime(2024, 1, 2, 23, 55), ["out_tx"]), "day")[date(2024, 1, 2)]["projected_out_tx"] is None


def test_roll_forward_counts_late_rows(ledger):
    from tallyflow.functions import DEFAULT_SCHEME, classified
    from tallyflow.operators import facts

    rows = classified(ledger([("OUT", s, "T", 1, "x") for s in (10, 20, 86400, 86410, 172800)]), DEFAULT_SCHEME)
    stored = facts.rollup(rows.filter("blk in (1, 3)"))
    grown = facts.roll_forward(stored, rows)
    assert {r.day.day: r.n for r in grown.groupBy("day").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {1: 2, 2: 2, 3: 1}
    fixed = rows.withColumn("usd", F.when(F.col("blk") == 3, 9.0).otherwise(F.col("usd"))).filter("blk <> 5")
    got = {r.day.day: r.usd for r in facts.roll_forward(grown, fixed).groupBy("day").agg(F.sum("usd").alias("usd")).collect()}
    assert got == {1: 2.0, 2: 10.0}
