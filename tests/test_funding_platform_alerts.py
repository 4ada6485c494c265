from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import DEFAULT_SCHEME, classified
from tallyflow.operators import alerts, earners, funding, platform, registry
from tallyflow.plans import queries
from tests.conftest import T0, by, one


def test_funding_split(ledger):
    spent = ledger([("IN", 0, "T", 10, "a"), ("IN", 1, "T", 5, "a"), ("IN", 0, "T", 4, "b"), ("IN", 0, "T", 7, "c"), ("IN", 0, "T", 99, "own")])
    paid = ledger([("OUT", 0, "T", 9, "a"), ("OUT", 0, "T", 20, "b"), ("OUT", 0, "T", 1, "z")])
    got = one(funding.funding_split(spent, paid, own="OWN"))
    assert got == {
        "consumed_usd": 26.0, "spenders": 3, "backed_usd": 13.0, "user_usd": 13.0, "user_pct": 50.0, "excess_n": 2, "never_credited_n": 1,
    }


def test_consumption_counts_only_paid_wallets(spark, ledger):
    spent = ledger([("IN", 0, "T", 10, "a"), ("IN", 9 * 86400, "T", 5, "a"), ("IN", 0, "T", 4, "stranger")])
    paid = ledger([("OUT", 0, "T", 9, "a")])
    rates = spark.createDataFrame([("T", date(2024, 1, 1), 2.0)], "asset string, day date, rate double")
    got = one(funding.consumption(spent, paid, rates, 3.0, T0 + timedelta(days=10), own="own"))
    assert (got["total_n"], got["total_usd"], got["usd_7d"], got["n_24h"], got["spenders_7d"]) == (2, 35.0, 15.0, 0, 1)


def test_lagged_share_uses_calendar_days(spark):
    frame = lambda rows: spark.createDataFrame([(date(2024, 1, d), float(v)) for d, v in rows], "day date, val double")
    series = funding.sweep_series(frame([(2, 4), (4, 9), (5, 3), (7, 1)]), frame([(1, 2)]), frame([(1, 10), (3, 0), (4, 6), (5, 8), (5, 2)]))
    got = by(funding.lagged_share(series), "day")
    assert {k.day: v["share"] for k, v in got.items()} == {2: 0.4, 5: 0.5}
    total = one(funding.sweep_summary(series, frame([(4, 1), (9, 2)]), F.lit(7.126)))
    assert (total["out_n"], total["out_total"], total["collector_bal"], total["recycle_first"]) == (2, 3.0, 7.13, date(2024, 1, 1))
    assert total["phase_first"] == date(2024, 1, 1) and total["phase_days"] == 1
    assert (total["days"], total["total"], total["share_cum"], total["share_median"], total["recycle_span_days"]) == (4, 17.0, 106.3, 45.0, 1)  # 106.25 rounds half up
    audit = one(funding.contract_audit(series, pct=0.5, rate=2.0))
    assert (audit["expected"], audit["actual"], audit["variance"], audit["variance_usd"], audit["old_pct"]) == (8.0, 17.0, 9.0, 18.0, 20.0)


def test_sweep_series_holds_the_days_before_recycling(spark, tmp_path):
    orders = [(datetime(1997, 12, 30), 7.0), (datetime(1997, 12, 31), 5.0), (datetime(1998, 1, 2), 3.0)]
    lines = [(datetime(1997, 12, 31), 2.0), (datetime(1998, 1, 1), 4.0)]
    spark.createDataFrame(orders, "o_orderdate timestamp_ntz, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_shipdate timestamp_ntz, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = by(queries.REGISTERED["sweep_series"](spark, str(tmp_path)), "day")
    assert {k: (v["i"], v["r"], v["s"]) for k, v in got.items()} == {"1997-12-30": (7.0, 0.0, 0.0), "1997-12-31": (5.0, 2.0, 0.0), "1998-01-01": (0.0, 0.0, 4.0), "1998-01-02": (3.0, 0.0, 0.0)}
    assert sorted(r.day.day for r in funding.since_recycling(queries._sweeps(spark, str(tmp_path))).collect()) == [1, 2, 31]


def test_archive_split_prices_each_day(spark, ledger):
    prices = spark.createDataFrame([("T", date(2024, 1, 1), 2.0)], "asset string, day date, rate double")
    rows = [("IN", 0, "T", 10, "a"), ("OUT", 1, "T", 4, "a"), ("IN", 86400, "T", 9000, "b"), ("OUT", 0, "T", 7, "c")]
    got = one(funding.archive_split(ledger(rows), prices))
    assert got == {"consumed_usd": 29.0, "spenders": 2, "backed_usd": 8.0, "user_usd": 21.0, "user_pct": 72.4, "excess_n": 2}  # 20 + 9, 8 credited


def test_archive_defaults_missing_prices(spark, ledger):
    prices = spark.createDataFrame([("T", date(2024, 1, 1), 2.0)], "asset string, day date, rate double")
    rows = ledger([("IN", 0, "T", 10, "a"), ("OUT", 40 * 86400, "T", 1000, "a"), ("OUT", 0, "T", 1, "b")])
    got = one(funding.archive_rollup(rows, prices))
    assert (got["in_usd"], got["out_usd"], got["both_n"], got["topped_n"]) == (20.0, 3.0, 1, 2)
    months = by(funding.archive_monthly(rows, prices), "month")
    assert months["2024-02"]["out_usd"] == 1.0 and months["2024-02"]["in_usd"] == 0.0


EVENTS = "ts timestamp_ntz, event_type string, user_id long, props string"


def test_event_days_reads_the_first_amount(spark):
    rows = [(T0, "buy", 1, '{"amount_usd": "5.5", "amount": 9}'), (T0, "buy", 1, '{"amount": 2}'), (T0, "buy", 2, "{}"), (T0, "view", 2, '{"amount": 8}'),
            (T0 - timedelta(seconds=1), "buy", 2, '{"amount": 8}'), (T0, "noise", 3, "{}")]
    spec = {"n": platform.EventMeasure(("buy",)), "usd": platform.EventMeasure(("buy",), ("$.amount_usd", "$.amount")), "views": platform.EventMeasure(("view",))}
    got = one(platform.event_days(spark.createDataFrame(rows, EVENTS), spec, T0))
    assert (got["n"], got["usd"], got["views"]) == (3, 7.5, 1)


def test_active_users_excludes_the_cut(spark):
    rows = [(T0, "e", 1, ""), (T0 + timedelta(seconds=1), "e", 2, ""), (T0 + timedelta(seconds=1), "e", 2, ""), (T0 - timedelta(days=20), "e", 3, "")]
    frame = spark.createDataFrame(rows, EVENTS)
    assert one(platform.active_users(frame, T0 + timedelta(days=7))) == {"active_7d": 1, "active_30d": 3}
    assert one(platform.active_users(frame, T0 + timedelta(days=7), approx=True)) == {"active_7d": 1, "active_30d": 3}


def test_ratio_weeks_drop_the_short_run(spark, ledger):
    days = spark.createDataFrame([(date(2024, 1, d), 1, float(d), 0, d != 20) for d in range(1, 21)], "day date, topups long, topup_usd double, awakens long, settled boolean")
    rows = classified(ledger([("OUT", 86400 * (d - 1), "T", 1, "x") for d in range(1, 21)]), DEFAULT_SCHEME)
    got = by(platform.ratio_weeks(days, rows, DEFAULT_SCHEME), "end_day")
    assert {k.day: (v["topup"], v["unbacked"], v["ratio"]) for k, v in got.items()} == {19: (112.0, 7.0, 0.1), 12: (63.0, 7.0, 0.1)}
    tier = one(platform.settled_tier(days, rows, DEFAULT_SCHEME, burn7avg=F.lit(2.0), wau=F.lit(4)))
    assert (tier["first_day"].day, tier["topup_usd"], tier["unbacked_usd"], tier["cost_per_user"]) == (13, 112.0, 7.0, 3.5)


def test_loop_and_guard(spark, ledger):
    rows = classified(ledger([("OUT", 0, "T", 3, "a")] + [("OUT", i, "T", 1, "a") for i in range(12)] + [("OUT", 0, "T", 3, "b"), ("OUT", 0, "T", 1, "c")]), DEFAULT_SCHEME)
    assert one(earners.earn_loop(rows, DEFAULT_SCHEME)) == {"credit_recip_n": 2, "loop_n": 1, "loop_usd": 12.0, "loop_gt10": 1, "loop_gt50": 0}
    prints = spark.createDataFrame([("review", 5.0), ("organic", 7.0)], "status string, usd double")
    assert one(earners.guard(prints, F.lit(20.0))) == {"flagged_n": 1, "monitored_n": 2, "at_risk_usd": 5.0, "total_usd": 20.0}


def test_asof_stats(ledger):
    rows = ledger([("OUT", 0, "T", 10, "a"), ("OUT", 3600 * 30, "T", 100, "a"), ("OUT", 3600 * 47 + 1, "T", 10, "b"), ("OUT", 3600 * 49, "T", 10, "late")])
    stats = alerts.asof_stats(rows, T0 + timedelta(hours=48), 0.01)
    got = by(stats, "label")
    assert [(got[k]["invoke"], got[k]["equip"], got[k]["earners"]) for k in ("now", "1h", "24h", "7d")] == [(2, 1, 2), (1, 1, 1), (1, 0, 1), (0, 0, 0)]
    moved = by(alerts.stat_deltas(stats, ["invoke", "earned_val"]), "label")
    assert moved["1h"]["invoke_delta"] == 1 and moved["24h"]["earned_val_delta"] == 110.0


@pytest.mark.parametrize(
    "prev, now, hour, every, sent",
    [(None, 5.0, 1, False, True), (8.0, 5.0, 1, False, True), (6.0, 5.0, 1, False, False), (6.0, 5.0, 6, False, True), (6.0, 5.0, 1, True, True),
     (1.0, 0.9, 1, False, True), (0.9, 0.8, 1, False, False), (0.9, 0.4, 1, False, True), (6.0, 7.0, 1, True, False), (6.0, 0.0, 1, True, False)],
)
def test_low_runway_rule(spark, prev, now, hour, every, sent):
    rows = [] if prev is None else [(T0, prev, None, None)]
    rows.append((T0 + timedelta(days=1, hours=hour), None, now, None))
    if prev is not None:
        rows[0] = (T0, None, prev, None)
    history = spark.createDataFrame(rows, "ts timestamp_ntz, runway24 double, runway7 double, runway_adj double")
    none = spark.createDataFrame([], "asset string, drift double, warn boolean")
    history = history.withColumns({"burn24": F.lit(1.0), "burn_prev": F.lit(1.0)})
    assert (alerts.alerts(history, none, every=every).count() == 1) == sent


def test_collisions_and_registry(spark):
    cps = ["0xabcd11ff99", "0xabcd22ff99", "0xABCD11FF99", "0xabcd1199ff99", "0x000000aaaa"]
    got = by(registry.short_collisions(spark.createDataFrame([(c,) for c in cps], "cp string")), "cp")
    assert {k: v["collision"] for k, v in got.items()} == {"0xabcd11ff99": "table", "0xabcd22ff99": "short", "0xabcd1199ff99": "table"}
    reg = spark.createDataFrame([("0xA", "core", "Core", True)], "cp string, role string, grp string, warn boolean")
    board = lambda *rows: spark.createDataFrame(rows, "cp string, label string, role string, grp string")
    recipients = board(("0xa", None, "top", "R"), ("0xB", None, "top", "R"), ("0xC", "Cee", "top", "R"), ("0xabcd11ff99", "El", "top", "R"))
    sources = board(("0xb", None, "src", "A"), ("0xD", None, "src", "A"), ("0xabcd22ff99", None, "src", "A"))
    labels = spark.createDataFrame([("0xC", "Cee"), ("0xa", "Ay"), ("0xE", "Eff (mind)"), ("0xF", "Eff"), ("0xf", "Ef")], "cp string, label string")
    rows = registry.extend_registry(reg, [recipients, sources], labels, left_out="(mind)").collect()
    assert sorted((r.cp, r.role, r.warn, r.collision) for r in rows) == [
        ("0xA", "core", True, None), ("0xB", "top", False, None), ("0xC", "Cee", False, None), ("0xD", "src", False, None), ("0xabcd22ff99", "src", False, "short"), ("0xf", "Ef", False, None),
    ]
    assert registry.extend_registry(reg.limit(0), [], labels.limit(0)).count() == 0


def test_a_form_that_half_of_all_addresses_share_is_split(spark):
    cps = [f"0xaaaa{i:06}ffff" for i in range(400)] + [f"0x{i:08}{i:04}" for i in range(400)] + ["0xaaaa000001ffff"]
    frame = spark.createDataFrame([(c,) for c in cps], "cp string").repartition(3)
    for per_split in (10, 100_000):
        got = {r.cp: r.collision for r in registry.short_collisions(frame, per_split=per_split).collect()}
        shorts, longs = (Counter(c[:n] + c[-4:] for c in set(cps)) for n in (6, 8))
        assert got == {c: "table" if longs[c[:8] + c[-4:]] > 1 else "short" for c in set(cps) if shorts[c[:6] + c[-4:]] > 1}
    rows = frame.distinct().withColumn("form", F.concat(F.left("cp", F.lit(6)), F.right("cp", F.lit(4))))
    heavy = spark.createDataFrame([("0xaaaaffff", 40)], "form string, splits int")
    parts = Counter(r.salt for r in registry.split_keys(rows, "form", heavy).filter("form = '0xaaaaffff'").collect())
    assert len(parts) > 30 and max(parts.values()) < 40


def test_the_daily_phase_is_the_longest_run_of_days(spark):
    days = [date(2024, 1, n) for n in (1, 2, 5, 6, 7, 8, 20, 21, 22, 23, 30)]
    series = spark.createDataFrame([(d, 1) for d in days] + [(date(2024, 1, 9), 0)], "day date, n_r long")
    assert one(funding.daily_phase(series)) == {"phase_first": date(2024, 1, 5), "phase_last": date(2024, 1, 8), "phase_days": 4}
    assert one(funding.daily_phase(series.limit(0))) == {"phase_first": None, "phase_last": None, "phase_days": 0}


def test_sketches_of_days_merge_to_the_users_of_their_union(spark):
    rows = [(T0 + timedelta(days=d, minutes=u), 37 * d + u) for d in range(40) for u in range(60)] + [(T0 + timedelta(days=39), None)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, user_id long")
    stored = platform.user_days(events)
    assert stored.count() == 40
    last = (T0 + timedelta(days=39)).date()
    days = events.select(F.to_date("ts").alias("day"), "user_id").distinct()
    exact = by(platform.active_from_days(days, last, user="user_id"), "days")
    guess = by(platform.active_from_days(stored, last), "days")
    assert {d: r["users"] for d, r in exact.items()} == {1: 60, 7: 60 + 37 * 6, 30: 60 + 37 * 29}
    assert set(guess) == set(exact) and all(abs(guess[d]["users"] / exact[d]["users"] - 1) < 0.04 for d in exact)
    assert platform.active_from_days(stored.limit(0), last).count() == 0
