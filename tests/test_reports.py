import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import DEFAULT_SCHEME
from tallyflow.operators.platform import EventMeasure, active_users
from tallyflow.plans import hourly
from tallyflow.sources import append_snapshot, read_revenue
from tallyflow.sources.runs import Runs
from tests.conftest import T0, by, one

AS_OF = T0 + timedelta(days=10)


@pytest.fixture(scope="module")
def inputs(spark, ledger):
    rows = [("OUT", 3600 * i, "T", 10 if i % 3 else 100, f"w{i % 5}") for i in range(239)] + [("IN", 7200 * i, "U", 50, "hub") for i in range(100)]
    rates = spark.createDataFrame([("T", date(2024, 1, 3), 0.01), ("U", date(2024, 1, 2), 2.0)], "asset string, day date, rate double")
    return hourly.Inputs(
        ledger=ledger(rows).drop("usd"), rates=rates,
        live=spark.createDataFrame([("T", 0.02), ("U", 2.0)], "asset string, rate double"),
        balances=spark.createDataFrame([("T", 900.0, False), ("U", 70.0, False)], "asset string, balance double, degraded boolean"),
        prev_recon=spark.createDataFrame([("T", 1.0)], "asset string, delta double"),
        labels=spark.createDataFrame([("W1", "one")], "cp string, label string"), assets=("T", "U"), recycle_src="hub",
    )


def test_hourly_report_agrees_with_itself(inputs):
    report = hourly.hourly_report(inputs, AS_OF)
    windows = by(report["windows"], "label")
    assert windows["all history"]["out_usd"] == pytest.approx(sum(0.01 * (10 if i % 3 else 100) for i in range(239)))
    assert windows["all history"]["in_usd"] == 10_000 and windows["all history"]["in_external_usd"] == 0
    totals = by(report["totals"], "cat")
    assert totals["invoke"]["n"] + totals["equip"]["n"] == 239
    assert sum(r["usd"] for r in totals.values()) == pytest.approx(windows["all history"]["out_usd"])
    daily = by(report["daily"], "day")
    assert sum(r["out_tx"] for r in daily.values()) == 239 and sum(v["n"] for v in daily[date(2024, 1, 2)]["bands"].values()) == 24
    assert by(report["top_recipients"], "cp")["w1"]["label"] == "one"
    assert one(report["guard"])["total_usd"] == pytest.approx(windows["all history"]["out_usd"])
    assert one(report["runway"])["bal_usd"] == round(900 * 0.02 + 70 * 2.0)
    assert one(report["wallets"]) == {"wallets_all": 5, "wallets_repeat": 5}
    for name, df in report.items():
        assert df.count() > 0 or name in ("loop",), name


def test_a_stored_rollup_changes_nothing(inputs):
    from dataclasses import replace

    from tallyflow.functions import classified
    from tallyflow.operators import facts
    from tallyflow.operators.rates import asof_rate

    ledger = classified(asof_rate(inputs.ledger, inputs.rates, live=inputs.live))
    stored = facts.rollup(ledger.filter("day <= '2024-01-05'"))
    whole, grown = (hourly.hourly_report(x, AS_OF) for x in (inputs, replace(inputs, rollup=stored)))
    for name, keys in (("windows", ["label"]), ("daily", ["day"]), ("top_recipients", ["cp"]), ("fine_table", ["fine"]), ("loop", ["loop_n"])):
        assert by(whole[name], *keys) == by(grown[name], *keys), name
    history = facts.rollup(ledger)
    assert by(facts.monthly_facts(history, AS_OF, ("T", "U")), "label") == by(facts.monthly_facts(ledger, AS_OF, ("T", "U")), "label")
    assert by(facts.daily_facts(history, AS_OF, ("T", "U"), DEFAULT_SCHEME), "day") == by(facts.daily_facts(ledger, AS_OF, ("T", "U"), DEFAULT_SCHEME), "day")


def test_snapshots_feed_the_notification(spark, inputs, tmp_path):
    report = hourly.hourly_report(inputs, AS_OF)
    from tallyflow.functions import classified
    from tallyflow.operators.rates import asof_rate

    valued = classified(asof_rate(inputs.ledger, inputs.rates, live=inputs.live))
    runs = Runs(spark, str(tmp_path / "history"))
    for hours in (1, 0, 1):
        row = hourly.kpi_snapshot(valued, inputs.balances, report["runway"], AS_OF - timedelta(hours=hours), 0.02, "T")
        append_snapshot(row, runs, f"run {hours}")
    history = runs.read(row.schema)
    assert history.count() == 2 and history.first().creators == 5
    sent = hourly.notification(inputs.ledger, history, report["recon"], AS_OF, 0.02, every=True)
    assert {r.label for r in sent["deltas"].collect()} == {"1h", "24h", "7d"}
    assert "reconciliation drift" in {r.rule for r in sent["alerts"].collect()}


def test_telemetry(spark):
    rows = [(T0 + timedelta(hours=i), "buy" if i % 2 else "view", i % 7, json.dumps({"amount": i})) for i in range(240)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, user_id long, props string")
    spec = {"topups": EventMeasure(("buy",)), "topup_usd": EventMeasure(("buy",), ("$.amount",))}
    empty = spark.createDataFrame([], "day date, topups long, topup_usd double, settled boolean, partial boolean")
    first = hourly.telemetry(events, spec, empty, datetime(2024, 1, 6, 12))
    bank = by(first["days"], "day")
    assert bank[date(2024, 1, 4)]["settled"] and not bank[date(2024, 1, 5)]["settled"] and bank[date(2024, 1, 6)]["partial"]
    kept = first["days"].withColumn("topups", F.lit(-1).cast("long"))
    again = by(hourly.telemetry(events, spec, kept, datetime(2024, 1, 7))["days"], "day")
    assert again[date(2024, 1, 4)]["topups"] == -1 and again[date(2024, 1, 5)]["topups"] == 12
    assert one(active_users(events, AS_OF)) == {"active_7d": 7, "active_30d": 7}


def test_revenue_document(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"period": ["2024-01-01", "2024-01-31"], "net_usd": 90.0, "fees_est_usd": 5.0, "tiers": {"$10": 3}, "rows": 1}, indent=1))
    row = one(read_revenue(spark, str(tmp_path / "r.json")))
    assert (row["first_day"], row["last_day"], row["net"], row["net_proceeds"], row["tiers"]) == (date(2024, 1, 1), date(2024, 1, 31), 90.0, None, {"$10": 3})


def test_rates_missing_altogether_leave_the_live_one(spark, inputs):
    from tallyflow.operators.rates import asof_rate

    got = asof_rate(inputs.ledger, inputs.rates.limit(0), live=inputs.live).select("asset", "rate", "rate_src").distinct().collect()
    assert sorted((r.asset, r.rate, r.rate_src) for r in got) == [("T", 0.02, "live"), ("U", 2.0, "live")]
