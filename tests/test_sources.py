import json
from datetime import date, datetime

import pytest

from tallyflow.operators.rates import best_pair, daily_close, sane_quotes
from tallyflow.plans import queries
from tallyflow.sources import ingest, normalise, excluded, readers, sinks
from tallyflow.sources.runs import Runs
from tests.conftest import by


def write_lines(path, docs):
    path.mkdir()
    (path / "part.json").write_text("\n".join(json.dumps(d) for d in docs))
    return str(path)


def transfer(i, token, value="1500000000000000000", decimals="18", block=7, to="0xB", ts="2024-01-02T03:04:05.999999Z"):
    doc = {
        "transaction_hash": f"0xt{i}", "log_index": i, "timestamp": ts, "token": {"address_hash": token},
        "total": {"value": value, "decimals": decimals}, "from": {"hash": "0xAa"}, "to": {"hash": to},
    }
    return doc | ({"block_number": block} if block is not None else {})


@pytest.fixture
def assets(spark):
    return spark.createDataFrame([("0xTOK", "T", 6), ("0xany", "U", None)], "address string, asset string, decimals int")


def test_normalise(spark, assets, tmp_path):
    big = "123456789012345678901234567890123456789012345"
    docs = [
        transfer(1, "0xtOk"), transfer(2, "0xTOK", value="2500000", decimals=None), transfer(3, "0xANY", value=big, decimals=None),
        transfer(4, "0xother"), transfer(5, "0xtok", block=None, to="0xMiXed"),
    ]
    raw = readers.read_transfers(spark, write_lines(tmp_path / "raw", docs))
    rows = by(normalise(raw, assets, "OUT"), "key")
    assert set(rows) == {"0xt1:1", "0xt2:2", "0xt3:3", "0xt5:5"}
    assert rows["0xt1:1"]["val"] == 1.5 and rows["0xt1:1"]["ts"] == datetime(2024, 1, 2, 3, 4, 5)
    assert rows["0xt2:2"]["val"] == 2.5
    assert rows["0xt3:3"]["val"] == pytest.approx(int(big) / 10**18) and rows["0xt3:3"]["raw_val"] == big
    assert rows["0xt5:5"]["blk"] == 0 and rows["0xt5:5"]["cp"] == "0xmixed"
    assert by(normalise(raw, assets, "IN"), "key")["0xt1:1"]["cp"] == "0xaa"
    assert excluded(raw, assets).first().excluded == 1
    assert readers.read_transfers(spark, str(tmp_path / "raw"), token="0XTOK", to="0xmixed").count() == 1


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Mind_Name , ADDRESS,x\n Ann ,0xAA,1\n,0xBB,2\nCid,zz,3\nDee,0xCC,4\n")
    known = spark.createDataFrame([("0xcc", "old")], "cp string, label string")
    rows = by(readers.read_labels(spark, str(tmp_path / "l.csv"), existing=known, suffix=" (x)"), "cp")
    assert {k: v["label"] for k, v in rows.items()} == {"0xcc": "old", "0xaa": "Ann (x)"}


def test_labels_without_a_header_or_with_other_case(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b\n0xAA,Ann\n")
    (tmp_path / "l.csv").write_text("name,address\nAnn,0xAA\n")
    known = spark.createDataFrame([("0xAa", "old")], "cp string, label string")
    for name in ("n.csv", "l.csv"):
        assert [tuple(r) for r in readers.read_labels(spark, str(tmp_path / name), existing=known).collect()] == [("0xAa", "old")]


def test_archive_prices_state(spark, tmp_path):
    doc = {"in": [{"ts": "2024-01-01T00:00:00Z", "val": 2.0, "cp": "0xA"}], "out": [{"ts": "2024-01-02T00:00:00Z", "val": 3.0, "cp": "0xB"}]}
    rows = by(readers.read_archive(spark, write_lines(tmp_path / "a", [doc, {"in": []}])), "direction")
    assert rows["IN"]["cp"] == "0xa" and rows["OUT"]["day"] == date(2024, 1, 2)
    prices = by(readers.read_price_map(spark, write_lines(tmp_path / "p", [{"2024-01-01": 0.5, "2024-01-03": 0.7}]), "S"), "day")
    assert prices[date(2024, 1, 3)]["rate"] == 0.7
    state = readers.read_state(spark, write_lines(tmp_path / "s", [{"day_rates": {"T": {"2024-01-01": 1.5}, "U": {}}, "x": 1}]), "day_rates")
    assert [tuple(r) for r in state.collect()] == [("T", date(2024, 1, 1), 1.5)]


def test_ohlcv_and_quotes(spark, tmp_path):
    t = 1704067200
    docs = [
        {"asset": "T", "pool": "p", "pool_rank": 0, "ohlcv": [[t, 1, 1, 1, 10.0, 5], [t + 86400, 1, 1, 1, 0.0, 9], [t + 172800, 1, 1, 1, 3.0, 9]]},
        {"asset": "T", "pool": "q", "pool_rank": 1, "ohlcv": [[t, 1, 1, 1, 20.0, 5], [t + 86400, 1, 1, 1, 8.0, 2]]},
    ]
    closes = by(daily_close(readers.read_ohlcv(spark, write_lines(tmp_path / "o", docs)), before=datetime(2024, 1, 3)), "day")
    assert {k: v["close"] for k, v in closes.items()} == {date(2024, 1, 1): 10.0}
    pair = lambda base, price, liq: {"baseToken": {"address": base}, "priceUsd": price, "liquidity": {"usd": liq}}
    doc = {"asset": "T", "ts": "2024-01-01T00:00:00", "pairs": [pair("0xTT", "2.0", 50), pair("0xtt", "2.2", 50), pair("0xother", "2", 99), pair("0xtt", "5.0", 99), pair("0xtt", None, 99)]}
    quotes = readers.read_quotes(spark, write_lines(tmp_path / "q", [doc]))
    anchors = spark.createDataFrame([("T", "0xtT", 1.0)], "asset string, base string, anchor double")
    assert [r.price for r in best_pair(sane_quotes(quotes, anchors)).collect()] == [2.0]


def test_quote_lists_of_one_time_stay_apart(spark, tmp_path):
    pair = lambda price, liq: {"baseToken": {"address": "0xtt"}, "priceUsd": price, "liquidity": {"usd": liq}}
    docs = [{"asset": "T", "ts": "2024-01-01T00:00:00", "pairs": pairs} for pairs in ([pair("2.0", 50), pair("2.2", 50)], [pair("1.5", 10)], [pair("2.0", 50)], [pair("9.0", 90)])]
    quotes = sane_quotes(readers.read_quotes(spark, write_lines(tmp_path / "q", docs)), spark.createDataFrame([("T", "0xtt", 1.0)], "asset string, base string, anchor double"))
    assert sorted(r.price for r in best_pair(quotes, by=("list_id", "asset", "ts")).collect()) == [1.5, 2.0, 2.0]
    assert [r.price for r in best_pair(quotes).collect()] == [2.0]


def test_quote_scan_counts_every_event_of_a_time(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 5), 2 * i, "view", 20.0 + i, "{}") for i in range(4)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in queries.REGISTERED["quote_scan"](spark, str(tmp_path)).select("asset", "day", "n", "price").collect()] == [("A0", "2024-01-01", 4, 86.0)]


def test_ingest_is_idempotent_and_guarded(ledger):
    bank = ledger([("OUT", s, "T", 1, "x") for s in range(10)])
    batch = bank.filter("blk >= 8").unionByName(bank.filter("blk = 9"))
    again = ingest.ingest_increment(bank, batch, ["key"])
    assert again.count() == 10 and again.select("key").distinct().count() == 10
    assert not ingest.gap_check(bank.filter("blk < 5"), batch).first().complete
    assert ingest.ingest_increment(bank.filter("blk < 5"), batch, ["key"]).count() == 4
    assert ingest.ingest_increment(bank.filter("blk < 5"), batch, ["key"], exhausted=True).count() == 7
    assert ingest.ingest_increment(bank.limit(0), batch, ["key"]).count() == 3
    grown = ingest.backfill(bank.filter("blk > 5"), bank, ["key"], datetime(2024, 1, 1, 0, 0, 2))
    assert sorted(int(r.key) for r in grown.collect()) == list(range(2, 10))
    assert ingest.backfill(grown, bank, ["key"], datetime(2024, 1, 1, 0, 0, 2)).count() == 8


def test_known_keys_stay_out_whatever_their_time(ledger, spark):
    from pyspark.sql import functions as F

    bank = ledger([("OUT", s, "T", 1, "x") for s in range(10)])
    corrected = bank.withColumn("ts", F.expr("ts + INTERVAL 400 DAYS"))
    timeless = bank.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    for batch in (bank, corrected, timeless, timeless.unionAll(timeless)):
        assert ingest.unseen(batch, bank, ["key"]).count() == 0
    assert ingest.unseen(timeless.unionAll(timeless), bank.limit(0), ["key"]).count() == 10
    assert ingest.unseen(bank.select("key"), bank.filter("blk > 3"), ["key"]).count() == 3


def test_one_copied_key_may_fill_the_batch(ledger):
    batch = ledger([("OUT", s, "T", 1, "x") for s in range(4)])
    many = batch.filter("blk = 1").crossJoin(batch.sparkSession.range(5000)).drop("id").unionByName(batch)
    assert ingest.one_per_key(many, ["key"]).count() == 4


def left_side(rows, join):
    """The join's line in a plan, and the operators of its left side down to the scan."""
    lines = [x.lstrip(" :+-") for x in rows._jdf.queryExecution().executedPlan().toString().splitlines()]
    at = next(i for i, x in enumerate(lines) if join in x)
    end = next(i for i, x in enumerate(lines) if i > at and "FileScan" in x)
    return lines[at], lines[at + 1 : end]


def test_a_small_batch_leaves_the_bank_unshuffled(spark, tmp_path):
    path = str(tmp_path / "stored_bank")
    spark.range(5000).selectExpr("id AS key", "id * 2 AS v").write.parquet(path)
    batch = spark.range(4990, 5010).selectExpr("id AS key", "id AS v")
    rows = ingest.unseen(batch, spark.read.parquet(path), ["key"])
    join, bank_side = left_side(rows, "LeftSemi")
    assert "BroadcastHashJoin" in join and not any("Exchange" in x or "Sort" in x for x in bank_side)
    assert sorted(r.key for r in rows.collect()) == list(range(5000, 5010))


def test_a_bank_by_key_stays_in_place_for_a_large_batch(spark, tmp_path):
    path = str(tmp_path / "keyed_bank")
    bank = ingest.store_bank_by_key(spark.range(3000).selectExpr("id AS key", "id * 2 AS v"), "keyed_bank", ["key"], 4, path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = ingest.unseen(spark.range(6000).selectExpr("id AS key", "id AS v"), bank, ["key"])
        join, bank_side = left_side(rows, "LeftSemi")
        assert "SortMergeJoin" in join and not any("Exchange" in x for x in bank_side)
        assert sorted(r.key for r in rows.collect()) == list(range(3000, 6000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE keyed_bank")


def test_bank_days_keeps_settled(spark):
    schema = "day date, n long, settled boolean, partial boolean"
    bank = spark.createDataFrame([(date(2024, 1, 1), 1, True, False), (date(2024, 1, 2), 2, False, False), (date(2023, 12, 1), 9, False, False)], schema)
    new = spark.createDataFrame([(date(2024, 1, d), 10 * d) for d in (1, 2, 3, 4)], "day date, n long")
    rows = by(sinks.bank_days(new, bank, datetime(2024, 1, 4, 12)), "day")
    assert {d.day: (r["n"], r["settled"], r["partial"]) for d, r in rows.items() if d.year == 2024} == {
        1: (1, True, False), 2: (20, True, False), 3: (30, False, False), 4: (40, False, True),
    }
    assert rows[date(2023, 12, 1)]["n"] == 9


def test_publish_closed_never_changes_rows(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "state"))
    first = spark.createDataFrame([("T", 1, 1.0), ("T", 2, 2.0)], "asset string, d int, rate double")
    assert runs.append("first", first)
    second = spark.createDataFrame([("T", 2, 9.0), ("T", 3, 3.0), ("T", 3, 4.0)], "asset string, d int, rate double")
    for _ in range(2):
        sinks.publish_closed(second, runs.read(first.schema), ["asset", "d"], runs, "second")
    assert {k: v["rate"] for k, v in by(runs.read(first.schema), "d").items()} == {1: 1.0, 2: 2.0, 3: 3.0}


def test_only_committed_runs_count_and_each_once(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "runs"))
    assert runs.committed() == {} and runs.read("n long").count() == 0
    row = lambda n: spark.range(n, n + 1).withColumnRenamed("id", "n")
    half = runs.fresh()
    row(100).write.parquet(half)  # written, never marked
    assert runs.read("n long").count() == 0
    assert runs.append("a/1", row(1)) and runs.append("b", row(2)) and not runs.append("a/1", row(1))
    twin = runs.fresh()
    row(2).write.parquet(twin)
    runs.mark("b", twin)  # two writers of one run
    assert sorted(r.n for r in runs.read("n long").collect()) == [1, 2]
    runs.mark("late", half)
    assert sorted(r.n for r in runs.read("n long, more string").collect()) == [1, 2, 100]


def test_a_stored_bank_keeps_settled_days_through_repeated_and_half_written_runs(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "bank"))
    days = lambda factor, last: spark.createDataFrame([(date(2024, 1, d), factor * d) for d in range(1, last + 1)], "day date, n long")
    first = sinks.store_bank(days(1, 3), runs, "2024-01-03T01", datetime(2024, 1, 3, 1))
    assert {r.day.day: (r.n, r.settled, r.partial) for r in first.collect()} == {1: (1, True, False), 2: (2, False, False), 3: (3, False, True)}
    days(500, 4).write.parquet(runs.fresh())  # a run that died before its marker
    for factor in (10, 70):  # the second call repeats the run and changes nothing
        second = sinks.store_bank(days(factor, 4), runs, "2024-01-04T01", datetime(2024, 1, 4, 1))
        assert {r.day.day: r.n for r in second.collect()} == {1: 1, 2: 20, 3: 30, 4: 40}


def test_export_order_and_format(ledger, spark):
    from pyspark.sql import functions as F

    rows = ledger([("IN", 5, "T", 1.5, "0xb"), ("OUT", 1, "T", 2, "0xa"), ("OUT", 9, "T", 3, "0xc")])
    rows = rows.withColumns({"rate": F.lit(0.5), "rate_src": F.lit("live"), "band": F.lit("b1")})
    labels = spark.createDataFrame([("0xA", "Ann")], "cp string, label string")
    out = sinks.export_rows(rows, labels, {"b1": "one"}).collect()
    assert [(r.direction, r.amount, r.size_band, r.counterparty_label) for r in out] == [
        ("OUT", "3.000000", "one", ""), ("OUT", "2.000000", "one", "Ann"), ("IN", "1.500000", "", ""),
    ]
