import random
from datetime import timedelta

from pyspark.sql import functions as F

from tallyflow import streaming
from tallyflow.operators.balance import pinned, signed
from tallyflow.operators.quotes import JUDGED, validate_quotes
from tests.conftest import T0, by

SCHEMA = "ts timestamp_ntz, key string, asset string, direction string, usd double"


def land(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def schema_of(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema).schema


def event(day, key, usd=1.0, direction="OUT"):
    return (T0 + timedelta(days=day), str(key), "T", direction, float(usd))


def test_repeated_keys_arrive_once_across_runs(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    land(spark, [event(0, 1), event(1, 2), event(1, 2)], src)

    def run():
        return streaming.drain(streaming.stream_ledger(spark, src, schema_of(spark), ["key"], "5 days"), out)

    assert sorted(r.key for r in run().collect()) == ["1", "2"]
    land(spark, [event(1, 2), event(2, 3)], src)
    assert sorted(r.key for r in run().collect()) == ["1", "2", "3"]


def test_settled_days_never_change(spark, tmp_path):
    src, out, upd = (str(tmp_path / n) for n in ("src", "out", "upd"))
    land(spark, [event(0.1, 1), event(0.5, 2), event(1.2, 3), event(3.5, 4)], src)

    def days():
        return streaming.settled_days(streaming.landed(spark, src, schema_of(spark), "1 day"), usd=F.sum("usd"))

    assert {k.day: v["n"] for k, v in by(streaming.drain(days(), out), "day").items()} == {1: 2, 2: 1}
    assert {k.day: v["n"] for k, v in by(streaming.latest_updates(streaming.drain_updates(days(), upd), ["day"]), "day").items()} == {1: 2, 2: 1, 4: 1}
    land(spark, [event(0.3, 5), event(3.6, 6), event(9, 7)], src)
    settled = by(streaming.drain(days(), out), "day")
    assert {k.day: v["n"] for k, v in settled.items()} == {1: 2, 2: 1, 4: 2}
    seen = by(streaming.latest_updates(streaming.drain_updates(days(), upd), ["day"]), "day")
    assert {k.day: v["n"] for k, v in seen.items()} == {1: 2, 2: 1, 4: 2, 10: 1}


def test_published_rows_survive_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "pub")
    publish = streaming.publish_batch(path, ["day"])
    frame = lambda rows: spark.createDataFrame(rows, "day int, n int")
    publish(frame([(1, 10), (2, 20)]), 0)
    publish(frame([(2, 99), (3, 30)]), 1)
    publish(frame([(2, 99), (3, 30)]), 1)
    publish(frame([(1, 10), (2, 20)]), 0)
    assert {k: v["n"] for k, v in by(spark.read.parquet(path).drop("batch"), "day").items()} == {1: 10, 2: 20, 3: 30}


def test_sliding_windows_overlap(spark, tmp_path):
    src = str(tmp_path / "src")
    land(spark, [event(1, 1, 5), event(1.02, 2, 7, "IN"), event(5, 3)], src)
    kpis = streaming.sliding_kpis(streaming.landed(spark, src, schema_of(spark), "1 hour"), "24 hours", "6 hours")
    got = by(streaming.drain(kpis, str(tmp_path / "out")), "as_of")
    assert [k.isoformat(" ") for k in sorted(got)][:4] == [f"2024-01-0{d}" for d in ("2 06:00:00", "2 12:00:00", "2 18:00:00", "3 00:00:00")]
    assert all((v["out_usd"], v["in_usd"], v["out_tx"]) == (5.0, 7.0, 1) for k, v in sorted(got.items())[:4])


def test_quote_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(8)
    schema = "asset string, ts timestamp_ntz, key string, price double, fallback double"
    rows = [
        (a, T0 + timedelta(minutes=i), f"{i:03}", rnd.choice([None, 0.0, rnd.lognormvariate(0, 1)]), rnd.choice([None, rnd.lognormvariate(0, 1)]))
        for a in "TU" for i in range(60)
    ]
    src, out, sliced = (str(tmp_path / n) for n in ("src", "out", "sliced"))
    start = spark.createDataFrame([("T", 1.0), ("U", 2.0)], "asset string, anchor double")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.ROCKSDB)
    batch = streaming.quote_batch(sliced, start, rows_per_slice=4)
    try:
        for lo, hi in ((0, 25), (25, 60)):
            land(spark, [r for r in rows if lo <= int(r[2]) < hi], src, schema)
            stream = streaming.landed(spark, src, schema_of(spark, schema))
            got = streaming.drain(streaming.validate_quotes_stream(stream, {"T": 1.0, "U": 2.0}), out)
            cut = streaming.each_batch(stream, sliced, batch, "append", JUDGED)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = by(validate_quotes(spark.createDataFrame(rows, schema), start), "asset", "key")
    judged = by(cut, "asset", "key")
    for seen in (by(got, "asset", "key"), judged):
        assert set(seen) == set(want)
        for k, w in want.items():
            assert (seen[k]["rate"], seen[k]["source"], seen[k]["anchor"]) == (w["rate"], w["source"], w["anchor"])
    batch(spark.createDataFrame([r for r in rows if int(r[2]) >= 25], schema), 1)
    assert by(spark.read.parquet(sliced).select(cut.columns), "asset", "key") == judged


def test_pinned_net_follows_the_slower_side(spark, tmp_path):
    schema = "asset string, direction string, blk long, usd double"
    batches = [
        [("T", "OUT", 5, 1.0), ("T", "OUT", 9, 2.0), ("U", "OUT", 7, 4.0), ("U", "OUT", None, 99.0)],
        [("T", "IN", 3, 10.0), ("T", "IN", 6, 20.0)],
        [],
        [("T", "IN", 8, 40.0), ("T", "OUT", 4, 0.5), ("U", "IN", 0, 0.25)],
        [("T", "IN", 30, 7.0), ("T", "OUT", 20, 3.0), ("T", "OUT", 20, 3.0)],
    ]
    path, seen = str(tmp_path / "net"), {}

    def note(net, batch_id):
        seen[batch_id] = {r.asset: r.net for r in net.collect()}

    publish = streaming.pinned_batch(path, note)
    sent = []
    for i, rows in enumerate(batches):
        sent += rows
        for _ in range(2):  # a batch that runs again changes nothing
            publish(spark.createDataFrame(rows, schema), i)
        whole = pinned(spark.createDataFrame(sent, schema)).groupBy("asset").agg(F.sum(signed("usd")).alias("net"))
        assert {a: n for a, n in seen[i].items() if n} == {r.asset: r.net for r in whole.collect() if r.net}
    assert seen[1] == {"T": 29.0, "U": 0.0} and seen[4] == {"T": 60.5, "U": -3.75}
    left = spark.read.parquet(path).filter("batch = 4 AND asset IS NOT NULL")
    assert {(r.asset, r.blk) for r in left.collect()} == {("T", None), ("T", 30), ("U", None)}
