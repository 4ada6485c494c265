import math
import random

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import behaviour as b
from tests.conftest import by, one

def feeds():
    rnd = random.Random(11)
    out = {
        "even": [60 * i for i in range(40)],
        "same": [500] * 12,
        "edge": [600 * i for i in range(15)] + [600 * i + 601 for i in range(15)],
        "pairs": [x for i in range(20) for x in (1000 * i, 1000 * i)],
        "few": [0, 5],
    }
    for k in range(6):
        t, secs = rnd.randrange(5000), []
        for _ in range(rnd.randrange(10, 80)):
            t += int(rnd.choice([0, 0, 1, 20, 300, 599, 600, 5000, 40000]) * rnd.random() ** 0.3)
            secs.append(t)
        out[f"r{k}"] = secs
    return out


LN6 = math.log(6)
BY_HAND = {
    # 39 gaps of 60 s in one bin; 600 s hold 11 of 40 events
    "even": {"n": 40, "span_h": 0.65, "ent": 0.0, "acf": 0.0, "burst": 11 / 40},
    "same": {"n": 12, "span_h": 0.0, "ent": 0.0, "acf": 0.0, "burst": 1.0},
    # 20 gaps of 0 s and 19 of 1000 s take turns
    "pairs": {"n": 40, "span_h": 19000 / 3600, "ent": -(20 / 39 * math.log(20 / 39) + 19 / 39 * math.log(19 / 39)) / LN6, "acf": -1.0, "burst": 2 / 40},
}


@pytest.mark.parametrize("slice_seconds", [700, 3600, 86400, b.SLICE_SECONDS])
def test_cadence_by_hand_and_in_slices(ledger, slice_seconds):
    data = feeds()
    rows = [("OUT", s, "T", 1, cp) for cp, secs in data.items() for s in secs]
    rows += [("OUT", s + 86400 * 3, "T", 1, f"later {cp}") for cp, secs in data.items() for s in secs]
    random.Random(1).shuffle(rows)
    got = by(b.cadence(ledger(rows), min_events=10, slice_seconds=slice_seconds), "cp")
    whole = by(b.cadence(ledger(rows), min_events=10), "cp")
    assert set(got) == {f"{p}{cp}" for cp in set(data) - {"few"} for p in ("", "later ")}
    for cp, want in BY_HAND.items():
        assert {k: got[cp][k] for k in want} == pytest.approx(want, abs=1e-9), cp
    for cp, row in got.items():  # neither the slices nor a shift of all times change a measure
        for other in (whole[cp], got[cp.removeprefix("later ")]):
            assert [row[k] for k in ("n", "span_h", "ent", "acf", "burst")] == pytest.approx([other[k] for k in ("n", "span_h", "ent", "acf", "burst")], abs=1e-9), cp


@pytest.mark.parametrize("slice_seconds", [700, b.SLICE_SECONDS])
def test_gaps_match_brute_force(ledger, slice_seconds):
    data = feeds()
    rows = [("OUT", s, "T", 1, cp) for cp, secs in data.items() for s in secs]
    got = {}
    for r in b.gaps(ledger(rows), slice_seconds=slice_seconds).collect():
        got.setdefault(r.entity, []).extend([r.gap] * r.n)
    for cp, secs in data.items():
        secs = sorted(secs)
        assert sorted(got.get(cp, [])) == sorted(y - x for x, y in zip(secs, secs[1:]))


def test_stored_slices_and_later_events_give_the_same(ledger):
    data = feeds()
    rows = ledger([("OUT", s, "T", 1, cp) for cp, secs in data.items() for s in secs])
    length, start = 3600, 1704067200
    cut = start + 4 * length
    seconds = b.active_seconds(rows)
    stored = b.slice_summaries(seconds.filter(f"sec <= {cut + 600}"), length).filter(f"slice < {cut // length}")
    later = b.slice_summaries(seconds.filter(f"sec >= {cut}"), length).filter(f"slice >= {cut // length}")
    assert by(b.stitched(stored.unionByName(later)), "cp") == by(b.cadence(rows, slice_seconds=length), "cp")


def test_volume_threshold_reads_the_rank(spark):
    counts = [1] * 15 + [2, 3, 40, 50, 60]
    frame = spark.createDataFrame([(c,) for c in counts], "n long")
    assert one(b.volume_threshold(frame))["high_volume"] == max(15, sorted(counts)[int(len(counts) * 0.95)])
    assert one(b.volume_threshold(frame.limit(19)))["high_volume"] is None


def test_flags_tags_and_status(ledger):
    from pyspark.sql import functions as F

    rows = [("OUT", 60 * i, "T", 0.1, "steady") for i in range(40)]
    rows += [("OUT", i, "T", 0.1, "bursty") for i in range(20)] + [("OUT", 30000, "T", 0.1, "bursty")]
    rows += [("OUT", int(7000 * i**1.3) % 400000, "T", 0.1, "calm") for i in range(12)]
    rows += [("OUT", 5, "T", 3, "calm"), ("OUT", 6, "T", 3, "other")]
    rows = ledger(rows).withColumn("cat", F.when(F.col("val") < 1, "invoke").otherwise("growth"))
    rows = rows.withColumn("fine", F.when(F.col("val") == 3, "credit").otherwise("invoke"))
    got = by(b.fingerprints(rows, ("credit",)), "cp")
    assert got["steady"]["flags"] == ["uniform cadence"] and got["steady"]["status"] == "review"
    assert got["bursty"]["flags"] == ["burst cluster"] and got["bursty"]["usd"] == 2.1
    assert got["calm"]["flags"] == [] and got["calm"]["tags"] == ["earn+receive"] and got["calm"]["status"] == "organic"
    assert "other" not in got
    assert [r.cp for r in b.review_order(b.fingerprints(rows, ("credit",))).collect()][-1] == "calm"


def test_one_recipient_with_a_third_of_the_ledger(spark):
    """Events per second are counted before any shuffle, so copies cost nothing downstream."""
    hot = spark.range(200_000).selectExpr("'hot' AS cp", "timestamp_seconds(1704067200 + id % 977) AS ts")
    rest = spark.range(400_000).selectExpr("concat('c', id % 5000) AS cp", "timestamp_seconds(1704067200 + id * 7) AS ts")
    events = hot.unionByName(rest)
    seconds = b.active_seconds(events)
    assert seconds.filter("entity = 'hot'").count() == 977
    row = by(b.cadence(events, min_events=1000), "cp")["hot"]
    assert row["n"] == 200_000 and row["span_h"] == pytest.approx(976 / 3600) and row["burst"] > 0.6 and row["ent"] < 0.1


def test_fullest_burst_of_dense_seconds(spark):
    """Windows hold both ends: 601 seconds in a row make one, and so do two seconds 600 apart across a cut."""
    rows = [("dense", s, 1) for s in range(1000)] + [("apart", 1700, 4), ("apart", 2300, 5), ("apart", 2301, 2)]
    seconds = spark.createDataFrame(rows, "entity string, sec long, n long")
    for length in (2000, 86400):
        got = {r.entity: r.burst for r in b.slice_summaries(seconds, length).groupBy("entity").agg(F.max("burst").alias("burst")).collect()}
        assert got == {"dense": 601, "apart": 9}
    plan = b.slice_summaries(seconds)._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" in plan and "currentrow$(), 600" not in plan
