from pyspark.sql import functions as F

from tallyflow.functions import DEFAULT_SCHEME, bucket_of, classified, folded_class, range_band, short_key, tidy
from tests.conftest import by


def test_size_bands_and_classes(spark):
    bands = {
        0.0: "micro", 0.0599: "micro", 0.06: "other", 0.0919: "other", 0.0925: "b010", 0.1079: "b010", 0.1081: "other", 0.5: "other", 0.93: "b1", 1.07: "b1",
        1.09: "other", 2.9: "b3", 5.3: "b5", 9.3: "b10", 24.0: "b25", 45.9: "other", 46.1: "b50", 53.9: "b50", 1000.0: "other",
    }
    df = classified(spark.createDataFrame([(a,) for a in bands], "usd double"), DEFAULT_SCHEME)
    got = by(df, "usd")
    assert {a: got[a]["band"] for a in bands} == bands
    assert got[0.0925]["fine"] == "invoke" and got[0.0925]["cat"] == "invoke"
    assert got[2.9]["fine"] == "$3 credit" and got[2.9]["cat"] == "growth"
    assert got[0.0]["fine"] == "test" and got[0.0]["cat"] == "micro"
    assert got[0.06]["fine"] == "nonstandard (small)" and got[0.06]["cat"] == "nonstandard"
    assert got[0.5]["fine"] == "nonstandard (large)"


def test_folded_ranges_buckets_and_short_keys(spark):
    df = spark.createDataFrame([("nonstandard", 0.3, "0xABCDEF0123456789"), ("nonstandard", 3.0, "0xabcDEFffff6789"), ("equip", 1.0, "0x1")], "cat string, usd double, a string")
    rows = df.select(
        F.expr(folded_class()).alias("f"), F.expr(range_band("usd", (0.4, 2), ("s", "m", "l"))).alias("r"),
        short_key(F.col("a"), 6).alias("k"), F.expr(bucket_of("'stripe $25'")).alias("b"),
    ).collect()
    assert [r.f for r in rows] == ["invoke", "growth", "equip"]
    assert [r.r for r in rows] == ["s", "l", "m"]
    assert rows[0].k == rows[1].k == "0xabcd6789"
    assert rows[0].b == "stripe"


def test_tidy_removes_addition_noise(spark):
    row = spark.range(1).select(tidy(F.lit(0.1) + F.lit(0.2) + F.lit(0.75), 1).alias("a"), tidy(F.lit(6492.649999999999), 1).alias("b")).first()
    assert (row.a, row.b) == (1.1, 6492.7)
