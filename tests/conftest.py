from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tallyflow.session import session

LEDGER = (
    "key string, direction string, ts timestamp_ntz, day date, asset string, val double, blk long, cp string, usd double"
)
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "tests", "local[4]",
        **{
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def ledger(spark):
    """Rows ``(direction, seconds after T0, asset, val, cp[, usd])`` as a ledger."""

    def make(rows):
        full = []
        for i, (direction, sec, asset, val, cp, *usd) in enumerate(rows):
            ts = T0 + timedelta(seconds=sec)
            full.append((str(i), direction, ts, ts.date(), asset, float(val), i + 1, cp, float(usd[0] if usd else val)))
        return spark.createDataFrame(full, LEDGER)

    return make


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by(df, *keys):
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        assert key not in out
        out[key if len(keys) > 1 else key[0]] = row.asDict()
    return out
