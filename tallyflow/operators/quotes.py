"""Quote validation: a small state machine over each asset's quotes (WIN20)."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.operators.quotemaps import Piece, QuoteMap, QuoteState, applied, chained, quote_map, quote_step
from tallyflow.session import settle

STATE = "anchor double, pending double, accepted boolean"
JUDGED = "asset string, ts timestamp_ntz, key string, price double, rate double, source string, anchor double"
_PIECES = ("close", "lo", "hi", "to_anchor", "to_pending")
_MAP = "asset string, slice long, first double, close array<boolean>, lo array<double>, hi array<double>, to_anchor array<double>, to_pending array<double>"
_ENDED = ("end_anchor", "end_pending", "end_accepted")


def _optional(value: float) -> float | None:
    return None if pd.isna(value) else float(value)


def _optionals(values) -> list[float | None]:
    return [None if x is None or x != x else float(x) for x in values]


def run_quotes(state: QuoteState, quotes: pd.DataFrame, factor: float, confirm: float):
    """Rates, sources and anchors for quotes already in order, and the end state."""
    out = []
    for price, fallback in zip(_optionals(quotes["price"].tolist()), _optionals(quotes["fallback"].tolist())):
        state, rate, source = quote_step(state, price, fallback, factor, confirm)
        out.append((rate, source, state.anchor))
    return state, out


def _state_of(row) -> QuoteState:
    return QuoteState(_optional(row.anchor), _optional(row.pending), bool(row.accepted))


def _map_of(row) -> QuoteMap:
    columns = (row.close, row.lo, row.hi, _optionals(row.to_anchor), _optionals(row.to_pending))
    return QuoteMap(_optional(row.first), [Piece(bool(c), float(lo), float(hi), a, p) for c, lo, hi, a, p in zip(*columns)])


def _map_row(asset, number, run: QuoteMap) -> pd.DataFrame:
    parts = [list(column) for column in zip(*run.pieces)]
    return pd.DataFrame([(asset, number, run.first, *parts)], columns=["asset", "slice", "first", *_PIECES])


def sliced(quotes: DataFrame, rows_per_slice: int) -> DataFrame:
    """Adds ``slice``: consecutive runs of fewer than twice ``rows_per_slice`` quotes per asset.

    The cuts come from counts per second, so the rows of a busy asset spread
    over many groups. Only quotes of a second that holds more than a slice are numbered one by one.
    """
    timed = quotes.withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    per_sec = timed.groupBy("asset", "sec").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("asset").orderBy("sec")) - F.col("n")
    cuts = settle(per_sec.withColumn("before", before), "quote_cuts")
    cut = lambda ahead: F.floor(ahead / rows_per_slice).alias("slice")
    full = F.col("n") > rows_per_slice
    some = timed.join(cuts.filter(~full), ["asset", "sec"]).select(*quotes.columns, cut(F.col("before")))
    place = F.row_number().over(W.partitionBy("asset", "sec").orderBy("ts", "key")) - 1
    return some.unionByName(timed.join(cuts.filter(full), ["asset", "sec"]).select(*quotes.columns, cut(F.col("before") + place)))


def _nodes(maps: DataFrame, fan: int) -> DataFrame:
    return maps.withColumn("node", F.floor(F.col("slice") / fan))


def _slice_starts(maps: DataFrame, states: DataFrame, fan: int, confirm: float) -> tuple[DataFrame, int]:
    """The state each slice starts from and ends in, and how many tables of maps that took.

    Maps of ``fan`` slices are chained into one until an asset has no more than
    ``fan``; then the states go down the same tree. A table per level and way, so the
    logarithm of the slices, whatever the quotes are.
    """

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        runs = [_map_of(row) for row in group.sort_values("slice").itertuples()]
        return _map_row(group["asset"].iloc[0], group["node"].iloc[0], functools.reduce(lambda a, b: chained(a, b, confirm), runs))

    def start(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group.sort_values("slice").itertuples())
        state, out = _state_of(rows[0]), []
        for row in rows:
            after = applied(_map_of(row), state, confirm)
            out.append((row.asset, row.slice, *state, *after))
            state = after
        return pd.DataFrame(out, columns=["asset", "slice", *QuoteState._fields, *_ENDED])

    levels = [_nodes(maps, fan)]
    while not levels[-1].filter("node > 0").isEmpty():
        levels.append(_nodes(settle(levels[-1].groupBy("asset", "node").applyInPandas(chain, _MAP), "quote_maps"), fan))
    ended = "end_anchor double, end_pending double, end_accepted boolean"
    begin = states.select("asset", F.lit(0).cast("long").alias("node"), *QuoteState._fields)
    for level in reversed(levels):
        known = level.join(begin, ["asset", "node"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
        starts = settle(known.groupBy("asset", "node").applyInPandas(start, f"asset string, slice long, {STATE}, {ended}"), "quote_starts")
        begin = starts.select("asset", F.col("slice").alias("node"), *QuoteState._fields)
    return starts, 2 * len(levels)


def walk_quotes(
    quotes: DataFrame, states: DataFrame, factor: float = 5, confirm: float = 2, rows_per_slice: int = 20_000, fan: int = 64
) -> tuple[DataFrame, DataFrame]:
    """WIN20: the judged quotes, and each asset's ``(asset, anchor, pending, accepted)`` after them.

    ``states`` has the same columns: where each asset stands before the quotes. Slices are
    walked twice, all at once: for their map from any state to the one after, and, once the maps
    have said where each starts, for the rates.
    """
    rows = settle(sliced(quotes.select("asset", "ts", "key", "price", "fallback"), rows_per_slice), "quotes")

    def mapped(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["ts", "key"])
        run = quote_map(_optionals(ordered["price"].tolist()), _optionals(ordered["fallback"].tolist()), factor, confirm)
        return _map_row(group["asset"].iloc[0], group["slice"].iloc[0], run)

    maps = settle(rows.groupBy("asset", "slice").applyInPandas(mapped, _MAP), "quote_maps")
    starts, _ = _slice_starts(maps, states, fan, confirm)

    def judged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", "key"])
        _, out = run_quotes(_state_of(next(group.itertuples())), group, factor, confirm)
        result = group[["asset", "ts", "key", "price"]].copy()
        result[["rate", "source", "anchor"]] = pd.DataFrame(out, index=group.index)
        return result

    ends = starts.groupBy("asset").agg(F.max_by(F.struct(*_ENDED), "slice").alias("end"))
    ends = ends.select("asset", *(F.col(f"end.{e}").alias(f) for e, f in zip(_ENDED, QuoteState._fields)))
    due = starts.select("asset", "slice", *QuoteState._fields)
    return rows.join(due, ["asset", "slice"]).groupBy("asset", "slice").applyInPandas(judged, JUDGED), ends


def validate_quotes(
    quotes: DataFrame, anchors: DataFrame, factor: float = 5, confirm: float = 2, rows_per_slice: int = 20_000, fan: int = 64
) -> DataFrame:
    """WIN20: rate in force, its source and the anchor after every quote.

    ``quotes`` is ``(asset, ts, key, price, fallback)``; ``anchors`` is
    ``(asset, anchor)``. Quotes of an asset without an anchor are kept, without a
    rate. Quotes of one asset with the same time and key come in any order.
    """
    states = anchors.selectExpr("asset", "anchor", "CAST(NULL AS DOUBLE) AS pending", "false AS accepted")
    return walk_quotes(quotes, states, factor, confirm, rows_per_slice, fan)[0]
