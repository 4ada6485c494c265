"""What a run of quotes does to any state it may start from, so that runs can be worked out apart and joined (WIN20).

A quote asks two things of the state before it: is the anchor in band, and is the pending
quote close. Both are questions about intervals, so a run is a list of pieces: for all
anchors from ``lo`` to ``hi``, and a pending quote that is or is not close to the run's first
price, it ends with this anchor (none: the one it began with) and this pending quote. Starts
that have met in one state stay together, so pieces are few however long the run: only
anchors that no quote has moved yet are told apart, by the last price alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

KEPT = "kept"


class QuoteState(NamedTuple):
    """Anchor to judge against, the last in-band quote, and whether any quote set the anchor."""

    anchor: float | None
    pending: float | None
    accepted: bool


class Piece(NamedTuple):
    close: bool
    lo: float
    hi: float
    anchor: float | None
    pending: float | None


class QuoteMap(NamedTuple):
    """``first`` is the run's first price; without one, the pending quote stays what it was."""

    first: float | None
    pieces: list[Piece]


def inside(price: float | None, centre: float | None, factor: float) -> bool:
    return price is not None and centre is not None and centre / factor < price < centre * factor


def quote_step(
    state: QuoteState, price: float | None, fallback: float | None, factor: float, confirm: float
) -> tuple[QuoteState, float | None, str]:
    """Next state, the rate in force and its source.

    No price means the quote could not be fetched; a zero price is a rejected
    one and forgets the pending quote. Two close in-band quotes in a row move
    the anchor; a sane fallback price moves it at once. Without an anchor nothing
    can be judged: there is no rate, and the source says so.
    """
    if state.anchor is None:
        return state, None, "no-anchor"
    if price is not None and price > 0 and inside(price, state.anchor, factor):
        moved = inside(price, state.pending, confirm)
        after = QuoteState(price if moved else state.anchor, price, state.accepted or moved)
        return after, price, "primary"
    pending = state.pending if price is None else None
    if inside(fallback, state.anchor, factor):
        return QuoteState(fallback, pending, True), fallback, "secondary"
    return state._replace(pending=pending), state.anchor, "last-accepted" if state.accepted else "fallback"


def bands(values: Sequence[float | None], factor: float) -> list[tuple[float, float]]:
    """The least and greatest anchor each value is in band of, to the last bit; (inf, -inf) if there is none."""
    v = np.array([math.nan if x is None else x for x in values], float)
    real = np.isfinite(v) & (v > 0)
    v = np.where(real, v, 1.0)
    with np.errstate(over="ignore"):
        lo, hi = v / factor, v * factor
        for _ in range(3):  # begin outside, whichever way the quotient was rounded
            lo, hi = np.nextafter(lo, -np.inf), np.nextafter(hi, np.inf)
        for _ in range(6):
            lo = np.where(lo * factor > v, lo, np.nextafter(lo, np.inf))
            hi = np.where(hi / factor < v, hi, np.nextafter(hi, -np.inf))
    return list(zip(np.where(real, lo, np.inf).tolist(), np.where(real, hi, -np.inf).tolist()))


def _cut(parts: list[tuple], lo: float, hi: float) -> tuple[list[tuple], list[tuple]]:
    """Parts ``(close, lo, hi)`` within [lo, hi], and the rest."""
    if lo > hi:
        return [], parts
    within, rest = [], []
    for close, x, y in parts:
        if y < lo or x > hi:
            rest.append((close, x, y))
            continue
        if x < lo:
            rest.append((close, x, math.nextafter(lo, -math.inf)))
        if y > hi:
            rest.append((close, math.nextafter(hi, math.inf), y))
        within.append((close, max(x, lo), min(y, hi)))
    return within, rest


def _joined(parts: list[tuple]) -> list[tuple]:
    """The same anchors in as few parts as can be."""
    out: list[tuple] = []
    for close, x, y in sorted(parts):
        if out and out[-1][0] == close and math.nextafter(out[-1][2], math.inf) >= x:
            out[-1] = (close, out[-1][1], max(y, out[-1][2]))
        else:
            out.append((close, x, y))
    return out


def quote_map(prices: Sequence[float | None], fallbacks: Sequence[float | None], factor: float, confirm: float) -> QuoteMap:
    """The map of a run of quotes in order."""
    everywhere = [(close, -math.inf, math.inf) for close in (False, True)]
    live: dict[tuple, list[tuple]] = {(KEPT, KEPT): everywhere}
    for price, fallback, priced, backed in zip(prices, fallbacks, bands(prices, factor), bands(fallbacks, factor)):
        if price is None and fallback is None:
            continue
        after: dict[tuple, list[tuple]] = {}

        def put(anchor, pending, parts):
            if parts:
                after.setdefault((anchor, pending), []).extend(parts)

        for (anchor, pending), parts in live.items():
            asked = [(pending, parts)]
            if pending is KEPT and price is not None:  # the first price: close or not is what the pieces are told apart by
                asked = [(price, [p for p in parts if p[0]]), (None, [p for p in parts if not p[0]])]
            for before, some in asked:
                if anchor is not KEPT:
                    state, _, _ = quote_step(QuoteState(anchor, before, True), price, fallback, factor, confirm)
                    put(state.anchor, state.pending, some)
                    continue
                taken, rest = _cut(some, *priced)
                put(price if taken and inside(price, before, confirm) else KEPT, price, taken)
                cleared = before if price is None else None
                moved, rest = _cut(rest, *backed)
                put(fallback, cleared, moved)
                put(KEPT, cleared, rest)
        live = {key: parts if len(parts) < 5 else _joined(parts) for key, parts in after.items()}
    first = next((p for p in prices if p is not None), None)
    plain = lambda x: None if x is KEPT else x
    return QuoteMap(first, [Piece(*part, plain(a), plain(p)) for (a, p), parts in live.items() for part in _joined(parts)])


def applied(run: QuoteMap, state: QuoteState, confirm: float) -> QuoteState:
    """The state after the run."""
    if state.anchor is None:
        return state
    close = inside(run.first, state.pending, confirm)
    piece = next(p for p in run.pieces if p.close == close and p.lo <= state.anchor <= p.hi)
    pending = state.pending if run.first is None else piece.pending
    return QuoteState(state.anchor if piece.anchor is None else piece.anchor, pending, state.accepted or piece.anchor is not None)


def chained(one: QuoteMap, two: QuoteMap, confirm: float) -> QuoteMap:
    """The map of both runs, one behind the other."""
    found: dict[tuple, list[tuple]] = {}
    for p in one.pieces:
        close = p.close if one.first is None else inside(two.first, p.pending, confirm)
        for q in two.pieces:
            lo, hi = (p.lo, p.hi) if p.anchor is not None else (max(p.lo, q.lo), min(p.hi, q.hi))
            met = q.lo <= p.anchor <= q.hi if p.anchor is not None else lo <= hi
            if met and q.close == close:
                anchor = p.anchor if q.anchor is None else q.anchor
                found.setdefault((anchor, p.pending if two.first is None else q.pending), []).append((p.close, lo, hi))
    first = two.first if one.first is None else one.first
    return QuoteMap(first, [Piece(*part, *key) for key, parts in found.items() for part in _joined(parts)])
