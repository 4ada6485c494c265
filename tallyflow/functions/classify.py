"""Amount bands and the fine and coarse classes built on them (CLS1-CLS6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.numbers import quoted

EARNING = ("invoke", "equip")
UNBACKED = ("invoke", "equip", "growth")


@dataclass(frozen=True)
class Scheme:
    """How an amount becomes a size band, a fine class and a coarse class."""

    grid: tuple[tuple[float, str], ...]
    floor: float
    tolerance: float
    fine: Mapping[str, str]
    coarse: Mapping[str, str]
    small_below: float
    backed: tuple[str, ...]
    incentives: tuple[str, ...]
    credit: str
    buckets: Mapping[str, str] = field(default_factory=dict)

    @property
    def price_of(self) -> dict[str, float]:
        """Listed price of each fine class that sits on the grid."""
        return {self.fine[band]: price for price, band in self.grid if band in self.fine}


# Price grid, class names and cut points that results are stated in.
DEFAULT_SCHEME = Scheme(
    grid=((0.10, "b010"), (1, "b1"), (3, "b3"), (5, "b5"), (10, "b10"), (25, "b25"), (50, "b50")),
    floor=0.06,
    tolerance=0.08,
    fine={
        "b010": "invoke", "b1": "equip", "b3": "$3 credit", "b5": "referral $5",
        "b10": "stripe $10", "b25": "stripe $25", "b50": "stripe $50", "micro": "test",
    },
    coarse={"invoke": "invoke", "equip": "equip", "test": "micro"},
    small_below=0.5,
    backed=("stripe $10", "stripe $25", "stripe $50"),
    incentives=("$3 credit", "referral $5"),
    credit="$3 credit",
    buckets={
        "invoke": "c010", "equip": "c1", "$3 credit": "c3", "referral $5": "c5",
        "stripe $10": "stripe", "stripe $25": "stripe", "stripe $50": "stripe",
    },
)


def _case(key: str, mapping: Mapping[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {quoted([k])} THEN {quoted([v])}" for k, v in mapping.items())
    return f"CASE {key} {whens} ELSE {default} END"


def band_names(scheme: Scheme) -> list[str]:
    return ["micro", *(band for _, band in scheme.grid), "other"]


def _by_size(usd: str, scheme: Scheme, values: Mapping[str, str], off_grid: str) -> str:
    """One flat CASE over the grid, so a filter on the result stays a handful of comparisons."""
    near = " ".join(
        f"WHEN abs({usd} - {float(price)}D) / {float(price)}D <= {scheme.tolerance}D THEN {quoted([values[band]])}" for price, band in scheme.grid
    )
    return f"CASE WHEN {usd} < {scheme.floor}D THEN {quoted([values['micro']])} {near} ELSE {off_grid} END"


def size_band(usd: str = "usd", scheme: Scheme = DEFAULT_SCHEME) -> str:
    """CLS1 as SQL text: below the floor, the first grid price within tolerance, or other."""
    return _by_size(usd, scheme, {b: b for b in band_names(scheme)}, "'other'")


def fine_class(usd: str = "usd", scheme: Scheme = DEFAULT_SCHEME) -> str:
    """CLS2 as SQL text: named grid sizes; everything off the grid stays visible on its own."""
    off_grid = f"CASE WHEN {usd} < {scheme.small_below}D THEN 'nonstandard (small)' ELSE 'nonstandard (large)' END"
    return _by_size(usd, scheme, scheme.fine, off_grid)


def coarse_class(usd: str = "usd", scheme: Scheme = DEFAULT_SCHEME) -> str:
    """CLS2 as SQL text: the coarse class of each fine one; grid sizes without one are growth."""
    coarse = {band: scheme.coarse.get(fine, "growth") for band, fine in scheme.fine.items()}
    return _by_size(usd, scheme, coarse, "'nonstandard'")


def classified(df: DataFrame, scheme: Scheme = DEFAULT_SCHEME) -> DataFrame:
    """Adds ``band``, ``fine`` and ``cat`` from ``usd``."""
    return df.selectExpr(
        "*", f"{size_band(scheme=scheme)} AS band", f"{fine_class(scheme=scheme)} AS fine", f"{coarse_class(scheme=scheme)} AS cat"
    )


def is_unbacked(scheme: Scheme = DEFAULT_SCHEME) -> str:
    """FLT4 as SQL text: classified payouts that no purchase pays for."""
    return f"(cat IN ({quoted(UNBACKED)}) AND fine NOT IN ({quoted(scheme.backed)}))"


def range_band(usd: str, edges: Sequence[float], names: Sequence[str]) -> str:
    """CLS3 and CLS6 as SQL text: plain ranges; ``names`` has one more entry than ``edges``."""
    whens = " ".join(f"WHEN {usd} < {float(edge)}D THEN {quoted([name])}" for edge, name in zip(edges, names))
    return f"CASE {whens} ELSE {quoted([names[-1]])} END"


def folded_class(cat: str = "cat", usd: str = "usd", scheme: Scheme = DEFAULT_SCHEME) -> str:
    """CLS4 as SQL text: the older reading that folds off-grid sizes into a class."""
    return f"CASE WHEN {cat} <> 'nonstandard' THEN {cat} WHEN {usd} < {scheme.small_below}D THEN 'invoke' ELSE 'growth' END"


def bucket_of(fine: str = "fine", scheme: Scheme = DEFAULT_SCHEME) -> str:
    """The older bucket of a fine class, as SQL text."""
    return _case(fine, scheme.buckets, "'other'")


def short_key(address: Column, head: int, tail: int = 4) -> Column:
    """CLS5: the first ``head`` and last ``tail`` characters, lower case."""
    return F.lower(F.concat(F.substring(address, 1, head), F.right(address, F.lit(tail))))
