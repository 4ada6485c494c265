"""Fingerprints of payout cadence per recipient (WIN1-WIN7, JN13).

Events of one recipient are first counted per second, the grain of the ledger.
That bounds a recipient by the seconds it was active, however many rows it has,
and the counting combines before the shuffle. Its seconds are then cut into
slices, so a recipient that holds much of the ledger is worked on by many tasks
and only one summary row per slice meets again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions import exprs, quoted, tidied
from tallyflow.operators.facts import with_label
from tallyflow.session import settle

# Upper edges of the gap bins, in seconds.
GAP_EDGES = (30, 120, 600, 3600, 21600)
BURST_SECONDS = 600
SLICE_SECONDS = 30 * 86400


@dataclass(frozen=True)
class CadenceRules:
    """When a cadence is worth a review. Defaults are fixed values."""

    min_events: int = 10
    uniform_events: int = 30
    uniform_entropy: float = 0.45
    scripted_events: int = 30
    scripted_acf: float = 0.6
    burst_events: int = 15
    burst_share: float = 0.7
    burst_span_hours: float = 2
    volume_floor: int = 15
    volume_quantile: float = 0.95
    volume_entities: int = 20


def _in_bin(gap: str, i: int) -> str:
    edges = [f"{gap} >= {GAP_EDGES[i - 1]}"] if i > 0 else []
    edges += [f"{gap} < {GAP_EDGES[i]}"] if i < len(GAP_EDGES) else []
    return " AND ".join(edges)


BINS = range(len(GAP_EDGES) + 1)


def active_seconds(events: DataFrame, entity: str = "cp", ts: str = "ts") -> DataFrame:
    """``(entity, sec, n)``: how many events each second held."""
    sec = F.unix_seconds(F.col(ts).cast("timestamp")).alias("sec")
    return events.groupBy(F.col(entity).alias("entity"), sec).agg(F.count("*").alias("n"))


def gaps(events: DataFrame, entity: str = "cp", ts: str = "ts", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """WIN1: gaps in seconds between consecutive events, as ``(entity, sec, gap, n)``.

    ``n`` counts equal gaps ending in that second: events sharing a second are 0 apart.
    """
    seconds = settle(active_seconds(events, entity, ts), "seconds").withColumn("slice", F.floor(F.col("sec") / slice_seconds))
    edges = seconds.groupBy("entity", "slice").agg(F.max("sec").alias("last_sec"))
    edges = edges.withColumn("before", F.lag("last_sec").over(W.partitionBy("entity").orderBy("slice"))).drop("last_sec")
    previous = F.lag("sec").over(W.partitionBy("entity", "slice").orderBy("sec"))
    entered = seconds.withColumn("prev", previous).join(edges, ["entity", "slice"])
    gap = F.col("sec") - F.coalesce("prev", "before")
    one = lambda g, n: F.struct(g.cast("long").alias("gap"), n.cast("long").alias("n"))
    both = F.array(one(gap, F.lit(1)), one(F.lit(0), F.col("n") - 1))
    return entered.select("entity", "sec", F.inline(F.filter(both, lambda x: x.gap.isNotNull() & (x.n > 0))))


def slice_summaries(seconds: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row per (entity, slice): sums over inner gaps, the edges, and the fullest burst.

    The first seconds of a slice are lent to the slice before it, so a burst
    window that crosses the cut is counted whole. A slice is final once those
    seconds have passed; its row can be stored and only later events summarised.
    A second enters a running sum and leaves it after the burst window, so the
    fullest window costs one ordered pass however dense the seconds are.
    """
    own = f"floor(sec / {slice_seconds})"
    lent = f"CASE WHEN sec % {slice_seconds} <= {BURST_SECONDS} THEN {own} - 1 END"
    placed = seconds.selectExpr("entity", "sec", "n", f"{own} AS own", f"explode(array_compact(array({own}, {lent}))) AS slice")
    order = "PARTITION BY entity, slice ORDER BY sec"
    measures = {
        "sec": "sec", "n": "n", "gap": f"sec - lag(sec) OVER ({order})",
        "next_gap": f"CASE WHEN lead(own) OVER ({order}) = slice THEN lead(sec) OVER ({order}) - sec END",
    }
    inner = placed.selectExpr("entity", "slice", "sec AS at", "n AS more", *(f"CASE WHEN own = slice THEN {v} END AS {k}" for k, v in measures.items()))
    left = f"at + {BURST_SECONDS + 1} AS at, -more AS more, {', '.join(f'CAST(NULL AS BIGINT) AS {k}' for k in measures)}"
    marked = inner.selectExpr("entity", "slice", f"inline(array(struct(at, more, {', '.join(measures)}), struct({left})))")
    seen = marked.selectExpr("*", "sum(more) OVER (PARTITION BY entity, slice ORDER BY at RANGE UNBOUNDED PRECEDING) AS burst")
    return seen.groupBy("entity", "slice").agg(
        *exprs(
            "count(sec) AS secs", "sum(n) AS events", "min(sec) AS first_sec", "max(sec) AS last_sec",
            "sum(n) FILTER (WHERE gap IS NULL) AS first_n", "sum(n) FILTER (WHERE next_gap IS NULL) AS last_n",
            "sum(next_gap) FILTER (WHERE gap IS NULL) AS first_gap", "sum(gap) FILTER (WHERE next_gap IS NULL) AS last_gap",
            "sum(gap * gap) AS squares", "sum(gap * next_gap) FILTER (WHERE n = 1) AS products", "max(burst) AS burst",
            [f"count_if({_in_bin('gap', i)}) AS bin{i}" for i in BINS],
        )
    ).filter("secs > 0")


def cadence(
    events: DataFrame, entity: str = "cp", ts: str = "ts", min_events: int = 10, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """WIN1-WIN5, JN13: count, span, gap entropy, lag-1 autocorrelation and burst ratio."""
    return stitched(slice_summaries(active_seconds(events, entity, ts), slice_seconds), min_events)


def stitched(slices: DataFrame, min_events: int = 10) -> DataFrame:
    """The measures of :func:`cadence` from slice summaries.

    Sums of gaps, squares and neighbouring products are whole numbers and stay
    exact, so constant gaps give a variance of exactly zero.
    """
    order = "PARTITION BY entity ORDER BY slice"
    joined = slices.selectExpr(
        "*",
        f"first_sec - lag(last_sec) OVER ({order}) AS gap_in",
        f"lead(first_sec) OVER ({order}) - last_sec AS gap_out",
    )
    # A second between two gaps adds their product only when it holds one event.
    joint = """CASE WHEN secs = 1 THEN CASE WHEN first_n = 1 THEN gap_in * gap_out END
        ELSE coalesce(CASE WHEN first_n = 1 THEN gap_in * first_gap END, 0) + coalesce(CASE WHEN last_n = 1 THEN last_gap * gap_out END, 0) END"""
    opening = "CASE WHEN gap_in IS NULL THEN CASE WHEN first_n > 1 THEN 0 ELSE coalesce(first_gap, gap_out) END END"
    closing = "CASE WHEN gap_out IS NULL THEN CASE WHEN last_n > 1 THEN 0 ELSE coalesce(last_gap, gap_in) END END"
    exact = lambda text: f"CAST(coalesce({text}, 0) AS DECIMAL(38, 0))"
    binned = [f"sum(bin{i}) + count_if({_in_bin('gap_in', i)}) AS bin{i}" for i in BINS]
    binned[0] = f"sum(bin0) + count_if({_in_bin('gap_in', 0)}) + sum(events - secs) AS bin0"
    per = joined.groupBy("entity").agg(
        *exprs(
            "sum(events) AS n", "min(first_sec) AS t0", "max(last_sec) AS t1", "max(burst) AS burst",
            f"{exact('sum(squares)')} + {exact('sum(gap_in * gap_in)')} AS squares",
            f"{exact('sum(products)')} + {exact(f'sum({joint})')} AS products",
            f"{exact(f'max({opening})')} AS g_first", f"{exact(f'max({closing})')} AS g_last",
            binned,
        )
    ).filter(f"n >= {min_events}")
    part = lambda i: f"CASE WHEN bin{i} > 0 THEN bin{i} / (n - 1) * ln(bin{i} / (n - 1)) ELSE 0D END"
    moments = per.selectExpr(
        "entity AS cp", "n", "(t1 - t0) / 3600 AS span_h", "burst / n AS burst",
        f"CASE WHEN n > 1 THEN greatest(0D, -({' + '.join(part(i) for i in BINS)}) / ln({len(BINS)}D)) ELSE 0D END AS ent",
        "CAST(n - 2 AS DECIMAL(38, 0)) AS pairs", "products", "squares", "g_first", "g_last",
        f"{exact('t1 - t0')} - g_last AS head", f"{exact('t1 - t0')} - g_first AS tail",
    ).selectExpr(
        "*",
        "CAST(pairs * products - head * tail AS DOUBLE) AS co",
        "CAST(pairs * (squares - g_last * g_last) - head * head AS DOUBLE) AS var_head",
        "CAST(pairs * (squares - g_first * g_first) - tail * tail AS DOUBLE) AS var_tail",
    )
    acf = "CASE WHEN n >= 4 AND var_head > 0 AND var_tail > 0 THEN co / (sqrt(var_head) * sqrt(var_tail)) ELSE 0D END AS acf"
    return moments.selectExpr("cp", "n", "span_h", "ent", acf, "burst")


def volume_threshold(counts: DataFrame, rules: CadenceRules = CadenceRules()) -> DataFrame:
    """WIN7: one row holding the count above which a recipient is high volume.

    The rank is read from how many recipients share each count. Distinct counts
    grow with the square root of the ledger, so one task can order them.
    """
    hist = counts.groupBy("n").agg(F.count("*").alias("entities"))
    ranked = hist.selectExpr(
        "n",
        "sum(entities) OVER (ORDER BY n) AS upto",
        "sum(entities) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total",
    )
    at_rank = f"min(n) FILTER (WHERE upto > floor(total * {rules.volume_quantile}D))"
    return ranked.agg(
        F.expr(f"CASE WHEN max(total) >= {rules.volume_entities} THEN greatest({rules.volume_floor}L, {at_rank}) END AS high_volume")
    )


def _present(flags: dict[str, str]) -> str:
    return f"array_compact(array({', '.join(f'CASE WHEN {cond} THEN {quoted([name])} END' for name, cond in flags.items())}))"


def fingerprints(
    ledger: DataFrame,
    incentives: tuple[str, ...],
    rules: CadenceRules = CadenceRules(),
    earning: tuple[str, ...] = ("invoke", "equip"),
    monitored: str = "invoke",
    slice_seconds: int = SLICE_SECONDS,
    labels: DataFrame | None = None,
) -> DataFrame:
    """WIN1-WIN7, JN5: cadence of every earner with enough events, flags, tags and status, and labels if given.

    ``ledger`` carries ``cat`` and ``fine``. Earnings, incentive receipts and the
    counts behind the volume threshold come from one aggregate per recipient,
    written once, so both sides of the join hold each recipient once.
    """
    out = ledger.filter("direction = 'OUT'")
    watched = out.filter(F.col("cat") == monitored)
    shape = cadence(watched, min_events=rules.min_events, slice_seconds=slice_seconds)
    per = out.groupBy("cp").agg(
        *exprs(
            f"count_if(cat = {quoted([monitored])}) AS watched",
            f"sum(usd) FILTER (WHERE cat IN ({quoted(earning)})) AS usd",
            f"count_if(fine IN ({quoted(incentives)})) > 0 AS receives",
        )
    )
    totals = settle(per, "recipients")
    high = volume_threshold(totals.filter("watched > 0").selectExpr("watched AS n"), rules).scalar()
    flags = {
        "uniform cadence": f"n >= {rules.uniform_events} AND ent < {rules.uniform_entropy}D",
        "scripted pattern": f"n >= {rules.scripted_events} AND abs(acf) > greatest({rules.scripted_acf}D, 2 / sqrt(n - 1))",
        "burst cluster": f"n >= {rules.burst_events} AND burst > {rules.burst_share}D AND span_h > {rules.burst_span_hours}D",
    }
    tags = {"high volume": "n > high", "earn+receive": "receives"}
    prints = shape.join(totals, "cp").withColumn("high", high).selectExpr(
        "cp", "n",
        f"{tidied('span_h', 1)} AS span_h", f"{tidied('ent', 2)} AS ent", f"{tidied('acf', 2)} AS acf",
        f"CAST({tidied('burst * 100', 0)} AS BIGINT) AS burst", f"{tidied('usd', 2)} AS usd",
        f"{_present(flags)} AS flags", f"{_present(tags)} AS tags",
        f"CASE WHEN size({_present(flags)}) > 0 THEN 'review' ELSE 'organic' END AS status",
    )
    return prints if labels is None else with_label(prints, labels)


def review_order(fingerprints: DataFrame) -> DataFrame:
    """SRT3: recipients to review first, then by USD."""
    return fingerprints.orderBy(F.col("status") != "review", F.col("usd").desc(), "cp")
