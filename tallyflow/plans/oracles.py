"""The same results as ANSI SQL over the same tables, for checking."""

from __future__ import annotations

A = """a AS (
  SELECT CAST(event_id AS VARCHAR) AS key, CASE WHEN event_type = 'purchase' THEN 'IN' ELSE 'OUT' END AS direction,
         ts, CAST(ts AS DATE) AS day, 'A' || CAST(user_id % 2 AS VARCHAR) AS asset, value AS val, event_id AS blk,
         CAST(user_id AS VARCHAR) AS cp, value AS usd, event_type, user_id,
         CAST(floor(epoch(ts)) AS BIGINT) AS sec
  FROM events)"""

C = A + """, banded AS (
  SELECT *, CASE WHEN usd < 2 THEN 'micro'
      WHEN abs(usd - 5.0::DOUBLE) / 5.0::DOUBLE <= 0.08::DOUBLE THEN 'b5'
      WHEN abs(usd - 10.0::DOUBLE) / 10.0::DOUBLE <= 0.08::DOUBLE THEN 'b10'
      WHEN abs(usd - 25.0::DOUBLE) / 25.0::DOUBLE <= 0.08::DOUBLE THEN 'b25'
      WHEN abs(usd - 50.0::DOUBLE) / 50.0::DOUBLE <= 0.08::DOUBLE THEN 'b50'
      WHEN abs(usd - 100.0::DOUBLE) / 100.0::DOUBLE <= 0.08::DOUBLE THEN 'b100'
      ELSE 'other' END AS band FROM a),
fined AS (
  SELECT *, CASE band WHEN 'b5' THEN 'invoke' WHEN 'b10' THEN 'equip' WHEN 'b25' THEN 'credit' WHEN 'b50' THEN 'referral'
      WHEN 'b100' THEN 'purchase' WHEN 'micro' THEN 'test'
      ELSE CASE WHEN usd < 20 THEN 'nonstandard (small)' ELSE 'nonstandard (large)' END END AS fine FROM banded),
c AS (
  SELECT *, CASE WHEN fine LIKE 'nonstandard%' THEN 'nonstandard' WHEN fine IN ('invoke', 'equip') THEN fine
      WHEN fine = 'test' THEN 'micro' ELSE 'growth' END AS cat FROM fined),
o AS (SELECT *, cat IN ('invoke', 'equip', 'growth') AND fine <> 'purchase' AS unbacked FROM c WHERE direction = 'OUT')"""

B = """b AS (
  SELECT 'OUT' AS direction, l_shipdate AS ts, CAST(l_shipdate AS DATE) AS day, l_quantity AS val,
         's' || CAST(l_suppkey AS VARCHAR) AS cp, l_extendedprice AS usd FROM lineitem
  UNION ALL
  SELECT 'IN', o_orderdate, CAST(o_orderdate AS DATE), 1.0, 'c' || CAST(o_custkey AS VARCHAR), o_totalprice FROM orders)"""

FOLDED = "CASE WHEN cat <> 'nonstandard' THEN cat WHEN usd < 20 THEN 'invoke' ELSE 'growth' END"
SPARSE = "rates AS (SELECT asset, day, avg(val) / 1000 AS rate FROM a WHERE day(day) % 2 = 1 GROUP BY asset, day)"

D = "strftime({0}, '%Y-%m-%d')"


def decimal_rounding(sql: str) -> str:
    """Rounds to 0, 1 or 2 digits in decimals, where halves are exact."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if depth == 1 and sql[end] == "," else comma
            end += 1
        value, digits = decimal_rounding(sql[start + 6 : comma]), sql[comma + 1 : end - 1].strip()
        exact = f"CAST(round(CAST({value} AS DECIMAL(28, 6)), {digits}) AS DOUBLE)"
        out += [sql[at:start], exact if digits in "012" else f"round({value}, {digits})"]
        at = end
    return "".join(out) + sql[at:]


def d(col: str) -> str:
    return D.format(col)


def s(col: str, cond: str | None = None) -> str:
    return f"coalesce(sum({col}) FILTER (WHERE {cond}), 0)" if cond else f"coalesce(sum({col}), 0)"


_ASSET_SUMS = ", ".join(
    f"round({s(col, f'''direction = '{way}' AND asset = '{asset}' ''')}, {p}) AS {name}_{asset}"
    for name, way, col, p in (("out_usd", "OUT", "usd", 2), ("out_raw", "OUT", "val", 1), ("in_raw", "IN", "val", 1))
    for asset in ("A0", "A1")
)


def _facts(recycle: str, more: str) -> str:
    out, inn = "direction = 'OUT'", "direction = 'IN'"
    rec = f"{inn} AND cp = '{recycle}'"
    return f"""round({s('usd', out)}, 2) AS out_usd, round({s('usd', inn)}, 2) AS in_usd,
      round({s('usd', rec)}, 2) AS in_recycled_usd,
      round(round({s('usd', inn)}, 6) - round({s('usd', rec)}, 6), 2) AS in_external_usd,
      round(round({s('usd', inn)}, 6) - round({s('usd', out)}, 6), 2) AS net_usd,
      count(*) FILTER (WHERE {out}) AS out_tx, count(*) FILTER (WHERE {inn}) AS in_tx,
      count(DISTINCT cp) FILTER (WHERE {out}) AS out_wallets, count(DISTINCT cp) FILTER (WHERE {inn}) AS in_sources, {more}"""


_WINDOWS = {
    "24h": "ts > TIMESTAMP '2024-01-30 00:00:00'",
    "7d": "ts > TIMESTAMP '2024-01-24 00:00:00'",
    "30d": "ts > TIMESTAMP '2024-01-01 00:00:00'",
    "all history": "true",
    "prev 24h": "ts > TIMESTAMP '2024-01-29 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00'",
}

_BAND_COUNTS = "count(*) AS n, round(sum(usd), 2) AS usd, count(DISTINCT cp) AS w"

_CANDLES = """pools AS (SELECT asset, event_type AS pool, day, arg_max(val, blk) / 1000 AS close,
     round(sum(val), 2) AS volume, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS pool_rank
   FROM a GROUP BY asset, event_type, day),
closes AS (SELECT asset, day, round(close, 8) AS close FROM pools WHERE true
   QUALIFY row_number() OVER (PARTITION BY asset, day ORDER BY volume DESC, pool_rank) = 1)"""

_BEHAVE = A + """, e AS (
  SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'invoke' WHEN event_type = 'signup' THEN 'equip' ELSE 'growth' END AS cat,
     event_type = 'error' AND usd > 60 AS credit FROM a WHERE direction = 'OUT'),
w AS (SELECT cp, sec, sec - lag(sec) OVER (PARTITION BY cp ORDER BY sec, blk) AS gap,
        row_number() OVER (PARTITION BY cp ORDER BY sec, blk) AS rn,
        count(*) OVER (PARTITION BY cp ORDER BY sec RANGE BETWEEN CURRENT ROW AND 600 FOLLOWING) AS burst
      FROM e WHERE cat = 'invoke'),
g AS (SELECT *, lead(gap) OVER (PARTITION BY cp ORDER BY rn) AS next_gap FROM w),
bins AS (SELECT cp, CASE WHEN gap < 30 THEN 0 WHEN gap < 120 THEN 1 WHEN gap < 600 THEN 2 WHEN gap < 3600 THEN 3 WHEN gap < 21600 THEN 4 ELSE 5 END AS bin,
        count(*) AS c FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
ent AS (SELECT cp, greatest(0, -sum(c / t * ln(c / t)) / ln(6)) AS ent
        FROM (SELECT *, (sum(c) OVER (PARTITION BY cp))::DOUBLE AS t FROM bins) GROUP BY cp),
shape AS (SELECT cp, count(*) AS n, (max(sec) - min(sec)) / 3600 AS span_h, max(burst) / count(*) AS burst,
        CASE WHEN count(gap) >= 3 AND var_pop(gap) FILTER (WHERE next_gap IS NOT NULL) > 0 AND var_pop(next_gap) FILTER (WHERE gap IS NOT NULL) > 0
          THEN covar_pop(gap, next_gap) FILTER (WHERE gap IS NOT NULL) / (stddev_pop(gap) FILTER (WHERE next_gap IS NOT NULL) * stddev_pop(next_gap) FILTER (WHERE gap IS NOT NULL))
          ELSE 0 END AS acf
      FROM g GROUP BY cp HAVING count(*) >= 10)"""

_PRINTS = _BEHAVE + """, counts AS (SELECT cp, count(*) AS n FROM w GROUP BY cp),
vol AS (SELECT CASE WHEN count(*) >= 20 THEN greatest(15, list_sort(list(n))[CAST(floor(count(*) * 0.9::DOUBLE) AS INT) + 1]) END AS high FROM counts),
tot AS (SELECT cp, sum(usd) FILTER (WHERE cat IN ('invoke', 'equip')) AS usd, count(*) FILTER (WHERE credit) > 0 AS receives FROM e GROUP BY cp),
flagged AS (SELECT shape.*, ent.ent, tot.usd, tot.receives, vol.high,
    list_filter([CASE WHEN n >= 30 AND ent.ent < 0.4 THEN 'uniform cadence' END,
      CASE WHEN n >= 30 AND abs(acf) > greatest(0.2, 2 / sqrt(n - 1)) THEN 'scripted pattern' END,
      CASE WHEN n >= 15 AND burst > 0.06 AND span_h > 2 THEN 'burst cluster' END], lambda x: x IS NOT NULL) AS flags,
    list_filter([CASE WHEN n > vol.high THEN 'high volume' END, CASE WHEN tot.receives THEN 'earn+receive' END], lambda x: x IS NOT NULL) AS tags
  FROM shape JOIN ent USING (cp) JOIN tot USING (cp) CROSS JOIN vol)"""

_BALANCE = "held AS (SELECT asset, round(sum(val), 2) AS balance FROM a GROUP BY asset)"

_PIN = "pin AS (SELECT coalesce(min(m), 0) AS pin FROM (SELECT max(blk) AS m FROM a WHERE blk > 0 GROUP BY direction))"

_SERIES = A + f""", {_BALANCE}, {_PIN},
moves AS (SELECT asset, day, {s('val', "direction = 'OUT'")} AS out, {s('val', "direction = 'IN' AND cp = '3'")} AS in_rec,
    {s('val', "direction = 'IN' AND cp <> '3'")} AS in_ext FROM a, pin WHERE blk <= pin AND day >= DATE '2024-01-02' GROUP BY asset, day),
grid AS (SELECT x.asset, y.day FROM (VALUES ('A0'), ('A1')) x(asset), (SELECT DISTINCT day FROM a, pin WHERE blk <= pin AND day >= DATE '2024-01-02') y),
full_moves AS (SELECT grid.asset, grid.day, coalesce(out, 0) AS out, coalesce(in_rec, 0) AS in_rec, coalesce(in_ext, 0) AS in_ext
    FROM grid LEFT JOIN moves USING (asset, day)),
series AS (SELECT asset, day, round(balance - round(coalesce(sum(in_rec + in_ext - out) OVER (PARTITION BY asset ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 6), 1) AS qty,
    round(out, 1) AS out, round(in_rec, 1) AS in_rec, round(in_ext, 1) AS in_ext, round(in_rec + in_ext - out, 1) AS delta, false AS partial
    FROM full_moves JOIN held USING (asset))"""


def _trend(eps: str) -> str:
    return _SERIES + f""", r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY day DESC) AS rn, count(*) OVER (PARTITION BY asset) AS days FROM series),
f AS (SELECT *, coalesce(min(CASE WHEN abs(delta) >= {eps} THEN rn END) OVER (PARTITION BY asset) - 1, days) AS flat FROM r),
p AS (SELECT asset, max(days) AS days, max(flat) AS flat, max(qty) FILTER (WHERE rn = 1) AS now,
   round((max(qty) FILTER (WHERE rn = flat + 1) - max(qty) FILTER (WHERE rn = flat + 8)) / 7, 1) AS slope FROM f GROUP BY asset),
q AS (SELECT *, CASE WHEN days >= 8 AND flat < 3 AND days - flat >= 8 THEN slope END AS change FROM p)
SELECT asset, days, CASE WHEN days >= 8 THEN flat ELSE 0 END AS flat_days, change,
  CASE WHEN days < 8 THEN NULL WHEN flat >= 3 THEN 'frozen' WHEN change IS NOT NULL THEN CASE WHEN change < 0 THEN 'declining' ELSE 'growing' END
    WHEN flat > 0 THEN 'frozen' ELSE 'declining' END AS status,
  CASE WHEN change < 0 THEN CAST(trunc(now / -change) AS BIGINT) END AS days_to_zero FROM q"""


_RECON = f"""WITH {A}, {_BALANCE}, {_PIN},
net AS (SELECT asset, sum(CASE WHEN direction = 'IN' THEN val ELSE -val END) AS net FROM a, pin WHERE blk <= pin GROUP BY asset),
r AS (SELECT asset, round(net, 1) AS net_cached, round(balance, 1) AS balance, round(balance - net, 1) AS delta,
   round(CASE WHEN asset = 'A0' THEN balance ELSE 0 END, 1) AS prev FROM held JOIN net USING (asset)),
recon AS (SELECT asset, net_cached, balance, delta, round(delta - prev, 1) AS drift, false AS degraded,
   round(delta - prev, 1) > 30 OR round(delta - prev, 1) < -150 AS warn FROM r)"""

_TELEMETRY = """count(*) FILTER (WHERE event_type = 'purchase') AS topups,
  round(coalesce(sum(coalesce(TRY_CAST(json_extract_string(props, '$.amount') AS DOUBLE), TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0))
     FILTER (WHERE event_type = 'purchase'), 0), 2) AS topup_usd,
  count(*) FILTER (WHERE event_type = 'click') AS topup_intents, count(*) FILTER (WHERE event_type = 'view') AS awakens,
  count(*) FILTER (WHERE event_type IN ('signup', 'error')) AS logins"""

_MEASURES = ("topups", "topup_usd", "topup_intents", "awakens", "logins")

_BANK = f"""fresh AS (SELECT CAST(ts AS DATE) AS day, {_TELEMETRY} FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY 1),
stored AS (SELECT * REPLACE (topups + 3 AS topups, topup_usd + 10.5 AS topup_usd, logins + 1 AS logins) FROM (SELECT CAST(ts AS DATE) AS day, {_TELEMETRY} FROM events WHERE day(ts) <= 25 GROUP BY 1)),
bank AS (SELECT day, {', '.join(f'CASE WHEN keep THEN o_{m} ELSE n_{m} END AS {m}' for m in _MEASURES)},
    CASE WHEN keep THEN day(day) <= 20 ELSE day <= DATE '2024-01-29' END AS settled, false AS partial
  FROM (SELECT coalesce(o.day, n.day) AS day, (o.day IS NOT NULL AND day(o.day) <= 20) OR n.day IS NULL AS keep,
    {', '.join(f'o.{m} AS o_{m}, n.{m} AS n_{m}' for m in _MEASURES)} FROM stored o FULL OUTER JOIN fresh n ON o.day = n.day)),
ld AS (SELECT day, coalesce(sum(usd) FILTER (WHERE unbacked), 0) AS unbacked, coalesce(sum(usd) FILTER (WHERE fine = 'purchase'), 0) AS backed FROM o GROUP BY day)"""

_SPENDS = f"""consumed AS (SELECT * FROM a WHERE event_type IN ('click', 'error') AND cp <> '5' UNION ALL SELECT * REPLACE ('x' || cp AS cp) FROM a WHERE event_type = 'purchase'),
paid AS (SELECT * FROM a WHERE event_type IN ('view', 'signup')),
spends AS (SELECT * FROM consumed WHERE cp IN (SELECT cp FROM paid))"""

_SWEEP = """legs AS (
  SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS val, 'i' AS leg FROM orders
  UNION ALL SELECT CAST(l_shipdate AS DATE), l_extendedprice, 'r' FROM lineitem WHERE l_shipdate < '1998-01-01'
  UNION ALL SELECT CAST(l_shipdate AS DATE), l_extendedprice, 's' FROM lineitem WHERE l_shipdate >= '1998-01-01'),
series AS (SELECT day, """ + ", ".join(
    f"{s('val', f'''leg = '{x}' ''')} AS {x}, count(*) FILTER (WHERE leg = '{x}') AS n_{x}" for x in "irs"
) + """ FROM legs GROUP BY day),
edges AS (SELECT min(day) FILTER (WHERE n_s > 0) AS s0, max(day) FILTER (WHERE n_s > 0) AS s1, min(day) FILTER (WHERE n_r > 0) AS r0, max(day) FILTER (WHERE n_r > 0) AS r1 FROM series),
shares AS (SELECT x.day, x.s, y.i AS base, x.s / y.i AS share FROM series x JOIN series y ON x.day = y.day + 1 WHERE x.n_s > 0 AND y.i <> 0)"""


def _asof_stats(cut: str) -> str:
    upto = f"ts <= TIMESTAMP '{cut}'"
    earn = "kind IN ('invoke', 'equip')"
    return f"""count(*) FILTER (WHERE {upto} AND kind = 'invoke') AS invoke, count(*) FILTER (WHERE {upto} AND kind = 'equip') AS equip,
    count(*) FILTER (WHERE {upto} AND kind = 'incentive') AS incentive, count(DISTINCT cp) FILTER (WHERE {upto} AND {earn}) AS earners,
    round({s('val', f'{upto} AND {earn}')}, 2) AS earned_val, round({s('val', f'''{upto} AND kind IN ('incentive', 'micro')''')}, 2) AS incentive_val,
    round({s('val', f'''{upto} AND kind = 'topup' ''')}, 2) AS topup_val FROM k"""


_STATS = f"""WITH {A}, k AS (SELECT *, CASE WHEN val * 0.01::DOUBLE < 0.06::DOUBLE THEN 'micro' WHEN val * 0.01::DOUBLE < 0.4::DOUBLE THEN 'invoke'
   WHEN val * 0.01::DOUBLE < 2 THEN 'equip' WHEN val * 0.01::DOUBLE < 7 THEN 'incentive' ELSE 'topup' END AS kind FROM a WHERE direction = 'OUT'),
stats AS ({' UNION ALL '.join(f"SELECT '{label}' AS label, {_asof_stats(cut)}" for label, cut in (
    ('now', '2024-01-30 18:00:00'), ('1h', '2024-01-30 17:00:00'), ('24h', '2024-01-29 18:00:00'), ('7d', '2024-01-23 18:00:00')))})"""

_HISTORY = f"""{A}, per AS (SELECT date_trunc('hour', ts) AS ts, sum(usd) AS usd FROM a WHERE direction = 'OUT' GROUP BY 1),
rolled AS (SELECT ts,
   round(sum(usd) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW), 2) AS burn24,
   round(sum(usd) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 47 HOUR PRECEDING AND INTERVAL 24 HOUR PRECEDING), 2) AS burn_prev,
   round(sum(usd) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 167 HOUR PRECEDING AND CURRENT ROW), 2) AS week FROM per),
history AS (SELECT ts, burn24, burn_prev, round(40.0::DOUBLE * day(ts) / burn24 * week / 1000, 1) AS runway24, round(280.0::DOUBLE * day(ts) / week, 1) AS runway7 FROM rolled),
low AS (SELECT ts, least(coalesce(nullif(runway7, 0), 99), coalesce(nullif(runway24, 0), 99)) AS runway, lag(runway7) OVER (ORDER BY ts) AS prev FROM history),
runs AS (SELECT *, prev IS NULL OR prev >= 7 OR (runway < 1 AND prev >= 1) OR (runway < 0.5 AND prev >= 0.5) AS crossed FROM low WHERE runway < 7)"""

_OUT = "SELECT *, CASE WHEN cat <> 'nonstandard' THEN cat WHEN usd < 20 THEN 'invoke' ELSE 'growth' END AS lcat, CASE fine WHEN 'invoke' THEN 'c5' WHEN 'equip' THEN 'c10' WHEN 'credit' THEN 'c25' WHEN 'referral' THEN 'c50' WHEN 'purchase' THEN 'backed' ELSE 'other' END AS bucket FROM c WHERE asset = 'A0'"

_SINGLE = f"WITH {C}, rows1 AS ({_OUT}), m AS (SELECT * FROM rows1 WHERE direction = 'OUT')"

_FOLDED = ("invoke", "equip", "growth", "micro")
_LCOUNTS = ", ".join(f"count(*) FILTER (WHERE lcat = '{x}') AS {x}" for x in _FOLDED)


def _implied(kept: str, live: str, last_open: str) -> str:
    return f"""WITH RECURSIVE {A}, {SPARSE}, outs AS (SELECT asset, day, val FROM a WHERE direction = 'OUT'),
kept AS ({kept}), live AS ({live}),
days AS (SELECT asset, day, row_number() OVER (PARTITION BY asset ORDER BY day DESC) AS k FROM (SELECT DISTINCT asset, day FROM outs)),
walk AS (
  SELECT asset, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS day, rate AS ref, CAST(NULL AS DOUBLE) AS found FROM live
  UNION ALL
  SELECT asset, k, day, coalesce(kept_rate, implied, ref), coalesce(kept_rate, implied) FROM (
    SELECT d.asset, d.k, d.day, any_value(w.ref) AS ref, any_value(kept.rate) AS kept_rate,
      CASE WHEN count(outs.val) >= 5 THEN 0.1::DOUBLE / median(outs.val) END AS implied
    FROM walk w JOIN days d ON d.asset = w.asset AND d.k = w.k + 1
    LEFT JOIN kept ON kept.asset = d.asset AND kept.day = d.day
    LEFT JOIN outs ON outs.asset = d.asset AND outs.day = d.day
      AND outs.val > 0.1::DOUBLE / w.ref / 2.5::DOUBLE AND outs.val < 0.1::DOUBLE / w.ref * 2.5::DOUBLE
    GROUP BY d.asset, d.k, d.day))
SELECT asset, {d('day')} AS day, round(found, 10) AS rate, {last_open} AS is_open FROM walk WHERE found IS NOT NULL"""


_WATERMARK = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"

_LIVE_REF = "SELECT * FROM (VALUES ('A0', 0.005::DOUBLE), ('A1', 0.004::DOUBLE)) t(asset, rate)"

_QUOTES = f"""WITH RECURSIVE q AS (SELECT 'A' || CAST(user_id % 2 AS VARCHAR) AS asset, row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts, CAST(event_id AS VARCHAR)) AS k, ts,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0.0 ELSE value END AS price, CASE WHEN event_id % 3 = 0 THEN value / 2 + 10 END AS fallback FROM events),
  walk AS (
    SELECT asset, CAST(0 AS BIGINT) AS k, anchor, CAST(NULL AS DOUBLE) AS pending, false AS accepted, CAST(NULL AS DOUBLE) AS rate, '' AS source
    FROM (VALUES ('A0', 20.0::DOUBLE), ('A1', 30.0::DOUBLE)) t(asset, anchor)
    UNION ALL
    SELECT asset, k, CASE WHEN ok THEN CASE WHEN near THEN price ELSE anchor END WHEN fb THEN fallback ELSE anchor END,
      CASE WHEN ok THEN price WHEN price IS NULL THEN pending END, accepted OR (ok AND near) OR (NOT ok AND fb),
      CASE WHEN ok THEN price WHEN fb THEN fallback ELSE anchor END,
      CASE WHEN ok THEN 'primary' WHEN fb THEN 'secondary' WHEN accepted THEN 'last-accepted' ELSE 'fallback' END
    FROM (SELECT q.asset, q.k, q.price, q.fallback, w.anchor, w.pending, w.accepted,
        coalesce(q.price > 0 AND q.price > w.anchor / 5 AND q.price < w.anchor * 5, false) AS ok,
        coalesce(q.price > w.pending / 2 AND q.price < w.pending * 2, false) AS near,
        coalesce(q.fallback > w.anchor / 5 AND q.fallback < w.anchor * 5, false) AS fb
      FROM walk w JOIN q ON q.asset = w.asset AND q.k = w.k + 1))
  SELECT q.asset, {d('q.ts')} AS day, source, count(*) AS n, round(sum(rate), 4) AS rate_sum, round(max(anchor), 4) AS anchor_max
  FROM walk JOIN q USING (asset, k) GROUP BY q.asset, {d('q.ts')}, source"""

ORACLES: dict[str, str] = {
    "daily_facts": f"""WITH {A} SELECT {d('day')} AS day, round({s('usd', "direction = 'OUT'")}, 2) AS out_usd,
      round({s('usd', "direction = 'IN'")}, 2) AS in_usd, round(round({s('usd', "direction = 'IN'")}, 6) - round({s('usd', "direction = 'OUT'")}, 6), 2) AS net_usd,
      count(*) FILTER (WHERE direction = 'OUT') AS out_tx, count(DISTINCT cp) FILTER (WHERE direction = 'OUT') AS wallets,
      round({s('val', "direction = 'OUT' AND asset = 'A0'")}, 1) AS "raw_A0", round({s('val', "direction = 'OUT' AND asset = 'A1'")}, 1) AS "raw_A1",
      a.day = DATE '2024-01-31' AS partial FROM a GROUP BY a.day""",
    "daily_band_facts": f"WITH {C} SELECT {d('day')} AS day, band, {_BAND_COUNTS} FROM o GROUP BY o.day, band",
    "flow_windows": f"WITH {A} " + " UNION ALL ".join(
        f"SELECT '{label}' AS label, {_facts('3', _ASSET_SUMS)} FROM a WHERE {cond}" for label, cond in _WINDOWS.items()
    ),
    "monthly_flows": f"""WITH {B}, start AS (SELECT min(day) AS d0 FROM b WHERE direction = 'OUT')
      SELECT CASE WHEN m = '2001-06' THEN m || ' (partial)' WHEN m = strftime(d0, '%Y-%m') AND day(d0) <> 1 THEN m || ' (from ' || {d('d0')} || ')' ELSE m END AS label,
        * EXCLUDE (m, d0) FROM (SELECT strftime(day, '%Y-%m') AS m, {_facts('c7', f'''round({s('usd', "direction = 'OUT'")}, 2) AS "out_usd_B",
        round({s('val', "direction = 'OUT'")}, 1) AS "out_raw_B", round({s('val', "direction = 'IN'")}, 1) AS "in_raw_B" ''')} FROM b GROUP BY 1), start""",
    "hourly_gapfill": f"""WITH {A}, hours AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-24 05:00:00', TIMESTAMP '2024-01-31 05:00:00', INTERVAL 1 HOUR)) AS h)
      SELECT strftime(h, '%Y-%m-%d %H') AS h, count(*) FILTER (WHERE asset = 'A0') AS "A0", count(*) FILTER (WHERE asset = 'A1') AS "A1"
      FROM hours LEFT JOIN a ON date_trunc('hour', ts) = hours.h AND direction = 'OUT' AND ts > TIMESTAMP '2024-01-24 05:30:00' GROUP BY hours.h""",
    "repeat_entities": f"""WITH {A} SELECT count(*) AS wallets_all, count(*) FILTER (WHERE days >= 2) AS wallets_repeat
      FROM (SELECT cp, count(DISTINCT day) AS days FROM a WHERE direction = 'OUT' GROUP BY cp)""",
    "top_recipients": f"""SELECT 's' || CAST(l_suppkey AS VARCHAR) AS cp, any_value(s_name) AS label, count(*) AS n, round(sum(l_extendedprice), 2) AS usd,
      count(DISTINCT CAST(l_shipdate AS DATE)) AS days, {d('min(l_shipdate)')} AS first, {d('max(l_shipdate)')} AS last,
      round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem) * 100, 1) AS share
      FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey ORDER BY usd DESC, cp LIMIT 25""",
    "top_sources": f"""SELECT 'c' || CAST(o_custkey AS VARCHAR) AS cp, any_value(c_name) AS label, count(*) AS n,
      round(sum(o_totalprice), 2) AS usd, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, {d('min(o_orderdate)')} AS first, {d('max(o_orderdate)')} AS last,
      round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) * 100, 1) AS share
      FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey ORDER BY usd DESC, cp LIMIT 10""",
    "flow_ratios": f"""WITH {A}, f AS (SELECT round(sum(usd) FILTER (WHERE direction = 'IN' AND cp = '3'), 2) AS rec, round(sum(usd) FILTER (WHERE direction = 'IN'), 2) AS inn,
        round(sum(usd) FILTER (WHERE direction = 'OUT'), 2) AS out, round(sum(usd) FILTER (WHERE direction = 'OUT' AND ts > TIMESTAMP '2024-01-24'), 2) AS week,
        sum(usd) FILTER (WHERE event_type = 'click') AS used,
        CASE WHEN min(ts) FILTER (WHERE direction = 'OUT') > TIMESTAMP '2024-01-24' THEN greatest(epoch(TIMESTAMP '2024-01-31' - min(ts) FILTER (WHERE direction = 'OUT')) / 86400, 1) ELSE 7 END AS span FROM a)
      SELECT round(rec / inn * 100, 0) AS recycled_share, round(used / out * 100, 0) AS consumption_ratio, round(week / span, 2) AS dist_pace FROM f""",
    "projected_day": f"""WITH {A}, p AS (SELECT day, count(*) FILTER (WHERE direction = 'OUT') AS out_tx, round({s('usd', "direction = 'OUT'")}, 2) AS out_usd
        FROM a WHERE ts <= TIMESTAMP '2024-01-30 18:00:00' GROUP BY day)
      SELECT {d('day')} AS day, out_tx, out_usd, CASE WHEN p.day = DATE '2024-01-30' THEN round(out_tx / 0.75::DOUBLE, 2) END AS projected_out_tx,
        CASE WHEN p.day = DATE '2024-01-30' THEN round(out_usd / 0.75::DOUBLE, 2) END AS projected_out_usd FROM p""",
    "category_totals": f"""WITH {C} SELECT cat, count(*) AS n, round(sum(usd), 2) AS usd, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30') AS n_24h FROM o GROUP BY cat""",
    "earner_board": f"""WITH {C} SELECT cp, count(*) FILTER (WHERE cat = 'invoke') AS invoke, count(*) FILTER (WHERE cat = 'equip') AS equip, round(sum(usd), 2) AS usd
      FROM o WHERE cat IN ('invoke', 'equip') GROUP BY cp""",
    "top_earners": f"""WITH {C}, t AS (SELECT cp, count(*) FILTER (WHERE cat = 'invoke') AS invoke, count(*) FILTER (WHERE cat = 'equip') AS equip, sum(usd) AS usd
      FROM o WHERE cat IN ('invoke', 'equip') GROUP BY cp) SELECT cp, c_name AS label, invoke, equip, round(usd, 2) AS usd, round(usd / (SELECT sum(usd) FROM t) * 100, 1) AS share
      FROM t LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = cp ORDER BY round(usd, 2) DESC, cp LIMIT 15""",
    "earner_totals": f"""WITH {C} SELECT count(DISTINCT cp) AS earners, round(sum(usd), 2) AS usd,
      round(count(*) FILTER (WHERE cat = 'invoke') / count(*) FILTER (WHERE cat = 'equip'), 0) AS invoke_per_equip FROM o WHERE cat IN ('invoke', 'equip')""",
    "fine_table": f"""WITH {C} SELECT fine, count(*) AS n, round(sum(usd), 2) AS usd, round(sum(usd) / (SELECT sum(usd) FROM o) * 100, 1) AS share FROM o GROUP BY fine""",
    "unclassified_summary": f"""WITH {C}, r AS (SELECT * FROM o WHERE {FOLDED} NOT IN ('invoke', 'equip'))
      SELECT fine, count(*) AS n, round(sum(usd), 2) AS usd, round(sum(usd) / (SELECT sum(usd) FROM r) * 100, 1) AS share FROM r GROUP BY fine""",
    "earn_loop": f"""WITH {C}, credited AS (SELECT DISTINCT cp FROM o WHERE fine = 'credit'),
      earned AS (SELECT cp, round(sum(usd), 2) AS usd FROM o WHERE cat IN ('invoke', 'equip') GROUP BY cp), both_sides AS (SELECT * FROM earned WHERE cp IN (SELECT cp FROM credited))
      SELECT (SELECT count(*) FROM credited) AS credit_recip_n, count(*) AS loop_n, round(sum(usd), 2) AS loop_usd,
        count(*) FILTER (WHERE usd > 10) AS loop_gt10, count(*) FILTER (WHERE usd > 50) AS loop_gt50 FROM both_sides""",
    "latest_unclassified": f"""WITH {C} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, key, cp, round(usd, 2) AS usd, fine
      FROM o WHERE {FOLDED} NOT IN ('invoke', 'equip') ORDER BY o.ts DESC, key LIMIT 40""",
    "range_bands": f"""WITH {C} SELECT CASE WHEN usd * 0.01::DOUBLE < 0.06::DOUBLE THEN 'micro' WHEN usd * 0.01::DOUBLE < 0.4::DOUBLE THEN 'invoke' WHEN usd * 0.01::DOUBLE < 2 THEN 'equip' WHEN usd * 0.01::DOUBLE < 7 THEN 'incentive' ELSE 'topup' END AS five,
      CASE WHEN usd < 2 THEN 'micro' WHEN usd < 8 THEN 'invoke' WHEN usd < 20 THEN 'equip' ELSE 'large' END AS four,
      CASE WHEN cat <> 'nonstandard' THEN cat WHEN usd < 20 THEN 'invoke' ELSE 'growth' END AS folded, count(*) AS n, round(sum(usd), 2) AS usd FROM o GROUP BY 1, 2, 3""",
    "asof_rates": f"""WITH {A}, {SPARSE}, known AS (SELECT * FROM rates WHERE day > DATE '2024-01-04' AND day(day) < 29), opening AS (SELECT * FROM rates WHERE day(day) = 29),
      live AS (SELECT * FROM (VALUES ('A0', 0.05::DOUBLE), ('A1', 0.06::DOUBLE)) t(asset, rate)),
      j AS (SELECT a.key, a.val, x.rate AS exact, op.rate AS opening, p.rate AS prior, n.rate AS later, live.rate AS live
        FROM a LEFT JOIN known x ON x.asset = a.asset AND x.day = a.day LEFT JOIN opening op ON op.asset = a.asset AND op.day = a.day
        ASOF LEFT JOIN known p ON p.asset = a.asset AND p.day <= a.day ASOF LEFT JOIN known n ON n.asset = a.asset AND n.day > a.day LEFT JOIN live ON live.asset = a.asset)
      SELECT key, round(coalesce(exact, opening, prior, later, live), 8) AS rate,
        CASE WHEN exact IS NOT NULL THEN 'day-implied' WHEN opening IS NOT NULL THEN 'day-implied (open)' WHEN prior IS NOT NULL THEN 'carry-forward' WHEN later IS NOT NULL THEN 'carry-back' ELSE 'live' END AS rate_src,
        CAST(round(CAST(val * coalesce(exact, opening, prior, later, live) AS DECIMAL(28, 9)), 6) AS DOUBLE) AS usd FROM j""",
    "exact_rates": f"""WITH {A}, {SPARSE} SELECT a.asset, {d('a.day')} AS day, count(*) AS n, round(sum(val * coalesce(rate, 0.001::DOUBLE)), 6) AS usd
      FROM a LEFT JOIN rates ON rates.asset = a.asset AND rates.day = a.day GROUP BY a.asset, a.day""",
    "daily_close": f"WITH {A}, {_CANDLES} SELECT asset, {d('day')} AS day, close FROM closes",
    "market_deviation": f"""WITH {A}, {SPARSE}, {_CANDLES}, dev AS (SELECT asset, abs(rate - close) / close * 100 AS dev FROM rates JOIN closes USING (asset, day) WHERE close <> 0)
      SELECT asset, count(*) AS n, count(*) FILTER (WHERE dev <= 50) AS "within", round(list_sort(list(dev))[count(*) // 2 + 1], 1) AS median_dev, round(max(dev), 1) AS max_dev FROM dev GROUP BY asset""",
    "best_pair": f"""WITH {A}, q AS (SELECT asset, day, val AS price, CAST(floor(val % 7) AS BIGINT) AS liquidity, blk, CASE asset WHEN 'A0' THEN 20.0::DOUBLE ELSE 30.0::DOUBLE END AS anchor FROM a WHERE blk % 2 = user_id % 2)
      SELECT asset, {d('day')} AS day, price, liquidity FROM q WHERE price > anchor / 5 AND price < anchor * 5
      QUALIFY row_number() OVER (PARTITION BY asset, q.day ORDER BY liquidity DESC, blk) = 1""",
    "implied_day_rates": _implied("SELECT asset, day, rate FROM rates WHERE false", _LIVE_REF, "walk.day = DATE '2024-01-30'"),
    "implied_with_kept_days": _implied("SELECT asset, day, round(rate / 6, 6) AS rate FROM rates WHERE day(day) % 5 = 0", _LIVE_REF, "false"),
    "quote_validation": _QUOTES,
    "quote_stream": _QUOTES,
    "event_gaps": f"""WITH {A}, w AS (SELECT cp, sec - lag(sec) OVER (PARTITION BY cp ORDER BY sec, blk) AS gap FROM a WHERE direction = 'OUT')
      SELECT cp, count(*) AS gaps, CAST(sum(gap) AS BIGINT) AS total, min(gap) AS shortest, max(gap) AS longest FROM w WHERE gap IS NOT NULL GROUP BY cp""",
    "cadence": f"WITH {_BEHAVE} SELECT cp, n, round(span_h, 2) AS span_h, round(ent, 4) AS ent, round(acf, 4) AS acf, round(burst, 4) AS burst FROM shape JOIN ent USING (cp)",
    "cadence_flags": f"""WITH {_PRINTS} SELECT cp, n, round(span_h, 1) AS span_h, round(ent, 2) AS ent, round(acf, 2) AS acf, CAST(round(burst * 100, 0) AS BIGINT) AS burst,
      round(usd, 2) AS usd, array_to_string(flags, ',') AS flags, array_to_string(tags, ',') AS tags, CASE WHEN len(flags) > 0 THEN 'review' ELSE 'organic' END AS status, c_name AS label
      FROM flagged LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = cp""",
    "guard_summary": f"""WITH {_PRINTS} SELECT count(*) FILTER (WHERE len(flags) > 0) AS flagged_n, count(*) AS monitored_n, round({s('round(usd, 2)', 'len(flags) > 0')}, 2) AS at_risk_usd,
      (SELECT round(sum(usd), 2) FROM e WHERE cat IN ('invoke', 'equip')) AS total_usd FROM flagged""",
    "reconciliation": f"{_RECON} SELECT * FROM recon",
    "recon_state": f"{_RECON} SELECT asset, CASE WHEN asset = 'A0' THEN delta ELSE 0.0::DOUBLE END AS delta FROM recon",
    "pinned_balance": f"""WITH {A}, {_PIN}, x AS (SELECT asset, max(val) FILTER (WHERE blk = pin) AS exact, arg_max(val, blk) AS live FROM a, pin GROUP BY asset)
      SELECT asset, coalesce(exact, live) AS balance, exact IS NULL AS degraded FROM x""",
    "backward_balance": f"WITH {_SERIES} SELECT * REPLACE ({d('day')} AS day) FROM series",
    "balance_points": f"""WITH {_SERIES}, {SPARSE}, known AS (SELECT * FROM rates WHERE day(day) > 4),
      j AS (SELECT x.asset, x.day, qty, delta, e.rate AS exact, p.rate AS prior, n.rate AS later FROM series x LEFT JOIN known e ON e.asset = x.asset AND e.day = x.day
        ASOF LEFT JOIN known p ON p.asset = x.asset AND p.day <= x.day ASOF LEFT JOIN known n ON n.asset = x.asset AND n.day > x.day)
      SELECT asset, {d('day')} AS day, qty, delta, round(qty * coalesce(exact, prior, later), 0) AS usd,
        CASE WHEN exact IS NOT NULL THEN 'day-implied' WHEN prior IS NOT NULL THEN 'carry-forward' ELSE 'carry-back' END AS rate_src FROM j""",
    "trend_state": "WITH " + _trend("150"),
    "flat_trend": "WITH " + _trend("1e9"),
    "last_moves": f"""WITH {A} SELECT asset, {d("max(day) FILTER (WHERE direction = 'IN')")} AS last_in, {d("max(day) FILTER (WHERE direction = 'IN' AND cp = '3')")} AS last_recycle,
      {d("max(day) FILTER (WHERE direction = 'OUT')")} AS last_out, {d("min(day) FILTER (WHERE direction = 'OUT')")} AS first_out FROM a GROUP BY asset""",
    "burn_runway": f"""WITH {C}, {_BALANCE}, bal AS (SELECT sum(balance) AS bal FROM held),
      z AS (SELECT {s('usd', "unbacked AND ts > TIMESTAMP '2024-01-30'")} AS burn24, {s('usd', "unbacked AND ts > TIMESTAMP '2024-01-29' AND ts <= TIMESTAMP '2024-01-30'")} AS burn_prev,
        {s('usd', "unbacked AND ts > TIMESTAMP '2024-01-24'")} AS burn7, {s('usd', "ts > TIMESTAMP '2024-01-24'")} AS out7,
        greatest(least((epoch(TIMESTAMP '2024-01-31') - floor(epoch(min(ts)))) / 86400, 7), 1) AS span FROM o)
      SELECT round(bal, 0) AS bal_usd, round(burn24, 2) AS burn24, round(burn_prev, 2) AS burn_prev, round(burn7 / span, 2) AS burn7avg, round(span, 4) AS span_days,
        CASE WHEN burn24 > 0 THEN round(bal / burn24, 1) END AS runway24, CASE WHEN burn7 > 0 THEN round(bal / (burn7 / span), 1) END AS runway7,
        CASE WHEN out7 > 0 THEN round(bal / (out7 / span), 1) END AS runway_total FROM z, bal""",
    "live_balances": f"WITH {A}, {_BALANCE} SELECT asset, '2024-01-31' AS day, round(balance, 1) AS qty, round(balance * CASE asset WHEN 'A0' THEN 0.5 ELSE 0.25 END, 0) AS usd, true AS partial FROM held",
    "valued_balances": f"WITH {A}, {_BALANCE} SELECT asset, round(balance, 0) AS balance, round(balance * CASE asset WHEN 'A0' THEN 0.5 ELSE 0.25 END, 2) AS usd FROM held",
    "ledger_range": f"SELECT {d('min(l_shipdate)')} AS first_day, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS last_ts FROM lineitem",
    "consumption": f"""WITH {A}, {SPARSE}, {_SPENDS}, v AS (SELECT x.*, x.val * coalesce(rate, 0.02::DOUBLE) AS worth FROM spends x LEFT JOIN rates ON rates.asset = x.asset AND rates.day = x.day)
      SELECT count(*) AS total_n, round(sum(val), 0) AS total_val, round(sum(worth), 2) AS total_usd, round({s('worth', "ts > TIMESTAMP '2024-01-24'")}, 2) AS usd_7d,
        count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30') AS n_24h, count(DISTINCT cp) AS spenders_all, count(DISTINCT cp) FILTER (WHERE ts > TIMESTAMP '2024-01-24') AS spenders_7d,
        {d('min(v.day)')} AS first_day, min(v.day) <= DATE '2024-01-02' AS crawl_complete FROM v""",
    "consumption_daily": f"""WITH {A}, {_SPENDS} SELECT {d('spends.day')} AS day, count(*) AS n, round(sum(val), 1) AS val, count(DISTINCT cp) AS spenders FROM spends GROUP BY spends.day ORDER BY 1 DESC LIMIT 20""",
    "funding_split": f"""WITH {A}, {_SPENDS}, sp AS (SELECT cp, sum(usd) AS spend FROM consumed GROUP BY cp), cr AS (SELECT cp, sum(usd) AS credit FROM paid GROUP BY cp),
      j AS (SELECT cp, spend, coalesce(credit, 0) AS credit, greatest(0, spend - coalesce(credit, 0)) AS excess FROM sp LEFT JOIN cr USING (cp))
      SELECT round(sum(spend), 0) AS consumed_usd, count(*) AS spenders, round(sum(spend - excess), 0) AS backed_usd, round(sum(excess), 0) AS user_usd,
        round(sum(excess) / sum(spend) * 100, 1) AS user_pct, count(*) FILTER (WHERE excess > 0.01) AS excess_n, count(*) FILTER (WHERE excess > 0.01 AND credit = 0) AS never_credited_n FROM j""",
    "archive_rollup": f"""WITH {A}, {SPARSE}, v AS (SELECT x.*, x.val * coalesce(rate, 0.001::DOUBLE) AS worth FROM a x LEFT JOIN rates ON rates.asset = x.asset AND rates.day = x.day),
      topped AS (SELECT DISTINCT cp FROM a WHERE direction = 'OUT'), spent AS (SELECT DISTINCT cp FROM a WHERE direction = 'IN')
      SELECT round(sum(val) FILTER (WHERE direction = 'OUT'), 0) AS out_val, round(sum(val) FILTER (WHERE direction = 'IN'), 0) AS in_val,
        round(sum(worth) FILTER (WHERE direction = 'OUT'), 2) AS out_usd, round(sum(worth) FILTER (WHERE direction = 'IN'), 2) AS in_usd,
        count(*) FILTER (WHERE direction = 'OUT') AS out_tx, count(*) FILTER (WHERE direction = 'IN') AS in_tx,
        (SELECT count(*) FROM topped) AS topped_n, (SELECT count(*) FROM spent) AS spent_n, (SELECT count(*) FROM (SELECT cp FROM topped INTERSECT SELECT cp FROM spent)) AS both_n,
        {d("min(v.day) FILTER (WHERE direction = 'IN')")} AS first_spend, {d("max(v.day) FILTER (WHERE direction = 'IN')")} AS last_spend FROM v""",
    "archive_split": f"""WITH {A}, {SPARSE}, v AS (SELECT x.*, x.val * coalesce(rate, 0.001::DOUBLE) AS worth FROM a x LEFT JOIN rates ON rates.asset = x.asset AND rates.day = x.day),
      j AS (SELECT cp, sum(worth) FILTER (WHERE direction = 'IN') AS spend, {s('worth', "direction = 'OUT'")} AS credit FROM v GROUP BY cp HAVING count(*) FILTER (WHERE direction = 'IN') > 0),
      e AS (SELECT *, greatest(0, spend - credit) AS excess FROM j)
      SELECT round(sum(spend), 0) AS consumed_usd, count(*) AS spenders, round(sum(spend - excess), 0) AS backed_usd, round(sum(excess), 0) AS user_usd,
        round(sum(excess) / sum(spend) * 100, 1) AS user_pct, count(*) FILTER (WHERE excess > 0.01) AS excess_n FROM e""",
    "archive_monthly": f"""WITH {B}, prices AS (SELECT day, avg(usd) / 1e6 AS rate FROM b WHERE direction = 'OUT' AND day(day) % 2 = 0 GROUP BY day),
      v AS (SELECT b.*, val * coalesce(nullif(rate, 0), 0.001::DOUBLE) AS worth FROM b LEFT JOIN prices USING (day))
      SELECT strftime(day, '%Y-%m') AS month, round({s('val', "direction = 'OUT'")}, 0) AS out_val, round({s('val', "direction = 'IN'")}, 0) AS in_val,
        round({s('worth', "direction = 'OUT'")}, 2) AS out_usd, round({s('worth', "direction = 'IN'")}, 2) AS in_usd FROM v GROUP BY 1""",
    "sweep_series": f"WITH {_SWEEP} SELECT {d('day')} AS day, round(i, 1) AS i, round(r, 1) AS r, round(s, 1) AS s, n_i, n_r, n_s FROM series",
    "lagged_share": f"WITH {_SWEEP} SELECT {d('day')} AS day, round(s, 2) AS s, round(base, 2) AS base, round(share, 6) AS share FROM shares",
    "sweep_summary": f"""WITH {_SWEEP}, recycled AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM series WHERE n_r > 0),
      phase AS (SELECT min(day) AS p0, count(*) AS phase_days FROM recycled GROUP BY day - CAST(n AS INTEGER) ORDER BY phase_days DESC, p0 LIMIT 1)
      SELECT count(*) FILTER (WHERE n_s > 0) AS days, {d('any_value(s0)')} AS first, {d('any_value(s1)')} AS last, {d('any_value(r0)')} AS recycle_first, {d('any_value(r1)')} AS recycle_last, round(sum(s), 2) AS total,
        round(sum(s) / sum(i) FILTER (WHERE day >= s0) * 100, 1) AS share_cum, count(*) FILTER (WHERE n_r > 0) AS recycle_n, round(sum(r), 2) AS recycle_total,
        round(sum(r) / sum(i) FILTER (WHERE day BETWEEN r0 AND r1) * 100, 1) AS recycle_share_cum, CAST(any_value(r1) - any_value(r0) + 1 AS BIGINT) AS recycle_span_days,
        round(avg(i) FILTER (WHERE n_i > 0 AND day BETWEEN p0 AND r1), 0) AS intake_pre, round(avg(i) FILTER (WHERE n_i > 0 AND day >= s0), 0) AS intake_post,
        (SELECT round(median(share) * 100, 1) FROM shares) AS share_median, {d('any_value(p0)')} AS phase_first, any_value(phase_days) AS phase_days,
        (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS out_n, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'P') AS out_total,
        (SELECT round(sum(c_acctbal), 2) FROM customer) AS collector_bal FROM series, edges, phase""",
    "contract_audit": f"""WITH {_SWEEP}, z AS (SELECT sum(i) FILTER (WHERE day >= s0) AS base, sum(s) AS got, sum(i) FILTER (WHERE day BETWEEN r0 AND r1) AS base_old, sum(r) AS got_old FROM series, edges)
      SELECT round(got_old / base_old * 100, 1) AS old_pct, round(got / base * 100, 1) AS new_pct, round(base * 0.4::DOUBLE, 0) AS expected, round(got, 0) AS actual,
        round(got - base * 0.4::DOUBLE, 0) AS variance, round((got - base * 0.4::DOUBLE) * 0.5, 0) AS variance_usd FROM z""",
    "contract_months": f"""WITH {_SWEEP}, z AS (SELECT strftime(day, '%Y-%m') AS month, sum(s) AS got, sum(i) AS base FROM series, edges WHERE day >= s0 GROUP BY 1)
      SELECT month, round(got / base * 100, 1) AS pct, round(base * 0.4::DOUBLE - got, 0) AS short FROM z WHERE base <> 0""",
    "event_days": f"SELECT {d('CAST(ts AS DATE)')} AS day, {_TELEMETRY} FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY CAST(ts AS DATE)",
    "active_users": """SELECT count(DISTINCT user_id) FILTER (WHERE ts > TIMESTAMP '2024-01-29 12:00:00') AS active_1d, count(DISTINCT user_id) FILTER (WHERE ts > TIMESTAMP '2024-01-23 12:00:00') AS active_7d,
      count(DISTINCT user_id) FILTER (WHERE ts > TIMESTAMP '2023-12-31 12:00:00') AS active_30d FROM events""",
    "active_users_by_sketch": """SELECT days, count(DISTINCT user_id) AS users, true AS close FROM (VALUES (1), (7), (30)) w(days)
      JOIN events ON CAST(ts AS DATE) <= DATE '2024-01-30' AND date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') < days GROUP BY days""",
    "bank_days": f"WITH {C}, {_BANK} SELECT * REPLACE ({d('day')} AS day) FROM bank",
    "settled_tier": f"""WITH {C}, {_BANK}, last7 AS (SELECT * FROM bank WHERE settled ORDER BY day DESC LIMIT 7), z AS (SELECT min(last7.day) AS d0, max(last7.day) AS d1, round(sum(topup_usd), 2) AS topup,
        CAST(sum(topups) AS BIGINT) AS topups, CAST(sum(awakens) AS BIGINT) AS awakens, round(coalesce(sum(backed), 0), 2) AS backed, round(coalesce(sum(unbacked), 0), 2) AS unbacked FROM last7 LEFT JOIN ld USING (day)),
        pace AS (SELECT sum(usd) / 7 AS burn7avg FROM o WHERE unbacked AND ts > TIMESTAMP '2024-01-24'), wau AS (SELECT count(DISTINCT user_id) AS wau FROM events WHERE ts > TIMESTAMP '2024-01-24')
      SELECT {d('d0')} AS first_day, {d('d1')} AS last_day, topup AS topup_usd, topups, awakens, backed AS backed_out_usd, round(backed - topup, 2) AS diverge_usd, unbacked AS unbacked_usd,
        CASE WHEN topup <> 0 THEN round(unbacked / topup, 1) END AS subsidy_ratio, CASE WHEN wau > 0 THEN round(burn7avg * 7 / wau, 2) END AS cost_per_user FROM z, pace, wau""",
    "ratio_weeks": f"""WITH {C}, {_BANK}, r AS (SELECT bank.*, (row_number() OVER (ORDER BY day DESC) - 1) // 7 AS run FROM bank WHERE settled),
        z AS (SELECT run, count(*) AS n, max(r.day) AS d1, sum(topup_usd) AS topup, round(coalesce(sum(unbacked), 0), 2) AS unbacked FROM r LEFT JOIN ld USING (day) GROUP BY run HAVING count(*) = 7)
      SELECT {d('d1')} AS end_day, round(topup, 2) AS topup, unbacked, CASE WHEN topup <> 0 THEN round(unbacked / topup, 1) END AS ratio FROM z""",
    "period_ratio": f"""WITH {C}, {_BANK}, snap AS (SELECT min(day) AS d0, max(day) AS d1, sum(topup_usd) - sum(topups) * 0.5 AS proceeds FROM fresh WHERE day(day) BETWEEN 8 AND 22),
        dist AS (SELECT sum(usd) AS paid FROM o, snap WHERE unbacked AND o.day BETWEEN d0 AND d1)
      SELECT round(paid, 2) AS unbacked_usd, round(proceeds, 2) AS proceeds, CASE WHEN proceeds <> 0 THEN round(paid / proceeds, 1) END AS ratio FROM snap, dist""",
    "asof_stats": f"{_STATS} SELECT * FROM stats",
    "stat_deltas": f"""{_STATS} SELECT s.label, n.invoke - s.invoke AS invoke_delta, n.equip - s.equip AS equip_delta, n.incentive - s.incentive AS incentive_delta, n.earners - s.earners AS earners_delta,
      round(n.earned_val - s.earned_val, 2) AS earned_val_delta FROM stats s, stats n WHERE n.label = 'now' AND s.label <> 'now'""",
    "runway_alerts": f"WITH {_HISTORY} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, runway, prev, crossed, crossed OR hour(runs.ts) % 6 = 0 AS send FROM runs",
    "burn_alerts": f"WITH {_HISTORY} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, burn24, burn_prev, round(burn24 / burn_prev, 6) AS growth FROM history WHERE burn_prev > 0 AND burn24 / burn_prev > 1.1::DOUBLE",
    "drift_alerts": f"{_RECON} SELECT asset, drift FROM recon WHERE warn",
    "due_alerts": f"""{_RECON.replace('WITH ' + A, 'WITH ' + _HISTORY)}, newest AS (SELECT max(ts) AS t FROM history),
      due AS (SELECT ts, 'low runway' AS rule, '' AS subject, runway AS value FROM runs WHERE ts = (SELECT t FROM newest)
        UNION ALL SELECT ts, 'burn accelerating', '', burn24 / burn_prev FROM history WHERE ts = (SELECT t FROM newest) AND burn_prev > 0 AND burn24 / burn_prev > 0.5
        UNION ALL SELECT t, 'reconciliation drift', asset, drift FROM recon, newest WHERE warn)
      SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, rule, subject, round(value, 4) AS value FROM due""",
    "short_collisions": """WITH n AS (SELECT lower('0x' || right(c_name, 5) || 'AB' || CAST(c_nationkey AS VARCHAR) || '99') AS cp FROM customer),
      k AS (SELECT DISTINCT cp, left(cp, 5) || right(cp, 3) AS short_key, left(cp, 6) || right(cp, 3) AS long_key FROM n),
      z AS (SELECT *, count(*) OVER (PARTITION BY short_key) AS sn, count(*) OVER (PARTITION BY long_key) AS ln FROM k)
      SELECT cp, short_key, long_key, CASE WHEN ln > 1 THEN 'table' ELSE 'short' END AS collision FROM z WHERE sn > 1""",
    "extend_registry": """WITH sup AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS cp, s_name || CASE WHEN s_nationkey > 20 THEN ' (branch)' ELSE '' END AS label, s_acctbal, s_nationkey FROM supplier),
      lab AS (SELECT cp, label FROM sup WHERE s_acctbal >= 5000), listed AS (SELECT lower(cp) AS cp, s_acctbal < 0 AS warn FROM sup WHERE s_nationkey = 7),
      out_board AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS cp, count(*) AS n, round(sum(l_extendedprice), 2) AS usd FROM lineitem GROUP BY l_suppkey ORDER BY usd DESC, cp LIMIT 10),
      in_board AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS cp, count(*) AS n, round(sum(o_totalprice), 2) AS usd FROM orders GROUP BY o_custkey ORDER BY usd DESC, cp LIMIT 10),
      lead AS (SELECT cp, 'Top recipient over ' || CAST(n AS VARCHAR) AS role, 'Recipients' AS grp FROM out_board WHERE cp NOT IN (SELECT lower(cp) FROM lab)
        UNION ALL SELECT cp, 'Inflow source over ' || CAST(n AS VARCHAR), 'Funding sources' FROM in_board),
      reg AS (SELECT cp, 'listed' AS role, 'Core' AS grp, warn FROM listed UNION ALL SELECT cp, role, grp, false FROM lead WHERE cp NOT IN (SELECT cp FROM listed)
        UNION ALL SELECT cp, label, 'Other labeled', false FROM lab WHERE NOT contains(label, '(branch)') AND lower(cp) NOT IN (SELECT cp FROM listed UNION ALL SELECT cp FROM lead)),
      shown AS (SELECT DISTINCT lower(cp) AS cp FROM (SELECT cp FROM reg UNION ALL SELECT cp FROM out_board UNION ALL SELECT cp FROM in_board)),
      z AS (SELECT cp, count(*) OVER (PARTITION BY left(cp, 2) || right(cp, 1)) AS sn, count(*) OVER (PARTITION BY left(cp, 3) || right(cp, 1)) AS ln FROM shown)
      SELECT reg.cp, role, grp, warn, CASE WHEN ln > 1 THEN 'table' WHEN sn > 1 THEN 'short' END AS collision FROM reg JOIN z ON z.cp = lower(reg.cp)""",
    "ingest_dedupe": f"WITH {A} SELECT key, direction, asset, cp, val FROM a",
    "ingest_gap": f"WITH {A} SELECT key, direction, asset, cp, val FROM a WHERE ts < TIMESTAMP '2024-01-20'",
    "gap_check": """SELECT strftime(min(ts) FILTER (WHERE ts >= TIMESTAMP '2024-01-15'), '%Y-%m-%d %H:%M:%S') AS batch_oldest, strftime(max(ts) FILTER (WHERE ts < TIMESTAMP '2024-01-20'), '%Y-%m-%d %H:%M:%S') AS bank_newest,
      min(ts) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') < max(ts) FILTER (WHERE ts < TIMESTAMP '2024-01-20') AS complete FROM events""",
    "backfill_merge": f"WITH {A} SELECT key, direction, asset, cp, val FROM a WHERE ts >= TIMESTAMP '2024-01-05'",
    "normalised_transfers": """SELECT '0xTX' || CAST(event_id AS VARCHAR) || ':' || CAST(event_id % 7 AS VARCHAR) AS key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'A' || CAST(user_id % 3 AS VARCHAR) AS asset, value AS val,
      CASE WHEN event_id % 5 <> 0 THEN event_id ELSE 0 END AS blk, '0xuser' || CAST(user_id AS VARCHAR) AS cp FROM events WHERE user_id % 3 < 2""",
    "one_role_scan": f"SELECT {d('CAST(ts AS DATE)')} AS day, count(*) AS n, round(sum(value), 2) AS val FROM events WHERE user_id % 3 = 1 GROUP BY CAST(ts AS DATE)",
    "excluded_rows": "SELECT count(*) AS excluded FROM events WHERE user_id % 3 = 2",
    "label_scan": """SELECT '0x' || CAST(s_suppkey AS VARCHAR) AS cp, 'known' AS label FROM supplier WHERE s_suppkey < 10
      UNION ALL SELECT '0x' || CAST(s_suppkey AS VARCHAR), s_name || ' (named)' FROM supplier WHERE s_suppkey >= 10 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0""",
    "archive_scan": f"WITH {A} SELECT direction, {d('day')} AS day, count(*) AS n, round(sum(val), 2) AS val, count(DISTINCT cp) AS cps FROM a GROUP BY direction, a.day",
    "price_map_scan": f"WITH {A}, {SPARSE} SELECT asset, {d('day')} AS day, round(rate, 8) AS rate FROM rates",
    "ohlcv_scan": f"WITH {A}, {_CANDLES} SELECT asset, {d('day')} AS day, close FROM closes",
    "state_scan": f"WITH {A}, {SPARSE} SELECT asset, {d('day')} AS day, round(rate, 8) AS rate FROM rates",
    "quote_scan": f"""WITH {A}, q AS (SELECT *, CASE asset WHEN 'A0' THEN 20.0::DOUBLE ELSE 30.0::DOUBLE END AS anchor FROM a),
      p AS (SELECT asset, ts, day, CASE WHEN val > anchor / 5 AND val < anchor * 5 THEN val WHEN val + 1 > anchor / 5 AND val + 1 < anchor * 5 THEN val + 1 END AS price FROM q)
      SELECT asset, {d('day')} AS day, count(*) AS n, round(sum(price), 2) AS price FROM p WHERE price IS NOT NULL GROUP BY asset, p.day""",
    "export_rows": f"""WITH {C}, {SPARSE}, known AS (SELECT * FROM rates WHERE day > DATE '2024-01-04' AND day(day) < 29), opening AS (SELECT * FROM rates WHERE day(day) = 29)
      SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp_utc, direction, c.asset AS token, printf('%.6f', val) AS amount,
        CASE WHEN k.day IS NOT NULL THEN 'day-implied' WHEN day(c.day) = 29 THEN 'day-implied (open)' WHEN c.day > DATE '2024-01-05' THEN 'carry-forward' ELSE 'carry-back' END AS rate_source,
        printf('%.8f', coalesce(k.rate, op.rate, prior.rate, later.rate)) AS rate_usd, printf('%.4f', usd) AS usd, CASE WHEN direction = 'OUT' THEN CASE band WHEN 'other' THEN 'other size' ELSE band END ELSE '' END AS size_band, cp AS counterparty,
        coalesce(c_name, '') AS counterparty_label, key AS tx_hash FROM c LEFT JOIN known k ON k.asset = c.asset AND k.day = c.day LEFT JOIN opening op ON op.asset = c.asset AND op.day = c.day
        ASOF LEFT JOIN known prior ON prior.asset = c.asset AND prior.day <= c.day ASOF LEFT JOIN known later ON later.asset = c.asset AND later.day > c.day
        LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = cp""",
    "publish_closed": f"WITH {A}, {_CANDLES} SELECT asset, {d('day')} AS day, CASE WHEN day <= DATE '2024-01-12' THEN 1.0::DOUBLE ELSE close END AS close FROM closes",
    "snapshot_history": """SELECT 'mid' AS run, count(*) AS n, CAST(NULL AS DOUBLE) AS val FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-15'
      UNION ALL SELECT 'end', count(*), round(sum(value), 2) FROM events""",
    "result_document": f"""WITH {C} SELECT 'totals' AS section, round(sum(usd), 2) AS usd, count(*) AS n FROM o GROUP BY cat UNION ALL SELECT 'fine', round(sum(usd), 2), count(*) FROM o GROUP BY fine""",
    "asset_totals": f"{_SINGLE} SELECT lcat, count(*) AS n, round(sum(val), 1) AS val, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30') AS n_24h FROM m GROUP BY lcat",
    "asset_hourly": f"""{_SINGLE}, hours AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM m), TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 HOUR)) AS hr)
      SELECT strftime(hr, '%Y-%m-%d %H') AS h, {_LCOUNTS}, round({s('val')}, 1) AS val FROM hours LEFT JOIN m ON date_trunc('hour', ts) = hr GROUP BY hr""",
    "asset_daily": f"""{_SINGLE}, days AS (SELECT DISTINCT day FROM m UNION SELECT DATE '2024-01-31') SELECT {d('days.day')} AS day, {_LCOUNTS},
      round({s('val', "lcat IN ('invoke', 'equip')")}, 1) AS earned, round({s('val', "lcat IN ('growth', 'micro')")}, 1) AS other FROM days LEFT JOIN m ON m.day = days.day GROUP BY days.day""",
    "asset_earners": f"{_SINGLE} SELECT cp, count(*) FILTER (WHERE lcat = 'invoke') AS invoke, count(*) FILTER (WHERE lcat = 'equip') AS equip, round(sum(val), 1) AS val FROM m WHERE lcat IN ('invoke', 'equip') GROUP BY cp",
    "asset_treasury": f"""{_SINGLE}, t AS (SELECT day, {s('val', "direction = 'OUT'")} AS ov, {s('usd', "direction = 'OUT'")} AS ou, {s('val', "direction = 'IN'")} AS iv FROM rows1 GROUP BY day),
      bk AS (SELECT day, bucket, round(sum(usd), 2) AS usd, count(DISTINCT cp) AS w FROM m GROUP BY day, bucket)
      SELECT {d('t.day')} AS day, round(ov, 1) AS out, round(ou, 2) AS out_usd, round(iv, 1) AS inn, round(round(iv, 6) - round(ov, 6), 1) AS net, bucket, usd, w FROM t LEFT JOIN bk ON bk.day = t.day""",
    "asset_guard": f"""{_SINGLE}, {_BALANCE}, bal AS (SELECT max(balance) * 0.02::DOUBLE AS bal FROM held WHERE asset = 'A0'),
      z AS (SELECT 0.9::DOUBLE AS r, {s('val', "direction = 'OUT' AND (lcat IN ('invoke', 'equip') OR fine IN ('credit', 'referral')) AND ts > TIMESTAMP '2024-01-30'")} * 0.9::DOUBLE AS burn24,
        {s('val', "direction = 'OUT' AND (lcat IN ('invoke', 'equip') OR fine IN ('credit', 'referral')) AND ts > TIMESTAMP '2024-01-29' AND ts <= TIMESTAMP '2024-01-30'")} * 0.9::DOUBLE AS burn_prev,
        {s('val', "direction = 'OUT' AND ts > TIMESTAMP '2024-01-30'")} AS out24, {s('val', "direction = 'IN' AND ts > TIMESTAMP '2024-01-30'")} AS in24,
        {s('val', "direction = 'IN' AND val >= 100 AND ts > TIMESTAMP '2024-01-30'")} AS topup24,
        {s("CASE fine WHEN 'invoke' THEN 5 WHEN 'equip' THEN 10 WHEN 'credit' THEN 25 WHEN 'referral' THEN 50 WHEN 'purchase' THEN 100 ELSE val * 0.9::DOUBLE END", "direction = 'OUT'")} AS promised,
        {s('val', "direction = 'OUT'")} * 0.9::DOUBLE AS settled, {s('val', "direction = 'OUT' AND lcat IN ('invoke', 'equip')")} AS earned FROM rows1),
      b7 AS (SELECT round(avg(usd), 2) AS burn7_usd FROM (SELECT day, {s('usd', "direction = 'OUT'")} AS usd FROM rows1 WHERE day < DATE '2024-01-31' GROUP BY day ORDER BY day DESC LIMIT 7)),
      y AS (SELECT *, CASE WHEN burn_prev > 0 THEN least(burn24 / burn_prev, 2) ELSE 1 END AS growth FROM z, bal, b7, (SELECT at_risk_usd AS risk FROM (__GUARD__)))
      SELECT round((earned - risk / r) / earned * 100, 1) AS organic_share, round(risk / r * r, 2) AS at_risk_usd, round(in24 - out24, 0) AS bal_delta24, round(topup24, 0) AS topup24,
        CASE WHEN burn24 > 0 THEN round(greatest(0, 7 * burn24 - bal * r) / r, 0) END AS topup_needed, CASE WHEN burn24 > 0 THEN round(bal * r / burn24, 1) END AS runway_days,
        CASE WHEN burn24 > 0 THEN round(bal * r / (burn24 * growth), 1) END AS runway_adj, round(burn24, 2) AS burn24, round(burn_prev, 2) AS burn_prev, round(promised, 2) AS promised_usd,
        round((settled - promised) / promised * 100, 1) AS fx_drift_pct, burn7_usd FROM y""",
    "stream_ingest": f"SELECT {d('CAST(ts AS DATE)')} AS day, count(*) AS n, round(sum(value), 2) AS val FROM events GROUP BY CAST(ts AS DATE)",
    "stream_ingest_batches": f"SELECT {d('CAST(ts AS DATE)')} AS day, count(*) AS n, round(sum(value), 2) AS val FROM events GROUP BY CAST(ts AS DATE)",
    "settled_days_stream": f"""SELECT {d('CAST(ts AS DATE)')} AS day, count(*) AS n, round(sum(value), 2) AS usd FROM events
      GROUP BY CAST(ts AS DATE) HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= {_WATERMARK}""",
    "provisional_days_stream": f"SELECT {d('CAST(ts AS DATE)')} AS day, count(*) AS n, round(sum(value), 2) AS usd FROM events GROUP BY CAST(ts AS DATE)",
    "tumbling_counts_stream": f"""WITH {A} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, asset, direction, count(*) AS n, round(sum(usd), 2) AS usd FROM a
      GROUP BY date_trunc('hour', ts), asset, direction HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_WATERMARK}""",
    "sliding_kpis_stream": f"""WITH {A}, ends AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-02-01 00:00:00', INTERVAL 1 HOUR)) AS e)
      SELECT strftime(e, '%Y-%m-%d %H') AS as_of, round({s('usd', "direction = 'OUT'")}, 2) AS out_usd, round({s('usd', "direction = 'IN'")}, 2) AS in_usd, count(*) FILTER (WHERE direction = 'OUT') AS out_tx
      FROM ends JOIN a ON ts >= e - INTERVAL 24 HOUR AND ts < e WHERE e <= {_WATERMARK} GROUP BY e""",
    "publish_stream": f"""SELECT {d('CAST(ts AS DATE)')} AS day, count(*) AS n, CASE WHEN day(CAST(ts AS DATE)) <= 10 THEN 0.0::DOUBLE ELSE round(sum(value), 2) END AS usd FROM events
      GROUP BY CAST(ts AS DATE) HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= {_WATERMARK}""",
    "alert_stream": f"""{_RECON.replace('WITH ' + A, 'WITH ' + _HISTORY)}, newest AS (SELECT max(ts) AS t FROM history)
      SELECT 'low runway' AS rule, '' AS subject, round(runway, 1) AS value FROM runs WHERE ts = (SELECT t FROM newest)
      UNION ALL SELECT 'burn accelerating', '', round(burn24 / burn_prev, 1) FROM history WHERE ts = (SELECT t FROM newest) AND burn_prev > 0 AND burn24 / burn_prev > 2
      UNION ALL SELECT 'reconciliation drift', asset, drift FROM recon WHERE warn""",
}

ORACLES["daily_from_rollup"] = ORACLES["daily_band_facts"]
ORACLES["asset_guard"] = ORACLES["asset_guard"].replace("__GUARD__", ORACLES["guard_summary"])
ORACLES = {name: decimal_rounding(sql) for name, sql in ORACLES.items()}

ORACLES["review_board"] = f"""SELECT cp, label, n, usd, status, flags FROM ({ORACLES["cadence_flags"]}) ORDER BY status <> 'review', usd DESC, cp LIMIT 20"""
ORACLES["kpi_snapshot"] = f"""WITH {C}, {_BALANCE},
  t AS (SELECT count(*) FILTER (WHERE cat = 'invoke') AS invoke, count(*) FILTER (WHERE cat = 'equip') AS equip, count(*) FILTER (WHERE cat = 'growth') AS growth,
    round(sum(val) FILTER (WHERE asset = 'A0'), 1) AS amount, count(DISTINCT cp) FILTER (WHERE cat IN ('invoke', 'equip')) AS creators FROM o),
  h AS (SELECT round(max(balance) FILTER (WHERE asset = 'A0'), 1) AS balance, round(max(balance) FILTER (WHERE asset = 'A1'), 1) AS second_balance FROM held)
  SELECT '2024-01-31 00:00' AS ts, t.*, 0.02::DOUBLE AS rate, h.*, runway24, runway7, burn24, burn_prev, runway7 AS runway_adj FROM t, h, ({ORACLES["burn_runway"]})"""
