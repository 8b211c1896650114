"""DuckDB SQL for the registered queries, written by hand from the definitions, not from the Spark plans."""

from __future__ import annotations

from ..functions.calendar import EARLY_CLOSES, HOLIDAYS


def _dates(texts: list[str]) -> str:
    return ", ".join(f"DATE '{t}'" for t in texts)


TAPE = """tape AS (SELECT event_type AS symbol, event_id, user_id, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS px FROM events)"""

BARS = (
    TAPE
    + """,
bars AS (
  SELECT symbol, os, os + 1800 AS ce, arg_min(px, (t, event_id)) AS o, max(px) AS h, min(px) AS l, arg_max(px, (t, event_id)) AS c, count(*) AS v,
         'X:' || CAST(dayofyear(make_timestamp(os * 1000000)) // 10 AS VARCHAR) AS contract_id
  FROM (SELECT *, (t // 1800000000) * 1800 AS os FROM tape) GROUP BY symbol, os)"""
)

CAL = f"""cal0 AS (
  SELECT CAST(d AS DATE) AS day, isodow(d) >= 6 OR CAST(d AS DATE) IN ({_dates(HOLIDAYS)}) AS closed, CAST(d AS DATE) IN ({_dates(EARLY_CLOSES)}) AS early
  FROM (SELECT unnest(generate_series(TIMESTAMP '2021-01-01', TIMESTAMP '2026-12-31', INTERVAL 1 DAY)) AS d)),
cal AS (
  SELECT day, closed, early,
    min(CASE WHEN NOT closed THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS next_open,
    max(CASE WHEN NOT closed THEN day END) OVER (ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS prev_open,
    CAST(epoch(timezone('America/New_York', day + TIME '09:30:00')) AS BIGINT) AS open_s,
    CAST(epoch(timezone('America/New_York', day + CASE WHEN early THEN TIME '13:00:00' ELSE TIME '16:00:00' END)) AS BIGINT) AS close_s
  FROM cal0)"""

SESS = (
    BARS
    + ",\n"
    + CAL
    + """,
placed AS (
  SELECT b.*, CAST(lt AS DATE) AS l_day, CASE WHEN hour(lt) >= 16 OR k.closed THEN k.next_open ELSE CAST(lt AS DATE) END AS s_date, k.closed AS l_closed
  FROM (SELECT *, timezone('America/New_York', to_timestamp(os)) AS lt FROM bars) b JOIN cal k ON CAST(lt AS DATE) = k.day),
sess AS (
  SELECT p.symbol, p.os, p.ce, p.o, p.h, p.l, p.c, p.v, p.contract_id, CAST(p.s_date AS VARCHAR) AS session_date, k.open_s, k.close_s, k.early,
    CASE WHEN p.os >= k.open_s AND p.os < k.close_s THEN 'rth' WHEN p.l_closed AND isodow(p.l_day) = 6 THEN 'closed' ELSE 'overnight' END AS phase
  FROM placed p JOIN cal k ON p.s_date = k.day)"""
)

FEATS = (
    SESS
    + """,
lev0 AS (
  SELECT symbol, session_date, max(h) FILTER (phase = 'rth') AS rth_high, min(l) FILTER (phase = 'rth') AS rth_low,
    max(h) FILTER (phase <> 'rth') AS on_high, min(l) FILTER (phase <> 'rth') AS on_low,
    max(h) FILTER (phase = 'rth' AND os < open_s + 3600) AS or_high, min(l) FILTER (phase = 'rth' AND os < open_s + 3600) AS or_low,
    CASE WHEN count(*) FILTER (phase = 'rth' AND os < open_s + 3600) > 0 THEN min(ce) FILTER (phase = 'rth' AND ce >= open_s + 3600) END AS or_at
  FROM sess GROUP BY symbol, session_date),
lev AS (
  SELECT *, lag(rth_high) OVER w AS pdh, lag(rth_low) OVER w AS pdl, lag(on_high) OVER w AS onh, lag(on_low) OVER w AS onl, lag(session_date) OVER w AS prev_session
  FROM lev0 WINDOW w AS (PARTITION BY symbol ORDER BY session_date)),
f0 AS (
  SELECT s.*, pdh, pdl, onh, onl, or_high, or_low, or_at, prev_session, lag(c) OVER w AS prev_c, row_number() OVER w AS n_bar
  FROM sess s JOIN lev USING (symbol, session_date) WINDOW w AS (PARTITION BY symbol ORDER BY ce)),
f1a AS (
  SELECT *, CASE WHEN prev_c IS NULL THEN h - l ELSE greatest(h - l, abs(h - prev_c), abs(l - prev_c)) END AS tr, CASE WHEN prev_c <> 0 THEN (c - prev_c) / prev_c END AS ret FROM f0),
f1 AS (
  SELECT *, CASE WHEN ret IS NOT NULL AND count(ret) OVER x = 30 THEN stddev_pop(ret) OVER x END AS spread FROM f1a WINDOW x AS (PARTITION BY symbol, ret IS NULL ORDER BY ce ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
feats AS (
  SELECT *, h - l AS bar_range, CAST(trunc((ce - open_s) / 60.0) AS INT) AS minutes_since_rth_open,
    CASE WHEN sum(CASE WHEN phase = 'rth' THEN v END) OVER d > 0 THEN (sum(CASE WHEN phase = 'rth' THEN (h + l + c) * v END) OVER d) / (3 * sum(CASE WHEN phase = 'rth' THEN v END) OVER d) END AS vwap,
    CASE WHEN count(tr) OVER a = 14 THEN sum(tr) OVER a / 14 END AS atr,
    last_value(spread IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ce ROWS UNBOUNDED PRECEDING) AS realized_volatility,
    v / nullif(avg(v) OVER r, 0) AS volume_ratio, max(h) OVER d AS session_high, min(l) OVER d AS session_low,
    CASE WHEN ce >= or_at THEN or_high END AS orh, CASE WHEN ce >= or_at THEN or_low END AS orl,
    CASE WHEN n_bar > 4 AND lag(h, 2) OVER w > max(h) OVER b AND lag(h, 2) OVER w > max(h) OVER x THEN lag(h, 2) OVER w END AS swing_high,
    CASE WHEN n_bar > 4 AND lag(l, 2) OVER w < min(l) OVER b AND lag(l, 2) OVER w < min(l) OVER x THEN lag(l, 2) OVER w END AS swing_low
  FROM f1
  WINDOW w AS (PARTITION BY symbol ORDER BY ce), d AS (PARTITION BY symbol, session_date ORDER BY ce ROWS UNBOUNDED PRECEDING),
    a AS (PARTITION BY symbol ORDER BY ce ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), r AS (PARTITION BY symbol ORDER BY ce ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY symbol ORDER BY ce ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING), x AS (PARTITION BY symbol ORDER BY ce ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))"""
)

_EV = "SELECT symbol, session_date, ce, '{0}' AS event, CAST({1} AS DOUBLE) AS value, CAST({2} AS VARCHAR) AS reference FROM {3}"


def _ev(name: str, value: str, source: str, reference: str = "NULL") -> str:
    return _EV.format(name, value, reference, source)


GAPS = """gaps AS (
  SELECT symbol, session_date, ce, n_bar, mid_os, 'up' AS side, l AS top, h2 AS bottom FROM (SELECT *, lag(h, 2) OVER w AS h2, lag(os) OVER w AS mid_os FROM feats WINDOW w AS (PARTITION BY symbol ORDER BY ce)) WHERE l - h2 >= 4
  UNION ALL
  SELECT symbol, session_date, ce, n_bar, mid_os, 'down', l2, h FROM (SELECT *, lag(l, 2) OVER w AS l2, lag(os) OVER w AS mid_os FROM feats WINDOW w AS (PARTITION BY symbol ORDER BY ce)) WHERE l2 - h >= 4)"""

_STRUCT = """(SELECT *, row_number() OVER (PARTITION BY symbol, g ORDER BY ce) AS k FROM
  (SELECT *, count({s}) OVER p AS g, last_value({s} IGNORE NULLS) OVER p AS level FROM feats WINDOW p AS (PARTITION BY symbol ORDER BY ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE c {op} level) WHERE k = 1"""

EVENTS = {
    "session_open": _ev("session_open", "NULL", "(SELECT *, lag(session_date) OVER (PARTITION BY symbol ORDER BY ce) AS was FROM feats) WHERE was IS NULL OR was <> session_date"),
    "session_close": "SELECT symbol, was AS session_date, ce, 'session_close' AS event, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS reference FROM (SELECT *, lag(session_date) OVER (PARTITION BY symbol ORDER BY ce) AS was FROM feats) WHERE was <> session_date",
    "opening_range_established": _ev("opening_range_established", "or_high - or_low", "feats WHERE ce = or_at"),
    "or_high_broken": _ev("or_high_broken", "c", "(SELECT *, row_number() OVER (PARTITION BY symbol, session_date ORDER BY ce) AS k FROM feats WHERE phase = 'rth' AND ce >= or_at AND c > or_high) WHERE k = 1"),
    "or_low_broken": _ev("or_low_broken", "c", "(SELECT *, row_number() OVER (PARTITION BY symbol, session_date ORDER BY ce) AS k FROM feats WHERE phase = 'rth' AND ce >= or_at AND c < or_low) WHERE k = 1"),
    "structure_break_up": _ev("structure_break_up", "level", _STRUCT.format(s="swing_high", op=">")),
    "structure_break_down": _ev("structure_break_down", "level", _STRUCT.format(s="swing_low", op="<")),
    "sweep_high": _ev("sweep_high", "pdh", "feats WHERE h >= pdh + 1 AND c < pdh", "'pdh'") + " UNION ALL " + _ev("sweep_high", "onh", "feats WHERE h >= onh + 1 AND c < onh", "'onh'"),
    "sweep_low": _ev("sweep_low", "pdl", "feats WHERE l <= pdl - 1 AND c > pdl", "'pdl'") + " UNION ALL " + _ev("sweep_low", "onl", "feats WHERE l <= onl - 1 AND c > onl", "'onl'"),
    "displacement_up": _ev("displacement_up", "tr / atr", "feats WHERE atr > 0 AND tr >= 1.5 * atr AND c > o"),
    "displacement_down": _ev("displacement_down", "tr / atr", "feats WHERE atr > 0 AND tr >= 1.5 * atr AND c <= o"),
    "fvg_formed_up": _ev("fvg_formed_up", "top - bottom", "gaps WHERE side = 'up'"),
    "fvg_formed_down": _ev("fvg_formed_down", "top - bottom", "gaps WHERE side = 'down'"),
    "fvg_filled": _ev("fvg_filled", "top - bottom", "gaps", "side"),
    "fvg_inverted": """SELECT g.symbol, arg_min(b.session_date, b.ce) AS session_date, min(b.ce) AS ce, 'fvg_inverted' AS event, CAST(any_value(g.top - g.bottom) AS DOUBLE) AS value, g.side AS reference
  FROM gaps g JOIN feats b ON b.symbol = g.symbol AND b.ce > g.ce AND ((g.side = 'up' AND b.c < g.bottom) OR (g.side = 'down' AND b.c > g.top)) GROUP BY g.symbol, g.ce, g.side""",
    "swing_high": _ev("swing_high", "swing_high", "feats WHERE swing_high IS NOT NULL"),
    "swing_low": _ev("swing_low", "swing_low", "feats WHERE swing_low IS NOT NULL"),
}

EVS = FEATS + ",\n" + GAPS + ",\nevs AS (" + "\nUNION ALL ".join(f"SELECT * FROM ({q})" for q in EVENTS.values()) + ")"


def paths(name: str, horizon: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY ce RANGE BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING)"
    return f"""{name} AS (SELECT *, coalesce(last_value(c) OVER p - c, 0) AS terminal, greatest(coalesce(max(h) OVER p, c) - c, 0) AS max_up, least(coalesce(min(l) OVER p, c) - c, 0) AS max_down,
    CASE WHEN max(h) OVER p > c THEN arg_max(os, (h, -ce)) OVER p END AS max_up_at, CASE WHEN min(l) OVER p < c THEN arg_min(os, (l, ce)) OVER p END AS max_down_at,
    count(c) OVER p AS n_path, coalesce(max(ce) OVER p, 0) < ce + {horizon} AS truncated
  FROM feats WINDOW p AS {frame})"""


#: Sessions of the volatility reference in the registered queries: the tape has about 21 of them; the operators take 20 by default.
SESSIONS = 5
REF = """closing AS (SELECT symbol, session_date, arg_max(atr, ce) AS atr FROM feats WHERE atr IS NOT NULL GROUP BY ALL),
ref AS (SELECT symbol, session_date, CASE WHEN count(atr) OVER w = {n} THEN median(atr) OVER w END AS reference FROM closing WINDOW w AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))"""
STRAT = (
    REF.format(n=SESSIONS)
    + """,
strat0 AS (SELECT f.*, CAST(floor((f.ce - f.open_s) / 3600.0) AS BIGINT) AS bucket, CASE WHEN reference IS NULL OR f.atr IS NULL THEN 'unknown' WHEN f.atr < 0.75 * reference THEN 'quiet' WHEN f.atr > 1.25 * reference THEN 'elevated' ELSE 'normal' END AS band FROM feats f LEFT JOIN ref USING (symbol, session_date)),
strat AS (SELECT *, bucket || '|' || band AS stratum FROM strat0)"""
)
