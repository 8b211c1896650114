"""The registered queries of the research engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.lineage import cut
from ..operators import features as ft
from ..operators import inference as inf
from ..operators import lineage as ln
from ..operators import paths as pt
from ..operators import quality as ql
from ..operators import study as st
from ..operators import touch as tc
from ..sources import bars as src
from . import oracles as O  # noqa: N812

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return cal.with_session(src.bars_from_events(spark, sf))


def _feats(spark: SparkSession, sf: str) -> DataFrame:
    """The wide rows, written once for a query that reads them several times."""
    return cut(ft.features(spark, sf))


def _once(spark: SparkSession, sf: str) -> DataFrame:
    """The wide rows for a query that reads them once: nothing is written, and columns that it does not need are never computed."""
    return ft.features(spark, sf)


# -- sources -----------------------------------------------------------------------------------------------


@query("bars_from_events", f"WITH {O.BARS} SELECT symbol, os, ce, o, h, l, c, v FROM bars")
def _(spark, sf):
    return src.bars_from_events(spark, sf).select("symbol", "os", "ce", "o", "h", "l", "c", "v")


@query("src_dec_int", "SELECT event_id, CAST(CAST(value AS DECIMAL(18,9)) AS DOUBLE) AS price, CASE WHEN event_type = 'view' THEN -1 ELSE user_id END AS size FROM events")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    blank = F.when(F.col("event_type") == "view", "").otherwise(F.col("user_id").cast("string"))
    return e.select("event_id", src.parse_number(F.col("value").cast("string"), "decimal(18,9)", False).cast("double").alias("price"), F.coalesce(src.parse_number(blank, "bigint", True), F.lit(-1)).alias("size"))


@query("src_fixed", "SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DECIMAL(28,9)) / 100 AS price FROM lineitem")
def _(spark, sf):
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    fixed = F.round(F.col("l_extendedprice") * 100).cast("long") * F.lit(10_000_000).cast("long")
    return x.select("l_orderkey", "l_linenumber", (fixed.cast("decimal(28,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("double").alias("price"))


@query("src_ns", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 7)
    return e.select("event_id", F.unix_micros(F.timestamp_micros(F.expr("ns div 1000"))).alias("micros"))


@query("src_contract", f"WITH {O.BARS} SELECT symbol, contract_id, count(*) AS n FROM bars GROUP BY ALL")
def _(spark, sf):
    return src.bars_from_events(spark, sf).groupBy("symbol", "contract_id").agg(F.count("*").alias("n"))


@query("src_symbology", f"WITH {O.BARS}, map AS (SELECT 'X:' || i AS code, i * 10 AS lo, i * 10 + 10 AS hi FROM range(0, 37) t(i)) SELECT b.symbol, b.os, m.code FROM bars b JOIN map m ON dayofyear(make_timestamp(b.os * 1000000)) >= m.lo AND dayofyear(make_timestamp(b.os * 1000000)) < m.hi")
def _(spark, sf):
    b = src.bars_from_events(spark, sf).withColumn("doy", F.dayofyear(F.timestamp_seconds("os"))).withColumn("cell", F.expr("doy div 10"))
    m = spark.range(37).select(F.concat(F.lit("X:"), F.col("id").cast("string")).alias("code"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 10).alias("hi"), F.col("id").alias("m_cell"))
    return b.join(F.broadcast(m), (F.col("cell") == F.col("m_cell")) & (F.col("doy") >= F.col("lo")) & (F.col("doy") < F.col("hi")), "left").select("symbol", "os", F.coalesce("code", F.raise_error(F.concat(F.lit("unresolved day: "), F.col("doy").cast("string"))).cast("string")).alias("code"))


@query("src_history", "SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.where("ts >= timestamp_ntz'2024-01-10 00:00:00' and ts < timestamp_ntz'2024-01-12 00:00:00'").select("event_id", "event_type", "value")


@query("snk_fixture", f"WITH {O.BARS}, first_seen AS (SELECT contract_id, min(os) AS seen FROM bars GROUP BY contract_id) SELECT contract_id, 'contract_' || CAST(dense_rank() OVER (ORDER BY seen, contract_id) AS VARCHAR) AS label FROM first_seen")
def _(spark, sf):
    first = src.bars_from_events(spark, sf).groupBy("contract_id").agg(F.min("os").alias("at"))
    return first.select("contract_id", F.concat(F.lit("contract_"), F.dense_rank().over(Window.orderBy("at", "contract_id")).cast("string")).alias("label"))


# -- row checks --------------------------------------------------------------------------------------------


@query("val_tob", "SELECT p_partkey, coalesce(bid > ask, false) AS crossed, (bid + ask) / 2 AS mid FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS bid, CASE WHEN p_size % 5 <> 0 THEN p_retailprice + p_size - 10 END AS ask FROM part)")
def _(spark, sf):
    x = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", "case when p_size % 7 <> 0 then p_retailprice end as bid", "case when p_size % 5 <> 0 then p_retailprice + p_size - 10 end as ask")
    return x.selectExpr("p_partkey", "coalesce(bid > ask, false) as crossed", "(bid + ask) / 2 as mid")


@query("val_tick", f"WITH {O.TAPE} SELECT event_id, px % 25 = 0 AS on_tick FROM tape")
def _(spark, sf):
    return src.events(spark, sf).select("event_id", F.expr("px % 25 = 0").alias("on_tick"))


# -- calendar ----------------------------------------------------------------------------------------------


@query("cal_session_date", f"WITH {O.SESS} SELECT symbol, os, session_date FROM sess")
def _(spark, sf):
    return _bars(spark, sf).select("symbol", "os", "session_date")


@query("cal_phase", f"WITH {O.SESS} SELECT symbol, os, phase FROM sess")
def _(spark, sf):
    return _bars(spark, sf).select("symbol", "os", "phase")


_ORDER_DAYS = "(SELECT o_orderkey, DATE '2022-01-01' + CAST(o_orderkey % 1500 AS INT) AS day FROM orders)"


def _order_days(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.expr("date_add(date'2022-01-01', int(o_orderkey % 1500))").alias("o_day"))
    return o.join(F.broadcast(cal.days(spark)), F.col("o_day") == F.col("day"))


@query("cal_next_prev", f"WITH {O.CAL} SELECT o_orderkey, CAST(next_open AS VARCHAR) AS next_open, CAST(prev_open AS VARCHAR) AS prev_open FROM {_ORDER_DAYS} JOIN cal USING (day)")
def _(spark, sf):
    return _order_days(spark, sf).select("o_orderkey", F.col("next_open").cast("string"), F.col("prev_open").cast("string"))


@query("cal_rth_bounds", f"WITH {O.CAL} SELECT o_orderkey, open_s, close_s, open_s + 3600 AS or_end_s, (close_s - open_s) // 60 AS expected FROM {_ORDER_DAYS} JOIN cal USING (day)")
def _(spark, sf):
    return _order_days(spark, sf).select("o_orderkey", "open_s", "close_s", (F.col("open_s") + 3600).alias("or_end_s"), F.col("expected").cast("long").alias("expected"))


@query("cal_closed_early", f"WITH {O.CAL} SELECT o_orderkey, closed, early FROM {_ORDER_DAYS} JOIN cal USING (day)")
def _(spark, sf):
    return _order_days(spark, sf).select("o_orderkey", "closed", "early")


_ROLL = f"""WITH {O.CAL}, tf AS (SELECT o_orderkey, day, make_date(year(day), month(day), 1) + CAST(((5 - isodow(make_date(year(day), month(day), 1)) + 7) % 7) + 14 AS INT) AS friday FROM {_ORDER_DAYS})
SELECT o_orderkey, CAST(friday AS VARCHAR) AS third_friday, CASE WHEN month(day) % 3 = 0 AND day = friday THEN 'expiry' WHEN month(day) % 3 = 0 AND day = (SELECT next_open FROM cal k WHERE k.day = tf.friday) THEN 'roll_adjacent' ELSE 'ordinary' END AS kind FROM tf"""


@query("cal_roll", _ROLL)
def _(spark, sf):
    o = _order_days(spark, sf).select("o_orderkey", "day").withColumn("friday", cal.third_friday(F.year("day"), F.month("day")))
    nxt = F.broadcast(cal.days(spark).select(F.col("day").alias("f_day"), F.col("next_open").alias("f_next")))
    quarter = F.month("day") % 3 == 0
    kind = F.when(quarter & (F.col("day") == F.col("friday")), "expiry").when(quarter & (F.col("day") == F.col("f_next")), "roll_adjacent").otherwise("ordinary")
    return o.join(nxt, F.col("friday") == F.col("f_day"), "left").select("o_orderkey", F.col("friday").cast("string").alias("third_friday"), kind.alias("kind"))


@query("cal_buckets", f"WITH {O.SESS} SELECT symbol, ce, CAST(trunc((ce - open_s) / 60.0) AS INT) AS minutes, CAST(floor((ce - open_s) / 3600.0) AS BIGINT) AS bucket, CASE WHEN ce < open_s OR ce >= close_s THEN 'overnight' WHEN ce - open_s < 1800 THEN 'open30' WHEN ce - open_s < 7200 THEN 'mid' ELSE 'late' END AS phase4 FROM sess")
def _(spark, sf):
    return _bars(spark, sf).selectExpr("symbol", "ce", "int((ce - open_s) / 60) as minutes", "floor((ce - open_s) / 3600) as bucket", "case when ce < open_s or ce >= close_s then 'overnight' when ce - open_s < 1800 then 'open30' when ce - open_s < 7200 then 'mid' else 'late' end as phase4")


@query("cal_closed_at", f"WITH {O.BARS} SELECT symbol, os, os + 1800 AS closed_at, ce - os AS lag_s FROM bars")
def _(spark, sf):
    return src.bars_from_events(spark, sf).selectExpr("symbol", "os", f"os + {src.INTERVAL} as closed_at", "ce - os as lag_s")


@query("fmt_duration", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN format('{}h{:02d}m{:02d}s', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN format('{}m{:02d}s', s // 60, s % 60) ELSE format('{}s', s) END AS text FROM (SELECT o_orderkey, CAST(o_orderkey % 9000 AS BIGINT) AS s FROM orders)")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", cal.duration_text(F.col("o_orderkey") % 9000).alias("text"))


# -- features and events -----------------------------------------------------------------------------------

for _name in [*ft.STATE, "above_vwap"]:
    _rounded = _name in ("realized_volatility", "vwap", "distance_to_vwap", "volume_ratio")
    _expr = f"round({_name}, 4)" if _rounded else _name
    if _name.startswith("distance_to_"):
        _raw = f"c - {_name.removeprefix('distance_to_')}"
        _sql = f"round({_raw}, 4)" if _rounded else _raw
    elif _name == "above_vwap":
        _sql = "CASE WHEN vwap IS NULL THEN NULL WHEN c > vwap THEN 'above' ELSE 'below' END"
    else:
        _sql = _expr
    SQL[f"f_{_name}"] = f"WITH {O.FEATS} SELECT symbol, ce, {_sql} AS value FROM feats WHERE {_sql} IS NOT NULL"
    QUERIES[f"f_{_name}"] = lambda spark, sf, e=_expr: _once(spark, sf).select("symbol", "ce", F.expr(e).alias("value")).where("value is not null")

_MAKERS = {
    "session_open": ft.session_events, "session_close": ft.session_events, "opening_range_established": ft.opening_range_events, "or_high_broken": ft.opening_range_events, "or_low_broken": ft.opening_range_events,
    "structure_break_up": ft.structure_events, "structure_break_down": ft.structure_events, "sweep_high": ft.sweep_events, "sweep_low": ft.sweep_events, "displacement_up": ft.displacement_events,
    "displacement_down": ft.displacement_events, "fvg_formed_up": ft.gap_events, "fvg_formed_down": ft.gap_events, "fvg_filled": ft.gap_events, "fvg_inverted": ft.gap_events, "swing_high": ft.swing_events, "swing_low": ft.swing_events,
}
for _name, _make in _MAKERS.items():
    SQL[f"e_{_name}"] = f"WITH {O.FEATS},\n{O.GAPS}\nSELECT symbol, session_date, ce, event, round(value, 6) AS value, reference FROM ({O.EVENTS[_name]})"
    QUERIES[f"e_{_name}"] = lambda spark, sf, n=_name, m=_make: m((_feats if m is ft.gap_events else _once)(spark, sf)).where(F.col("event") == n).withColumn("value", F.round("value", 6))


@query("records_long", f"WITH {O.FEATS} SELECT symbol, session_date, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT symbol, session_date FROM feats WHERE {'phase' if x == 'phase' else 'vwap' if x in ('above_vwap', 'distance_to_vwap') else x.removeprefix('distance_to_')} IS NOT NULL" for x in [*ft.STATE, "phase", "above_vwap"]) + ") GROUP BY ALL")
def _(spark, sf):
    return ft.records(_once(spark, sf)).groupBy("symbol", "session_date").agg(F.count("*").alias("n"))


# -- joins -------------------------------------------------------------------------------------------------

_USERS = f"{O.TAPE}, buys AS (SELECT event_id, user_id, t FROM tape WHERE symbol = 'purchase'), views AS (SELECT user_id, t AS vt, max(px) AS px FROM tape WHERE symbol = 'view' GROUP BY ALL)"


@query("j_condition_state", f"WITH {_USERS} SELECT event_id, px AS last_px FROM buys b ASOF LEFT JOIN views v ON b.user_id = v.user_id AND b.t >= v.vt")
def _(spark, sf):
    e = src.events(spark, sf)
    left = e.where("symbol = 'purchase'").select(F.col("user_id").cast("string").alias("symbol"), F.col("t").alias("ce"), "event_id")
    right = e.where("symbol = 'view'").select(F.col("user_id").cast("string").alias("symbol"), F.col("t").alias("ce"), (-F.col("px")).alias("seq"), F.col("px").alias("last_px"))
    return pt.as_of(left, right, "last_px").select("event_id", "last_px")


@query("j_ref_bar", f"WITH {O.BARS} SELECT t.event_id, b.ce AS ref_ce, b.c AS ref_c FROM tape t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.t // 1000000 <= b.ce")
def _(spark, sf):
    m = src.events(spark, sf).select("symbol", F.col("event_id").alias("id"), F.expr("t div 1000000").alias("t"))
    return pt.reference_bar(m, src.bars_from_events(spark, sf)).select(F.col("id").alias("event_id"), "ref_ce", "ref_c")


@query("j_forward_window", f"WITH {O.FEATS},\n{O.GAPS},\na AS ({O.EVENTS['displacement_up']}) SELECT a.symbol, a.ce, count(*) AS n, CAST(sum(b.c) AS BIGINT) AS closes FROM a JOIN bars b ON a.symbol = b.symbol AND b.ce > a.ce AND b.ce <= a.ce + 14400 GROUP BY ALL")
def _(spark, sf):
    f = _feats(spark, sf)
    return pt.interval_join(ft.displacement_events(f).where("event = 'displacement_up'").select("symbol", "ce"), f, 14400).groupBy("symbol", "ce").agg(F.count("*").alias("n"), F.sum("b_c").alias("closes"))


@query("j_recent_events", f"WITH {O.EVS} SELECT a.symbol, a.ce, a.event, coalesce(a.reference, '') AS reference, string_agg(DISTINCT b.event, ',' ORDER BY b.event) AS recent FROM (SELECT DISTINCT symbol, ce, event, reference FROM evs) a JOIN evs b ON a.symbol = b.symbol AND b.ce BETWEEN a.ce - 3600 AND a.ce GROUP BY ALL")
def _(spark, sf):
    e = ft.all_events(_feats(spark, sf))
    return pt.recent_events(e, 3600).select("symbol", "ce", "event", F.coalesce("reference", F.lit("")).alias("reference"), "recent").distinct()


@query("j_as_of_filter", f"WITH {O.EVS} SELECT symbol, event, count(*) AS n FROM evs WHERE ce <= 1705276800 GROUP BY ALL")
def _(spark, sf):
    return ft.all_events(_feats(spark, sf)).where("ce <= 1705276800").groupBy("symbol", "event").agg(F.count("*").alias("n"))


@query("j_required_types", f"WITH {O.EVS} SELECT event, count(*) AS n FROM evs WHERE event IN ('sweep_high', 'sweep_low') GROUP BY event")
def _(spark, sf):
    return ft.all_events(_feats(spark, sf)).where(F.col("event").isin("sweep_high", "sweep_low")).groupBy("event").agg(F.count("*").alias("n"))


@query("j_exclude", f"WITH {O.EVS} SELECT symbol, count(*) AS n FROM feats f WHERE NOT EXISTS (SELECT 1 FROM evs e WHERE e.symbol = f.symbol AND e.ce = f.ce AND e.event = 'displacement_up') GROUP BY symbol")
def _(spark, sf):
    f = _feats(spark, sf)
    own = ft.displacement_events(f).where("event = 'displacement_up'").select("symbol", "ce")
    return f.join(own, ["symbol", "ce"], "left_anti").groupBy("symbol").agg(F.count("*").alias("n"))


@query("j_lineage", "WITH RECURSIVE e AS (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders), up AS (SELECT child, parent, CAST(1 AS BIGINT) AS depth FROM e WHERE parent IS NOT NULL UNION ALL SELECT u.child, e.parent, u.depth + 1 FROM up u JOIN e ON u.parent = e.child WHERE e.parent IS NOT NULL) SELECT child, parent, depth FROM up")
def _(spark, sf):
    """Each order with all orders of its customer that it follows, however far back."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return ln.ancestors(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("child"), before.alias("parent")))


# -- paths -------------------------------------------------------------------------------------------------

for _h in pt.HORIZONS:
    SQL[f"p_path_{_h // 60}"] = f"WITH {O.FEATS},\n{O.paths('p', _h)} SELECT symbol, ce, terminal, max_up, max_down, max_up_at, max_down_at, n_path, truncated FROM p"
    QUERIES[f"p_path_{_h // 60}"] = lambda spark, sf, h=_h: pt.with_paths(_once(spark, sf), h).select("symbol", "ce", "terminal", "max_up", "max_down", "max_up_at", "max_down_at", "n_path", "truncated")

_ORIENT = """SELECT symbol, ce, d AS direction, CASE WHEN d = 'up' THEN terminal ELSE -terminal END AS signed, CASE WHEN d = 'up' THEN max_up ELSE -max_down END AS mfe, CASE WHEN d = 'up' THEN max_down ELSE -max_up END AS mae,
  CASE WHEN fav <> adv THEN fav < adv END AS favorable_first
  FROM (SELECT *, CASE WHEN d = 'up' THEN max_up_at ELSE max_down_at END AS fav, CASE WHEN d = 'up' THEN max_down_at ELSE max_up_at END AS adv FROM p, (VALUES ('up'), ('down')) v(d))"""


@query("p_oriented", f"WITH {O.FEATS},\n{O.paths('p', 3600)} {_ORIENT}")
def _(spark, sf):
    p = pt.with_paths(_once(spark, sf), 3600).withColumn("direction", F.explode(F.array(F.lit("up"), F.lit("down"))))
    return pt.oriented(p).select("symbol", "ce", "direction", "signed", "mfe", "mae", "favorable_first")


def _hit_sql(favorable: str, adverse: str, direction: str, where: str) -> str:
    level = lambda d, up: f"a.c {'+' if up else '-'} a.{d}"
    fav = f"min(b.ce) FILTER (CASE a.direction WHEN 'up' THEN b.h >= {level('favorable', True)} ELSE b.l <= {level('favorable', False)} END)"
    adv = f"min(b.ce) FILTER (CASE a.direction WHEN 'up' THEN b.l <= {level('adverse', False)} ELSE b.h >= {level('adverse', True)} END)"
    return f"""WITH {O.FEATS}, a AS (SELECT symbol, ce, c, {favorable} AS favorable, {adverse} AS adverse, {direction} AS direction FROM feats WHERE {where}),
t AS (SELECT a.symbol, a.ce, a.favorable, a.adverse, a.direction, {fav} AS fav, {adv} AS adv FROM a LEFT JOIN feats b ON a.symbol = b.symbol AND b.ce > a.ce AND b.ce <= a.ce + 14400 GROUP BY ALL),
hits AS (SELECT *, CASE WHEN fav IS NULL AND adv IS NULL THEN 'neither' WHEN adv IS NULL OR fav < adv THEN 'favorable' WHEN fav IS NULL OR adv < fav THEN 'adverse' ELSE 'same_bar' END AS hit, least(fav, adv) - 1800 AS hit_os FROM t)"""


@query("p_hit_atr", _hit_sql("atr", "atr", "'up'", "atr > 0") + " SELECT symbol, ce, hit FROM hits")
def _(spark, sf):
    """Which of one average range up or down comes first; every bar with a range has a row."""
    f = _feats(spark, sf)
    a = f.where("atr > 0").select("symbol", "ce", F.col("atr").alias("favorable"), F.col("atr").alias("adverse"), F.lit("up").alias("direction"))
    return tc.hit_first(a, f, 14400).select("symbol", "ce", "hit")


@query("p_hit_first", _hit_sql("CAST(bar_range + 50 + n_bar % 3 * 400 AS DOUBLE)", "CAST(100 + n_bar % 4 * 300 AS DOUBLE)", "CASE WHEN n_bar % 2 = 0 THEN 'up' ELSE 'down' END", "true") + " SELECT symbol, ce, favorable, adverse, direction, hit, hit_os FROM hits")
def _(spark, sf):
    """Thresholds of each anchor's own, not the same on both sides, both directions."""
    f = _feats(spark, sf)
    own = {"favorable": "cast(bar_range + 50 + n_bar % 3 * 400 as double)", "adverse": "cast(100 + n_bar % 4 * 300 as double)", "direction": "case when n_bar % 2 = 0 then 'up' else 'down' end"}
    return tc.hit_first(f.select("symbol", "ce", *[F.expr(v).alias(k) for k, v in own.items()]), f, 14400)


# -- quality and contracts ---------------------------------------------------------------------------------

_QUALITY = (
    O.FEATS
    + """,
q0 AS (SELECT *, CASE WHEN phase = 'rth' THEN (os - open_s) // 1800 END AS slot, (close_s - open_s) // 1800 AS n_slots, lag(c) OVER w AS bc, lead(o) OVER w AS ao FROM feats WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ce)),
q1 AS (SELECT *, slot - coalesce(lag(slot) OVER (PARTITION BY symbol, session_date ORDER BY ce), -1) - 1 AS gap FROM q0 WHERE slot IS NOT NULL),
q2 AS (SELECT symbol, session_date, max(gap) AS gap, max(slot) AS last_slot, count(DISTINCT slot) AS seen FROM q1 GROUP BY ALL),
q3 AS (SELECT symbol, session_date, count(*) AS n_bars, CAST(sum(v) AS BIGINT) AS volume, count(*) FILTER (phase = 'rth') AS n_rth, count(*) FILTER (phase <> 'rth') AS n_overnight, max(n_slots) AS n_slots,
   count(*) FILTER (bc IS NOT NULL AND ao IS NOT NULL AND least(bc, ao) > 0 AND h > greatest(bc, ao) * 201.0) AS n_bad, max(bar_range) AS max_range, list_sort(list(bar_range))[count(*) // 2 + 1] AS mid_range, bool_or(early) AS early FROM q0 GROUP BY ALL),
q4 AS (SELECT q3.*, coalesce(seen, 0) / n_slots AS coverage, greatest(coalesce(gap, 0), n_slots - 1 - coalesce(last_slot, -1)) AS longest_gap, CASE WHEN mid_range > 0 THEN max_range / mid_range END AS range_ratio FROM q3 LEFT JOIN q2 USING (symbol, session_date)),
q5 AS (SELECT *, concat_ws(',', CASE WHEN coverage < 0.6 OR n_rth < 4 THEN 'rth_coverage' END, CASE WHEN longest_gap > 4 THEN 'rth_contiguous_gap' END, CASE WHEN n_bad > 0 THEN 'implausible_print' END) AS exclusions,
   concat_ws(',', CASE WHEN early THEN 'early_close' END, CASE WHEN n_overnight = 0 THEN 'no_overnight_bars' WHEN n_overnight < n_slots THEN 'sparse_overnight' END) AS observations FROM q4)"""
)


#: What this tape of half-hour bars can meet; the operator's own defaults are those for minute bars.
TAPE = {"min_coverage": 0.6, "max_gap": 4, "min_bars": 4, "tolerance": 200.0}


@query("a_implausible", f"WITH {O.FEATS}, n AS (SELECT *, lag(c) OVER w AS bc, lead(o) OVER w AS ao FROM feats WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ce)) SELECT symbol, ce, coalesce(bc IS NOT NULL AND ao IS NOT NULL AND greatest(bc, ao) > 0 AND ((h - greatest(bc, ao)) / greatest(bc, ao) > 0.05 OR (least(bc, ao) > 0 AND (least(bc, ao) - l) / greatest(bc, ao) > 0.05)), false) AS flagged FROM n")
def _(spark, sf):
    return _once(spark, sf).select("symbol", "ce", F.coalesce(ql.implausible(0.05), F.lit(False)).alias("flagged"))


@query("a_quality", f"WITH {_QUALITY} SELECT symbol, session_date, n_bars, volume, n_rth, n_overnight, coverage, longest_gap, n_bad, range_ratio, exclusions, observations, exclusions = '' AS passed FROM q5")
def _(spark, sf):
    return ql.quality(_feats(spark, sf), **TAPE)


@query("a_quality_summary", f"WITH {_QUALITY} SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(exclusions, ',')) AS rule FROM q5 WHERE exclusions <> '' UNION ALL SELECT unnest(string_split(observations, ',')) FROM q5 WHERE observations <> '') GROUP BY rule")
def _(spark, sf):
    q = ql.quality(_feats(spark, sf), **TAPE)
    return q.select(F.explode(F.array_union(F.split("exclusions", ","), F.split("observations", ","))).alias("rule")).where("rule <> ''").groupBy("rule").agg(F.count("*").alias("n"))


@query("a_passed_days", f"WITH {_QUALITY} SELECT symbol, session_date FROM q5 WHERE exclusions = ''")
def _(spark, sf):
    return ql.quality(_feats(spark, sf), **TAPE).where("passed").select("symbol", "session_date")


_CONT = (
    O.SESS
    + """,
k0 AS (SELECT symbol, session_date, string_agg(DISTINCT contract_id, ',' ORDER BY contract_id) AS contract_ids, count(DISTINCT contract_id) AS n_contracts, count(*) FILTER (contract_id IS NULL) AS n_missing, count(*) AS n_bars FROM sess GROUP BY ALL),
k1 AS (SELECT *, lag(session_date) OVER w AS prior_session, lag(contract_ids) OVER w AS p_ids, lag(n_contracts) OVER w AS p_n, lag(n_missing) OVER w AS p_missing FROM k0 WINDOW w AS (PARTITION BY symbol ORDER BY session_date)),
k2 AS (SELECT symbol, session_date, prior_session, contract_ids, CASE WHEN n_missing > 0 OR n_contracts = 0 THEN 'unknown_provenance' WHEN n_contracts > 1 THEN 'mixed_session' WHEN prior_session IS NULL THEN 'no_prior_session' WHEN p_missing > 0 OR p_n = 0 THEN 'unknown_provenance' WHEN p_n > 1 THEN 'mixed_session' WHEN p_ids <> contract_ids THEN 'contract_boundary' ELSE 'same_contract' END AS verdict FROM k1)"""
)


@query("a_contracts", f"WITH {_CONT} SELECT symbol, session_date, contract_ids, n_contracts, n_bars, n_missing FROM k0")
def _(spark, sf):
    return ql.contracts(_bars(spark, sf))


# -- studies -----------------------------------------------------------------------------------------------

_HYP = "hyp(hypothesis, event, direction, bars, above) AS (VALUES " + ", ".join("('{}', '{}', '{}', {}, {})".format(h, e, d, b, f"'{a}'" if a else "CAST(NULL AS VARCHAR)") for h, e, d, b, a in inf.HYPOTHESES) + ")"
_OBS = (
    O.EVS
    + ",\n"
    + O.STRAT
    + ",\n"
    + ",\n".join(O.paths(f"p{b}", b * 3600).replace("FROM feats", "FROM strat") for b in (1, 2, 4))
    + ",\nall_p AS ("
    + " UNION ALL ".join(f"SELECT {b} AS bars, * FROM p{b}" for b in (1, 2, 4))
    + "),\n"
    + _HYP
    + """,
obs AS (SELECT y.hypothesis, e.symbol, e.session_date, e.ce, CASE WHEN y.direction = 'up' THEN p.terminal ELSE -p.terminal END AS signed, CASE WHEN y.direction = 'up' THEN p.max_up ELSE -p.max_down END AS mfe, CASE WHEN p.max_up_at <> p.max_down_at THEN (y.direction = 'up') = (p.max_up_at < p.max_down_at) END AS favorable_first, p.c > p.vwap AS above, p.stratum
  FROM hyp y JOIN evs e USING (event) JOIN all_p p ON p.symbol = e.symbol AND p.ce = e.ce AND p.bars = y.bars
  WHERE p.n_path > 0 AND (y.above IS NULL OR (p.vwap IS NOT NULL AND p.c > p.vwap)))"""
)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of each hypothesis with the path that its horizon and direction ask for; matched tells whether its condition held."""
    f = st.stratified(_feats(spark, sf), O.SESSIONS)
    e = ft.all_events(f).join(F.broadcast(inf.hypotheses(spark)), "event").select("hypothesis", "direction", "bars", "above", "symbol", "session_date", "ce")
    p = None
    for b in (1, 2, 4):
        x = pt.with_paths(f, b * 3600).select(F.lit(b).alias("p_bars"), F.col("symbol").alias("p_symbol"), F.col("ce").alias("p_ce"), "above_vwap", "stratum", "terminal", "max_up", "max_down", "max_up_at", "max_down_at", "n_path")
        p = x if p is None else p.unionByName(x)
    j = e.join(p, (F.col("symbol") == F.col("p_symbol")) & (F.col("ce") == F.col("p_ce")) & (F.col("bars") == F.col("p_bars")))
    return pt.oriented(j).withColumn("matched", F.col("above").isNull() | F.coalesce(F.col("above_vwap") == F.col("above"), F.lit(False)))


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates that matched and were measured."""
    return _candidates(spark, sf).where("matched and n_path > 0")


_PARTS = "parts AS (SELECT session_date, CASE WHEN i < greatest(1, CAST(floor(n * 0.5) AS BIGINT)) THEN 'discovery' WHEN i < least(greatest(greatest(1, CAST(floor(n * 0.5) AS BIGINT)) + 1, CAST(floor(n * 0.8) AS BIGINT)), n - 1) THEN 'validation' ELSE 'holdout' END AS part FROM d)"
_DAYS = "d AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session_date FROM sess))"


@query(
    "a_hyp_result",
    f"""WITH {_OBS}, {_DAYS}, {_PARTS}, every AS (SELECT y.hypothesis, q.part, y.above IS NULL OR coalesce(p.c > p.vwap, false) AS matched, p.n_path, CASE WHEN y.direction = 'up' THEN 1 ELSE -1 END * p.terminal AS signed, CASE WHEN y.direction = 'up' THEN p.max_up ELSE -p.max_down END AS mfe, CASE WHEN y.direction = 'up' THEN p.max_down ELSE -p.max_up END AS mae,
  CASE WHEN p.max_up_at <> p.max_down_at THEN (y.direction = 'up') = (p.max_up_at < p.max_down_at) END AS fav FROM hyp y JOIN evs e USING (event) JOIN all_p p ON p.symbol = e.symbol AND p.ce = e.ce AND p.bars = y.bars JOIN parts q ON q.session_date = e.session_date)
SELECT hypothesis, part, count(*) AS n_events, count(*) FILTER (matched) AS n_matched, count(*) FILTER (matched AND n_path > 0) AS n, round(avg(signed) FILTER (matched AND n_path > 0), 4) AS mean, round(median(signed) FILTER (matched AND n_path > 0), 4) AS median, round(stddev_pop(signed) FILTER (matched AND n_path > 0), 4) AS sd,
  round(avg(mfe) FILTER (matched AND n_path > 0), 4) AS mfe, round(avg(mae) FILTER (matched AND n_path > 0), 4) AS mae, round(avg(CAST(fav AS INT)) FILTER (matched AND n_path > 0), 4) AS favorable_first FROM every GROUP BY ALL""",
)
def _(spark, sf):
    """Each hypothesis in each partition of the days: its events, those that matched and were measured, and their figures, in one aggregate."""
    x = _candidates(spark, sf).join(F.broadcast(_split_days(spark, sf).withColumnRenamed("session_date", "d_date")), F.col("session_date") == F.col("d_date"))
    seen = F.col("matched") & (F.col("n_path") > 0)
    only = lambda c: F.when(seen, F.col(c).cast("double"))
    g = x.groupBy("hypothesis", "part").agg(
        F.count("*").alias("n_events"), F.count_if("matched").alias("n_matched"), F.count_if(seen).alias("n"), F.avg(only("signed")).alias("mean"), F.median(only("signed")).alias("median"), F.stddev_pop(only("signed")).alias("sd"),
        F.avg(only("mfe")).alias("mfe"), F.avg(only("mae")).alias("mae"), F.avg(F.when(seen, F.col("favorable_first").cast("int"))).alias("favorable_first"),
    )
    return g.select("hypothesis", "part", "n_events", "n_matched", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "sd", "mfe", "mae", "favorable_first")])


@query("a_strata", f"WITH {_OBS} SELECT hypothesis, session_date, stratum, CAST(sum(signed) AS BIGINT) AS total, count(*) AS n FROM obs GROUP BY ALL")
def _(spark, sf):
    return _observations(spark, sf).groupBy("hypothesis", "session_date", "stratum").agg(F.sum("signed").cast("long").alias("total"), F.count("*").alias("n"))


@query("a_kish", f"WITH {_OBS} SELECT hypothesis, round(CAST(sum(n) AS DOUBLE) * sum(n) / sum(n * n), 6) AS clusters FROM (SELECT hypothesis, session_date, count(*) AS n FROM obs GROUP BY ALL) GROUP BY hypothesis")
def _(spark, sf):
    n = _observations(spark, sf).groupBy("hypothesis", "session_date").agg(F.count("*").alias("n"))
    return n.groupBy("hypothesis").agg(F.round(F.sum("n").cast("double") * F.sum("n") / F.sum(F.col("n") * F.col("n")), 6).alias("clusters"))


#: Exponent of the complementary error function, a Chebyshev fit with a relative error below 1.2e-7 everywhere.
_ERFC = inf.horner(inf.ERFC, "t")
def boot_sql(source: str, keys: list[str], rounds: int = 2000) -> str:
    """Intervals of the mean from whole sessions drawn by md5, as inference.bootstrap_mean gives them."""
    k = ", ".join(keys)
    return f"""bc AS (SELECT {k}, session_date, CAST(sum(signed) AS DOUBLE) AS s, count(signed) AS n, row_number() OVER (PARTITION BY {k} ORDER BY session_date) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS k FROM {source} GROUP BY {k}, session_date),
bd AS (SELECT {k}, round, CAST('0x' || substr(md5('20260907|' || round || '|' || i), 1, 8) AS BIGINT) % k AS i FROM bc, range(1, {rounds + 1}) t(round)),
bm AS (SELECT {k}, round, sum(s) / sum(n) AS mean FROM bd JOIN bc USING ({k}, i) GROUP BY {k}, round), bl AS (SELECT {k}, list_sort(list(mean)) AS m FROM bm GROUP BY {k}),
boot AS (SELECT {k}, m[{int(0.025 * rounds) + 1}] AS ci_low, m[{min(rounds - 1, int(0.975 * rounds)) + 1}] AS ci_high FROM bl)"""


_P = "CASE WHEN sd = 0 THEN CASE WHEN mean = 0 THEN 1.0 ELSE 0.0 END ELSE tail END"
_BH = f"""WITH {_OBS}, est AS (SELECT hypothesis, count(*) AS n, avg(signed) AS mean, stddev_pop(signed) AS sd FROM obs GROUP BY hypothesis),
z AS (SELECT *, CASE WHEN sd > 0 THEN abs(mean) / (sd / sqrt(n)) END AS z FROM est), y AS (SELECT *, 1.0 / (1 + 0.5 * (z / sqrt(2.0))) AS t FROM z),
c AS (SELECT *, t * exp(-z * z / 2 + ({_ERFC})) AS tail FROM y),
p AS (SELECT hypothesis, {_P} AS p FROM c), r AS (SELECT *, row_number() OVER (ORDER BY p, hypothesis) AS rank, count(*) OVER () AS m FROM p)
SELECT hypothesis, round(p, 6) AS p, rank, round(least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC)), 6) AS p_adjusted, round(least(1.0, p * m), 6) AS bonferroni, rank <= coalesce(max(CASE WHEN p <= rank / m * 0.05 THEN rank END) OVER (), 0) AS significant FROM r"""


@query("w_bh", _BH)
def _(spark, sf):
    e = inf.estimate(_observations(spark, sf), ["hypothesis"], "signed").withColumn("p", inf.two_sided_p(F.col("mean"), F.col("sd"), F.col("n")))
    x = inf.benjamini_hochberg(e, "hypothesis", "p")
    return x.select("hypothesis", F.round("p", 6).alias("p"), "rank", F.round("p_adjusted", 6).alias("p_adjusted"), F.round(F.least(F.lit(1.0), F.col("p") * F.col("m")), 6).alias("bonferroni"), "significant")


def _session_days(spark: SparkSession, sf: str) -> DataFrame:
    # one row per trading day: the window runs over a calendar's worth of rows
    d = _bars(spark, sf).select("session_date").distinct()
    return d.withColumn("i", F.row_number().over(Window.orderBy("session_date")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))


def _split_days(spark: SparkSession, sf: str) -> DataFrame:
    """Trading days in time order: half for discovery, three tenths for validation, the rest held out."""
    d = _session_days(spark, sf).withColumn("d_end", F.greatest(F.lit(1), F.expr("bigint(n * double(0.5))"))).withColumn("v_end", F.least(F.greatest(F.col("d_end") + 1, F.expr("bigint(n * (double(0.5) + double(0.3)))")), F.col("n") - 1))
    return d.select("session_date", F.when(F.col("i") < F.col("d_end"), "discovery").when(F.col("i") < F.col("v_end"), "validation").otherwise("holdout").alias("part"))


@query("w_split", f"WITH {O.SESS}, {_DAYS}, {_PARTS} SELECT session_date, part FROM parts")
def _(spark, sf):
    return _split_days(spark, sf)


@query("w_thirds", f"WITH {O.SESS}, {_DAYS} SELECT session_date, least(2, i * 3 // n) AS third FROM d")
def _(spark, sf):
    return _session_days(spark, sf).select("session_date", F.least(F.lit(2), F.expr("i * 3 div n")).alias("third"))


@query("w_stride", f"WITH {O.BARS} SELECT symbol, ce FROM (SELECT symbol, ce, row_number() OVER (PARTITION BY symbol ORDER BY ce) AS k FROM bars) WHERE k % 3 = 1")
def _(spark, sf):
    return src.bars_from_events(spark, sf).withColumn("k", F.row_number().over(ft.w_s())).where("k % 3 = 1").select("symbol", "ce")


@query("s_reservoir", f"WITH {O.FEATS} SELECT symbol, phase, ce FROM (SELECT symbol, phase, ce, row_number() OVER (PARTITION BY symbol, phase ORDER BY md5('7|' || ce), ce) AS k FROM feats) WHERE k <= 20")
def _(spark, sf):
    f = _bars(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("symbol", "phase").orderBy(F.md5(F.concat(F.lit("7|"), F.col("ce").cast("string")).cast("binary")), "ce")))
    return f.where("k <= 20").select("symbol", "phase", "ce")


@query("a_percentiles", f"WITH {O.BARS} SELECT symbol, r[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50, r[CAST(floor(n * 0.9) AS BIGINT) + 1] AS p90 FROM (SELECT symbol, list_sort(list(h - l)) AS r, count(*) AS n FROM bars GROUP BY symbol)")
def _(spark, sf):
    # nearest rank, found by position in the sorted rows rather than in a collected list
    b = src.bars_from_events(spark, sf).selectExpr("symbol", "h - l as r")
    b = b.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("r")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    at = lambda p: F.max(F.when(F.col("i") == F.expr(f"bigint(n * double({p}))"), F.col("r")))
    return b.groupBy("symbol").agg(at(0.5).alias("p50"), at(0.9).alias("p90"))


@query("a_cluster_rate", f"WITH {_QUALITY} SELECT CAST(isodow(CAST(session_date AS DATE)) AS BIGINT) AS weekday, count(*) AS n, count(*) FILTER (exclusions <> '') AS excluded FROM q5 GROUP BY 1")
def _(spark, sf):
    q = ql.quality(_feats(spark, sf), **TAPE)
    return q.groupBy((F.weekday(F.col("session_date").cast("date")) + 1).cast("long").alias("weekday")).agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("excluded"))


@query("a_first_touch", f"WITH {O.FEATS}, brackets(b) AS (VALUES (2000), (5000), (10000)), a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ce) AS k FROM feats), t AS (SELECT a.symbol, a.ce, b, min(x.ce) FILTER (x.h >= a.c + b) AS fav, min(x.ce) FILTER (x.l <= a.c - b) AS adv FROM a JOIN feats x ON a.symbol = x.symbol AND x.ce > a.ce AND x.ce <= a.ce + 14400, brackets WHERE a.k % 3 = 1 GROUP BY ALL) SELECT CAST(b AS BIGINT) AS bracket, count(*) AS n, count(*) FILTER (fav IS NOT NULL AND (adv IS NULL OR fav < adv)) AS up_first, count(*) FILTER (fav = adv) AS ambiguous, count(*) FILTER (fav IS NULL AND adv IS NULL) AS neither FROM t GROUP BY b")
def _(spark, sf):
    f = _feats(spark, sf)
    a = f.withColumn("k", F.row_number().over(ft.w_s())).where("k % 3 = 1").select("symbol", "ce", "c")
    j = pt.interval_join(a, f, 14400).withColumn("bracket", F.explode(F.array(*[F.lit(x).cast("long") for x in (2000, 5000, 10000)])))
    t = j.groupBy("symbol", "ce", "bracket").agg(F.min(F.expr("case when b_h >= c + bracket then b_ce end")).alias("fav"), F.min(F.expr("case when b_l <= c - bracket then b_ce end")).alias("adv"))
    return t.groupBy("bracket").agg(F.count("*").alias("n"), F.count_if(F.expr("fav is not null and (adv is null or fav < adv)")).alias("up_first"), F.count_if(F.expr("fav = adv")).alias("ambiguous"), F.count_if(F.expr("fav is null and adv is null")).alias("neither"))


def _values(names: list[str]) -> str:
    return ", ".join(f"('{n}')" for n in names)


@query("set_session_universe", f"WITH {O.EVS} SELECT DISTINCT session_date FROM evs UNION SELECT session_date FROM sess")
def _(spark, sf):
    f = _feats(spark, sf)
    return ft.all_events(f).select("session_date").union(f.select("session_date")).distinct()


_VERDICT = """CASE WHEN d_n IS NULL OR d_n < 30 THEN 'inconclusive' WHEN NOT (d_lo > 0 OR d_hi < 0) THEN 'reject' WHEN NOT significant THEN 'reject' WHEN d_hi < 0 THEN 'opposite_effect'
  WHEN v_n IS NULL THEN 'promising' WHEN v_n < 30 THEN 'inconclusive' WHEN NOT (v_lo > 0 OR v_hi < 0) THEN 'reject' WHEN (d_mean > 0) <> (v_mean > 0) THEN 'reject'
  WHEN h_n IS NULL THEN 'promising' WHEN h_n < 30 THEN 'inconclusive' WHEN NOT (h_lo > 0 OR h_hi < 0) OR (h_mean > 0) <> (d_mean > 0) THEN 'reject' WHEN fav < 0.5 THEN 'promising' ELSE 'robust' END"""
_PART = "CASE WHEN i < greatest(1, CAST(floor(n * 0.5) AS BIGINT)) THEN 'd' WHEN i < least(greatest(greatest(1, CAST(floor(n * 0.5) AS BIGINT)) + 1, CAST(floor(n * 0.8) AS BIGINT)), n - 1) THEN 'v' ELSE 'h' END"
_CLASSIFY = f"""WITH {_OBS}, {_DAYS}, parts AS (SELECT session_date, {_PART} AS part FROM d),
po AS (SELECT obs.*, part FROM obs JOIN parts USING (session_date)),
est AS (SELECT hypothesis, part, count(*) AS n, avg(signed) AS mean, stddev_pop(signed) AS sd, avg(CAST(favorable_first AS INT)) AS fav FROM po GROUP BY ALL),
{boot_sql('po', ['hypothesis', 'part'])},
ci AS (SELECT *, ci_low AS lo, ci_high AS hi, CASE WHEN sd > 0 THEN abs(mean) / (sd / sqrt(n)) END AS z FROM est JOIN boot USING (hypothesis, part)),
y AS (SELECT *, 1.0 / (1 + 0.5 * (z / sqrt(2.0))) AS t FROM ci), c AS (SELECT *, t * exp(-z * z / 2 + ({_ERFC})) AS tail FROM y),
p AS (SELECT hypothesis, {_P} AS p FROM c WHERE part = 'd'), r AS (SELECT *, row_number() OVER (ORDER BY p, hypothesis) AS rank, count(*) OVER () AS m FROM p),
s AS (SELECT hypothesis, rank <= coalesce(max(CASE WHEN p <= rank / m * 0.05 THEN rank END) OVER (), 0) AS significant FROM r),
w AS (SELECT hypothesis, any_value(n) FILTER (part = 'd') AS d_n, any_value(mean) FILTER (part = 'd') AS d_mean, any_value(lo) FILTER (part = 'd') AS d_lo, any_value(hi) FILTER (part = 'd') AS d_hi, any_value(fav) FILTER (part = 'd') AS fav,
  any_value(n) FILTER (part = 'v') AS v_n, any_value(mean) FILTER (part = 'v') AS v_mean, any_value(lo) FILTER (part = 'v') AS v_lo, any_value(hi) FILTER (part = 'v') AS v_hi,
  any_value(n) FILTER (part = 'h') AS h_n, any_value(mean) FILTER (part = 'h') AS h_mean, any_value(lo) FILTER (part = 'h') AS h_lo, any_value(hi) FILTER (part = 'h') AS h_hi FROM ci GROUP BY hypothesis)
SELECT hypothesis, d_n, v_n, h_n, {_VERDICT} AS verdict FROM w LEFT JOIN s USING (hypothesis)"""


@query("i_classify", _CLASSIFY)
def _(spark, sf):
    parts = QUERIES["w_split"](spark, sf).select("session_date", F.substring("part", 1, 1).alias("part"))
    o = cut(_observations(spark, sf).join(parts, "session_date"))
    e = inf.estimate(o, ["hypothesis", "part"], "signed").join(o.groupBy("hypothesis", "part").agg(F.avg(F.col("favorable_first").cast("int")).alias("fav")), ["hypothesis", "part"])
    b = inf.bootstrap_mean(o, ["hypothesis", "part"], "signed", rounds=2000)
    e = e.join(b.withColumnsRenamed({"ci_low": "lo", "ci_high": "hi"}), ["hypothesis", "part"])
    p = e.where("part = 'd'").withColumn("p", inf.two_sided_p(F.col("mean"), F.col("sd"), F.col("n")))
    sig = inf.benjamini_hochberg(p.select("hypothesis", "p"), "hypothesis", "p").select("hypothesis", "significant")
    one = lambda c, k: F.max(F.when(F.col("part") == k, F.col(c)))
    w = e.groupBy("hypothesis").agg(*[one(c, k).alias(f"{k}_{c}") for k in "dvh" for c in ("n", "mean", "lo", "hi")], one("fav", "d").alias("fav"))
    return w.join(sig, "hypothesis", "left").select("hypothesis", "d_n", "v_n", "h_n", F.expr(_VERDICT).alias("verdict"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Opening-range breaks above VWAP and their mean path over the next hour, by symbol."""
    f = pt.with_paths(_feats(spark, sf), 3600)
    e = ft.opening_range_events(f).where("event = 'or_high_broken'").select("symbol", "ce")
    return f.join(e, ["symbol", "ce"]).where("n_path > 0").groupBy("symbol", "above_vwap").agg(F.count("*").alias("n"), F.round(F.avg("terminal"), 4).alias("mean_return"))


@query("flagship", f"WITH {O.FEATS},\n{O.GAPS},\n{O.paths('p', 3600)}, e AS ({O.EVENTS['or_high_broken']}) SELECT p.symbol, CASE WHEN vwap IS NULL THEN NULL WHEN c > vwap THEN 'above' ELSE 'below' END AS above_vwap, count(*) AS n, round(avg(terminal), 4) AS mean_return FROM p JOIN e ON p.symbol = e.symbol AND p.ce = e.ce WHERE n_path > 0 GROUP BY ALL")
def _(spark, sf):
    return flagship(spark, sf)


from . import checks, streams, study  # noqa: E402, F401  register their queries
