"""Registered queries on event and control arms, resampling, tags and the candidate screen, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import features as ft
from ..operators import inference as inf
from ..operators import paths as pt
from ..operators import search as se
from ..operators import study as st
from . import oracles as O  # noqa: N812
from .registry import _HYP, _OBS, _feats, _observations, _values, query

SESSIONS = O.SESSIONS
#: The search's bar for this tape of half-hour bars over a month; the operators' defaults are those for minute bars over years.
CRITERIA = se.Criteria(min_events=40, min_event_sessions=12, min_effective_clusters=9, min_events_per_third=10, min_clusters_per_third=3, min_absolute_lift=20.0, min_lift_to_mfe_ratio=0.01, min_perturbed_magnitude_ratio=0.2, confidence=0.8, rounds=400)
#: Rounds of the two event-level diagnostics in the registered queries; the operators take 400 by default.
DIAGNOSTIC = 100

REF, STRAT = O.REF, O.STRAT


def paths(name: str, horizon: int, source: str = "strat") -> str:
    return O.paths(name, horizon).replace("FROM feats", f"FROM {source}")


ARMS = (
    O.EVS
    + ",\n"
    + STRAT
    + ",\n"
    + ",\n".join(paths(f"p{b}", b * 3600) for b in (1, 2, 4))
    + ",\nall_p AS ("
    + " UNION ALL ".join(f"SELECT {b} AS bars, * FROM p{b}" for b in (1, 2, 4))
    + "),\n"
    + _HYP
    + """,
each AS (SELECT y.hypothesis, y.event, y.above AS need, p.symbol, p.session_date, p.ce, p.stratum, CASE WHEN y.direction = 'up' THEN p.terminal ELSE -p.terminal END AS y, CASE WHEN y.direction = 'up' THEN p.max_up ELSE -p.max_down END AS mfe, CASE WHEN y.direction = 'up' THEN p.max_down ELSE -p.max_up END AS mae,
  CASE WHEN p.max_up_at <> p.max_down_at THEN (y.direction = 'up') = (p.max_up_at < p.max_down_at) END AS fav, coalesce(p.c > p.vwap, false) AS above
  FROM all_p p JOIN hyp y USING (bars) WHERE n_path > 0),
co AS (SELECT *, row_number() OVER (PARTITION BY hypothesis, stratum ORDER BY md5('5|' || hypothesis || '|' || symbol || '|' || ce), symbol, ce) AS draw FROM each WHERE NOT EXISTS (SELECT 1 FROM evs o WHERE o.event = each.event AND o.symbol = each.symbol AND o.ce = each.ce)),
arms AS (SELECT 'event' AS arm, hypothesis, symbol, each.session_date, ce, stratum, y, mfe, mae, fav, above FROM each JOIN (SELECT event, symbol, ce FROM evs) o USING (event, symbol, ce) WHERE need IS NULL OR above
  UNION ALL SELECT 'control', hypothesis, symbol, session_date, ce, stratum, y, mfe, mae, fav, above FROM co WHERE draw <= 200)"""
)

_SIDES = ", ".join(
    f"count(*) FILTER (arm = '{arm}') AS {k}n, count(fav) FILTER (arm = '{arm}') AS {k}fn, CAST(sum(y) FILTER (arm = '{arm}') AS DOUBLE) AS {k}_y, CAST(sum(mfe) FILTER (arm = '{arm}') AS DOUBLE) AS {k}_mfe, CAST(sum(mae) FILTER (arm = '{arm}') AS DOUBLE) AS {k}_mae, CAST(sum(CAST(fav AS INT)) FILTER (arm = '{arm}') AS DOUBLE) AS {k}_fav"
    for arm, k in (("event", "e"), ("control", "c"))
)


def _lift_sql(source: str, thin: int) -> str:
    return f"""cells AS (SELECT hypothesis, stratum, {_SIDES} FROM {source} GROUP BY ALL), ok AS (SELECT *, cn >= {thin} AS ok FROM cells WHERE en > 0),
lifts AS (SELECT hypothesis, CAST(coalesce(sum(en) FILTER (ok), 0) AS BIGINT) AS n, count(*) FILTER (ok) AS strata_used, count(*) FILTER (NOT ok) AS strata_dropped, CAST(coalesce(sum(en) FILTER (NOT ok), 0) AS BIGINT) AS events_dropped,
  sum(e_y) FILTER (ok) / sum(en) FILTER (ok) AS event_mean, sum(en * c_y / cn) FILTER (ok) / sum(en) FILTER (ok) AS control_mean, sum(e_mfe) FILTER (ok) / sum(en) FILTER (ok) - sum(en * c_mfe / cn) FILTER (ok) / sum(en) FILTER (ok) AS mfe_lift, sum(e_mae) FILTER (ok) / sum(en) FILTER (ok) - sum(en * c_mae / cn) FILTER (ok) / sum(en) FILTER (ok) AS mae_lift,
  sum(e_fav) FILTER (ok) / nullif(sum(efn) FILTER (ok), 0) - sum(en * c_fav / cfn) FILTER (ok AND cfn > 0) / nullif(sum(en) FILTER (ok AND cfn > 0), 0) AS fav_lift FROM ok GROUP BY hypothesis)"""


_LIFT_OUT = "SELECT hypothesis, n, strata_used, strata_dropped, events_dropped, round(event_mean, 4) AS event_mean, round(control_mean, 4) AS control_mean, round(event_mean - control_mean, 4) AS lift, round(mfe_lift, 4) AS mfe_lift, round(mae_lift, 4) AS mae_lift, round(fav_lift, 4) AS fav_lift FROM lifts"


def _shown(x):
    return x.select("hypothesis", "n", "strata_used", "strata_dropped", "events_dropped", *[F.round(c, 4).alias(c) for c in ("event_mean", "control_mean", "lift", "mfe_lift", "mae_lift", "fav_lift")])


def _arms(spark, sf):
    return cut(st.arms(spark, _feats(spark, sf), sessions=SESSIONS))


@query("w_vol_reference", f"WITH {O.FEATS}, {REF.format(n=SESSIONS)} SELECT symbol, session_date, round(reference, 6) AS reference FROM ref")
def _(spark, sf):
    return st.volatility_reference(_feats(spark, sf), SESSIONS).select("symbol", "session_date", F.round("reference", 6).alias("reference"))


@query("j_stratify", f"WITH {O.FEATS}, {STRAT} SELECT symbol, ce, bucket, band FROM strat")
def _(spark, sf):
    return st.stratified(_feats(spark, sf), SESSIONS).select("symbol", "ce", "bucket", "band")


@query("a_lift", f"WITH {ARMS},\n{_lift_sql('arms', 20)} {_LIFT_OUT}")
def _(spark, sf):
    return _shown(st.matched_lift(_arms(spark, sf)))


@query("a_lift_search", f"WITH {ARMS},\n{_lift_sql('arms', 1)} {_LIFT_OUT}")
def _(spark, sf):
    """The screen's lift: no rule against thin strata."""
    return _shown(st.matched_lift(_arms(spark, sf), thin=1))


@query("a_conditioning", f"WITH {ARMS}, split AS (SELECT * REPLACE (CASE WHEN above THEN 'event' ELSE 'control' END AS arm) FROM arms WHERE arm = 'event'),\n{_lift_sql('split', 10)} {_LIFT_OUT}")
def _(spark, sf):
    """Events that meet the condition against those that do not, ten in a stratum at least."""
    a = _arms(spark, sf).where("arm = 'event'").withColumn("arm", F.when(F.col("above"), "event").otherwise("control"))
    return _shown(st.matched_lift(a, thin=10))


@query("a_arm_stats", f"WITH {ARMS} SELECT hypothesis, arm, count(*) AS n, round(avg(y), 4) AS mean, round(median(y), 4) AS median, round(avg(mfe), 4) AS mfe, round(avg(mae), 4) AS mae, round(avg(CAST(fav AS INT)), 4) AS favorable_first FROM arms GROUP BY ALL")
def _(spark, sf):
    g = _arms(spark, sf).groupBy("hypothesis", "arm").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.median("y").alias("median"), F.avg("mfe").alias("mfe"), F.avg("mae").alias("mae"), F.avg(F.col("fav").cast("int")).alias("favorable_first"))
    return g.select("hypothesis", "arm", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "mfe", "mae", "favorable_first")])


@query("a_measure_control", f"WITH {ARMS} SELECT hypothesis, stratum, count(*) AS n, CAST(sum(y) AS BIGINT) AS total, CAST(max(mfe) AS BIGINT) AS best FROM arms WHERE arm = 'control' GROUP BY ALL")
def _(spark, sf):
    return _arms(spark, sf).where("arm = 'control'").groupBy("hypothesis", "stratum").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("total"), F.max("mfe").cast("long").alias("best"))


@query("j_control_pool", f"WITH {ARMS} SELECT hypothesis, symbol, ce, stratum FROM arms WHERE arm = 'control'")
def _(spark, sf):
    return _arms(spark, sf).where("arm = 'control'").select("hypothesis", "symbol", "ce", "stratum")


@query("j_event_anchor", f"WITH {O.EVS},\n{O.paths('p', 3600)} SELECT e.event, count(*) AS n, count(*) FILTER (p.ce IS NULL) AS unmatched FROM evs e LEFT JOIN (SELECT symbol, ce FROM p WHERE n_path > 0) p ON e.symbol = p.symbol AND e.ce = p.ce GROUP BY e.event")
def _(spark, sf):
    """Events that find a measured anchor at their time, and those that do not."""
    f = _feats(spark, sf)
    p = pt.with_paths(f, 3600).where("n_path > 0").select(F.col("symbol").alias("a_symbol"), F.col("ce").alias("a_ce"))
    j = ft.all_events(f).join(p, (F.col("symbol") == F.col("a_symbol")) & (F.col("ce") == F.col("a_ce")), "left")
    return j.groupBy("event").agg(F.count("*").alias("n"), F.count_if(F.col("a_ce").isNull()).alias("unmatched"))


# -- resampling --------------------------------------------------------------------------------------------

_USABLE = "keep AS (SELECT hypothesis, stratum FROM arms GROUP BY ALL HAVING count(*) FILTER (arm = 'event') > 0 AND count(*) FILTER (arm = 'control') >= 20), u AS (SELECT arms.* FROM arms JOIN keep USING (hypothesis, stratum))"
_ROUND_LIFT = "l AS (SELECT hypothesis, round, sum(es) / sum(en) - sum(en * cs / cn) / sum(en) AS lift FROM sums WHERE en > 0 AND cn > 0 GROUP BY ALL)"
_CI = "ci AS (SELECT hypothesis, list_sort(list(lift)) AS m, count(*) FILTER (lift <= 0) AS below, count(*) FILTER (lift >= 0) AS above FROM l GROUP BY hypothesis), iv AS (SELECT hypothesis, m[CAST(floor(len(m) * ((1 - 0.95) / 2)) AS BIGINT) + 1] AS lo, m[CAST(least(len(m) - 1, floor(len(m) * (1 - (1 - 0.95) / 2))) AS BIGINT) + 1] AS hi, least(1.0, 2.0 * (least(below, above) + 1) / (len(m) + 1)) AS p FROM ci)"
_BY_ARM = "CAST(sum(y * {t}) FILTER (arm = 'event') AS DOUBLE) AS es, CAST(sum({t}) FILTER (arm = 'event') AS DOUBLE) AS en, CAST(sum(y * {t}) FILTER (arm = 'control') AS DOUBLE) AS cs, CAST(sum({t}) FILTER (arm = 'control') AS DOUBLE) AS cn"
_CLUSTER = f"""{_USABLE}, c AS (SELECT hypothesis, session_date, stratum, {_BY_ARM.format(t=1)} FROM u GROUP BY ALL),
s AS (SELECT hypothesis, session_date, row_number() OVER (PARTITION BY hypothesis ORDER BY session_date) - 1 AS pick, count(*) OVER (PARTITION BY hypothesis) AS k FROM (SELECT DISTINCT hypothesis, session_date FROM c)),
taken AS (SELECT k, round, CAST('0x' || substr(md5('20260907|' || round || '|' || i), 1, 8) AS BIGINT) % k AS pick, count(*) AS times FROM (SELECT DISTINCT k FROM s WHERE k >= 10), range(1, 2001) t(round), LATERAL (SELECT unnest(range(0, k)) AS i) GROUP BY ALL),
sums AS (SELECT hypothesis, round, stratum, sum(es * times) AS es, sum(en * times) AS en, sum(cs * times) AS cs, sum(cn * times) AS cn FROM c JOIN s USING (hypothesis, session_date) JOIN taken USING (k, pick) GROUP BY ALL),
{_ROUND_LIFT}, {_CI}"""


@query("i_boot_cluster", f"WITH {ARMS}, {_CLUSTER} SELECT x.hypothesis, x.sessions, round(lo, 4) AS ci_low, round(hi, 4) AS ci_high, round(p, 6) AS p FROM (SELECT hypothesis, max(k) AS sessions FROM s GROUP BY hypothesis) x LEFT JOIN iv USING (hypothesis)")
def _(spark, sf):
    b = st.cluster_bootstrap(st.usable(_arms(spark, sf)))
    return b.select("hypothesis", "sessions", *[F.round(c, 4).alias(c) for c in ("ci_low", "ci_high")], F.round("p", 6).alias("p"))


_EVENT_BOOT = f"""v AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY hypothesis, stratum, arm) AS k FROM u WINDOW w AS (PARTITION BY hypothesis, stratum, arm ORDER BY symbol, ce, y)),
d AS (SELECT hypothesis, stratum, arm, round, CAST('0x' || substr(md5('20260907|' || round || '|' || arm || '|' || stratum || '|' || i), 1, 8) AS BIGINT) % k AS i, count(*) AS times FROM v, range(1, {DIAGNOSTIC + 1}) t(round) GROUP BY ALL),
sums AS (SELECT hypothesis, round, stratum, {_BY_ARM.format(t='times')} FROM d JOIN v USING (hypothesis, stratum, arm, i) GROUP BY ALL), {_ROUND_LIFT}, {_CI}"""


@query("i_boot_event", f"WITH {ARMS}, {_USABLE}, {_EVENT_BOOT} SELECT hypothesis, round(lo, 4) AS ci_low, round(hi, 4) AS ci_high FROM iv")
def _(spark, sf):
    b = st.event_bootstrap(st.usable(_arms(spark, sf)), rounds=DIAGNOSTIC)
    return b.select("hypothesis", *[F.round(c, 4).alias(c) for c in ("ci_low", "ci_high")])


@query("i_perm", f"""WITH {ARMS}, {_USABLE}, v AS (SELECT *, count(*) FILTER (arm = 'event') OVER (PARTITION BY hypothesis, stratum) AS size FROM u),
d AS (SELECT *, row_number() OVER (PARTITION BY hypothesis, round, stratum ORDER BY CAST('0x' || substr(md5('11|' || round || '|' || symbol || '|' || ce), 1, 8) AS BIGINT), symbol, ce) AS place FROM v, range(0, {DIAGNOSTIC + 1}) t(round)),
sums AS (SELECT hypothesis, round, stratum, sum(y) FILTER (is_event) AS es, count(*) FILTER (is_event) AS en, sum(y) FILTER (NOT is_event) AS cs, count(*) FILTER (NOT is_event) AS cn FROM (SELECT *, CASE WHEN round = 0 THEN arm = 'event' ELSE place <= size END AS is_event FROM d) GROUP BY ALL), {_ROUND_LIFT}
SELECT x.hypothesis, count(*) AS trials, round((count(*) FILTER (abs(x.lift) >= abs(real.lift) - 1e-9) + 1) / (count(*) + 1), 6) AS p FROM l x JOIN l real ON x.hypothesis = real.hypothesis AND real.round = 0 WHERE x.round > 0 GROUP BY x.hypothesis""")
def _(spark, sf):
    p = st.permutation(st.usable(_arms(spark, sf)), rounds=DIAGNOSTIC)
    return p.select("hypothesis", "trials", F.round("p", 6).alias("p"))


@query("i_cluster_flag", f"WITH {ARMS}, {_CLUSTER.replace('ci AS', 'ci1 AS').replace('FROM ci)', 'FROM ci1)').replace('iv AS', 'clustered AS').replace('sums', 'sums1').replace('l AS (', 'l1 AS (').replace('FROM l ', 'FROM l1 ')}, {_EVENT_BOOT} SELECT iv.hypothesis, (c.lo > 0 OR c.hi < 0) AS clustered, (iv.lo > 0 OR iv.hi < 0) AS naive, (c.lo > 0 OR c.hi < 0) <> (iv.lo > 0 OR iv.hi < 0) AS changes FROM iv LEFT JOIN clustered c USING (hypothesis)")
def _(spark, sf):
    """Whether taking sessions as the unit changes what the interval says."""
    u = st.usable(_arms(spark, sf))
    c = st.cluster_bootstrap(u).select("hypothesis", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("clustered"))
    e = st.event_bootstrap(u, rounds=DIAGNOSTIC).select("hypothesis", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("naive"))
    return e.join(c, "hypothesis", "left").select("hypothesis", "clustered", "naive", (F.col("clustered") != F.col("naive")).alias("changes"))


# -- tags, screen, winner ----------------------------------------------------------------------------------

_TAGGED = (
    STRAT
    + """,
brk AS (SELECT symbol, ce, max(CASE event WHEN 'structure_break_up' THEN 'up' ELSE 'down' END) AS side FROM evs WHERE event IN ('structure_break_up', 'structure_break_down') GROUP BY ALL),
tagged AS (SELECT s.*, CASE WHEN ce < open_s OR ce >= close_s THEN 'overnight' WHEN ce - open_s < 1800 THEN 'open30' WHEN ce - open_s < 7200 THEN 'mid' ELSE 'late' END AS session_phase, band AS atr_regime, CASE WHEN volume_ratio < 0.7 THEN 'low' WHEN volume_ratio > 1.3 THEN 'high' ELSE 'normal' END AS volume_context,
  coalesce(last_value(CASE WHEN vwap IS NULL THEN NULL WHEN c > vwap THEN 'above' ELSE 'below' END IGNORE NULLS) OVER d, 'above') AS vwap_side, CASE WHEN c - orh > 0 THEN 'above_or' WHEN c - orl < 0 THEN 'below_or' ELSE 'inside_or' END AS or_location,
  CASE WHEN ce - last_value(CASE WHEN side IS NOT NULL THEN ce END IGNORE NULLS) OVER d <= 3600 THEN last_value(side IGNORE NULLS) OVER d ELSE 'none' END AS structure_bias
  FROM strat s LEFT JOIN brk USING (symbol, ce) WINDOW d AS (PARTITION BY symbol, session_date ORDER BY ce ROWS UNBOUNDED PRECEDING))"""
)
_SETS = [c for k in range(3) for c in st.combinations(st.TAGS, k)]
_COND = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN grouping({t}) = 0 THEN '{t}=' || {t} END" for t in st.TAGS) + "], lambda x: x IS NOT NULL)), '&')"


def _cells(name: str, source: str, keys: list[str]) -> str:
    sets = ", ".join("(" + ", ".join([*keys, "stratum", *s]) + ")" for s in _SETS)
    return f"{name} AS (SELECT {', '.join([*keys, 'stratum'])}, {_COND} AS cond, count(*) AS n, CAST(sum(terminal) AS BIGINT) AS total FROM {source} GROUP BY GROUPING SETS ({sets}))"


@query("build_tags", f"WITH {O.EVS}, {_TAGGED} SELECT symbol, ce, {', '.join(st.TAGS)} FROM tagged")
def _(spark, sf):
    return st.tagged(_feats(spark, sf), sessions=SESSIONS).select("symbol", "ce", *st.TAGS)


@query("a_cube", f"WITH {O.EVS}, {_TAGGED},\n{paths('p', 3600, 'tagged')}, a AS (SELECT e.event AS anchor, p.* FROM (SELECT DISTINCT symbol, ce, event FROM evs WHERE event IN ({', '.join(repr(x) for x in inf.ANCHORS)})) e JOIN p USING (symbol, ce) WHERE n_path > 0), {_cells('g', 'a', ['anchor'])} SELECT * FROM g")
def _(spark, sf):
    f = _feats(spark, sf)
    e = ft.all_events(f).where(F.col("event").isin(inf.ANCHORS)).select("symbol", "ce", F.col("event").alias("anchor")).distinct()
    t = pt.with_paths(st.tagged(f, sessions=SESSIONS), 3600).where("n_path > 0").withColumn("y", F.col("terminal"))
    return st.tag_cells(t.join(e, ["symbol", "ce"]), ["anchor"]).select("anchor", "stratum", "cond", "n", "total")


_TAG_LIST = ", ".join(st.TAGS)


def _rows_sql() -> str:
    """Moments of both arms (controls have the anchor ''), one row for each anchor, predecessor and horizon."""
    each = " UNION ALL ".join(
        f"SELECT a.anchor, w.predecessor AS p, {m} AS horizon, d.third, {_TAG_LIST}, t.session_date, stratum, terminal AS up, max_up, max_down FROM p{m} t JOIN moment a USING (symbol, ce) JOIN recent w USING (symbol, ce) JOIN dd d ON d.session_date = t.session_date WHERE n_path > 0" for m in (30, 60)
    )
    return f"""{O.EVS}, {_TAGGED}, anc AS (SELECT symbol, ce, event AS anchor FROM evs WHERE event IN ({_values(inf.ANCHORS)[1:-1].replace('), (', ', ')})),
recent AS (SELECT symbol, ce, '-' AS predecessor FROM strat UNION ALL SELECT DISTINCT s.symbol, s.ce, a.anchor FROM strat s JOIN anc a ON a.symbol = s.symbol AND a.ce BETWEEN s.ce - 3600 AND s.ce WHERE a.anchor IN ({_values(inf.PREDECESSORS)[1:-1].replace('), (', ', ')})),
dd0 AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session_date FROM feats)),
dd AS (SELECT session_date, CASE WHEN i < n // 3 THEN 0 WHEN i < 2 * n // 3 THEN 1 ELSE 2 END AS third FROM dd0),
pool AS (SELECT symbol, ce FROM strat QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('5|' || symbol || '|' || ce), symbol, ce) <= 200),
moment AS (SELECT symbol, ce, anchor FROM anc UNION ALL SELECT symbol, ce, '' FROM pool),
{paths("p30", 1800, "tagged")}, {paths("p60", 3600, "tagged")},
r AS MATERIALIZED ({each})"""


def _screen_sql(c: se.Criteria) -> str:
    fam = ", ".join(f"({i}, '{f}', '{v}')" for i, (f, v) in enumerate((f, v) for f, vs in inf.FAMILIES.items() for v in vs))
    return f"""{_rows_sql()},
re AS (SELECT *, up AS terminal FROM r WHERE anchor <> ''), rc AS (SELECT *, up AS terminal FROM r WHERE anchor = ''),
{_cells("ge", "re", ["anchor", "p", "horizon"])}, {_cells("gc", "rc", ["p", "horizon"])},
gn AS (SELECT p, horizon, cond, sum(n) AS n_controls FROM gc GROUP BY ALL),
per0 AS (SELECT e.anchor, e.p, e.cond, e.horizon, sum(e.n) AS n_events, sum(e.total) / sum(e.n) - sum(e.n * c.total / c.n) FILTER (c.n > 0) / sum(e.n) FILTER (c.n > 0) AS raw FROM ge e LEFT JOIN gc c USING (p, horizon, stratum, cond) GROUP BY ALL),
per AS (SELECT per0.*, n_controls FROM per0 LEFT JOIN gn USING (p, horizon, cond)),
s(i, f, v) AS (VALUES {fam}), one AS (SELECT i, f, f || '=' || v AS cond FROM s),
sets AS (SELECT '' AS cond, 0 AS k UNION ALL SELECT cond, 1 FROM one UNION ALL SELECT least(a.cond, b.cond) || '&' || greatest(a.cond, b.cond), 2 FROM one a JOIN one b ON a.i < b.i AND a.f <> b.f),
anchors(anchor) AS (VALUES {_values(inf.ANCHORS)}), pred(predecessor) AS (VALUES (CAST(NULL AS VARCHAR)), {_values(inf.PREDECESSORS)}),
census AS (SELECT anchor, predecessor, cond, horizon, direction, 1 + k + CASE WHEN predecessor IS NULL THEN 0 ELSE 1 END AS complexity FROM anchors, pred, sets, (VALUES (30), (60)) h(horizon), (VALUES ('up'), ('down')) d(direction) WHERE predecessor IS NULL OR k <= 1),
x AS (SELECT c.*, coalesce(n_events, 0) AS n_events, coalesce(n_events, 0) >= {c.min_events} AS enough, n_controls, CASE direction WHEN 'down' THEN -raw ELSE raw END AS oriented FROM census c LEFT JOIN per ON per.anchor = c.anchor AND per.p = coalesce(c.predecessor, '-') AND per.cond = c.cond AND per.horizon = c.horizon),
scr AS MATERIALIZED (SELECT anchor, predecessor, cond, horizon, direction, complexity, CAST(n_events AS BIGINT) AS n_events, CAST(CASE WHEN enough THEN coalesce(n_controls, 0) ELSE 0 END AS BIGINT) AS n_controls, CASE WHEN enough THEN oriented END AS lift,
  CASE WHEN NOT enough THEN 'below the event floor' WHEN oriented IS NULL THEN 'no matched controls' WHEN oriented <= 0 THEN 'moves against the stated direction' WHEN oriented < {c.min_absolute_lift} THEN 'below the economic floor' ELSE '' END AS reason FROM x),
sl AS MATERIALIZED (SELECT *, anchor || coalesce('|after<' || predecessor || '>', '') || CASE WHEN cond = '' THEN '' ELSE '|' || replace(cond, '&', '|') END || '|' || horizon || 'm|' || direction AS key FROM scr WHERE reason = '' ORDER BY abs(lift) DESC, key LIMIT {c.shortlist_size})"""


def _assess_sql(c: se.Criteria) -> str:
    regimes = inf.FAMILIES["atr_regime"]
    need = " AND ".join(f"(coalesce(v.less, '') = '{t}' OR regexp_extract('&' || v.cond || '&', '&{t}=([^&]*)&', 1) IN ('', r.{t}))" for t in st.TAGS)
    kind = "NULL::INT AS in_third, NULL::VARCHAR AS in_regime, NULL::VARCHAR AS less"
    pick = lambda view, col: f"max({col}) FILTER (view = '{view}')"
    thirds = ", ".join(f"{pick(f'third:{i}', 'lift')} AS t{i}, coalesce({pick(f'third:{i}', 'en')}, 0) AS tn{i}, coalesce({pick(f'third:{i}', 'clusters')}, 0) AS tc{i}" for i in range(3))
    boot = _CLUSTER[_CLUSTER.index("s AS (SELECT hypothesis") :].replace("range(1, 2001)", f"range(1, {c.rounds + 1})").replace("(1 - 0.95) / 2", f"{(1 - c.confidence) / 2!r}::DOUBLE").replace("s AS (SELECT hypothesis", "bs AS (SELECT hypothesis", 1).replace("FROM s WHERE", "FROM bs WHERE").replace("JOIN s USING", "JOIN bs USING").replace("FROM c)", "FROM bc)").replace("FROM c JOIN", "FROM bc JOIN")
    return f"""{_screen_sql(c)},
v AS (SELECT sl.*, 'all' AS view, {kind} FROM sl UNION ALL SELECT sl.*, 'third:' || i, i, NULL, NULL FROM sl, range(0, 3) t(i) UNION ALL SELECT sl.*, 'regime:' || g, NULL, g, NULL FROM sl, (VALUES {_values(regimes)}) t(g) UNION ALL SELECT sl.*, 'drop:' || part, NULL, NULL, part FROM sl, LATERAL (SELECT split_part(unnest(string_split(sl.cond, '&')), '=', 1) AS part) WHERE sl.cond <> ''),
ax AS MATERIALIZED (SELECT v.key, v.view, r.session_date, r.stratum, count(*) FILTER (r.anchor <> '') AS en, count(*) FILTER (r.anchor = '') AS cn, coalesce(sum(CASE v.direction WHEN 'up' THEN r.up ELSE -r.up END) FILTER (r.anchor <> ''), 0) AS es, coalesce(sum(CASE v.direction WHEN 'up' THEN r.up ELSE -r.up END) FILTER (r.anchor = ''), 0) AS cs,
  coalesce(sum(CASE v.direction WHEN 'up' THEN r.max_up ELSE -r.max_down END) FILTER (r.anchor <> ''), 0) AS mfe, coalesce(sum(CASE v.direction WHEN 'up' THEN -r.max_down ELSE r.max_up END) FILTER (r.anchor <> ''), 0) AS mae
  FROM v JOIN r ON r.p = coalesce(v.predecessor, '-') AND r.horizon = v.horizon AND (r.anchor = v.anchor OR r.anchor = '') AND (v.in_third IS NULL OR v.in_third = r.third) AND (v.in_regime IS NULL OR v.in_regime = r.atr_regime) AND {need} GROUP BY ALL),
ast AS (SELECT key, view, stratum, sum(en) AS en, sum(cn) AS cn, sum(es) AS es, sum(cs) AS cs, sum(mfe) AS mfe, sum(mae) AS mae FROM ax GROUP BY ALL),
af AS (SELECT key, view, sum(en) AS en, sum(cn) AS cn, sum(es) AS es, sum(cs) AS cs, sum(mfe) AS mfe, sum(mae) AS mae, CASE WHEN sum(en) > 0 AND sum(cn) > 0 THEN sum(es) / sum(en) - sum(en * cs / cn) FILTER (cn > 0) / sum(en) FILTER (cn > 0) END AS lift FROM ast GROUP BY ALL),
ad AS (SELECT key, view, count(*) AS sessions, CAST(sum(d) AS DOUBLE) * sum(d) / sum(d * d) AS clusters FROM (SELECT key, view, session_date, sum(en) AS d FROM ax WHERE en > 0 GROUP BY ALL) GROUP BY ALL),
ag AS (SELECT af.*, sessions, clusters FROM af LEFT JOIN ad USING (key, view)),
ap AS (SELECT key, {pick('all', 'en')} AS n_events, {pick('all', 'cn')} AS n_controls, {pick('all', 'es')} AS es, {pick('all', 'cs')} AS cs, {pick('all', 'mfe')} AS mfe, {pick('all', 'mae')} AS mae, {pick('all', 'lift')} AS lift, {pick('all', 'sessions')} AS event_sessions, {pick('all', 'clusters')} AS effective_clusters, {thirds}, {', '.join(f"{pick(f'regime:{g}', 'lift')} AS regime_{g}" for g in regimes)} FROM ag GROUP BY key),
aw AS (SELECT key, list('parameter_sensitivity:' || family ORDER BY family) AS weak FROM (SELECT v.key, v.less AS family FROM v JOIN ap USING (key) LEFT JOIN ag ON ag.key = v.key AND ag.view = v.view WHERE v.less IS NOT NULL AND (ag.lift IS NULL OR ag.lift <= 0 OR abs(ag.lift) < {c.min_perturbed_magnitude_ratio} * abs(ap.lift))) GROUP BY key),
a1 AS (SELECT ap.*, complexity, list_filter(list_concat([CASE WHEN ap.n_events < {c.min_events} THEN 'min_events' END, CASE WHEN event_sessions < {c.min_event_sessions} THEN 'min_event_sessions' END, CASE WHEN effective_clusters < {c.min_effective_clusters} THEN 'min_effective_clusters' END,
  CASE WHEN ap.lift < {c.min_absolute_lift} THEN 'min_absolute_lift_points' END, CASE WHEN mfe <> 0 AND abs(ap.lift) / abs(mfe / ap.n_events) < {c.min_lift_to_mfe_ratio} THEN 'min_lift_to_mfe_ratio' END, CASE WHEN NOT coalesce(t0 > 0 AND t1 > 0 AND t2 > 0, false) THEN 'sign_stable_thirds' END,
  CASE WHEN least(tn0, tn1, tn2) < {c.min_events_per_third} THEN 'min_events_per_third' END, CASE WHEN least(tc0, tc1, tc2) < {c.min_clusters_per_third} THEN 'min_clusters_per_third' END, CASE WHEN coalesce(least({', '.join(f'regime_{g}' for g in regimes)}), 0) <= 0 THEN 'sign_stable_regimes' END], coalesce(weak, [])), lambda f: f IS NOT NULL) AS early
  FROM ap JOIN sl USING (key) LEFT JOIN aw USING (key)),
bc AS (SELECT key AS hypothesis, session_date, stratum, CAST(es AS DOUBLE) AS es, CAST(en AS DOUBLE) AS en, CAST(cs AS DOUBLE) AS cs, CAST(cn AS DOUBLE) AS cn FROM ax WHERE view = 'all' AND key IN (SELECT key FROM a1 WHERE len(early) = 0)),
{boot},
assessed AS (SELECT a1.*, lo AS ci_low, hi AS ci_high, iv.p AS p, CASE WHEN len(early) > 0 THEN array_to_string(early, ', ') WHEN lo IS NULL THEN 'no clustered interval' WHEN lo <= 0 THEN 'the {c.confidence:.0%} clustered interval includes zero' ELSE '' END AS failures FROM a1 LEFT JOIN iv ON iv.hypothesis = a1.key)"""


_SCREEN, _ASSESS = _screen_sql(CRITERIA), _assess_sql(CRITERIA)


def _arm_cells(spark, sf):
    return cut(se.arm_cells(se.moments(_feats(spark, sf), sessions=SESSIONS)))


def _assessed(spark, sf):
    cells = _arm_cells(spark, sf)
    return se.assess(cells, cut(se.shortlist(se.screen(spark, cells, CRITERIA), CRITERIA.shortlist_size)), CRITERIA)


@query("i_screen", f"WITH {_SCREEN} SELECT * REPLACE (round(lift, 4) + 0.0 AS lift) FROM scr")
def _(spark, sf):
    return se.screen(spark, _arm_cells(spark, sf), CRITERIA).withColumn("lift", F.round("lift", 4) + 0.0)  # no negative zero


@query("set_census", f"WITH {_SCREEN} SELECT anchor, predecessor, cond, horizon, direction, complexity, n_events FROM scr")
def _(spark, sf):
    """The frozen candidate space with what the tape holds of each candidate."""
    return se.screen(spark, _arm_cells(spark, sf), CRITERIA).select("anchor", "predecessor", "cond", "horizon", "direction", "complexity", "n_events")


@query("w_topk_short", f"WITH {_SCREEN} SELECT key, n_events, round(lift, 4) AS lift FROM sl")
def _(spark, sf):
    """The shortlist: of all candidates that pass the screen those with the largest lifts."""
    return se.shortlist(se.screen(spark, _arm_cells(spark, sf), CRITERIA), CRITERIA.shortlist_size).select("key", "n_events", F.round("lift", 4).alias("lift"))


_FIGURES = ["effective_clusters", "event_mean", "control_mean", "lift", "mfe_mean", "mae_mean", "third_1", "third_2", "third_3", *(f"regime_{g}" for g in inf.FAMILIES["atr_regime"]), "ci_low", "ci_high", "p", "score"]


@query(
    "i_assess",
    f"""WITH {_ASSESS}, shown AS (SELECT *, es / n_events AS event_mean, cs / n_controls AS control_mean, mfe / n_events AS mfe_mean, mae / n_events AS mae_mean, t0 AS third_1, t1 AS third_2, t2 AS third_3, CASE WHEN failures = '' THEN abs(lift) * pow({CRITERIA.complexity_penalty}, complexity - 1) END AS score FROM assessed)
SELECT key, CAST(n_events AS BIGINT) AS n_events, CAST(n_controls AS BIGINT) AS n_controls, event_sessions, {', '.join(f'round({c}, 4) AS {c}' for c in _FIGURES)}, failures, failures = '' AS qualified FROM shown""",
)
def _(spark, sf):
    """Every candidate of the shortlist against all criteria, its failures in the order of the rules."""
    a = _assessed(spark, sf)
    a = a.withColumns({f"third_{i + 1}": F.element_at("thirds_lift", i + 1) for i in range(3)} | {f"regime_{g}": F.element_at("regimes", i + 1) for i, g in enumerate(inf.FAMILIES["atr_regime"])})
    return a.select("key", "n_events", "n_controls", "event_sessions", *[F.round(c, 4).alias(c) for c in _FIGURES], F.array_join("failures", ", ").alias("failures"), "qualified")


@query("w_winner", f"WITH {_ASSESS} SELECT key, CAST(n_events AS BIGINT) AS n_events, round(effective_clusters, 4) AS effective_clusters, round(lift, 4) AS lift, round(ci_low, 4) AS ci_low, round(abs(lift) * pow({CRITERIA.complexity_penalty}, complexity - 1), 4) AS score FROM assessed WHERE failures = '' ORDER BY abs(lift) * pow({CRITERIA.complexity_penalty}, complexity - 1) DESC, effective_clusters DESC, key LIMIT 1")
def _(spark, sf):
    """The single winner among the assessed candidates, by formula."""
    return se.winner(_assessed(spark, sf)).select("key", "n_events", *[F.round(c, 4).alias(c) for c in ("effective_clusters", "lift", "ci_low", "score")])


# -- distribution functions ----------------------------------------------------------------------------------


def _quantile_sql(p: str) -> str:
    ratio = lambda pair, x: f"{inf.horner(pair[0][::-1], x)} / {inf.horner(pair[1][::-1], x)}"
    tail = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    return f"CASE WHEN abs({p} - 0.5) <= {0.5 - inf.TAIL} THEN ({p} - 0.5) * {ratio(inf.MIDDLE, f'(({p} - 0.5) * ({p} - 0.5))')} WHEN {p} < 0.5 THEN {ratio(inf.TAILS, tail)} ELSE -({ratio(inf.TAILS, tail)}) END"


@query("math_quantile", f"SELECT o_orderkey, round({_quantile_sql('p')}, 6) + 0.0 AS z FROM (SELECT o_orderkey, (o_orderkey % 9973 + 1) / 9974.0::DOUBLE AS p FROM orders)")
def _(spark, sf):
    """The inverse normal distribution function in its middle and both tails."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", ((F.col("o_orderkey") % 9973 + 1).cast("double") / 9974).alias("p"))
    return o.select("o_orderkey", (F.round(inf.normal_quantile(F.col("p")), 6) + 0.0).alias("z"))


_Z = f"(SELECT {_quantile_sql('0.975::DOUBLE')} + {_quantile_sql('0.8::DOUBLE')})"


@query("math_minimum_n", f"WITH {_OBS} SELECT hypothesis, n, CASE WHEN sd > 0 AND mean <> 0 THEN CAST(ceil(pow({_Z} * sd / abs(mean), 2)) AS BIGINT) END AS minimum_n, n >= ceil(pow({_Z} * sd / abs(nullif(mean, 0)), 2)) AS enough FROM (SELECT hypothesis, count(*) AS n, avg(signed) AS mean, stddev_pop(signed) AS sd FROM obs GROUP BY hypothesis)")
def _(spark, sf):
    """How many events each hypothesis would need to show the effect that it has."""
    e = inf.estimate(_observations(spark, sf), ["hypothesis"], "signed")
    n, mean, sd = F.col("n"), F.col("mean"), F.col("sd")
    return e.select("hypothesis", "n", inf.minimum_n(mean, sd).alias("minimum_n"), inf.enough(n, mean, sd).alias("enough"))
