"""Event and control arms of a study, matched lifts, resampling of both arms, and market-state tags."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import features as ft
from . import inference as inf
from . import paths as pt
from .inference import md5_int


def volatility_reference(f: DataFrame, sessions: int = 20) -> DataFrame:
    """(symbol, session_date, reference): median closing ATR of the previous ``sessions`` sessions that have one; null if there are fewer.

    Windows run over one row per session.
    """
    c = f.where("atr is not null").groupBy("symbol", "session_date").agg(F.max_by("atr", "ce").alias("atr"))
    w = Window.partitionBy("symbol").orderBy("session_date").rowsBetween(-sessions, -1)
    return c.select("symbol", "session_date", F.when(F.count("atr").over(w) == sessions, F.expr("percentile(atr, 0.5)").over(w)).alias("reference"))


def stratified(f: DataFrame, sessions: int = 20, quiet: float = 0.75, elevated: float = 1.25) -> DataFrame:
    """Adds bucket (hours since the open), band (of the ATR against the reference) and stratum (both) to every bar."""
    ref = volatility_reference(f, sessions).withColumnsRenamed({"symbol": "v_symbol", "session_date": "v_date"})
    j = f.join(ref, (F.col("symbol") == F.col("v_symbol")) & (F.col("session_date") == F.col("v_date")), "left").drop("v_symbol", "v_date")
    band = F.expr(f"case when reference is null or atr is null then 'unknown' when atr < {quiet}D * reference then 'quiet' when atr > {elevated}D * reference then 'elevated' else 'normal' end")
    j = j.withColumn("bucket", F.expr("floor((ce - open_s) / 3600)")).withColumn("band", band)
    return j.withColumn("stratum", F.concat_ws("|", F.col("bucket").cast("string"), "band"))


def arms(spark: SparkSession, f: DataFrame, pool: int = 200, seed: int = 5, sessions: int = 20) -> DataFrame:
    """Both arms of every hypothesis, measured on its own horizon and turned in its direction.

    hypothesis, arm (event or control), symbol, session_date, ce, stratum, y, mfe, mae, fav, above. Controls are bars
    without the hypothesis's own event, ``pool`` of each stratum at the most, the first by md5.
    """
    hyp = F.broadcast(inf.hypotheses(spark))  # the preregistered list, a dozen rows
    s = stratified(f, sessions)
    p = None
    for b in (1, 2, 4):
        x = pt.with_paths(s, b * 3600).where("n_path > 0").select(F.lit(b).alias("bars"), "symbol", "session_date", "ce", "stratum", "above_vwap", "terminal", "max_up", "max_down", "max_up_at", "max_down_at")
        p = x if p is None else p.unionByName(x)
    each = pt.oriented(p.join(hyp, "bars"))
    own = ft.all_events(f).select(F.col("event").alias("o_event"), F.col("symbol").alias("o_symbol"), F.col("ce").alias("o_ce"))
    # one join tells both arms apart: a bar with the hypothesis's own event is no control, whatever its condition
    j = each.join(own, (F.col("event") == F.col("o_event")) & (F.col("symbol") == F.col("o_symbol")) & (F.col("ce") == F.col("o_ce")), "left").withColumn("arm", F.when(F.col("o_ce").isNull(), "control").otherwise("event"))
    draw = F.row_number().over(Window.partitionBy("hypothesis", "stratum", "arm").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "hypothesis", "symbol", F.col("ce").cast("string")).cast("binary")), "symbol", "ce"))
    j = j.withColumn("draw", draw).where(F.when(F.col("arm") == "control", F.col("draw") <= pool).otherwise(F.expr("above is null or above_vwap = above")))
    return j.select("arm", "hypothesis", "symbol", "session_date", "ce", "stratum", F.col("signed").alias("y"), "mfe", "mae", F.col("favorable_first").alias("fav"), F.coalesce(F.col("above_vwap") == "above", F.lit(False)).alias("above"))


def cells(a: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums and counts of both arms for each of keys and stratum, in one aggregate."""
    e, c = F.col("arm") == "event", F.col("arm") == "control"
    out = []
    for side, name in ((e, "e"), (c, "c")):
        out += [F.count_if(side).alias(f"{name}n"), F.count_if(side & F.col("fav").isNotNull()).alias(f"{name}fn")]
        out += [F.sum(F.when(side, F.col(v).cast("double"))).alias(f"{name}_{v}") for v in ("y", "mfe", "mae")] + [F.sum(F.when(side & F.col("fav"), 1.0).when(side & ~F.col("fav"), 0.0)).alias(f"{name}_fav")]
    return a.groupBy(*keys, "stratum").agg(*out)


def matched_lift(a: DataFrame, keys: Sequence[str] = ("hypothesis",), thin: int = 20) -> DataFrame:
    """Event means less control means standardised to the events' strata.

    Strata with fewer than ``thin`` controls leave both arms and are counted; weights are renormalised for a measure
    that a stratum's controls do not have. Everything comes from one row per stratum.
    """
    x = cells(a, keys).where("en > 0").withColumn("ok", F.col("cn") >= thin)
    ok = lambda v: F.sum(F.when(F.col("ok"), v))
    base = {}
    for v in ("y", "mfe", "mae", "fav"):
        have = F.col("ok") & ((F.col("cfn") > 0) if v == "fav" else F.lit(True))
        mean = F.col(f"c_{v}") / (F.col("cfn") if v == "fav" else F.col("cn"))
        base[v] = F.try_divide(F.sum(F.when(have, F.col("en") * mean)), F.sum(F.when(have, F.col("en"))))
    arm = {v: F.try_divide(ok(F.col(f"e_{v}")), ok(F.col("efn" if v == "fav" else "en"))) for v in base}
    return x.groupBy(*keys).agg(
        F.coalesce(ok(F.col("en")), F.lit(0)).cast("long").alias("n"), F.count_if("ok").alias("strata_used"), F.count_if(~F.col("ok")).alias("strata_dropped"), F.sum(F.when(~F.col("ok"), F.col("en")).otherwise(0)).cast("long").alias("events_dropped"),
        arm["y"].alias("event_mean"), base["y"].alias("control_mean"), (arm["y"] - base["y"]).alias("lift"), *[(arm[v] - base[v]).alias(f"{v}_lift") for v in ("mfe", "mae", "fav")],
    )


def usable(a: DataFrame, keys: Sequence[str] = ("hypothesis",), thin: int = 20) -> DataFrame:
    """Rows of both arms in strata that hold events and enough controls."""
    k = a.groupBy(*keys, "stratum").agg(F.count_if(F.col("arm") == "event").alias("en"), F.count_if(F.col("arm") == "control").alias("cn")).where(f"en > 0 and cn >= {thin}").drop("en", "cn")
    return a.join(k, [*keys, "stratum"], "left_semi")


def _round_lift(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lift of each round from stratum sums (es, en, cs, cn), over the strata that both arms have."""
    both = sums.where("en > 0 and cn > 0")
    return both.groupBy(*keys, "round").agg((F.sum("es") / F.sum("en") - F.sum(F.col("en") * F.col("cs") / F.col("cn")) / F.sum("en")).alias("lift"))


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Few rows that are about to become many: over all cores first, since adaptive execution goes by bytes."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *by)


def _interval(lifts: DataFrame, keys: Sequence[str], confidence: float) -> DataFrame:
    """Percentile interval and two-sided p of the rounds' lifts; one row per round and key meets, ``rounds`` at the most."""
    tail = (1 - confidence) / 2
    g = lifts.groupBy(*keys).agg(F.sort_array(F.collect_list("lift")).alias("m"), F.count_if(F.col("lift") <= 0).alias("below"), F.count_if(F.col("lift") >= 0).alias("above"))
    size = F.size("m")
    at = lambda i: F.element_at("m", i.cast("int") + 1)
    p = F.least(F.lit(1.0), 2.0 * (F.least("below", "above") + 1) / (size + 1))
    return g.select(*keys, at(F.floor(size * F.lit(tail))).alias("ci_low"), at(F.least(size - 1, F.floor(size * F.lit(1 - tail)))).alias("ci_high"), p.alias("p"))


def cluster_bootstrap(a: DataFrame, keys: Sequence[str] = ("hypothesis",), rounds: int = 2000, confidence: float = 0.95, least: int = 10, seed: int = 20260907) -> DataFrame:
    """Interval and p of the lift, drawing whole sessions with replacement for both arms together.

    Rows shrink to one per session and stratum first; a round's draws shrink to how often it takes each session.
    Keys with fewer than ``least`` sessions get nulls. Returns keys, sessions, ci_low, ci_high, p.
    """
    c = a.groupBy(*keys, "session_date", "stratum").agg(*[F.sum(F.when(F.col("arm") == arm, x)).alias(n) for arm, n, x in (("event", "es", F.col("y")), ("event", "en", F.lit(1)), ("control", "cs", F.col("y")), ("control", "cn", F.lit(1)))])
    return bootstrap_cells(c, keys, rounds, confidence, least, seed)


def bootstrap_cells(cells: DataFrame, keys: Sequence[str], rounds: int = 2000, confidence: float = 0.95, least: int = 10, seed: int = 20260907) -> DataFrame:
    """cluster_bootstrap from sums and counts of each session and stratum (es, en, cs, cn)."""
    c = cut(cells)
    w = Window.partitionBy(*keys)
    s = c.select(*keys, "session_date").distinct().withColumn("pick", F.row_number().over(w.orderBy("session_date")) - 1).withColumn("k", F.count("*").over(w))
    sizes = s.select("k").distinct().where(F.col("k") >= least)
    draws = sizes.select("k", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).select("k", "round", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
    taken = draws.groupBy("k", "round", F.pmod(md5_int(F.lit(seed), F.col("round"), F.col("i")), F.col("k")).alias("pick")).agg(F.count("*").alias("times"))
    placed = _spread(taken, "round").join(c.join(s, [*keys, "session_date"]), ["k", "pick"])
    sums = placed.groupBy(*keys, "round", "stratum").agg(*[F.sum(F.col(x) * F.col("times")).alias(x) for x in ("es", "en", "cs", "cn")])
    ci = _interval(_round_lift(sums, keys), keys, confidence)
    return s.groupBy(*keys).agg(F.max("k").alias("sessions")).join(ci, list(keys), "left")


def event_bootstrap(a: DataFrame, keys: Sequence[str] = ("hypothesis",), rounds: int = 400, confidence: float = 0.95, seed: int = 20260907) -> DataFrame:
    """The interval that treats every event as independent, for comparison only: draws inside each arm and stratum."""
    w = Window.partitionBy(*keys, "stratum", "arm")
    v = a.withColumn("i", F.row_number().over(w.orderBy("symbol", "ce", "y")) - 1).withColumn("k", F.count("*").over(w)).select(*keys, "stratum", "arm", "i", "k", "y")
    draws = _spread(v, "stratum", "i").select(*keys, "stratum", "arm", "k", "i", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    draws = draws.withColumn("pick", F.pmod(md5_int(F.lit(seed), F.col("round"), F.col("arm"), F.col("stratum"), F.col("i")), F.col("k"))).groupBy(*keys, "stratum", "arm", "round", "pick").agg(F.count("*").alias("times"))
    got = draws.join(v.select(*keys, "stratum", "arm", F.col("i").alias("pick"), "y"), [*keys, "stratum", "arm", "pick"])
    sums = got.groupBy(*keys, "round", "stratum").agg(*[F.sum(F.when(F.col("arm") == arm, x * F.col("times"))).alias(n) for arm, n, x in (("event", "es", F.col("y")), ("event", "en", F.lit(1)), ("control", "cs", F.col("y")), ("control", "cn", F.lit(1)))])
    return _interval(_round_lift(sums, keys), keys, confidence).select(*keys, "ci_low", "ci_high")


def permutation(a: DataFrame, keys: Sequence[str] = ("hypothesis",), rounds: int = 400, seed: int = 11) -> DataFrame:
    """p of the lift by relabelling both arms inside each stratum, keeping both counts; the order comes from md5."""
    w = Window.partitionBy(*keys, "stratum")
    v = a.withColumn("size", F.count_if(F.col("arm") == "event").over(w)).select(*keys, "stratum", "arm", "symbol", "ce", "y", "size")
    label = lambda s, is_event: s.groupBy(*keys, "round", "stratum").agg(F.sum(F.when(is_event, F.col("y"))).alias("es"), F.count_if(is_event).alias("en"), F.sum(F.when(~is_event, F.col("y"))).alias("cs"), F.count_if(~is_event).alias("cn"))
    real = _round_lift(label(v.withColumn("round", F.lit(0)), F.col("arm") == "event"), keys).select(*keys, F.abs("lift").alias("real"))
    drawn = _spread(v, "symbol", "ce").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    order = Window.partitionBy(*keys, "round", "stratum").orderBy(md5_int(F.lit(seed), F.col("round"), F.col("symbol"), F.col("ce")), "symbol", "ce")
    drawn = drawn.withColumn("place", F.row_number().over(order))
    lifts = _round_lift(label(drawn, F.col("place") <= F.col("size")), keys)
    # a hair below, so that the sum's last bit does not decide ties
    g = lifts.join(real, list(keys)).groupBy(*keys).agg(F.count_if(F.abs("lift") >= F.col("real") - 1e-9).alias("extreme"), F.count("*").alias("trials"))
    return g.select(*keys, "trials", ((F.col("extreme") + 1) / (F.col("trials") + 1)).alias("p"))


# -- market-state tags  --------------------------------------------------------------

TAGS = ("session_phase", "atr_regime", "volume_context", "vwap_side", "or_location", "structure_bias")


def tagged(f: DataFrame, structure_s: int = 3600, sessions: int = 20) -> DataFrame:
    """Every bar with its six tags, as known at its close, and its stratum."""
    s = stratified(f, sessions)
    breaks = ft.structure_events(f).select(F.col("symbol").alias("k_symbol"), F.col("ce").alias("k_ce"), F.when(F.col("event") == "structure_break_up", "up").otherwise("down").alias("side")).groupBy("k_symbol", "k_ce").agg(F.max("side").alias("side"))
    s = s.join(breaks, (F.col("symbol") == F.col("k_symbol")) & (F.col("ce") == F.col("k_ce")), "left")
    run = ft.w_d().rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("last_break", F.last(F.when(F.col("side").isNotNull(), F.struct(F.col("ce").alias("at"), "side")), True).over(run)).withColumn("vwap_known", F.last("above_vwap", True).over(run))
    return s.withColumns(
        {
            "session_phase": F.expr("case when ce < open_s or ce >= close_s then 'overnight' when ce - open_s < 1800 then 'open30' when ce - open_s < 7200 then 'mid' else 'late' end"),
            "atr_regime": F.col("band"),
            "volume_context": F.expr("case when volume_ratio < 0.7D then 'low' when volume_ratio > 1.3D then 'high' else 'normal' end"),
            "vwap_side": F.coalesce("vwap_known", F.lit("above")),
            "or_location": F.expr("case when distance_to_orh > 0 then 'above_or' when distance_to_orl < 0 then 'below_or' else 'inside_or' end"),
            "structure_bias": F.when(F.col("ce") - F.col("last_break.at") <= structure_s, F.col("last_break.side")).otherwise("none"),
        }
    )


def tag_cells(rows: DataFrame, keys: Sequence[str], most: int = 2, n: Column | None = None, total: Column | None = None) -> DataFrame:
    """(keys, stratum, cond, k, n, total) for every set of at most ``most`` tags, by grouping sets in one aggregate.

    Rows count once with the value y, or as ``n`` and ``total`` say.
    """
    sets = [c for k in range(most + 1) for c in combinations(TAGS, k)]
    g = rows.groupingSets([[F.col(c) for c in (*keys, "stratum", *s)] for s in sets], *[F.col(c) for c in (*keys, "stratum", *TAGS)])
    n, total = (F.count("*") if n is None else n), (F.sum("y") if total is None else total)
    g = g.agg(n.alias("n"), total.cast("long").alias("total"), *[F.grouping(t).alias(f"g_{t}") for t in TAGS])
    shown = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"g_{t}") == 0, F.concat(F.lit(f"{t}="), F.col(t))) for t in TAGS])))
    return g.select(*keys, "stratum", F.array_join(shown, "&").alias("cond"), F.size(shown).alias("k"), "n", "total")
