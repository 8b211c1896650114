"""The candidate search: cells of both arms, the screen over the census, and the full assessment of a shortlist."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import features as ft
from . import inference as inf
from . import paths as pt
from .study import TAGS, bootstrap_cells, tag_cells, tagged


@dataclass(frozen=True)
class Criteria:
    """The bar that a candidate must clear, and how candidates are ranked; lifts are in ticks."""

    min_events: int = 200
    min_event_sessions: int = 100
    min_effective_clusters: float = 60
    min_events_per_third: int = 40
    min_clusters_per_third: float = 15
    min_absolute_lift: float = 100.0
    min_lift_to_mfe_ratio: float = 0.10
    min_perturbed_magnitude_ratio: float = 0.50
    confidence: float = 0.99
    rounds: int = 2000
    family_wise_alpha: float = 0.05
    shortlist_size: int = 50
    complexity_penalty: float = 0.80


def candidate_key() -> Column:
    """A candidate's name: anchor, predecessor, conditions, horizon and direction."""
    parts = ["anchor", F.concat(F.lit("after<"), "predecessor", F.lit(">")), F.when(F.col("cond") != "", F.replace("cond", F.lit("&"), F.lit("|"))), F.concat(F.col("horizon").cast("string"), F.lit("m")), "direction"]
    return F.concat_ws("|", *parts)


def moments(f: DataFrame, horizons: Sequence[int] = (30, 60), recent_s: int = 3600, sessions: int = 20, pool: int = 200, seed: int = 5) -> DataFrame:
    """Every bar that is an event's or a control's moment, once: third, stratum, tags, arms, predecessors and measured paths.

    ``arms`` has each anchor event at the bar, and '' if the bar is in the control pool: any bar may be, event or not,
    ``pool`` of each stratum at the most, the first by md5. ``predecessors`` has '-' and the types of the last ``recent_s``. The
    tape's trading days are cut into thirds in time order.
    """
    t = tagged(f, sessions=sessions)
    for m in horizons:
        t = pt.with_paths(t, m * 60).withColumn(f"path_{m}", F.when(F.col("n_path") > 0, F.struct(F.lit(m).alias("horizon"), F.col("terminal").alias("up"), "max_up", "max_down")))
        t = t.drop("terminal", "max_up", "max_down", "max_up_at", "max_down_at", "n_path", "truncated")
    days = f.select(F.col("session_date").alias("d_date")).distinct()  # one row for each trading day
    days = days.withColumn("i", F.row_number().over(Window.orderBy("d_date")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    days = days.select("d_date", F.expr("case when i < n div 3 then 0 when i < 2 * n div 3 then 1 else 2 end").alias("third"))
    at = ft.all_events(f).where(F.col("event").isin(inf.ANCHORS)).groupBy(F.col("symbol").alias("e_symbol"), F.col("ce").alias("e_ce"))
    at = at.agg(F.collect_list("event").alias("anchors"), F.array_intersect(F.collect_set("event"), F.array(*map(F.lit, inf.PREDECESSORS))).alias("here"))
    draw = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "symbol", F.col("ce").cast("string")).cast("binary")), "symbol", "ce"))
    drawn = t.select("symbol", "ce", "stratum").withColumn("draw", draw).where(F.col("draw") <= pool).select(F.col("symbol").alias("c_symbol"), F.col("ce").alias("c_ce"))
    x = t.join(days, F.col("session_date") == F.col("d_date")).join(at, (F.col("symbol") == F.col("e_symbol")) & (F.col("ce") == F.col("e_ce")), "left").join(drawn, (F.col("symbol") == F.col("c_symbol")) & (F.col("ce") == F.col("c_ce")), "left")
    recent = F.flatten(F.collect_list("here").over(Window.partitionBy("symbol").orderBy("ce").rangeBetween(-recent_s, 0)))
    x = x.withColumn("predecessors", F.concat(F.array(F.lit("-")), F.array_distinct(recent)))
    arms = F.concat(F.coalesce("anchors", F.array().cast("array<string>")), F.when(F.col("c_ce").isNotNull(), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    x = x.select("symbol", "ce", "session_date", "third", "stratum", *TAGS, arms.alias("arms"), "predecessors", F.array_compact(F.array(*[f"path_{m}" for m in horizons])).alias("paths"))
    return x.where("size(arms) > 0 and size(paths) > 0")


def arm_cells(m: DataFrame) -> DataFrame:
    """The finest cells that screen and assessment roll up: n and sums of up, max_up and max_down for each

    (anchor, predecessor, horizon, third, six tags, session, stratum); controls have the anchor ''.
    """
    x = m.withColumn("anchor", F.explode("arms")).withColumn("path", F.explode("paths")).withColumn("p", F.explode("predecessors"))
    g = x.groupBy("anchor", "p", F.col("path.horizon").alias("horizon"), "third", *TAGS, "session_date", "stratum")
    return g.agg(F.count("*").alias("n"), *[F.sum(F.col(f"path.{c}")).cast("long").alias(c) for c in ("up", "max_up", "max_down")])


def standardised(total: str, n: str, control_total: str, control_n: str) -> Column:
    """Event mean less the control mean standardised to the events' strata, over rows of strata; null if no stratum has controls."""
    both = F.col(control_n) > 0
    mean = F.sum(F.when(both, F.col(n) * F.col(control_total) / F.col(control_n)))
    return F.try_divide(F.sum(total), F.sum(n)) - F.try_divide(mean, F.sum(F.when(both, F.col(n))))


def screen(spark: SparkSession, cells: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """Every candidate of the census with its events, controls, lift in its direction and the reason it fails, if it does."""
    flat = cells.groupBy("anchor", "p", "horizon", "stratum", *TAGS).agg(F.sum("n").alias("n"), F.sum("up").alias("y"))
    sums = {"n": F.sum("n"), "total": F.sum("y")}
    e = tag_cells(flat.where("anchor <> ''"), ["anchor", "p", "horizon"], **sums)
    c = cut(tag_cells(flat.where("anchor = ''"), ["p", "horizon"], **sums).select("p", "horizon", "stratum", "cond", F.col("n").alias("cn"), F.col("total").alias("cs")))
    g = e.join(c, ["p", "horizon", "stratum", "cond"], "left").groupBy("anchor", "p", "cond", "horizon").agg(F.sum("n").alias("n_events"), standardised("total", "n", "cs", "cn").alias("raw"))
    g = g.join(c.groupBy("p", "horizon", "cond").agg(F.sum("cn").alias("n_controls")), ["p", "horizon", "cond"], "left")
    x = inf.census(spark).withColumn("p", F.coalesce("predecessor", F.lit("-"))).join(g, ["anchor", "p", "cond", "horizon"], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))
    enough = F.col("n_events") >= criteria.min_events
    x = x.withColumn("lift", F.when(enough, F.when(F.col("direction") == "down", -F.col("raw")).otherwise(F.col("raw"))))
    reason = F.when(~enough, "below the event floor").when(F.col("lift").isNull(), "no matched controls").when(F.col("lift") <= 0, "moves against the stated direction").when(F.col("lift") < criteria.min_absolute_lift, "below the economic floor")
    return x.select("anchor", "predecessor", "cond", "horizon", "direction", "complexity", "n_events", F.when(enough, F.coalesce("n_controls", F.lit(0))).otherwise(0).cast("long").alias("n_controls"), "lift", F.coalesce(reason, F.lit("")).alias("reason"))


def shortlist(screened: DataFrame, size: int = 50) -> DataFrame:
    """The candidates that passed, the largest lifts first, ties by key; ``size`` at the most."""
    return screened.where("reason = ''").withColumn("key", candidate_key()).orderBy(F.desc(F.abs("lift")), "key").limit(size)


def views(candidates: DataFrame) -> DataFrame:
    """The subsets that an assessment looks at: the whole candidate, its thirds, its volatility regimes, and it with one condition less."""
    need = F.when(F.col("cond") != "", F.str_to_map("cond", F.lit("&"), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))
    one = lambda name, third=None, regime=None, less=None: F.struct(name.alias("view"), F.lit(third).cast("int").alias("in_third"), F.lit(regime).cast("string").alias("in_regime"), (F.lit(None) if less is None else less).cast("string").alias("less"))
    fixed = [one(F.lit("all")), *[one(F.lit(f"third:{i}"), third=i) for i in range(3)], *[one(F.lit(f"regime:{r}"), regime=r) for r in inf.FAMILIES["atr_regime"]]]
    x = candidates.withColumn("need", need).withColumn("v", F.explode(F.concat(F.array(*fixed), F.transform(F.map_keys("need"), lambda k: one(F.concat(F.lit("drop:"), k), less=k)))))
    wanted = [F.when(F.col("v.less") == t, None).otherwise(F.try_element_at("need", F.lit(t))).alias(f"need_{t}") for t in TAGS]
    return x.select("key", F.col("anchor").alias("v_anchor"), F.coalesce("predecessor", F.lit("-")).alias("v_p"), F.col("horizon").alias("v_horizon"), "direction", "v.view", "v.in_third", "v.in_regime", *wanted)


def assess(cells: DataFrame, candidates: DataFrame, criteria: Criteria = Criteria(), census_size: int = 13_884) -> DataFrame:
    """Everything the criteria demand of each candidate (as shortlist gives them): a row with ``failures`` in the order of the rules.

    All figures are rolled up from the cells: each view of a candidate shrinks to sums for each session and stratum. The
    clustered interval is drawn only for candidates without a failure so far. Only the candidates' views are broadcast, a
    dozen rows for each of at most criteria.shortlist_size.
    """
    v = F.broadcast(views(candidates))
    holds = (F.col("p") == F.col("v_p")) & (F.col("horizon") == F.col("v_horizon")) & ((F.col("anchor") == "") | (F.col("anchor") == F.col("v_anchor")))
    for t in TAGS:
        holds &= F.col(f"need_{t}").isNull() | (F.col(f"need_{t}") == F.col(t))
    holds &= (F.col("in_third").isNull() | (F.col("in_third") == F.col("third"))) & (F.col("in_regime").isNull() | (F.col("in_regime") == F.col("atr_regime")))
    up, event = F.col("direction") == "up", F.col("anchor") != ""
    y, mfe, mae = F.when(up, F.col("up")).otherwise(-F.col("up")), F.when(up, F.col("max_up")).otherwise(-F.col("max_down")), F.when(up, -F.col("max_down")).otherwise(F.col("max_up"))
    sums = {"en": F.when(event, F.col("n")), "es": F.when(event, y), "cn": F.when(~event, F.col("n")), "cs": F.when(~event, y), "mfe": F.when(event, mfe), "mae": F.when(event, mae)}
    x = cut(cells.join(v, holds).groupBy("key", "view", "session_date", "stratum").agg(*[F.coalesce(F.sum(s), F.lit(0)).cast("double").alias(k) for k, s in sums.items()]))
    strata = x.groupBy("key", "view", "stratum").agg(*[F.sum(k).alias(k) for k in sums])
    figures = strata.groupBy("key", "view").agg(*[F.sum(k).alias(k) for k in sums], standardised("es", "en", "cs", "cn").alias("lift"))
    days = x.where("en > 0").groupBy("key", "view", "session_date").agg(F.sum("en").alias("d")).groupBy("key", "view").agg(F.count("*").alias("sessions"), (F.sum("d") * F.sum("d") / F.sum(F.col("d") * F.col("d"))).alias("clusters"))
    # a subset without events or without controls has no lift
    figures = figures.join(days, ["key", "view"], "left").withColumn("lift", F.when((F.col("en") > 0) & (F.col("cn") > 0), F.col("lift")))
    of = lambda view, c: F.max(F.when(F.col("view") == view, F.col(c)))
    every = figures.groupBy("key").agg(
        *[of("all", c).alias(c) for c in ("en", "cn", "es", "cs", "mfe", "mae", "lift", "sessions", "clusters")],
        *[F.array(*[of(f"third:{i}", c) for i in range(3)]).alias(f"thirds_{c}") for c in ("lift", "en", "clusters")],
        F.array(*[of(f"regime:{r}", "lift") for r in inf.FAMILIES["atr_regime"]]).alias("regimes"),
        F.collect_list(F.when(F.col("view").startswith("drop:"), F.struct(F.substring("view", 6, 100).alias("family"), "lift"))).alias("found"),
    )
    r = candidates.select("key", "cond", "complexity").join(every, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    r = r.select(
        "key", "complexity", zero("en").cast("long").alias("n_events"), zero("cn").cast("long").alias("n_controls"), zero("sessions").cast("long").alias("event_sessions"), F.col("clusters").alias("effective_clusters"), F.try_divide("es", "en").alias("event_mean"), F.try_divide("cs", "cn").alias("control_mean"),
        "lift", F.try_divide("mfe", "en").alias("mfe_mean"), F.try_divide("mae", "en").alias("mae_mean"), "thirds_lift", F.transform("thirds_en", lambda n: F.coalesce(n, F.lit(0.0))).alias("thirds_events"), F.transform("thirds_clusters", lambda n: F.coalesce(n, F.lit(0.0))).alias("thirds_clusters"), "regimes",
        # a dropped condition without any row is a subset without a lift
        F.transform(F.when(F.col("cond") != "", F.split("cond", "&")).otherwise(F.array().cast("array<string>")), lambda c: F.struct(F.split_part(c, F.lit("="), F.lit(1)).alias("family"), F.element_at(F.filter("found", lambda s: s["family"] == F.split_part(c, F.lit("="), F.lit(1))), 1)["lift"].alias("lift"))).alias("perturbed"),
    )
    c = criteria
    fails = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]))
    counts = fails([("min_events", F.col("n_events") < c.min_events), ("min_event_sessions", F.col("event_sessions") < c.min_event_sessions), ("min_effective_clusters", zero("effective_clusters") < c.min_effective_clusters)])
    seen = F.array_compact("regimes")
    worth = fails(
        [
            ("min_absolute_lift_points", F.col("lift") < c.min_absolute_lift),
            ("min_lift_to_mfe_ratio", (F.col("mfe_mean") != 0) & (F.try_divide(F.abs("lift"), F.abs("mfe_mean")) < c.min_lift_to_mfe_ratio)),
            ("sign_stable_thirds", F.exists("thirds_lift", lambda t: t.isNull() | (t <= 0))),
            ("min_events_per_third", F.exists("thirds_events", lambda n: n < c.min_events_per_third)),
            ("min_clusters_per_third", F.exists("thirds_clusters", lambda n: n < c.min_clusters_per_third)),
            ("sign_stable_regimes", (F.size(seen) == 0) | F.exists(seen, lambda t: t <= 0)),
        ]
    )
    weak = F.filter("perturbed", lambda s: s["lift"].isNull() | (s["lift"] <= 0) | (F.abs(s["lift"]) < c.min_perturbed_magnitude_ratio * F.abs("lift")))
    sensitive = F.transform(weak, lambda s: F.concat(F.lit("parameter_sensitivity:"), s["family"]))
    found = F.when((F.col("n_events") == 0) | (F.col("n_controls") == 0), F.array(F.lit("no events or no controls"))).when(F.col("lift").isNull(), F.concat(counts, F.array(F.lit("no lift")))).otherwise(F.concat(counts, worth, sensitive))
    r = cut(r.withColumn("failures", found))
    left = r.where("size(failures) = 0").select("key")
    boot = bootstrap_cells(x.where("view = 'all'").join(F.broadcast(left), "key", "left_semi").select("key", "session_date", "stratum", "es", "en", "cs", "cn"), ["key"], c.rounds, c.confidence)
    r = r.join(boot.select("key", "ci_low", "ci_high", "p"), "key", "left")
    late = F.when(F.size("failures") > 0, F.col("failures")).when(F.col("ci_low").isNull() | F.col("p").isNull(), F.array(F.lit("no clustered interval"))).when(F.col("ci_low") <= 0, F.array(F.lit(f"the {c.confidence:.0%} clustered interval includes zero"))).otherwise(F.col("failures"))
    r = r.withColumn("failures", late).withColumn("qualified", F.size("failures") == 0)
    score = F.when(F.col("qualified"), F.abs("lift") * F.pow(F.lit(c.complexity_penalty), F.col("complexity") - 1))
    return r.withColumns({"score": score, "family_wise_alpha": F.lit(c.family_wise_alpha / max(1, census_size)), "p_resolution_floor": F.lit(2.0 / (c.rounds + 1))})


def winner(assessed: DataFrame) -> DataFrame:
    """The single winner by formula: score, then effective clusters, then key; no row if none qualifies."""
    return assessed.where("qualified").orderBy(F.desc("score"), F.desc("effective_clusters"), "key").limit(1)
