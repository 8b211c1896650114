"""State features and events of bars, as windows over wide rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import with_session
from ..functions.lineage import cut
from ..sources.bars import INTERVAL, bars_from_events
from . import touch


@dataclass(frozen=True)
class Config:
    """Parameters of the features, in bars, minutes and ticks."""

    or_minutes: int = 60
    swing: int = 2
    displacement: float = 1.5
    atr: int = 14
    volatility: int = 30
    volume: int = 30
    gap_ticks: int = 4
    sweep_ticks: int = 1


def w_s():
    """Bars of a symbol in time order, never reset."""
    return Window.partitionBy("symbol").orderBy("ce")


def w_d():
    """Bars of one session of a symbol."""
    return Window.partitionBy("symbol", "session_date").orderBy("ce")


def sessions(bars: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per symbol and session: extremes of its phases, opening range, and the previous session's levels."""
    rth, rng = F.col("phase") == "rth", (F.col("phase") == "rth") & (F.col("os") < F.col("open_s") + config.or_minutes * 60)
    s = bars.groupBy("symbol", "session_date").agg(
        F.max(F.when(rth, F.col("h"))).alias("rth_high"),
        F.min(F.when(rth, F.col("l"))).alias("rth_low"),
        F.max(F.when(~rth, F.col("h"))).alias("on_high"),
        F.min(F.when(~rth, F.col("l"))).alias("on_low"),
        F.max(F.when(rng, F.col("h"))).alias("or_high"),
        F.min(F.when(rng, F.col("l"))).alias("or_low"),
        F.count_if(rng).alias("or_n"),
        # established by an in-range bar that closes at the end, or the first regular bar behind it
        F.min(F.when(rth & ((F.col("os") >= F.col("open_s") + config.or_minutes * 60) | (F.col("ce") >= F.col("open_s") + config.or_minutes * 60)), F.col("ce"))).alias("or_at"),
    )
    s = s.withColumn("or_at", F.when(F.col("or_n") > 0, F.col("or_at")))
    past = Window.partitionBy("symbol").orderBy("session_date")
    names = {"rth_high": "pdh", "rth_low": "pdl", "on_high": "onh", "on_low": "onl"}
    for have, name in names.items():  # plain lag: a session without regular bars passes null on
        s = s.withColumn(name, F.lag(have).over(past))
    return s.withColumn("prev_session", F.lag("session_date").over(past))


def features(spark: SparkSession, sf_dir: str, config: Config = Config()) -> DataFrame:
    """One row per bar with every state feature (null while not available) and what events need.

    Rolling windows run over the symbol and are never reset; VWAP and extremes run over the session. Session
    levels come from one small row per session, joined back. Partitioned by symbol throughout.
    """
    b = with_session(bars_from_events(spark, sf_dir))
    level = sessions(b, config)
    b = b.join(level.select(F.col("symbol").alias("x_symbol"), F.col("session_date").alias("x_date"), "pdh", "pdl", "onh", "onl", "or_high", "or_low", "or_at", "prev_session"), (F.col("symbol") == F.col("x_symbol")) & (F.col("session_date") == F.col("x_date"))).drop("x_symbol", "x_date")
    rth = F.col("phase") == "rth"
    run = w_d().rowsBetween(Window.unboundedPreceding, 0)
    last = lambda n: w_s().rowsBetween(1 - n, 0)
    prev = F.lag("c").over(w_s())
    b = b.withColumn("prev_c", prev).withColumn("n_bar", F.row_number().over(w_s()))
    b = b.withColumn("tr", F.when(F.col("prev_c").isNull(), F.col("h") - F.col("l")).otherwise(F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("prev_c")), F.abs(F.col("l") - F.col("prev_c")))))
    b = b.withColumn("ret", F.when(F.col("prev_c") != 0, (F.col("c") - F.col("prev_c")) / F.col("prev_c")))
    weight = F.sum(F.when(rth, F.col("v"))).over(run)
    value = F.sum(F.when(rth, (F.col("h") + F.col("l") + F.col("c")) * F.col("v"))).over(run)
    b = b.withColumn("vwap", F.when(weight > 0, value / (3 * weight)))
    b = b.withColumn("atr", F.when(F.count("tr").over(last(config.atr)) == config.atr, F.sum("tr").over(last(config.atr)) / config.atr))
    # over the last returns there are: a bar without one repeats what was known
    own = Window.partitionBy("symbol", F.col("ret").isNull()).orderBy("ce").rowsBetween(1 - config.volatility, 0)
    b = b.withColumn("spread", F.when(F.col("ret").isNotNull() & (F.count("ret").over(own) == config.volatility), F.stddev_pop("ret").over(own)))
    b = b.withColumn("realized_volatility", F.last("spread", True).over(w_s().rowsBetween(Window.unboundedPreceding, 0))).drop("spread")
    b = b.withColumn("volume_ratio", F.try_divide("v", F.avg("v").over(last(config.volume))))
    b = b.withColumn("session_high", F.max("h").over(run)).withColumn("session_low", F.min("l").over(run))
    b = b.withColumn("bar_range", F.col("h") - F.col("l"))
    b = b.withColumn("distance_to_vwap", F.col("c") - F.col("vwap")).withColumn("above_vwap", F.when(F.col("vwap").isNull(), None).when(F.col("c") > F.col("vwap"), "above").otherwise("below"))
    b = b.withColumn("minutes_since_rth_open", ((F.col("ce") - F.col("open_s")) / 60).cast("int"))
    shown = F.col("ce") >= F.col("or_at")
    b = b.withColumn("orh", F.when(shown, F.col("or_high"))).withColumn("orl", F.when(shown, F.col("or_low")))
    for name in ("pdh", "pdl", "onh", "onl", "orh", "orl"):
        b = b.withColumn(f"distance_to_{name}", F.col("c") - F.col(name))
    k = config.swing
    for name, col, best in (("swing_high", "h", F.max), ("swing_low", "l", F.min)):
        mid, before, after = F.lag(col, k).over(w_s()), best(col).over(w_s().rowsBetween(-2 * k, -k - 1)), best(col).over(w_s().rowsBetween(1 - k, 0))
        strict = (mid > before) & (mid > after) if name == "swing_high" else (mid < before) & (mid < after)
        b = b.withColumn(name, F.when((F.col("n_bar") > 2 * k) & strict, mid))
    return b


# -- events ------------------------------------------------------------------------------------------------


def _event(df: DataFrame, name: str, value: str, reference: str = "null") -> DataFrame:
    """Rows as events; value and reference are SQL expressions."""
    return df.select("symbol", "session_date", "ce", F.lit(name).alias("event"), F.expr(f"cast({value} as double)").alias("value"), F.expr(f"cast({reference} as string)").alias("reference"))


def session_events(f: DataFrame) -> DataFrame:
    turn = f.withColumn("was", F.lag("session_date").over(w_s())).where("was is null or was <> session_date")
    return _event(turn, "session_open", "null").unionByName(_event(turn.where("was is not null").withColumn("session_date", F.col("was")), "session_close", "null"))


def opening_range_events(f: DataFrame) -> DataFrame:
    out = _event(f.where("ce = or_at"), "opening_range_established", "or_high - or_low")
    for name, cond in (("or_high_broken", "c > or_high"), ("or_low_broken", "c < or_low")):
        hit = f.where(f"phase = 'rth' and ce >= or_at and {cond}").withColumn("n", F.row_number().over(w_d())).where("n = 1")
        out = out.unionByName(_event(hit, name, "c"))
    return out


def structure_events(f: DataFrame) -> DataFrame:
    """Close beyond the last confirmed swing, which the event consumes; checked before the bar's own confirmation."""
    out = None
    for name, swing, cond in (("structure_break_up", "swing_high", "c > level"), ("structure_break_down", "swing_low", "c < level")):
        before = w_s().rowsBetween(Window.unboundedPreceding, -1)
        x = f.withColumn("g", F.count(swing).over(before)).withColumn("level", F.last(swing, True).over(before)).where(f"level is not null and {cond}")
        x = x.withColumn("n", F.row_number().over(Window.partitionBy("symbol", "g").orderBy("ce"))).where("n = 1")
        out = _event(x, name, "level") if out is None else out.unionByName(_event(x, name, "level"))
    return out


def sweep_events(f: DataFrame, config: Config = Config()) -> DataFrame:
    out = []
    for name, refs, cond in (
        ("sweep_high", ("pdh", "onh"), "h >= {r} + " + str(config.sweep_ticks) + " and c < {r}"),
        ("sweep_low", ("pdl", "onl"), "l <= {r} - " + str(config.sweep_ticks) + " and c > {r}"),
    ):
        out += [_event(f.where(cond.format(r=r)), name, r, f"'{r}'") for r in refs]
    return reduce(DataFrame.unionByName, out)


def displacement_events(f: DataFrame, config: Config = Config()) -> DataFrame:
    hit = f.where(f"atr > 0 and tr >= {config.displacement} * atr")
    return _event(hit.where("c > o"), "displacement_up", "tr / atr").unionByName(_event(hit.where("c <= o"), "displacement_down", "tr / atr"))


def gaps(f: DataFrame, config: Config = Config()) -> DataFrame:
    """Fair-value gaps: symbol, ce, side, top, bottom, mid_os (open of the middle bar)."""
    x = f.withColumns({"h2": F.lag("h", 2).over(w_s()), "l2": F.lag("l", 2).over(w_s()), "mid_os": F.lag("os", 1).over(w_s())})
    up = x.where(f"l - h2 >= {config.gap_ticks}").select("symbol", "session_date", "ce", "mid_os", F.lit("up").alias("side"), F.col("l").alias("top"), F.col("h2").alias("bottom"))
    down = x.where(f"l2 - h >= {config.gap_ticks}").select("symbol", "session_date", "ce", "mid_os", F.lit("down").alias("side"), F.col("l2").alias("top"), F.col("h").alias("bottom"))
    return up.unionByName(down)


def gap_events(f: DataFrame, config: Config = Config(), fill_on_forming_bar: bool = True) -> DataFrame:
    """Formation, fill (on the forming bar by default, as the level's own bar touches it) and inversion.

    Inversion is the first later bar that closes beyond the far side, found in the tree of block extremes of closes.
    """
    g = gaps(f, config)
    out = g.select("symbol", "session_date", "ce", F.concat(F.lit("fvg_formed_"), "side").alias("event"), (F.col("top") - F.col("bottom")).cast("double").alias("value"), F.lit(None).cast("string").alias("reference"))
    bars = f.select("symbol", "session_date", "ce", "n_bar", "c")
    if fill_on_forming_bar:
        out = out.unionByName(g.select("symbol", "session_date", "ce", F.lit("fvg_filled").alias("event"), (F.col("top") - F.col("bottom")).cast("double").alias("value"), F.col("side").alias("reference")))
    own = cut(g.join(bars.select("symbol", "ce", "n_bar"), ["symbol", "ce"]).withColumns({"up": F.col("side") == "down", "at": F.when(F.col("side") == "up", F.col("bottom") - 1).otherwise(F.col("top") + 1)}))
    hit = touch.first_touch(own.withColumnRenamed("n_bar", "n"), touch.extremes(bars.withColumnRenamed("n_bar", "n"), "c", "c"))
    hit = hit.select(*[F.col(c).alias(f"t_{c}") for c in ("symbol", "n", "up", "at", "touch")])
    inv = own.join(hit, (F.col("symbol") == F.col("t_symbol")) & (F.col("n_bar") == F.col("t_n")) & (F.col("up") == F.col("t_up")) & (F.col("at") == F.col("t_at")))
    b = bars.select(F.col("symbol").alias("b_symbol"), F.col("n_bar").alias("b_n"), F.col("ce").alias("b_ce"), F.col("session_date").alias("b_date"))
    inv = inv.join(b, (F.col("symbol") == F.col("b_symbol")) & (F.col("t_touch") == F.col("b_n")))
    return out.unionByName(inv.select("symbol", F.col("b_date").alias("session_date"), F.col("b_ce").alias("ce"), F.lit("fvg_inverted").alias("event"), (F.col("top") - F.col("bottom")).cast("double").alias("value"), F.col("side").alias("reference")))


def swing_events(f: DataFrame) -> DataFrame:
    return _event(f.where("swing_high is not null"), "swing_high", "swing_high").unionByName(_event(f.where("swing_low is not null"), "swing_low", "swing_low"))


def all_events(f: DataFrame, config: Config = Config()) -> DataFrame:
    """Every event: symbol, session_date, ce (when it can be known), event, value, reference.

    The same rows as the union of the single families above, in one pass: windows mark what each bar brings
    about, and one explode gives the events; only gap inversions, which look at later bars, are added.
    """
    run = Window.unboundedPreceding
    x = f.withColumns({"was": F.lag("session_date").over(w_s()), "h2": F.lag("h", 2).over(w_s()), "l2": F.lag("l", 2).over(w_s())})
    after_or = (F.col("phase") == "rth") & (F.col("ce") >= F.col("or_at"))
    marks = {"or_high_broken": after_or & (F.col("c") > F.col("or_high")), "or_low_broken": after_or & (F.col("c") < F.col("or_low"))}
    x = x.withColumns({f"n_{k}": F.count_if(v).over(w_d().rowsBetween(run, 0)) for k, v in marks.items()})
    before = w_s().rowsBetween(run, -1)
    for name, swing in (("up", "swing_high"), ("down", "swing_low")):
        x = x.withColumns({f"g_{name}": F.count(swing).over(before), f"level_{name}": F.last(swing, True).over(before)})
    broke = {"up": F.col("c") > F.col("level_up"), "down": F.col("c") < F.col("level_down")}
    x = x.withColumns({f"n_{k}": F.count_if(v).over(Window.partitionBy("symbol", f"g_{k}").orderBy("ce").rowsBetween(run, 0)) for k, v in broke.items()})

    def one(cond, name: str, value: str = "null", reference: str = "null", day: str = "session_date"):
        cond = F.expr(cond) if isinstance(cond, str) else cond
        return F.when(cond, F.struct(F.col(day).alias("session_date"), F.lit(name).alias("event"), F.expr(f"cast({value} as double)").alias("value"), F.expr(f"cast({reference} as string)").alias("reference")))

    turn, moved = "was is null or was <> session_date", f"atr > 0 and tr >= {config.displacement}D * atr"
    up, down = f"l - h2 >= {config.gap_ticks}", f"l2 - h >= {config.gap_ticks}"
    made = [
        one(turn, "session_open"), one("was is not null and was <> session_date", "session_close", day="was"), one("ce = or_at", "opening_range_established", "or_high - or_low"),
        *[one(v & (F.col(f"n_{k}") == 1), k, "c") for k, v in marks.items()],
        *[one(f"h >= {r} + {config.sweep_ticks} and c < {r}", "sweep_high", r, f"'{r}'") for r in ("pdh", "onh")], *[one(f"l <= {r} - {config.sweep_ticks} and c > {r}", "sweep_low", r, f"'{r}'") for r in ("pdl", "onl")],
        one(f"{moved} and c > o", "displacement_up", "tr / atr"), one(f"{moved} and c <= o", "displacement_down", "tr / atr"),
        *[one(v & (F.col(f"n_{k}") == 1), f"structure_break_{k}", f"level_{k}") for k, v in broke.items()],
        one(up, "fvg_formed_up", "l - h2"), one(down, "fvg_formed_down", "l2 - h"), one(up, "fvg_filled", "l - h2", "'up'"), one(down, "fvg_filled", "l2 - h", "'down'"),
        one("swing_high is not null", "swing_high", "swing_high"), one("swing_low is not null", "swing_low", "swing_low"),
    ]
    direct = x.select("symbol", "ce", F.explode(F.array_compact(F.array(*made))).alias("e")).select("symbol", "e.session_date", "ce", "e.event", "e.value", "e.reference")
    return direct.unionByName(gap_events(f, config).where("event = 'fvg_inverted'"))


STATE = ["vwap", "distance_to_vwap", "atr", "realized_volatility", "volume_ratio", "session_high", "session_low", "bar_range", "minutes_since_rth_open", "pdh", "pdl", "onh", "onl", "orh", "orl", *(f"distance_to_{x}" for x in ("pdh", "pdl", "onh", "onl", "orh", "orl")), "swing_high", "swing_low"]


def records(f: DataFrame) -> DataFrame:
    """The long form: one row per bar and available feature (symbol, ce, feature, value, state)."""
    numbers = [F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("value"), F.lit(None).cast("string").alias("state")) for x in STATE]
    states = [F.struct(F.lit(x).alias("feature"), F.lit(None).cast("double").alias("value"), F.col(x).alias("state")) for x in ("phase", "above_vwap")]
    return f.select("symbol", "session_date", "ce", F.explode(F.array(*numbers, *states)).alias("r")).select("symbol", "session_date", "ce", "r.*").where("value is not null or state is not null")
