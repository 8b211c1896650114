"""Session quality, contract continuity and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def implausible(tolerance: float = 0.05) -> Column:
    """Whether a bar's high or low stands out from both neighbours in its session, strictly by more than ``tolerance``; first and last bars do not."""
    w = Window.partitionBy("symbol", "session_date").orderBy("ce")
    before, after = F.lag("c").over(w), F.lead("o").over(w)
    high, low = F.greatest(before, after), F.least(before, after)
    up, down = F.try_divide(F.col("h") - high, high), F.try_divide(low - F.col("l"), high)
    return before.isNotNull() & after.isNotNull() & (high > 0) & ((up > tolerance) | ((low > 0) & (down > tolerance)))


def quality(f: DataFrame, slot_s: int = 1800, min_coverage: float = 0.95, max_gap: int = 0, min_bars: int = 30, tolerance: float = 0.05) -> DataFrame:
    """One row per symbol and session: counts, coverage, gaps, exclusions (sorted by rule order) and observations.

    ``slot_s`` is the bar interval; gaps and coverage count slots of the regular session. Everything is one
    aggregate over bars plus one over a session's slots, with lags inside the session.
    """
    rth = F.col("phase") == "rth"
    w = Window.partitionBy("symbol", "session_date").orderBy("ce")
    f = f.withColumn("slot", F.when(rth, F.expr(f"(os - open_s) div {slot_s}"))).withColumn("n_slots", F.expr(f"(close_s - open_s) div {slot_s}"))
    prev_slot = F.last("slot", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("gap", F.when(F.col("slot").isNotNull(), F.col("slot") - F.coalesce(prev_slot, F.lit(-1)) - 1))
    f = f.withColumn("bad", implausible(tolerance))
    g = f.groupBy("symbol", "session_date").agg(
        F.count("*").alias("n_bars"), F.sum("v").alias("volume"), F.count_if(rth).alias("n_rth"), F.count_if(~rth).alias("n_overnight"), F.max("n_slots").alias("n_slots"), F.countDistinct("slot").alias("seen"),
        F.max("gap").alias("gap"), F.max("slot").alias("last_slot"), F.count_if("bad").alias("n_bad"), F.max("bar_range").alias("max_range"), F.sort_array(F.collect_list("bar_range")).alias("ranges"), F.first("early").alias("early"),
    )
    g = g.withColumn("coverage", F.col("seen") / F.col("n_slots")).withColumn("longest_gap", F.greatest(F.coalesce("gap", F.lit(0)), F.col("n_slots") - 1 - F.coalesce("last_slot", F.lit(-1))))
    g = g.withColumn("mid_range", F.element_at("ranges", F.expr("int(size(ranges) div 2 + 1)")))
    g = g.withColumn("range_ratio", F.when(F.col("mid_range") > 0, F.col("max_range") / F.col("mid_range")))
    ex = F.array_compact(F.array(F.when((F.col("coverage") < min_coverage) | (F.col("n_rth") < min_bars), "rth_coverage"), F.when(F.col("longest_gap") > max_gap, "rth_contiguous_gap"), F.when(F.col("n_bad") > 0, "implausible_print")))
    ob = F.array_compact(F.array(F.when(F.col("early"), "early_close"), F.when(F.col("n_overnight") == 0, "no_overnight_bars").when(F.col("n_overnight") < F.col("n_slots"), "sparse_overnight")))
    return g.select("symbol", "session_date", "n_bars", "volume", "n_rth", "n_overnight", "coverage", "longest_gap", "n_bad", "range_ratio", F.array_join(ex, ",").alias("exclusions"), F.array_join(ob, ",").alias("observations"), (F.size(ex) == 0).alias("passed"))


def contracts(bars: DataFrame) -> DataFrame:
    """Contracts seen in each session, and bars without one."""
    return bars.groupBy("symbol", "session_date").agg(F.array_join(F.array_sort(F.collect_set("contract_id")), ",").alias("contract_ids"), F.countDistinct("contract_id").alias("n_contracts"), F.count("*").alias("n_bars"), F.count_if(F.col("contract_id").isNull()).alias("n_missing"))


def continuity(c: DataFrame, passed: DataFrame) -> DataFrame:
    """The verdict for using the prior session's levels: checks run in this order, the first that fails names it.

    The prior session is the last one before that passed the quality rules (rows of ``passed``). The window holds
    one row for each session of a symbol.
    """
    before = Window.partitionBy("symbol").orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    x = c.join(passed.select("symbol", "session_date").distinct().withColumn("ok", F.lit(True)), ["symbol", "session_date"], "left")
    x = x.withColumn("p", F.last(F.when(F.col("ok"), F.struct("session_date", "contract_ids", "n_contracts", "n_missing")), True).over(before))
    known = lambda m, n: f"({m} = 0 and {n} > 0)"
    verdict = F.expr(
        f"""case when not {known('n_missing', 'n_contracts')} then 'unknown_provenance' when n_contracts > 1 then 'mixed_session' when p is null then 'no_prior_session'
        when not {known('p.n_missing', 'p.n_contracts')} then 'unknown_provenance' when p.n_contracts > 1 then 'mixed_session' when p.contract_ids <> contract_ids then 'contract_boundary' else 'same_contract' end"""
    )
    return x.select("symbol", "session_date", F.col("p.session_date").alias("prior_session"), "contract_ids", verdict.alias("verdict"))


def fixed_count_gate(bars: DataFrame, expected: int = 1380, min_bars: int = 300, max_missing: float = 0.1, min_volume: int = 1000, max_zero: float = 0.3, max_move: float = 10.0) -> DataFrame:
    """The older gate, which holds each session against a fixed number of bars: (symbol, session_date, reasons in rule order).

    ``bars`` has arrival, at, h, l and v; duplicate and disordered times show in the order of arrival. Windows
    and lists are bounded by the bars of a session.
    """
    was = F.lag("at").over(Window.partitionBy("symbol", "session_date").orderBy("arrival"))
    g = bars.withColumn("back", F.col("at") < was).groupBy("symbol", "session_date").agg(
        F.count("*").alias("n"), F.sum("v").alias("volume"), F.count_if(F.col("v") == 0).alias("zero"), F.sort_array(F.collect_list(F.col("h") - F.col("l"))).alias("ranges"), F.countDistinct("at").alias("times"), F.count_if("back").alias("back")
    )
    g = g.withColumn("mid", F.element_at("ranges", F.expr("int(size(ranges) div 2 + 1)")))
    rules = {
        "min_bars": F.col("n") < min_bars,
        "max_missing_fraction": F.greatest(F.lit(0), expected - F.col("n")) / expected > max_missing,
        "min_total_volume": F.col("volume") < min_volume,
        "max_zero_volume_fraction": F.col("zero") / F.col("n") > max_zero,
        "max_single_bar_move_atr": (F.col("mid") > 0) & (F.try_divide(F.array_max("ranges"), "mid") > max_move),
        "duplicate_timestamps": F.col("times") < F.col("n"),
        "out_of_order": F.col("back") > 0,
    }
    return g.select("symbol", "session_date", F.array_join(F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()])), ",").alias("reasons"))
