"""First touches by a tree of block extremes: which later bar first reaches a price, for any number of anchors and prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Children of a block.
FANOUT = 64


def extremes(bars: DataFrame, high: str = "h", low: str = "l", fanout: int = FANOUT) -> list[DataFrame]:
    """The tree over bars (symbol, n from 1): a level's rows are (b_symbol, parent, child, high, low), bars first.

    A level is one aggregate of the level below, a ``fanout``-th of its size; the last level has one block a symbol. Rows of one parent are
    at most ``fanout``, so joins on (symbol, parent) have no hot key, however long a symbol's history is.
    """
    levels = [cut(bars.select(F.col("symbol").alias("b_symbol"), F.expr(f"n div {fanout}").alias("parent"), F.col("n").alias("child"), F.col(high).alias("high"), F.col(low).alias("low")))]
    top = levels[0].agg(F.max("parent")).first()[0] or 0
    while top > 0:
        up = levels[-1].groupBy("b_symbol", F.col("parent").alias("block")).agg(F.max("high").alias("high"), F.min("low").alias("low"))
        levels.append(cut(up.select("b_symbol", F.expr(f"block div {fanout}").alias("parent"), F.col("block").alias("child"), "high", "low")))
        top //= fanout
    return levels


def _reaches() -> Column:
    return F.when(F.col("up"), F.col("high") >= F.col("at")).otherwise(F.col("low") <= F.col("at"))


def first_touch(wanted: DataFrame, levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """For each (symbol, n, up, at): ``touch``, the first bar behind n with high >= at (up) or low <= at; no row if there is none.

    The search climbs from the bar's own block until a later sibling reaches the price, and goes down into it: an
    anchor meets at most ``fanout`` rows in each of 2 * levels - 1 equi-joins. Equal wishes are asked once.
    """
    keys = ["symbol", "n", "up", "at"]
    todo = cut(wanted.select(*keys).where("at is not null").distinct()).withColumn("pos", F.col("n"))
    met = lambda rows, level, near: rows.join(level, (F.col("symbol") == F.col("b_symbol")) & near & _reaches()).groupBy(*keys).agg(F.min("child").alias("found"))
    found = []
    for level in levels:
        hit = cut(met(todo, level, (F.expr(f"pos div {fanout}") == F.col("parent")) & (F.col("child") > F.col("pos"))))
        found.append(hit)
        todo = todo.join(hit.select(*keys), keys, "left_anti").withColumn("pos", F.expr(f"pos div {fanout}"))
    here = found[-1]
    for level, own in zip(reversed(levels[:-1]), reversed(found[:-1]), strict=True):
        here = met(here, level, F.col("found") == F.col("parent")).unionByName(own)
    return here.withColumnRenamed("found", "touch")


def hit_first(anchors: DataFrame, bars: DataFrame, horizon: int, fanout: int = FANOUT) -> DataFrame:
    """Which of its two prices each anchor's path touches first within (ce, ce + horizon]: symbol, ce, favorable, adverse, direction, hit, hit_os.

    Anchors have symbol, ce, the distances favorable and adverse from the bar's close (both positive, each anchor its own) and
    the direction, up or down; bars have symbol, os, ce, n_bar, c, h, l. ``hit`` is favorable, adverse, same_bar (which came first
    within a bar is not known) or neither, also for anchors without a later bar; ``hit_os`` is the open of the bar. Null distances give
    neither on their side; distances that are not positive fail the job.
    """
    ok = "(favorable is null or favorable > 0) and (adverse is null or adverse > 0)"
    b = bars.select(F.col("symbol").alias("x_symbol"), F.col("ce").alias("x_ce"), F.col("os").alias("x_os"), F.col("n_bar").alias("n"), "c")
    a = anchors.select("symbol", "ce", "favorable", "adverse", "direction").distinct()
    a = a.join(b, (F.col("symbol") == F.col("x_symbol")) & (F.col("ce") == F.col("x_ce"))).drop("x_symbol", "x_ce", "x_os")
    up = F.col("direction") == "up"
    price = lambda side, is_up: F.col("c") + F.when(is_up, F.col(side)).otherwise(-F.col(side))
    a = a.withColumn("c", F.when(F.expr(ok), F.col("c")).otherwise(F.raise_error(F.lit("thresholds must be positive")).cast("long")))
    a = cut(a.withColumns({"fav_at": price("favorable", up).cast("double"), "adv_at": price("adverse", ~up).cast("double"), "fav_up": up}))
    sides = [a.select("symbol", "n", F.col("fav_up").alias("up"), F.col("fav_at").alias("at")), a.select("symbol", "n", (~F.col("fav_up")).alias("up"), F.col("adv_at").alias("at"))]
    tree = extremes(bars.select("symbol", F.col("n_bar").alias("n"), "h", "l"), fanout=fanout)
    touched = first_touch(reduce(DataFrame.unionByName, sides), tree, fanout)
    times = b.select("x_symbol", F.col("n").alias("x_n"), F.col("x_ce").alias("t_ce"), F.col("x_os").alias("t_os"))
    t = cut(touched.join(times, (F.col("symbol") == F.col("x_symbol")) & (F.col("touch") == F.col("x_n"))).drop("x_symbol", "x_n"))
    for side, at, way in (("fav", "fav_at", F.col("fav_up")), ("adv", "adv_at", ~F.col("fav_up"))):
        s = t.select(F.col("symbol").alias("s_symbol"), F.col("n").alias("s_n"), F.col("up").alias("s_up"), F.col("at").alias("s_at"), F.col("t_ce").alias(side), F.col("t_os").alias(f"{side}_os"))
        a = a.join(s, (F.col("symbol") == F.col("s_symbol")) & (F.col("n") == F.col("s_n")) & (way == F.col("s_up")) & (F.col(at) == F.col("s_at")) & (F.col(side) <= F.col("ce") + horizon), "left").drop("s_symbol", "s_n", "s_up", "s_at")
    hit = F.expr("case when fav is null and adv is null then 'neither' when adv is null or fav < adv then 'favorable' when fav is null or adv < fav then 'adverse' else 'same_bar' end")
    return a.select("symbol", "ce", "favorable", "adverse", "direction", hit.alias("hit"), F.least("fav_os", "adv_os").alias("hit_os"))
