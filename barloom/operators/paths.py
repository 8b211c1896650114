"""Forward paths of bars, and as-of, interval and recency joins between bars and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import w_s

HORIZONS = (3600, 7200, 14400)


def with_paths(f: DataFrame, horizon: int) -> DataFrame:
    """Adds the path of each bar over (close, close + horizon seconds]; a path depends on the bar alone.

    terminal, max_up and max_down are relative to the bar's close (clamped at 0); *_at is the open of the first bar
    that reaches the extreme, null if the excursion is 0; n bars; truncated if the path ends early.
    """
    frame = w_s().rangeBetween(1, horizon)
    up, down = F.greatest(F.max("h").over(frame) - F.col("c"), F.lit(0)), F.least(F.min("l").over(frame) - F.col("c"), F.lit(0))
    return f.select(
        "*",
        F.coalesce(F.last("c").over(frame) - F.col("c"), F.lit(0)).alias("terminal"),
        F.coalesce(up, F.lit(0)).alias("max_up"),
        F.coalesce(down, F.lit(0)).alias("max_down"),
        F.when(up > 0, F.max_by("os", F.struct("h", -F.col("ce"))).over(frame)).alias("max_up_at"),
        F.when(down < 0, F.min_by("os", F.struct("l", "ce")).over(frame)).alias("max_down_at"),
        F.count("c").over(frame).alias("n_path"),
        (F.coalesce(F.max("ce").over(frame), F.lit(0)) < F.col("ce") + horizon).alias("truncated"),
    )


def oriented(p: DataFrame, direction: str = "direction") -> DataFrame:
    """signed, mfe, mae and favorable_first for up or down; which came first is null if both extremes fall in one bar, or a side never moved."""
    up = F.col(direction) == "up"
    fav, adv = F.when(up, F.col("max_up_at")).otherwise(F.col("max_down_at")), F.when(up, F.col("max_down_at")).otherwise(F.col("max_up_at"))
    first = F.when(fav != adv, fav < adv)
    return p.withColumns(
        {
            "signed": F.when(up, F.col("terminal")).otherwise(-F.col("terminal")),
            "mfe": F.when(up, F.col("max_up")).otherwise(-F.col("max_down")),
            "mae": F.when(up, F.col("max_down")).otherwise(-F.col("max_up")),
            "favorable_first": first,
        }
    )


def interval_join(anchors: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Anchors (symbol, ce, ...) with every bar that closes in (ce, ce + horizon], by equality on the symbol and a time cell.

    An anchor looks into the two cells that its window can touch, so no join compares all bars.
    """
    cell = lambda c: F.expr(f"{c} div {horizon}")
    a = anchors.withColumn("cell", F.explode(F.array(cell("ce"), cell("ce") + 1)))
    b = bars.select(F.col("symbol").alias("b_symbol"), F.col("ce").alias("b_ce"), F.col("h").alias("b_h"), F.col("l").alias("b_l"), F.col("c").alias("b_c"), cell("ce").alias("b_cell"))
    return a.join(b, (F.col("symbol") == F.col("b_symbol")) & (F.col("cell") == F.col("b_cell")) & (F.col("b_ce") > F.col("ce")) & (F.col("b_ce") <= F.col("ce") + horizon)).drop("b_symbol", "b_cell", "cell")


def carried(rows: DataFrame, value: str, order: list[str], cells: int = 4096) -> DataFrame:
    """Rows (symbol, at, ...) with ``value`` replaced by the last one that is not null, up to and including the row, by ``order`` (at first).

    A scan in two levels: time is cut into at most ``cells`` cells, the last value of each (symbol, cell) is carried over the
    cells, and inside a cell rows see their own cell only. So a symbol's history spreads over as many tasks as cells, and what meets
    in one window is one cell's rows, or one row for each of a symbol's cells.
    """
    ends = rows.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    if ends["lo"] is None:
        return rows
    width = (ends["hi"] - ends["lo"]) // cells + 1
    r = rows.withColumn("cell", F.expr(f"(at - {ends['lo']}L) div {width}L"))
    last = r.groupBy("symbol", "cell").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("end"))
    before = Window.partitionBy("symbol").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(F.col("symbol").alias("k_symbol"), F.col("cell").alias("k_cell"), F.last("end", True).over(before).alias("carry"))
    inside = Window.partitionBy("symbol", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = r.join(carry, (F.col("symbol") == F.col("k_symbol")) & (F.col("cell") == F.col("k_cell")))
    return x.withColumn(value, F.coalesce(F.last(value, True).over(inside), "carry")).drop("cell", "carry", "k_symbol", "k_cell")


def as_of(left: DataFrame, right: DataFrame, value: str, cells: int = 4096) -> DataFrame:
    """Backward as-of join on (symbol, ce), inclusive and unbounded: the latest value known at each left row.

    Left and right are sorted together, in cells of time, and the value carried on. Of right rows at one time the first
    by seq wins; right has symbol, ce, seq and ``value``.
    """
    r = right.groupBy("symbol", "ce").agg(F.min_by(value, "seq").alias("v")).select("symbol", F.col("ce").alias("at"), F.lit(0).alias("side"), "v")
    both = left.select("symbol", F.col("ce").alias("at"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row")).unionByName(r, allowMissingColumns=True)
    return carried(both, "v", ["at", "side"], cells).where("side = 1").select("row.*", F.col("v").alias(value))


def reference_bar(moments: DataFrame, bars: DataFrame, cells: int = 4096) -> DataFrame:
    """Forward as-of: for each (symbol, id, t in seconds) the first bar that closes at t or later; time runs backwards in the scan."""
    b = bars.select("symbol", (-F.col("ce")).alias("at"), F.lit(0).alias("side"), F.struct(F.col("ce").alias("b_ce"), F.col("c").alias("b_c")).alias("ref"))
    m = moments.select("symbol", "id", (-F.col("t")).alias("at"), F.lit(1).alias("side"))
    got = carried(m.unionByName(b, allowMissingColumns=True), "ref", ["at", "side"], cells)
    return got.where("side = 1").select("symbol", "id", (-F.col("at")).alias("t"), F.col("ref.b_ce").alias("ref_ce"), F.col("ref.b_c").alias("ref_c"))


def recent_events(events: DataFrame, seconds: int) -> DataFrame:
    """For each event, the sorted types of events of its symbol in the ``seconds`` up to and including its time."""
    w = Window.partitionBy("symbol").orderBy("ce").rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.array_join(F.array_sort(F.collect_set("event").over(w)), ","))
