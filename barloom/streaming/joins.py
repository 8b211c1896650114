"""Joins of two streams over time: the forward window of anchors, and the as-of state at each moment."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def forward_window(anchors: DataFrame, bars: DataFrame, horizon: int, late: str = "10 minutes") -> DataFrame:
    """Anchors (symbol, ce) with every bar (symbol, ce, c) that closes in (ce, ce + horizon]: symbol, ce, b_ce, b_c.

    Both sides have a watermark and the join is bounded on both sides in time, so Spark drops what can no longer meet.
    """
    a = anchors.withColumn("a_at", F.timestamp_seconds("ce")).withWatermark("a_at", late)
    b = bars.select(F.col("symbol").alias("b_symbol"), F.col("ce").alias("b_ce"), F.col("c").alias("b_c"), F.timestamp_seconds("ce").alias("b_at")).withWatermark("b_at", late)
    near = (F.col("b_at") > F.col("a_at")) & (F.col("b_at") <= F.col("a_at") + F.expr(f"interval {horizon} seconds"))
    return a.join(b, (F.col("symbol") == F.col("b_symbol")) & near).drop("a_at", "b_at", "b_symbol")


def as_of(left: DataFrame, right: DataFrame, value: str, late: str = "10 minutes", ticks: int = 1, buckets: int = 1024) -> DataFrame:
    """Backward as-of join of two streams on (symbol, ce): symbol, ce, id and the latest ``value`` (text) known at each left row.

    Left has symbol, ce and id, right symbol, ce, seq and the value; ``ticks`` of ce are a second (a power of ten up to a million).

    As the batch join: inclusive, unbounded in age, and of right rows at one time the first by seq wins. A left row
    goes out once the watermark has passed its time, so right rows may come ``late``; what comes later still is dropped by the
    watermark. Symbols share ``buckets`` states by hash, so that Python is entered once a bucket and trigger, not once a
    symbol; a state is the last value of each of its symbols and the rows that the watermark has not passed. The number is part
    of a checkpoint. A null symbol meets nothing, a row without a time goes, a right row without a seq comes last of its time.
    """
    none = F.lit(-(1 << 63)).cast("long")
    one = left.select("symbol", "ce", F.lit(1).alias("side"), F.coalesce(F.col("id").cast("long"), none).alias("seq"), F.lit(None).cast("string").alias("value"))
    two = right.select("symbol", "ce", F.lit(0).alias("side"), F.coalesce(F.col("seq").cast("long"), F.lit((1 << 63) - 1)).alias("seq"), F.col(value).cast("string").alias("value"))
    both = one.unionByName(two).where("ce is not null").withColumn("at", F.timestamp_micros(F.col("ce") * (1_000_000 // ticks))).withWatermark("at", late).withColumn("bucket", F.expr(f"pmod(xxhash64(symbol), {buckets})"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, waiting = json.loads(state.get[0]) if state.exists else ({}, [[], [], [], [], []])
        new = [] if state.hasTimedOut else list(frames)
        symbol, v = (np.concatenate([np.array(waiting[i], object), *[f[c].astype(object).where(f[c].notna(), None) for f in new]]) for i, c in ((0, "symbol"), (4, "value")))
        ce, side, seq = (np.concatenate([np.array(waiting[i], np.int64), *[f[c].to_numpy(np.int64) for f in new]]) for i, c in ((1, "ce"), (2, "side"), (3, "seq")))
        passed = ce <= state.getCurrentWatermarkMs() * ticks // 1000
        waiting = [x[~passed].tolist() for x in (symbol, ce, side, seq, v)]
        if passed.any():
            code, names = pd.factorize(symbol[passed])
            order = np.lexsort((seq[passed], side[passed], ce[passed], code))
            code, (symbol, ce, side, seq, v) = code[order], (x[passed][order] for x in (symbol, ce, side, seq, v))
            row, first = np.arange(len(code)), np.r_[True, code[1:] != code[:-1]]
            again = np.r_[False, ce[1:] == ce[:-1]] & ~first
            seen = np.maximum.accumulate(np.where((side == 0) & ~again & (code >= 0), row, -1))
            fresh = seen >= np.maximum.accumulate(np.where(first, row, 0))
            last = np.where(fresh, v[seen], np.array([*map(known.get, names), None], object)[code])
            end, out = np.r_[first[1:], True] & fresh, side == 1
            known.update(zip(symbol[end], last[end], strict=True))
            if out.any():
                yield pd.DataFrame({"symbol": symbol[out], "ce": ce[out], "id": seq[out], value: last[out]})
        state.update((json.dumps([known, waiting]),))
        if waiting[1]:
            state.setTimeoutTimestamp(-(-min(waiting[1]) * 1000 // ticks))

    joined = both.groupBy("bucket").applyInPandasWithState(step, f"symbol string, ce long, id long, {value} string", "memory string", "append", GroupStateTimeout.EventTimeTimeout)
    return joined.withColumn("id", F.nullif("id", none))
