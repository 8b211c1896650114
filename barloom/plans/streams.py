"""Registered queries over streams: each runs what the tables hold through a stream to its end, and reads back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import features as ft
from ..sources import bars as src
from ..streaming import bars as sb
from ..streaming import features as sf
from ..streaming import joins as sj
from . import oracles as O  # noqa: N812
from .registry import _USERS, query


def _folder(spark) -> str:
    """A folder of its own for each run, where all executors see it."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"


def _through(spark, folder: str, *slices):
    """Bars arrive in slices; the stream is stopped and started again between them."""
    for i, bars in enumerate(slices):
        bars.select(*sf.BAR).write.parquet(f"{folder}/bars/slice{i}")
        sf.run_to_end(sf.stream_records(sf.read_bars(spark, f"{folder}/bars/*")), f"{folder}/out", f"{folder}/mark")
    return spark.read.parquet(f"{folder}/out/records"), spark.read.parquet(f"{folder}/out/refused")


#: The tape's middle, where the registered streams are stopped and started again (fixed value).
MIDDLE = 1705276800


@query("stream_events", f"WITH {O.EVS} SELECT symbol, session_date, ce, event, round(value, 6) AS value, reference FROM evs")
def _(spark, sf_dir):
    """All events from keyed state over two runs of a stream of bars; the same as the batch operators give."""
    bars = src.bars_from_events(spark, sf_dir)
    records, _ = _through(spark, _folder(spark), bars.where(F.col("ce") <= MIDDLE), bars.where(F.col("ce") > MIDDLE))
    return records.where("kind = 'event'").select("symbol", "session_date", "ce", F.col("name").alias("event"), F.round("value", 6).alias("value"), "reference")


@query(
    "stream_state",
    f"WITH {O.FEATS} SELECT symbol, session_date, ce, round(vwap, 4) AS vwap, round(atr, 4) AS atr, round(realized_volatility, 6) AS realized_volatility, round(volume_ratio, 6) AS volume_ratio, CAST(session_high AS DOUBLE) AS session_high, CAST(pdl AS DOUBLE) AS pdl, CAST(orh AS DOUBLE) AS orh, CAST(swing_low AS DOUBLE) AS swing_low FROM feats",
)
def _(spark, sf_dir):
    """Wide rows of the streamed state features."""
    names = {"vwap": 4, "atr": 4, "realized_volatility": 6, "volume_ratio": 6, "session_high": 6, "pdl": 6, "orh": 6, "swing_low": 6}
    bars = src.bars_from_events(spark, sf_dir)
    records, _ = _through(spark, _folder(spark), bars.where(F.col("ce") <= MIDDLE), bars.where(F.col("ce") > MIDDLE))
    wide = records.where("kind = 'feature'").groupBy("symbol", "session_date", "ce").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    return wide.select("symbol", "session_date", "ce", *[F.round(n, d).alias(n) for n, d in names.items()])


@query(
    "stream_refused",
    f"WITH {O.SESS}, e AS (SELECT *, max(ce) OVER (PARTITION BY symbol) AS last_ce FROM sess WHERE ce <= {MIDDLE}) SELECT symbol, session_date, ce, CASE WHEN ce = last_ce THEN 'repeated' ELSE 'late' END AS why FROM e WHERE ce = last_ce OR v % 3 = 0 UNION ALL SELECT symbol, session_date, ce, 'repeated' FROM sess WHERE ce > {MIDDLE} AND v % 4 = 0",
)
def _(spark, sf_dir):
    """Bars sent again: the last one of each symbol's first slice, older ones, and some twice in one slice; all are refused, none is lost silently."""
    bars = src.bars_from_events(spark, sf_dir)
    early, later = bars.where(F.col("ce") <= MIDDLE), bars.where(F.col("ce") > MIDDLE)
    last = early.groupBy("symbol").agg(F.max("ce").alias("last_ce"))
    again = early.join(last, "symbol").where("ce = last_ce or v % 3 = 0").drop("last_ce")
    _, refused = _through(spark, _folder(spark), early, later.unionByName(later.where("v % 4 = 0")).unionByName(again))
    return refused.select("symbol", "session_date", "ce", F.col("name").alias("why"))


@query(
    "stream_as_of",
    f"WITH {_USERS}, m AS (SELECT (max(t) // 1000 - 600000) * 1000 AS passed FROM tape WHERE symbol IN ('purchase', 'view')) SELECT event_id, px AS last_px FROM (SELECT * FROM buys, m WHERE t <= passed) b ASOF LEFT JOIN views v ON b.user_id = v.user_id AND b.t >= v.vt",
)
def _(spark, sf_dir):
    """The as-of state of j_condition_state from two streams, up to the watermark."""
    e = sb.read_events(spark, sf_dir).select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ce"), F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("long").alias("px"))
    left, right = e.where("kind = 'purchase'"), e.where("kind = 'view'").select("symbol", "ce", (-F.col("px")).alias("seq"), F.col("px").cast("string").alias("last_px"))
    folder = _folder(spark)
    sb.run_to_end(sj.as_of(left, right, "last_px", ticks=1_000_000), f"{folder}/out", f"{folder}/mark")
    return spark.read.schema("symbol string, ce long, id long, last_px string").parquet(f"{folder}/out").select(F.col("id").alias("event_id"), F.col("last_px").cast("long").alias("last_px"))


@query("stream_forward", f"WITH {O.FEATS},\n{O.GAPS},\na AS ({O.EVENTS['displacement_up']}) SELECT a.symbol, a.ce, b.ce AS b_ce, b.c AS b_c FROM a JOIN bars b ON a.symbol = b.symbol AND b.ce > a.ce AND b.ce <= a.ce + 14400")
def _(spark, sf_dir):
    """The forward window of each upward displacement, joined stream to stream within time bounds."""
    folder = _folder(spark)
    f = ft.features(spark, sf_dir)
    ft.displacement_events(f).where("event = 'displacement_up'").select("symbol", "ce").write.parquet(f"{folder}/anchors")
    f.select(*sf.BAR).write.parquet(f"{folder}/bars")
    anchors = spark.readStream.schema("symbol string, ce long").parquet(f"{folder}/anchors")
    sb.run_to_end(sj.forward_window(anchors, sf.read_bars(spark, f"{folder}/bars"), 14400), f"{folder}/out", f"{folder}/mark")
    return spark.read.schema("symbol string, ce long, b_ce long, b_c long").parquet(f"{folder}/out")
