"""State features and events of a stream of bars, with refused bars as an output of their own."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.calendar import with_session
from ..operators.features import Config

BAR = ["symbol", "os", "ce", "o", "h", "l", "c", "v"]
OUT = "symbol string, session_date string, ce long, kind string, name string, value double, reference string"


@dataclass
class Memory:
    """What one symbol carries from bar to bar; it travels as JSON in the stream's state store."""

    last_os: int | None = None
    n: int = 0
    session: str | None = None
    bars: list = field(default_factory=list)  # (os, h, l) of the last 2 * swing bars
    close: int | None = None
    ranges: list = field(default_factory=list)
    returns: list = field(default_factory=list)
    volumes: list = field(default_factory=list)
    own: dict = field(default_factory=dict)  # this session: high, low, extremes of its phases, opening range, sums of the VWAP
    prior: dict = field(default_factory=dict)  # levels of the session before
    pivots: dict = field(default_factory=dict)  # last confirmed swing of each side that no break has consumed
    gaps: list = field(default_factory=list)  # (side, top, bottom) of gaps that are not inverted


def _wider(own: dict, name: str, high: int, low: int) -> None:
    own[f"{name}_high"], own[f"{name}_low"] = max(own.get(f"{name}_high", high), high), min(own.get(f"{name}_low", low), low)


def observe(m: Memory, b, config: Config) -> Iterator[tuple]:
    """(session, kind, name, value, reference) of one bar that is newer than all before it; changes the memory."""
    k, rth = config.swing, b.phase == "rth"
    day = b.session_date
    event = lambda name, value=None, reference=None, at=day: (at, "event", name, None if value is None else float(value), reference)
    if m.session != day:
        yield event("session_open")
        if m.session is not None:
            yield event("session_close", at=m.session)
        names = {"pdh": "rth_high", "pdl": "rth_low", "onh": "out_high", "onl": "out_low"}
        m.prior = {name: m.own.get(have) for name, have in names.items()}
        m.session, m.own = day, {}
    own = m.own
    _wider(own, "day", b.h, b.l)
    _wider(own, "rth" if rth else "out", b.h, b.l)
    if rth:
        own["weight"], own["sum"] = own.get("weight", 0) + b.v, own.get("sum", 0) + (b.h + b.l + b.c) * b.v
        end = b.open_s + config.or_minutes * 60
        if b.os < end:
            _wider(own, "or", b.h, b.l)
        if "or_high" in own and b.ce >= end and not own.get("or_done"):
            own["or_done"] = True
            yield event("opening_range_established", own["or_high"] - own["or_low"])
    span = b.h - b.l if m.close is None else max(b.h - b.l, abs(b.h - m.close), abs(b.l - m.close))
    m.ranges = [*m.ranges, span][-config.atr :]
    m.volumes = [*m.volumes, b.v][-config.volume :]
    if m.close:
        m.returns = [*m.returns, (b.c - m.close) / m.close][-config.volatility :]
    m.n += 1
    seen = [*m.bars, (b.os, b.h, b.l)]

    # -- state at the close
    atr = sum(m.ranges) / config.atr if len(m.ranges) == config.atr else None
    vwap = own["sum"] / (3 * own["weight"]) if own.get("weight", 0) > 0 else None
    mean = sum(m.volumes) / len(m.volumes)
    state = {"vwap": vwap, "distance_to_vwap": None if vwap is None else b.c - vwap, "atr": atr, "volume_ratio": b.v / mean if mean else None, "session_high": own["day_high"], "session_low": own["day_low"], "bar_range": b.h - b.l, "minutes_since_rth_open": int((b.ce - b.open_s) / 60)}
    if len(m.returns) == config.volatility:
        centre = sum(m.returns) / config.volatility
        state["realized_volatility"] = (sum((r - centre) ** 2 for r in m.returns) / config.volatility) ** 0.5
    levels = m.prior | ({"orh": own["or_high"], "orl": own["or_low"]} if own.get("or_done") else {})
    state |= levels | {f"distance_to_{name}": None if at is None else b.c - at for name, at in levels.items()}
    swings = {}
    if m.n > 2 * k:
        for side, at, best in (("high", 1, max), ("low", 2, min)):
            x = [s[at] for s in seen[-2 * k - 1 :]]
            others = best([*x[:k], *x[k + 1 :]])
            if x[k] != others and best(x[k], others) == x[k]:
                swings[side] = state[f"swing_{side}"] = x[k]
    for name, value in state.items():
        if value is not None:
            yield day, "feature", name, float(value), None
    yield day, "feature", "phase", None, b.phase
    if vwap is not None:
        yield day, "feature", "above_vwap", None, "above" if b.c > vwap else "below"

    # -- events
    for name in ("pdh", "onh"):
        if (at := m.prior.get(name)) is not None and b.h >= at + config.sweep_ticks and b.c < at:
            yield event("sweep_high", at, name)
    for name in ("pdl", "onl"):
        if (at := m.prior.get(name)) is not None and b.l <= at - config.sweep_ticks and b.c > at:
            yield event("sweep_low", at, name)
    if atr and span >= config.displacement * atr:
        yield event("displacement_up" if b.c > b.o else "displacement_down", span / atr)
    for name, side, beyond in (("up", "high", lambda p: b.c > p), ("down", "low", lambda p: b.c < p)):
        if (at := m.pivots.get(side)) is not None and beyond(at):
            yield event(f"structure_break_{name}", at)
            m.pivots[side] = None
    still = []
    for side, top, bottom in m.gaps:
        if b.c < bottom if side == "up" else b.c > top:
            yield event("fvg_inverted", top - bottom, side)
        else:
            still.append((side, top, bottom))
    m.gaps = still
    if len(seen) >= 3:
        _, high, low = seen[-3]
        for side, top, bottom in (("up", b.l, high), ("down", low, b.h)):
            if top - bottom >= config.gap_ticks:
                yield event(f"fvg_formed_{side}", top - bottom)
                yield event("fvg_filled", top - bottom, side)
                m.gaps.append((side, top, bottom))
    if rth and own.get("or_done"):
        for name, hit in (("or_high_broken", b.c > own["or_high"]), ("or_low_broken", b.c < own["or_low"])):
            if hit and not own.get(name):
                own[name] = True
                yield event(name, b.c)
    for side, at in swings.items():
        yield event(f"swing_{side}", at)
        m.pivots[side] = at
    m.close, m.bars, m.last_os = b.c, seen[-2 * k :], b.os


def stream_records(bars: DataFrame, config: Config = Config()) -> DataFrame:
    """Features, events and refused bars of a stream of bars (symbol, os, ce, o, h, l, c, v), as rows of one schema.

    The state of a symbol is its rolling windows, session extremes, last swings and open gaps. A trigger's bars of a symbol are taken in
    time order. A bar that is not newer than the last one seen is refused, not absorbed: kind ``refused``, name
    ``repeated`` (the same time) or ``late``, its prices in ``reference``. Of several bars of one time in a trigger
    the smallest by its prices is taken. Bars with a null in them are refused as ``incomplete``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Memory(**json.loads(state.get[0])) if state.exists else Memory()
        rows = []
        for frame in frames:
            rows += frame.astype(object).where(frame.notna(), None).itertuples(index=False)
        whole = [b for b in rows if not any(getattr(b, x) is None for x in BAR)]
        bad = [(b, "incomplete") for b in rows if any(getattr(b, x) is None for x in BAR)]
        out = []
        for b in sorted(whole, key=lambda b: (b.os, b.ce, b.o, b.h, b.l, b.c, b.v)):
            if m.last_os is not None and b.os <= m.last_os:
                bad.append((b, "repeated" if b.os == m.last_os else "late"))
                continue
            out += [(key[0], day, b.ce, *rest) for day, *rest in observe(m, b, config)]
        out += [(key[0], b.session_date, b.ce, "refused", why, None, ",".join(str(getattr(b, x)) for x in BAR[1:])) for b, why in bad]
        state.update((json.dumps(asdict(m), default=int),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    placed = with_session(bars.select(*BAR)).select(*BAR, "session_date", "phase", "open_s")
    return placed.groupBy("symbol").applyInPandasWithState(step, OUT, "memory string", "append", GroupStateTimeout.NoTimeout)


def run_to_end(records: DataFrame, out: str, checkpoint: str) -> None:
    """Runs what is there now: features and events to ``out``/records, refused bars to ``out``/refused.

    Each batch replaces its own folder, so a batch that is run again after a restart leaves the same rows once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, keep in (("records", "kind <> 'refused'"), ("refused", "kind = 'refused'")):
            batch.where(keep).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    q = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def read_bars(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """The bar files of a folder as a stream; each file is read once."""
    reader = spark.readStream.schema("symbol string, os long, ce long, o long, h long, l long, c long, v long")
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(folder)
