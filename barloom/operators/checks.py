"""Row checks, arrival order, date-effective lookup and record digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bar_fault() -> Column:
    """The first rule that a bar (o, h, l, c, v) breaks; empty if it breaks none."""
    return F.expr(
        """case when o is null or h is null or l is null or c is null then 'missing' when h < l then 'high_below_low' when o < l or o > h then 'open_outside'
        when c < l or c > h then 'close_outside' when v < 0 then 'negative_volume' else '' end"""
    )


def order_faults(rows: DataFrame, key: str, arrival: str, at: str, block: int = 1_000_000) -> DataFrame:
    """For each key, rows that go back in time in their order of arrival, and rows that repeat the time before.

    Arrival is cut into blocks of ``block``, so a hot key's rows do not meet in one task; only the ends of
    blocks are compared afterwards. Rows without a time are left out.
    """
    x = rows.where(F.col(at).isNotNull()).withColumn("block", F.floor(F.col(arrival) / block))
    x = x.withColumn("was", F.lag(at).over(Window.partitionBy(key, "block").orderBy(arrival)))
    per = x.groupBy(key, "block").agg(F.count_if(F.col(at) < F.col("was")).alias("back"), F.count_if(F.col(at) == F.col("was")).alias("same"), F.min_by(at, arrival).alias("first"), F.max_by(at, arrival).alias("last"))
    per = per.withColumn("was", F.lag("last").over(Window.partitionBy(key).orderBy("block")))
    one = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    return per.groupBy(key).agg(F.sum(F.col("back") + one(F.col("first") < F.col("was"))).alias("backwards"), F.sum(F.col("same") + one(F.col("first") == F.col("was"))).alias("repeated"))


def overlaps(ranges: DataFrame, key: str, start: str, end: str, name: str) -> DataFrame:
    """Ranges of each key that end before they start, and that start before an earlier one has ended."""
    w = Window.partitionBy(key).orderBy(start, name)
    x = ranges.withColumn("until", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return x.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(end) < F.col(start)).alias("backwards"), F.count_if(F.col(start) <= F.col("until")).alias("overlapping"))


def resolve(records: DataFrame, mapping: DataFrame, instrument: str, day: str) -> DataFrame:
    """Adds the code that an instrument has on a day, from ranges (m_instrument, lo, hi, code), hi excluded.

    Fails closed: a record that no range holds ends the job, and so do ranges of an instrument that overlap.
    """
    following = F.lead("lo").over(Window.partitionBy("m_instrument").orderBy("lo"))
    m = mapping.withColumn("code", F.when(following < F.col("hi"), F.raise_error(F.concat(F.lit("overlapping ranges: "), F.col("m_instrument").cast("string"))).cast("string")).otherwise(F.col("code")))
    on = (F.col(instrument) == F.col("m_instrument")) & (F.col(day) >= F.col("lo")) & (F.col(day) < F.col("hi"))
    unknown = F.raise_error(F.concat(F.lit("unresolved instrument: "), F.coalesce(F.col(instrument).cast("string"), F.lit("none")))).cast("string")
    return records.join(m, on, "left").withColumn("code", F.coalesce("code", unknown)).drop("m_instrument", "lo", "hi")


def digests(bars: DataFrame) -> DataFrame:
    """SHA-256 over the canonical JSON lines (sorted keys, compact) of each session's bars, in time order.

    A group is one session of one symbol, so the collected list is bounded by the bars of a day.
    """
    line = F.to_json(F.struct("c", "h", "l", "o", "os", "v"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("os", line.alias("line")))), lambda x: x["line"])
    return bars.groupBy("symbol", "session_date").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def chain(d: DataFrame) -> DataFrame:
    """The head of each symbol's hash chain over its session digests: each link hashes the head before and the next digest."""
    days = F.transform(F.array_sort(F.collect_list(F.struct("session_date", "digest"))), lambda x: x["digest"])
    return d.groupBy("symbol").agg(F.count("*").alias("links"), F.aggregate(days, F.lit(""), lambda head, x: F.sha2(F.concat(head, x), 256)).alias("head"))


#: Stages of an artifact (fixed values).
STAGES = ("market_observation", "feature", "market_state", "research", "setup_candidate", "entry_candidate", "ai_analysis", "adversarial_review", "delivery")


def artifact_faults(artifacts: DataFrame, edges: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """The first rule that an artifact (id, stage, run_id, observed_at, captured_at) breaks; empty if it breaks none.

    Its stage is known, it names its run, an observation says when it was true and when it was captured, and
    anything derived has a parent in ``edges`` (child, parent). Repeated edges count once.
    """
    parents = edges.where("parent is not null").select(F.col("child").alias("p_child")).distinct().withColumn("derived", F.lit(True))
    fault = (
        F.when(F.col("stage").isNull() | ~F.col("stage").isin(*stages), "unknown_stage")
        .when(F.coalesce("run_id", F.lit("")) == "", "no_run")
        .when((F.col("stage") == "market_observation") & (F.col("observed_at").isNull() | F.col("captured_at").isNull()), "no_times")
        .when((F.col("stage") != "market_observation") & F.col("derived").isNull(), "no_parent")
        .otherwise("")
    )
    return artifacts.join(parents, F.col("id") == F.col("p_child"), "left").select("id", "stage", fault.alias("fault"))
