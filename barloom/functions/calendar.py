"""The exchange calendar as a small table of days, and session functions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"
FIRST_DAY, LAST_DAY = "2021-01-01", "2026-12-31"

# The exchange's closed weekdays and its 13:00 closes, by year.
HOLIDAYS = """
2021-01-01 2021-01-18 2021-02-15 2021-04-02 2021-05-31 2021-07-05 2021-09-06 2021-11-25 2021-12-24
2022-01-17 2022-02-21 2022-04-15 2022-05-30 2022-06-20 2022-07-04 2022-09-05 2022-11-24 2022-12-26
2023-01-02 2023-01-16 2023-02-20 2023-04-07 2023-05-29 2023-06-19 2023-07-04 2023-09-04 2023-11-23 2023-12-25
2024-01-01 2024-01-15 2024-02-19 2024-03-29 2024-05-27 2024-06-19 2024-07-04 2024-09-02 2024-11-28 2024-12-25
2025-01-01 2025-01-20 2025-02-17 2025-04-18 2025-05-26 2025-06-19 2025-07-04 2025-09-01 2025-11-27 2025-12-25
2026-01-01 2026-01-19 2026-02-16 2026-04-03 2026-05-25 2026-06-19 2026-07-03 2026-09-07 2026-11-26 2026-12-25
""".split()
EARLY_CLOSES = "2021-11-26 2022-11-25 2023-07-03 2023-11-24 2024-07-03 2024-11-29 2024-12-24 2025-07-03 2025-11-28 2025-12-24 2026-11-27 2026-12-24".split()


def days(spark: SparkSession) -> DataFrame:
    """One row per calendar day covered: day, closed, next_open, prev_open, open_s, close_s (epoch seconds), early, expected minutes.

    About 2,200 rows whatever the data, so joins to it broadcast.
    """
    d = spark.range(1).select(F.explode(F.expr(f"sequence(date'{FIRST_DAY}', date'{LAST_DAY}')")).alias("day"))
    text = F.col("day").cast("string")
    d = d.withColumn("closed", (F.weekday("day") >= 5) | text.isin(HOLIDAYS)).withColumn("early", text.isin(EARLY_CLOSES))
    # windows run inside a year and its neighbours' edges: the table is tiny and fixed
    after = Window.orderBy("day").rowsBetween(1, 10)
    before = Window.orderBy("day").rowsBetween(-10, -1)
    open_day = F.when(~F.col("closed"), F.col("day"))
    wall = lambda t: F.to_utc_timestamp(F.concat_ws(" ", text, t).cast("timestamp"), ZONE).cast("long")
    return d.select(
        "day", "closed", "early", F.min(open_day).over(after).alias("next_open"), F.max(open_day).over(before).alias("prev_open"), wall(F.lit("09:30:00")).alias("open_s"), wall(F.when(F.col("early"), "13:00:00").otherwise("16:00:00")).alias("close_s")
    ).withColumn("expected", F.expr("int((close_s - open_s) div 60)"))


def local_time(at_s: Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(at_s), ZONE)


def with_session(df: DataFrame, at: str = "os") -> DataFrame:
    """Adds session_date, phase, open_s, close_s to rows with an epoch-second column.

    From 16:00 local on, an instant belongs to the next trading day; on a closed day to the next open one. A
    day outside the covered years fails the job rather than count as a plain day.
    """
    cal = F.broadcast(days(df.sparkSession))
    here = cal.select(F.col("day").alias("c_day"), F.col("closed").alias("c_closed"), "next_open")
    there = cal.select(F.col("day").alias("s_day"), "open_s", "close_s", "early", "expected")
    lt = local_time(F.col(at))
    x = df.withColumn("l_day", F.to_date(lt)).withColumn("l_closed_time", F.hour(lt) >= 16)
    x = x.join(here, F.col("l_day") == F.col("c_day"), "left")
    known = F.when(F.col("c_day").isNull(), F.raise_error(F.lit("day outside the calendar")).cast("date"))
    session = F.coalesce(known, F.when(F.col("l_closed_time") | F.col("c_closed"), F.col("next_open")).otherwise(F.col("l_day")))
    x = x.withColumn("s_date", session).join(there, F.col("s_date") == F.col("s_day"), "left")
    inside = (F.col(at) >= F.col("open_s")) & (F.col(at) < F.col("close_s"))
    phase = F.when(inside, "rth").when(F.col("c_closed") & (F.weekday("l_day") == 5), "closed").otherwise("overnight")
    return x.withColumn("session_date", F.col("s_date").cast("string")).withColumn("phase", phase).drop("l_day", "l_closed_time", "c_day", "c_closed", "next_open", "s_day", "s_date")


def third_friday(year: Column, month: Column) -> Column:
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(first, F.pmod(F.lit(4) - F.weekday(first), F.lit(7)) + 14)


def duration_text(seconds: Column) -> Column:
    """h/m/s text of a number of seconds, the largest unit first."""
    h, m, s = (F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60)))
    return F.when(seconds >= 3600, F.format_string("%dh%02dm%02ds", h, m, s.cast("long"))).when(seconds >= 60, F.format_string("%dm%02ds", m, s.cast("long"))).otherwise(F.format_string("%ds", s.cast("long")))
