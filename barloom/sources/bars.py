"""Bars from the event tape, and typed readers of bar, trade and quote files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERVAL = 1800

SCHEMAS = {
    "bars": "observed_at string, open string, high string, low string, close string, volume string, trade_count string",
    "trades": "observed_at string, price string, size string, aggressor string, sequence string",
    "top_of_book": "observed_at string, bid_price string, bid_size string, ask_price string, ask_size string",
}
OPTIONAL = {"trade_count", "aggressor", "sequence", "bid_price", "bid_size", "ask_price", "ask_size"}


def parse_instant(text: Column) -> Column:
    """ISO-8601 text with an offset to epoch seconds; text without an offset fails the job."""
    ok = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(ok, F.to_timestamp(text).cast("long")).otherwise(F.raise_error(F.concat(F.lit("no offset: "), text)).cast("long"))


def parse_micros(text: Column, where: Column | None = None) -> Column:
    """As parse_instant, to epoch microseconds: fractions of a second stay. ``where`` begins the message of a failure."""
    ok = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(ok, F.unix_micros(F.to_timestamp(text))).otherwise(F.raise_error(F.concat(F.lit("") if where is None else where, F.lit("no offset: "), text)).cast("long"))


def parse_number(text: Column, kind: str, optional: bool, where: Column | None = None) -> Column:
    """A number of a type; blank is null if optional, anything else that is no number fails the job."""
    value = text.try_cast(kind)
    blank = text.isNull() | (F.trim(text) == "")
    bad = F.raise_error(F.concat(F.lit("") if where is None else where, F.lit("bad number: "), F.coalesce(text, F.lit("")))).cast(kind)
    return F.when(blank, F.lit(None).cast(kind) if optional else bad).otherwise(F.coalesce(value, bad))


def read_csv(spark: SparkSession, path: str, schema: str, start_s: int | None = None, end_s: int | None = None) -> DataFrame:
    """A replay file of the given schema, in [start, end): epoch seconds, decimals and counts, strictly typed."""
    raw = spark.read.schema(SCHEMAS[schema]).csv(path, header=True, mode="FAILFAST")
    cols = [parse_instant(F.col("observed_at")).alias("os")]
    for name in raw.columns[1:]:
        kind = "string" if name == "aggressor" else "bigint" if name in ("volume", "size", "bid_size", "ask_size", "trade_count", "sequence") else "decimal(18,9)"
        cols.append((F.col(name) if kind == "string" else parse_number(F.col(name), kind, name in OPTIONAL)).alias(name))
    df = raw.select(*cols)
    if start_s is not None:
        df = df.where(F.col("os") >= start_s)
    return df.where(F.col("os") < end_s) if end_s is not None else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape: symbol, event_id, t (epoch microseconds), px (price in ticks of 0.01), user_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("symbol"), "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.round(F.col("value") * 100).cast("long").alias("px"))


def bars_from_events(spark: SparkSession, sf_dir: str, interval: int = INTERVAL) -> DataFrame:
    """OHLCV bars of each symbol: symbol, os (open), ce (close), o, h, l, c in ticks, v, contract_id.

    One aggregate with map-side combining; a bar exists where the tape has an event.
    """
    e = events(spark, sf_dir).withColumn("os", F.expr(f"t div {interval * 1_000_000} * {interval}"))
    at = F.struct("t", "event_id")
    b = e.groupBy("symbol", "os").agg(F.min_by("px", at).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", at).alias("c"), F.count("*").alias("v"))
    contract = F.concat(F.lit("X:"), F.expr("string(dayofyear(timestamp_seconds(os)) div 10)"))
    return b.withColumn("ce", F.col("os") + interval).withColumn("contract_id", contract)
