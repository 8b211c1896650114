"""Streamed features and events against the batch operators; refused bars; restarts."""

import pandas as pd
import pytest
from barloom.operators import features as ft
from barloom.sources.bars import bars_from_events
from barloom.streaming import features as sf
from pyspark.sql import functions as F

from test_registry import rows

SF = "/root/testdata/sf0.001"


def add(df, folder, name):
    """One more file of bars, in the order of its arrival."""
    df.select(*sf.BAR).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, out, mark):
    sf.run_to_end(sf.stream_records(sf.read_bars(spark, f"{folder}/*")), out, mark)


@pytest.fixture(scope="module")
def batch(spark):
    f = ft.features(spark, SF).cache()
    events = ft.all_events(f).select("symbol", "session_date", "ce", F.lit("event").alias("kind"), F.col("event").alias("name"), "value", "reference")
    features = ft.records(f).select("symbol", "session_date", "ce", F.lit("feature").alias("kind"), F.col("feature").alias("name"), "value", F.col("state").alias("reference"))
    return events.unionByName(features).toPandas()


def test_stream_equals_batch_over_restarts(spark, tmp_path, batch):
    bars = bars_from_events(spark, SF).cache()
    ends = [int(x) for x in bars.approxQuantile("ce", [0.3, 0.31, 0.7], 0.0)]
    for i, (lo, hi) in enumerate(zip([0, *ends], [*ends, 1 << 40], strict=True)):
        add(bars.where((F.col("ce") > lo) & (F.col("ce") <= hi)), f"{tmp_path}/bars", f"slice{i}")
        if i != 1:  # a stop after the first slice, in the middle of sessions, and after the third
            run(spark, f"{tmp_path}/bars", f"{tmp_path}/out", f"{tmp_path}/mark")
    got = spark.read.parquet(f"{tmp_path}/out/records").drop("batch").toPandas()
    assert rows(got) == rows(batch) and len(got) > 10_000
    assert {*got.loc[got.kind == "event", "name"]} >= {"fvg_inverted", "structure_break_up", "sweep_high", "or_high_broken", "opening_range_established", "session_close"}
    assert spark.read.parquet(f"{tmp_path}/out/refused").count() == 0


def test_late_and_repeated_bars_are_refused(spark, tmp_path, batch):
    bars = bars_from_events(spark, SF).cache()
    middle = int(bars.approxQuantile("ce", [0.5], 0.0)[0])
    early, later = bars.where(F.col("ce") <= middle), bars.where(F.col("ce") > middle)
    last = early.groupBy("symbol").agg(F.max("ce").alias("ce"))
    again, old = early.join(last, ["symbol", "ce"]), early.where("ce % 7200 = 0").join(last, ["symbol", "ce"], "left_anti")
    twice = later.where("ce % 10800 = 0")
    add(early, f"{tmp_path}/bars", "a")
    run(spark, f"{tmp_path}/bars", f"{tmp_path}/out", f"{tmp_path}/mark")
    add(later.unionByName(twice).unionByName(again).unionByName(old).unionByName(later.limit(1).withColumn("c", F.lit(None).cast("long"))), f"{tmp_path}/bars", "b")
    run(spark, f"{tmp_path}/bars", f"{tmp_path}/out", f"{tmp_path}/mark")
    assert rows(spark.read.parquet(f"{tmp_path}/out/records").drop("batch").toPandas()) == rows(batch)
    refused = spark.read.parquet(f"{tmp_path}/out/refused").groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in refused} == {"repeated": again.count() + twice.count(), "late": old.count(), "incomplete": 1}


def test_one_bar(spark, tmp_path):
    b = pd.Series({"symbol": "x", "os": 1704205800, "ce": 1704207600, "o": 5, "h": 5, "l": 5, "c": 5, "v": 0, "session_date": "2024-01-02", "phase": "rth", "open_s": 1704205800})
    m = sf.Memory()
    got = [x[2] for x in sf.observe(m, b, ft.Config()) if x[1] == "event"]
    assert got == ["session_open"] and m.last_os == 1704205800 and m.n == 1
