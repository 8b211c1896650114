"""The streamed as-of join against a plain one, over a restart; its number of states."""

import random

import pandas as pd
from barloom.streaming import joins as sj
from barloom.streaming.bars import run_to_end

SCHEMA = "symbol string, ce long, side int, seq long, value string"


def plain(rows, until):
    """Each left row up to ``until`` with the value of the latest right row; of one time the first by seq."""
    known, at, out = {}, {}, []
    for symbol, ce, side, seq, value in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1:4]):
        if side:
            out.append((symbol, ce, seq, known.get(symbol)))
        elif at.get(symbol) != ce:
            known[symbol], at[symbol] = value, ce
    out += [(None, r[1], r[3], None) for r in rows if r[0] is None and r[2]]
    return sorted((r for r in out if r[1] <= until), key=repr)


def test_as_of_over_a_restart_in_few_states(spark, tmp_path):
    r = random.Random(7)
    symbols = [f"s{i}" for i in range(2500)] + [None]
    rows = [(r.choice(symbols), 1_704_100_000 + r.randrange(4000), r.randrange(2), i, None if i % 11 == 0 else str(i)) for i in range(12_000)]
    rows += [(s, ce, 0, seq + 20_000, "second") for s, ce, side, seq, _ in rows[:2000] if side == 0]
    rows += [(s, ce, 1, seq + 40_000, None) for s, ce, side, seq, _ in rows[:2000] if side == 0]
    cut = 1_704_102_000
    for i, part in enumerate(([x for x in rows if x[1] <= cut], [x for x in rows if x[1] > cut])):
        spark.createDataFrame(pd.DataFrame(part, columns=["symbol", "ce", "side", "seq", "value"]), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        e = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        joined = sj.as_of(e.where("side = 1").selectExpr("symbol", "ce", "seq as id"), e.where("side = 0").select("symbol", "ce", "seq", "value"), "value")
        q = joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024
        got = sorted((tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").select("symbol", "ce", "id", "value").collect()), key=repr)
        assert len(got) > 1000 and got == plain(rows, max(x[1] for x in part) - 600)


def test_as_of_with_nulls(spark, tmp_path):
    rows = [("a", 1000, 0, None, "no seq"), ("a", 1000, 0, 5, "first"), ("a", 1001, 1, None, None), ("a", None, 1, 7, None), ("a", None, 0, 1, "never"), (None, 1000, 0, 1, "x"), (None, 1002, 1, 8, None), ("b", 9000, 1, 9, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    e = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    joined = sj.as_of(e.where("side = 1").selectExpr("symbol", "ce", "seq as id"), e.where("side = 0").select("symbol", "ce", "seq", "value"), "value")
    run_to_end(joined, f"{tmp_path}/out", f"{tmp_path}/mark")
    got = spark.read.parquet(f"{tmp_path}/out").select("symbol", "ce", "id", "value").collect()
    assert sorted(map(tuple, got), key=repr) == [("a", 1001, None, "first"), (None, 1002, 8, None)]
