"""As-of joins by a scan in two levels: against plain search, and spread over tasks."""

import random
from bisect import bisect_left, bisect_right

import pytest
from barloom.operators import paths as pt
from pyspark.sql import functions as F


@pytest.mark.parametrize("cells", [1, 7, 4096])
def test_as_of_and_reference_bar(spark, cells):
    random.seed(cells)
    left = [("hot" if random.random() < 0.8 else "thin", random.randrange(-500, 3000), i) for i in range(400)] + [("none", 5, 900)]
    right = [("hot" if random.random() < 0.9 else "thin", random.randrange(0, 2500), random.randrange(3), f"v{i}" if i % 9 else None) for i in range(150)] + [("other", 1, 0, "x")]
    known = {}
    for s, t, seq, v in sorted(right, key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or "")):
        known.setdefault((s, t), (seq, v))
    # of one time the first by seq; ties by seq are left out of the table so that the answer is one
    times = {k: v for k, v in known.items() if sum(r[:3] == (*k, v[0]) for r in right) == 1}
    right = [r for r in right if (r[0], r[1]) in times]
    got = {r["i"]: r["v"] for r in pt.as_of(spark.createDataFrame(left, "symbol string, ce long, i long"), spark.createDataFrame(right, "symbol string, ce long, seq int, v string"), "v", cells).collect()}
    for s, t, i in left:
        at = sorted(k[1] for k, v in times.items() if k[0] == s and v[1] is not None)
        n = bisect_right(at, t)
        assert got[i] == (times[s, at[n - 1]][1] if n else None)
    bars = sorted({("hot", 37 * i, i) for i in range(60)} | {("thin", 900, 1)})
    back = {r["id"]: (r["ref_ce"], r["ref_c"]) for r in pt.reference_bar(spark.createDataFrame([(s, i, t) for s, t, i in left], "symbol string, id long, t long"), spark.createDataFrame(bars, "symbol string, ce long, c long"), cells).collect()}
    for s, t, i in left:
        at = [b[1:] for b in bars if b[0] == s]
        n = bisect_left([b[0] for b in at], t)
        assert back[i] == (at[n] if n < len(at) else (None, None))


def test_an_empty_side(spark):
    none = spark.createDataFrame([], "symbol string, ce long, seq int, v string")
    assert [r["v"] for r in pt.as_of(spark.createDataFrame([("a", 1)], "symbol string, ce long"), none, "v").collect()] == [None]
    assert pt.as_of(spark.createDataFrame([], "symbol string, ce long"), none, "v").count() == 0


def test_a_hot_symbol_spreads_over_tasks(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(20_000).select(F.lit("hot").alias("symbol"), F.col("id").alias("ce"))
        right = spark.range(0, 20_000, 50).select(F.lit("hot").alias("symbol"), F.col("id").alias("ce"), F.lit(0).alias("seq"), F.col("id").alias("v"))
        got = pt.as_of(left, right, "v").withColumn("task", F.spark_partition_id())
        per = got.groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.expr("v = ce div 50 * 50")).alias("right")).collect()
        assert sum(r["right"] for r in per) == 20_000 and len(per) == 32 and max(r["n"] for r in per) < 2 * 20_000 / 32
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
