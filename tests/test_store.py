"""Config upserts of writers that meet, studies that resume, lineage of long chains."""

import threading

import pytest
from barloom.operators import lineage
from barloom.sources import resume, store
from pyspark.sql import functions as F

CONFIG = "digest string, body string"


def test_upsert_keeps_the_first_of_each_digest(spark, tmp_path):
    folder = f"{tmp_path}/c"
    assert store.upsert_configs(spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "1")], CONFIG), folder) == 0
    store.upsert_configs(spark.createDataFrame([("b", "9"), ("c", "3")], CONFIG), folder)
    store.upsert_configs(spark.createDataFrame([], CONFIG), folder)
    assert sorted(map(tuple, store.stored_configs(spark, folder, CONFIG).collect())) == [("a", "1"), ("b", "1"), ("c", "3")]
    with pytest.raises(Exception, match="without a digest"):
        store.upsert_configs(spark.createDataFrame([(None, "1")], CONFIG), folder)
    assert store.stored_configs(spark, f"{tmp_path}/none", CONFIG).count() == 0


def test_two_writers_at_once(spark, tmp_path):
    """Both have written their rows before either commits: one loses the number and tries again without what the other stored."""
    folder, meet, lost = f"{tmp_path}/c", threading.Barrier(2), {}

    def writer(name):
        df = spark.createDataFrame([(f"d{i}", name) for i in (range(0, 60) if name == "x" else range(40, 100))], CONFIG)
        lost[name] = store.upsert_configs(df, folder, before_commit=lambda n: meet.wait(60) if n == 0 else None)

    both = [threading.Thread(target=writer, args=(n,)) for n in "xy"]
    for t in both:
        t.start()
    for t in both:
        t.join()
    got = [tuple(r) for r in store.stored_configs(spark, folder, CONFIG).collect()]
    assert sorted(lost.values()) == [0, 1] and len(got) == len(dict(got)) == 100
    first = next(n for n in lost if lost[n] == 0)
    assert {dict(got)[f"d{i}"] for i in range(40, 60)} == {first}


def build(spark, made, name, rows):
    def run():
        made.append(name)
        return spark.createDataFrame(rows, "day int, x int")

    return run


def test_a_study_resumes(spark, tmp_path):
    folder, made, rows = f"{tmp_path}/s", [], [(i, i * i) for i in range(20)]
    identity = {"inputs": resume.input_digest(spark.createDataFrame(rows, "day int, x int")), "rounds": 5}
    one = resume.Study(spark, folder, identity)
    one.stage("a", build(spark, made, "a", rows))
    with pytest.raises(ZeroDivisionError):
        one.stage("b", lambda: 1 / 0)
    two = resume.Study(spark, folder, {**identity})
    a = two.stage("a", build(spark, made, "a", []))
    total = two.stage("b", lambda: a.agg(F.sum("x").alias("total"))).first()["total"]
    assert total == sum(x for _, x in rows) and made == ["a"] and two.resumed == ["a"] and two.made == ["b"]


def test_another_study_is_refused_by_field(spark, tmp_path):
    resume.Study(spark, f"{tmp_path}/s", {"rounds": 5, "seed": 1, "old": None})
    with pytest.raises(ValueError, match="rounds is 6, was 5, seed is '1', was 1$"):
        resume.Study(spark, f"{tmp_path}/s", {"rounds": 6, "seed": "1", "old": None})
    with pytest.raises(ValueError, match="old is None, was None"):
        resume.Study(spark, f"{tmp_path}/s", {"rounds": 5, "seed": 1})


def test_the_holdout_is_never_stored(spark, tmp_path):
    study, made = resume.Study(spark, f"{tmp_path}/s", {"v": 1}, holdout=F.col("day") >= 15), []
    study.stage("ok", build(spark, made, "ok", [(14, 1), (None, 2)]))
    with pytest.raises(Exception, match="stage bad holds rows of the holdout"):
        study.stage("bad", build(spark, made, "bad", [(14, 1), (15, 2)]))
    assert not store.exists(spark, f"{tmp_path}/s/bad.json") and resume.Study(spark, f"{tmp_path}/s", {"v": 1}).stage("ok", build(spark, made, "again", [])).count() == 2
    assert made == ["ok", "bad"]


def test_input_digest_sees_rows_and_columns_but_not_their_order(spark):
    df = spark.range(50).selectExpr("id", "id % 7 as k", "cast(null as string) as n")
    same = df.repartition(5).select("n", "k", "id")
    assert resume.input_digest(df) == resume.input_digest(same)
    assert len({resume.input_digest(x) for x in (df, df.union(df.limit(1)), df.withColumn("k", F.col("k") + (F.col("id") == 3).cast("int")), df.withColumnRenamed("k", "j"), df.limit(0))}) == 5


def test_lineage_of_a_long_chain_and_a_net(spark):
    n = 300
    chain = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1, 0), (None, 3), (4, None)], "child long, parent long")
    got = lineage.ancestors(chain)
    assert got.count() == n * (n + 1) // 2 and got.where("depth <> child - parent").count() == 0
    net = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "b")], "child string, parent string")
    assert sorted(map(tuple, lineage.ancestors(net).collect())) == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1), ("d", "a", 2), ("d", "a", 3), ("d", "b", 1), ("d", "b", 2), ("d", "c", 1)]
    with pytest.raises(ValueError, match="a cycle"):
        lineage.ancestors(net.union(spark.createDataFrame([("a", "d")], "child string, parent string")))
    assert lineage.ancestors(net.where("false")).count() == 0
