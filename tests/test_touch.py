"""First touches by the tree of extremes against a plain scan, and the size of its joins."""

import random

import pytest
from barloom.operators import touch
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tape(spark):
    random.seed(12)
    rows = []
    for symbol, n in (("hot", 700), ("thin", 9), ("one", 1)):
        price = 1000
        for i in range(1, n + 1):
            price += random.choice([-9, -4, 0, 4, 9])
            rows.append((symbol, i, 60 * i, 60 * i + 60, price, price + random.randrange(25), price - random.randrange(25)))
    return rows, spark.createDataFrame(rows, "symbol string, n_bar long, os long, ce long, c long, h long, l long").cache()


@pytest.mark.parametrize("fanout", [2, 3, 8, 64])
def test_first_touch(spark, tape, fanout):
    rows, df = tape
    random.seed(fanout)
    wishes = [(s, n, random.random() < 0.5, float(random.randrange(850, 1150))) for s, n, *_ in rows for _ in range(2)]
    levels = touch.extremes(df.withColumnRenamed("n_bar", "n"), fanout=fanout)
    got = {tuple(r)[:4]: r["touch"] for r in touch.first_touch(spark.createDataFrame(wishes + wishes[:9], "symbol string, n long, up boolean, at double"), levels, fanout).collect()}
    want = {}
    for s, n, up, at in wishes:
        hit = next((m for t, m, _, _, _, h, low in rows if t == s and m > n and (h >= at if up else low <= at)), None)
        if hit is not None:
            want[s, n, up, at] = hit
    assert got == want
    assert all(x.groupBy("b_symbol", "parent").count().agg(F.max("count")).first()[0] <= fanout for x in levels)
    assert touch.first_touch(spark.createDataFrame(wishes, "symbol string, n long, up boolean, at double").where("false"), levels, fanout).count() == 0


def test_hit_first(spark, tape):
    rows, df = tape
    random.seed(5)
    horizon = 60 * 40
    anchors = [(s, ce, float(random.randrange(1, 40)), float(random.randrange(1, 40)), random.choice(["up", "down"])) for s, _, _, ce, *_ in rows]
    got = {tuple(r)[:2]: (r["hit"], r["hit_os"]) for r in touch.hit_first(spark.createDataFrame(anchors, "symbol string, ce long, favorable double, adverse double, direction string"), df, horizon, 8).collect()}
    close = {(s, ce): c for s, _, _, ce, c, *_ in rows}
    for s, at, fav, adv, way in anchors:
        turn, want = (1 if way == "up" else -1), ("neither", None)
        for t, _, os, ce, _, h, low in rows:
            if t != s or not at < ce <= at + horizon:
                continue
            best, worst = (h, low) if turn > 0 else (low, h)
            f, a = turn * (best - close[s, at]) >= fav, turn * (worst - close[s, at]) <= -adv
            if f or a:
                want = ("same_bar" if f and a else "favorable" if f else "adverse", os)
                break
        assert got[s, at] == want
    assert len(got) == len(rows)  # bars without a later one have their row
    assert {x for x, _ in got.values()} == {"favorable", "adverse", "same_bar", "neither"}
    with pytest.raises(Exception, match="must be positive"):
        touch.hit_first(spark.createDataFrame([("one", 120, 0.0, 1.0, "up")], "symbol string, ce long, favorable double, adverse double, direction string"), df, horizon).collect()


def test_an_empty_tape(spark, tape):
    empty = tape[1].where("false")
    assert touch.hit_first(spark.createDataFrame([("hot", 120, 1.0, 1.0, "up")], "symbol string, ce long, favorable double, adverse double, direction string"), empty, 60).count() == 0
