"""Registered queries against their SQL on the small tables, and properties of the bar operators."""

import os

import duckdb
import pandas as pd
import pytest
from barloom.functions import calendar as cal
from barloom.operators import features as ft
from barloom.operators import inference as inf
from barloom.plans import registry
from barloom.sources import bars as src
from barloom.sources import store
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "nation customer supplier orders lineitem part events".split()
SAMPLE = ["flagship", "cal_session_date", "cal_roll", "e_structure_break_up", "e_fvg_inverted", "p_oriented", "p_hit_atr", "a_quality", "a_continuity", "w_bh", "a_lift", "i_perm", "i_screen", "j_condition_state", "src_dbn", "val_order", "val_bar", "a_hash_chain", "j_eligible", "i_classify", "val_artifact", "a_old_gate", "snk_features"]


def rows(df: pd.DataFrame) -> list:
    def norm(x):
        if pd.isna(x):
            return None
        if isinstance(x, str):
            return x
        return f"{float(x):.9g}"

    return sorted(repr([norm(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), c.execute(registry.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sample_without_spread_is_enough(spark, tmp_path):
    """One displacement alone: its mean has no spread, so no least sample is named, and any sample shows it."""
    px = [100 + i % 2 for i in range(40)] + [90] + [92] * 8
    t = pd.DataFrame({"event_id": range(len(px)), "ts": pd.Timestamp("2024-01-02 00:05") + pd.to_timedelta([30 * i for i in range(len(px))], "min"), "user_id": 1, "event_type": "view", "value": [float(x) for x in px], "props": "{}"})
    c = duckdb.connect()
    c.execute("create table events as select * replace (cast(ts as timestamp) as ts) from t")
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got, want = registry.QUERIES["math_minimum_n"](spark, str(tmp_path)).toPandas(), c.execute(registry.SQL["math_minimum_n"]).fetchdf()
    assert rows(got) == rows(want)
    assert [tuple(r) for r in got.loc[got.hypothesis == "H5", ["n", "enough"]].itertuples(index=False)] == [(1, True)]


def test_which_came_first_needs_both_sides(spark, tmp_path):
    """A side that never moved, or one bar with both extremes, leaves open which came first; the row stays."""
    bars = {
        "flat": [[100], [100], [100]],
        "rises": [[100], [101], [102]],
        "falls": [[100], [99], [98]],
        "same_bar": [[100], [102, 98], [100]],
        "rise_first": [[100], [102], [98, 102]],
        "fall_first": [[100], [98], [102, 98]],
        "alone": [[100]],
    }
    tape = [(s, pd.Timestamp("2024-01-02 00:05") + pd.Timedelta(30 * i + k, "min"), float(x)) for s, b in bars.items() for i, px in enumerate(b) for k, x in enumerate(px)]
    t = pd.DataFrame({"event_id": range(len(tape)), "ts": [r[1] for r in tape], "user_id": 1, "event_type": [r[0] for r in tape], "value": [r[2] for r in tape], "props": "{}"})
    c = duckdb.connect()
    c.execute("create table events as select * replace (cast(ts as timestamp) as ts) from t")
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got, want = registry.QUERIES["p_oriented"](spark, str(tmp_path)).toPandas(), c.execute(registry.SQL["p_oriented"]).fetchdf()
    assert rows(got) == rows(want) and len(got) == 2 * sum(map(len, bars.values()))
    first = got[got.ce == got.ce.min()]
    assert {(r.symbol, r.direction): None if pd.isna(r.favorable_first) else bool(r.favorable_first) for r in first.itertuples()} == {
        **{(s, d): None for s in bars for d in ("up", "down")},
        ("rise_first", "up"): True,
        ("rise_first", "down"): False,
        ("fall_first", "up"): False,
        ("fall_first", "down"): True,
    }


def test_store_holds_whole_runs(spark, tmp_path):
    r = spark.createDataFrame([("A", "2024-01-02", 1, "vwap", 2.5, None), ("A", "2024-01-02", 2, "phase", None, "rth")], "symbol string, session_date string, ce long, feature string, value double, state string")
    folder = str(tmp_path / "store")
    for run in ("one", "two", "two"):
        store.append_records(r, folder, run)
    with pytest.raises(Exception, match="record without"):
        store.append_records(r.withColumn("feature", F.when(F.col("ce") == 1, F.col("feature"))), folder, "three")
    assert {(x["run"], x["n"]) for x in store.stored_records(spark, folder).groupBy("run").agg(F.count("*").alias("n")).collect()} == {("one", 2), ("two", 2)}
    assert store.stored_records(spark, folder, ["two"]).count() == 2


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_census_size(spark):
    assert inf.census(spark).count() == 13884


def test_prefix_invariance(spark, tmp_path):
    """Features and events of a cut tape are the beginning of those of the whole tape."""
    cut_at = "2024-01-16 00:00:00"
    os.makedirs(tmp_path / "cut")
    spark.read.parquet(f"{SF}/events.parquet").where(F.col("ts") < F.lit(cut_at).cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "cut/events.parquet"))
    whole, part = ft.features(spark, SF), ft.features(spark, str(tmp_path / "cut"))
    keep = F.col("ce") <= F.unix_timestamp(F.lit(cut_at).cast("timestamp"))
    cols = ["symbol", "ce", "vwap", "atr", "swing_high", "pdh", "orh", "session_high"]
    assert rows(whole.where(keep).select(*cols).toPandas()) == rows(part.where(keep).select(*cols).toPandas())
    known = ["session_open", "sweep_high", "sweep_low", "displacement_up", "structure_break_up", "fvg_inverted", "fvg_formed_up", "swing_high"]
    pick = lambda f: ft.all_events(f).where(keep & F.col("event").isin(known)).toPandas()
    assert rows(pick(whole)) == rows(pick(part))


def test_daylight_saving(spark):
    days = {str(r["day"]): r for r in cal.days(spark).where("day in (date'2024-03-08', date'2024-03-11', date'2024-07-03')").collect()}
    assert days["2024-03-08"]["open_s"] % 86400 == 14 * 3600 + 1800
    assert days["2024-03-11"]["open_s"] % 86400 == 13 * 3600 + 1800
    assert days["2024-07-03"]["early"] and days["2024-07-03"]["expected"] == 210


def test_third_friday(spark):
    got = spark.createDataFrame([(2024, 3), (2021, 9), (2026, 12)], "y int, m int").select(cal.third_friday(F.col("y"), F.col("m")).cast("string")).collect()
    assert [r[0] for r in got] == ["2024-03-15", "2021-09-17", "2026-12-18"]


def test_benjamini_hochberg_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "label string, p double")
    got = {r["label"]: (round(r["p_adjusted"], 4), r["significant"]) for r in inf.benjamini_hochberg(df, "label", "p").collect()}
    assert got == {"a": (0.04, True), "c": (0.0533, False), "b": (0.0533, False), "d": (0.5, False)}


def test_csv_reader(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("observed_at,open,high,low,close,volume,trade_count\n2024-01-02T14:30:00Z,1.5,2,1,1.75,10,\n2024-01-02T09:31:00-05:00,2,3,1,2,5,4\n")
    got = src.read_csv(spark, str(p), "bars").orderBy("os").collect()
    assert [r["os"] for r in got] == [1704205800, 1704205860] and got[0]["trade_count"] is None and float(got[0]["close"]) == 1.75
    p.write_text("observed_at,open,high,low,close,volume,trade_count\n2024-01-02T14:30:00,1,1,1,1,1,1\n")
    with pytest.raises(Exception, match="no offset"):
        src.read_csv(spark, str(p), "bars").collect()


def test_one_pass_events_are_the_families(spark):
    from functools import reduce

    f = ft.features(spark, SF)
    c = ft.Config()
    parts = [ft.session_events(f), ft.opening_range_events(f), ft.sweep_events(f, c), ft.displacement_events(f, c), ft.structure_events(f), ft.gap_events(f, c), ft.swing_events(f)]
    assert rows(ft.all_events(f).toPandas()) == rows(reduce(lambda a, b: a.unionByName(b), parts).toPandas())


def test_planted_effect(spark):
    """Events that are ten ticks better than controls of their stratum: the lift says so, the interval excludes zero, the permutation agrees."""
    from barloom.operators import study as st

    base = spark.range(2400).selectExpr("'h' as hypothesis", "case when id % 4 = 0 then 'event' else 'control' end as arm", "'s' as symbol", "string(id % 12) as session_date", "id as ce", "string(id % 3) as stratum", "bigint(pmod(xxhash64(id), 21)) - 10 + (id % 3) * 100 + case when id % 4 = 0 then 10 else 0 end as y", "bigint(0) as mfe", "bigint(0) as mae", "true as fav", "true as above")
    got = st.matched_lift(base).first()
    assert abs(got["lift"] - 10) < 1.5 and got["n"] == 600 and got["strata_dropped"] == 0
    ci = st.cluster_bootstrap(base, rounds=200).first()
    assert ci["sessions"] == 12 and 7 < ci["ci_low"] <= got["lift"] <= ci["ci_high"] < 13 and ci["p"] < 0.02
    assert st.permutation(base, rounds=60).first()["p"] < 0.02
    few = st.cluster_bootstrap(base.where("session_date in ('0', '1', '2')"), rounds=20).first()
    assert few["sessions"] == 3 and few["ci_low"] is None
    thin = st.matched_lift(base.where("arm = 'event' or ce < 40")).first()
    assert thin["strata_dropped"] == 3 and thin["lift"] is None


def test_empty_tape(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").where("false").write.parquet(str(tmp_path / "events.parquet"))
    assert ft.all_events(ft.features(spark, str(tmp_path))).count() == 0


def test_order_faults_across_blocks(spark):
    """Ends of blocks are compared too: small blocks give what one block gives."""
    from barloom.operators import checks as ck

    rows_ = [(i, "a" if i % 3 else "b", None if i % 11 == 0 else (i * 7) % 23) for i in range(200)]
    df = spark.createDataFrame(rows_, "id long, key string, at long")
    want = {}
    for key in "ab":
        at = [t for i, k, t in rows_ if k == key and t is not None]
        want[key] = (sum(y < x for x, y in zip(at, at[1:])), sum(y == x for x, y in zip(at, at[1:])))
    for block in (5, 64, 1000):
        assert {r["key"]: (r["backwards"], r["repeated"]) for r in ck.order_faults(df, "key", "id", "at", block).collect()} == want
    assert ck.order_faults(df.where("false"), "key", "id", "at").count() == 0


def test_lookup_fails_closed(spark):
    from barloom.operators import checks as ck

    records = spark.createDataFrame([(1, 5), (1, 12), (2, 5)], "instrument int, day int")
    ranges = [(1, 0, 10, "x"), (1, 10, 20, "y"), (2, 0, 9, "z")]
    named = lambda m: {(r["instrument"], r["day"]): r["code"] for r in ck.resolve(records, spark.createDataFrame(m, "m_instrument int, lo int, hi int, code string"), "instrument", "day").collect()}
    assert named(ranges) == {(1, 5): "x", (1, 12): "y", (2, 5): "z"}
    with pytest.raises(Exception, match="unresolved instrument: 2"):
        named(ranges[:2])
    with pytest.raises(Exception, match="overlapping ranges: 1"):
        named([*ranges, (1, 9, 12, "w")])


def test_prior_session_is_one_that_passed(spark):
    from barloom.operators import quality as ql

    c = spark.createDataFrame([("s", f"2024-01-0{i}", "A" if i < 4 else "B", 1, 5, 0) for i in range(1, 6)], "symbol string, session_date string, contract_ids string, n_contracts long, n_bars long, n_missing long")
    got = {r["session_date"][-1]: (r["prior_session"], r["verdict"]) for r in ql.continuity(c, c.where("session_date in ('2024-01-02', '2024-01-05')")).collect()}
    assert got == {"1": (None, "no_prior_session"), "2": (None, "no_prior_session"), "3": ("2024-01-02", "same_contract"), "4": ("2024-01-02", "contract_boundary"), "5": ("2024-01-02", "contract_boundary")}


def test_tail_of_the_normal_distribution(spark):
    import math

    z = [0.0, 0.5, 1.96, 4.0, 8.0, 20.0]
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in z], "z double").select(inf.two_sided_p(F.col("z"), F.lit(1.0), F.lit(1)).alias("p")).collect()]
    assert all(abs(p / math.erfc(x / math.sqrt(2)) - 1) < 2e-7 for x, p in zip(z, got, strict=True))


def test_inverse_normal_and_least_sample(spark):
    from statistics import NormalDist

    p = [1e-12, 1e-5, 0.02, 0.02425, 0.3, 0.5, 0.8, 0.97575, 0.99, 1 - 1e-9, 0.0, 1.0, -1.0, None]
    got = [r["z"] for r in spark.createDataFrame([(x,) for x in p], "p double").select(inf.normal_quantile(F.col("p")).alias("z")).collect()]
    assert got[10:] == [None] * 4 and all(abs(z - NormalDist().inv_cdf(x)) < 1e-8 for x, z in zip(p[:10], got, strict=False))
    rows_ = [(0.5, 1.0), (0.2, 1.0), (-0.2, 1.0), (0.0, 1.0), (1.0, 0.0), (3.0, 1.0)]
    least = [r["n"] for r in spark.createDataFrame(rows_, "effect double, sd double").select(inf.minimum_n(F.col("effect"), F.col("sd")).alias("n")).collect()]
    assert least == [32, 197, 197, None, None, 1]


def test_a_query_of_one_feature_computes_no_other(spark):
    plan = lambda name: registry.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    atr = plan("f_atr")
    read = [x.split(">")[0] for x in atr.split("ReadSchema: ")[1:]]
    assert read and not any(c in x for x in read for c in ("user_id", "props"))
    assert "session_high" not in atr and "stddev" not in atr and "ExistingRDD" not in atr  # nothing is written between
    assert "stddev" in plan("f_realized_volatility")
