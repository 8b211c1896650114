"""The candidate assessment: planted candidates that fail each rule once, and its figures against plain arithmetic."""

from dataclasses import replace

import pytest
from barloom.operators import search as se

TAGS = {"session_phase": "mid", "atr_regime": "normal", "volume_context": "normal", "vwap_side": "above", "or_location": "inside_or", "structure_bias": "none"}
BAR = se.Criteria(min_events=30, min_event_sessions=12, min_effective_clusters=10, min_events_per_third=8, min_clusters_per_third=3, min_absolute_lift=5.0, min_lift_to_mfe_ratio=0.2, rounds=200)


def moments(up=lambda i, day: 10, days=15, each=6, tags=lambda i, day: {}, mfe=20, only=lambda day: True):
    """Events of one anchor and controls of no drift, ``each`` of both a day; days are cut into thirds."""
    rows = []
    for day in range(days):
        for i in range(each):
            t = TAGS | tags(i, day)
            third, date, stratum = day * 3 // days, f"2024-01-{day + 1:02}", f"{i % 2}|{t['atr_regime']}"
            if only(day):
                rows.append(("a", "-", 30, third, *t.values(), date, stratum, 1, up(i, day), mfe, -4))
            rows.append(("", "-", 30, third, *t.values(), date, stratum, 1, i % 3 - 1, 8, -8))
    return rows


def assessed(spark, rows, cond="", direction="up", criteria=BAR, predecessor=None):
    cells = spark.createDataFrame(rows, "anchor string, p string, horizon int, third int, " + ", ".join(f"{t} string" for t in TAGS) + ", session_date string, stratum string, n long, up long, max_up long, max_down long")
    c = spark.createDataFrame([("a", predecessor, cond, 30, direction, 1 + cond.count("="))], "anchor string, predecessor string, cond string, horizon int, direction string, complexity int").withColumn("key", se.candidate_key())
    return se.assess(cells, c, criteria).first()


def regime(i, day):
    return {"atr_regime": ("quiet", "normal", "elevated")[i % 3]}


def test_a_candidate_that_qualifies(spark):
    r = assessed(spark, moments(tags=regime))
    assert r["failures"] == [] and r["qualified"] and r["key"] == "a|30m|up"
    assert (r["n_events"], r["n_controls"], r["event_sessions"], r["effective_clusters"]) == (90, 90, 15, 15.0)
    assert r["event_mean"] == 10 and r["mfe_mean"] == 20 and r["mae_mean"] == 4 and r["lift"] == r["score"]
    # six strata, one control value each: what is left of the event mean is the standardised difference
    assert r["lift"] == pytest.approx(10 - sum(i % 3 - 1 for i in range(6)) / 6) and r["thirds_lift"] == pytest.approx([10] * 3)
    assert r["ci_low"] > 0 and r["ci_low"] <= r["lift"] <= r["ci_high"] and r["p"] < 0.02 and r["p_resolution_floor"] == 2 / 201


def test_direction_turns_every_measure(spark):
    r = assessed(spark, moments(up=lambda i, day: -10, tags=regime), direction="down")
    assert r["event_mean"] == 10 and r["mfe_mean"] == 4 and r["mae_mean"] == 20 and "min_absolute_lift_points" not in r["failures"]


@pytest.mark.parametrize(
    "rows, rule, more",
    [
        ({"only": lambda day: False}, "no events or no controls", {}),
        ({"tags": regime}, "min_events", {"min_events": 91}),
        ({"tags": regime}, "min_event_sessions", {"min_event_sessions": 16}),
        ({"tags": regime}, "min_effective_clusters", {"min_effective_clusters": 15.5}),
        ({"tags": regime}, "min_absolute_lift_points", {"min_absolute_lift": 11.0}),
        ({"tags": regime, "mfe": 200}, "min_lift_to_mfe_ratio", {}),
        ({"tags": regime, "up": lambda i, day: 40 if day < 10 else -1}, "sign_stable_thirds", {}),
        ({"tags": regime}, "min_events_per_third", {"min_events_per_third": 31}),
        ({"tags": regime}, "min_clusters_per_third", {"min_clusters_per_third": 5.5}),
        ({"tags": regime, "up": lambda i, day: -3 if i % 3 == 0 else 40}, "sign_stable_regimes", {}),
        ({"tags": regime, "up": lambda i, day: 100 if day % 5 == 0 else -5}, "the 99% clustered interval includes zero", {}),
    ],
)
def test_each_rule_alone(spark, rows, rule, more):
    r = assessed(spark, moments(**rows), criteria=replace(BAR, **more))
    assert r["failures"] == [rule] and not r["qualified"] and r["score"] is None
    assert (r["ci_low"] is None) == ("interval" not in rule)  # drawn only for what is left


def test_no_lift_and_no_interval(spark):
    rows = [(*r[:11], "elsewhere", *r[12:]) if r[0] == "" else r for r in moments(tags=regime)]
    assert assessed(spark, rows, criteria=replace(BAR, min_events=91))["failures"] == ["min_events", "no lift"]
    few = replace(BAR, min_event_sessions=5, min_effective_clusters=5, min_clusters_per_third=1)
    assert assessed(spark, moments(tags=regime, days=9), criteria=few)["failures"] == ["no clustered interval"]


def test_dropped_conditions(spark):
    # inside the condition 10, outside it -9: half of the bars each, so the widened lift is a knife edge's
    rows = moments(tags=lambda i, day: regime(i, day) | {"vwap_side": "above" if day % 2 else "below"}, up=lambda i, day: 10 if day % 2 else -9, days=30)
    r = assessed(spark, rows, "vwap_side=above")
    assert r["failures"] == ["parameter_sensitivity:vwap_side"] and [(x["family"], round(x["lift"], 6)) for x in r["perturbed"]] == [("vwap_side", 0.5)]
    fine = assessed(spark, [r for r in rows if r[7] == "above"], "or_location=inside_or&vwap_side=above")
    assert fine["qualified"] and [x["family"] for x in fine["perturbed"]] == ["or_location", "vwap_side"] and fine["score"] == pytest.approx(0.64 * fine["lift"])


def test_failures_come_in_the_order_of_the_rules(spark):
    r = assessed(spark, moments(up=lambda i, day: 2 if day < 5 else -3, mfe=90), criteria=se.Criteria())
    assert r["failures"] == ["min_events", "min_event_sessions", "min_effective_clusters", "min_absolute_lift_points", "min_lift_to_mfe_ratio", "sign_stable_thirds", "min_events_per_third", "min_clusters_per_third", "sign_stable_regimes"]


def test_winner_breaks_ties_by_clusters_then_key(spark):
    a = spark.createDataFrame([("b", True, 2.0, 5.0), ("a", True, 2.0, 5.0), ("c", True, 2.0, 6.0), ("d", False, None, 9.0)], "key string, qualified boolean, score double, effective_clusters double")
    assert se.winner(a).first()["key"] == "c" and se.winner(a.where("key <> 'c'")).first()["key"] == "a" and se.winner(a.where("key = 'd'")).count() == 0


def test_shortlist_cuts(spark):
    s = spark.createDataFrame([("a", None, "", 30, "up", float(i), "" if i % 2 else "below the economic floor") for i in range(20)], "anchor string, predecessor string, cond string, horizon int, direction string, lift double, reason string")
    assert [r["lift"] for r in se.shortlist(s, 3).collect()] == [19.0, 17.0, 15.0]
    one = spark.createDataFrame([("x", "y", "a=1&b=2", 60, "down")], "anchor string, predecessor string, cond string, horizon int, direction string")
    assert one.select(se.candidate_key().alias("k")).first()["k"] == "x|after<y>|a=1|b=2|60m|down"
