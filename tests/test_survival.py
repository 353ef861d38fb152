import math

import pytest
from pyspark.sql import functions as F

from twinarm.operators import survival


@pytest.fixture
def four(spark):
    return spark.createDataFrame([(1, 2.0, 1, 1), (2, 3.0, 1, 1), (3, 3.0, 0, 0), (4, 5.0, 1, 0)], "id int, t double, e int, arm int")


ARGS = {"time": "t", "event": "e"}


def test_curve_by_hand(four, rows):
    found = rows(survival.kaplan_meier(four, **ARGS), "time")
    assert [(r["time"], r["at_risk"], r["events"], r["censored"]) for r in found] == [(2.0, 4, 1, 0), (3.0, 3, 1, 1), (5.0, 1, 1, 0)]
    assert [r["survival"] for r in found] == pytest.approx([0.75, 0.5, 0.0])
    assert found[0]["std_error"] == pytest.approx(0.75 * math.sqrt(1 / 12))
    assert found[2]["std_error"] is None and found[2]["ci_low"] is None
    assert all(r["ci_high"] <= 1 for r in found[:2])


def test_all_censored_and_all_at_once(spark, rows):
    none = spark.createDataFrame([(1.0, 0), (2.0, 0)], "t double, e int")
    assert {r["survival"] for r in rows(survival.kaplan_meier(none, **ARGS))} == {1.0}
    once = spark.createDataFrame([(4.0, 1, 1), (4.0, 1, 0)], "t double, e int, arm int")
    assert [r["survival"] for r in rows(survival.kaplan_meier(once, **ARGS))] == [0.0]
    (test,) = rows(survival.logrank(once, arm="arm", arms=[0, 1], **ARGS))
    assert test["chi_square"] is None and test["p"] is None


def test_wrong_event_codes_are_errors(spark):
    for bad in ((1.0, 2), (-1.0, 1)):
        with pytest.raises(Exception, match="time must be"):
            survival.survival_pair(spark.createDataFrame([bad], "t double, e int"), **ARGS).collect()
    assert survival.survival_pair(spark.createDataFrame([(None, 1), (1.0, None)], "t double, e int"), **ARGS).count() == 0


def test_logrank_by_hand(four, rows):
    (r,) = rows(survival.logrank(four, arm="arm", arms=[0, 1], **ARGS))
    # times 2, 3, 5 with one event each: expected in arm 1 is 2/4 + 1/3 + 0
    assert r["observed_1"] == 2 and r["expected_1"] == pytest.approx(0.5 + 1 / 3)
    variance = 0.25 + 2 / 9
    assert r["chi_square"] == pytest.approx((2 - 5 / 6) ** 2 / variance)
    (swapped,) = rows(survival.logrank(four.withColumn("arm", 1 - F.col("arm")), arm="arm", arms=[0, 1], **ARGS))
    assert swapped["chi_square"] == pytest.approx(r["chi_square"])


def test_many_arms_agree_with_two(four, rows):
    three = survival.logrank(four, arm="arm", arms=[0, 1, 2], **ARGS)
    (r,) = rows(three)
    assert r["df"] == 1 and r["chi_square"] == pytest.approx(rows(survival.logrank(four, arm="arm", arms=[0, 1], **ARGS))[0]["chi_square"])


def test_risk_table(four, rows):
    found = rows(survival.risk_table(four, times=[0, 3, 9], **ARGS), "time")
    assert [(r["at_risk"], r["events_so_far"], r["censored_so_far"]) for r in found] == [(4, 0, 0), (3, 2, 1), (0, 3, 1)]


def test_follow_up_times(spark, rows):
    df = spark.createDataFrame(
        [(1, 1, 30.0, None), (2, 0, 30.0, 12.0), (3, 0, 30.0, None), (4, None, 30.0, 5.0), (5, None, None, None), (6, 1, 20.0, 7.0)],
        "id int, status int, win double, days double")
    exceptions = spark.createDataFrame([(3, 1.0, 91.0), (5, 0.0, 0.0), (6, 0.0, 1.0)], "id int, scale double, offset double")
    out = survival.follow_up_time(df, status="status", window="win", days="days", no_event_offset=180.0, overrides=exceptions, subject="id")
    # a subject without event keeps the first rule even with an exception
    assert [r["time"] for r in rows(out, "id")] == [210.0, 13.0, 121.0, 6.0, 0.0, 200.0]
    plain = survival.follow_up_time(df, status="status", window="win", days="days")
    assert [r["time"] for r in rows(plain, "id")] == [30.0, 13.0, None, 6.0, None, 20.0]


def test_label(spark):
    df = spark.createDataFrame([(0.5, 0.25, 1.0, 0.04321)], "hr double, hr_low double, hr_high double, p double")
    assert survival.hazard_label(df).first()["label"] == "HR = 0.50 (95% CI: 0.25–1.00)\nLog-rank p = 0.0432"
