import datetime

import pytest
from pyspark.sql import functions as F

from catalog.fixtures import ARM_CODES, study_visits
from twinarm.plans import ancillary, baseline, change, rare_event, repeated, time_to_event

FOLDER = "/root/testdata/sf0.01"
ORDER = {"order_by": ["event_id"]}
CODED = {**ORDER, "arm_codes": ARM_CODES}


@pytest.fixture(scope="module")
def visits(spark):
    return study_visits(spark, FOLDER).cache()


def test_demographics(spark, rows, visits):
    exceptions = spark.createDataFrame([(3, "Pansexual")], "ID_Sub int, override_value string")
    people = baseline.demographics(visits, arms=["Active", "Control"], orientation_exceptions=exceptions, **ORDER)
    found = rows(people, "ID_Sub")
    assert len(found) == visits.select("ID_Sub").distinct().count()
    assert found[3]["orientation"] == "Pansexual" and {r["race"] for r in found} <= {"White", "Black", None}
    strict = baseline.demographics(visits, arms=["Active", "Control"], race_other=None, **ORDER)
    assert {r["race"] for r in rows(strict)} <= {"White", None}
    table = rows(baseline.demographic_table(people, arms=["Active", "Control"]))
    assert {r["variable"] for r in table} >= {"gender", "age", "education"}
    for variable in ("gender", "education"):
        for arm in ("Active", "Control"):
            part = [r for r in table if r["variable"] == variable and r["arm"] == arm]
            assert sum(r["n"] for r in part) == part[0]["n_known"]


def test_use_history(rows, visits):
    people = baseline.use_history(visits, arms=["Active", "Control"], prior_use=[1003], **ORDER)
    found = {r["ID_Sub"]: r for r in rows(people)}
    assert found[3]["prior_hallucinogen"] == "Yes" if 3 in found else True
    assert {r["tobacco_daily"] for r in found.values()} <= {"Yes", "No"}
    table = rows(baseline.use_history_table(people, arms=["Active", "Control"]))
    assert {r["level"] for r in table if r["variable"] == "any_cannabis"} == {"Yes"}


def small(spark):
    data = [
        (1, 1, 11, "Active", "Prescreening Assessment 1", "Female", 10.0, None, None, 40.0),
        (1, 2, 11, "Active", "Follow-up 1", None, None, 30.0, None, None),
        (1, 3, 11, "Active", "180-day Assessment", None, None, None, 50.0, None),
        (2, 4, 12, "Control", "Prescreening Assessment 1", None, None, None, None, None),
        (2, 5, 12, "Control", "Follow-up 1", "Male", 5.0, 20.0, None, None),
        (2, 6, 12, "Control", "180-day Assessment", None, None, None, 25.0, 33.0),
        (3, 7, None, "Control", "Follow-up 1", "Male", 1.0, 9.0, None, 1.0),
    ]
    df = spark.createDataFrame(
        data, "ID_Sub int, event_id int, ID_Drug int, Condition string, Time string, Gender string, AB_Per_PreContact double, "
        "AB_Per_PostDrugTX double, AB_Per_Follow_Ups double, days_under_obs double")
    return df.withColumns({"AB_Per_PreTX": F.lit(None).cast("double"), "AB_Per_Preps": F.lit(None).cast("double")})


def test_outcome_rows(spark, rows):
    found = rows(repeated.outcome_rows(small(spark), **CODED), "subject", "period")
    assert [(r["subject"], r["period"], r["y"], r["gender"], r["days"], r["baseline"]) for r in found] == [
        (1, 1, 10.0, "Female", 40.0, 10.0), (1, 4, 30.0, "Female", 40.0, 10.0), (1, 6, 50.0, "Female", 40.0, 10.0),
        (2, 4, 20.0, "Male", 33.0, 5.0), (2, 6, 25.0, "Male", 33.0, 5.0)]


def test_study_days_do_not_double_rows(spark, rows):
    dates = spark.createDataFrame([("11", datetime.date(2020, 3, 1)), ("12", datetime.date(2020, 3, 11))], "k string, index_date date")
    base = repeated.outcome_rows(small(spark), **CODED)
    found = rows(repeated.with_study_day(base, small(spark), dates, order_by=["event_id"]), "subject", "period")
    assert [r["study_day"] for r in found] == [1, 1, 1, 11, 11]
    assert found[0]["study_day_c"] == pytest.approx(1 - 5.0)
    by_subject = rows(repeated.with_study_day(base, small(spark), dates, order_by=["event_id"], over="subjects"), "subject", "period")
    assert by_subject[0]["study_day_c"] == pytest.approx(1 - 6.0)


def survival_visits(spark):
    data = [(1, 1, "Active", None, None, None, 30.0), (1, 2, "Active", "Female", 8.0, 0, None),
            (2, 3, "Control", "Male", None, 1, 20.0), (3, 4, "Control", "Male", None, 0, 20.0)]
    return spark.createDataFrame(data, "ID_Sub int, event_id int, Condition string, Gender string, DAYS double, STATUS int, Integration double")


def test_event_on_a_later_row_counts(spark, rows):
    found = rows(time_to_event.survival_frame(survival_visits(spark), **CODED), "subject")
    assert [(r["event"], r["time"]) for r in found] == [(1, 9.0), (0, 200.0), (0, None)]
    first = rows(time_to_event.survival_frame(survival_visits(spark), event_from="first_row", **CODED), "subject")
    assert [r["event"] for r in first] == [0, 0, 0]
    status = rows(time_to_event.survival_frame(survival_visits(spark), event_rule="status", **CODED), "subject")
    assert [int(r["event"]) for r in status] == [1, 0, 1]


def test_survival_outputs(rows, visits):
    people = time_to_event.survival_frame(visits, **CODED).cache()
    curve = rows(time_to_event.curves(people), "arm", "time")
    for arm in (0, 1):
        steps = [r["survival"] for r in curve if r["arm"] == arm]
        assert all(a >= b - 1e-12 for a, b in zip(steps, steps[1:])) and 0 <= min(steps) <= max(steps) <= 1
    assert len(rows(time_to_event.at_risk(people, [0, 30, 90]))) == 6
    assert {r["model"] for r in rows(time_to_event.cox_table(people, genders=["Male", "Female"]))} == {"Unadjusted", "Adjusted for Gender"}
    (label,) = rows(time_to_event.annotation(people))
    assert label["label"].startswith("HR = ") and "Log-rank p = " in label["label"]


def test_rare_event(rows, visits):
    people = rare_event.binary_frame(visits, **CODED).cache()
    (test,) = rows(rare_event.exact_test(people))
    assert test["n00"] + test["n01"] + test["n10"] + test["n11"] == people.where("event is not null and arm is not null").count()
    assert 0 < test["p"] <= 1
    (g,) = rows(rare_event.effect_size(people))
    assert g["ci_low"] < g["g"] < g["ci_high"]
    assert {r["term"] for r in rows(rare_event.penalised_models(people))} == {"(Intercept)", "arm", "Integration"}


def test_change_ranking(rows, visits):
    changes = change.change_frame(visits, arm_names={1: "Active", 0: "Control"}, **CODED)
    ranked = rows(change.waterfall(changes, "prep_change"), "rank")
    known = [r["prep_change"] for r in ranked if r["prep_change"] is not None]
    assert known == sorted(known, reverse=True) and [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert {(r["group"], r["group_order"]) for r in ranked} == {("Active", 1), ("Control", 2)}


def test_ancillary(spark, rows, visits):
    assert {r["variable"] for r in rows(ancillary.observed_days(visits, **CODED))} == set(ancillary.WINDOWS)
    scores = ancillary.scale_frame(visits, arm_codes=ARM_CODES).cache()
    assert {r["scale"] for r in rows(scores)} == {"Cred", "Exp"}
    assert all(r["n1"] > 0 and r["n0"] > 0 for r in rows(ancillary.scale_tests(scores)))
    points, lines = ancillary.scale_plots(scores)
    assert points.count() == scores.count() and lines.count() == scores.select("scale", "visit", "arm").distinct().count()
    days = spark.createDataFrame([(i % 2, i) for i in range(20)], "arm int, study_day int")
    assert [r["n"] for r in rows(ancillary.study_day_summary(days), "arm")] == [10, 10]
    assert len(rows(ancillary.study_day_balance(days))) == 2


def test_repeated_models(spark, rows):
    data = [(s, p, 10.0 + s % 5 + p + (s % 2) * 2 + ((s * 7 + p * 3) % 11), "Female" if s % 3 else "Male", s % 2, 30.0 + s % 4, 5.0 + s % 6, float(s % 9 - 4))
            for s in range(40) for p in (1, 2, 3, 4, 5, 6) if (s + p) % 7]
    df = spark.createDataFrame(data, "subject int, period int, y double, gender string, arm int, days double, baseline double, study_day_c double")
    out = rows(repeated.fit_models(df))
    assert {r["model"] for r in out} == set(repeated.model_specs())
    last = [r["term"] for r in out if r["model"] == "Post Adjusted - With Interaction" and r["kind"] == "coefficient"]
    assert last == ["(Intercept)", "arm[1]", "period[5]", "period[6]", "arm[1]:period[5]", "arm[1]:period[6]", "study_day_c",
                    "study_day_c:arm[1]", "baseline"]
    assert len([r for r in out if r["kind"] == "contrast" and r["model"] == "Post - With Interaction"]) == 3
    assert len(rows(repeated.period_tests(df))) == 6
