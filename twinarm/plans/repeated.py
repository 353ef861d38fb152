"""Repeated-measures analysis: frame, tests per period, eight model fits, contrasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.functions import fixed_values as v
from twinarm.functions.columns import band, pick_by, recode
from twinarm.operators.design import crossed
from twinarm.operators.joins import attach_aggregate, attach_by_text_key, centre, lookup_join, study_day
from twinarm.operators.mmrm import arm_contrasts, mmrm
from twinarm.operators.reshape import append_labelled
from twinarm.operators.scan import largest_group
from twinarm.operators.sequence import collapse, fill
from twinarm.operators.two_sample import welch
from twinarm.session import materialise

ARM, PERIOD = "arm", "period"


def outcome_rows(
    visits: DataFrame, *, order_by: Sequence[str], arm_codes: Mapping, subject: str = "ID_Sub", fill_scope: str = "subject",
    visit_codes: Mapping[str, int] = v.VISIT_CODES,
) -> DataFrame:
    """Rows of randomised subjects with a known outcome: period, outcome, arm, covariates.

    ``days`` is the subject's first known number of observed days. Gender and
    baseline are filled over the outcome rows, per subject or, as an option, down
    the whole table.
    """
    timed = visits.where(F.col("ID_Drug").isNotNull()).withColumn("visit_code", recode("Time", visit_codes))
    timed = timed.withColumn(PERIOD, band("visit_code", v.PERIOD_RANGES))
    timed = timed.withColumns({"y": pick_by(PERIOD, v.OUTCOME_BY_PERIOD), ARM: recode("Condition", arm_codes).cast("int")})
    days = {"_observed": F.min_by("days_under_obs", F.when(F.col("days_under_obs").isNotNull(), F.struct(*order_by)))}
    rows = attach_aggregate(timed.where(F.col("y").isNotNull()), timed, subject, days)
    # Counted on the source table, where it reads one column instead of running the join.
    largest = largest_group(visits, [subject])
    rows = fill(
        rows, subject=subject, order_by=order_by, cols=["Gender", "AB_Per_PreContact"], scope=fill_scope, largest=largest
    )
    return rows.select(
        F.col(subject).alias("subject"), PERIOD, "y", F.col("Gender").alias("gender"), ARM, F.col("_observed").alias("days"),
        F.col("AB_Per_PreContact").alias("baseline"),
    )


def with_study_day(
    rows: DataFrame, visits: DataFrame, dates: DataFrame, *, order_by: Sequence[str], subject: str = "ID_Sub", over: str = "rows"
) -> DataFrame:
    """Add the subject's dosing day since the first one of the trial, and its centred form.

    ``dates(ID_Drug, index_date)`` has text keys. Each subject's randomisation id is reduced
    to one row first, so no row is doubled.
    """
    ids = collapse(visits, subject=subject, order_by=order_by, cols=["ID_Drug"])
    dated = attach_by_text_key(ids, dates, key="ID_Drug", lookup_key=dates.columns[0])
    dated = study_day(dated, "index_date").select(F.col(subject).alias("subject"), "study_day")
    return centre(lookup_join(rows, dated, "subject"), "study_day", out="study_day_c", over=over, subject="subject")


def period_tests(rows: DataFrame) -> DataFrame:
    """Welch test of the outcome between arms in every period."""
    return welch(rows, "y", arm=ARM, by=[PERIOD])


def model_specs() -> dict[str, dict]:
    """The fits: which periods, which terms."""
    adjusted = ["days", "gender"]
    plain, product = [ARM, PERIOD], crossed(ARM, PERIOD)
    every, post = v.PERIODS, v.POST_PERIODS
    return {
        "Full - No Interaction": {"periods": every, "terms": [*plain, *adjusted]},
        "Full - With Interaction": {"periods": every, "terms": [*product, *adjusted]},
        "Post - No Interaction": {"periods": post, "terms": [*plain, *adjusted]},
        "Post - With Interaction": {"periods": post, "terms": [*product, *adjusted]},
        "Post Unadjusted - No Interaction": {"periods": post, "terms": plain},
        "Post Unadjusted - With Interaction": {"periods": post, "terms": product},
        "Post Adjusted - No Interaction": {"periods": post, "terms": [*plain, *adjusted, "study_day_c"]},
        "Post Adjusted - With Interaction": {
            "periods": post, "terms": [*product, "study_day_c", ("study_day_c", ARM), "baseline"],
        },
    }


def fit_models(
    rows: DataFrame, *, genders: Sequence[str] = v.GENDER_LEVELS, by: Sequence[str] = (), specs: Mapping[str, dict] | None = None,
    periods: Sequence | None = None,
) -> DataFrame:
    """Coefficient rows of every model, and the arm contrasts of those with a product term.

    The frame is written once; each fit is one pass over it.
    """
    rows, tables = materialise(rows), {}
    for name, spec in (specs or model_specs()).items():
        levels = {ARM: [0, 1], PERIOD: [p for p in spec["periods"] if periods is None or p in periods], "gender": list(genders)}
        contrasts = arm_contrasts(ARM, 1, PERIOD, levels[PERIOD]) if (ARM, PERIOD) in spec["terms"] else None
        tables[name] = mmrm(
            rows, y="y", subject="subject", period=PERIOD, period_levels=levels[PERIOD], terms=spec["terms"],
            levels=levels, by=by, contrasts=contrasts,
        )
    return append_labelled(tables)
