"""Rare binary outcome: exact test, penalised logistic models, effect size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.functions.columns import event_flag, recode
from twinarm.operators.exact import fisher_2x2
from twinarm.operators.firth import firth, odds_ratios
from twinarm.operators.reshape import append_labelled
from twinarm.operators.sequence import collapse
from twinarm.operators.survival import follow_up_time
from twinarm.operators.two_sample import hedges_g
from twinarm.session import materialise


def binary_frame(
    visits: DataFrame, *, order_by: Sequence[str], arm_codes: Mapping, subject: str = "ID_Sub",
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """One row per subject: event flag from the status, arm, raw status, windows, follow-up time.

    The label of the arm is filled before it is recoded, so the first known label
    counts, also an unknown one.
    """
    windows = ["Prescreen", "Preparation", "Drug", "Integration"]
    people = collapse(
        visits, subject=subject, order_by=order_by,
        cols=["Gender", "Ethnicity", "Race", "Condition", *windows, "DAYS", "STATUS"],
    )
    timed = follow_up_time(
        people, status="STATUS", window="Integration", days="DAYS", overrides=exceptions, subject=subject
    )
    return timed.select(
        F.col(subject).alias("subject"), F.col("Gender").alias("gender"), F.col("Ethnicity").alias("ethnicity"),
        F.col("Race").alias("race"), *windows, "time", recode("Condition", arm_codes).cast("int").alias("arm"),
        event_flag("status", status="STATUS").cast("int").alias("event"), F.col("STATUS").cast("int").alias("status"),
    )


def exact_test(people: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fisher's exact test of the event by arm."""
    return fisher_2x2(people, arm="arm", flag="event", by=by)


def penalised_models(people: DataFrame, *, response: str = "status", window: str = "Integration", by: Sequence[str] = ()) -> DataFrame:
    """Odds ratios of the arm, alone and with the observed window."""
    people = materialise(people)
    return append_labelled({
        "No Covariates": odds_ratios(firth(people, response=response, terms=["arm"], by=by)),
        "With Covariates": odds_ratios(firth(people, response=response, terms=["arm", window], by=by)),
    })


def effect_size(people: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hedges' g of the event flag between arms."""
    return hedges_g(people, "event", arm="arm", by=by)
