"""Further comparisons: dosing day, observed days, rating scales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.functions import fixed_values as v
from twinarm.functions.columns import recode
from twinarm.operators.describe import group_stats, scale_scores
from twinarm.operators.ranks import normal_plot, normal_plot_line
from twinarm.operators.reshape import items_to_long
from twinarm.operators.sequence import collapse
from twinarm.operators.two_sample import balance_tests, compare_scales, compare_totals

WINDOWS = {"Days_Prescreen": "Prescreen", "Days_Preparation": "Preparation", "Days_Integration": "Integration"}


def study_day_summary(people: DataFrame) -> DataFrame:
    """Rows, mean, SD, median and IQR of the study day per arm."""
    known = people.where(F.col("arm").isNotNull() & F.col("study_day").isNotNull())
    return group_stats(known, "study_day", by=["arm"])


def study_day_balance(people: DataFrame) -> DataFrame:
    """Welch and rank-sum test of the study day with the standardised difference."""
    return balance_tests(people, "study_day", arm="arm", method="exact_if_small")


def observed_days(visits: DataFrame, *, order_by: Sequence[str], arm_codes: Mapping, subject: str = "ID_Sub") -> DataFrame:
    """Observed days per window compared between arms."""
    arms = collapse(visits, subject=subject, order_by=order_by, cols=["Condition"]).select(
        subject, recode("Condition", arm_codes).cast("int").alias("arm")
    )
    return compare_totals(visits, arms, subject=subject, arm="arm", columns=WINDOWS)


def scale_frame(visits: DataFrame, *, arm_codes: Mapping, subject: str = "ID_Sub") -> DataFrame:
    """Mean item score per subject, visit and scale."""
    long = items_to_long(
        visits.withColumn("arm", recode("Condition", arm_codes).cast("int")), ids=[subject, "arm", "Time"],
        columns=v.SCALE_ITEMS, pattern=v.SCALE_PATTERN, names=["scale", "item"],
    )
    scores = scale_scores(long, by=[subject, "arm", "Time", "scale"])
    return scores.withColumnsRenamed({subject: "subject", "Time": "visit"})


def scale_tests(scores: DataFrame) -> DataFrame:
    """Rank-sum comparison of the arms per scale and visit."""
    return compare_scales(scores, score="score_mean", arm="arm", by=["scale", "visit"])


def scale_plots(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normal quantile points and lines per scale, visit and arm."""
    groups = ["scale", "visit", "arm"]
    return (
        normal_plot(scores, "score_mean", tie=["subject"], by=groups),
        normal_plot_line(scores, "score_mean", by=groups),
    )
