"""Baseline summary tables by arm: demographics and history of use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.functions import fixed_values as v
from twinarm.functions.columns import (
    among_users, any_use, band, collapse_with_bands, exactly, is_in, keep_levels, recode, to_number, two_flags, yes_no,
)
from twinarm.operators.describe import Categorical, Continuous, summary_table
from twinarm.operators.scan import largest_group
from twinarm.operators.sequence import collapse, fill, first_row
from twinarm.sources.tables import apply_overrides


def demographics(
    visits: DataFrame, *, order_by: Sequence[str], arms: Sequence[str], subject: str = "ID_Sub",
    orientation_exceptions: DataFrame | None = None, race_groups: Mapping[str, str] = v.RACE_GROUPS,
    race_other: str | None = None,
) -> DataFrame:
    """One row per randomised subject with the collapsed demographic variables.

    ``orientation_exceptions(subject, override_value)`` come before the label
    groups. A race that is not in ``race_groups`` is missing, or
    becomes ``race_other``.
    """
    people = collapse(
        visits.where(F.col("ID_Drug").isNotNull() & F.col("Condition").isNotNull()), subject=subject, order_by=order_by,
        cols=["Condition", "Gender", "Race", "Age", "SexOr", "Marital", "OccStatus", "Income", "Degree", "EduYears",
              "LivSit", "Veteran"],
    )
    groups = recode("SexOr", v.ORIENTATION_GROUPS)
    if orientation_exceptions is None:
        people = people.withColumn("orientation", groups)
    else:
        people = apply_overrides(
            people, orientation_exceptions, key=[subject], out="orientation", rules=[], default=groups
        )
    return people.select(
        subject, keep_levels("Condition", arms).alias("arm"),
        keep_levels("Gender", v.GENDER_LEVELS).alias("gender"),
        recode("Race", race_groups, race_other).alias("race"),
        F.col("Age").cast("double").alias("age"), "orientation",
        keep_levels("Marital", v.MARITAL_LEVELS).alias("marital"),
        recode("OccStatus", v.EMPLOYMENT_GROUPS).alias("employment"),
        keep_levels("Income", v.INCOME_LEVELS).alias("income"),
        collapse_with_bands("Degree", v.EDUCATION_GROUPS, "EduYears", v.EDUCATION_YEARS).alias("education"),
        recode("LivSit", v.HOUSING_GROUPS).alias("housing"),
        keep_levels("Veteran", v.YES_NO_LEVELS).alias("veteran"),
    )


def demographic_variables() -> dict[str, Categorical | Continuous]:
    """The rows of the demographic table."""
    levels = {
        "gender": v.GENDER_LEVELS, "race": v.RACE_LEVELS, "age": None, "orientation": v.ORIENTATION_LEVELS,
        "marital": v.MARITAL_LEVELS, "employment": v.EMPLOYMENT_LEVELS, "income": v.INCOME_LEVELS,
        "education": v.EDUCATION_LEVELS, "housing": v.HOUSING_LEVELS, "veteran": v.YES_NO_LEVELS,
    }
    return {
        n: Continuous(v.DEMOGRAPHIC_LABELS[n], digits=0) if ls is None else Categorical(
            tuple(ls), v.DEMOGRAPHIC_LABELS[n], ("Yes",) if n == "veteran" else None
        )
        for n, ls in levels.items()
    }


def demographic_table(people: DataFrame, *, arms: Sequence[str], kind: int = 7) -> DataFrame:
    """Demographics by arm with exact and rank-sum p-values."""
    return summary_table(people, demographic_variables(), arm="arm", arms=arms, interval="%s (%s, %s)", kind=kind, tests=True)


def use_history(
    visits: DataFrame, *, order_by: Sequence[str], arms: Sequence[str], subject: str = "ID_Sub",
    prior_use: Sequence[int] = (), visit_codes: Mapping[str, int] = v.VISIT_CODES,
) -> DataFrame:
    """One row per randomised subject at the intake visit with the derived history variables.

    ``prior_use`` lists the randomisation ids with earlier hallucinogen use.
    """
    timed = visits.where(F.col("ID_Drug").isNotNull()).withColumn("visit_code", recode("Time", visit_codes))
    timed = timed.withColumn("period", band("visit_code", v.PERIOD_RANGES)).where(F.col("period").isNotNull())
    timed = timed.withColumn("Condition", keep_levels("Condition", arms))
    history = ["Condition", "Age_First_Use", "Age_Reg_Use", "Quit_Attempts", "Quit_Long", "Treatment"]
    used = ["Days_Crack", "Days_Cocaine", "Per_Tob", "Per_Heavy_GenSpec", "Per_Can", "Per_Dep", "Per_Stim", "Per_Opi", "Per_Her"]
    # Only these columns travel: the first row below is taken as one record.
    timed = timed.select(subject, *[o for o in order_by if o != subject], "ID_Drug", "period", *history, *used)
    filled = fill(
        timed, subject=subject, order_by=order_by, cols=history, largest=largest_group(visits, [subject])
    )
    intake = first_row(filled.where(F.col("period") == 1), subject=subject, order_by=order_by)
    return intake.select(
        subject, F.col("Condition").alias("arm"),
        two_flags("Days_Crack", "Days_Cocaine", "Both smoking and snorting", "Smoking", "Snorting").alias("route"),
        to_number("Age_First_Use").alias("age_first_use"), to_number("Age_Reg_Use").alias("age_regular_use"),
        to_number("Quit_Attempts").alias("quit_attempts"), recode("Treatment", v.YES_NO_CODES).alias("treatment"),
        to_number("Quit_Long").alias("quit_longest"), yes_no(exactly("Per_Tob", 100)).alias("tobacco_daily"),
        yes_no(any_use("Per_Heavy_GenSpec")).alias("any_heavy_drinking"),
        among_users("Per_Heavy_GenSpec").alias("heavy_drinking_pct"),
        yes_no(any_use("Per_Can")).alias("any_cannabis"), among_users("Per_Can").alias("cannabis_pct"),
        yes_no(any_use("Per_Dep")).alias("any_depressant"), yes_no(any_use("Per_Stim")).alias("any_stimulant"),
        yes_no(any_use("Per_Opi")).alias("any_opioid"), yes_no(any_use("Per_Her")).alias("any_heroin"),
        yes_no(is_in("ID_Drug", prior_use) if prior_use else F.lit(False)).alias("prior_hallucinogen"),
    )


def use_history_variables() -> dict[str, Categorical | Continuous]:
    """The rows of the table of use; Yes/No variables show their Yes row."""
    numbers = {"age_first_use", "age_regular_use", "quit_attempts", "quit_longest", "heavy_drinking_pct", "cannabis_pct"}
    spec = {}
    for name, label in v.USE_HISTORY_LABELS.items():
        if name in numbers:
            spec[name] = Continuous(label, digits=1)
        elif name == "route":
            spec[name] = Categorical(tuple(v.ROUTE_LEVELS), label)
        else:
            spec[name] = Categorical(tuple(v.YES_NO_LEVELS), label, ("Yes",))
    return spec


def use_history_table(people: DataFrame, *, arms: Sequence[str], kind: int = 7) -> DataFrame:
    """History of use by arm."""
    return summary_table(people, use_history_variables(), arm="arm", arms=arms, interval="%s (%s-%s)", kind=kind)
