"""Change scores per subject and their ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.functions.columns import recode
from twinarm.operators.ranks import rank_rows
from twinarm.operators.sequence import collapse


def change_frame(
    visits: DataFrame, *, order_by: Sequence[str], arm_codes: Mapping, arm_names: Mapping[int, str], subject: str = "ID_Sub"
) -> DataFrame:
    """Change from baseline and from preparation to follow-up.

    Subjects need baseline and follow-up; a missing preparation value leaves that
    change missing. ``group_order`` follows the order of ``arm_names``.
    """
    # Labels are recoded row by row, so that an unknown one does not hide a known one after it.
    coded = visits.where(F.col("Time").isNotNull()).withColumn("_arm", recode("Condition", arm_codes).cast("int"))
    people = collapse(
        coded, subject=subject, order_by=order_by,
        cols=["_arm", "AB_Per_PreContact", "AB_Per_Preps", "AB_Per_DA_to_180"],
    )
    known = people.where(F.col("AB_Per_PreContact").isNotNull() & F.col("AB_Per_DA_to_180").isNotNull())
    arm = F.col("_arm")
    return known.select(
        F.col(subject).alias("subject"), arm.alias("arm"), recode(arm, arm_names).alias("group"),
        recode(arm, {k: i + 1 for i, k in enumerate(arm_names)}).alias("group_order"),
        (F.col("AB_Per_DA_to_180") - F.col("AB_Per_PreContact")).alias("change"),
        (F.col("AB_Per_DA_to_180") - F.col("AB_Per_Preps")).alias("prep_change"),
    )


def waterfall(changes: DataFrame, c: str = "change", by: Sequence[str] = ()) -> DataFrame:
    """Subjects numbered from the largest change down, missing last."""
    return rank_rows(changes, c, tie=["subject"], by=by)
