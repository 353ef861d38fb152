"""Time-to-event analysis: frame, curves, log-rank test, Cox tables, label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.functions.columns import event_flag, recode
from twinarm.operators.cox import cox
from twinarm.operators.reshape import append_labelled
from twinarm.operators.sequence import collapse, first_row
from twinarm.operators.survival import follow_up_time, hazard_label, kaplan_meier, logrank, risk_table
from twinarm.session import materialise


def survival_frame(
    visits: DataFrame, *, order_by: Sequence[str], arm_codes: Mapping, subject: str = "ID_Sub",
    event_rule: str = "time_present", event_from: str = "subject", no_event_offset: float = 180.0,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """One row per subject: time, event, arm, gender.

    ``event_from='subject'`` derives the event from the collapsed record, so an
    event noted on a later row counts; ``'first_row'`` looks at the first row only.
    ``exceptions(subject, scale, offset)`` replace the follow-up time of single subjects.
    """
    # Labels are recoded row by row, so that an unknown one does not hide a known one after it.
    coded = visits.withColumn("_arm", recode("Condition", arm_codes).cast("int"))
    people = collapse(coded, subject=subject, order_by=order_by, cols=["_arm", "Gender", "DAYS", "STATUS", "Integration"])
    rule = {"time": "DAYS"} if event_rule == "time_present" else {"status": "STATUS"}
    if event_from == "subject":
        people = people.withColumn("event", event_flag(event_rule, **rule))
    elif event_from == "first_row":
        first = first_row(visits.select(subject, *order_by, "DAYS", "STATUS"), subject=subject, order_by=order_by)
        flags = first.select(subject, event_flag(event_rule, **rule).alias("event"))
        people = people.join(flags, subject, "left")
    else:
        raise ValueError(f"unknown event source: {event_from}")
    timed = follow_up_time(
        people, status="STATUS", window="Integration", days="DAYS", no_event_offset=no_event_offset,
        overrides=exceptions, subject=subject,
    )
    return timed.select(
        F.col(subject).alias("subject"), "time", "event", F.col("_arm").alias("arm"),
        F.col("Gender").alias("gender"),
    )


def curves(people: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Survival curve of each arm."""
    return kaplan_meier(people.where(F.col("arm").isNotNull()), time="time", event="event", by=[*by, "arm"])


def at_risk(people: DataFrame, times: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Numbers at risk and censored per arm at the chosen times."""
    return risk_table(people.where(F.col("arm").isNotNull()), time="time", event="event", times=times, by=[*by, "arm"])


def arm_test(people: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Log-rank test between the arms."""
    return logrank(people, time="time", event="event", arm="arm", arms=[0, 1], by=by)


def cox_table(people: DataFrame, *, genders: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Hazard ratios of the arm, alone and adjusted for gender."""
    people = materialise(people)
    fit = {"time": "time", "event": "event", "by": by}
    return append_labelled({
        "Unadjusted": cox(people, terms=["arm"], **fit),
        "Adjusted for Gender": cox(people, terms=["arm", "gender"], levels={"gender": list(genders)}, **fit),
    })


def annotation(people: DataFrame) -> DataFrame:
    """Hazard ratio with interval and log-rank p as one text."""
    people = materialise(people)
    hr = cox(people, time="time", event="event", terms=["arm"]).select("hr", "hr_low", "hr_high")
    test = arm_test(people).select(F.col("p"))
    both = hr.withColumn("p", test.scalar())
    return hazard_label(both).select("hr", "hr_low", "hr_high", "p", "label")
