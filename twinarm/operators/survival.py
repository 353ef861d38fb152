"""Time-to-event operators on counts per distinct time.

Subjects are reduced to event and censoring counts per (group, time) before any
ordering, and the running sums over times are scanned in range chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinarm.functions.columns import fixed
from twinarm.functions.tails import chi2_p
from twinarm.operators.scan import range_chunks, running_sums, strata
from twinarm.sources.tables import apply_overrides

Z975 = 1.959963984540054  # normal quantile of the 95% interval


def follow_up_time(
    df: DataFrame, *, status: str, window: str, days: str, no_event: object = 1, no_event_offset: float = 0.0,
    event_offset: float = 1.0, overrides: DataFrame | None = None, subject: str | None = None, out: str = "time",
) -> DataFrame:
    """Follow-up time of each subject.

    Without an event: the observed window plus ``no_event_offset``. Then per-subject
    exceptions, as ``scale * window + offset`` from ``overrides(subject, scale,
    offset)``. Everyone else: recorded days plus ``event_offset``, NULL if unknown.
    """
    rules = [(F.coalesce(F.col(status) == no_event, F.lit(False)), F.col(window) + no_event_offset)]
    default = F.col(days) + event_offset
    if overrides is None:
        return df.withColumn(out, F.when(*rules[0]).otherwise(default))
    known = overrides.select(subject, F.col("scale").alias("_scale"), F.col("offset").alias("_offset"))
    value = F.when(F.col("_scale") == 0, F.col("_offset")).otherwise(F.col("_scale") * F.col(window) + F.col("_offset"))
    return apply_overrides(df, known, key=[subject], out=out, rules=rules, default=default, value=value, position=1)


def survival_pair(df: DataFrame, *, time: str, event: str) -> DataFrame:
    """Rows with a known time and event; a negative time or another event code is an error."""
    wrong = (F.col(time) < 0) | ~F.col(event).isin(0, 1)
    checked = F.when(wrong, F.raise_error(F.lit("time must be >= 0 and event 0 or 1"))).otherwise(F.col(event))
    known = df.where(F.col(time).isNotNull() & F.col(event).isNotNull())
    return known.withColumns({time: F.col(time).cast("double"), event: checked.cast("int")})


def kaplan_meier(df: DataFrame, *, time: str, event: str, by: Sequence[str] = (), z: float = Z975) -> DataFrame:
    """Survival curve per group: at risk, events, censored, survival, standard error, interval.

    The interval is on the log scale and ends at 1. Once everybody at risk has
    the event, survival is 0 and the error and interval are NULL.
    """
    df, keys = strata(survival_pair(df, time=time, event=event), by)
    counts = df.groupBy(*keys, F.col(time).alias("time")).agg(
        F.sum(event).alias("events"), F.sum(1 - F.col(event)).alias("censored")
    )
    chunked = range_chunks(counts, [*keys, "time"])
    left = F.col("events") + F.col("censored")
    ran = running_sums(chunked, by=keys, order_by=["time"], sums={"_gone": left}, totals={"_all_rows": left})
    ran = ran.withColumn("at_risk", F.col("_all_rows") - F.col("_gone") + left)
    d, n = F.col("events"), F.col("at_risk")
    ended = F.when(d == n, 1).otherwise(0)
    steps = running_sums(
        ran, by=keys, order_by=["time"],
        sums={
            "_log": F.when(d < n, F.log1p(-d / n)).otherwise(0.0),
            "_green": F.when(d < n, d / (n.cast("double") * (n - d))).otherwise(0.0),
            "_ended": ended,
        },
    )
    alive = F.col("_ended") == 0
    s = F.when(alive, F.exp("_log")).otherwise(0.0)
    half = z * F.sqrt("_green")
    return steps.select(
        *by, "time", "at_risk", "events", "censored", s.alias("survival"),
        F.when(alive, F.exp("_log") * F.sqrt("_green")).alias("std_error"),
        F.when(alive, F.exp(F.col("_log") - half)).alias("ci_low"),
        F.when(alive, F.least(F.exp(F.col("_log") + half), F.lit(1.0))).alias("ci_high"),
    )


def risk_table(df: DataFrame, *, time: str, event: str, times: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """At risk at, and events and censored up to, each listed time. One pass, no ordering."""
    df = survival_pair(df, time=time, event=event)
    t, e = F.col(time), F.col(event)
    cells = []
    for i, at in enumerate(times):
        cells += [
            F.count(F.when(t >= at, 1)).alias(f"_r{i}"), F.count(F.when((t <= at) & (e == 1), 1)).alias(f"_e{i}"),
            F.count(F.when((t <= at) & (e == 0), 1)).alias(f"_c{i}"),
        ]
    wide = df.groupBy(*by).agg(*cells)
    rows = F.array(*[
        F.struct(
            F.lit(float(at)).alias("time"), F.col(f"_r{i}").alias("at_risk"), F.col(f"_e{i}").alias("events_so_far"),
            F.col(f"_c{i}").alias("censored_so_far"),
        )
        for i, at in enumerate(times)
    ])
    return wide.select(*by, F.inline(rows))


def logrank(df: DataFrame, *, time: str, event: str, arm: str, arms: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Log-rank test over the listed arms: observed, expected, chi-square, df, p per stratum.

    Only sums over times come together per stratum: one row with k expected
    counts and a k x k covariance.
    """
    arms = list(arms)
    df, keys = strata(survival_pair(df.where(F.col(arm).isin(arms)), time=time, event=event), by)
    inside = [F.when(F.col(arm) == a, 1).otherwise(0) for a in arms]
    counts = df.groupBy(*keys, F.col(time).alias("time")).agg(
        *[F.sum(inside[i]).alias(f"_m{i}") for i in range(len(arms))],
        *[F.sum(inside[i] * F.col(event)).alias(f"_d{i}") for i in range(len(arms))],
    )
    chunked = range_chunks(counts, [*keys, "time"])
    each = range(len(arms))
    ran = running_sums(
        chunked, by=keys, order_by=["time"], sums={f"_g{i}": f"_m{i}" for i in each}, totals={f"_w{i}": f"_m{i}" for i in each})
    risk = [(F.col(f"_w{i}") - F.col(f"_g{i}") + F.col(f"_m{i}")).cast("double") for i in range(len(arms))]
    n, d = _add(risk), _add([F.col(f"_d{i}") for i in range(len(arms))])
    ran = ran.select(*keys, *[risk[i].alias(f"_n{i}") for i in range(len(arms))], *[f"_d{i}" for i in range(len(arms))],
                     n.alias("_n"), d.alias("_d")).where("_d > 0")
    share = [F.col(f"_n{i}") / F.col("_n") for i in range(len(arms))]
    spread = F.when(F.col("_n") > 1, F.col("_d") * (F.col("_n") - F.col("_d")) / (F.col("_n") - 1)).otherwise(0.0)
    sums = [F.sum(f"_d{i}").alias(f"observed_{a}") for i, a in enumerate(arms)]
    sums += [F.sum(F.col("_d") * share[i]).alias(f"expected_{a}") for i, a in enumerate(arms)]
    for i in range(len(arms)):
        for j in range(i, len(arms)):
            same = share[i] if i == j else F.lit(0.0)
            sums.append(F.sum(spread * (same - share[i] * share[j])).alias(f"_v{i}_{j}"))
    table = ran.groupBy(*keys).agg(*sums)
    if len(arms) == 2:
        gap = F.col(f"observed_{arms[1]}") - F.col(f"expected_{arms[1]}")
        table = table.withColumn("chi_square", F.when(F.col("_v1_1") > 0, gap * gap / F.col("_v1_1"))).withColumn(
            "df", F.lit(1)
        )
    else:
        table = _quadratic_form(table, arms)
    named = [f"{w}_{a}" for w in ("observed", "expected") for a in arms]
    return table.select(*by, *named, "chi_square", "df", chi2_p(F.col("chi_square"), F.col("df")).alias("p"))


def _add(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _quadratic_form(table: DataFrame, arms: list) -> DataFrame:
    """Chi-square of more than two arms: gap' V^- gap for each one-row stratum."""
    k = len(arms)
    gaps = F.array(*[F.col(f"observed_{a}") - F.col(f"expected_{a}") for a in arms])
    cells = F.array(*[F.col(f"_v{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])

    @F.pandas_udf("chi double, df int")
    def solve(gap: pd.Series, cov: pd.Series) -> pd.DataFrame:
        rows = []
        for g, v in zip(gap, cov):
            g, v = np.asarray(g, float), np.asarray(v, float).reshape(k, k)
            used = np.diag(v) > 0
            rank = int(used.sum()) - 1
            chi = None
            if rank > 0:
                keep = np.flatnonzero(used)[1:]
                chi = float(g[keep] @ np.linalg.solve(v[np.ix_(keep, keep)], g[keep]))
            rows.append((chi, max(rank, 0)))
        return pd.DataFrame(rows, columns=["chi", "df"])

    out = table.withColumn("_q", solve(gaps, cells))
    return out.withColumn("chi_square", F.col("_q.chi")).withColumn("df", F.col("_q.df"))


def hazard_label(table: DataFrame, *, hr: str = "hr", low: str = "hr_low", high: str = "hr_high", p: str = "p", out: str = "label") -> DataFrame:
    """Text of a hazard ratio with its interval and a log-rank p-value."""
    text = F.concat(
        F.lit("HR = "), fixed(F.bround(hr, 2), 2), F.lit(" (95% CI: "), fixed(F.bround(low, 2), 2), F.lit("–"),
        fixed(F.bround(high, 2), 2), F.lit(")\nLog-rank p = "), fixed(p, 4),
    )
    return table.withColumn(out, text)
