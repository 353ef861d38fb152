"""Two-sample tests and effect sizes from per-arm moments.

Every function makes one aggregation per stratum, combined before the shuffle,
and finishes with column arithmetic on one row per stratum. Differences are
arm 1 minus arm 0 throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinarm.functions.tails import t_multiplier, t_p
from twinarm.operators.describe import totals
from twinarm.operators.joins import lookup_join
from twinarm.operators.ranks import rank_sum
from twinarm.operators.reshape import to_long
from twinarm.operators.scan import join_groups, strata

DIRECTION = "arm1 - arm0"


def arm_moments(df: DataFrame, y: str, *, arm: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean and sample variance of ``y`` in arm 1 and arm 0."""
    parts: list[Column] = []
    for a in (1, 0):
        inside = F.when(F.col(arm) == a, F.col(y))
        parts += [
            F.count(inside).alias(f"n{a}"), F.avg(inside).alias(f"mean{a}"), F.var_samp(inside).alias(f"var{a}")
        ]
    return df.groupBy(*by).agg(*parts)


def with_welch(m: DataFrame) -> DataFrame:
    """Add difference, standard error, t and degrees of freedom to arm moments."""
    a, b = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    enough = (F.col("n1") >= 2) & (F.col("n0") >= 2) & (a + b > 0)
    m = m.withColumn("difference", F.col("mean1") - F.col("mean0")).withColumn("se", F.when(enough, F.sqrt(a + b)))
    return m.withColumn("t", F.col("difference") / F.col("se")).withColumn(
        "df", F.when(enough, (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1)))
    )


def with_welch_test(m: DataFrame, level: float = 0.95) -> DataFrame:
    """Add p and interval to ``with_welch``."""
    m = m.withColumn("p", t_p(F.col("t"), F.col("df"))).withColumn("_half", t_multiplier(F.col("df"), level) * F.col("se"))
    return m.withColumns({"ci_low": F.col("difference") - F.col("_half"), "ci_high": F.col("difference") + F.col("_half")}).drop("_half")


def with_hedges(m: DataFrame, level: float = 0.95) -> DataFrame:
    """Add the corrected standardised difference, its error, interval and magnitude word to arm moments."""
    n1, n0 = F.col("n1"), F.col("n0")
    dof = n1 + n0 - 2
    pooled = F.sqrt(((n1 - 1) * F.col("var1") + (n0 - 1) * F.col("var0")) / dof)
    m = m.withColumn("sd_pooled", F.when((n1 >= 2) & (n0 >= 2), pooled))
    d = F.when(F.col("sd_pooled") > 0, (F.col("mean1") - F.col("mean0")) / F.col("sd_pooled"))
    m = m.withColumn("cohen_d", d).withColumn("g", F.col("cohen_d") * (1 - 3 / (4 * (n1 + n0) - 9)))
    error = F.sqrt(((n1 + n0) / (n1 * n0) + F.col("g") * F.col("g") / (2 * dof)) * ((n1 + n0) / dof))
    known = F.col("g").isNotNull()
    m = m.withColumn("g_se", F.when(known, error)).withColumn("_half", t_multiplier(F.when(known, dof), level) * F.col("g_se"))
    size = F.abs("g")
    word = F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").when(known, "large")
    return m.withColumns({
        "g_low": F.col("g") - F.col("_half"), "g_high": F.col("g") + F.col("_half"), "magnitude": word
    }).drop("_half")


def with_smd(m: DataFrame) -> DataFrame:
    """Add the mean difference over the root of the averaged variances to arm moments."""
    unit = F.sqrt((F.col("var1") + F.col("var0")) / 2)
    return m.withColumn("smd", F.when(unit > 0, (F.col("mean1") - F.col("mean0")) / unit))


def welch_statistic(df: DataFrame, y: str, *, arm: str, by: Sequence[str] = ()) -> DataFrame:
    """Welch statistic and its degrees of freedom, built-in expressions only."""
    return with_welch(arm_moments(df, y, arm=arm, by=by))


def welch(df: DataFrame, y: str, *, arm: str, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Welch t-test: both means, difference, t, df, p and interval.

    With fewer than two values in an arm, or no spread at all, the statistic is NULL.
    """
    m = with_welch_test(welch_statistic(df, y, arm=arm, by=by), level)
    return m.select(
        *by, "n1", "n0", "mean1", "mean0", "difference", "se", "t", "df", "p", "ci_low", "ci_high",
        F.lit(DIRECTION).alias("direction"),
    )


def hedges_g(df: DataFrame, y: str, *, arm: str, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Standardised difference with small-sample correction, interval and magnitude word."""
    m = with_hedges(arm_moments(df, y, arm=arm, by=by), level)
    return m.select(
        *by, "n1", "n0", "mean1", "mean0", "sd_pooled", "cohen_d", "g", F.col("g_se").alias("se"),
        F.col("g_low").alias("ci_low"), F.col("g_high").alias("ci_high"), "magnitude", F.lit(DIRECTION).alias("direction"),
    )


def standardised_difference(df: DataFrame, y: str, *, arm: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean difference over the root of the averaged variances."""
    m = with_smd(arm_moments(df, y, arm=arm, by=by))
    return m.select(*by, "n1", "n0", (F.col("mean1") - F.col("mean0")).alias("difference"), "smd")


def balance_tests(df: DataFrame, y: str, *, arm: str, by: Sequence[str] = (), method: str = "normal") -> DataFrame:
    """Welch and rank-sum rows with the standardised difference; ``method`` is that of ``rank_sum``."""
    df, keys = strata(df, by)
    m = with_welch_test(with_welch(with_smd(arm_moments(df, y, arm=arm, by=keys))))
    t = m.select(*keys, F.lit("Welch t-test").alias("test"), "difference", F.col("t").alias("statistic"), "p", "smd", F.lit("t").alias("method"))
    w = rank_sum(df, y, arm=arm, by=keys, method=method).select(
        *keys, F.lit("Wilcoxon rank-sum").alias("test"), F.lit(None).cast("double").alias("difference"),
        F.col("w").alias("statistic"), "p", F.lit(None).cast("double").alias("smd"), "method",
    )
    return t.unionByName(w).select(*by, "test", "difference", "statistic", "p", "smd", "method")


def compare_totals(
    days: DataFrame, arms: DataFrame, *, subject: str, arm: str, columns: dict[str, str]
) -> DataFrame:
    """Day totals per subject and window, compared between arms: moments, t-test and g per variable.

    ``arms`` holds one row per subject; a second row is an error. All statistics
    come from one pass over the totals.
    """
    per_subject = totals(days, columns, by=[subject])
    joined = lookup_join(per_subject, arms.select(subject, arm), subject, how="inner")
    long = to_long(joined, ids=[subject, arm], columns=list(columns))
    m = with_hedges(with_welch_test(with_welch(arm_moments(long, "value", arm=arm, by=["variable"]))))
    return m.select(
        "variable", "n1", "n0", "mean1", "mean0", "difference", "se", "t", "df", "p", "ci_low", "ci_high",
        F.lit(DIRECTION).alias("direction"), F.sqrt("var1").alias("sd1"), F.sqrt("var0").alias("sd0"),
        "g", "g_low", "g_high", "magnitude",
    )


def compare_scales(scores: DataFrame, *, score: str, arm: str, by: Sequence[str]) -> DataFrame:
    """Per scale and visit: n, mean, SD of each arm, W, p and both rank-biserial forms.

    Strata where an arm is absent give no row.
    """
    usable = scores.where(F.col(arm).isNotNull())
    wide = arm_moments(usable, score, arm=arm, by=by).where((F.col("n1") > 0) & (F.col("n0") > 0))
    test = rank_sum(usable, score, arm=arm, by=by).select(*by, "w", "p", "rbc_half", "rank_biserial")
    joined = join_groups(wide, test, list(by), "inner")
    return joined.select(
        *by, "n1", "n0", "mean1", F.sqrt("var1").alias("sd1"), "mean0", F.sqrt("var0").alias("sd0"),
        "w", "p", "rbc_half", "rank_biserial",
    )
