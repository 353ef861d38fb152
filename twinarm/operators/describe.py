"""Counts, moments, order statistics and the summary table by arm."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinarm.functions.columns import fixed, p_text
from twinarm.operators.exact import fisher_levels
from twinarm.operators.joins import spread_join
from twinarm.operators.ranks import moments, quantiles, rank_sum, value_counts
from twinarm.operators.reshape import to_long
from twinarm.operators.scan import join_groups, strata
from twinarm.session import materialise


def count_rows(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group; a missing value is a group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, levels: Mapping[object, str], *, keep_missing: bool = True) -> DataFrame:
    """Counts of ``row`` by the listed levels of ``column``, one output column each.

    With ``keep_missing`` a missing row value is a row and missing column values
    are counted in ``n_missing``; otherwise both are left out.
    """
    parts = [F.count(F.when(F.col(column) == v, 1)).alias(f"n_{name}") for v, name in levels.items()]
    if keep_missing:
        parts.append(F.count(F.when(F.col(column).isNull(), 1)).alias("n_missing"))
    else:
        df = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    return df.groupBy(row).agg(*parts)


def missing_counts(df: DataFrame, cols: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """Rows and missing values of each column."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"missing_{c}") for c in cols]
    )


def five_numbers(df: DataFrame, c: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, maximum, mean, and the number of missing values."""
    df, keys = strata(df, by)
    counts = value_counts(df, c, keys)
    q = quantiles(df, c, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=keys, counts=counts)
    both = join_groups(moments(counts, keys), q, keys)
    return both.select(*by, "minimum", "q1", "median", "mean", "q3", "maximum", (F.col("n") - F.col("n_nonnull")).alias("n_missing"))


def group_stats(df: DataFrame, c: str, *, by: Sequence[str] = (), kind: int = 7) -> DataFrame:
    """Rows, known values, mean, SD, median and interquartile range per group."""
    df, keys = strata(df, by)
    counts = value_counts(df, c, keys)
    q = quantiles(df, c, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=keys, kind=kind, counts=counts)
    both = join_groups(moments(counts, keys), q, keys)
    return both.select(*by, "n", "n_nonnull", "mean", "sd", "median", (F.col("q3") - F.col("q1")).alias("iqr"))


def group_moments(df: DataFrame, c: str, *, by: Sequence[str]) -> DataFrame:
    """Rows, known values, mean and SD of one column per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(c).alias("n_nonnull"),
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
    )


def arm_means(df: DataFrame, y: str, *, arm: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean within each arm and their difference (arm 1 minus arm 0)."""
    out = df.groupBy(*by).agg(
        F.avg(F.when(F.col(arm) == 1, F.col(y))).alias("mean1"), F.avg(F.when(F.col(arm) == 0, F.col(y))).alias("mean0")
    )
    return out.withColumn("difference", F.col("mean1") - F.col("mean0"))


def totals(df: DataFrame, cols: Mapping[str, str], *, by: Sequence[str]) -> DataFrame:
    """Sums that skip missing values; a sum of nothing is 0."""
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in cols.items()])


def scale_scores(items: DataFrame, *, by: Sequence[str], score: str = "score", out: str = "score_mean") -> DataFrame:
    """Mean of the known item scores; groups without any are left out."""
    return items.groupBy(*by).agg(F.avg(score).alias(out)).where(F.col(out).isNotNull())


def with_both_arms(df: DataFrame, *, arm: str, by: Sequence[str], least: int = 2) -> DataFrame:
    """Rows of the strata that hold at least ``least`` different arms."""
    # As a struct, a missing stratum is one like any other.
    marked = df.withColumn("_stratum", F.struct(*[F.col(k) for k in by]))
    enough = marked.groupBy("_stratum").agg(F.count_distinct(arm).alias("_arms")).where(F.col("_arms") >= least).select("_stratum")
    return spread_join(marked, enough, ["_stratum"], "left_semi").drop("_stratum")


@dataclass(frozen=True)
class Categorical:
    """A variable counted by level. ``show`` limits the rows shown to these levels."""

    levels: tuple[str, ...]
    label: str = ""
    show: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Continuous:
    """A variable described by median and quartiles."""

    label: str = ""
    digits: int = 1


def summary_table(
    df: DataFrame,
    variables: Mapping[str, Categorical | Continuous],
    *,
    arm: str,
    arms: Sequence[str],
    by: Sequence[str] = (),
    interval: str = "%s (%s, %s)",
    kind: int = 7,
    tests: bool = False,
    category_test: str = "exact",
    number_test: str = "normal",
) -> DataFrame:
    """Many variables described by arm: counts with percent, or median and quartiles.

    One row per declared (variable, level) and arm of every stratum, also where no
    value is known: then ``n_known`` is 0 and the rest NULL. Missing values are outside numerator and
    denominator. Percentages show no decimals, quartiles ``digits``. With
    ``tests`` each row also has the p-value of its variable and its ``method``: by
    ``category_test`` for categories (see ``fisher_levels``), the rank-sum test for
    numbers, ``exact`` or ``normal`` (the first two of ``arms``).

    The rows are read twice, for categories and for numbers; everything else works
    on the counts per value made there.
    """
    df, keys = strata(df.where(F.col(arm).isin(list(arms))), by)
    cats, nums, levels, values = _value_counts(df, variables, keys, arm)
    place = {n: i for i, n in enumerate(variables)}
    spark = df.sparkSession
    parts = []
    # Every stratum with every arm, so that cells without a known value are shown.
    arm_type = df.schema[arm].dataType
    sides = spark.createDataFrame([(a,) for a in arms], T.StructType([T.StructField(arm, arm_type)]))
    base = df.select(*keys).distinct().join(F.broadcast(sides)) if keys else sides
    if cats:
        whole = levels.groupBy(*keys, arm, "variable").agg(F.sum("n").alias("n_known"))
        # Every declared level of every variable, so that empty cells are shown.
        rows = [(n, lv, i) for n, v in cats.items() for i, lv in enumerate(v.levels) if v.show is None or lv in v.show]
        grid = spark.createDataFrame(rows, "variable string, level string, level_order int")
        cells = join_groups(base.join(F.broadcast(grid)), whole, [*keys, arm, "variable"])
        cells = join_groups(cells, levels, [*keys, arm, "variable", "level"])
        known = F.coalesce(F.col("n_known"), F.lit(0).cast("long"))
        n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
        pct = F.when(known > 0, 100.0 * n / known)
        text = F.concat(n.cast("string"), F.lit(" ("), fixed(F.bround(pct, 0), 0), F.lit("%)"))
        parts.append(cells.select(
            *keys, arm, "variable", "level", "level_order", known.alias("n_known"), n.alias("n"), pct.alias("percent"),
            F.lit(None).cast("double").alias("median"), F.lit(None).cast("double").alias("q1"),
            F.lit(None).cast("double").alias("q3"), text.alias("text"),
        ))
    if nums:
        q = quantiles(values, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=[*keys, arm, "variable"], kind=kind, weight="n")
        names = spark.createDataFrame([(n,) for n in nums], "variable string")
        q = join_groups(base.join(F.broadcast(names)), q, [*keys, arm, "variable"])
        q = q.withColumn("n_known", F.coalesce(F.col("n_known"), F.lit(0).cast("long")))
        shown = {d: [n for n, v in nums.items() if v.digits == d] for d in {v.digits for v in nums.values()}}
        text = F.lit(None).cast("string")
        for d, names in shown.items():
            piece = F.format_string(interval, fixed("median", d), fixed("q1", d), fixed("q3", d))
            text = F.when(F.col("variable").isin(names), piece).otherwise(text)
        parts.append(q.select(
            *keys, arm, "variable", F.lit(None).cast("string").alias("level"), F.lit(0).alias("level_order"), "n_known",
            F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("percent"), "median", "q1", "q3", text.alias("text"),
        ))
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    labels = {n: (v.label or n) for n, v in variables.items()}
    pairs = [F.lit(x) for n in variables for x in (n, labels[n])]
    order = [F.lit(x) for n in variables for x in (n, place[n])]
    table = table.withColumn("label", F.create_map(*pairs)[F.col("variable")]).withColumn(
        "variable_order", F.create_map(*order)[F.col("variable")]
    )
    columns = [*by, "variable", "label", "variable_order", "level", "level_order", arm, "n_known", "n", "percent",
               "median", "q1", "q3", "text"]
    if tests:
        p_values = _tests_from_counts(cats, levels, values, arm=arm, arms=arms, keys=keys, category_test=category_test, number_test=number_test)
        table = join_groups(table, p_values, [*keys, "variable"])
        columns += ["p", "p_text", "method"]
    return table.select(*columns)


def summary_tests(
    df: DataFrame, variables: Mapping[str, Categorical | Continuous], *, arm: str, arms: Sequence[str], by: Sequence[str] = (),
    category_test: str = "exact", number_test: str = "normal",
) -> DataFrame:
    """One p-value per variable, with its method: ``category_test`` for categories, the rank-sum test for numbers."""
    df, keys = strata(df.where(F.col(arm).isin(list(arms))), by)
    cats, _, levels, values = _value_counts(df, variables, keys, arm)
    found = _tests_from_counts(cats, levels, values, arm=arm, arms=arms, keys=keys, category_test=category_test, number_test=number_test)
    return found.select(*by, "variable", "p", "p_text", "method")


def _value_counts(df: DataFrame, variables: Mapping[str, Categorical | Continuous], keys: list[str], arm: str):
    """Categories, numbers, and their written counts per (variable, value, arm)."""
    cats = {n: v for n, v in variables.items() if isinstance(v, Categorical)}
    nums = {n: v for n, v in variables.items() if isinstance(v, Continuous)}
    levels = values = None
    if cats:
        long = _long_categories(df, cats, [*keys, arm])
        levels = materialise(long.groupBy(*keys, arm, "variable", "level").agg(F.count(F.lit(1)).alias("n")))
    if nums:
        long = _long_numbers(df, nums, [*keys, arm])
        values = materialise(long.groupBy(*keys, arm, "variable", "value").agg(F.count(F.lit(1)).alias("n")))
    return cats, nums, levels, values


def _tests_from_counts(
    cats, levels, values, *, arm: str, arms: Sequence[str], keys: list[str], category_test: str, number_test: str
) -> DataFrame:
    side = F.when(F.col(arm) == arms[0], 1).when(F.col(arm) == arms[1], 0)
    parts = []
    if levels is not None:
        parts.append(fisher_levels(
            levels.withColumn("_arm", side), level="level", arm="_arm", by=[*keys, "variable"], method=category_test, weight="n"
        ).select(*keys, "variable", "p", "method"))
    if values is not None:
        parts.append(rank_sum(
            values.withColumn("_arm", side), "value", arm="_arm", by=[*keys, "variable"], weight="n", method=number_test
        ).select(*keys, "variable", "p", "method"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("p_text", p_text("p"))


def _long_categories(df: DataFrame, cats: Mapping[str, Categorical], ids: list[str]) -> DataFrame:
    kept = df.select(*ids, *[F.when(F.col(n).isin(list(v.levels)), F.col(n)).alias(n) for n, v in cats.items()])
    return to_long(kept, ids=ids, columns=list(cats), value="level").where(F.col("level").isNotNull())


def _long_numbers(df: DataFrame, nums: Mapping[str, Continuous], ids: list[str]) -> DataFrame:
    kept = df.select(*ids, *[F.col(n).cast("double").alias(n) for n in nums])
    return to_long(kept, ids=ids, columns=list(nums)).where(F.col("value").isNotNull())
