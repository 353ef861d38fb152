"""Order statistics on distinct values: quantiles, ranks, quantile plots, rank-sum test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinarm.functions import rank_exact
from twinarm.functions.normal import normal_quantile
from twinarm.functions.tails import normal_p
from twinarm.operators.scan import CHUNK, join_groups, range_chunks, running_sums, strata

QUARTILE_SPAN = 1.3489795003921634  # distance of the normal quartiles


def _amount(weight: str | None, test: Column | None = None) -> Column:
    """Number of rows (of those that pass ``test``), or the sum of their counts."""
    if weight is None:
        return F.count(F.lit(1) if test is None else F.when(test, 1))
    return F.sum(weight if test is None else F.when(test, F.col(weight)).otherwise(0))


def value_counts(df: DataFrame, c: str, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Written counts of each value, the missing one included, in range chunks of (group, value): all that quantiles and moments need."""
    return range_chunks(df.groupBy(*keys, F.col(c).alias("_v")).agg(_amount(weight).alias("_n")), [*keys, "_v"])


def moments(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, known values, mean, SD and extremes per group from ``value_counts``.

    Squares are taken from the mean of a chunk's part of the group and put together from
    there, so a mean far from zero costs no digits.
    """
    inside, group = Window.partitionBy(CHUNK, *keys), Window.partitionBy(*keys)
    v, known = F.col("_v").cast("double"), F.when(F.col("_v").isNotNull(), F.col("_n"))
    local = counts.withColumn("_mean", F.sum(F.col("_n") * v).over(inside) / F.sum(known).over(inside))
    pieces = local.groupBy(CHUNK, *keys).agg(
        F.sum("_n").alias("_rows"), F.coalesce(F.sum(known), F.lit(0)).alias("_known"), F.max("_mean").alias("_mean"),
        F.sum(F.col("_n") * F.pow(v - F.col("_mean"), F.lit(2.0))).alias("_squares"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    pieces = pieces.withColumn("_centre", F.sum(F.col("_known") * F.col("_mean")).over(group) / F.nullif(F.sum("_known").over(group), F.lit(0)))
    squares = F.sum(F.col("_squares") + F.col("_known") * F.pow(F.col("_mean") - F.col("_centre"), F.lit(2.0)))
    n = F.sum("_known")
    return pieces.groupBy(*keys).agg(
        F.sum("_rows").alias("n"), n.alias("n_nonnull"), F.max("_centre").alias("mean"), F.when(n > 1, F.sqrt(squares / (n - 1))).alias("sd"),
        F.min("_low").alias("minimum"), F.max("_high").alias("maximum"))


def quantiles(df: DataFrame, c: str, probs: Mapping[str, float], *, by: Sequence[str] = (), kind: int = 7,
              weight: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probs``, and ``n_known``.

    ``kind`` 7 interpolates linearly between order statistics, 2 averages at
    jumps. Works on value counts, so no group is held in one task. ``weight``
    names a column of counts when the rows are already counted; ``counts`` are those of ``value_counts``
    where they have been made.
    """
    if kind not in (2, 7):
        raise ValueError("kind must be 2 or 7")
    df, keys = strata(df, by)
    chunked = value_counts(df.where(F.col(c).isNotNull()), c, keys, weight) if counts is None else counts.where(F.col("_v").isNotNull())
    pieces = chunked.groupBy(CHUNK, *keys).agg(F.sum("_n").alias("_rows"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        CHUNK, *keys, "_rows", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(group).alias("n_known"),
    )

    n = F.col("n_known")
    places = []
    for q in probs.values():
        if kind == 7:
            place = (n - 1) * F.lit(float(q))
            places.append((F.floor(place), F.ceil(place), place - F.floor(place)))
        else:
            place = n * F.lit(float(q))
            whole = F.abs(place - F.round(place)) < 1e-9
            at = F.when(whole, F.round(place)).otherwise(F.floor(place)).cast("long")
            high = F.least(at, n - 1)
            places.append((F.when(whole, F.greatest(at - 1, F.lit(0))).otherwise(high), high, F.lit(0.5)))
    # Only the pieces that hold a wanted order statistic are ordered.
    wanted = F.lit(False)
    for low, high, _ in places:
        for k in (low, high):
            wanted = wanted | ((F.col("_before") <= k) & (k < F.col("_before") + F.col("_rows")))
    held = join_groups(chunked, pieces.where(wanted), [CHUNK, *keys], "inner")
    inside = Window.partitionBy(CHUNK, *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))

    def order_statistic(k: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= k) & (k < F.col("_upto")), F.col("_v")))

    picks, finals = [], []
    for i, (name, (low, high, share)) in enumerate(zip(probs, places)):
        picks += [order_statistic(low).alias(f"_low{i}"), order_statistic(high).alias(f"_high{i}"), F.max(share).alias(f"_s{i}")]
        finals.append((F.col(f"_low{i}") + F.col(f"_s{i}") * (F.col(f"_high{i}") - F.col(f"_low{i}"))).alias(name))
    return ranked.groupBy(*keys).agg(*picks, F.max("n_known").alias("n_known")).select(*by, "n_known", *finals)


def rank_rows(
    df: DataFrame, c: str, *, tie: Sequence[str], by: Sequence[str] = (), descending: bool = True, out: str = "rank"
) -> DataFrame:
    """Number the rows of each group by ``c``, missing last, ties in the order of ``tie``."""
    value = F.desc_nulls_last(c) if descending else F.asc_nulls_last(c)
    order = [value, *[F.col(t) for t in tie]]
    chunked = range_chunks(df, [*by, *order])
    return running_sums(chunked, by=list(by), order_by=order, sums={out: F.lit(1)}).drop("_chunk")


def normal_plot(df: DataFrame, c: str, *, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Points of a normal quantile plot: each known value against its normal score."""
    df, keys = strata(df.where(F.col(c).isNotNull()), by)
    order = [F.col(c), *[F.col(t) for t in tie]]
    chunked = range_chunks(df.select(*keys, c, *tie), [*keys, *order])
    ranked = running_sums(chunked, by=keys, order_by=order, sums={"position": F.lit(1)}, totals={"n": F.lit(1)})
    shift = F.when(F.col("n") <= 10, 3.0 / 8).otherwise(0.5)
    point = (F.col("position") - shift) / (F.col("n") + 1 - 2 * shift)
    return ranked.select(
        *by, *tie, "position", "n", point.alias("probability"), normal_quantile(point).alias("theoretical"),
        F.col(c).alias("sample"),
    )


def normal_plot_line(df: DataFrame, c: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Line through the first and third quartiles of the normal quantile plot."""
    q = quantiles(df, c, {"q1": 0.25, "q3": 0.75}, by=by)
    slope = (F.col("q3") - F.col("q1")) / QUARTILE_SPAN
    return q.select(*by, "q1", "q3", slope.alias("slope"), ((F.col("q1") + F.col("q3")) / 2).alias("intercept"))


def rank_sum(df: DataFrame, y: str, *, arm: str, by: Sequence[str] = (), method: str = "normal", first: int = 1,
             weight: str | None = None) -> DataFrame:
    """Wilcoxon rank-sum test of two arms (1 and 0) with mid-ranks.

    ``first`` is the arm whose rank sum gives W. The normal form is continuity and tie corrected.
    ``exact_if_small`` asks for the usual rule: the exact distribution where both arms are below 50
    and untied, the normal form elsewhere. The form used is in the column ``method``.
    """
    if method not in ("normal", "exact_if_small"):
        raise ValueError(f"unknown method: {method}")
    df, keys = strata(df.where(F.col(y).isNotNull() & F.col(arm).isin(0, 1)), by)
    counts = df.groupBy(*keys, F.col(y).alias("_v")).agg(
        _amount(weight, F.col(arm) == first).alias("_a"), _amount(weight).alias("_t")
    )
    chunked = range_chunks(counts, [*keys, "_v"])
    ranked = running_sums(chunked, by=keys, order_by=["_v"], sums={"_upto": "_t"})
    t = F.col("_t").cast("double")
    mid = F.col("_upto") - t + (t + 1) / 2
    sums = ranked.groupBy(*keys).agg(
        F.sum("_a").alias("na"), F.sum(F.col("_t") - F.col("_a")).alias("nb"),
        F.sum(F.col("_a") * mid).alias("_ra"), F.sum(t * t * t - t).alias("tie_term"),
    )
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    w = F.col("_ra") - na * (na + 1) / 2
    gap = F.col("w") - na * nb / 2
    sigma = F.sqrt(na * nb / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    z = F.when(F.col("sigma") > 0, (gap - F.signum(gap) * 0.5) / F.col("sigma"))
    out = sums.where((F.col("na") > 0) & (F.col("nb") > 0)).withColumn("w", w).withColumn("sigma", sigma).withColumn("z", z)
    p = F.least(normal_p(F.col("z")), F.lit(1.0))
    used = F.lit("normal")
    if method == "exact_if_small":
        small = (F.col("na") < 50) & (F.col("nb") < 50) & (F.col("tie_term") == 0)
        p = F.when(small, rank_exact.exact_p("w", "na", "nb", small)).otherwise(p)
        used = F.when(small, "exact").otherwise(used)
    out = out.withColumn("p", p).withColumn("method", used)
    n1, n0 = ("na", "nb") if first == 1 else ("nb", "na")
    half = F.col("w") / (na * nb) - 0.5
    return out.select(
        *by, F.col(n1).alias("n1"), F.col(n0).alias("n0"), "w", "tie_term", "z", "p",
        half.alias("rbc_half"), (2 * half).alias("rank_biserial"), "method",
    )
