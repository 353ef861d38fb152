"""Running sums and carried values over ordered rows, without one-task windows.

``range_chunks`` range-partitions rows by (group, order) and writes them out with
their chunk number. A group of any size is spread over several chunks, a chunk
holds many small groups, and every scan is then a window inside each chunk plus
one offset per chunk for the group that began in an earlier one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinarm.functions.columns import col
from twinarm.session import materialise

CHUNK = "_chunk"


def range_chunks(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """``df`` in range partitions of ``keys`` with the partition number as a column."""
    return materialise(df.repartitionByRange(*[col(k) for k in keys]).withColumn(CHUNK, F.spark_partition_id()))


def strata(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` and its group columns; without any, one constant column ``_all``."""
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join two tables on group columns where a NULL group is a group like any other."""
    if not keys:
        raise ValueError("no group columns")
    marked = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(marked, test, how).drop(*[f"_r_{k}" for k in keys])


def running_sums(
    chunked: DataFrame, *, by: Sequence[str], order_by: Sequence[str | Column], sums: Mapping[str, str | Column],
    totals: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Inclusive running sums within ``by`` along ``order_by``, one column per entry, and sums over the whole group.

    ``chunked`` comes from ``range_chunks`` on (by, order_by), whose key is unique. A
    group's total is what its chunk holds plus the offsets before and after it, so no row
    is joined or shuffled by group.
    """
    by, whole = list(by), dict(totals or {})
    inside = (
        Window.partitionBy(CHUNK, *by).orderBy(*[col(o) for o in order_by])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    group = Window.partitionBy(CHUNK, *by)
    local = chunked.select(
        "*", *[F.sum(col(e)).over(inside).alias(n) for n, e in sums.items()], *[F.sum(col(e)).over(group).alias(n) for n, e in whole.items()])
    pieces = chunked.groupBy(CHUNK, *by).agg(*[F.sum(col(e)).alias(f"_t_{n}") for n, e in {**sums, **whole}.items()])
    chunks = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = chunks.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = chunks.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    both = lambda e: F.coalesce(e.over(earlier), F.lit(0)) + F.coalesce(e.over(later), F.lit(0))
    offsets = pieces.select(
        CHUNK, *by, (both(F.count(F.lit(1))) if whole else F.count(F.lit(1)).over(earlier)).alias("_others"),
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in sums], *[both(F.sum(f"_t_{n}")).alias(f"_o_{n}") for n in whole],
    ).where("_others > 0").drop("_others")
    # Only the first and the last group of a chunk can reach beyond it: at most two rows per chunk.
    joined = join_groups(local, F.broadcast(offsets), [CHUNK, *by])
    kept = [c for c in local.columns if c not in sums and c not in whole]
    return joined.select(
        *kept, *[(F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in (*sums, *whole)]
    )


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; counts are combined before the shuffle."""
    counts = df.groupBy(*keys).count() if keys else df.groupBy().count()
    return counts.agg(F.max("count")).first()[0] or 0
