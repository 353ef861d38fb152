"""Joins on one key, with guards against fan-out and against hot keys.

Lookups come from the caller and may be as long as the subject list, so Spark
picks the join by measured size. A summary with a fixed number of counters per task
finds the keys that hold more than one shuffle partition's share of the rows. Their rows
are dealt out by a salt and only their lookup rows are repeated, once per salt; the
join itself is one, and reads each side once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinarm.functions.columns import col

#: Counters of the summary for each shuffle partition; a key with more than its share of the rows cannot escape them.
COUNTERS = 64
MOST_COUNTERS = 100_000


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def one_per_key(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``df`` itself, failing at run time if a key has two rows.

    The check is an aggregation on the join key, so it is combined before the
    shuffle and the join reuses its partitioning.
    """
    keys = _keys(key)
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.first(F.struct(*rest) if rest else F.lit(1)).alias("_rest")
    )
    checked = F.when(
        F.col("_rows") > 1, F.raise_error(F.lit(f"more than one row for a value of {', '.join(keys)}"))
    ).otherwise(F.col("_rest"))
    checked = counted.select(*keys, checked.alias("_rest")).where(F.col("_rest").isNotNull())
    return checked.select(*keys, *[F.col("_rest")[c].alias(c) for c in rest])


def heavy_keys(df: DataFrame, keys: Sequence[str], *, parts: int | None = None) -> tuple[list[tuple[int, int]], bool]:
    """(digest, salts) of the keys that hold more than 1/``parts`` of the rows, and whether rows with a missing key do.

    One pass over the key columns: each task sums up what it sees in a fixed number of
    counters, and the summaries are merged. At most ``parts`` keys can be that heavy; a
    key gets a salt for each such share of the rows it holds.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = _known(keys)
    told = df.select(F.when(known, F.xxhash64(*keys)).alias("_hash")).agg(
        F.count(F.lit(1)).alias("n"), F.count("_hash").alias("known"),
        F.expr(f"approx_top_k(_hash, {parts}, {min(MOST_COUNTERS, COUNTERS * parts)})").alias("top")).first()
    n = told["n"]
    found = [(t["item"], -(-t["count"] * parts // n)) for t in told["top"] or [] if t["item"] is not None and t["count"] * parts > n]
    return found, (n - told["known"]) * parts > n


def _known(keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).isNotNull()
    return test


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", *, parts: int | None = None) -> DataFrame:
    """Join to a table with at most one row per key, whatever share of ``left`` a key, or a missing key, holds.

    Rows of a heavy key are dealt out by a salt from their content and input split, so a
    repeated task deals them alike. Lookup rows of such keys are repeated once per
    salt: at most twice as many as there are shuffle partitions.
    """
    keys = list(keys)
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy, blank = heavy_keys(left, keys, parts=parts)
    if not heavy and not blank:
        return left.join(right, keys, how)
    marks = F.broadcast(left.sparkSession.createDataFrame(heavy, "_hash bigint, _salts int"))
    dealt = F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.spark_partition_id())
    some = left.withColumn("_hash", F.xxhash64(*keys)).join(marks, "_hash", "left").withColumn(
        "_salt", F.pmod(dealt, F.when(_known(keys), F.coalesce("_salts", F.lit(1))).otherwise(F.lit(parts))).cast("int")).drop("_hash", "_salts")
    repeated = right.withColumn("_hash", F.xxhash64(*keys)).join(marks, "_hash", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hash", "_salts")
    return some.join(repeated, [*keys, "_salt"], how).drop("_salt")


def lookup_join(df: DataFrame, lookup: DataFrame, key: str | Sequence[str], *, how: str = "left") -> DataFrame:
    """Left or inner join to a lookup that must hold one row per key."""
    return spread_join(df, one_per_key(lookup, key), _keys(key), how)


def attach_by_text_key(df: DataFrame, lookup: DataFrame, *, key: str, lookup_key: str) -> DataFrame:
    """Left join where the left key is read as text."""
    renamed = one_per_key(lookup, lookup_key).withColumnRenamed(lookup_key, "_text_key")
    return spread_join(df.withColumn("_text_key", F.col(key).cast("string")), renamed, ["_text_key"]).drop("_text_key")


def attach_aggregate(df: DataFrame, source: DataFrame, key: str | Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Left join to per-key aggregates of another table, aggregated before the join."""
    keys = _keys(key)
    summary = source.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    return spread_join(df, summary, keys)


def keys_where(df: DataFrame, key: str | Sequence[str], test: Column) -> DataFrame:
    """Distinct keys of the rows that pass ``test``."""
    return df.where(test).select(*_keys(key)).distinct()


def keep_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return spread_join(df, keys, keys.columns, "left_semi")


def study_day(df: DataFrame, date: str | Column, *, out: str = "study_day") -> DataFrame:
    """1-based whole days since the earliest date of the table."""
    first = df.agg(F.min(col(date))).scalar()
    return df.withColumn(out, (F.datediff(col(date), first) + 1).cast("int"))


def centre(df: DataFrame, c: str, *, out: str, over: str = "rows", subject: str | None = None) -> DataFrame:
    """Subtract the mean, over all rows or over one value per subject."""
    if over == "rows":
        mean = df.agg(F.avg(c)).scalar()
    elif over == "subjects":
        mean = df.groupBy(subject).agg(F.max(c).alias("_v")).agg(F.avg("_v")).scalar()
    else:
        raise ValueError(f"unknown averaging: {over}")
    return df.withColumn(out, F.col(c) - mean)


def clear_infinite(df: DataFrame) -> DataFrame:
    """Infinite values of every floating column become NULL."""
    return df.withColumns(
        {n: F.when(~F.abs(F.col(n)).isin(float("inf")), F.col(n)) for n, t in df.dtypes if t in ("double", "float")}
    )
