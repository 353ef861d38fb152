"""Sources: the long subject-by-visit table, lookups, label decoding, overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinarm.functions.columns import col, recode
from twinarm.operators.joins import one_per_key, spread_join


def load_long(
    spark: SparkSession,
    path: str | list[str],
    *,
    schema: T.StructType | str | None = None,
    fmt: str = "csv",
    missing: str = "NA",
) -> DataFrame:
    """Read a long table. ``schema=None`` infers it, which costs a pass over CSV.

    In CSV the token ``missing`` and an unquoted blank are NULL; a quoted ``""``
    stays an empty text. Text in a numeric column is NULL.
    """
    if fmt == "csv":
        reader = spark.read.option("header", True).option("nullValue", missing)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def visit_lookup(spark: SparkSession, codes: Mapping[str, int], name: str = "visit", code: str = "visit_code") -> DataFrame:
    """The visit map as a table with one row per visit name."""
    return spark.createDataFrame(list(codes.items()), f"{name} string, {code} int")


def index_dates(dates: DataFrame, *, key: str, text: str, fmt: str = "M/d/yy", out: str = "index_date") -> DataFrame:
    """Caller's (key, date text) pairs as (key text, date); unreadable text is NULL.

    A two-digit year always reads as 20xx, so years after 2068, which other
    tools read as 19xx, are rejected.
    """
    parsed = F.to_date(F.try_to_timestamp(F.col(text), F.lit(fmt)))
    safe = F.when(F.year(parsed) > 2068, F.raise_error(F.lit("ambiguous two-digit year"))).otherwise(parsed)
    return dates.select(F.col(key).cast("string").alias(key), safe.cast("date").alias(out))


def decode_labels(df: DataFrame, codebook: Mapping[str, Mapping]) -> DataFrame:
    """Replace codes by labels in every column of ``codebook``; unlisted codes stay as text."""
    known = {c: m for c, m in codebook.items() if c in df.columns}
    return df.withColumns(
        {c: F.coalesce(recode(c, m), F.col(c).cast("string")) for c, m in known.items()}
    )


def apply_overrides(
    df: DataFrame,
    overrides: DataFrame,
    *,
    key: Sequence[str],
    out: str,
    rules: Sequence[tuple[Column, Column]],
    default: Column,
    value: str | Column = "override_value",
    position: int = 0,
) -> DataFrame:
    """First matching rule decides, with per-key exceptions at ``position``.

    ``overrides`` has at most one row per ``key``; ``value`` is its column, or an
    expression over its columns and those of ``df``. Position 0 puts the
    exceptions before every rule, position k after the first k rules.
    """
    known = one_per_key(overrides, key).withColumn("_has_override", F.lit(True))
    joined = spread_join(df, known, list(key))
    chain = list(rules)
    chain.insert(position, (F.coalesce(F.col("_has_override"), F.lit(False)), col(value)))
    result = default
    for test, answer in reversed(chain):
        result = F.when(test, answer).otherwise(result)
    extra = [c for c in known.columns if c not in key]
    return joined.withColumn(out, result).drop(*[c for c in extra if c != out])
