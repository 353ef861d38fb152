"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_columns(df: DataFrame, columns: Sequence[str], change: Callable[[Column], Column]) -> DataFrame:
    """The same change (a cast, a rounding) applied to several columns."""
    return df.withColumns({c: change(F.col(c)) for c in columns})


def to_long(df: DataFrame, *, ids: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Several columns stacked into (name, value) rows; one expansion, no shuffle."""
    return df.unpivot(list(ids), list(columns), name, value)


def items_to_long(
    df: DataFrame, *, ids: Sequence[str], columns: Sequence[str], pattern: str, names: Sequence[str], value: str = "score"
) -> DataFrame:
    """Wide item columns to rows; each regex group of the column name becomes a column."""
    stacked = to_long(df, ids=ids, columns=columns, name="_item", value=value)
    parts = {n: F.regexp_extract("_item", pattern, i + 1) for i, n in enumerate(names)}
    return stacked.select(*ids, *[e.alias(n) for n, e in parts.items()], value)


def arms_to_wide(df: DataFrame, *, by: Sequence[str], arm: str, levels: Mapping[object, str], value: str) -> DataFrame:
    """Count, mean and SD of ``value`` per arm as columns ``n_<label>``, ``mean_<label>``, ``sd_<label>``."""
    parts = []
    for level, label in levels.items():
        inside = F.when(F.col(arm) == level, F.col(value))
        parts += [
            F.count(F.when(F.col(arm) == level, 1)).alias(f"n_{label}"),
            F.avg(inside).alias(f"mean_{label}"),
            F.stddev_samp(inside).alias(f"sd_{label}"),
        ]
    return df.groupBy(*by).agg(*parts)


def first_available(df: DataFrame, out: str, columns: Sequence[str]) -> DataFrame:
    """``out`` from the first of ``columns`` that exists and is known."""
    present = [c for c in columns if c in df.columns]
    return df.withColumn(out, F.coalesce(*[F.col(c) for c in present]) if present else F.lit(None))


def append_labelled(tables: Mapping[str, DataFrame], label: str = "model") -> DataFrame:
    """Result tables one below the other, each with its name in ``label``."""
    out = None
    for name, table in tables.items():
        named = table.withColumn(label, F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out
