"""Model terms as columns: numbers, factors with treatment contrasts, products.

A term is a column name or a tuple of names (their product). A name listed in
``levels`` is a factor; its first level is the reference.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Term = str | tuple[str, ...]


@dataclass(frozen=True)
class DesignColumn:
    """One model coefficient: the factor levels it requires and the numbers it multiplies."""

    name: str
    factors: tuple[tuple[str, object], ...]
    numbers: tuple[str, ...]


def crossed(*names: str) -> list[Term]:
    """Main effects and the product of two variables."""
    return [*names, tuple(names)]


def design_columns(terms: Sequence[Term], levels: Mapping[str, Sequence], *, intercept: bool) -> list[DesignColumn]:
    """Coefficients of ``terms`` in order, each with a readable name."""
    out = [DesignColumn("(Intercept)", (), ())] if intercept else []
    for term in terms:
        names = (term,) if isinstance(term, str) else tuple(term)
        factors = [n for n in names if n in levels]
        numbers = tuple(n for n in names if n not in levels)
        for picked in product(*[list(levels[f])[1:] for f in factors]):
            chosen = dict(zip(factors, picked))
            label = ":".join(f"{n}[{chosen[n]}]" if n in chosen else n for n in names)
            out.append(DesignColumn(label, tuple(chosen.items()), numbers))
    return out


def variables(terms: Sequence[Term]) -> list[str]:
    """Every variable the terms use, once, in order."""
    seen: dict[str, None] = {}
    for term in terms:
        for name in (term,) if isinstance(term, str) else term:
            seen[name] = None
    return list(seen)


def complete_rows(df: DataFrame, terms: Sequence[Term], levels: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose every variable is known; a value outside its level list counts as missing."""
    for name in variables(terms):
        known = F.col(name).isNotNull()
        if name in levels:
            known = known & F.col(name).isin(list(levels[name]))
        df = df.where(known)
    return df


def expression(column: DesignColumn) -> Column:
    """The column's value in a complete row."""
    value = F.lit(1.0)
    for name in column.numbers:
        value = value * F.col(name).cast("double")
    for name, level in column.factors:
        value = F.when(F.col(name) == level, value).otherwise(0.0)
    return value
