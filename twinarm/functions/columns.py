"""Column expressions: recodes, flags, factors, number formats.

Everything here is a built-in Spark expression, so it stays inside
whole-stage code generation and reaches no Python worker.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_in(c: str | Column, values: Sequence) -> Column:
    """Set membership that is false, not NULL, for a missing value."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def recode(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Look the text of ``c`` up in ``mapping``; other known values get ``default``.

    Keys are compared as text, so mixed codings (1 / "1" / "Yes") can share a
    mapping. A missing value stays missing.
    """
    pairs = [F.lit(x) for k, v in mapping.items() for x in (str(k), v)]
    found = F.try_element_at(F.create_map(*pairs), col(c).cast("string"))
    return found if default is None else F.coalesce(found, F.when(col(c).isNotNull(), F.lit(default)))


def band(c: str | Column, ranges: Sequence[tuple]) -> Column:
    """First ``(low, high, result)`` whose closed range holds the value; None is open."""
    out = F.lit(None)
    for low, high, result in reversed(list(ranges)):
        test = F.lit(True)
        if low is not None:
            test = test & (col(c) >= low)
        if high is not None:
            test = test & (col(c) <= high)
        out = F.when(test, F.lit(result)).otherwise(out)
    return F.when(col(c).isNotNull(), out)


def pick_by(key: str | Column, columns: Mapping[object, str | Column]) -> Column:
    """The column named for the value of ``key`` (an outcome stored per period)."""
    out = F.lit(None).cast("double")
    for value, source in columns.items():
        values = value if isinstance(value, tuple) else (value,)
        out = F.when(col(key).isin(list(values)), col(source)).otherwise(out)
    return out


def keep_levels(c: str | Column, levels: Sequence[str]) -> Column:
    """The value when it is one of ``levels``, else NULL."""
    return F.when(col(c).isin(list(levels)), col(c))


def level_position(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based place of the value in ``levels``, NULL when it is not there."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), col(c)), F.lit(0)).cast("int")


def collapse_with_bands(
    label: str | Column, mapping: Mapping, number: str | Column, ranges: Sequence[tuple]
) -> Column:
    """Group of a label; only where the label is missing, the band of a number."""
    return F.coalesce(
        recode(label, mapping), F.when(col(label).isNull(), band(number, ranges))
    )


def two_flags(first: str | Column, second: str | Column, both: str, only_first: str, only_second: str) -> Column:
    """Classify by use of two things: both, the first, the second, neither (NULL)."""
    a, b = any_use(first), any_use(second)
    return F.when(a & b, both).when(a, only_first).when(b, only_second)


def any_use(c: str | Column) -> Column:
    """True above zero; missing counts as no use."""
    return F.coalesce(col(c) > 0, F.lit(False))


def exactly(c: str | Column, value) -> Column:
    """True at exactly ``value``; missing counts as no."""
    return F.coalesce(col(c) == value, F.lit(False))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def among_users(c: str | Column) -> Column:
    """The value where it is above zero, else NULL."""
    return F.when(col(c) > 0, col(c))


def to_number(c: str | Column) -> Column:
    """Number of a text; text that is no number becomes NULL."""
    return col(c).try_cast("double")


def event_flag(rule: str, *, time: str | Column | None = None, status: str | Column | None = None,
               event_codes: Sequence = ("0",), none_codes: Sequence = ("1",)) -> Column:
    """1 = event, 0 = censored.

    ``rule='time_present'``: a recorded time is an event. ``rule='status'``: the
    status code decides and any other code is NULL.
    """
    if rule == "time_present":
        return F.when(col(time).isNotNull(), 1).otherwise(0)
    if rule == "status":
        return recode(status, {**{c: 1 for c in event_codes}, **{c: 0 for c in none_codes}})
    raise ValueError(f"unknown event rule: {rule}")


def finite(c: str | Column) -> Column:
    """The value unless it is infinite."""
    return F.when(F.abs(col(c)) != float("inf"), col(c))


def fixed(c: str | Column, digits: int) -> Column:
    """Text with a fixed number of decimals, halves to the even neighbour."""
    return F.when(col(c).isNotNull(), F.format_string(f"%.{digits}f", F.bround(col(c).cast("double"), digits)))


def half_even(c: str | Column, digits: int = 0) -> Column:
    """Round to ``digits`` decimals, halves to the even neighbour."""
    return F.bround(col(c), digits)


def significant(c: str | Column, digits: int) -> Column:
    """Round to ``digits`` significant digits."""
    x = col(c)
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), F.abs(places))
    scaled = F.when(places >= 0, F.rint(x * scale) / scale).otherwise(F.rint(x / scale) * scale)
    return F.when(x == 0, F.lit(0.0)).otherwise(scaled)


def p_text(p: str | Column, digits: int = 3) -> Column:
    """A p-value as text: below 0.001 and above 0.999 only the bound is shown."""
    x = col(p)
    return (
        F.when(x.isNull(), None)
        .when(x < 0.001, "<0.001")
        .when(x > 0.999, ">0.999")
        .otherwise(fixed(x, digits))
    )
