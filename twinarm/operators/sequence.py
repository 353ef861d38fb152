"""Per-subject sequence operators. Row order is data, so every one names its order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinarm.functions.columns import col
from twinarm.operators.scan import CHUNK, join_groups, largest_group, range_chunks


HOT_ROWS = 500_000
#: Bits of the types whose values can be packed into one whole number (fixed values).
WIDTHS = {"tinyint": 8, "smallint": 16, "int": 32, "date": 32, "bigint": 64, "timestamp": 64}


def _order(order_by: Sequence[str | Column]) -> Column:
    return F.struct(*[col(o) for o in order_by])


def _place(df: DataFrame, order_by: Sequence[str]) -> Column:
    """The order as one value of fixed width where the columns fit into 64 bits, else as a struct.

    A buffer of fixed width lets numbers be aggregated by hash, without a sort. A missing
    order comes first, as the lowest number of its type.
    """
    kinds = dict(df.dtypes)
    widths = [WIDTHS.get(kinds.get(o, "")) for o in order_by]
    if None in widths or sum(widths) > 64:
        return _order(order_by)
    out = None
    for name, width in zip(order_by, widths):
        value = {"date": F.unix_date, "timestamp": F.unix_micros}.get(kinds[name], lambda c: c)(F.col(name)).cast("bigint")
        value = F.coalesce(value, F.lit(-(1 << (width - 1))).cast("bigint"))
        # Later columns count from zero up, below the bits of the earlier ones.
        out = value if out is None else F.shiftleft(out, width).bitwiseOR(value + F.lit(1 << (width - 1)))
    return out


def _local_fill(c: str, keys: list[str], order_by: list[str], direction: str) -> Column:
    # Both directions are running frames: looking ahead is a running frame of the reversed order,
    # because Spark evaluates a frame that ends at the last row anew for every row.
    forward = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*[F.asc(o) for o in order_by])
    back = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*[F.desc(o) for o in order_by])
    running = (Window.unboundedPreceding, Window.currentRow)
    down = F.last(c, ignorenulls=True).over(forward.rowsBetween(*running))
    up = F.last(c, ignorenulls=True).over(back.rowsBetween(*running))
    return {"down": down, "up": up, "downup": F.coalesce(down, up)}[direction]


def fill(
    df: DataFrame,
    *,
    subject: str,
    order_by: Sequence[str],
    cols: Sequence[str],
    direction: str = "downup",
    scope: str = "subject",
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Replace missing values by the last known one before, else the first one after.

    ``direction`` may also be ``"down"`` or ``"up"``. ``scope="table"`` carries
    values across subjects in the order (subject, order_by).

    The largest subject is counted first, unless ``largest`` bounds it. Up to
    ``hot_rows`` rows it is a window per subject; beyond that, and for the whole
    table, the rows are range-split and only the last and first known values of
    each piece travel.
    """
    if scope not in ("subject", "table"):
        raise ValueError(f"unknown scope: {scope}")
    keys = [subject] if scope == "subject" else []
    order = list(order_by) if keys else [subject, *order_by]
    if keys and (largest_group(df, keys) if largest is None else largest) <= hot_rows:
        return df.withColumns({c: _local_fill(c, keys, order, direction) for c in cols})
    return _fill_in_chunks(df, keys, order, list(cols), direction)


def _fill_in_chunks(df: DataFrame, keys: list[str], order: list[str], cols: list[str], direction: str) -> DataFrame:
    chunked = range_chunks(df, [*keys, *order])
    place = _order(order)
    local = chunked.withColumns(
        {f"_{d}_{c}": _local_fill(c, [CHUNK, *keys], order, d) for c in cols for d in ("down", "up")}
    )
    ends = chunked.groupBy(CHUNK, *keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_last_{c}") for c in cols],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_first_{c}") for c in cols],
    )
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy(F.asc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    after = group.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        CHUNK, *keys,
        (F.count(F.lit(1)).over(before) + F.count(F.lit(1)).over(after)).alias("_others"),
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_from_before_{c}") for c in cols],
        *[F.last(f"_first_{c}", ignorenulls=True).over(after).alias(f"_from_after_{c}") for c in cols],
    ).where("_others > 0").drop("_others")
    # A group that spans chunks is the first or the last of each: at most two rows per chunk.
    joined = join_groups(local, F.broadcast(carried), [CHUNK, *keys])
    filled = {}
    for c in cols:
        down = [F.col(f"_down_{c}"), F.col(f"_from_before_{c}")]
        up = [F.col(f"_up_{c}"), F.col(f"_from_after_{c}")]
        filled[c] = F.coalesce(*{"down": down, "up": up, "downup": down + up}[direction])
    return joined.withColumns(filled).select(*df.columns)


def collapse(df: DataFrame, *, subject: str | Sequence[str], order_by: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """One row per subject with the first known value of every column.

    Same result as filling every column and keeping the first row, but as an
    aggregation: combined before the shuffle, no window and no sort of rows.
    """
    keys = [subject] if isinstance(subject, str) else list(subject)
    names = list(cols) if cols is not None else [c for c in df.columns if c not in keys]
    place = _place(df, order_by)
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in names]
    )


def first_row(df: DataFrame, *, subject: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first whole row per subject, missing values kept."""
    keys = [subject] if isinstance(subject, str) else list(subject)
    place = _place(df, order_by)
    # The order is total, so every column is taken from the same row.
    return df.groupBy(*keys).agg(*[F.min_by(c, place).alias(c) for c in df.columns if c not in keys]).select(*df.columns)


def first_value(df: DataFrame, *, subject: str | Sequence[str], order_by: Sequence[str], c: str, skip_missing: bool = False) -> DataFrame:
    """(subject, first value of ``c``), optionally the first known one."""
    keys = [subject] if isinstance(subject, str) else list(subject)
    place = _place(df, order_by)
    if skip_missing:
        place = F.when(F.col(c).isNotNull(), place)
    return df.groupBy(*keys).agg(F.min_by(c, place).alias(c))
