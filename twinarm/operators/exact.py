"""Exact tests on contingency tables counted by Spark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.functions.hypergeometric import SLACK, FarTail, Network, Table, log_binomial, network_paths
from twinarm.functions.tails import chi2_p
from twinarm.operators.scan import strata
from twinarm.session import materialise

PATHS = 20_000  # paths that a task makes at once; from there on they are shared among tasks
DEALT_PATHS = 5_000_000  # paths that one task finishes without dealing them out
FAR_PATHS = 100_000_000  # tables with more paths than this, and p below FAR_P for certain, are integrated
FAR_P = 1e-12
FAR_TERMS = 16  # terms of such an integral that go out as one row
LEAST_LOG = -746.0  # ln of less than the smallest double
PATH_DIGITS = 9  # paths that agree to so many decimals of ln P are one
REPLICATES = 20_000  # random tables, if asked for
BLOCK = 500
METHODS = ("exact", "random", "chi_square")


def fisher_2x2(df: DataFrame, *, arm: str, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """Fisher's exact test of a 0/1 flag by a 0/1 arm: two-sided p, odds ratio, 95% interval.

    The four counts per stratum are one aggregation; only they reach Python.
    """
    df, keys = strata(df.where(F.col(arm).isin(0, 1) & F.col(flag).isin(0, 1)), by)
    cell = {(a, f): F.count(F.when((F.col(arm) == a) & (F.col(flag) == f), 1)) for a in (0, 1) for f in (0, 1)}
    counts = df.groupBy(*keys).agg(*[e.alias(f"n{a}{f}") for (a, f), e in cell.items()])

    @F.pandas_udf("p double, odds_ratio double, ci_low double, ci_high double")
    def test(n00: pd.Series, n01: pd.Series, n10: pd.Series, n11: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c, d in zip(n00, n01, n10, n11):
            t = Table(a, a + c, b + d, a + b)
            rows.append((t.two_sided_p(), *t.odds_ratio()))
        return pd.DataFrame(rows, columns=["p", "odds_ratio", "ci_low", "ci_high"])

    out = counts.withColumn("_t", test("n00", "n01", "n10", "n11"))
    return out.select(*by, "n00", "n01", "n10", "n11", "_t.p", "_t.odds_ratio", "_t.ci_low", "_t.ci_high")


def fisher_levels(
    df: DataFrame, *, level: str, arm: str, by: Sequence[str] = (), method: str = "exact", most_levels: int | None = None,
    replicates: int = REPLICATES, seed: int = 1, weight: str | None = None
) -> DataFrame:
    """Test of a category with any levels by a 0/1 arm: one p per stratum, by the ``method`` asked for.

    ``exact`` covers all tables with the same margins by a network: tasks extend
    paths by a level at a time, and where there are many Spark merges those that meet in a node and deals them out anew. Where the
    likelier tables are too many to be walked and p is at most ``FAR_P`` by a proven bound, p comes from the integral of ``FarTail``,
    about five digits of so small a number; below the smallest double it is 0. ``random`` takes p from
    ``replicates`` random tables with these margins, drawn in blocks over tasks, and
    ``chi_square`` from the limit distribution. The method is a column of the result; it
    is ``none`` (p = 1) where only one table is possible. ``most_levels``, if given, makes
    more levels an error. ``weight`` names a column of counts when the rows are
    already counted.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    df, keys = strata(df.where(F.col(level).isNotNull() & F.col(arm).isin(0, 1)), by)
    amount = F.lit(1).cast("long") if weight is None else F.col(weight)
    cells = df.groupBy(*keys, level).agg(F.sum(amount).alias("_n"), F.sum(F.when(F.col(arm) == 1, amount).otherwise(0)).alias("_a"))
    # One cell per level and stratum; larger rows last, so the early stages are small.
    tables = cells.where("_n > 0").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", "_a"))).alias("_cells"))
    total = F.aggregate("_cells", F.lit(0).cast("long"), lambda s, c: s + c["_n"])
    column = F.aggregate("_cells", F.lit(0).cast("long"), lambda s, c: s + c["_a"])
    tables = tables.select(
        *keys, F.transform("_cells", lambda c: c["_n"]).alias("_rows"), F.transform("_cells", lambda c: c["_a"]).alias("_ones"),
        total.alias("n"), column.alias("_column"), F.size("_cells").alias("levels"),
    )
    if most_levels is not None:
        few = F.when(F.col("levels") > most_levels, F.raise_error(F.lit("more levels than allowed"))).otherwise(F.col("levels"))
        tables = tables.where(few > 0)
    trivial = (F.col("levels") < 2) | (F.col("_column") == 0) | (F.col("_column") == F.col("n"))
    tables = materialise(tables.withColumn("method", F.when(trivial, "none").otherwise(method)))
    expected = F.aggregate(
        F.arrays_zip("_rows", "_ones"), F.lit(0.0),
        lambda s, c: s + F.pow(c["_ones"] - c["_rows"] * F.col("_column") / F.col("n"), F.lit(2.0))
        / (c["_rows"] * F.col("_column") / F.col("n") * (1 - F.col("_column") / F.col("n"))),
    )
    rest = tables.where("method in ('none', 'chi_square')").withColumn(
        "_x2", F.when(F.col("method") == "none", F.lit(0.0)).otherwise(expected)
    )
    out = rest.select(
        *keys, "levels", "n", "method",
        F.when(F.col("method") == "none", F.lit(1.0)).otherwise(chi2_p(F.col("_x2"), F.col("levels") - 1)).alias("p"),
    )
    if method == "exact":
        out = out.unionByName(_through_network(tables.where("method = 'exact'"), keys))
    if method == "random":
        out = out.unionByName(_random_tables(tables.where("method = 'random'"), keys, replicates, seed))
    return out.select(*by, "levels", "n", "method", "p")


def merged(left: np.ndarray, lp: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths that meet in a node with the same probability as one."""
    near = np.round(lp, PATH_DIGITS)
    order = np.lexsort((near, left))
    left, near, lp, paths = left[order], near[order], lp[order], paths[order]
    if not len(left):
        return left, lp, paths
    starts = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (near[1:] != near[:-1])]))
    return left[starts], lp[starts], np.add.reduceat(paths, starts)


def _through_network(tables: DataFrame, keys: list[str]) -> DataFrame:
    """p of each table: paths extended level by level, merged where they meet, and dealt out anew where there are many."""
    most = tables.agg(F.max("levels")).first()[0] or 0
    width = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*keys, "levels", "n", "method"]
    tables = tables.withColumn("_table", F.monotonically_increasing_id())
    fixed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tables.select(*names).schema)
    state = f"{fixed}, _table bigint, _rows array<bigint>, _share double, _whole double, _most double, _place int, _left bigint, _lp double, _paths double"
    fields = [*names, "_table", "_rows", "_share", "_whole", "_most", "_place", "_left", "_lp", "_paths"]

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            share = batch["_column"].to_numpy(float) / batch["n"].to_numpy(float)
            seen = [float(log_binomial(np.asarray(r, float), np.asarray(o, float), s).sum()) for r, o, s in zip(batch["_rows"], batch["_ones"], share)]
            whole = log_binomial(batch["n"].to_numpy(float), batch["_column"].to_numpy(float), share)
            yield batch[[*names, "_table", "_rows"]].assign(
                _share=share, _whole=whole, _most=np.array(seen) + SLACK, _place=0, _left=batch["_column"], _lp=0.0, _paths=1.0)[fields]

    def row(batch: pa.RecordBatch, rows: np.ndarray, place: int, left, lp, paths, share) -> pa.RecordBatch:
        taken = batch.take(pa.array(rows))
        made = {"_place": pa.array(np.full(len(rows), place), pa.int32()), "_left": pa.array(np.asarray(left).astype(np.int64)), "_lp": pa.array(lp, pa.float64()),
                "_paths": pa.array(paths, pa.float64())}
        return pa.RecordBatch.from_arrays([*(made.get(f, taken.column(f)) for f in fields), share], names=[*fields, "share"])

    def far(head: dict) -> FarTail | None:
        """The integral for a table whose network is too large, if p is surely negligible beside 1."""
        if network_paths(head["_rows"], head["_share"], head["_most"]) <= FAR_PATHS:
            return None
        tail = FarTail(head["_rows"], round(head["_share"] * head["n"]), head["_share"], head["_most"], head["_whole"])
        return tail if tail.log_bound < np.log(FAR_P) else None

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, places = batch.column("_table").to_numpy(), batch.column("_place").to_numpy()
            for number, place in np.unique(np.stack([table, places]), axis=1).T.tolist():
                mine = np.flatnonzero((table == number) & (places == place))
                one = mine[:1]
                head = batch.slice(int(one[0]), 1).to_pylist()[0]
                net, total = Network(head["_rows"], head["_share"], head["_most"]), 0.0
                left, lp, paths = (batch.column(c).to_numpy()[mine].astype(float) for c in ("_left", "_lp", "_paths"))
                if place < 0:  # terms of an integral, whose first ones stand for the column
                    tail = far(head)
                    total = sum(tail.share(int(k), int(k) + FAR_TERMS) for k in left)
                    yield row(batch, one, 0, [0], [0.0], [0.0], pa.array([float(total * np.exp(tail.log_bound))]))
                    continue
                if place == 0 and len(head["_rows"]) > 2:
                    # No more tables than this, none likelier than the observed one.
                    if head["_most"] - head["_whole"] + np.log1p(np.array(head["_rows"][:-1], float)).sum() < LEAST_LOG:
                        left = left[:0]
                    elif (tail := far(head)) is not None:
                        at = np.arange(0, tail.terms, FAR_TERMS)
                        yield row(batch, np.repeat(one, len(at)), -1, at, np.zeros(len(at)), np.ones(len(at)), pa.nulls(len(at), pa.float64()))
                        left = left[:0]
                came = place
                while len(left):
                    first, last = net.inner(place, left, lp)
                    wide = np.maximum(last - first + 1, 0).astype(int)
                    ends = np.cumsum(wide)
                    # Many paths into few nodes: the last levels are listed once a node.
                    closing = place == len(head["_rows"]) - 3 and ends[-1] > max(PATHS, 8 * ((left - first).max() - (left - last).min() + 1))
                    if closing and place > came and ends[-1] > DEALT_PATHS:
                        yield row(batch, np.repeat(one, len(left)), place, left, lp, paths, pa.nulls(len(left), pa.float64()))
                        break
                    total += float((paths * np.exp(lp - head["_whole"]) * net.outer(place, left, first, last)).sum())
                    if place == len(head["_rows"]) - 2:
                        break  # the last level takes what is left: what is inside is likelier than the observed table
                    if closing:
                        total += net.tail_of_last_three(left, lp, paths * np.exp(-head["_whole"]), first, last)
                        break
                    place, on = place + 1, ends[-1] <= PATHS
                    for rows in [np.arange(len(left))] if on else np.split(np.arange(len(left)), np.flatnonzero(np.diff(ends // PATHS)) + 1):
                        node = np.repeat(rows, wide[rows])
                        x = first[node] + np.arange(len(node)) - np.repeat(np.cumsum(wide[rows]) - wide[rows], wide[rows])
                        further = lp[node] + log_binomial(net.rows[place - 1], x, net.share)
                        kept = further + net.shortest(place, left[node] - x) <= net.most
                        met = merged((left[node] - x)[kept], further[kept], paths[node[kept]])
                        if not on:
                            yield row(batch, np.repeat(one, len(met[0])), place, *met, pa.nulls(len(met[0]), pa.float64()))
                    if not on:
                        break  # from here on the nodes are shared among tasks
                    left, lp, paths = met
                yield row(batch, one, 0, [0], [0.0], [0.0], pa.array([total]))

    nodes = tables.select(*names, "_table", "_rows", "_ones", "_column").repartition(width, "_table").mapInPandas(begin, state)
    shares = None
    for _ in range(max(most - 1, 0)):
        done = materialise(nodes.mapInArrow(extend, f"{state}, share double"))
        part = done.where("share is not null").groupBy(*names).agg(F.sum("share").alias("share"))
        shares = part if shares is None else shares.unionByName(part)
        left = done.where("share is null")
        if left.isEmpty():
            break
        # The number of partitions is given: the rows are small, the work on each is not.
        met = left.withColumn("_near", F.round("_lp", PATH_DIGITS)).repartition(width, "_table", "_place", "_left", "_near")
        told = [F.any_value(c).alias(c) for c in fields if c not in ("_table", "_place", "_left", "_lp", "_paths")]
        nodes = met.groupBy("_table", "_place", "_left", "_near").agg(F.min("_lp").alias("_lp"), F.sum("_paths").alias("_paths"), *told).select(*fields)
    if shares is None:
        return tables.select(*names, F.lit(None).cast("double").alias("p"))
    return shares.groupBy(*names).agg(F.greatest(F.least(F.sum("share"), F.lit(1.0)), F.lit(0.0)).alias("p"))


def _random_tables(tables: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """p of each table from random ones with its margins."""
    names = [*keys, "levels", "n", "method"]
    drawn = tables.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(np.ceil(replicates / BLOCK)) - 1).cast("long"))))
    # Spread by block number, so one table uses every task. The number of partitions is given because
    # the rows are small and would otherwise be merged into one task.
    width = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = drawn.repartition(width, *[F.col(k) for k in keys], F.col("_first"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tables.select(*names).schema)

    def work_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shares = []
            for rows, ones, column, first in zip(batch["_rows"], batch["_ones"], batch["_column"], batch["_first"]):
                rows, ones = np.asarray(rows, float), np.asarray(ones, float)
                share = float(column) / rows.sum()
                rng = np.random.default_rng([seed, int(first), int(column)])
                draws = rng.multivariate_hypergeometric(rows.astype(np.int64), int(column), size=BLOCK)
                seen = log_binomial(rows, ones, share).sum()
                shares.append(float((log_binomial(rows, draws, share).sum(axis=1) <= seen + SLACK).sum()))
            yield batch[names].assign(share=shares)

    done = drawn.select(*names, "_rows", "_ones", "_column", "_first").mapInPandas(work_on, f"{schema}, share double").groupBy(*names).agg(
        F.sum("share").alias("_share"), F.count(F.lit(1)).alias("_blocks"))
    return done.select(*names, ((1 + F.col("_share")) / (1 + F.col("_blocks") * BLOCK)).alias("p"))
