"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinarm.session import shared_folder

#: Rows, and bytes, that a Python worker gets at once.
BATCH_ROWS = 2000
BATCH_BYTES = 4_000_000
#: Letters of scripts that are written without spaces between words: Thai, Lao, Burmese, Khmer, kana, bopomofo, Han (fixed values).
UNSPACED = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
    "\U00020000-\U0003ffff]")


def spaced(text: str) -> str:
    """The text with white space on both sides of each letter of a script without spaces."""
    return text if text.isascii() else UNSPACED.sub(r" \g<0> ", text)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lineage ends at files that every executor can read, so a lost executor costs no
    earlier stage. The folder is the one of ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, most_rows: int, salt: int) -> DataFrame:
    """The rows of the ``most_rows`` keys with the lowest digests.

    Only keys are ordered; at most ``most_rows`` of them are sent to the rows, which
    are not moved. Rows without a key are left out, rows with the same key stay together.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key, F.lit(salt)), key).limit(most_rows)
    return df.join(F.broadcast(keys), key)


def arrow_schema(ddl: str) -> pa.Schema:
    """An Arrow schema from ``name type, ...`` with the few types used here."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "float": pa.float32(),
    }
    parts = [field.split() for field in ddl.split(",")]
    return pa.schema([(name, kinds[kind]) for name, kind in parts])


def free_name(df: DataFrame, base: str) -> str:
    """A name that starts with ``base`` and that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(name for name in (base + "_" * k for k in range(1, len(taken) + 2)) if name.lower() not in taken)


def other_columns(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those named so, whatever their case."""
    lowered = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in lowered]


def bound_batches(spark: SparkSession) -> None:
    """Send fewer rows at once to Python workers than the default, as texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(BATCH_ROWS))


def small_batches(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of a few megabytes, so that what is made from them stays small too."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def per_batch(df: DataFrame, source: str | Column, outputs: str, make: Callable) -> DataFrame:
    """Add columns computed from one column, Arrow batch by Arrow batch.

    ``source`` is a column's name or an expression. ``make`` is called once per task and
    returns a function from the Arrow array of a batch to the values of each output and
    the numbers of the rows that they stand for, or None for all in turn. Columns of
    ``df`` that are named like an output, whatever their case, are replaced; all others
    pass through under any name.
    """
    schema = arrow_schema(outputs)
    names = other_columns(df, *schema.names)
    fields = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    target = ", ".join(filter(None, [fields, *(f"`{f.split()[0]}` {_ddl(f.split()[1])}" for f in outputs.split(","))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in small_batches(batches):
            compute = compute or make()
            found, rows = compute(batch.column(0))
            base = batch.select(names) if rows is None else batch.select(names).take(pa.array(rows))
            made = [v.cast(f.type) if isinstance(v := found[f.name], pa.Array) else pa.array(v, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*base.columns, *made], names=[*names, *schema.names])

    bound_batches(df.sparkSession)
    value = F.col(f"`{source}`") if isinstance(source, str) else source
    hidden = free_name(df, "source")
    return df.select(value.alias(hidden), *(F.col(f"`{n}`") for n in names)).mapInArrow(run, target)


def per_row(df: DataFrame, source: str | Column, outputs: str, make: Callable[[], Callable[[list], dict[str, list]]]) -> DataFrame:
    """``per_batch`` for functions from a list of Python values to lists of values."""
    def make_batch():
        compute = make()
        return lambda values: (compute(values.to_pylist()), None)

    return per_batch(df, source, outputs, make_batch)


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], salt: Column, how: str = "inner", most: int = 100_000, salts: int = 64) -> DataFrame:
    """Join ``groups``, a written table with one row per key, to ``rows`` whatever number of rows a key has.

    Up to ``most`` groups are sent to the rows, which then are not moved. Beyond that
    both sides are shuffled by key and by ``salt`` modulo ``salts``, so that the rows of
    one key go to that many tasks. Keys are compared null-safe.
    """
    on = lambda left, right, names: functools.reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in names))
    added = [F.col(f"g.{c}") for c in groups.columns if c not in keys]
    if groups.count() <= most:
        return rows.alias("r").join(F.broadcast(groups).alias("g"), on("r", "g", keys), how).select("r.*", *added)
    part = free_name(rows, "salt")
    left = rows.withColumn(part, F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = groups.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.alias("r").join(right.alias("g"), on("r", "g", [*keys, part]), how).select(*(F.col(f"r.{c}") for c in rows.columns), *added)


def _ddl(kind: str) -> str:
    return {"long": "bigint"}.get(kind, kind).replace("<long>", "<bigint>")
