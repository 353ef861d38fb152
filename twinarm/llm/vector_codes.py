"""Compression of vectors to short codes: an exact k-means codebook for each part of a vector.

Entries become whole numbers, so that sums, distances and ties are the same whatever
the order of rows. Distances come from products of matrices split into limbs (see
``vectors.exact_products``); of equal ones the first counts. Each round is one pass over
the rows: a task adds up its own parts by entry, so at most parts x entries rows of a
task are shuffled, and a group of copies costs no more than others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.common import bound_batches, lookup, other_columns, per_batch, small_batches, written
from twinarm.llm.vectors import exact_products, lengths, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]`` is a matrix of whole numbers, a row for each entry; vectors have ``size`` entries."""

    size: int
    scale: int
    entries: tuple[np.ndarray, ...]

    @property
    def reach(self) -> int:
        """The largest whole number with which the error of a vector fits in 64 bits."""
        return math.isqrt((2**63 - 1) // (4 * max(1, self.size)))

    def sha256(self) -> str:
        """Digest of all entries' whole numbers by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(v) for book in self.entries for v in book.ravel().tolist()).encode()).hexdigest()

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose vectors can be coded, and their whole numbers."""
        rows, values = matrix(column, self.size)
        scaled = np.floor(values * self.scale)
        near = (np.abs(scaled) <= self.reach).all(1)
        return rows[near], scaled[near].astype(np.int64)

    def assign(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part, ties to the first, and the squared distances summed over parts."""
        width = self.size // len(self.entries)
        codes, error = np.zeros((len(numbers), len(self.entries)), np.int64), np.zeros(len(numbers), np.int64)
        for p, book in enumerate(self.entries):
            part = numbers[:, p * width:(p + 1) * width]
            distance = (part * part).sum(1)[:, None] - 2 * exact_products(part, book) + (book * book).sum(1)
            codes[:, p] = distance.argmin(1)
            error += np.take_along_axis(distance, codes[:, p:p + 1], 1)[:, 0]
        return codes, error


def _first_vectors(df: DataFrame, vector: str, key: str, entries: int, scale: int) -> tuple[int, list[list[float]]]:
    """The commonest length of vectors, the longer one of ties, and the vectors of the smallest keys with that length, in order."""
    reach = lambda size: Codebooks(size, scale, ()).reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        least: dict[int, dict] = {}
        for batch in small_batches(batches):
            keys, column = batch.column(1).to_pylist(), batch.column(0)
            for size in np.unique(lengths(column)).tolist():
                if size < 0:
                    continue
                rows, values = matrix(column, size)
                near = (np.abs(np.floor(values * scale)) <= reach(size)).all(1)
                counts[size] = counts.get(size, 0) + int(near.sum())
                mine = least.setdefault(size, {})
                for row, value in zip(rows[near].tolist(), values[near].tolist(), strict=True):
                    if keys[row] is not None and (len(mine) < entries or keys[row] <= max(mine)):
                        mine[keys[row]] = min(mine.get(keys[row], value), value)
                        if len(mine) > entries:
                            del mine[max(mine)]
        rows = [(size, n, None, None) for size, n in counts.items()] + [(size, 0, k, v) for size, mine in least.items() for k, v in mine.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["size", "n", "key", "value"])

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
    bound_batches(df.sparkSession)
    found = written(df.select(F.col(f"`{vector}`").alias("v"), F.col(f"`{key}`").cast("long").alias("k")).where("v is not null").mapInArrow(
        run, "size bigint, n bigint, key bigint, value array<double>"), "first-vectors")
    best = found.groupBy("size").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return 0, []
    firsts = found.where((F.col("size") == best["size"]) & F.col("key").isNotNull()).groupBy("key").agg(F.min("value").alias("value")).orderBy("key").limit(entries)
    return best["size"], [r["value"] for r in firsts.collect()]


def _sums(df: DataFrame, books: Codebooks, vector: str) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By part and entry the number of parts nearest to it, and their sum. One pass."""
    n_parts, n_entries = len(books.entries), len(books.entries[0])
    width = books.size // n_parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((n_parts, n_entries), np.int64), np.zeros((n_parts, n_entries, width), np.int64)
        for batch in small_batches(batches):
            _, numbers = books.numbers(batch.column(0))
            codes, _ = books.assign(numbers)
            for p in range(n_parts):
                chosen = (codes[:, p] == np.arange(n_entries)[:, None]).astype(np.int64)
                counts[p] += chosen.sum(1)
                sums[p] += exact_products(chosen, np.ascontiguousarray(numbers[:, p * width:(p + 1) * width].T))
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])

    found = df.select(F.col(f"`{vector}`").alias("v")).where("v is not null").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    cells = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
    total = cells.groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for row in total.orderBy("part", "entry", "at").collect():  # parts x entries x width numbers
        out.setdefault((row["part"], row["entry"]), (int(row["n"]), []))[1].append(int(row["value"]))
    return out


def fit(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks from all vectors of ``df``, which is read once more than there are rounds.

    Vectors that are null or hold null or a number that is not finite are left out; so are
    those of another length than most have, and those with a number so large that an
    error would not fit in 64 bits. Codebooks start as the vectors of the smallest
    distinct keys (of one key the smallest vector; a null key is none); with fewer keys
    than ``entries`` they are shorter, with none they are empty. A length that ``parts``
    does not divide is an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256, as a code is two hex digits")
    size, first = _first_vectors(df, vector, key, entries, scale)
    if size % parts:
        raise ValueError(f"vectors of {size} entries cannot be cut into {parts} equal parts")
    start = np.floor(np.array(first, np.float64).reshape(len(first), size) * scale).astype(np.int64)
    books = Codebooks(size, scale, tuple(np.ascontiguousarray(x) for x in np.split(start, parts, axis=1)))
    for _ in range(rounds if first else 0):
        fresh = [book.copy() for book in books.entries]
        for (part, entry), (n, sums) in _sums(df, books, vector).items():
            fresh[part][entry] = [s // n for s in sums]
        books = Codebooks(size, scale, tuple(fresh))
    return books


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """The rows of ``df`` whose vector holds only finite numbers, with ``code`` and ``error`` (columns of these names are replaced).

    ``code`` has two hex digits for each part. Vectors that were left out of the fit for
    their length or size have a null code and error.
    """
    def make():
        def compute(column: pa.Array):
            sizes = lengths(column)
            finite = np.sort(np.concatenate([matrix(column, n)[0] for n in np.unique(sizes[sizes >= 0])] or [np.zeros(0, np.int64)]))
            if not len(books.entries[0]):
                return {"code": [None] * len(finite), "error": [None] * len(finite)}, finite
            rows, numbers = books.numbers(column)
            codes, error = books.assign(numbers)
            told = dict(zip(rows.tolist(), zip((bytes(c).hex() for c in codes.astype(np.uint8)), error.tolist(), strict=True), strict=True))
            found = [told.get(r, (None, None)) for r in finite.tolist()]
            return {"code": [c for c, _ in found], "error": [e for _, e in found]}, finite

        return compute

    return per_batch(df, vector, "code string,error long", make)


def with_group_error(coded: DataFrame, group: str = "label", name: str = "group_error") -> DataFrame:
    """Add the sum of ``error`` over the rows with the same ``group``, nulls together; null where no error is known or the sum exceeds 64 bits.

    ``coded`` should be a written table, as it is read twice. Sums are made before rows are joined.
    """
    sums = coded.groupBy(F.col(f"`{group}`").alias(group)).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias(name)).withColumn(name, F.expr(f"try_cast(`{name}` as bigint)"))
    return lookup(coded.select(other_columns(coded, name)), sums, [group], F.struct("code", "error"), "left")
