"""Exact duplicates by polynomial fingerprints that compose.

The fingerprint of a text is the value of the polynomial with its bytes as coefficients,
modulo two primes. That of two parts in a row is the first one's times the base to the
length of the second, plus the second one's; so chunks are hashed side by side, and those
of a very long text in different tasks. Texts with the same fingerprint and length are
then compared with one of them: those of another SHA-256 differ, of the others all bytes
are compared, piece by piece; where texts differ after all, the comparison goes on among
those left. Nothing but fingerprints and candidate texts moves, one a digest from each task.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinarm.llm.common import per_batch, written

#: Primes below 2**31 and the bases of the polynomials (fixed values).
MODULI = (2147483647, 2147483629)
BASES = (1099087573, 1566083941)
#: Bytes that are hashed side by side; 255 * 2**31 * CHUNK stays below 2**53, so sums of doubles are exact.
CHUNK = 1024
CHUNKS_AT_ONCE = 4096
#: Bytes of a piece of a text; longer texts are hashed and compared in several.
PIECE_BYTES = 1 << 20
#: Rows of a group that are compared in one task.
GROUP_ROWS = 512
#: A key with more than one in so many rows is dealt out to SALTS tasks.
HEAVY_KEYS = 1000
SALTS = 64
#: Bits for each group in the table that tells which texts may belong to one, and bits at most (16 MB).
BITS_EACH = 32
MOST_BITS = 1 << 27


def combine(left: int, right: int, right_bytes: int, base: int, modulus: int) -> int:
    """The fingerprint of two parts in a row."""
    return (left * pow(base, right_bytes, modulus) + right) % modulus


def _powers(base: int, modulus: int, count: int) -> np.ndarray:
    out = np.ones(count, np.int64)
    for i in range(1, count):
        out[i] = out[i - 1] * base % modulus
    return out


class Hasher:
    """Fingerprints of byte strings, chunk by chunk."""

    def __init__(self, moduli: tuple[int, ...] = MODULI, bases: tuple[int, ...] = BASES):
        self.moduli, self.bases = moduli, bases
        self.weights = np.stack([_powers(b, m, CHUNK)[::-1] for b, m in zip(bases, moduli, strict=True)], 1).astype(np.float64)
        self.shifts = [np.ones(1, np.int64) for _ in moduli]

    def _shift(self, k: int, chunks: np.ndarray) -> np.ndarray:
        """The base to the bytes of so many chunks."""
        most = int(chunks.max(initial=0))
        if most >= len(self.shifts[k]):
            self.shifts[k] = _powers(pow(self.bases[k], CHUNK, self.moduli[k]), self.moduli[k], 2 * most + 1)
        return self.shifts[k][chunks]

    def hash(self, column: pa.Array) -> list[np.ndarray]:
        """For each modulus the fingerprint of each byte string; null counts as empty."""
        column = pc.fill_null(column, b"").cast(pa.large_binary())
        column = pa.concat_arrays([column])  # from the start of its own buffers
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        counts = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(sizes)), counts)
        ends = np.cumsum(counts)
        after = np.repeat(ends, counts) - np.arange(len(owner)) - 1  # chunks that follow; only the first one of a text may be short
        stop = offsets[1:][owner] - after * CHUNK
        found = np.zeros((len(owner), len(self.moduli)), np.int64)
        for at in range(0, len(owner), CHUNKS_AT_ONCE):
            mine = slice(at, at + CHUNKS_AT_ONCE)
            place = stop[mine, None] - CHUNK + np.arange(CHUNK)
            lanes = np.where(place >= offsets[:-1][owner[mine], None], data[np.maximum(place, 0)] if len(data) else 0, 0).astype(np.float64)
            found[mine] = (lanes @ self.weights).astype(np.int64)
        out = []
        for k, modulus in enumerate(self.moduli):
            moved = found[:, k] % modulus * self._shift(k, after) % modulus
            total = np.concatenate([[0], np.cumsum(moved)])  # below 2**31 each
            out.append((total[ends] - total[ends - counts]) % modulus)
        return out


def _pieces(rows: DataFrame, bytes_: Column, size: int) -> DataFrame:
    """A row for each piece of a byte string: ``no`` from 0 on, ``piece`` and ``after``, the bytes that follow. Empty strings have one."""
    last = F.greatest(F.ceil(F.octet_length(bytes_) / F.lit(size)).cast("int") - 1, F.lit(0))
    each = rows.select("*", bytes_.alias("_bytes"), F.explode(F.sequence(F.lit(0), last)).alias("no"))
    return each.withColumn("piece", F.substring("_bytes", F.col("no") * size + 1, F.lit(size))).withColumn(
        "after", F.greatest(F.octet_length("_bytes") - (F.col("no") + 1) * size, F.lit(0))).drop("_bytes")


def fingerprints(df: DataFrame, text: str, doc_id: str, piece_bytes: int = PIECE_BYTES, moduli: tuple[int, ...] = MODULI, bases: tuple[int, ...] = BASES) -> DataFrame:
    """One row per text: doc_id, sha (SHA-256 of its bytes), n_bytes, fingerprint.

    Texts of up to ``piece_bytes`` bytes are hashed where they are. Longer ones are cut into
    pieces that other tasks hash, each moved to its place by the bytes that follow, and
    the pieces of a text added up; copies of it under one id are counted and listed again.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    told = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), value.alias("value")).withColumns({
        "sha": _digest(F.col("value")), "n_bytes": F.octet_length("value").cast("long")})

    def make():
        hasher = Hasher(moduli, bases)
        return lambda column: ({f"h{k}": h for k, h in enumerate(hasher.hash(column))}, None)

    hashes = [f"h{k}" for k in range(len(moduli))]
    fields = ",".join(f"{h} long" for h in hashes)
    short = per_batch(told.where(F.col("n_bytes") <= piece_bytes), "value", fields, make).drop("value")
    cut = _pieces(told.where(F.col("n_bytes") > piece_bytes).select("doc_id", "sha", "n_bytes", "value"), F.col("value"), piece_bytes).drop("value")
    spread = cut.repartition("doc_id", "sha", "no")

    def make_moved():
        hasher = Hasher(moduli, bases)

        def compute(column: pa.Array):
            after = pc.struct_field(column, "after").to_pylist()
            found = hasher.hash(pc.struct_field(column, "piece"))
            return {f"h{k}": [int(v) * pow(b, a, m) % m for v, a in zip(h, after, strict=True)] for k, (h, b, m) in enumerate(zip(found, bases, moduli, strict=True))}, None

        return compute

    moved = per_batch(spread, F.struct("piece", "after"), fields, make_moved)
    copies = F.sum((F.col("no") == 0).cast("long")).alias("copies")
    whole = moved.groupBy("doc_id", "sha", "n_bytes").agg(copies, *(F.sum(h).alias(h) for h in hashes))
    whole = whole.withColumns({h: F.expr(f"(`{h}` div copies) % {m}") for h, m in zip(hashes, moduli, strict=True)})
    long = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "sha", "n_bytes", *hashes)
    key = F.col("h0")
    for h in hashes[1:]:
        key = F.shiftleft(key, 31).bitwiseXOR(F.col(h))
    return short.select("doc_id", "sha", "n_bytes", *hashes).unionByName(long).select("doc_id", "sha", "n_bytes", key.alias("fingerprint"))


def _digest(bytes_: Column) -> Column:
    return F.unhex(F.sha2(bytes_, 256))


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str, most: int) -> DataFrame:
    """Join ``groups``, one row per key, to the written ``rows``; ``size`` has the number of rows of a key. Keys are compared null-safe.

    Up to ``most`` groups are sent to the rows. More are shuffled with them by key and never
    broadcast, however small Spark takes them to be. Of a key that has more than one in
    ``HEAVY_KEYS`` rows the group is repeated, and its rows are dealt out; such keys are few.
    """
    on = lambda names: functools.reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in names))
    columns = [*(F.col(f"r.{c}") for c in rows.columns), *(F.col(f"g.{c}") for c in groups.columns if c not in keys)]
    if groups.count() <= most:
        return rows.alias("r").join(F.broadcast(groups).alias("g"), on(keys), how).select(*columns)
    heavy = F.col(size) > rows.count() // HEAVY_KEYS
    marks = groups.where(heavy).select(*keys, F.lit(SALTS).alias("salts"))
    salt = F.when(F.col("g.salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("r.row"), F.lit(SALTS)).cast("int"))
    dealt = rows.alias("r").join(F.broadcast(marks).alias("g"), on(keys), "left").select("r.*", salt.alias("salt"))
    repeated = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(heavy, F.lit(SALTS - 1)).otherwise(F.lit(0)))))
    return dealt.alias("r").join(repeated.hint("merge").alias("g"), on([*keys, "salt"]), how).select(*columns)


def _sieved(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose ``sha`` is the ``last_sha`` of a group, and a few others, as a table of bits for their hashes tells; at most ``MOST_BITS`` bits are sent to the rows."""
    bits = min(MOST_BITS.bit_length() - 1, max((BITS_EACH * groups.count()).bit_length(), 16))
    place = lambda sha: F.shiftrightunsigned(F.xxhash64(sha), 64 - bits)
    bucket, bit = (lambda sha: F.shiftright(place(sha), 15)), (lambda sha: place(sha).bitwiseAND(F.lit((1 << 15) - 1)))
    table = groups.groupBy(bucket("last_sha").alias("bucket")).agg(F.bitmap_construct_agg(bit("last_sha")).alias("bits"))
    told = rows.withColumns({"bucket": bucket("sha"), "bit": bit("sha")}).join(F.broadcast(table), "bucket")
    is_set = F.expr("bit_get(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) = 1")
    return told.where(is_set).select(*rows.columns)


def _grouped(prints: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of two rows or more: their number of rows, the id, digest and row of the one with the largest id, and whether digests differ."""
    last = F.max(F.struct("doc_id", "sha", "row"))
    return written(prints.groupBy(*keys).agg(F.count("*").alias("texts"), last.alias("last"), (F.min("sha") != F.max("sha")).alias("mixed")).where("texts > 1").select(
        *keys, "texts", F.col("last.doc_id").alias("last_id"), F.col("last.sha").alias("last_sha"), F.col("last.row").alias("last_row"), "mixed"), "groups")


def _unlike(df: DataFrame, groups: DataFrame, text: str, piece_bytes: int) -> DataFrame:
    """Digests of groups, of which some text differs from another in a byte. Each task sends on one text a digest, or the least and largest of different ones."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    told = _sieved(df.select(value.alias("value")).withColumn("sha", _digest(F.col("value"))), groups)
    cut = _pieces(told, F.col("value"), piece_bytes).select("sha", "no", "piece")
    ends = cut.groupBy("sha", "no").agg(F.min("piece").alias("least"), F.max("piece").alias("largest"))
    return written(ends.where(F.col("least") != F.col("largest")).select("sha").distinct(), "unlike")


def _different(df: DataFrame, prints: DataFrame, groups: DataFrame, keys: list[str], text: str, doc_id: str, piece_bytes: int, most: int) -> DataFrame:
    """(doc_id, sha, copies) of the texts that are not byte for byte the last one of their group.

    Those with another digest are not; of those with the same one all bytes are compared.
    """
    members = lambda of: _joined(prints, of.select(*keys, "texts", "last_id", "last_sha"), keys, "texts", "inner", most)
    found = members(groups.where("mixed")).where(F.col("sha") != F.col("last_sha")).groupBy("doc_id", "sha").agg(F.count("*").alias("copies"))
    unlike = _unlike(df, groups, text, piece_bytes)
    if not unlike.isEmpty():  # one digest of different texts
        alike = members(groups.join(unlike, F.col("last_sha") == F.col("sha"), "left_semi")).where(F.col("sha") == F.col("last_sha"))
        alike = written(alike.groupBy("doc_id", "sha", *keys, "texts", "last_id").agg(F.count("*").alias("copies")), "members")
        value = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
        told = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), value.alias("value")).withColumn("sha", _digest(F.col("value")))
        on = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.sha") == F.col("g.sha"))
        texts = told.alias("r").join(alike.hint("merge").alias("g"), on).select("g.*", "r.value")
        cut = _pieces(texts, F.col("value"), piece_bytes).drop("value", "after")
        # A large group is dealt out; each part gets its own copy of the text that the others are compared with.
        parts = F.ceil(F.col("texts") / F.lit(GROUP_ROWS)).cast("int")
        is_last = F.col("doc_id").eqNullSafe(F.col("last_id"))
        others = cut.where(~is_last).withColumn("part", F.pmod(F.xxhash64("doc_id", "sha"), parts).cast("int"))
        last = cut.where(is_last).select(*keys, "no", F.col("piece").alias("other"), parts.alias("parts")).dropDuplicates([*keys, "no"])
        last = last.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        apart = others.join(last, [*keys, "no", "part"]).where(F.col("piece") != F.col("other"))
        found = found.unionByName(apart.select("doc_id", "sha", "copies").distinct())
    return written(found, "different")


def mark_duplicates(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", piece_bytes: int = PIECE_BYTES, moduli: tuple[int, ...] = MODULI, bases: tuple[int, ...] = BASES,
    broadcast_groups: int = 100_000,
) -> DataFrame:
    """One row per text: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are byte for byte the same; a null text is an empty one. Of
    equal texts the row with the largest doc_id stays (``keep_id``); a null id is smaller than
    any other, and of rows with the same id one stays. ``group_size`` counts rows. Groups
    of up to ``broadcast_groups`` are sent to the rows; more are joined in a shuffle.
    """
    prints = written(fingerprints(df, text, doc_id, piece_bytes, moduli, bases).withColumns({"row": F.monotonically_increasing_id(), "round": F.lit(0)}), "fingerprints")
    keys = ["fingerprint", "n_bytes", "round"]
    groups = todo = _grouped(prints, keys)
    step = 0
    while not todo.isEmpty():
        different = _different(df, prints, todo, keys, text, doc_id, piece_bytes, broadcast_groups)
        if different.isEmpty():
            break
        step += 1
        marked = _joined(prints, different, ["doc_id", "sha"], "copies", "left", broadcast_groups)
        prints = written(marked.withColumn("round", F.when(F.col("copies").isNotNull(), F.lit(step)).otherwise(F.col("round"))).drop("copies"), "fingerprints")
        groups = _grouped(prints, keys)
        todo = groups.where(F.col("round") == step)
    found = _joined(prints, groups.drop("last_sha", "mixed"), keys, "texts", "left", broadcast_groups)
    return found.select(
        "doc_id", F.when(F.col("texts").isNull(), F.col("doc_id")).otherwise(F.col("last_id")).alias("keep_id"),
        F.coalesce("texts", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("row") == F.col("last_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
