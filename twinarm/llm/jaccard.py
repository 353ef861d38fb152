"""Join of texts whose sets of word shingles are alike, by prefix filtering.

Shingles are ordered by the number of texts that have them, rare ones first. Two sets
with a Jaccard similarity of t share a shingle among the first |s| - ceil(t |s|) + 1 of
each, and a shingle that only one text has can be shared with none. So only the
repeated shingles of these prefixes are joined, pairs pass length and positional
filters there, and each pair is verified once, after a suffix filter.

Steps and what they move:

1. Each task turns some of its texts into shingle digests and sends them out by range
   of digest, packed, with copies of a text and shingles of many texts counted once.
2. For each range the number of texts is counted; shingles of one text end here. The
   repeated ones go back to where they came from.
3. There they are ordered, and a text keeps its prefix and its repeated shingles, which
   are all that a verification needs.
4. Shingles of few texts give all their pairs. At its rarest shingles of many texts each
   text is paired with some pivots; texts that pivots did not bring into the group's largest
   component are then paired with all its others that pass a filter on marked bits. No
   link is lost: pairs that are left out are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.common import bound_batches, free_name, lookup, per_row, written
from twinarm.llm.components import components

SHINGLE = 5
PERCENT = 80
#: Characters of texts that are packed together.
PACK_CHARS = 4_000_000
#: Bytes of text for each range of digests.
RANGE_BYTES = 8_000_000
#: Texts of one pack that share a shingle from which on they are listed apart.
DENSE = 64
#: Texts of a shingle up to which all pairs are taken.
SMALL_GROUP = 24
PIVOTS = 8
#: Shingles of a text, the rarest first, at which it is paired with pivots; the pass after that takes in all of them.
PIVOT_GRAMS = 4
MEMO_ENTRIES = 400_000
#: Ids of 8 bytes up to which they are sent to all tasks.
FEW_IDS = 1_000_000
#: Bytes of a shingle's digest.
DIGEST_BYTES = 6
#: Bits that mark the repeated shingles of a text.
MARK_BITS = 2048

_PACKED = "part int, pack long, kind int, a binary, b binary, c binary, d binary, ids array<bigint>"
_ARROW = pa.schema([("part", pa.int32()), ("pack", pa.int64()), ("kind", pa.int32()), *((n, pa.binary()) for n in "abcd"), ("ids", pa.list_(pa.int64()))])
_DOCS = "doc_id bigint, node binary, n_shingles bigint, single int, prefix array<bigint>, grams binary, marks array<bigint>"
_DOCS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()), ("single", pa.int32()), ("prefix", pa.list_(pa.int64())), ("grams", pa.binary()),
    ("marks", pa.list_(pa.int64()))])


def squeeze(digests: np.ndarray) -> bytes:
    """Ordered digests as differences, one plane of bytes after the other, so that the shuffle's codec finds the empty high bytes."""
    steps = np.diff(digests, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :DIGEST_BYTES].T).tobytes()


def expand(data: bytes) -> np.ndarray:
    """The digests that were squeezed."""
    planes = np.frombuffer(data, np.uint8).reshape(DIGEST_BYTES, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :DIGEST_BYTES] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def mark_bits(digests: np.ndarray) -> np.ndarray:
    """A bit for each shingle. Two texts whose bits differ at h places have at least h shingles that only one of them has."""
    bits = np.zeros(MARK_BITS, np.uint8)
    bits[(digests % np.uint64(MARK_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


class _Digests(dict):
    """64-bit digest of a word; common words are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_ENTRIES and len(word) <= 48:
            self[word] = value
        return value


def shingle_digests(lists: list[list[bytes]], memo: dict, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Digest and text number of each distinct shingle, ordered by digest, then text.

    A text with fewer words than a shingle has one shingle, the whole sequence; one
    without words has none.
    """
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = [np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)) for words in lists]
    words = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(lists), dtype=np.int64), counts)
    n = max(0, len(words) - size + 1)
    mixed = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(size):
        mixed = (mixed ^ words[k:k + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - 8 * DIGEST_BYTES)
    whole = owner[:n] == owner[size - 1:size - 1 + n]
    mixed, owner = mixed[whole], owner[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        told = np.array([xxhash.xxh3_64_intdigest(b" ".join(lists[i]), 1) for i in short], np.uint64) >> np.uint64(64 - 8 * DIGEST_BYTES)
        mixed, owner = np.concatenate([mixed, told]), np.concatenate([owner, short])
    order = np.lexsort((owner, mixed)) if len(short) else np.argsort(mixed, kind="stable")
    mixed, owner = mixed[order], owner[order]
    fresh = np.ones(len(mixed), bool)
    fresh[1:] = (mixed[1:] != mixed[:-1]) | (owner[1:] != owner[:-1])
    return mixed[fresh], owner[fresh]


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal values in a row."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_values)))


def _pack(ids: list, texts: list, memo: dict, bits: int, pack: int, size: int) -> list[dict]:
    """The rows that stand for some texts: their shingles by range, and what is known of each text."""
    lists = [(t or "").encode().lower().split() for t in texts]
    nodes = [xxhash.xxh3_128_digest(b" ".join(words)) for words in lists]
    first: dict[bytes, int] = {}
    copy_of = np.array([first.setdefault(node, i) for i, node in enumerate(nodes)], np.uint32)
    digests, owner = shingle_digests([words if copy_of[i] == i else [] for i, words in enumerate(lists)], memo, size)
    sizes = np.bincount(owner, minlength=len(texts)).astype(np.uint32)[copy_of]
    starts, lengths = _runs(digests)
    dense = np.repeat(lengths >= DENSE, lengths)
    heavy = lengths >= DENSE
    shift = np.uint64(8 * DIGEST_BYTES - bits)
    listed, listed_owner = digests[~dense], owner[~dense].astype("<u2")
    counted, counts = digests[starts[heavy]], lengths[heavy].astype("<u4")
    parts = np.arange(1 << bits)
    cuts = np.searchsorted(listed >> shift, np.append(parts, 1 << bits))
    heavy_cuts = np.searchsorted(counted >> shift, np.append(parts, 1 << bits))
    rows = [
        {"part": int(p), "pack": pack, "kind": 0, "a": squeeze(listed[cuts[p]:cuts[p + 1]]), "b": listed_owner[cuts[p]:cuts[p + 1]].tobytes(),
         "c": squeeze(counted[heavy_cuts[p]:heavy_cuts[p + 1]]), "d": counts[heavy_cuts[p]:heavy_cuts[p + 1]].tobytes(), "ids": None}
        for p in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(heavy_cuts) > 0)).tolist()
    ]
    rows.append({
        "part": xxhash.xxh3_64_intdigest(str(pack)) % (1 << bits), "pack": pack, "kind": 1, "a": b"".join(nodes),
        "b": np.concatenate([copy_of, sizes]).astype("<u4").tobytes(), "c": squeeze(digests[dense]), "d": owner[dense].astype("<u2").tobytes(), "ids": ids})
    return rows


def _packs(bits: int, size: int):
    """Step 1: rows for ranges of digests from Arrow batches of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, number = _Digests(), TaskContext.get().partitionId() << 32
        for batch in batches:  # a pack holds rows of one batch only
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = chars = 0
            for i in range(len(texts) + 1):
                if i == len(texts) or chars and chars + len(texts[i] or "") > PACK_CHARS:
                    if i > start:
                        yield pa.RecordBatch.from_pylist(_pack(ids[start:i], texts[start:i], memo, bits, number, size), _ARROW)
                        number += 1
                    start, chars = i, 0
                if i < len(texts):
                    chars += len(texts[i] or "")

    return run


def _count_range(table: pa.Table) -> pa.Table:
    """Step 2: of one range, the shingles of two texts or more, with their number of texts, by pack."""
    rows = table.to_pylist()
    out = [r for r in rows if r["kind"] == 1]
    rows = [r for r in rows if r["kind"] == 0]
    digests = [expand(r["a"]) for r in rows]
    dense = [expand(r["c"]) for r in rows]
    told = np.concatenate([*digests, *dense, np.zeros(0, np.uint64)])
    weight = np.concatenate([np.ones(sum(map(len, digests)), np.int64), *(np.frombuffer(r["d"], "<u4").astype(np.int64) for r in rows)])
    order = np.argsort(told, kind="stable")
    starts, _ = _runs(told[order])
    kinds = told[order][starts]
    counts = np.add.reduceat(weight[order], starts) if len(starts) else np.zeros(0, np.int64)
    # Only the order matters from here on: six steps for each doubling.
    kinds, levels = kinds[counts > 1], np.minimum(255, 6 * np.log2(counts[counts > 1])).astype(np.uint8)
    for r, d, h in zip(rows, digests, dense, strict=True):
        owner = np.frombuffer(r["b"], "<u2")
        for kind, values, owners in ((0, d, owner), (2, h, None)):
            at = np.minimum(np.searchsorted(kinds, values), max(0, len(kinds) - 1))
            keep = kinds[at] == values if len(kinds) else np.zeros(len(values), bool)
            if keep.any():
                out.append({
                    "part": r["part"], "pack": r["pack"], "kind": kind, "a": squeeze(values[keep]), "b": b"" if owners is None else owners[keep].tobytes(),
                    "c": levels[at[keep]].tobytes(), "d": None, "ids": None})
    return pa.Table.from_pylist(out, _ARROW)


def _order_pack(percent: int):
    """Step 3: of one pack, each text with its prefix of repeated shingles and all its repeated shingles."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        info = next(r for r in rows if r["kind"] == 1)
        n = len(info["ids"])
        copy_of, sizes = np.split(np.frombuffer(info["b"], "<u4").astype(np.int64), 2)
        listed = [r for r in rows if r["kind"] == 0]
        heavy = [r for r in rows if r["kind"] == 2]
        digests = [expand(r["a"]) for r in listed] + [expand(info["c"])]
        owner = np.concatenate([np.frombuffer(r["b"], "<u2") for r in listed] + [np.frombuffer(info["d"], "<u2")]).astype(np.int64)
        known = np.concatenate([expand(r["a"]) for r in heavy] + [np.zeros(0, np.uint64)])
        known_levels = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in heavy] + [np.zeros(0, np.uint8)])
        by_digest = np.argsort(known)
        extra = known_levels[by_digest][np.searchsorted(known[by_digest], digests[-1])] if len(known) else np.zeros(0, np.uint8)
        levels = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in listed] + [extra])
        told = np.concatenate(digests)
        order = np.lexsort((told, levels, owner))
        told, owner = told[order], owner[order]
        ends = np.searchsorted(owner, np.arange(n), side="right")
        starts = np.searchsorted(owner, np.arange(n), side="left")
        single = sizes - (ends - starts)
        wanted = np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)
        take = np.where(copy_of == np.arange(n), np.clip(wanted - single, 0, ends - starts), 0)
        return pa.Table.from_pydict({
            "doc_id": info["ids"], "node": [info["a"][16 * i:16 * i + 16] for i in range(n)], "n_shingles": sizes, "single": single.astype(np.int32),
            "prefix": [told[s:s + k].view(np.int64) if k else None for s, k in zip(starts, take, strict=True)],
            "grams": [squeeze(np.sort(told[s:e])) if k else None for s, e, k in zip(starts, ends, take, strict=True)],
            "marks": [mark_bits(told[s:e]) if k else None for s, e, k in zip(starts, ends, take, strict=True)],
        }, _DOCS_ARROW)

    return run


def _passes(percent: int):
    """Length filter, and positional filter at a shared shingle, for sides l and r."""
    need = f"ceil({percent} * (l.n + r.n) / {100 + percent}.0D)"
    return F.expr(f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) and 1 + least(l.n - l.at, r.n - r.at) - 1 >= {need}")


def _pairs(left: DataFrame, right: DataFrame, percent: int, more) -> DataFrame:
    """Distinct pairs a < b of nodes that share a prefix shingle and pass the filters."""
    joined = left.alias("l").join(right.alias("r"), (F.col("l.gram") == F.col("r.gram")) & more & _passes(percent))
    return joined.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are alike: a suffix filter on their repeated shingles, then the exact size of what they share."""
    sides = texts.select("node", "n", "grams")
    rows = pairs.join(sides.toDF("a", "n_a", "g_a"), "a").join(sides.toDF("b", "n_b", "g_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep = []
            for n_a, n_b, g_a, g_b in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "g_a", "g_b")), strict=True):
                x, y = expand(g_a), expand(g_b)
                need = -(-percent * (n_a + n_b) // (100 + percent))
                edges = np.arange(1, 8) * len(x) // 8
                # Parts of different length on both sides of an edge cannot be shared in full.
                apart = np.abs(np.diff(np.concatenate([[0], edges, [len(x)]])) - np.diff(np.concatenate([[0], np.searchsorted(y, x[edges]), [len(y)]])))
                if len(x) + len(y) - 2 * need < apart.sum():
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(int((y[at] == x).sum()) >= need)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a binary, b binary")


def shingle_table(df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Steps 1 to 3: one row per text with its node (digest of its words), set size, prefix and repeated shingles; written."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    bound_batches(df.sparkSession)
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, volume / RANGE_BYTES)))))
    packed = docs.mapInArrow(_packs(bits, size), _PACKED)
    counted = packed.groupBy("part").applyInArrow(_count_range, _PACKED)
    return written(counted.groupBy("pack").applyInArrow(_order_pack(percent), _DOCS), "shingles")


def links(rows: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(node, root) of all nodes that are linked to others, from ``shingle_table`` rows; None if no shingle is shared."""
    texts = written(
        rows.where(F.col("prefix").isNotNull()).dropDuplicates(["node"]).select("node", F.col("n_shingles").alias("n"), "single", "prefix", "grams", "marks"), "prefixes")
    entries = texts.select("node", "n", F.posexplode("prefix").alias("k", "gram"), "single").select(
        "gram", "node", "n", (F.col("single") + F.col("k")).alias("at"))
    pivots = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "at")).alias(f"p{k}") for k in range(PIVOTS)]
    groups = written(entries.groupBy("gram").agg(F.count("*").alias("texts"), *pivots).where("texts > 1"), "groups")
    few, many = groups.where(F.col("texts") <= SMALL_GROUP), groups.where(F.col("texts") > SMALL_GROUP)
    few_entries = entries.join(few.select("gram"), "gram")
    many_entries = entries.join(many.select("gram"), "gram")
    pivot = many.select("gram", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("p")).select("gram", "p.node", "p.n", "p.at")
    # A text meets the pivots of a few shingles only: those of the others are mostly the same texts.
    met = many_entries.groupBy("node", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "gram"))), 1, PIVOT_GRAMS).alias("e")).select(
        "node", "n", F.inline("e"))
    pairs = written(
        _pairs(few_entries, few_entries, percent, F.expr("l.node < r.node")).unionByName(
            _pairs(met, pivot, percent, F.expr("l.node != r.node"))).distinct(), "pairs")
    found = written(_verified(pairs, texts, percent), "links")
    roots = None if found.isEmpty() else components(found)
    if many.isEmpty():
        return roots
    # Without a link so far each text is its own root.
    rooted = many_entries.withColumn("root", F.col("node")) if roots is None else many_entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = written(
        rooted.join(
            texts.select("node", "prefix", "marks", (F.col("n") - F.col("single")).alias("repeated")), "node"), "entries")
    largest = labelled.groupBy("gram", "root").count().groupBy("gram").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
    apart = labelled.join(largest, "gram").where(F.col("root") != F.col("largest")).drop("largest")
    # A pair is taken at the first shingle that both prefixes have, not at each.
    # What their marks say they can share at most is compared before a pair goes anywhere.
    differ = "aggregate(zip_with(l.marks, r.marks, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)"
    most = f"l.repeated + r.repeated - {differ} >= 2 * ceil({percent} * (l.n + r.n) / {100 + percent}.0D)"
    first = F.expr(f"l.root != r.root and l.gram = array_intersect(l.prefix, r.prefix)[0] and {most}")
    rest = _pairs(apart, labelled, percent, first).join(pairs, ["a", "b"], "left_anti")
    more = written(_verified(rest, texts, percent), "links")
    return roots if more.isEmpty() else components(found.unionByName(more))


def _components(rows: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, node and component_id of each text, from ``shingle_table`` rows, and ``chosen``, the node of the component that stands for it."""
    roots = links(rows, percent)
    named = rows.select("doc_id", "n_shingles", "node")
    full = named.where("n_shingles > 0")
    if roots is not None:
        full = full.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        full = full.withColumn("root", F.col("node"))
    # The least doc_id that is not null, and the least of its nodes.
    least = full.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least")).select(
        "root", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("chosen"))
    return full.join(least, "root").select("doc_id", "n_shingles", "node", "component_id", "chosen").unionByName(
        named.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "chosen": F.col("node")}))


def join_alike(df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per text: doc_id, n_shingles (size of its set), component_id.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. Two are linked
    if they share at least ``percent`` of the union of their shingles; component_id is
    the smallest doc_id that links lead to. Texts without words, or null, are linked
    with nothing. Rows with the same doc_id are separate texts; a null doc_id is the
    component's only if it has no other.
    """
    rows = shingle_table(df, text, doc_id, percent, size)
    return _components(rows, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The rows of one document of each component, that with the smallest doc_id.

    Of alike rows with the same doc_id one stays, of rows with the same doc_id and text
    too; rows with a null doc_id all stay, as they cannot be told apart.

    Texts are not moved where the ids to drop, and the ids that several rows have, are few
    enough to be sent to them; beyond that rows are joined by id and salt.
    """
    rows = shingle_table(df, text, doc_id, percent, size)
    found = written(_components(rows, percent).where(F.col("doc_id").isNotNull()).select(
        "doc_id", "node", ((F.col("doc_id") == F.col("component_id")) & (F.col("node") == F.col("chosen"))).alias("stays")), "kept")
    # Ids with one row that goes, and ids that several rows have.
    told = written(found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("stays").alias("some")).where("rows > 1 or not some"), "told")
    id_, node, rows_, some, empty = (free_name(df, n) for n in ("id", "node", "rows", "some", "empty"))
    marked = lookup(df.withColumn(id_, F.col(f"`{doc_id}`").cast("long")), told.toDF(id_, rows_, some), [id_], F.length(f"`{text}`"), "left", FEW_IDS)
    once = marked.where(F.col(rows_).isNull())

    def make():
        return lambda texts: {node: [xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]}

    # Rows whose id others have too are told apart by their words.
    several = per_row(marked.where((F.col(rows_) > 1) & F.col(some)), text, f"{node} binary", make)
    chosen = found.where("stays").groupBy("doc_id", "node").agg(F.lit(1).alias("one")).select(F.col("doc_id").alias(id_), F.col("node").alias(node))
    several = several.join(chosen, [id_, node], "left_semi")
    several = several.withColumn(empty, F.when(F.col(node) == F.lit(xxhash.xxh3_128_digest(b"")), F.col(f"`{text}`"))).dropDuplicates([id_, node, empty])
    return once.select(df.columns).unionByName(several.select(df.columns))
