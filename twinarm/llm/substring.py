"""Removal of passages that were seen before, by hashing short units of lines.

A line is cut into units: sentences, and the parts before a capitalised word inside
them, so that a passage pasted into the middle of a line starts a unit of its own.
Digests of normalised units are grouped over all texts; each unit is kept where it
occurs first (lowest rank, then place) and marked elsewhere. Runs of marked units of at
least ``min_words`` words are removed, with their offsets in the original text.

Besides, a text is cut by its content: of every ten neighbouring word pairs the one with
the lowest digest is a cut, so equal stretches are cut alike wherever they stand, within
ten words of their ends. Spans of two such pieces are marked in the same way, and runs
of at least ``LONG_WORDS`` words are removed. So of each repeated passage of 44 words or
more all but ten words at each end at most are removed, whatever the lines, sentences
and capitals around it.

Digests of some texts travel together, packed and once each, to ranges of digests, which
return those that another pack has too, with their lowest rank. The offsets of units and
spans stay in their pack, where runs of marked ones become what is cut; texts are read
once more to cut them.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.common import UNSPACED, bound_batches, free_name, lookup, other_columns, per_batch, small_batches, spaced, written

#: Words that a run of marked units has at least; shorter ones stay, as chance repeats them.
MIN_WORDS = 8
#: Word pairs of which one is a cut, and the words that a run of marked spans has at least.
WINDOW, LONG_WORDS = 10, 24
#: Digests for each range of them.
RANGE_UNITS = 500_000
MEMO_ENTRIES = 150_000
#: Bytes of texts whose units are held at once.
PACK_BYTES = 2_000_000
#: Cuts up to which they are sent to all tasks: 8 bytes each, and 40 for each text that loses some.
FEW_CUTS = 1_000_000
#: Letters that stand for a word in scripts without spaces, so that runs of 40 of them are long enough too.
WORD_LETTERS = 5
LAST_RANK = (1 << 63) - 1
_CAPITALS = "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if chr(c).isupper())
_WORD = re.compile(rf"{UNSPACED.pattern}|[^\s{UNSPACED.pattern[1:-1]}]+")
_BASE = 0x9E3779B97F4A7C15
_PACKED = "kind int, part int, pack bigint, total bigint, a binary, b binary, c binary, ranks array<bigint>, ids array<bigint>, keys binary, n_units array<int>, n_all array<int>"
_ARROW = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("pack", pa.int64()), ("total", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("ranks", pa.list_(pa.int64())),
    ("ids", pa.list_(pa.int64())), ("keys", pa.binary()), ("n_units", pa.list_(pa.int32())), ("n_all", pa.list_(pa.int32()))])
#: White space that ends a line or a sentence, or stands before a capital.
_BREAK = re.compile(rf"\s(?:(?<=\n)|(?<=[.!?].)|(?=[{_CAPITALS}]))\s*", re.DOTALL)


def units(text: str) -> list[tuple[int, int]]:
    """Start and end of each unit of a text, without the white space between them."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        start, end = m.span()
        if start > at:
            out.append((at, start))
        at = end
    if at < len(text):
        out.append((at, len(text)))
    return out


class _Digests(dict):
    """64-bit digest of a word; common words are remembered."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode())
        if len(self) < MEMO_ENTRIES and len(word) <= 48:
            self[word] = value
        return value


def _hashed(text: str, memo: dict) -> np.ndarray:
    """Digests of the words of a text, without case."""
    words = spaced(text).lower().split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def content_spans(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word, word after the last and digest of the spans of two pieces that contents cut."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    words, owner = np.concatenate([*lists, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(lists)), counts)
    if len(words) <= WINDOW:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    pair = (words[:-1] * np.uint64(_BASE) ^ words[1:]) * np.uint64(0xD6E8FEB86659FD93)
    pair ^= pair >> np.uint64(32)
    last = np.lib.stride_tricks.sliding_window_view(pair, WINDOW)[:, ::-1].argmin(1)
    whole = np.flatnonzero(owner[WINDOW:] == owner[:-WINDOW])
    cuts = np.unique(whole + WINDOW - 1 - last[whole])
    start, end = cuts[:-2], cuts[2:]
    inside = owner[start] == owner[end] if len(start) else np.zeros(0, bool)
    start, end = start[inside], end[inside]
    power = np.cumprod(np.full(len(words), _BASE, np.uint64))
    back = np.cumprod(np.full(len(words), pow(_BASE, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])
    told = (sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)
    told = (told ^ (told >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    first = (np.cumsum(counts) - counts)[owner[start]]
    return owner[start], start - first, end - first, np.maximum(told ^ (told >> np.uint64(29)), np.uint64(1))


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers, one plane of bytes after the other, so that the shuffle's codec finds the empty high bytes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _squeezed(table: np.ndarray) -> bytes:
    """Rows of whole numbers as differences, one plane of bytes after the other."""
    steps = np.diff(np.ascontiguousarray(table), axis=1, prepend=np.int32(0)).astype("<i4")
    # Zigzag: small negative steps have empty high bytes too.
    steps = ((steps << 1) ^ (steps >> 31)).astype("<u4")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unsqueezed(data: bytes, rows: int) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(rows, -1)
    return np.cumsum((steps >> 1).astype(np.int32) ^ -(steps & 1).astype(np.int32), axis=1, dtype=np.int32)


def _row(**values) -> dict:
    return dict.fromkeys(_ARROW.names) | values


def _unit_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for some texts: digests of the units, then of the spans, of each (0 for none), whether the text had them before, and where they are.

    Of each its first and last place in the text, and the words before it and up to its end
    (of units in fifths of a word, counted over the units alone).
    """
    memo, number = _Digests(), TaskContext.get().partitionId() << 32
    for batch in small_batches(batches, PACK_BYTES):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        owner, starts, ends, found = content_spans([_hashed(t, memo) for t in texts])
        edges = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        told, again, places = array("Q"), bytearray(), array("i")
        n_units, n_all = [], []
        for i, text in enumerate(texts):
            seen: dict[int, int] = {}
            before, parts = len(told), units(text)
            upto = 0
            for k, (a, b) in enumerate(parts):
                words = " ".join(text[a:b].lower().split())
                digest = (xxhash.xxh3_64_intdigest(words.encode()) or 1) if words else 0
                told.append(digest)
                again.append(bool(words) and digest in seen)
                seen[digest] = 0
                size = round(WORD_LETTERS * amount(text[a:b]))
                places.extend((a, parts[k + 1][0] if k + 1 < len(parts) else len(text), upto, upto + size))
                upto += size
            seen = {}
            mine = slice(edges[i], edges[i + 1])
            if edges[i] < edges[i + 1]:
                at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
            for a, b, digest in zip(starts[mine].tolist(), ends[mine].tolist(), found[mine].tolist(), strict=True):
                # One that overlaps the first of its kind is no second one.
                again.append(seen.setdefault(digest, b) <= a)
                told.append(digest)
                places.extend((at[a], at[b], a, b))
            n_units.append(len(parts))
            n_all.append(len(told) - before)
        yield pa.RecordBatch.from_pylist([_row(
            kind=1, pack=number, total=len(told), a=told.tobytes(), b=np.packbits(np.frombuffer(again, bool)).tobytes(),
            c=_squeezed(np.frombuffer(places, np.int32).reshape(-1, 4).T), ranks=batch.column("rank").to_pylist(), ids=batch.column("id").to_pylist(),
            keys=b"".join(batch.column("key").to_pylist()), n_units=n_units, n_all=n_all)], _ARROW)
        number += 1


def _by_range(bits: int):
    """Rows for ranges of digests: each digest of a pack once, with its lowest rank there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                digests, ranks = _lowest(np.frombuffer(row["a"], np.uint64), np.repeat(np.array(row["ranks"], np.int64), row["n_all"]))
                cuts = np.searchsorted(digests >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
                rows = [
                    _row(kind=0, part=p, pack=row["pack"], a=_planes(np.diff(digests[a:b], prepend=np.uint64(0))), b=_planes(ranks[a:b]))
                    for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if b > a]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def _lowest(digests: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests but 0, in order, and the lowest rank of each."""
    order = np.lexsort((ranks, digests))
    digests, ranks = digests[order], ranks[order]
    fresh = digests != 0
    fresh[1:] &= digests[1:] != digests[:-1]
    return digests[fresh], ranks[fresh]


def _shared_digests(table: pa.Table) -> pa.Table:
    """Of one range, for each pack the digests that another one has too, with their lowest rank."""
    rows = table.select(["pack", "a", "b"]).to_pylist()
    lists = [np.cumsum(_numbers(r["a"]), dtype=np.uint64) for r in rows]
    flat = np.concatenate(lists)
    kinds, ranks = _lowest(flat, np.concatenate([_numbers(r["b"], np.int64) for r in rows]))
    many = np.bincount(np.searchsorted(kinds, flat), minlength=len(kinds)) > 1
    out = []
    for row, digests in zip(rows, lists, strict=True):
        at = np.searchsorted(kinds, digests)
        keep = many[at]
        if keep.any():
            out.append(_row(kind=0, pack=row["pack"], a=_planes(np.diff(digests[keep], prepend=np.uint64(0))), b=_planes(ranks[at[keep]])))
    return pa.Table.from_pylist(out, _ARROW)


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of neighbours."""
    if not len(marked):
        return []
    breaks = np.flatnonzero(np.diff(marked) > 1)
    return list(zip(marked[np.concatenate([[0], breaks + 1])].tolist(), marked[np.concatenate([breaks, [len(marked) - 1]])].tolist(), strict=True))


def unit_cuts(places: np.ndarray, marked: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Character spans of the runs of marked units with enough words, up to the next unit."""
    first, last, before, upto = places
    return [(int(first[a]), int(last[b])) for a, b in _runs(marked) if upto[b] - before[a] >= WORD_LETTERS * min_words]


def span_cuts(places: np.ndarray, marked: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Character spans of the stretches of marked content spans with enough words, up to the next word."""
    out: list[list[int]] = []
    for first, last, a, b in places[:, marked].T.tolist():
        if out and a <= out[-1][3]:
            out[-1][1], out[-1][3] = last, b
        else:
            out.append([first, last, a, b])
    return [(first, last) for first, last, a, b in out if b - a >= max(min_words, LONG_WORDS)]


def _marks(min_words: int):
    """Of one pack, what is cut from each text that loses something."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        info = next(r for r in rows if r["kind"] == 1)
        digests, n_all = np.frombuffer(info["a"], np.uint64), np.array(info["n_all"], np.int64)
        rank = np.repeat(np.array(info["ranks"], np.int64), n_all)
        returned = [r for r in rows if r["kind"] == 0]
        kinds, lowest = _lowest(
            np.concatenate([digests, *(np.cumsum(_numbers(r["a"]), dtype=np.uint64) for r in returned)]), np.concatenate([rank, *(_numbers(r["b"], np.int64) for r in returned)]))
        marked = np.unpackbits(np.frombuffer(info["b"], np.uint8), count=len(digests)).astype(bool)
        some = digests != 0
        marked[some] |= lowest[np.searchsorted(kinds, digests[some])] < rank[some]
        places = _unsqueezed(info["c"], 4)
        ids, keys, starts, ends = [], [], [], []
        for i, (n, begin, end) in enumerate(zip(info["n_units"], np.cumsum(n_all) - n_all, np.cumsum(n_all), strict=True)):
            at = np.flatnonzero(marked[begin:end])
            if not len(at):
                continue
            mine = places[:, begin:end]
            cuts = merged(unit_cuts(mine[:, :n], at[at < n], min_words) + span_cuts(mine[:, n:], at[at >= n] - n, min_words))
            if cuts:
                ids.append(info["ids"][i])
                keys.append(info["keys"][16 * i:16 * i + 16])
                starts.append([a for a, _ in cuts])
                ends.append([b for _, b in cuts])
        ints = pa.list_(pa.int32())
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(starts, ints), pa.array(ends, ints)], names=["id", "key", "starts", "ends"])

    return run


def amount(text: str) -> float:
    """Words of a text; letters of scripts without spaces count by the number that stands for a word."""
    if text.isascii():
        return len(text.split())
    bare, letters = UNSPACED.subn(" ", text)
    return len(bare.split()) + letters / WORD_LETTERS


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows of ``df`` with the text cut, and ``removed_starts`` and ``removed_ends``, the offsets of what was cut.

    Texts are ranked by doc_id, a null one last. Rows with the same doc_id rank alike:
    none of them loses a passage to another, but each loses what it repeats itself. A
    null text stays null. A text of nothing but repeated passages becomes empty.
    """
    bound_batches(df.sparkSession)
    id_, key = (free_name(df, n) for n in ("id", "key"))
    # A text is known by its id and 128 bits of its digest; texts that agree in both lose the same.
    keyed = df.withColumns({id_: F.col(f"`{doc_id}`").cast("long"), key: F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))})
    told = keyed.where(F.col(f"`{text}`") != "").select(
        F.coalesce(F.col(id_), F.lit(LAST_RANK)).alias("rank"), F.col(id_).alias("id"), F.col(key).alias("key"), F.col(f"`{text}`").alias("text"))
    packs = written(told.mapInArrow(_unit_packs, _PACKED), "units")
    total = packs.agg(F.sum("total")).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, total / RANGE_UNITS)))))
    shared = packs.mapInArrow(_by_range(bits), _PACKED).groupBy("part").applyInArrow(_shared_digests, _PACKED)
    marks = written(shared.unionByName(packs).groupBy("pack").applyInArrow(_marks(min_words), "id bigint, key binary, starts array<int>, ends array<int>").groupBy("id", "key").agg(
        F.first("starts").alias("starts"), F.first("ends").alias("ends")), "cuts").toDF(id_, key, *(free_name(df, n) for n in ("starts", "ends")))
    starts, ends = marks.columns[2:]
    # Sent to the texts where there are few cuts in all, else joined by key and salt.
    few = (marks.agg(F.sum(F.size(starts))).first()[0] or 0) <= FEW_CUTS
    joined = lookup(keyed, marks, [id_, key], F.col(key), "left", FEW_CUTS if few else 0)
    none = F.array().cast("array<int>")

    def make():
        def compute(column: pa.Array):
            values, begins, stops = (pc.struct_field(column, n) for n in ("text", "starts", "ends"))
            losing = np.flatnonzero(pc.list_value_length(begins).to_numpy(zero_copy_only=False) > 0)
            if not len(losing):
                return {text: values, "removed_starts": begins, "removed_ends": stops}, None
            picked = pa.array(losing)
            left = []
            for value, a, b in zip(values.take(picked).to_pylist(), begins.take(picked).to_pylist(), stops.take(picked).to_pylist(), strict=True):
                left.append("".join(value[x:y] for x, y in zip([0, *b], [*a, len(value)], strict=True)).rstrip())
            mask = np.zeros(len(values), bool)
            mask[losing] = True
            return {text: pc.replace_with_mask(values, pa.array(mask), pa.array(left, values.type)), "removed_starts": begins, "removed_ends": stops}, None

        return compute

    source = F.struct(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(starts), none).alias("starts"), F.coalesce(F.col(ends), none).alias("ends"))
    out = per_batch(joined, source, f"{text} string,removed_starts array<int>,removed_ends array<int>", make)
    return out.select(*other_columns(df, "removed_starts", "removed_ends"), "removed_starts", "removed_ends")
