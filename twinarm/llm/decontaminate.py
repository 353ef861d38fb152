"""Benchmark passages in texts, by an embedding of edit distance and bit sampling.

A random walk copies the words of a window to its output and steps on, or stays, by a
random bit of the word and the step; two windows that differ by few edits then agree at
most places of their outputs, so edit distance becomes Hamming distance (CGK). A walk
drifts away from that of its copy with every edit, so an item is walked from several
places: once for every ``SPAN`` words, each time over its share of the words. Some places of the
output are drawn again and again; where a text agrees with an item at all places of
one draw, the starts that the edits before it leave are verified by exact edit distance.
The number of draws so follows the item's length.

Edits are insertions, deletions and replacements of words; passages start at any word.
Before the walk, the words from a start on, as many as the item has, must hold enough
words of the benchmark and enough of its pairs of neighbouring words; an edit costs at
most one of the former and two of the latter, so this loses nothing. Items too short for
an edit are looked up as they stand. In scripts without spaces each letter is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.common import UNSPACED, per_row, spaced

#: Edits allowed, in hundredths of an item's words.
EDIT_PERCENT = 20
BLOCK_ITEMS = 20_000
#: Words that are walked at once, random walks, draws of places of each, and places of a draw.
SPAN, WALKS, DRAWS, PLACES = 16, 4, 10, 3
#: Places for each pair of words in the table of pairs; some other pairs fall on the same ones.
PAIR_PLACES = 64
BANDS = 8
CHUNK_WORDS = 1_000_000
CHUNK_WINDOWS = 20_000
#: Matches that are followed up together.
CHUNK_MATCHES = 500_000
MEMO_ENTRIES = 400_000
#: Marks that most words with marks have at their ends.
MARKS = ".,;:!?\"'()[]-"


def plain(word: str) -> str:
    """A word without case and without anything but letters and digits."""
    word = word.casefold()
    if word.isalnum():
        return word
    bare = word.strip(MARKS)
    return bare if bare.isalnum() else "".join(filter(str.isalnum, word))


def plain_words(text: str | None) -> list[str]:
    """The plain words of a text."""
    return [w for w in map(plain, spaced(text or "").split()) if w]


def _mix(values: np.ndarray, salt: int) -> np.ndarray:
    """Well-mixed 64-bit numbers."""
    x = (values.astype(np.uint64) + np.uint64(salt & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_keys(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A key for the ``size`` words from each place on."""
    keys = np.full(len(at), size, np.uint64)
    for k in range(size):
        keys = _mix(keys ^ words[at + k].astype(np.uint64), k + 1)
    return keys


def walk_outputs(words: np.ndarray, starts: np.ndarray, size: int, walk: int) -> np.ndarray:
    """Symbols that a walk copies from the ``size`` words at each start, a row for each step; 0 after the end, words are shifted by 1.

    A walk takes about two steps for each word, so there are twice as many steps.
    """
    at = np.zeros(len(starts), np.int64)
    out = np.zeros((2 * size, len(starts)), np.int32)
    for step in range(len(out)):
        symbol = np.where(at < size, words[starts + np.minimum(at, size - 1)] + 1, 0)
        out[step] = symbol
        at += (_mix(symbol, walk * 0x10001 + step * 0x3779B1) >> np.uint64(63)).astype(np.int64)
    return out


def walk_keys(words: np.ndarray, starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each draw of each walk, a key for each window: its symbols at the drawn places."""
    places = np.random.default_rng(17).random((WALKS, DRAWS, PLACES))
    for walk in range(WALKS):
        out = walk_outputs(words, starts, size, walk)
        for draw in places[walk]:
            key = np.full(len(starts), size, np.uint64)
            for k, share in enumerate(draw):
                key = _mix(key ^ out[int(share * 2 * size)].astype(np.uint64), k + 1)
            yield key


class _Ids(dict):
    """Number of a word as it stands: that of its plain form in the benchmark, 0 for others, -1 for none, -2 for several letters that are words of their own."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        form = plain(word)
        value = self.vocabulary.get(form, 0) if form else -1
        if len(form) > 1 and not form.isascii() and UNSPACED.search(form):
            value = -2
        if len(self) < MEMO_ENTRIES and len(word) <= 48:
            self[word] = value
        return value


class Finder:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int | None, str | None]], percent: int = EDIT_PERCENT):
        known: dict[tuple[str, ...], list] = {}
        for item_id, text in items:
            words = tuple(plain_words(text))
            if words:
                known.setdefault(words, []).append(item_id)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for words in known for w in words}), 1)}
        self.ids = _Ids(self.vocabulary)
        self.percent = percent
        listed = sorted(known.items(), key=lambda x: (len(x[0]), x[0]))
        self.item_ids = [ids for _, ids in listed]
        self.sizes = np.array([len(words) for words, _ in listed], np.int64)
        self.lengths = np.unique(self.sizes)
        self.flat = np.array([self.vocabulary[w] for words, _ in listed for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.windows = self._item_windows()
        # The table of pairs has a bit for each band of item lengths.
        self.bands = [band.tolist() for band in np.array_split(self.lengths, BANDS) if len(band)]
        inner = np.setdiff1d(np.arange(max(0, len(self.flat) - 1)), self.starts - 1)
        self.pair_bits = max(10, int(len(inner) * PAIR_PLACES).bit_length())
        self.pairs = np.zeros(1 << self.pair_bits, np.uint8)
        size = np.repeat(self.sizes, self.sizes)[inner]
        places = self._pair_places(self.flat[inner], self.flat[inner + 1]) if len(inner) else inner
        for bit, band in enumerate(self.bands):
            self.pairs[places[(size >= band[0]) & (size <= band[-1])]] |= np.uint8(1 << bit)
        self.pad = self.edits(int(self.sizes.max(initial=0))) + 1

    def edits(self, n: int) -> int:
        return self.percent * n // 100

    def _pair_places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (_mix(first * len(self.vocabulary) + second, 11) >> np.uint64(64 - self.pair_bits)).astype(np.int64)

    def _item_windows(self) -> dict[tuple[int, bool], tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
        """By number of words, and whether they are walked: ordered keys of each draw, then item, first word in it and most edits before it."""
        told: dict[tuple[int, bool], list] = {}
        for n in self.lengths.tolist():
            mine, walked = np.flatnonzero(self.sizes == n), self.edits(n) > 0
            parts = -(-n // SPAN) if walked else 1
            cuts = [j * n // parts for j in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                told.setdefault((b - a, walked), []).append((mine, np.full(len(mine), a), np.full(len(mine), min(self.edits(n), a // 2 + 2) if walked else 0)))
        out = {}
        for (size, walked), parts in told.items():
            items, offsets, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
            starts = self.starts[items] + offsets
            draws = walk_keys(self.flat, starts, size) if walked else [gram_keys(self.flat, starts, size)]
            out[size, walked] = ([(key[order], order) for key in draws for order in [np.argsort(key, kind="stable")]], items, offsets, numbers)
        return out

    def _matches(self, words: np.ndarray, at: np.ndarray, size: int, walked: bool) -> tuple[np.ndarray, np.ndarray]:
        """Windows of texts and of items that agree at all places of a draw: start in the text, and number of the item's window."""
        known = self.windows[size, walked][0]
        found = [np.zeros(0, np.int64)]
        n_entries = len(known[0][0])
        for part in np.array_split(at, max(1, len(at) // CHUNK_WINDOWS)):
            draws = walk_keys(words, part, size) if walked else [gram_keys(words, part, size)]
            for key, (keys, order) in zip(draws, known, strict=True):
                low = np.searchsorted(keys, key, "left")
                hit = np.flatnonzero(keys[np.minimum(low, n_entries - 1)] == key)
                many = np.searchsorted(keys, key[hit], "right") - low[hit]
                each = np.repeat(hit, many)
                entry = order[low[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)]
                found.append(part[each] * n_entries + entry)
        pairs = np.unique(np.concatenate(found))
        return pairs // n_entries, pairs % n_entries

    def _candidates(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Windows and items, as window x items + item, that a match of a walked part leaves."""
        none = np.zeros(0, np.int64)
        if not len(starts):
            return none
        total, n_items = len(words), len(self.sizes)
        step = np.bincount(starts, minlength=total + 1)
        step -= np.bincount(np.minimum(starts + sizes + self.percent * sizes // 100, total), minlength=total + 1)
        covered = np.cumsum(step)[:total] > 0
        codes = np.searchsorted(self.lengths, sizes) * total + starts
        order = np.argsort(codes, kind="stable")
        codes, row = codes[order], np.searchsorted(self.lengths, self.sizes) * total
        out = [none]
        for (size, walked), (_, items, offsets, numbers) in self.windows.items():
            if size > total:
                continue
            at, entry = self._matches(words, np.flatnonzero(covered[:total - size + 1]), size, walked)
            for part in np.array_split(np.arange(len(at)), max(1, len(at) // CHUNK_MATCHES)):
                begin, item, number = at[part] - offsets[entry[part]], items[entry[part]], numbers[entry[part]]
                found = [none]
                for shift in range(-int(number.max(initial=0)), int(number.max(initial=0)) + 1):
                    near = np.flatnonzero((number >= abs(shift)) & (begin + shift >= 0) & (begin + shift < total))
                    code = row[item[near]] + begin[near] + shift
                    place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    ok = codes[place] == code
                    found.append(order[place[ok]] * n_items + item[near][ok])
                out.append(np.unique(np.concatenate(found)))
        return np.unique(np.concatenate(out))

    def _windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the windows that have enough words and pairs of the benchmark."""
        known = words > 0
        both = np.zeros(len(words), np.uint8)
        at = np.flatnonzero(known[:-1] & known[1:])
        both[at] = self.pairs[self._pair_places(words[at], words[at + 1])] if len(at) else 0
        hits = np.concatenate([[0], np.cumsum(known, dtype=np.int32)])
        found, lengths = [], []
        for bit, band in enumerate(self.bands):
            low = band[0]
            if len(words) < low:
                break
            pairs = np.concatenate([[0], np.cumsum((both >> bit) & 1, dtype=np.int32)])
            # What the first words of a longer window have at least.
            least = min(n - 1 - 2 * self.edits(n) - (n - low) for n in band)
            some = np.flatnonzero(pairs[low - 1:-1] - pairs[:len(pairs) - low] >= least)
            for n in band:
                at = some[some + n <= len(words)]
                found.append(at[(hits[at + n] - hits[at] >= n - self.edits(n)) & (pairs[at + n - 1] - pairs[at] >= n - 1 - 2 * self.edits(n))])
                lengths.append(n)
        sizes = np.repeat(np.array(lengths, np.int64), list(map(len, found)))
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), sizes

    def _distances(self, words: np.ndarray, starts: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
        """Least number of edits between each item and a passage that starts at each start; over ``edits`` it may be more than the least."""
        most = self.edits(n)
        reach = starts[None, :] + np.arange(n + most)[:, None]
        text = np.where(reach < len(words), words[np.minimum(reach, len(words) - 1)], 0)
        far = np.int32(n + most + 1)
        # A row for each place in the passage; within the band of ``most`` edits only.
        row = np.repeat(np.arange(n + most + 1, dtype=np.int32)[:, None], len(starts), axis=1)
        fresh = np.full_like(row, far)
        for i in range(1, n + 1):
            low, high = max(1, i - most), min(n + most, i + most)
            fresh[low - 1] = i if i <= most else far
            step = row[low - 1:high] + (text[low - 1:high] != items[:, i - 1])
            fresh[low:high + 1] = np.minimum(step, row[low:high + 1] + 1)
            for j in range(low, high + 1):
                np.minimum(fresh[j], fresh[j - 1] + 1, out=fresh[j])
            if high < n + most:
                fresh[high + 1] = far
            row, fresh = fresh, row
        return row[n - most:n + most + 1].min(0)

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text the items in it: id, first word, edits. The place with the fewest edits counts, then the first."""
        lists = []
        for text in texts:
            numbers = self._numbers((text or "").split())
            lists.append(self._numbers(spaced(text).split()) if (numbers == -2).any() else numbers)
        out: list[list[tuple[int, int, int]]] = []
        start = size = 0
        for i, numbers in enumerate([*lists, None]):
            if numbers is None or size and size + len(numbers) > CHUNK_WORDS:
                out += self._find(lists[start:i])
                start, size = i, 0
            size += 0 if numbers is None else len(numbers)
        return out

    def _find(self, lists: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        gap = np.zeros(self.pad, np.int64)
        parts, firsts, ends, at = [], [], [], 0
        for numbers in lists:
            words = numbers[numbers >= 0]
            firsts.append(at)
            ends.append(at + len(words))
            parts += [words, gap]
            at += len(words) + len(gap)
        words = np.concatenate(parts) if parts else gap
        firsts = np.array(firsts)
        best: list[dict] = [{} for _ in lists]
        starts, sizes = self._windows(words)
        pairs = self._candidates(words, starts, sizes)
        window, item = pairs // max(1, len(self.sizes)), pairs % max(1, len(self.sizes))
        for n in np.unique(sizes[window]).tolist():
            mine = np.flatnonzero(sizes[window] == n)
            for part in np.array_split(mine, max(1, len(mine) // CHUNK_WINDOWS)):
                begin = starts[window[part]]
                distance = self._distances(words, begin, self.flat[self.starts[item[part]][:, None] + np.arange(n)], n)
                for k in np.flatnonzero(distance <= self.edits(n)):
                    text = int(np.searchsorted(firsts, begin[k], "right")) - 1
                    if begin[k] >= ends[text]:  # a passage of the next text, with the gap before it
                        continue
                    for item_id in self.item_ids[item[part[k]]]:
                        told = (int(distance[k]), int(begin[k] - firsts[text]))
                        best[text][item_id] = min(best[text].get(item_id, told), told)
        return [sorted(((i, s, d) for i, (d, s) in found.items()), key=lambda x: (x[0] is None, x[0] or 0)) for found in best]


def find_items(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = EDIT_PERCENT) -> DataFrame:
    """Add ``leak_items``, ``leak_starts`` (first word) and ``leak_edits`` of the items found in each whole text.

    Texts and items without words have none; items of fewer words than allow an edit are
    found where they stand unchanged. The items, a stated set, are sent to the tasks in blocks of 20,000 at
    most, however many they are; all blocks are looked up in one pass. Columns of these names are replaced.
    """
    context = df.sparkSession.sparkContext
    blocks, block = [], []
    for row in items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).orderBy("i", "t").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK_ITEMS:
            blocks.append(context.broadcast(block))
            block = []
    blocks += [context.broadcast(block)] if block else []

    def make():
        finders = [Finder(b.value, percent) for b in blocks]

        def compute(texts):
            found: list[list] = [[] for _ in texts]
            for finder in finders:
                for mine, leaks in zip(found, finder.find(texts), strict=True):
                    mine += leaks
            return {name: [[leak[k] for leak in leaks] for leaks in found] for k, name in enumerate(("leak_items", "leak_starts", "leak_edits"))}

        return compute

    return per_row(df, text, "leak_items array<long>,leak_starts array<int>,leak_edits array<int>", make)
