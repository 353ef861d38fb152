"""Exact token counts at every prefix of a text by dynamic programming.

Inside one match of the split pattern the last token of a prefix is the only one whose
neighbour before it fits: two tokens fit if they are the code of their own joined
bytes. So ``last(i)`` is found from ``last(j)`` of shorter prefixes, and the count at
``i`` is one more than at ``j``. Counts at matches add up along the text. Truncation to
a budget reads these counts and codes nothing again.
"""

from __future__ import annotations

import json

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from twinarm.llm.common import per_row

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_ENTRIES = 400_000
MEMO_LENGTH = 48


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary file stands for.

    Printable Latin-1 bytes stand for themselves, the others for letters from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Unsafe(Exception):
    """A word that cannot be counted apart from what follows it."""


class _Words(dict):
    """Number of tokens of a space and the word after it; common words are remembered."""

    def __init__(self, piece, split):
        super().__init__()
        self.piece, self.split = piece, split

    def __missing__(self, word: str) -> int:
        if not word or word[-1].isspace():
            raise _Unsafe
        if word.isalpha():
            n = self.piece(" " + word)
        elif word[:-1].isalpha() and word[-1] in ".,":
            n = self.piece(" " + word[:-1]) + self.piece(word[-1])
        else:
            n = sum(map(self.piece, self.split.findall(" " + word)))
        if len(word) <= MEMO_LENGTH and len(self) < MEMO_ENTRIES:
            self[word] = n
        return n


class Counter:
    """Counts tokens as the byte-level BPE vocabulary in ``path`` gives them, special strings being one token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters = byte_letters()
        special = [t["content"] for t in told.get("added_tokens", []) if t.get("special")]
        self.ids = {
            bytes(letters[c] for c in t): i
            for t, i in told["model"]["vocab"].items() if t not in special and all(c in letters for c in t)
        }
        joined = [self.ids[bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in told["model"]["merges"]]
        if joined != sorted(joined):
            raise ValueError("the ids of the vocabulary do not follow the order of its merges")
        self.inner = tiktoken.Encoding("ids", pat_str=SPLIT, mergeable_ranks=self.ids, special_tokens={})
        self.longest = max(map(len, self.ids), default=1)
        self.sizes_by_end: dict[bytes, list[int]] = {}
        for token in self.ids:
            if len(token) > 2:
                self.sizes_by_end.setdefault(token[-3:], []).append(len(token))
        self.sizes_by_end = {end: sorted(set(sizes), reverse=True) for end, sizes in self.sizes_by_end.items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(SPLIT)
        self.spaces = regex.compile(r"\s+")
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, int] = {}
        self.words = _Words(self._piece, self.split)

    def _fit(self, first: int, second: int) -> bool:
        key = first << 32 | second
        known = self.fits.get(key)
        if known is None:
            decode = self.inner.decode_single_token_bytes
            known = self.inner._encode_single_piece(decode(first) + decode(second)) == [first, second]
            if len(self.fits) < MEMO_ENTRIES:
                self.fits[key] = known
        return known

    def prefix_counts(self, data: bytes) -> list[int]:
        """Tokens of each prefix of the bytes of one match."""
        ids, fits, by_end, fit = self.ids, self.fits, self.sizes_by_end, self._fit
        last, counts = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for end in range(1, len(data) + 1):
            for size in (*by_end.get(data[end - 3:end] if end > 2 else b"", ()), 2, 1):
                start = end - size
                if start < 0:
                    continue
                token = ids.get(data[start:end])
                if token is None:
                    continue
                if start:
                    known = fits.get(last[start] << 32 | token)
                    if not (fit(last[start], token) if known is None else known):
                        continue
                last[end], counts[end] = token, counts[start] + 1
                break
        return counts

    def _solve(self, data: bytes, end: int, solved: dict[int, tuple[int, int]]) -> tuple[int, int]:
        """Last token and token count of the prefix up to ``end``, from only the shorter prefixes it needs."""
        ids, fits = self.ids, self.fits
        for size in (*self.sizes_by_end.get(data[end - 3:end] if end > 2 else b"", ()), 2, 1):
            start = end - size
            if start < 0:
                continue
            token = ids.get(data[start:end])
            if token is None:
                continue
            if not start:
                solved[end] = found = (token, 1)
                return found
            last, count = solved.get(start) or self._solve(data, start, solved)
            known = fits.get(last << 32 | token)
            if self._fit(last, token) if known is None else known:
                solved[end] = found = (token, count + 1)
                return found
        raise ValueError("a byte is no token")

    def _piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            data = piece.encode()
            if data in self.ids:
                n = 1
            elif len(data) <= MEMO_LENGTH:
                n = self._solve(data, len(data), {})[1]
            else:
                n = self.prefix_counts(data)[-1]
            if len(data) <= MEMO_LENGTH and len(self.pieces) < MEMO_ENTRIES:
                self.pieces[piece] = n
        return n

    def _segments(self, text: str) -> list[tuple[int, int, bool]]:
        """Pieces of ordinary text and special strings: start, end, special."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                out.append((at, m.start(), False))
            out.append((m.start(), m.end(), True))
            at = m.end()
        if at < len(text):
            out.append((at, len(text), False))
        return out

    def _unit_counts(self, text: str) -> tuple[list[str], np.ndarray]:
        """Units that no match spans, a space with the word after it, and their token counts; or single matches."""
        words = text.split(" ")
        try:
            if len(words) > 1 and (not words[0] or words[0][-1].isspace()):
                raise _Unsafe
            counts = np.fromiter(map(self.words.__getitem__, words[1:]), np.int64, len(words) - 1)
            return words, np.concatenate([[sum(map(self._piece, self.split.findall(words[0])))], counts])
        except _Unsafe:
            found = self.split.findall(text)
            return found, np.fromiter(map(self._piece, found), np.int64, len(found))

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        return self.budget(text, None)[0]

    def budget(self, text: str | None, limit: int | None) -> tuple[int, int]:
        """Tokens of the text, and characters of its longest prefix of at most ``limit`` tokens."""
        if not text:
            return 0, 0
        total, cut, over = 0, 0, limit is None
        base, base_count = 0, 0  # where the ordinary text before a special string starts
        segments = self._segments(text)
        for i, (start, end, special) in enumerate(segments):
            if special:
                if not over and total + 1 > limit:
                    over, cut = True, max(cut, self._fit_end(text[:end - 1], base, base_count, limit))
                total, cut = total + 1, cut if over else end
                base, base_count = end, total
                continue
            units, counts = self._unit_counts(text[start:end])
            base, base_count, total = start, total, total + int(counts.sum())
            if over:
                continue
            cut = end
            if total > limit:
                over = True
                sums = base_count + np.cumsum(counts)
                # The units before k fit; some are looked at again, as a prefix may end inside white space.
                k = int(np.searchsorted(sums, limit, side="right"))
                first = max(0, k - 2)
                gap = int(sum(map(len, units)) != end - start)
                ends = start + np.cumsum([len(u) + gap for u in units[:k + 1]]) - gap
                stop = segments[i + 1][1] - 1 if k == len(units) - 1 and i + 1 < len(segments) else int(ends[k])
                cut = self._fit_end(text[:stop], int(ends[first - 1]) if first else start, int(sums[first - 1]) if first else base_count, limit)
        return total, cut

    def _fit_end(self, text: str, start: int, before: int, limit: int) -> int:
        """End of the longest prefix of at most ``limit`` tokens that ends at ``start`` or later."""
        return start + int(np.flatnonzero(before + self.prefixes(text[start:], special=False) <= limit)[-1])

    def prefixes(self, text: str | None, special: bool = True) -> np.ndarray:
        """Tokens of each prefix of 0, 1, ... characters, each counted as a text of its own."""
        text = text or ""
        if special and self.special and self.special.search(text):
            out, base = [np.zeros(1, int)], 0
            segments = self._segments(text)
            i = 0
            while i < len(segments):
                start, end, is_special = segments[i]
                body_end = start if is_special else end
                follows = is_special or (i + 1 < len(segments) and segments[i + 1][2])
                stop = (end if is_special else segments[i + 1][1]) if follows else end
                inner = self.prefixes(text[start:stop - 1 if follows else stop], special=False)
                out.append(base + inner[1:])
                base += int(inner[body_end - start])
                if follows:
                    base += 1
                    out.append(np.array([base]))
                    i += 1 if is_special else 2
                else:
                    i += 1
            return np.concatenate(out)
        counts, done = np.zeros(len(text) + 1, int), 0
        for m in self.split.finditer(text):
            piece, start = m.group(), m.start()
            inner = self.prefix_counts(piece.encode())
            ends = np.cumsum([len(c.encode()) for c in piece])
            counts[start + 1:m.end() + 1] = done + np.array(inner)[ends]
            if piece[0] == "'" and len(piece) == 3 and piece[1:] in ("re", "ve", "ll"):
                counts[start + 2] = done + self._piece("'") + self._piece(piece[1])
            done += inner[-1]
        for m in self.spaces.finditer(text):
            # A prefix that ends in white space ends in one match of all of it.
            ends = np.cumsum([len(c.encode()) for c in m.group()])
            counts[m.start() + 1:m.end() + 1] = counts[m.start()] + np.array(self.prefix_counts(m.group().encode()))[ends]
        return counts


def count_tokens(df: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` of each whole text, and ``fit_chars``, the characters of the longest prefix within ``limit`` tokens.

    A null or empty text has none of either. Columns of those names are replaced.
    """
    def make():
        counter = Counter(path)

        def compute(texts):
            found = [counter.budget(t, limit) for t in texts]
            return {"n_tokens": [n for n, _ in found], "fit_chars": [c for _, c in found]}

        return compute

    return per_row(df, text, "n_tokens long,fit_chars long", make)
