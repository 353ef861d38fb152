"""Byte-level BPE coding as a tree reduction over a text.

A text is halved until pieces are short, each short piece is coded alone, and two
neighbours are joined by coding a window around the cut again. The window grows on
each side until the tokens outside provably cannot change:

* its edge is a place that no match of the split pattern can span, whatever stands
  around it (for example between a letter and white space), or
* its edge lies inside a run of one kind of character, so inside one match, and the
  two tokens that meet there are the code of their own joined bytes. A sequence of
  tokens of which all neighbours are so is the code of the whole match.

Joining is associative, so it does not matter how a text is cut. Decoding joins the
bytes of the tokens up the same kind of tree.
"""

from __future__ import annotations

import base64

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from twinarm.llm.common import per_row

LEAF_BYTES = 4096
LEAF_TOKENS = 8192
MEMO_ENTRIES = 300_000
_SPACE = regex.compile(r"\s")
_LETTER = regex.compile(r"\p{L}")
_NUMBER = regex.compile(r"\p{N}")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def kind(char: str) -> str:
    """Which of the four kinds the split pattern tells apart: space, letter, number, other."""
    if _SPACE.match(char):
        return "s"
    return "l" if _LETTER.match(char) else "n" if _NUMBER.match(char) else "o"


class Coder:
    """Codes and decodes with the ranks of ``path``; matches of ``pattern`` are coded separately."""

    def __init__(self, path: str, pattern: str, leaf_bytes: int = LEAF_BYTES):
        ranks = read_ranks(path)
        self.inner = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.leaf_bytes = max(8, leaf_bytes)
        self.fits: dict[tuple[int, int], bool] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of the whole text; none for a missing text."""
        if not text:
            return []
        data = text.encode()
        return self._node(data, 0, len(data))

    def decode(self, ids) -> bytes:
        """The bytes of the ids."""
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _node(self, data: bytes, low: int, high: int) -> list[int]:
        if high - low <= self.leaf_bytes:
            return self.inner.encode_ordinary(data[low:high].decode())
        cut = (low + high) // 2
        while data[cut] & 0xC0 == 0x80:
            cut -= 1
        return self._join(data, low, cut, high, self._node(data, low, cut), self._node(data, cut, high))

    def _join(self, data: bytes, low: int, cut: int, high: int, left: list[int], right: list[int]) -> list[int]:
        """Code of ``data[low:high]`` from the codes before and after ``cut``."""
        i = j = 0
        start, end = cut, cut
        grow_left = grow_right = 1
        window: list[int] = []
        while True:
            for _ in range(grow_left):
                if i < len(left):
                    i += 1
                    start -= len(self.bytes_of[left[-i]])
            for _ in range(grow_right):
                if j < len(right):
                    end += len(self.bytes_of[right[j]])
                    j += 1
            at_left, at_right = self._edge(data, low, cut, start, left=True), self._edge(data, cut, high, end, left=False)
            if at_left and at_right:
                window = self.inner.encode_ordinary(data[start:end].decode())
                at_left = at_left == "apart" or self._fit(left[-i - 1], window[0])
                at_right = at_right == "apart" or self._fit(window[-1], right[j])
                if at_left and at_right:
                    return left[: len(left) - i] + window + right[j:]
            grow_left = 0 if at_left else max(1, i)
            grow_right = 0 if at_right else max(1, j)

    @staticmethod
    def _edge(data: bytes, low: int, high: int, at: int, left: bool) -> str:
        """What a window edge at ``at`` is: apart (no match spans it), inside (of one match) or nothing known."""
        if at == (low if left else high):
            return "apart"
        if at == (high if left else low) or data[at] & 0xC0 == 0x80:
            return ""
        before, after = data[max(low, at - 12):at].decode(errors="ignore"), data[at:min(high, at + 12)].decode(errors="ignore")
        a, b = kind(before[-1]), kind(after[0])
        if a != b:
            quoted = before[-1] == "'" and b == "l"
            return "" if a == "s" or quoted else "apart"
        if after[0] == "'" or len(before) < 3 or any(kind(c) != a for c in before[-3:]):
            return ""
        return "inside" if len(after) >= 2 and kind(after[1]) == a else ""

    def _fit(self, first: int, second: int) -> bool:
        """Whether two tokens side by side are the code of their joined bytes."""
        known = self.fits.get((first, second))
        if known is None:
            joined = self.bytes_of[first] + self.bytes_of[second]
            known = self.inner._encode_single_piece(joined) == [first, second]
            if len(self.fits) < MEMO_ENTRIES:
                self.fits[first, second] = known
        return known


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    A null text has no ids, like an empty one. Very long texts are coded as a tree, so
    the work grows with their length. A column named like ``ids`` is replaced.
    """
    def make():
        coder = Coder(path, pattern)
        return lambda texts: {ids: [np.array(coder.encode(t), "<u4").tobytes() for t in texts]}

    return per_row(df, text, f"{ids} binary", make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for; null ids give none."""
    def make():
        coder = Coder(path, pattern)
        return lambda rows: {out: [coder.decode(np.frombuffer(r or b"", "<u4").tolist()) for r in rows]}

    return per_row(df, ids, f"{out} binary", make)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Both of the above in one pass: the packed ids of each whole text, and the bytes decoded from them."""
    def make():
        coder = Coder(path, pattern)

        def compute(texts):
            coded = [coder.encode(t) for t in texts]
            return {ids: [np.array(c, "<u4").tobytes() for c in coded], out: [coder.decode(c) for c in coded]}

        return compute

    return per_row(df, text, f"{ids} binary,{out} binary", make)
