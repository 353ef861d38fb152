"""Host and path rules for urls, found in a sorted array of digests.

Keys are stored as one file: their 64-bit digests in order, then the full strings. A
worker maps the file into memory and looks all candidates of a batch up by one binary
search; a hit counts only if the stored string is the candidate, so two strings with
the same digest are told apart. The file reaches the executors as a file of the Spark
context; its size is that of the rule list, which is an argument.
"""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinarm.llm.common import per_row

#: Words in a host name that block it where no rule fits.
BLOCKED_WORDS = ("adult", "casino", "porn", "spam", "xxx")
WORD_MARK = "\n"


class DigestIndex:
    """A memory-mapped set of strings with a small number for each."""

    def __init__(self, path: str):
        head = np.memmap(path, "<u8", "r", shape=(2,))
        n, size = int(head[0]), int(head[1])
        self.digests = np.memmap(path, "<u8", "r", offset=16, shape=(n,)) if n else np.zeros(0, np.uint64)
        self.ends = np.memmap(path, "<u8", "r", offset=16 + 8 * n, shape=(n,)) if n else np.zeros(0, np.uint64)
        self.values = np.memmap(path, "<u8", "r", offset=16 + 16 * n, shape=(n,)) if n else np.zeros(0, np.uint64)
        self.strings = np.memmap(path, "u1", "r", offset=16 + 24 * n, shape=(size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def write(path: str, keys: dict[str, int], digest=xxhash.xxh64_intdigest) -> None:
        """Write the keys and their numbers, ordered by digest."""
        rows = sorted((digest(k.encode()), k.encode(), v) for k, v in keys.items())
        text = b"".join(k for _, k, _ in rows)
        ends = np.cumsum([len(k) for _, k, _ in rows], dtype=np.uint64)
        with open(path, "wb") as file:
            for part in ([len(rows), len(text)], [d for d, _, _ in rows], ends, [v for _, _, v in rows]):
                file.write(np.array(part, "<u8").tobytes())
            file.write(text)

    def find(self, keys: list[str], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The number of each key, -1 where it is not stored."""
        raw = [k.encode() for k in keys]
        wanted = np.fromiter((digest(k) for k in raw), np.uint64, len(raw))
        at = np.searchsorted(self.digests, wanted)
        out = np.full(len(raw), -1, np.int64)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted) if len(self.digests) else ():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == wanted[i]:
                start = int(self.ends[k - 1]) if k else 0
                if self.strings[start:int(self.ends[k])].tobytes() == raw[i]:
                    out[i] = int(self.values[k])
                    break
                k += 1
        return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _ship(spark: SparkSession, keys: dict[str, int]) -> str:
    """Write the index and make it a file of the context; returns its name."""
    name = f"url-keys-{xxhash.xxh3_64_hexdigest(repr(sorted(keys.items())))}-{spark.sparkContext.applicationId}"
    path = os.path.join(tempfile.gettempdir(), name)
    if not os.path.exists(path):
        DigestIndex.write(path + ".part", keys)
        os.replace(path + ".part", path)
    spark.sparkContext.addFile(os.path.abspath(path))
    return name


def judge(df: DataFrame, block: list[str], allow: list[str], url: str = "url", blocked_words: tuple[str, ...] = BLOCKED_WORDS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` of each url.

    A rule ``host/path`` fits its host and all subdomains if the url's path starts with
    the rule's. The longest rule wins, of equally long ones that with the longer host;
    a rule in both lists allows. Without a rule, a host with a blocked word between its
    dots and hyphens is blocked and all else allowed, so a null or broken url is
    allowed. Columns of the four names are replaced.
    """
    rules = {**dict.fromkeys(block, "block"), **dict.fromkeys(allow, "allow")}
    order = sorted(rules, key=lambda r: (len(r), r.index("/")))
    lengths = sorted({len(r) - r.index("/") for r in rules})
    keys = {r: i for i, r in enumerate(order)} | {WORD_MARK + w: len(order) for w in blocked_words}
    name = _ship(df.sparkSession, keys)

    def make():
        index, split = DigestIndex(SparkFiles.get(name)), re.compile(r"[.\-]")

        def compute(rows):
            told: list[str] = []
            owner: list[int] = []
            for i, (host, path) in enumerate(rows):
                labels = host.split(".")
                heads = [path[:n] for n in lengths if n <= len(path)]
                mine = [".".join(labels[k:]) + head for k in range(len(labels)) for head in heads] if host else []
                mine += [WORD_MARK + w for w in set(split.split(host)) if w]
                told += mine
                owner += [i] * len(mine)
            found, who = index.find(told), np.array(owner, int)
            is_rule = (found >= 0) & (found < len(order))
            best, word = np.full(len(rows), -1), np.zeros(len(rows), bool)
            np.maximum.at(best, who[is_rule], found[is_rule])
            word[who[found == len(order)]] = True
            rule = [order[b] if b >= 0 else None for b in best.tolist()]
            return {"host": [h for h, _ in rows], "path": [p for _, p in rows], "rule": rule, "verdict": [rules[r] if r is not None else "block" if w else "allow" for r, w in zip(rule, word.tolist(), strict=True)]}

        return compute

    return per_row(df, F.array(*url_parts(F.col(f"`{url}`"))), "host string,path string,rule string,verdict string", make)
