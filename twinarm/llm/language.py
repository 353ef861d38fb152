"""Language of texts: scripts narrow the candidates, words are scored, and a Viterbi path labels spans.

For each language the table has the log share of hashed character 3-grams of its words
and the share of each script. A word's score for a language is the sum over its
3-grams; languages that do not use the word's script get a large penalty. The best
sequence of labels over a text pays a penalty for each switch, so a passage in another
language becomes a span of its own and single odd words do not.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.common import bound_batches, per_row

BITS = 16
BUCKETS = 1 << BITS
#: Labelled documents of each language that the tables are learned from, about, if it has more.
MOST_ROWS = 20_000
SWITCH = 12.0
MEMO_ENTRIES = 400_000
CHUNK_CHARS = 1_000_000
#: Scripts by ranges of code points (fixed values); other letters are script 0.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF))),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
)


class Letters:
    """Letter and script of every code point, and the 3-grams of words."""

    def __init__(self):
        top = 0x110000
        self.letter = np.fromiter((chr(c).isalpha() for c in range(top)), bool, top)
        self.script = np.zeros(top, np.int8)
        for i, (_, ranges) in enumerate(SCRIPTS, 1):
            for low, high in ranges:
                self.script[low:high + 1] = i

    def grams(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """3-gram buckets of all words, the word of each, and letters and script (of the first letter) by word."""
        framed = [f" {w.lower()} " for w in words]
        lengths = np.fromiter(map(len, framed), np.int64, len(framed))
        codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(words)), lengths)
        is_letter = self.letter[codes]
        plain = np.where(is_letter, codes, 32).astype(np.uint32)
        mixed = plain[:-2] * np.uint32(2654435761) + plain[1:-1] * np.uint32(2246822519) + plain[2:] * np.uint32(3266489917)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(668265263)
        ok = (owner[:-2] == owner[2:]) & (is_letter[:-2] | is_letter[1:-1] | is_letter[2:])
        letters = np.bincount(owner, is_letter, len(words)).astype(np.int64)
        script = np.zeros(len(words), np.int8)
        places = np.flatnonzero(is_letter)[::-1]
        script[owner[places]] = self.script[codes[places]]
        return (mixed >> np.uint32(32 - BITS))[ok].astype(np.int64), owner[:-2][ok], letters, script


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most_rows: int = MOST_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log shares of 3-grams by language, and shares of scripts by language.

    Learned from all rows with a language, a key and a text of a language that has up to
    ``most_rows`` of them; of others, from those whose digest of ``key`` is in the share
    that has about so many. Texts are counted whole, in tasks.
    """
    named = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("_key"))
    known = named.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("_key").isNotNull())
    share = known.groupBy("lang").agg((F.lit(float(most_rows)) / F.count("*")).alias("_share"))
    place = F.shiftrightunsigned(F.xxhash64("_key", F.lit(3)), 11) / F.lit(float(1 << 53))
    sample = known.join(F.broadcast(share), "lang").where(place < F.col("_share"))

    def run(batches):
        import pyarrow as pa

        tool, counts, scripts = Letters(), {}, {}
        for batch in batches:
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = value.split()
                if not words:
                    continue
                grams, _, letters, script = tool.grams(words)
                counts[name] = counts.get(name, 0) + np.bincount(grams, minlength=BUCKETS)
                scripts[name] = scripts.get(name, 0) + np.bincount(script, letters, len(SCRIPTS) + 1)
        names = sorted(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[n].astype("<i8").tobytes() for n in names], pa.binary()),
             pa.array([scripts[n].astype("<f8").tobytes() for n in names], pa.binary())], names=["lang", "grams", "scripts"])

    # A task has one row of counts for each language; they are added up in two steps, so that few reach the driver.
    bound_batches(labelled.sparkSession)
    counted = sample.select("lang", "text").mapInArrow(run, "lang string, grams binary, scripts binary")
    slot = F.pmod(F.spark_partition_id(), F.lit(8)).alias("slot")
    totals: dict[str, list] = {}
    for row in counted.select("lang", slot, "grams", "scripts").groupBy("lang", "slot").applyInArrow(_added, "lang string, grams binary, scripts binary").collect():
        grams, scripts = np.frombuffer(row["grams"], "<i8"), np.frombuffer(row["scripts"], "<f8")
        old = totals.get(row["lang"])
        totals[row["lang"]] = [grams, scripts] if old is None else [old[0] + grams, old[1] + scripts]
    names = sorted(totals)
    if not names:
        return [], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS) + 1))
    grams = np.stack([totals[n][0] for n in names]) + 0.1
    scripts = np.stack([totals[n][1] for n in names])
    return names, np.log(grams / grams.sum(1, keepdims=True)), scripts / np.maximum(scripts.sum(1, keepdims=True), 1)


def _added(table):
    """One row for the counts of a language from several tasks."""
    import pyarrow as pa

    grams = sum(np.frombuffer(x, "<i8") for x in table.column("grams").to_pylist())
    scripts = sum(np.frombuffer(x, "<f8") for x in table.column("scripts").to_pylist())
    return pa.table({"lang": table.column("lang").slice(0, 1), "grams": pa.array([grams.tobytes()], pa.binary()), "scripts": pa.array([scripts.tobytes()], pa.binary())})


class _Words(dict):
    """Row of the score table of each word that was seen."""


class Labeller:
    """Scores words and finds the best sequence of languages of each text."""

    def __init__(self, names: list[str], grams: np.ndarray, scripts: np.ndarray, switch: float = SWITCH):
        self.names, self.tool, self.switch = names, Letters(), switch
        self.grams = np.ascontiguousarray(grams.T.astype(np.float32))
        uses = scripts > 0.001
        self.penalty = np.where(uses.any(0)[None, :] & ~uses, -50.0, 0.0).T.astype(np.float32)
        self.memo = _Words()
        self.table = np.zeros((0, len(names)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        grams, owner, letters, script = self.tool.grams(words)
        score = np.stack([np.bincount(owner, self.grams[grams, k], len(words)) for k in range(len(self.names))], 1)
        score = np.where((letters > 0)[:, None], score + self.penalty[script], 0.0)
        return score.astype(np.float32), letters

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the score table of all words, and the number of words of each text."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo, self.table, self.letters = _Words(), self.table[:0], self.letters[:0]
        flat, counts, size, part = [], [], 0, []
        for i, text in enumerate(texts):
            words = text.split()
            counts.append(len(words))
            part += words
            size += len(text)
            if size > CHUNK_CHARS or i == len(texts) - 1:
                fresh = sorted(set(part) - self.memo.keys())
                if fresh:
                    score, letters = self._score(fresh)
                    start = len(self.table)
                    self.table, self.letters = np.concatenate([self.table, score]), np.concatenate([self.letters, letters])
                    self.memo.update(zip(fresh, range(start, start + len(fresh)), strict=True))
                flat.append(np.fromiter(map(self.memo.__getitem__, part), np.int32, len(part)))
                part, size = [], 0
        return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), np.array(counts, np.int64)

    def spans(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The label of each word, by the best path of each text; all texts step together, the longest first."""
        n_lang = len(self.names)
        order = np.argsort(-counts, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        active = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), side="left")
        value = np.zeros((len(counts), n_lang), np.float32)
        back = np.zeros((len(ids), n_lang), np.int16)
        stay = np.arange(n_lang, dtype=np.int16)[None, :]
        for t, n in enumerate(active.tolist()):
            at, v = starts[:n] + t, value[:n]
            best = v.argmax(1)
            change = np.take_along_axis(v, best[:, None], 1) - np.float32(self.switch)
            taken = change > v
            back[at] = np.where(taken, best[:, None].astype(np.int16), stay)
            value[:n] = np.where(taken, change, v) + self.table[ids[at]]
        label, current = np.zeros(len(ids), np.int16), value.argmax(1)
        for t in range(len(active) - 1, -1, -1):
            n = int(active[t])
            at = starts[:n] + t
            label[at] = current[:n]
            current[:n] = back[at, current[:n]]
        return label

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language with the most letters under the labels, and its share of the letters; ``und`` and 0 without letters."""
        texts = [t or "" for t in texts]
        ids, counts = self.ids(texts) if self.names else ([], [])
        if not len(ids):
            return ["und"] * len(texts), [0.0] * len(texts)
        label, letters = self.spans(ids, counts), self.letters[ids]
        text = np.repeat(np.arange(len(texts)), counts)
        share = np.bincount(text * len(self.names) + label, letters, len(texts) * len(self.names)).reshape(len(texts), -1)
        total = share.sum(1)
        best = share.argmax(1)
        score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
        return [self.names[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)], score.tolist()

    def label_spans(self, text: str) -> list[tuple[str, int, int]]:
        """Spans of one text: language, first word and the word after the last."""
        ids, counts = self.ids([text]) if self.names else ([], [])
        if not len(ids):
            return []
        label = self.spans(ids, counts)
        cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
        return [(self.names[label[a]], a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def predict(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", switch: float = SWITCH) -> DataFrame:
    """Add ``lang_pred`` and ``score`` of each whole text.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if
    nothing was learned. Columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32), model[2]))

    def make():
        labeller = Labeller(*shared.value, switch=switch)

        def compute(texts):
            names, scores = labeller.predict(texts)
            return {"lang_pred": names, "score": scores}

        return compute

    return per_row(df, text, "lang_pred string,score double", make)
