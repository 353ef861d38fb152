"""Quality rules: simple counts, and a logistic regression on hashed n-grams.

Words and character 3-grams are hashed into buckets; a text's features are the shares
of its words and of its 3-grams in each bucket. Weights are fitted to labelled rows,
probabilities are calibrated on labelled rows kept out of the fit, and texts are scored
in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.common import per_row

BITS = 14
BUCKETS = 1 << BITS
#: Labelled rows used for the fit, at most, of each label.
MOST_ROWS = 1500
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
THRESHOLD = 0.5
LEAST_WORDS = 50
REPEAT_PERCENT = 50
CHUNK_CHARS = 1_000_000
MEMO_ENTRIES = 300_000
#: Keeps buckets that few labelled texts use from getting large weights.
RARE = 1e-5


class _Hashes(dict):
    """64-bit digest of a word; common words are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_ENTRIES and len(word) <= 48:
            self[word] = value
        return value


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about the same number of characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _word_hashes(texts: list[str], memo: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words of the texts in a row, and the number of words of each text."""
    lists = [t.encode().split() for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = [np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)) for words in lists]
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint64)), counts


def _gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character 3-grams, and their number for each text. Texts are framed by line ends."""
    framed = ["\n" + t + "\n" for t in texts]
    counts = np.fromiter(map(len, framed), np.int64, len(framed))
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = codes * np.uint32(2654435761)
    mixed[:-1] += codes[1:] * np.uint32(2246822519)
    mixed[:-2] += codes[2:] * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(668265263)
    # The two last places of each text would reach into the next one.
    keep = np.ones(len(codes), bool)
    ends = np.cumsum(counts)
    keep[ends - 1] = False
    keep[np.maximum(ends - 2, 0)] = False
    return (mixed >> np.uint32(32 - BITS))[keep].astype(np.int64), np.maximum(counts - 2, 0)


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of consecutive groups, 0 for empty ones."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(counts)
    return (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)


def _repeat_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the words in 3-word windows that it has twice or more."""
    n = len(hashes)
    if n < 3:
        return np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(text[:-2] == text[2:])
    mixed = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + text[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = whole[np.argsort(mixed[whole], kind="stable")]
    same = (mixed[order][1:] == mixed[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(n, bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return np.bincount(text, weights=covered, minlength=len(counts)).astype(np.int64)


def _duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    spoken = [line for line in lines if line.strip(SPACES)]
    return len(spoken) - len(set(spoken))


def base_counts(texts: list[str | None], memo: _Hashes | None = None) -> dict[str, list[int]]:
    """The counts of the rules for each text; a missing text has none of anything."""
    texts = [t or "" for t in texts]
    memo = _Hashes() if memo is None else memo
    words, repeats = [], []
    for start, end in _chunks(texts):
        hashes, counts = _word_hashes(texts[start:end], memo)
        words += counts.tolist()
        repeats += _repeat_words(hashes, counts).tolist()
    return {
        "n_words": words,
        "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [_duplicate_lines(t) for t in texts],
        "n_repeat_words": repeats,
    }


def _scores(texts: list[str], weights: np.ndarray, memo: _Hashes) -> np.ndarray:
    """Linear score: the mean weight of the words and of the 3-grams, and the constant."""
    out = []
    for start, end in _chunks(texts):
        hashes, n_words = _word_hashes(texts[start:end], memo)
        grams, n_grams = _gram_buckets(texts[start:end])
        words = _means(weights[:BUCKETS][(hashes >> np.uint64(64 - BITS)).astype(np.int64)], n_words)
        out.append(words + _means(weights[BUCKETS:2 * BUCKETS][grams], n_grams) + weights[-1])
    return np.concatenate(out) if out else np.zeros(0)


def _features(rows: DataFrame, text: str) -> DataFrame:
    """Buckets and shares of each row's text as packed arrays."""
    def make():
        memo = _Hashes()

        def compute(texts):
            places, shares = [], []
            for t in texts:
                hashes, n_words = _word_hashes([t or ""], memo)
                grams, n_grams = _gram_buckets([t or ""])
                w, wc = np.unique((hashes >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
                g, gc = np.unique(grams.astype(np.int32), return_counts=True)
                places.append(np.concatenate([w, g + BUCKETS]).astype("<i4").tobytes())
                shares.append(np.concatenate([wc / max(1, n_words[0]), gc / max(1, n_grams[0])]).astype("<f4").tobytes())
            return {"places": places, "shares": shares}

        return compute

    return per_row(rows, text, "places binary,shares binary", make)


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", most_rows: int = MOST_ROWS, steps: int = 150
) -> np.ndarray:
    """Weights by bucket, the constant, and the slope and shift of the calibration.

    Of each label the ``most_rows`` rows of ``labels`` with the lowest digest of ``key``
    are used (rows without label or key are not), with their texts from ``docs``. Three of
    four are fitted; the fourth calibrates. With one label only, or none, every text
    gets that label's verdict, or is kept.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, label)
    order = F.xxhash64(F.col(key), F.lit(7))
    zeros, ones = (known.where(F.col(label) == value).orderBy(order, key).limit(most_rows) for value in (0, 1))
    # At most twice ``most_rows`` labels are sent to the documents; these are not shuffled.
    sample = docs.select(key, text).join(F.broadcast(zeros.unionByName(ones)), key)
    rows = sorted(_features(sample, text).select(key, label, "places", "shares").collect())
    out = np.zeros(2 * BUCKETS + 3)
    out[-2], labels = 1.0, np.array([r[1] for r in rows], float)
    if len(set(labels)) < 2:
        out[-3] = 10.0 if not len(labels) or labels[0] else -10.0
        return out
    kept_out = np.arange(len(rows)) % 4 == 3
    places = [np.frombuffer(r[2], "<i4") for r in rows]
    shares = [np.frombuffer(r[3], "<f4") for r in rows]
    index = np.repeat(np.arange(len(rows)), list(map(len, places)))
    place, share = np.concatenate(places), np.concatenate(shares).astype(float)
    balance = np.where(labels == 1, 0.5 / max(1, labels[~kept_out].sum()), 0.5 / max(1, (1 - labels[~kept_out]).sum())) * ~kept_out
    used = ~kept_out[index]
    scale = np.sqrt(np.bincount(place[used], share[used] ** 2 * balance[index[used]], 2 * BUCKETS) + RARE)
    share = share / scale[place]
    weight, constant = np.zeros(2 * BUCKETS), 0.0
    moment, second = np.zeros(2 * BUCKETS + 1), np.zeros(2 * BUCKETS + 1)
    for step in range(1, steps + 1):
        score = np.bincount(index, share * weight[place], len(rows)) + constant
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) * balance
        grad = np.append(np.bincount(place, share * error[index], 2 * BUCKETS) + 1e-3 * weight, error.sum())
        moment, second = 0.9 * moment + 0.1 * grad, 0.99 * second + 0.01 * grad ** 2
        move = 0.02 * (moment / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
        weight, constant = weight - move[:-1], constant - move[-1]
    score = np.bincount(index, share * weight[place], len(rows)) + constant
    out[:2 * BUCKETS], out[-3] = weight / scale, constant
    out[-2:] = _calibrate(score[kept_out], labels[kept_out])
    return out


def _calibrate(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores of unseen rows into probabilities, by Newton's steps."""
    if len(set(label)) < 2:
        return 1.0, 0.0
    # Targets a little inside 0 and 1 keep the slope finite for rows that are told apart without error.
    ones, zeros = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x, theta = np.stack([score, np.ones_like(score)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, x.T @ (target - p))
    return (float(theta[0]), float(theta[1])) if np.isfinite(theta).all() and theta[0] > 0 else (1.0, 0.0)


def score(df: DataFrame, model: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add the counts of the rules, ``base_failed``, ``quality_score`` and ``kept``.

    A null text counts as one without words. ``base_failed``: under 50 words, or more
    than half of the words in repeated 3-word windows. Other rows are kept if their
    probability of quality reaches ``threshold``. Columns of these names are replaced.
    """
    packed = df.sparkSession.sparkContext.broadcast(model.astype("<f8").tobytes())

    def make():
        weights, memo = np.frombuffer(packed.value, "<f8"), _Hashes()

        def compute(texts):
            texts = [t or "" for t in texts]
            found = base_counts(texts, memo)
            linear = _scores(texts, weights[:-2], memo)
            chance = 1 / (1 + np.exp(-np.clip(weights[-2] * linear + weights[-1], -30, 30)))
            n, repeats = np.array(found["n_words"], int), np.array(found["n_repeat_words"], int)
            failed = (n < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
            return found | {"base_failed": failed.tolist(), "quality_score": chance.tolist(), "kept": (~failed & (chance >= threshold)).tolist()}

        return compute

    outputs = "n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,base_failed boolean,quality_score double,kept boolean"
    return per_row(df, text, outputs, make)
