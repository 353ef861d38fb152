"""Coding and token counts against the libraries."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, by_id, docs
from twinarm.llm import bpe, token_counts

RANKS, VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
PARTS = [
    "a", "b", "e", "s", "re", " ", "  ", "\n", "'", "'s", "'re", "'ll", "1", "23", "!", "é", "ñ", "漢", "字", "😀", " ", "-", "<|endoftext|>", "THE", "tion",
    "\t", "\x1c", "’", "٣", "l",
]


def texts(n, longest, seed):
    rng = random.Random(seed)
    for _ in range(n):
        pool = PARTS if rng.random() < 0.5 else rng.sample(PARTS, rng.randint(1, 4))
        yield "".join(rng.choice(pool) for _ in range(rng.randint(0, longest)))


@pytest.mark.parametrize("leaf", [8, 11, 16, 4096])
def test_tree_gives_the_codes_of_the_library(leaf):
    coder = bpe.Coder(RANKS, P.PATTERN, leaf_bytes=leaf)
    for text in texts(800, 60, leaf):
        ids = coder.encode(text)
        assert ids == coder.inner.encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()


def test_long_runs_without_breaks():
    coder = bpe.Coder(RANKS, P.PATTERN)
    for text in ("ab" * 30_000, " " * 20_000 + "x", "7" * 9_000, "!'" * 5_000 + "s", "漢" * 7_000):
        assert coder.encode(text) == coder.inner.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()


def test_every_token_is_its_own_code():
    """What the joining of windows and the counting of prefixes rest on."""
    for path in (RANKS, P.path("byte_bpe_50k.tiktoken")):
        ranks = bpe.read_ranks(path)
        for token in random.Random(5).sample(sorted(ranks), 4000):
            parts = [token[i:i + 1] for i in range(len(token))]
            while len(parts) > 1:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                assert rank < 1 << 40
                parts[at:at + 2] = [parts[at] + parts[at + 1]]


def test_coding_of_odd_rows(spark):
    df = bpe.encode(docs(spark).withColumn("ids", F.lit("clash")), RANKS, P.PATTERN)
    coder = bpe.Coder(RANKS, P.PATTERN)
    want = sorted(((i, n, np.array(coder.inner.encode_ordinary(t or ""), "<u4").tobytes()) for i, t, n in ODD), key=repr)
    assert sorted(((r["doc_id"], r["note"], bytes(r["ids"])) for r in df.collect()), key=repr) == want
    both = bpe.round_trip(docs(spark), RANKS, P.PATTERN)
    assert by_id(both.withColumn("same", F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")), "same") == [(True,)] * len(ODD)
    assert by_id(bpe.decode(df, RANKS, P.PATTERN).select("doc_id", F.col("decoded").cast("string").alias("t")), "doc_id", "t") == sorted(
        ((i, t or "") for i, t, _ in ODD), key=repr)
    assert bpe.encode(docs(spark, []), RANKS, P.PATTERN).count() == 0


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_counts_are_those_of_the_library(library):
    counter = token_counts.Counter(VOCABULARY)
    for text in texts(2500, 60, 1):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_every_prefix_and_budget(library):
    counter = token_counts.Counter(VOCABULARY)
    for text in texts(400, 25, 2):
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == want, text
        for limit in (0, 1, 3, 7):
            assert counter.budget(text, limit) == (want[-1], max(i for i in range(len(text) + 1) if want[i] <= limit)), (text, limit)


def test_counts_of_odd_rows(spark, library):
    df = token_counts.count_tokens(docs(spark, note="n_tokens"), VOCABULARY, 6)
    assert df.columns == ["doc_id", "text", "n_tokens", "fit_chars"]
    assert by_id(df, "doc_id", "n_tokens") == sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD), key=repr)
    assert token_counts.count_tokens(docs(spark, []), VOCABULARY, 6).count() == 0
