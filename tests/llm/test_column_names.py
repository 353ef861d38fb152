"""Extra columns under any name pass through every operator, and columns named like an output are replaced."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs
from twinarm.llm import bpe, decontaminate, exact_dedup, html_text, jaccard, language, quality, substring, token_counts, url_filter, vector_codes, whitening
from twinarm.llm.queries import RANKS, VOCABULARY

#: Names that operators use inside, or that differ from an output by case only.
NAMES = ["_text", "_source", "source", "source_", "_key", "_node", "_page", "_parts", "_pair", "_units", "_spans", "_empty", "_i", "_s", "_e", "pack", "place", "salt", "row"]


def crowded(df, *clashes):
    return df.withColumns({n: F.lit(f"in {n}") for n in [*NAMES, *clashes]})


def checked(out, df, made):
    """All columns but those made are there with their values; those made are there once, whatever their case."""
    lowered = [c.lower() for c in out.columns]
    assert len(set(lowered)) == len(lowered) and set(m.lower() for m in made) <= set(lowered)
    kept = [c for c in df.columns if c.lower() not in {m.lower() for m in made}]
    assert sorted(map(repr, out.select(kept).collect())) == sorted(map(repr, df.select(kept).collect()))


def test_texts(spark):
    base = docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    df = crowded(base, "N_TOKENS", "IDS", "Decoded", "LANG_PRED", "Kept", "Leak_Items", "Removed_Starts")
    checked(bpe.round_trip(df, RANKS, P.PATTERN), df, ["ids", "decoded"])
    checked(bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN), df, ["ids", "decoded"])
    checked(token_counts.count_tokens(df, VOCABULARY, 5), df, ["n_tokens", "fit_chars"])
    model = language.learn(base.withColumn("lang", F.lit("en")))
    checked(language.predict(df, model), df, ["lang_pred", "score"])
    checked(quality.score(df, quality.fit(base, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))), df, [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept"])
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "漢字")], "item_id long, text string")
    checked(decontaminate.find_items(df, items), df, ["leak_items", "leak_starts", "leak_edits"])
    checked(substring.remove_repeats(df.where("doc_id <> 6")), df.where("doc_id <> 6"), ["text", "removed_starts", "removed_ends"])


def test_rows_that_stay(spark):
    df = crowded(docs(spark), "NODE", "Component_Id", "Often")
    assert set(jaccard.keep_one(df).columns) == set(df.columns) and jaccard.keep_one(df).count() == 8
    assert jaccard.join_alike(df).count() == df.count() == exact_dedup.mark_duplicates(df).count()


def test_pages_and_urls(spark):
    df = crowded(spark.createDataFrame([(1, "<p>a b</p>", "http://a.net/x"), (2, None, None)], "page_id long, html string, url string"), "TEXT", "N_CHARS", "HOST", "Verdict")
    checked(html_text.extract(df, html_text.learn(df)), df, ["text", "n_chars"])
    checked(url_filter.judge(df, ["net/"], []), df, ["host", "path", "rule", "verdict"])


@pytest.mark.parametrize("most", [4])
def test_vectors(spark, most):
    df = crowded(spark.createDataFrame([(i, [float(i), 1.0 / (1 + i)] * 4, i % 2) for i in range(6)], "vec_id long, embedding array<double>, label int"), "CODE", "Whitened")
    coded = vector_codes.encode(df, vector_codes.fit(df, entries=2, rounds=1))
    checked(coded, df, ["code", "error"])
    checked(vector_codes.with_group_error(coded), df, ["code", "error", "group_error"])
    out = whitening.whiten(df, whitening.fit(df, most=1))
    checked(out, df, ["component", "n", "deviation", "whitened", "explained", "identity_error"])
