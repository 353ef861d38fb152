"""One query for each operator of this folder over the given tables, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinarm.llm import (
    bpe, chat, decontaminate, exact_dedup, html_text, jaccard, language, quality, substring, token_counts, url_filter, vector_codes, whitening)
from twinarm.llm.common import table, written

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 512
BLOCK_RULES, ALLOW_RULES = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]
EXTRA_CONVERSATION = -7
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, BLOCK_RULES, ALLOW_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_substring(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", F.size("removed_starts").cast("long").alias("n_removed"), "removed_starts", "removed_ends", "text")


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    out = chat.format_trees(chat.chain(rows.unionByName(extra)))
    read = out.select(
        F.col("tree").alias("conv_id"), chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op5_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_alike(table(spark, folder, "documents"))


def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.learn(pages)).select("page_id", "url", "text", "n_chars")


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.learn(docs.where(~held_out))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return token_counts.count_tokens(docs, VOCABULARY, TOKEN_LIMIT).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars")


def op9_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    leaks = F.explode(F.arrays_zip("leak_items", "leak_starts", "leak_edits")).alias("leak")
    return found.select("doc_id", leaks).select(
        "doc_id", F.col("leak.leak_items").alias("item_id"), F.col("leak.leak_starts").cast("long").alias("first_word"),
        F.col("leak.leak_edits").cast("long").alias("edits"))


def quality_model(spark: SparkSession, folder: str):
    """The quality model from the labelled documents of a folder."""
    return quality.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.score(docs, quality_model(spark, folder)).drop("text")


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    books = vector_codes.fit(vectors)
    coded = written(vector_codes.encode(vectors, books).select("vec_id", "label", "code", "error"), "codes")
    return vector_codes.with_group_error(coded, "label", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, whitening.fit(vectors)).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def codebook_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """SQL for the codes: long rows of (vector, part, place, number), a common table for each round."""
    steps = [f"""
        kept AS (
            SELECT vec_id, label, embedding AS e, len(embedding) // {parts} AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cells AS MATERIALIZED (
            SELECT vec_id, p, i, CAST(floor({scale} * CAST(e[p * w + i + 1] AS DOUBLE)) AS BIGINT) AS x
            FROM kept, range({parts}) a(p), range(CAST(w AS BIGINT)) b(i)
        ), first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}
        ), book0 AS MATERIALIZED (SELECT p, entry, i, x AS c FROM cells JOIN first USING (vec_id)
        )"""]
    for k in range(rounds + 1):
        steps.append(f"""
        near{k} AS MATERIALIZED (
            SELECT vec_id, p, min((d, entry)) AS best FROM (
                SELECT vec_id, p, entry, sum((x - c) * (x - c)) AS d FROM cells JOIN book{k} USING (p, i) GROUP BY ALL) GROUP BY ALL
        )""")
        if k < rounds:
            steps.append(f"""
        book{k + 1} AS MATERIALIZED (
            SELECT b.p, b.entry, b.i, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
                SELECT n.p, n.best[2] AS entry, c.i, CAST((sum(c.x) - (sum(c.x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS c
                FROM near{k} n JOIN cells c USING (vec_id, p) GROUP BY ALL) m USING (p, entry, i)
        )""")
    steps.append(f"""
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', CAST(best[2] AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
            FROM near{rounds} GROUP BY vec_id
        ), digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, entry, i)) AS codebooks_sha256 FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (vec_id), digest""")
    return "WITH" + ",".join(steps[:-1]) + "," + steps[-1]


QUERIES = {
    f.__name__: f for f in (
        op1_bpe, op2_url_rules, op3_substring, op4_chat_format, op5_shingle_join, op6_main_text, op7_language, op8_token_counts, op9_benchmark_leaks,
        op10_quality, op11_vector_codes, op12_whitening, op13_exact_dedup)
}

SQL = {
    "op2_url_rules": r"""
        WITH parts AS (
            SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM parts
        ), rules(rule, rhost, rpath, rverdict) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), fits AS (
            SELECT s.page_id, s.host, s.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.rverdict, length(r.rule)) AS rverdict
            FROM split s LEFT JOIN rules r
                ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
            GROUP BY ALL
        )
        SELECT page_id, host, path, rule,
            coalesce(rverdict, CASE WHEN len(list_intersect(regexp_split_to_array(host, '[.\-]'), ['adult', 'casino', 'porn', 'spam', 'xxx'])) > 0
                THEN 'block' ELSE 'allow' END) AS verdict
        FROM fits""",
    "op5_shingle_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
            FROM words
        ), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), edges AS (SELECT x AS u, y AS v FROM shared UNION SELECT y, x FROM shared
        ), reach(u, v) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u)
        SELECT s.doc_id, len(s.s) AS n_shingles, min(r.v) AS component_id FROM sets s JOIN reach r ON r.u = s.doc_id GROUP BY ALL""",
    "op11_vector_codes": codebook_sql(),
    "op13_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
            sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
