"""The registered queries that SQL cannot express, and the pipeline, against brute force."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.compare import differences, open_tables
from tests.llm.helpers import LONG, ODD, by_id, docs
from twinarm.llm import bpe, jaccard, quality
from twinarm.llm.decontaminate import plain_words

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def alike(rows, percent=80):
    """Size of each set and least id of its component, by comparing all pairs."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) & {n for n in queries() if n.startswith("op")}))
def test_queries_against_sql(spark, name):
    assert differences(queries()[name](spark, FOLDER), open_tables(FOLDER), oracle_sql()[name]) == []


def test_codes_and_counts_against_the_libraries(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = coder.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert by_id(queries()["op1_bpe"](spark, FOLDER), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counts = [(i, len((t or "").encode()), n, n > 512) for i, t in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)]]
    assert by_id(queries()["op8_token_counts"](spark, FOLDER), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(counts, key=repr)


def test_join_of_odd_rows(spark):
    out = by_id(jaccard.join_alike(docs(spark, note="component_id")), "doc_id", "n_shingles", "component_id")
    want = alike([(i, t) for i, t, _ in ODD if i is not None])
    assert [r for r in out if r[0] is not None] == sorted(((i, *want[i]) for i, _, _ in ODD if i is not None), key=repr)
    assert [r for r in out if r[0] is None] == [(None, len(shingles(ODD[3][1])), None)]
    assert jaccard.join_alike(docs(spark, [])).count() == 0
    kept = by_id(jaccard.keep_one(docs(spark)), "doc_id")
    assert kept == sorted([(1,), (2,), (3,), (4,), (5,), (7,), (8,), (None,)], key=repr)


def test_join_of_large_groups(spark, monkeypatch):
    """Groups beyond the size for all pairs: chains and near copies keep every link."""
    rng = np.random.default_rng(3)
    rows, base = [], [f"w{i}" for i in range(60)]
    for i in range(150):
        changed = list(base)
        for k in rng.choice(60, rng.integers(0, 5), replace=False):
            changed[k] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(changed)))
    chain = [f"c{i}" for i in range(200)]
    rows += [(1000 + i, " ".join(chain[2 * i:2 * i + 60])) for i in range(60)]
    rows += [(2000 + i, f"same header line here for all of us {i} " + " ".join(f"y{i}z{k}" for k in range(30))) for i in range(80)]
    monkeypatch.setattr(jaccard, "SMALL_GROUP", 6)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    found = jaccard.join_alike(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == alike(rows)


def test_pipeline_against_brute_force(spark):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, steps = source, []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, FOLDER)
        kept.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}/pipeline-{len(steps)}")
        kept = spark.read.parquet(path)
        steps.append({r["doc_id"]: r for r in kept.collect()})
    start = {r["doc_id"]: r for r in source.collect()}
    model = quality.fit(source, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert set(steps[0]) == {r["doc_id"] for r in quality.score(source, model).where("kept").collect()}
    assert set(steps[1]) == {c for _, c in alike([(i, r["text"]) for i, r in steps[0].items()]).values()}
    assert all(r == start[i] for i, r in steps[1].items())
    assert set(steps[2]) <= set(steps[1]) and all(len(r["text"]) == r["n_chars"] or r == start[i] for i, r in steps[2].items())
    items = [" ".join(plain_words(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    exact = {i for i, r in steps[2].items() if any(x in " ".join(plain_words(r["text"])) for x in items)}
    assert exact <= set(steps[2]) - set(steps[3]) and len(set(steps[2]) - set(steps[3])) <= len(exact) + 3
    assert set(steps[4]) == set(steps[3]) and all(r["exact"] for r in steps[4].values())
    whole = {r["doc_id"]: r["n_tokens"] for r in queries()["pipeline"](spark, FOLDER).collect()}
    assert whole == {i: r["n_tokens"] for i, r in steps[4].items()}


def test_pipeline_of_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, t, "en", "s", len(t or "")) for i, t, _ in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert by_id(out, "doc_id", "text") == [(5, LONG)]
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).where(F.lit(True)).count() == 0
