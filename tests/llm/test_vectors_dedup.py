"""Vector codes, whitening and exact duplicates against brute force."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, ODD, by_id, docs
from twinarm.llm import exact_dedup, vector_codes, whitening
from twinarm.llm.vectors import exact_products

# ---- vectors


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for bits, width in ((10, 8), (27, 64), (29, 8), (30, 3), (12, 1)):
        a, b = (rng.integers(-(1 << bits), 1 << bits, (7, width)) for _ in range(2))
        assert exact_products(a, b).tolist() == (a.astype(object) @ b.astype(object).T).tolist()


def codes_by_hand(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks with Python's whole numbers."""
    numbers = {k: [math.floor(scale * x) for x in v] for k, v in rows}
    width = len(next(iter(numbers.values()))) // parts
    cut = {k: [tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for k, v in numbers.items()}
    books = [[list(cut[k][p]) for k in sorted(cut)[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((x - c) ** 2 for x, c in zip(part, entry)), i) for i, entry in enumerate(book))
    for _ in range(rounds):
        fresh = [[list(e) for e in book] for book in books]
        for p in range(parts):
            chosen: dict = {}
            for v in cut.values():
                chosen.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for entry, mine in chosen.items():
                fresh[p][entry] = [sum(x) // len(mine) for x in zip(*mine)]
        books = fresh
    found = {k: [near(v[p], books[p]) for p in range(parts)] for k, v in cut.items()}
    told = ",".join(str(c) for book in books for entry in book for c in entry)
    return {k: ("".join(f"{i:02x}" for _, i in v), sum(d for d, _ in v)) for k, v in found.items()}, hashlib.sha256(told.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<double>, label int, CODE string, N int"


def vector_rows(n=60, size=4, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(0, 0.3, size) * (1, 40)[i % 7 == 0]).round(3).tolist(), (i % 3) or None, "clash", 1) for i in range(n)]


ODD_VECTORS = [
    (100, None, 1, "x", 1), (101, [0.1, None, 0.2, 0.3], 1, "x", 1), (102, [0.1, float("nan"), 0.2, 0.3], 1, "x", 1), (103, [0.1, float("inf"), 0.2, 0.3], 1, "x", 1),
]


def test_codes_against_whole_numbers(spark):
    rows = vector_rows()
    rows += [(200, [0.0] * 4, None, "x", 1), (200, [0.0] * 4, None, "x", 1)]  # a repeated row
    df = spark.createDataFrame(rows + ODD_VECTORS, VECTORS).repartition(5)
    books = vector_codes.fit(df, parts=2, entries=5, rounds=3, scale=64)
    out = vector_codes.encode(df, books)
    # The repeated row counts twice.
    want, digest = codes_by_hand([((k, i), v) for i, (k, v, *_) in enumerate(rows)], 2, 5, 3, 64)
    assert by_id(out, "vec_id", "code", "error") == sorted(((k, *found) for (k, _), found in want.items()), key=repr)
    assert books.sha256() == digest and out.columns == ["vec_id", "embedding", "label", "N", "code", "error"]
    totals: dict = {}
    for i, (_, _, label, *_) in enumerate(rows):
        totals[label] = totals.get(label, 0) + want[(rows[i][0], i)][1]
    for most in (100, 0):  # sent to the rows, and joined by a salted shuffle
        sums = vector_codes.lookup(out, spark.createDataFrame(list(totals.items()), "label int, s long"), ["label"], F.col("vec_id"), "left", most, 3)
        assert {(r["label"], r["s"]) for r in sums.collect()} == set(totals.items())
    assert {(r["label"], r["group_error"]) for r in vector_codes.with_group_error(out).collect()} == set(totals.items())


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    books = vector_codes.fit(empty)
    assert vector_codes.encode(empty, books).count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
    assert vector_codes.with_group_error(vector_codes.encode(empty, books)).count() == 0
    none = spark.createDataFrame(ODD_VECTORS, VECTORS)
    assert vector_codes.encode(none, vector_codes.fit(none)).count() == 0
    # Too few vectors for all entries, a null id, a vector of another length, one beyond 64 bits, an empty one.
    few = spark.createDataFrame([(None, [9.0] * 8, 1, "x", 1), (2, [1.0] * 8, 1, "x", 1), (1, [2.0] * 8, 1, "x", 1), (3, [1.0] * 3, 1, "x", 1), (4, [1e30] * 8, 1, "x", 1), (5, [], 1, "x", 1)], VECTORS)
    books = vector_codes.fit(few, scale=1)
    assert [len(b) for b in books.entries] == [2] * 8
    out = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.encode(few, books).collect()}
    assert out == {None: ("00" * 8, 0), 2: ("01" * 8, 0), 1: ("01" * 8, 8), 3: (None, None), 4: (None, None), 5: (None, None)}
    with pytest.raises(ValueError):
        vector_codes.fit(spark.createDataFrame([(1, [1.0] * 9, 1, "x", 1)], VECTORS))


def whitened_by_hand(rows, most):
    numbers = [[math.floor(64 * x) + 1_000_000 for x in v] for _, v in rows]
    n, size = len(numbers), len(numbers[0])
    sums = [sum(x) for x in zip(*numbers)]
    apart = np.array([[float(Fraction(x) - Fraction(s, n)) for x, s in zip(row, sums)] for row in numbers])
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    order = np.argsort(-values)[:most]
    deviation = [sum((n * x - s) ** 2 for x, s in zip(row, sums)) for row in numbers]
    return deviation, apart @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_against_dense(spark):
    rows = vector_rows(80, 6)
    df = spark.createDataFrame(rows + ODD_VECTORS, VECTORS).repartition(5)
    model = whitening.fit(df, most=4)
    out = whitening.whiten(df, model)
    assert "CODE" in out.columns and "N" not in out.columns and out.count() == 80 * 4
    deviation, white, explained = whitened_by_hand([(k, v) for k, v, *_ in rows], 4)
    found = np.zeros((80, 4))
    for r in out.collect():
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]] and r["n"] == 80
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-10
    assert np.allclose(np.abs(found), np.abs(white), atol=1e-9)
    assert np.allclose(found.T @ found / 80, np.eye(4), atol=1e-10)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    model = whitening.fit(df)
    deviation, white, explained = whitened_by_hand([(r["vec_id"], r["embedding"]) for r in df.orderBy("vec_id").collect()], 32)
    found = np.zeros_like(white)
    for r in whitening.whiten(df, model).collect():
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]]
    assert np.abs(np.abs(found) - np.abs(white)).max() < 1e-8 and np.allclose(model.eigenvalues / model.trace, explained, rtol=1e-10)


def test_whitening_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], 1, "x", 1), (1, [1.0, 2.0], 1, "x", 1), (2, [1.0], 1, "x", 1)], VECTORS)
    assert whitening.fit(same).n == 2 and whitening.whiten(same, whitening.fit(same)).count() == 0
    line = spark.createDataFrame([(None, [1.0, 2.0], 1, "x", 1), (1, [3.0, 6.0], 1, "x", 1), (1, [3.0, 6.0], 1, "x", 1), (2, [1e300, 1.0], 1, "x", 1)], VECTORS)
    out = whitening.whiten(line, whitening.fit(line)).collect()
    assert len(out) == 3 and {r["component"] for r in out} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in out)
    far = spark.createDataFrame([(i, [1e9 * (i - 5), 1e8 * i * i], 1, "x", 1) for i in range(11)], VECTORS)
    model = whitening.fit(far)
    deviation, white, _ = whitened_by_hand([(r[0], r[1]) for r in far.orderBy("vec_id").collect()], 2)
    for r in whitening.whiten(far, model).collect():
        assert abs(abs(r["whitened"]) - abs(white[r["vec_id"], r["component"] - 1])) < 1e-9
        assert r["deviation"] == (deviation[r["vec_id"]] if deviation[r["vec_id"]] < 2**63 else None)


def test_eigenvectors_of_odd_matrices():
    rng = np.random.default_rng(5)
    for size, rank in ((1, 1), (5, 5), (9, 4), (33, 33)):
        a = rng.normal(size=(size, rank)) * np.logspace(0, -4, rank)
        values, vectors = whitening.eigen(a @ a.T)
        assert len(values) == rank and np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
        assert np.allclose(vectors * values @ vectors.T, a @ a.T, atol=1e-13)
    assert whitening.eigen(np.zeros((3, 3)))[0].size == 0 and whitening.eigen(np.zeros((0, 0)))[0].size == 0


# ---- exact duplicates

WORDS = ["", "a", "b" * 1024, "b" * 1025, "c" * 5000, "é" * 700, "\0", "\0\0", "x" * 40_000, "x" * 39_999 + "y"]


def test_fingerprints_compose():
    hasher = exact_dedup.Hasher()
    import pyarrow as pa

    data = [w.encode() for w in WORDS] + [LONG.encode(), None]
    found = hasher.hash(pa.array(data, pa.binary()))
    for k, (base, modulus) in enumerate(zip(exact_dedup.BASES, exact_dedup.MODULI, strict=True)):
        for value, told in zip(found[k].tolist(), data, strict=True):
            told = told or b""
            assert value == sum(c * pow(base, len(told) - 1 - i, modulus) for i, c in enumerate(told)) % modulus if len(told) < 6000 else True
            cut = len(told) // 3
            left, right = (int(x) for x in hasher.hash(pa.array([told[:cut], told[cut:]], pa.binary()))[k])
            assert exact_dedup.combine(left, right, len(told) - cut, base, modulus) == value
    assert [h.tolist() for h in hasher.hash(pa.array(data, pa.binary()).slice(2, 3))] == [f[2:5].tolist() for f in found]


def duplicates_by_hand(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and the number of rows that stay."""
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, last[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr), len(groups)


@pytest.mark.parametrize("moduli,piece,most", [(exact_dedup.MODULI, 1 << 20, 1000), (exact_dedup.MODULI, 300, 0), ((3, 2), 7000, 1000), ((3, 2), 500, 0)])
def test_duplicates(spark, moduli, piece, most):
    """Also with pieces of few bytes, with salted joins, and with moduli so small that most fingerprints collide."""
    rows = [(i, t) for i, t, _ in ODD] + [(10 + i, w) for i, w in enumerate(WORDS)] + [(40 + i, w) for i, w in enumerate(WORDS[3:])]
    rows += [(60 + i, f"text {i % 4:03d}") for i in range(24)] + [(90, None), (None, "text 001"), (None, "only here"), (None, "only here"), (91, LONG), (91, LONG), (7, LONG + " ")]
    df = docs(spark, [(i, t, "n") for i, t in rows], note="KEPT").repartition(4)
    out = exact_dedup.mark_duplicates(df, piece_bytes=piece, moduli=moduli, broadcast_groups=most)
    want, groups = duplicates_by_hand(rows)
    assert by_id(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = out.where("kept").collect()
    assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_duplicates_of_an_empty_table(spark):
    assert exact_dedup.mark_duplicates(docs(spark, [])).count() == 0
    single = exact_dedup.mark_duplicates(docs(spark, [(None, None, None)])).collect()
    assert [tuple(r)[:4] for r in single] == [(None, None, 1, True)]


PAIRS = [(i, f"text {i % 300:03d}", None) for i in range(600)] + [(600 + i, f"alone {i}", None) for i in range(100)] + [(800 + i, "often", None) for i in range(200)]


def broadcast_parts(df):
    """The parts of a plan that are sent whole to all tasks, each as the lines below its broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    return ["\n".join(lines[i:next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]) for i, line in enumerate(lines) if "BroadcastExchange" in line]


def test_many_groups_are_not_broadcast(spark, monkeypatch):
    """Beyond ``broadcast_groups`` only the few keys with many rows are sent to all tasks, though Spark takes all groups to be small."""
    monkeypatch.setattr(exact_dedup, "HEAVY_KEYS", 10)
    out = exact_dedup.mark_duplicates(docs(spark, PAIRS).repartition(4), broadcast_groups=0)
    sent = broadcast_parts(out)
    assert sent and all("Generate" not in part and "last_id" not in part for part in sent)
    assert by_id(out, "doc_id", "keep_id", "group_size", "text_sha256") == duplicates_by_hand([(i, t) for i, t, _ in PAIRS])[0]


def test_a_group_goes_to_several_tasks_only_where_it_is_large(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY_KEYS", 10)
    seen = []
    explode = F.explode
    monkeypatch.setattr(F, "explode", lambda c: seen.append(c) or explode(c))
    rows = spark.range(300).select(F.col("id").alias("row"), F.when(F.col("id") < 200, 1000).otherwise(F.col("id")).cast("long").alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = exact_dedup._joined(rows, groups, ["k"], "n", "left", 0)
    assert sorted((r["row"], r["n"]) for r in out.collect()) == [(i, 200 if i < 200 else 1) for i in range(300)]
    assert len(groups.select("k", explode(seen[0])).collect()) == 100 + exact_dedup.SALTS


@pytest.mark.parametrize("most", [1000, 0])
def test_bytes_decide_where_digests_agree(spark, monkeypatch, most):
    """With a digest of few values most different texts share one, and with the moduli the fingerprint too."""
    monkeypatch.setattr(exact_dedup, "_digest", lambda value: F.unhex(F.substring(F.sha2(value, 256), 1, 1)))
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(50, None), (51, ""), (52, LONG), (53, LONG), (54, LONG[:-1] + "?")]
    out = exact_dedup.mark_duplicates(docs(spark, [(i, t, None) for i, t in rows]).repartition(3), piece_bytes=5000, moduli=(3, 2), broadcast_groups=most)
    assert by_id(out, "doc_id", "keep_id", "group_size") == sorted((r[:3] for r in duplicates_by_hand(rows)[0]), key=repr)


def test_bits_let_all_candidates_through(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 1 << 18)
    told = spark.range(20_000).select("id", exact_dedup._digest(F.col("id").cast("string").cast("binary")).alias("sha"))
    found = {r["id"] for r in exact_dedup._sieved(told, told.where("id % 5 = 0").select(F.col("sha").alias("last_sha"))).collect()}
    assert found >= set(range(0, 20_000, 5)) and len(found) < 4000 + 0.05 * 16_000
