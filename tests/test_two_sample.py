import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinarm.operators import describe, exact, ranks, two_sample
from twinarm.operators.describe import Categorical, Continuous


@pytest.fixture
def sample(spark):
    rng = np.random.default_rng(7)
    data = [(int(i), int(i % 2), float(rng.integers(0, 9)), "ab"[i % 3 == 0]) for i in range(60)]
    return spark.createDataFrame(data, "id int, arm int, y double, site string")


def test_welch_equal_groups(spark, rows):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (0, 1.0), (0, 3.0)], "arm int, y double")
    (r,) = rows(two_sample.welch(df, "y", arm="arm"))
    assert (r["mean1"], r["mean0"], r["difference"], r["df"]) == (3.0, 2.0, 1.0, 2.0)
    assert r["t"] == pytest.approx(1 / math.sqrt(2))
    # t with two degrees of freedom has p = 1 - t / sqrt(2 + t^2)
    assert r["p"] == pytest.approx(1 - r["t"] / math.sqrt(2 + r["t"] ** 2))
    assert r["ci_high"] - r["ci_low"] == pytest.approx(2 * 4.302652729911275 * r["se"])


def test_too_few_or_no_spread(spark, rows):
    df = spark.createDataFrame([("one", 1, 2.0), ("one", 0, 1.0), ("one", 0, 5.0), ("flat", 1, 3.0), ("flat", 1, 3.0),
                                ("flat", 0, 3.0), ("flat", 0, 3.0), ("empty", 1, 1.0), ("empty", 1, 2.0)], "s string, arm int, y double")
    for r in rows(two_sample.welch(df, "y", arm="arm", by=["s"]), "s"):
        assert r["t"] is None and r["p"] is None and r["ci_low"] is None
    g = {r["s"]: r for r in rows(two_sample.hedges_g(df, "y", arm="arm", by=["s"]))}
    assert g["one"]["g"] is None and g["flat"]["g"] is None and g["empty"]["magnitude"] is None
    assert {r["s"] for r in rows(ranks.rank_sum(df, "y", arm="arm", by=["s"]))} == {"one", "flat"}


def test_arm_swap_negates(sample, rows):
    swapped = sample.withColumn("arm", 1 - F.col("arm"))
    for call, column in ((two_sample.welch, "t"), (two_sample.hedges_g, "g"), (two_sample.standardised_difference, "smd"),
                         (ranks.rank_sum, "rank_biserial")):
        a, b = rows(call(sample, "y", arm="arm"))[0], rows(call(swapped, "y", arm="arm"))[0]
        assert a[column] == pytest.approx(-b[column])
        if "p" in a:
            assert a["p"] == pytest.approx(b["p"])


def test_one_stratum_alone_equals_among_many(sample, rows):
    for call in (two_sample.welch, two_sample.hedges_g, ranks.rank_sum):
        many = {r.pop("site"): r for r in rows(call(sample, "y", arm="arm", by=["site"]))}
        for g in "ab":
            assert rows(call(sample.where(F.col("site") == g), "y", arm="arm"))[0] == pytest.approx(many[g], nan_ok=True)


def test_rank_sum_by_hand(spark, rows):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (0, 2.0), (0, 3.0)], "arm int, y double")
    (r,) = rows(ranks.rank_sum(df, "y", arm="arm"))
    # ranks 1, 3, 3 | 3, 5: the rank sum of arm 1 is 7
    assert (r["w"], r["tie_term"]) == (1.0, 24.0)
    assert r["rbc_half"] == pytest.approx(1 / 6 - 0.5) and r["rank_biserial"] == pytest.approx(2 / 6 - 1)
    sigma = math.sqrt(6 / 12 * (6 - 24 / 20))
    assert r["z"] == pytest.approx((1 - 3 + 0.5) / sigma)


def test_rank_sum_exact_only_without_ties(spark, rows):
    df = spark.createDataFrame([("u", 1, 1.0), ("u", 1, 2.0), ("u", 0, 3.0), ("u", 0, 4.0), ("u", 0, 5.0),
                                ("t", 1, 1.0), ("t", 1, 2.0), ("t", 0, 2.0), ("t", 0, 4.0)], "s string, arm int, y double")
    found = {r["s"]: r["p"] for r in rows(ranks.rank_sum(df, "y", arm="arm", by=["s"], method="exact_if_small"))}
    assert found["u"] == pytest.approx(2 / 10)
    normal = {r["s"]: r["p"] for r in rows(ranks.rank_sum(df, "y", arm="arm", by=["s"]))}
    assert found["t"] == normal["t"] and found["u"] != normal["u"]


def test_counted_rows_give_the_same(sample, rows):
    counted = sample.groupBy("arm", "y").agg(F.count(F.lit(1)).alias("n"))
    assert rows(ranks.rank_sum(sample, "y", arm="arm")) == rows(ranks.rank_sum(counted, "y", arm="arm", weight="n"))
    probs = {"q1": 0.25, "m": 0.5}
    assert rows(ranks.quantiles(sample, "y", probs, by=["arm"]), "arm") == rows(ranks.quantiles(counted, "y", probs, by=["arm"], weight="n"), "arm")


def table(spark, cells):
    data = [(level, a) for level, (zero, one) in cells.items() for a, n in ((0, zero), (1, one)) for _ in range(n)]
    return spark.createDataFrame(data, "level string, arm int")


def test_fisher(spark, rows):
    df = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 0)] + [(1, 1)] * 3, "arm int, flag int")
    (r,) = rows(exact.fisher_2x2(df, arm="arm", flag="flag"))
    assert r["p"] == pytest.approx(34 / 70) and r["odds_ratio"] == pytest.approx(6.4083, abs=1e-4)
    (empty,) = rows(exact.fisher_2x2(df.where("flag = 0 or arm = 1"), arm="arm", flag="flag"))
    assert empty["odds_ratio"] == float("inf") and empty["ci_high"] == float("inf")


def test_exact_levels_and_random_tables(spark, rows):
    df = table(spark, {"a": (5, 1), "b": (2, 6), "c": (3, 4), "d": (1, 7)})
    (full,) = rows(exact.fisher_levels(df, level="level", arm="arm"))
    assert full["method"] == "exact"
    (drawn,) = rows(exact.fisher_levels(df, level="level", arm="arm", method="random", replicates=40000))
    assert drawn["method"] == "random"
    assert drawn["p"] == pytest.approx(full["p"], abs=4 * math.sqrt(full["p"] / 40000))
    (two,) = rows(exact.fisher_levels(table(spark, {"a": (3, 1), "b": (1, 3)}), level="level", arm="arm"))
    assert two["p"] == pytest.approx(34 / 70)
    (alone,) = rows(exact.fisher_levels(table(spark, {"a": (3, 1)}), level="level", arm="arm"))
    assert (alone["method"], alone["p"]) == ("none", 1.0)
    with pytest.raises(Exception, match="more levels"):
        exact.fisher_levels(df, level="level", arm="arm", most_levels=3).collect()


def test_method_is_the_one_asked_for(spark, rows):
    """The number of rows never changes the method: not for two levels, not for more."""
    for scale in (1, 40):
        df = table(spark, {"a": (5 * scale, scale), "b": (2 * scale, 6 * scale), "c": (3 * scale, 4 * scale)})
        assert {exact.fisher_levels(df, level="level", arm="arm", method=m).first()["method"] for m in exact.METHODS} == set(exact.METHODS)
    counted = spark.createDataFrame([("a", 0, 1_000_000), ("a", 1, 1_010_000), ("b", 0, 1_020_000), ("b", 1, 1_000_000)], "level string, arm int, n long")
    (two,) = rows(exact.fisher_levels(counted, level="level", arm="arm", weight="n"))
    assert two["method"] == "exact" and 0 < two["p"] < 1e-20


def test_network_of_levels(spark, rows):
    """Many levels, levels without rows of an arm, equal levels whose paths merge, several strata, large counts near the limit distribution."""
    rng = np.random.default_rng(8)
    cells, want = [], {}
    for stratum, sizes in enumerate([(3, 3, 3, 3, 3, 3), (1, 2, 5, 9), (4, 4), (6, 1, 1, 1, 1, 1, 1, 1)]):
        ones = [int(rng.integers(0, n + 1)) for n in sizes]
        ones[0] = max(1, min(sizes[0] - 1, ones[0])) if sizes[0] > 1 else ones[0]
        cells += [(stratum, f"l{k}", a, n) for k, (total, one) in enumerate(zip(sizes, ones)) for a, n in ((1, one), (0, total - one))]
        ways = {(): 1}
        for total in sizes:
            ways = {(*k, c): w * math.comb(total, c) for k, w in ways.items() for c in range(total + 1)}
        seen = math.prod(math.comb(t, o) for t, o in zip(sizes, ones))
        want[stratum] = sum(w for k, w in ways.items() if sum(k) == sum(ones) and w <= seen * (1 + 1e-9)) / math.comb(sum(sizes), sum(ones))
    df = spark.createDataFrame(cells, "stratum int, level string, arm int, n long")
    found = rows(exact.fisher_levels(df, level="level", arm="arm", by=["stratum"], weight="n"), "stratum")
    assert [r["p"] for r in found] == [pytest.approx(want[i], abs=1e-10) for i in range(4)]
    large = spark.createDataFrame([(k, a, 40_000 + 150 * ((k + a) % 2)) for k in range(4) for a in (0, 1)], "level int, arm int, n long")
    (big,) = rows(exact.fisher_levels(large, level="level", arm="arm", weight="n"))
    (limit,) = rows(exact.fisher_levels(large, level="level", arm="arm", weight="n", method="chi_square"))
    assert big["p"] == pytest.approx(limit["p"], rel=1e-3)


def test_summary_table_shows_every_cell(spark, rows):
    df = spark.createDataFrame([(1, "x", 2.0), (1, "y", 4.0), (0, None, None), (0, None, None)], "arm int, c string, z double")
    spec = {"c": describe.Categorical(("x", "y")), "z": describe.Continuous()}
    out = rows(describe.summary_table(df, spec, arm="arm", arms=[1, 0], tests=True), "variable", "level", "arm")
    assert [(r["variable"], r["level"], r["arm"], r["n_known"], r["n"]) for r in out] == [
        ("c", "x", 0, 0, 0), ("c", "x", 1, 2, 1), ("c", "y", 0, 0, 0), ("c", "y", 1, 2, 1), ("z", None, 0, 0, None), ("z", None, 1, 2, None)]
    assert {(r["variable"], r["method"]) for r in out if r["method"]} == {("c", "none")}


def test_totals_need_one_arm_per_subject(spark):
    days = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "s int, d double")
    arms = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0)], "s int, arm int")
    with pytest.raises(Exception, match="more than one row"):
        two_sample.compare_totals(days, arms, subject="s", arm="arm", columns={"total": "d"}).collect()


def test_scale_strata_with_one_arm_are_left_out(spark, rows):
    df = spark.createDataFrame([("x", 1, 1.0), ("x", 0, 2.0), ("x", None, 9.0), ("y", 1, 3.0)], "scale string, arm int, v double")
    assert [r["scale"] for r in rows(two_sample.compare_scales(df, score="v", arm="arm", by=["scale"]))] == ["x"]


def test_summary_table(spark, rows):
    df = spark.createDataFrame(
        [("A", "x", 1.0, "Yes"), ("A", "x", 2.0, "No"), ("A", None, None, "No"), ("B", "y", 3.0, "No"), ("B", "other", 4.0, None)],
        "arm string, cat string, num double, yn string")
    spec = {"cat": Categorical(("x", "y", "z"), "Category"), "num": Continuous("Number"), "yn": Categorical(("No", "Yes"), "Flag", ("Yes",))}
    found = {(r["variable"], r["level"], r["arm"]): r["text"] for r in rows(describe.summary_table(df, spec, arm="arm", arms=["A", "B"], tests=True))}
    assert found[("cat", "x", "A")] == "2 (100%)" and found[("cat", "z", "B")] == "0 (0%)"
    assert found[("cat", "y", "B")] == "1 (100%)"
    assert found[("num", None, "A")] == "1.5 (1.2, 1.8)"
    assert found[("yn", "Yes", "A")] == "1 (33%)" and ("yn", "No", "A") not in found
    assert found[("yn", "Yes", "B")] == "0 (0%)"


def test_counts_keep_missing_groups(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 0)], "c string, k int")
    assert rows(describe.crosstab(df, "c", "k", {1: "one", 0: "zero"}), "c") == [
        {"c": "a", "n_one": 1, "n_zero": 0, "n_missing": 1}, {"c": None, "n_one": 0, "n_zero": 1, "n_missing": 0}]
    (s,) = rows(describe.group_stats(df, "k"))
    assert (s["n"], s["n_nonnull"], s["mean"]) == (3, 2, 0.5)
    assert rows(describe.totals(df, {"t": "k"}, by=["c"]), "c") == [{"c": "a", "t": 1}, {"c": None, "t": 0}]


def test_summaries_read_their_source_once(spark, rows, tmp_path):
    """Quantiles, moments and extremes come from one count of the values; a group without known values and one far from zero are right."""
    data = [("a", 1e9 + v) for v in (1.0, 2.0, 2.0, 5.0)] + [("a", None), (None, 3.0), ("b", None)]
    spark.createDataFrame(data, "g string, y double").write.parquet(f"{tmp_path}/y")
    df = spark.read.parquet(f"{tmp_path}/y")
    found = {r["g"]: r for r in rows(describe.group_stats(df, "y", by=["g"]))}
    assert [(found[g]["n"], found[g]["n_nonnull"]) for g in ("a", None, "b")] == [(5, 4), (1, 1), (1, 0)]
    assert found["a"]["mean"] == 1e9 + 2.5 and found["a"]["sd"] == pytest.approx(math.sqrt(3.0), rel=1e-12) and found["a"]["median"] == 1e9 + 2
    assert found[None]["sd"] is None and found[None]["mean"] == 3.0 and found["b"]["mean"] is found["b"]["median"] is None
    five = {r["g"]: r for r in rows(describe.five_numbers(df, "y", by=["g"]))}
    assert (five["a"]["minimum"], five["a"]["maximum"], five["a"]["n_missing"], five["b"]["n_missing"]) == (1e9 + 1, 1e9 + 5, 1, 1)
    for frame in (describe.group_stats(df, "y", by=["g"]), describe.five_numbers(df, "y", by=["g"])):
        assert "FileScan" not in frame._jdf.queryExecution().executedPlan().toString()  # the written counts are all that is read


def counted_levels(spark, *tables):
    cells = [(i, f"l{k}", a, n) for i, (sizes, ones) in enumerate(tables) for k, (t, o) in enumerate(zip(sizes, ones)) for a, n in ((1, o), (0, t - o))]
    return spark.createDataFrame(cells, "stratum int, level string, arm int, n long")


def test_far_out_tables_of_large_counts(spark, rows):
    """Two milliard likelier tables before the last two levels are not walked: p is surely negligible, and right to some digits."""
    df = counted_levels(spark, ((31620, 32520, 31380, 33660, 31200), (16500, 16680, 15420, 16500, 15420)))
    start = time.monotonic()
    (far,) = rows(exact.fisher_levels(df, level="level", arm="arm", weight="n"))
    assert time.monotonic() - start < 120
    (limit,) = rows(exact.fisher_levels(df, level="level", arm="arm", weight="n", method="chi_square"))
    assert far["method"] == "exact" and far["p"] == pytest.approx(limit["p"], rel=0.03)
    assert far["p"] == pytest.approx(6.2558817757e-22, rel=1e-6)  # all terms in one task


def test_tables_less_likely_than_a_double(spark, rows):
    """Where the sum over all tables is below the smallest double, none is walked; a stratum beside it keeps its p."""
    df = counted_levels(spark, ((154286, 115714, 154285, 115715), (77142, 38572, 77142, 77144)), ((10, 12, 14), (3, 6, 9)))
    start = time.monotonic()
    none, near = rows(exact.fisher_levels(df, level="level", arm="arm", by=["stratum"], weight="n"), "stratum")
    assert time.monotonic() - start < 60
    assert (none["method"], none["p"]) == ("exact", 0.0) and 0.1 < near["p"] < 1


def test_large_counts_near_the_limit(spark, rows):
    """Tens of millions of likelier tables before the last two levels are walked, dealt out to tasks."""
    df = counted_levels(spark, ((15660, 15930, 16200, 15990, 15690), (7830, 7950, 7980, 8040, 7950)),
                        ((1000000, 1001000, 1002000, 1003000), (500000, 500500, 501900, 501500)))
    start = time.monotonic()
    found = rows(exact.fisher_levels(df, level="level", arm="arm", by=["stratum"], weight="n"), "stratum")
    assert time.monotonic() - start < 90
    limit = rows(exact.fisher_levels(df, level="level", arm="arm", by=["stratum"], weight="n", method="chi_square"), "stratum")
    assert [r["p"] for r in found] == [pytest.approx(r["p"], rel=2e-3) for r in limit]
