import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinarm.functions import columns as c
from twinarm.functions import fixed_values as v
from twinarm.functions import tails
from twinarm.functions.hypergeometric import FarTail, Network, Table, log_binomial, network_paths
from twinarm.functions.normal import normal_quantile
from twinarm.functions.rank_exact import exact_rank_p, rank_sum_counts


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("x")).first()["x"]


def test_visit_names(spark):
    code = c.recode("v", v.VISIT_CODES)
    assert one(spark, code, "180-day Assessment") == 19
    assert one(spark, code, "Integration/MRI2") == 13
    assert one(spark, code, "Integration / MRI2") is None
    assert one(spark, code, "Blood Pressure Check") is None
    assert one(spark, code, None) is None


@pytest.mark.parametrize("code,period", [(1, 1), (2, 2), (6, 2), (7, 3), (12, 3), (13, 4), (17, 4), (18, 5), (19, 6), (20, None), (None, None)])
def test_periods(spark, code, period):
    assert one(spark, c.band("v", v.PERIOD_RANGES), code, "int") == period


def test_missing_rules(spark):
    assert one(spark, c.is_in("v", ["a"]), None) is False
    assert one(spark, c.any_use("v"), None, "double") is False
    assert one(spark, c.among_users("v"), 0.0, "double") is None
    assert one(spark, c.exactly("v", 100), 100.0, "double") is True
    assert one(spark, c.to_number("v"), "abc") is None
    assert one(spark, c.to_number("v"), "12") == 12.0
    assert one(spark, c.recode("v", {"White": "White"}, "Other"), None) is None
    assert one(spark, c.recode("v", {"White": "White"}, "Other"), "x") == "Other"
    assert one(spark, c.level_position("v", ["a", "b"]), "b") == 2
    assert one(spark, c.level_position("v", ["a", "b"]), "z") is None


def test_two_flags(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (None, 2.0), (None, None)], "a double, b double")
    found = [r[0] for r in df.select(c.two_flags("a", "b", "both", "first", "second")).collect()]
    assert found == ["both", "first", "second", None]


def test_education_fallback(spark):
    rule = c.collapse_with_bands("d", v.EDUCATION_GROUPS, "y", v.EDUCATION_YEARS)
    df = spark.createDataFrame(
        [("High School, GED", 18), (None, 11), (None, 12), (None, 14), (None, 16), ("unlisted", 12), (None, None)], "d string, y int")
    assert [r[0] for r in df.select(rule).collect()] == [
        "High school degree", "Less than a high school degree", "High school degree", "Associate's degree/vocational training",
        "Bachelor's degree", None, None]


def test_text_formats(spark):
    assert [one(spark, c.p_text("v"), p, "double") for p in (0.0004, 0.0421, 0.9995, None)] == ["<0.001", "0.042", ">0.999", None]
    assert one(spark, c.half_even("v"), 2.5, "double") == 2.0
    assert one(spark, c.significant("v", 3), 0.0012345, "double") == pytest.approx(0.00123)
    assert one(spark, c.fixed("v", 4), None, "double") is None


def integral(f, low, high, n=40000):
    x = np.linspace(low, high, n + 1)
    w = np.ones(n + 1)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return (high - low) / (3 * n) * (w * f(x)).sum()


@pytest.mark.parametrize("t,df", [(0.5, 1.5), (2.0, 4.0), (1.3, 37.4), (4.2, 900.0), (2.5, 5e5)])
def test_t_tail(t, df):
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    expected = 1 - 2 * integral(lambda x: front * (1 + x * x / df) ** (-(df + 1) / 2), 0, t)
    assert float(tails.t_two_sided(t, df)) == pytest.approx(expected, abs=2e-9)
    assert float(tails.t_two_sided(tails.t_point(0.95, np.array([df]))[0], df)) == pytest.approx(0.05, abs=1e-10)


def test_chi_square_and_normal():
    assert float(tails.chi2_upper(3.841458820694124, 1)) == pytest.approx(0.05, abs=1e-12)
    for k in (2, 3, 5, 8):
        front = 1 / (2 ** (k / 2) * math.gamma(k / 2))
        expected = 1 - integral(lambda x: front * x ** (k / 2 - 1) * np.exp(-x / 2), 1e-12, 6.0)
        assert float(tails.chi2_upper(6.0, k)) == pytest.approx(expected, abs=1e-6)
    assert math.isnan(float(tails.t_two_sided(float("nan"), 3.0)))


def test_normal_quantile(spark):
    ps = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.9, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for r in df.collect():
        assert 0.5 * math.erfc(-r["z"] / math.sqrt(2)) == pytest.approx(r["p"], rel=1e-10)


def test_small_table():
    t = Table(3, 4, 4, 4)
    assert t.two_sided_p() == pytest.approx(34 / 70)
    estimate, low, high = t.odds_ratio()
    assert estimate == pytest.approx(6.4083, abs=1e-4)
    assert t.mean(math.log(estimate)) == pytest.approx(3.0, abs=1e-9)
    assert t.tail(math.log(low), True) == pytest.approx(0.025, abs=1e-9)
    assert t.tail(math.log(high), False) == pytest.approx(0.025, abs=1e-9)
    assert Table(0, 5, 5, 5).odds_ratio()[:2] == (0.0, 0.0)
    assert Table(5, 5, 5, 5).odds_ratio()[0] == float("inf")


def test_large_table_far_from_centre():
    assert Table(10, 1000, 1000, 1000).two_sided_p() == 0.0 or Table(10, 1000, 1000, 1000).two_sided_p() < 1e-300
    assert 0 < Table(400, 1000, 1000, 1000).two_sided_p() < 1e-15
    assert Table(500_300, 10**6, 10**6, 10**6).two_sided_p() == pytest.approx(0.3969316, abs=1e-6)


def test_tables_of_any_count():
    """Counts of 1e10: the normal limit, a symmetric interval, and blocks of bounded size."""
    n = 10**10
    t = Table(n // 4 + 50_000, n // 2, n // 2, n // 2)
    sd = math.sqrt(n / 16)
    assert t.two_sided_p() == pytest.approx(math.erfc((50_000 - 0.5) / sd / math.sqrt(2)), rel=1e-4)
    estimate, low, high = Table(n // 4, n // 2, n // 2, n // 2).odds_ratio()
    assert estimate == pytest.approx(1.0, abs=1e-9) and low * high == pytest.approx(1.0, abs=1e-8)
    assert math.log(high) == pytest.approx(1.959964 * math.sqrt(16 / n), rel=1e-3)
    assert all(len(points) <= 8192 for points, _ in t.blocks(t.mode(0.0), 0.0, 1))


def test_binomial_probabilities():
    for n in (1, 2, 17, 40):
        for share in (0.03, 0.5, 0.9):
            want = [math.log(math.comb(n, k)) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(n + 1)]
            assert np.allclose(log_binomial(n, np.arange(n + 1), share), want, rtol=1e-12, atol=1e-12)
    assert log_binomial(5, [-1, 6], 0.5).tolist() == [-math.inf, -math.inf]


def test_network_against_counting():
    """Paths through the levels, extended and merged, give the sum over all tables listed."""
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(40):
        rows = np.sort(rng.integers(1, 9, rng.integers(2, 6)))
        seen = np.array([rng.integers(0, r + 1) for r in rows])
        column, total = int(seen.sum()), int(rows.sum())
        if column in (0, total):
            continue
        ways = lambda cells: math.prod(math.comb(int(r), int(k)) for r, k in zip(rows, cells))
        limit = ways(seen) * (1 + 1e-9)
        expected = sum(
            w for cells in product(*[range(r + 1) for r in rows]) if sum(cells) == column and (w := ways(cells)) <= limit
        ) / math.comb(total, column)
        share = column / total
        net = Network(rows, share, float(log_binomial(rows, seen, share).sum()) + 1e-7)
        paths, found = {(float(column), 0.0): 1}, 0.0
        for place in range(len(rows) - 1):
            left, lp = (np.array(c) for c in zip(*paths)) if paths else (np.zeros(0), np.zeros(0))
            times = np.array(list(paths.values()), float)
            first, last = net.inner(place, left, lp)
            found += float((times * np.exp(lp) * net.outer(place, left, first, last)).sum())
            fresh: dict = {}
            for m, p, k, a, b in zip(left, lp, times, first, last):
                for x in np.arange(a, b + 1):
                    step = p + float(log_binomial(rows[place], x, share))
                    if step + net.shortest(place + 1, m - x) <= net.most:
                        fresh[m - x, round(step, 9)] = fresh.get((m - x, round(step, 9)), 0) + k
            paths = fresh
        assert found / math.exp(float(log_binomial(total, column, share))) == pytest.approx(expected, abs=1e-8)


def test_rank_sum_distribution():
    from itertools import combinations

    m, n = 3, 4
    counts = np.zeros(m * n + 1)
    for pick in combinations(range(1, m + n + 1), m):
        counts[sum(pick) - m * (m + 1) // 2] += 1
    assert np.array_equal(rank_sum_counts(m, n), counts)
    assert exact_rank_p(0, 3, 4) == pytest.approx(2 / 35)


def levels_of(rows, ones):
    """A network of these levels and the log probability of its column total."""
    rows, ones = np.asarray(rows, float), np.asarray(ones, float)
    share = ones.sum() / rows.sum()
    net = Network(rows, share, float(log_binomial(rows, ones, share).sum()) + 1e-7)
    return net, float(log_binomial(rows.sum(), ones.sum(), share))


def children(net, place, left, lp, first, last):
    wide = np.maximum(last - first + 1, 0).astype(int)
    node = np.repeat(np.arange(len(left)), wide)
    x = first[node] + np.arange(len(node)) - np.repeat(np.cumsum(wide) - wide, wide)
    return left[node] - x, lp[node] + log_binomial(net.rows[place], x, net.share)


def test_far_tail_against_network():
    """The integral gives what walking all likelier tables gives, its bound is one, and their number is foretold."""
    for rows, ones in (([260, 265, 270, 275, 280], [105, 150, 125, 155, 128]), ([600, 3000, 4000, 5000], [20, 160, 240, 340])):
        net, whole = levels_of(rows, ones)
        left, lp, paths, total = np.array([float(sum(ones))]), np.zeros(1), 0, 0.0
        for place in range(len(rows) - 1):
            first, last = net.inner(place, left, lp)
            total += float((np.exp(lp - whole) * net.outer(place, left, first, last)).sum())
            paths = len(left)
            if place < len(rows) - 2:
                left, lp = children(net, place, left, lp, first, last)
        tail = FarTail(rows, sum(ones), net.share, net.most, whole)
        assert math.exp(tail.log_bound) * tail.share(0, tail.terms) == pytest.approx(total, rel=1e-3)
        assert math.exp(tail.log_bound) * (tail.share(0, 100) + tail.share(100, tail.terms)) == pytest.approx(total, rel=1e-3)
        assert math.exp(tail.log_bound) > total
        assert network_paths(rows, net.share, net.most) == pytest.approx(paths, rel=0.1)


def test_last_levels_by_running_sums():
    """Looking up the splits of the last two levels adds what summing the tails of every child adds."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        rows = np.sort(rng.integers(5, 90, 4))
        seen = np.array([rng.integers(0, r + 1) for r in rows])
        if seen.sum() in (0, rows.sum()):
            continue
        net, whole = levels_of(rows, seen)
        left, lp = np.array([float(seen.sum())]), np.zeros(1)
        left, lp = children(net, 0, left, lp, *net.inner(0, left, lp))
        first, last = net.inner(1, left, lp)
        further = children(net, 1, left, lp, first, last)
        plain = float((np.exp(further[1] - whole) * net.outer(2, further[0], *net.inner(2, *further))).sum())
        assert net.tail_of_last_three(left, lp, np.full(len(left), math.exp(-whole)), first, last) == pytest.approx(plain, rel=1e-9, abs=1e-300)
