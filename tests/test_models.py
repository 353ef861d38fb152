import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinarm.operators.cox import cox, efron_sums
from twinarm.operators.design import crossed, design_columns
from twinarm.operators.firth import firth, odds_ratios
from twinarm.operators.mmrm import arm_contrasts, mmrm

GENDER = {"g": ["F", "M"]}


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(1)
    n = 240
    f = pd.DataFrame({"id": range(n), "arm": np.arange(n) % 2, "g": np.where(np.arange(n) % 3 > 0, "M", "F"),
                      "d": rng.integers(20, 30, n).astype(float)})
    f["t"] = np.ceil(rng.exponential(10, n) * np.exp(0.5 * f.arm))
    f["e"] = (rng.random(n) < 0.7).astype(int)
    f["flag"] = (rng.random(n) < 0.05 + 0.1 * f.arm).astype(int)
    f["s"] = np.where(np.arange(n) % 5 == 0, "a", "b")
    return f


def test_term_names():
    columns = design_columns([*crossed("arm", "p"), ("d", "arm")], {"arm": [0, 1], "p": [4, 5, 6]}, intercept=True)
    assert [c.name for c in columns] == [
        "(Intercept)", "arm[1]", "p[5]", "p[6]", "arm[1]:p[5]", "arm[1]:p[6]", "d:arm[1]"]


@pytest.mark.parametrize("risk,tied,d", [(50.0, 3.0, 3), (150.0, 150.0, 150), (1000.0, 120.0, 100), (1e6, 3e3, 2500)])
def test_tie_sums(risk, tied, d):
    terms = risk - np.arange(d) / d * tied
    logs, first, second = (v[0] for v in efron_sums([risk], [tied], [d]))
    assert logs == pytest.approx(np.log(terms).sum(), rel=1e-12)
    assert first == pytest.approx((1 / terms).sum(), rel=1e-12)
    assert second == pytest.approx((1 / terms**2).sum(), rel=1e-12)


def dense_cox(f):
    x = np.column_stack([f.arm, f.g == "M", f.d]).astype(float)
    t, e = f.t.to_numpy(), f.e.to_numpy()

    def value(b):
        eta = x @ b
        w, total = np.exp(eta), 0.0
        for at in np.unique(t[e == 1]):
            dead = (t == at) & (e == 1)
            m = dead.sum()
            total += eta[dead].sum() - np.log(w[t >= at].sum() - np.arange(m) / m * w[dead].sum()).sum()
        return total

    b, h, eye = np.zeros(3), 1e-4, np.eye(3)
    for _ in range(8):
        g = np.array([(value(b + h * i) - value(b - h * i)) / (2 * h) for i in eye])
        hess = np.array([[(value(b + h * i + h * j) - value(b + h * i - h * j) - value(b - h * i + h * j) + value(b - h * i - h * j))
                          / (4 * h * h) for j in eye] for i in eye])
        b = b - np.linalg.solve(hess, g)
    return b, np.sqrt(np.diag(np.linalg.inv(-hess))), value(b)


@pytest.mark.parametrize("local_rows", [100_000, 50])
def test_cox_against_dense(spark, rows, people, local_rows):
    df = spark.createDataFrame(people)
    out = rows(cox(df, time="t", event="e", terms=["arm", "g", "d"], levels=GENDER, by=["s"], local_rows=local_rows))
    for s, part in people.groupby("s"):
        found = {r["term"]: r for r in out if r["s"] == s}
        b, se, value = dense_cox(part)
        assert [found[k]["estimate"] for k in ("arm", "g[M]", "d")] == pytest.approx(b, abs=1e-6)
        assert [found[k]["std_error"] for k in ("arm", "g[M]", "d")] == pytest.approx(se, rel=1e-5)
        assert found["arm"]["loglik"] == pytest.approx(value, abs=1e-8)
        assert found["arm"]["n"] == len(part) and not found["arm"]["diverging"]


def test_cox_swap_and_missing(spark, rows, people):
    df = spark.createDataFrame(people)
    (a,) = rows(cox(df, time="t", event="e", terms=["arm"]))
    (b,) = rows(cox(df.withColumn("arm", 1 - F.col("arm")), time="t", event="e", terms=["arm"]))
    assert a["estimate"] == pytest.approx(-b["estimate"]) and a["p"] == pytest.approx(b["p"])
    holed = df.withColumn("arm", F.when(F.col("id") != 7, F.col("arm")))
    assert rows(cox(holed, time="t", event="e", terms=["arm"]))[0]["n"] == len(people) - 1


def test_cox_without_events_in_an_arm(spark, rows):
    df = spark.createDataFrame([(float(i), int(i % 2 == 0), i % 2) for i in range(1, 21)], "t double, e int, arm int")
    (r,) = rows(cox(df, time="t", event="e", terms=["arm"]))
    assert r["diverging"] and r["estimate"] < -10


@pytest.mark.parametrize("local_rows", [100_000, 0])
def test_firth_saturated_is_half_added_to_each_cell(spark, rows, people, local_rows):
    found = {r["term"]: r for r in rows(odds_ratios(firth(spark.createDataFrame(people), response="flag", terms=["arm"], local_rows=local_rows)))}
    odds = [math.log((g.flag.sum() + 0.5) / (len(g) - g.flag.sum() + 0.5)) for _, g in people.groupby("arm")]
    assert found["(Intercept)"]["estimate"] == pytest.approx(odds[0], abs=1e-8)
    assert found["arm"]["estimate"] == pytest.approx(odds[1] - odds[0], abs=1e-8)
    assert found["arm"]["odds_ratio"] == pytest.approx(math.exp(odds[1] - odds[0]))
    assert found["arm"]["ci_low"] < found["arm"]["estimate"] < found["arm"]["ci_high"]


def test_firth_profiles_against_brute_force(spark, rows, people):
    part = people[people.s == "b"]
    x, y = np.column_stack([np.ones(len(part)), part.arm, part.d]), part.flag.to_numpy(float)

    def value(b):
        eta = x @ b
        p = 1 / (1 + np.exp(-eta))
        return (y * eta - np.logaddexp(0, eta)).sum() + 0.5 * np.linalg.slogdet((x.T * (p * (1 - p))) @ x)[1]

    def best(fixed=None):
        b = np.zeros(3)
        free = [0, 1, 2]
        if fixed is not None:
            free, b[1] = [0, 2], fixed
        for _ in range(300):
            h = 1e-5
            g = np.array([(value(b + h * np.eye(3)[i]) - value(b - h * np.eye(3)[i])) / (2 * h) for i in free])
            p = 1 / (1 + np.exp(-(x @ b)))
            step = np.linalg.solve(((x.T * (p * (1 - p))) @ x)[np.ix_(free, free)], g)
            b[free] += step * min(1, 2 / np.abs(step).max())
            if np.abs(step).max() < 1e-8:
                break
        return value(b)

    found = {r["term"]: r for r in rows(firth(spark.createDataFrame(part), response="flag", terms=["arm", "d"]))}
    top = best()
    assert found["arm"]["penalised_loglik"] == pytest.approx(top, abs=1e-8)
    assert found["arm"]["chi_square"] == pytest.approx(2 * (top - best(0.0)), abs=1e-6)
    for side in ("ci_low", "ci_high"):
        assert 2 * (top - best(found["arm"][side])) == pytest.approx(3.841458820694124, abs=1e-5)


def test_firth_with_separation_is_finite(spark, rows):
    df = spark.createDataFrame([(0, 0)] * 8 + [(1, 1)] * 5 + [(1, 0)] * 3, "arm int, y int")
    found = {r["term"]: r for r in rows(firth(df, response="y", terms=["arm"]))}
    assert found["arm"]["estimate"] == pytest.approx(math.log(5.5 / 3.5) - math.log(0.5 / 8.5), abs=1e-8)
    assert math.isfinite(found["arm"]["ci_low"])


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(1)
    out = []
    for s in range(60):
        e, arm, g, d = 0.0, s % 2, "FM"[s % 3 > 0], float(rng.integers(20, 60))
        for p in (1, 2, 3, 4):
            e = rng.normal() if p == 1 else 0.6 * e + 0.8 * rng.normal()
            if rng.random() >= 0.2:
                out.append((s, p, 10 + 2 * arm + p + 0.5 * arm * p + 0.05 * d + 3 * e, arm, g, d))
    return pd.DataFrame(out, columns=["s", "p", "y", "arm", "g", "d"])


FIT = {"y": "y", "subject": "s", "period": "p", "period_levels": [1, 2, 3, 4]}
LEVELS = {"arm": [0, 1], "p": [1, 2, 3, 4], "g": ["F", "M"]}


def dense_reml(f, x):
    y = f.y.to_numpy()

    def parts(rho):
        xx = xy = yy = logdet = 0
        for ix in f.groupby("s").indices.values():
            at = f.p.to_numpy()[ix]
            r = float(rho) ** np.abs(at[:, None] - at[None])
            inv = np.linalg.inv(r)
            logdet += np.linalg.slogdet(r)[1]
            xx, xy, yy = xx + x[ix].T @ inv @ x[ix], xy + x[ix].T @ inv @ y[ix], yy + y[ix] @ inv @ y[ix]
        b = np.linalg.solve(xx, xy)
        return b, xx, float(yy - b @ xy), logdet + np.linalg.slogdet(xx)[1]

    n, q = x.shape

    def loss(rho, s2=None):
        _, _, rss, logs = parts(rho)
        s2 = rss / (n - q) if s2 is None else s2
        return 0.5 * ((n - q) * math.log(2 * math.pi * s2) + logs + rss / s2)

    low, high = -0.9, 0.95
    for _ in range(120):
        a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    rho = (low + high) / 2
    b, xx, rss, _ = parts(rho)
    s2 = rss / (n - q)
    h = np.array([1e-3 * s2, 1e-3])
    at = np.array([s2, rho])
    f2 = lambda v: loss(v[1], v[0])
    eye = np.eye(2) * h
    hess = np.array([[(f2(at + i + j) - f2(at + i - j) - f2(at - i + j) + f2(at - i - j)) / (4 * i.max() * j.max()) for j in eye] for i in eye])
    spread = np.linalg.inv(hess)
    dfs = []
    for k in range(q):
        v = lambda t, k=k: t[0] * np.linalg.inv(parts(t[1])[1])[k, k]
        g = np.array([(v(at + i) - v(at - i)) / (2 * i.max()) for i in eye])
        dfs.append(2 * v(at) ** 2 / (g @ spread @ g))
    return {"b": b, "se": np.sqrt(s2 * np.diag(np.linalg.inv(xx))), "df": dfs, "rho": rho, "value": -loss(rho),
            "rms": math.sqrt(((y - x @ b) ** 2).mean())}


def test_mmrm_against_dense(spark, rows, panel):
    terms = [*crossed("arm", "p"), "d", "g"]
    contrasts = arm_contrasts("arm", 1, "p", [1, 2, 3, 4])
    out = rows(mmrm(spark.createDataFrame(panel).repartition(5), terms=terms, levels=LEVELS, contrasts=contrasts, **FIT))
    f = panel
    x = np.column_stack([np.ones(len(f)), f.arm, *[f.p == k for k in (2, 3, 4)], *[f.arm * (f.p == k) for k in (2, 3, 4)], f.d, f.g == "M"]).astype(float)
    names = ["(Intercept)", "arm[1]", "p[2]", "p[3]", "p[4]", "arm[1]:p[2]", "arm[1]:p[3]", "arm[1]:p[4]", "d", "g[M]"]
    dense, found = dense_reml(f, x), {r["term"]: r for r in out if r["kind"] == "coefficient"}
    assert [found[k]["estimate"] for k in names] == pytest.approx(dense["b"], abs=1e-5)
    assert [found[k]["std_error"] for k in names] == pytest.approx(dense["se"], rel=1e-5)
    assert [found[k]["df"] for k in names] == pytest.approx(dense["df"], rel=1e-3)
    assert found["d"]["rho"] == pytest.approx(dense["rho"], abs=1e-5)
    assert found["d"]["reml_loglik"] == pytest.approx(dense["value"], abs=1e-8)
    assert found["d"]["rms_residual"] == pytest.approx(dense["rms"], rel=1e-6)
    by_period = {r["term"]: r for r in out if r["kind"] == "contrast"}
    assert by_period["p[1]"]["estimate"] == pytest.approx(found["arm[1]"]["estimate"])
    assert by_period["p[3]"]["estimate"] == pytest.approx(found["arm[1]"]["estimate"] + found["arm[1]:p[3]"]["estimate"])
    assert by_period["p[3]"]["std_contrast"] == pytest.approx(by_period["p[3]"]["estimate"] / dense["rms"])


def test_mmrm_one_row_per_subject_is_least_squares(spark, rows, panel):
    f = panel[panel.p == 1]
    out = {r["term"]: r for r in rows(mmrm(spark.createDataFrame(f), terms=["arm"], levels=LEVELS, **FIT))}
    gap = f[f.arm == 1].y.mean() - f[f.arm == 0].y.mean()
    pooled = (((f.y - f.groupby("arm").y.transform("mean")) ** 2).sum()) / (len(f) - 2)
    se = math.sqrt(pooled * (1 / (f.arm == 1).sum() + 1 / (f.arm == 0).sum()))
    assert out["arm[1]"]["estimate"] == pytest.approx(gap) and out["arm[1]"]["std_error"] == pytest.approx(se)
    assert out["arm[1]"]["df"] == pytest.approx(len(f) - 2) and out["arm[1]"]["rho"] is None


def test_mmrm_strata_are_independent(spark, rows, panel):
    df = spark.createDataFrame(panel)
    many = rows(mmrm(df, terms=["arm", "p"], levels=LEVELS, by=["g"], **FIT), "g", "term")
    one = rows(mmrm(df.where("g = 'F'"), terms=["arm", "p"], levels=LEVELS, **FIT), "term")
    for a, b in zip([r for r in many if r["g"] == "F"], one):
        assert a["estimate"] == pytest.approx(b["estimate"], rel=1e-9)


def test_mmrm_refuses_two_rows_in_a_period(spark, panel):
    twice = pd.concat([panel, panel.head(1)])
    with pytest.raises(Exception, match="more than one row in a period"):
        mmrm(spark.createDataFrame(twice), terms=["arm"], levels=LEVELS, **FIT).collect()


def test_mmrm_aliased_and_unknown_terms(spark, rows, panel):
    df = spark.createDataFrame(panel).withColumn("twin", F.col("d") * 2)
    found = {r["term"]: r["estimate"] for r in rows(mmrm(df, terms=["arm", "d", "twin"], levels=LEVELS, **FIT))}
    assert found["twin"] is None and found["d"] is not None
    with pytest.raises(ValueError, match="unknown coefficients"):
        mmrm(df, terms=["arm"], levels=LEVELS, contrasts={"c": {"absent": 1.0}}, **FIT)


def test_mmrm_keeps_covariates_far_from_zero(spark, rows, panel):
    """A covariate like a day number or Unix seconds gives the same effect as the centred one."""
    near = panel.assign(d=np.sin(np.arange(len(panel))) / 2)
    terms = ["arm", "p", "d", ("d", "arm")]
    want = {r["term"]: r for r in rows(mmrm(spark.createDataFrame(near), terms=terms, levels=LEVELS, **FIT))}
    for far in (19_000.0, 1.7e9):
        got = {r["term"]: r for r in rows(mmrm(spark.createDataFrame(near.assign(d=near.d + far)), terms=terms, levels=LEVELS, **FIT))}
        for name in [n for n in want if n.startswith(("d", "p["))]:
            assert got[name]["estimate"] == pytest.approx(want[name]["estimate"], rel=1e-5)
            assert got[name]["std_error"] == pytest.approx(want[name]["std_error"], rel=1e-5)
        assert got["arm[1]"]["estimate"] == pytest.approx(want["arm[1]"]["estimate"] - far * want["d:arm[1]"]["estimate"], rel=1e-4)


def test_mmrm_shows_strata_that_cannot_be_fitted(spark, rows, panel):
    df = spark.createDataFrame(panel)
    small = df.where("s = 1").limit(1).withColumn("g", F.lit("tiny")) if "s" in panel else df.limit(1).withColumn("g", F.lit("tiny"))
    out = rows(mmrm(df.unionByName(small), terms=["arm", "p"], levels=LEVELS, by=["g"], **FIT), "g", "term")
    tiny = [r for r in out if r["g"] == "tiny"]
    assert tiny and all(r["estimate"] is None and r["n"] == 1 for r in tiny)
