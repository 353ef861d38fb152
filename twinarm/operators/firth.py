"""Logistic regression with Firth's penalty, profile intervals and penalised tests.

Subjects are reduced to counts per covariate pattern. All sums a step needs (log
likelihood, score, information and the third-order sums of the penalty) are one
aggregation, so a step is one pass, and every profile interval of every
coefficient advances in the same pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.functions.tails import chi2_upper
from twinarm.operators.design import Term, complete_rows, design_columns, expression
from twinarm.operators.newton import climb, independent, lockstep, profile_limit
from twinarm.operators.scan import join_groups, largest_group, strata
from twinarm.session import materialise

LOCAL_ROWS = 200_000
DROP = 3.841458820694124 / 2  # half of the 95% point of chi-square with one degree of freedom
LONGEST = 5.0
RESULT = (
    "term string, estimate double, std_error double, ci_low double, ci_high double, chi_square double, p double, "
    "n long, events long, penalised_loglik double, steps int, converged boolean, limits_converged boolean"
)


def firth(
    df: DataFrame, *, response: str, terms: Sequence[Term], levels: Mapping[str, Sequence] | None = None,
    by: Sequence[str] = (), local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """Penalised coefficients with profile intervals and likelihood-ratio p per stratum and term.

    ``response`` is 0/1; rows with a missing response or term are left out. ``converged``
    is that of the fit, ``limits_converged`` that of both limits and of the fit behind p.
    """
    levels = levels or {}
    columns = design_columns(terms, levels, intercept=True)
    known, keys = strata(complete_rows(df.where(F.col(response).isin(0, 1)), terms, levels), by)
    xs = [f"_x{i}" for i in range(len(columns))]
    reduced = materialise(
        known.groupBy(*keys, *[expression(c).alias(x) for c, x in zip(columns, xs)]).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(F.col(response).cast("long")).alias("_e")
        )
    )
    names = [c.name for c in columns]
    fields = [c.split()[0] for c in RESULT.split(", ")]
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reduced.select(*keys).schema)

    def finish(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        evaluate = local_sums(table[xs].to_numpy(float), table["_n"].to_numpy(float), table["_e"].to_numpy(float))
        done = fit_all({0: None}, len(xs), lambda waiting: {k: evaluate(v) for k, v in waiting.items()})[0]
        rows = result_rows(done, names, int(table["_n"].sum()), int(table["_e"].sum()))
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*keys, *fields])

    schema = f"{key_types}, {RESULT}"
    if largest_group(reduced, keys) <= local_rows:
        out = reduced.groupBy(*keys).applyInPandas(finish, schema)
    else:
        sizes = reduced.groupBy(*keys).agg((F.count(F.lit(1)) > local_rows).alias("_big"))
        marked = join_groups(reduced, sizes, keys)
        small = marked.where("not _big").drop("_big").groupBy(*keys).applyInPandas(finish, schema)
        out = small.unionByName(_fit_distributed(marked.where("_big").drop("_big"), keys, names, xs, schema))
    return out.select(*by, *fields)


def penalise(value: float, score: np.ndarray, info: np.ndarray, third: np.ndarray) -> dict:
    """Add the penalty: half the log determinant of the information and its gradient."""
    keep = independent(info, 1e-13)
    if not keep.any():
        return {"value": -np.inf, "score": score, "info": info}
    part = np.ix_(keep, keep)
    inverse = np.zeros_like(info)
    inverse[part] = np.linalg.inv(info[part])
    logdet = np.linalg.slogdet(info[part])[1]
    return {"value": value + 0.5 * logdet, "score": score + 0.5 * np.einsum("st,rst->r", inverse, third), "info": info}


def fit_all(strata_keys, p: int, evaluate) -> dict:
    """Full fit of every stratum, then all of its profile fits, in two lockstep rounds."""
    best = lockstep({(k, "full"): climb(p, longest=LONGEST) for k in strata_keys}, evaluate)
    tasks = {}
    for (k, _), fit in best.items():
        for j in np.flatnonzero(fit["used"]):
            free = fit["used"].copy()
            free[j] = False
            null = fit["theta"].copy()
            null[j] = 0.0
            tasks[(k, f"null{j}")] = climb(p, start=null, free=free, longest=LONGEST)
            tasks[(k, f"low{j}")] = profile_limit(int(j), -1, fit, DROP)
            tasks[(k, f"high{j}")] = profile_limit(int(j), 1, fit, DROP)
    profiles = lockstep(tasks, evaluate)
    return {k: (best[(k, "full")], {t: v for (s, t), v in profiles.items() if s == k}) for k in strata_keys}


def result_rows(done: tuple, names: list[str], n: int, events: int) -> list[tuple]:
    fit, profiles = done
    used = fit["used"]
    cov = np.full((len(used), len(used)), np.nan)
    if used.any():
        cov[np.ix_(used, used)] = np.linalg.inv(fit["sums"]["info"][np.ix_(used, used)])
    rows = []
    for j, name in enumerate(names):
        tail = (n, events, float(fit["sums"]["value"]), fit["steps"], fit["converged"])
        if not used[j]:
            rows.append((name, None, None, None, None, None, None, *tail, None))
            continue
        chi = max(2 * (fit["sums"]["value"] - profiles[f"null{j}"]["sums"]["value"]), 0.0)
        rows.append((
            name, float(fit["theta"][j]), float(np.sqrt(cov[j, j])), float(profiles[f"low{j}"]["limit"]),
            float(profiles[f"high{j}"]["limit"]), float(chi), float(chi2_upper(chi, 1)), *tail,
            all(profiles[f"{kind}{j}"]["converged"] for kind in ("null", "low", "high")),
        ))
    return rows


def local_sums(x: np.ndarray, n: np.ndarray, e: np.ndarray):
    """Evaluator over one table of covariate patterns held in a task."""

    def evaluate(theta: np.ndarray) -> dict:
        eta = x @ theta
        q = 1 / (1 + np.exp(-np.abs(eta)))
        p = np.where(eta >= 0, q, 1 - q)
        w = p * (1 - p)
        value = float((e * eta - n * (np.maximum(eta, 0) + np.log1p(np.exp(-np.abs(eta))))).sum())
        score = ((e - n * p)[:, None] * x).sum(0)
        info = np.einsum("k,ki,kj->ij", n * w, x, x)
        third = np.einsum("k,ki,kj,kl->ijl", n * w * (1 - 2 * p), x, x, x)
        return penalise(value, score, info, third)

    return evaluate


def _fit_distributed(reduced: DataFrame, keys: list[str], names: list[str], xs: list[str], schema: str) -> DataFrame:
    """The same fits over large pattern tables: one job evaluates every waiting vector."""
    spark = reduced.sparkSession
    p = len(xs)
    heads = reduced.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_e").alias("e")).collect()
    sizes = {tuple(r[k] for k in keys): (r["n"], r["e"]) for r in heads}
    pairs = list(combinations_with_replacement(range(p), 2))
    triples = list(combinations_with_replacement(range(p), 3))
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reduced.select(*keys).schema)

    def evaluate(waiting: dict) -> dict:
        rows = [(*k, task, *[float(v) for v in theta]) for (k, task), theta in waiting.items()]
        params = spark.createDataFrame(rows, f"{key_types}, _task string" + "".join(f", _b{i} double" for i in range(p)))
        at = join_groups(reduced, params, keys, "inner")
        eta = sum((F.col(x) * F.col(f"_b{i}") for i, x in enumerate(xs)), F.lit(0.0))
        at = at.withColumn("_eta", eta).withColumn("_p", 1 / (1 + F.exp(-F.col("_eta"))))
        at = at.withColumn("_w", F.col("_n") * F.col("_p") * (1 - F.col("_p")))
        soft = F.greatest(F.col("_eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_eta")))
        out = [F.sum(F.col("_e") * F.col("_eta") - F.col("_n") * soft).alias("value")]
        out += [F.sum((F.col("_e") - F.col("_n") * F.col("_p")) * F.col(x)).alias(f"u{i}") for i, x in enumerate(xs)]
        out += [F.sum(F.col("_w") * F.col(xs[i]) * F.col(xs[j])).alias(f"i{i}_{j}") for i, j in pairs]
        tilt = F.col("_w") * (1 - 2 * F.col("_p"))
        out += [F.sum(tilt * F.col(xs[i]) * F.col(xs[j]) * F.col(xs[l])).alias(f"t{i}_{j}_{l}") for i, j, l in triples]
        answers = {}
        for r in at.groupBy(*keys, "_task").agg(*out).collect():
            info, third = np.zeros((p, p)), np.zeros((p, p, p))
            for i, j in pairs:
                info[i, j] = info[j, i] = r[f"i{i}_{j}"]
            for i, j, l in triples:
                for a, b, c in {(i, j, l), (i, l, j), (j, i, l), (j, l, i), (l, i, j), (l, j, i)}:
                    third[a, b, c] = r[f"t{i}_{j}_{l}"]
            score = np.array([r[f"u{i}"] for i in range(p)])
            answers[(tuple(r[k] for k in keys), r["_task"])] = penalise(r["value"], score, info, third)
        return answers

    fits = fit_all(sizes, p, evaluate)
    rows = [(*k, *r) for k, done in fits.items() for r in result_rows(done, names, *sizes[k])]
    return spark.createDataFrame(rows, schema)


def odds_ratios(table: DataFrame) -> DataFrame:
    """Odds ratio and interval of each coefficient."""
    return table.withColumns({"odds_ratio": F.exp("estimate"), "or_low": F.exp("ci_low"), "or_high": F.exp("ci_high")})
