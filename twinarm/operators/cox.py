"""Proportional hazards regression with Efron's treatment of ties.

Subjects are first reduced to counts per (time, covariate values), which is exact
and small when times are whole days and covariates are factors. Strata whose
reduced table fits a task are finished there, all in one job; larger ones stay
distributed and cost one job per Newton step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.functions.tails import normal_two_sided
from twinarm.operators.design import Term, complete_rows, design_columns, expression
from twinarm.operators.newton import climb, lockstep
from twinarm.operators.scan import CHUNK, join_groups, largest_group, range_chunks, running_sums, strata
from twinarm.operators.survival import Z975, survival_pair
from twinarm.session import materialise

LOCAL_ROWS = 200_000
RESULT = (
    "term string, estimate double, std_error double, z double, p double, hr double, hr_low double, hr_high double, "
    "n long, events long, loglik double, loglik_null double, steps int, diverging boolean, converged boolean"
)


def cox(
    df: DataFrame, *, time: str, event: str, terms: Sequence[Term], levels: Mapping[str, Sequence] | None = None,
    by: Sequence[str] = (), local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """Coefficients, errors, z, p, hazard ratios and intervals per stratum and term.

    Rows with a missing time, event or term are left out. ``diverging`` marks a
    coefficient that has no finite maximum (an arm without events), ``converged`` a fit
    whose criterion stood still at its last step.
    """
    levels = levels or {}
    columns = design_columns(terms, levels, intercept=False)
    known, keys = strata(complete_rows(survival_pair(df, time=time, event=event), terms, levels), by)
    xs = [f"_x{i}" for i in range(len(columns))]
    reduced = known.groupBy(*keys, F.col(time).alias("_time"), *[expression(c).alias(x) for c, x in zip(columns, xs)]).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(event).alias("_e")
    )
    reduced = materialise(reduced)
    names = [c.name for c in columns]
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reduced.select(*keys).schema)
    schema = f"{key_schema}, {RESULT}"

    def finish(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        evaluate = local_sums(table["_time"].to_numpy(float), table[xs].to_numpy(float),
                              table["_n"].to_numpy(float), table["_e"].to_numpy(float))
        fit = lockstep({0: climb(len(xs))}, lambda waiting: {k: evaluate(v) for k, v in waiting.items()})[0]
        rows = result_rows(fit, names, int(table["_n"].sum()), int(table["_e"].sum()))
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*keys, *[c.split()[0] for c in RESULT.split(", ")]])

    if largest_group(reduced, keys) <= local_rows:
        out = reduced.groupBy(*keys).applyInPandas(finish, schema)
    else:
        sizes = reduced.groupBy(*keys).agg((F.count(F.lit(1)) > local_rows).alias("_big"))
        marked = join_groups(reduced, sizes, keys)
        small = marked.where("not _big").drop("_big").groupBy(*keys).applyInPandas(finish, schema)
        out = small.unionByName(_fit_distributed(marked.where("_big").drop("_big"), keys, names, xs, schema))
    return out.select(*by, *[c.split()[0] for c in RESULT.split(", ")])


def result_rows(fit: dict, names: list[str], n: int, events: int) -> list[tuple]:
    used = fit["used"]
    cov = np.full((len(used), len(used)), np.nan)
    if used.any():
        cov[np.ix_(used, used)] = np.linalg.inv(fit["sums"]["info"][np.ix_(used, used)])
    rows = []
    for i, name in enumerate(names):
        tail = (n, events, float(fit["sums"]["value"]), float(fit["first"]), fit["steps"], fit["diverging"], fit["converged"])
        if not used[i]:
            rows.append((name, None, None, None, None, None, None, None, *tail))
            continue
        b, se = float(fit["theta"][i]), float(np.sqrt(cov[i, i]))
        with np.errstate(over="ignore"):
            ratio, low, high = (float(np.exp(v)) for v in (b, b - Z975 * se, b + Z975 * se))
        rows.append((name, b, se, b / se, float(normal_two_sided(b / se)), ratio, low, high, *tail))
    return rows


def efron_sums(risk: np.ndarray, tied: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over l = 0..d-1 of ln, 1/. and 1/.^2 of (risk - l/d tied).

    Up to 64 ties term by term. Beyond, the smallest 20 terms and the
    Euler-Maclaurin formula for the rest, so a tie of any size costs the same.
    """
    risk, tied, d = (np.asarray(v, float) for v in (risk, tied, d))
    unit = tied / d
    a = np.maximum(risk / unit, d)
    logs, first, second = (np.zeros_like(a) for _ in range(3))
    few = d <= 64
    for l in range(int(d[few].max()) if few.any() else 0):
        on = few & (l < d)
        x = a[on] - l
        logs[on] += np.log(x)
        first[on] += 1 / x
        second[on] += 1 / x**2
    many = ~few
    if many.any():
        top = a[many]
        low = top - d[many] + 1
        lo, fi, se = (np.zeros_like(top) for _ in range(3))
        for k in range(20):
            x = low + k
            lo, fi, se = lo + np.log(x), fi + 1 / x, se + 1 / x**2
        c = low + 20
        lo += top * np.log(top) - top - c * np.log(c) + c + (np.log(c) + np.log(top)) / 2
        lo += (1 / top - 1 / c) / 12 - (2 / top**3 - 2 / c**3) / 720
        fi += np.log1p((top - c) / c) + (1 / c + 1 / top) / 2
        fi += (1 / c**2 - 1 / top**2) / 12 - (6 / c**4 - 6 / top**4) / 720 + (120 / c**6 - 120 / top**6) / 30240
        se += (top - c) / (top * c) + (1 / c**2 + 1 / top**2) / 2
        se += (2 / c**3 - 2 / top**3) / 12 - (24 / c**5 - 24 / top**5) / 720 + (720 / c**7 - 720 / top**7) / 30240
        logs[many], first[many], second[many] = lo, fi, se
    return d * np.log(unit) + logs, first / unit, second / unit**2


def local_sums(time: np.ndarray, x: np.ndarray, n: np.ndarray, e: np.ndarray):
    """Evaluator over one reduced table held in a task."""
    order = np.argsort(-time, kind="stable")
    time, x, n, e = time[order], x[order], n[order], e[order]
    starts = np.flatnonzero(np.r_[True, np.diff(time) != 0])
    squares = np.einsum("ki,kj->kij", x, x)

    def per_time(v):
        return np.add.reduceat(v, starts, axis=0)

    deaths = per_time(e)
    on = deaths > 0

    def evaluate(theta: np.ndarray) -> dict:
        eta = x @ theta
        shift = eta.max()
        w = np.exp(eta - shift)
        nw, ew = n * w, e * w
        s0 = np.cumsum(per_time(nw))[on]
        s1 = np.cumsum(per_time(nw[:, None] * x), axis=0)[on]
        s2 = np.cumsum(per_time(nw[:, None, None] * squares), axis=0)[on]
        d0, d1, d2 = per_time(ew)[on], per_time(ew[:, None] * x)[on], per_time(ew[:, None, None] * squares)[on]
        d = deaths[on]
        logs, h1, h2 = efron_sums(s0, d0, d)
        ratio = (s0 / d0)[:, None]
        gap = s1 - ratio * d1
        mean = d1 / d0[:, None]
        value = float((e * eta).sum() - (logs + d * shift).sum())
        score = (e[:, None] * x).sum(0) - (d[:, None] * mean + gap * h1[:, None]).sum(0)
        within = (d / d0)[:, None, None] * d2 + (s2 - ratio[:, :, None] * d2) * h1[:, None, None]
        cross = np.einsum("ki,kj->kij", mean, gap)
        between = d[:, None, None] * np.einsum("ki,kj->kij", mean, mean)
        between += (cross + cross.transpose(0, 2, 1)) * h1[:, None, None]
        between += np.einsum("ki,kj->kij", gap, gap) * h2[:, None, None]
        return {"value": value, "score": score, "info": (within - between).sum(0)}

    return evaluate


def _fit_distributed(reduced: DataFrame, keys: list[str], names: list[str], xs: list[str], schema: str) -> DataFrame:
    """Newton steps for the large strata together; one job per step, fixed-size answers."""
    spark = reduced.sparkSession
    chunked = range_chunks(reduced, [*keys, F.desc("_time")])
    ends = [f(x).alias(f"{tag}{x}") for x in xs for tag, f in (("min", F.min), ("max", F.max))]
    heads = chunked.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_e").alias("e"), *ends).collect()
    sizes = {tuple(r[k] for k in keys): (r["n"], r["e"]) for r in heads}
    reach = {tuple(r[k] for k in keys): [(r[f"min{x}"], r[f"max{x}"]) for x in xs] for r in heads}
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunked.select(*keys).schema)

    @F.pandas_udf("logs double, h1 double, h2 double")
    def ties(risk: pd.Series, tied: pd.Series, d: pd.Series) -> pd.DataFrame:
        a, b, c = efron_sums(risk.to_numpy(), tied.to_numpy(), d.to_numpy())
        return pd.DataFrame({"logs": a, "h1": b, "h2": c})

    def evaluate(waiting: dict) -> dict:
        # The linear predictor is taken from its largest possible value, so that its exponential stays finite.
        shift = {k: float(sum(max(b * low, b * high) for b, (low, high) in zip(theta, reach[k]))) for k, theta in waiting.items()}
        rows = [(*k, *[float(v) for v in theta], shift[k]) for k, theta in waiting.items()]
        params = spark.createDataFrame(rows, key_types + "".join(f", _b{i} double" for i in range(p)) + ", _shift double")
        at = join_groups(chunked, params, keys, "inner")
        eta = sum((F.col(x) * F.col(f"_b{i}") for i, x in enumerate(xs)), F.lit(0.0))
        at = at.withColumn("_eta", eta).withColumn("_w", F.exp(F.col("_eta") - F.col("_shift")))
        sums = [F.sum("_e").alias("d"), F.sum(F.col("_e") * F.col("_eta")).alias("_ee")]
        sums += [F.sum(F.col("_e") * F.col(x)).alias(f"_ex{i}") for i, x in enumerate(xs)]
        weights = {"": F.lit(1.0), **{f"{i}": F.col(x) for i, x in enumerate(xs)},
                   **{f"{i}_{j}": F.col(xs[i]) * F.col(xs[j]) for i, j in pairs}}
        for tag, value in weights.items():
            sums.append(F.sum(F.col("_n") * F.col("_w") * value).alias(f"_r{tag}"))
            sums.append(F.sum(F.col("_e") * F.col("_w") * value).alias(f"_d{tag}"))
        per_time = at.groupBy(CHUNK, *keys, "_time").agg(*sums)
        scanned = running_sums(per_time, by=keys, order_by=[F.desc("_time")], sums={f"_s{t}": f"_r{t}" for t in weights})
        scanned = scanned.where("d > 0").withColumn("_t", ties("_s", "_d", F.col("d").cast("double")))
        d, h1, h2, ratio = F.col("d"), F.col("_t.h1"), F.col("_t.h2"), F.col("_s") / F.col("_d")
        gap = [F.col(f"_s{i}") - ratio * F.col(f"_d{i}") for i in range(p)]
        mean = [F.col(f"_d{i}") / F.col("_d") for i in range(p)]
        out = [F.sum(F.col("_ee") - F.col("_t.logs")).alias("value")]
        out += [F.sum(F.col(f"_ex{i}") - d * mean[i] - gap[i] * h1).alias(f"u{i}") for i in range(p)]
        for i, j in pairs:
            d2, s2 = F.col(f"_d{i}_{j}"), F.col(f"_s{i}_{j}")
            within = d * d2 / F.col("_d") + (s2 - ratio * d2) * h1
            between = d * mean[i] * mean[j] + (mean[i] * gap[j] + mean[j] * gap[i]) * h1 + gap[i] * gap[j] * h2
            out.append(F.sum(within - between).alias(f"i{i}_{j}"))
        answers = {}
        for r in scanned.groupBy(*keys).agg(*out).collect():
            info = np.zeros((p, p))
            for i, j in pairs:
                info[i, j] = info[j, i] = r[f"i{i}_{j}"]
            key = tuple(r[k] for k in keys)
            answers[key] = {
                "value": r["value"] - sizes[key][1] * shift[key], "score": np.array([r[f"u{i}"] for i in range(p)]), "info": info
            }
        return answers

    # A stratum without events has nothing to fit; its sums are zero.
    nothing = {"value": 0.0, "score": np.zeros(p), "info": np.zeros((p, p))}

    def complete(waiting: dict) -> dict:
        answers = evaluate(waiting)
        return {k: answers.get(k, nothing) for k in waiting}

    fits = lockstep({k: climb(p) for k in sizes}, complete)
    rows = [(*k, *r) for k, fit in fits.items() for r in result_rows(fit, names, *sizes[k])]
    return spark.createDataFrame(rows, schema)
