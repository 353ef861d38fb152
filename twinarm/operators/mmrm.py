"""Repeated-measures regression with first-order autoregressive errors (REML).

Errors of one subject at period positions i and j correlate as rho^|i-j|, so a row
depends on earlier ones only through the subject's previous observed row. The
whole likelihood is therefore a function of cross-products of each row with its
predecessor, grouped by the factor levels of both rows and the gap between them.
Spark makes these with one aggregation per subject (a slot per period) and one by
group; the groups are bounded by the declared levels, whatever the number of
subjects. Each stratum is finished from its groups in one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.functions.tails import t_point, t_two_sided
from twinarm.operators.design import DesignColumn, Term, complete_rows, design_columns, variables
from twinarm.operators.newton import independent
from twinarm.operators.scan import join_groups, strata

RESULT = (
    "kind string, term string, estimate double, std_error double, df double, t double, p double, ci_low double, "
    "ci_high double, std_contrast double, std_contrast_corrected double, n long, subjects long, rho double, "
    "sigma double, rms_residual double, reml_loglik double, at_border boolean"
)
FIELDS = [c.split()[0] for c in RESULT.split(", ")]


def cross_products(
    df: DataFrame, *, y: str, subject: str, period: str, period_levels: Sequence, terms: Sequence[Term],
    levels: Mapping[str, Sequence], by: Sequence[str] = (),
) -> tuple[DataFrame, list[str], list[str]]:
    """Sufficient statistics: sums of products of a row's numbers with its own and its predecessor's.

    Returns the table, its factor columns and its number columns (``_one`` and
    the outcome ``_y`` included). ``gap`` is 0 for a subject's first row. Two rows
    of a subject in one period are an error.
    """
    names = variables(terms)
    factors = [n for n in names if n in levels]
    numbers = ["_one", *[n for n in names if n not in levels], "_y"]
    known = complete_rows(df.where(F.col(y).isNotNull() & F.col(period).isin(list(period_levels))), terms, levels)
    place = F.array_position(F.array(*[F.lit(v) for v in period_levels]), F.col(period)).cast("int")
    rows = known.select(
        *by, F.col(subject).alias("_subject"), place.alias("_place"),
        *[F.array_position(F.array(*[F.lit(v) for v in levels[f]]), F.col(f)).cast("int").alias(f"_f_{f}") for f in factors],
        F.lit(1.0).alias("_v__one"), *[F.col(n).cast("double").alias(f"_v_{n}") for n in numbers[1:-1]],
        F.col(y).cast("double").alias("_v__y"),
    )
    # One record per subject with a slot per period: an aggregation of fixed-width values, combined
    # before the only large shuffle. A second row in a slot is refused.
    fs = [f"_f_{f}" for f in factors]
    vs = [f"_v_{n}" for n in numbers]
    slots, record = [], []
    for k in range(1, len(period_levels) + 1):
        here = F.col("_place") == k
        slots.append(F.count(F.when(here, 1)).alias(f"_c{k}"))
        slots += [F.max(F.when(here, F.col(c))).alias(f"{c}@{k}") for c in (*fs, *vs)]
        twice = F.when(F.col(f"_c{k}") > 1, F.raise_error(F.lit("a subject has more than one row in a period")))
        cells = [F.col(f"`{c}@{k}`").alias(c) for c in (*fs, *vs)]
        record.append(F.when(F.col(f"_c{k}") > 0, F.struct(F.coalesce(twice.cast("int"), F.lit(k)).alias("_place"), *cells)))
    wide = rows.groupBy(*by, "_subject").agg(*slots).select(*by, F.array_compact(F.array(*record)).alias("_rows"))
    pairs = F.transform("_rows", lambda row, i: F.struct(row.alias("own"), F.get("_rows", i - 1).alias("prev")))
    paired = wide.select(*by, F.inline(pairs)).select(
        *by, *[F.col("own")[c].alias(c) for c in (*fs, *vs)],
        F.coalesce(F.col("own")["_place"] - F.col("prev")["_place"], F.lit(0)).alias("gap"),
        *[F.coalesce(F.col("prev")[f], F.lit(0)).alias(f"_p{f}") for f in fs],
        *[F.coalesce(F.col("prev")[v], F.lit(0.0)).alias(f"_p{v}") for v in vs],
    )
    sums = [F.count(F.lit(1)).alias("rows")]
    for i, a in enumerate(vs):
        for j, b in enumerate(vs):
            if j >= i:
                sums.append(F.sum(F.col(a) * F.col(b)).alias(f"own_{i}_{j}"))
                sums.append(F.sum(F.col(f"_p{a}") * F.col(f"_p{b}")).alias(f"prev_{i}_{j}"))
            sums.append(F.sum(F.col(a) * F.col(f"_p{b}")).alias(f"cross_{i}_{j}"))
    table = paired.groupBy(*by, "gap", *fs, *[f"_p{f}" for f in fs]).agg(*sums)
    return table, factors, numbers


def mmrm(
    df: DataFrame, *, y: str, subject: str, period: str, period_levels: Sequence, terms: Sequence[Term],
    levels: Mapping[str, Sequence], by: Sequence[str] = (), contrasts: Mapping[str, Mapping[str, float]] | None = None,
    level: float = 0.95,
) -> DataFrame:
    """Fit per stratum: one row per coefficient and per contrast.

    ``contrasts`` maps a name to weights on coefficient names. Degrees of freedom
    are Satterthwaite's. ``std_contrast`` is the estimate in units of the root mean
    square residual and ``std_contrast_corrected`` the same with the small-sample
    factor of the degrees of freedom. An aliased coefficient is NULL; ``at_border`` marks a
    correlation at the edge of its range. A stratum with no more rows than coefficients
    has its rows with ``n`` and ``subjects`` and NULL for all that a fit would give.

    Numbers are centred in each stratum before their products are summed, so that a
    covariate far from zero keeps its digits, and coefficients are turned back after the
    fit. A number in a product without its main effects is left as it is.
    """
    df, keys = strata(df, by)
    columns = design_columns(terms, levels, intercept=True)
    shapes = {(c.factors, c.numbers) for c in columns}
    centred = [
        v for v in variables(terms) if v not in levels
        and all((c.factors, ()) in shapes for c in columns if c.numbers == (v,)) and not any(v in c.numbers and len(c.numbers) > 1 for c in columns)
    ]
    means = [f"_mean_{v}" for v in centred]
    if centred:
        known = complete_rows(df.where(F.col(y).isNotNull() & F.col(period).isin(list(period_levels))), terms, levels)
        centre = known.groupBy(*keys).agg(*[F.avg(F.col(v).cast("double")).alias(m) for v, m in zip(centred, means)])
        df = join_groups(df, centre, keys, "inner").withColumns({v: F.col(v).cast("double") - F.col(m) for v, m in zip(centred, means)})
    table, factors, numbers = cross_products(
        df, y=y, subject=subject, period=period, period_levels=period_levels, terms=terms, levels=levels, by=[*keys, *means]
    )
    wanted = {name: dict(weights) for name, weights in (contrasts or {}).items()}
    for name, weights in wanted.items():
        unknown = set(weights) - {c.name for c in columns}
        if unknown:
            raise ValueError(f"contrast {name} names unknown coefficients: {sorted(unknown)}")
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*keys).schema)
    level_lists = {f: list(levels[f]) for f in factors}

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        fit = fit_from_products(part, factors, level_lists, numbers, columns)
        shift = dict(zip(centred, key[len(keys):]))
        rows = result_rows(fit, columns, wanted, level, shift)
        return pd.DataFrame([(*key[: len(keys)], *r) for r in rows], columns=[*keys, *FIELDS])

    return table.groupBy(*keys, *means).applyInPandas(finish, f"{key_types}, {RESULT}").select(*by, *FIELDS)


def arm_contrasts(arm: str, arm_level, period: str, period_levels: Sequence) -> dict[str, dict[str, float]]:
    """Arm effect in each period of a model with the arm by period product."""
    main = f"{arm}[{arm_level}]"
    first, *others = period_levels
    out = {f"{period}[{first}]": {main: 1.0}}
    for p in others:
        out[f"{period}[{p}]"] = {main: 1.0, f"{main}:{period}[{p}]": 1.0}
    return out


def _row_map(codes: Sequence[int], factors, levels, numbers, columns: Sequence[DesignColumn]) -> np.ndarray:
    """Matrix that turns a row's numbers into (model columns, outcome) for given factor levels."""
    out = np.zeros((len(columns) + 1, len(numbers)))
    at = {f: levels[f][c - 1] for f, c in zip(factors, codes) if c > 0}
    for i, c in enumerate(columns):
        if all(at.get(f) == v for f, v in c.factors):
            out[i, numbers.index(c.numbers[0]) if c.numbers else 0] = 1.0
    out[-1, -1] = 1.0
    return out


def gather(part: pd.DataFrame, factors, levels, numbers, columns) -> dict:
    """Per gap: count and the three product matrices over (model columns, outcome)."""
    m = len(numbers)
    gaps: dict[int, list] = {}
    for row in part.to_dict("records"):
        own, prev, cross = (np.zeros((m, m)) for _ in range(3))
        for i in range(m):
            for j in range(m):
                a, b = min(i, j), max(i, j)
                own[i, j], prev[i, j], cross[i, j] = row[f"own_{a}_{b}"], row[f"prev_{a}_{b}"], row[f"cross_{i}_{j}"]
        here = _row_map([row[f"_f_{f}"] for f in factors], factors, levels, numbers, columns)
        before = _row_map([row[f"_p_f_{f}"] for f in factors], factors, levels, numbers, columns)
        size = len(columns) + 1
        slot = gaps.setdefault(int(row["gap"]), [0, np.zeros((size, size)), np.zeros((size, size)), np.zeros((size, size))])
        slot[0] += int(row["rows"])
        slot[1] += here @ own @ here.T
        slot[2] += here @ cross @ before.T
        slot[3] += before @ prev @ before.T
    return gaps


class Restricted:
    """Restricted likelihood as a function of rho, from the products per gap."""

    def __init__(self, gaps: dict, p: int):
        self.gaps, self.p = gaps, p
        self.n = sum(g[0] for g in gaps.values())
        plain = sum(g[1] for g in gaps.values())
        self.keep = independent(plain[:p, :p])
        self.use = np.r_[np.flatnonzero(self.keep), p]
        self.plain = plain[np.ix_(self.use, self.use)]
        self.q = int(self.keep.sum())

    def whitened(self, rho: float) -> tuple[np.ndarray, float]:
        """Products of the decorrelated rows and the log determinant of the correlations."""
        total, logdet = 0.0, 0.0
        for gap, (n, own, cross, prev) in self.gaps.items():
            if gap == 0:
                total = total + own
                continue
            r = rho**gap
            total = total + (own - r * (cross + cross.T) + r * r * prev) / (1 - r * r)
            logdet += n * math.log1p(-r * r)
        return total[np.ix_(self.use, self.use)], logdet

    def parts(self, rho: float) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Coefficients, inverse information (unit variance), residual sum, the two log determinants."""
        m, logdet = self.whitened(rho)
        q = self.q
        xx, xy, yy = m[:q, :q], m[:q, q], m[q, q]
        scale = 1 / np.sqrt(np.diag(xx))
        inverse = np.linalg.inv(xx * np.outer(scale, scale)) * np.outer(scale, scale)
        beta = inverse @ xy
        rss = float(yy - xy @ beta)
        return beta, inverse, rss, logdet + float(np.linalg.slogdet(xx)[1])

    def criterion(self, rho: float) -> float:
        """Minus twice the log likelihood at the best variance, without constants."""
        _, _, rss, logs = self.parts(rho)
        return (self.n - self.q) * math.log(max(rss, 1e-300) / (self.n - self.q)) + logs


def _minimum(f, low: float, high: float) -> float:
    """Global minimum on an interval: a grid, then golden section around its best point."""
    grid = np.linspace(low, high, 81)
    values = [f(x) for x in grid]
    i = int(np.argmin(values))
    a, b = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while b - a > 1e-9:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return 0.5 * (a + b)


def _slopes(f, x: float, h: float):
    """First and second derivative by five-point differences."""
    m2, m1, z, p1, p2 = (np.asarray(f(x + k * h)) for k in (-2, -1, 0, 1, 2))
    return (m2 - 8 * m1 + 8 * p1 - p2) / (12 * h), (-m2 + 16 * m1 - 30 * z + 16 * p1 - p2) / (12 * h * h)


def fit_from_products(part: pd.DataFrame, factors, levels, numbers, columns) -> dict:
    """REML estimates of one stratum; only its size when it has no more rows than coefficients."""
    gaps = gather(part, factors, levels, numbers, columns)
    model = Restricted(gaps, len(columns))
    dof = model.n - model.q
    if dof <= 0 or model.q == 0:
        return {"n": model.n, "subjects": gaps.get(0, [0])[0], "beta": None}
    paired = any(g > 0 for g in gaps)
    rho = 0.0
    if paired:
        rho = _minimum(model.criterion, -0.999, 0.999)
        h = min(1e-3, (1 - abs(rho)) / 4)
        for _ in range(6):
            first, second = _slopes(model.criterion, rho, h)
            if second <= 0 or abs(rho - first / second) >= 0.999:
                break
            rho -= float(first / second)
    beta, inverse, rss, logs = model.parts(rho)
    s2 = rss / dof
    border = paired and abs(rho) > 0.995
    spread = np.array([[1.0 / 0.5 * s2 * s2 / dof]])
    if paired:
        h = min(1e-3, (1 - abs(rho)) / 4)
        rss1, rss2 = _slopes(lambda r: model.parts(r)[2], rho, h)
        _, logs2 = _slopes(lambda r: model.parts(r)[3], rho, h)
        hessian = np.array([
            [dof / (2 * s2 * s2), -float(rss1) / (2 * s2 * s2)],
            [-float(rss1) / (2 * s2 * s2), 0.5 * (float(logs2) + float(rss2) / s2)],
        ])
        spread = np.linalg.pinv(hessian)
        inverse1, _ = _slopes(lambda r: model.parts(r)[1], rho, h)
    else:
        inverse1 = np.zeros_like(inverse)
    residual = model.plain[-1, -1] - 2 * beta @ model.plain[:-1, -1] + beta @ model.plain[:-1, :-1] @ beta
    value = -0.5 * (dof * math.log(2 * math.pi) + dof * math.log(s2) + logs + dof) if s2 > 0 else None
    return {
        "beta": beta, "inverse": inverse, "inverse1": inverse1, "s2": s2, "rho": rho if paired else None,
        "spread": spread, "keep": model.keep, "n": model.n, "subjects": gaps.get(0, [0])[0],
        "rms": math.sqrt(max(float(residual), 0.0) / model.n), "value": value, "border": bool(border),
    }


def result_rows(fit: dict, columns, contrasts: dict, level: float, means: Mapping[str, float]) -> list[tuple]:
    """Rows of coefficients and contrasts; ``means`` are what was taken off numbers before the fit."""
    names = [c.name for c in columns]
    wanted = [("coefficient", n, {n: 1.0}) for n in names]
    wanted += [("contrast", n, w) for n, w in contrasts.items()]
    if fit["beta"] is None:
        return [(kind, name, *[None] * 9, fit["n"], fit["subjects"], *[None] * 5) for kind, name, _ in wanted]
    # In centred numbers, the coefficient of a column without the number holds the mean times that with it.
    lower = {c.name: (next(d.name for d in columns if d.factors == c.factors and not d.numbers), means[c.numbers[0]])
             for c in columns if c.numbers and c.numbers[0] in means}
    at = {names[i]: k for k, i in enumerate(np.flatnonzero(fit["keep"]))}
    tail = (fit["n"], fit["subjects"], fit["rho"], math.sqrt(max(fit["s2"], 0.0)), fit["rms"], fit["value"], fit["border"])
    rows = []
    for kind, name, weights in wanted:
        if any(n not in at for n in weights) or fit["s2"] <= 0:
            rows.append((kind, name, *[None] * 9, *tail))
            continue
        c = np.zeros(len(at))
        for n, w in weights.items():
            c[at[n]] += w
            for with_number, (without, mean) in lower.items():
                if without == n and with_number in at:
                    c[at[with_number]] -= mean * w
        estimate = float(c @ fit["beta"])
        unit = float(c @ fit["inverse"] @ c)
        v = fit["s2"] * unit
        slope = np.array([unit, fit["s2"] * float(c @ fit["inverse1"] @ c)])[: len(fit["spread"])]
        df = 2 * v * v / float(slope @ fit["spread"] @ slope)
        se = math.sqrt(v)
        half = float(t_point(level, np.array([df]))[0]) * se
        std = estimate / fit["rms"] if kind == "contrast" and fit["rms"] > 0 else None
        small = std * (1 - 3 / (4 * df - 1)) if std is not None else None
        rows.append((kind, name, estimate, se, df, estimate / se, float(t_two_sided(estimate / se, df)),
                     estimate - half, estimate + half, std, small, *tail))
    return rows
