"""Newton iterations that do not care where their sums come from.

A fit is a generator: it yields a coefficient vector and receives the sums at
that vector. ``lockstep`` advances any number of fits together, so one Spark job
can serve every fit of a step. Small tables answer from memory inside a task,
large ones by a distributed aggregation; the fits are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Mapping

import numpy as np

Fit = Generator[np.ndarray, dict, dict]


def lockstep(fits: Mapping[object, Fit], evaluate: Callable[[dict], dict]) -> dict:
    """Run all fits to their end; ``evaluate`` maps {key: vector} to {key: sums}."""
    results, waiting = {}, {}
    for key, fit in fits.items():
        waiting[key] = next(fit)
    while waiting:
        answers, moved = evaluate(waiting), {}
        for key in waiting:
            try:
                moved[key] = fits[key].send(answers[key])
            except StopIteration as end:
                results[key] = end.value
        waiting = moved
    return results


def independent(matrix: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Mask of the columns that are no combination of earlier ones."""
    a = np.array(matrix, float)
    keep = np.zeros(len(a), bool)
    scale = np.diag(matrix).copy()
    for i in range(len(a)):
        if scale[i] > 0 and a[i, i] > tolerance * scale[i]:
            keep[i] = True
            row = a[i] / a[i, i]
            a = a - np.outer(a[:, i], row)
    return keep


def climb(p: int, *, start: np.ndarray | None = None, free: np.ndarray | None = None, max_steps: int = 40,
          longest: float = math.inf, tolerance: float = 1e-11) -> Fit:
    """Maximise a concave criterion; the sums hold ``value``, ``score`` and ``info``.

    Coefficients outside ``free`` stay at ``start``. A step that lowers the
    criterion is halved. ``diverging`` is set when the criterion stood still
    while coefficients still moved.
    """
    theta = np.zeros(p) if start is None else np.array(start, float)
    sums = yield theta
    first = sums["value"]
    allowed = np.ones(p, bool) if free is None else free
    use = np.flatnonzero(allowed)
    use = use[independent(sums["info"][np.ix_(use, use)])] if len(use) else use
    moved, steps, converged = 0.0, 0, False
    while steps < max_steps and len(use):
        step = np.linalg.lstsq(sums["info"][np.ix_(use, use)], sums["score"][use], rcond=None)[0]
        biggest = np.abs(step).max()
        if biggest > longest:
            step *= longest / biggest
        steps += 1
        for _ in range(30):
            trial = theta.copy()
            trial[use] += step
            answer = yield trial
            if np.isfinite(answer["value"]) and answer["value"] >= sums["value"] - 1e-12 * (1 + abs(sums["value"])):
                break
            step = step / 2
        gain, moved = answer["value"] - sums["value"], float(np.abs(step).max())
        theta, sums = trial, answer
        if abs(gain) <= tolerance * (1 + abs(sums["value"])):
            converged = True
            if moved < 1e-9 * (1 + float(np.abs(theta).max())) or moved > 1e-3:
                break
    used = np.zeros(p, bool)
    used[use] = True
    return {"theta": theta, "sums": sums, "first": first, "steps": steps, "used": used,
            "diverging": bool(moved > 1e-3), "converged": converged or not len(use)}


def profile_limit(j: int, side: int, best: dict, drop: float, longest: float = 5.0) -> Fit:
    """Value of coefficient ``j`` where the profiled criterion has fallen by ``drop``.

    Newton on the signed root of the fall, which is nearly linear in the
    coefficient, kept inside a bracket.
    """
    theta, top = best["theta"].copy(), best["sums"]["value"]
    free = best["used"].copy()
    free[j] = False
    error = math.sqrt(max(np.linalg.pinv(best["sums"]["info"][np.ix_(best["used"], best["used"])])[
        int(best["used"][:j].sum()), int(best["used"][:j].sum())], 1e-12))
    target = math.sqrt(2 * drop)
    inner, outer = best["theta"][j], None
    at, converged = inner + side * error * target, False
    for _ in range(60):
        theta[j] = at
        fit = yield from climb(len(theta), start=theta, free=free, longest=longest)
        theta = fit["theta"].copy()
        root = math.sqrt(max(2 * (top - fit["sums"]["value"]), 0.0))
        gap = root - target
        if abs(gap) < 1e-9:
            converged = True
            break
        if gap < 0:
            inner = at
        else:
            outer = at
        slope = -side * fit["sums"]["score"][j] / root if root > 0 else 0.0
        new = at - side * gap / slope if slope > 1e-12 else math.nan
        if outer is None:
            far = inner + side * 4 * max(error, abs(inner - best["theta"][j]))
            new = far if not math.isfinite(new) or abs(new - inner) > abs(far - inner) else new
            if abs(at - best["theta"][j]) > 700:
                return {"limit": side * math.inf, "converged": True}
        elif not math.isfinite(new) or not min(inner, outer) < new < max(inner, outer):
            new = 0.5 * (inner + outer)
        if abs(new - at) < 1e-12 * (1 + abs(at)):
            converged = True
            break
        at = new
    return {"limit": at, "converged": converged}
