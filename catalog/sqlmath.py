"""SQL text for tail probabilities, as numerical integrals over ``range``."""

from __future__ import annotations

STEPS = 2000  # Simpson intervals


def simpson(function: str, upper: str) -> str:
    """Integral of ``function`` of ``u`` from 0 to ``upper`` (Simpson)."""
    weight = f"CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    body = function.replace("u", f"(({upper}) * i / {STEPS}.0)")
    return f"(({upper}) / {3 * STEPS}.0 * (SELECT sum({weight} * ({body})) FROM range({STEPS + 1}) AS steps(i)))"


def normal_p(z: str) -> str:
    """Two-sided normal p."""
    return f"(1 - 2 * {simpson('exp(-u * u / 2) / sqrt(2 * pi())'.replace('sqrt', 'SQRT'), f'least(abs({z}), 38.0)')})"


def t_p(t: str, df: str) -> str:
    """Two-sided t p."""
    constant = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / SQRT({df} * pi())"
    return f"(1 - 2 * {constant} * {simpson(f'pow(1 + u * u / {df}, -({df} + 1) / 2.0)', f'abs({t})')})"


def t_point(df: str) -> str:
    """Two-sided 95% point of t: the expansion in 1/df, then one Newton step on the integral."""
    z = 1.959963984540054
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    g5 = (27 * z**11 + 339 * z**9 + 930 * z**7 - 1782 * z**5 - 765 * z**3 + 17955 * z) / 368640
    start = f"({z} + {g1} / {df} + {g2} / pow({df}, 2) + {g3} / pow({df}, 3) + {g4} / pow({df}, 4) + {g5} / pow({df}, 5))"
    density = (f"(exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / SQRT({df} * pi()) "
               f"* pow(1 + {start} * {start} / {df}, -({df} + 1) / 2.0))")
    return f"({start} + ({t_p(start, df)} - 0.05) / (2 * {density}))"


def chi_square_p(x: str, df: str) -> str:
    """Upper tail of chi-square with any degrees of freedom; the integral is over the root of the variable."""
    constant = f"exp(ln(2) - {df} / 2.0 * ln(2) - lgamma({df} / 2.0))"
    return f"(1 - {constant} * {simpson(f'pow(u, {df} - 1) * exp(-u * u / 2)', f'least(SQRT({x}), 60.0)')})"


def log_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


# --- repeated measures: elimination over matrix cells and a search in one dimension ------------

RANGE = 0.999  # correlations searched
GRIDS = (80, 40, 40)  # intervals of the first grid, and of those around the best point of the one before
NEWTON_ROUNDS = 4


def design_sql(column) -> str:
    """The value of a model column (``operators.design.DesignColumn``) in a complete row."""
    value = " * ".join(["1.0", *[f"CAST({n} AS DOUBLE)" for n in column.numbers]])
    if not column.factors:
        return value
    test = " AND ".join(f"{f} = {literal(v)}" for f, v in column.factors)
    return f"CASE WHEN {test} THEN {value} ELSE 0.0 END"


def literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def sweep(name: str, source: str, size: int, pivots: int) -> str:
    """Recursive table ``name`` that sweeps the first ``pivots`` columns of each matrix of ``source(key, rid, rho, a)``.

    ``a`` is a list of the size x size cells. Swept, it holds minus the inverse, the
    coefficients beside it and what is left of the last cell; ``ld`` is the log determinant
    and ``used`` the number of columns that were no combination of earlier ones.
    """
    d = f"a[k * {size} + k + 1]"
    i, j = f"(t // {size})", f"(t % {size})"
    cell = (f"CASE WHEN {i} = k AND {j} = k THEN -1 / {d} WHEN {i} = k OR {j} = k THEN a[t + 1] / {d} "
            f"ELSE a[t + 1] - a[{i} * {size} + k + 1] * a[k * {size} + {j} + 1] / {d} END")
    # The column of a skipped pivot is cleared, so that it has no part in what follows.
    cleared = f"CASE WHEN {i} = k OR {j} = k THEN 0 ELSE a[t + 1] END"
    kept = f"{d} > 1e-9 * a0[k * {size} + k + 1]"
    return f"""{name}(key, rid, rho, k, a, a0, ld, used) AS (
        SELECT key, rid, rho, CAST(0 AS BIGINT), a, a, CAST(0 AS DOUBLE), [CAST(-1 AS BIGINT)] FROM {source}
        UNION ALL
        SELECT key, rid, rho, k + 1, CASE WHEN {kept} THEN list_transform(range({size * size}), lambda t: {cell})
            ELSE list_transform(range({size * size}), lambda t: {cleared}) END, a0,
          CASE WHEN {kept} THEN ld + ln({d}) ELSE ld END, CASE WHEN {kept} THEN list_append(used, k) ELSE used END
        FROM {name} WHERE k < {pivots})"""


def reml_sql(source: str, *, columns, levels, variables, y: str, subject: str, period: str, period_levels, by: str = "", contrasts=None, prefix: str = "r") -> list[str]:
    """Common tables that end in ``{prefix}_fit``: all columns of ``operators.mmrm.mmrm`` but p and the interval.

    Products per gap are summed once; each probe of the correlation is a row, whose
    matrix is put together and swept. The minimum is found by grids that close in and then by Newton steps
    on five-point differences, which also give the degrees of freedom.
    """
    p, size = len(columns), len(columns) + 1
    key = by or "0"
    known = [f"{y} IS NOT NULL", f"{period} IN ({', '.join(map(literal, period_levels))})"] + [
        f"{v} IN ({', '.join(map(literal, levels[v]))})" if v in levels else f"{v} IS NOT NULL" for v in variables]
    place = "CASE " + " ".join(f"WHEN {period} = {literal(v)} THEN {i}" for i, v in enumerate(period_levels)) + " END"
    x = prefix
    out = [
        f"""{x}_rows AS (SELECT {key} AS key, {subject} AS subject, {place} AS place, [{', '.join(map(design_sql, columns))}, CAST({y} AS DOUBLE)] AS z
            FROM {source} WHERE {' AND '.join(known)})""",
        f"""{x}_pairs AS (SELECT key, z, coalesce(place - lag(place) OVER w, 0) AS gap, coalesce(lag(z) OVER w, list_transform(z, lambda v: CAST(0 AS DOUBLE))) AS q
            FROM {x}_rows WINDOW w AS (PARTITION BY key, subject ORDER BY place))""",
        f"""{x}_gaps AS MATERIALIZED (SELECT key, gap, i, j, count(*) AS n, sum(z[i] * z[j]) AS own, sum(z[i] * q[j] + q[i] * z[j]) AS mixed, sum(q[i] * q[j]) AS prev
            FROM {x}_pairs, range(1, {size + 1}) a(i), range(1, {size + 1}) b(j) GROUP BY ALL)""",
        f"""{x}_total AS MATERIALIZED (SELECT key, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN gap = 0 THEN n ELSE 0 END) AS BIGINT) AS subjects
            FROM {x}_gaps WHERE i = 1 AND j = 1 GROUP BY key)""",
        f"{x}_plain AS MATERIALIZED (SELECT key, list(v ORDER BY i, j) AS m FROM (SELECT key, i, j, sum(own) AS v FROM {x}_gaps GROUP BY ALL) GROUP BY key)",
    ]

    def probe(name: str, points: str) -> list[str]:
        """Criterion and swept matrix at the points (key, rid, rho)."""
        r = "pow(rho, gap)"
        return [
            f"{name}_p AS MATERIALIZED ({points})",
            f"""{name}_m AS MATERIALIZED (SELECT key, rid, rho, list(v ORDER BY i, j) AS a FROM (
                SELECT key, rid, rho, i, j, sum(CASE WHEN gap = 0 THEN own ELSE (own - {r} * mixed + {r} * {r} * prev) / (1 - {r} * {r}) END) AS v
                FROM {name}_p JOIN {x}_gaps USING (key) GROUP BY ALL) GROUP BY key, rid, rho)""",
            sweep(f"{name}_s", f"{name}_m", size, p),
            f"""{name} AS MATERIALIZED (SELECT key, rid, rho, a, list_filter(used, lambda u: u >= 0) AS used, n, a[{size * size}] AS rss, n - len(used) + 1 AS dof, ld + corr AS logs,
                (n - len(used) + 1) * ln(greatest(a[{size * size}], 1e-300) / (n - len(used) + 1)) + ld + corr AS crit
                FROM {name}_s JOIN {x}_total USING (key) JOIN (SELECT key, rid, sum(CASE WHEN gap = 0 THEN 0 ELSE n * ln(1 - pow(rho, 2 * gap)) END) AS corr
                  FROM {name}_p JOIN {x}_gaps USING (key) WHERE i = 1 AND j = 1 GROUP BY ALL) USING (key, rid) WHERE k = {p})""",
        ]

    out += probe(f"{x}0", f"SELECT key, t AS rid, -{RANGE} + {2 * RANGE} * t / {GRIDS[0]} AS rho FROM {x}_total, range({GRIDS[0] + 1}) g(t)")
    step, last = 2 * RANGE / GRIDS[0], f"{x}0"
    for number, parts in enumerate(GRIDS[1:], 1):
        best = f"(SELECT key, arg_min(rho, crit) AS best FROM {last} GROUP BY key)"
        width = f"greatest(-{RANGE}, best - {step!r}) + (least({RANGE}, best + {step!r}) - greatest(-{RANGE}, best - {step!r})) * t / {parts}"
        out += probe(f"{x}{number}", f"SELECT key, t AS rid, {width} AS rho FROM {best}, range({parts + 1}) g(t)")
        step, last = 2 * step / parts, f"{x}{number}"
    centre = f"(SELECT key, arg_min(rho, crit) AS best FROM {last} GROUP BY key)"
    around = "SELECT key, t AS rid, best + t * least(1e-3, (1 - abs(best)) / 4) AS rho FROM {source}, range(-2, 3) g(t)"
    # Values at the five points as columns of one row.
    five = lambda e: {t: f"max(CASE WHEN rid = {t} THEN {e} END)" for t in range(-2, 3)}
    first = lambda e: "(({-2}) - 8 * ({-1}) + 8 * ({1}) - ({2})) / (12 * h)".replace("{-2}", five(e)[-2]).replace("{-1}", five(e)[-1]).replace("{1}", five(e)[1]).replace("{2}", five(e)[2])  # noqa: E731,E501
    second = lambda e: f"(-({five(e)[-2]}) + 16 * ({five(e)[-1]}) - 30 * ({five(e)[0]}) + 16 * ({five(e)[1]}) - ({five(e)[2]})) / (12 * h * h)"
    h = "(SELECT *, least(1e-3, (1 - abs(best)) / 4) AS h FROM (SELECT *, max(CASE WHEN rid = 0 THEN rho END) OVER (PARTITION BY key) AS best FROM {name}))"
    for number in range(NEWTON_ROUNDS):
        name = f"{x}n{number}"
        out += probe(name, around.format(source=centre))
        centre = f"(SELECT key, best - ({first('crit')}) / ({second('crit')}) AS best FROM {h.format(name=name)} GROUP BY key, best, h)"
    out += probe(f"{x}f", around.format(source=centre))
    cells = f"{x}f, range({size}) a(i), range({size}) b(j)"
    out += [
        f"""{x}_at AS MATERIALIZED (SELECT key, best AS rho, any_value(n) AS n, any_value(dof) AS dof, {five('rss')[0]} AS rss, {five('logs')[0]} AS logs,
            {first('rss')} AS rss1, {second('rss')} AS rss2, {second('logs')} AS logs2, any_value(used) AS used FROM {h.format(name=f'{x}f')} GROUP BY key, best, h)""",
        # Inverse, coefficients (at j = p) and slope of the inverse.
        f"""{x}_inv AS MATERIALIZED (SELECT key, i, j, {five('v')[0]} AS v, {first('v')} AS v1 FROM {h.format(name=f'''(SELECT key, rid, rho, i, j, a[i * {size} + j + 1] AS v FROM {cells})''').replace(
            'PARTITION BY key)', 'PARTITION BY key, i, j)')} GROUP BY key, i, j, h)""",
        f"""{x}_var AS MATERIALIZED (SELECT *, rss / dof AS s2 FROM {x}_at)""",
        f"""{x}_hess AS MATERIALIZED (SELECT *, dof / (2 * s2 * s2) AS h11, -rss1 / (2 * s2 * s2) AS h12, 0.5 * (logs2 + rss2 / s2) AS h22 FROM {x}_var)""",
        f"""{x}_rms AS MATERIALIZED (SELECT key, sqrt(greatest(sum(w * u * m[i * {size} + j + 1]), 0) / any_value(n)) AS rms FROM (
              SELECT a.key, a.i, b.i AS j, a.w, b.w AS u FROM (SELECT key, i, CASE WHEN i = {p} THEN -1 ELSE v END AS w FROM {x}_inv WHERE j = {p}) a
              JOIN (SELECT key, i, CASE WHEN i = {p} THEN -1 ELSE v END AS w FROM {x}_inv WHERE j = {p}) b USING (key)) JOIN {x}_plain USING (key) JOIN {x}_total USING (key) GROUP BY key)""",
    ]
    names = [c.name for c in columns]
    wanted = [("coefficient", n, {n: 1.0}) for n in names] + [("contrast", n, w) for n, w in (contrasts or {}).items()]
    weights = ", ".join(f"({number}, '{kind}', '{term}', {names.index(n)}, {w!r}e0)" for number, (kind, term, told) in enumerate(wanted) for n, w in told.items())
    out += [
        f"{x}_w(number, kind, term, i, w) AS (VALUES {weights})",
        f"""{x}_est AS MATERIALIZED (SELECT key, number, kind, term, sum(w * v) AS estimate, bool_and(list_contains(used, CAST(i AS BIGINT))) AS known
            FROM {x}_w JOIN {x}_inv USING (i) JOIN {x}_at USING (key) WHERE j = {p} GROUP BY ALL)""",
        f"""{x}_unit AS MATERIALIZED (SELECT key, a.number, -sum(a.w * b.w * v) AS unit, -sum(a.w * b.w * v1) AS unit1
            FROM {x}_w a JOIN {x}_w b USING (number) JOIN {x}_inv c ON c.i = a.i AND c.j = b.i GROUP BY ALL)""",
        f"""{x}_fit AS MATERIALIZED (SELECT key, kind, term, estimate, sqrt(v) AS std_error, 2 * v * v * (h11 * h22 - h12 * h12) / (g1 * g1 * h22 - 2 * g1 * g2 * h12 + g2 * g2 * h11) AS df,
              n, subjects, rho, sqrt(s2) AS sigma, rms AS rms_residual, -0.5 * (dof * ln(2 * pi()) + dof * ln(s2) + logs + dof) AS reml_loglik, abs(rho) > 0.995 AS at_border
            FROM (SELECT e.key, kind, term, CASE WHEN known THEN estimate END AS estimate, CASE WHEN known THEN s2 * unit END AS v, unit AS g1, s2 * unit1 AS g2, h11, h12, h22, h.n, subjects, rho, s2, rms, dof, logs
              FROM {x}_est e JOIN {x}_unit u USING (key, number) JOIN {x}_hess h USING (key) JOIN {x}_total t USING (key) JOIN {x}_rms USING (key)))""",
    ]
    return out


def reml_select(prefix: str = "r", by: str = "", extra: str = "") -> str:
    """The rows of ``{prefix}_fit`` with t, p, interval and standardised contrasts."""
    std = "CASE WHEN kind = 'contrast' THEN estimate / rms_residual END"
    return f"""SELECT {extra}{f'key AS {by}, ' if by else ''}kind, term, estimate, std_error, df, estimate / std_error AS t, {t_p('(estimate / std_error)', 'df')} AS p,
        estimate - {t_point('df')} * std_error AS ci_low, estimate + {t_point('df')} * std_error AS ci_high, {std} AS std_contrast,
        {std} * (1 - 3 / (4 * df - 1)) AS std_contrast_corrected, n, subjects, rho, sigma, rms_residual, reml_loglik, at_border FROM {prefix}_fit"""


# --- penalised logistic regression: inner maximum and root search ------------------------------

NEWTON_STEPS = 45
DAMPING = 0.7  # scoring steps overshoot where the penalty leads
ROOT_ROUNDS = 12
FAR = 24  # points of the first look for a limit, a quarter of the Wald half-width apart
HALF_WIDTH = 1.959963984540054
DROP = 3.841458820694124


def determinant(cells: list[list[str]]) -> str:
    if len(cells) == 1:
        return cells[0][0]
    minors = [(k, [row[:k] + row[k + 1:] for row in cells[1:]]) for k in range(len(cells))]
    return "(" + " ".join(f"{'-' if k % 2 else '+'} {cells[0][k]} * {determinant(minor)}" for k, minor in minors) + ")"


def adjugate(cells: list[list[str]]) -> list[list[str]]:
    """Cofactors of a symmetric matrix: its inverse times its determinant."""
    n = len(cells)
    if n == 1:
        return [["1.0"]]
    return [[f"({'-' if (i + j) % 2 else ''}{determinant([[cells[r][c] for c in range(n) if c != j] for r in range(n) if r != i])})" for j in range(n)] for i in range(n)]


def penalised_climb(name: str, points: str, patterns: str, p: int) -> list[str]:
    """Common tables that maximise the penalised likelihood from each of ``points(key, rid, fixed, b)``.

    Coefficient ``fixed`` (none if -1) stays. The result ``name(key, rid, fixed, b, value, info)``
    has the information as a list of cells. ``patterns(key, x, n, e)`` are counts per covariate pattern.
    """
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    info = [[f"i{min(i, j)}{max(i, j)}" for j in range(p)] for i in range(p)]
    held = [[f"(CASE WHEN fixed IN ({i}, {j}) THEN {float(i == j)} ELSE {info[i][j]} END)" for j in range(p)] for i in range(p)]
    sums = ", ".join(f"sum(n * pr * (1 - pr) * x[{i + 1}] * x[{j + 1}]) OVER (PARTITION BY key, rid) AS i{i}{j}" for i, j in pairs)
    inverse = adjugate(info)
    hat = "pr * (1 - pr) * (" + " + ".join(f"{inverse[i][j]} * x[{i + 1}] * x[{j + 1}]" for i in range(p) for j in range(p)) + ") / det"
    scores = ", ".join(f"sum((e - n * pr + n * hat * (0.5 - pr)) * x[{r + 1}]) AS u{r}" for r in range(p))
    free = [f"(CASE WHEN fixed = {r} THEN 0 ELSE u{r} END)" for r in range(p)]
    solved = adjugate(held)
    steps = ", ".join("(" + " + ".join(f"{solved[i][j]} * {free[j]}" for j in range(p)) + f") / {determinant(held)}" for i in range(p))
    cells = ", ".join(info[i][j] for i in range(p) for j in range(p))
    return [
        f"{name}_p AS MATERIALIZED ({points})",
        f"""{name}_s(key, rid, fixed, it, b, value, info) AS (
            SELECT key, rid, fixed, 0, b, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE[]) FROM {name}_p
            UNION ALL
            SELECT key, rid, fixed, it + 1, list_transform(range(1, {p + 1}), lambda r: b[r] + {DAMPING} * d[r] * least(1, 5 / greatest(5, list_max(list_transform(d, lambda v: abs(v)))))), value, info
            FROM (SELECT key, rid, fixed, it, b, value, [{cells}] AS info, [{steps}] AS d
              FROM (SELECT key, rid, fixed, it, b, {scores}, {', '.join(f'any_value(i{i}{j}) AS i{i}{j}' for i, j in pairs)},
                  sum(e * eta - n * (greatest(eta, 0) + ln(1 + exp(-abs(eta))))) + 0.5 * ln(any_value(det)) AS value
                FROM (SELECT *, {hat} AS hat
                  FROM (SELECT *, {determinant(info)} AS det
                    FROM (SELECT *, {sums}
                      FROM (SELECT s.key, rid, fixed, it, b, x, n, e, list_dot_product(b, x) AS eta, 1 / (1 + exp(-list_dot_product(b, x))) AS pr
                        FROM {name}_s s JOIN {patterns} t ON s.key = t.key WHERE it < {NEWTON_STEPS}))))
                GROUP BY key, rid, fixed, it, b)))""",
        f"{name} AS MATERIALIZED (SELECT key, rid, fixed, b, value, info FROM {name}_s WHERE it = {NEWTON_STEPS})",
    ]


def firth_sql(source: str, *, columns, where: str, response: str, by: str = "", prefix: str = "f") -> list[str]:
    """Common tables that end in ``{prefix}_fit``: the columns of ``operators.firth.firth`` but the number of steps.

    The limits of an interval are where twice the fall of the profiled likelihood reaches
    the 95% point. Each is first looked for on a line of points, then by false position on the
    square root of the fall, where an end that stays counts half; each point has its own inner maximum over the other coefficients.
    """
    p, x = len(columns), prefix
    key = f"coalesce(CAST({by} AS VARCHAR), '~')" if by else "'~'"
    names = ", ".join(f"({i}, '{c.name}')" for i, c in enumerate(columns))
    out = [
        f"""{x}_pat AS MATERIALIZED (SELECT key, x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(e) AS DOUBLE) AS e
            FROM (SELECT {key} AS key, [{', '.join(map(design_sql, columns))}] AS x, {response} AS e FROM {source} WHERE {where}) GROUP BY key, x)""",
        f"{x}_name(j, term) AS (VALUES {names})",
    ]
    zero = "[" + ", ".join(["CAST(0 AS DOUBLE)"] * p) + "]"
    out += penalised_climb(f"{x}_full", f"SELECT DISTINCT key, 0 AS rid, -1 AS fixed, {zero} AS b FROM {x}_pat", f"{x}_pat", p)
    info = [[f"info[{i * p + j + 1}]" for j in range(p)] for i in range(p)]
    adj = adjugate(info)
    errors = ", ".join(f"sqrt({adj[i][i]} / {determinant(info)})" for i in range(p))
    inverse = ", ".join(f"{adj[i][j]} / {determinant(info)}" for i in range(p) for j in range(p))
    # The other coefficients start where they would be if the likelihood were quadratic.
    put = lambda at: f"list_transform(range(1, {p + 1}), lambda r: b[r] + ({at} - b[j + 1]) * cov[(r - 1) * {p} + j + 1] / cov[j * {p + 1} + 1])"
    out.append(f"{x}_top AS MATERIALIZED (SELECT key, b, value AS top, [{errors}] AS se, [{inverse}] AS cov FROM {x}_full)")
    out += penalised_climb(f"{x}_null", f"SELECT key, j AS rid, j AS fixed, {put('0')} AS b FROM {x}_top, {x}_name", f"{x}_pat", p)
    sides = f"(SELECT key, j, side, b, top, se, cov FROM {x}_top, {x}_name, (VALUES (-1), (1)) s(side))"
    # The number of a point tells coefficient, side and place.
    number = f"(j * 2 + (side + 1) // 2) * {FAR + 1}"
    at = f"b[j + 1] + side * se[j + 1] * {HALF_WIDTH} * k / 4"
    out += penalised_climb(f"{x}_far", f"SELECT key, {number} + k AS rid, j AS fixed, {put(at)} AS b FROM {sides}, range(1, {FAR + 1}) g(k)", f"{x}_pat", p)
    fall = "sqrt(greatest(2 * (top - value), 0))"
    gap = f"{fall} - sqrt({DROP})"
    out.append(f"""{x}_b0 AS MATERIALIZED (SELECT key, j, side, coalesce(max(v) FILTER (f < 0), any_value(start)) AS low, coalesce(max(f) FILTER (f < 0), -sqrt({DROP})) AS low_gap,
          min(v) FILTER (f >= 0) AS high, min(f) FILTER (f >= 0) AS high_gap, 0 AS last
        FROM (SELECT key, r.fixed AS j, side, side * r.b[r.fixed + 1] AS v, {gap} AS f, side * t.b[r.fixed + 1] AS start
          FROM {x}_far r JOIN {x}_top t USING (key), (VALUES (-1), (1)) s(side) WHERE r.rid // {FAR + 1} % 2 = (side + 1) // 2) GROUP BY key, j, side)""")
    for k in range(ROOT_ROUNDS):
        guess = "(low - (high - low) * low_gap / (high_gap - low_gap))"
        out += penalised_climb(
            f"{x}_r{k}", f"SELECT key, j * 2 + (side + 1) // 2 AS rid, j AS fixed, {put(f'side * {guess}')} AS b FROM {x}_b{k} JOIN {x}_top USING (key)", f"{x}_pat", p)
        # An end that stays twice counts half, so both ends close in.
        out.append(f"""{x}_b{k + 1} AS MATERIALIZED (SELECT key, j, side, CASE WHEN f < 0 THEN v ELSE low END AS low, CASE WHEN f < 0 THEN f WHEN last = 1 THEN low_gap / 2 ELSE low_gap END AS low_gap,
              CASE WHEN f >= 0 THEN v ELSE high END AS high, CASE WHEN f >= 0 THEN f WHEN last = -1 THEN high_gap / 2 ELSE high_gap END AS high_gap,
              CASE WHEN f < 0 THEN -1 ELSE 1 END AS last, side * v AS at
            FROM (SELECT a.*, a.side * r.b[a.j + 1] AS v, {gap} AS f FROM {x}_b{k} a JOIN {x}_r{k} r ON a.key = r.key AND r.rid = a.j * 2 + (a.side + 1) // 2 JOIN {x}_top t ON a.key = t.key))""")
    out.append(f"""{x}_fit AS MATERIALIZED (SELECT t.key, term, t.b[c.j + 1] AS estimate, se[c.j + 1] AS std_error, lo.at AS ci_low, hi.at AS ci_high,
          greatest(2 * (top - z.value), 0) AS chi_square, n, events, top AS penalised_loglik
        FROM {x}_top t, {x}_name c JOIN {x}_null z ON z.key = t.key AND z.rid = c.j JOIN {x}_b{ROOT_ROUNDS} lo ON lo.key = t.key AND lo.j = c.j AND lo.side = -1
        JOIN {x}_b{ROOT_ROUNDS} hi ON hi.key = t.key AND hi.j = c.j AND hi.side = 1
        JOIN (SELECT key, CAST(sum(n) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS events FROM {x}_pat GROUP BY key) s ON s.key = t.key)""")
    return out


def firth_select(prefix: str = "f", by: str = "", extra: str = "", odds: bool = False) -> str:
    """The rows of ``{prefix}_fit`` with p and, if asked for, odds ratios."""
    ratios = ", exp(estimate) AS odds_ratio, exp(ci_low) AS or_low, exp(ci_high) AS or_high" if odds else ""
    key = f"nullif(key, '~') AS {by}, " if by else ""
    return f"""SELECT {extra}{key}term, estimate, std_error, ci_low, ci_high, chi_square, {normal_p('sqrt(chi_square)')} AS p, n, events, penalised_loglik,
        true AS converged, true AS limits_converged{ratios} FROM {prefix}_fit"""


# --- exact tests ------------------------------------------------------------------------------

BISECTIONS = 100


def odds_ratio_sql(source: str, by: str) -> list[str]:
    """Common tables from ``source(by, n00, n01, n10, n11)`` to ``odds``: two-sided p, conditional odds ratio and its exact interval."""
    part = lambda test: f"list_sum(list_transform(s, lambda q: CASE WHEN {test} THEN exp(q.lp + q.k * mid - top) ELSE 0 END)) / list_sum(list_transform(s, lambda q: exp(q.lp + q.k * mid - top)))"  # noqa: E731,E501
    mean = "list_sum(list_transform(s, lambda q: q.k * exp(q.lp + q.k * mid - top))) / list_sum(list_transform(s, lambda q: exp(q.lp + q.k * mid - top)))"
    return [
        f"""support AS MATERIALIZED (SELECT {by}, n00, n01, n10, n11, greatest(0, n00 - n11) AS first, least(n00 + n01, n00 + n10) AS last,
              list_transform(range(greatest(0, n00 - n11), least(n00 + n01, n00 + n10) + 1),
                lambda k: {{'k': k, 'lp': {log_choose('(n00 + n10)', 'k')} + {log_choose('(n01 + n11)', '(n00 + n01 - k)')}}}) AS s FROM {source})""",
        f"""roots({by}, kind, i, n00, low, high, s) AS (
            SELECT {by}, kind, 0, n00, CAST(-60 AS DOUBLE), CAST(60 AS DOUBLE), s FROM support, (VALUES ('mean'), ('lower'), ('upper')) k(kind)
            UNION ALL
            SELECT {by}, kind, i + 1, n00, CASE WHEN below THEN mid ELSE low END, CASE WHEN below THEN high ELSE mid END, s
            FROM (SELECT *, CASE kind WHEN 'mean' THEN {mean} < n00 WHEN 'lower' THEN {part('q.k >= n00')} < 0.025 ELSE {part('q.k <= n00')} > 0.025 END AS below
              FROM (SELECT *, list_max(list_transform(s, lambda q: q.lp + q.k * mid)) AS top FROM (SELECT *, (low + high) / 2 AS mid FROM roots WHERE i < {BISECTIONS}))))""",
        f"""odds AS (SELECT {by}, n00, n01, n10, n11,
              (SELECT sum(exp(q.lp - top)) FILTER (q.lp <= seen + 1e-7) / sum(exp(q.lp - top)) FROM (SELECT q, max(q.lp) OVER () AS top, max(CASE WHEN q.k = n00 THEN q.lp END) OVER () AS seen
                FROM (SELECT unnest(s) AS q))) AS p,
              CASE WHEN first = last THEN 'nan'::DOUBLE WHEN n00 = first THEN 0 WHEN n00 = last THEN 'inf'::DOUBLE ELSE exp(m) END AS odds_ratio,
              CASE WHEN n00 = first THEN 0 ELSE exp(l) END AS ci_low, CASE WHEN n00 = last THEN 'inf'::DOUBLE ELSE exp(u) END AS ci_high
            FROM support JOIN (SELECT {by}, max((low + high) / 2) FILTER (kind = 'mean') AS m, max((low + high) / 2) FILTER (kind = 'lower') AS l,
              max((low + high) / 2) FILTER (kind = 'upper') AS u FROM roots WHERE i = {BISECTIONS} GROUP BY {by}) USING ({by}))""",
    ]


def levels_sql(source: str, by: str, prefix: str = "x") -> list[str]:
    """Exact test of level by 0/1 arm of ``source(by, level, n, a)`` in each stratum, as ``{prefix}_p(by, levels, n, method, p)``.

    Levels are added one after another: all counts of the first ones, with what they take of the column, are listed,
    and meet the splits of the last two, ordered by probability with running sums.
    """
    x = prefix
    return [
        f"""{x}_rows AS MATERIALIZED (SELECT {by}, n, a, row_number() OVER (PARTITION BY {by} ORDER BY n, a) AS k, count(*) OVER (PARTITION BY {by}) AS levels,
              sum(n) OVER (PARTITION BY {by}) AS total, sum(a) OVER (PARTITION BY {by}) AS col FROM {source} WHERE n > 0)""",
        f"""{x}_seen AS MATERIALIZED (SELECT {by}, any_value(levels) AS levels, CAST(any_value(total) AS BIGINT) AS n, any_value(col) AS col,
              sum({log_choose('n', 'a')}) - any_value({log_choose('total', 'col')}) AS seen, any_value({log_choose('total', 'col')}) AS whole FROM {x}_rows GROUP BY {by})""",
        f"""{x}_walk({by}, k, taken, lp) AS (SELECT {by}, CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS DOUBLE) FROM {x}_seen WHERE levels >= 2
            UNION ALL SELECT w.{by}, w.k + 1, w.taken + c, w.lp + {log_choose('r.n', 'c')}
              FROM {x}_walk w JOIN {x}_rows r ON w.{by} IS NOT DISTINCT FROM r.{by} AND r.k = w.k + 1 AND r.k <= r.levels - 2, LATERAL (SELECT unnest(range(CAST(least(r.n, r.col - w.taken) AS BIGINT) + 1)) AS c))""",
        f"""{x}_ends AS MATERIALIZED (SELECT {by}, left_sum, lp, sum(exp(lp - whole)) OVER (PARTITION BY {by}, left_sum ORDER BY lp) AS upto FROM (
              SELECT a.{by}, c + d AS left_sum, {log_choose('a.n', 'c')} + {log_choose('b.n', 'd')} AS lp, whole
              FROM {x}_rows a JOIN {x}_rows b ON a.{by} IS NOT DISTINCT FROM b.{by} AND a.k = a.levels - 1 AND b.k = b.levels JOIN {x}_seen s ON s.{by} IS NOT DISTINCT FROM a.{by},
              LATERAL (SELECT unnest(range(CAST(least(a.n, a.col) AS BIGINT) + 1)) AS c), LATERAL (SELECT unnest(range(CAST(least(b.n, b.col) AS BIGINT) + 1)) AS d) WHERE c + d <= a.col))""",
        f"""{x}_p AS MATERIALIZED (SELECT s.{by}, CAST(s.levels AS INTEGER) AS levels, s.n, CASE WHEN s.levels < 2 OR s.col IN (0, s.n) THEN 'none' ELSE 'exact' END AS method,
              CASE WHEN s.levels < 2 OR s.col IN (0, s.n) THEN 1 ELSE least(p, 1) END AS p
            FROM {x}_seen s LEFT JOIN (SELECT w.{by}, sum(exp(w.lp) * e.upto) AS p FROM (
                SELECT w.{by}, s.col - w.taken AS left_sum, w.lp, s.seen + s.whole + 1e-7 - w.lp AS most FROM {x}_walk w JOIN {x}_seen s ON w.{by} IS NOT DISTINCT FROM s.{by} WHERE w.k = s.levels - 2) w
              ASOF JOIN {x}_ends e ON w.{by} = e.{by} AND w.left_sum = e.left_sum AND w.most >= e.lp GROUP BY w.{by}) q ON s.{by} IS NOT DISTINCT FROM q.{by})""",
    ]


def rank_counts_sql(source: str) -> list[str]:
    """From ``source(m, n)`` the table ``ways(m, n, counts)``: arrangements for each value 0..mn of the rank-sum statistic.

    The counts are the coefficients of a product of (1 - q^(n + i)) / (1 - q^i), one factor a step, in exact whole numbers.
    """
    return [f"""ways_s(m, n, i, a) AS (
            SELECT DISTINCT m, n, CAST(0 AS BIGINT), list_transform(range(m * n + 1), lambda t: CAST(CASE WHEN t = 0 THEN 1 ELSE 0 END AS HUGEINT)) FROM {source}
            UNION ALL
            SELECT m, n, i + 1, list_transform(range(m * n + 1), lambda t: list_sum(list_transform(range(t // (i + 1) + 1), lambda r: b[t - r * (i + 1) + 1])))
            FROM (SELECT m, n, i, list_transform(range(m * n + 1), lambda t: a[t + 1] - CASE WHEN t >= n + i + 1 THEN a[t - n - i] ELSE 0 END) AS b FROM ways_s WHERE i < m))""",
            "ways AS MATERIALIZED (SELECT m, n, a AS counts FROM ways_s WHERE i = m)"]


# --- summary tables ---------------------------------------------------------------------------

NORMAL_TEXT = "CASE WHEN p < 0.001 THEN '<0.001' WHEN p > 0.999 THEN '>0.999' ELSE printf('%.3f', round_even(p, 3)) END"


def summary_sql(source: str, variables, *, arm: str, arms, interval: str = "%s (%s, %s)", tests: bool = False, rank_sql=None) -> list[str]:
    """Common tables that end in ``summary``: the rows of ``operators.describe.summary_table`` over ``source``, without strata.

    ``variables`` is the same specification. ``rank_sql`` writes the rank-sum test of numbers where tests are asked for.
    """
    place = {n: i for i, n in enumerate(variables)}
    cats = {n: v for n, v in variables.items() if hasattr(v, "levels")}
    nums = {n: v for n, v in variables.items() if n not in cats}
    q = lambda text: "'" + str(text).replace("'", "''") + "'"
    sides = ", ".join(f"({literal(a)})" for a in arms)
    known = f"{arm} IN ({', '.join(map(literal, arms))})"
    observed = " UNION ALL ".join(
        f"SELECT {arm} AS arm_, {q(n)} AS variable, CAST({n} AS VARCHAR) AS level FROM {source} WHERE {known} AND {n} IN ({', '.join(map(q, v.levels))})" for n, v in cats.items())
    grid = ", ".join(
        f"({q(n)}, {q(v.label or n)}, {place[n]}, {q(lv)}, {i})" for n, v in cats.items() for i, lv in enumerate(v.levels) if v.show is None or lv in v.show)
    numbers = " UNION ALL ".join(f"SELECT {arm} AS arm_, {q(n)} AS variable, CAST({n} AS DOUBLE) AS value FROM {source} WHERE {known} AND {n} IS NOT NULL" for n in nums)
    listed = ", ".join(f"({q(n)}, {q(v.label or n)}, {place[n]}, {v.digits})" for n, v in nums.items())
    show = lambda c: " ".join(["CASE digits", *[f"WHEN {d} THEN printf('%.{d}f', round_even({c}, {d}))" for d in sorted({v.digits for v in nums.values()})], "END"])
    pieces = interval.split("%s")
    text = " || ".join([show("median"), q(pieces[1]), show("q1"), q(pieces[2]), show("q3"), q(pieces[3])])
    p = "p, p_text, method" if tests else ""
    out = [
        f"sides(arm_) AS (VALUES {sides})", f"seen AS MATERIALIZED ({observed})", f"grid(variable, label, variable_order, level, level_order) AS (VALUES {grid})",
        "whole AS (SELECT arm_, variable, count(*) AS n_known FROM seen GROUP BY ALL)", "each AS (SELECT arm_, variable, level, count(*) AS n FROM seen GROUP BY ALL)",
        f"numbers AS MATERIALIZED ({numbers})", f"listed(variable, label, variable_order, digits) AS (VALUES {listed})",
        """quartiles AS (SELECT arm_, variable, count(*) AS n_known, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM numbers GROUP BY ALL)""",
        f"""described AS (
            SELECT variable, label, variable_order, level, level_order, arm_, coalesce(n_known, 0) AS n_known, coalesce(n, 0) AS n,
              CASE WHEN n_known > 0 THEN 100.0 * coalesce(n, 0) / n_known END AS percent, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS q3,
              CAST(coalesce(n, 0) AS VARCHAR) || ' (' || printf('%.0f', round_even(100.0 * coalesce(n, 0) / n_known, 0)) || '%)' AS text
            FROM (SELECT * FROM sides, grid) g LEFT JOIN whole USING (arm_, variable) LEFT JOIN each USING (arm_, variable, level)
            UNION ALL
            SELECT variable, label, variable_order, NULL, 0, arm_, coalesce(n_known, 0), NULL, NULL, median, q1, q3, {text}
            FROM (SELECT * FROM sides, listed) g LEFT JOIN quartiles USING (arm_, variable))""",
    ]
    side = f"CASE WHEN arm_ = {literal(arms[0])} THEN 1 ELSE 0 END"
    if tests:
        out += [f"counted AS (SELECT variable, level, count(*) AS n, sum({side}) AS a FROM seen GROUP BY ALL)", *levels_sql("counted", "variable", "lv"),
                f"sided AS (SELECT variable, value, {side} AS arm FROM numbers)", rank_sql("sided", "value", "variable"),
                f"tested AS (SELECT variable, p, method, {NORMAL_TEXT} AS p_text FROM (SELECT variable, p, method FROM lv_p UNION ALL SELECT variable, least(p, 1), 'normal' FROM r))"]
    out.append(f"summary AS (SELECT d.* EXCLUDE (arm_), arm_ AS {arm}{', ' + p if p else ''} FROM described d {'LEFT JOIN tested USING (variable)' if tests else ''})")
    return out
