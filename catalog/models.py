"""Registered queries: survival, Cox, penalised logistic and repeated-measures models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as x
from catalog import sqlmath as m
from catalog.fixtures import Entry, digits
from twinarm.operators import survival
from twinarm.operators.cox import cox
from twinarm.operators.design import crossed, design_columns, expression, variables
from twinarm.operators.firth import firth, odds_ratios
from twinarm.operators.mmrm import arm_contrasts, cross_products, mmrm
from twinarm.operators.reshape import append_labelled

E: dict[str, Entry] = {}
S, L, B = x.SURVIVAL, x.LONG, x.BINARY
GENDER = {"gender": ["F", "M"]}

# --- survival ------------------------------------------------------------------------------
E["survival_pair"] = Entry(
    lambda s, d: survival.survival_pair(x.survival(s, d), time="time", event="event").select("user_id", "time", "event"),
    f"WITH {S} SELECT user_id, time, event FROM survival WHERE time IS NOT NULL AND event IS NOT NULL", digits("time"),
)
KM = """cnt AS (SELECT {by}, time, sum(event) AS events, sum(1 - event) AS censored FROM {source} GROUP BY ALL),
  rk AS (SELECT *, sum(events + censored) OVER (PARTITION BY {by} ORDER BY time DESC) AS at_risk FROM cnt),
  km AS (SELECT *, sum(CASE WHEN events < at_risk THEN ln(1 - events / CAST(at_risk AS DOUBLE)) ELSE 0 END) OVER w AS ls,
         sum(CASE WHEN events < at_risk THEN events / (CAST(at_risk AS DOUBLE) * (at_risk - events)) ELSE 0 END) OVER w AS gw,
         max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER w AS ended FROM rk WINDOW w AS (PARTITION BY {by} ORDER BY time))
  SELECT {by}, time, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events, CAST(censored AS BIGINT) AS censored,
         CASE WHEN ended = 1 THEN 0 ELSE exp(ls) END AS survival, CASE WHEN ended = 0 THEN exp(ls) * sqrt(gw) END AS std_error,
         CASE WHEN ended = 0 THEN exp(ls - 1.959963984540054 * sqrt(gw)) END AS ci_low,
         CASE WHEN ended = 0 THEN least(exp(ls + 1.959963984540054 * sqrt(gw)), 1.0) END AS ci_high FROM km"""
KM_COLS = digits("time", "survival", "std_error", "ci_low", "ci_high")
E["kaplan_meier_by_arm"] = Entry(
    lambda s, d: survival.kaplan_meier(x.survival(s, d), time="time", event="event", by=["arm"]),
    f"WITH {S}, " + KM.format(by="arm", source="survival"), KM_COLS,
)
ORDERS = """waits AS (SELECT o_orderpriority AS priority, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS DOUBLE) AS time,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event, CAST(o_custkey % 2 AS INTEGER) AS arm FROM orders)"""


def waits(s, d):
    return x.table(s, d, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.datediff(F.lit("2001-08-02").cast("date"), "o_orderdate").cast("double").alias("time"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("event"), (F.col("o_custkey") % 2).cast("int").alias("arm"),
    )


E["kaplan_meier_many_times"] = Entry(
    lambda s, d: survival.kaplan_meier(waits(s, d), time="time", event="event", by=["priority"]),
    f"WITH {ORDERS}, " + KM.format(by="priority", source="waits"), KM_COLS,
)
TIMES = [0, 7, 14, 21, 28]
E["risk_table_at_times"] = Entry(
    lambda s, d: survival.risk_table(x.survival(s, d), time="time", event="event", times=TIMES, by=["arm"]),
    f"""WITH {S}, a AS (SELECT DISTINCT arm FROM survival), t(time) AS (VALUES {', '.join(f'({float(v)})' for v in TIMES)})
        SELECT a.arm, CAST(t.time AS DOUBLE) AS time, count(CASE WHEN s.time >= t.time THEN 1 END) AS at_risk,
          count(CASE WHEN s.time <= t.time AND event = 1 THEN 1 END) AS events_so_far,
          count(CASE WHEN s.time <= t.time AND event = 0 THEN 1 END) AS censored_so_far
        FROM a CROSS JOIN t JOIN survival s ON s.arm = a.arm GROUP BY ALL""",
)


def logrank_sql(source: str, by: str) -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""ct AS (SELECT {b}time, count(CASE WHEN arm = 0 THEN 1 END) AS m0, count(CASE WHEN arm = 1 THEN 1 END) AS m1,
          sum(CASE WHEN arm = 0 THEN event ELSE 0 END) AS d0, sum(CASE WHEN arm = 1 THEN event ELSE 0 END) AS d1 FROM {source} GROUP BY ALL),
        rk AS (SELECT *, CAST(sum(m0) OVER ({part} ORDER BY time DESC) AS DOUBLE) AS n0, CAST(sum(m1) OVER ({part} ORDER BY time DESC) AS DOUBLE) AS n1 FROM ct),
        lr AS (SELECT {b}sum(d0) AS o0, sum(d1) AS o1, sum((d0 + d1) * n0 / (n0 + n1)) AS e0, sum((d0 + d1) * n1 / (n0 + n1)) AS e1,
          sum(CASE WHEN n0 + n1 > 1 THEN (d0 + d1) * (n1 / (n0 + n1)) * (n0 / (n0 + n1)) * (n0 + n1 - d0 - d1) / (n0 + n1 - 1) ELSE 0 END) AS v
          FROM rk {f'GROUP BY {by}' if by else ''})
        SELECT {b}CAST(o0 AS BIGINT) AS observed_0, CAST(o1 AS BIGINT) AS observed_1, e0 AS expected_0, e1 AS expected_1,
          pow(o1 - e1, 2) / v AS chi_square, 1 AS df, {m.normal_p('(abs(o1 - e1) / sqrt(v))')} AS p FROM lr"""


LR_COLS = digits("expected_0", "expected_1", "chi_square", "p")
E["logrank_two_arms"] = Entry(
    lambda s, d: survival.logrank(x.survival(s, d), time="time", event="event", arm="arm", arms=[0, 1]),
    f"WITH {S}, " + logrank_sql("survival", ""), LR_COLS,
)
E["logrank_per_stratum"] = Entry(
    lambda s, d: survival.logrank(waits(s, d), time="time", event="event", arm="arm", arms=[0, 1], by=["priority"]),
    f"WITH {ORDERS}, " + logrank_sql("waits", "priority"), LR_COLS,
)


def logrank_arms_sql(source: str, arms: list) -> str:
    """Log-rank test of any number of arms: the covariance without the first arm is swept beside the differences."""
    k = len(arms)
    each = lambda text, sep=", ": sep.join(text.format(i=i, a=a) for i, a in enumerate(arms))
    cells = []
    for i in range(1, k):
        row = [f"sum(c * (n{i} / n) * ({'1 - ' if i == j else '-'}n{j} / n))" for j in range(1, k)]
        cells += [*row, f"sum(d{i} - d * n{i} / n)"]
    cells += [f"sum(d{i} - d * n{i} / n)" for i in range(1, k)] + ["0"]
    return f"""ct AS (SELECT time, {each("count(CASE WHEN arm = {a} THEN 1 END) AS m{i}, sum(CASE WHEN arm = {a} THEN event ELSE 0 END) AS d{i}")} FROM {source} GROUP BY time),
        rk AS (SELECT *, {each("CAST(sum(m{i}) OVER (ORDER BY time DESC) AS DOUBLE) AS n{i}")} FROM ct),
        t AS (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END AS c FROM (SELECT *, {each("n{i}", " + ")} AS n, {each("d{i}", " + ")} AS d FROM rk)),
        mat AS (SELECT 0 AS key, 0 AS rid, CAST(0 AS DOUBLE) AS rho, [{", ".join(f"CAST({c} AS DOUBLE)" for c in cells)}] AS a FROM t),
        {m.sweep("swept", "mat", k, k - 1)},
        o AS (SELECT {each("CAST(sum(d{i}) AS BIGINT) AS observed_{a}, sum(d * n{i} / n) AS expected_{a}")} FROM t),
        x2 AS (SELECT -a[{k * k}] AS chi_square, {k - 1} AS df FROM swept WHERE k = {k - 1})
        SELECT o.*, chi_square, df, {m.chi_square_p("chi_square", "df")} AS p FROM o, x2"""


MANY_ARMS = [1, 2, 3, 4, 5]
E["logrank_many_arms"] = Entry(
    lambda s, d: survival.logrank(
        waits(s, d).withColumn("arm", F.substring("priority", 1, 1).cast("int")), time="time", event="event", arm="arm", arms=MANY_ARMS),
    f"WITH RECURSIVE {ORDERS}, five AS (SELECT time, event, CAST(priority[1] AS INTEGER) AS arm FROM waits), " + logrank_arms_sql("five", MANY_ARMS),
    digits("chi_square", "p", *[f"expected_{i}" for i in MANY_ARMS]),
)

E["logrank_three_arms"] = Entry(
    lambda s, d: survival.logrank(
        waits(s, d).withColumn("arm", F.when(F.col("priority") < "2", 0).when(F.col("priority") < "4", 1).otherwise(2)),
        time="time", event="event", arm="arm", arms=[0, 1, 2]).drop("p"),
    f"""WITH {ORDERS}, w AS (SELECT time, event, CASE WHEN priority < '2' THEN 0 WHEN priority < '4' THEN 1 ELSE 2 END AS arm FROM waits),
        ct AS (SELECT time, """ + ", ".join(
        f"count(CASE WHEN arm = {a} THEN 1 END) AS m{a}, sum(CASE WHEN arm = {a} THEN event ELSE 0 END) AS d{a}" for a in range(3)) + """ FROM w GROUP BY time),
        rk AS (SELECT *, """ + ", ".join(f"CAST(sum(m{a}) OVER (ORDER BY time DESC) AS DOUBLE) AS n{a}" for a in range(3)) + """ FROM ct),
        t AS (SELECT *, n0 + n1 + n2 AS n, d0 + d1 + d2 AS d, CASE WHEN n0 + n1 + n2 > 1 THEN (d0 + d1 + d2) * (n0 + n1 + n2 - d0 - d1 - d2) / (n0 + n1 + n2 - 1) ELSE 0 END AS c FROM rk),
        s AS (SELECT """ + ", ".join(f"CAST(sum(d{a}) AS BIGINT) AS observed_{a}, sum(d * n{a} / n) AS expected_{a}" for a in range(3)) + """,
              sum(c * n1 / n * (1 - n1 / n)) AS v11, sum(c * n2 / n * (1 - n2 / n)) AS v22, -sum(c * n1 / n * n2 / n) AS v12 FROM t)
        SELECT observed_0, observed_1, observed_2, expected_0, expected_1, expected_2,
          (pow(observed_1 - expected_1, 2) * v22 - 2 * (observed_1 - expected_1) * (observed_2 - expected_2) * v12
           + pow(observed_2 - expected_2, 2) * v11) / (v11 * v22 - v12 * v12) AS chi_square, 2 AS df FROM s""",
    digits("chi_square", "expected_0", "expected_1", "expected_2"),
)


def newton_cox(source: str, steps: int = 7, by: str = "") -> str:
    """One binary covariate, Efron ties: Newton steps as chained CTEs ending in ``fit``."""
    b, part, join = (f"{by}, ", f"PARTITION BY {by} ", f"USING ({by})") if by else ("", "", "ON true")
    sums = f"""ct AS (SELECT {b}time, count(CASE WHEN arm = 1 THEN 1 END) AS m1, count(CASE WHEN arm = 0 THEN 1 END) AS m0,
            sum(CASE WHEN arm = 1 THEN event ELSE 0 END) AS d1, sum(CASE WHEN arm = 0 THEN event ELSE 0 END) AS d0 FROM {source} GROUP BY {b}time),
        rk AS (SELECT *, sum(m1) OVER ({part}ORDER BY time DESC) AS n1, sum(m0) OVER ({part}ORDER BY time DESC) AS n0 FROM ct),
        ties AS (SELECT {b}d1, d0, CAST(n1 AS DOUBLE) AS n1, CAST(n0 AS DOUBLE) AS n0, l, l / CAST(d1 + d0 AS DOUBLE) AS f
                 FROM rk, LATERAL (SELECT unnest(range(CAST(d1 + d0 AS BIGINT))) AS l)),
        size AS (SELECT {b}CAST(sum(m1 + m0) AS BIGINT) AS n, CAST(sum(d1 + d0) AS BIGINT) AS events FROM ct {f'GROUP BY {by}' if by else ''}),
        b0 AS (SELECT {b}CAST(0 AS DOUBLE) AS b FROM size)"""
    for i in range(steps):
        share = "(exp(b) * (n1 - f * d1) / (n0 - f * d0 + exp(b) * (n1 - f * d1)))"
        sums += f""", s{i} AS (SELECT {b}b, sum(CASE WHEN l = 0 THEN d1 ELSE 0 END) - sum({share}) AS u, sum({share} * (1 - {share})) AS i,
              sum(CASE WHEN l = 0 THEN d1 * b ELSE 0 END) - sum(ln(n0 - f * d0 + exp(b) * (n1 - f * d1))) AS ll FROM ties JOIN b{i} {join} GROUP BY {b}b),
            b{i + 1} AS (SELECT {b}b + u / i AS b FROM s{i})"""
    return sums + f", fit AS (SELECT {b.replace(by, 'z.' + by) if by else ''}z.b, 1 / sqrt(z.i) AS se, z.ll, y.ll AS ll0, n, events FROM s{steps - 1} z JOIN s0 y {join} JOIN size {join})"


COX_COLS = digits("estimate", "std_error", "z", "p", "hr", "hr_low", "hr_high") | digits("loglik", "loglik_null", places=3)
COX_END = ", n, events, false AS diverging, true AS converged FROM fit"
COX_SELECT = f"""SELECT 'arm' AS term, b AS estimate, se AS std_error, b / se AS z, {m.normal_p('(b / se)')} AS p, exp(b) AS hr,
    exp(b - 1.959963984540054 * se) AS hr_low, exp(b + 1.959963984540054 * se) AS hr_high, ll AS loglik, ll0 AS loglik_null FROM fit"""
E["cox_one_covariate"] = Entry(
    lambda s, d: cox(x.survival(s, d), time="time", event="event", terms=["arm"]).select(
        "term", "estimate", "std_error", "z", "p", "hr", "hr_low", "hr_high", "loglik", "loglik_null"),
    f"WITH {S}, {newton_cox('survival')} {COX_SELECT}", COX_COLS,
)
E["cox_distributed_steps"] = Entry(
    lambda s, d: cox(waits(s, d), time="time", event="event", terms=["arm"], local_rows=0).select(
        "term", "estimate", "std_error", "z", "p", "hr", "hr_low", "hr_high", "loglik", "loglik_null"),
    f"WITH {ORDERS}, {newton_cox('waits')} {COX_SELECT}", COX_COLS,
)


def newton_cox_two(steps: int = 8, source: str = "survival", second: str = "M") -> str:
    """Arm and gender, Efron ties: Newton steps in two coefficients ending in ``fit``."""
    cells = [(a, g) for a in (0, 1) for g in (0, 1)]
    tag = lambda a, g: f"{a}{g}"
    counts = ", ".join(
        f"count(CASE WHEN arm = {a} AND man = {g} THEN 1 END) AS m{tag(a, g)}, "
        f"sum(CASE WHEN arm = {a} AND man = {g} THEN event ELSE 0 END) AS d{tag(a, g)}" for a, g in cells)
    risk = ", ".join(f"CAST(sum(m{tag(a, g)}) OVER (ORDER BY time DESC) AS DOUBLE) AS n{tag(a, g)}" for a, g in cells)
    d = " + ".join(f"d{tag(a, g)}" for a, g in cells)
    weight = {c: f"(exp(b1 * {c[0]} + b2 * {c[1]}) * (n{tag(*c)} - f * d{tag(*c)}))" for c in cells}
    total = "(" + " + ".join(weight.values()) + ")"
    text = f"""g AS (SELECT *, CASE WHEN gender = '{second}' THEN 1 ELSE 0 END AS man FROM {source} WHERE gender IS NOT NULL),
        ct AS (SELECT time, {counts} FROM g GROUP BY time), rk AS (SELECT *, {risk} FROM ct),
        ties AS (SELECT *, l / CAST({d} AS DOUBLE) AS f FROM rk, LATERAL (SELECT unnest(range(CAST({d} AS BIGINT))) AS l)),
        size AS (SELECT count(*) AS n, CAST(sum(event) AS BIGINT) AS events FROM g),
        p0 AS (SELECT CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2)"""
    for i in range(steps):
        text += f""", e{i} AS (SELECT *, ({weight[(1, 0)]} + {weight[(1, 1)]}) / {total} AS ea, ({weight[(0, 1)]} + {weight[(1, 1)]}) / {total} AS eg,
              {weight[(1, 1)]} / {total} AS eag, ln({total}) AS lt, CASE WHEN l = 0 THEN d10 + d11 ELSE 0 END AS xa, CASE WHEN l = 0 THEN d01 + d11 ELSE 0 END AS xg FROM ties, p{i}),
            s{i} AS (SELECT b1, b2, sum(xa - ea) AS u1, sum(xg - eg) AS u2, sum(ea * (1 - ea)) AS i11, sum(eg * (1 - eg)) AS i22, sum(eag - ea * eg) AS i12,
              sum(xa * b1 + xg * b2 - lt) AS ll FROM e{i} GROUP BY b1, b2),
            p{i + 1} AS (SELECT b1 + (i22 * u1 - i12 * u2) / (i11 * i22 - i12 * i12) AS b1, b2 + (i11 * u2 - i12 * u1) / (i11 * i22 - i12 * i12) AS b2 FROM s{i})"""
    last = f"s{steps - 1}"
    return text + f""", fit AS (SELECT 'arm' AS term, b1 AS b, sqrt(i22 / (i11 * i22 - i12 * i12)) AS se, ll, (SELECT ll FROM s0) AS ll0, n, events FROM {last}, size
        UNION ALL SELECT 'gender[{second}]', b2, sqrt(i11 / (i11 * i22 - i12 * i12)), ll, (SELECT ll FROM s0), n, events FROM {last}, size)"""


E["cox_two_covariates"] = Entry(
    lambda s, d: cox(x.survival(s, d), time="time", event="event", terms=["arm", "gender"], levels=GENDER).select(
        "term", "estimate", "std_error", "z", "p", "hr", "hr_low", "hr_high", "loglik", "loglik_null"),
    f"WITH {S}, {newton_cox_two()} {COX_SELECT.replace(chr(39) + 'arm' + chr(39) + ' AS term', 'term')}", COX_COLS,
)


def cox_table_sql(tables: str, second: str, adjusted: str) -> str:
    """SQL of the model with the arm alone and of that with gender, over ``survival``."""
    one = f"WITH {newton_cox('survival')} {COX_SELECT.replace(' FROM fit', COX_END)}"
    two = f"WITH {newton_cox_two(second=second)} {COX_SELECT.replace(chr(39) + 'arm' + chr(39) + ' AS term', 'term').replace(' FROM fit', COX_END)}"
    return f"WITH {tables} SELECT 'Unadjusted' AS model, * FROM ({one}) UNION ALL SELECT '{adjusted}', * FROM ({two})"


E["cox_table_two_models"] = Entry(
    lambda s, d: append_labelled({
        "Unadjusted": cox(x.survival(s, d), time="time", event="event", terms=["arm"]),
        "Adjusted": cox(x.survival(s, d), time="time", event="event", terms=["arm", "gender"], levels=GENDER),
    }).drop("steps"), cox_table_sql(S, "M", "Adjusted"), COX_COLS,
)
E["cox_per_stratum"] = Entry(
    lambda s, d: cox(waits(s, d), time="time", event="event", terms=["arm"], by=["priority"]).drop("steps"),
    f"WITH {ORDERS}, {newton_cox('waits', by='priority')} {COX_SELECT.replace(' FROM fit', COX_END).replace('SELECT', 'SELECT priority,', 1)}", COX_COLS,
)


def _hr_label(s, d):
    fit = cox(x.survival(s, d), time="time", event="event", terms=["arm"]).select("hr", "hr_low", "hr_high")
    test = survival.logrank(x.survival(s, d), time="time", event="event", arm="arm", arms=[0, 1])
    return survival.hazard_label(fit.withColumn("p", test.select("p").scalar())).select("label")


E["hazard_ratio_label"] = Entry(
    _hr_label,
    f"WITH {S}, {newton_cox('survival')}, test AS (WITH {logrank_sql('survival', '').replace('ct AS', 'ct2 AS').replace('FROM ct)', 'FROM ct2)').replace('rk AS', 'rk2 AS').replace('FROM rk ', 'FROM rk2 ')}) "
    "SELECT printf('HR = %.2f (95%% CI: %.2f–%.2f)', exp(b), exp(b - 1.959963984540054 * se), exp(b + 1.959963984540054 * se)) || chr(10) || "
    "printf('Log-rank p = %.4f', p) AS label FROM fit, test",
)

# --- penalised logistic --------------------------------------------------------------------
E["firth_one_binary_covariate"] = Entry(
    lambda s, d: firth(x.binary(s, d), response="flag", terms=["arm"]).select("term", "estimate", "std_error"),
    f"""WITH {B}, c AS (SELECT arm, sum(flag) + 0.5 AS e, count(*) - sum(flag) + 0.5 AS f, count(*) AS n FROM binary_rows GROUP BY arm),
        o AS (SELECT arm, ln(e / f) AS b, 1.0 / (n * (e / (e + f)) * (f / (e + f))) AS v FROM c),
        w AS (SELECT max(CASE WHEN arm = 0 THEN b END) AS b0, max(CASE WHEN arm = 1 THEN b END) AS b1,
              max(CASE WHEN arm = 0 THEN v END) AS v0, max(CASE WHEN arm = 1 THEN v END) AS v1 FROM o)
        SELECT '(Intercept)' AS term, b0 AS estimate, sqrt(v0) AS std_error FROM w UNION ALL SELECT 'arm', b1 - b0, sqrt(v0 + v1) FROM w""",
    digits("estimate", "std_error"),
)
FIRTH_COLS = digits("estimate", "std_error", "ci_low", "ci_high", "chi_square", "p", "penalised_loglik", places=5) | digits("odds_ratio", "or_low", "or_high", places=3)


def firth_tables(source: str, tables: str, response: str, models: dict[str, list[str]]) -> str:
    """SQL of odds ratios of several models, with their names."""
    parts, rows = [tables], []
    for k, (name, terms) in enumerate(models.items()):
        known = " AND ".join([f"{response} IN (0, 1)", *[f"{t} IS NOT NULL" for t in terms]])
        parts += m.firth_sql(source, columns=design_columns(terms, {}, intercept=True), where=known, response=response, prefix=f"f{k}")
        rows.append(m.firth_select(f"f{k}", extra=f"'{name}' AS model, ", odds=True))
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(rows)}"


E["firth_odds_ratio_tables"] = Entry(
    lambda s, d: append_labelled({
        "No Covariates": odds_ratios(firth(x.binary(s, d), response="flag", terms=["arm"])),
        "With Covariates": odds_ratios(firth(x.binary(s, d), response="flag", terms=["arm", "days"])),
    }).drop("steps"),
    firth_tables("binary_rows", B, "flag", {"No Covariates": ["arm"], "With Covariates": ["arm", "days"]}), FIRTH_COLS,
)
E["firth_per_stratum"] = Entry(
    lambda s, d: firth(x.binary(s, d), response="flag", terms=["arm"], by=["gender"]).drop("steps"),
    f"WITH RECURSIVE {B}, " + ", ".join(m.firth_sql(
        "binary_rows", columns=design_columns(["arm"], {}, intercept=True), where="arm IS NOT NULL", response="flag", by="gender")) + " " + m.firth_select(by="gender"),
    digits("estimate", "std_error", "ci_low", "ci_high", "chi_square", "p", "penalised_loglik", places=5),
)

# --- repeated measures ---------------------------------------------------------------------
PERIODS = [1, 2, 3, 4, 5]
LEVELS = {"arm": [0, 1], "period": PERIODS, **GENDER}


def _design(s, d):
    cols = design_columns([*crossed("arm", "period"), "days", "gender", ("days", "arm")], LEVELS, intercept=True)
    return x.long(s, d).select("user_id", "period", *[expression(k).alias(f"x{i}") for i, k in enumerate(cols)])


E["model_design_columns"] = Entry(
    _design,
    f"""WITH {L} SELECT user_id, period, 1.0 AS x0, CAST(arm = 1 AS DOUBLE) AS x1, """ + ", ".join(
        f"CAST(period = {p} AS DOUBLE) AS x{i + 2}" for i, p in enumerate(PERIODS[1:])) + ", " + ", ".join(
        f"CAST(arm = 1 AND period = {p} AS DOUBLE) AS x{i + 6}" for i, p in enumerate(PERIODS[1:]))
    + ", days AS x10, CAST(gender = 'M' AS DOUBLE) AS x11, CASE WHEN arm = 1 THEN days ELSE 0 END AS x12 FROM long WHERE arm IS NOT NULL",
    digits(*[f"x{i}" for i in range(13)]),
)


def _products(s, d):
    table, _, _ = cross_products(
        x.long(s, d), y="y", subject="user_id", period="period", period_levels=PERIODS, terms=["arm", "days"], levels=LEVELS)
    return table


E["mmrm_cross_products"] = Entry(
    _products,
    f"""WITH {L}, r AS (SELECT *, lag(period) OVER w AS pp, lag(arm) OVER w AS pa, coalesce(lag(1.0) OVER w, 0) AS p0,
            coalesce(lag(days) OVER w, 0) AS p1, coalesce(lag(y) OVER w, 0) AS p2, 1.0 AS v0, days AS v1, y AS v2
            FROM long WINDOW w AS (PARTITION BY user_id ORDER BY period))
        SELECT CAST(coalesce(period - pp, 0) AS INTEGER) AS gap, CAST(arm + 1 AS INTEGER) AS _f_arm, CAST(coalesce(pa + 1, 0) AS INTEGER) AS _p_f_arm, count(*) AS rows, """
    + ", ".join(f"sum(v{i} * v{j}) AS own_{i}_{j}, sum(p{i} * p{j}) AS prev_{i}_{j}" for i in range(3) for j in range(i, 3)) + ", "
    + ", ".join(f"sum(v{i} * p{j}) AS cross_{i}_{j}" for i in range(3) for j in range(3)) + " FROM r GROUP BY ALL",
    digits(*[f"{k}_{i}_{j}" for i in range(3) for j in range(3) for k in ("own", "prev", "cross") if j >= i or k == "cross"], places=5),
)


def reml(terms, *, by: str = "", contrasts=None) -> str:
    """SQL of ``fit`` with the same terms."""
    tables = m.reml_sql(
        "long", columns=design_columns(terms, LEVELS, intercept=True), levels=LEVELS, variables=variables(terms), y="y", subject="user_id", period="period",
        period_levels=PERIODS, by=by, contrasts=contrasts)
    return f"WITH RECURSIVE {', '.join([L, *tables])} {m.reml_select(by=by)}"


def fit(s, d, terms, *, by=(), contrasts=None):
    return mmrm(x.long(s, d), y="y", subject="user_id", period="period", period_levels=PERIODS, terms=terms, levels=LEVELS,
                by=by, contrasts=contrasts)


MM_COLS = digits("estimate", "std_error", "t", "p", "ci_low", "ci_high", "std_contrast", "std_contrast_corrected", "rho",
                 "sigma", "rms_residual", "reml_loglik", places=5) | digits("df", places=3)


def repeated(terms, **more) -> Entry:
    return Entry(lambda s, d: fit(s, d, terms, **{k: [v] if k == "by" else v for k, v in more.items()}), reml(terms, **more), MM_COLS)


E["mmrm_arm_only"] = repeated(["arm"])
E["mmrm_adjusted"] = repeated(["arm", "period", "days", "gender"])
E["mmrm_with_interaction_and_contrasts"] = repeated(
    [*crossed("arm", "period"), "days", "gender"], contrasts=arm_contrasts("arm", 1, "period", PERIODS))
E["mmrm_number_by_arm"] = repeated([*crossed("arm", "period"), "first_day", ("first_day", "arm"), "baseline"])
E["mmrm_per_stratum"] = repeated(["arm", "period"], by="gender")
