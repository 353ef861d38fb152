"""Registered queries: the whole analyses on a visit table in the study's column layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as x
from catalog import sqlmath
from catalog.comparisons import GCOLS, RANK_FROM, RANK_P, SHARES, g_sql, moments, rank_sql, welch_sql
from catalog.fixtures import Entry, digits
from catalog.models import FIRTH_COLS, KM, LR_COLS, MM_COLS, cox_table_sql, firth_tables, logrank_sql, newton_cox
from catalog.rows import _normal_sql
from twinarm.functions.fixed_values import GENDER_LEVELS, VISIT_CODES
from twinarm.operators.design import design_columns, variables
from twinarm.operators.mmrm import arm_contrasts
from twinarm.plans import ancillary, baseline, change, rare_event, repeated, time_to_event

E: dict[str, Entry] = {}

# The study's visit table as SQL: the first event of every subject and visit slot.
STUDY = x.VISITS + """, study AS (
  SELECT * FROM (SELECT *, CAST(least(floor(day * 19 / 30.0), 18) AS INTEGER) AS slot, round(value % 100, 2) AS pct FROM visits)
  QUALIFY row_number() OVER (PARTITION BY user_id, slot ORDER BY event_id) = 1)"""
PERIOD = "CASE WHEN slot = 0 THEN 1 WHEN slot <= 5 THEN 2 WHEN slot <= 11 THEN 3 WHEN slot <= 16 THEN 4 WHEN slot = 17 THEN 5 ELSE 6 END"
NAMES = "[" + ", ".join(f"'{n}'" for n in VISIT_CODES) + "]"
FRAME = """subjects AS (SELECT user_id, any_value(arm) AS arm, arg_min(day, event_id) FILTER (value > 150) AS days,
    max(CASE WHEN event_type = 'signup' THEN 20 + user_id % 10 END) AS win,
    max(CASE WHEN event_type = 'signup' THEN CASE WHEN user_id % 3 = 0 THEN 'Female' ELSE 'Male' END END) AS gender FROM study GROUP BY user_id),
  survival AS (SELECT * FROM (SELECT arm, gender, CASE WHEN days IS NOT NULL THEN 1 ELSE 0 END AS event,
    CAST(CASE WHEN user_id % 7 = 0 THEN win + 180 ELSE days + 1 END AS DOUBLE) AS time FROM subjects) WHERE time IS NOT NULL)"""
ITEM = {"Cred": "event_type IN ('view', 'click', 'error')", "Exp": "event_type IN ('signup', 'purchase', 'view')"}
ARMS = ["Active", "Control"]
ORDER = {"order_by": ["event_id"]}
CODED = {**ORDER, "arm_codes": x.ARM_CODES}
SUMMARY = digits("percent", "median", "q1", "q3", places=4)



def _said(kind: str, value: str) -> str:
    """What a visit column that events of one kind fill holds for a subject: it is the same on all of them."""
    return f"CASE WHEN bool_or(event_type = '{kind}') THEN {value} END"


def _picked(options: list[str], step: int) -> str:
    """The label that ``fixtures._pick`` takes, NULL where it has no group (None)."""
    listed = ", ".join("NULL" if o is None else "'" + o.replace("'", "''") + "'" for o in options)
    return f"([{listed}])[(user_id * {step} + user_id // 7) % {len(options)} + 1]"


DEMOGRAPHICS = f"""study_people AS (SELECT user_id, CASE WHEN user_id % 2 = 1 THEN 'Active' ELSE 'Control' END AS arm,
    {_said('signup', "CASE WHEN user_id % 3 = 0 THEN 'Female' ELSE 'Male' END")} AS gender, {_said('click', "CASE WHEN user_id % 5 < 2 THEN 'White' END")} AS race,
    CAST(20 + user_id % 45 AS DOUBLE) AS age, {_said('view', _picked(['Heterosexual', 'Gay', 'Bisexual', 'Heterosexual', 'Pansexual', 'Asexual'], 7))} AS orientation,
    {_said('view', _picked(['Single, never married', 'Divorced or Separated', 'Married', 'Widowed'], 11))} AS marital,
    {_said('error', _picked(['Employed', 'Unemployed', 'Retired or disabled', 'Homemaker', 'Student'], 13))} AS employment,
    {_said('error', _picked(['Less than $10,000', '$11,000 - $20,000', '$21,000 - $30,000', '$31,000 - $40,000'], 3))} AS income,
    coalesce({_said('click', 'CASE WHEN user_id % 4 <> 0 THEN ' + _picked(['High school degree', "Associate's degree/vocational training", "Bachelor's degree"], 5) + ' END')},
      CASE WHEN 10 + user_id % 8 < 12 THEN 'Less than a high school degree' WHEN 10 + user_id % 8 = 12 THEN 'High school degree'
        WHEN 10 + user_id % 8 < 16 THEN 'Associate''s degree/vocational training' ELSE 'Bachelor''s degree' END) AS education,
    {_said('purchase', _picked(['Stable housing', 'Stable housing', 'Experiencing homelessness'], 17))} AS housing,
    {_said('signup', "CASE WHEN user_id % 9 = 0 THEN 'Yes' ELSE 'No' END")} AS veteran FROM study GROUP BY user_id)"""
# The first row of the intake visit decides the numbers of use; the other answers are those of any visit.
_FIRST = "arg_min({0}, event_id) FILTER (slot = 0)"
_PCT = _FIRST.format("pct")
_YES = "CASE WHEN {0} THEN 'Yes' ELSE 'No' END"
HISTORY = f"""study_history AS (SELECT * FROM (SELECT user_id, CASE WHEN user_id % 2 = 1 THEN 'Active' ELSE 'Control' END AS arm,
    CASE WHEN {_FIRST.format("CASE WHEN event_type = 'click' THEN value ELSE 0 END")} > 0 THEN 'Smoking' WHEN {_FIRST.format("CASE WHEN event_type = 'view' THEN value ELSE 0 END")} > 0 THEN 'Snorting' END AS route,
    {_said('signup', 'CAST(15 + user_id % 12 AS DOUBLE)')} AS age_first_use, {_said('click', 'CAST(18 + user_id % 15 AS DOUBLE)')} AS age_regular_use,
    {_said('view', 'CASE WHEN user_id % 10 <> 0 THEN CAST(user_id % 6 AS DOUBLE) END')} AS quit_attempts, {_said('error', _picked(['Yes', 'No', 'Yes', 'No'], 1))} AS treatment,
    {_said('purchase', 'CAST(user_id % 200 AS DOUBLE)')} AS quit_longest, {_YES.format(f'{_PCT} > 50')} AS tobacco_daily, {_YES.format(f'{_PCT} > 30')} AS any_heavy_drinking,
    CASE WHEN {_PCT} > 30 THEN {_PCT} END AS heavy_drinking_pct, {_YES.format(f'{_PCT} > 60')} AS any_cannabis, CASE WHEN {_PCT} > 60 THEN {_PCT} END AS cannabis_pct,
    {_YES.format(f'{_PCT} > 90')} AS any_depressant, {_YES.format(f'{_PCT} > 80')} AS any_stimulant, {_YES.format(f'{_PCT} > 95')} AS any_opioid, {_YES.format(f'{_PCT} > 97')} AS any_heroin,
    CASE WHEN user_id IN (3, 8) THEN 'Yes' ELSE 'No' END AS prior_hallucinogen, bool_or(slot = 0) AS came FROM study GROUP BY user_id) WHERE came)"""
E["study_demographics_table"] = Entry(
    lambda s, d: baseline.demographic_table(baseline.demographics(x.study_visits(s, d), arms=ARMS, **ORDER), arms=ARMS),
    f"""WITH RECURSIVE {STUDY}, {DEMOGRAPHICS}, {', '.join(sqlmath.summary_sql(
        'study_people', baseline.demographic_variables(), arm='arm', arms=ARMS, tests=True, rank_sql=rank_sql))} SELECT * FROM summary""",
    {**SUMMARY, **digits("p", places=6)},
)
E["study_use_history_table"] = Entry(
    lambda s, d: baseline.use_history_table(baseline.use_history(x.study_visits(s, d), arms=ARMS, prior_use=[1003, 1008], **ORDER), arms=ARMS),
    f"""WITH RECURSIVE {STUDY}, {HISTORY}, {', '.join(sqlmath.summary_sql(
        'study_history', baseline.use_history_variables(), arm='arm', arms=ARMS, interval='%s (%s-%s)'))} SELECT * FROM summary""",
    SUMMARY,
)


def analysis_rows(s, d):
    visits = x.study_visits(s, d)
    rows = repeated.outcome_rows(visits, **CODED)
    dates = visits.select(F.col("ID_Drug").cast("string").alias("key"), (F.col("ID_Sub") % 400).alias("shift")).distinct().select(
        "key", F.date_add(F.lit("2016-01-01").cast("date"), F.col("shift").cast("int")).alias("index_date"))
    # One row per subject and period: the largest outcome of the period, and what each column of the subject has at most.
    last = rows.groupBy("subject", "period").agg(
        *[F.max(c).alias(c) for c in ("y", "gender", "arm", "days", "baseline")])
    return repeated.with_study_day(last, visits, dates, order_by=["event_id"])


E["study_period_tests"] = Entry(
    lambda s, d: repeated.period_tests(analysis_rows(s, d)),
    f"""WITH {STUDY}, o AS (SELECT user_id, any_value(arm) AS arm, {PERIOD} AS period, max(pct) AS y FROM study GROUP BY user_id, {PERIOD}),
        {welch_sql('o', 'y', 'period')} SELECT * FROM w""",
    digits("mean1", "mean0", "difference", "se", "t", "df", "p", "ci_low", "ci_high"),
)
ANALYSIS = f"""people AS (SELECT user_id, any_value(arm) AS arm, CASE WHEN bool_or(event_type = 'signup') THEN CASE WHEN user_id % 3 = 0 THEN 'Female' ELSE 'Male' END END AS gender,
    CASE WHEN bool_or(event_type = 'click') THEN CAST(30 + user_id % 20 AS DOUBLE) END AS days, max(CASE WHEN slot = 0 THEN pct END) AS baseline,
    user_id % 400 - (SELECT min(user_id % 400) FROM study) + 1 AS study_day FROM study GROUP BY user_id),
  uncentred AS (SELECT user_id, {PERIOD} AS period, max(pct) AS y FROM study GROUP BY ALL),
  analysis AS (SELECT *, study_day - avg(study_day) OVER () AS study_day_c FROM uncentred JOIN people USING (user_id))"""


def repeated_sql() -> str:
    """Every model of the plan over the analysis rows."""
    tables, rows = [], []
    for k, (name, spec) in enumerate(repeated.model_specs().items()):
        levels = {"arm": [0, 1], "period": list(spec["periods"]), "gender": list(GENDER_LEVELS)}
        contrasts = arm_contrasts("arm", 1, "period", levels["period"]) if ("arm", "period") in spec["terms"] else None
        tables += sqlmath.reml_sql(
            "analysis", columns=design_columns(spec["terms"], levels, intercept=True), levels=levels, variables=variables(spec["terms"]), y="y",
            subject="user_id", period="period", period_levels=levels["period"], contrasts=contrasts, prefix=f"f{k}_")
        rows.append(sqlmath.reml_select(f"f{k}_", extra=f"'{name}' AS model, "))
    return f"WITH RECURSIVE {', '.join([STUDY, ANALYSIS, *tables])} {' UNION ALL '.join(rows)}"


E["study_repeated_models"] = Entry(lambda s, d: repeated.fit_models(analysis_rows(s, d)), repeated_sql(), MM_COLS)


def survival_people(s, d):
    return time_to_event.survival_frame(x.study_visits(s, d), **CODED)


E["study_survival_curves"] = Entry(
    lambda s, d: time_to_event.curves(survival_people(s, d)), f"WITH {STUDY}, {FRAME}, " + KM.format(by="arm", source="survival"),
    digits("survival", "std_error", "ci_low", "ci_high"))
E["study_hazard_ratio"] = Entry(
    lambda s, d: time_to_event.annotation(survival_people(s, d)).select("hr", "hr_low", "hr_high"),
    f"""WITH {STUDY}, {FRAME}, {newton_cox('survival')} SELECT exp(b) AS hr, exp(b - 1.959963984540054 * se) AS hr_low,
          exp(b + 1.959963984540054 * se) AS hr_high FROM fit""",
    digits("hr", "hr_low", "hr_high"),
)
E["study_cox_table"] = Entry(
    lambda s, d: time_to_event.cox_table(survival_people(s, d), genders=["Male", "Female"]).drop("steps"),
    cox_table_sql(f"{STUDY}, {FRAME}", "Female", "Adjusted for Gender"),
    digits("estimate", "std_error", "z", "p", "hr", "hr_low", "hr_high", "loglik", "loglik_null"),
)
E["study_penalised_models"] = Entry(
    lambda s, d: rare_event.penalised_models(rare_event.binary_frame(x.study_visits(s, d), **CODED)).drop("steps"),
    firth_tables("rare", f"""{STUDY}, rare AS (SELECT user_id, any_value(arm) AS arm, CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS status,
        max(CASE WHEN event_type = 'signup' THEN CAST(20 + user_id % 10 AS DOUBLE) END) AS Integration FROM study GROUP BY user_id)""",
        "status", {"No Covariates": ["arm"], "With Covariates": ["arm", "Integration"]}),
    FIRTH_COLS,
)
E["study_change_waterfall"] = Entry(
    lambda s, d: change.waterfall(change.change_frame(x.study_visits(s, d), arm_names={1: "Active", 0: "Control"}, **CODED)),
    f"""WITH {STUDY}, c AS (SELECT user_id, any_value(arm) AS arm, arg_min(pct, event_id) FILTER (slot = 0) AS base,
            arg_min(pct, event_id) AS prep, arg_min(pct, event_id) FILTER (event_type = 'purchase') AS post FROM study GROUP BY user_id)
        SELECT CAST(user_id AS INTEGER) AS subject, arm, CASE arm WHEN 1 THEN 'Active' ELSE 'Control' END AS "group",
          CASE arm WHEN 1 THEN 1 ELSE 2 END AS group_order, post - base AS change, post - prep AS prep_change,
          row_number() OVER (ORDER BY post - base DESC, user_id) AS rank FROM c WHERE base IS NOT NULL AND post IS NOT NULL""",
    digits("change", "prep_change"),
)
E["study_observed_days"] = Entry(
    lambda s, d: ancillary.observed_days(x.study_visits(s, d), **CODED),
    f"""WITH {STUDY}, tot AS (SELECT user_id, any_value(arm) AS arm, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN value % 40 END), 0) AS DOUBLE) AS Days_Prescreen,
            CAST(coalesce(sum(CASE WHEN event_type = 'click' THEN value % 30 END), 0) AS DOUBLE) AS Days_Preparation,
            CAST(coalesce(sum(CASE WHEN event_type = 'signup' THEN 20 + user_id % 10 END), 0) AS DOUBLE) AS Days_Integration FROM study GROUP BY 1),
        lg AS (SELECT arm, variable, value FROM tot UNPIVOT (value FOR variable IN (Days_Prescreen, Days_Preparation, Days_Integration))),
        {welch_sql('lg', 'value', 'variable')}, {g_sql('lg', 'value', 'variable')}
        SELECT w.*, sqrt(var1) AS sd1, sqrt(var0) AS sd0, gg.g, gg.ci_low AS g_low, gg.ci_high AS g_high, magnitude
        FROM w JOIN mom USING (variable) JOIN gg USING (variable)""",
    digits("mean1", "mean0", "difference", "se", "t", "df", "p", "ci_low", "ci_high", "sd1", "sd0", "g", "g_low", "g_high"),
)
E["study_scale_tests"] = Entry(
    lambda s, d: ancillary.scale_tests(ancillary.scale_frame(x.study_visits(s, d), arm_codes=x.ARM_CODES)),
    f"WITH {STUDY}, sc AS (" + " UNION ALL ".join(
        f"SELECT arm, '{scale}' AS scale, ({NAMES})[slot + 1] AS visit, round(value % 10, 0) AS score_mean FROM study WHERE {test}"
        for scale, test in ITEM.items()) + f"""), {rank_sql('sc', 'score_mean', 'scale, visit')},
        mo AS ({moments('score_mean', 'sc', 'scale, visit')})
        SELECT scale, visit, mo.n1, mo.n0, mean1, sqrt(var1) AS sd1, mean0, sqrt(var0) AS sd0, w, p, rbc_half, rank_biserial
        FROM mo JOIN r USING (scale, visit)""",
    digits("mean1", "sd1", "mean0", "sd0", "w", "p") | SHARES,
)


def rare_people(s, d):
    return rare_event.binary_frame(x.study_visits(s, d), **CODED)


RARE = f"{STUDY}, rare_events AS (SELECT user_id, any_value(arm) AS arm, CASE WHEN user_id % 7 = 0 THEN 0 ELSE 1 END AS event FROM study GROUP BY user_id)"
E["study_exact_test"] = Entry(
    lambda s, d: rare_event.exact_test(rare_people(s, d)),
    f"""WITH RECURSIVE {RARE}, cells AS (SELECT 0 AS one, count(CASE WHEN arm = 0 AND event = 0 THEN 1 END) AS n00, count(CASE WHEN arm = 0 AND event = 1 THEN 1 END) AS n01,
            count(CASE WHEN arm = 1 AND event = 0 THEN 1 END) AS n10, count(CASE WHEN arm = 1 AND event = 1 THEN 1 END) AS n11 FROM rare_events),
        {', '.join(sqlmath.odds_ratio_sql('cells', 'one'))} SELECT * EXCLUDE (one) FROM odds""",
    digits("p", "odds_ratio", "ci_low", "ci_high"),
)
E["study_event_effect_size"] = Entry(
    lambda s, d: rare_event.effect_size(rare_people(s, d)), f"WITH {RARE}, {g_sql('rare_events', 'event', '')} SELECT * FROM gg", GCOLS,
)
RISK_TIMES = [0, 10, 20, 60, 180]
E["study_risk_table"] = Entry(
    lambda s, d: time_to_event.at_risk(survival_people(s, d), RISK_TIMES),
    f"""WITH {STUDY}, {FRAME}, a AS (SELECT DISTINCT arm FROM survival), t(time) AS (VALUES {', '.join(f'({float(v)})' for v in RISK_TIMES)})
        SELECT a.arm, CAST(t.time AS DOUBLE) AS time, count(CASE WHEN s.time >= t.time THEN 1 END) AS at_risk,
          count(CASE WHEN s.time <= t.time AND event = 1 THEN 1 END) AS events_so_far, count(CASE WHEN s.time <= t.time AND event = 0 THEN 1 END) AS censored_so_far
        FROM a CROSS JOIN t JOIN survival s ON s.arm = a.arm GROUP BY ALL""",
)
E["study_arm_test"] = Entry(
    lambda s, d: time_to_event.arm_test(survival_people(s, d)), f"WITH {STUDY}, {FRAME}, {logrank_sql('survival', '')}", LR_COLS,
)


def dosed_people(s, d):
    return analysis_rows(s, d).select("subject", "arm", "study_day").distinct()


E["study_day_summary"] = Entry(
    lambda s, d: ancillary.study_day_summary(dosed_people(s, d)),
    f"""WITH {STUDY}, {ANALYSIS} SELECT arm, count(*) AS n, count(study_day) AS n_nonnull, avg(study_day) AS mean, stddev_samp(study_day) AS sd, median(study_day) AS median,
          quantile_cont(study_day, 0.75) - quantile_cont(study_day, 0.25) AS iqr FROM people GROUP BY arm""",
    digits("mean", "sd", "median", "iqr"),
)
E["study_day_balance"] = Entry(
    lambda s, d: ancillary.study_day_balance(dosed_people(s, d)).select("test", "difference", "statistic", "p", "smd"),
    f"""WITH RECURSIVE {STUDY}, {ANALYSIS}, dosed AS (SELECT 0 AS one, * FROM people), {welch_sql('dosed', 'study_day', '')}, {rank_sql('dosed', 'study_day', 'one')},
        small AS (SELECT n1 AS m, n0 AS n FROM r WHERE n1 < 50 AND n0 < 50 AND tie_term = 0), {', '.join(sqlmath.rank_counts_sql('small'))}
        SELECT 'Welch t-test' AS test, w.difference, t AS statistic, p, w.difference / sqrt((var1 + var0) / 2) AS smd FROM w, mom
        UNION ALL SELECT 'Wilcoxon rank-sum', NULL, w, {RANK_P}, NULL FROM {RANK_FROM}""",
    digits("difference", "statistic", "p", "smd"),
)
E["study_scale_points"] = Entry(
    lambda s, d: ancillary.scale_plots(ancillary.scale_frame(x.study_visits(s, d), arm_codes=x.ARM_CODES))[0].withColumn("subject", F.col("subject").cast("long")),
    f"WITH {STUDY}, sc AS (" + " UNION ALL ".join(
        f"SELECT user_id AS subject, arm, '{scale}' AS scale, ({NAMES})[slot + 1] AS visit, round(value % 10, 0) AS sample FROM study WHERE {test}"
        for scale, test in ITEM.items()) + f"""),
        ordered AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY scale, visit, arm) AS n FROM sc WHERE sample IS NOT NULL
          WINDOW w AS (PARTITION BY scale, visit, arm ORDER BY sample, subject)),
        points AS (SELECT *, (position - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) AS probability FROM ordered)
        SELECT scale, visit, arm, subject, position, n, probability, theoretical, sample FROM ({_normal_sql('probability')})""",
    digits("probability", "theoretical", "sample"),
)
E["study_prep_change_waterfall"] = Entry(
    lambda s, d: change.waterfall(change.change_frame(x.study_visits(s, d), arm_names={1: "Active", 0: "Control"}, **CODED), "prep_change"),
    E["study_change_waterfall"].sql.replace("ORDER BY post - base DESC, user_id", "ORDER BY post - prep DESC NULLS LAST, user_id"),
    digits("change", "prep_change"),
)
