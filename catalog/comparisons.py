"""Registered queries: two-sample tests, exact tests, effect sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as x
from catalog import sqlmath as m
from catalog.fixtures import Entry, digits
from catalog.rows import SUMMARY_SPEC, _scores
from twinarm.operators import describe, exact, ranks, two_sample
from twinarm.operators.joins import study_day
from twinarm.operators.reshape import to_long

E: dict[str, Entry] = {}
V, P = x.VISITS, x.PEOPLE


def moments(y: str, source: str, by: str) -> str:
    parts = ", ".join(
        f"count(CASE WHEN arm = {a} THEN {y} END) AS n{a}, avg(CASE WHEN arm = {a} THEN {y} END) AS mean{a}, "
        f"var_samp(CASE WHEN arm = {a} THEN {y} END) AS var{a}" for a in (1, 0)
    )
    return f"SELECT {by}{', ' if by else ''}{parts} FROM {source} {'GROUP BY ALL' if by else ''}"


def welch_sql(source: str, y: str, by: str) -> str:
    """CTEs ``mom`` and ``w`` with the Welch quantities."""
    b = f"{by}, " if by else ""
    return f"""mom AS ({moments(y, source, by)}),
        s AS (SELECT *, mean1 - mean0 AS difference, sqrt(var1 / n1 + var0 / n0) AS se,
              pow(var1 / n1 + var0 / n0, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var0 / n0, 2) / (n0 - 1)) AS df FROM mom),
        w AS (SELECT {b}n1, n0, mean1, mean0, difference, se, difference / se AS t, df,
              {m.t_p('(difference / se)', 'df')} AS p, difference - {m.t_point('df')} * se AS ci_low,
              difference + {m.t_point('df')} * se AS ci_high, 'arm1 - arm0' AS direction FROM s)"""


def g_sql(source: str, y: str, by: str) -> str:
    b = f"{by}, " if by else ""
    return f"""gm AS ({moments(y, source, by)}),
        gp AS (SELECT *, sqrt(((n1 - 1) * var1 + (n0 - 1) * var0) / (n1 + n0 - 2)) AS sd_pooled FROM gm),
        gd AS (SELECT *, (mean1 - mean0) / sd_pooled AS cohen_d, (mean1 - mean0) / sd_pooled * (1 - 3.0 / (4 * (n1 + n0) - 9)) AS g FROM gp),
        ge AS (SELECT *, sqrt(((n1 + n0) / (n1 * n0 * 1.0) + 0.5 * g * g / (n1 + n0 - 2)) * ((n1 + n0) / (n1 + n0 - 2.0))) AS gse FROM gd),
        gg AS (SELECT {b}n1, n0, mean1, mean0, sd_pooled, cohen_d, g, gse AS se, g - {m.t_point('(n1 + n0 - 2)')} * gse AS ci_low,
              g + {m.t_point('(n1 + n0 - 2)')} * gse AS ci_high,
              CASE WHEN abs(g) < 0.2 THEN 'negligible' WHEN abs(g) < 0.5 THEN 'small' WHEN abs(g) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude,
              'arm1 - arm0' AS direction FROM ge)"""


def rank_sql(source: str, y: str, by: str, first: int = 1) -> str:
    """CTE ``r`` with the rank-sum quantities; ``by`` may not be empty."""
    return f"""vals AS (SELECT {by}, {y} AS v, count(CASE WHEN arm = {first} THEN 1 END) AS a, count(*) AS t FROM {source}
              WHERE {y} IS NOT NULL AND arm IN (0, 1) GROUP BY ALL),
        mid AS (SELECT *, sum(t) OVER (PARTITION BY {by} ORDER BY v) - t + (t + 1) / 2.0 AS mid FROM vals),
        rs AS (SELECT {by}, CAST(sum(a) AS BIGINT) AS na, CAST(sum(t - a) AS BIGINT) AS nb, CAST(sum(a * mid) AS DOUBLE) AS ra,
              CAST(sum(t * t * t - t) AS DOUBLE) AS tie_term FROM mid GROUP BY ALL),
        rw AS (SELECT *, ra - na * (na + 1) / 2.0 AS w,
              sqrt(na * nb / 12.0 * ((na + nb + 1) - tie_term / ((na + nb) * (na + nb - 1.0)))) AS sigma FROM rs),
        rz AS (SELECT *, (w - na * nb / 2.0 - sign(w - na * nb / 2.0) * 0.5) / sigma AS z FROM rw WHERE na > 0 AND nb > 0),
        r AS (SELECT {by}, {'na AS n1, nb AS n0' if first == 1 else 'nb AS n1, na AS n0'}, w, tie_term, z, {m.normal_p('z')} AS p, w / (CAST(na AS DOUBLE) * nb) - 0.5 AS rbc_half,
              2 * (w / (CAST(na AS DOUBLE) * nb) - 0.5) AS rank_biserial FROM rz)"""


WELCH = digits("mean1", "mean0", "difference", "se", "t", "df", "p", "ci_low", "ci_high")
GCOLS = digits("mean1", "mean0", "sd_pooled", "cohen_d", "g", "se", "ci_low", "ci_high")
# Half-integers over products of small counts end on a 5 often: more places keep ties away from rounding.
SHARES = digits("rbc_half", "rank_biserial", places=9)
RANK = digits("z", "p", "w", "tie_term") | SHARES

E["welch_per_period"] = Entry(
    lambda s, d: two_sample.welch(x.visits(s, d), "y", arm="arm", by=["period"]),
    f"WITH {V}, {welch_sql('visits', 'y', 'period')} SELECT * FROM w", WELCH,
)
E["welch_whole_table"] = Entry(
    lambda s, d: two_sample.welch(study_day_frame(s, d), "study_day", arm="arm"),
    f"""WITH {x.ENTERED}, days AS (SELECT CAST(o_custkey % 2 AS INTEGER) AS arm,
            date_diff('day', (SELECT min(entered) FROM entered), entered) + 1 AS study_day FROM entered),
        {welch_sql('days', 'study_day', '')} SELECT * FROM w""", WELCH,
)
E["rank_sum_per_period"] = Entry(
    lambda s, d: ranks.rank_sum(x.visits(s, d), "y", arm="arm", by=["period"]).drop("method"),
    f"WITH {V}, {rank_sql('visits', 'y', 'period')} SELECT * FROM r", RANK,
)
E["rank_sum_control_first"] = Entry(
    lambda s, d: ranks.rank_sum(x.table(s, d, "lineitem").withColumn("arm", F.when(F.col("l_linestatus") == "F", 1).otherwise(0)),
                                "l_quantity", arm="arm", by=["l_returnflag"], first=0).drop("method"),
    f"""WITH li AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS arm FROM lineitem),
        {rank_sql('li', 'l_quantity', 'l_returnflag', 0)} SELECT * FROM r""", RANK,
)
# The exact p where both arms are below 50 and untied, from the counts of ``sqlmath.rank_counts_sql``.
RANK_FROM = "r LEFT JOIN ways ON n1 = m AND n0 = n AND n1 < 50 AND n0 < 50 AND tie_term = 0"
RANK_P = """CASE WHEN counts IS NULL THEN p ELSE least(1, 2 * CAST(list_sum(CASE WHEN w > n1 * n0 / 2.0 THEN counts[CAST(w AS BIGINT) + 1:]
            ELSE counts[1:CAST(w AS BIGINT) + 1] END) AS DOUBLE) / CAST(list_sum(counts) AS DOUBLE)) END"""
E["rank_sum_exact_small"] = Entry(
    lambda s, d: ranks.rank_sum(x.long(s, d), "y", arm="arm", by=["period"], method="exact_if_small").select("period", "n1", "n0", "w", "p", "method"),
    f"""WITH RECURSIVE {x.LONG}, {rank_sql('long', 'y', 'period')}, small AS (SELECT n1 AS m, n0 AS n FROM r WHERE n1 < 50 AND n0 < 50 AND tie_term = 0),
        {', '.join(m.rank_counts_sql('small'))}
        SELECT period, n1, n0, w, {RANK_P} AS p, CASE WHEN counts IS NULL THEN 'normal' ELSE 'exact' END AS method
        FROM {RANK_FROM}""",
    digits("w", "p"),
)
E["fisher_exact_2x2"] = Entry(
    lambda s, d: exact.fisher_2x2(x.binary(s, d), arm="arm", flag="flag").select("n00", "n01", "n10", "n11", "p"),
    f"""WITH {x.BINARY}, c AS (SELECT count(CASE WHEN arm = 0 AND flag = 0 THEN 1 END) AS n00, count(CASE WHEN arm = 0 AND flag = 1 THEN 1 END) AS n01,
            count(CASE WHEN arm = 1 AND flag = 0 THEN 1 END) AS n10, count(CASE WHEN arm = 1 AND flag = 1 THEN 1 END) AS n11 FROM binary_rows),
        h AS (SELECT c.*, k, {m.log_choose('(n00 + n10)', 'k')} + {m.log_choose('(n01 + n11)', '(n00 + n01 - k)')} AS lp
              FROM c, LATERAL (SELECT unnest(range(greatest(0, n00 - n11), least(n00 + n01, n00 + n10) + 1)) AS k))
        SELECT n00, n01, n10, n11, sum(exp(lp - top)) FILTER (lp <= seen + 1e-7) / sum(exp(lp - top)) AS p
        FROM (SELECT *, max(lp) OVER () AS top, max(CASE WHEN k = n00 THEN lp END) OVER () AS seen FROM h) GROUP BY ALL""",
    digits("p"),
)
E["fisher_exact_odds_ratio"] = Entry(
    lambda s, d: exact.fisher_2x2(x.binary(s, d), arm="arm", flag="flag", by=["gender"]),
    f"""WITH RECURSIVE {x.BINARY}, cells AS (SELECT gender, count(CASE WHEN arm = 0 AND flag = 0 THEN 1 END) AS n00, count(CASE WHEN arm = 0 AND flag = 1 THEN 1 END) AS n01,
            count(CASE WHEN arm = 1 AND flag = 0 THEN 1 END) AS n10, count(CASE WHEN arm = 1 AND flag = 1 THEN 1 END) AS n11 FROM binary_rows GROUP BY gender),
        {', '.join(m.odds_ratio_sql('cells', 'gender'))} SELECT * FROM odds""",
    digits("p", "odds_ratio", "ci_low", "ci_high"),
)
THREE = {"AFRICA": "South", "AMERICA": "West", "ASIA": "East", "EUROPE": "West", "MIDDLE EAST": "East"}


def three_regions(s, d):
    from twinarm.functions.columns import recode

    return x.people(s, d).withColumn("part", recode("region", THREE))


E["exact_test_three_levels"] = Entry(
    lambda s, d: exact.fisher_levels(three_regions(s, d), level="part", arm="arm"),
    f"""WITH {P}, q AS (SELECT CASE WHEN region = 'AFRICA' THEN 'South' WHEN region IN ('AMERICA', 'EUROPE') THEN 'West' ELSE 'East' END AS part, arm FROM cohort),
        t AS (SELECT count(CASE WHEN part = 'South' THEN 1 END) AS r1, count(CASE WHEN part = 'West' THEN 1 END) AS r2, count(CASE WHEN part = 'East' THEN 1 END) AS r3,
              count(CASE WHEN part = 'South' AND arm = 1 THEN 1 END) AS o1, count(CASE WHEN part = 'West' AND arm = 1 THEN 1 END) AS o2,
              count(CASE WHEN part = 'East' AND arm = 1 THEN 1 END) AS o3 FROM q),
        f AS (SELECT t.*, a, b, {m.log_choose('r1', 'a')} + {m.log_choose('r2', 'b')} + {m.log_choose('r3', '(o1 + o2 + o3 - a - b)')}
                 - {m.log_choose('(r1 + r2 + r3)', '(o1 + o2 + o3)')} AS lp,
              {m.log_choose('r1', 'o1')} + {m.log_choose('r2', 'o2')} + {m.log_choose('r3', 'o3')} - {m.log_choose('(r1 + r2 + r3)', '(o1 + o2 + o3)')} AS seen
              FROM t, LATERAL (SELECT unnest(range(0, least(r1, o1 + o2 + o3) + 1)) AS a), LATERAL (SELECT unnest(range(0, least(r2, o1 + o2 + o3) + 1)) AS b)
              WHERE o1 + o2 + o3 - a - b BETWEEN 0 AND r3)
        SELECT 3 AS levels, any_value(r1 + r2 + r3) AS n, 'exact' AS method, sum(exp(lp)) FILTER (lp <= seen + 1e-7) AS p FROM f""",
    digits("p"),
)
E["exact_test_many_levels"] = Entry(
    lambda s, d: exact.fisher_levels(x.people(s, d), level="segment", arm="arm", by=["region"]),
    f"""WITH RECURSIVE {P}, counted AS (SELECT region, segment, count(*) AS n, sum(arm) AS a FROM cohort WHERE segment IS NOT NULL GROUP BY ALL),
        {', '.join(m.levels_sql('counted', 'region'))} SELECT * FROM x_p""",
    digits("p"),
)
E["hedges_g_per_period"] = Entry(
    lambda s, d: two_sample.hedges_g(x.visits(s, d), "y", arm="arm", by=["period"]),
    f"WITH {V}, {g_sql('visits', 'y', 'period')} SELECT * FROM gg", GCOLS,
)
E["hedges_g_binary"] = Entry(
    lambda s, d: two_sample.hedges_g(x.binary(s, d), "flag", arm="arm"),
    f"WITH {x.BINARY}, {g_sql('binary_rows', 'flag', '')} SELECT * FROM gg", GCOLS,
)


def study_day_frame(s, d):
    return study_day(x.entry_dates(s, d), "entered").withColumn("arm", (F.col("o_custkey") % 2).cast("int"))


DAYS = x.ENTERED + """, days AS (SELECT 0 AS one, CAST(o_custkey % 2 AS INTEGER) AS arm,
    date_diff('day', (SELECT min(entered) FROM entered), entered) + 1 AS study_day FROM entered)"""
E["standardised_difference"] = Entry(
    lambda s, d: two_sample.standardised_difference(study_day_frame(s, d), "study_day", arm="arm"),
    f"WITH {DAYS}, mm AS ({moments('study_day', 'days', '')}) SELECT n1, n0, mean1 - mean0 AS difference, (mean1 - mean0) / sqrt((var1 + var0) / 2) AS smd FROM mm",
    digits("difference", "smd"),
)
E["balance_table"] = Entry(
    lambda s, d: two_sample.balance_tests(study_day_frame(s, d), "study_day", arm="arm").drop("method"),
    f"""WITH {DAYS}, {welch_sql('days', 'study_day', '')}, {rank_sql('days', 'study_day', 'one')}
        SELECT 'Welch t-test' AS test, w.difference, t AS statistic, p, w.difference / sqrt((var1 + var0) / 2) AS smd FROM w, mom
        UNION ALL SELECT 'Wilcoxon rank-sum', NULL, w, p, NULL FROM r""",
    digits("difference", "statistic", "p", "smd"),
)
E["rank_biserial_whole_table"] = Entry(
    lambda s, d: ranks.rank_sum(study_day_frame(s, d), "study_day", arm="arm").select("w", "rbc_half", "rank_biserial"),
    f"WITH {DAYS}, {rank_sql('days', 'study_day', 'one')} SELECT w, rbc_half, rank_biserial FROM r",
    digits("w") | SHARES,
)
E["scale_comparison"] = Entry(
    lambda s, d: two_sample.compare_scales(
        _scores(s, d).withColumn("stratum", F.concat_ws("/", "scale", "period")), score="score_mean", arm="arm", by=["stratum"]),
    f"""WITH {x.SCORES}, sc AS (SELECT *, concat(scale, '/', period) AS stratum FROM scores), {rank_sql('sc', 'score_mean', 'stratum')},
        mo AS ({moments('score_mean', 'sc', 'stratum')})
        SELECT stratum, mo.n1, mo.n0, mean1, sqrt(var1) AS sd1, mean0, sqrt(var0) AS sd0, w, p, rbc_half, rank_biserial
        FROM mo JOIN r USING (stratum)""",
    digits("mean1", "sd1", "mean0", "sd0", "w", "p") | SHARES,
)
TOTALS = {"Days_Prescreen": "a", "Days_Preparation": "b", "Days_Integration": "c"}


def day_windows(s, d):
    v = x.visits(s, d)
    said = lambda k: F.when(F.col("event_type") == k, F.col("value") % 30)
    return v.select("user_id", "arm", said("view").alias("a"), said("click").alias("b"), said("error").alias("c"))


E["day_totals_comparison"] = Entry(
    lambda s, d: two_sample.compare_totals(
        day_windows(s, d), x.visits(s, d).select("user_id", "arm").distinct(), subject="user_id", arm="arm", columns=TOTALS),
    f"""WITH {V}, tot AS (SELECT user_id, any_value(arm) AS arm, coalesce(sum(CASE WHEN event_type = 'view' THEN value % 30 END), 0) AS Days_Prescreen,
            coalesce(sum(CASE WHEN event_type = 'click' THEN value % 30 END), 0) AS Days_Preparation,
            coalesce(sum(CASE WHEN event_type = 'error' THEN value % 30 END), 0) AS Days_Integration FROM visits GROUP BY 1),
        lg AS (SELECT arm, variable, value FROM tot UNPIVOT (value FOR variable IN (Days_Prescreen, Days_Preparation, Days_Integration))),
        {welch_sql('lg', 'value', 'variable')}, {g_sql('lg', 'value', 'variable')}
        SELECT w.*, sqrt(var1) AS sd1, sqrt(var0) AS sd0, gg.g, gg.ci_low AS g_low, gg.ci_high AS g_high, magnitude
        FROM w JOIN mom USING (variable) JOIN gg USING (variable)""",
    {**WELCH, **digits("sd1", "sd0", "g", "g_low", "g_high")},
)
E["summary_table_p_values"] = Entry(
    lambda s, d: describe.summary_tests(
        three_regions(s, d), {"part": describe.Categorical(("East", "South", "West")), "balance": describe.Continuous()}, arm="arm", arms=[1, 0]
    ).select("variable", "p"),
    "WITH exact_part AS (SELECT p FROM (" + E["exact_test_three_levels"].sql + f""")), {P}, one AS (SELECT 0 AS one, * FROM cohort), {rank_sql('one', 'balance', 'one')}
        SELECT 'part' AS variable, p FROM exact_part UNION ALL SELECT 'balance', p FROM r""",
    digits("p"),
)
E["summary_table_with_tests"] = Entry(
    lambda s, d: describe.summary_table(x.people(s, d), SUMMARY_SPEC, arm="arm", arms=[1, 0], tests=True),
    f"WITH RECURSIVE {P}, {', '.join(m.summary_sql('cohort', SUMMARY_SPEC, arm='arm', arms=[1, 0], tests=True, rank_sql=rank_sql))} SELECT * FROM summary",
    digits("percent", "median", "q1", "q3", "p"),
)
E["welch_many_strata"] = Entry(
    lambda s, d: two_sample.welch_statistic(
        to_long(
            x.table(s, d, "lineitem").withColumn("arm", F.when(F.col("l_linestatus") == "F", 1).otherwise(0)),
            ids=["l_suppkey", "arm"], columns=["l_quantity", "l_extendedprice", "l_discount"]),
        "value", arm="arm", by=["l_suppkey", "variable"]).select("l_suppkey", "variable", "n1", "n0", "difference", "t", "df"),
    f"""WITH li AS (SELECT l_suppkey, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS arm, variable, value FROM lineitem
            UNPIVOT (value FOR variable IN (l_quantity, l_extendedprice, l_discount))),
        mm AS ({moments('value', 'li', 'l_suppkey, variable')}),
        s AS (SELECT *, mean1 - mean0 AS difference, sqrt(var1 / n1 + var0 / n0) AS se FROM mm)
        SELECT l_suppkey, variable, n1, n0, difference, difference / se AS t,
          pow(se, 4) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var0 / n0, 2) / (n0 - 1)) AS df FROM s""",
    digits("difference", "t", "df", places=4),
)
