"""Cohort tables derived from the driver's tables, in Spark and as SQL.

The driver's tables have no arms, visits or censoring. Fixed expressions on whole
tables supply them, the same on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinarm.functions.fixed_values import VISIT_CODES
from twinarm.operators.sequence import first_row

ARMS = {"1": "Active", "0": "Control"}
ARM_CODES = {"Active": 1, "Control": 0}


@dataclass(frozen=True)
class Entry:
    """A registered query, its SQL counterpart and the columns rounded on both sides."""

    run: object
    sql: str | None = None
    rounded: dict[str, int] = field(default_factory=dict)


def digits(*names: str, places: int = 6) -> dict[str, int]:
    return {n: places for n in names}


# Means of cents over 8 or 16 rows end exactly on a 5, where the last bit decides the rounding. Both
# sides are moved off such ties by the same few parts in 1e11 before they are rounded.
OFF_TIES = 1.00000000003


def rounded_frame(df: DataFrame, places: dict[str, int]) -> DataFrame:
    if not places:
        return df
    return df.withColumns({c: F.round(F.col(c).cast("double") * OFF_TIES, d) + 0.0 for c, d in places.items()})


def rounded_sql(sql: str, places: dict[str, int]) -> str:
    if not places:
        return sql
    swaps = ", ".join(f"round(CAST({c} AS DOUBLE) * {OFF_TIES!r}e0, {d}) + 0.0 AS {c}" for c, d in places.items())
    return f"SELECT * REPLACE ({swaps}) FROM ({sql}) AS answer"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Subject rows over time: outcome missing on error rows, gender noted at sign-up only.
def visits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    sex = F.when(F.col("user_id") % 3 == 0, "F").otherwise("M")
    return e.select(
        "event_id", "user_id", "event_type", "value", (F.col("user_id") % 2).cast("int").alias("arm"),
        (F.floor((F.dayofmonth("ts") - 1) / 7) + 1).cast("int").alias("period"),
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day"),
        F.when(F.col("event_type") == "signup", sex).alias("gender"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("y"),
    )


VISITS = """visits AS (
  SELECT event_id, user_id, event_type, value, CAST(user_id % 2 AS INTEGER) AS arm,
         CAST(floor((day(ts) - 1) / 7.0) + 1 AS INTEGER) AS period,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
         CASE WHEN event_type = 'signup' THEN CASE WHEN user_id % 3 = 0 THEN 'F' ELSE 'M' END END AS gender,
         CASE WHEN event_type <> 'error' THEN value END AS y
  FROM events)"""


# One row per subject and week: mean of the larger purchases, so weeks without any are gaps.
def long(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf)
    big = (F.col("event_type") == "purchase") & (F.col("value") > 20)
    weeks = v.where(big).groupBy("user_id", "arm", "period").agg(F.avg("value").alias("y"))
    people = v.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("days"), F.max("gender").alias("gender"),
        F.avg(F.when(F.col("period") == 1, F.col("value"))).alias("baseline"), F.min("day").alias("first_day"),
    )
    return weeks.join(people, "user_id")


LONG = VISITS + """, weeks AS (
  SELECT user_id, arm, period, avg(value) AS y FROM visits
  WHERE event_type = 'purchase' AND value > 20 GROUP BY ALL),
people AS (
  SELECT user_id, CAST(count(*) AS DOUBLE) AS days, max(gender) AS gender,
         avg(CASE WHEN period = 1 THEN value END) AS baseline, min(day) AS first_day
  FROM visits GROUP BY user_id),
long AS (SELECT * FROM weeks JOIN people USING (user_id))"""


# Day of a subject's first large value, else censored at day 30.
def survival(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf)
    return v.groupBy("user_id", "arm").agg(
        F.coalesce(F.min(F.when(F.col("value") > 200, F.col("day"))), F.lit(30)).cast("double").alias("time"),
        F.max(F.when(F.col("value") > 200, 1).otherwise(0)).alias("event"),
        F.max("gender").alias("gender"), F.count(F.lit(1)).cast("double").alias("days"),
    )


SURVIVAL = VISITS + """, survival AS (
  SELECT user_id, arm, CAST(coalesce(min(CASE WHEN value > 200 THEN day END), 30) AS DOUBLE) AS time,
         max(CASE WHEN value > 200 THEN 1 ELSE 0 END) AS event, max(gender) AS gender,
         CAST(count(*) AS DOUBLE) AS days
  FROM visits GROUP BY user_id, arm)"""


# A rare flag per subject: any very large value.
def binary(spark: SparkSession, sf: str) -> DataFrame:
    return visits(spark, sf).groupBy("user_id", "arm").agg(
        F.max(F.when(F.col("value") > 300, 1).otherwise(0)).alias("flag"),
        F.count(F.lit(1)).cast("double").alias("days"), F.max("gender").alias("gender"),
    )


BINARY = VISITS + """, binary_rows AS (
  SELECT user_id, arm, max(CASE WHEN value > 300 THEN 1 ELSE 0 END) AS flag,
         CAST(count(*) AS DOUBLE) AS days, max(gender) AS gender
  FROM visits GROUP BY user_id, arm)"""


# Customers with region; a negative balance counts as unknown.
def people(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        "c_custkey", (F.col("c_custkey") % 2).cast("int").alias("arm"), F.col("r_name").alias("region"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_acctbal") > 5000, "Yes").otherwise("No").alias("rich"),
    )


PEOPLE = """cohort AS (
  SELECT c_custkey, CAST(c_custkey % 2 AS INTEGER) AS arm, r_name AS region,
         CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
         CASE WHEN c_acctbal > 5000 THEN 'Yes' ELSE 'No' END AS rich
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# Wide instrument items per subject and week.
ITEM_COLUMNS = [f"SC_{s}{i}" for s in ("Low", "High") for i in (1, 2, 3)]
ITEM_PATTERN = "SC_(Low|High)([123])"


def items(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf)
    cells = []
    for scale, side in (("Low", F.col("value") <= 35), ("High", F.col("value") > 35)):
        for i, kind in enumerate(("view", "click", "purchase"), 1):
            cells.append(F.avg(F.when(side & (F.col("event_type") == kind), F.col("value"))).alias(f"SC_{scale}{i}"))
    return v.groupBy("user_id", "arm", "period").agg(*cells)


ITEMS = VISITS + ", items AS (SELECT user_id, arm, period, " + ", ".join(
    f"avg(CASE WHEN value {op} 35 AND event_type = '{kind}' THEN value END) AS SC_{scale}{i}"
    for scale, op in (("Low", "<="), ("High", ">")) for i, kind in enumerate(("view", "click", "purchase"), 1)
) + " FROM visits GROUP BY ALL)"

SCORES = ITEMS + """, scores AS (
  SELECT user_id, arm, period, scale, avg(score) AS score_mean FROM (
    SELECT user_id, arm, period, regexp_extract(item, 'SC_(Low|High)([123])', 1) AS scale, score
    FROM items UNPIVOT (score FOR item IN (SC_Low1, SC_Low2, SC_Low3, SC_High1, SC_High2, SC_High3)))
  GROUP BY ALL HAVING avg(score) IS NOT NULL)"""


# First order date per customer, as the day a subject entered.
def entry_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("entered"))


ENTERED = "entered AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS entered FROM orders GROUP BY o_custkey)"


# First and last week of each subject.
def change(spark: SparkSession, sf: str) -> DataFrame:
    rows = long(spark, sf)
    return rows.groupBy("user_id", "arm").agg(
        (F.max_by("y", "period") - F.min_by("y", "period")).alias("change"),
        (F.max_by("y", "period") - F.max(F.when(F.col("period") == 2, F.col("y")))).alias("prep_change"),
    )


CHANGE = LONG + """, changes AS (
  SELECT user_id, arm, arg_max(y, period) - arg_min(y, period) AS change,
         arg_max(y, period) - max(CASE WHEN period = 2 THEN y END) AS prep_change
  FROM long GROUP BY user_id, arm)"""


# A subject-by-visit table in the study's own column layout, every row from one event.
def study_visits(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf)
    names = F.array(*[F.lit(n) for n in VISIT_CODES])
    slot = F.least(F.floor(F.col("day") * 19 / 30), F.lit(18)).cast("int")
    pct = F.round(F.col("value") % 100, 2)
    user = F.col("user_id")
    v = first_row(v.withColumns({"slot": slot, "pct": pct}), subject=["user_id", "slot"], order_by=["event_id"])
    said = lambda kind, c: F.when(F.col("event_type") == kind, c)
    return v.select(
        "event_id", user.cast("int").alias("ID_Sub"), (user + 1000).cast("int").alias("ID_Drug"),
        F.when(user % 2 == 1, "Active").otherwise("Control").alias("Condition"), names[F.col("slot")].alias("Time"),
        said("signup", F.when(user % 3 == 0, "Female").otherwise("Male")).alias("Gender"),
        said("click", F.when(user % 5 < 2, "Caucasian/White").otherwise("Other label")).alias("Race"),
        F.lit(None).cast("string").alias("Ethnicity"),
        (20 + user % 45).cast("double").alias("Age"),
        said("view", _pick(user, ["Heterosexual", "Homosexual/Gay/Lesbian", "Bisexual", "none", "Pansexual", "Asexual"], 7)).alias("SexOr"),
        said("view", _pick(user, ["Single, never married", "Divorced or Separated", "Married", "Widowed"], 11)).alias("Marital"),
        said("error", _pick(user, ["Employed", "Unemployed", "Retired", "Full-time homemaker", "Student (not employed)"], 13)).alias("OccStatus"),
        said("error", _pick(user, ["Less than $10,000", "$11,000 - $20,000", "$21,000 - $30,000", "$31,000 - $40,000"], 3)).alias("Income"),
        said("click", F.when(user % 4 != 0, _pick(user, ["High School, GED", "A.A., A.S., Other Vocational Program", "B.A., B.S., Etc."], 5))).alias("Degree"),
        (10 + user % 8).cast("int").alias("EduYears"),
        said("purchase", _pick(user, ["House or Apartment (you own or rent)", "House or Apartment of friend or relative",
                                      "Homeless (streets, shelter, car, no stable arrangement)"], 17)).alias("LivSit"),
        said("signup", F.when(user % 9 == 0, "Yes").otherwise("No")).alias("Veteran"),
        said("click", F.col("value")).alias("Days_Crack"), said("view", F.col("value")).alias("Days_Cocaine"),
        said("signup", (15 + user % 12).cast("string")).alias("Age_First_Use"),
        said("click", (18 + user % 15).cast("string")).alias("Age_Reg_Use"),
        said("view", F.when(user % 10 == 0, "many").otherwise((user % 6).cast("string"))).alias("Quit_Attempts"),
        said("purchase", (user % 200).cast("string")).alias("Quit_Long"),
        said("error", _pick(user, ["1", "0", "Yes", "No"], 1)).alias("Treatment"),
        F.when(pct > 50, 100.0).otherwise(pct).alias("Per_Tob"), F.when(pct > 30, pct).otherwise(0.0).alias("Per_Heavy_GenSpec"),
        F.when(pct > 60, pct).otherwise(0.0).alias("Per_Can"), F.when(pct > 90, pct).otherwise(0.0).alias("Per_Dep"),
        F.when(pct > 80, pct).alias("Per_Stim"), F.when(pct > 95, pct).otherwise(0.0).alias("Per_Opi"),
        F.when(pct > 97, pct).otherwise(0.0).alias("Per_Her"),
        F.when(F.col("slot") == 0, pct).alias("AB_Per_PreContact"),
        *[pct.alias(c) for c in ("AB_Per_PreTX", "AB_Per_Preps", "AB_Per_PostDrugTX", "AB_Per_Follow_Ups")],
        said("purchase", pct).alias("AB_Per_DA_to_180"), said("click", (30 + user % 20).cast("double")).alias("days_under_obs"),
        F.when(F.col("value") > 150, F.col("day").cast("double")).alias("DAYS"),
        F.when(user % 7 == 0, 1).otherwise(0).alias("STATUS"),
        said("view", (F.col("value") % 40)).alias("Prescreen"), said("click", F.col("value") % 30).alias("Preparation"),
        said("error", F.col("value") % 20).alias("Drug"), said("signup", (20 + user % 10).cast("double")).alias("Integration"),
        *[said(kind, F.round(F.col("value") % 10, 0)).alias(c) for c, kind in (
            ("CQ_Cred1", "view"), ("CQ_Cred2", "click"), ("CQ_Cred3", "error"),
            ("CQ_Exp1", "signup"), ("CQ_Exp2", "purchase"), ("CQ_Exp3", "view"))],
    )


def _pick(key, options: list[str], step: int):
    return F.array(*[F.lit(o) for o in options])[((key * step + F.floor(key / 7)) % len(options)).cast("int")]
