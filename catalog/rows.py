"""Registered queries: recodes, joins, sequence, aggregation, reshape, ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import fixtures as x
from catalog.fixtures import Entry, digits
from twinarm.functions import columns as c
from twinarm.operators import describe, joins, ranks, reshape, sequence
from twinarm.session import shared_folder
from twinarm.sources import sinks, tables

E: dict[str, Entry] = {}
V, L, P = x.VISITS, x.LONG, x.PEOPLE
KINDS = {"signup": 1, "view": 2, "click": 3, "purchase": 4}
KIND_CASE = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END"

# --- sources -------------------------------------------------------------------------------
E["source_label_decode"] = Entry(
    lambda s, d: tables.decode_labels(
        x.table(s, d, "labels"), {"quality": {0: "low", 1: "high"}, "toxic": {1: "toxic"}}
    ).groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")),
    """SELECT CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS quality,
              CASE toxic WHEN 1 THEN 'toxic' ELSE CAST(toxic AS VARCHAR) END AS toxic, count(*) AS n
       FROM labels GROUP BY ALL""",
)


def _csv_copy(s, d):
    """Customers written as CSV beside the checkpoints and read back with a declared schema."""
    path = f"{shared_folder(s)}/csv-{uuid.uuid4().hex}"
    sinks.save_table(x.people(s, d).select("c_custkey", "region", "segment", "balance"), path, fmt="csv")
    return tables.load_long(s, path, schema="c_custkey bigint, region string, segment string, balance double")


E["source_csv_round_trip"] = Entry(
    _csv_copy, f"WITH {P} SELECT c_custkey, region, segment, balance FROM cohort", digits("balance"),
)


def _overrides(s, d):
    people = x.people(s, d)
    known = x.table(s, d, "orders").where(F.col("o_totalprice") > 490000).groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("override_value")
    ).withColumnRenamed("o_custkey", "c_custkey")
    return tables.apply_overrides(
        people, known, key=["c_custkey"], out="amount", rules=[(F.col("rich") == "Yes", F.col("balance") * 2)],
        default=F.col("balance"), position=1,
    ).select("c_custkey", "rich", "amount")


E["source_override_table"] = Entry(
    _overrides,
    f"""WITH {P}, known AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_totalprice > 490000 GROUP BY 1)
        SELECT c_custkey, rich, CASE WHEN rich = 'Yes' THEN balance * 2 WHEN o_custkey IS NOT NULL THEN v ELSE balance END AS amount
        FROM cohort LEFT JOIN known ON c_custkey = o_custkey""",
    digits("amount"),
)

# --- recodes -------------------------------------------------------------------------------
E["recode_visit_and_period"] = Entry(
    lambda s, d: x.visits(s, d).withColumn("code", c.recode("event_type", KINDS)).withColumn(
        "phase", c.band("day", [(0, 0, 1), (1, 6, 2), (7, 12, 3), (13, 20, 4), (21, 28, 5)])
    ).groupBy("code", "phase").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {V} SELECT {KIND_CASE} AS code,
          CASE WHEN day = 0 THEN 1 WHEN day BETWEEN 1 AND 6 THEN 2 WHEN day BETWEEN 7 AND 12 THEN 3
               WHEN day BETWEEN 13 AND 20 THEN 4 WHEN day BETWEEN 21 AND 28 THEN 5 END AS phase, count(*) AS n
        FROM visits GROUP BY ALL""",
)
E["recode_outcome_by_period"] = Entry(
    lambda s, d: x.visits(s, d).select(
        "event_id", "period", c.pick_by("period", {1: "value", 2: "y", (3, 4): F.col("day").cast("double")}).alias("outcome")
    ),
    f"WITH {V} SELECT event_id, period, CASE WHEN period = 1 THEN value WHEN period = 2 THEN y WHEN period IN (3, 4) THEN CAST(day AS DOUBLE) END AS outcome FROM visits",
    digits("outcome"),
)
E["recode_arm_and_factor_levels"] = Entry(
    lambda s, d: x.people(s, d).select(
        "c_custkey", c.recode("arm", x.ARMS).alias("arm_name"), c.keep_levels("segment", ["BUILDING", "HOUSEHOLD", "MACHINERY"]).alias("kept"),
        c.level_position("segment", ["BUILDING", "HOUSEHOLD", "MACHINERY"]).alias("kept_ord"),
    ),
    f"""WITH {P} SELECT c_custkey, CASE arm WHEN 1 THEN 'Active' WHEN 0 THEN 'Control' END AS arm_name,
          CASE WHEN segment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN segment END AS kept,
          CASE segment WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 2 WHEN 'MACHINERY' THEN 3 END AS kept_ord FROM cohort""",
)
E["recode_collapse_with_fallback"] = Entry(
    lambda s, d: x.people(s, d).select(
        "c_custkey", c.recode("region", {"ASIA": "East", "AFRICA": "South"}, "Other").alias("part"),
        c.collapse_with_bands("segment", {"BUILDING": "trade", "MACHINERY": "trade", "FURNITURE": "home"}, "c_custkey",
                              [(None, 99, "early"), (100, 499, "middle"), (500, None, "late")]).alias("grp"),
    ),
    f"""WITH {P} SELECT c_custkey, CASE region WHEN 'ASIA' THEN 'East' WHEN 'AFRICA' THEN 'South' ELSE 'Other' END AS part,
          CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'trade' WHEN segment = 'FURNITURE' THEN 'home'
               WHEN segment IS NULL AND c_custkey <= 99 THEN 'early' WHEN segment IS NULL AND c_custkey <= 499 THEN 'middle'
               WHEN segment IS NULL THEN 'late' END AS grp FROM cohort""",
)
E["recode_mixed_coding"] = Entry(
    lambda s, d: x.table(s, d, "orders").select(
        "o_orderkey", c.recode("o_orderstatus", {"F": "Yes", "1": "Yes", "O": "No", "0": "No"}).alias("done"),
        c.to_number(F.split("o_orderpriority", "-")[0]).alias("urgency"), c.to_number("o_orderpriority").alias("no_number"),
        c.is_in("o_orderstatus", ["P"]).alias("open"),
    ),
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' END AS done,
              TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS urgency, TRY_CAST(o_orderpriority AS DOUBLE) AS no_number,
              o_orderstatus = 'P' AS open FROM orders""",
)


def _use_flags(s, d):
    p = x.visits(s, d).groupBy("user_id").agg(
        F.sum(F.when(F.col("event_type") == "click", F.when(F.col("value") > 150, 1).otherwise(0))).alias("a"),
        F.sum(F.when(F.col("event_type") == "view", F.when(F.col("value") > 150, 1).otherwise(0))).alias("b"),
    )
    return p.select(
        "user_id", c.two_flags("a", "b", "Both", "First", "Second").alias("route"), c.any_use("a").alias("any_a"),
        c.exactly("b", 1).alias("one_b"), c.among_users("a").alias("a_users"), c.yes_no(c.any_use("b")).alias("b_text"),
    )


E["flags_of_use"] = Entry(
    _use_flags,
    f"""WITH {V}, p AS (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN CASE WHEN value > 150 THEN 1 ELSE 0 END END) AS a,
            sum(CASE WHEN event_type = 'view' THEN CASE WHEN value > 150 THEN 1 ELSE 0 END END) AS b FROM visits GROUP BY 1)
        SELECT user_id, CASE WHEN a > 0 AND b > 0 THEN 'Both' WHEN a > 0 THEN 'First' WHEN b > 0 THEN 'Second' END AS route,
               coalesce(a > 0, false) AS any_a, coalesce(b = 1, false) AS one_b, CAST(CASE WHEN a > 0 THEN a END AS BIGINT) AS a_users,
               CASE WHEN b > 0 THEN 'Yes' ELSE 'No' END AS b_text FROM p""",
)


def _events_and_times(s, d):
    from twinarm.operators.survival import follow_up_time

    p = x.visits(s, d).groupBy("user_id").agg(
        F.min(F.when(F.col("value") > 200, F.col("day").cast("double"))).alias("days"), F.max("day").cast("double").alias("window"),
        F.max(F.when(F.col("value") > 250, 0).otherwise(1)).alias("any_low"), F.min(F.when(F.col("value") > 250, 0).otherwise(1)).alias("status"),
    )
    exceptions = p.where("window < 29").select("user_id", F.lit(1.0).alias("scale"), F.lit(91.0).alias("offset"))
    p = p.withColumn("event_by_time", c.event_flag("time_present", time="days")).withColumn(
        "event_by_status", c.event_flag("status", status="status").cast("int")
    )
    out = follow_up_time(p, status="status", window="window", days="days", no_event_offset=180.0, overrides=exceptions, subject="user_id")
    return out.select("user_id", "event_by_time", "event_by_status", "time")


E["event_and_follow_up_time"] = Entry(
    _events_and_times,
    f"""WITH {V}, p AS (SELECT user_id, CAST(min(CASE WHEN value > 200 THEN day END) AS DOUBLE) AS days, CAST(max(day) AS DOUBLE) AS win,
            min(CASE WHEN value > 250 THEN 0 ELSE 1 END) AS status FROM visits GROUP BY 1)
        SELECT user_id, CASE WHEN days IS NOT NULL THEN 1 ELSE 0 END AS event_by_time, 1 - status AS event_by_status,
               CASE WHEN status = 1 THEN win + 180 WHEN win < 29 THEN win + 91 ELSE days + 1 END AS time FROM p""",
)
E["study_day_centred"] = Entry(
    lambda s, d: joins.centre(
        joins.study_day(x.entry_dates(s, d), "entered"), "study_day", out="study_day_c"
    ).select("o_custkey", "study_day", "study_day_c"),
    f"""WITH {x.ENTERED}, t AS (SELECT o_custkey, CAST(date_diff('day', (SELECT min(entered) FROM entered), entered) + 1 AS INTEGER) AS study_day FROM entered)
        SELECT o_custkey, study_day, study_day - (SELECT avg(study_day) FROM t) AS study_day_c FROM t""",
    digits("study_day_c"),
)
E["infinite_to_null"] = Entry(
    lambda s, d: joins.clear_infinite(
        x.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.try_divide(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio"),
                                         F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax")).alias("rate"))
    ),
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS ratio,
              CASE WHEN l_discount <> 0 THEN l_tax END AS rate FROM lineitem""",
    digits("ratio", "rate", places=4),
)
E["number_text_formats"] = Entry(
    lambda s, d: x.people(s, d).select(
        "c_custkey", c.p_text((F.col("c_custkey") % 1013) / 1012.0).alias("p_text"), c.fixed(F.col("balance") / 7, 2).alias("two_places"),
        c.half_even(F.col("c_custkey") / 2.0).cast("bigint").alias("even"), c.significant(F.col("balance"), 3).alias("three_digits"),
    ),
    f"""WITH {P} SELECT c_custkey, CASE WHEN p < 0.001 THEN '<0.001' WHEN p > 0.999 THEN '>0.999' ELSE printf('%.3f', p) END AS p_text,
          CASE WHEN balance IS NOT NULL THEN printf('%.2f', balance / 7) END AS two_places,
          CAST(round_even(c_custkey / 2.0, 0) AS BIGINT) AS even,
          CASE WHEN balance = 0 THEN 0 WHEN balance < 1000 THEN round_even(balance * pow(10, 2 - floor(log10(balance))), 0) / pow(10, 2 - floor(log10(balance)))
               ELSE round_even(balance / pow(10, floor(log10(balance)) - 2), 0) * pow(10, floor(log10(balance)) - 2) END AS three_digits
        FROM (SELECT *, (c_custkey % 1013) / 1012.0 AS p FROM cohort)""",
    digits("three_digits"),
)

E["filter_rows"] = Entry(
    lambda s, d: x.visits(s, d).where(F.col("y").isNotNull() & F.col("period").isin(2, 3, 4) & (F.col("arm") == 1)).select("event_id", "y"),
    f"WITH {V} SELECT event_id, y FROM visits WHERE y IS NOT NULL AND period IN (2, 3, 4) AND arm = 1", digits("y"),
)
E["project_rename_convert"] = Entry(
    lambda s, d: reshape.change_columns(
        reshape.change_columns(x.table(s, d, "lineitem").drop("absent", "l_tax"), ["l_orderkey", "l_linenumber"], lambda k: k.cast("string")),
        ["l_extendedprice", "l_quantity"], lambda k: c.half_even(k, 0)
    ).withColumnsRenamed({"l_orderkey": "order", "l_linenumber": "line"}).select("order", "line", "l_extendedprice", "l_quantity"),
    """SELECT CAST(l_orderkey AS VARCHAR) AS "order", CAST(l_linenumber AS VARCHAR) AS line, round_even(l_extendedprice, 0) AS l_extendedprice,
              round_even(l_quantity, 0) AS l_quantity FROM lineitem""",
)

# --- joins ---------------------------------------------------------------------------------
E["join_lookup_unique"] = Entry(
    lambda s, d: joins.lookup_join(
        x.visits(s, d), tables.visit_lookup(s, KINDS, "event_type", "code"), "event_type"
    ).select("event_id", "code"),
    f"WITH {V} SELECT event_id, {KIND_CASE} AS code FROM visits",
)
E["join_text_key_dates"] = Entry(
    lambda s, d: joins.attach_by_text_key(
        x.table(s, d, "customer").select("c_custkey"),
        tables.index_dates(
            x.entry_dates(s, d).select(F.col("o_custkey").alias("key"), F.date_format(F.add_months("entered", 120), "M/d/yy").alias("text")),
            key="key", text="text"), key="c_custkey", lookup_key="key",
    ).select("c_custkey", F.date_format("index_date", "yyyy-MM-dd").alias("index_date")),
    f"""WITH {x.ENTERED} SELECT c_custkey, strftime(entered + INTERVAL 10 YEAR, '%Y-%m-%d') AS index_date
        FROM customer LEFT JOIN entered ON c_custkey = o_custkey""",
)
E["join_aggregate_then_attach"] = Entry(
    lambda s, d: joins.attach_aggregate(
        x.people(s, d), x.table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey",
        {"first_price": F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey"))},
    ).select("c_custkey", "arm", "first_price"),
    f"""WITH {P}, f AS (SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price FROM orders GROUP BY 1)
        SELECT c_custkey, arm, first_price FROM cohort LEFT JOIN f ON c_custkey = o_custkey""",
    digits("first_price"),
)
E["join_semi_valid_subjects"] = Entry(
    lambda s, d: joins.keep_keys(
        x.long(s, d), joins.keys_where(x.long(s, d), "user_id", F.col("period").isin(4, 5))
    ).select("user_id", "period", "y"),
    f"WITH {L} SELECT user_id, period, y FROM long WHERE user_id IN (SELECT user_id FROM long WHERE period IN (4, 5))",
    digits("y"),
)
E["join_day_totals_to_arm"] = Entry(
    lambda s, d: joins.lookup_join(
        describe.totals(x.visits(s, d), {"total_y": "y", "total_day": "day"}, by=["user_id"]),
        x.visits(s, d).select("user_id", "arm").distinct(), "user_id", how="inner"
    ),
    f"WITH {V} SELECT user_id, coalesce(sum(y), 0) AS total_y, CAST(coalesce(sum(day), 0) AS BIGINT) AS total_day, any_value(arm) AS arm FROM visits GROUP BY 1",
    digits("total_y"),
)

# --- sequence ------------------------------------------------------------------------------
FILLED = """coalesce(last_value(gender IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(gender IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
FILLED_Y = FILLED.replace("gender", "y")
E["fill_down_up_per_subject"] = Entry(
    lambda s, d: sequence.fill(x.visits(s, d), subject="user_id", order_by=["event_id"], cols=["gender", "y"]).select(
        "event_id", "user_id", "gender", "y"),
    f"WITH {V} SELECT event_id, user_id, {FILLED} AS gender, {FILLED_Y} AS y FROM visits",
    digits("y"),
)
E["fill_down_up_split_subjects"] = Entry(
    lambda s, d: sequence.fill(
        x.visits(s, d), subject="user_id", order_by=["event_id"], cols=["gender", "y"], hot_rows=0
    ).select("event_id", "user_id", "gender", "y"),
    E["fill_down_up_per_subject"].sql, digits("y"),
)
E["fill_across_table"] = Entry(
    lambda s, d: sequence.fill(
        x.visits(s, d), subject="user_id", order_by=["event_id"], cols=["gender"], scope="table"
    ).select("event_id", "gender"),
    f"WITH {V} SELECT event_id, {FILLED.replace('PARTITION BY user_id ORDER BY event_id', 'ORDER BY user_id, event_id')} AS gender FROM visits",
)
E["collapse_first_known"] = Entry(
    lambda s, d: sequence.collapse(
        x.visits(s, d), subject="user_id", order_by=["event_id"], cols=["gender", "y", "event_type"]),
    f"""WITH {V} SELECT user_id, arg_min(gender, event_id) FILTER (gender IS NOT NULL) AS gender,
          arg_min(y, event_id) FILTER (y IS NOT NULL) AS y, arg_min(event_type, event_id) AS event_type FROM visits GROUP BY 1""",
    digits("y"),
)
E["first_row_per_subject"] = Entry(
    lambda s, d: sequence.first_row(x.visits(s, d), subject="user_id", order_by=["event_id"]),
    f"WITH {V} SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    digits("value", "y"),
)
E["first_value_and_distinct"] = Entry(
    lambda s, d: sequence.first_value(
        x.visits(s, d), subject="user_id", order_by=["event_id"], c="y").join(
        x.visits(s, d).select("user_id", "event_type").distinct(), "user_id"),
    f"""WITH {V}, f AS (SELECT user_id, y FROM visits QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
        SELECT user_id, y, event_type FROM f JOIN (SELECT DISTINCT user_id, event_type FROM visits) USING (user_id)""",
    digits("y"),
)

# --- aggregation ---------------------------------------------------------------------------
E["count_by_group"] = Entry(
    lambda s, d: describe.count_rows(x.people(s, d), ["arm", "segment"]),
    f"WITH {P} SELECT arm, segment, count(*) AS n FROM cohort GROUP BY ALL",
)
E["crosstab_with_missing"] = Entry(
    lambda s, d: describe.crosstab(x.people(s, d), "segment", "arm", {1: "active", 0: "control"}),
    f"""WITH {P} SELECT segment, count(CASE WHEN arm = 1 THEN 1 END) AS n_active, count(CASE WHEN arm = 0 THEN 1 END) AS n_control,
          count(CASE WHEN arm IS NULL THEN 1 END) AS n_missing FROM cohort GROUP BY 1""",
)
E["crosstab_known_only"] = Entry(
    lambda s, d: describe.crosstab(x.people(s, d), "segment", "rich", {"Yes": "yes", "No": "no"}, keep_missing=False),
    f"""WITH {P} SELECT segment, count(CASE WHEN rich = 'Yes' THEN 1 END) AS n_yes, count(CASE WHEN rich = 'No' THEN 1 END) AS n_no
        FROM cohort WHERE segment IS NOT NULL GROUP BY 1""",
)
E["missing_audit"] = Entry(
    lambda s, d: describe.missing_counts(x.visits(s, d), ["gender", "y"], by=["arm"]),
    f"WITH {V} SELECT arm, count(*) AS n, count(*) - count(gender) AS missing_gender, count(*) - count(y) AS missing_y FROM visits GROUP BY 1",
)
E["five_number_summary"] = Entry(
    lambda s, d: describe.five_numbers(x.table(s, d, "lineitem"), "l_extendedprice", by=["l_returnflag"]),
    """SELECT l_returnflag, min(l_extendedprice) AS minimum, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS median,
              avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.75) AS q3, max(l_extendedprice) AS maximum,
              count(*) - count(l_extendedprice) AS n_missing FROM lineitem GROUP BY 1""",
    digits("minimum", "q1", "median", "mean", "q3", "maximum", places=4),
)
E["group_stats_with_quartiles"] = Entry(
    lambda s, d: describe.group_stats(x.visits(s, d), "y", by=["arm", "period"]),
    f"""WITH {V} SELECT arm, period, count(*) AS n, count(y) AS n_nonnull, avg(y) AS mean, stddev_samp(y) AS sd, median(y) AS median,
          quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM visits GROUP BY ALL""",
    digits("mean", "sd", "median", "iqr"),
)
E["quantiles_averaged_at_jumps"] = Entry(
    lambda s, d: ranks.quantiles(x.visits(s, d), "y", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=["arm"], kind=2),
    f"""WITH {V}, o AS (SELECT arm, y, row_number() OVER (PARTITION BY arm ORDER BY y) AS i, count(*) OVER (PARTITION BY arm) AS n
            FROM visits WHERE y IS NOT NULL)
        SELECT arm, max(n) AS n_known, """ + ", ".join(
        f"(max(CASE WHEN i = CASE WHEN (n * {q}) % 1 = 0 THEN n * {q} ELSE floor(n * {q}) + 1 END THEN y END)"
        f" + max(CASE WHEN i = floor(n * {q}) + 1 THEN y END)) / 2 AS {name}" for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    ) + " FROM o GROUP BY arm",
    digits("q1", "median", "q3"),
)
E["group_moments"] = Entry(
    lambda s, d: describe.group_moments(x.table(s, d, "lineitem"), "l_quantity", by=["l_returnflag", "l_linestatus"]),
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_quantity) AS n_nonnull, avg(l_quantity) AS mean,
              stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY ALL""",
    digits("mean", "sd"),
)
E["arm_means_per_period"] = Entry(
    lambda s, d: describe.arm_means(x.visits(s, d), "y", arm="arm", by=["period"]),
    f"""WITH {V} SELECT period, avg(CASE WHEN arm = 1 THEN y END) AS mean1, avg(CASE WHEN arm = 0 THEN y END) AS mean0,
          avg(CASE WHEN arm = 1 THEN y END) - avg(CASE WHEN arm = 0 THEN y END) AS difference FROM visits GROUP BY 1""",
    digits("mean1", "mean0", "difference"),
)
E["scale_scores"] = Entry(
    lambda s, d: _scores(s, d),
    f"WITH {x.SCORES} SELECT user_id, arm, period, scale, score_mean FROM scores",
    digits("score_mean"),
)
E["strata_with_both_arms"] = Entry(
    lambda s, d: describe.with_both_arms(
        x.visits(s, d).where("value > 250"), arm="arm", by=["day"]).select("event_id", "day", "arm"),
    f"""WITH {V}, b AS (SELECT * FROM visits WHERE value > 250)
        SELECT event_id, day, arm FROM b WHERE day IN (SELECT day FROM b GROUP BY 1 HAVING count(DISTINCT arm) >= 2)""",
)


def _scores(s, d):
    rows = reshape.items_to_long(
        x.items(s, d), ids=["user_id", "arm", "period"], columns=x.ITEM_COLUMNS, pattern=x.ITEM_PATTERN, names=["scale", "item"]
    )
    return describe.scale_scores(rows, by=["user_id", "arm", "period", "scale"])


def _summary_sql() -> str:
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    grid = ", ".join(f"('segment', 'Segment', 0, '{v}', {i})" for i, v in enumerate(segs)) + ", ('rich', 'Rich', 2, 'Yes', 1)"
    return f"""WITH {P}, obs AS (SELECT arm, 'segment' AS variable, segment AS level FROM cohort WHERE segment IS NOT NULL
                 UNION ALL SELECT arm, 'rich', rich FROM cohort),
        grid(variable, label, variable_order, level, level_order) AS (VALUES {grid}),
        whole AS (SELECT arm, variable, count(*) AS n_known FROM obs GROUP BY ALL),
        cells AS (SELECT g.*, w.arm, w.n_known, (SELECT count(*) FROM obs o WHERE o.arm = w.arm AND o.variable = g.variable AND o.level = g.level) AS n
                  FROM grid g JOIN whole w USING (variable))
        SELECT variable, label, variable_order, level, level_order, arm, n_known, n, 100.0 * n / n_known AS percent,
               CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS q3,
               concat(CAST(n AS VARCHAR), ' (', printf('%.0f', round_even(100.0 * n / n_known, 0)), '%)') AS text FROM cells
        UNION ALL
        SELECT 'balance', 'Balance', 1, NULL, 0, arm, count(balance), NULL, NULL, median(balance), quantile_cont(balance, 0.25),
               quantile_cont(balance, 0.75), printf('%.1f (%.1f, %.1f)', median(balance), quantile_cont(balance, 0.25), quantile_cont(balance, 0.75))
        FROM cohort GROUP BY arm"""


SUMMARY_SPEC = {
    "segment": describe.Categorical(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), "Segment"),
    "balance": describe.Continuous("Balance", 1),
    "rich": describe.Categorical(("No", "Yes"), "Rich", ("Yes",)),
}
E["summary_table_by_arm"] = Entry(
    lambda s, d: describe.summary_table(x.people(s, d), SUMMARY_SPEC, arm="arm", arms=[1, 0]),
    _summary_sql(), digits("percent", "median", "q1", "q3"),
)

# --- reshape -------------------------------------------------------------------------------
E["items_to_long"] = Entry(
    lambda s, d: reshape.items_to_long(
        x.items(s, d), ids=["user_id", "arm", "period"], columns=x.ITEM_COLUMNS, pattern=x.ITEM_PATTERN, names=["scale", "item"]),
    f"""WITH {x.ITEMS} SELECT user_id, arm, period, regexp_extract(name, 'SC_(Low|High)([123])', 1) AS scale,
          regexp_extract(name, 'SC_(Low|High)([123])', 2) AS item, score
        FROM items UNPIVOT INCLUDE NULLS (score FOR name IN (SC_Low1, SC_Low2, SC_Low3, SC_High1, SC_High2, SC_High3))""",
    digits("score"),
)
E["arms_to_wide"] = Entry(
    lambda s, d: reshape.arms_to_wide(_scores(s, d), by=["scale", "period"], arm="arm", levels={1: "active", 0: "control"}, value="score_mean"),
    f"WITH {x.SCORES} SELECT scale, period, " + ", ".join(
        f"count(CASE WHEN arm = {a} THEN 1 END) AS n_{n}, avg(CASE WHEN arm = {a} THEN score_mean END) AS mean_{n}, "
        f"stddev_samp(CASE WHEN arm = {a} THEN score_mean END) AS sd_{n}" for a, n in ((1, "active"), (0, "control"))
    ) + " FROM scores GROUP BY ALL",
    digits("mean_active", "sd_active", "mean_control", "sd_control"),
)
E["append_labelled_results"] = Entry(
    lambda s, d: reshape.append_labelled({
        "events": describe.arm_means(x.visits(s, d), "y", arm="arm", by=["period"]),
        "weeks": describe.arm_means(x.long(s, d), "y", arm="arm", by=["period"]),
    }),
    f"""WITH {L} SELECT 'events' AS model, period, avg(CASE WHEN arm = 1 THEN y END) AS mean1, avg(CASE WHEN arm = 0 THEN y END) AS mean0,
           avg(CASE WHEN arm = 1 THEN y END) - avg(CASE WHEN arm = 0 THEN y END) AS difference FROM visits GROUP BY period
        UNION ALL SELECT 'weeks', period, avg(CASE WHEN arm = 1 THEN y END), avg(CASE WHEN arm = 0 THEN y END),
           avg(CASE WHEN arm = 1 THEN y END) - avg(CASE WHEN arm = 0 THEN y END) FROM long GROUP BY period""",
    digits("mean1", "mean0", "difference"),
)
E["first_available_column"] = Entry(
    lambda s, d: reshape.first_available(
        x.visits(s, d).withColumn("n_1", F.col("y")), "outcome", ["n_1", "n_Active", "value"]).select("event_id", "outcome"),
    f"WITH {V} SELECT event_id, coalesce(y, value) AS outcome FROM visits", digits("outcome"),
)

# --- ranking -------------------------------------------------------------------------------
E["change_scores"] = Entry(
    lambda s, d: x.change(s, d),
    f"WITH {x.CHANGE} SELECT user_id, arm, change, prep_change FROM changes", digits("change", "prep_change"),
)
E["waterfall_ranking"] = Entry(
    lambda s, d: ranks.rank_rows(x.change(s, d), "prep_change", tie=["user_id"]).select("user_id", "prep_change", "rank"),
    f"""WITH {x.CHANGE} SELECT user_id, prep_change, row_number() OVER (ORDER BY prep_change DESC NULLS LAST, user_id) AS rank FROM changes""",
    digits("prep_change"),
)
E["waterfall_ranking_large"] = Entry(
    lambda s, d: ranks.rank_rows(
        x.table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_totalprice", tie=["o_orderkey"], by=["o_orderstatus"]),
    """SELECT o_orderkey, o_orderstatus, o_totalprice,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders""",
    digits("o_totalprice"),
)


def _horner(coefs, v):
    out = repr(coefs[-1])
    for k in reversed(coefs[:-1]):
        out = f"({out} * {v} + {k!r})"
    return out


def _normal_sql(p: str) -> str:
    from twinarm.functions import normal as nq

    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    centre = f"({p} - 0.5) * {_horner(nq.CENTRE_NUM, 'rc')} / {_horner(nq.CENTRE_DEN, 'rc')}"
    mid = f"{_horner(nq.MIDDLE_NUM, 'rm')} / {_horner(nq.MIDDLE_DEN, 'rm')}"
    tail = f"{_horner(nq.TAIL_NUM, 'rt')} / {_horner(nq.TAIL_DEN, 'rt')}"
    return (f"SELECT *, CASE WHEN abs({p} - 0.5) <= 0.425 THEN {centre} ELSE sign({p} - 0.5) * CASE WHEN {r} <= 5 THEN {mid} ELSE {tail} END END AS theoretical "
            f"FROM (SELECT *, 0.180625 - ({p} - 0.5) * ({p} - 0.5) AS rc, {r} - 1.6 AS rm, {r} - 5 AS rt FROM points)")


E["normal_quantile_points"] = Entry(
    lambda s, d: ranks.normal_plot(x.visits(s, d), "y", tie=["event_id"], by=["arm", "period"]),
    f"""WITH {V}, ordered AS (SELECT arm, period, event_id, y AS sample, row_number() OVER (PARTITION BY arm, period ORDER BY y, event_id) AS position,
            count(*) OVER (PARTITION BY arm, period) AS n FROM visits WHERE y IS NOT NULL),
        points AS (SELECT *, (position - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) AS probability FROM ordered)
        SELECT arm, period, event_id, position, n, probability, theoretical, sample FROM ({_normal_sql('probability')})""",
    digits("probability", "theoretical", "sample"),
)
E["normal_quantile_line"] = Entry(
    lambda s, d: ranks.normal_plot_line(x.visits(s, d), "y", by=["arm"]),
    f"""WITH {V}, q AS (SELECT arm, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM visits GROUP BY 1)
        SELECT arm, q1, q3, (q3 - q1) / 1.3489795003921634 AS slope, (q1 + q3) / 2 AS intercept FROM q""",
    digits("q1", "q3", "slope", "intercept"),
)
E["sorted_results"] = Entry(
    lambda s, d: describe.group_moments(
        x.people(s, d).withColumn("segment_ord", c.level_position("segment", ["MACHINERY", "BUILDING", "HOUSEHOLD"])), "balance",
        by=["segment_ord", "arm"]).orderBy(F.asc_nulls_last("segment_ord"), "arm"),
    f"""WITH {P} SELECT CASE segment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'HOUSEHOLD' THEN 3 END AS segment_ord, arm,
          count(*) AS n, count(balance) AS n_nonnull, avg(balance) AS mean, stddev_samp(balance) AS sd FROM cohort GROUP BY ALL ORDER BY 1, 2""",
    digits("mean", "sd"),
)
