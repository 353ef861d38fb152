import pytest
from pyspark.sql import functions as F

from twinarm.operators import ranks, scan, sequence, survival
from twinarm.operators.sequence import collapse, first_row

DATA = [
    (1, 1, None, None), (1, 2, "a", None), (1, 3, None, None), (1, 4, "b", None), (1, 5, None, None),
    (2, 1, "c", 1.0), (2, 2, None, None), (2, 3, None, 2.0), (3, 1, None, None), (3, 2, None, 7.0),
]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(DATA, "s int, o int, c string, x double")


def read(frame):
    return sorted((r["s"], r["o"], r["c"], r["x"]) for r in frame.collect())


ORDER = {"subject": "s", "order_by": ["o"]}


def test_fill_values(df):
    found = read(sequence.fill(df, cols=["c", "x"], **ORDER))
    assert [r[2] for r in found] == ["a", "a", "a", "b", "b", "c", "c", "c", None, None]
    assert [r[3] for r in found] == [None] * 5 + [1.0, 1.0, 2.0, 7.0, 7.0]


@pytest.mark.parametrize("direction", ["down", "up", "downup"])
def test_split_subjects_fill_alike(df, direction):
    plain = read(sequence.fill(df, cols=["c", "x"], direction=direction, **ORDER))
    split = read(sequence.fill(df.repartition(5), cols=["c", "x"], direction=direction, hot_rows=0, **ORDER))
    assert plain == split


def test_one_subject_over_many_chunks(spark):
    big = spark.range(20000).select(
        F.lit(1).alias("s"), F.col("id").alias("o"), F.when(F.col("id") % 700 == 650, F.col("id")).alias("v"))
    chunks = scan.range_chunks(big, ["s", "o"])
    assert chunks.select("_chunk").distinct().count() >= 1
    plain = sequence.fill(big, subject="s", order_by=["o"], cols=["v"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = sequence.fill(big, subject="s", order_by=["o"], cols=["v"], hot_rows=0)
        assert scan.range_chunks(big, ["s", "o"]).select("_chunk").distinct().count() > 1
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_fill_is_idempotent_and_ignores_row_order(df):
    once = sequence.fill(df, cols=["c", "x"], **ORDER)
    assert read(once) == read(sequence.fill(once, cols=["c", "x"], **ORDER))
    assert read(once) == read(sequence.fill(df.orderBy(F.rand(5)).repartition(7), cols=["c", "x"], **ORDER))


def test_fill_over_table_crosses_subjects(df):
    found = read(sequence.fill(df, cols=["c"], scope="table", **ORDER))
    assert [r[2] for r in found] == ["a", "a", "a", "b", "b", "c", "c", "c", "c", "c"]


def test_collapse_is_fill_then_first_row(df):
    both = sequence.first_row(sequence.fill(df, cols=["c", "x"], **ORDER), **ORDER).select("s", "c", "x")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, sequence.collapse(df, cols=["c", "x"], **ORDER).collect()))


def test_first_row_keeps_missing(df):
    assert read(sequence.first_row(df, **ORDER))[0] == (1, 1, None, None)
    assert dict(sequence.first_value(df, c="c", **ORDER).collect()) == {1: None, 2: "c", 3: None}
    assert dict(sequence.first_value(df, c="c", skip_missing=True, **ORDER).collect()) == {1: "a", 2: "c", 3: None}


def test_running_sums_over_chunks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select((F.col("id") % 3 == 0).alias("g"), F.col("id").alias("o"))
        df = df.select(F.when(F.col("g"), "hot").alias("g"), "o")
        out = scan.running_sums(scan.range_chunks(df, ["g", "o"]), by=["g"], order_by=["o"], sums={"n": F.lit(1)})
        assert out.select("_chunk").distinct().count() > 1
        for name in ("hot", None):
            test = F.col("g").eqNullSafe(F.lit(name))
            found = [(r["o"], r["n"]) for r in out.where(test).orderBy("o").collect()]
            assert [n for _, n in found] == list(range(1, len(found) + 1))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranking_puts_missing_last(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0), (4, 5.0)], "s int, v double")
    found = {r["s"]: r["rank"] for r in ranks.rank_rows(df, "v", tie=["s"]).collect()}
    assert found == {3: 1, 1: 2, 4: 3, 2: 4}


def test_quantile_kinds(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "top": 1.0, "low": 0.0}
    assert ranks.quantiles(df, "v", probs).first().asDict() == {"n_known": 4, "q1": 1.75, "q2": 2.5, "q3": 3.25, "top": 4.0, "low": 1.0}
    assert ranks.quantiles(df, "v", probs, kind=2).first().asDict() == {"n_known": 4, "q1": 1.5, "q2": 2.5, "q3": 3.5, "top": 4.0, "low": 1.0}


def test_no_window_over_the_whole_table(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("v"))
    for frame in (ranks.rank_rows(df, "v", tie=["id"]), ranks.normal_plot(df, "v", tie=["id"]), ranks.quantiles(df, "v", {"m": 0.5})):
        for line in frame._jdf.queryExecution().optimizedPlan().toString().splitlines():
            if "Window [" in line:  # rows are windowed per chunk; only chunk totals over groups
                assert "_chunk" in line or "_rows" in line


def test_first_known_number_without_a_sort(spark):
    """Numbers in an order of fixed width are aggregated by hash; the order may be one column or a packed pair, with missing first."""
    df = spark.createDataFrame(
        [(1, None, 5, 2.5, None), (1, 3, -4, None, 7), (1, 3, -5, 1.5, 8), (2, -1, 0, None, None), (2, -1, 9, 4.0, 1)], "s int, a int, b int, v double, w int")
    for order in (["a", "b"], ["b"]):
        out = collapse(df, subject="s", order_by=order, cols=["v", "w"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "Sort" not in plan
    assert {r["s"]: (r["v"], r["w"]) for r in collapse(df, subject="s", order_by=["a", "b"], cols=["v", "w"]).collect()} == {1: (2.5, 8), 2: (4.0, 1)}
    assert {r["s"]: (r["v"], r["w"]) for r in first_row(df, subject="s", order_by=["a", "b"]).collect()} == {1: (2.5, None), 2: (None, None)}
    assert "Sort" not in first_row(df, subject="s", order_by=["a", "b"])._jdf.queryExecution().executedPlan().toString()


def test_group_totals_without_a_join_by_group(spark):
    """Ranks, curves and tests join only chunk offsets, sent to all tasks, and count whole groups right across chunks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(400).select(
            "id", F.when(F.col("id") < 300, "hot").alias("g"), (F.col("id") % 90).cast("double").alias("t"), (F.col("id") % 3 == 0).cast("int").alias("e"),
            (F.col("id") % 2).cast("int").alias("arm"))
        points = ranks.normal_plot(df, "t", tie=["id"], by=["g"])
        curve = survival.kaplan_meier(df, time="t", event="e", by=["g"])
        test = survival.logrank(df, time="t", event="e", arm="arm", arms=[0, 1], by=["g"])
        for frame in (points, curve, test):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert {(r["g"], r["n"]) for r in points.collect()} == {("hot", 300), (None, 100)}
        first = {r["g"]: r["at_risk"] for r in curve.where("time = 0").collect()}
        assert first == {"hot": 300, None: 100}
        assert {r["g"]: r["observed_0"] + r["observed_1"] for r in test.collect()} == {"hot": 100, None: 34}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
