import datetime

import pytest
from pyspark.sql import functions as F

from twinarm.operators.joins import heavy_keys, lookup_join, one_per_key, spread_join, study_day
from twinarm.sources import sinks, tables


def test_csv_missing_tokens(spark, tmp_path):
    path = tmp_path / "visits.csv"
    path.write_text('ID,Label,Num\n1,NA,2.5\n2,,NA\n3,"",abc\n4,x,\n')
    df = tables.load_long(spark, str(path), schema="ID int, Label string, Num double")
    found = {r["ID"]: (r["Label"], r["Num"]) for r in df.collect()}
    assert found == {1: (None, 2.5), 2: (None, None), 3: ("", None), 4: ("x", None)}
    assert tables.load_long(spark, str(path)).columns == ["ID", "Label", "Num"]


def test_save_and_reload(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 1.5)], "a int, b double")
    sinks.save_table(df, str(tmp_path / "p"))
    sinks.save_table(df, str(tmp_path / "c"), fmt="csv")
    for path, fmt in (("p", "parquet"), ("c", "csv")):
        again = tables.load_long(spark, str(tmp_path / path), schema="a int, b double", fmt=fmt)
        assert sorted(map(tuple, again.collect())) == [(1, None), (2, 1.5)]


def test_decode_keeps_unlisted_codes(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "a int")
    assert [r[0] for r in tables.decode_labels(df, {"a": {1: "one"}, "absent": {}}).collect()] == ["one", "9", None]


def test_index_dates(spark):
    df = spark.createDataFrame([(7, "3/4/21"), (8, "x")], "k int, t string")
    found = {r["k"]: r["index_date"] for r in tables.index_dates(df, key="k", text="t").collect()}
    assert found == {"7": datetime.date(2021, 3, 4), "8": None}
    with pytest.raises(Exception, match="ambiguous"):
        tables.index_dates(spark.createDataFrame([(1, "1/2/70")], "k int, t string"), key="k", text="t").collect()


@pytest.mark.parametrize("position,expected", [(0, {1: "exception", 2: "rule", 3: "other"}), (1, {1: "rule", 2: "rule", 3: "other"})])
def test_override_position(spark, position, expected):
    df = spark.createDataFrame([(1, True), (2, True), (3, None)], "id int, flag boolean")
    exceptions = spark.createDataFrame([(1, "exception")], "id int, override_value string")
    out = tables.apply_overrides(
        df, exceptions, key=["id"], out="v", rules=[(F.coalesce(F.col("flag"), F.lit(False)), F.lit("rule"))],
        default=F.lit("other"), position=position)
    assert {r["id"]: r["v"] for r in out.collect()} == expected


def test_lookup_must_be_unique(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="more than one row"):
        lookup_join(df, twice, "k").collect()
    assert one_per_key(twice.dropDuplicates(["k"]), "k").count() == 1


def test_hot_key_join_equals_plain_join(spark):
    key = F.when(F.col("id") < 1000, 0).when(F.col("id") < 1900, None).otherwise(F.col("id") % 50)
    left = spark.range(3000).select(key.cast("long").alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_semi"):
        spread = spread_join(left, right, ["k"], how)
        plain = left.join(right, ["k"], how)
        assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
    heavy, blank = heavy_keys(left, ["k"])
    zero = spark.range(1).select(F.xxhash64(F.lit(0).cast("long")).alias("h")).first()["h"]
    assert dict(heavy) == {zero: 3} and blank  # a third of the rows: three of eight partitions' shares
    assert heavy_keys(left.where("k > 0"), ["k"]) == ([], False) and heavy_keys(left.limit(0), ["k"]) == ([], False)


def test_hot_key_join_reads_each_side_once(spark, tmp_path):
    """One join by key and salt, each file scanned once, only marked lookup rows repeated, and the hot key spread over tasks."""
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    spark.range(6000).select(key.alias("k"), "id").write.parquet(f"{tmp_path}/left")
    spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).write.parquet(f"{tmp_path}/right")
    left, right = spark.read.parquet(f"{tmp_path}/left"), spark.read.parquet(f"{tmp_path}/right")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = spread_join(left, right, ["k"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and plan.count("SortMergeJoin") == 1 and plan.count("Union") == 0
        assert "hashpartitioning(k" in plan and "_salt" in plan
        spread = joined.where("k = 7").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread > 1 and joined.count() == 6000


def test_study_day_counts_from_first_date(spark):
    df = spark.createDataFrame([(1, datetime.date(2020, 1, 3)), (2, datetime.date(2020, 1, 1)), (3, None)], "k int, d date")
    assert {r["k"]: r["study_day"] for r in study_day(df, "d").collect()} == {1: 3, 2: 1, 3: None}
