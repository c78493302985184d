from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from yieldlake.operators import leakage, splits
from yieldlake.profile import PROTOCOL_ID, SOURCE_ROW_ID, SPLIT_ROLE, ContractError, Profile

PROFILE = Profile("days", "label", -1, 1, timestamp="timestamp", timestamp_format="yyyy-MM-dd", excluded=("row_id",),
                  feature_prefix="sensor_")


def days(spark, numbers):
    rows = [(i, i * 1.0, 1 if i % 2 else -1, f"2020-01-{d:02d}") for i, d in enumerate(numbers)]
    return spark.createDataFrame(rows, "row_id bigint, sensor_0 double, label int, timestamp string")


def sizes(df):
    found = {r.role: r.n for r in df.groupBy("role").agg(F.count("*").alias("n")).collect()}
    return tuple(found.get(r, 0) for r in splits.ROLES)


def test_twenty_reversed_days(spark):
    assert sizes(splits.time_split(days(spark, range(20, 0, -1)), PROFILE, role="role")) == (14, 3, 3)


def test_tied_days_stay_whole(spark):
    out = splits.time_split(days(spark, [d for d in range(1, 11) for _ in range(2)]), PROFILE, role="role")
    assert out.groupBy("timestamp").agg(F.count_distinct("role").alias("n")).where("n > 1").isEmpty()


def test_fallback_cut(spark):
    assert sizes(splits.time_split(days(spark, [1, 2, 3, 4, 5, 6, 7, 7, 7, 7]), PROFILE, role="role")) == (5, 1, 4)


def test_groups_stay_whole_or_are_rejected(spark):
    grouped = replace(PROFILE, groups=("lot",), excluded=("row_id",))
    df = days(spark, range(1, 21)).withColumn("lot", F.floor(F.col("row_id") / 4))
    out = splits.time_split(df, grouped, role="role")
    assert out.groupBy("lot").agg(F.count_distinct("role").alias("n")).where("n > 1").isEmpty()
    with pytest.raises(ContractError):
        splits.time_split(df.withColumn("lot", F.lit(1)), grouped, role="role")


def test_bad_times_are_rejected(spark):
    df = days(spark, range(1, 21)).withColumn("timestamp", F.when(F.col("row_id") == 3, "soon").otherwise(F.col("timestamp")))
    with pytest.raises(ContractError):
        splits.time_split(df, PROFILE, role="role")


def test_random_split_is_stratified_and_repeatable(spark):
    df = spark.range(200).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, 1).otherwise(-1).alias("label"))
    first = splits.random_split(df, PROFILE, ["row_id"], 3, "role")
    again = splits.random_split(df.repartition(7), PROFILE, ["row_id"], 3, "role")
    assert sorted(first.collect()) == sorted(again.collect())
    counts = {(r.role, r.label): r.n for r in first.groupBy("role", "label").agg(F.count("*").alias("n")).collect()}
    assert counts == {("train", 1): 14, ("train", -1): 126, ("validation", 1): 3, ("validation", -1): 27,
                      ("test", 1): 3, ("test", -1): 27}


def test_tagged_split_passes_its_own_gate(spark):
    tagged = splits.tag_splits(days(spark, range(1, 29)), PROFILE, "row_id")
    timed = tagged.where("strategy = 'time'")
    checks = leakage.leakage_checks(timed.drop("strategy"), PROFILE, "time").collect()
    assert {c.status for c in checks} == {"PASS"}
    protocols = timed.select(PROTOCOL_ID).distinct().collect()
    assert len(protocols) == 1 and protocols[0][0].startswith("time:")
    leakage.require_train_role(timed.where(F.col(SPLIT_ROLE) == "train").drop("strategy"))
    with pytest.raises(ContractError):
        leakage.require_train_role(timed.drop("strategy"))
    twice = timed.where(F.col(SPLIT_ROLE) == "train").drop("strategy")
    with pytest.raises(ContractError):
        leakage.require_train_role(twice.unionByName(twice))
    assert timed.select(SOURCE_ROW_ID).distinct().count() == 28


def test_pair_leakage_is_found(spark):
    df = days(spark, range(1, 11))
    train, later = df.where("row_id < 6"), df.where("row_id >= 6")
    leakage.require_pair(train, later, PROFILE, temporal=True)
    with pytest.raises(ContractError):
        leakage.require_pair(train, later.unionByName(train.limit(1)), PROFILE)
    with pytest.raises(ContractError):
        leakage.require_pair(later, train, PROFILE, temporal=True)


def test_group_folds_are_disjoint_and_cover_both_labels(spark):
    rows = [(i, i * 1.0, 1 if (i // 2) % 2 else -1, i // 2 if i % 2 else i // 2) for i in range(12)]
    df = spark.createDataFrame([(i, v, 1 if i % 2 else -1, lot) for i, v, _, lot in rows],
                               "row_id bigint, value double, label int, lot int")
    profile = Profile("g", "label", -1, 1, groups=("lot",), excluded=("row_id",))
    members = splits.group_folds(df, profile, ["row_id"], 2, 2)
    assert members.groupBy("repeat", "group").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert splits.fold_label_coverage(members, profile, ["repeat", "fold"]).where("not both_labels").isEmpty()
    with pytest.raises(ContractError):
        splits.group_folds(df, profile, ["row_id"], 7, 1)


def test_recent_window_keeps_last_days(spark):
    df = spark.createDataFrame([(i, f"2020-03-{i + 1:02d}") for i in range(30)], "row_id int, timestamp string").withColumn(
        "label", F.lit(1)).withColumns({"fold": F.lit(1), "fold_role": F.lit("fit")})
    kept = sorted(r.row_id for r in splits.recent_rows(df, PROFILE, 10).collect())
    assert kept == list(range(19, 30))
