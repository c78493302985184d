"""Stability of selected sensors over folds, set overlaps and the reduction policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..profile import ReductionPolicy


def selection_frequency(selected: DataFrame) -> DataFrame:
    """Share of fits per (model, role) that chose a feature, with its mean rank."""
    totals = selected.groupBy("model_name", "fit_role").agg(F.count_distinct("fit_id").alias("total_fit_count"))
    counts = selected.groupBy("model_name", "fit_role", "feature", "feature_space").agg(
        F.count_distinct("fit_id").alias("selected_fit_count"), F.avg("selection_rank").alias("mean_selection_rank"))
    return counts.join(totals, ["model_name", "fit_role"]).withColumn(
        "selection_frequency", ratio(F.col("selected_fit_count"), F.col("total_fit_count"))).orderBy(
        "model_name", "fit_role", F.desc("selection_frequency"), "mean_selection_rank", "feature")


def fold_rank_table(records: DataFrame, folds: list[int]) -> DataFrame:
    """One row per feature: its rank in each fold, Top-K count, mean rank when used, folds used."""
    wide = records.groupBy("feature").agg(
        *[F.max(F.when(F.col("fold") == f, F.col("importance_rank"))).alias(f"fold_{f}_rank") for f in folds],
        F.sum(F.col("in_topk").cast("int")).alias("topk_count"),
        F.avg("importance_rank").alias("mean_rank_when_used"),
        F.count("importance_rank").alias("used_fold_count"))
    return wide.orderBy(F.desc("topk_count"), F.asc_nulls_last("mean_rank_when_used"), "feature")


def fold_overlap(records: DataFrame) -> DataFrame:
    """Common Top-K sensors and Jaccard similarity of every pair of folds.

    Each feature carries one flag per fold, so pairs are formed over folds, never over features.
    """
    top = records.where("in_topk").select("fold", "feature").distinct()
    held = top.groupBy("feature").agg(F.sort_array(F.collect_set("fold")).alias("folds"))
    pair = F.explode(F.expr(
        "flatten(transform(folds, (a, i) -> transform(slice(folds, i + 2, size(folds)), b -> struct(a as f, b as s))))"
    )).alias("p")
    common = held.select(pair).groupBy(F.col("p.f").alias("first_fold"), F.col("p.s").alias("second_fold")).agg(
        F.count(F.lit(1)).alias("common_sensor_count"))
    sizes = top.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    # A pair per two folds: the fold table has one row per fold of the experiment.
    grid = sizes.select(F.col("fold").alias("first_fold"), F.col("n").alias("first_sensor_count")).join(
        F.broadcast(sizes.select(F.col("fold").alias("second_fold"), F.col("n").alias("second_sensor_count"))),
        F.col("first_fold") < F.col("second_fold"))
    both = F.coalesce(F.col("common_sensor_count"), F.lit(0))
    return grid.join(common, ["first_fold", "second_fold"], "left").select(
        "first_fold", "second_fold", "first_sensor_count", "second_sensor_count",
        both.alias("common_sensor_count"),
        ratio(both, F.col("first_sensor_count") + F.col("second_sensor_count") - both).alias("jaccard_similarity"))


def importance_table(profiled: DataFrame, importances: DataFrame) -> DataFrame:
    """Every feature with removal status, importance and min-rank; removed features stay last and unranked."""
    joined = profiled.select("feature", "status", F.col("missing_ratio").alias("train_missing_ratio")).join(
        importances.select("feature", "importance"), "feature", "left")
    # One row per column of the table, so a single ordered window is bounded by the schema.
    from pyspark.sql.window import Window
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("importance"))
    return joined.withColumn("importance_rank", F.when(F.col("importance").isNotNull(), F.rank().over(order))).orderBy(
        F.desc_nulls_last("importance"), "feature")


def top_k_flags(records: DataFrame, k: int, order_column: str = "importance") -> DataFrame:
    """Mark the k best ranked features of each fold; ties follow the feature order."""
    from pyspark.sql.window import Window
    by = Window.partitionBy("fold").orderBy(F.desc_nulls_last(order_column), "feature")
    return records.withColumn("in_topk", (F.row_number().over(by) <= k) & F.col(order_column).isNotNull())


def selection_overlap(oof_selected: DataFrame, selected: DataFrame) -> DataFrame:
    """Per fold: sensors, sensors of the full selection, common ones and Jaccard similarity."""
    full = selected.select("feature").distinct().withColumn("in_full", F.lit(1))
    size = full.agg(F.count(F.lit(1)).alias("train_sensor_count"))
    folds = oof_selected.select("cv_fold", "feature").distinct().join(full, "feature", "left").groupBy("cv_fold").agg(
        F.count(F.lit(1)).alias("oof_sensor_count"), F.count("in_full").alias("common_count"))
    return folds.crossJoin(F.broadcast(size)).withColumn("jaccard", ratio(
        F.col("common_count"), F.col("oof_sensor_count") + F.col("train_sensor_count") - F.col("common_count")))


def window_sensor_changes(selected: DataFrame) -> DataFrame:
    """Per (model, fold, window, feature): common, removed or added against the full history (window 0)."""
    keys = ["model_name", "outer_fold"]
    base = selected.where("window_days = 0").select(*keys, "feature").withColumn("in_base", F.lit(True))
    windows = selected.where("window_days <> 0").select(*keys, "window_days").distinct()
    recent = selected.where("window_days <> 0").select(*keys, "window_days", "feature").withColumn(
        "in_recent", F.lit(True))
    sides = windows.join(base, keys).join(recent, [*keys, "window_days", "feature"], "full_outer")
    return sides.select(*keys, "window_days", "feature", F.when(
        F.col("in_base") & F.col("in_recent"), "common").when(F.col("in_base"), "removed").otherwise("added")
        .alias("sensor_status"))


def window_sensor_overlap(changes: DataFrame) -> DataFrame:
    status = F.col("sensor_status")
    return changes.groupBy("model_name", "outer_fold", "window_days").agg(
        F.count_if(status != "added").alias("baseline_sensor_count"),
        F.count_if(status != "removed").alias("recent_sensor_count"),
        F.count_if(status == "common").alias("common_count"),
        F.count_if(status == "removed").alias("removed_count"),
        F.count_if(status == "added").alias("added_count"),
        ratio(F.count_if(status == "common"), F.count(F.lit(1))).alias("jaccard"),
    ).withColumn("same_sensor_set", (F.col("removed_count") == 0) & (F.col("added_count") == 0))


def window_diagnostics(rows: DataFrame) -> DataFrame:
    """Each recent-window result against the full history of the same model and fold."""
    keys = ["model_name", "outer_fold"]
    base = rows.where("window_days = 0")
    paired = rows.where("window_days <> 0").join(
        base.select(*keys, *[F.col(c).alias(f"baseline_{c}") for c in base.columns if c not in keys]), keys, "left")
    usable = (F.col("status") == "evaluated") & (F.col("baseline_status") == "evaluated")
    delta = F.when(usable, F.col("average_precision") - F.col("baseline_average_precision"))
    return paired.select(
        *keys, "window_days", "status", "average_precision", "baseline_average_precision",
        (F.col("baseline_train_samples") - F.col("train_samples")).alias("removed_train_samples"),
        (F.col("baseline_train_fail") - F.col("train_fail")).alias("removed_train_fail"),
        ratio(F.col("train_fail"), F.col("train_samples")).alias("train_fail_ratio"),
        ratio(F.col("baseline_train_fail"), F.col("baseline_train_samples")).alias("baseline_train_fail_ratio"),
        delta.alias("ap_delta"),
        F.when(F.col("baseline_average_precision") > 0,
               ratio(delta, F.col("baseline_average_precision"))).alias("ap_relative_change"),
        F.when(usable, F.col("roc_auc") - F.col("baseline_roc_auc")).alias("roc_auc_delta"),
        ((F.col("train_samples") == F.col("baseline_train_samples"))
         & (F.col("train_start") == F.col("baseline_train_start"))
         & (F.col("train_end") == F.col("baseline_train_end"))).alias("same_training_period"))


def assess_reduction(folds: DataFrame, policy: ReductionPolicy) -> DataFrame:
    """Retention of mean AP and sensor-count check for each (all sensors, reduced) pair.

    Undefined when folds repeat, differ or hold an AP outside 0-1.
    """
    spark = folds.sparkSession
    pairs = spark.createDataFrame(list(policy.comparison_pairs), "baseline string, candidate string")
    per_fold = folds.groupBy("experiment", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.max("ap").alias("ap"), F.min("sensor_count").alias("lo"),
        F.max("sensor_count").alias("hi"), F.count_if(F.col("sensor_count").isNull()).alias("no_count"),
        F.count_if(~F.coalesce("is_raw_sensor", F.lit(False))).alias("not_raw"))
    reduced = pairs.join(per_fold.withColumnRenamed("experiment", "candidate"), "candidate")
    base = pairs.join(per_fold.select(F.col("experiment").alias("baseline"), "fold", F.col("n").alias("bn"),
                                      F.col("ap").alias("bap")), "baseline")
    paired = reduced.join(base, ["baseline", "candidate", "fold"], "full_outer")

    def fine(ap):
        return F.coalesce((ap >= 0) & (ap <= 1), F.lit(False))

    usable = (F.col("n") == 1) & (F.col("bn") == 1) & fine(F.col("ap")) & fine(F.col("bap"))
    out = paired.groupBy("baseline", "candidate").agg(
        F.min(F.coalesce(usable, F.lit(False)).cast("int")).alias("ok"),
        F.avg("bap").alias("base_ap"), F.avg("ap").alias("cand_ap"), F.count("n").alias("cand_folds"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        (F.coalesce(F.sum("no_count"), F.lit(0)) + F.coalesce(F.sum("not_raw"), F.lit(0))).alias("unclear"),
    ).where("cand_folds > 0")
    ok = F.col("ok") == 1
    keep = F.when(ok & (F.col("base_ap") > 0), ratio(F.col("cand_ap"), F.col("base_ap")))
    loss = 1 - F.col("ap_retention_ratio")
    counted = F.col("unclear") == 0
    return out.select(
        "baseline", "candidate", F.when(ok, F.col("base_ap")).alias("baseline_ap_mean"),
        F.when(ok, F.col("cand_ap")).alias("candidate_ap_mean"), keep.alias("ap_retention_ratio"),
        F.when(counted, F.col("hi")).alias("max_sensor_count_observed"),
        F.when(~counted, "undefined").when((F.col("lo") >= 1) & (F.col("hi") <= policy.max_sensor_count), "met")
        .otherwise("too_many_sensors").alias("sensor_status"),
    ).withColumn("ap_loss_ratio", loss).withColumn(
        "ap_status", F.when(loss.isNull(), "undefined").when(loss <= policy.target_ap_loss_ratio + 1e-12, "target_met")
        .when(loss <= policy.max_ap_loss_ratio + 1e-12, "allowed_below_target").otherwise("loss_too_large"))
