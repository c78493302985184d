"""Error analysis of scored rows: confusion groups and per-sensor differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import known, ratio, to_long
from ..profile import Profile
from ..columns import column_moments, column_quantiles
from ..scale import cut_lineage

# Order of the confusion groups.
ERROR_GROUPS = ("TP", "FN", "FP", "TN")


def assign_error_groups(df: DataFrame, profile: Profile, score: str, threshold: float) -> DataFrame:
    failed = F.col(profile.label) == F.lit(profile.positive)
    flagged = F.col(score) >= threshold
    return df.withColumn("error_group", F.when(failed & flagged, "TP").when(failed, "FN")
                         .when(flagged, "FP").otherwise("TN"))


def error_group_summary(cases: DataFrame, features: list[str], score: str) -> DataFrame:
    """Count, mean and median score and row missing ratio of all four groups."""
    missing = sum((known(F.col(f).cast("double")).isNull().cast("int") for f in features), F.lit(0)) \
        if len(features) <= 64 else F.aggregate(
            F.array(*[F.isnull(f) for f in features]), F.lit(0), lambda a, x: a + x.cast("int"))
    work = cut_lineage(cases.select("error_group", F.col(score).alias("score"),
                                    (missing / F.lit(len(features))).alias("row_missing_ratio")))
    stats = work.groupBy("error_group").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("score").alias("score_mean"),
        F.avg("row_missing_ratio").alias("row_missing_ratio_mean"))
    both = column_quantiles(work, ["score", "row_missing_ratio"], [0.5], ["error_group"], "q", stored=True).groupBy("error_group").agg(
        F.max(F.when(F.col("feature") == "score", F.col("q"))).alias("sm"),
        F.max(F.when(F.col("feature") != "score", F.col("q"))).alias("rm"))
    groups = cases.sparkSession.createDataFrame([(g,) for g in ERROR_GROUPS], "error_group string")
    return (
        groups.join(stats, "error_group", "left").join(both, "error_group", "left")
        .select("error_group", F.coalesce("sample_count", F.lit(0)).alias("sample_count"), "score_mean",
                F.get("sm", F.lit(0)).alias("score_median"), "row_missing_ratio_mean",
                F.get("rm", F.lit(0)).alias("row_missing_ratio_median"))
    )


def compare_error_features(cases: DataFrame, features: list[str], drift: DataFrame | None = None) -> DataFrame:
    """Per sensor: FN and FP against TN by missing ratio, median and sample-variance SMD."""
    stored = cut_lineage(cases.where("error_group <> 'TP'").select("error_group", *features))
    found = column_moments(stored, features, ["error_group"])
    aggs = []
    for g in ("FN", "FP", "TN"):
        def mine(c, g=g):
            return F.max(F.when(F.col("error_group") == g, c))

        aggs += [mine(ratio(F.col("row_count") - F.col("seen_count"), F.col("row_count"))).alias(f"{g}_missing"),
                 F.coalesce(mine(F.col("value_count")), F.lit(0)).alias(f"{g}_n"), mine(F.col("mean")).alias(f"{g}_mean"),
                 mine(ratio(F.col("m2"), F.col("value_count") - 1)).alias(f"{g}_var")]
    stats = found.groupBy("feature").agg(*aggs)
    medians = column_quantiles(
        stored.where("error_group in ('FN', 'TN')"), features, [0.5], ["error_group"], "q", stored=True,
    ).groupBy("feature").agg(
        F.max(F.when(F.col("error_group") == "FN", F.get("q", F.lit(0)))).alias("fn_median"),
        F.max(F.when(F.col("error_group") == "TN", F.get("q", F.lit(0)))).alias("tn_median"))

    def smd(g: str):
        pooled = F.sqrt((F.col(f"{g}_var") + F.col("TN_var")) / 2)
        enough = (F.col(f"{g}_n") >= 2) & (F.col("TN_n") >= 2)
        return F.when(enough, ratio(F.col(f"{g}_mean") - F.col("TN_mean"), pooled))

    out = stats.join(medians, "feature", "left").select(
        "feature", F.col("FN_missing").alias("fn_missing_ratio"), F.col("TN_missing").alias("tn_missing_ratio"),
        (F.col("FN_missing") - F.col("TN_missing")).alias("fn_vs_tn_missing_ratio_delta"),
        "fn_median", "tn_median", smd("FN").alias("fn_vs_tn_standardized_mean_difference"),
        F.col("FP_missing").alias("fp_missing_ratio"), smd("FP").alias("fp_vs_tn_standardized_mean_difference"),
    ).withColumn("absolute_fn_vs_tn_smd", F.abs("fn_vs_tn_standardized_mean_difference"))
    if drift is None:
        return out.orderBy(F.desc_nulls_last("absolute_fn_vs_tn_smd"), "feature")
    marks = drift.select("feature", "drift_priority", "drift_priority_score")
    return out.join(marks, "feature", "left").orderBy(
        F.desc_nulls_last("drift_priority_score"), F.desc_nulls_last("absolute_fn_vs_tn_smd"), "feature")


def fn_drift_candidates(compared: DataFrame, limit: int | None = None) -> DataFrame:
    """Sensors by how far missed failures differ from true negatives; the first ``limit`` where one is given."""
    ranked = compared.orderBy(F.desc_nulls_last("absolute_fn_vs_tn_smd"), "feature")
    return ranked if limit is None else ranked.limit(limit)
