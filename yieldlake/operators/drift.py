"""Distribution change between an earlier and a later part of a sensor table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import column_bins, column_moments, column_quantiles, exact_quantiles
from ..functions.scalars import event_time, finite, ratio, to_long_text
from ..profile import ContractError, Profile
from ..scale import cut_lineage

RATIO_FLOOR = 1e-6
# Change that counts as priority 1.0 for each measure.
PRIORITY_UNITS = {
    "missing_ratio_delta": 0.10,
    "standardized_mean_difference": 0.50,
    "population_stability_index": 0.25,
    "unseen_category_ratio": 0.10,
    "category_distribution_tvd": 0.20,
}
REPORT_COLUMNS = (
    "feature", "feature_type", "train_missing_ratio", "validation_missing_ratio", "missing_ratio_delta",
    "train_mean", "validation_mean", "train_median", "validation_median",
    "standardized_mean_difference", "population_stability_index",
    "unseen_category_ratio", "category_distribution_tvd",
)


def psi_from_counts(counts: DataFrame, edges: DataFrame, keys: list[str], side: str,
                    train: str, later: str) -> DataFrame:
    """PSI per key from bin counts, with absent bins as zero and shares floored."""
    bins = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    wide = counts.groupBy(*keys, "bin").agg(
        F.coalesce(F.sum(F.when(F.col(side) == train, F.col("n"))), F.lit(0)).alias("t"),
        F.coalesce(F.sum(F.when(F.col(side) == later, F.col("n"))), F.lit(0)).alias("v"))
    totals = wide.groupBy(*keys).agg(F.sum("t").alias("tt"), F.sum("v").alias("vv"))
    filled = bins.join(wide, [*keys, "bin"], "left").join(totals, keys).where("tt > 0 and vv > 0")
    t = F.greatest(F.coalesce("t", F.lit(0)) / F.col("tt"), F.lit(RATIO_FLOOR))
    v = F.greatest(F.coalesce("v", F.lit(0)) / F.col("vv"), F.lit(RATIO_FLOOR))
    return filled.groupBy(*keys).agg(F.sum((v - t) * F.ln(v / t)).alias("population_stability_index"))


def psi(long: DataFrame, side: str, train: str, later: str, bins: int = 10) -> DataFrame:
    """PSI per feature of long rows ``(feature, value, side)``; features without 3 edges are absent."""
    seen = long.where(finite(F.col("value")).isNotNull())
    probs = [i / bins for i in range(bins + 1)]
    edges = cut_lineage(exact_quantiles(seen.where(F.col(side) == train), ["feature"], "value", probs, "edges").select(
        "feature", F.array_distinct("edges").alias("edges")).where(F.size("edges") >= 3))
    inner = F.filter(F.slice("edges", 2, F.size("edges") - 2), lambda e: e <= F.col("value"))
    # One row per feature of the schema: its size is bounded by the number of columns.
    counts = seen.join(F.broadcast(edges), "feature").withColumn("bin", F.size(inner)).groupBy("feature", "bin", side).agg(
        F.count(F.lit(1)).alias("n"))
    return psi_from_counts(counts, edges, ["feature"], side, train, later)


def quantile_edges(df: DataFrame, features: list[str], side: str, train: str, bins: int = 10) -> DataFrame:
    """``feature, edges``: the quantiles of the finite training values that bound equally filled bins."""
    probs = [i / bins for i in range(bins + 1)]
    return column_quantiles(df.where(F.col(side) == train), features, probs, name="edges", finite=True)


def column_psi(df: DataFrame, edges: DataFrame, side: str, train: str, later: str) -> DataFrame:
    """PSI per feature between the given bin edges; features with fewer than 3 distinct edges are absent.

    ``edges`` has one row per feature of the schema, so its size is bounded by the number of
    columns and it may be sent to the tasks.  Bins are half-open between the inner edges.
    """
    edges = edges.select("feature", F.array_distinct("edges").alias("edges")).where(F.size("edges") >= 3)
    inner = {r["feature"]: r["edges"][1:-1] for r in edges.collect()}
    return psi_from_counts(column_bins(df, inner, [side]), edges, ["feature"], side, train, later)


def numeric_drift(df: DataFrame, features: list[str], side: str, train: str = "train",
                  later: str = "validation", bins: int = 10) -> DataFrame:
    """Missing ratios, means, medians, SMD with population variance and PSI per numeric feature.

    Missing counts null and NaN; everything else is over finite values.
    """
    stored = cut_lineage(df.where(F.col(side).isin(train, later)).select(side, *features))

    def of(name: str, expr: Column) -> Column:
        return F.when(F.col(side) == name, expr)

    probs = [*[i / bins for i in range(bins + 1)], 0.5]
    moments = column_moments(stored, features, [side], finite=True).select(
        "feature", side, ratio(F.col("row_count") - F.col("seen_count"), F.col("row_count")).alias("missing_ratio"), "mean",
        F.sqrt(ratio(F.col("m2"), F.col("value_count"))).alias("std"))
    per_side = moments.join(column_quantiles(stored, features, probs, [side], "q", stored=True, finite=True), ["feature", side])
    # One row per feature; written, because edges and report both read it.
    wide = cut_lineage(per_side.groupBy("feature").agg(*[
        F.max(of(name, F.col(c))).alias(f"{tag}_{c}") for name, tag in ((train, "train"), (later, "validation"))
        for c in ("missing_ratio", "mean", "std", "q")]))
    edges = wide.select("feature", F.slice("train_q", 1, bins + 1).alias("edges"))
    pooled = F.sqrt((F.pow("train_std", 2) + F.pow("validation_std", 2)) / 2)
    return (
        wide.join(column_psi(stored, edges, side, train, later), "feature", "left")
        .select(
            "feature", F.lit("numeric").alias("feature_type"),
            "train_missing_ratio", "validation_missing_ratio",
            (F.col("validation_missing_ratio") - F.col("train_missing_ratio")).alias("missing_ratio_delta"),
            "train_mean", "validation_mean",
            F.get("train_q", F.lit(bins + 1)).alias("train_median"),
            F.get("validation_q", F.lit(bins + 1)).alias("validation_median"),
            ratio(F.col("validation_mean") - F.col("train_mean"), pooled).alias("standardized_mean_difference"),
            "population_stability_index",
            F.lit(None).cast("double").alias("unseen_category_ratio"),
            F.lit(None).cast("double").alias("category_distribution_tvd"))
    )


def categorical_drift(df: DataFrame, features: list[str], side: str, train: str = "train",
                      later: str = "validation") -> DataFrame:
    """Unseen-category ratio and total variation distance per categorical feature.

    Everything derives from one count per (feature, value), so a value that holds a
    third of the rows is combined before the shuffle.
    """
    long = to_long_text(df.where(F.col(side).isin(train, later)), features, [side])
    counts = long.groupBy("feature", "value").agg(
        F.count_if(F.col(side) == train).alias("t"), F.count_if(F.col(side) == later).alias("v"))
    seen = F.col("value").isNotNull()
    totals = counts.groupBy("feature").agg(
        F.sum("t").alias("t_all"), F.sum("v").alias("v_all"),
        F.coalesce(F.sum(F.when(seen, F.col("t"))), F.lit(0)).alias("t_seen"),
        F.coalesce(F.sum(F.when(seen, F.col("v"))), F.lit(0)).alias("v_seen"),
        F.coalesce(F.sum(F.when(seen & (F.col("t") == 0), F.col("v"))), F.lit(0)).alias("v_new"))
    distance = (
        counts.where(seen).join(F.broadcast(totals), "feature").groupBy("feature").agg(
            (F.sum(F.abs(ratio(F.col("t"), F.col("t_seen")) - ratio(F.col("v"), F.col("v_seen")))) / 2)
            .alias("category_distribution_tvd")))
    t_missing = ratio(F.col("t_all") - F.col("t_seen"), F.col("t_all"))
    v_missing = ratio(F.col("v_all") - F.col("v_seen"), F.col("v_all"))
    nothing = F.lit(None).cast("double")
    return totals.join(distance, "feature", "left").select(
        "feature", F.lit("categorical").alias("feature_type"),
        t_missing.alias("train_missing_ratio"), v_missing.alias("validation_missing_ratio"),
        (v_missing - t_missing).alias("missing_ratio_delta"),
        *[nothing.alias(c) for c in ("train_mean", "validation_mean", "train_median", "validation_median",
                                     "standardized_mean_difference", "population_stability_index")],
        ratio(F.col("v_new"), F.col("v_seen")).alias("unseen_category_ratio"),
        "category_distribution_tvd")


def with_priority(report: DataFrame) -> DataFrame:
    """Add the priority score (largest measure in its own unit, nulls skipped) and its band."""
    parts = [F.abs(F.col(c)) / F.lit(unit) for c, unit in PRIORITY_UNITS.items()]
    score = F.greatest(*parts)
    return report.withColumn("drift_priority_score", score).withColumn(
        "drift_priority",
        F.when(F.col("drift_priority_score") >= 1.0, "high")
        .when(F.col("drift_priority_score") >= 0.5, "medium").otherwise("low"))


def drift_report(df: DataFrame, profile: Profile, side: str, train: str = "train",
                 later: str = "validation", bins: int = 10) -> DataFrame:
    """One row per feature, largest change first."""
    features = profile.features([c for c in df.columns if c != side])
    numeric = [f for f in features if f not in profile.categorical]
    report = numeric_drift(df, numeric, side, train, later, bins) if numeric else None
    if profile.categorical:
        extra = categorical_drift(df, list(profile.categorical), side, train, later)
        report = extra if report is None else report.unionByName(extra)
    return with_priority(report).orderBy(
        F.desc_nulls_last("drift_priority_score"), F.desc_nulls_last("population_stability_index"),
        F.abs("standardized_mean_difference").desc_nulls_last(), "feature")


def label_drift(df: DataFrame, profile: Profile, side: str, train: str = "train",
                later: str = "validation") -> DataFrame:
    """Count, share and change of share for both labels."""
    label = F.col(profile.label)
    counts = df.agg(
        F.count_if(F.col(side) == train).alias("t_all"), F.count_if(F.col(side) == later).alias("v_all"),
        *[F.count_if((F.col(side) == s) & (label == F.lit(value))).alias(f"{t}{i}")
          for s, t in ((train, "t"), (later, "v"))
          for i, value in enumerate((profile.negative, profile.positive))])
    rows = F.array(*[
        F.struct(F.lit(str(value)).alias("label"), F.col(f"t{i}").alias("train_count"),
                 F.col(f"v{i}").alias("validation_count"),
                 ratio(F.col(f"t{i}"), F.col("t_all")).alias("train_ratio"),
                 ratio(F.col(f"v{i}"), F.col("v_all")).alias("validation_ratio"))
        for i, value in enumerate((profile.negative, profile.positive))])
    return counts.select(F.inline(rows)).withColumn(
        "ratio_delta", F.col("validation_ratio") - F.col("train_ratio"))


def flag_selected(report: DataFrame, selected: DataFrame) -> DataFrame:
    """Mark the report rows of selected sensors; an unknown or repeated name is an error."""
    bad = selected.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).join(
        report.select("feature", F.lit(1).alias("known")), "feature", "left"
    ).where("n > 1 or known is null or feature is null")
    if not bad.isEmpty():
        raise ContractError("selected sensors are repeated, null or absent from the report")
    marks = selected.select("feature", F.lit(True).alias("selected"))
    return report.join(marks, "feature", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def monthly_statistics(df: DataFrame, profile: Profile, side: str, features: list[str]) -> DataFrame:
    """Per (split, month, sensor): rows, observed values, mean, median and failures."""
    month = F.date_format(event_time(df, profile.timestamp, profile.timestamp_format), "yyyy-MM")
    failed = (F.col(profile.label) == F.lit(profile.positive)).cast("int").alias("failed")
    stored = cut_lineage(df.select(F.col(side).alias("split"), month.alias("month"), failed, *features))
    groups = ["split", "month"]
    keys = [*groups, "feature"]
    failures = stored.groupBy(*groups).agg(F.sum("failed").alias("failure_count"))
    stats = column_moments(stored, features, groups, finite=True).join(failures, groups).select(
        *keys, "row_count", F.col("value_count").alias("observed_count"),
        ratio(F.col("row_count") - F.col("value_count"), F.col("row_count")).alias("missing_ratio"), "mean", "failure_count")
    medians = column_quantiles(stored, features, [0.5], groups, "m", stored=True, finite=True).select(
        *keys, F.get("m", F.lit(0)).alias("median"))
    return stats.join(medians, keys).withColumn(
        "failure_ratio", ratio(F.col("failure_count"), F.col("row_count")))


def detail_summary(df: DataFrame, features: list[str], side: str) -> DataFrame:
    """Per (feature, split): rows, observed, missing ratio, min, p10, median, p90, max, population sigma."""
    stored = cut_lineage(df.select(F.col(side).alias("split"), *features))
    keys = ["feature", "split"]
    stats = column_moments(stored, features, ["split"]).select(
        *keys, "row_count", F.col("seen_count").alias("observed_count"),
        ratio(F.col("row_count") - F.col("seen_count"), F.col("row_count")).alias("missing_ratio"), "minimum", "maximum",
        F.sqrt(ratio(F.col("m2"), F.col("value_count"))).alias("std_pop"))
    q = column_quantiles(stored, features, [0.1, 0.5, 0.9], ["split"], "q", stored=True)
    return stats.join(q, keys).select(
        *keys, "row_count", "observed_count", "missing_ratio", "minimum",
        F.get("q", F.lit(0)).alias("p10"), F.get("q", F.lit(1)).alias("median"),
        F.get("q", F.lit(2)).alias("p90"), "maximum", "std_pop")
