"""Tie-aware ranking metrics, threshold tables and summaries of scored rows.

Rows are first combined per (keys, score), so ties and hot groups shrink before
any ordered work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ratio, ratio0
from ..profile import ContractError, Profile
from ..columns import exact_quantiles
from ..scale import join_on, running_sum

METRIC_COLUMNS = (
    "threshold", "support", "positive_support", "recall", "precision", "f1", "average_precision", "roc_auc",
    "true_negative", "false_positive", "false_negative", "true_positive",
)


def score_violations(df: DataFrame, profile: Profile, score: str, keys: list[str] | None = None,
                     probability: bool = True) -> DataFrame:
    """Counts of unusable scores and labels per key, and of groups without a positive row."""
    s, label = F.col(score).cast("double"), F.col(profile.label)
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == F.lit(float("inf")))
    outside = ((s < 0) | (s > 1)) if probability else F.lit(False)
    return df.groupBy(*(keys or [])).agg(
        F.count_if(bad).alias("bad_scores"),
        F.count_if(~bad & outside).alias("outside_scores"),
        F.count_if(label.isNull() | ~label.isin(profile.negative, profile.positive)).alias("bad_labels"),
        (F.count_if(label == F.lit(profile.positive)) == 0).cast("int").alias("no_positive"))


def require_scores(df: DataFrame, profile: Profile, score: str, keys: list[str] | None = None,
                   probability: bool = True) -> None:
    checks = score_violations(df, profile, score, keys, probability)
    worst = checks.agg(*[F.max(c).alias(c) for c in
                         ("bad_scores", "outside_scores", "bad_labels", "no_positive")]).first().asDict()
    if any(v is None or v for v in worst.values()):
        raise ContractError(f"scores or labels cannot be evaluated: {worst}")


def score_groups(df: DataFrame, profile: Profile, score: str, keys: list[str]) -> DataFrame:
    """Rows and positives per (keys, score)."""
    positive = F.col(profile.label) == F.lit(profile.positive)
    return df.groupBy(*keys, (F.col(score).cast("double") + F.lit(0.0)).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("pos"))


def score_curve(df: DataFrame, profile: Profile, score: str, keys: list[str],
                rows: int | None = None) -> DataFrame:
    """Score groups with the rows and positives at or above each score."""
    return running_sum(score_groups(df, profile, score, keys), [F.desc("score")], ["n", "pos"], keys, rows)


def confusion(table: DataFrame) -> DataFrame:
    """Add recall, precision, F1 and reinspection ratio to the four confusion counts."""
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return table.withColumns({
        "recall": ratio0(tp, tp + fn),
        "precision": ratio0(tp, tp + fp),
        "f1": ratio0(2 * tp, 2 * tp + fp + fn),
        "reinspection_ratio": ratio(tp + fp, F.col("support")),
    })


def metrics_from_curve(curve: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """All metrics per key from one aggregation of the curve; decision is ``score >= threshold``."""
    above = F.col("score") >= F.col("__t")
    neg = F.col("n") - F.col("pos")
    counted = curve.withColumn("__t", threshold.cast("double")).groupBy(*keys).agg(
        F.max("__t").alias("threshold"),
        F.sum("n").alias("support"), F.sum("pos").alias("positive_support"),
        F.coalesce(F.sum(F.when(above, F.col("pos"))), F.lit(0)).alias("true_positive"),
        F.coalesce(F.sum(F.when(above, neg)), F.lit(0)).alias("false_positive"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("__ap"),
        F.sum(neg * (F.col("cum_pos") - F.col("pos") / 2)).alias("__auc"))
    p, n = F.col("positive_support"), F.col("support") - F.col("positive_support")
    return confusion(counted.select(
        *keys, "threshold", "support", "positive_support",
        ratio(F.col("__ap"), p).alias("average_precision"),
        ratio(F.col("__auc"), p * n).alias("roc_auc"),
        (n - F.col("false_positive")).alias("true_negative"), "false_positive",
        (p - F.col("true_positive")).alias("false_negative"), "true_positive"))


def binary_metrics(df: DataFrame, profile: Profile, score: str, threshold: float | str, keys: list[str] | None = None,
                   rows: int | None = None) -> DataFrame:
    """Metric record per key.  ``threshold`` is a number or a column that is constant within a key."""
    keys = list(keys or [])
    if isinstance(threshold, str):
        held = [*keys, "__threshold"]
        curve = score_curve(df.withColumn("__threshold", F.col(threshold)), profile, score, held, rows)
        return metrics_from_curve(curve, held, F.col("__threshold")).drop("__threshold")
    return metrics_from_curve(score_curve(df, profile, score, keys, rows), keys, F.lit(threshold))


def pr_curve(df: DataFrame, profile: Profile, score: str, keys: list[str], rows: int | None = None) -> DataFrame:
    """Precision and recall at every distinct score, highest first."""
    groups = score_groups(df, profile, score, keys)
    totals = groups.groupBy(*keys).agg(F.sum("pos").alias("positive_support"))
    curve = join_on(running_sum(groups, [F.desc("score")], ["n", "pos"], keys, rows), totals, keys)
    return curve.select(
        *keys, F.col("score").alias("threshold"), ratio(F.col("cum_pos"), F.col("cum_n")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("positive_support")).alias("recall"),
        F.col("cum_pos").alias("true_positive"), (F.col("cum_n") - F.col("cum_pos")).alias("false_positive"))


def threshold_candidates(df: DataFrame, score: str, keys: list[str], default: float | None = 0.5,
                         steps: int = 100, above_max: bool = False) -> DataFrame:
    """Sorted distinct candidates per key: score quantiles, the default, optionally one above the maximum."""
    q = exact_quantiles(df, keys, score, [i / steps for i in range(steps + 1)], "candidates")
    found = F.col("candidates")
    if default is not None:
        found = F.concat(found, F.array(F.lit(float(default))))
    if above_max:
        found = F.concat(found, F.array(F.array_max("candidates") + 1))
    return q.select(*keys, F.array_sort(F.array_distinct(found)).alias("candidates"))


def threshold_table(df: DataFrame, profile: Profile, score: str, keys: list[str] | None = None,
                    candidates: DataFrame | None = None, default: float | None = 0.5,
                    rows: int | None = None) -> DataFrame:
    """Confusion counts and rates at each candidate threshold of each key.

    Every score group finds the number of candidates at or below it, so one count per
    (key, candidate) and a running total over at most ~100 candidates replace a
    scan per threshold or a sort of all scores.
    """
    keys = list(keys or [])
    if candidates is None:
        candidates = threshold_candidates(df, score, keys, default)
    groups = join_on(score_groups(df, profile, score, keys), candidates, keys)
    reached = F.size(F.filter("candidates", lambda c: c <= F.col("score")))
    held = groups.groupBy(*keys, reached.alias("slot")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    slots = candidates.select(*keys, F.posexplode("candidates").alias("slot", "threshold")).withColumn(
        "slot", F.col("slot") + 1)
    zero = F.lit(0).cast("bigint")
    base = candidates.select(*keys, F.lit(0).alias("slot"), F.lit(None).cast("double").alias("threshold"))
    filled = slots.unionByName(base).join(held, [*keys, "slot"], "left").withColumns({
        "n": F.coalesce("n", zero), "pos": F.coalesce("pos", zero)})
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    upward = per_key.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    swept = filled.select(
        *keys, "threshold",
        F.sum("n").over(per_key).alias("support"), F.sum("pos").over(per_key).alias("positive_support"),
        F.sum("n").over(upward).alias("flagged"), F.sum("pos").over(upward).alias("true_positive"),
    ).where("threshold is not null")
    return confusion(swept.select(
        *keys, "threshold", "support", "positive_support", "true_positive",
        (F.col("flagged") - F.col("true_positive")).alias("false_positive"),
        (F.col("positive_support") - F.col("true_positive")).alias("false_negative"),
        (F.col("support") - F.col("positive_support") - F.col("flagged") + F.col("true_positive"))
        .alias("true_negative")))


def full_threshold_table(df: DataFrame, profile: Profile, score: str, keys: list[str] | None = None,
                         ends: tuple[float, ...] = (0.0, 1.0), rows: int | None = None) -> DataFrame:
    """Like :func:`threshold_table` with every observed score and ``ends`` as candidates."""
    keys = list(keys or [])
    groups = score_groups(df, profile, score, keys)
    units = groups.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    added = units.select(*keys, F.explode(F.array(*map(F.lit, ends))).alias("score"),
                         F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"))
    merged = groups.unionByName(added).groupBy(*keys, "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    curve = running_sum(merged, [F.desc("score")], ["n", "pos"], keys, rows)
    totals = groups.groupBy(*keys).agg(F.sum("n").alias("support"), F.sum("pos").alias("positive_support"))
    return confusion(join_on(curve, totals, keys).select(
        *keys, F.col("score").alias("threshold"), "support", "positive_support",
        F.col("cum_pos").alias("true_positive"),
        (F.col("cum_n") - F.col("cum_pos")).alias("false_positive"),
        (F.col("positive_support") - F.col("cum_pos")).alias("false_negative"),
        (F.col("support") - F.col("positive_support") - F.col("cum_n") + F.col("cum_pos")).alias("true_negative")))


def fixed_threshold_table(df: DataFrame, profile: Profile, score: str, thresholds: list[float],
                          keys: list[str] | None = None) -> DataFrame:
    """Metrics of several frozen thresholds from one pass over the scores."""
    keys = list(keys or [])
    units = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    found = units.select(*keys, F.array_sort(F.array(*map(F.lit, thresholds))).alias("candidates"))
    return threshold_table(df, profile, score, keys, found)


def fold_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Means over folds and pooled rates from summed counts."""
    tp, fp, fn, tn = (F.sum(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    return results.groupBy(*keys).agg(
        F.avg("average_precision").alias("ap_mean"), F.stddev_pop("average_precision").alias("ap_std"),
        F.avg("roc_auc").alias("roc_auc_mean"), F.avg("recall").alias("recall_mean"),
        ratio0(tp, tp + fn).alias("pooled_recall"), ratio0(tp, tp + fp).alias("pooled_precision"),
        ratio(tp + fp, tp + fp + fn + tn).alias("alarm_ratio"),
        tp.alias("true_positive"), fp.alias("false_positive"), fn.alias("false_negative"), tn.alias("true_negative"))


def oof_coverage(train: DataFrame, oof: DataFrame, profile: Profile, keys: list[str]) -> DataFrame:
    """Train rows, rows with an inner prediction, rows without one, and failures covered."""
    everyone = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("train_samples"))
    covered = oof.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("oof_samples"),
        F.count_if(F.col(profile.label) == F.lit(profile.positive)).alias("oof_fail"))
    return everyone.join(covered, keys, "left").select(
        *keys, "train_samples", F.coalesce("oof_samples", F.lit(0)).alias("oof_samples"),
        (F.col("train_samples") - F.coalesce("oof_samples", F.lit(0))).alias("excluded_initial_samples"),
        F.coalesce("oof_fail", F.lit(0)).alias("oof_fail"))


def mean_scores(predictions: DataFrame, ids: list[str], score: str) -> DataFrame:
    """Mean score and number of predictions per row over repeated folds."""
    return predictions.groupBy(*ids).agg(F.avg(score).alias("oof_score"), F.count(score).alias("prediction_count"))


def score_distribution(df: DataFrame, profile: Profile, score: str, role: str, threshold: float) -> DataFrame:
    """Per (role, class): count, mean, p10, median, p90 and share at or above the threshold."""
    keys = [role, profile.label]
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg(score).alias("mean"),
        F.avg((F.col(score) >= threshold).cast("int")).alias("above_threshold_ratio"))
    q = exact_quantiles(df, keys, score, [0.1, 0.5, 0.9], "q")
    classes = F.array(F.lit(profile.negative), F.lit(profile.positive))
    grid = df.select(role).distinct().select(role, F.explode(classes).alias(profile.label))
    return grid.join(stats, keys, "left").join(q, keys, "left").select(
        *keys, F.coalesce("count", F.lit(0)).alias("count"), "mean", F.get("q", F.lit(0)).alias("p10"),
        F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("p90"), "above_threshold_ratio")


def role_metrics(df: DataFrame, profile: Profile, score: str, role: str, threshold: float,
                 rows: int | None = None) -> DataFrame:
    """Metric record per role with prevalence and alarm ratio."""
    return binary_metrics(df, profile, score, threshold, [role], rows).withColumn(
        "positive_prevalence", ratio(F.col("positive_support"), F.col("support")))


def evaluation_mismatch(predictions: DataFrame, stored: DataFrame, profile: Profile, score: str,
                        decision: str, threshold: str, keys: list[str]) -> DataFrame:
    """Per key: wrong stored decisions and the largest gap between stored and recomputed metrics."""
    wrong = predictions.groupBy(*keys).agg(F.count_if(
        F.col(decision) != (F.col(score) >= F.col(threshold))).alias("wrong_decisions"))
    again = binary_metrics(predictions, profile, score, threshold, keys)
    names = ["recall", "precision", "f1", "average_precision", "true_positive", "false_positive"]
    gap = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"s.{c}")) for c in names])
    joined = again.alias("a").join(stored.alias("s"), keys)
    gaps = joined.groupBy(*keys).agg(F.max(gap).cast("double").alias("largest_gap"))
    return wrong.join(gaps, keys, "left")
