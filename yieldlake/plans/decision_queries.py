"""Queries over scored rows: metrics, thresholds, policy, errors and stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import drift, errors, leakage, metrics, policy, stability
from ..operators.splits import fold_membership, time_blocks, time_split
from ..profile import ReductionPolicy, ThresholdPolicy
from ..scale import as_of_join
from ..sources.tables import NUMERIC_PROFILE, SENSORS, event_results, score_frame, table
from . import sql
from .registry import query

POLICY = ThresholdPolicy(min_recall=0.8, max_reinspection_ratio=0.81)
_METRICS = ("support, positive_support, recall, precision, f1, average_precision, roc_auc, true_negative, "
            "false_positive, false_negative, true_positive, reinspection_ratio")
_TABLE = """support, positive_support, true_positive, false_positive, false_negative, true_negative,
ROUND(recall, 6) AS recall, ROUND(precision, 6) AS precision, ROUND(f1, 6) AS f1,
ROUND(reinspection_ratio, 6) AS reinspection_ratio"""


def _table(spark, folder):
    return metrics.threshold_table(score_frame(spark, folder), NUMERIC_PROFILE, "score", ["fold"])


@query("M1 M2 M3", f"""WITH {sql.B2}, {sql.curve('b2', 'fold')}, {sql.metrics('fold', '0.5')}
SELECT fold, CAST(0.5 AS DOUBLE) AS threshold, {_METRICS} FROM mr""")
def binary_metrics(spark, folder):
    return rounded(metrics.binary_metrics(score_frame(spark, folder), NUMERIC_PROFILE, "score", 0.5, ["fold"]))


@query("M1 M2 M3 L18", f"""WITH {sql.B2}, b3 AS (SELECT * REPLACE (sensor_1 AS score) FROM b2),
{sql.curve('b3', 'fold')}, {sql.metrics('fold', '5000')}
SELECT fold, CAST(5000 AS DOUBLE) AS threshold, {_METRICS} FROM mr""")
def unbounded_score_metrics(spark, folder):
    """Anomaly-style scores without the 0-1 range."""
    frame = score_frame(spark, folder).withColumn("score", F.col("sensor_1"))
    return rounded(metrics.binary_metrics(frame, NUMERIC_PROFILE, "score", 5000.0, ["fold"]))


@query("M1", f"""WITH {sql.B2} SELECT fold, CAST(0 AS BIGINT) AS bad_scores,
COUNT(*) FILTER (sensor_1 / 1000 < 0 OR sensor_1 / 1000 > 1) AS outside_scores, CAST(0 AS BIGINT) AS bad_labels,
CASE WHEN COUNT(*) FILTER (label = 1) = 0 THEN 1 ELSE 0 END AS no_positive FROM b2 GROUP BY fold""")
def score_contract(spark, folder):
    frame = score_frame(spark, folder).withColumn("score", F.col("sensor_1") / 1000)
    return metrics.score_violations(frame, NUMERIC_PROFILE, "score", ["fold"])


@query("M21", f"""WITH {sql.B2}, {sql.curve('b2', 'fold')}, t AS (SELECT fold, SUM(pos) AS p FROM sg GROUP BY fold)
SELECT cv.fold, score AS threshold, ROUND(cp / CAST(cn AS DOUBLE), 6) AS precision, ROUND(cp / CAST(p AS DOUBLE), 6) AS recall,
CAST(cp AS BIGINT) AS true_positive, CAST(cn - cp AS BIGINT) AS false_positive FROM cv JOIN t ON cv.fold = t.fold""")
def pr_curve_points(spark, folder):
    return rounded(metrics.pr_curve(score_frame(spark, folder), NUMERIC_PROFILE, "score", ["fold"]))


@query("M4", f"""WITH {sql.B2}, {sql.thresholds('b2', 'fold')} SELECT fold, ROUND(threshold, 6) AS threshold, {_TABLE} FROM tt""")
def threshold_table(spark, folder):
    return rounded(_table(spark, folder))


@query("M4 M11", f"""WITH {sql.B2}, cd AS (SELECT DISTINCT fold, score AS threshold FROM b2 UNION
 SELECT fold, UNNEST([0.0, 1.0]::DOUBLE[]) FROM (SELECT DISTINCT fold FROM b2)),
g AS (SELECT fold, score, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS pos FROM b2 GROUP BY fold, score),
tc AS (SELECT cd.fold, threshold, SUM(n) AS n, SUM(pos) AS p, COALESCE(SUM(n) FILTER (score >= threshold), 0) AS fl,
 COALESCE(SUM(pos) FILTER (score >= threshold), 0) AS tp FROM g JOIN cd ON g.fold = cd.fold GROUP BY cd.fold, threshold)
SELECT fold, threshold, CAST(tp AS BIGINT) AS true_positive, CAST(fl - tp AS BIGINT) AS false_positive,
ROUND(tp / CAST(p AS DOUBLE), 6) AS recall, ROUND(CASE WHEN fl = 0 THEN 0 ELSE tp / CAST(fl AS DOUBLE) END, 6) AS precision,
ROUND(fl / CAST(n AS DOUBLE), 6) AS reinspection_ratio FROM tc""")
def full_threshold_table(spark, folder):
    out = metrics.full_threshold_table(score_frame(spark, folder), NUMERIC_PROFILE, "score", ["fold"])
    return rounded(out.select("fold", "threshold", "true_positive", "false_positive", "recall", "precision",
                              "reinspection_ratio"))


@query("L24", f"""WITH {sql.B2}, t AS (SELECT UNNEST([0.2, 0.5, 0.9]::DOUBLE[]) AS threshold),
c AS (SELECT threshold, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS p, COUNT(*) FILTER (score >= threshold) AS fl,
COUNT(*) FILTER (score >= threshold AND label = 1) AS tp FROM b2, t GROUP BY threshold)
SELECT threshold, tp AS true_positive, fl - tp AS false_positive, ROUND(tp / CAST(p AS DOUBLE), 6) AS recall,
ROUND(tp / CAST(fl AS DOUBLE), 6) AS precision FROM c""")
def many_thresholds_one_pass(spark, folder):
    out = metrics.fixed_threshold_table(score_frame(spark, folder), NUMERIC_PROFILE, "score", [0.2, 0.5, 0.9])
    return rounded(out.select("threshold", "true_positive", "false_positive", "recall", "precision"))


@query("M5", f"""WITH {sql.B2}, {sql.thresholds('b2', 'fold')} SELECT fold, CAST(0 AS BIGINT) AS bad_numbers,
CAST(0 AS BIGINT) AS outside_range, CAST(0 AS BIGINT) AS bad_counts, CAST(0 AS BIGINT) AS inconsistent_counts,
COUNT(*) FILTER (fold = 3 AND ABS(recall - (recall + 1) / 2) > 1e-10) AS recall_mismatch, 0 AS mixed_support
FROM tt GROUP BY fold""")
def threshold_table_contract(spark, folder):
    """Fold 3 carries a falsified recall that the check must count."""
    out = _table(spark, folder).withColumn(
        "recall", F.when(F.col("fold") == 3, (F.col("recall") + 1) / 2).otherwise(F.col("recall")))
    return policy.candidate_violations(out, ["fold"])


_PICK = "ROW_NUMBER() OVER (PARTITION BY fold ORDER BY {order}) AS rn"


@query("M5 M6", f"""WITH {sql.B2}, {sql.thresholds('b2', 'fold')},
f AS (SELECT *, {_PICK.format(order='reinspection_ratio, recall DESC, threshold DESC')} FROM tt
 WHERE recall >= 0.8 AND reinspection_ratio <= 0.81)
SELECT k.fold, ROUND(threshold, 6) AS threshold, ROUND(recall, 6) AS recall,
ROUND(reinspection_ratio, 6) AS reinspection_ratio,
CASE WHEN threshold IS NULL THEN 'infeasible' ELSE 'feasible' END AS policy_status
FROM (SELECT DISTINCT fold FROM b2) k LEFT JOIN (SELECT * FROM f WHERE rn = 1) f ON f.fold = k.fold""")
def policy_threshold(spark, folder):
    return rounded(policy.select_policy_threshold(_table(spark, folder), POLICY, ["fold"]))


@query("M7", f"""WITH {sql.B2}, {sql.thresholds('b2', 'fold')},
f AS (SELECT *, {_PICK.format(order='f1 DESC, threshold')} FROM tt)
SELECT fold, ROUND(threshold, 6) AS threshold, ROUND(f1, 6) AS f1 FROM f WHERE rn = 1""")
def best_f1_threshold(spark, folder):
    return rounded(policy.best_f1_threshold(_table(spark, folder), ["fold"]))


@query("M8", f"""WITH {sql.B2}, {sql.thresholds('b2', 'fold')}, g AS (SELECT UNNEST([0.8, 0.9]::DOUBLE[]) AS target_recall),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fold, target_recall ORDER BY reinspection_ratio, precision DESC, threshold DESC)
 AS rn FROM tt, g WHERE recall >= target_recall)
SELECT fold, target_recall, ROUND(threshold, 6) AS threshold, ROUND(recall, 6) AS recall, ROUND(precision, 6) AS precision,
ROUND(f1, 6) AS f1, ROUND(reinspection_ratio, 6) AS reinspection_ratio FROM f WHERE rn = 1""")
def recall_target_scenarios(spark, folder):
    return rounded(policy.recall_target_choices(_table(spark, folder), ["fold"]))


@query("M9", f"""WITH {sql.B2}, {sql.thresholds('b2', 'fold')}, g AS (SELECT UNNEST([0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS target_recall),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fold, target_recall ORDER BY precision DESC, f1 DESC, threshold DESC)
 AS rn FROM tt, g WHERE recall >= target_recall)
SELECT fold, target_recall, ROUND(threshold, 6) AS threshold, ROUND(recall, 6) AS recall, ROUND(precision, 6) AS precision,
ROUND(f1, 6) AS f1, 'candidate' AS status FROM f WHERE rn = 1""")
def best_precision_at_recall(spark, folder):
    return rounded(policy.best_precision_by_recall(_table(spark, folder), ["fold"]))


@query("M10", f"""WITH {sql.B2}, {sql.thresholds('b2', 'fold')}, g AS (SELECT UNNEST([0.8, 0.9]::DOUBLE[]) AS target),
f AS (SELECT fold, target, threshold, recall, reinspection_ratio, 'recall_target' AS scenario,
 ROW_NUMBER() OVER (PARTITION BY fold, target ORDER BY reinspection_ratio, recall DESC, threshold DESC) AS rn
 FROM tt, g WHERE recall >= target
 UNION ALL SELECT fold, 0.2, threshold, recall, reinspection_ratio, 'alarm_limit',
 ROW_NUMBER() OVER (PARTITION BY fold ORDER BY recall DESC, reinspection_ratio, threshold DESC)
 FROM tt WHERE reinspection_ratio <= 0.2)
SELECT fold, CAST(target AS DOUBLE) AS target, ROUND(threshold, 6) AS threshold, ROUND(recall, 6) AS recall,
ROUND(reinspection_ratio, 6) AS reinspection_ratio, scenario, 'candidate' AS status FROM f WHERE rn = 1""")
def alarm_and_recall_scenarios(spark, folder):
    return rounded(policy.alarm_and_recall_scenarios(_table(spark, folder), ["fold"], (0.8, 0.9), 0.2))


def _two_variants(spark, folder):
    frame = score_frame(spark, folder)
    other = frame.withColumn("score", ((F.col("row_id") * 104729) % 1000) / F.lit(1000.0))
    return frame.withColumn("variant", F.lit("a")).unionByName(other.withColumn("variant", F.lit("b")))


_VARIANTS = """v AS (SELECT 'a' AS variant, row_id, label, score FROM b2 UNION ALL
SELECT 'b', row_id, label, ((row_id * 104729) % 1000) / CAST(1000.0 AS DOUBLE) FROM b2)"""


@query("M11 M22", f"""WITH {sql.B2}, {_VARIANTS}, {sql.curve('v', 'variant')}, {sql.metrics('variant', '0.5')}
SELECT variant, CAST(0.5 AS DOUBLE) AS threshold, {_METRICS} FROM mr""")
def two_variant_comparison(spark, folder):
    """Metric rows of two scorers after the check that both scored the same rows."""
    both = _two_variants(spark, folder)
    a, b = both.where("variant = 'a'"), both.where("variant = 'b'")
    gaps = leakage.same_rows(a, b, ["row_id", "label"]).first()
    if gaps.only_left or gaps.only_right or gaps.repeated_keys:
        raise ValueError("the variants were scored on different rows")
    return rounded(metrics.binary_metrics(both, NUMERIC_PROFILE, "score", 0.5, ["variant"]))


@query("M12", f"""WITH {sql.B2}, past AS (SELECT * FROM b2 WHERE fold < 3), {sql.thresholds('past', 'fold')},
g AS (SELECT UNNEST([0.8, 0.9]::DOUBLE[]) AS target_recall),
c AS (SELECT fold, target_recall, threshold FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fold, target_recall
 ORDER BY reinspection_ratio, precision DESC, threshold DESC) AS rn FROM tt, g WHERE recall >= target_recall) WHERE rn = 1),
nx AS (SELECT * REPLACE (fold - 3 AS fold) FROM b2 WHERE fold >= 3)
SELECT c.fold, c.target_recall, ROUND(MAX(c.threshold), 6) AS threshold, COUNT(*) AS support,
COUNT(*) FILTER (label = 1 AND score >= threshold) AS true_positive,
COUNT(*) FILTER (label <> 1 AND score >= threshold) AS false_positive
FROM c JOIN nx ON nx.fold = c.fold GROUP BY c.fold, c.target_recall""")
def thresholds_on_next_period(spark, folder):
    frame = score_frame(spark, folder)
    past = metrics.threshold_table(frame.where("fold < 3"), NUMERIC_PROFILE, "score", ["fold"])
    chosen = policy.recall_target_choices(past, ["fold"])
    future = frame.where("fold >= 3").withColumn("fold", F.col("fold") - 3)
    out = policy.apply_thresholds(chosen, future, NUMERIC_PROFILE, "score", ["fold"], ["target_recall"])
    return rounded(out.where("support is not null").select(
        "fold", "target_recall", "threshold", "support", "true_positive", "false_positive"))


@query("M15", f"""WITH {sql.B2}, {sql.thresholds('b2', 'fold')},
f AS (SELECT fold, threshold AS th FROM (SELECT *, {_PICK.format(order='reinspection_ratio, recall DESC, threshold DESC')}
 FROM tt WHERE recall >= 0.8 AND reinspection_ratio <= 0.81) WHERE rn = 1),
nx AS (SELECT * REPLACE ((fold + 4) % 5 AS fold) FROM b2),
m AS (SELECT f.fold, MAX(th) AS th, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS p, COUNT(*) FILTER (score >= th) AS fl,
 COUNT(*) FILTER (label = 1 AND score >= th) AS tp FROM f JOIN nx ON nx.fold = f.fold GROUP BY f.fold)
SELECT k.fold, ROUND(th, 6) AS threshold, ROUND(tp / CAST(p AS DOUBLE), 6) AS recall,
ROUND(fl / CAST(n AS DOUBLE), 6) AS reinspection_ratio,
CASE WHEN th IS NULL THEN 'infeasible' ELSE 'feasible' END AS policy_status,
tp / CAST(p AS DOUBLE) >= 0.8 AND fl / CAST(n AS DOUBLE) <= 0.81 AS evaluation_meets_policy
FROM (SELECT DISTINCT fold FROM b2) k LEFT JOIN m ON m.fold = k.fold""")
def policy_outcome(spark, folder):
    frame = score_frame(spark, folder)
    chosen = policy.select_policy_threshold(_table(spark, folder), POLICY, ["fold"])
    future = frame.withColumn("fold", (F.col("fold") + 4) % 5)
    out = policy.policy_outcome(chosen, future, NUMERIC_PROFILE, "score", ["fold"], POLICY)
    return rounded(out.select("fold", "threshold", "recall", "reinspection_ratio", "policy_status",
                              "evaluation_meets_policy"))


@query("M16", f"""WITH {sql.B2}, {sql.thresholds('b2', 'fold')},
f AS (SELECT *, {_PICK.format(order='reinspection_ratio, recall DESC, threshold DESC')} FROM tt
 WHERE recall >= 0.5 AND reinspection_ratio <= 0.6)
SELECT k.fold, ROUND(threshold, 6) AS threshold, ROUND(recall, 6) AS recall,
ROUND(reinspection_ratio, 6) AS reinspection_ratio,
CASE WHEN threshold IS NULL THEN 'infeasible' ELSE 'feasible' END AS policy_status, 'policy' AS change
FROM (SELECT DISTINCT fold FROM b2) k LEFT JOIN (SELECT * FROM f WHERE rn = 1) f ON f.fold = k.fold""")
def policy_reselected_from_stored(spark, folder):
    return rounded(policy.reselect_from_stored(_table(spark, folder), ThresholdPolicy(0.5, 0.6), ["fold"]))


@query("P12", f"""WITH {sql.B2}, {sql.thresholds('b2', 'fold')} SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS wrong_dataset_id,
COUNT(*) FILTER (fold = 4) AS wrong_experiment, CAST(0 AS BIGINT) AS bad_thresholds,
COUNT(*) FILTER (threshold = 0.5) AS listed FROM tt""")
def threshold_report_provenance(spark, folder):
    report = _table(spark, folder).withColumns({
        "dataset_id": F.lit("orders_sensor"), "experiment": F.when(F.col("fold") == 4, "other").otherwise("base")})
    return policy.report_provenance(report, {"dataset_id": "orders_sensor", "experiment": "base"}, 0.5)


@query("M13", """WITH e AS (SELECT event_type AS model_name, user_id % 3 AS outer_fold, (event_id % 100) / CAST(100.0 AS DOUBLE) AS ap,
 event_id % 7 AS tp, event_id % 11 AS fp, event_id % 5 AS fn, event_id % 13 AS tn FROM events)
SELECT model_name, outer_fold, ROUND(AVG(ap), 6) AS ap_mean, ROUND(STDDEV_POP(ap), 6) AS ap_std,
ROUND(AVG(1 - ap), 6) AS roc_auc_mean, ROUND(AVG(ap / 2), 6) AS recall_mean,
ROUND(SUM(tp) / CAST(SUM(tp + fn) AS DOUBLE), 6) AS pooled_recall,
ROUND(SUM(tp) / CAST(SUM(tp + fp) AS DOUBLE), 6) AS pooled_precision,
ROUND(SUM(tp + fp) / CAST(SUM(tp + fp + fn + tn) AS DOUBLE), 6) AS alarm_ratio, CAST(SUM(tp) AS BIGINT) AS true_positive,
CAST(SUM(fp) AS BIGINT) AS false_positive, CAST(SUM(fn) AS BIGINT) AS false_negative, CAST(SUM(tn) AS BIGINT) AS true_negative
FROM e GROUP BY model_name, outer_fold""")
def fold_summary(spark, folder):
    rows = event_results(spark, folder).withColumns({
        "average_precision": F.col("ap"), "roc_auc": 1 - F.col("ap"), "recall": F.col("ap") / 2,
        "true_positive": F.col("event_id") % 7, "false_positive": F.col("event_id") % 11,
        "false_negative": F.col("event_id") % 5, "true_negative": F.col("event_id") % 13})
    return rounded(metrics.fold_summary(rows, ["model_name", "outer_fold"]))


@query("M14", f"""WITH {sql.B1}, {sql.blocks('b1', 2)} SELECT 'all' AS model, COUNT(*) AS train_samples,
COUNT(*) FILTER (block > 0) AS oof_samples, COUNT(*) FILTER (block = 0) AS excluded_initial_samples,
COUNT(*) FILTER (block > 0 AND label = 1) AS oof_fail FROM bl""")
def oof_coverage(spark, folder):
    blocked = time_blocks(score_frame(spark, folder), NUMERIC_PROFILE, 2).withColumn("model", F.lit("all"))
    return metrics.oof_coverage(blocked, blocked.where("block > 0"), NUMERIC_PROFILE, ["model"])


@query("L8", f"""WITH {sql.B2} SELECT row_id, label, ROUND(AVG(s), 6) AS oof_score, CAST(3 AS BIGINT) AS prediction_count
FROM (SELECT row_id, label, ((row_id * (7919 + r)) % 1000) / CAST(1000.0 AS DOUBLE) AS s
FROM b2, (SELECT UNNEST([0, 1, 2]) AS r)) GROUP BY row_id, label""")
def repeated_oof_mean(spark, folder):
    frame = score_frame(spark, folder).select("row_id", "label", F.explode(F.array(*map(F.lit, range(3)))).alias("r"))
    scored = frame.withColumn("score", ((F.col("row_id") * (F.lit(7919) + F.col("r"))) % 1000) / F.lit(1000.0))
    return rounded(metrics.mean_scores(scored, ["row_id", "label"], "score"))


@query("R14", f"""WITH {sql.B2}, s AS (SELECT CASE WHEN fold < 3 THEN 'train_oof' ELSE 'time_validation' END AS role, * FROM b2)
SELECT role, label, COUNT(*) AS count, ROUND(AVG(score), 6) AS mean, ROUND(quantile_cont(score, 0.1), 6) AS p10,
ROUND(quantile_cont(score, 0.5), 6) AS median, ROUND(quantile_cont(score, 0.9), 6) AS p90,
ROUND(COUNT(*) FILTER (score >= 0.4) / CAST(COUNT(*) AS DOUBLE), 6) AS above_threshold_ratio FROM s GROUP BY role, label""")
def score_distribution(spark, folder):
    frame = score_frame(spark, folder).withColumn(
        "role", F.when(F.col("fold") < 3, "train_oof").otherwise("time_validation"))
    return rounded(metrics.score_distribution(frame, NUMERIC_PROFILE, "score", "role", 0.4))


@query("R14 M1", f"""WITH {sql.B2}, s AS (SELECT CASE WHEN fold < 3 THEN 'train_oof' ELSE 'time_validation' END AS role, * FROM b2),
{sql.curve('s', 'role')}, {sql.metrics('role', '0.4')}
SELECT role, CAST(0.4 AS DOUBLE) AS threshold, {_METRICS}, ROUND(positive_support / CAST(support AS DOUBLE), 6) AS positive_prevalence
FROM mr""")
def role_metrics(spark, folder):
    frame = score_frame(spark, folder).withColumn(
        "role", F.when(F.col("fold") < 3, "train_oof").otherwise("time_validation"))
    return rounded(metrics.role_metrics(frame, NUMERIC_PROFILE, "score", "role", 0.4))


@query("P11", f"""WITH {sql.B2} SELECT fold, COUNT(*) FILTER (row_id % 100 = 0) AS wrong_decisions,
CAST(0.0 AS DOUBLE) AS largest_gap FROM b2 GROUP BY fold""")
def prediction_log_integrity(spark, folder):
    """Every hundredth stored decision is flipped; stored metrics agree with the recomputed ones."""
    frame = score_frame(spark, folder).withColumn("threshold", F.lit(0.3)).withColumn(
        "decision", (F.col("score") >= 0.3) != (F.col("row_id") % 100 == 0))
    stored = metrics.binary_metrics(frame, NUMERIC_PROFILE, "score", 0.3, ["fold"])
    return rounded(metrics.evaluation_mismatch(
        frame, stored, NUMERIC_PROFILE, "score", "decision", "threshold", ["fold"]))


@query("P13", f"""WITH {sql.B1}, {sql.blocks('b1', 2)} SELECT CAST(0 AS BIGINT) AS only_left,
COUNT(*) FILTER (block > 0 AND row_id % 50 = 0) AS only_right, CAST(0 AS BIGINT) AS repeated_keys FROM bl""")
def oof_evidence(spark, folder):
    """Stored OOF rows, one in fifty lost, against the recomputed fold blocks."""
    blocked = time_blocks(score_frame(spark, folder), NUMERIC_PROFILE, 2).where("block > 0")
    return leakage.same_rows(blocked.where("row_id % 50 <> 0"), blocked, ["row_id", "label", "block"])


_CASES = f"""{sql.B2}, ca AS (SELECT *, CASE WHEN label = 1 AND score >= 0.5 THEN 'TP' WHEN label = 1 THEN 'FN'
WHEN score >= 0.5 THEN 'FP' ELSE 'TN' END AS error_group FROM b2)"""


def _cases(spark, folder):
    return errors.assign_error_groups(score_frame(spark, folder), NUMERIC_PROFILE, "score", 0.5)


@query("M17", f"WITH {_CASES} SELECT row_id, error_group FROM ca")
def error_groups(spark, folder):
    return _cases(spark, folder).select("row_id", "error_group")


_MISS = " + ".join(f"CASE WHEN {f} IS NULL THEN 1 ELSE 0 END" for f in sql.FEATURES)


@query("M18", f"""WITH {_CASES}, r AS (SELECT error_group, score, ({_MISS}) / CAST(6 AS DOUBLE) AS m FROM ca)
SELECT error_group, COUNT(*) AS sample_count, ROUND(AVG(score), 6) AS score_mean,
ROUND(quantile_cont(score, 0.5), 6) AS score_median, ROUND(AVG(m), 6) AS row_missing_ratio_mean,
ROUND(quantile_cont(m, 0.5), 6) AS row_missing_ratio_median FROM r GROUP BY error_group""")
def error_group_summary(spark, folder):
    return rounded(errors.error_group_summary(_cases(spark, folder), SENSORS, "score"))


def _smd(g):
    return f"""CASE WHEN COUNT(value) FILTER (error_group = '{g}') >= 2 AND COUNT(value) FILTER (error_group = 'TN') >= 2
AND VAR_SAMP(value) FILTER (error_group = '{g}') + VAR_SAMP(value) FILTER (error_group = 'TN') > 0
THEN (AVG(value) FILTER (error_group = '{g}') - AVG(value) FILTER (error_group = 'TN'))
 / SQRT((VAR_SAMP(value) FILTER (error_group = '{g}') + VAR_SAMP(value) FILTER (error_group = 'TN')) / 2) END"""


def _gone(g):
    return (f"COUNT(*) FILTER (error_group = '{g}' AND value IS NULL) / "
            f"CAST(COUNT(*) FILTER (error_group = '{g}') AS DOUBLE)")


_COMPARED = f"""ef AS (SELECT feature, {_gone('FN')} AS fn_missing_ratio, {_gone('TN')} AS tn_missing_ratio,
{_gone('FN')} - {_gone('TN')} AS fn_vs_tn_missing_ratio_delta,
quantile_cont(value, 0.5) FILTER (error_group = 'FN') AS fn_median,
quantile_cont(value, 0.5) FILTER (error_group = 'TN') AS tn_median,
{_smd('FN')} AS fn_vs_tn_standardized_mean_difference, {_gone('FP')} AS fp_missing_ratio,
{_smd('FP')} AS fp_vs_tn_standardized_mean_difference, ABS({_smd('FN')}) AS absolute_fn_vs_tn_smd
FROM ({sql.long('ca', 'error_group')}) GROUP BY feature)"""
_EF = ["fn_missing_ratio", "tn_missing_ratio", "fn_vs_tn_missing_ratio_delta", "fn_median", "tn_median",
       "fn_vs_tn_standardized_mean_difference", "fp_missing_ratio", "fp_vs_tn_standardized_mean_difference",
       "absolute_fn_vs_tn_smd"]


@query("M19", f"""WITH {_CASES}, {_COMPARED} SELECT feature, {', '.join(f'ROUND({c}, 6) AS {c}' for c in _EF)} FROM ef""")
def error_feature_comparison(spark, folder):
    return rounded(errors.compare_error_features(_cases(spark, folder), SENSORS))


@query("M20 M23", f"""WITH {_CASES}, {_COMPARED} SELECT feature, ROUND(absolute_fn_vs_tn_smd, 6) AS absolute_fn_vs_tn_smd
FROM ef ORDER BY ef.absolute_fn_vs_tn_smd DESC NULLS LAST, feature LIMIT 3""")
def missed_failure_candidates(spark, folder):
    frame = time_split(_cases(spark, folder), NUMERIC_PROFILE, role="role")
    report = drift.with_priority(drift.numeric_drift(frame, SENSORS, "role"))
    compared = errors.compare_error_features(_cases(spark, folder), SENSORS, report)
    return rounded(errors.fn_drift_candidates(compared, 3).select("feature", "absolute_fn_vs_tn_smd"))


_SELECTED = """s AS (SELECT event_type AS model_name, CASE WHEN user_id % 2 = 0 THEN 'outer_fit' ELSE 'inner_oof' END AS fit_role,
 event_id % 9 AS fit_id, 'sensor_' || (user_id % 20) AS feature, 'raw_sensor' AS feature_space,
 event_id % 17 + 1 AS selection_rank FROM events)"""


@query("F10", f"""WITH {_SELECTED}, t AS (SELECT model_name, fit_role, COUNT(DISTINCT fit_id) AS total FROM s GROUP BY 1, 2)
SELECT model_name, fit_role, feature, feature_space, COUNT(DISTINCT fit_id) AS selected_fit_count,
ROUND(AVG(selection_rank), 6) AS mean_selection_rank, MAX(total) AS total_fit_count,
ROUND(COUNT(DISTINCT fit_id) / CAST(MAX(total) AS DOUBLE), 6) AS selection_frequency
FROM s JOIN t USING (model_name, fit_role) GROUP BY model_name, fit_role, feature, feature_space""")
def selection_frequency(spark, folder):
    e = table(spark, folder, "events")
    rows = e.select(
        F.col("event_type").alias("model_name"),
        F.when(F.col("user_id") % 2 == 0, "outer_fit").otherwise("inner_oof").alias("fit_role"),
        (F.col("event_id") % 9).alias("fit_id"),
        F.concat(F.lit("sensor_"), (F.col("user_id") % 20).cast("string")).alias("feature"),
        F.lit("raw_sensor").alias("feature_space"), (F.col("event_id") % 17 + 1).alias("selection_rank"))
    return rounded(stability.selection_frequency(rows))


def _records(spark, folder):
    e = table(spark, folder, "events")
    per = e.groupBy(F.col("user_id").alias("k"), (F.col("event_id") % 3 + 1).cast("int").alias("fold")).agg(
        F.round(F.sum("value"), 4).alias("importance"))  # users without events of a fold leave gaps
    rows = per.select(F.concat(F.lit("sensor_"), F.col("k").cast("string")).alias("feature"), "fold", "importance")
    flagged = stability.top_k_flags(rows, 10)
    from pyspark.sql.window import Window
    order = Window.partitionBy("fold").orderBy(F.desc("importance"))
    return flagged.withColumn("importance_rank", F.rank().over(order))


_RECORDS = """p AS (SELECT user_id AS k, CAST(event_id % 3 + 1 AS INTEGER) AS fold, ROUND(SUM(value), 4) AS importance FROM events
 GROUP BY 1, 2),
r AS (SELECT 'sensor_' || k AS feature, fold, RANK() OVER (PARTITION BY fold ORDER BY importance DESC) AS rk,
 ROW_NUMBER() OVER (PARTITION BY fold ORDER BY importance DESC, 'sensor_' || k) <= 10 AS top FROM p)"""


@query("F11 L32", f"""WITH {_RECORDS} SELECT feature, MAX(rk) FILTER (fold = 1)::INTEGER AS fold_1_rank,
MAX(rk) FILTER (fold = 2)::INTEGER AS fold_2_rank, MAX(rk) FILTER (fold = 3)::INTEGER AS fold_3_rank,
COUNT(*) FILTER (top) AS topk_count, ROUND(AVG(rk), 6) AS mean_rank_when_used, COUNT(rk) AS used_fold_count
FROM r GROUP BY feature""")
def fold_rank_table(spark, folder):
    return rounded(stability.fold_rank_table(_records(spark, folder), [1, 2, 3]))


@query("F11", f"""WITH {_RECORDS}, t AS (SELECT * FROM r WHERE top), n AS (SELECT fold, COUNT(*) AS c FROM t GROUP BY fold)
SELECT a.fold AS first_fold, b.fold AS second_fold, a.c AS first_sensor_count, b.c AS second_sensor_count,
COUNT(y.feature) AS common_sensor_count,
ROUND(COUNT(y.feature) / CAST(a.c + b.c - COUNT(y.feature) AS DOUBLE), 6) AS jaccard_similarity
FROM n a JOIN n b ON a.fold < b.fold JOIN t x ON x.fold = a.fold LEFT JOIN t y ON y.fold = b.fold AND y.feature = x.feature
GROUP BY a.fold, b.fold, a.c, b.c""")
def fold_overlap(spark, folder):
    return rounded(stability.fold_overlap(_records(spark, folder)))


@query("F13", f"""WITH {_RECORDS}, f AS (SELECT DISTINCT feature FROM r WHERE top AND fold = 1)
SELECT fold AS cv_fold, COUNT(*) AS oof_sensor_count, COUNT(f.feature) AS common_count, (SELECT COUNT(*) FROM f) AS train_sensor_count,
ROUND(COUNT(f.feature) / CAST(COUNT(*) + (SELECT COUNT(*) FROM f) - COUNT(f.feature) AS DOUBLE), 6) AS jaccard
FROM r LEFT JOIN f USING (feature) WHERE top GROUP BY fold""")
def selection_overlap(spark, folder):
    top = _records(spark, folder).where("in_topk")
    return rounded(stability.selection_overlap(
        top.select(F.col("fold").alias("cv_fold"), "feature"), top.where("fold = 1").select("feature")))


def _windows(spark, folder):
    return table(spark, folder, "events").select(F.col("event_type").alias("model_name"), (F.col("user_id") % 3).alias("outer_fold"),
                    (F.col("event_id") % 3 * 30).cast("int").alias("window_days"),
                    F.concat(F.lit("sensor_"), F.col("user_id").cast("string")).alias("feature")).distinct()


_WINDOWS = """w AS (SELECT DISTINCT event_type AS model_name, user_id % 3 AS outer_fold, CAST(event_id % 3 * 30 AS INTEGER) AS window_days,
 'sensor_' || user_id AS feature FROM events),
b AS (SELECT * FROM w WHERE window_days = 0), k AS (SELECT DISTINCT model_name, outer_fold, window_days FROM w WHERE window_days <> 0),
l AS (SELECT k.*, b.feature FROM k JOIN b ON b.model_name = k.model_name AND b.outer_fold = k.outer_fold),
c AS (SELECT COALESCE(l.model_name, r.model_name) AS model_name, COALESCE(l.outer_fold, r.outer_fold) AS outer_fold,
 COALESCE(l.window_days, r.window_days) AS window_days, COALESCE(l.feature, r.feature) AS feature,
 CASE WHEN l.feature IS NOT NULL AND r.feature IS NOT NULL THEN 'common' WHEN l.feature IS NOT NULL THEN 'removed' ELSE 'added' END
 AS sensor_status FROM l FULL OUTER JOIN (SELECT * FROM w WHERE window_days <> 0) r ON l.model_name = r.model_name
 AND l.outer_fold = r.outer_fold AND l.window_days = r.window_days AND l.feature = r.feature)"""


@query("F14", f"WITH {_WINDOWS} SELECT * FROM c")
def window_sensor_changes(spark, folder):
    return stability.window_sensor_changes(_windows(spark, folder))


@query("F14", f"""WITH {_WINDOWS} SELECT model_name, outer_fold, window_days,
COUNT(*) FILTER (sensor_status <> 'added') AS baseline_sensor_count,
COUNT(*) FILTER (sensor_status <> 'removed') AS recent_sensor_count,
COUNT(*) FILTER (sensor_status = 'common') AS common_count, COUNT(*) FILTER (sensor_status = 'removed') AS removed_count,
COUNT(*) FILTER (sensor_status = 'added') AS added_count,
ROUND(COUNT(*) FILTER (sensor_status = 'common') / CAST(COUNT(*) AS DOUBLE), 6) AS jaccard,
COUNT(*) FILTER (sensor_status <> 'common') = 0 AS same_sensor_set FROM c GROUP BY model_name, outer_fold, window_days""")
def window_sensor_overlap(spark, folder):
    return rounded(stability.window_sensor_overlap(stability.window_sensor_changes(_windows(spark, folder))))


def _window_rows(spark, folder):
    e = table(spark, folder, "events")
    return e.groupBy(F.col("event_type").alias("model_name"), (F.col("user_id") % 3).alias("outer_fold"),
                     (F.col("event_id") % 3 * 30).cast("int").alias("window_days")).agg(
        (F.avg("value") / 100).alias("average_precision"), (F.avg("value") / 50).alias("roc_auc"),
        F.count(F.lit(1)).alias("train_samples"), F.count_if(F.col("event_id") % 10 == 0).alias("train_fail"),
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("train_start"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("train_end")
    ).withColumn("status", F.when((F.col("outer_fold") == 2) & (F.col("window_days") == 60), "skipped")
                 .otherwise("evaluated"))


@query("L15", """WITH r AS (SELECT event_type AS model_name, user_id % 3 AS outer_fold, CAST(event_id % 3 * 30 AS INTEGER) AS window_days,
 AVG(value) / 100 AS ap, AVG(value) / 50 AS auc, COUNT(*) AS n, COUNT(*) FILTER (event_id % 10 = 0) AS f,
 strftime(MIN(ts), '%Y-%m-%d') AS s, strftime(MAX(ts), '%Y-%m-%d') AS e FROM events GROUP BY 1, 2, 3),
q AS (SELECT *, CASE WHEN outer_fold = 2 AND window_days = 60 THEN 'skipped' ELSE 'evaluated' END AS status FROM r)
SELECT a.model_name, a.outer_fold, a.window_days, a.status, ROUND(a.ap, 6) AS average_precision,
ROUND(b.ap, 6) AS baseline_average_precision, b.n - a.n AS removed_train_samples, b.f - a.f AS removed_train_fail,
ROUND(a.f / CAST(a.n AS DOUBLE), 6) AS train_fail_ratio, ROUND(b.f / CAST(b.n AS DOUBLE), 6) AS baseline_train_fail_ratio,
ROUND(CASE WHEN a.status = 'evaluated' THEN a.ap - b.ap END, 6) AS ap_delta,
ROUND(CASE WHEN a.status = 'evaluated' AND b.ap > 0 THEN (a.ap - b.ap) / b.ap END, 6) AS ap_relative_change,
ROUND(CASE WHEN a.status = 'evaluated' THEN a.auc - b.auc END, 6) AS roc_auc_delta,
a.n = b.n AND a.s = b.s AND a.e = b.e AS same_training_period
FROM q a JOIN q b ON a.model_name = b.model_name AND a.outer_fold = b.outer_fold AND b.window_days = 0 WHERE a.window_days <> 0""")
def window_diagnostics(spark, folder):
    return rounded(stability.window_diagnostics(_window_rows(spark, folder)))


@query("F15", """WITH f AS (SELECT event_type AS x, user_id % 3 AS fold, AVG(event_id % 100) / 100 AS ap, COUNT(DISTINCT user_id) AS k
 FROM events GROUP BY 1, 2),
p AS (SELECT * FROM (VALUES ('view', 'click'), ('view', 'purchase'), ('view', 'absent')) v(baseline, candidate)),
j AS (SELECT p.baseline, p.candidate, AVG(b.ap) AS ba, AVG(c.ap) AS ca, MAX(c.k) AS k, MIN(c.k) AS lo
 FROM p JOIN f c ON c.x = p.candidate JOIN f b ON b.x = p.baseline AND b.fold = c.fold GROUP BY 1, 2)
SELECT baseline, candidate, ROUND(ba, 6) AS baseline_ap_mean, ROUND(ca, 6) AS candidate_ap_mean,
ROUND(ca / ba, 6) AS ap_retention_ratio, k AS max_sensor_count_observed,
CASE WHEN lo >= 1 AND k <= 20 THEN 'met' ELSE 'too_many_sensors' END AS sensor_status, ROUND(1 - ca / ba, 6) AS ap_loss_ratio,
CASE WHEN 1 - ca / ba <= 0.2 + 1e-12 THEN 'target_met' WHEN 1 - ca / ba <= 0.3 + 1e-12 THEN 'allowed_below_target'
ELSE 'loss_too_large' END AS ap_status FROM j""")
def reduction_policy(spark, folder):
    folds = event_results(spark, folder).groupBy(
        F.col("model_name").alias("experiment"), F.col("outer_fold").alias("fold")).agg(
        (F.avg(F.col("event_id") % 100) / 100).alias("ap"), F.count_distinct("user_id").alias("sensor_count"),
        F.lit(True).alias("is_raw_sensor"))
    return rounded(stability.assess_reduction(folds, ReductionPolicy(
        (("view", "click"), ("view", "purchase"), ("view", "absent")))))


@query("F12", f"""WITH {sql.B1}, st AS (SELECT feature, COUNT(*) FILTER (value IS NULL) / CAST(COUNT(*) AS DOUBLE) AS m,
COUNT(DISTINCT value) AS u, STDDEV_POP(value) AS s FROM ({sql.long('b1', 'row_id')}) GROUP BY feature),
x AS (SELECT feature, m, CASE WHEN m > 0.5 THEN 'removed_high_missing' WHEN u <= 1 THEN 'removed_constant' ELSE 'used' END AS status,
CASE WHEN m <= 0.5 AND u > 1 THEN s END AS imp FROM st)
SELECT feature, status, ROUND(m, 6) AS train_missing_ratio, ROUND(imp, 6) AS importance,
CASE WHEN imp IS NOT NULL THEN CAST(RANK() OVER (ORDER BY imp DESC NULLS LAST) AS INTEGER) END AS importance_rank FROM x""")
def importance_table(spark, folder):
    from ..functions.scalars import to_long
    from ..operators.quality import feature_profile
    frame = score_frame(spark, folder).drop("score", "fold")
    profiled = feature_profile(frame, NUMERIC_PROFILE)
    spread = to_long(frame, SENSORS).groupBy("feature").agg(F.stddev_pop("value").alias("importance"))
    used = spread.join(profiled.where("status = 'used'").select("feature"), "feature", "left_semi")
    return rounded(stability.importance_table(profiled, used))


@query("L13 P13", f"""WITH {sql.B2}, {sql.blocks('b2', 3)}, past AS (SELECT *, block AS k FROM bl WHERE block IN (1, 2)),
p2 AS (SELECT * REPLACE (0 AS fold) FROM past), {sql.thresholds('p2', 'fold')},
g AS (SELECT UNNEST([0.8, 0.9]::DOUBLE[]) AS target_recall),
c AS (SELECT target_recall, threshold FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_recall
 ORDER BY reinspection_ratio, precision DESC, threshold DESC) AS rn FROM tt, g WHERE recall >= target_recall) WHERE rn = 1)
SELECT target_recall, ROUND(MAX(threshold), 6) AS threshold, COUNT(*) AS support,
COUNT(*) FILTER (label = 1 AND score >= threshold) AS true_positive,
COUNT(*) FILTER (label <> 1 AND score >= threshold) AS false_positive FROM c, bl WHERE block = 3 GROUP BY target_recall""")
def oof_thresholds_on_final_block(spark, folder):
    blocked = time_blocks(score_frame(spark, folder).withColumn("unit", F.lit("all")), NUMERIC_PROFILE, 3)
    past = metrics.threshold_table(blocked.where("block in (1, 2)"), NUMERIC_PROFILE, "score", ["unit"])
    chosen = policy.recall_target_choices(past, ["unit"])
    out = policy.apply_thresholds(chosen, blocked.where("block = 3"), NUMERIC_PROFILE, "score", ["unit"], ["target_recall"])
    return rounded(out.select("target_recall", "threshold", "support", "true_positive", "false_positive"))


@query("M13 T2", f"""WITH {sql.B2}, {sql.blocks('b2', 3)}, e AS (SELECT * REPLACE (block AS fold) FROM bl WHERE block > 0),
{sql.curve('e', 'fold')}, {sql.metrics('fold', '0.5')}
SELECT ROUND(AVG(average_precision), 4) AS ap_mean, CAST(SUM(true_positive) AS BIGINT) AS true_positive,
ROUND(SUM(true_positive) / CAST(SUM(true_positive + false_negative) AS DOUBLE), 6) AS pooled_recall FROM mr""")
def time_fold_summary(spark, folder):
    blocked = time_blocks(score_frame(spark, folder), NUMERIC_PROFILE, 3)
    evaluated = fold_membership(blocked.drop("fold"), 3).where("fold_role = 'evaluation'")
    per_fold = metrics.binary_metrics(evaluated, NUMERIC_PROFILE, "score", 0.5, ["fold"])
    out = metrics.fold_summary(per_fold.withColumn("all", F.lit(1)), ["all"])
    return out.select(F.round("ap_mean", 4).alias("ap_mean"), "true_positive",
                      F.round("pooled_recall", 6).alias("pooled_recall"))


@query("L13 M12 M15", f"""WITH {sql.B2}, st AS (SELECT machine, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE) AS since,
 ROUND(AVG(score), 6) AS threshold FROM b2 GROUP BY ALL)
SELECT row_id, strftime(since, '%Y-%m') AS since, threshold, score >= threshold AS alarm
FROM b2 ASOF LEFT JOIN st ON b2.machine = st.machine AND b2.ts >= st.since""")
def threshold_in_force(spark, folder):
    """Each row with its machine's threshold in force: chosen on a month's rows, valid from the next month on."""
    frame = score_frame(spark, folder)
    states = frame.groupBy("machine", F.add_months(F.trunc("ts", "month"), 1).alias("since")).agg(
        F.round(F.avg("score"), 6).alias("threshold"))
    found = as_of_join(frame.select("row_id", "machine", "ts", "score"), states, ["machine"], "ts", "since", ["threshold"])
    return found.select("row_id", F.date_format("since", "yyyy-MM").alias("since"), "threshold",
                        (F.col("score") >= F.col("threshold")).alias("alarm"))
