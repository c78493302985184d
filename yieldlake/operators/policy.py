"""Choice of a decision threshold under recall and re-inspection limits.

Each choice is one aggregation (``min_by``/``max_by`` over an ordering struct), so a
table that lists every observed score is never sorted inside a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..profile import PROTOCOL_ID, ContractError, Profile, ThresholdPolicy
from ..scale import join_on
from .metrics import binary_metrics


def policy_candidates(table: DataFrame, policy: ThresholdPolicy) -> DataFrame:
    """Add the re-inspection ratio recomputed from counts and the feasibility flag."""
    again = ratio(F.col("true_positive") + F.col("false_positive"), F.col("support"))
    return table.withColumn("reinspection_ratio", again).withColumn(
        "policy_feasible", (F.col("recall") >= policy.min_recall)
        & (F.col("reinspection_ratio") <= policy.max_reinspection_ratio))


def candidate_violations(table: DataFrame, keys: list[str], probability: bool = True) -> DataFrame:
    """Per key: rows that break the consistency rules of a threshold table."""
    t, r = F.col("threshold").cast("double"), F.col("recall").cast("double")
    n, p, tp, fp = (F.col(c).cast("double") for c in
                    ("support", "positive_support", "true_positive", "false_positive"))
    inf = F.lit(float("inf"))
    bad_number = F.lit(False)
    for c in (t, r, n, p, tp, fp):
        bad_number = bad_number | c.isNull() | F.isnan(c) | (F.abs(c) == inf)
    whole = F.lit(False)
    for c in (n, p, tp, fp):
        whole = whole | (c < 0) | (c != F.floor(c))
    rate = ratio(tp, p)
    return table.groupBy(*keys).agg(
        F.count_if(bad_number).alias("bad_numbers"),
        F.count_if((r < 0) | (r > 1) | (F.lit(probability) & ((t < 0) | (t > 1)))).alias("outside_range"),
        F.count_if(whole).alias("bad_counts"),
        F.count_if((n <= 0) | (p <= 0) | (p > n) | (tp > p) | (fp > n - p)).alias("inconsistent_counts"),
        F.count_if(F.abs(r - rate) > 1e-12 + 1e-10 * F.abs(rate)).alias("recall_mismatch"),
        ((F.min(n) != F.max(n)) | (F.min(p) != F.max(p))).cast("int").alias("mixed_support"))


def require_candidates(table: DataFrame, keys: list[str], probability: bool = True) -> None:
    checks = candidate_violations(table, keys, probability)
    names = [c for c in checks.columns if c not in keys]
    worst = checks.agg(*[F.max(c).alias(c) for c in names]).first().asDict()
    if any(v is None or v for v in worst.values()):
        raise ContractError(f"threshold table cannot be used: {worst}")


def best_row(table: DataFrame, keys: list[str], feasible: Column, order: list[Column],
             fields: list[str]) -> DataFrame:
    """The feasible row with the smallest ``order`` per key; null fields when none is feasible."""
    ranked = F.min_by(F.struct(*fields), F.when(feasible, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])))
    return table.groupBy(*keys).agg(ranked.alias("__best")).select(*keys, *[
        F.col(f"__best.{f}").alias(f) for f in fields])


def select_policy_threshold(table: DataFrame, policy: ThresholdPolicy, keys: list[str]) -> DataFrame:
    """Least re-inspection, then most recall, then the highest threshold; null when infeasible."""
    chosen = best_row(
        policy_candidates(table, policy), keys, F.col("policy_feasible"),
        [F.col("reinspection_ratio"), -F.col("recall"), -F.col("threshold")],
        ["threshold", "recall", "reinspection_ratio"])
    return chosen.withColumn("policy_status", F.when(F.col("threshold").isNull(), "infeasible").otherwise("feasible"))


def best_f1_threshold(table: DataFrame, keys: list[str]) -> DataFrame:
    """Diagnostic threshold of the highest F1; ties take the lowest threshold."""
    return best_row(table, keys, F.lit(True), [-F.col("f1"), F.col("threshold")], ["threshold", "f1"])


def _targets(table: DataFrame, targets: list[float], name: str) -> DataFrame:
    return table.withColumn(name, F.explode(F.array(*[F.lit(float(t)) for t in targets])))


def recall_target_choices(table: DataFrame, keys: list[str], targets: tuple[float, ...] = (0.8, 0.9)) -> DataFrame:
    """Per recall target: least alarm, then most precision, then the highest threshold."""
    wide = _targets(table, list(targets), "target_recall")
    return best_row(wide, [*keys, "target_recall"], F.col("recall") >= F.col("target_recall"),
                    [F.col("reinspection_ratio"), -F.col("precision"), -F.col("threshold")],
                    ["threshold", "recall", "precision", "f1", "reinspection_ratio"])


def best_precision_by_recall(table: DataFrame, keys: list[str],
                             targets: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Per recall target: most precision, then F1, then the highest threshold."""
    wide = _targets(table, list(targets), "target_recall")
    out = best_row(wide, [*keys, "target_recall"], F.col("recall") >= F.col("target_recall"),
                   [-F.col("precision"), -F.col("f1"), -F.col("threshold")],
                   ["threshold", "recall", "precision", "f1"])
    return out.withColumn("status", F.when(F.col("threshold").isNull(), "infeasible").otherwise("candidate"))


def alarm_and_recall_scenarios(table: DataFrame, keys: list[str], recall_targets: tuple[float, ...],
                               alarm_limit: float) -> DataFrame:
    """Recall-target rows and one row with the most recall under an alarm limit."""
    fields = ["threshold", "recall", "reinspection_ratio"]
    by_recall = best_row(
        _targets(table, list(recall_targets), "target"), [*keys, "target"], F.col("recall") >= F.col("target"),
        [F.col("reinspection_ratio"), -F.col("recall"), -F.col("threshold")], fields)
    by_alarm = best_row(
        _targets(table, [alarm_limit], "target"), [*keys, "target"],
        F.col("reinspection_ratio") <= F.col("target"),
        [-F.col("recall"), F.col("reinspection_ratio"), -F.col("threshold")], fields)
    return by_recall.withColumn("scenario", F.lit("recall_target")).unionByName(
        by_alarm.withColumn("scenario", F.lit("alarm_limit"))).withColumn(
        "status", F.when(F.col("threshold").isNull(), "infeasible").otherwise("candidate"))


def apply_thresholds(choices: DataFrame, scored: DataFrame, profile: Profile, score: str, keys: list[str],
                     extra: list[str] | None = None, threshold: str = "threshold") -> DataFrame:
    """Metrics of the chosen thresholds on a later scored period; infeasible choices keep a null row.

    ``choices`` has a few rows per key.
    """
    extra = list(extra or [])
    chosen = choices.select(*keys, *extra, F.col(threshold).alias("__chosen"))
    usable = join_on(scored, chosen.where("__chosen is not null"), keys)
    measured = binary_metrics(usable, profile, score, "__chosen", [*keys, *extra]).drop("threshold")
    return chosen.withColumnRenamed("__chosen", "threshold").join(measured, [*keys, *extra], "left")


def policy_outcome(choices: DataFrame, scored: DataFrame, profile: Profile, score: str, keys: list[str],
                   policy: ThresholdPolicy) -> DataFrame:
    """Policy threshold applied to the future period with a flag whether it still meets the policy."""
    applied = apply_thresholds(choices, scored, profile, score, keys)
    return applied.withColumn(
        "policy_status", F.when(F.col("threshold").isNull(), "infeasible").otherwise("feasible")
    ).withColumn("evaluation_meets_policy", (F.col("recall") >= policy.min_recall)
                 & (F.col("reinspection_ratio") <= policy.max_reinspection_ratio))


def report_provenance(report: DataFrame, expected: dict[str, str], threshold: float) -> DataFrame:
    """One row: provenance columns that are not single-valued and as expected, and whether the threshold is listed."""
    wrong = [F.count_if(F.col(c).isNull() | (F.col(c) != F.lit(v))).alias(f"wrong_{c}") for c, v in expected.items()]
    t = F.col("threshold").cast("double")
    return report.agg(
        F.count(F.lit(1)).alias("rows"), *wrong,
        F.count_if(t.isNull() | F.isnan(t) | (t < 0) | (t > 1)).alias("bad_thresholds"),
        F.count_if(F.abs(t - threshold) <= 1e-12 * F.abs(F.lit(threshold))).alias("listed"))


def require_threshold_report(report: DataFrame, train: DataFrame, profile: Profile, experiment: str,
                             threshold: float) -> None:
    protocol = train.agg(F.max(PROTOCOL_ID).alias("p")).first().p
    found = report_provenance(report, {
        "dataset_id": profile.dataset_id, "experiment": experiment, "training_protocol_id": protocol,
        "oof_score_method": "single", "threshold_use": "candidate"}, threshold).first().asDict()
    if not found.pop("rows") or not found.pop("listed") or any(found.values()):
        raise ContractError(f"the threshold report does not support this threshold: {found}")


def reselect_from_stored(report: DataFrame, policy: ThresholdPolicy, keys: list[str], reused: bool = True) -> DataFrame:
    """New policy choice from a stored threshold table, with what changed; nothing is refitted."""
    require_candidates(report, keys)
    return select_policy_threshold(report, policy, keys).withColumn(
        "change", F.lit("policy" if reused else "threshold"))
