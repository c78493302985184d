import pytest
from pyspark.sql import functions as F

from yieldlake.operators import drift, errors, metrics, policy, quality, stability
from yieldlake.profile import ContractError, Profile, ReductionPolicy, ThresholdPolicy, validate_frame

PROFILE = Profile("t", "label", -1, 1)


def test_confusion_counts(spark):
    df = spark.createDataFrame([(-1, .1), (1, .9), (-1, .7), (1, .3)], "label int, score double")
    m = metrics.binary_metrics(df, PROFILE, "score", 0.5).first()
    assert (m.true_negative, m.false_positive, m.false_negative, m.true_positive) == (1, 1, 1, 1)
    assert (m.recall, m.precision, m.f1, m.roc_auc) == (0.5, 0.5, 0.5, 0.75)
    assert m.average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_no_flagged_row_gives_zero_rates_and_one_class_no_auc(spark):
    df = spark.createDataFrame([(1, .2), (1, .3)], "label int, score double")
    m = metrics.binary_metrics(df, PROFILE, "score", 0.9).first()
    assert (m.precision, m.recall, m.f1, m.roc_auc) == (0.0, 0.0, 0.0, None)


def test_unusable_scores_are_rejected(spark):
    df = spark.createDataFrame([(1, .2), (-1, float("nan"))], "label int, score double")
    with pytest.raises(ContractError):
        metrics.require_scores(df, PROFILE, "score")


def _table(spark, rows):
    return spark.createDataFrame(
        [("m", *r) for r in rows], "model string, threshold double, recall double, support int, positive_support int, "
        "true_positive int, false_positive int")


def test_policy_prefers_less_inspection_then_recall_then_threshold(spark):
    rows = [(0.1, 1.0, 100, 10, 10, 40), (0.2, 0.9, 100, 10, 9, 21), (0.3, 0.9, 100, 10, 9, 21), (0.5, 0.5, 100, 10, 5, 5)]
    table = _table(spark, rows)
    policy.require_candidates(table, ["model"])
    assert policy.select_policy_threshold(table, ThresholdPolicy(0.8, 0.4), ["model"]).first().threshold == 0.3
    none = policy.select_policy_threshold(table, ThresholdPolicy(0.95, 0.2), ["model"]).first()
    assert none.threshold is None and none.policy_status == "infeasible"


def test_inconsistent_candidates_are_rejected(spark):
    for bad in ((0.1, 0.9, 100, 10, 10, 0), (0.1, 1.0, 100, 10, 10, 95), (0.1, 1.0, 0, 10, 10, 0)):
        with pytest.raises(ContractError):
            policy.require_candidates(_table(spark, [bad]), ["model"])


def test_psi_smd_tvd_and_label_change(spark):
    train = [("train", 1.0, "a", -1), ("train", 2.0, "a", -1), ("train", 3.0, "b", -1), ("train", 4.0, "b", -1), ("train", None, "a", 1)]
    later = [("validation", 3.0, "c", -1), ("validation", 5.0, "c", 1), ("validation", 7.0, "c", -1), ("validation", None, "a", 1)]
    df = spark.createDataFrame(train + later, "side string, sensor double, machine string, label int")
    profile = Profile("t", "label", -1, 1, categorical=("machine",))
    report = {r.feature: r for r in drift.drift_report(df, profile, "side").collect()}
    sensor, machine = report["sensor"], report["machine"]
    assert sensor.standardized_mean_difference == pytest.approx(2.5 / (((1.25 + 8 / 3) / 2) ** 0.5))
    assert machine.unseen_category_ratio == 0.75 and machine.category_distribution_tvd == pytest.approx(0.75)
    assert machine.drift_priority == "high" and sensor.population_stability_index > 0
    change = {r.label: r.ratio_delta for r in drift.label_drift(df, profile, "side").collect()}
    assert change["1"] == pytest.approx(0.3)


def test_constant_train_has_no_psi(spark):
    df = spark.createDataFrame([("train", "s", 1.0)] * 4 + [("validation", "s", 2.0)] * 3, "side string, feature string, value double")
    assert drift.psi(df, "side", "train", "validation").isEmpty()


def test_quality_filter_boundary(spark):
    df = spark.createDataFrame(
        [(1.0, None, 5.0, None, 1), (2.0, None, None, 7.0, -1), (3.0, None, 5.0, None, 1), (4.0, 9.0, None, 8.0, -1)],
        "ok double, sparse double, constant double, half double, label int")
    status = {r.feature: r.status for r in quality.feature_profile(df, PROFILE).collect()}
    assert status == {"ok": "used", "sparse": "removed_high_missing", "constant": "removed_constant", "half": "used"}
    assert quality.retained_features(df, PROFILE) == ["ok", "half"]
    assert validate_frame(df, PROFILE) == ["ok", "sparse", "constant", "half"]


def test_labels_outside_the_profile_are_rejected(spark):
    with pytest.raises(ContractError):
        validate_frame(spark.createDataFrame([(1.0, 2)], "x double, label int"), PROFILE)
    with pytest.raises(ContractError):
        validate_frame(spark.createDataFrame([("a", 1)], "x string, label int"), PROFILE)


def test_error_groups_and_summary(spark):
    df = spark.createDataFrame([(1, .9, 1.0, 1.0), (1, .1, 2.0, None), (-1, .8, 3.0, 3.0), (-1, .2, 4.0, 4.0)],
                               "label int, score double, sensor_0 double, sensor_1 double")
    cases = errors.assign_error_groups(df, PROFILE, "score", 0.5)
    assert [r.error_group for r in cases.orderBy("sensor_0").collect()] == ["TP", "FN", "FP", "TN"]
    summary = {r.error_group: r for r in errors.error_group_summary(cases, ["sensor_0", "sensor_1"], "score").collect()}
    assert summary["FN"].row_missing_ratio_mean == 0.5 and summary["TP"].sample_count == 1
    compared = {r.feature: r for r in errors.compare_error_features(cases, ["sensor_0", "sensor_1"]).collect()}
    assert compared["sensor_1"].fn_missing_ratio == 1.0 and compared["sensor_0"].fn_vs_tn_standardized_mean_difference is None


@pytest.mark.parametrize("ap, status", [(.16, "target_met"), (.15, "allowed_below_target"), (.14, "allowed_below_target"),
                                        (.13, "loss_too_large"), (.22, "target_met")])
def test_reduction_bands(spark, ap, status):
    rows = [(e, f, a, 20, True) for f in (1, 2) for e, a in (("all", .2), ("top", ap))]
    folds = spark.createDataFrame(rows, "experiment string, fold int, ap double, sensor_count int, is_raw_sensor boolean")
    out = stability.assess_reduction(folds, ReductionPolicy((("all", "top"),))).first()
    assert out.ap_status == status and out.sensor_status == "met"


def test_reduction_is_undefined_for_different_folds(spark):
    rows = [("all", 1, .2, 50, True), ("top", 2, .2, 25, True)]
    folds = spark.createDataFrame(rows, "experiment string, fold int, ap double, sensor_count int, is_raw_sensor boolean")
    out = stability.assess_reduction(folds, ReductionPolicy((("all", "top"),))).first()
    assert (out.ap_status, out.sensor_status) == ("undefined", "too_many_sensors")


def test_all_metrics_match_brute_force(spark):
    rows = [(i, 1 if (i * 7) % 11 < 2 else -1, ((i * 29) % 23) / 23.0) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, label int, score double")
    table = metrics.full_threshold_table(df, PROFILE, "score").collect()
    for r in table:
        flagged = [(l, s) for _, l, s in rows if s >= r.threshold]
        assert r.true_positive == sum(l == 1 for l, _ in flagged) and r.false_positive == sum(l != 1 for l, _ in flagged)
    pos = [s for _, l, s in rows if l == 1]
    neg = [s for _, l, s in rows if l != 1]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.binary_metrics(df, PROFILE, "score", 0.5).first().roc_auc == pytest.approx(auc)
    assert df.select(F.count("*")).first()[0] == 120
