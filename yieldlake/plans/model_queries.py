"""Queries that fit preprocessing, models and detectors on the sensor frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..ml import anomaly, evaluation
from ..ml.evaluation import SCORE
from ..ml.inference import FrozenScorer, input_violations, score_gap
from ..ml.models import Candidate, class_weight_table, fit, bootstrap_copies, importances, pca_to_variance, stratified_bootstrap, weight_grid
from ..ml.preprocess import FeaturePrep
from ..operators import errors, metrics
from ..operators.splits import fold_membership, random_split, time_blocks, time_split
from ..profile import Evaluation, ThresholdPolicy
from ..scale import cut_lineage
from ..sources.tables import NUMERIC_PROFILE, SENSORS, sensor_frame, stored_sensor_frame
from . import sql
from .registry import query

FAST = Candidate("logistic", "logistic_regression", max_iter=15)
FOREST = Candidate("forest", "random_forest", trees=5, depth=4)
BOOSTED = Candidate("boosted", "boosted_trees", trees=3, depth=3)
SETTINGS = Evaluation(n_splits=3, n_repeats=2, policy=ThresholdPolicy(0.5, 0.6))
IDS = ["row_id"]
CV_CANDIDATES = [FAST, Candidate("forest_top_2", "logistic_regression", selector="forest", top_k=2, trees=5, max_iter=15)]


def _parts(spark, folder):
    frame = time_split(stored_sensor_frame(spark, folder), NUMERIC_PROFILE, role="role")
    return frame.where("role = 'train'").drop("role"), frame.where("role = 'validation'").drop("role")


_KEPT = ["sensor_0", "sensor_1", "sensor_2", "sensor_5"]


def _prepared_sql():
    fill = {f: f"COALESCE({f}, (SELECT quantile_cont({f}, 0.5) FROM tr))" for f in _KEPT}
    filled = ", ".join(f"{x} AS {f}" for f, x in fill.items())
    scaled = ", ".join(f"ROUND(({f} - (SELECT AVG({f}) FROM ft)) / (SELECT STDDEV_POP({f}) FROM ft), 6) AS {f}" for f in _KEPT)
    return f"""WITH {sql.B1}, {sql.split()}, tr AS (SELECT * FROM sp WHERE role = 'train'),
ft AS (SELECT row_id, {filled} FROM tr), fv AS (SELECT row_id, {filled} FROM sp WHERE role = 'validation')
SELECT row_id, {scaled} FROM fv"""


@query("F1 F2 Q11", _prepared_sql())
def imputed_and_scaled(spark, folder):
    """Validation rows prepared with medians, means and population sigmas of Train."""
    train, later = _parts(spark, folder)
    # sensor_5 misses half of its values, which the 0.55 threshold keeps on either side of one half.
    model = FeaturePrep(features=SENSORS, missingThreshold=0.55, scale=True).fit(train)
    values = later.select("row_id", model.values().alias("v"))
    return rounded(values.select("row_id", *[F.get("v", F.lit(i)).alias(f) for i, f in enumerate(model.get("features"))]))


@query("F4", f"""WITH {sql.B1} SELECT row_id, ROUND(COALESCE(sensor_2, (SELECT quantile_cont(sensor_2, 0.5) FROM b1)), 6) AS filled,
CAST(sensor_2 IS NULL AS INTEGER)::DOUBLE AS missing_flag FROM b1""")
def missing_indicators(spark, folder):
    frame = sensor_frame(spark, folder)
    model = FeaturePrep(features=["sensor_0", "sensor_2"], indicators=True).fit(frame)
    return rounded(frame.select("row_id", model.values().alias("v")).select(
        "row_id", F.get("v", F.lit(1)).alias("filled"), F.get("v", F.lit(2)).alias("missing_flag")))


@query("F3", f"""WITH {sql.B1}, m AS (SELECT machine FROM b1 WHERE row_id % 4 <> 0 GROUP BY machine ORDER BY COUNT(*) DESC, machine LIMIT 1),
s AS (SELECT row_id, CASE WHEN row_id % 4 = 0 THEN (SELECT machine FROM m) WHEN row_id % 9 = 1 THEN 'UNSEEN' ELSE machine END AS x FROM b1)
SELECT row_id, {', '.join(f"CAST(x = '{m}' AS INTEGER)::DOUBLE AS {m.lower()}" for m in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM s""")
def one_hot_unknown_zero(spark, folder):
    frame = sensor_frame(spark, folder).withColumn("machine", F.when(F.col("row_id") % 4 != 0, F.col("machine")))
    model = FeaturePrep(features=["sensor_0"], categorical=["machine"]).fit(frame)
    later = frame.withColumn("machine", F.when((F.col("row_id") % 9 == 1) & F.col("machine").isNotNull(), "UNSEEN")
                             .otherwise(F.col("machine")))
    names = [s.split("=")[1].lower() for s in model.get("levels")]
    return later.select("row_id", model.values().alias("v")).select(
        "row_id", *[F.get("v", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


@query("L2 L3", f"""WITH {sql.B1}, {sql.blocks('b1', 3)}, f AS (SELECT 1 AS fold UNION ALL SELECT 2 UNION ALL SELECT 3),
c AS (SELECT fold, COUNT(*) FILTER (label = -1) / CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) AS r FROM bl, f WHERE block < fold GROUP BY fold)
SELECT fold, 'none' AS mode, CAST(1 AS DOUBLE) AS positive_weight FROM c UNION ALL SELECT fold, 'sqrt_ratio', ROUND(SQRT(r), 6) FROM c
UNION ALL SELECT fold, 'ratio', ROUND(r, 6) FROM c""")
def class_weights_by_fold(spark, folder):
    members = fold_membership(time_blocks(sensor_frame(spark, folder), NUMERIC_PROFILE, 3), 3).where("fold_role = 'fit'")
    return rounded(class_weight_table(members, NUMERIC_PROFILE, ["fold"]))


@query("F5 F6")
def pca_variance_table(spark, folder):
    """Components needed for 80, 90 and 95 percent of the variance of standardised Train rows."""
    train, _ = _parts(spark, folder)
    prep = FeaturePrep(features=SENSORS, scale=True, outputCol="all_features_vector").fit(train)
    prepared = prep.transform(train)
    model, _ = pca_to_variance(prepared, len(prep.slot_names()), 0.9)
    shares = model.explainedVariance.toArray().tolist()
    rows, total = [], 0.0
    for i, v in enumerate(shares, 1):
        total += v
        rows.append((i, v, total, *[total >= t - 1e-12 for t in (0.8, 0.9, 0.95)]))
    return spark.createDataFrame(
        rows, "component int, share double, cumulative double, reaches_80 boolean, reaches_90 boolean, reaches_95 boolean")


@query("L1 L4 L5 L10 F7 F8 F18 L30")
def later_period_comparison(spark, folder):
    """Three families and three selectors, fitted on Train and measured on the later period."""
    train, later = _parts(spark, folder)
    candidates = [FAST, FOREST, BOOSTED,
                  Candidate("logistic_l1_selected", "logistic_regression", selector="l1", max_iter=15),
                  Candidate("forest_top_2", "logistic_regression", selector="forest", top_k=2, trees=5, max_iter=15),
                  Candidate("pca_logistic", "logistic_regression", selector="pca", max_iter=15)]
    results = evaluation.compare_later_period(train, later, NUMERIC_PROFILE, candidates, SENSORS, IDS, 0.07, stored=True)
    return evaluation.relative_ap_loss(results, "logistic")


@query("L6 L7 L8")
def repeated_cv_comparison(spark, folder):
    train, _ = _parts(spark, folder)
    done = evaluation.compare_candidates(train, NUMERIC_PROFILE, CV_CANDIDATES, SENSORS, IDS, SETTINGS)
    return done["summary"]


@query("L8 P13", f"""WITH {sql.B1}, {sql.split()} SELECT row_id, label, CAST(1 AS BIGINT) AS prediction_count, TRUE AS in_range
FROM sp WHERE role = 'train'""")
def oof_score_rows(spark, folder):
    """Every Train row gets exactly one out-of-fold probability."""
    train, _ = _parts(spark, folder)
    scores = evaluation.oof_scores(train, NUMERIC_PROFILE, FAST, SENSORS, IDS, SETTINGS)
    return scores.select("row_id", "label", "prediction_count",
                         ((F.col("oof_score") >= 0) & (F.col("oof_score") <= 1)).alias("in_range"))


@query("L9 L11 M14")
def nested_time_evaluation(spark, folder):
    frame = sensor_frame(spark, folder)
    done = evaluation.compare_temporal(frame, NUMERIC_PROFILE, CV_CANDIDATES, SENSORS, IDS, SETTINGS)
    return done["fold_results"]


@query("L12 L13 L28")
def fixed_against_reselected_sensors(spark, folder):
    """Sensors fixed on the first past against sensors chosen again, on identical later rows."""
    blocked = time_blocks(stored_sensor_frame(spark, folder), NUMERIC_PROFILE, 3)
    first = fit(blocked.where("block < 1"), NUMERIC_PROFILE,
                Candidate("pick", "logistic_regression", selector="forest", top_k=2, trees=5, max_iter=10), SENSORS, stored=True)
    names = tuple(s["feature"] for s in first.selected)
    candidates = [Candidate("fixed", "logistic_regression", selector="fixed", fixed=names, max_iter=10),
                  Candidate("again", "logistic_regression", selector="forest", top_k=2, trees=5, max_iter=10)]
    done = evaluation.score_folds(evaluation.time_fold_rows(blocked, stored=True), NUMERIC_PROFILE, candidates, SENSORS, IDS, "fold", [2, 3])
    results = metrics.binary_metrics(done.predictions, NUMERIC_PROFILE, SCORE, 0.07, ["model_name", "fold"])
    return evaluation.paired_ap_delta(results, "fixed", "again", "fold")


@query("L14 L15 P7")
def recent_window_training(spark, folder):
    rows = evaluation.compare_recent_windows(
        sensor_frame(spark, folder), NUMERIC_PROFILE, FAST, SENSORS, IDS, [0, 180], threshold=0.07)
    from ..operators.stability import window_diagnostics
    return window_diagnostics(rows)


@query("L31 F4")
def missing_mode_comparison(spark, folder):
    from ..ml.models import missing_mode_candidates
    train, later = _parts(spark, folder)
    return evaluation.compare_later_period(
        train, later, NUMERIC_PROFILE, missing_mode_candidates(FAST), SENSORS, IDS, 0.07, stored=True)


@query("F9 L27")
def stable_selection(spark, folder):
    train, _ = _parts(spark, folder)
    model = fit(train, NUMERIC_PROFILE, Candidate(
        "stable", "logistic_regression", selector="stable_forest", top_k=2, trees=20, repeats=10, max_iter=10), SENSORS, IDS)
    return evaluation.selection_rows(model, spark, model_name="stable")


@query("F16 F17 F12")
def coefficient_ranking(spark, folder):
    """Sensors by absolute standardised coefficient with the sign kept."""
    train, _ = _parts(spark, folder)
    model = fit(train, NUMERIC_PROFILE, FAST, SENSORS, stored=True)
    ranked = importances(model.model, model.prep.slot_names())
    return spark.createDataFrame([(i, n, v, True) for i, (n, v) in enumerate(ranked, 1)],
                                 "rank int, feature string, coefficient double, analysis_only boolean")


@query("F16")
def sensor_count_curve(spark, folder):
    """AP of nested Top-n sensor sets from one coefficient ranking."""
    train, later = _parts(spark, folder)
    model = fit(train, NUMERIC_PROFILE, FAST, SENSORS, stored=True)
    names = [n for n, _ in importances(model.model, model.prep.slot_names())]
    candidates = [Candidate(f"top_{n}", "logistic_regression", selector="fixed", fixed=tuple(names[:n]), max_iter=10)
                  for n in (1, 2, len(names))]
    return evaluation.compare_later_period(train, later, NUMERIC_PROFILE, candidates, SENSORS, IDS, 0.07, stored=True).select(
        "model_name", "average_precision", "roc_auc")


@query("L3")
def weight_and_depth_grid(spark, folder):
    """Two depths under three weight modes; every fit boosts all 300 trees of the weight comparison."""
    train, later = _parts(spark, folder)
    grid = weight_grid(Candidate("boosted", "boosted_trees", trees=300))
    return evaluation.compare_later_period(train, later, NUMERIC_PROFILE, grid, SENSORS, IDS, 0.3, stored=True)


@query("F9", f"""WITH {sql.B1} SELECT TRUE AS size_near_expected, COUNT(DISTINCT label) AS labels FROM b1""")
def bootstrap_rows(spark, folder):
    frame = sensor_frame(spark, folder)
    drawn = stratified_bootstrap(frame, "label", IDS, 1, 42)
    total = frame.agg(F.count(F.lit(1)).alias("n"))
    return drawn.agg(F.count(F.lit(1)).alias("k"), F.count_distinct("label").alias("labels")).crossJoin(total).select(
        (F.abs(F.col("k") / F.col("n") - 1) < 0.1).alias("size_near_expected"), "labels")


@query("F9", f"""WITH {sql.B1}, rk AS (SELECT row_id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id) - 1 AS place,
 COUNT(*) OVER (PARTITION BY label) AS n FROM b1),
dr AS (SELECT label, r AS repeat, CAST('0x' || substr(md5('42|' || r || '|' || label || '|' || place), 1, 15) AS BIGINT) % n AS place
 FROM rk, (SELECT UNNEST(range(2)) AS r)),
pk AS (SELECT label, repeat, place, COUNT(*) AS copies FROM dr GROUP BY label, repeat, place)
SELECT row_id, label, CAST(repeat AS INTEGER) AS repeat, copies FROM pk JOIN rk USING (label, place)""")
def bootstrap_draws(spark, folder):
    """Which rows two repeats draw, and how often; each class draws its own size."""
    frame = sensor_frame(spark, folder).select(*IDS, "label")
    return bootstrap_copies(frame, "label", IDS, 0, 42).withColumn("repeat", F.lit(0)).unionByName(
        bootstrap_copies(frame, "label", IDS, 1, 42).withColumn("repeat", F.lit(1))).select("row_id", "label", "repeat", "copies")


@query("L16")
def pca_reconstruction_scores(spark, folder):
    train, later = _parts(spark, folder)
    model = anomaly.fit_pca_detector(train, NUMERIC_PROFILE, SENSORS)
    return model.score(later).select("row_id", "label", anomaly.SCORE)


@query("L17")
def isolation_forest_scores(spark, folder):
    train, later = _parts(spark, folder)
    model = anomaly.fit_forest_detector(train, NUMERIC_PROFILE, SENSORS, IDS, trees=100)
    return model.score(later).select("row_id", "label", anomaly.SCORE)


@query("L18 L19")
def anomaly_time_comparison(spark, folder):
    """Both detectors and a supervised model over the same periods, one summary row each."""
    frame = sensor_frame(spark, folder)
    found = anomaly.compare_anomalies(frame, NUMERIC_PROFILE, SENSORS, IDS, SETTINGS, trees=50)
    known = evaluation.compare_temporal(frame, NUMERIC_PROFILE, [FAST], SENSORS, IDS, SETTINGS)
    return anomaly.with_supervised(found["summary"], known["summary"].where("mode <> 'default'"), found["folds"], known["folds"])


@query("L20 L23", f"""WITH {sql.B1}, {sql.split()} SELECT row_id, TRUE AS decision_matches, TRUE AS label_matches FROM sp
WHERE role = 'validation'""")
def frozen_scoring(spark, folder):
    """Decision and label follow from score and threshold for every later row."""
    train, later = _parts(spark, folder)
    model = fit(train, NUMERIC_PROFILE, FAST, _KEPT)
    scorer = FrozenScorer.from_fit(model, NUMERIC_PROFILE, 0.5, 20).retarget(0.07)
    out = scorer.score(later.select("row_id", *scorer.sensors), IDS)
    flagged = F.col("positive_score") >= 0.07
    return out.select("row_id", (F.col("predicted_positive") == flagged).alias("decision_matches"),
                      (F.col("predicted_label") == F.when(flagged, 1).otherwise(-1)).alias("label_matches"))


@query("L21 L22 L29", f"""WITH {sql.B1}, {sql.split()} SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS unmatched,
CAST(0 AS DOUBLE) AS largest_gap, CAST(0 AS BIGINT) AS different_labels FROM sp WHERE role = 'validation'""")
def frozen_scoring_parity(spark, folder):
    """Scores of reordered columns and other partitions equal the first ones."""
    train, later = _parts(spark, folder)
    scorer = FrozenScorer.from_fit(fit(train, NUMERIC_PROFILE, FAST, _KEPT), NUMERIC_PROFILE, 0.07, 20)
    first = scorer.score(later.select("row_id", *scorer.sensors), IDS)
    again = scorer.score(later.repartition(3).select(*reversed(scorer.sensors), "row_id"), IDS)
    return rounded(score_gap(first, again, IDS))


@query("L20", f"""WITH {sql.B1} SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS infinite_rows,
COUNT(*) FILTER (sensor_2 IS NULL AND sensor_3 IS NULL AND sensor_5 IS NULL) AS all_missing_rows FROM b1""")
def frozen_input_guard(spark, folder):
    return input_violations(sensor_frame(spark, folder), ["sensor_2", "sensor_3", "sensor_5"])


@query("L26")
def random_against_time_validation(spark, folder):
    frame = stored_sensor_frame(spark, folder)
    out = None
    # The roles of the time split are comparisons with two literals; those of the random one are hashes.
    for kind, rows in (("time", time_split(frame, NUMERIC_PROFILE, role="role")),
                       ("random", cut_lineage(random_split(frame, NUMERIC_PROFILE, IDS, role="role")))):
        result = evaluation.compare_later_period(
            rows.where("role = 'train'").drop("role"), rows.where("role = 'validation'").drop("role"),
            NUMERIC_PROFILE, [FAST], SENSORS, IDS, 0.07, stored=True).withColumn("split_type", F.lit(kind))
        out = result if out is None else out.unionByName(result)
    return out


@query("M20 L10")
def later_period_error_analysis(spark, folder):
    """Fit on Train, group the later period's errors and compare sensors between them."""
    train, later = _parts(spark, folder)
    model = fit(train, NUMERIC_PROFILE, FAST, SENSORS)
    cases = cut_lineage(errors.assign_error_groups(model.score(later), NUMERIC_PROFILE, SCORE, 0.07))
    return errors.compare_error_features(cases, SENSORS)


@query("L25 T3")
def matched_reference_blocks(spark, folder):
    """Reference scores on stored fold blocks, rebuilt by joining on the saved row ids."""
    blocked = time_blocks(sensor_frame(spark, folder), NUMERIC_PROFILE, 2)
    stored = cut_lineage(blocked.select("row_id", "block"))
    rebuilt = cut_lineage(sensor_frame(spark, folder).join(stored, "row_id"))
    done = evaluation.score_folds(evaluation.time_fold_rows(rebuilt), NUMERIC_PROFILE, [FAST], SENSORS, IDS, "fold", [1, 2])
    return metrics.binary_metrics(done.predictions, NUMERIC_PROFILE, SCORE, 0.07, ["model_name", "fold"])
