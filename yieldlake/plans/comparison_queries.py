"""Fitted comparisons, stored scorers and scans of written text, checked by closed forms where they exist."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import rounded
from ..ml import evaluation
from ..ml.evaluation import SCORE
from ..ml.inference import FrozenScorer, score_gap
from ..ml.models import Candidate, fit, importances, pca_to_variance, run_all, top_k_candidates
from ..ml.preprocess import FeaturePrep
from ..operators import metrics
from ..operators.splits import time_blocks, time_split
from ..operators.stability import fold_rank_table
from ..scale import scratch_path
from ..sources import readers
from ..sources.tables import NUMERIC_PROFILE, SENSORS, sensor_frame, stored_sensor_frame, table
from . import sql
from .registry import query
from .wafer_queries import _SOURCE, manifest

IDS = ["row_id"]
PLAIN = Candidate("all_sensors", "logistic_regression", max_iter=15)


def _parts(spark, folder):
    frame = time_split(stored_sensor_frame(spark, folder), NUMERIC_PROFILE, role="role")
    return frame.where("role = 'train'").drop("role"), frame.where("role = 'validation'").drop("role")


@query("S1", """SELECT CAST(event_id AS BIGINT) AS event_id, ROUND(CASE WHEN event_id % 9 <> 0 THEN value END, 6) AS value,
event_type AS kind FROM events""")
def scanned_text_table(spark, folder):
    """Lines with fields of varying distance, split by a pattern under a declared schema."""
    path = scratch_path(spark)
    events = table(spark, folder, "events")
    gap = F.when(F.col("event_id") % 2 == 0, "  ").otherwise("\t")
    value = F.when(F.col("event_id") % 9 == 0, "NaN").otherwise(F.col("value").cast("string"))
    events.select(F.concat(F.col("event_id").cast("string"), gap, value, gap, F.col("event_type"))).write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()),
                           T.StructField("kind", T.StringType())])
    return rounded(readers.scan_delimited(spark, readers.TextSource(path, r"\s+"), schema))


@query("S5", f"""WITH {_SOURCE} SELECT label_status, quality_status, COUNT(*) AS rows, COUNT(map_hash) AS maps,
CAST(SUM(failed_die_count) AS BIGINT) AS failed_dies FROM mf GROUP BY 1, 2""")
def scanned_manifest(spark, folder):
    """The manifest written as JSON lines and scanned with the fields of the exploratory tables."""
    path = scratch_path(spark)
    manifest(spark, folder).drop("map").write.json(path)
    return readers.read_manifest(spark, path).groupBy("label_status", "quality_status").agg(
        F.count(F.lit(1)).alias("rows"), F.count("map_hash").alias("maps"), F.sum("failed_die_count").alias("failed_dies"))


@query("L22", f"""WITH {sql.B1}, {sql.split()} SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS unmatched,
CAST(0 AS DOUBLE) AS largest_gap, CAST(0 AS BIGINT) AS different_labels FROM sp WHERE role = 'validation'""")
def saved_scorer_parity(spark, folder):
    """A scorer saved, loaded and applied gives the scores and labels that it gave before."""
    train, later = _parts(spark, folder)
    scorer = FrozenScorer.from_fit(fit(train, NUMERIC_PROFILE, PLAIN, SENSORS), NUMERIC_PROFILE, 0.07, 20)
    path = scratch_path(spark)
    scorer.save(path)
    rows = later.select("row_id", *scorer.sensors)
    return rounded(score_gap(scorer.score(rows, IDS), FrozenScorer.load(path).score(rows, IDS), IDS))


@query("L29", f"""WITH {sql.B1}, {sql.blocks('b1', 3)} SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS unmatched,
CAST(0 AS DOUBLE) AS largest_gap, CAST(0 AS BIGINT) AS different_labels FROM bl WHERE block = 3""")
def last_fold_refit(spark, folder):
    """The last fold fitted again gives the stored scores of that fold."""
    blocked = time_blocks(stored_sensor_frame(spark, folder), NUMERIC_PROFILE, 3)
    folds = evaluation.time_fold_rows(blocked, stored=True)
    stored, again = (evaluation.score_folds(folds, NUMERIC_PROFILE, [PLAIN], SENSORS, IDS, "fold", f).predictions.where("fold = 3")
                     for f in ([1, 2, 3], [3]))
    label = F.when(F.col(SCORE) >= 0.07, 1).otherwise(-1).alias("predicted_label")
    return rounded(score_gap(stored.select("row_id", SCORE, label), again.select("row_id", SCORE, label), IDS))


@query("L4 L30", f"""WITH {sql.B1} SELECT CAST(machine = 'BUILDING' AS INTEGER) AS sensor_b, COUNT(*) AS rows,
ROUND(COUNT(*) FILTER (label = 1) / CAST(COUNT(*) AS DOUBLE), 6) AS rate, TRUE AS score_is_rate FROM b1 GROUP BY 1""")
def logistic_on_binary_sensor(spark, folder):
    """Without a penalty, the fitted probability of each level of one binary sensor is its failure rate."""
    frame = sensor_frame(spark, folder).withColumn("sensor_b", (F.col("machine") == "BUILDING").cast("double"))
    model = fit(frame, NUMERIC_PROFILE, Candidate("binary", "logistic_regression", max_iter=100), ["sensor_b"])
    scored = model.score(frame).groupBy(F.col("sensor_b").cast("int").alias("sensor_b")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col("label") == 1).cast("double")).alias("rate"),
        F.max(SCORE).alias("high"), F.min(SCORE).alias("low"))
    near = (F.abs(F.col("high") - F.col("rate")) < 1e-4) & (F.abs(F.col("low") - F.col("rate")) < 1e-4)
    return rounded(scored.select("sensor_b", "rows", "rate", near.alias("score_is_rate")))


@query("F5 F6", f"""WITH {sql.B1}, {sql.split()}, r AS (SELECT ABS(CORR(sensor_0, sensor_1)) AS r FROM sp WHERE role = 'train')
SELECT 1 AS component, ROUND((1 + r) / 2, 6) AS share FROM r UNION ALL SELECT 2, ROUND((1 - r) / 2, 6) FROM r""")
def two_sensor_components(spark, folder):
    """Shares of variance of two standardised sensors: half of one plus and minus their correlation."""
    train, _ = _parts(spark, folder)
    prep = FeaturePrep(features=["sensor_0", "sensor_1"], scale=True, outputCol="all_features_vector").fit(train)
    model, _ = pca_to_variance(prep.transform(train), 2, 1.0)
    return rounded(spark.createDataFrame(
        [(i, float(v)) for i, v in enumerate(model.explainedVariance.toArray(), 1)], "component int, share double"))


_KEPT_INPUTS = " + ".join(
    f"CAST(AVG(CAST({c} IS NULL AS INTEGER)) <= 0.5 AND MIN({c}) < MAX({c}) AS BIGINT)" for c in SENSORS)


@query("L9 L2 Q12", f"""WITH {sql.B1}, {sql.blocks('b1', 3)}, f AS (SELECT UNNEST([1, 2, 3]) AS fold),
c AS (SELECT fold, COUNT(*) AS fit_rows, COUNT(*) FILTER (label = -1) / CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) AS r,
{_KEPT_INPUTS} AS k FROM bl, f WHERE block < fold GROUP BY fold)
SELECT 'plain' AS model_name, fold, fit_rows, CAST(1 AS DOUBLE) AS positive_weight, k AS model_input_count FROM c
UNION ALL SELECT 'weighted', fold, fit_rows, ROUND(r, 6), k FROM c""")
def time_fold_fit_records(spark, folder):
    """What each fit of each time fold received: its rows, its positive weight and its inputs."""
    blocked = time_blocks(stored_sensor_frame(spark, folder), NUMERIC_PROFILE, 3)
    candidates = [Candidate("plain", "logistic_regression", max_iter=5),
                  Candidate("weighted", "logistic_regression", weight_mode="ratio", max_iter=5)]
    done = evaluation.score_folds(evaluation.time_fold_rows(blocked, stored=True), NUMERIC_PROFILE, candidates,
                                  SENSORS, IDS, "fold", [1, 2, 3])
    return rounded(done.fits.select("model_name", F.col("fold").cast("int").alias("fold"), "fit_rows", "positive_weight", "model_input_count"))


@query("L7 L11 L28 L30 F15")
def top_k_against_all_sensors(spark, folder):
    """All sensors against the best ones by a forest fitted on Train, with the relative loss of average precision."""
    train, later = _parts(spark, folder)
    base = Candidate("forest", "logistic_regression", selector="forest", trees=10, max_iter=15)
    results = evaluation.compare_later_period(
        train, later, NUMERIC_PROFILE, [PLAIN, *top_k_candidates(base, (3, 2, 1))], SENSORS, IDS, 0.07, stored=True)
    return evaluation.relative_ap_loss(results, "all_sensors")


@query("L27 F17")
def gain_candidate_comparison(spark, folder):
    """No selection, selection by boosted gain and by gain that is stable over bootstraps, on the same later rows."""
    train, later = _parts(spark, folder)
    candidates = [PLAIN, Candidate("gain_top_2", "logistic_regression", selector="gain", top_k=2, trees=5, max_iter=15),
                  Candidate("stable_gain_top_2", "logistic_regression", selector="stable_gain", top_k=2, trees=3, repeats=5, max_iter=15)]
    results = evaluation.compare_later_period(train, later, NUMERIC_PROFILE, candidates, SENSORS, IDS, 0.07, stored=True)
    return evaluation.relative_ap_loss(results, "all_sensors")


@query("L32 F11")
def fitted_fold_ranks(spark, folder):
    """Ranks of the sensors by a forest fitted on the past rows of each time fold."""
    blocked = time_blocks(stored_sensor_frame(spark, folder), NUMERIC_PROFILE, 3)
    forest = Candidate("forest", "random_forest", trees=10)

    def ranks(fold: int) -> list[tuple]:
        model = fit(blocked.where(F.col("block") < fold), NUMERIC_PROFILE, forest, SENSORS)
        found = importances(model.model, model.prep.slot_names())
        return [(fold, name, rank, value, rank <= 2) for rank, (name, value) in enumerate(found, 1)]

    rows = [r for found in run_all([lambda f=f: ranks(f) for f in (1, 2, 3)]) for r in found]
    records = spark.createDataFrame(rows, "fold int, feature string, importance_rank int, importance double, in_topk boolean")
    return fold_rank_table(records, [1, 2, 3])


_STUMPS = f"""{sql.B1}, {sql.blocks('b1', 3)}, fr AS (SELECT fold, label, sensor_5 FROM bl, (SELECT UNNEST([1, 2, 3]) AS fold) WHERE block < fold),
md AS (SELECT fold, quantile_cont(sensor_5, 0.5) AS med, COUNT(*) FILTER (label = -1) / CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) AS r
 FROM fr GROUP BY fold),
vw AS (SELECT fold, COALESCE(sensor_5, med) AS x, SUM(CASE WHEN label = 1 THEN r ELSE 1 END) AS w,
 SUM(CASE WHEN label = 1 THEN r ELSE -1 END) AS s FROM fr JOIN md USING (fold) GROUP BY ALL),
cu AS (SELECT fold, SUM(w) OVER l AS wl, SUM(s) OVER l AS sl, SUM(w) OVER (PARTITION BY fold) AS wa, SUM(s) OVER (PARTITION BY fold) AS sa
 FROM vw WINDOW l AS (PARTITION BY fold ORDER BY x)),
gn AS (SELECT fold, MAX(sl * sl / wl + (sa - sl) * (sa - sl) / (wa - wl) - sa * sa / wa) AS gain FROM cu WHERE wl < wa - 0.5::DOUBLE GROUP BY fold)"""


@query("F17 L27", f"""WITH {_STUMPS} SELECT CAST(fold AS INTEGER) AS fold, 'sensor_5' AS feature, ROUND(gain, 4) AS gain FROM gn""")
def stump_gain_by_time_fold(spark, folder):
    """The class-weighted gain of one split on each time fold's fit rows: the best of all splits of a sensor of 25 values."""
    profile = replace(NUMERIC_PROFILE, missing_threshold=0.9)
    blocked = time_blocks(stored_sensor_frame(spark, folder), profile, 3)
    stump = Candidate("stump", "boosted_trees", trees=1, selector_depth=1)
    return rounded(evaluation.fold_gains(evaluation.time_fold_rows(blocked, stored=True), profile, stump, ["sensor_5"], [1, 2, 3])[0], 4)


@query("F17 L27")
def gain_average_over_time_folds(spark, folder):
    """Share of the class-weighted gain that each sensor brings, averaged over the time folds."""
    blocked = time_blocks(stored_sensor_frame(spark, folder), NUMERIC_PROFILE, 3)
    return rounded(evaluation.fold_gains(evaluation.time_fold_rows(blocked, stored=True), NUMERIC_PROFILE, Candidate("gain", "boosted_trees", trees=10),
                                         SENSORS, [1, 2, 3])[1])


@query("L27 L11")
def three_candidates_over_time(spark, folder):
    """All sensors, stable ones and those of weighted gain under one weighted final classifier, over the time folds."""
    blocked = time_blocks(stored_sensor_frame(spark, folder), NUMERIC_PROFILE, 3)
    final = Candidate("all_sensors", "boosted_trees", weight_mode="ratio", trees=10)
    candidates = [final, replace(final, name="stable_top_2", selector="stable_forest", top_k=2, repeats=3),
                  replace(final, name="weighted_gain_top_2", selector="weighted_gain", top_k=2)]
    done = evaluation.score_folds(evaluation.time_fold_rows(blocked, stored=True), NUMERIC_PROFILE, candidates, SENSORS, IDS, "fold", [1, 2, 3])
    per_fold = metrics.binary_metrics(done.predictions, NUMERIC_PROFILE, evaluation.SCORE, 0.5, ["model_name", "fold"])
    return rounded(per_fold.select("model_name", "fold", "support", "average_precision", "roc_auc"))
