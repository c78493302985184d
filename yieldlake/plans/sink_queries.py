"""Queries that write tables to the shared scratch folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..ml.inference import FrozenScorer
from ..ml.models import Candidate, fit
from ..operators import metrics
from ..operators.splits import tag_splits
from ..scale import scratch_path
from ..sources import readers, sinks
from ..sources.tables import NUMERIC_PROFILE, SENSORS, score_frame, sensor_frame, table
from . import sql
from .registry import query


@query("S2 S3 S1", f"""WITH {sql.B1} SELECT CAST(label AS VARCHAR) AS label, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
ROUND(sensor_0, 6) AS sensor_0, ROUND(sensor_2, 6) AS sensor_1 FROM b1""")
def feature_metadata_pair(spark, folder):
    """Two headerless text sources in the same row order, joined line by line and stored."""
    ordered = sensor_frame(spark, folder).repartitionByRange(4, "row_id").sortWithinPartitions("row_id")
    features, labels, out = scratch_path(spark), scratch_path(spark), scratch_path(spark)
    ordered.select(F.concat_ws(" ", F.col("sensor_0").cast("string"), F.coalesce(
        F.col("sensor_2").cast("string"), F.lit("NaN")))).write.text(features)
    ordered.select(F.concat(F.col("label").cast("string"), F.lit(' "'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                            F.lit('"'))).write.text(labels)
    plan = readers.Ingestion("feature_metadata_pair", {
        "features": readers.TextSource(features, r"\s+"), "metadata": readers.TextSource(labels, r"\s+")},
        {"metadata_columns": ["label", "stamp"]})
    sinks.materialize(spark, plan, out)
    return rounded(spark.read.parquet(out).drop("row_pos"))


@query("S4", """SELECT CAST(event_id AS DOUBLE) AS event_id, ROUND(CASE WHEN event_id % 9 <> 0 THEN value END, 6) AS value FROM events""")
def strict_sensor_scan(spark, folder):
    path = scratch_path(spark)
    table(spark, folder, "events").select(
        F.col("event_id").cast("double").alias("event_id"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"),
    ).write.option("header", True).option("nullValue", "NaN").csv(path)
    # Every part file repeats the header, as the scan expects.
    return rounded(readers.read_sensor_csv(spark, path))


@query("S6", f"""WITH {sql.B1}, {sql.split()} SELECT role, COUNT(*) AS rows FROM sp GROUP BY role""")
def stored_split_rows(spark, folder):
    path = scratch_path(spark)
    sinks.write_splits(tag_splits(sensor_frame(spark, folder), NUMERIC_PROFILE, "row_id"), NUMERIC_PROFILE, path)
    return spark.read.parquet(f"{path}/splits").where("strategy = 'time'").groupBy(
        F.col("__split_role").alias("role")).agg(F.count(F.lit(1)).alias("rows"))


@query("S7", f"""WITH {sql.B2}, {sql.curve('b2', 'fold')}, {sql.metrics('fold', '0.5')}
SELECT fold, average_precision, roc_auc, true_positive FROM mr""")
def stored_result_table(spark, folder):
    path = scratch_path(spark)
    per_fold = metrics.binary_metrics(score_frame(spark, folder), NUMERIC_PROFILE, "score", 0.5, ["fold"])
    sinks.write_results({"fold_results": per_fold}, path, threshold=0.5)
    return rounded(spark.read.parquet(f"{path}/fold_results").select(
        "fold", "average_precision", "roc_auc", "true_positive"))


@query("S10 L20", f"""WITH {sql.B1} SELECT row_id, TRUE AS in_range FROM b1""")
def stored_predictions(spark, folder):
    frame = sensor_frame(spark, folder)
    model = fit(frame, NUMERIC_PROFILE, Candidate("lr", "logistic_regression", max_iter=10), SENSORS)
    scorer = FrozenScorer.from_fit(model, NUMERIC_PROFILE, 0.5, 20)
    path = scratch_path(spark)
    sinks.write_predictions(scorer, frame.select("row_id", *scorer.sensors), ["row_id"], path)
    return spark.read.parquet(path).select("row_id", F.col("positive_score").between(0, 1).alias("in_range"))
