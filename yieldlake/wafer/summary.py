"""Exploratory tables over the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dies import CLASS_NAMES
from ..operators.distribution import correlations
from .groups import map_hash_counts

NUMERIC = ["map_height", "map_width", "valid_die_count", "failed_die_count", "failed_die_ratio", "aspect_ratio"]
EDA_FIELDS = ("source_row_position", "lot_id", "pattern_label", "class_index", "label_status", "quality_status",
              "map_hash", "map_height", "map_width", "valid_die_count", "failed_die_count", "failed_die_ratio")


def class_table(manifest: DataFrame) -> DataFrame:
    """Labeled rows, accepted labeled rows and their lots per class, all nine listed."""
    spark = manifest.sparkSession
    classes = spark.createDataFrame([(c,) for c in CLASS_NAMES], "pattern_label string")
    ok = F.col("quality_status") == "accepted"
    found = manifest.where("label_status = 'labeled'").groupBy("pattern_label").agg(
        F.count(F.lit(1)).alias("labeled_samples"), F.count_if(ok).alias("accepted_labeled_samples"),
        F.count_distinct(F.when(ok, F.col("lot_id"))).alias("accepted_lot_count"))
    return classes.join(found, "pattern_label", "left").na.fill(0)


def status_table(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("label_status", "quality_status").agg(F.count(F.lit(1)).alias("rows"))


def shape_table(manifest: DataFrame) -> DataFrame:
    return manifest.where("map_hash is not null").groupBy("map_height", "map_width").agg(
        F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "map_height", "map_width")


def lot_sizes(manifest: DataFrame) -> DataFrame:
    """How many lots hold how many rows; lot names stay out of the result."""
    per_lot = manifest.where("lot_id is not null").groupBy("lot_id").agg(F.count(F.lit(1)).alias("rows_per_lot"))
    return per_lot.groupBy("rows_per_lot").agg(F.count(F.lit(1)).alias("lots"))


def statistics(manifest: DataFrame) -> DataFrame:
    """One row: rows, rows with a map, lots, repeated maps and label conflicts among labeled rows."""
    rows = manifest.agg(
        F.count(F.lit(1)).alias("row_count"), F.count("map_hash").alias("rows_with_valid_map"),
        F.count_distinct("lot_id").alias("lot_count"))
    maps = map_hash_counts(manifest).agg(
        F.count_if(F.col("n") > 1).alias("duplicate_map_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_duplicate_groups"))
    labeled = map_hash_counts(manifest.where("label_status = 'labeled'")).agg(
        F.count_if(F.col("labels") > 1).alias("map_label_conflict_groups"))
    return rows.crossJoin(F.broadcast(maps)).crossJoin(F.broadcast(labeled))


def accepted_numbers(manifest: DataFrame) -> DataFrame:
    """Accepted rows with a map and the aspect ratio width / height."""
    return manifest.where("map_hash is not null and quality_status = 'accepted'").withColumn(
        "aspect_ratio", F.when(F.col("map_height") > 0, F.col("map_width") / F.col("map_height")))


def map_correlations(manifest: DataFrame) -> DataFrame:
    return correlations(accepted_numbers(manifest), NUMERIC)


def class_correlations(manifest: DataFrame) -> DataFrame:
    """Correlations per class, with null cells for classes without enough rows."""
    spark = manifest.sparkSession
    numbers = accepted_numbers(manifest).where("pattern_label is not null")
    found = correlations(numbers, NUMERIC, ["pattern_label"])
    cells = [(c, m, a, b) for c in CLASS_NAMES for m in ("pearson", "spearman")
             for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]
    grid = spark.createDataFrame(cells, "pattern_label string, method string, first string, second string")
    return grid.join(found, ["pattern_label", "method", "first", "second"], "left").withColumn(
        "rows", F.coalesce("rows", F.lit(0)))


def first_examples(manifest: DataFrame) -> DataFrame:
    """Position of the first accepted labeled row per class."""
    return manifest.where("quality_status = 'accepted' and label_status = 'labeled'").groupBy("pattern_label").agg(
        F.min("source_row_position").alias("source_row_position"))
