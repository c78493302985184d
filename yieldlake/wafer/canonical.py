"""Canonical die-map manifest: normalisation, row states and integrity audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dies
from ..functions.scalars import ratio
from ..profile import ContractError

# Reasons that are not map errors.
MISSING_LOT = "MISSING_OR_INVALID_LOT"
INVALID_LABEL = "INVALID_LABEL"
MANIFEST_FIELDS = (
    "sample_id", "dataset_version", "source_row_position", "lot_id", "wafer_index", "source_partition",
    "pattern_label", "class_index", "label_status", "quality_status", "reason_codes", "split", "map",
    "map_hash", "map_height", "map_width", "valid_die_count", "failed_die_count", "failed_die_ratio",
)


def canonical_manifest(df: DataFrame, version: str, position: str, die_map: str, label: str, lot: str,
                       wafer: str | None = None, partition: str | None = None) -> DataFrame:
    """One pass that turns source rows into manifest rows; broken rows stay, quarantined with reasons."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def text(name: str | None):
        return F.lit(None).cast("string") if name is None else dies.scalar_text(F.col(name), types[name])

    lot_id = dies.stripped(F.col(lot)) if isinstance(types[lot], T.StringType) else F.lit(None).cast("string")
    cells = F.col(die_map).cast("array<array<tinyint>>")
    first = df.select(
        F.col(position).cast("bigint").alias("source_row_position"), lot_id.alias("lot_id"),
        text(wafer).alias("wafer_index"), text(partition).alias("source_partition"),
        dies.normalized_label(F.col(label), types[label]).alias("__label"),
        cells.alias("__cells"), dies.map_error(cells).alias("__error"))
    reasons = F.array_compact(F.array(
        F.col("__error"), F.when(F.col("lot_id").isNull(), MISSING_LOT),
        F.when(F.col("__label.label_status") == "invalid", INVALID_LABEL)))
    usable = F.when(F.col("__error").isNull(), F.col("__cells"))
    second = first.select(
        F.concat(F.lit(version + ":"), F.col("source_row_position").cast("string")).alias("sample_id"),
        F.lit(version).alias("dataset_version"), "source_row_position", "lot_id", "wafer_index", "source_partition",
        "__label.pattern_label", "__label.class_index", "__label.label_status",
        reasons.alias("reason_codes"), usable.alias("map"))
    held = F.size("reason_codes") > 0
    third = second.withColumns({
        "quality_status": F.when(held, "quarantined").otherwise("accepted"),
        "split": F.when(held, "quarantined").when(F.col("label_status") == "unlabeled", "unlabeled")
        .otherwise("pending"),
        "map_hash": dies.content_hash(F.col("map")),
        "map_height": F.when(F.col("map").isNotNull(), F.size("map")),
        "map_width": F.when(F.col("map").isNotNull(), F.size(F.get("map", F.lit(0)))),
        "valid_die_count": F.when(F.col("map").isNotNull(), dies.valid_count(F.col("map"))),
        "failed_die_count": F.when(F.col("map").isNotNull(), dies.failed_count(F.col("map"))),
    })
    return third.withColumn(
        "failed_die_ratio", ratio(F.col("failed_die_count"), F.col("valid_die_count"))).select(*MANIFEST_FIELDS)


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """Rows per (kind, item): row total, quality and label status, reasons and classes, in one pass."""
    def entry(kind: str, item):
        return F.struct(F.lit(kind).alias("kind"), item.alias("item"))

    entries = F.concat(
        F.array(entry("rows", F.lit("all")), entry("status", F.col("quality_status")),
                entry("status", F.col("label_status"))),
        F.transform("reason_codes", lambda r: entry("reason", r)),
        F.when(F.col("label_status") == "labeled", F.array(entry("class", F.col("pattern_label"))))
        .otherwise(F.expr("cast(array() as array<struct<kind:string,item:string>>)")))
    return manifest.select(F.inline(entries)).groupBy("kind", "item").agg(F.count(F.lit(1)).alias("rows"))


def label_coverage(manifest: DataFrame) -> DataFrame:
    """Whether every class has a labeled row."""
    seen = manifest.where("label_status = 'labeled'").agg(F.count_distinct("pattern_label").alias("classes"))
    return seen.withColumn("label_coverage_status", F.when(
        F.col("classes") == len(dies.CLASS_NAMES), "complete").otherwise("incomplete"))


def reconcile_counts(manifest: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared against observed counts per (kind, item), keeping only differences."""
    observed = manifest_counts(manifest).withColumnRenamed("rows", "observed")
    both = declared.select("kind", "item", F.col("rows").alias("declared")).join(observed, ["kind", "item"], "full_outer")
    return both.where(~F.col("declared").eqNullSafe(F.col("observed")))


def manifest_violations(manifest: DataFrame, version: str) -> DataFrame:
    """Rows with the contract codes they break; an intact manifest has none."""
    names = F.array(*map(F.lit, dies.CLASS_NAMES))
    labeled = F.col("label_status") == "labeled"
    why = F.col("reason_codes")
    known = F.array(*map(F.lit, (*dies.MAP_ERRORS, MISSING_LOT, INVALID_LABEL)))
    broken_map = F.arrays_overlap(why, F.array(*map(F.lit, dies.MAP_ERRORS)))
    held = F.size(why) > 0

    def code(name: str, bad):
        return F.when(F.coalesce(bad, F.lit(True)), name)

    expected_split = F.when(held, "quarantined").when(F.col("label_status") == "unlabeled", "unlabeled").otherwise("pending")
    codes = F.array_compact(F.array(
        code("INVALID_ROW_POSITION", F.col("source_row_position") < 0),
        code("INVALID_SAMPLE_ID", (F.col("dataset_version") != version) | (
            F.col("sample_id") != F.concat_ws(":", F.lit(version), F.col("source_row_position").cast("string")))),
        code("INVALID_LABEL_STATUS", ~F.col("label_status").isin("labeled", "unlabeled", "invalid")),
        code("LABEL_MAPPING_MISMATCH", labeled & ~F.coalesce(
            F.get(names, F.col("class_index")) == F.col("pattern_label"), F.lit(False))),
        code("INVALID_EMPTY_LABEL", ~labeled & (F.col("pattern_label").isNotNull() | F.col("class_index").isNotNull())),
        code("INVALID_LOT", F.col("lot_id").isNotNull() & ~F.col("lot_id").eqNullSafe(dies.stripped(F.col("lot_id")))),
        code("INVALID_REASONS", (F.size(F.array_distinct(why)) != F.size(why)) | (F.size(F.array_except(why, known)) > 0)),
        code("REASON_STATE_MISMATCH", (F.array_contains(why, MISSING_LOT) != F.col("lot_id").isNull()) | (
            F.array_contains(why, INVALID_LABEL) != (F.col("label_status") == "invalid"))),
        code("INVALID_ROW_STATE", (F.col("quality_status") != F.when(held, "quarantined").otherwise("accepted"))
             | (F.col("split") != expected_split)),
        code("MISSING_MAP_REFERENCE", F.col("map").isNull() & (~broken_map | F.col("map_hash").isNotNull())),
        code("UNEXPECTED_MAP_REFERENCE", F.col("map").isNotNull() & broken_map),
        code("INVALID_MAP_HASH", F.col("map").isNotNull() & ~F.coalesce(
            F.col("map_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)))))
    return manifest.select("sample_id", F.explode(codes).alias("code"))


def position_continuity(manifest: DataFrame) -> DataFrame:
    """One row: positions run 0..n-1 without repeats, one dataset version, unique sample ids."""
    per = manifest.groupBy("source_row_position").agg(
        F.count(F.lit(1)).alias("n"), F.min("dataset_version").alias("lo"), F.max("dataset_version").alias("hi"))
    return per.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_positions"),
        F.min("source_row_position").alias("first_position"), F.max("source_row_position").alias("last_position"),
        (F.min("lo") != F.max("hi")).alias("mixed_versions"),
    ).withColumn("continuous", (F.col("first_position") == 0) & (F.col("last_position") == F.col("rows") - 1)
                 & (F.col("distinct_positions") == F.col("rows")))


def map_violations(manifest: DataFrame) -> DataFrame:
    """Recompute values, hash, shape and counts of every stored map and list what differs."""
    cells = F.col("map")
    valid, failed = dies.valid_count(cells), dies.failed_count(cells)
    gap = F.abs(F.col("failed_die_ratio") - ratio(failed, valid))
    wrong_stats = (~F.col("map_height").eqNullSafe(F.size(cells))) | (
        ~F.col("map_width").eqNullSafe(F.size(F.get(cells, F.lit(0))))) | (
        ~F.col("valid_die_count").eqNullSafe(valid)) | (~F.col("failed_die_count").eqNullSafe(failed))
    codes = F.array_compact(F.array(
        F.when(dies.map_error(cells).isNotNull(), "INVALID_MAP_VALUES"),
        F.when(~F.col("map_hash").eqNullSafe(dies.content_hash(cells)), "MAP_HASH_MISMATCH"),
        F.when(wrong_stats, "MAP_STATISTIC_MISMATCH"),
        F.when(~F.coalesce(gap <= 1e-12, F.lit(False)), "MAP_RATIO_MISMATCH")))
    return manifest.where(cells.isNotNull()).select("sample_id", F.explode(codes).alias("code"))


def audit_report(manifest: DataFrame, version: str) -> DataFrame:
    """Violations per (stage, code) of the manifest and map stage."""
    stages = manifest_violations(manifest, version).withColumn("stage", F.lit("manifest")).unionByName(
        map_violations(manifest).withColumn("stage", F.lit("maps")))
    return stages.groupBy("stage", "code").agg(F.count(F.lit(1)).alias("rows"))


def source_profile(df: DataFrame, die_map: str, label: str, limit: int | None = None,
                   order: str | None = None) -> DataFrame:
    """First look: map status, shape and label structure with their row counts.

    The whole table is inspected, or the ``limit`` rows with the smallest ``order`` values.
    """
    if limit is not None:
        if order is None:
            raise ContractError("a limited profile needs an order")
        df = df.orderBy(order).limit(limit)
    cells = F.col(die_map).cast("array<array<tinyint>>")
    dtype = df.schema[label].dataType
    shape = F.concat_ws("x", F.size(cells).cast("string"), F.size(F.get(cells, F.lit(0))).cast("string"))
    status = dies.normalized_label(F.col(label), dtype)["label_status"]
    return df.groupBy(
        F.coalesce(dies.map_error(cells), F.lit("valid")).alias("map_status"), shape.alias("shape"),
        F.lit(dtype.simpleString()).alias("label_type"), status.alias("label_status"),
    ).agg(F.count(F.lit(1)).alias("rows"))
