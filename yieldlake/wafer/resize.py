"""Resize checks and the model-input table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dies
from ..functions.dies import CLASS_NAMES
from ..functions.scalars import ratio
from ..profile import ContractError
from ..scale import published
from .groups import SPLITS

# Rows per file of the input table and the target size.
MAX_RECORDS_PER_FILE = 4096
TARGET = (128, 128)


def with_resized(rows: DataFrame, target: tuple[int, int] = TARGET, die_map: str = "map") -> DataFrame:
    """Add ``geometry`` and ``resized`` to rows with a map."""
    cells = F.col(die_map)
    geometry = dies.resize_geometry(F.size(cells), F.size(F.get(cells, F.lit(0))), *target)
    return rows.withColumn("geometry", geometry).withColumn(
        "resized", dies.resized(cells, F.col("geometry"), *target))


def preservation(before: Column, after: Column) -> dict[str, Column]:
    """Valid and failed cells on both sides, their ratios and the lost-region flags."""
    valid0, failed0 = dies.valid_count(before), dies.failed_count(before)
    valid1, failed1 = dies.valid_count(after), dies.failed_count(after)
    first, second = ratio(failed0, valid0), ratio(failed1, valid1)
    return {
        "original_valid_dies": valid0, "original_failed_dies": failed0,
        "transformed_valid_pixels": valid1, "transformed_failed_pixels": failed1,
        "original_failed_ratio": first, "transformed_failed_ratio": second,
        "absolute_ratio_delta": F.abs(second - first),
        "failed_region_lost": (failed0 > 0) & (failed1 == 0), "valid_region_lost": valid1 == 0,
    }


def preservation_rows(rows: DataFrame, target: tuple[int, int] = TARGET) -> DataFrame:
    """Geometry and preservation metrics per row; test rows are never read."""
    kept = rows.where(F.col("split").isin("train", "validation") & F.col("map").isNotNull())
    return with_resized(kept, target).withColumns(preservation(F.col("map"), F.col("resized"))).select(
        "sample_id", "source_row_position", "split", "pattern_label", "class_index", "geometry.*",
        "original_valid_dies", "original_failed_dies", "transformed_valid_pixels", "transformed_failed_pixels",
        "original_failed_ratio", "transformed_failed_ratio", "absolute_ratio_delta",
        "failed_region_lost", "valid_region_lost")


def preservation_report(checked: DataFrame) -> DataFrame:
    """Rows, losses, mean and largest ratio change per (split, class)."""
    return checked.groupBy("split", "pattern_label").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("failed_region_lost").alias("failed_region_lost"),
        F.count_if("valid_region_lost").alias("valid_region_lost"),
        F.avg("absolute_ratio_delta").alias("mean_absolute_ratio_delta"),
        F.max("absolute_ratio_delta").alias("max_absolute_ratio_delta"),
        F.count("absolute_ratio_delta").alias("ratio_comparison_rows"))


def example_picks(checked: DataFrame) -> DataFrame:
    """First row per class and the smallest, largest, most extreme and first lost map (earliest on ties)."""
    cells = F.col("original_height").cast("bigint") * F.col("original_width")
    aspect = F.greatest("original_height", "original_width") / F.least("original_height", "original_width")
    position = F.col("source_row_position")
    per_class = checked.groupBy("pattern_label").agg(F.min("source_row_position").alias("position")).select(
        F.col("pattern_label").alias("example"), "position")
    picked = checked.agg(
        F.min(F.struct(cells, position)).alias("a"), F.min(F.struct(-cells, position)).alias("b"),
        F.min(F.struct(-aspect, position)).alias("c"),
        F.min(F.when(F.col("failed_region_lost"), position)).alias("d"))
    whole = picked.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("example"), p.alias("position")) for n, p in (
            ("Smallest map", F.col("a.source_row_position")), ("Largest map", F.col("b.source_row_position")),
            ("Extreme aspect", F.col("c.source_row_position")), ("First lost defect", F.col("d")))])))
    return per_class.unionByName(whole.where("position is not null"))


def check_gate(report: DataFrame, split_rows: DataFrame) -> DataFrame:
    """(split, class) pairs whose checked rows differ from the split or that lost a region; empty when passed."""
    expected = split_rows.where(F.col("split").isin("train", "validation")).groupBy("split", "pattern_label").agg(
        F.count(F.lit(1)).alias("expected"))
    both = report.select("split", "pattern_label", F.col("rows").alias("checked"),
                         (F.col("failed_region_lost") + F.col("valid_region_lost")).alias("lost"))
    return expected.join(both, ["split", "pattern_label"], "full_outer").where(
        ~F.col("expected").eqNullSafe(F.col("checked")) | (F.coalesce("lost", F.lit(0)) > 0))


def input_table(split_rows: DataFrame, target: tuple[int, int] = TARGET) -> DataFrame:
    """Labeled maps of the three splits at model size, one row per sample."""
    kept = split_rows.where(F.col("split").isin(*SPLITS) & F.col("map").isNotNull())
    return with_resized(kept, target).select("sample_id", "split", "class_index", F.col("resized").alias("map"))


def class_weights(split_rows: DataFrame) -> DataFrame:
    """Train rows and weight ``N / (9 n)`` per class."""
    spark = split_rows.sparkSession
    classes = spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_index int, pattern_label string")
    counts = split_rows.where("split = 'train'").groupBy("class_index").agg(F.count(F.lit(1)).alias("n"))
    full = classes.join(counts, "class_index", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # nine rows
    return full.select("class_index", "pattern_label", F.col("n").alias("train_samples"),
                       ratio(total, F.lit(len(CLASS_NAMES)) * F.col("n")).alias("weight"))


def _row_breaches(target: tuple[int, int]) -> dict[str, Column]:
    """What may be wrong with one row of the input table."""
    cells = F.col("map")
    flat = F.flatten(cells)
    shape = (F.size(cells) == target[0]) & (F.size(flat) == target[0] * target[1])
    values = F.size(F.array_except(F.array_distinct(flat), F.array(*[F.lit(v).cast("tinyint") for v in (0, 1, 2)]))) == 0
    whole = dies.failed_count(cells) <= dies.valid_count(cells)
    known = F.col("class_index").between(0, len(CLASS_NAMES) - 1)
    return {"wrong_shape": ~F.coalesce(shape, F.lit(False)), "wrong_values": ~F.coalesce(values, F.lit(False)),
            "defect_outside_valid": ~F.coalesce(whole, F.lit(False)), "wrong_class": ~F.coalesce(known, F.lit(False)),
            "wrong_split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))}


def write_input_table(split_rows: DataFrame, report: DataFrame, path: str, target: tuple[int, int] = TARGET) -> None:
    """Write the gated input table by split; refuses an existing path, any lost region and any broken row.

    Rows are counted and judged in the job that writes them to a staging folder, which is
    published when all hold.  They are spread within each split by sample hash, so a split
    with most rows still writes from many tasks.
    """
    if not check_gate(report, split_rows).isEmpty():
        raise ContractError("the resize check does not cover the split or lost a region")
    spark = split_rows.sparkSession
    salt = F.pmod(F.xxhash64("sample_id"), F.lit(1024))
    seen = Observation()
    table = input_table(split_rows, target)
    with published(spark, path) as staging:
        (table.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in _row_breaches(target).items()])
         .repartition("split", salt).write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy("split").parquet(staging))
        broken = {n: v for n, v in seen.get.items() if n != "rows" and v}
        ids = spark.read.schema(table.schema).parquet(staging).agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("sample_id").alias("ids")).first()
        if broken or ids.rows != seen.get["rows"] or ids.ids != ids.rows:
            raise ContractError(f"the input table breaks its contract: {broken}, {ids.rows} rows, {ids.ids} samples")


def input_violations(table: DataFrame, target: tuple[int, int] = TARGET) -> DataFrame:
    """One row of contract breaches over the whole input table; all zero when it is usable."""
    checks = _row_breaches(target)
    per_id = table.select("sample_id", *[c.alias(n) for n, c in checks.items()]).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(n).alias(n) for n in checks])
    return per_id.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated_ids"), *[F.sum(n).alias(n) for n in checks])


def as_channels(table: DataFrame) -> DataFrame:
    """Model input: defect and valid mask as floats."""
    return table.withColumn("channels", dies.channels(F.col("map")))
