"""Text and manifest scans with declared schemas."""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import nan_to_null
from ..profile import ContractError
from ..scale import cut_lineage, running_sum
from ..wafer.summary import EDA_FIELDS

Adapter = Callable[[SparkSession, "Ingestion"], DataFrame]
ADAPTERS: dict[str, Adapter] = {}


def adapter(name: str) -> Callable[[Adapter], Adapter]:
    """Register a builder of the canonical table."""
    def add(build: Adapter) -> Adapter:
        ADAPTERS[name] = build
        return build
    return add


@dataclass(frozen=True)
class TextSource:
    path: str
    sep: str = ","
    header: bool = False


@dataclass(frozen=True)
class Ingestion:
    """Which adapter builds the canonical table, from which sources."""

    adapter: str
    sources: dict[str, TextSource] = field(default_factory=dict)
    options: dict[str, object] = field(default_factory=dict)


def scan_delimited(spark: SparkSession, source: TextSource, schema: T.StructType | None = None) -> DataFrame:
    """Delimited scan; a pattern such as ``\\s+`` splits lines, a plain separator uses the CSV reader."""
    if len(source.sep) == 1:
        reader = spark.read.option("sep", source.sep).option("header", source.header).option("mode", "FAILFAST").option(
            "nanValue", "NaN")
        return nan_to_null((reader.schema(schema) if schema else reader).csv(source.path))
    if schema is None:
        raise ContractError("a pattern separator needs a schema")
    width = len(schema.fields)
    cut = F.split(F.trim("value"), source.sep)
    parts = F.when(F.size(cut) == width, cut).otherwise(F.raise_error(F.concat(
        F.lit(f"a line does not have {width} fields: "), F.substring("value", 1, 80))).cast("array<string>"))
    fields = [F.nullif(F.get("parts", F.lit(i)), F.lit("NaN")).cast(f.dataType).alias(f.name)
              for i, f in enumerate(schema.fields)]
    return spark.read.text(source.path).where(F.length(F.trim("value")) > 0).select(parts.alias("parts")).select(*fields)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their position over the part files in name order.

    File, block start and the row number inside the scan task give the order; it is
    written once so that a repeated scan cannot number the lines anew.
    """
    lines = cut_lineage(spark.read.text(path).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"),
        F.lit(1).cast("bigint").alias("one")).where(F.length(F.trim("value")) > 0))
    ranked = running_sum(lines, [F.col("file_path"), F.col("file_block_start"), F.col("at")], ["one"])
    return ranked.select("value", (F.col("cum_one") - 1).alias("row_pos"))


@adapter("feature_metadata_pair")
def feature_metadata_pair(spark: SparkSession, plan: Ingestion) -> DataFrame:
    """Join two headerless files line by line: metadata columns first, then ``prefix{i}`` features."""
    features, metadata = plan.sources["features"], plan.sources["metadata"]
    names = list(plan.options["metadata_columns"])
    prefix = str(plan.options.get("prefix", "sensor_"))
    # Each line is split once; a token that is no number stands out as a null that was not "NaN".
    left = _numbered_lines(spark, features.path).select("row_pos", F.split(F.trim("value"), features.sep).alias("parts"))
    wrong = F.exists("parts", lambda t: (t != "NaN") & t.try_cast("double").isNull())
    widths = left.agg(F.min(F.size("parts")).alias("lo"), F.max(F.size("parts")).alias("hi"), F.count_if(wrong).alias("bad")).first()
    if widths.lo is None or widths.lo != widths.hi:
        raise ContractError("feature rows differ in width")
    if widths.bad:
        raise ContractError(f"{widths.bad} feature rows hold a token that is no number")
    numbers = left.select("row_pos", F.transform("parts", lambda t: F.nullif(t, F.lit("NaN")).cast("double")).alias("parts"))
    values = numbers.select("row_pos", *[F.get("parts", F.lit(i)).alias(f"{prefix}{i}") for i in range(widths.lo)])
    right = _numbered_lines(spark, metadata.path)
    # Separators inside double quotes belong to the value.
    cut = F.split(F.trim("value"), f'(?:{metadata.sep})(?=(?:[^"]*"[^"]*")*[^"]*$)')
    if not right.where(F.size(cut) != len(names)).isEmpty():
        raise ContractError(f"a metadata row does not have the {len(names)} declared columns")
    labels = right.select("row_pos", *[
        F.regexp_replace(F.trim(F.get(cut, F.lit(i))), '^"|"$', "").alias(n) for i, n in enumerate(names)])
    paired = labels.join(values, "row_pos", "full_outer")
    counts = labels.agg(F.count(F.lit(1)).alias("n")).crossJoin(values.agg(F.count(F.lit(1)).alias("m"))).first()
    if counts.n != counts.m:
        raise ContractError(f"row counts differ: {counts.m} features, {counts.n} metadata")
    return paired.select(*names, *[f"{prefix}{i}" for i in range(widths.lo)], "row_pos")


def build_canonical(spark: SparkSession, plan: Ingestion) -> DataFrame:
    if plan.adapter not in ADAPTERS:
        raise ContractError(f"unknown adapter: {plan.adapter}")
    return ADAPTERS[plan.adapter](spark, plan)


def read_sensor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sensor scan with a checked header: non-empty unique names, every row as wide as the header.

    Only one header line reaches the driver; the scan checks the header of every other file
    against it, and rejects rows of another width and values that are no number.
    """
    head = spark.read.text(path).first()
    names = [n.strip() for n in next(csv.reader([head.value]), [])] if head else []
    if not names or any(not n for n in names) or len(set(names)) != len(names):
        raise ContractError("the header needs unique non-empty names")
    fields = [T.StructField(n, T.DoubleType()) for n in names]
    reader = spark.read.option("header", True).option("enforceSchema", False)
    marked = T.StructType([*fields, T.StructField("__corrupt", T.StringType())])
    loose = reader.option("columnNameOfCorruptRecord", "__corrupt").schema(marked).csv(path)
    try:
        # Hashing all columns makes the scan parse and check all of them.
        broken = loose.agg(F.count("__corrupt").alias("n"), F.max(F.hash(*names))).first().n
    except Exception as error:  # the message names the file whose header differs
        raise ContractError(f"the files do not have one header: {error}") from error
    if broken:
        raise ContractError("a row differs in width from the header or holds a value that is no number")
    return nan_to_null(reader.option("mode", "FAILFAST").schema(T.StructType(fields)).csv(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines manifest pruned to the fields of the exploratory tables."""
    types = {"source_row_position": "bigint", "class_index": "int", "map_height": "int", "map_width": "int",
             "valid_die_count": "int", "failed_die_count": "int", "failed_die_ratio": "double"}
    schema = ", ".join(f"{f} {types.get(f, 'string')}" for f in EDA_FIELDS)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
