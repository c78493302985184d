"""Sensor frames, score frames and die maps derived from the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null
from ..profile import Profile
from ..scale import cut_lineage

SENSORS = ["sensor_0", "sensor_1", "sensor_2", "sensor_3", "sensor_4", "sensor_5"]
SENSOR_PROFILE = Profile(
    "orders_sensor", "label", -1, 1, timestamp="ts", excluded=("row_id", "grp"),
    categorical=("machine",), feature_prefix="sensor_")
NUMERIC_PROFILE = Profile("orders_sensor", "label", -1, 1, timestamp="ts", excluded=("row_id", "grp"),
                          feature_prefix="sensor_")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table with NaN turned into null."""
    return nan_to_null(spark.read.parquet(f"{folder}/{name}.parquet"))


def sensor_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Orders joined to customers as a sensor table with a rare failure label."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    key = F.col("o_orderkey")
    return joined.select(
        key.alias("row_id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("grp"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), 1).otherwise(-1)
        .alias("label"),
        F.col("o_totalprice").alias("sensor_0"), F.col("c_acctbal").alias("sensor_1"),
        F.when(key % 3 != 0, F.col("o_totalprice") / 1000).alias("sensor_2"),
        F.when(key % 5 >= 3, F.col("c_acctbal")).alias("sensor_3"),
        F.lit(1.0).alias("sensor_4"),
        F.when(key % 2 != 0, F.col("c_nationkey").cast("double")).alias("sensor_5"),
        F.col("c_mktsegment").alias("machine"))


def stored_sensor_frame(spark: SparkSession, folder: str) -> DataFrame:
    """The sensor frame written once, for queries that read it many times: the join is made in one pass only."""
    return cut_lineage(sensor_frame(spark, folder))


def score_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Sensor frame with a deterministic tied score and a fold number."""
    return sensor_frame(spark, folder).withColumn(
        "score", ((F.col("row_id") * 7919) % 1000) / F.lit(1000.0)).withColumn("fold", F.col("row_id") % 5)


def monthly_groups(df: DataFrame) -> DataFrame:
    """Sensor frame whose group is the calendar month, so that time cuts can keep groups whole."""
    return df.withColumn("grp", F.year("ts") * 12 + F.month("ts"))


def wafer_source(spark: SparkSession, folder: str) -> DataFrame:
    """8x8 die maps from embeddings, with repeated maps, conflicting labels and some broken rows."""
    names = F.array(*map(F.lit, [
        "none", "Center", "Donut", "Edge-Loc", "Edge-Ring", " Loc ", "Near-full", "Random", "Scratch"]))
    base = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    vec = F.col("vec_id")
    cells = F.transform("embedding", lambda x, i: F.when(
        i.isin(0, 7, 56, 63), F.lit(0)).when(x > 0.1, F.lit(2)).otherwise(F.lit(1)).cast("tinyint"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(F.col("flat"), r * 8 + 1, 8))
    shaped = base.withColumn("flat", cells).select(
        "vec_id", F.col("label").alias("k"), grid.alias("wafer_map"))

    def rows(df: DataFrame, lot, k, copy: int) -> DataFrame:
        return df.select(
            (vec * 4 + copy).alias("position"), F.col("wafer_map"), lot.alias("lot_name"),
            (vec % 25).cast("string").alias("wafer_index"),
            F.get(names, k).alias("failure_type"))

    own = rows(shaped, F.concat(F.lit("lot_"), F.floor(vec / 5).cast("string")), F.col("k"), 0)
    twin = rows(shaped.where(vec % 50 == 0), F.concat(F.lit("twin_"), vec.cast("string")), F.col("k"), 1)
    clash = rows(shaped.where(vec % 100 == 0), F.concat(F.lit("clash_"), vec.cast("string")), (F.col("k") + 1) % 9, 2)
    broken = rows(shaped.where(vec % 120 == 7), F.when(vec % 240 == 7, F.lit("  ")).otherwise(F.lit("lot_x")),
                  F.lit(0), 3).withColumn("failure_type", F.lit("unknown")).withColumn(
        "wafer_map", F.when(F.col("lot_name") == "lot_x", F.expr(
            "transform(wafer_map, (r, i) -> transform(r, c -> cast(if(i = 1, 3, c) as tinyint)))")).otherwise(
            F.col("wafer_map")))
    return own.unionByName(twin).unionByName(clash).unionByName(broken)


def event_results(spark: SparkSession, folder: str) -> DataFrame:
    """Long result rows per (model, fold) from the events table."""
    return table(spark, folder, "events").select(
        F.col("event_id"), F.col("event_type").alias("model_name"), (F.col("user_id") % 3).alias("outer_fold"),
        ((F.col("event_id") % 100) / F.lit(100.0)).alias("ap"), "value", "ts", "user_id")
