"""Frozen scoring with a fixed sensor list, fit statistics and threshold."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..profile import ContractError, Profile
from .models import Fitted


def input_violations(df: DataFrame, sensors: list[str]) -> DataFrame:
    """Rows with an infinite value and rows without any known sensor."""
    values = F.array(*[F.col(s).cast("double") for s in sensors])
    infinite = F.exists(values, lambda v: F.coalesce(F.abs(v) == F.lit(float("inf")), F.lit(False)))
    empty = F.forall(values, lambda v: v.isNull() | F.isnan(v))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(infinite).alias("infinite_rows"),
                  F.count_if(empty).alias("all_missing_rows"))


@dataclass(frozen=True)
class FrozenScorer:
    """Pipeline, sensor order, labels and threshold; nothing is refitted."""

    pipeline: PipelineModel
    sensors: tuple[str, ...]
    positive: object
    negative: object
    threshold: float

    @staticmethod
    def from_fit(model: Fitted, profile: Profile, threshold: float, max_sensors: int) -> FrozenScorer:
        sensors = tuple(model.prep.get("features"))
        if len(sensors) > max_sensors:
            raise ContractError(f"{len(sensors)} sensors exceed the limit of {max_sensors}")
        return FrozenScorer(model.pipeline(), sensors, profile.positive, profile.negative, threshold)._checked()

    def _checked(self) -> FrozenScorer:
        if not self.sensors or len(set(self.sensors)) != len(self.sensors):
            raise ContractError("the sensor list must be non-empty and unique")
        if not 0.0 <= self.threshold <= 1.0:
            raise ContractError("the threshold must lie within 0 and 1")
        return self

    def retarget(self, threshold: float) -> FrozenScorer:
        """Same scores under another threshold."""
        return replace(self, threshold=threshold)._checked()

    def check(self, df: DataFrame, ids: list[str]) -> None:
        given = [c for c in df.columns if c not in ids]
        missing, extra = set(self.sensors) - set(given), set(given) - set(self.sensors)
        if missing or extra:
            raise ContractError(f"sensor columns differ: missing {sorted(missing)}, extra {sorted(extra)}")
        wrong = [f.name for f in df.schema.fields if f.name in self.sensors and not isinstance(f.dataType, T.NumericType)]
        if wrong:
            raise ContractError(f"non-numeric sensors: {wrong}")
        found = input_violations(df, list(self.sensors)).first()
        if not found.rows or found.infinite_rows or found.all_missing_rows:
            raise ContractError(f"unusable rows: {found.asDict()}")

    def score(self, df: DataFrame, ids: list[str], checked: bool = True) -> DataFrame:
        """``(ids, positive_score, predicted_positive, predicted_label)``; each row depends on itself only."""
        if checked:
            self.check(df, ids)
        scored = self.pipeline.transform(df).withColumn("positive_score", vector_to_array("probability")[1])
        flagged = F.col("positive_score") >= self.threshold
        return scored.select(*ids, "positive_score", flagged.alias("predicted_positive"), F.when(
            flagged, F.lit(self.positive)).otherwise(F.lit(self.negative)).alias("predicted_label"))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.pipeline.write().save(f"{path}/pipeline")
        spark.createDataFrame(
            [(list(self.sensors), str(self.positive), str(self.negative), isinstance(self.positive, int), self.threshold)],
            "sensors array<string>, positive string, negative string, integer_labels boolean, threshold double",
        ).coalesce(1).write.mode("errorifexists").parquet(f"{path}/contract")

    @staticmethod
    def load(path: str) -> FrozenScorer:
        spark = SparkSession.getActiveSession()
        row = spark.read.parquet(f"{path}/contract").first()
        cast = int if row.integer_labels else str
        return FrozenScorer(PipelineModel.load(f"{path}/pipeline"), tuple(row.sensors), cast(row.positive),
                            cast(row.negative), row.threshold)._checked()


def score_gap(left: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    """One row: rows compared, rows on one side only, largest score gap and differing decisions."""
    a = left.select(*ids, F.col("positive_score").alias("a"), F.col("predicted_label").alias("la"))
    b = right.select(*ids, F.col("positive_score").alias("b"), F.col("predicted_label").alias("lb"))
    both = a.join(b, ids, "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_gap"),
        F.count_if(F.col("la") != F.col("lb")).alias("different_labels"))


def require_parity(left: DataFrame, right: DataFrame, ids: list[str], tolerance: float = 1e-12) -> None:
    found = score_gap(left, right, ids).first()
    if found.unmatched or found.different_labels or (found.largest_gap or 0.0) > tolerance:
        raise ContractError(f"scores differ: {found.asDict()}")
