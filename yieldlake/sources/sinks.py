"""Gated writes that never replace an existing table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.leakage import leakage_checks, time_boundaries
from ..profile import SPLIT_ROLE, ContractError, Profile
from ..scale import published
from .readers import Ingestion, build_canonical


def materialize(spark: SparkSession, plan: Ingestion, path: str) -> None:
    """Build the canonical table with its adapter and write it."""
    build_canonical(spark, plan).write.mode("errorifexists").parquet(path)


def write_splits(tagged: DataFrame, profile: Profile, path: str) -> DataFrame:
    """Write a tagged split table by strategy and role if every leakage check holds; return the checks.

    The table is written once to a staging folder and checked there; a table that fails leaves nothing.
    """
    spark = tagged.sparkSession
    with published(spark, path) as staging:
        tagged.write.partitionBy("strategy", SPLIT_ROLE).parquet(f"{staging}/splits")
        written = spark.read.schema(tagged.schema).parquet(f"{staging}/splits")
        checks = None
        for row in written.select("strategy").distinct().collect():
            mine = written.where(F.col("strategy") == row.strategy).drop("strategy")
            found = leakage_checks(mine, profile, row.strategy).select("check", "status", "split_type")
            if row.strategy == "time":
                found = found.unionByName(time_boundaries(mine, profile).select(
                    "check", "status", F.lit("time").alias("split_type")))
            checks = found if checks is None else checks.unionByName(found)
        if checks is None:
            raise ContractError("no rows to split")
        checks.coalesce(1).write.parquet(f"{staging}/checks")
        failed = [r.check for r in spark.read.parquet(f"{staging}/checks").where("status = 'FAIL'").collect()]
        if failed:
            raise ContractError(f"split checks failed: {failed}")
    return spark.read.parquet(f"{path}/checks")


def write_results(results: dict[str, DataFrame | None], path: str, **run: object) -> None:
    """One table per named result and a run-metadata row."""
    spark = SparkSession.getActiveSession()
    written = []
    for name, frame in results.items():
        if frame is not None:
            frame.write.mode("errorifexists").parquet(f"{path}/{name}")
            written.append(name)
    row = {"written_at": datetime.now(timezone.utc).isoformat(), "tables": ",".join(written),
           **{k: str(v) for k, v in run.items()}}
    spark.createDataFrame([row]).coalesce(1).write.mode("errorifexists").parquet(f"{path}/run")


def write_predictions(scorer, frame: DataFrame, ids: list[str], path: str) -> None:
    """Frozen scores to a new location."""
    scorer.score(frame, ids).write.mode("errorifexists").parquet(path)
