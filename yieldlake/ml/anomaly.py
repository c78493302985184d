"""Anomaly scores learned from normal rows only."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics, policy
from ..operators.splits import fold_membership, fold_periods, time_blocks
from ..profile import ContractError, Evaluation, Profile
from ..scale import cut_lineage
from .evaluation import tagged, union_all
from .models import pca_to_variance, run_all
from .preprocess import FeaturePrep, FeaturePrepModel

SCORE = "anomaly_score"
SAMPLE = 256  # fixed value: rows per isolation tree


@dataclass
class PcaDetector:
    """Reconstruction error in the standardised space.

    Inputs are centred and components orthonormal, so the squared residual is the
    squared length of the input minus that of its kept components.
    """

    prep: FeaturePrepModel
    pca: object
    kept: int

    def score(self, df: DataFrame) -> DataFrame:
        done = self.pca.transform(self.prep.transform(df))
        x, z = vector_to_array(self.prep.get("outputCol")), F.slice(vector_to_array("components"), 1, self.kept)

        def squares(values):
            return F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v)

        width = len(self.prep.slot_names())
        return done.withColumn(SCORE, F.greatest(squares(x) - squares(z), F.lit(0.0)) / width).select(*df.columns, SCORE)


def _normal_rows(df: DataFrame, profile: Profile) -> DataFrame:
    return df.where(F.col(profile.label) == F.lit(profile.negative))


def fit_pca_detector(df: DataFrame, profile: Profile, features: list[str], share: float = 0.9) -> PcaDetector:
    normal = _normal_rows(df, profile)
    prep = FeaturePrep(features=features, missingThreshold=profile.missing_threshold,
                       dropConstant=profile.drop_constant, scale=True).fit(normal)
    model, k = pca_to_variance(prep.transform(normal), len(prep.slot_names()), share, prep.get("outputCol"))
    return PcaDetector(prep, model, k)


def path_constant(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(tree: int, values: np.ndarray, seed: int) -> list[tuple]:
    """Nodes ``(tree, node, feature, cut, left, right, length)`` of one isolation tree over at most 256 rows."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(values), 2)))
    nodes: list[tuple] = [()]
    todo = [(0, np.arange(len(values)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        part = values[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[node] = (tree, node, -1, 0.0, -1, -1, depth + path_constant(len(rows)))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        goes = part[:, f] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[node] = (tree, node, f, cut, left, right, 0.0)
        todo += [(left, rows[goes], depth + 1), (right, rows[~goes], depth + 1)]
    return nodes


@dataclass
class ForestDetector:
    """Isolation forest: trees of at most 256 sampled normal rows."""

    prep: FeaturePrepModel
    trees: list[np.ndarray]
    sample: int

    def score(self, df: DataFrame) -> DataFrame:
        # At most 511 nodes per tree, so the broadcast is bounded by the tree count.
        held = df.sparkSession.sparkContext.broadcast(self.trees)
        scale = max(path_constant(self.sample), 1e-12)

        @F.pandas_udf("double")
        def score(batch: pd.Series) -> pd.Series:
            x = np.stack(batch.to_numpy()).astype(float) if len(batch) else np.zeros((0, 1))
            total = np.zeros(len(x))
            for nodes in held.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    feature = nodes[at, 0].astype(int)
                    inner = np.flatnonzero(feature >= 0)
                    if not len(inner):
                        break
                    here = nodes[at[inner]]
                    left = x[inner, feature[inner]] <= here[:, 1]
                    at[inner] = np.where(left, here[:, 2], here[:, 3]).astype(int)
                total += nodes[at, 4]
            return pd.Series(np.power(2.0, -(total / len(held.value)) / scale))

        return df.withColumn(SCORE, score(self.prep.values()))


def fit_forest_detector(df: DataFrame, profile: Profile, features: list[str], ids: list[str], trees: int = 200,
                        seed: int = 42) -> ForestDetector:
    """Each row draws its trees by hash; every tree keeps the 256 smallest draws and grows in its own task."""
    normal = _normal_rows(df, profile)
    prep = FeaturePrep(features=features, missingThreshold=profile.missing_threshold,
                       dropConstant=profile.drop_constant, scale=True).fit(normal)
    n = normal.count()
    if n < 2:
        raise ContractError("anomaly detection needs at least two normal rows")
    size = min(SAMPLE, n)
    share = min(1.0, 2.0 * size / n + 40.0 / n)
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    draw = F.transform(numbers, lambda t: F.struct(
        t.alias("tree"), ((F.pmod(F.xxhash64(F.lit(seed), t, *ids), F.lit(1 << 40)) + 0.5) / float(1 << 40)).alias("u")))
    drawn = normal.select(F.explode(F.filter(draw, lambda d: d["u"] < share)).alias("d"), prep.values().alias("x"), *ids)
    # The draw share bounds each window to a few hundred rows whatever the table size.
    order = Window.partitionBy("d.tree").orderBy("d.u", *ids)
    sampled = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).select("d.tree", "r", "x")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        return pd.DataFrame(_grow(int(pdf["tree"].iloc[0]), np.stack(pdf["x"].to_numpy()).astype(float), seed),
                            columns=["tree", "node", "feature", "cut", "left", "right", "length"])

    grown = sampled.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, left int, right int, length double").toPandas()
    arrays = [g.sort_values("node")[["feature", "cut", "left", "right", "length"]].to_numpy(dtype=float)
              for _, g in grown.groupby("tree")]
    return ForestDetector(prep, arrays, size)


DETECTORS = ("isolation_forest", "pca_reconstruction")


def fit_detector(df: DataFrame, profile: Profile, name: str, features: list[str], ids: list[str],
                 settings: Evaluation, trees: int = 200):
    if name == "pca_reconstruction":
        return fit_pca_detector(df, profile, features, settings.pca_variance)
    if name == "isolation_forest":
        return fit_forest_detector(df, profile, features, ids, trees, settings.seed)
    raise ContractError(f"unknown detector: {name}")


def compare_anomalies(df: DataFrame, profile: Profile, features: list[str], ids: list[str], settings: Evaluation,
                      detectors: tuple[str, ...] = DETECTORS, outer_splits: int = 3, inner_splits: int = 2,
                      trees: int = 200) -> dict[str, DataFrame]:
    """Nested time comparison of detectors: F1 diagnostic and policy thresholds come from the past only."""
    blocked = cut_lineage(time_blocks(df, profile, outer_splits))
    columns = [*ids, profile.label]

    def scored(rows: DataFrame, block: str, fold: int, name: str, **tags) -> DataFrame:
        model = fit_detector(rows.where(F.col(block) < fold), profile, name, features, ids, settings, trees)
        return tagged(model.score(rows.where(F.col(block) == fold)).select(*columns, SCORE), model_name=name, **tags)

    folds = range(1, outer_splits + 1)
    future = run_all([lambda f=f, n=n: scored(blocked, "block", f, n, outer_fold=f)
                      for f in folds for n in detectors])
    inner = []
    for f in folds:
        past = time_blocks(blocked.where(F.col("block") < f), profile, inner_splits, "inner_block")
        inner += run_all([lambda i=i, n=n, p=past, f=f: scored(p, "inner_block", i, n, outer_fold=f, inner_fold=i)
            for i in range(1, inner_splits + 1) for n in detectors])
    keys = ["model_name", "outer_fold"]
    predictions, oof = cut_lineage(union_all(future)), cut_lineage(union_all(inner))
    # One candidate lies above the largest score, so that flagging nothing is an option.
    candidates = metrics.threshold_candidates(oof, SCORE, keys, default=None, above_max=True)
    table = cut_lineage(metrics.threshold_table(oof, profile, SCORE, keys, candidates))
    results = policy.apply_thresholds(policy.best_f1_threshold(table, keys), predictions, profile, SCORE, keys)
    outcome = policy.policy_outcome(policy.select_policy_threshold(table, settings.policy, keys), predictions, profile,
                                    SCORE, keys, settings.policy)
    return {"predictions": predictions, "oof_predictions": oof, "threshold_compare": table, "fold_results": results,
            "summary": metrics.fold_summary(results, ["model_name"]), "policy_selection": outcome,
            "folds": fold_periods(fold_membership(blocked, outer_splits).withColumnRenamed("fold", "outer_fold"), profile, ["outer_fold"])}


def with_supervised(anomaly_summary: DataFrame, supervised_summary: DataFrame, anomaly_periods: DataFrame,
                    supervised_periods: DataFrame) -> DataFrame:
    """Union of both summaries after the check that they used the same periods."""
    names = sorted(set(anomaly_periods.columns) & set(supervised_periods.columns))
    a, b = anomaly_periods.select(*names), supervised_periods.select(*names)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ContractError("the comparisons used different periods")
    return tagged(anomaly_summary, model_family="anomaly").unionByName(
        tagged(supervised_summary, model_family="supervised"), allowMissingColumns=True)
