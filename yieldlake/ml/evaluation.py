"""Cross-validation, out-of-fold scores and nested time evaluation of candidates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import event_time, ratio
from ..operators import leakage, metrics, policy
from ..operators.splits import fold_membership, fold_periods, recent_rows, stratified_homes, time_blocks
from ..profile import ContractError, Evaluation, Profile
from ..scale import cut_lineage
from .models import Candidate, Fitted, averaged_gains, fit, prep_statistics, run_all, weighted_gains

SCORE = "positive_score"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged(df: DataFrame, **tags) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def fit_record(model: Fitted, spark, **tags) -> DataFrame:
    """One row: what the filter removed, how many features the model received and its weights."""
    row = {**tags, "high_missing_removed_count": len(model.prep.get("removedMissing")),
           "constant_removed_count": len(model.prep.get("removedConstant")),
           "retained_feature_count": len(model.prep.get("features")), "model_input_count": model.feature_count(),
           "positive_weight": float(model.weights["positive"]), "fit_rows": int(model.weights["rows"])}
    return spark.createDataFrame([row])


def selection_rows(model: Fitted, spark, **tags) -> DataFrame | None:
    """Selected features of one fit with rank, importance and feature space."""
    if not model.selected:
        return None
    keys = ["feature", "selection_rank", "selection_importance", "feature_space"]
    schema = "feature string, selection_rank int, selection_importance double, feature_space string"
    return tagged(spark.createDataFrame([tuple(s[k] for k in keys) for s in model.selected], schema), **tags)


@dataclass
class Scored:
    """Scored evaluation rows and the records of every fit."""

    predictions: DataFrame
    fits: DataFrame
    selected: DataFrame | None


@dataclass
class FoldRows:
    """Rows stored once, and which of them fit and which evaluate a fold.

    Statistics read rows that are ``stored`` where they are; of others they write what they need.
    """

    rows: DataFrame
    fit: Callable[[int], Column]
    evaluation: Callable[[int], Column]
    stored: bool = False


def time_fold_rows(blocked: DataFrame, block: str = "block", stored: bool = False) -> FoldRows:
    """Fold i evaluates block i and fits on all earlier blocks."""
    return FoldRows(blocked, lambda f: F.col(block) < f, lambda f: F.col(block) == f, stored)


def cv_fold_rows(df: DataFrame, profile: Profile, ids: list[str], n_splits: int, n_repeats: int, seed: int) -> FoldRows:
    """Stratified repeats under one running fold number; the rows carry their fold of each repeat."""
    placed = cut_lineage(stratified_homes(df, profile, ids, n_splits, n_repeats, seed, "__homes"))

    def home(f: int) -> Column:
        return F.get("__homes", F.lit((f - 1) // n_splits)) == (f - 1) % n_splits + 1

    return FoldRows(placed, lambda f: ~home(f), home, True)


def score_folds(members: FoldRows, profile: Profile, candidates: list[Candidate], features: list[str], ids: list[str],
                fold: str, folds: list[int], keep: list[str] | None = None, role: str = "oof") -> Scored:
    """Fit each candidate on every fold's fit rows and score its evaluation rows.

    The folds of all candidates run as concurrent jobs and share the statistics of their fit
    rows; predictions are written once.
    """
    spark = members.rows.sparkSession
    columns = [*ids, profile.label, *(keep or [])]

    def job(c: Candidate, f: int):
        model = fit(members.rows.where(members.fit(f)), profile, c, features, ids, known[f])
        scored = model.score(members.rows.where(members.evaluation(f))).select(*columns, SCORE)
        tags = {"model_name": c.name, fold: f}
        return (tagged(scored, **tags), fit_record(model, spark, **tags, fit_role=role),
                selection_rows(model, spark, **tags, fit_role=role, fit_id=f"{c.name}:{role}:{f}"))

    known = dict(zip(folds, run_all([lambda f=f: prep_statistics(
        members.rows.where(members.fit(f)), profile, features, members.stored, candidates) for f in folds])))
    done = run_all([lambda c=c, f=f: job(c, f) for c in candidates for f in folds])
    chosen = [d[2] for d in done if d[2] is not None]
    return Scored(cut_lineage(union_all([d[0] for d in done])), union_all([d[1] for d in done]),
                  union_all(chosen) if chosen else None)


def fold_gains(members: FoldRows, profile: Profile, c: Candidate, features: list[str], folds: list[int]) -> tuple[DataFrame, DataFrame]:
    """Class-weighted split gains ``(fold, feature, gain)`` of every fold's fit rows, and their average ``(feature, share, rank)``."""
    spark = members.rows.sparkSession
    def run(f: int) -> list[tuple[str, float]]:
        rows = members.rows.where(members.fit(f))
        return weighted_gains(rows, profile, c, features, prep_statistics(rows, profile, features, members.stored))

    runs = run_all([lambda f=f: run(f) for f in folds])
    rows = [(f, n, v) for f, run in zip(folds, runs) for n, v in run]
    mean = [(n, v, i) for i, (n, v) in enumerate(averaged_gains(runs, features), 1)]
    return (spark.createDataFrame(rows, "fold int, feature string, gain double"),
            spark.createDataFrame(mean, "feature string, share double, rank int"))


def compare_candidates(df: DataFrame, profile: Profile, candidates: list[Candidate], features: list[str],
                       ids: list[str], settings: Evaluation) -> dict[str, DataFrame]:
    """Repeated-CV comparison: metrics per fold, mean and population deviation per model."""
    members = cv_fold_rows(df, profile, ids, settings.n_splits, settings.n_repeats, settings.seed)
    done = score_folds(members, profile, candidates, features, ids, "cv_fold",
                       list(range(1, settings.n_splits * settings.n_repeats + 1)))
    per_fold = metrics.binary_metrics(done.predictions, profile, SCORE, settings.default_threshold, ["model_name", "cv_fold"])
    names = ["average_precision", "roc_auc", "recall", "precision", "f1"]
    summary = per_fold.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("folds"), *[a for n in names for a in (
            F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"))])
    return {"fold_results": per_fold, "summary": summary, "predictions": done.predictions, "fits": done.fits,
            "selected": done.selected}


def oof_scores(df: DataFrame, profile: Profile, candidate: Candidate, features: list[str], ids: list[str],
               settings: Evaluation, method: str = "single") -> DataFrame:
    """One out-of-fold score per row: a single repeat, or the mean over repeats."""
    repeats = 1 if method == "single" else settings.n_repeats
    members = cv_fold_rows(df, profile, ids, settings.n_splits, repeats, settings.seed)
    done = score_folds(members, profile, [candidate], features, ids, "cv_fold",
                       list(range(1, settings.n_splits * repeats + 1)))
    scores = metrics.mean_scores(done.predictions, [*ids, profile.label], SCORE)
    wrong = scores.where(F.col("prediction_count") != repeats)
    if not wrong.isEmpty():
        raise ContractError("a row lacks or repeats an out-of-fold prediction")
    return scores


def compare_temporal(df: DataFrame, profile: Profile, candidates: list[Candidate], features: list[str], ids: list[str],
                     settings: Evaluation, outer_splits: int = 3, inner_splits: int = 2,
                     modes: tuple[str, ...] = ("temporal_oof",)) -> dict[str, DataFrame]:
    """Nested time evaluation: thresholds come from inner out-of-fold scores of the past only.

    Fits run per (fold, model); everything after the scores is one job over all keys.
    """
    leakage.require_train_role(df)
    blocked = cut_lineage(time_blocks(df, profile, outer_splits))
    outer = fold_membership(blocked, outer_splits).withColumnRenamed("fold", "outer_fold")
    folds = list(range(1, outer_splits + 1))
    done = score_folds(time_fold_rows(blocked, stored=True), profile, candidates, features, ids, "outer_fold", folds, role="outer_fit")
    inner_parts, inner_fits = [], []
    for f in folds:
        past = blocked.where(F.col("block") < f)
        for mode in modes:
            if mode == "temporal_oof":
                # Inner blocks are time cuts, a column of the stored rows.
                members = time_fold_rows(time_blocks(past, profile, inner_splits, "inner_block"), "inner_block", stored=True)
                inner_folds = list(range(1, inner_splits + 1))
            else:
                members = cv_fold_rows(past, profile, ids, settings.n_splits, 1, settings.seed)
                inner_folds = list(range(1, settings.n_splits + 1))
            scored = score_folds(members, profile, candidates, features, ids, "inner_fold", inner_folds,
                                 role="inner_oof")
            inner_parts.append(tagged(scored.predictions, outer_fold=f, mode=mode))
            inner_fits.append(tagged(scored.fits, outer_fold=f, mode=mode))
    keys = ["model_name", "outer_fold", "mode"]
    oof = cut_lineage(union_all(inner_parts))
    table = cut_lineage(metrics.threshold_table(oof, profile, SCORE, keys, default=settings.default_threshold))
    best = policy.best_f1_threshold(table, keys).select(*keys, "threshold")
    fixed = done.predictions.select("model_name", "outer_fold").distinct().select(
        "model_name", "outer_fold", F.lit("default").alias("mode"), F.lit(settings.default_threshold).alias("threshold"))
    chosen = best.unionByName(fixed)
    results = policy.apply_thresholds(chosen, done.predictions, profile, SCORE, ["model_name", "outer_fold"], ["mode"])
    picked = policy.select_policy_threshold(table, settings.policy, keys)
    outcome = policy.policy_outcome(
        picked, done.predictions.crossJoin(F.broadcast(picked.select("mode").distinct())), profile, SCORE, keys, settings.policy)
    past = outer.where("fold_role = 'fit'").groupBy("outer_fold").agg(F.count(F.lit(1)).alias("train_samples"))
    covered = oof.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("oof_samples"),
        F.count_if(F.col(profile.label) == F.lit(profile.positive)).alias("oof_fail"))
    coverage = covered.join(past, "outer_fold").withColumn(
        "excluded_initial_samples", F.col("train_samples") - F.col("oof_samples"))
    return {
        "folds": fold_periods(outer, profile, ["outer_fold"]), "fold_results": results,
        "summary": metrics.fold_summary(results, ["model_name", "mode"]), "predictions": done.predictions,
        "oof_predictions": oof, "oof_coverage": coverage, "threshold_compare": table, "policy_selection": outcome,
        "quality_filter": union_all([done.fits, *inner_fits]), "selected": done.selected}


def compare_later_period(train: DataFrame, later: DataFrame, profile: Profile, candidates: list[Candidate],
                         features: list[str], ids: list[str], threshold: float, stored: bool = False) -> DataFrame:
    """Fit on Train, score a later period, one metric row per model under a fixed threshold; ``stored`` rows are read in place."""
    rows = tagged(train, fold_role="fit").unionByName(tagged(later, fold_role="evaluation"))
    members = FoldRows(rows, lambda f: F.col("fold_role") == "fit", lambda f: F.col("fold_role") == "evaluation", stored)
    done = score_folds(members, profile, candidates, features, ids, "period", [1])
    return metrics.binary_metrics(done.predictions, profile, SCORE, threshold, ["model_name"])


def relative_ap_loss(results: DataFrame, baseline: str) -> DataFrame:
    """AP loss of every model relative to the baseline model's AP."""
    base = results.where(F.col("model_name") == baseline).agg(F.max("average_precision").alias("base_ap"))
    return results.crossJoin(F.broadcast(base)).withColumn(
        "ap_relative_loss", 1 - ratio(F.col("average_precision"), F.col("base_ap")))


def compare_recent_windows(df: DataFrame, profile: Profile, candidate: Candidate, features: list[str], ids: list[str],
                           windows: list[int], outer_splits: int = 3, threshold: float = 0.5) -> DataFrame:
    """Fit on the last days before each fold only; a window without both labels stays as a skipped row."""
    blocked = cut_lineage(time_blocks(df, profile, outer_splits))
    members = fold_membership(blocked, outer_splits).drop("block")
    ts = event_time(members, profile.timestamp, profile.timestamp_format)
    failed = F.col(profile.label) == F.lit(profile.positive)
    facts = []
    for days in windows:
        past = recent_rows(members, profile, days).select(members.columns)
        facts.append(tagged(past, window_days=days).groupBy("fold", "window_days").agg(
            F.count(F.lit(1)).alias("train_samples"), F.count_if(failed).alias("train_fail"),
            F.min(ts).alias("train_start"), F.max(ts).alias("train_end")))
    facts_all = cut_lineage(union_all(facts))
    usable = facts_all.where("train_fail > 0 and train_fail < train_samples").collect()  # folds times windows
    since = {r.fold * 100000 + r.window_days: r.train_start for r in usable}
    every = FoldRows(blocked, lambda u: (F.col("block") < u // 100000) & (ts >= F.lit(since[u])),
                     lambda u: F.col("block") == u // 100000, True)
    done = score_folds(every, profile, [candidate], features, ids, "unit", sorted(since))
    scored = metrics.binary_metrics(done.predictions, profile, SCORE, threshold, ["model_name", "unit"]).withColumns({
        "fold": F.floor(F.col("unit") / 100000).cast("int"), "window_days": (F.col("unit") % 100000).cast("int")})
    return facts_all.join(scored.drop("unit"), ["fold", "window_days"], "left").withColumns({
        "model_name": F.lit(candidate.name), "status": F.when(F.col("support").isNull(), "skipped").otherwise("evaluated"),
    }).withColumnRenamed("fold", "outer_fold")


def paired_ap_delta(results: DataFrame, first: str, second: str, fold: str = "outer_fold") -> DataFrame:
    """AP difference of two models on the same folds."""
    a = results.where(F.col("model_name") == first).select(fold, F.col("average_precision").alias("first_ap"))
    b = results.where(F.col("model_name") == second).select(fold, F.col("average_precision").alias("second_ap"))
    return a.join(b, fold).withColumn("ap_delta", F.col("second_ap") - F.col("first_ap"))
