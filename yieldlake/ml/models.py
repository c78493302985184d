"""Candidate classifiers, class weights, fits on fold rows and positive scores."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..profile import ContractError, Profile
from ..scale import cut_lineage, remove_path, scratch_path, scratch_scope, seeded_hash
from .preprocess import WRITTEN_OUT, FeaturePrep, FeaturePrepModel, PrepStatistics, bin_edges

# Leaf sizes and depth variants of the candidate families.
LEAF_VARIANTS = {"random_forest_leaf3": 3, "random_forest_leaf5": 5}
TOP_K_SIZES = (100, 50, 30, 20, 10)


@dataclass(frozen=True)
class Candidate:
    """One pipeline: preprocessing mode, optional selection and a final classifier."""

    name: str
    classifier: str = "logistic_regression_l1"
    weight_mode: str = "none"  # none, sqrt_ratio, ratio, balanced
    missing_mode: str = "median"  # median, median_indicator
    selector: str | None = None  # forest, gain, weighted_gain, l1, stable_forest, stable_gain, pca, fixed
    top_k: int | None = None
    fixed: tuple[str, ...] = ()
    trees: int = 20
    depth: int = 5
    selector_depth: int = 5
    selector_leaf: int = 1
    max_iter: int = 50
    repeats: int = 10
    pca_variance: float = 0.9
    seed: int = 42


def weight_grid(base: Candidate) -> list[Candidate]:
    """Depth 5 and depth 2 versions of a boosted candidate under three class-weight modes."""
    return [replace(base, name=f"{tag}_{mode}", depth=depth, weight_mode=mode)
            for tag, depth in (("M0", 5), ("M3", 2)) for mode in ("none", "sqrt_ratio", "ratio")]


def missing_mode_candidates(base: Candidate, modes=("median", "median_indicator")) -> list[Candidate]:
    unknown = set(modes) - {"median", "median_indicator"}
    if unknown or len(set(modes)) != len(modes):
        raise ContractError(f"unsupported or repeated missing modes: {modes}")
    return [replace(base, name=f"{mode}_{base.name}", missing_mode=mode) for mode in modes]


def top_k_candidates(base: Candidate, sizes=TOP_K_SIZES) -> list[Candidate]:
    return [replace(base, name=f"{base.name}_top_{k}", top_k=k) for k in sizes]


def build_classifier(c: Candidate, total_weight: float):
    """Unfitted classifier; an L1 penalty of strength 1 against the summed loss is 1 / total weight on the mean loss."""
    common = {"featuresCol": "features_vector", "labelCol": "__y", "weightCol": "__w"}
    if c.classifier in ("logistic_regression_l1", "logistic_regression"):
        if not c.classifier.endswith("l1"):
            return LogisticRegression(maxIter=c.max_iter, **common)
        return LogisticRegression(maxIter=c.max_iter, elasticNetParam=1.0, regParam=1.0 / total_weight, **common)
    if c.classifier == "random_forest" or c.classifier in LEAF_VARIANTS:
        return RandomForestClassifier(numTrees=c.trees, maxDepth=c.depth, seed=c.seed,
                                      minInstancesPerNode=LEAF_VARIANTS.get(c.classifier, 1), **common)
    if c.classifier == "boosted_trees":
        return GBTClassifier(maxIter=c.trees, maxDepth=c.depth, stepSize=0.1, seed=c.seed, **common)
    raise ContractError(f"unknown classifier: {c.classifier}")


def label_counts(df: DataFrame, profile: Profile) -> tuple[int, int]:
    """Rows of the positive and the negative label."""
    label = F.col(profile.label)
    n = df.agg(F.count_if(label == F.lit(profile.positive)).alias("p"),
               F.count_if(label == F.lit(profile.negative)).alias("n")).first()
    return n.p, n.n


def class_weight(df: DataFrame, profile: Profile, mode: str, known: PrepStatistics | None = None) -> dict[str, float]:
    """Weights of both labels from the counts of the current fit rows, which ``known`` may hold already."""
    p, n = (known and known.labels) or label_counts(df, profile)
    if not p or not n:
        raise ContractError("the fit rows need both labels")
    if mode == "balanced":
        total = p + n
        return {"positive": total / (2 * p), "negative": total / (2 * n), "rows": total, "total": float(total)}
    ratio = {"none": 1.0, "sqrt_ratio": (n / p) ** 0.5, "ratio": n / p}[mode]
    return {"positive": ratio, "negative": 1.0, "rows": p + n, "total": ratio * p + n}


def class_weight_table(df: DataFrame, profile: Profile, keys: list[str]) -> DataFrame:
    """``(keys, mode, positive_weight)`` of every weight mode, from one aggregation."""
    label = F.col(profile.label)
    counts = df.groupBy(*keys).agg(F.count_if(label == F.lit(profile.positive)).alias("p"),
                                   F.count_if(label == F.lit(profile.negative)).alias("n"))
    share = F.col("n") / F.col("p")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), w.cast("double").alias("positive_weight"))
                      for m, w in (("none", F.lit(1.0)), ("sqrt_ratio", F.sqrt(share)), ("ratio", share))])
    return counts.select(*keys, F.inline(modes))


def with_target(df: DataFrame, profile: Profile, weights: dict[str, float]) -> DataFrame:
    failed = F.col(profile.label) == F.lit(profile.positive)
    return df.withColumns({
        "__y": failed.cast("double"),
        "__w": F.when(failed, float(weights["positive"])).otherwise(float(weights["negative"]))})


@dataclass
class Fitted:
    """Fitted pipeline with what was removed, selected and weighted."""

    candidate: Candidate
    prep: FeaturePrepModel
    model: object
    weights: dict[str, float]
    selected: list[dict] = field(default_factory=list)
    stages: list = field(default_factory=list)

    def pipeline(self) -> PipelineModel:
        return PipelineModel(stages=[self.prep, *self.stages, self.model])

    def score(self, df: DataFrame, out: str = "positive_score") -> DataFrame:
        """Add the probability of the positive label; it is class 1 of the fit target by construction."""
        prepared = self.prep.transform(df)
        for stage in self.stages:
            prepared = stage.transform(prepared)
        scored = self.model.transform(prepared)
        return scored.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)

    def feature_count(self) -> int:
        return int(self.model.numFeatures)


def without_summary(model):
    """The model as saving and loading gives it, without the summary of its training.

    The summary refers to the session, and tasks that score receive the model with all it refers
    to: a session that was given a job tag or an observed metric can't be sent.
    """
    if not getattr(model, "hasSummary", False):
        return model
    spark = SparkSession.active()
    path = scratch_path(spark)
    model.write().save(path)
    stored = type(model).load(path)
    remove_path(spark, path)
    return stored


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    """Feature importance (trees) or absolute coefficient (linear), best first; ties keep input order."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    pairs = [(n, float(values[i])) for i, n in enumerate(names)]
    return sorted(pairs, key=lambda p: -abs(p[1]))


def boosting(c: Candidate) -> bool:
    """Whether a candidate fits boosted trees on its fit rows, as selector or as classifier."""
    return c.classifier == "boosted_trees" or c.selector in ("gain", "weighted_gain")


def counted_bins(df: DataFrame, profile: Profile, prep: FeaturePrepModel, count: Column | None = None) -> DataFrame:
    """``(__slots, label, __n)``: how many rows have the same prepared slots and label."""
    return df.groupBy(prep.values().alias("__slots"), F.col(profile.label)).agg(
        F.sum(F.lit(1).cast("bigint") if count is None else count).alias("__n"))


def boosting_rows(df: DataFrame, profile: Profile, prep: FeaturePrepModel, weights: dict[str, float],
                  known: PrepStatistics, count: Column | None = None) -> tuple[FeaturePrepModel, DataFrame]:
    """The preparation and the weighted rows that boosted trees are fitted on.

    Spark's trees see an input through 32 bins only, and rows with equal bins and label have the same gradient in
    every iteration: one row of their summed weight gives the same trees.  Their number is bounded by the bins.  Wide
    rows, of which few are equal, stay as they are.
    """
    if len(prep.get("features")) > WRITTEN_OUT or not prep.get("features"):
        rows = df if count is None else _repeated(df, count, [*prep.get("features"), *prep.get("categorical"), profile.label])
        return prep, prep.transform(with_target(rows, profile, weights))
    prep = prep.binned(known.edges or bin_edges(known, df, prep.get("features")))
    names, rows = known.binned or ([], None)
    if count is None and set(prep.slot_names()) <= set(names):
        mine = F.array(*[F.get("__slots", F.lit(names.index(n))) for n in prep.slot_names()])
        counted = rows.groupBy(mine.alias("__slots"), F.col(profile.label)).agg(F.sum("__n").alias("__n"))
    else:
        counted = counted_bins(df, profile, prep, count)
    weighted = with_target(cut_lineage(counted), profile, weights).withColumn("__w", F.col("__w") * F.col("__n"))
    return prep, weighted.withColumn(prep.get("outputCol"), array_to_vector("__slots"))


def _selector_model(c: Candidate, kind: str, prepared: DataFrame, total_weight: float):
    common = {"featuresCol": "features_vector", "labelCol": "__y", "weightCol": "__w"}
    if kind == "forest":
        return RandomForestClassifier(numTrees=c.trees, maxDepth=c.selector_depth, seed=c.seed,
                                      minInstancesPerNode=c.selector_leaf, **common).fit(prepared)
    if kind == "gain":
        return GBTClassifier(maxIter=c.trees, maxDepth=c.selector_depth, stepSize=0.1, seed=c.seed, **common).fit(prepared)
    return LogisticRegression(maxIter=c.max_iter, elasticNetParam=1.0, regParam=1.0 / total_weight, **common).fit(prepared)


def split_gains(model, names: list[str]) -> list[tuple[str, float]]:
    """Summed gain of each feature of a boosted model's splits, largest first; features without a split are left out.

    A node's gain is its fall in weighted squared error: Spark's gain per unit of weight times
    the weight of the node.  Nodes are read from the saved model, one row per feature comes back.
    """
    spark = SparkSession.active()
    path = scratch_path(spark)
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("nodeData.*").where("leftChild >= 0")
    found = nodes.groupBy(F.col("split.featureIndex").alias("i")).agg(
        F.sum(F.col("gain") * F.get("impurityStats", F.lit(0))).alias("gain")).collect()
    remove_path(spark, path)
    return [(names[r["i"]], float(r["gain"])) for r in sorted(found, key=lambda r: (-r["gain"], r["i"]))]


def weighted_gains(df: DataFrame, profile: Profile, c: Candidate, features: list[str],
                   known: PrepStatistics | None = None) -> list[tuple[str, float]]:
    """Split gains of a boosted model on these rows, with failures weighted by the class ratio of the same rows."""
    weights = class_weight(df, profile, "ratio", known)
    numeric = [f for f in features if f not in profile.categorical]
    known = known or prep_statistics(df, profile, numeric)
    prep = FeaturePrep(features=numeric, missingThreshold=profile.missing_threshold, dropConstant=profile.drop_constant).build(known)
    _, rows = boosting_rows(df, profile, prep, weights, known)
    model = _selector_model(c, "gain", rows, weights["total"])
    return split_gains(model, prep.slot_names())


def averaged_gains(runs: list[list[tuple[str, float]]], features: list[str]) -> list[tuple[str, float]]:
    """Mean share of a run's whole gain per feature, largest first; a feature without a split counts as 0.

    Shares, not sums: the folds of a time split hold different numbers of rows.
    """
    totals = [sum(v for _, v in run) for run in runs]
    means = {f: sum(dict(run).get(f, 0.0) / t for run, t in zip(runs, totals) if t > 0) / len(runs) for f in features}
    return sorted(means.items(), key=lambda x: (-x[1], features.index(x[0])))


def _class_ranks(df: DataFrame, label: str, ids: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``__rank``, a row's place within its class in a seeded hash order, and the class sizes.

    A rank is found from counts per hash prefix and the order within a prefix; rows without a label are left out.
    """
    hashed = df.where(F.col(label).isNotNull()).withColumn("__h", seeded_hash(ids, seed)).withColumn("__p", F.substring("__h", 1, 4))
    prefixes = hashed.groupBy(label, "__p").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(label).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # At most 65,536 rows a class.
    offsets = cut_lineage(prefixes.select(label, "__p", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__before"), "__n"))
    within = Window.partitionBy(label, "__p").orderBy("__h", *ids)
    ranked = hashed.join(F.broadcast(offsets.drop("__n")), [label, "__p"]).withColumn(
        "__rank", F.col("__before") + F.row_number().over(within) - 1)
    return ranked.select(*df.columns, "__rank"), offsets.groupBy(label).agg(F.sum("__n").alias("__size"))


def bootstrap_counts(df: DataFrame, label: str, ids: list[str], repeats: list[int], seed: int) -> DataFrame:
    """``df`` with ``copies``, an array: how often each of the ``repeats`` draws a row when every class draws its own size with replacement.

    Each of a class's draws hashes to one rank; the draws of all repeats are counted per rank
    before they meet the rows, once.  Rows that no repeat drew and rows without a label are
    left out; ``ids`` must identify a row.
    """
    ranked, sizes = _class_ranks(df, label, ids, seed)
    most = sizes.agg(F.max("__size").alias("n")).first().n or 0
    draws = df.sparkSession.range(most).crossJoin(F.broadcast(sizes)).where("id < __size").withColumn(  # one row a class
        "__repeat", F.explode(F.array(*map(F.lit, repeats))))
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__repeat").cast("string"), F.col(label).cast("string"), F.col("id").cast("string")))
    picked = draws.select(
        label, "__repeat", F.pmod(F.conv(F.substring(place, 1, 15), 16, 10).cast("bigint"), F.col("__size")).alias("__rank")).repartition(label, "__rank").groupBy(
        label, "__rank").agg(F.array(*[F.count_if(F.col("__repeat") == r) for r in repeats]).alias("copies"))
    return ranked.join(picked, [label, "__rank"]).select(*df.columns, "copies")


def bootstrap_copies(df: DataFrame, label: str, ids: list[str], repeat: int, seed: int) -> DataFrame:
    """``df`` with ``copies``: how often one repeat of ``bootstrap_counts`` draws each row."""
    return bootstrap_counts(df, label, ids, [repeat], seed).withColumn("copies", F.get("copies", F.lit(0)))


def _repeated(drawn: DataFrame, copies: Column, columns: list[str]) -> DataFrame:
    """Every row as often as ``copies`` says."""
    return drawn.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).select(*columns)


def stratified_bootstrap(df: DataFrame, label: str, ids: list[str], repeat: int, seed: int) -> DataFrame:
    """Bootstrap rows: ``df`` with each row as often as ``bootstrap_copies`` draws it; every class keeps its size."""
    return _repeated(bootstrap_copies(df, label, ids, repeat, seed), F.col("copies"), df.columns)


def stable_selection(df: DataFrame, profile: Profile, c: Candidate, features: list[str], ids: list[str]) -> list[dict]:
    """Selection frequency and mean rank over bootstraps; a sensor removed in a bootstrap ranks last plus one.

    The rows are written once with their copies in every bootstrap; each bootstrap reads them from there.
    """
    kind = "forest" if c.selector == "stable_forest" else "gain"
    last = len(features) + 1
    # Every class keeps its size, so all bootstraps have the class weights of the rows themselves.
    weights = class_weight(df, profile, c.weight_mode)
    columns = list(dict.fromkeys([*features, profile.label]))

    def one(drawn: DataFrame, repeat: int) -> dict[str, tuple[int, float]]:
        copies = F.get("copies", F.lit(repeat))
        sample = _repeated(drawn, copies, columns)
        prep = FeaturePrep(features=features, missingThreshold=profile.missing_threshold,
                           dropConstant=profile.drop_constant)
        known = prep.statistics(sample, stored=True)
        prep = prep.build(known)
        if kind == "gain":
            known = replace(known, edges=bin_edges(known, sample, prep.get("features")))
            _, rows = boosting_rows(drawn.where(copies > 0), profile, prep, weights, known, copies)
        else:
            rows = prep.transform(with_target(sample, profile, weights))
        model = _selector_model(replace(c, seed=c.seed + repeat), kind, rows, weights["total"])
        return {n: (i, v) for i, (n, v) in enumerate(importances(model, prep.get("features")), 1)}

    with scratch_scope(df.sparkSession):
        counted = bootstrap_counts(df.select(*dict.fromkeys([*ids, *columns])), profile.label, ids, list(range(c.repeats)), c.seed)
        drawn = cut_lineage(counted.select(*columns, "copies"))
        runs = run_all([lambda r=r: one(drawn, r) for r in range(c.repeats)])
    order = {f: i for i, f in enumerate(features)}
    table = []
    for f in features:
        ranks = [run.get(f, (last, 0.0)) for run in runs]
        table.append({
            "feature": f, "bootstrap_selection_frequency": sum(r[0] <= c.top_k for r in ranks) / c.repeats,
            "bootstrap_mean_rank": sum(r[0] for r in ranks) / c.repeats,
            "selection_importance": sum(r[1] for r in ranks) / c.repeats, "bootstrap_repeats": c.repeats})
    table.sort(key=lambda t: (-t["bootstrap_selection_frequency"], t["bootstrap_mean_rank"], order[t["feature"]]))
    return [{**t, "selection_rank": i, "feature_space": "raw_sensor"} for i, t in enumerate(table[:c.top_k], 1)]


def prep_statistics(df: DataFrame, profile: Profile, features: list[str], stored: bool = False,
                    candidates: Sequence[Candidate] = ()) -> PrepStatistics:
    """Statistics of fit rows that the preprocessing and the class weights of all candidates share.

    Where several of the ``candidates`` boost trees, these share the counted bins, too.
    """
    found = FeaturePrep(features=[f for f in features if f not in profile.categorical],
                        categorical=[f for f in features if f in profile.categorical]).statistics(df, stored)
    found = replace(found, labels=label_counts(df, profile))
    numeric = [f for f in features if f not in profile.categorical]
    if not any(map(boosting, candidates)) or len(numeric) > WRITTEN_OUT:
        return found
    prep = FeaturePrep(features=numeric, missingThreshold=profile.missing_threshold, dropConstant=profile.drop_constant).build(found)
    edges = bin_edges(found, df, numeric)
    return replace(found, edges=edges, binned=(
        prep.slot_names(), cut_lineage(counted_bins(df, profile, prep.binned(edges)))))


def fit(df: DataFrame, profile: Profile, c: Candidate, features: list[str], ids: list[str] | None = None,
        known: PrepStatistics | None = None, stored: bool = False) -> Fitted:
    """Fit every stage on these rows only; ``known`` are their statistics where they were made before, ``stored`` rows are read in place."""
    known = known or prep_statistics(df, profile, features, stored)
    weights = class_weight(df, profile, c.weight_mode, known)
    linear = c.classifier.startswith("logistic") or c.selector == "pca"
    numeric = [f for f in features if f not in profile.categorical]
    prep = FeaturePrep(
        features=numeric, missingThreshold=profile.missing_threshold, dropConstant=profile.drop_constant, scale=linear,
        indicators=c.missing_mode == "median_indicator",
        categorical=[f for f in features if f in profile.categorical]).build(known)
    target = with_target(df, profile, weights)
    selected: list[dict] = []
    stages: list = []
    if c.selector in ("forest", "gain", "l1"):
        names = prep.slot_names()
        if c.top_k is not None and c.top_k > len(names):
            raise ContractError(f"Top-K of {c.top_k} exceeds {len(names)} features")
        rows = boosting_rows(df, profile, prep, weights, known)[1] if c.selector == "gain" else prep.transform(target)
        ranked = importances(_selector_model(c, c.selector, rows, weights["total"]), names)
        chosen = [p for p in ranked if p[1] != 0.0] if c.selector == "l1" else ranked[:c.top_k]
        selected = [{"feature": n, "selection_rank": i, "selection_importance": v,
                     "feature_space": "raw_sensor" if n in numeric else "transformed_feature"}
                    for i, (n, v) in enumerate(chosen, 1)]
        slots = sorted(names.index(s["feature"]) for s in selected)
        if not slots:
            raise ContractError("the selector keeps no feature")
        if len(names) == len(prep.get("features")):
            prep = prep.keep([names[i] for i in slots])
        else:
            prep._set(outputCol="all_features_vector")
            stages.append(VectorSlicer(inputCol="all_features_vector", outputCol="features_vector", indices=slots))
    elif c.selector == "weighted_gain":
        ranked = weighted_gains(df, profile, c, numeric, known)[:c.top_k]
        selected = [{"feature": n, "selection_rank": i, "selection_importance": v, "feature_space": "raw_sensor"}
                    for i, (n, v) in enumerate(ranked, 1)]
        if not selected:
            raise ContractError("the selector keeps no feature")
        prep = prep.keep([f for f in prep.get("features") if f in {n for n, _ in ranked}])
    elif c.selector in ("stable_forest", "stable_gain"):
        selected = stable_selection(df, profile, c, numeric, ids or [])
        prep = prep.keep([f for f in prep.get("features") if f in {s["feature"] for s in selected}])
    elif c.selector == "fixed":
        fixed = FeaturePrep(features=list(c.fixed), missingThreshold=1.0, dropConstant=False, scale=linear)
        prep = fixed.build(known) if set(c.fixed) <= set(known.medians) else fixed.fit(df)
        selected = [{"feature": n, "selection_rank": i, "selection_importance": None, "feature_space": "raw_sensor"}
                    for i, n in enumerate(c.fixed, 1)]
    elif c.selector == "pca":
        prep._set(outputCol="all_features_vector")
        model, k = pca_to_variance(prep.transform(df), len(prep.slot_names()), c.pca_variance)
        stages = [model, VectorSlicer(inputCol="components", outputCol="features_vector", indices=list(range(k)))]
    if c.classifier == "boosted_trees" and not stages:
        prep, prepared = boosting_rows(df, profile, prep, weights, known)
    else:
        prepared = prep.transform(target)
    for stage in stages:
        prepared = stage.transform(prepared)
    return Fitted(c, prep, without_summary(build_classifier(c, weights["total"]).fit(prepared)), weights, selected, stages)


def pca_to_variance(prepared: DataFrame, width: int, share: float, column: str = "all_features_vector"):
    """PCA model with all components and the number that reaches ``share`` of the variance."""
    model = PCA(k=width, inputCol=column, outputCol="components").fit(prepared)
    total, k = 0.0, width
    for i, v in enumerate(model.explainedVariance.toArray(), 1):
        total += float(v)
        if total >= share - 1e-12:
            k = i
            break
    return model, k


def run_all(jobs: list, workers: int = 4) -> list:
    """Run independent fits concurrently so that the cluster is not idle between small jobs."""
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda job: job(), jobs))
