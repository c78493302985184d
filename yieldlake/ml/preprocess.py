"""Preprocessing fitted on Train rows only and applied as one array expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..columns import column_moments, column_quantiles
from ..functions.scalars import known as known_number, ratio, to_long_text
from ..profile import ContractError
from ..scale import cut_lineage

WRITTEN_OUT = 32  # inputs whose preparation is one expression each
BINS = 32  # bins of a binned input, as many as Spark's trees use
EDGE_STEPS = 256  # quantiles from which the edges of the bins are taken
MAX_LEVELS = 10_000  # slots that all categorical features together may add to the vector


def _one_hot(levels: Column, value: Column) -> Column:
    return F.transform(levels, lambda level: (level == value).cast("double"))


def _bin(x: Column, edges: list[float], first: int = 0) -> Column:
    """Number of edges below ``x``, found by halving."""
    if not edges:
        return F.lit(float(first))
    half = len(edges) // 2
    return F.when(x > F.lit(edges[half]), _bin(x, edges[half + 1:], first + half + 1)).otherwise(_bin(x, edges[:half], first))


def bin_edges(known: PrepStatistics, rows: DataFrame, names: Sequence[str]) -> dict[str, list[float]]:
    """At most 31 edges per input of the imputed ``rows``: midpoints of up to 32 values, otherwise quantiles.

    Of an input that is imputed, the median has a bin of its own up to 1/256 of the rows.
    The quantiles are those of ``approxQuantile`` with a rank error of 1/2000.
    """
    edges: dict[str, list[float]] = {f: [] for f in names}
    names = [f for f in names if known.columns[f].seen]
    found = dict(zip(names, rows.select(*[F.col(f).cast("double").alias(f) for f in names]).approxQuantile(
        names, [i / EDGE_STEPS for i in range(EDGE_STEPS + 1)], 0.0005)))
    for f in names:
        median, imputed = known.medians[f], known.columns[f].seen < known.columns[f].n
        points = set(found[f])
        if len(points) <= BINS:
            x = known_number(F.col(f).cast("double"))
            few = rows.select(x.alias("x")).where("x is not null").distinct().limit(BINS + 1)  # at most 33 rows
            points = {r.x for r in few.collect()} | ({median} if imputed else set())
        if len(points) <= BINS:
            ordered = sorted(points)
            edges[f] = [(a + b) / 2 for a, b in zip(ordered, ordered[1:])]
            continue
        step = EDGE_STEPS // BINS
        cuts = found[f][step:-1:step]
        if imputed:
            lower = [v for v in found[f] if v < median]
            cuts[BINS // 2 - 1] = median
            cuts[BINS // 2 - 2] = lower[-1] if lower else cuts[BINS // 2 - 2]
        edges[f] = sorted(set(cuts))
    return edges


class _PrepParams(HasOutputCol):
    features = Param(Params._dummy(), "features", "numeric inputs in model order", TypeConverters.toListString)
    missingThreshold = Param(Params._dummy(), "missingThreshold", "removal above this share", TypeConverters.toFloat)
    dropConstant = Param(Params._dummy(), "dropConstant", "remove constant inputs", TypeConverters.toBoolean)
    scale = Param(Params._dummy(), "scale", "standardise with population sigma", TypeConverters.toBoolean)
    indicators = Param(Params._dummy(), "indicators", "append flags of missing inputs", TypeConverters.toBoolean)
    categorical = Param(Params._dummy(), "categorical", "text inputs to encode", TypeConverters.toListString)


@dataclass(frozen=True)
class PrepStatistics:
    """Column statistics, medians and categories of the rows of one fit."""

    columns: dict[str, Row]
    medians: dict[str, float]
    modes: list[str]
    levels: list[str]
    labels: tuple[int, int] | None = None  # rows of the positive and the negative label
    edges: dict[str, list[float]] | None = None  # of the bins, where boosted trees need them
    binned: tuple[list[str], DataFrame] | None = None  # inputs and counted rows of these bins


class FeaturePrep(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    """Quality filter, exact-median imputation, optional scaling, missing flags and one-hot encoding.

    The inputs are written once, unless they are stored; statistics and exact medians come from
    their batches whatever the number of sensors, and one row per sensor reaches the driver.
    """

    @keyword_only
    def __init__(self, *, features=None, missingThreshold=0.5, dropConstant=True, scale=False, indicators=False,
                 categorical=None, outputCol="features_vector"):
        super().__init__()
        self._setDefault(missingThreshold=0.5, dropConstant=True, scale=False, indicators=False, categorical=[],
                         outputCol="features_vector")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def statistics(self, dataset: DataFrame, stored: bool = False) -> PrepStatistics:
        """What fitting needs to know of the rows; it serves every scaling and missing mode.

        Rows that are ``stored`` already are read from where they are.
        """
        names = self.getOrDefault("features")
        rows = dataset.select(*names) if stored else cut_lineage(dataset.select(*names))
        columns = {r.feature: r for r in column_moments(rows, names).select(
            "feature", F.col("row_count").alias("n"), F.col("seen_count").alias("seen"), "mean",
            ratio(F.col("m2"), F.col("value_count")).alias("var"), F.col("minimum").alias("low"),
            F.col("maximum").alias("high")).collect()}
        if not columns:
            raise ContractError("no rows to fit on")
        medians = {r.feature: (r.q[0] if r.q else 0.0) for r in column_quantiles(
            rows, names, [0.5], name="q", stored=True).collect()}
        return PrepStatistics(columns, medians, *self._fit_categories(dataset))

    def _fit(self, dataset: DataFrame) -> FeaturePrepModel:
        return self.build(self.statistics(dataset))

    def build(self, known: PrepStatistics) -> FeaturePrepModel:
        """The model that fitting the rows of ``known`` gives."""
        names, stats, medians = self.getOrDefault("features"), known.columns, known.medians
        threshold, drop = self.getOrDefault("missingThreshold"), self.getOrDefault("dropConstant")
        high = [f for f in names if (stats[f].n - stats[f].seen) / stats[f].n > threshold]
        constant = [f for f in names if f not in high and drop and (stats[f].seen == 0 or stats[f].low == stats[f].high)]
        kept = [f for f in names if f not in high and f not in constant]
        if not kept:
            raise ContractError("the quality filter leaves no feature")
        centres, spreads = [], []
        for f in kept:
            s, m = stats[f], medians[f]
            gone = s.n - s.seen
            seen_mean = s.mean if s.seen else 0.0
            centre = (seen_mean * s.seen + m * gone) / s.n
            total = s.seen * ((s.var or 0.0) + (seen_mean - centre) ** 2) + gone * (m - centre) ** 2
            spread = (total / s.n) ** 0.5
            centres.append(float(centre))
            spreads.append(float(spread) if spread > 0 else 1.0)
        use_scale = self.getOrDefault("scale")
        flagged = [f for f in kept if stats[f].seen < stats[f].n] if self.getOrDefault("indicators") else []
        modes, levels = (known.modes, known.levels) if self.getOrDefault("categorical") else ([], [])
        model = FeaturePrepModel()
        model._set(
            features=kept, medians=[float(medians[f]) for f in kept],
            means=centres if use_scale else [0.0] * len(kept), scales=spreads if use_scale else [1.0] * len(kept),
            flags=flagged, removedMissing=high, removedConstant=constant,
            categorical=list(self.getOrDefault("categorical")), modes=modes, levels=levels,
            outputCol=self.getOrDefault("outputCol"))
        return model

    def _fit_categories(self, dataset: DataFrame) -> tuple[list[str], list[str]]:
        columns = list(self.getOrDefault("categorical"))
        if not columns:
            return [], []
        counts = to_long_text(dataset, columns).where("value is not null").groupBy("feature", "value").agg(
            F.count(F.lit(1)).alias("n"))
        modes = {r.feature: r.mode for r in counts.groupBy("feature").agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect()}
        # One entry per category is one slot of the encoded vector, which has a declared width.
        found = sorted((r.feature, r.value) for r in counts.select("feature", "value").limit(MAX_LEVELS + 1).collect())
        if len(found) > MAX_LEVELS:
            raise ContractError(f"the categorical features {columns} have more than {MAX_LEVELS} levels")
        return [modes.get(c, "") for c in columns], [f"{f}={v}" for c in columns for f, v in found if f == c]


class FeaturePrepModel(Model, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted preprocessing; later data never change its lists or statistics."""

    features = Param(Params._dummy(), "features", "kept inputs", TypeConverters.toListString)
    medians = Param(Params._dummy(), "medians", "fit medians", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "centres", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "scales", TypeConverters.toListFloat)
    flags = Param(Params._dummy(), "flags", "inputs with a missing flag", TypeConverters.toListString)
    removedMissing = Param(Params._dummy(), "removedMissing", "high-missing inputs", TypeConverters.toListString)
    removedConstant = Param(Params._dummy(), "removedConstant", "constant inputs", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "encoded text inputs", TypeConverters.toListString)
    modes = Param(Params._dummy(), "modes", "most frequent category", TypeConverters.toListString)
    levels = Param(Params._dummy(), "levels", "column=category of each slot", TypeConverters.toListString)
    edges = Param(Params._dummy(), "edges", "edges of the bins of all kept inputs", TypeConverters.toListFloat)
    edgeCounts = Param(Params._dummy(), "edgeCounts", "edges of each kept input; none: no bins", TypeConverters.toListInt)

    def __init__(self):
        super().__init__()
        self._setDefault(outputCol="features_vector", flags=[], removedMissing=[], removedConstant=[],
                         categorical=[], modes=[], levels=[], edges=[], edgeCounts=[])

    def get(self, name: str):
        return self.getOrDefault(name)

    def slot_names(self) -> list[str]:
        return [*self.get("features"), *[f"{f}__missing" for f in self.get("flags")], *self.get("levels")]

    def keep(self, names: Sequence[str]) -> FeaturePrepModel:
        """Same statistics for a subset of the numeric inputs, in the given order."""
        place = {f: i for i, f in enumerate(self.get("features"))}
        chosen = [n for n in names if n in place]
        model = FeaturePrepModel()
        model._set(features=chosen, flags=[f for f in self.get("flags") if f in chosen],
                   removedMissing=self.get("removedMissing"), removedConstant=self.get("removedConstant"),
                   outputCol=self.get("outputCol"),
                   **{k: [self.get(k)[place[n]] for n in chosen] for k in ("medians", "means", "scales")})
        return model

    def binned(self, edges: dict[str, list[float]]) -> FeaturePrepModel:
        """Same inputs as numbers of their bins; flags and categories stay as they are."""
        model = self.copy()
        model._set(edges=[float(e) for f in self.get("features") for e in edges[f]],
                   edgeCounts=[len(edges[f]) for f in self.get("features")])
        return model

    def _bins(self) -> list[Column]:
        out, start = [], 0
        for f, median, size in zip(self.get("features"), self.get("medians"), self.get("edgeCounts")):
            x = F.coalesce(known_number(F.col(f).cast("double")), F.lit(float(median)))
            out.append(_bin(x, self.get("edges")[start:start + size]))
            start += size
        return out

    def values(self):
        """Array of prepared values.

        Many inputs are zipped with the fitted arrays, so the expression does not grow per
        statistic; few are written out, which Spark compiles.  Both give the same numbers.
        """
        def numbers(name: str):
            return F.array(*[F.lit(float(v)) for v in self.get(name)])

        raw = [known_number(F.col(f).cast("double")) for f in self.get("features")]
        if self.get("edgeCounts"):
            out = F.array(*self._bins())
        elif len(raw) <= WRITTEN_OUT:
            fitted = zip(raw, self.get("medians"), self.get("means"), self.get("scales"))
            out = F.array(*[(F.coalesce(x, F.lit(float(m))) - F.lit(float(c))) / F.lit(float(s)) for x, m, c, s in fitted])
        else:
            filled = F.zip_with(F.array(*raw), numbers("medians"), lambda x, m: F.coalesce(x, m))
            out = F.zip_with(F.zip_with(filled, numbers("means"), lambda x, m: x - m), numbers("scales"), lambda x, s: x / s)
        if self.get("flags"):
            flags = [known_number(F.col(f).cast("double")).isNull().cast("double") for f in self.get("flags")]
            out = F.concat(out, F.array(*flags))
        for column, mode in zip(self.get("categorical"), self.get("modes")):
            mine = F.array(*[F.lit(s.split("=", 1)[1]) for s in self.get("levels") if s.split("=", 1)[0] == column])
            seen = F.coalesce(F.col(column).cast("string"), F.lit(mode))
            out = F.concat(out, _one_hot(mine, seen))
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        missing = [f for f in self.get("features") if f not in dataset.columns]
        if missing:
            raise ContractError(f"fitted features missing from the input: {missing}")
        return dataset.withColumn(self.get("outputCol"), array_to_vector(self.values()))
