"""Class and period distributions, ECDF points, histograms and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, known, ratio
from ..profile import ContractError, Profile
from ..columns import column_moments, column_quantiles, exact_quantiles
from ..scale import cut_lineage, join_on, lookup_join, running_sum

WHOLE = "all"


def class_period_distribution(df: DataFrame, profile: Profile, features: list[str],
                              block: str = "block") -> DataFrame:
    """Per (period, class, feature) rows, observed, missing ratio, median, p10, p90, plus period ``all``.

    Statistics of a block and class merge into those of the whole by grouping sets; no row
    is repeated.  An infinite value is an error.
    """
    stored = cut_lineage(df.select(F.col(block).cast("string").alias("period"), F.col(profile.label).alias("class"), *features))
    kept = stored.where(F.col("class").isin(profile.negative, profile.positive))
    found = cut_lineage(column_moments(kept, features, ["period", "class"]))
    infinite = F.lit(float("inf"))
    if not found.where((F.col("minimum") == -infinite) | (F.col("maximum") == infinite)).isEmpty():
        raise ContractError("infinite sensor values")
    keys = ["period", "class", "feature"]
    stats = found.groupingSets([keys, keys[1:]], *keys).agg(
        F.grouping("period").alias("__whole"), F.sum("row_count").alias("row_count"), F.sum("seen_count").alias("observed_count"))
    stats = stats.withColumn("period", F.when(F.col("__whole") == 1, WHOLE).otherwise(F.col("period"))).drop("__whole")
    whole = column_quantiles(kept, features, [0.1, 0.5, 0.9], ["class"], "q", stored=True).withColumn("period", F.lit(WHOLE))
    q = column_quantiles(kept, features, [0.1, 0.5, 0.9], ["period", "class"], "q", stored=True).unionByName(whole)
    names = stored.select("period").distinct().unionByName(df.sparkSession.range(1).select(F.lit(WHOLE).alias("period"))).distinct()
    grid = names.select(
        "period", F.explode(F.array(F.lit(profile.negative), F.lit(profile.positive))).alias("class")).select(
        "period", "class", F.explode(F.array(*map(F.lit, features))).alias("feature"))
    return grid.join(stats, keys, "left").join(q, keys, "left").select(
        *keys, F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("observed_count", F.lit(0)).alias("observed_count"),
        ratio(F.col("row_count") - F.col("observed_count"), F.col("row_count")).alias("missing_ratio"),
        F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("p10"), F.get("q", F.lit(2)).alias("p90"))


def ecdf(df: DataFrame, value: str, keys: list[str], rows: int | None = None) -> DataFrame:
    """Distinct values with their cumulative share per key; ties appear once, at their top."""
    seen = df.where(known(F.col(value).cast("double")).isNotNull())
    counts = seen.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = join_on(running_sum(counts, [F.col(value)], ["n"], keys, rows), totals, keys)
    return ranked.select(*keys, value, F.col("cum_n").alias("upto"),
                         ratio(F.col("cum_n"), F.col("total")).alias("share"))


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None,
              keys: list[str] | None = None) -> DataFrame:
    """Rows per equal-width bin between the bounds (the observed range when not given); the last bin is closed."""
    keys = list(keys or [])
    v = F.col(value).cast("double")
    if low is None or high is None:
        span = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        if span.lo is None:
            return df.select(*keys, F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"),
                             F.lit(0).cast("bigint").alias("rows")).limit(0)
        low, high = (span.lo, span.hi) if span.hi > span.lo else (span.lo - 0.5, span.hi + 0.5)
    width = (high - low) / bins
    slot = F.least(F.floor((v - low) / F.lit(width)), F.lit(bins - 1)).cast("int")
    inside = df.where((v >= low) & (v <= high))
    return inside.groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("rows")).select(
        *keys, "bin", (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "rows")


def box_statistics(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Quartiles and 1.5-IQR whisker ends per key, as a box plot without outliers shows them."""
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], "q")
    q = q.select(*keys, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    iqr = F.col("q3") - F.col("q1")
    joined = join_on(df, q.withColumn("lo", F.col("q1") - 1.5 * iqr).withColumn("hi", F.col("q3") + 1.5 * iqr), keys)
    v = F.col(value)
    return joined.groupBy(*keys).agg(
        F.count(v).alias("observed"), F.max("q1").alias("q1"), F.max("median").alias("median"),
        F.max("q3").alias("q3"), F.min(F.when(v >= F.col("lo"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("hi"), v)).alias("whisker_high"))


def display_sample(df: DataFrame, ids: list[str], size: int = 5000, seed: int = 42) -> DataFrame:
    """Reproducible sample of at most ``size`` rows: the smallest seeded hashes."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))
    return df.withColumn("__h", order).orderBy("__h", *ids).limit(size).drop("__h")


def correlations(df: DataFrame, columns: list[str], keys: list[str] | None = None,
                 rows: int | None = None) -> DataFrame:
    """Pearson and Spearman for every pair of columns over complete finite rows.

    Spearman is Pearson over average ranks.  Rows are first combined per distinct
    value tuple with a weight, so ties of any size cost one row.  Fewer than three rows
    or a constant column give null.
    """
    keys = list(keys or [])
    clean = df.select(*keys, *[(finite(F.col(c).cast("double")) + F.lit(0.0)).alias(c) for c in columns]).dropna(subset=columns)
    # Written once: ranks, joins and means all read it.
    tuples = cut_lineage(clean.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("w")))
    long = tuples.select(*keys, "w", F.posexplode(F.array(*columns)).alias("pos", "v"))
    per_value = long.groupBy(*keys, "pos", "v").agg(F.sum("w").alias("n"))
    ranked = cut_lineage(running_sum(per_value, [F.col("v")], ["n"], [*keys, "pos"], rows).select(
        *keys, "pos", "v", "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank")))
    def value_key(column: str):
        return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("k"), F.col(k).cast("string")), F.lit("n")) for k in keys],
                           (F.col(column) + F.lit(0.0)).cast("string"))

    wide = tuples
    for i, c in enumerate(columns):
        # A value may be as frequent as the whole group, so its rank is looked up, not joined on a hot key.
        mine = ranked.where(F.col("pos") == i).select(value_key("v").alias("__value"), F.col("rank").alias(f"__r{i}"), F.col("n").alias("__n"))
        wide = lookup_join(wide.withColumn("__value", value_key(c)), mine, "__value", "__n").drop("__value", "__n")
    pairs = list(combinations(range(len(columns)), 2))
    # Centring on the group means keeps the second moments accurate for large ranks; the ranked values give the
    # means, so that the looked up rows are read by one pass only.
    wide = join_on(wide, _means(ranked, columns, keys), keys)
    aggs = [F.sum("w").alias("rows"), *[(F.min(c) == F.max(c)).alias(f"__same{i}") for i, c in enumerate(columns)]]
    for i, j in pairs:
        for method, a, b in (("p", f"__c{i}", f"__c{j}"), ("s", f"__d{i}", f"__d{j}")):
            aggs.append(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"{method}_{i}_{j}"))
    for i in range(len(columns)):
        aggs.append(F.sum(F.col("w") * F.col(f"__c{i}") * F.col(f"__c{i}")).alias(f"p_{i}"))
        aggs.append(F.sum(F.col("w") * F.col(f"__d{i}") * F.col(f"__d{i}")).alias(f"s_{i}"))
    centred = wide
    for i, c in enumerate(columns):
        centred = centred.withColumn(f"__c{i}", F.col(c) - F.col(f"__m{i}")).withColumn(
            f"__d{i}", F.col(f"__r{i}") - F.col(f"__n{i}"))
    sums = centred.groupBy(*keys).agg(*aggs)
    cells = []
    for method, name in (("p", "pearson"), ("s", "spearman")):
        for i, j in pairs:
            scale = F.sqrt(F.col(f"{method}_{i}")) * F.sqrt(F.col(f"{method}_{j}"))
            # A centred constant need not sum to zero exactly, so constants are found by their range.
            varied = (F.col("rows") >= 3) & ~F.col(f"__same{i}") & ~F.col(f"__same{j}")
            value = F.when(varied, ratio(F.col(f"{method}_{i}_{j}"), scale))
            cells.append(F.struct(F.lit(name).alias("method"), F.lit(columns[i]).alias("first"),
                                  F.lit(columns[j]).alias("second"), value.alias("correlation")))
    return sums.select(*keys, "rows", F.inline(F.array(*cells)))


def _means(ranked: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Means of values and ranks per key, from how often each value of a column occurs."""
    def mean(value: str, i: int):
        mine = F.col("pos") == i
        return F.sum(F.when(mine, F.col("n") * F.col(value))) / F.sum(F.when(mine, F.col("n")))

    return ranked.groupBy(*keys).agg(*[
        m for i in range(len(columns)) for m in (mean("v", i).alias(f"__m{i}"), mean("rank", i).alias(f"__n{i}"))])
