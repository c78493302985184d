"""Profiling of a sensor table: rows, labels, times, missing and constant features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..columns import column_moments, column_values
from ..functions.scalars import event_time, nan_to_null, ratio
from ..profile import ContractError, Profile, validate_frame
from ..scale import cut_lineage

SUMMARY_RULE_REMAINING = "feature_count - high_missing_candidates - constant_candidates"


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier full row: all rows minus distinct rows."""
    groups = nan_to_null(df).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_row_count"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per label value."""
    counts = df.groupBy(F.col(label).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        "class", "count", ratio(F.col("count"), F.col("total")).alias("ratio"))


def timestamp_profile(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """One row: missing, unparsable, duplicate and distinct times, first and last."""
    parsed = event_time(df, column, fmt)
    times = df.select(F.col(column).alias("raw"), parsed.alias("ts"))
    per_time = times.groupBy("ts").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw").isNull()).alias("missing"))
    seen = F.col("ts").isNotNull()
    return per_time.agg(
        F.sum("missing").alias("missing_count"),
        F.coalesce(F.sum(F.when(~seen, F.col("n") - F.col("missing"))), F.lit(0)).alias("parse_failure_count"),
        F.coalesce(F.sum(F.when(seen, F.col("n") - 1)), F.lit(0)).alias("duplicate_count"),
        F.count_if(seen).alias("unique_count"),
        F.min("ts").alias("minimum"),
        F.max("ts").alias("maximum"),
    )


def rows_per_day(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    day = F.date_trunc("day", event_time(df, column, fmt)).cast("timestamp_ntz")
    return df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("rows"))


def missing_by_feature(df: DataFrame, features: list[str]) -> DataFrame:
    return column_moments(df, features).select(
        "feature", "row_count", (F.col("row_count") - F.col("seen_count")).alias("missing_count"),
    ).withColumn("missing_ratio", ratio(F.col("missing_count"), F.col("row_count")))


def missing_summary(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Missing count and rate of every column of any type, most missing first."""
    flags = F.array(*[F.isnull(c).cast("int") for c in df.columns])
    names = F.array(*map(F.lit, df.columns))
    out = (
        nan_to_null(df).select(F.posexplode(flags).alias("pos", "gone"))
        .groupBy("pos").agg(F.sum("gone").alias("missing_count"), F.avg("gone").alias("missing_rate"))
        .select(F.element_at(names, F.col("pos") + 1).alias("column"), "missing_count", "missing_rate")
        .orderBy(F.desc("missing_rate"), "column")
    )
    return out if limit is None else out.limit(limit)


def feature_profile(df: DataFrame, profile: Profile, exact_unique: bool = True) -> DataFrame:
    """Missing ratio, distinct known values and the removal decision per feature.

    A feature is removed for missing values only above the threshold; the constant
    check looks only at features that pass it.
    """
    features = profile.features(df.columns)
    numeric = [f for f in features if f not in profile.categorical]
    text = [f for f in features if f in profile.categorical]
    if exact_unique or text:
        stats = _value_statistics(column_values(df, numeric if exact_unique else [], text))
    if not exact_unique:
        ends = column_moments(df, numeric).select(
            "feature", "row_count", (F.col("row_count") - F.col("seen_count")).alias("missing_count"),
            F.when(F.col("seen_count") == 0, 0).when(F.col("minimum") == F.col("maximum"), 1).otherwise(2).cast("bigint")
            .alias("unique_count"))
        stats = ends.unionByName(stats) if text else ends
    return _removal(stats, profile)


def _value_statistics(values: DataFrame) -> DataFrame:
    """Rows, missing rows and distinct known values per feature of a table of value counts."""
    gone = F.col("bits").isNull() & F.col("text").isNull()
    return values.groupBy("feature").agg(
        F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(gone, F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count_if(~gone).alias("unique_count"))


def _removal(stats: DataFrame, profile: Profile) -> DataFrame:
    missing = ratio(F.col("missing_count"), F.col("row_count"))
    high = missing > F.lit(profile.missing_threshold)
    constant = ~high & F.lit(profile.drop_constant) & (F.col("unique_count") <= 1)
    return stats.select(
        "feature", missing.alias("missing_ratio"), "unique_count",
        high.alias("high_missing"), constant.alias("constant"),
        F.when(high, "removed_high_missing").when(constant, "removed_constant")
        .otherwise("used").alias("status"),
    )


def feature_summary(profiled: DataFrame) -> DataFrame:
    """Counts of all, high-missing, constant and remaining features."""
    return profiled.agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.count_if("high_missing").alias("high_missing_count"),
        F.count_if("constant").alias("constant_count"),
        F.count_if(F.col("status") == "used").alias("remaining_count"),
    )


_ROW, _LABEL, _TIME = "__row", "__label", "__time"


def _counted_values(df: DataFrame, profile: Profile) -> DataFrame:
    """Value counts of rows, labels, times and features from one scan, written once.

    A row is named by the SHA-256 of its values.  An unparsable time is empty text.
    """
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    plain = nan_to_null(df).select(*[(F.col(c) + F.lit(0.0)).alias(c) if c in floats else F.col(c) for c in df.columns])
    marks = {_ROW: F.sha2(F.to_json(F.struct(*plain.columns), {"ignoreNullFields": "false"}), 256),
             _LABEL: F.col(profile.label).cast("string")}
    if profile.timestamp:
        parsed = event_time(plain, profile.timestamp, profile.timestamp_format).cast("string")
        marks[_TIME] = F.when(F.col(profile.timestamp).isNotNull(), F.coalesce(parsed, F.lit("")))
    features = profile.features(df.columns)
    numeric = [f for f in features if f not in profile.categorical]
    text = [f for f in features if f in profile.categorical]
    marked = plain.select(*features, *[c.alias(n) for n, c in marks.items()])
    return cut_lineage(column_values(marked, numeric, [*text, *marks]))


def quality_log(df: DataFrame, profile: Profile) -> DataFrame:
    """Whole-table log ``(category, item, value, rule, action)`` with values as text, from one scan."""
    validate_frame(df, profile)
    values = _counted_values(df, profile)
    profiled = cut_lineage(_removal(_value_statistics(values.where(~F.col("feature").isin(_ROW, _LABEL, _TIME))), profile))
    whole = values.where(F.col("feature") == _ROW).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"))
    labels = values.where(F.col("feature") == _LABEL).select(F.col("text").alias("class"), F.col("n").alias("count"))
    rule_missing = f"missing_ratio > {profile.missing_threshold}"
    rule_constant = "unique_non_missing_count <= 1"
    label_rule = f"column={profile.label}"

    def rows(frame: DataFrame, category, item, value, rule, action) -> DataFrame:
        return frame.select(*[
            (c if not isinstance(c, str) else F.lit(c)).cast("string").alias(n)
            for c, n in zip((category, item, value, rule, action),
                            ("category", "item", "value", "rule", "action"))])

    parts = [
        rows(whole, "dataset", "row_count", F.col("n"), "all rows", "record"),
        rows(df.sparkSession.range(1), "dataset", "column_count", F.lit(len(df.columns)),
             "all columns", "record"),
        rows(whole, "dataset", "duplicate_row_count", F.col("duplicate_row_count"),
             "exact full-row duplicate", "review"),
        rows(labels, "label_distribution", F.col("class"), F.col("count"),
             label_rule, "record"),
    ]
    if profile.timestamp:
        at = F.when(F.col("text") != "", F.col("text").cast("timestamp_ntz"))
        times = values.where(F.col("feature") == _TIME).agg(
            F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
            F.coalesce(F.sum(F.when(F.col("text") == "", F.col("n"))), F.lit(0)).alias("parse_failure_count"),
            F.coalesce(F.sum(F.when(F.col("text") != "", F.col("n") - 1)), F.lit(0)).alias("duplicate_count"),
            F.min(at).alias("minimum"), F.max(at).alias("maximum"))
        parsed = f"format={profile.timestamp_format}"
        entries = F.array(*[
            F.struct(F.lit(i).alias("item"), F.col(c).cast("string").alias("value"),
                     F.lit(r).alias("rule"), F.lit(a).alias("action"))
            for i, c, r, a in (
                ("missing_count", "missing_count", f"column={profile.timestamp}", "review"),
                ("parse_failure_count", "parse_failure_count", parsed, "review"),
                ("duplicate_count", "duplicate_count", "parsed timestamp duplicate", "review"),
                ("minimum", "minimum", parsed, "record"),
                ("maximum", "maximum", parsed, "record"))])
        parts.append(times.select(F.lit("timestamp").alias("category"), F.inline(entries)))
    keep = F.lit("keep")
    drop = F.lit("eda_candidate_drop")
    parts.append(rows(profiled, "feature_missing_ratio", F.col("feature"),
                      F.round("missing_ratio", 6), rule_missing, F.when(F.col("high_missing"), drop).otherwise(keep)))
    if profile.drop_constant:
        parts.append(rows(profiled.where(~F.col("high_missing")), "feature_constant_check", F.col("feature"),
                          F.col("unique_count"), rule_constant,
                          F.when(F.col("constant"), drop).otherwise(keep)))
    counts = F.array(*[
        F.struct(F.lit(i).alias("item"), F.col(c).cast("string").alias("value"),
                 F.lit(r).alias("rule"), F.lit(a).alias("action"))
        for i, c, r, a in (
            ("feature_count", "feature_count", "Dataset Profile selection", "record"),
            ("high_missing_candidate_count", "high_missing_count", rule_missing, "eda_only"),
            ("constant_candidate_count", "constant_count", rule_constant, "eda_only"),
            ("remaining_feature_candidate_count", "remaining_count", SUMMARY_RULE_REMAINING, "eda_only"))])
    parts.append(feature_summary(profiled).select(F.lit("feature_summary").alias("category"), F.inline(counts)))
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log


def split_summary(df: DataFrame, split: str, label: str, classes: list, splits: list[str]) -> DataFrame:
    """Rows and share per (split, class), with zero rows for absent classes."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(s, str(c)) for s in splits for c in classes], "split string, class string")
    counts = df.groupBy(F.col(split).alias("split"), F.col(label).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("count"))
    filled = grid.join(counts, ["split", "class"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy("split"))
    return filled.withColumn("ratio", F.when(total == 0, 0.0).otherwise(ratio(F.col("count"), total)))


def quality_filter_by_fold(members: DataFrame, profile: Profile, fold: str = "fold") -> DataFrame:
    """Filter record of every fold: what a filter fitted on that fold's rows removes.

    ``members`` repeats each fit row once per fold it belongs to.
    """
    numeric = [f for f in profile.features([c for c in members.columns if c != fold])
               if f not in profile.categorical]
    stats = column_moments(members, numeric, [fold]).select(
        fold, "feature", ratio(F.col("row_count") - F.col("seen_count"), F.col("row_count")).alias("missing_ratio"),
        F.col("minimum").alias("low"), F.col("maximum").alias("high"))
    high = F.col("missing_ratio") > F.lit(profile.missing_threshold)
    constant = ~high & F.lit(profile.drop_constant) & (F.col("low").isNull() | (F.col("low") == F.col("high")))
    flagged = stats.select(fold, "feature", high.alias("h"), constant.alias("c"))

    def names(flag):
        return F.array_join(F.sort_array(F.collect_list(F.when(flag, F.col("feature")))), ",")

    # collect_list holds at most one entry per column of the table.
    return flagged.groupBy(fold).agg(
        F.count(F.lit(1)).alias("input_feature_count"),
        F.count_if("h").alias("high_missing_removed_count"),
        F.count_if("c").alias("constant_removed_count"),
        F.count_if(F.col("h") | F.col("c")).alias("removed_feature_count"),
        F.count_if(~F.col("h") & ~F.col("c")).alias("retained_feature_count"),
        names(F.col("h")).alias("high_missing_features"),
        names(F.col("c")).alias("constant_features"),
    )


def retained_features(df: DataFrame, profile: Profile) -> list[str]:
    """Features a filter fitted on ``df`` keeps, in table order; an error when none is left."""
    status = {r.feature: r.status for r in feature_profile(df, profile, exact_unique=False).collect()}
    kept = [f for f in profile.features(df.columns) if status.get(f) == "used"]
    if not kept:
        raise ContractError("the quality filter leaves no feature")
    return kept
