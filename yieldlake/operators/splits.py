"""Time, random and group splits, cross-validation folds and split tagging."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import event_time, ratio
from ..profile import (
    PROTOCOL_ID, SOURCE_ROW_ID, SPLIT_COLUMNS, SPLIT_ROLE, ContractError, Profile, validate_frame,
)
from ..scale import apply_cuts, lookup_join, quota_cuts, running_sum

ROLES = ("train", "validation", "test")


@dataclass(frozen=True)
class TimeCuts:
    """Row positions of both cuts and the last timestamp of Train and of Validation."""

    rows: int
    train_end: int
    validation_end: int
    train_last: datetime
    validation_last: datetime


def _moment(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _time_of(df: DataFrame, profile: Profile) -> Column:
    if profile.timestamp is None:
        raise ContractError("a timestamp column is required")
    return event_time(df, profile.timestamp, profile.timestamp_format)


def _reject_nulls(df: DataFrame, columns: list[str]) -> None:
    if columns and df.where(" or ".join(f"`{c}` is null" for c in columns)).limit(1).count():
        raise ContractError(f"null in key columns {columns}")


def time_events(df: DataFrame, profile: Profile) -> DataFrame:
    """Per distinct time: its rows and the change in the number of open groups and ids.

    A cut is blocked when some group or id has rows on both sides.  Each group adds +1
    at its first and -1 at its last time, so a running total counts the open groups.
    """
    times = df.select(_time_of(df, profile).alias("ts"), *sorted({*profile.groups, *profile.ids}))
    events = times.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).withColumn("open", F.lit(0).cast("bigint"))
    for keys in (profile.groups, profile.ids):
        if not keys:
            continue
        span = times.groupBy(*keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        steps = span.where("first < last").select(F.inline(F.array(
            F.struct(F.col("first").alias("ts"), F.lit(1).alias("open")),
            F.struct(F.col("last").alias("ts"), F.lit(-1).alias("open")))))
        events = events.unionByName(steps.groupBy("ts").agg(F.sum("open").alias("open")).withColumn(
            "n", F.lit(0).cast("bigint")))
    if not (profile.groups or profile.ids):
        return events
    return events.groupBy("ts").agg(F.sum("n").alias("n"), F.sum("open").alias("open"))


def time_table(events: DataFrame, rows: int | None = None) -> DataFrame:
    """Per distinct time: cumulative rows ``boundary`` and whether a cut after it is ``blocked``."""
    return running_sum(events, [F.col("ts")], ["n", "open"], rows=rows).select(
        "ts", "n", F.col("cum_n").alias("boundary"), (F.col("cum_open") > 0).alias("blocked"))


def time_cuts(df: DataFrame, profile: Profile, train_ratio: float = 0.70,
              validation_ratio: float = 0.15) -> TimeCuts:
    """Cuts nearest the target shares that separate neither equal times nor groups.

    Only a few scalars per query reach the driver.
    """
    if not (train_ratio > 0 and validation_ratio > 0 and train_ratio + validation_ratio < 1):
        raise ContractError("split shares must be positive and sum to less than one")
    _reject_nulls(df, [*profile.groups, *profile.ids])
    events = time_events(df, profile).persist()
    try:
        total = events.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("times"),
                           F.count_if(F.col("ts").isNull()).alias("bad")).first()
        if total.bad:
            raise ContractError("missing or unparsable timestamps")
        n = total.n or 0
        if n < 3:
            raise ContractError("a time split needs at least three rows")
        train_target = max(1, min(int(n * train_ratio), n - 2))
        valid_target = max(train_target + 1, min(int(n * (train_ratio + validation_ratio)), n - 1))
        table = time_table(events, total.times)
        is_safe = (F.col("boundary") < n) & ~F.col("blocked")
        moved = table.agg(
            F.count_if(is_safe).alias("safe"), F.max(F.when(is_safe, F.col("boundary"))).alias("last"),
            F.min(F.when(F.col("boundary") >= train_target, F.struct("boundary", "blocked", "ts"))).alias("a"),
            F.min(F.when(F.col("boundary") >= valid_target, F.struct("boundary", "blocked", "ts"))).alias("b"),
        ).first()
        first, second = moved.a, max(moved.a, moved.b)
        ok = (0 < first.boundary < second.boundary < n) and not first.blocked and not second.blocked
        if moved.safe < 2:
            raise ContractError("times and groups cannot be kept whole in three parts")
        if not ok:
            def nearest(candidates: DataFrame, target: int):
                return candidates.agg(F.min(F.struct(
                    F.abs(F.col("boundary") - target).alias("gap"), "boundary", "ts")).alias("best")).first().best

            safe = table.where(is_safe)
            first = nearest(safe.where(F.col("boundary") < moved.last), train_target)
            second = nearest(safe.where(F.col("boundary") > first.boundary), valid_target)
        return TimeCuts(n, first.boundary, second.boundary, first.ts, second.ts)
    finally:
        events.unpersist()


def time_split(df: DataFrame, profile: Profile, train_ratio: float = 0.70, validation_ratio: float = 0.15,
               role: str = SPLIT_ROLE) -> DataFrame:
    """Add the role column of a time split; the wide rows are only compared with two literals."""
    cuts = time_cuts(df, profile, train_ratio, validation_ratio)
    ts = _time_of(df, profile)
    return df.withColumn(role, F.when(ts <= _moment(cuts.train_last), "train")
                         .when(ts <= _moment(cuts.validation_last), "validation").otherwise("test"))


def _largest_remainder(counts: DataFrame, total: int, name: str) -> DataFrame:
    """Share ``total`` units over strata in proportion to ``n`` (whole units, largest remainder first)."""
    # One row per label value: an unpartitioned window is bounded by the declared labels.
    everything = Window.partitionBy(F.lit(1))
    exact = F.col("n") * F.lit(total) / F.sum("n").over(everything)
    base = counts.withColumn("__base", F.floor(exact)).withColumn("__rest", exact - F.floor(exact))
    left = F.lit(total) - F.sum("__base").over(everything)
    rank = F.row_number().over(everything.orderBy(F.desc("__rest"), "stratum"))
    return base.withColumn(name, (F.col("__base") + F.when(rank <= left, 1).otherwise(0)).cast("bigint")).drop(
        "__base", "__rest")


def random_split(df: DataFrame, profile: Profile, ids: list[str], seed: int = 42,
                 role: str = SPLIT_ROLE) -> DataFrame:
    """Label-stratified 70/15/15 split by a seeded hash of the row ids."""
    labeled = df.withColumn("stratum", F.col(profile.label).cast("string"))
    counts = labeled.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    n = df.count()
    later = math.ceil(0.30 * n)
    tested = math.ceil(0.50 * later)
    sized = _largest_remainder(counts, n - later, "n_train")
    rest = sized.withColumn("n_all", F.col("n")).withColumn("n", F.col("n_all") - F.col("n_train"))
    sized = _largest_remainder(rest, later - tested, "n_valid")
    quotas = sized.select("stratum", F.inline(F.array(
        F.struct(F.lit(1).alias("part"), F.col("n_train").alias("upto")),
        F.struct(F.lit(2).alias("part"), (F.col("n_train") + F.col("n_valid")).alias("upto")))))
    cuts = quota_cuts(labeled, quotas, ["stratum"], ids, seed)
    parted = apply_cuts(labeled, cuts, ["stratum"], ids, seed, "__part")
    return parted.withColumn(role, F.element_at(F.array(*map(F.lit, ROLES)), F.col("__part"))).drop(
        "__part", "stratum")


def random_group_split(df: DataFrame, groups: list[str], seed: int = 42, role: str = SPLIT_ROLE) -> DataFrame:
    """70/15/15 split of whole groups: the rows of a group share its hash, so no join is needed."""
    _reject_nulls(df, groups)
    units = df.select(*groups).distinct().withColumn("stratum", F.lit("all"))
    n = units.count()
    later = math.ceil(0.30 * n)
    kept = n - later
    middle = later - math.ceil(0.50 * later)
    quotas = df.sparkSession.createDataFrame(
        [("all", 1, kept), ("all", 2, kept + middle)], "stratum string, part int, upto bigint")
    cuts = quota_cuts(units, quotas, ["stratum"], groups, seed)
    parted = apply_cuts(df.withColumn("stratum", F.lit("all")), cuts, ["stratum"], groups, seed, "__part")
    return parted.withColumn(role, F.element_at(F.array(*map(F.lit, ROLES)), F.col("__part"))).drop(
        "__part", "stratum")


def stratified_homes(df: DataFrame, profile: Profile, ids: list[str], n_splits: int = 5, n_repeats: int = 1,
                     seed: int = 42, out: str = "homes") -> DataFrame:
    """Each row once, with the array of its fold per repeat; per label, fold sizes differ by at most one."""
    labeled = df.withColumn("stratum", F.col(profile.label).cast("string"))
    counts = labeled.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    worst = counts.agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if worst.k < 2 or worst.n < n_splits:
        raise ContractError("each label needs at least as many rows as folds")
    quotas = counts.select("stratum", F.inline(F.array(*[
        F.struct(F.lit(j).alias("part"), F.floor(F.col("n") * j / n_splits).cast("bigint").alias("upto"))
        for j in range(1, n_splits)])))
    placed = labeled
    for repeat in range(n_repeats):
        cuts = quota_cuts(labeled, quotas, ["stratum"], ids, seed + repeat)
        placed = apply_cuts(placed, cuts, ["stratum"], ids, seed + repeat, f"__fold{repeat}")
    return placed.select(*df.columns, F.array(*[F.col(f"__fold{r}") for r in range(n_repeats)]).alias(out))


def stratified_folds(df: DataFrame, profile: Profile, ids: list[str], n_splits: int = 5, n_repeats: int = 1,
                     seed: int = 42) -> DataFrame:
    """Fold membership ``(ids, label, repeat, fold)``, one row per row and repeat."""
    placed = stratified_homes(df.select(*ids, profile.label), profile, ids, n_splits, n_repeats, seed)
    return placed.select(*ids, profile.label, F.posexplode("homes").alias("repeat", "fold")).withColumn(
        "repeat", F.col("repeat") + 1)


def group_folds(df: DataFrame, profile: Profile, ids: list[str], n_splits: int = 5, n_repeats: int = 1,
                seed: int = 42) -> DataFrame:
    """Group-disjoint folds ``(ids, label, group, repeat, fold)`` with both labels in every fold.

    Groups that hold the rarest label are dealt first, largest first, in alternating
    direction; ranks come from a running total, not from one global sort.
    """
    groups = list(profile.groups)
    _reject_nulls(df, groups)
    keyed = df.select(*ids, profile.label, F.to_json(F.struct(*groups)).alias("group"))
    positive = F.col(profile.label) == F.lit(profile.positive)
    sizes = keyed.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    support = sizes.agg(F.count_if(F.col("pos") > 0).alias("p"), F.count_if(F.col("neg") > 0).alias("q")).first()
    if min(support.p, support.q) < n_splits:
        raise ContractError("each label needs at least as many groups as folds")
    dealt = None
    for repeat in range(n_repeats):
        tagged = sizes.withColumn("rare", F.col("pos") > 0).withColumn("one", F.lit(1).cast("bigint")).withColumn(
            "h", F.md5(F.concat_ws("|", F.lit(str(seed + repeat)), "group")))
        ranked = running_sum(
            tagged, [F.desc("pos"), F.desc("n"), F.col("h"), F.col("group")], ["one"], ["rare"])
        turn = F.floor((F.col("cum_one") - 1) / n_splits)
        seat = F.pmod(F.col("cum_one") - 1, F.lit(n_splits))
        fold = (F.when(F.pmod(turn, F.lit(2)) == 0, seat).otherwise(n_splits - 1 - seat) + 1).cast("int")
        part = ranked.select("group", "n", F.lit(repeat + 1).alias("repeat"), fold.alias("fold"))
        joined = lookup_join(keyed, part, "group", "n").drop("n")
        dealt = joined if dealt is None else dealt.unionByName(joined)
    return dealt


def fold_label_coverage(members: DataFrame, profile: Profile, keys: list[str]) -> DataFrame:
    """Rows per label and a flag per fold; a fold without both labels is not usable."""
    return members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(profile.label) == F.lit(profile.positive)).alias("positive_rows"),
        F.count_if(F.col(profile.label) == F.lit(profile.negative)).alias("negative_rows"),
    ).withColumn("both_labels", (F.col("positive_rows") > 0) & (F.col("negative_rows") > 0))


def _blocks_after(df: DataFrame, profile: Profile, ranks_of, out: str) -> DataFrame:
    times = df.select(_time_of(df, profile).alias("ts")).distinct().withColumn("one", F.lit(1).cast("bigint")).persist()
    try:
        seen = times.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("ts").isNull()).alias("bad")).first()
        if seen.bad:
            raise ContractError("missing or unparsable timestamps")
        ranks = ranks_of(seen.m)
        ranked = running_sum(times, [F.col("ts")], ["one"], rows=seen.m)
        found = {r.cum_one: r.ts for r in ranked.where(F.col("cum_one").isin(ranks)).collect()}
    finally:
        times.unpersist()
    ts = _time_of(df, profile)
    block = F.lit(0)
    for rank in ranks:
        block = block + (ts > _moment(found[rank])).cast("int")
    return df.withColumn(out, block)


def time_blocks(df: DataFrame, profile: Profile, n_splits: int, out: str = "block") -> DataFrame:
    """Block 0 is the first past; block i is evaluated in fold i, which fits on all earlier blocks.

    The distinct times, not the rows, are cut: m // (n_splits + 1) times per evaluated block.
    """
    def ranks(m: int) -> list[int]:
        if n_splits < 2 or m <= n_splits:
            raise ContractError("time folds need at least two splits and more distinct times than splits")
        size = m // (n_splits + 1)
        return [m - (n_splits - i) * size for i in range(n_splits)]

    return _blocks_after(df, profile, ranks, out)


def later_blocks(df: DataFrame, profile: Profile, parts: int, out: str = "block") -> DataFrame:
    """Near-equal blocks 1..parts over the distinct times; the first m % parts get one more time."""
    def ranks(m: int) -> list[int]:
        if parts < 2 or m < parts:
            raise ContractError("too few distinct times for the blocks")
        sizes = [m // parts + (1 if i < m % parts else 0) for i in range(parts)]
        return [sum(sizes[:i]) for i in range(1, parts)]

    return _blocks_after(df, profile, ranks, out).withColumn(out, F.col(out) + 1)


def fold_membership(blocked: DataFrame, n_splits: int, block: str = "block") -> DataFrame:
    """Repeat each row for every fold it takes part in, as ``fold`` and ``fold_role``."""
    entries = F.array(*[
        F.when(F.col(block) < i, F.struct(F.lit(i).alias("fold"), F.lit("fit").alias("fold_role")))
        .when(F.col(block) == i, F.struct(F.lit(i).alias("fold"), F.lit("evaluation").alias("fold_role")))
        for i in range(1, n_splits + 1)])
    return blocked.select("*", F.inline(F.array_compact(entries)))


def fold_periods(members: DataFrame, profile: Profile, keys: list[str] | None = None) -> DataFrame:
    """Rows, failures, first and last time of the fit and evaluation part of each fold."""
    ts = _time_of(members, profile)
    failed = F.col(profile.label) == F.lit(profile.positive)
    parts = []
    for role, tag in (("fit", "train"), ("evaluation", "evaluation")):
        mine = F.col("fold_role") == role
        parts += [F.count_if(mine).alias(f"{tag}_samples"), F.count_if(mine & failed).alias(f"{tag}_fail"),
                  F.min(F.when(mine, ts)).alias(f"{tag}_start"), F.max(F.when(mine, ts)).alias(f"{tag}_end")]
    return members.groupBy(*(keys or ["fold"])).agg(*parts)


def fold_key_overlap(members: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present in both the fit and the evaluation part, per fold."""
    both = members.groupBy("fold", *keys).agg(
        F.max(F.col("fold_role") == "fit").alias("f"), F.max(F.col("fold_role") == "evaluation").alias("e"))
    return both.groupBy("fold").agg(F.count_if(F.col("f") & F.col("e")).alias("shared_keys"))


def recent_rows(members: DataFrame, profile: Profile, days: int) -> DataFrame:
    """Fit rows of the last ``days`` before each fold's latest fit time; 0 keeps all rows."""
    fit = members.where("fold_role = 'fit'")
    if days == 0:
        return fit
    ts = _time_of(fit, profile)
    latest = fit.groupBy("fold").agg(F.max(ts).alias("__latest"))
    # One row per fold.
    return fit.join(F.broadcast(latest), "fold").where(
        ts >= F.col("__latest") - F.make_dt_interval(F.lit(days))).drop("__latest")


def content_fingerprint(df: DataFrame, *salt: object) -> str:
    """Digest of the table content that row order and partitioning do not change."""
    seen = df.agg(
        F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    text = F.concat_ws("|", F.col("s").cast("string"), F.col("n").cast("string"), *[F.lit(str(s)) for s in salt])
    return seen.select(F.sha2(text, 256).alias("d")).first().d


def tag_splits(df: DataFrame, profile: Profile, row_id: str, seed: int = 42) -> DataFrame:
    """Union of the time and random split with source id, role, protocol and ``strategy``."""
    validate_frame(df, profile)
    if set(df.columns) & set(SPLIT_COLUMNS):
        raise ContractError("the input already has reserved split columns")
    digest = content_fingerprint(df, profile, seed)
    keys = list(profile.groups or profile.ids)
    timed = time_split(df, profile)
    drawn = random_group_split(df, keys, seed) if keys else random_split(df, profile, [row_id], seed)
    out = None
    for strategy, frame in (("time", timed), ("random", drawn)):
        tagged = frame.select(
            *df.columns, F.col(row_id).alias(SOURCE_ROW_ID), SPLIT_ROLE,
            F.lit(f"{strategy}:{digest}").alias(PROTOCOL_ID), F.lit(strategy).alias("strategy"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def train_label_coverage(tagged: DataFrame, profile: Profile) -> DataFrame:
    """Distinct labels of Train per strategy; fewer than two makes the split unusable."""
    return tagged.where(F.col(SPLIT_ROLE) == "train").groupBy("strategy").agg(
        F.count_distinct(profile.label).alias("labels"), F.count(F.lit(1)).alias("rows"),
        ratio(F.count_if(F.col(profile.label) == F.lit(profile.positive)), F.count(F.lit(1))).alias("positive_ratio"))
