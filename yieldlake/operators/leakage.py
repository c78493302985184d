"""Checks that no row, key or time leaks between the parts of a split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import event_time
from ..profile import PROTOCOL_ID, SOURCE_ROW_ID, SPLIT_COLUMNS, SPLIT_ROLE, ContractError, Profile
from .splits import ROLES

PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))


def overlap_counts(df: DataFrame, keys: list[str], role: str) -> DataFrame:
    """One row: distinct keys shared by each pair of parts; nulls compare equal."""
    present = df.groupBy(*keys).agg(*[F.max(F.col(role) == r).alias(r) for r in ROLES])
    return present.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in PAIRS])


def _detail(counts: DataFrame, check: str, extra=None, info: bool = False) -> DataFrame:
    clean = sum((F.col(f"{a}_{b}") for a, b in PAIRS), F.lit(0)) == 0
    if extra is not None:
        clean = clean & ~extra
    status = F.lit("INFO") if info else F.when(clean, "PASS").otherwise("FAIL")
    return counts.select(F.lit(check).alias("check"), status.alias("status"),
                         *[f"{a}_{b}" for a, b in PAIRS])


def duplicate_content(df: DataFrame, role: str = SPLIT_ROLE) -> DataFrame:
    """Full rows shared by two parts, compared by value."""
    columns = sorted(c for c in df.columns if c not in {*SPLIT_COLUMNS, role, "strategy"})
    return _detail(overlap_counts(df, columns, role), "duplicate_row_overlap")


def timestamp_overlap(df: DataFrame, profile: Profile, strategy: str, role: str = SPLIT_ROLE) -> DataFrame:
    """Times shared by two parts: informative for a random split, a failure for a time split."""
    times = df.select(event_time(df, profile.timestamp, profile.timestamp_format).alias("ts"), role)
    present = times.groupBy("ts").agg(*[F.max(F.col(role) == r).alias(r) for r in ROLES])
    bad = F.count_if(F.col("ts").isNull())
    counts = present.agg(bad.alias("bad"), *[
        F.count_if(F.col(a) & F.col(b) & F.col("ts").isNotNull()).alias(f"{a}_{b}") for a, b in PAIRS])
    out = _detail(counts, "timestamp_overlap", F.col("bad") > 0, info=strategy == "random")
    if strategy == "random":
        # An unparsable time fails under either strategy.
        failed = counts.select((F.col("bad") > 0).alias("failed"))
        out = out.crossJoin(F.broadcast(failed)).withColumn(
            "status", F.when(F.col("failed"), "FAIL").otherwise(F.col("status"))).drop("failed")
    return out


def metadata_overlap(df: DataFrame, keys: list[str], role: str = SPLIT_ROLE) -> DataFrame:
    """Ids or groups shared by two parts; a null key fails."""
    present = df.groupBy(*keys).agg(*[F.max(F.col(role) == r).alias(r) for r in ROLES])
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    counts = present.agg(F.count_if(null_key).alias("bad"), *[
        F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in PAIRS])
    return _detail(counts, "metadata_overlap:" + ",".join(keys), F.col("bad") > 0)


def leakage_checks(df: DataFrame, profile: Profile, strategy: str, role: str = SPLIT_ROLE) -> DataFrame:
    """All overlap checks of one strategy as rows ``(check, status, pair counts)``."""
    out = duplicate_content(df, role).unionByName(timestamp_overlap(df, profile, strategy, role))
    for keys in ((SOURCE_ROW_ID,), profile.groups, profile.ids):
        if keys and all(k in df.columns for k in keys):
            out = out.unionByName(metadata_overlap(df, list(keys), role))
    return out.withColumn("split_type", F.lit(strategy))


def time_boundaries(df: DataFrame, profile: Profile, role: str = SPLIT_ROLE) -> DataFrame:
    """Boundary table: strict order of the parts in time, parsing, and the overall status."""
    ts = event_time(df, profile.timestamp, profile.timestamp_format)

    def of(name: str):
        return F.when(F.col(role) == name, ts)

    bounds = df.agg(
        F.max(of("train")).alias("train_max"), F.min(of("validation")).alias("valid_min"),
        F.max(of("validation")).alias("valid_max"), F.min(of("test")).alias("test_min"),
        F.count_if(ts.isNull()).alias("bad"))
    first = F.coalesce(F.col("train_max") < F.col("valid_min"), F.lit(False))
    second = F.coalesce(F.col("valid_max") < F.col("test_min"), F.lit(False))
    parsed = (F.col("bad") == 0) & F.col("train_max").isNotNull() & F.col("valid_min").isNotNull() \
        & F.col("test_min").isNotNull()
    none = F.lit(None).cast("timestamp_ntz")

    def row(check, passed, left=none, right=none):
        return F.struct(F.lit(check).alias("check"), F.when(passed, "PASS").otherwise("FAIL").alias("status"),
                        left.alias("earlier_end"), right.alias("later_start"))

    return bounds.select(F.inline(F.array(
        row("train_max < valid_min", first, F.col("train_max"), F.col("valid_min")),
        row("valid_max < test_min", second, F.col("valid_max"), F.col("test_min")),
        row("timestamp_parsing", parsed),
        row("overall", first & second & parsed, F.col("train_max"), F.col("test_min")))))


def train_role_violations(df: DataFrame) -> DataFrame:
    """One row of contract breaches of a Train frame; all zero (one protocol) when it is usable."""
    ids = df.groupBy(SOURCE_ROW_ID).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(SPLIT_ROLE) != "train", F.lit(True))).alias("r"),
        F.min(PROTOCOL_ID).alias("lo"), F.max(PROTOCOL_ID).alias("hi"),
        F.count_if(F.col(PROTOCOL_ID).isNull()).alias("p"))
    return ids.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("not_train_rows"),
        F.coalesce(F.sum(F.when(F.col(SOURCE_ROW_ID).isNull(), F.col("n"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum(F.when(F.col(SOURCE_ROW_ID).isNotNull(), F.col("n") - 1)), F.lit(0)).alias("repeated_ids"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("null_protocols"),
        (F.min("lo") != F.max("hi")).cast("int").alias("mixed_protocols"))


def require_train_role(df: DataFrame) -> None:
    present = set(df.columns) & set(SPLIT_COLUMNS)
    if present and present != set(SPLIT_COLUMNS):
        raise ContractError("split metadata must hold source id, role and protocol")
    if present:
        found = train_role_violations(df).first().asDict()
        if any(found.values()):
            raise ContractError(f"not a usable Train split: {found}")


def pair_violations(train: DataFrame, later: DataFrame, profile: Profile, temporal: bool = False,
                    later_role: str = "validation") -> DataFrame:
    """One row of breaches between Train and a later part: ids, content, groups, protocol, time."""
    tagged = set(SPLIT_COLUMNS) <= set(train.columns)
    both = train.withColumn("__side", F.lit("a")).unionByName(
        later.withColumn("__side", F.lit("b")), allowMissingColumns=True)
    in_a, in_b = F.col("__side") == "a", F.col("__side") == "b"

    def shared(keys, name):
        held = both.groupBy(*keys).agg(F.max(in_a).alias("a"), F.max(in_b).alias("b"))
        return held.agg(F.count_if(F.col("a") & F.col("b")).alias(name))

    out = both.agg(F.count_if(in_a).alias("train_rows"), F.count_if(in_b).alias("later_rows"))
    if tagged:
        out = out.crossJoin(shared([SOURCE_ROW_ID], "shared_rows"))
        protocols = both.agg(
            (F.count_distinct(PROTOCOL_ID) != 1).cast("int").alias("mixed_protocols"),
            F.count_if(in_b & (F.col(SPLIT_ROLE) != later_role)).alias("wrong_role_rows"))
        out = out.crossJoin(protocols)
    else:
        columns = sorted(c for c in train.columns if c in later.columns)
        out = out.crossJoin(shared(columns, "shared_rows"))
    if profile.groups:
        out = out.crossJoin(shared(list(profile.groups), "shared_groups"))
    if temporal and profile.timestamp:
        ts = event_time(both, profile.timestamp, profile.timestamp_format)
        out = out.crossJoin(both.agg(
            F.count_if(ts.isNull()).alias("bad_times"),
            F.coalesce((F.max(F.when(in_a, ts)) >= F.min(F.when(in_b, ts))).cast("int"), F.lit(1))
            .alias("time_overlap")))
    return out


def require_pair(train: DataFrame, later: DataFrame, profile: Profile, temporal: bool = False,
                 later_role: str = "validation") -> None:
    found = pair_violations(train, later, profile, temporal, later_role).first().asDict()
    if not found.pop("train_rows") or not found.pop("later_rows"):
        raise ContractError("both parts need rows")
    if any(found.values()):
        raise ContractError(f"Train and the later part leak: {found}")


def require_final_pair(train: DataFrame, test: DataFrame, profile: Profile, protocol: str) -> None:
    """Both frames carry metadata of ``protocol``, the later one is the test part with both labels."""
    for frame in (train, test):
        if not set(SPLIT_COLUMNS) <= set(frame.columns):
            raise ContractError("split metadata is required for a final evaluation")
    require_train_role(train)
    require_pair(train, test, profile, temporal=True, later_role="test")
    seen = test.agg(F.count_distinct(profile.label).alias("labels"), F.max(PROTOCOL_ID).alias("p")).first()
    if seen.labels != 2:
        raise ContractError("the test part needs both labels")
    if seen.p != protocol:
        raise ContractError("the split protocol differs from the model's")


def same_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row of differences between two row sets, counting repeats on either side."""
    counts = left.select(*keys, F.lit(1).alias("d"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(-1).alias("d"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    ).groupBy(*keys).agg(F.sum("d").alias("d"), F.sum("l").alias("l"), F.sum("r").alias("r"))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("only_right"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated_keys"))
