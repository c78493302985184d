"""Building blocks that keep ordered and keyed work spread over the cluster.

Running totals have a plain form, used when a count proves that the input fits one
task, and a distributed form for anything larger.  Both give the same rows.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ONE_TASK_ROWS_KEY = "yieldlake.oneTaskRows"
ONE_TASK_ROWS = 2_000_000
BROADCAST_ROWS = 100_000  # narrow lookup rows, a few tens of megabytes at most
HOT_SHARE = 1000  # a key is hot when it holds more than 1/1000 of all rows


def one_task_rows(spark: SparkSession) -> int:
    """Largest number of rows that one task may sort or hold."""
    return int(spark.conf.get(ONE_TASK_ROWS_KEY, str(ONE_TASK_ROWS)))


def broadcast_rows(spark: SparkSession) -> int:
    """Largest counted lookup table that is broadcast whole."""
    return int(spark.conf.get("yieldlake.broadcastRows", str(BROADCAST_ROWS)))


def fits_one_task(df: DataFrame, rows: int | None = None) -> bool:
    """True when a count (or a known ``rows`` bound) proves that one task can hold ``df``."""
    known = df.count() if rows is None else rows
    return known <= one_task_rows(df.sparkSession)


def prepare_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local session makes its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def scratch_path(spark: SparkSession) -> str:
    """A new location in the checkpoint folder that every executor can reach."""
    prepare_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read it back.

    The table survives lost executors, is read by column, and its true size guides
    later joins, which a serialized checkpoint would not give.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    held = _SCOPE.get()
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, name: str) -> None:
    """Delete a scratch location."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def published(spark: SparkSession, path: str) -> Iterator[str]:
    """A staging folder beside ``path`` that is renamed to it when the block ends, and removed when the block raises.

    What the block checks in the folder is what is published; an existing ``path`` is refused.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    if files.exists(place):
        raise FileExistsError(f"{path} exists already")
    try:
        yield staging
        if files.exists(place) or not files.rename(spark._jvm.org.apache.hadoop.fs.Path(staging), place):
            raise FileExistsError(f"{path} was written meanwhile")
    finally:
        remove_path(spark, staging)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more.

    Its cleaner acts when the driver happens to collect garbage; between large steps whose
    results are written, asking for it keeps old files from adding up.
    """
    gc.collect()
    spark._jvm.System.gc()


# Tables written in the innermost open scope of this thread; None outside of any.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove the tables that ``cut_lineage`` writes inside, once the block ends.

    Gives a function that writes a result outside of the scope; only what it returns may
    be used afterwards.
    """
    outer, held = _SCOPE.get(), []

    def keep(df: DataFrame) -> DataFrame:
        token = _SCOPE.set(outer)
        try:
            return cut_lineage(df)
        finally:
            _SCOPE.reset(token)

    token = _SCOPE.set(held)
    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for name in held:
            remove_path(spark, name)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join with a ``right`` of few rows per key; with no keys it is one row and joins every row.

    Keys such as fold, label or sensor may hold a large part of ``left`` each.  ``right`` is
    written once and counted, and broadcast when that proves it small, so that no key is
    shuffled to one task.
    """
    if not keys:
        return left.crossJoin(F.broadcast(right))
    right = cut_lineage(right)
    small = right.count() <= broadcast_rows(left.sparkSession)
    return left.join(F.broadcast(right) if small else right, list(keys), how)


def running_sum(
    df: DataFrame,
    order: Sequence[Column],
    measures: Sequence[str],
    keys: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Add ``cum_<measure>``: the inclusive running total within ``keys`` along ``order``.

    ``(keys, order)`` must identify a row and ``keys`` must not be null.  A large
    input is range-partitioned, so that one hot key spreads over many tasks;
    each slice then gets the totals of the slices before it.
    """
    keys = list(keys)
    if rows is None:  # Written once: counting, finding the ranges and placing the rows would each make it again.
        df = cut_lineage(df)
    if fits_one_task(df, rows):
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(m).over(window).alias(f"cum_{m}") for m in measures])
    spark = df.sparkSession
    slices = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sliced = cut_lineage(
        df.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
        .withColumn("__slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "__slice").agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
        .select(*keys, "__slice", *[
            F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in measures])
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(m).over(inside).alias(f"__l_{m}") for m in measures])
    return local.join(offsets, [*keys, "__slice"]).select(
        *df.columns,
        *[(F.col(f"__l_{m}") + F.col(f"__o_{m}")).alias(f"cum_{m}") for m in measures])


def as_of_join(rows: DataFrame, states: DataFrame, keys: Sequence[str], at: str, since: str,
               values: Sequence[str]) -> DataFrame:
    """``rows`` plus ``since`` and ``values`` of the state in force: of the same ``keys``, the latest with ``since <= at``.

    Of states that share keys and time, the one with the largest values counts.  Rows with a
    null key or time, and rows before the first state, get nulls; no row is lost or repeated.
    Rows and states are ordered together over range-partitioned slices, and each slice is
    handed the last state of the slices before it: one key may fill many tasks.
    """
    keys = list(keys)
    spark = rows.sparkSession
    slices = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    state = F.struct(F.col(since), *[F.col(v) for v in values])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    kept = states.where(known & F.col(since).isNotNull()).select(
        *keys, F.col(since).alias("__at"), F.lit(0).alias("__kind"), state.alias("__state"))
    empty = F.lit(None).cast(kept.schema["__state"].dataType)
    mine = rows.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__kind"), empty.alias("__state"),
                       F.struct(*rows.columns).alias("__row"))
    both = mine.unionByName(kept, allowMissingColumns=True)
    # The hash spreads rows of one key and time; states come before them.
    order = ["__at", "__kind", "__state"]
    sliced = cut_lineage(both.repartitionByRange(slices, *keys, *order, F.xxhash64("__row")).withColumn("__slice", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("__found", F.last("__state", ignorenulls=True).over(inside)).where("__kind = 1")
    # One row for each key of a slice.
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut_lineage(sliced.where(known).groupBy(*keys, "__slice").agg(
        F.max("__state").alias("__last")).select(
        *keys, "__slice", F.last("__last", ignorenulls=True).over(before).alias("__carried")).where("__carried is not null"))
    found = F.when(known & F.col("__at").isNotNull(), F.coalesce("__found", "__carried"))
    joined = local.join(carried, [*keys, "__slice"], "left").withColumn("__found", found)
    return joined.select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in (since, *values)])


def hot_keys(counts: DataFrame, count: str) -> DataFrame:
    """Rows of a per-key count table whose key holds more than 1/1000 of everything (< 1000 rows)."""
    total = counts.agg(F.sum(count).alias("__all"))
    return counts.crossJoin(F.broadcast(total)).where(
        F.col(count) * HOT_SHARE > F.col("__all")).drop("__all")


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, count: str, bound: int | None = None) -> DataFrame:
    """Left join of ``rows`` to a one-row-per-key ``lookup`` that hot or null keys cannot skew.

    ``count`` is the lookup column with the key's row count.  A lookup whose size the
    caller bounds is broadcast when the bound is small; otherwise it is written once
    and counted.  Of a large one only the hot keys, fewer than 1000, are broadcast;
    the others meet in an ordinary shuffle, where hot and null keys are spread over
    stand-ins that match nothing.
    """
    fields = [c for c in lookup.columns if c != key]
    if bound is not None and bound <= broadcast_rows(rows.sparkSession):
        return rows.join(F.broadcast(lookup), key, "left").select(*rows.columns, *fields)
    lookup = cut_lineage(lookup)
    if lookup.count() <= broadcast_rows(rows.sparkSession):
        return rows.join(F.broadcast(lookup), key, "left").select(*rows.columns, *fields)
    hot = hot_keys(lookup, count).select(
        F.col(key), F.struct(*fields).alias("__hot"))
    tagged = rows.join(F.broadcast(hot), key, "left")
    simple = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)]
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*simple), F.lit(4096)).cast("string"))
    tagged = tagged.withColumn(
        "__key", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), spread)
        .otherwise(F.col(key).cast("string")))
    cold = lookup.select(F.col(key).cast("string").alias("__key"), F.struct(*fields).alias("__cold"))
    joined = tagged.join(cold, "__key", "left").withColumn("__hit", F.coalesce("__hot", "__cold"))
    return joined.select(*rows.columns, *[F.col(f"__hit.{f}").alias(f) for f in fields])


def seeded_hash(ids: Sequence[str], seed: int) -> Column:
    """Reproducible pseudo-random order key of a row: 32 hex digits of the seed and its ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def quota_cuts(units: DataFrame, quotas: DataFrame, strata: Sequence[str], ids: Sequence[str],
               seed: int) -> DataFrame:
    """Cut points that split a seeded shuffle of each stratum's ``units`` by quota.

    ``quotas`` holds ``(strata, part, upto)``: after shuffling, ranks up to ``upto``
    belong to ``part`` or an earlier one.  No row is sorted globally: counts per
    hash prefix show which prefix holds each cut, and only those rows are ranked.
    """
    strata = list(strata)
    slim = units.select(*strata, seeded_hash(ids, seed).alias("__h"),
                        *[F.col(c).cast("string").alias(f"__id_{c}") for c in ids])
    slim = slim.withColumn("__p", F.substring("__h", 1, 4))
    along = Window.partitionBy(*strata).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    prefix = slim.groupBy(*strata, "__p").agg(F.count(F.lit(1)).alias("__n")).select(
        "*", F.sum("__n").over(along).alias("__upto"))
    place = prefix.join(quotas, strata).where(
        (F.col("upto") <= F.col("__upto")) & (F.col("upto") > F.col("__upto") - F.col("__n"))
    ).select(*strata, "__p", "part", (F.col("upto") - F.col("__upto") + F.col("__n")).alias("__r"))
    ordered = ["__h", *[f"__id_{c}" for c in ids]]
    near = Window.partitionBy(*strata, "part").orderBy(*ordered)
    # One row per stratum and part: the quota table bounds it, so it may be broadcast.
    cuts = (
        slim.join(F.broadcast(place), [*strata, "__p"])
        .withColumn("__rank", F.row_number().over(near)).where(F.col("__rank") == F.col("__r"))
        .groupBy(*strata).agg(F.sort_array(F.collect_list(F.struct(*ordered))).alias("__cuts"))
    )
    empty = quotas.groupBy(*strata).agg(F.count_if(F.col("upto") == 0).alias("__empty"))
    return empty.join(cuts, strata, "left")


def apply_cuts(df: DataFrame, cuts: DataFrame, strata: Sequence[str], ids: Sequence[str],
               seed: int, out: str) -> DataFrame:
    """Number the part (1, 2, ...) of each row by comparing its seeded hash with the cuts; no shuffle."""
    mine = F.struct(seeded_hash(ids, seed).alias("__h"),
                    *[F.col(c).cast("string").alias(f"__id_{c}") for c in ids])
    return (
        df.withColumn("__mine", mine).join(F.broadcast(cuts), list(strata), "left")
        .withColumn(out, (1 + F.col("__empty") + F.coalesce(
            F.size(F.expr("filter(__cuts, c -> c < __mine)")), F.lit(0))).cast("int"))
        .select(*df.columns, out)
    )
