"""Statistics of many numeric columns at once, gathered per Arrow batch.

Each task reduces its batches to small partial results per (group, column), which merge in
one small shuffle: rows are never turned into one row per sensor, sorted or shuffled.

Quantiles are found by radix selection.  A double maps to 64 bits whose unsigned order is
the order of the numbers.  A pass counts the rows by the next 16 bits, with the smallest and
the largest number of each count, and shows which count holds each wanted rank; later passes
only count rows under those prefixes.  A rank is settled as soon as its count holds a single
number or starts or ends with it, which takes two or three passes, and four at most.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import cut_lineage, scratch_scope

DIGIT = 16  # bits by which a pass refines
CELLS_AT_ONCE = 100_000  # prefixes that one pass looks up; more are searched in several passes
GROUPS_HELD = 1 << 20  # partial results that a task holds before it emits them
_TOP = np.uint64(1 << 63)


def _keyed(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``__key`` names a row's group as text, ``__k`` holds its key columns, then the numbers."""
    fields = [F.col(k) for k in keys]
    return df.select(
        (F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}) if fields else F.lit("")).alias("__key"),
        (F.struct(*fields) if fields else F.struct(F.lit(0).alias("none"))).alias("__k"),
        *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def _key_type(keyed: DataFrame) -> str:
    return keyed.schema["__k"].dataType.simpleString()


def _groups(batch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Group names of a batch, the first row of each and the group of each row."""
    coded = batch.column(0).dictionary_encode()
    group = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary.to_pylist(), np.unique(group, return_index=True)[1], group


def _numbers(batch, i: int) -> np.ndarray:
    return batch.column(i + 2).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _named(df: DataFrame, columns: Sequence[str], keys: Sequence[str], *rest) -> DataFrame:
    names = F.array(*map(F.lit, columns))
    return df.select(*[F.col(f"__k.{k}").alias(k) for k in keys],
                     F.element_at(names, F.col("pos") + 1).alias("feature"), *rest)


# -- moments -----------------------------------------------------------------------------------------

_STATS = ("rows", "seen", "n", "mean", "m2", "low", "high")


def _merged(a: tuple, b: tuple) -> tuple:
    n = a[2] + b[2]
    with np.errstate(invalid="ignore", divide="ignore"):
        gap = b[3] - a[3]
        mean = np.where(n > 0, (a[2] * a[3] + b[2] * b[3]) / np.maximum(n, 1), 0.0)
        m2 = a[4] + b[4] + np.where((a[2] > 0) & (b[2] > 0), gap * gap * a[2] * b[2] / np.maximum(n, 1), 0.0)
    return a[0] + b[0], a[1] + b[1], n, mean, m2, np.fmin(a[5], b[5]), np.fmax(a[6], b[6])


def _batch_moments(numbers: np.ndarray, group: np.ndarray, count: int, finite: bool) -> tuple:
    """Per (group, column) of a batch: rows, known numbers, counted ones, mean, squared deviations, least, largest."""
    if count > 1:
        order = np.argsort(group, kind="stable")
        numbers, group = numbers[order], group[order]
    starts = np.searchsorted(group, np.arange(count))
    known = ~np.isnan(numbers)
    used = np.isfinite(numbers) if finite else known
    with np.errstate(invalid="ignore", divide="ignore"):
        rows = np.broadcast_to(np.diff(np.append(starts, len(group)))[:, None], (count, numbers.shape[1]))
        seen, n = (np.add.reduceat(x.astype(np.int64), starts, axis=0) for x in (known, used))
        mean = np.add.reduceat(np.where(used, numbers, 0.0), starts, axis=0) / np.maximum(n, 1)
        m2 = np.add.reduceat(np.where(used, (numbers - mean[group]) ** 2, 0.0), starts, axis=0)
        masked = np.where(used, numbers, np.nan)
        return rows, seen, n, mean, m2, np.fmin.reduceat(masked, starts, axis=0), np.fmax.reduceat(masked, starts, axis=0)


def column_moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), finite: bool = False) -> DataFrame:
    """Per ``(keys, feature)``: ``row_count, seen_count, value_count, mean, m2, minimum, maximum``.

    ``seen_count`` counts known numbers (neither null nor NaN); the other statistics are of
    those or, with ``finite``, of the finite ones.  ``m2`` is the sum of squared deviations
    from the mean.  Statistics without a number are null.
    """
    columns, keys = list(columns), list(keys)
    keyed = _keyed(df, columns, keys)
    width = len(columns)

    def run(batches):
        import pyarrow as pa

        held: dict[str, tuple] = {}
        firsts: dict[str, object] = {}

        def emitted():
            names = list(held)
            stats = [np.concatenate([held[k][i] for k in names]) for i in range(len(_STATS))]
            group = pa.array(np.repeat(np.arange(len(names)), width))
            own = pa.concat_arrays([firsts[k] for k in names])
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(group), own.take(group), pa.array(np.tile(np.arange(width, dtype=np.int32), len(names))),
                 *[pa.array(x.astype(np.int64)) for x in stats[:3]], *[pa.array(x) for x in stats[3:5]],
                 *[pa.array(x, from_pandas=True) for x in stats[5:]]],  # NaN: no number
                ["__key", "__k", "pos", *_STATS])

        for batch in batches:
            if not batch.num_rows:
                continue
            names, first, group = _groups(batch)
            found = _batch_moments(np.stack([_numbers(batch, i) for i in range(width)], axis=1), group, len(names), finite)
            for g, name in enumerate(names):
                mine = tuple(x[g] for x in found)
                held[name] = _merged(held[name], mine) if name in held else mine
                if name not in firsts:
                    firsts[name] = batch.column(1).slice(first[g], 1)
            if len(held) * width >= GROUPS_HELD:
                yield emitted()
                held, firsts = {}, {}
        if held:
            yield emitted()

    parts = keyed.mapInArrow(run, f"__key string, __k {_key_type(keyed)}, pos int, rows bigint, seen bigint, n bigint, "
                                  "mean double, m2 double, low double, high double")
    # The common mean comes first, so that squared deviations merge without cancellation; both steps share one shuffle.
    whole = Window.partitionBy("__key", "pos")
    centred = parts.withColumn("__mean", F.try_divide(F.sum(F.col("n") * F.col("mean")).over(whole), F.sum("n").over(whole)))
    some = F.sum("n") > 0
    merged = centred.groupBy("__key", "pos").agg(
        F.any_value("__k").alias("__k"), F.sum("rows").alias("row_count"), F.sum("seen").alias("seen_count"),
        F.sum("n").alias("value_count"), F.when(some, F.any_value("__mean")).alias("mean"),
        F.when(some, F.sum(F.col("m2") + F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("mean") - F.col("__mean"), 2)).otherwise(0.0)))
        .alias("m2"), F.min("low").alias("minimum"), F.max("high").alias("maximum"))
    return _named(merged, columns, keys, "row_count", "seen_count", "value_count", "mean", "m2", "minimum", "maximum")


# -- bins --------------------------------------------------------------------------------------------

def column_bins(df: DataFrame, inner: dict[str, Sequence[float]], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, feature, bin, n``: finite numbers per bin; a bin's number is how many inner edges are not above it."""
    columns, keys = list(inner), list(keys)
    keyed = _keyed(df, columns, keys)
    edges = [np.sort(np.asarray(inner[c], dtype=np.float64)) for c in columns]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            names, first, group = _groups(batch)
            for pos, mine in enumerate(edges):
                x = _numbers(batch, pos)
                used = np.isfinite(x)
                slots = len(mine) + 1
                counts = np.bincount(group[used] * slots + np.searchsorted(mine, x[used], "right"), minlength=len(names) * slots)
                at = np.flatnonzero(counts)
                own = pa.array(at // slots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()).take(own), batch.column(1).take(pa.array(first)).take(own),
                     pa.array(np.full(len(at), pos, dtype=np.int32)), pa.array((at % slots).astype(np.int32)), pa.array(counts[at])],
                    ["__key", "__k", "pos", "bin", "n"])

    counted = keyed.mapInArrow(run, f"__key string, __k {_key_type(keyed)}, pos int, bin int, n bigint").groupBy(
        "__key", "pos", "bin").agg(F.any_value("__k").alias("__k"), F.sum("n").alias("n"))
    # Without any edge there is no column.
    return _named(counted, columns or [""], keys, "bin", "n")


# -- distinct values ---------------------------------------------------------------------------------

def column_values(df: DataFrame, numeric: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """``feature, bits, text, n``: rows per distinct value of each column.

    A number is named by its 64 bits (-0.0 counts as 0.0), other columns by their text; both
    are null for null and NaN.  Batches count before the shuffle.
    """
    numeric, text = list(numeric), list(text)
    names = [*numeric, *text]

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("pos", pa.int32()), ("bits", pa.int64()), ("text", pa.string()), ("n", pa.int64())])

        def row(pos, bits, texts, counts):
            size = len(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, pos, dtype=np.int32)), bits if bits is not None else pa.nulls(size, pa.int64()),
                 texts.cast(pa.string()) if texts is not None else pa.nulls(size, pa.string()), counts], schema=schema)

        for batch in batches:
            for pos in range(len(names)):
                column = batch.column(pos)
                if pos < len(numeric):
                    x = column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                    known = x[~np.isnan(x)] + 0.0
                    bits, counts = np.unique(known.view(np.int64), return_counts=True)
                    if len(bits):
                        yield row(pos, pa.array(bits), None, pa.array(counts))
                    if len(known) < len(x):
                        yield row(pos, None, None, pa.array([len(x) - len(known)], pa.int64()))
                elif len(column):
                    found = column.value_counts()
                    yield row(pos, None, found.field("values"), found.field("counts"))

    counted = df.select(*[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numeric)],
                        *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(text)]).mapInArrow(
        run, "pos int, bits bigint, text string, n bigint")
    return counted.groupBy("pos", "bits", "text").agg(F.sum("n").alias("n")).select(
        F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1).alias("feature"), "bits", "text", "n")


# -- quantiles ---------------------------------------------------------------------------------------

def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of the doubles; 0.0 and -0.0 are one."""
    bits = (x + 0.0).view(np.int64)
    return (bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ _TOP


def _runs(cell: np.ndarray, x: np.ndarray, shift: int) -> tuple:
    """Counts of the known numbers ``x`` by cell and next bits, with the least and largest of each."""
    order = np.lexsort((x, cell)) if len(cell) and cell.min() < cell.max() else np.argsort(x)
    cell, x = cell[order], x[order] + 0.0
    digit = (_ordered(x) >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)
    edge = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(digit.astype(np.int64), prepend=-1) != 0))
    last = np.append(edge, len(x))[1:] - 1
    return cell[edge], digit[edge].astype(np.int64), last - edge + 1, x[edge], x[last]


def _counted(x: np.ndarray, finite: bool) -> np.ndarray:
    return np.isfinite(x) if finite else ~np.isnan(x)


def _first_pass(keyed: DataFrame, width: int, finite: bool) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            names, first, group = _groups(batch)
            for pos in range(width):
                x = _numbers(batch, pos)
                known = _counted(x, finite)
                at, digit, n, low, high = _runs(group[known].astype(np.int64), x[known], 64 - DIGIT)
                # Every group has a row, with or without numbers.
                size = len(names)
                at = pa.array(np.concatenate([at, np.arange(size)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()).take(at), batch.column(1).take(pa.array(first)).take(at),
                     pa.array(np.full(len(at), pos, dtype=np.int32)), pa.array(np.concatenate([digit, np.full(size, -1)])),
                     pa.array(np.concatenate([n, np.zeros(size, dtype=np.int64)])),
                     pa.array(np.concatenate([low, np.full(size, np.nan)]), from_pandas=True),
                     pa.array(np.concatenate([high, np.full(size, np.nan)]), from_pandas=True)],
                    ["__key", "__k", "pos", "digit", "n", "low", "high"])

    return keyed.mapInArrow(run, f"__key string, __k {_key_type(keyed)}, pos int, digit bigint, n bigint, low double, high double")


def _next_pass(keyed: DataFrame, cells: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]], level: int,
               finite: bool) -> DataFrame:
    """Counts under the wanted prefixes: ``cells`` gives sorted prefixes and cell numbers per group and column."""
    held = keyed.sparkSession.sparkContext.broadcast(cells)
    above, shift = np.uint64(64 - DIGIT * level), 64 - DIGIT * (level + 1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            names, _, group = _groups(batch)
            for g, name in enumerate(names):
                mine = held.value.get(name)
                rows = np.flatnonzero(group == g) if mine else ()
                for pos, (prefixes, numbers) in (mine or {}).items():
                    x = _numbers(batch, pos)[rows]
                    x = x[_counted(x, finite)]
                    own = _ordered(x) >> above
                    place = np.searchsorted(prefixes, own)
                    hit = place < len(prefixes)
                    hit[hit] = prefixes[place[hit]] == own[hit]
                    if hit.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c) for c in _runs(numbers[place[hit]], x[hit], shift)], ["cell", "digit", "n", "low", "high"])

    return keyed.mapInArrow(run, "cell bigint, digit bigint, n bigint, low double, high double")


def _settled(found: DataFrame):
    """The number of a rank, where its count decides it."""
    return (F.when((F.col("low") == F.col("high")) | (F.col("rank") == F.col("before")), F.col("low"))
            .when(F.col("rank") == F.col("before") + F.col("n") - 1, F.col("high")))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (),
                     name: str = "quantiles", stored: bool = False, finite: bool = False) -> DataFrame:
    """Per ``(keys, feature)`` the exact, linearly interpolated quantiles as an array; null without numbers.

    Null and NaN are no numbers; infinities are, unless only ``finite`` ones count.  Groups are the distinct ``keys``, of any
    number.  Each pass reads ``df``: unless it is ``stored`` already, the columns that matter
    are written once.
    """
    columns, keys, probs = list(columns), list(keys), [float(p) for p in probs]
    spark = df.sparkSession
    with scratch_scope(spark) as keep:
        source = df if stored else cut_lineage(df.select(*dict.fromkeys([*keys, *columns])))
        keyed = _keyed(source, columns, keys)
        positions = F.transform(F.array(*map(F.lit, probs)), lambda p: (F.col("total") - 1) * p)
        ranks = F.array_distinct(F.flatten(F.transform(positions, lambda x: F.array(F.floor(x), F.ceil(x)))))
        # At most 65,536 counts per group and column.
        whole = Window.partitionBy("__key", "pos")
        counts = _first_pass(keyed, len(columns), finite).groupBy("__key", "pos", "digit").agg(
            F.any_value("__k").alias("__k"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        placed = counts.select("*", F.sum("n").over(whole).alias("total"),
                               (F.sum("n").over(whole.orderBy("digit")) - F.col("n")).alias("before"))
        mine = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
        found = placed.select(
            "__key", "__k", "pos", "total", F.explode_outer(F.when(F.col("total") > 0, mine)).alias("rank"),
            F.col("digit").alias("prefix"), "before", "n", "low", "high").where("rank is not null or total = 0")
        shown = ["__key", "__k", "pos", "total", "rank"]
        parts = []
        state = cut_lineage(found)
        for level in range(1, 64 // DIGIT + 1):
            parts.append(state.where(_settled(state).isNotNull() | F.col("rank").isNull()).select(*shown, _settled(state).alias("value")))
            open_ranks = state.where("rank is not null").where(_settled(state).isNull())
            size = open_ranks.count()
            if not size:
                break
            steps = -(-size // CELLS_AT_ONCE)
            refined = []
            for step in range(steps):
                # Bounded by CELLS_AT_ONCE, up to the evenness of the hash.
                rows = open_ranks.where(F.pmod(F.xxhash64("__key", "pos"), F.lit(steps)) == step).select(
                    *shown, "prefix", "before").collect()
                refined.append(_refined(keyed, rows, state.schema, level, finite))
            state = refined[0]
            for more in refined[1:]:
                state = state.unionByName(more)
            state = cut_lineage(state)
        settled = parts[0]
        for more in parts[1:]:
            settled = settled.unionByName(more)
        by_rank = settled.groupBy("__key", "pos").agg(
            F.any_value("__k").alias("__k"), F.max("total").alias("total"),
            F.map_from_entries(F.collect_set(F.when(F.col("rank").isNotNull(), F.struct("rank", "value")))).alias("at"))

        def between(x):
            low, high = F.floor(x), F.ceil(x)
            a, b = F.element_at("at", low), F.element_at("at", high)
            return F.when((low == high) | (a == b), a).otherwise((high - x) * a + (x - low) * b)

        return keep(_named(by_rank, columns, keys, F.when(F.col("total") > 0, F.transform(positions, between)).alias(name)))


def _refined(keyed: DataFrame, rows: list, schema: T.StructType, level: int, finite: bool) -> DataFrame:
    """Where the wanted ranks of ``rows`` lie among the counts by the next bits."""
    spark = keyed.sparkSession
    numbers: dict[tuple, int] = {}
    for r in rows:
        numbers.setdefault((r["__key"], r["pos"], r["prefix"]), len(numbers))
    grouped: dict[str, dict[int, list]] = {}
    for (key, pos, prefix), cell in numbers.items():
        grouped.setdefault(key, {}).setdefault(pos, []).append((prefix % (1 << 64), cell))
    cells = {key: {pos: tuple(np.array(x, dtype=kind) for x, kind in zip(zip(*sorted(found)), (np.uint64, np.int64)))
                   for pos, found in mine.items()} for key, mine in grouped.items()}
    wanted = spark.createDataFrame(
        [(numbers[r["__key"], r["pos"], r["prefix"]], r["__key"], r["__k"], r["pos"], r["total"], r["rank"], r["prefix"], r["before"])
         for r in rows],
        T.StructType([T.StructField("cell", T.LongType()), *[schema[c] for c in ("__key", "__k", "pos", "total", "rank", "prefix", "before")]]))
    counts = _next_pass(keyed, cells, level, finite).groupBy("cell", "digit").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    within = counts.withColumn("__under", F.sum("n").over(Window.partitionBy("cell").orderBy("digit")) - F.col("n"))
    offset = F.col("rank") - F.col("before") - F.col("__under")
    return within.join(F.broadcast(wanted), "cell").where((offset >= 0) & (offset < F.col("n"))).select(
        "__key", "__k", "pos", "total", "rank",
        F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit")).alias("prefix"),
        (F.col("before") + F.col("__under")).alias("before"), "n", "low", "high")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "quantiles") -> DataFrame:
    """Exact quantiles of one column per key, as in ``column_quantiles``."""
    return column_quantiles(df, [value], probs, keys, name).drop("feature") if "feature" not in keys else (
        column_quantiles(df.withColumnRenamed("feature", "__feature"), [value], probs,
                         ["__feature" if k == "feature" else k for k in keys], name)
        .drop("feature").withColumnRenamed("__feature", "feature"))
