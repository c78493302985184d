"""Duplicate and conflict audits, lot groups over shared maps, and group splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dies import CLASS_NAMES
from ..functions.scalars import ratio
from ..profile import ContractError
from ..scale import cut_lineage, lookup_join, running_sum, scratch_scope

SPLITS = ("train", "validation", "test")
CLASSES = len(CLASS_NAMES)
CONTRACTED_EDGES = 500_000  # edges that one task may join


@dataclass(frozen=True)
class GroupSplitConfig:
    """Fixed values of the group split protocol."""

    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)
    seed: int = 42
    candidates: int = 32
    max_group_ratio: float = 0.2
    rare_class_warning: int = 10
    exchange_rounds: int = 20
    exchange_offers: int = 48  # groups offered for each pair of splits in a round


def map_hash_counts(manifest: DataFrame) -> DataFrame:
    """Rows and distinct explicit labels per map hash (two-level aggregation, hot hashes combine first)."""
    per_label = manifest.where("map_hash is not null").groupBy("map_hash", "class_index").agg(
        F.count(F.lit(1)).alias("n"))
    return per_label.groupBy("map_hash").agg(F.sum("n").alias("n"), F.count("class_index").alias("labels"))


def conflicting_maps(manifest: DataFrame) -> DataFrame:
    """Hashes that carry more than one explicit label, with their row count."""
    return map_hash_counts(manifest).where("labels > 1").select("map_hash", F.col("n").alias("conflict_rows"))


def without_conflicts(manifest: DataFrame) -> DataFrame:
    """Drop every row of a conflicting map, labeled or not; rows without a hash stay."""
    marked = lookup_join(manifest, conflicting_maps(manifest), "map_hash", "conflict_rows")
    return marked.where("conflict_rows is null").select(*manifest.columns)


def _star_edges(active: DataFrame) -> DataFrame:
    """Edges from each lot to the smallest lot that shares one of its maps."""
    pairs = active.where("map_hash is not null and lot_id is not null").select("map_hash", "lot_id").distinct()
    firsts = pairs.groupBy("map_hash").agg(F.min("lot_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = firsts.where("n > 1")
    return lookup_join(pairs, shared, "map_hash", "n").where("first <> lot_id").select(
        F.col("lot_id").alias("u"), F.col("first").alias("v")).distinct()


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return lookup_join(both.where("v > u"), least, "u", "n", 2 * size).where("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = lookup_join(down, least, "u", "n", 2 * size).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _contracted(edges: DataFrame, held: int) -> DataFrame:
    """The edges with each task's own components replaced by stars around their smallest members.

    A task joins about ``held`` nodes at a time by union-find, so edges between tasks alone
    are left to the rounds.
    """
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        parent: dict = {}

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        def stars(types):
            found = [(x, r) for x in list(parent) if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], ["u", "v"])

        types = None
        for batch in batches:
            types = [c.type for c in batch.columns]
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) >= held:
                yield stars(types)
                parent = {}
        if parent:
            yield stars(types)

    return edges.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest member of each node's component as ``(u, v)`` rows, for nodes other than that member.

    Each round contracts the edges within tasks and then, over all tasks, by a large-star and
    a small-star step; the number of rounds grows with the logarithm of the graph at most.
    Once a task may hold all edges that are left, its contraction is the result.  No neighbour
    list is ever collected; each round is written to the checkpoint folder.
    """
    def state_of(table: DataFrame):
        return table.agg(F.count(F.lit(1)).alias("n"),
                         F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    with scratch_scope(edges.sparkSession) as keep:
        current = cut_lineage(edges)
        mark = state_of(current)
        for _ in range(max_rounds):
            if not mark.n:
                return keep(current)
            if mark.n <= CONTRACTED_EDGES:
                return keep(_contracted(current.coalesce(1), 2 * CONTRACTED_EDGES))
            # No step adds edges, so the edge count bounds its tables of nodes.
            local = cut_lineage(_contracted(current, CONTRACTED_EDGES))
            current = cut_lineage(_small_star(_large_star(local, mark.n), mark.n))
            state = state_of(current)
            if state == mark:
                return keep(current)
            mark = state
    raise RuntimeError("connected groups did not converge")


def lot_groups(active: DataFrame) -> DataFrame:
    """``(lot_id, gid)``: lots joined when they share a map; ids follow the smallest lot name."""
    # Written once: what ``active`` derives from maps is read for lots, pairs and firsts.
    active = cut_lineage(active.select("lot_id", "map_hash").distinct())
    lots = active.where("lot_id is not null").select("lot_id").distinct()
    roots = connected(_star_edges(active)).select(F.col("u").alias("lot_id"), F.col("v").alias("root"))
    named = lots.join(roots, "lot_id", "left").withColumn("root", F.coalesce("root", "lot_id"))
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("lots"), F.lit(1).cast("bigint").alias("one"))
    numbered = running_sum(sizes, [F.col("root")], ["one"]).select(
        "root", "lots", (F.col("cum_one") - 1).alias("gid"))
    return lookup_join(named, numbered, "root", "lots").select("lot_id", "gid")


def _with_groups(active: DataFrame, groups: DataFrame) -> DataFrame:
    """Attach the group of each row's lot; a lot with a third of the rows does not skew the join."""
    sizes = active.where("lot_id is not null").groupBy("lot_id").agg(F.count(F.lit(1)).alias("lot_rows"))
    return lookup_join(active, groups.join(sizes, "lot_id"), "lot_id", "lot_rows")


def group_class_counts(active: DataFrame, groups: DataFrame) -> DataFrame:
    """Accepted labeled rows per (gid, class_index), counted per lot before the join."""
    per_lot = active.where("quality_status = 'accepted' and class_index is not null and lot_id is not null").groupBy(
        "lot_id", "class_index").agg(F.count(F.lit(1)).alias("n"))
    return per_lot.join(groups, "lot_id").groupBy("gid", "class_index").agg(F.sum("n").alias("n"))


def duplicate_audit(manifest: DataFrame) -> DataFrame:
    """One row: repeated maps, label conflicts and wafer ids with two maps or labels."""
    maps = map_hash_counts(manifest).agg(
        F.count_if(F.col("n") > 1).alias("duplicate_map_groups"), F.count_if(F.col("labels") > 1).alias("map_label_conflicts"))
    wafers = manifest.where("lot_id is not null and wafer_index is not null").groupBy("lot_id", "wafer_index").agg(
        (F.min("map_hash") != F.max("map_hash")).alias("h"), (F.min("class_index") != F.max("class_index")).alias("c"))
    ids = wafers.agg(F.count_if(F.col("h") | F.col("c")).alias("wafer_id_conflicts"))
    return maps.crossJoin(F.broadcast(ids))


def class_group_support(counts: DataFrame) -> DataFrame:
    """Independent groups per class, all nine classes listed."""
    spark = counts.sparkSession
    classes = spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_index int, pattern_label string")
    found = counts.groupBy("class_index").agg(F.count_distinct("gid").alias("groups"), F.sum("n").alias("samples"))
    return classes.join(found, "class_index", "left").select(
        "class_index", "pattern_label", F.coalesce("groups", F.lit(0)).alias("groups"),
        F.coalesce("samples", F.lit(0)).alias("samples"))


def split_feasibility(audit: DataFrame, counts: DataFrame, max_group_ratio: float = 0.2) -> DataFrame:
    """One row per named review check with its result."""
    sizes = counts.groupBy("gid").agg(F.sum("n").alias("n")).agg(
        F.coalesce(ratio(F.max("n"), F.sum("n")), F.lit(0.0)).alias("largest_group_ratio"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    support = class_group_support(counts).agg(F.min("groups").alias("fewest_groups"), F.max("groups").alias("most_groups"))
    one = audit.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(support))
    checks = F.array(*[
        F.struct(F.lit(code).alias("code"), passed.alias("passed")) for code, passed in (
            ("MAP_LABEL_CONFLICT", F.col("map_label_conflicts") == 0),
            ("WAFER_ID_CONFLICT", F.col("wafer_id_conflicts") == 0),
            ("NO_LABELED_GROUPS", F.col("most_groups") > 0),
            ("INSUFFICIENT_CLASS_GROUPS", F.col("fewest_groups") >= 3),
            ("LARGE_CONNECTED_GROUP", F.col("largest_group_ratio") <= max_group_ratio))])
    return one.select("largest_group_ratio", F.inline(checks))


def _matrix(counts: DataFrame) -> DataFrame:
    """One row per group: class counts as an array, size and the class it is rarest in."""
    totals = counts.groupBy("class_index").agg(F.sum("n").alias("total"))
    # Nine rows, so the broadcast is bounded.
    shares = counts.join(F.broadcast(totals), "class_index")
    cells = [F.coalesce(F.sum(F.when(F.col("class_index") == c, F.col("n"))), F.lit(0)).alias(f"c{c}") for c in range(CLASSES)]
    return shares.groupBy("gid").agg(
        F.sum("n").alias("size"), F.min_by("class_index", F.struct("total", "class_index")).alias("rare"), *cells)


def assignment_bands(counts: DataFrame, config: GroupSplitConfig) -> DataFrame:
    """Every candidate's split per group by bands of cumulative size: ``(candidate, gid, slot, c0..c8)``.

    Within its rarest class a group's place is a seeded hash, and its middle on the way
    through the rows of these groups falls into the band of a split.
    """
    groups = cut_lineage(_matrix(counts)).withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(config.candidates - 1))))
    ordered = groups.withColumn("h", F.md5(F.concat_ws(
        "|", F.lit(str(config.seed)), F.col("candidate").cast("string"), F.col("gid").cast("string"))))
    placed = running_sum(ordered, [F.col("h"), F.col("gid")], ["size"], ["candidate", "rare"])
    totals = ordered.groupBy("candidate", "rare").agg(F.sum("size").alias("class_size"))
    placed = placed.join(F.broadcast(totals), ["candidate", "rare"])  # candidates x classes rows
    middle = (F.col("cum_size") - F.col("size") / 2) / F.col("class_size")
    a, b, _ = config.ratios
    slot = F.when(middle < a, 0).when(middle < a + b, 1).otherwise(2)
    return placed.select("candidate", "gid", slot.cast("int").alias("slot"), *[f"c{c}" for c in range(CLASSES)])


def coverage_seeds(counts: DataFrame) -> dict[int, int]:
    """Groups that give every split every class, as ``{gid: slot}``; an error when no assignment can.

    Each class offers its 27 smallest groups (three for each class are enough: what the other
    classes may take of them still leaves three), so at most 243 groups reach the driver.
    """
    offered = Window.partitionBy("class_index").orderBy("size", "gid")
    sized = counts.join(counts.groupBy("gid").agg(F.sum("n").alias("size")), "gid")
    core = sized.where("n > 0").withColumn("place", F.row_number().over(offered)).where(
        F.col("place") <= len(SPLITS) * CLASSES).select("gid").distinct()
    rows = sized.join(F.broadcast(core), "gid").where("n > 0").groupBy("gid", "size").agg(
        F.expr("sum(shiftleft(1L, cast(class_index as int)))").alias("mask")).orderBy("size", "gid").collect()
    found = cover([(r["gid"], r["mask"]) for r in rows])
    if found is None:
        raise ContractError("NO_FEASIBLE_SPLIT_CANDIDATE")
    return found


def cover(groups: list[tuple[int, int]]) -> dict[int, int] | None:
    """Assign some groups to three splits so that each split meets all classes; None when impossible.

    ``groups`` are ``(gid, bit mask of classes)`` in order of preference.  Groups of equal
    masks stand for each other, the scarcest class is served first, and states that failed
    are not entered again: the search is exhaustive.
    """
    pools: dict[int, list[int]] = {}
    for gid, mask in groups:
        pools.setdefault(mask, []).append(gid)
    masks = list(pools)
    whole = (1 << CLASSES) - 1
    failed: set[tuple] = set()

    def search(left: tuple[int, ...], covered: tuple[int, ...]) -> list[tuple[int, int]] | None:
        if all(c == whole for c in covered):
            return []
        state = (left, tuple(sorted(covered)))
        if state in failed:
            return None
        scarce = None
        for k in range(CLASSES):
            needed = sum(not c >> k & 1 for c in covered)
            if needed:
                spare = sum(n for n, m in zip(left, masks) if m >> k & 1) - needed
                if spare < 0:
                    failed.add(state)
                    return None
                if scarce is None or spare < scarce[0]:
                    scarce = (spare, k)
        k = scarce[1]
        slot = next(s for s in range(len(covered)) if not covered[s] >> k & 1)
        options = [i for i, (n, m) in enumerate(zip(left, masks)) if n and m >> k & 1]
        for i in sorted(options, key=lambda i: -(masks[i] & ~covered[slot]).bit_count()):
            after = search(tuple(n - (j == i) for j, n in enumerate(left)),
                           tuple(c | masks[i] if s == slot else c for s, c in enumerate(covered)))
            if after is not None:
                return [(i, slot), *after]
        failed.add(state)
        return None

    found = search(tuple(len(pools[m]) for m in masks), (0,) * len(SPLITS))
    if found is None:
        return None
    taken = {m: iter(pools[m]) for m in masks}
    return {next(taken[masks[i]]): slot for i, slot in found}


def _with_slots(assigned: DataFrame, slots: dict[int, int]) -> DataFrame:
    """Replace the slots of the listed groups; the list is bounded by its makers."""
    if not slots:
        return assigned
    new = assigned.sparkSession.createDataFrame(sorted(slots.items()), "gid long, __slot int").withColumn(
        "gid", F.col("gid").cast(assigned.schema["gid"].dataType))
    return assigned.join(F.broadcast(new), "gid", "left").withColumn("slot", F.coalesce("__slot", "slot")).select(*assigned.columns)


def assignment_candidates(counts: DataFrame, config: GroupSplitConfig) -> DataFrame:
    """All candidates with the groups that give every split every class: ``(candidate, gid, slot, c0..c8)``."""
    return _with_slots(assignment_bands(counts, config), coverage_seeds(counts))


def split_objective(matrix: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Squared share errors of rows plus their mean over classes, of one or many split x class tables of counts."""
    sizes = matrix.sum(axis=-1)
    of_rows = ((sizes / sizes.sum(axis=-1, keepdims=True) - ratios) ** 2).sum(axis=-1)
    of_classes = ((matrix / matrix.sum(axis=-2, keepdims=True) - ratios[:, None]) ** 2).sum(axis=(-1, -2))
    return of_rows + of_classes / CLASSES


def _moved(matrix: np.ndarray, change: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Tables after each row of ``change`` went from its source to its target split."""
    tables = np.repeat(matrix[None].astype(np.int64), len(change), axis=0)
    at = np.arange(len(change))
    tables[at, source] -= change
    tables[at, target] += change
    return tables


def _best_moves(assigned: DataFrame, matrix: np.ndarray, config: GroupSplitConfig) -> list:
    """For every pair of splits the groups whose move changes the objective best, few enough for the driver."""
    ratios, kept = np.array(config.ratios), config.exchange_offers

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            gid, slot = batch.column(0), batch.column(1).to_numpy()
            counts = np.stack([batch.column(i + 2).to_numpy() for i in range(CLASSES)], axis=1)
            for source in range(len(SPLITS)):
                mine = np.flatnonzero(slot == source)
                for target in range(len(SPLITS)):
                    if source == target or not len(mine):
                        continue
                    after = split_objective(_moved(matrix, counts[mine], np.full(len(mine), source), np.full(len(mine), target)), ratios)
                    first = np.lexsort((gid.to_numpy()[mine], after))[:kept]
                    rows = pa.array(mine[first])
                    yield pa.RecordBatch.from_arrays(
                        [gid.take(rows), pa.array(np.full(len(first), source, dtype=np.int32)),
                         pa.array(np.full(len(first), target, dtype=np.int32)), pa.array(after[first]),
                         *[batch.column(i + 2).take(rows) for i in range(CLASSES)]],
                        ["gid", "source", "target", "after", *[f"c{c}" for c in range(CLASSES)]])

    columns = ", ".join(f"c{c} bigint" for c in range(CLASSES))
    found = assigned.select(F.col("gid").cast("bigint").alias("gid"), "slot", *[f"c{c}" for c in range(CLASSES)]).mapInArrow(
        run, f"gid bigint, source int, target int, after double, {columns}")
    best = Window.partitionBy("source", "target").orderBy("after", "gid")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= kept).orderBy(
        "source", "target", "place").collect()


def _exchange(offers: list, matrix: np.ndarray, config: GroupSplitConfig) -> tuple[dict[int, int], np.ndarray]:
    """Apply the best moves and swaps of offered groups, one after the other, while the objective falls.

    A step that would take a class away from a split is not made.
    """
    ratios = np.array(config.ratios)
    gid = np.array([r["gid"] for r in offers], dtype=np.int64)
    source = np.array([r["source"] for r in offers], dtype=np.int64)
    target = np.array([r["target"] for r in offers], dtype=np.int64)
    counts = np.array([[r[f"c{c}"] for c in range(CLASSES)] for r in offers], dtype=np.int64).reshape(-1, CLASSES)
    # Two groups that change places are one step; a single move pairs with nothing.
    first, second = np.nonzero((source[:, None] == target[None]) & (target[:, None] == source[None]) & (source[:, None] < target[:, None]))
    first, second = np.concatenate([np.arange(len(gid)), first]), np.concatenate([np.full(len(gid), -1), second])
    change = counts[first] - np.where(second[:, None] >= 0, counts[second], 0)
    done: dict[int, int] = {}
    current = float(split_objective(matrix, ratios))
    open_ = np.ones(len(first), dtype=bool)
    while open_.any():
        at = np.flatnonzero(open_)
        tables = _moved(matrix, change[at], source[first[at]], target[first[at]])
        after = np.where((tables > 0).all(axis=(1, 2)), split_objective(tables, ratios), np.inf)
        best = int(np.argmin(after))
        if not after[best] < current - 1e-12:
            break
        matrix, current, step = tables[best], float(after[best]), at[best]
        for i in (first[step], second[step]):
            if i >= 0:
                done[int(gid[i])] = int(target[i])
                open_ &= (gid[first] != gid[i]) & ((second < 0) | (gid[second] != gid[i]))
    return done, matrix


def candidate_scores(assigned: DataFrame, config: GroupSplitConfig) -> DataFrame:
    """Objective and class coverage per candidate: squared share errors of rows plus the class mean."""
    sums = assigned.groupBy("candidate", "slot").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(CLASSES)])
    cells = sums.select("candidate", "slot", F.posexplode(F.array(*[f"c{c}" for c in range(CLASSES)])).alias("k", "n"))
    # At most candidates x 3 x 9 rows from here on.
    grid = cells.select("candidate").distinct().select(
        "candidate", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot")).select(
        "candidate", "slot", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))).alias("k"))
    full = grid.join(cells, ["candidate", "slot", "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_class = Window.partitionBy("candidate", "k")
    target = F.element_at(F.array(*map(F.lit, config.ratios)), F.col("slot") + 1)
    full = full.withColumn("target", target).withColumn("class_total", F.sum("n").over(of_class))
    class_error = F.pow(ratio(F.col("n"), F.col("class_total")) - F.col("target"), 2)
    per_slot = full.groupBy("candidate", "slot").agg(
        F.sum("n").alias("n"), F.max("target").alias("target"), F.sum(class_error).alias("class_error"),
        F.min(F.when(F.col("n") > 0, 1).otherwise(0)).alias("covered"))
    whole = F.sum("n").over(Window.partitionBy("candidate"))
    per_slot = per_slot.withColumn("size_error", F.pow(ratio(F.col("n"), whole) - F.col("target"), 2))
    return per_slot.groupBy("candidate").agg(
        F.round(F.sum("size_error") + F.sum("class_error") / CLASSES, 12).alias("objective"),
        (F.min("covered") == 1).alias("all_classes_present"))


@dataclass(frozen=True)
class Assignment:
    """``groups`` holds ``(gid, split)``; the tables count rows per split and class."""

    groups: DataFrame
    candidate: int
    seeded: np.ndarray
    final: np.ndarray


def improve_assignment(counts: DataFrame, config: GroupSplitConfig | None = None) -> Assignment:
    """The best candidate that covers every class, after rounds of moves and swaps.

    Every candidate holds the coverage seeds, so one is found whenever any assignment covers
    all classes.  A round scores every group's move in parallel; of the best offers for each
    pair of splits the driver applies those that lower the objective.  No step breaks
    coverage, and the rounds end when no offer helps.
    """
    config = config or GroupSplitConfig()
    counts = cut_lineage(counts)
    support = class_group_support(counts).agg(F.min("groups").alias("g"), F.min("samples").alias("s")).first()
    if support.g < 3 or support.s <= 0:
        raise ContractError("INSUFFICIENT_CLASS_GROUPS")
    candidates = cut_lineage(assignment_candidates(counts, config))
    best = candidate_scores(candidates, config).where("all_classes_present").agg(
        F.min_by("candidate", F.struct("objective", "candidate")).alias("c")).first().c
    assigned = cut_lineage(candidates.where(F.col("candidate") == best).drop("candidate"))
    matrix = np.zeros((len(SPLITS), CLASSES), dtype=np.int64)
    for r in assigned.groupBy("slot").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(CLASSES)]).collect():
        matrix[r["slot"]] = [r[f"c{c}"] for c in range(CLASSES)]
    seeded, slots = matrix, {}
    for _ in range(config.exchange_rounds):
        moved, matrix = _exchange(_best_moves(_with_slots(assigned, slots), matrix, config), matrix, config)
        if not moved:
            break
        slots |= moved
    names = F.array(*map(F.lit, SPLITS))
    groups = _with_slots(assigned, slots).select("gid", F.element_at(names, F.col("slot") + 1).alias("split"))
    return Assignment(groups, best, seeded, matrix)


def choose_assignment(counts: DataFrame, config: GroupSplitConfig | None = None) -> DataFrame:
    """``(gid, split)`` as ``improve_assignment`` finds it."""
    return improve_assignment(counts, config).groups


def assignment_overlap(active: DataFrame, groups: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row: lots and map hashes that reach two splits; both must be zero."""
    rows = _with_groups(active, groups.join(assignment, "gid").select("lot_id", "split")
                        .withColumnRenamed("split", "group_split"))

    def spread(key: str):
        per = rows.where(F.col(key).isNotNull() & F.col("group_split").isNotNull()).groupBy(key).agg(
            F.min("group_split").alias("lo"), F.max("group_split").alias("hi"))
        return per.agg(F.count_if(F.col("lo") != F.col("hi")).alias(f"{key}_overlap"))

    return spread("lot_id").crossJoin(F.broadcast(spread("map_hash")))


def split_manifest(manifest: DataFrame, groups: DataFrame, assignment: DataFrame, protocol: str) -> DataFrame:
    """Every source row with group id, group split, exclusion reasons and final split."""
    lots = groups.join(assignment.withColumnRenamed("split", "group_split"), "gid", "left")
    rows = lookup_join(_with_groups(manifest, lots), conflicting_maps(manifest), "map_hash", "conflict_rows")
    clash = F.col("conflict_rows").isNotNull()
    return rows.select(
        *[c for c in manifest.columns if c != "split"],
        F.col("split").alias("source_split"), F.lit(protocol).alias("split_protocol_id"),
        F.when(~clash & F.col("gid").isNotNull(), F.concat(F.lit("group_"), F.lpad(F.col("gid").cast("string"), 8, "0")))
        .alias("split_group_id"),
        F.when(~clash, F.col("group_split")).alias("group_split"),
        F.when(clash, F.array(F.lit("MAP_LABEL_CONFLICT"))).otherwise(F.expr("cast(array() as array<string>)"))
        .alias("exclusion_reasons"),
        F.when(clash | (F.col("quality_status") != "accepted"), "quarantined")
        .when(F.col("label_status") != "labeled", "unlabeled").otherwise(F.col("group_split")).alias("split"))


def split_summary(split_rows: DataFrame, warn_below: int = 10) -> DataFrame:
    """Samples per (split, class), split size and share, and a warning for rare classes outside Train."""
    spark = split_rows.sparkSession
    grid = spark.createDataFrame(
        [(s, i, n) for s in SPLITS for i, n in enumerate(CLASS_NAMES)], "split string, class_index int, pattern_label string")
    found = split_rows.where(F.col("split").isin(*SPLITS)).groupBy("split", "class_index").agg(F.count(F.lit(1)).alias("samples"))
    full = grid.join(found, ["split", "class_index"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    size = F.sum("samples").over(Window.partitionBy("split"))
    # 27 rows: three splits by nine classes.
    everything = F.sum("samples").over(Window.partitionBy(F.lit(1)))
    return full.select("split", "class_index", "pattern_label", "samples", size.alias("split_samples"),
                       ratio(size, everything).alias("split_ratio"),
                       ((F.col("split") != "train") & (F.col("samples") < warn_below)).alias("rare_warning"))


def split_manifest_violations(derived: DataFrame, manifest: DataFrame, protocol: str) -> DataFrame:
    """Rows per audit code of a derived manifest: changed source rows, policy breaks, partly assigned groups."""
    stated = [c for c in manifest.columns if c not in ("map", "split")]
    source = manifest.select("sample_id", F.xxhash64(*[c for c in stated if c != "sample_id"]).alias("__source"))
    mine = derived.withColumn("__mine", F.xxhash64(*[c for c in stated if c != "sample_id"]))
    # sample_id is unique, so this join has no hot key.
    both = mine.join(source, "sample_id", "full_outer")
    clash = F.size("exclusion_reasons") > 0
    expected = F.when(clash | (F.col("quality_status") != "accepted"), "quarantined").when(
        F.col("label_status") != "labeled", "unlabeled").otherwise(F.col("group_split"))
    codes = F.array_compact(F.array(
        F.when(~F.col("__mine").eqNullSafe(F.col("__source")), "SOURCE_ROW_CHANGED"),
        F.when(~F.col("split_protocol_id").eqNullSafe(F.lit(protocol)), "PROTOCOL_MISMATCH"),
        F.when(~F.col("split").eqNullSafe(expected), "SPLIT_POLICY_MISMATCH"),
        F.when(clash & (F.col("group_split").isNotNull() | F.col("split_group_id").isNotNull()), "EXCLUDED_ROW_ASSIGNED")))
    per_row = both.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("rows"))
    active = derived.where(~clash)
    for key in ("split_group_id", "lot_id", "map_hash"):
        mixed = active.where(F.col(key).isNotNull() & F.col("group_split").isNotNull()).groupBy(key).agg(
            F.min("group_split").alias("lo"), F.max("group_split").alias("hi")).where("lo <> hi")
        per_row = per_row.unionByName(mixed.agg(F.count(F.lit(1)).alias("rows")).where("rows > 0").select(
            F.lit(f"SPLIT_{key.upper()}_OVERLAP").alias("code"), "rows"))
    return per_row


def exclusion_comparison(manifest: DataFrame) -> DataFrame:
    """Per class: samples, lots and groups before and after dropping conflicting maps, without changing data."""
    manifest = cut_lineage(manifest.select("lot_id", "map_hash", "class_index", "quality_status"))

    def side(rows: DataFrame, tag: str) -> DataFrame:
        counted = class_group_support(group_class_counts(rows, lot_groups(rows)))
        lots = rows.where("quality_status = 'accepted' and class_index is not null").groupBy("class_index").agg(
            F.count(F.lit(1)).alias("samples"), F.count_distinct("lot_id").alias("lots"))
        return counted.drop("samples").join(lots, "class_index", "left").select(
            "class_index", "pattern_label", F.coalesce("samples", F.lit(0)).alias(f"samples_{tag}"),
            F.coalesce("lots", F.lit(0)).alias(f"lots_{tag}"), F.col("groups").alias(f"groups_{tag}"),
            (F.col("groups") >= 3).alias(f"minimum_groups_met_{tag}"))

    before, after = side(manifest, "before"), side(without_conflicts(manifest), "after")
    return before.join(after, ["class_index", "pattern_label"]).withColumn(
        "excluded_labeled_samples", F.col("samples_before") - F.col("samples_after"))
