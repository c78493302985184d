"""Near-duplicate embeddings through a forest of random-projection trees.

Each tree splits the vectors again and again at the median of a random projection; those
near a split go to both sides.  The splits are fitted on a bounded sample, and every
vector is routed through every tree.  Vectors are compared within leaves only; a leaf with
more rows than planned is compared in square tiles that spread over tasks.  Leaves yield
no pair lists but star edges, which connect the same vectors; within the components that
follow, direct links are counted exactly, again in tiles.

Equal vectors are one class, represented by the smallest id, before anything is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldlake.scale import cut_lineage, lookup_join, scratch_scope
from yieldlake.wafer.groups import connected


@dataclass(frozen=True)
class ForestOptions:
    threshold: float = 0.9
    trees: int = 12
    leaf_rows: int = 512  # planned size of a leaf, and of a tile's side
    spill: float = 0.06  # share of a node's vectors on each side of a split that go both ways
    sample_rows: int = 50_000  # the fit reads no more vectors than these
    least_sample: int = 8  # a node with fewer sampled vectors is not split
    seed: int = 5


@dataclass
class Node:
    """A split at ``low``..``high`` along one direction, or a leaf with a number."""

    leaf: int = -1
    direction: np.ndarray | None = None
    low: float = 0.0
    high: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Tree:
    root: Node
    leaves: int = 0


@dataclass
class Forest:
    """Trees by vector length; a length that the sample lacks has one leaf per tree."""

    options: ForestOptions
    trees: dict[int, list[Tree]] = field(default_factory=dict)


def fit_forest(sample: list[np.ndarray], total: int, options: ForestOptions) -> Forest:
    """Fit on sampled unit vectors of a collection of ``total`` vectors."""
    forest = Forest(options)
    for length in sorted({len(v) for v in sample}):
        own = np.array([v for v in sample if len(v) == length])
        least = max(options.least_sample, int(options.leaf_rows * len(sample) / max(1, total)))
        forest.trees[length] = [_grown(own, least, np.random.default_rng([options.seed, length, t]), options)
                                for t in range(options.trees)]
    return forest


def _grown(vectors: np.ndarray, least: int, rng: np.random.Generator, options: ForestOptions) -> Tree:
    tree = Tree(Node())

    def split(node: Node, rows: np.ndarray) -> None:
        if len(rows) > least:
            direction = rng.normal(size=vectors.shape[1])
            along = vectors[rows] @ direction
            low, high = np.quantile(along, [0.5 - options.spill, 0.5 + options.spill])
            left, right = rows[along <= high], rows[along >= low]
            if max(len(left), len(right)) < 0.9 * len(rows):
                node.direction, node.low, node.high, node.left, node.right = direction, low, high, Node(), Node()
                split(node.left, left)
                split(node.right, right)
                return
        node.leaf, tree.leaves = tree.leaves, tree.leaves + 1

    split(tree.root, np.arange(len(vectors)))
    return tree


def route(tree: Tree, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each reached leaf with the positions of its vectors."""
    waiting = [(tree.root, np.arange(len(vectors)))]
    while waiting:
        node, rows = waiting.pop()
        if not len(rows):
            continue
        if node.direction is None:
            yield node.leaf, rows
        else:
            along = vectors[rows] @ node.direction
            waiting += [(node.left, rows[along <= node.high]), (node.right, rows[along >= node.low])]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def linked_blocks(vectors: np.ndarray, others: np.ndarray, threshold: float, side: int = 512) -> Iterator[tuple[int, int, np.ndarray]]:
    """Matrices of ``cosine >= threshold`` between blocks of rows of both sides, all in double precision."""
    for a in range(0, len(vectors), side):
        for b in range(0, len(others), side):
            yield a, b, vectors[a:a + side] @ others[b:b + side].T >= threshold


def star_edges(ids: np.ndarray, left: np.ndarray, right: np.ndarray, vectors: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges ``(id, smallest connected id)`` that connect what the links between two sets of rows connect."""
    hit = np.zeros((len(left), len(right)), dtype=bool)
    for a, b, found in linked_blocks(vectors[left], vectors[right], threshold):
        hit[a:a + found.shape[0], b:b + found.shape[1]] = found
    label, none = ids.copy(), np.iinfo(np.int64).max
    while True:
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(hit, label[right][None, :], none).min(axis=1, initial=none))
        label[right] = np.minimum(label[right], np.where(hit, label[left][:, None], none).min(axis=0, initial=none))
        if (label == before).all():
            return [(int(a), int(b)) for a, b in zip(ids, label) if a != b]


def _arrays(values: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1).astype(np.float64)


def vector_classes(vectors: DataFrame, key: str, embedding: str) -> tuple[DataFrame, DataFrame, str]:
    """``(rows, classes, kind)``: each row's digest (null where the vector counts for nothing), one
    packed vector per distinct digest with its smallest id and number of rows."""
    kind = "<f4" if "float" in vectors.schema[embedding].dataType.simpleString() else "<f8"

    def pack(batches):
        import pyarrow as pa
        for batch in batches:
            packed, digests = [], []
            for value in batch.column(1).to_pylist():
                array = np.array([] if value is None or None in value else value, dtype=kind)
                good = len(array) and np.isfinite(array).all() and np.isfinite(
                    norm := np.linalg.norm(array.astype(np.float64))) and norm > 0
                raw = (array + 0).tobytes() if good else None  # -0 becomes 0
                packed.append(raw)
                digests.append(md5(raw, usedforsecurity=False).hexdigest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(packed, pa.binary())], ["id", "digest", "packed"])

    rows = cut_lineage(vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v")).mapInArrow(
        pack, "id bigint, digest string, packed binary"))
    totals = rows.where("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    one = rows.join(totals.select(F.col("rep").alias("id"), "digest", "copies"), ["id", "digest"]).dropDuplicates(["id", "digest"])
    return rows.select("id", "digest"), cut_lineage(one.select("digest", "id", "copies", "packed")), kind


def _tiles(table: DataFrame, group: list[str], rows: Column, side: int) -> DataFrame:
    """Deal each group's rows to tiles: ``i, j`` are the blocks that meet, ``block`` is the row's own."""
    blocks = F.ceil(rows / (2 * side)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda o: F.struct(
        F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j")))
    return table.withColumn("__blocks", blocks).withColumn("block", own).withColumn("__tile", F.explode(met)).select(
        *group, "__tile.i", "__tile.j", "block", "id", "copies", "packed")


def _sides(table) -> tuple[np.ndarray, np.ndarray]:
    block, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def forest_edges(classes: DataFrame, kind: str, options: ForestOptions) -> DataFrame:
    """Edges ``(u, v)`` between class ids that connect all links found in leaves."""
    spark = classes.sparkSession
    total = classes.count()
    taken = classes.orderBy(F.xxhash64("id", F.lit(options.seed)), "id").limit(options.sample_rows).select("packed").toPandas()
    sample = [unit(_arrays([bytes(v)], kind))[0] for v in taken["packed"]]
    forest = spark.sparkContext.broadcast(fit_forest(sample, total, options))

    def routed(batches):
        import pyarrow as pa
        for batch in batches:
            values = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in values])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                vectors = unit(_arrays([values[k] for k in at], kind))
                own = forest.value.trees.get(vectors.shape[1]) or [Tree(Node(leaf=0), 1)] * options.trees
                for number, tree in enumerate(own):
                    for leaf, rows in route(tree, vectors):
                        picked = pa.array(at[rows])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(rows), number, np.int32)), pa.array(np.full(len(rows), leaf, np.int32)),
                            pa.array(np.full(len(rows), size, np.int32)),
                            batch.column(0).take(picked), batch.column(1).take(picked), batch.column(2).take(picked),
                        ], ["tree", "leaf", "bytes", "id", "copies", "packed"])

    group = ["tree", "leaf", "bytes"]
    placed = cut_lineage(classes.select("id", "copies", "packed").mapInArrow(
        routed, "tree int, leaf int, bytes int, id bigint, copies bigint, packed binary"))
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("where_", F.concat_ws("|", *group))
    counted = lookup_join(placed.withColumn("where_", F.concat_ws("|", *group)), sizes.select("where_", "rows"), "where_", "rows").where("rows is not null")
    dealt = _tiles(counted, group, F.col("rows"), options.leaf_rows)

    def compare(table):
        import pyarrow as pa
        left, right = _sides(table)
        ids = table.column("id").to_numpy()
        vectors = unit(_arrays(table.column("packed").to_pylist(), kind))
        found = star_edges(ids, left, right, vectors, options.threshold)
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy(*group, "i", "j").applyInArrow(compare, "u bigint, v bigint").distinct()


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding",
                 options: ForestOptions = ForestOptions()) -> DataFrame:
    """Per row: ``(key, n_links, component_id, kept)``.

    ``n_links`` counts the other rows whose cosine, in double precision, reaches the
    threshold, among rows of the component that the leaves found; ``component_id`` is the
    smallest key reachable by links.  A vector that is null, empty or zero, or that holds a
    null or non-finite component, and a row with a null key link with nothing; vectors of
    different length do not link.  Each row counts, also rows that repeat a key.  An empty
    table gives no rows; other columns are not read.
    """
    with scratch_scope(vectors.sparkSession) as keep:
        return keep(_near_vectors(vectors, key, embedding, options))


def _near_vectors(vectors: DataFrame, key: str, embedding: str, options: ForestOptions) -> DataFrame:
    rows, classes, kind = vector_classes(vectors, key, embedding)
    roots = connected(forest_edges(classes, kind, options))
    members = roots.select(F.col("u").alias("id"), F.col("v").alias("root"))
    components = cut_lineage(members.unionByName(members.select(F.col("root").alias("id"), "root")).distinct())
    sizes = components.groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
    grouped = classes.join(lookup_join(components, sizes, "root", "rows"), "id")
    dealt = _tiles(grouped.withColumn("bytes", F.length("packed")), ["root", "bytes"], F.col("rows"), options.leaf_rows)

    def count(table):
        import pyarrow as pa
        left, right = _sides(table)
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        vectors = unit(_arrays(table.column("packed").to_pylist(), kind))
        links = np.zeros(len(ids), np.int64)
        for a, b, hit in linked_blocks(vectors[left], vectors[right], options.threshold):
            own, others = left[a:a + hit.shape[0]], right[b:b + hit.shape[1]]
            if same:
                hit = hit & (own[:, None] != others[None, :])
            links[own] += hit @ copies[others]
            if not same:
                links[others] += copies[own] @ hit
        return pa.table({"id": pa.array(ids), "links": pa.array(links)})

    links = dealt.groupBy("root", "bytes", "i", "j").applyInArrow(count, "id bigint, links bigint").groupBy("id").agg(
        F.sum("links").alias("links"))
    facts = classes.select("digest", "id", "copies").join(links, "id", "left").join(components, "id", "left").select(
        "digest", "copies", F.col("id").alias("rep"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    # Classes of one vector without links need no lookup.
    wanted = facts.where("copies > 1 or links > 0")
    found = lookup_join(rows.withColumn("digest", F.when(F.col("id").isNotNull(), F.col("digest"))), wanted, "digest", "copies")
    component = F.coalesce("root", "id")
    return found.select(
        F.col("id").alias(key), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
