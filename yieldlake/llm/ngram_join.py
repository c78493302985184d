"""Exact Jaccard join of word five-grams through size-banded tiles with bitmap signatures.

1. Each text becomes a set of shingle hashes; equal sets are one class.
2. Sets with similarity t share a token among the first ``n - ceil(t n) + 1`` of any fixed
   order.  The order here is by hash, with tokens that many sets have put last.
   Tokens that the same sets have are one token from there on.
3. Sets that share a prefix token meet in its tiles, where sizes are kept within the band
   that t allows and bitmap signatures bound the overlap from above: a bit that differs
   stands for at least one shingle that is not shared.  Of the tokens that two sets share,
   the first that both name among their smallest compares them.
4. Pairs that pass are verified by intersecting the sorted arrays.

Groups of many near copies would make all their pairs: so each shared token first compares
its sets with one of them, then those of still several clusters with a few of them, and what
is found equal enough is one cluster before the tiles are compared.  Tiles only compare sets
of different clusters.  No pair of clusters is lost.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldlake.llm.shingles import as_bytes, mix, release_memory, shingle_sets
from yieldlake.scale import cut_lineage, lookup_join, release_shuffles, scratch_scope
from yieldlake.wafer.groups import connected

NUMERATOR, DENOMINATOR = 75, 100  # least similarity
SIGNATURE_WORDS = 16  # 64-bit words of a bitmap
HOT_ROWS = 24  # a prefix token of more sets is put last
MAX_HOT = 5_000_000  # a token counts as hot only above this share of all prefix tokens, so the list is bounded
TILE_SIDE = 256  # rows of one side of a tile
PAIR_CHUNK = 1 << 16
PART_ROWS = 512  # texts whose sets are made together
LONG_SET = SIGNATURE_WORDS * 64 * 2 // 3  # sets of more shingles also have a signature that fits them
LEADERS = 4  # sets of a token that its other sets are compared with before tiles
LEADER_TOKENS = 6  # tokens of a set that are compared with their leaders
SEED_TOKENS = 3
LOWEST = 4  # smallest tokens that a set names in tiles
NO_TOKEN = (1 << 63) - 1  # in place of a smallest token where a set has fewer
FINE_ROOM = 4  # how much more room signatures have that sort out the pairs of tiles
ID_BROADCAST = 100_000


def prefix_length(n: np.ndarray | int):
    """Tokens of a set of ``n`` that cannot all be missing from a similar set."""
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def similar(size_a, size_b, overlap):
    """100 * intersection >= 75 * union."""
    return DENOMINATOR * overlap >= NUMERATOR * (size_a + size_b - overlap)


def signature(shingles: np.ndarray, size: int = SIGNATURE_WORDS * 64) -> bytes:
    """Bitmap of ``size`` bits, a power of two."""
    bits = np.zeros(size, np.uint8)
    bits[(mix(shingles) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def fitting_signature(shingles: np.ndarray, room: int = 1) -> bytes:
    """Bitmap with room for a set of any size; half of it folds onto the other for comparison with a shorter one."""
    return signature(shingles, 1 << max(6, int(len(shingles) * room * 3 // 2).bit_length()))


def fitting_bound(size_a: int, size_b: int, bits_a: np.ndarray, bits_b: np.ndarray) -> bool:
    """Whether two sets with fitting signatures (64-bit words) may link."""
    while len(bits_a) > len(bits_b):
        bits_a = bits_a[:len(bits_a) // 2] | bits_a[len(bits_a) // 2:]
    while len(bits_b) > len(bits_a):
        bits_b = bits_b[:len(bits_b) // 2] | bits_b[len(bits_b) // 2:]
    apart = int(np.bitwise_count(bits_a ^ bits_b).sum(dtype=np.int64))
    return bool(similar(size_a, size_b, min((size_a + size_b - apart) // 2, size_a, size_b)))


def bounded(left_size, right_size, left_words: np.ndarray, right_words: np.ndarray) -> np.ndarray:
    """Which pairs may link: bits that differ bound the overlap from above."""
    apart = np.bitwise_count(left_words ^ right_words).sum(axis=1, dtype=np.int64)
    return similar(left_size, right_size, np.minimum((left_size + right_size - apart) // 2, np.minimum(left_size, right_size)))


def met_here(token: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of sets this token compares: all but those whose smallest tokens agree first on another one.

    ``left`` and ``right`` hold the ``LOWEST`` smallest tokens of the sets of each pair, in order.  Both sets have the
    token that they agree on, so they meet in its tiles.
    """
    agreed = np.full(len(token), NO_TOKEN, np.int64)
    for k in range(left.shape[1] - 1, -1, -1):
        named = left[:, k]
        agreed = np.where((right == named[:, None]).any(axis=1), named, agreed)
    return (agreed == NO_TOKEN) | (agreed == token)


def tile_candidates(tile: np.ndarray, square: np.ndarray, first: np.ndarray, sizes: np.ndarray, clusters: np.ndarray, words: np.ndarray,
                    token: np.ndarray, lowest: np.ndarray):
    """Positions ``(a, b)`` of rows that share a tile and may link, of different clusters.

    ``tile`` numbers the tiles of the rows, in order; rows of a tile are ordered by size.
    All pairs of a ``square`` tile count; of another, those of a ``first`` row with one of
    the second side.  A row is only paired within its size band, and a pair that another
    of its tokens compares is left to that one.
    """
    count = len(tile)
    ends = np.searchsorted(tile, tile, "right")
    # Rows of the tile, ordered by size, that are not larger than the band of a row allows.
    reach = tile.astype(np.float64) * (sizes.max(initial=0) * 2.0 + 2.0)
    last = np.minimum(ends, np.searchsorted(reach + sizes, reach + sizes * DENOMINATOR / NUMERATOR + 1e-6, "right"))
    partners = last - np.arange(count) - 1
    start = 0
    while start < count:
        upto = np.cumsum(partners[start:])
        stop = start + max(1, int(np.searchsorted(upto, PAIR_CHUNK, "right")))
        own = partners[start:stop]
        left = np.repeat(np.arange(start, stop), own)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        keep = (clusters[left] != clusters[right]) & (square[left] | (first[left] != first[right]))
        left, right = left[keep], right[keep]
        keep = met_here(token[left], lowest[left], lowest[right])
        left, right = left[keep], right[keep]
        good = bounded(sizes[left], sizes[right], words[left], words[right])
        yield left[good], right[good]
        start = stop


def set_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n, f1, f2, bits, fit)`` per row: size, 128-bit fingerprint and bitmap signature of its shingle set.

    ``fit`` is the signature with room for the set, where ``bits`` is too short to tell it apart.
    """
    def run(batches):
        import pyarrow as pa
        for batch in _parts(batches):
            n, first, second, bits, fit = [], [], [], [], []
            for s in shingle_sets(as_bytes(batch.column(1))):
                n.append(len(s))
                both = [int(mix(s + np.uint64(k)).sum(dtype=np.uint64)) for k in (1, 2)]
                first.append(both[0] - (1 << 63))
                second.append(both[1] - (1 << 63))
                bits.append(signature(s))
                fit.append(fitting_signature(s) if len(s) > LONG_SET else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.array(bits, pa.binary()), pa.array(fit, pa.binary())], ["doc", "n", "f1", "f2", "bits", "fit"])
    return _narrow(docs, key, text).mapInArrow(run, "doc bigint, n int, f1 bigint, f2 bigint, bits binary, fit binary")


def _parts(batches):
    """Batches in parts of few rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)
    release_memory()


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))


def _prefixes(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Prefix of a set in the order (hot, hash)."""
    size = prefix_length(len(s))
    if not len(hot):
        return s[:size]
    known = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
    return np.concatenate((s[~known], s[known]))[:size]


def prefix_tokens(docs: DataFrame, key: str, text: str, hot: np.ndarray) -> DataFrame:
    """``(token, f1, rank)``: prefix tokens of each set, named by the set's fingerprint."""
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        import pyarrow as pa
        for batch in _parts(batches):
            prefixes, owners = [], []
            for s in shingle_sets(as_bytes(batch.column(1))):
                if len(s):
                    prefixes.append(_prefixes(s, held.value))
                    owners.append(int(mix(s + np.uint64(1)).sum(dtype=np.uint64)) - (1 << 63))
            sizes = [len(p) for p in prefixes]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)),
                pa.array(np.repeat(np.array(owners, np.int64), sizes)),
                pa.array(np.concatenate([np.minimum(np.arange(z), 100) for z in sizes]).astype(np.int8) if sizes else np.zeros(0, np.int8)),
            ], ["token", "f1", "rank"])
    return _narrow(docs, key, text).mapInArrow(run, "token bigint, f1 bigint, rank tinyint")


def hot_tokens(docs: DataFrame, key: str, text: str) -> np.ndarray:
    """Prefix tokens under the plain hash order that many rows have, sorted; at most MAX_HOT of them."""
    counts = prefix_tokens(docs, key, text, np.zeros(0, np.uint64)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    frequent = cut_lineage(counts.groupBy((F.col("n") > HOT_ROWS).alias("many"), F.when(F.col("n") > HOT_ROWS, F.col("token")).alias("token")).agg(
        F.sum("n").alias("n")))
    total = frequent.agg(F.sum("n")).first()[0] or 0
    found = frequent.where(F.col("many") & (F.col("n") * MAX_HOT > total)).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """Rows ``(token, f1, rank, rows)`` of tokens that at least two different sets have; equal sets count once.

    Tokens of the same sets would compare the same pairs, so they become one token, named by a hash of its sets and
    with the least rank of each.  Should two hashes be equal, the sets of both are compared.
    """
    def run(batches):
        import pyarrow as pa
        rest = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int8)]

        def given(columns, last):
            """Whole groups of the sorted rows; the last group may go on in the next batch."""
            token, owner, rank = columns
            if not len(token):
                return None, columns
            end = len(token) if last else int(np.searchsorted(token, token[-1], "left"))
            new = np.ones(end, bool)
            new[1:] = (token[1:end] != token[:end - 1]) | (owner[1:end] != owner[:end - 1])
            t, o, r = token[:end][new], owner[:end][new], rank[:end][new]
            starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate((starts, [len(t)])))
            rows = np.repeat(sizes, sizes)
            keep = rows > 1
            owners = np.add.reduceat(mix(o.view(np.uint64)), starts) if len(t) else np.zeros(0, np.uint64)
            named = np.repeat(mix(owners + sizes.astype(np.uint64)).view(np.int64), sizes)
            out = pa.RecordBatch.from_arrays([pa.array(named[keep]), pa.array(o[keep]), pa.array(r[keep]), pa.array(rows[keep].astype(np.int64))],
                                             ["token", "f1", "rank", "rows"])
            return out, [c[end:] for c in columns]

        for batch in batches:
            rest = [np.concatenate((a, c.to_numpy(zero_copy_only=False))) for a, c in zip(rest, batch.columns)]
            if len(rest[0]) >= 1 << 16:
                out, rest = given(rest, False)
                yield out
        out, _ = given(rest, True)
        if out is not None:
            yield out

    count = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.repartition(count, "token").sortWithinPartitions("token", "f1").mapInArrow(
        run, "token bigint, f1 bigint, rank tinyint, rows bigint").groupBy("token", "f1").agg(
        F.min("rank").alias("rank"), F.max("rows").alias("rows"))


def seed_pairs(shared: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of each set with one other set of each of its first SEED_TOKENS shared tokens."""
    # A list holds one set's prefix at most.
    first = shared.where("rows > 2").groupBy("f1").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("rank", "token"))), 1, SEED_TOKENS).alias("first"))
    low = first.select("f1", F.explode("first").alias("t")).select("f1", "t.token")
    leaders = low.groupBy("token").agg(F.min_by("f1", F.xxhash64("token", "f1")).alias("leader"), F.count(F.lit(1)).alias("n"))
    met = lookup_join(low.select("token", "f1"), leaders, "token", "n").where("leader <> f1")
    return met.select(F.col("leader").alias("a"), F.col("f1").alias("b")).distinct()


def _allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes and signatures allow a link."""
    facts = classes.select("f1", "n", "bits")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            words = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SIGNATURE_WORDS) for c in (4, 5)]
            yield batch.select(["a", "b"]).filter(pa.array(bounded(na, nb, *words)))

    with_a = pairs.join(facts.toDF("a", "na", "bits_a"), "a")
    return with_a.join(facts.toDF("b", "nb", "bits_b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint")


def _encoded_sets(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, encode) -> DataFrame:
    """``(id, f1, n, code)`` of the sets that occur in pairs, computed from the texts again."""
    involved = cut_lineage(pairs.select(F.col("a").alias("f1")).unionByName(pairs.select(F.col("b").alias("f1"))).distinct()
                           .join(classes.select("f1", "id"), "f1").select(F.col("id").alias("doc")).distinct())
    if involved.count() <= ID_BROADCAST:
        involved = F.broadcast(involved)

    def run(batches):
        import pyarrow as pa
        for part in _parts(batches):
            sets = list(shingle_sets(as_bytes(part.column(1))))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([int(mix(s + np.uint64(1)).sum(dtype=np.uint64)) - (1 << 63) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([encode(s) for s in sets], pa.binary())], ["id", "f1", "n", "code"])

    return cut_lineage(_narrow(docs, key, text).join(involved, "doc", "left_semi").mapInArrow(
        run, "id bigint, f1 bigint, n bigint, code binary"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, room: int = 1) -> DataFrame:
    """Pairs whose sorted shingle arrays intersect enough, as class ids ``(u, v)`` with ``u > v``.

    Signatures of more ``room`` sort out more pairs before their arrays are read.
    """
    pairs = cut_lineage(pairs)
    marks = _encoded_sets(pairs, classes, docs, key, text, partial(fitting_signature, room=room))

    def bound(batches):
        import pyarrow as pa
        for batch in batches:
            good = [fitting_bound(m, n, np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                    for m, n, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # Short signatures let long sets pass; signatures that fit the sets do not, and are far smaller than the arrays.
    sides = marks.toDF("id", "f1", "n", "x")
    pairs = cut_lineage(pairs.join(sides.select(F.col("f1").alias("a"), F.col("n").alias("m"), "x"), "a").join(
        sides.select(F.col("f1").alias("b"), "n", F.col("x").alias("y")), "b").select("a", "b", "m", "n", "x", "y").mapInArrow(
        bound, "a bigint, b bigint").distinct())
    arrays = _encoded_sets(pairs, classes, docs, key, text, np.ndarray.tobytes).drop("n")

    def intersect(batches):
        import pyarrow as pa
        for batch in batches:
            found = []
            # Arrays are read in place: a batch may hold many long ones.
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if a != b and similar(len(left), len(right), both):
                    found.append((max(a, b), min(a, b)))
            yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    left = arrays.toDF("ida", "a", "xa")
    right = arrays.toDF("idb", "b", "xb")
    met = pairs.join(left, "a").join(right, "b").select("ida", "idb", "xa", "xb")
    return cut_lineage(met.mapInArrow(intersect, "u bigint, v bigint").distinct())


_ROW = ("f1", "n", "cluster", "bits", "fit")


class _Block:
    """Columns of some rows of ``_ROW`` as arrays; long signatures stay in their Arrow buffer."""

    def __init__(self, table):
        self.owner, self.sizes, self.clusters = (table.column(c).to_numpy().astype(np.int64) for c in _ROW[:3])
        self.words = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, SIGNATURE_WORDS)
        self.fit = table.column("fit")
        self.long = self.fit.is_valid().to_numpy(zero_copy_only=False) if len(self.owner) else np.zeros(0, bool)

    def linked(self, left: np.ndarray, right: np.ndarray):
        """The pairs of rows, once each, whose long signatures allow a link too, as a batch ``(a, b)``."""
        import pyarrow as pa

        a, b = np.minimum(self.owner[left], self.owner[right]), np.maximum(self.owner[left], self.owner[right])
        _, once = np.unique(np.stack((a, b)), axis=1, return_index=True)
        left, right, a, b = left[once], right[once], a[once], b[once]
        good = np.ones(len(left), bool)
        for i in np.flatnonzero(self.long[left] & self.long[right]).tolist():
            x, y = (np.frombuffer(self.fit[int(at)].as_buffer(), np.uint64) for at in (left[i], right[i]))
            good[i] = fitting_bound(int(self.sizes[left[i]]), int(self.sizes[right[i]]), x, y)
        return pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])


def _whole_groups(batches, names: tuple[str, ...], rows: int):
    """Tables of about ``rows`` sorted rows that end where the values of ``names`` change; groups are small."""
    import pyarrow as pa
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows >= rows:
            same = np.logical_and.reduce([k == k[-1] for k in (rest.column(c).to_numpy() for c in names)])
            end = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            if end:
                yield rest.slice(0, end).combine_chunks()
                rest = rest.slice(end)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()
    release_memory()


def _mixed_tokens(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows ``token, f1, rows`` of the tokens whose sets lie in more than one cluster; ``rows`` is one number a token."""
    grouped = shared.select("token", "f1", "rows").join(classes.select("f1", "cluster"), "f1")
    mixed = grouped.groupBy("token").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.max("rows").alias("rows")).where(
        "lo <> hi").select("token", "rows")
    return grouped.select("token", "f1").join(mixed, "token")


def leader_pairs(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of each set with LEADERS sets of LEADER_TOKENS tokens of several clusters, within size and signature.

    Tokens are taken in one hash order, so that near copies tend to take the same ones; the
    leaders are a token's first sets in hash order.  Rows stream by in that order, so a token
    of any number of sets takes the memory of its leaders, and pairs grow with the sets.
    """
    # A list holds one set's prefix at most.
    taken = _mixed_tokens(shared, classes).groupBy("f1").agg(F.slice(F.sort_array(F.collect_list(
        F.struct(F.xxhash64("token").alias("h"), "token"))), 1, LEADER_TOKENS).alias("taken")).select(
        "f1", F.explode("taken.token").alias("token"))

    def run(batches):
        import pyarrow as pa
        lead, token = None, None
        for batch in _parts(batches):
            table = pa.Table.from_batches([batch])
            own = table.column("token").to_numpy()
            if lead is not None and token == own[0]:
                table = pa.concat_tables([lead, table])
                own = table.column("token").to_numpy()
            table = table.combine_chunks()
            rows = _Block(table)
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            group = np.repeat(starts, np.diff(np.concatenate((starts, [len(own)]))))
            at = np.arange(len(own))
            for k in range(LEADERS):
                first = group + k
                right = at[(first < at) & (rows.clusters[np.minimum(first, len(own) - 1)] != rows.clusters)]
                left = first[right]
                keep = bounded(rows.sizes[left], rows.sizes[right], rows.words[left], rows.words[right])
                yield rows.linked(left[keep], right[keep])
            token = own[-1]
            lead = table.slice(int(starts[-1]), LEADERS)

    count = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64("token", "f1")
    return taken.join(classes.select(*_ROW), "f1").select("token", *_ROW).repartition(count, "token").sortWithinPartitions(
        "token", order, "f1").mapInArrow(run, "a bigint, b bigint").distinct()


def tile_pairs(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets of different clusters that share a prefix token and pass size and signatures.

    ``classes`` has ``f1, n, bits, fit, cluster``.  Tokens of a single cluster are left out.  A
    token's rows are dealt to tiles of about TILE_SIDE rows a side, each with the LOWEST smallest tokens of its set.
    """
    blocks = F.ceil(F.col("rows") / TILE_SIDE).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j")))
    lows = [f"low{k}" for k in range(LOWEST)]
    # A list holds one set's prefix at most.
    held = _mixed_tokens(shared, classes).groupBy("f1").agg(F.sort_array(F.collect_list(F.struct("token", "rows"))).alias("held"))
    named = [F.coalesce(F.get("held.token", F.lit(k)), F.lit(NO_TOKEN)).alias(c) for k, c in enumerate(lows)]
    dealt = held.join(classes.select(*_ROW), "f1").select(*_ROW, *named, F.inline("held")).withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("f1"), F.col("blocks")).cast("int")).withColumn(
        "tile", F.explode(met)).select("token", "tile.i", "tile.j", "block", *lows, *_ROW)

    def run(batches):
        for table in _whole_groups(batches, ("token", "i", "j"), 1 << 12):
            token, i, j = (table.column(c).to_numpy() for c in ("token", "i", "j"))
            tile = np.cumsum(np.concatenate(([0], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            rows = _Block(table)
            block = table.column("block").to_numpy()
            lowest = np.stack([table.column(c).to_numpy() for c in lows], axis=1)
            for x, y in tile_candidates(tile, i == j, block == i, rows.sizes, rows.clusters, rows.words, token, lowest):
                yield rows.linked(x, y)

    count = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(count, "token", "i", "j").sortWithinPartitions("token", "i", "j", "n").mapInArrow(
        run, "a bigint, b bigint").distinct()


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``(key, n_shingles, component_id)``.

    Two documents link when 100 times the intersection of their shingle sets reaches 75
    times the union; ``component_id`` is the smallest key reachable by links.  Texts of one
    to four words are one shingle.  Null text and text without words have an empty set and
    link with nothing.  Repeated rows are kept and rows that share a key are one document
    for links.  A null key keeps a null component.  An empty table gives no rows; other
    columns are not read.
    """
    with scratch_scope(docs.sparkSession) as keep:
        return keep(_similar_documents(docs, key, text))


def _clustered(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The columns of ``_ROW``: each class with the smallest id that its links reach."""
    clusters = connected(links).select(F.col("u").alias("id"), F.col("v").alias("cluster"))
    return cut_lineage(classes.join(clusters, "id", "left").withColumn("cluster", F.coalesce("cluster", "id")).select(*_ROW))


def _similar_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    sets = cut_lineage(set_table(docs, key, text))
    classes = cut_lineage(sets.where("n > 0 and doc is not null").groupBy("f1", "f2", "n").agg(
        F.min("doc").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits"), F.first("fit").alias("fit")))
    hot = hot_tokens(docs, key, text)
    shared = cut_lineage(shared_tokens(prefix_tokens(docs, key, text, hot)))
    release_shuffles(docs.sparkSession)
    seeds = verified(_allowed(seed_pairs(shared), classes), classes, docs, key, text)
    marked = _clustered(classes, seeds)
    seeds = cut_lineage(seeds.unionByName(verified(leader_pairs(shared, marked), classes, docs, key, text)).distinct())
    release_shuffles(docs.sparkSession)
    links = verified(tile_pairs(shared, _clustered(classes, seeds)), classes, docs, key, text, FINE_ROOM)
    # Rows of one class link; so do classes of rows that share a key.
    roots = connected(seeds.unionByName(links).distinct())
    named = classes.join(roots.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select(
        "f1", "f2", "copies", F.coalesce("root", "id").alias("root"), "id").where("copies > 1 or root <> id")
    named = named.select(F.concat_ws("|", "f1", "f2").alias("set"), "copies", "root")
    found = lookup_join(sets.withColumn("set", F.concat_ws("|", "f1", "f2")), named, "set", "copies")
    return found.select(F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"),
                        F.coalesce("root", "doc").alias("component_id"))
