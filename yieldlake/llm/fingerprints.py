"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

The shingles of a text are hashed once.  The high bits of a hash choose a bin, the
smallest hash of a bin is its value.  An empty bin takes the value of a filled one, found
by hashing (bin, attempt) until a filled bin comes up, which every text does in the same
order.  The low bits of the values are packed into the fingerprint.  Equal low bits of
different values are corrected for when two fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldlake.llm.shingles import mix, shingle_sets

BINS = 512  # a power of two
BITS = 4
EMPTY = "-"  # fingerprint of a text without a word
_SHIFT = np.uint64(64 - (BINS.bit_length() - 1))
BATCH_BYTES = 4 << 20


@lru_cache(maxsize=256)
def _probes(step: int) -> np.ndarray:
    """Bins that 32 successive attempts try for each bin, the same for every text."""
    attempts = np.arange(1 + 32 * step, 33 + 32 * step, dtype=np.uint64)[:, None] << np.uint64(32)
    return (mix(np.arange(BINS, dtype=np.uint64)[None, :] * np.uint64(0x10001) + attempts) >> _SHIFT).astype(np.int64)


def bin_values(shingles: np.ndarray) -> np.ndarray:
    """Value of each bin from a sorted, non-empty array of distinct shingle hashes."""
    bins = (shingles >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # sorted hashes: a bin's smallest comes first
    bins = bins[first]
    values = np.zeros(BINS, np.uint64)
    values[bins] = shingles[first]
    filled = np.zeros(BINS, bool)
    filled[bins] = True
    empty = np.flatnonzero(~filled)
    step = 0
    while len(empty):
        tries = filled[_probes(step)[:, empty]]
        hit = tries.any(axis=0)
        values[empty[hit]] = values[_probes(step)[tries.argmax(axis=0)[hit], empty[hit]]]
        empty = empty[~hit]
        step += 1
    return values


def fingerprint(shingles: np.ndarray) -> str:
    """Packed low bits of the bin values as hexadecimal digits."""
    if not len(shingles):
        return EMPTY
    low = (mix(bin_values(shingles)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return np.packbits(((low[:, None] >> np.arange(BITS, dtype=np.uint8)) & 1).ravel()).tobytes().hex()


def likeness(left: str, right: str) -> float:
    """Estimated Jaccard similarity of two fingerprints, corrected for chance agreement of the low bits."""
    if EMPTY in (left, right):
        return float(left == right)
    apart = np.frombuffer(bytes.fromhex(left), np.uint8) ^ np.frombuffer(bytes.fromhex(right), np.uint8)
    agree = (np.packbits(np.unpackbits(apart).reshape(-1, BITS), axis=1) == 0).mean()
    chance = 1 / (1 << BITS)
    return float(min(1.0, max(0.0, (agree - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compared(rows: list[tuple], marks: list[str]) -> Iterator[tuple]:
    """Results of each row but the last, which only follows."""
    changed = [edited(a[1], b[1]) for a, b in zip(rows, rows[1:])]
    made = [fingerprint(s) for s in shingle_sets([x.encode() for x in changed])]
    for i, (row, text) in enumerate(zip(rows, changed)):
        yield (row[0], len(row[1]), sha256(text.encode()).hexdigest(), marks[i], made[i],
               likeness(marks[i], made[i]), likeness(marks[i], marks[i + 1]))


def with_next(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Rows ``(block, place, key, text)`` such that each block holds a stretch of documents in
    descending order of the key, followed by the first document of the next stretch.

    Texts are shuffled once.  Block edges are approximate quantiles of the key, so no
    block grows with one machine's share; only the first document of each block is
    doubled.
    """
    spark = docs.sparkSession
    blocks = 8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    edges = rows.select("key").agg(F.percentile_approx(
        "key", F.lit([i / blocks for i in range(1, blocks)]), F.lit(20_000)).alias("e")).first()["e"] or []
    # Block i holds the keys above the i-th edge from the top; the last one the rest and null keys.
    edges = np.array(sorted(set(edges)), dtype=np.int64)

    @F.arrow_udf("int")
    def block_of(keys):
        import pyarrow as pa
        found = len(edges) - np.searchsorted(edges, keys.fill_null(0).to_numpy(zero_copy_only=False), "left")
        return pa.array(np.where(keys.is_null().to_numpy(zero_copy_only=False), len(edges), found).astype(np.int32))

    placed = rows.select(block_of("key").alias("block"), "key", "text")
    heads = {r["block"]: r["key"] for r in placed.groupBy("block").agg(F.max("key").alias("key")).collect()}
    present = sorted(heads)  # at most one entry per block
    leads = {b: present[i - 1] for i, b in enumerate(present)}

    @F.arrow_udf("int")
    def follows(block, keys):
        """The block that a block's first document follows; null for other documents."""
        import pyarrow as pa
        return pa.array([leads[b] if heads[b] == k else None for b, k in zip(block.to_pylist(), keys.to_pylist())], pa.int32())

    marked = placed.withColumn("after", follows("block", "key"))
    own = F.struct(F.col("block"), F.lit(0).alias("place"))
    lead = F.struct(F.col("after").alias("block"), F.lit(1).alias("place"))
    spread = marked.select("key", "text", F.explode(
        F.when(F.col("after").isNotNull(), F.array(own, lead)).otherwise(F.array(own))).alias("at"))
    return spread.select("at.block", "at.place", "key", "text"), blocks


def fingerprint_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: fingerprints of its whole text and of its edited text, and their likeness.

    Columns ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  The next document follows in descending order of ``key`` (null keys last,
    rows with one key ordered by text); the last is followed by the first.  A null text
    counts as empty.  A text without a word has the fingerprint ``-``, which is like itself
    (1) and like nothing else (0).  An empty table gives no rows, a single document is its
    own follower, and other columns are not read.
    """
    rows, blocks = with_next(docs, key, text)
    sorted_rows = rows.repartition(max(1, blocks // 8), "block").sortWithinPartitions(
        "block", "place", F.col("key").desc_nulls_last(), "text")

    def run(batches):
        import pyarrow as pa

        def flushed(found):
            columns = list(zip(*found)) if found else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held: list[tuple] = []
        size, block, closed = 0, None, True

        def work(last: bool):
            nonlocal held, size
            if len(held) > 1:
                marks = [fingerprint(s) for s in shingle_sets([r[1].encode() for r in held])]
                yield flushed(list(_compared(held, marks)))
            held, size = ([] if last else held[-1:]), 0

        for batch in batches:
            for at, place, own, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != block:
                    block, closed, held, size = at, False, [], 0
                if closed:
                    continue  # more rows of the follower's key: only the first follows
                held.append((own, content))
                size += len(content)
                if place == 1:
                    closed = True
                    yield from work(True)
                elif size >= BATCH_BYTES:
                    yield from work(False)

    made = sorted_rows.mapInArrow(
        run, "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
    return made.withColumnRenamed("key", key)
