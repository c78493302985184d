"""Spelling variants of the words of a collection, grouped under their most frequent form.

Letters are hashed to a few symbols.  Each word's reduced form gets its full one-edit
neighbourhood (every deletion, replacement and insertion over the small alphabet), as 64-bit
hashes that are joined with the reduced vocabulary; what meets is verified on the original
strings.  An edit leaves one half of the original word as it was, so that half is part of the
join key: words are shuffled to it once, and their neighbourhoods are only made where the
words that they can meet are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldlake.llm.shingles import _powers, mix
from yieldlake.scale import cut_lineage, scratch_scope

_RUN = re.compile("[a-zÀ-ÿ]+")  # after A-Z were lower-cased
LONG_TEXT = 1 << 22  # from here on, runs of a text are counted one by one
HELD_WORDS, HELD_BYTES = 100_000, 1 << 24  # counts that a task holds before it emits them
SLICE_LETTERS = 1 << 15  # letters of the words whose keys are made together
PAIRS_HELD, PAIRS_SENT = 1 << 20, 1 << 13  # pairs that a task expands, and sends in one batch
_SUFFIX, _PREFIX = np.uint64(0x51ED270B9F1F3D5B), np.uint64(0xA0761D6478BD642F)
_HALF, _LONGER = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


@dataclass(frozen=True)
class SpellingOptions:
    symbols: int = 8  # letters of the reduced alphabet
    least_letters: int = 5
    least_count: int = 3
    drop_one_in: int = 97  # a run whose hash this divides loses one letter; 0: none does
    block_words: int = 20_000  # words with a common half that one task joins
    dominance: int = 2  # a form occurs at least this many times as often as its variant


def _words_of(key: str | None, text: str, drop_one_in: int) -> Iterator[tuple[str, int]]:
    """Lower-cased runs of a text with their counts, after the planted deletions."""
    lowered = text.encode().lower().decode()
    if len(lowered) < LONG_TEXT:
        runs = Counter(_RUN.findall(lowered))
    else:
        runs = Counter(m.group() for m in _RUN.finditer(lowered))
    start = None if key is None or not drop_one_in else zlib.crc32(f"{key}:".encode())
    for word, n in runs.items():
        if start is not None:
            found = zlib.crc32(word.encode(), start)
            if found % drop_one_in == 0:
                at = found % len(word)
                word = word[:at] + word[at + 1:]
        yield word, n


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                options: SpellingOptions = SpellingOptions()) -> DataFrame:
    """``word, n``: words of at least ``least_letters`` code points that occur ``least_count`` times.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.  A run whose
    crc32 of ``<key>:<run>`` is divided by ``drop_one_in`` loses the letter at that number
    modulo its length; with a null key none does.  Null and empty texts have no words, rows
    that repeat count again, and an empty table gives no rows.  Tasks count before the shuffle.
    """
    least = options.least_letters
    drop = options.drop_one_in

    def run(batches):
        import pyarrow as pa

        held: dict[str, int] = {}
        size = 0

        def emitted():
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for own, content in zip(batch.column(0), batch.column(1)):
                content = content.as_py()
                if not content:
                    continue
                for word, n in _words_of(own.as_py(), content, drop):
                    if len(word) < least:
                        continue
                    if word in held:
                        held[word] += n
                    else:
                        held[word] = n
                        size += len(word)
                        if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                            yield emitted()
                            held, size = {}, 0
        if held:
            yield emitted()

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= options.least_count)


class _Rows:
    """Words of some blocks: prefix sums of their letters and of the symbols that stand for them.

    A block is named by ``longer``, the length of the longer of two near words, and by the
    half of it that an edit leaves as it is: with ``suffix`` the last ``longer // 2`` letters,
    otherwise the first ``longer - longer // 2``.
    """

    def __init__(self, words: list[str], suffix: np.ndarray, longer: np.ndarray, symbols: int):
        self.suffix, self.longer, self.symbols = suffix, longer, symbols
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(letters)) - np.repeat(self.first, self.sizes)
        self.forward, self.back = _powers(1 << max(10, int(self.sizes.max(initial=1) + 2).bit_length()))
        mixed = mix(letters + np.uint64(1))
        self.symbol = mixed % np.uint64(symbols) + np.uint64(1)
        self.of_letters = self._sums(mixed)
        self.of_symbols = self._sums(self.symbol)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.forward[self.place], dtype=np.uint64, out=total[1:])
        return total

    def _until(self, sums: np.ndarray, rows, place: np.ndarray) -> np.ndarray:
        """Sum over the first ``place`` letters of rows."""
        return sums[self.first[rows] + place] - sums[self.first[rows]]

    def blocks(self) -> np.ndarray:
        """Hash of each row's block."""
        rows = slice(None)
        cut = np.where(self.suffix, self.sizes - self.longer // 2, self.longer - self.longer // 2)
        until = self._until(self.of_letters, rows, cut)
        rest = (self._until(self.of_letters, rows, self.sizes) - until) * self.back[cut]
        half = np.where(self.suffix, mix(rest ^ _SUFFIX), mix(until ^ _PREFIX))
        return mix(half * _HALF + self.longer.astype(np.uint64) * _LONGER).view(np.int64)

    def own_keys(self, blocks: np.ndarray) -> np.ndarray:
        """Key of each row's reduced word within its block."""
        return self._key(self._until(self.of_symbols, slice(None), self.sizes), blocks)

    @staticmethod
    def _key(reduced: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        return mix(mix(reduced) + blocks.view(np.uint64)).view(np.int64)

    def neighbourhoods(self, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of all reduced words one edit away, edited outside of the block's half, with their rows.

        The longer word of a block has its letters replaced and deleted; the shorter one
        has letters inserted.
        """
        whole = self.longer - self.longer // 2
        start = np.where(self.suffix, 0, whole)
        number = np.where(self.suffix, whole, self.longer // 2)
        rows = np.repeat(np.arange(len(self.sizes)), number)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(number) - number, number) + start[rows]
        initial = place == start[rows]
        shorter = (self.sizes < self.longer)[rows]
        for chosen, added in ((~shorter, False), (shorter, True)):
            row, at, lead = rows[chosen], place[chosen], initial[chosen]
            block = blocks[row]
            before = self._until(self.of_symbols, row, at)
            total = self._until(self.of_symbols, row, self.sizes[row])
            here = self.first[row] + at
            left = np.where(lead, np.uint64(0), self.symbol[np.maximum(here - 1, 0)] if len(self.symbol) else np.uint64(0))
            if added:
                after = (total - before) * self.forward[1]
                for c in range(1, self.symbols + 1):
                    once = left != c  # beside an equal symbol gives the same word
                    made = before[once] + np.uint64(c) * self.forward[at[once]] + after[once]
                    yield self._key(made, block[once]), row[once]
            elif len(row):
                own = self.symbol[here]
                once = left != own
                after = (total - before - own * self.forward[at]) * self.back[1]
                yield self._key((before + after)[once], block[once]), row[once]
                for c in range(1, self.symbols + 1):
                    yield self._key(total + (np.uint64(c) - own) * self.forward[at], block), row


def _rows_of(batch, start: int, stop: int, symbols: int) -> _Rows:
    part = batch.slice(start, stop - start)
    return _Rows(part.column("word").to_pylist(), part.column("suffix").to_numpy(zero_copy_only=False),
                 part.column("longer").to_numpy(), symbols)


def _cuts(batch) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a batch that hold about SLICE_LETTERS letters each."""
    start = held = 0
    for i, size in enumerate(batch.column("longer").to_pylist()):
        held += size
        if held >= SLICE_LETTERS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield start, batch.num_rows


def word_blocks(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """``block, suffix, longer`` with each word: the halves it may share with a near word.

    Four rows a word: either half, as the longer (or equally long) and as the shorter word.
    """
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            size = batch.num_rows
            lengths = np.array([len(x.as_py()) for x in batch.column("word")], dtype=np.int64)
            for extra in (0, 1):
                for suffix in (True, False):
                    rows = pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(np.full(size, suffix)), pa.array(lengths + extra)],
                        [*batch.schema.names, "suffix", "longer"])
                    for start, stop in _cuts(rows):
                        blocks = _rows_of(rows, start, stop, symbols).blocks()
                        yield pa.RecordBatch.from_arrays([pa.array(blocks), *rows.slice(start, stop - start).columns],
                                                         ["block", *rows.schema.names])

    return vocabulary.select("id", "word", "n").mapInArrow(
        run, "block bigint, id bigint, word string, n bigint, suffix boolean, longer bigint")


def _matches(own: np.ndarray, keys: np.ndarray, rows: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a generated and a different own row with equal keys, in parts; ``own`` is sorted by ``order``."""
    first = np.searchsorted(own, keys, "left")
    count = np.searchsorted(own, keys, "right") - first
    hit = count > 0
    first, count, rows = first[hit], count[hit], rows[hit]
    upto = np.cumsum(count)
    start = 0
    while start < len(rows):
        base = upto[start] - count[start]
        stop = max(start + 1, int(np.searchsorted(upto, base + PAIRS_HELD, "right")))
        n = count[start:stop]
        left = np.repeat(rows[start:stop], n)
        right = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[start:stop], n)]
        yield left[left != right], right[left != right]
        start = stop


def _met_in_blocks(blocks: DataFrame, symbols: int) -> DataFrame:
    """Rows whose reduced words meet in a block; blocks are no larger than a task may hold."""
    spark = blocks.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        import pyarrow as pa

        names = ["id", "word", "n"]

        def joined(parts):
            batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            block = batch.column("block").to_numpy()
            rows = _rows_of(batch, 0, batch.num_rows, symbols)
            own = rows.own_keys(block)
            order = np.argsort(own, kind="stable")
            own = own[order]
            sides = [batch.column(x) for x in names]
            for keys, made in rows.neighbourhoods(block):
                for left, right in _matches(own, keys, made, order):
                    for at in range(0, len(left), PAIRS_SENT):
                        a, b = (pa.array(x[at:at + PAIRS_SENT]) for x in (left, right))
                        yield pa.RecordBatch.from_arrays(
                            [x.take(i) for i in (a, b) for x in sides], [*names, "near_id", "near", "near_n"])

        held, letters = [], 0
        for batch in batches:
            block = batch.column("block").to_numpy()
            sizes = batch.column("longer").to_numpy()
            # A slice ends where a block ends.
            ends = np.append(np.flatnonzero(np.diff(block)) + 1, batch.num_rows)
            if held and held[-1].column("block")[-1].as_py() != block[0] and letters >= SLICE_LETTERS:
                yield from joined(held)
                held, letters = [], 0
            start = 0
            for stop in ends.tolist():
                letters += int(sizes[start:stop].sum())
                if letters >= SLICE_LETTERS and stop < batch.num_rows:
                    held.append(batch.slice(start, stop - start))
                    yield from joined(held)
                    held, letters, start = [], 0, stop
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield from joined(held)

    return blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(
        run, "id bigint, word string, n bigint, near_id bigint, near string, near_n bigint")


def _met_by_keys(blocks: DataFrame, symbols: int) -> DataFrame:
    """The same for blocks too large for a task: every key of a neighbourhood is joined by itself."""
    def keyed(own: bool, name: str) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for start, stop in _cuts(batch):
                    rows = _rows_of(batch, start, stop, symbols)
                    ids = batch.column("id").to_numpy()[start:stop]
                    block = batch.column("block").to_numpy()[start:stop]
                    for keys, made in [(rows.own_keys(block), slice(None))] if own else rows.neighbourhoods(block):
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[made])], ["key", name])

        return blocks.mapInArrow(run, f"key bigint, {name} bigint")

    met = keyed(False, "id").join(keyed(True, "near_id"), "key").where("id <> near_id").select("id", "near_id").distinct()
    words = blocks.select("id", "word", "n").distinct()
    return met.join(words, "id").join(words.toDF("near_id", "near", "near_n"), "near_id")


def near_words(vocabulary: DataFrame, options: SpellingOptions = SpellingOptions()) -> DataFrame:
    """``id, near_id, near, near_n``: all ordered pairs of different words one edit apart.

    ``vocabulary`` holds distinct ``id, word, n``.  One edit is one code point inserted,
    deleted or replaced.  Words are brought together by the half they share; within such a
    block reduced neighbourhoods are joined with reduced words in the task, or key by key
    where a block holds more than ``block_words`` words.
    """
    blocks = cut_lineage(word_blocks(vocabulary, options.symbols))
    large = cut_lineage(blocks.groupBy("block").count().where(F.col("count") > options.block_words).select("block"))
    columns = ("id", "word", "near_id", "near", "near_n")
    if large.isEmpty():
        met = _met_in_blocks(blocks, options.symbols).select(*columns)
    else:
        met = _met_in_blocks(blocks.join(large, "block", "left_anti"), options.symbols).select(*columns).unionByName(
            _met_by_keys(blocks.join(large, "block", "left_semi"), options.symbols).select(*columns))
    return met.where(F.levenshtein("word", "near", 1) == 1).groupBy("id", "near_id").agg(
        F.first("near").alias("near"), F.first("near_n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """Last form of each word that has one: ``id, root_id``, by doubling the steps each round.

    A form is more frequent than its variant, so steps never lead back and end after
    logarithmically many rounds.
    """
    steps = cut_lineage(forms)
    while True:
        further = steps.select(F.col("id").alias("root_id"), F.col("root_id").alias("__next"))
        steps = cut_lineage(steps.join(further, "root_id", "left").select(
            "id", F.coalesce("__next", "root_id").alias("root_id"), F.col("__next").isNotNull().alias("moved")))
        if not steps.where("moved").limit(1).count():
            return steps.select("id", "root_id")
        steps = steps.select("id", "root_id")


def group_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    options: SpellingOptions = SpellingOptions()) -> DataFrame:
    """One row per word of ``word_counts``: ``word, form, root, n, n_near, form_n``.

    ``n_near`` counts the words one edit away.  The most frequent of them (ties: the smallest
    in code-point order) is the ``form`` when it occurs at least ``dominance`` times as often
    as the word, otherwise form and ``form_n`` are null.  ``root`` follows forms to the end, and
    is the word itself without a form.  Words of any length take memory in proportion to their
    length.  Nulls, repeated rows and empty tables are as in ``word_counts``; other columns
    are not read.
    """
    if options.dominance < 2:
        raise ValueError("forms must be more frequent than their variants")
    with scratch_scope(docs.sparkSession) as keep:
        vocabulary = cut_lineage(word_counts(docs, key, text, options).select(
            F.monotonically_increasing_id().alias("id"), "word", "n"))
        near = near_words(vocabulary, options).groupBy("id").agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("less"), "near", "near_id")).alias("best"))
        judged = cut_lineage(vocabulary.join(near, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(-F.col("best.less") >= options.dominance * F.col("n"), F.col("best")).alias("best")))
        roots = _roots(judged.where("best is not null").select("id", F.col("best.near_id").alias("root_id")))
        named = roots.join(vocabulary.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id")
        return keep(judged.join(named.select("id", "root"), "id", "left").select(
            "word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near",
            (-F.col("best.less")).alias("form_n")))
