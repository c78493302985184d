"""Ranked lexical search of a query set over all documents, in integer arithmetic.

One pass over the texts stores, for each document, its length and the counts of the terms
that the queries hold; document counts of the terms follow from that table.  Blocks of
documents are then searched within tasks by a hybrid of both classical orders.  The short
lists of a query are summed up term at a time into accumulators.  These are then one more
list, with a bound of its own, beside the long lists, and all of them are advanced together
in document order: windows whose bound lies under the score of the last document to be
reported are skipped, and within a window long lists are only entered at documents that
can still be reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yieldlake.scale import cut_lineage, scratch_scope

# Bytes of terms: digits, A-Z as a-z, a-z and all bytes of characters beyond ASCII.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                    for c in range(256))
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
WINDOW = 1024  # documents that advance together
TEXT_SLICE = 1 << 22  # bytes of a text that are split at a time


@dataclass(frozen=True)
class SearchOptions:
    top: int = 20
    block_documents: int = 16 * WINDOW  # documents that a task searches together
    block_postings: int = 2_000_000  # or fewer, once they hold this many term counts
    short_share: int = 64  # a list is short when it holds at most one in this many documents of a block
    query_bytes: int = 1 << 23  # distinct terms of the queries that are searched in one pass


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, in lists that together hold all of them."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + TEXT_SLICE)  # a term is not cut
        stop = gap.start() if gap else len(text)
        yield text[start:stop].translate(_TERM_BYTES).split()
        start = stop


def term_counts(text: bytes, wanted: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Number of all terms of a text and how often it holds each wanted one."""
    size, found = 0, Counter()
    for part in terms_of(text):
        size += len(part)
        found.update(part)
        if len(found) > 4 * TEXT_SLICE:  # only wanted terms need to be kept from part to part
            found = Counter({t: n for t, n in found.items() if t in wanted})
    return size, {wanted[t]: n for t, n in found.items() if t in wanted}


def document_terms(docs: DataFrame, wanted: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, size, terms, counts``: per row its number of terms and those of ``wanted`` it holds."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            content = batch.column(1)
            content = content.cast(pa.large_binary() if pa.types.is_large_string(content.type) else pa.binary())
            sizes, terms, counts = [], [], []
            for value in content:
                size, found = term_counts(value.as_py() or b"", held.value)
                sizes.append(size)
                terms.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], ["id", "size", "terms", "counts"])

    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, size bigint, terms array<int>, counts array<bigint>")


@dataclass
class PostingList:
    """Rows of a block that hold a term, in document order, with their scores and window maxima."""

    rows: np.ndarray
    scores: np.ndarray
    bound: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    maxima: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def bounded(self, windows: int) -> PostingList:
        """With the first entry and the highest score of each window."""
        self.starts = np.searchsorted(self.rows, np.arange(windows + 1) * WINDOW)
        self.maxima = np.zeros(windows, dtype=np.int64)
        np.maximum.at(self.maxima, self.rows // WINDOW, self.scores)
        self.bound = int(self.maxima.max(initial=0))
        return self


def posting_lists(sizes: list[int], terms: np.ndarray, counts: np.ndarray, per_row: np.ndarray,
                  weights: np.ndarray, documents: int, all_terms: int) -> dict[int, PostingList]:
    """Lists of a block's terms with the score that one occurrence in a query adds."""
    # Python integers first: length times document count may pass 64 bits before the division.
    norms = np.array([75 + (25 * n * documents) // all_terms for n in sizes], dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), per_row)
    scores = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * norms[rows]))
    order = np.lexsort((rows, terms))
    terms, rows, scores = terms[order], rows[order], scores[order]
    edges = np.flatnonzero(np.diff(terms, prepend=-1, append=-1))
    return {int(terms[a]): PostingList(rows[a:b], scores[a:b]) for a, b in zip(edges[:-1], edges[1:])}


def accumulate(lists: list[tuple[PostingList, int]]) -> PostingList:
    """Sum short lists term at a time: one list of their rows with the added scores."""
    rows = np.concatenate([x.rows for x, _ in lists])
    scores = np.concatenate([x.scores * times for x, times in lists])
    order = np.argsort(rows, kind="stable")
    rows, scores = rows[order], scores[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return PostingList(rows[first], np.add.reduceat(scores, first))


def search_block(lists: list[tuple[PostingList, int]], windows: int, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of a block's ``top`` documents of score ``floor`` and more, best first.

    ``lists`` are the bounded lists of one query, each with its repeats in the query.  Rows
    of equal score stay in document order.
    """
    lists = sorted(lists, key=lambda x: -x[0].bound * x[1])
    reach = np.array([x.maxima * times for x, times in lists]).reshape(len(lists), windows)
    bounds = np.cumsum(reach[::-1], axis=0)[::-1]  # per window, of all lists from the i-th on
    best_rows, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for window in np.flatnonzero(bounds[0] >= floor).tolist():
        below = bounds[:, window].tolist()
        if below[0] < floor:
            continue  # the floor rose since
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, (entry, times) in enumerate(lists):
            part = slice(entry.starts[window], entry.starts[window + 1])
            own, added = entry.rows[part], entry.scores[part] * times
            if below[i] >= floor:
                # Documents of this list alone could still be reported: all become candidates.
                rows = np.concatenate([rows, own])
                order = np.argsort(rows, kind="stable")
                scores = np.concatenate([scores, added])[order]
                rows = rows[order]
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                if len(first):
                    rows, scores = rows[first], np.add.reduceat(scores, first)
            else:
                alive = scores + below[i] >= floor
                rows, scores = rows[alive], scores[alive]
                if not len(rows):
                    break
                place = np.searchsorted(own, rows)
                hit = place < len(own)
                hit[hit] = own[place[hit]] == rows[hit]
                scores[hit] += added[place[hit]]
        reported = scores >= floor
        best_rows = np.concatenate([best_rows, rows[reported]])
        best_scores = np.concatenate([best_scores, scores[reported]])
        if len(best_rows) >= top:
            order = np.lexsort((best_rows, -best_scores))[:top]
            best_rows, best_scores = best_rows[order], best_scores[order]
            floor = max(floor, int(best_scores[-1]) + 1)  # later rows of the block lose a tie
    order = np.lexsort((best_rows, -best_scores))
    return best_rows[order], best_scores[order]


class _Searcher:
    """The best documents per query of all blocks that one task has seen."""

    def __init__(self, queries: dict[int, dict[int, int]], weights: np.ndarray, documents: int, all_terms: int,
                 options: SearchOptions):
        self.queries, self.weights, self.options = queries, weights, options
        self.documents, self.all_terms = documents, all_terms
        self.best: dict[int, list[tuple[int, object]]] = {}

    def add(self, ids: list, sizes: list[int], terms: np.ndarray, counts: np.ndarray, per_row: np.ndarray) -> None:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))  # document order: ties go by id
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        ids, sizes = [ids[i] for i in order], [sizes[i] for i in order]
        # Rows of the postings follow the documents.
        moved = np.argsort(np.repeat(place, per_row), kind="stable")
        lists = posting_lists(sizes, terms[moved], counts[moved], per_row[order], self.weights, self.documents, self.all_terms)
        windows = -(-len(ids) // WINDOW)
        short = max(1, len(ids) // self.options.short_share)
        for entry in lists.values():
            if len(entry.rows) > short:
                entry.bounded(windows)
        top = self.options.top
        for number, wanted in self.queries.items():
            mine = [(lists[t], times) for t, times in wanted.items() if t in lists]
            brief = [x for x in mine if len(x[0].rows) <= short]
            long = [x for x in mine if len(x[0].rows) > short]
            if brief:
                long.append((accumulate(brief).bounded(windows), 1))
            if not long:
                continue
            best = self.best.get(number, [])
            # Documents of a later block may have smaller ids, so equal scores still count.
            floor = best[-1][0] if len(best) == top else 1
            rows, scores = search_block(long, windows, top, floor)
            if len(rows):
                found = best + [(s, ids[r]) for r, s in zip(rows.tolist(), scores.tolist())]
                self.best[number] = sorted(found, key=lambda x: (-x[0], x[1] is None, x[1]))[:top]


def _searched(stored: DataFrame, queries: dict[int, dict[int, int]], weights: np.ndarray, documents: int,
              all_terms: int, options: SearchOptions) -> DataFrame:
    """``item, id, score``: the best documents of each task for each query."""
    held = stored.sparkSession.sparkContext.broadcast((queries, weights))
    kind = stored.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        own = _Searcher(*held.value, documents, all_terms, options)
        id_type = None
        ids, sizes, parts, postings = [], [], [], 0

        def search():
            nonlocal ids, sizes, parts, postings
            if ids:
                own.add(ids, sizes, *(np.concatenate(x) for x in zip(*parts)))
            ids, sizes, parts, postings = [], [], [], 0

        for whole in batches:
            id_type = whole.column(0).type
            for start in range(0, whole.num_rows, WINDOW):
                batch = whole.slice(start, WINDOW)
                ids += batch.column(0).to_pylist()
                sizes += batch.column(1).to_pylist()
                terms, counts = batch.column(2), batch.column(3)
                parts.append((terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy(),
                              terms.value_lengths().to_numpy(zero_copy_only=False)))
                postings += len(parts[-1][0])
                if len(ids) >= options.block_documents or postings >= options.block_postings:
                    search()
        search()
        found = [(number, key, score) for number, best in own.best.items() for score, key in best]
        for start in range(0, len(found), 10_000):
            items, keys, scores = zip(*found[start:start + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(keys, id_type), pa.array(scores, pa.int64())],
                                             ["item", "id", "score"])

    return stored.select("id", "size", "terms", "counts").where("size > 0").mapInArrow(run, f"item bigint, id {kind}, score bigint")


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """``queries`` plus ``terms`` and ``times``: each query's distinct terms and their repeats."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [Counter(t for part in terms_of((x.as_py() or "").encode()) for t in part) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([[t.decode() for t in x] for x in found], pa.list_(pa.string())),
                 pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))], ["item", "terms", "times"])

    return queries.select(F.col(text).cast("string").alias("text"), "item").mapInArrow(
        run, "item bigint, terms array<string>, times array<bigint>")


def _query_blocks(queries: DataFrame, limit: int) -> Iterator[tuple[dict[bytes, int], dict[int, dict[int, int]]]]:
    """The query set in parts whose distinct terms hold about ``limit`` bytes."""
    wanted: dict[bytes, int] = {}
    part: dict[int, dict[int, int]] = {}
    size = 0
    for row in queries.toLocalIterator():
        own = {}
        for term, times in zip(row["terms"], row["times"]):
            raw = term.encode()
            if raw not in wanted:
                size += len(raw)
            own[wanted.setdefault(raw, len(wanted))] = times
        size += 8 * len(own)
        part[row["item"]] = own
        if size >= limit:
            yield wanted, part
            wanted, part, size = {}, {}, 0
    if part:
        yield wanted, part


def search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id",
           query_text: str = "text", options: SearchOptions = SearchOptions()) -> DataFrame:
    """``query_key, rank, key, score``: the ``top`` best rows of ``docs`` for each row of ``queries``.

    Terms are maximal runs of digits, ASCII letters (A-Z lower-cased) and characters beyond
    ASCII, of the whole text.  With N documents that hold a term, L terms in them, n terms in
    a document and a term in df of them, its weight is floor(1000 ln((2N+2)/(2df+1))); a
    document adds weight * (10^9 tf div (1000 tf + 12 (75 + 25 n N div L))) for each repeat of
    a term in the query.  Rows come by score, then by ascending ``key`` (null keys last);
    scores of 0 are left out.

    Null and empty texts hold no term and are never found; a null or empty query finds
    nothing.  Rows that repeat are ranked each by itself, in documents and queries.  An empty
    table on either side gives no rows.  Other columns are not read.  A query set beyond
    ``query_bytes`` of terms is searched in several passes over the documents.
    """
    kind = queries.schema[query_key].dataType.simpleString()
    with scratch_scope(docs.sparkSession) as keep:
        # Queries are numbered, so that keys of any type that may repeat or be null stay apart.
        numbered = cut_lineage(queries.select(
            F.monotonically_increasing_id().alias("item"), F.col(query_key).alias("query"), F.col(query_text).alias("text")))
        parts = []
        for wanted, part in _query_blocks(query_terms(numbered, "text"), options.query_bytes):
            stored = cut_lineage(document_terms(docs, wanted, key, text))
            sizes = stored.where("size > 0").agg(F.count(F.lit(1)), F.sum("size")).first()
            documents, all_terms = sizes[0], sizes[1] or 0
            weights = np.zeros(max(1, len(wanted)), dtype=np.int64)
            # One row per term of this part of the queries.
            for row in stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
                weights[row["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row["count"] + 1)))
            parts.append(cut_lineage(_searched(stored, part, weights, documents, all_terms, options)))
        if not parts:
            return docs.sparkSession.createDataFrame(
                [], f"{query_key} {kind}, rank int, {key} {docs.schema[key].dataType.simpleString()}, score bigint")
        found = parts[0]
        for more in parts[1:]:
            found = found.unionAll(more)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.top)
        return keep(ranked.join(numbered.select("item", "query"), "item").select(
            F.col("query").alias(query_key), "rank", F.col("id").alias(key), "score"))
