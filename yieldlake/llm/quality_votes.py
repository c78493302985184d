"""Quality of a text by a vote of its nearest labelled texts in a latent semantic space.

Terms are hashed: windows of three and four lower-cased bytes carry the content, windows of
up to three character classes carry the form (capitals, digits, single signs), and a scale of
terms each tells how large a share of the words stands twice in a row or comes again.  A bounded sample of labelled rows
gives term weights and, by a randomised singular value decomposition, the latent space.  The
labelled vectors are broadcast; every text is held against all of them in blocks of exact
cosine products, and its nearest neighbours vote with weights that follow their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 13
_CONTENT = BUCKETS // 2  # buckets of content windows; the rest is for the form
_GRADES = 10  # a share of repeated words sets as many of ten terms as it has tenths
_GRADE_COUNT = 1000  # count of each, so that it weighs like a frequent window
_TWICE, _AGAIN = BUCKETS - 2 * _GRADES, BUCKETS - _GRADES
SLICE_BYTES = 1 << 20
BLOCK_TEXTS = 256  # texts whose products are taken together; always filled up, so that equal texts score alike
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint32)
_CLASS = np.array([1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57
                   else 4 if c == 32 or 9 <= c <= 13 else c + 5 for c in range(256)], dtype=np.uint32)
_MULTIPLY = np.uint32(2654435761)


@dataclass(frozen=True)
class QualityOptions:
    """The sample bound is ``2 * rows_per_label`` rows; a row's features hold at most BUCKETS numbers."""

    rows_per_label: int = 2000
    dimensions: int = 64
    power_rounds: int = 2
    neighbours: int = 25
    sharpness: int = 8  # weight of a neighbour: its cosine to this power
    prior_votes: float = 0.05  # weight of the overall share, which decides where no neighbour is near
    least_score: float = 0.3
    seed: int = 5


@dataclass(frozen=True)
class QualityModel:
    term_weights: np.ndarray
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # dimensions x labelled rows, of length one
    votes: np.ndarray  # labelled rows x 2: what a neighbour adds to label 1 and to all, by its label's true share
    share: float  # of label 1 among all labelled rows


def _buckets(codes: np.ndarray, salt: int, size: int) -> np.ndarray:
    mixed = (codes ^ np.uint32(salt)) * _MULTIPLY
    mixed ^= mixed >> np.uint32(15)
    return (mixed * _MULTIPLY >> np.uint32(8)) % np.uint32(size)


def term_counts(text: bytes) -> np.ndarray:
    """Counts of all hashed terms of a UTF-8 text, read in slices."""
    found = np.zeros(BUCKETS, dtype=np.int64)
    form = _TWICE - _CONTENT
    size = twice = again = 0
    for start in range(0, len(text), SLICE_BYTES):
        part = text[max(0, start - 3):start + SLICE_BYTES]
        fresh = min(start, 3)  # bytes that the slice before has counted
        data = np.frombuffer(part, dtype=np.uint8)
        low, kind = _LOWER[data], _CLASS[data]
        three = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
        four = (three[:-1] << np.uint32(8)) | low[3:]
        for codes, width, salt in ((three, 3, 0x1B873593), (four, 4, 0x85EBCA6B)):
            found[:_CONTENT] += np.bincount(_buckets(codes[max(0, fresh - width + 1):], salt, _CONTENT), minlength=_CONTENT)
        two = (kind[:-1] << np.uint32(9)) | kind[1:]
        last = (two[:-1] << np.uint32(9)) | kind[2:]
        for codes, width, salt in ((kind, 1, 0x27D4EB2F), (two, 2, 0x165667B1), (last, 3, 0x9E3779B1)):
            found[_CONTENT:_TWICE] += np.bincount(_buckets(codes[max(0, fresh - width + 1):], salt, form), minlength=form)
        words = part[fresh:].lower().split()
        size += len(words)
        twice += sum(map(bytes.__eq__, words, words[1:]))
        again += len(words) - len(set(words))
    for first, n in ((_TWICE, twice), (_AGAIN, again)):
        found[first:first + -(-_GRADES * n // max(1, size))] = _GRADE_COUNT
    return found


def _weighted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index = np.flatnonzero(counts)
    return index, np.log1p(counts[index].astype(np.float64))


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=-1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def fit(features: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], totals: tuple[int, int],
        options: QualityOptions = QualityOptions()) -> QualityModel:
    """Term weights, latent space and labelled vectors of a bounded sample.

    ``features`` hold the present terms of a row and the logarithms of their counts, ``labels``
    are 0 or 1 and ``totals`` count all labelled rows of either label.
    """
    labels = np.asarray(labels, dtype=np.int64)
    share = totals[1] / sum(totals) if sum(totals) else 0.5
    present = np.zeros(BUCKETS)
    for index, _ in features:
        present[index] += 1
    weights = np.log((1 + len(features)) / (1 + present)) + 1
    rows = []
    for index, values in features:
        values = values * weights[index]
        rows.append((index, values / max(1e-12, np.sqrt(values @ values))))
    size = min(options.dimensions, max(1, len(rows)))
    rng = np.random.default_rng(options.seed)
    basis = rng.normal(size=(BUCKETS, size))
    for _ in range(options.power_rounds + 1):
        images = np.array([v @ basis[i] for i, v in rows]).reshape(len(rows), size)
        images = np.linalg.qr(images)[0] if len(rows) else images
        basis = np.zeros((BUCKETS, images.shape[1]))
        for (index, values), image in zip(rows, images):
            basis[index] += np.outer(values, image)
        basis = np.linalg.qr(basis)[0]
    vectors = _unit(np.array([v @ basis[i] for i, v in rows]).reshape(len(rows), basis.shape[1]))
    # The sample holds the labels in other shares than the table: a vote counts by what it stands for.
    drawn = np.bincount(labels, minlength=2)
    scale = np.array([totals[k] / max(1, drawn[k]) for k in (0, 1)])
    scale = scale / max(1e-12, scale.max(initial=0))
    own = scale[labels] if len(labels) else np.zeros(0)
    return QualityModel(weights, basis, np.ascontiguousarray(vectors.T), np.stack([own * labels, own], axis=1), share)


def latent(model: QualityModel, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Vector of length one of a text's terms; zero without terms."""
    return _unit((values * model.term_weights[index]) @ model.basis[index])


def vote(model: QualityModel, vectors: np.ndarray, options: QualityOptions = QualityOptions()) -> np.ndarray:
    """Scores of at most BLOCK_TEXTS vectors: the share of label 1 among weighted neighbours."""
    block = np.zeros((BLOCK_TEXTS, len(model.vectors)))
    block[:len(vectors)] = vectors
    near = block @ model.vectors
    held = min(options.neighbours, near.shape[1])
    if not held:
        return np.full(len(vectors), model.share)
    # Rows as near as the last neighbour all vote, so that the order of the sample decides nothing.
    least = np.partition(near, near.shape[1] - held, axis=1)[:, near.shape[1] - held, None]
    weights = np.where(near >= least, np.maximum(near, 0), 0) ** options.sharpness
    votes = weights @ model.votes
    scores = (votes[:, 0] + options.prior_votes * model.share) / (votes[:, 1] + options.prior_votes)
    return np.round(np.clip(scores[:len(vectors)], 0, 1), 9)


def _batch_texts(column) -> Iterator[bytes]:
    import pyarrow as pa
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                    options: QualityOptions) -> tuple[list, list[int], tuple[int, int]]:
    """Features and labels of up to ``rows_per_label`` rows a label, and the counts of all labels.

    Labels are drawn by a hash of their key, then joined with the texts; features are made in
    the tasks, so that only they come to the driver: at most six bytes for each of BUCKETS terms a row.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("__label"))
    counts = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    totals = (counts.get(0, 0), counts.get(1, 0))
    draw = F.pmod(F.xxhash64(F.lit(options.seed), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
    wanted = F.when(F.col("__label") == 1, options.rows_per_label / max(1, totals[1])).otherwise(
        options.rows_per_label / max(1, totals[0]))
    # The limit proves that the drawn labels may be broadcast.
    drawn = known.withColumn("__draw", draw).where(F.col("__draw") < wanted).orderBy("__draw", "__label").limit(2 * options.rows_per_label)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [_weighted(term_counts(x)) for x in _batch_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0].astype(np.int16).tobytes() for x in found], pa.binary()),
                 pa.array([x[1].astype(np.float32).tobytes() for x in found], pa.binary())], ["label", "draw", "terms", "logs"])

    rows = docs.select(key, F.col(text).cast("string").alias("__text")).join(F.broadcast(drawn), key).select("__label", "__draw", "__text")
    # Keys that repeat bring all their rows: the order and the limit keep the sample bounded even then.
    made = rows.mapInArrow(run, "label int, draw double, terms binary, logs binary").orderBy(
        "draw", "label", F.xxhash64("terms", "logs")).limit(2 * options.rows_per_label).collect()
    return ([(np.frombuffer(r["terms"], dtype=np.int16).astype(np.int64), np.frombuffer(r["logs"], dtype=np.float32)) for r in made],
            [r["label"] for r in made], totals)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          options: QualityOptions = QualityOptions()) -> QualityModel:
    """Fit on the rows of ``docs`` that ``labels`` marks 0 or 1; other labels and null keys are left out."""
    return fit(*labelled_sample(docs, labels, key, text, label, options), options)


def score_texts(docs: DataFrame, model: QualityModel, text: str = "text",
                options: QualityOptions = QualityOptions()) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``least_score`` on).

    Whole texts are read, in slices; equal texts score alike.  Null and empty texts, and all
    texts where no row was labelled, score the overall share of label 1 (0.5 without labels).
    Columns of ``docs`` with those names are replaced, rows that repeat stay, and an empty
    table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(texts):
        import pyarrow as pa

        own = held.value
        scores, block = [], []
        for value in _batch_texts(texts):
            block.append(latent(own, *_weighted(term_counts(value))))
            if len(block) == BLOCK_TEXTS:
                scores.append(vote(own, np.array(block), options))
                block = []
        if block:
            scores.append(vote(own, np.array(block), options))
        return pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return docs.drop("score", "predicted").withColumn("score", judge(F.col(text).cast("string"))).withColumn(
        "predicted", (F.col("score") >= options.least_score).cast("int"))


def held_out(key: Column) -> Column:
    """Rows that are kept from training: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
