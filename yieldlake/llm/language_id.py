"""Language of a text: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased; every run of bytes that are no letters becomes one separator, and
all windows of two to four bytes are hashed into buckets.  The mean of the bucket
embeddings goes through a linear softmax.  Embeddings and weights are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows.  A held-out part of the
sample sets the softmax temperature and the confidence under which a text is rejected.

Since the model is linear, embeddings times weights give one row of class scores per
bucket; predicting a whole text, however long, only averages those rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 16
DIMENSIONS = 16
SIZES = (2, 3, 4)
SLICE_BYTES = 1 << 20
_IS_LETTER = np.array([c >= 128 or 97 <= c <= 122 for c in range(256)])


@dataclass(frozen=True)
class LanguageOptions:
    """Bounds and rates of the fit; the sample is the only part of the data that it reads."""

    rows_per_language: int = 1500  # expected sample rows of each language
    max_languages: int = 500  # the most frequent ones are learned; rows of others do not train
    max_sample_characters: int = 2000  # of a sampled text, from a random place; predictions read whole texts
    calibration_share: float = 0.25
    epochs: int = 6
    rate: float = 30.0
    false_rejections: float = 0.001  # share of correct calibration rows that the threshold may reject
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    scores: np.ndarray  # buckets x languages: embeddings times weights over the temperature
    bias: np.ndarray
    threshold: float


def buckets_of(data: np.ndarray) -> np.ndarray:
    """Bucket of every window of a lower-cased UTF-8 text; empty when it has no letter bytes."""
    letter = _IS_LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first byte after a run of letters stands for the gap
    clean = np.where(letter, data, 32)[keep].astype(np.uint32)
    clean = np.concatenate(([32], clean, [32])).astype(np.uint32)
    found = []
    for size in SIZES:
        count = len(clean) - size + 1
        if count > 0:
            code = np.full(count, size * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
            for k in range(size):
                code = (code ^ clean[k:k + count]) * np.uint32(0x01000193)
            code ^= code >> np.uint32(15)
            found.append((code * np.uint32(0x85EBCA6B)) >> np.uint32(16))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text that overlap by one window, so that a very long text needs little memory."""
    step = SLICE_BYTES
    for start in range(0, max(1, len(data)), step):
        yield data[start:start + step + max(SIZES) - 1]


def has_letter(text: str) -> bool:
    """Whether a text has a letter; number signs such as ² or Ⅷ are none."""
    return any(map(str.isalpha, text))


def predict_text(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """Most likely language and its calibrated probability; ``und`` and 0 without any letter."""
    if text is None or not has_letter(text):
        return UNKNOWN, 0.0
    total, count = np.zeros(len(model.languages)), 0
    for part in _pieces(_bytes(text)):
        found = buckets_of(part)
        counts = np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS // 4 else None
        total += counts @ model.scores if counts is not None else model.scores[found].sum(axis=0, dtype=np.float64)
        count += len(found)
    logits = total / max(1, count) + model.bias
    logits -= logits.max()
    shares = np.exp(logits)
    shares /= shares.sum()
    best = int(shares.argmax())
    return model.languages[best], float(shares[best])


def _sparse(texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        unique, counts = np.unique(buckets_of(_bytes(text)), return_counts=True)
        out.append((unique, counts / max(1, counts.sum())))
    return out


def fit(texts: Sequence[str], languages: Sequence[str], options: LanguageOptions = LanguageOptions()) -> LanguageModel:
    """Train on a bounded list of labelled texts and calibrate on a held-out part of it."""
    names = tuple(sorted(set(languages)))
    if not names:
        return LanguageModel((), np.zeros((BUCKETS, 0)), np.zeros(0), 0.0)
    rng = np.random.default_rng(options.seed)
    place = {name: i for i, name in enumerate(names)}
    wanted = np.array([place[x] for x in languages])
    features = _sparse(texts)
    order = rng.permutation(len(features))
    held = max(1, int(len(order) * options.calibration_share)) if len(order) >= 20 else 0
    calibration, training = order[:held], order[held:]
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = rng.normal(0, 0.1, (len(names), DIMENSIONS))
    bias = np.zeros(len(names))
    for epoch in range(options.epochs):
        rate = options.rate * (1 - epoch / options.epochs)
        for i in rng.permutation(training):
            index, share = features[i]
            hidden = share @ table[index]
            error = _softmax(weights @ hidden + bias)
            error[wanted[i]] -= 1
            table[index] -= rate * np.outer(share, error @ weights)
            weights -= 0.05 * np.outer(error, hidden)
            bias -= 0.01 * error
    scores = table @ weights.T
    judged = calibration if held else training
    logits = np.array([features[i][1] @ scores[features[i][0]] + bias for i in judged])
    truth = wanted[judged]
    # One temperature: the smallest loss over a fixed grid.
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    losses = [-np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(truth)), truth])).mean() for t in grid]
    heat = float(grid[int(np.argmin(losses))])
    shares = _softmax(logits / heat)
    right = shares.max(axis=1)[shares.argmax(axis=1) == truth]
    threshold = float(np.quantile(right, options.false_rejections)) if len(right) else 0.0
    # Never reject what is clearly above chance: calibration rows may all be easy.
    threshold = min(threshold, 1 / len(names) + 0.5 * (1 - 1 / len(names)))
    return LanguageModel(names, (scores / heat).astype(np.float32), bias / heat, threshold)


def _softmax(logits: np.ndarray) -> np.ndarray:
    shares = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shares / shares.sum(axis=-1, keepdims=True)


def labelled_sample(docs: DataFrame, text: str, lang: str, key: str, options: LanguageOptions) -> tuple[list[str], list[str]]:
    """About ``rows_per_language`` rows of each language, chosen by a hash of the key over all rows.

    A frequent language is thinned by its exact count.  Of a sampled text, a window from a
    random place is kept whose length also varies, so that short texts are learned too.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = labelled.groupBy(F.col(lang).alias("__lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "__lang").limit(options.max_languages).collect()
    if not counts:
        return [], []
    shares = F.create_map(*[x for row in counts for x in (F.lit(row["__lang"]), F.lit(min(1.0, options.rows_per_language / row["n"])))])

    def draw(salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(options.seed + salt), F.col(key)), F.lit(1 << 20)) / float(1 << 20)

    length = F.greatest(F.lit(20), (F.pow(draw(1), 2) * options.max_sample_characters).cast("int"))
    start = (draw(2) * F.greatest(F.lit(0), F.length(text) - length)).cast("int") + 1
    rows = labelled.where(draw(0) < F.element_at(shares, F.col(lang))).select(
        F.substring(F.col(text), start, length).alias("text"), F.col(lang).alias("lang"), draw(3).alias("o"), F.col(key).cast("string").alias("k"))
    # Rows that share a key are drawn together: a hard bound keeps the sample small even then.
    sample = rows.orderBy("o", "k", "lang", "text").limit(2 * options.rows_per_language * len(counts)).toPandas()
    return sample["text"].tolist(), sample["lang"].tolist()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          options: LanguageOptions = LanguageOptions()) -> LanguageModel:
    """Fit on the labelled rows of ``docs``; ``key`` only decides which rows are sampled."""
    return fit(*labelled_sample(docs, text, lang, key, options), options)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (0 to 1) and ``accepted``.

    ``lang_pred`` is ``und``, with score 0 and not accepted, for null text, text without a
    letter, and for a model that was trained on no rows.  Other texts have the most likely
    language; they are accepted when its probability reaches the calibrated threshold.
    Columns of ``docs`` with those names are replaced; repeated rows get equal results.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def judge(texts):
        import pyarrow as pa
        own = held.value
        found = [predict_text(own, x.as_py()) if own.languages else (UNKNOWN, 0.0) for x in texts]
        return pa.StructArray.from_arrays([
            pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
            pa.array([x[0] != UNKNOWN and x[1] >= own.threshold for x in found], pa.bool_()),
        ], ["lang_pred", "score", "accepted"])

    judge_type = judge(F.col(text).cast("string"))
    return docs.drop("lang_pred", "score", "accepted").withColumn("__judged", judge_type).select(
        "*", "__judged.lang_pred", "__judged.score", "__judged.accepted").drop("__judged")


def held_out(key: Column) -> Column:
    """Documents that are kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
