"""Byte-pair encoding and decoding with a SentencePiece model, by a merge-type prefix table.

Greedy merging gives every prefix of a word exactly one last token, and two neighbouring
tokens stay apart in a text just when they stay apart on their own.  So a word is encoded
from left to right: an automaton lists the vocabulary entries that end at each position,
the entry that is compatible with the last token of the prefix before it is that
position's last token, and the ids are recovered backwards through the table.

No vocabulary entry joins letters with other characters or holds the space mark behind
another character (checked when the model is loaded), so no merge crosses the edge of a
word, which is a run of letters or a run of anything else behind its space marks.  Words
are encoded on their own and kept in a bounded cache.  Work and memory are linear in the
text, also for a text that is one long word.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldlake.llm.shingles import release_memory

MARK = "▁"
CACHED_WORDS = 100_000  # in each of two generations; about 350 bytes a word
CACHED_PAIRS = 200_000
CACHED_LENGTH = 64  # longer words are encoded each time


class PieceCodec:
    """Encoder and decoder of one model file with identity normalisation and byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as source:
            model.ParseFromString(source.read())
        spec, kinds = model.normalizer_spec, model.SentencePiece
        if (spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix
                or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback):
            raise ValueError("only identity models with a dummy prefix and byte fallback are handled")
        # Superscripts and the like count as letters in a pattern, but not here.
        odd = re.escape("".join(sorted({c for p in model.pieces for c in p.piece if c.isalnum() and not c.isalpha()})))
        letter, other = rf"[^\W\d_{odd}]", rf"(?:(?!{MARK})[\W\d_{odd}])"
        self.split = re.compile(rf"{MARK}*{letter}+|{MARK}*{other}+|{MARK}+").findall
        crossing = re.compile(rf"[^{MARK}]{MARK}|{letter}{other}|{other}{letter}")
        self.surface: list[str | None] = []
        self.pieces = [piece.piece for piece in model.pieces]
        self.byte_of: dict[int, int] = {}
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        for i, piece in enumerate(model.pieces):
            self.surface.append(None)
            if piece.type == kinds.NORMAL:
                if crossing.search(piece.piece):
                    raise ValueError(f"a piece crosses words: {piece.piece!r}")
                self.id_of[piece.piece], self.score[piece.piece] = i, piece.score
                self.surface[i] = piece.piece.replace(MARK, " ")
            elif piece.type == kinds.BYTE:
                self.byte_of[i] = int(piece.piece[3:5], 16)
            elif piece.type not in (kinds.UNKNOWN, kinds.CONTROL):
                raise ValueError(f"piece type {piece.type} is not handled")
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.apart: dict[int, bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        # Entries that greedy merging never yields on their own would break the table.
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            if len(self.merged(piece)) == 1:
                self.automaton.add_word(piece, (len(piece), self.id_of[piece]))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """Greedy merging by definition: best score first, leftmost among equals (short strings only)."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1),
                       key=lambda i: (self.score.get(parts[i] + parts[i + 1], float("-inf")), -i))
            joined = parts[best] + parts[best + 1]
            if joined not in self.score:
                break
            parts[best:best + 2] = [joined]
        return parts

    def together(self, pair: int) -> bool:
        """Whether the tokens ``left << 16 | right`` remain apart when they stand next to each other."""
        if len(self.apart) >= CACHED_PAIRS:
            self.apart.clear()
        left, right = self.pieces[pair >> 16], self.pieces[pair & 0xFFFF]
        found = self.apart[pair] = self.merged(left + right) == [left, right]
        return found

    def tokens(self, word: str) -> list[int]:
        """Ids of one word; a character outside the vocabulary gives the ids of its bytes."""
        last = [-1] * len(word)  # last[i]: the token that ends at position i; -1 a character outside
        apart = self.apart.get
        for end, (size, token) in self.automaton.iter(word):
            if last[end] < 0:
                before = end - size
                left = last[before] if before >= 0 else -1
                if left >= 0:
                    known = apart(pair := left << 16 | token)
                    if not (self.together(pair) if known is None else known):
                        continue
                last[end] = token
        out = []
        at = len(word) - 1
        while at >= 0:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= len(self.pieces[token])
            else:
                out.extend([self.id_of_byte[b] for b in reversed(word[at].encode())])
                at -= 1
        return out[::-1]

    def word(self, word: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, and decoded text of a word."""
        found = self.older.get(word)
        if found is None:
            ids = self.tokens(word)
            found = len(ids), ",".join(map(str, ids)), self.decode(ids)
        if len(word) <= CACHED_LENGTH:
            if len(self.known) >= CACHED_WORDS:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def forget(self) -> None:
        """Empty the caches."""
        self.known, self.older, self.apart = {}, {}, {}

    def words(self, text: str) -> list[tuple[int, str, str]]:
        """``word`` of each word of the text in turn."""
        return [self.known.get(w) or self.word(w) for w in self.split(MARK + text.replace(" ", MARK))] if text else []

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.words(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of ids, with the space before the first word kept; bad byte runs give U+FFFD."""
        surfaces = [self.surface[i] for i in ids]
        if None not in surfaces:
            return "".join(surfaces)
        out: list[str] = []
        run = bytearray()
        for i in [*ids, None]:
            if i is not None and i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i is not None:
                surface = self.surface[i]
                if surface is None:
                    raise ValueError(f"id {i} has no text")
                out.append(surface)
        return "".join(out)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Token count, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        counts, ids, decoded = zip(*self.words(text)) if text else ((), (), ())
        return (sum(counts), sha256(",".join(ids).encode()).hexdigest(),
                sha256("".join(decoded).removeprefix(" ").encode()).hexdigest())


@lru_cache(maxsize=4)
def codec(model_file: str) -> PieceCodec:
    """One codec per model and Python worker."""
    return PieceCodec(model_file)


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """Add ``out``: the ids of each whole text, array<int>; null and empty text give an empty array."""
    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        own = codec(model_file)
        return pd.Series([own.encode(t or "") for t in texts])
    return docs.withColumn(out, encoded(F.col(text)))


def decode_ids(rows: DataFrame, model_file: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of each id array without the dummy space; null gives empty text."""
    @F.pandas_udf("string")
    def decoded(arrays: pd.Series) -> pd.Series:
        own = codec(model_file)
        return pd.Series(["" if x is None else own.decode([int(i) for i in x]).removeprefix(" ") for x in arrays])
    return rows.withColumn(out, decoded(F.col(ids)))


def piece_digests(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` per row of ``docs``.

    Encodes every whole text and decodes its ids, without holding either list.  Null text
    counts as empty; repeated rows and null keys are kept, an empty table gives no rows,
    and other columns are not read.
    """
    def run(batches):
        import pyarrow as pa
        own = codec(model_file)
        for batch in batches:
            found = [own.digest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string()),
            ], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()  # the worker lives on for tasks of other stages
        release_memory()

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
