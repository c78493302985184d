"""Vectorised word and shingle hashes over many texts at a time.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.  All
texts of a slice are hashed together with numpy: every byte and its place in the word give
64 scattered bits, their sum is the hash of the word (a polynomial modulo 2**64 would give
equal hashes to certain swapped texts), and five neighbouring word hashes give a shingle.  Hashes
are the same in every process.  A slice holds about a megabyte of text (a longer text
stands alone), so working memory does not follow the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

WIDTH = 5
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values evenly (finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_PLACES = mix(np.arange(1001, 1001 + WIDTH, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    forward = np.full(size, _BASE, dtype=np.uint64)
    back = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    forward[0] = back[0] = 1
    return np.cumprod(forward, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def slices(texts: Sequence[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together hold about SLICE_BYTES."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= SLICE_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and per text the index of its first word (one more at the end)."""
    joined = b"\n".join(t or b"" for t in texts).translate(_LOWER)
    data = np.frombuffer(joined, dtype=np.uint8)
    edges = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[data]
    turns = np.flatnonzero(np.diff(word))
    starts, ends = turns[0::2], turns[1::2]
    # Counts up along the text and jumps back to 0 at the start of each word; between words it does not matter.
    place = np.ones(len(data), dtype=np.int64)
    place[:1] = 0
    place[starts[1:]] -= starts[1:] - starts[:-1]
    if len(starts):
        place[starts[0]] -= starts[0]
    place = np.cumsum(place)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mix(_BYTES[data] + place.view(np.uint64) * np.uint64(_BASE)), dtype=np.uint64, out=total[1:])
    return mix(total[ends] - total[starts]), np.searchsorted(starts, edges)


def _windows(words: np.ndarray) -> np.ndarray:
    """Shingle that starts at each word (the last four positions of the array have none)."""
    count = len(words) - WIDTH + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = words[:count] * _PLACES[0]
    for k in range(1, WIDTH):
        total = total + words[k:k + count] * _PLACES[k]
    return mix(total)


def shingle_sets(texts: Sequence[bytes | None]) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingle hashes; with fewer than five words, one for the whole sequence.

    A text that is None or has no word gives an empty array.
    """
    for start, stop in slices(texts):
        words, first = word_hashes(texts[start:stop])
        windows = _windows(words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= WIDTH:
                yield np.unique(windows[a:b - WIDTH + 1])
            elif b > a:
                yield mix((words[a:b] * _PLACES[:b - a]).sum(dtype=np.uint64, keepdims=True)
                          + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def release_memory() -> None:
    """Give what freed batches left behind back to the system: a Python worker lives on for tasks of other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 values without decoding them."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
