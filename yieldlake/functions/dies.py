"""Expressions over 2-D die maps stored as ``array<array<tinyint>>``.

Cells are 0 outside, 1 good and 2 failed.  Counts use array built-ins that compile to
loops; a lambda runs only where cells are gathered.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Class order and accepted spellings.
CLASS_NAMES = ("None", "Center", "Donut", "Edge-Loc", "Edge-Ring", "Loc", "Near-Full", "Random", "Scratch")
LABEL_ALIASES = {"none": "None", "Near-full": "Near-Full"}
MAX_CELLS = 1_000_000
CELLS_HELD = 1 << 22  # resized cells that a task holds at a time
MAP_ERRORS = ("INVALID_MAP_STRUCTURE", "INVALID_MAP_SIZE_OR_DTYPE", "INVALID_MAP_VALUES", "NO_VALID_DIE")


def stripped(text: Column) -> Column:
    """Text without surrounding white space; null when nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def scalar_text(value: Column, dtype: T.DataType) -> Column:
    """Metadata value as text: trimmed strings, finite numbers, otherwise null."""
    if isinstance(dtype, T.ArrayType):
        return scalar_text(F.when(F.size(value) == 1, F.get(value, F.lit(0))), dtype.elementType)
    if isinstance(dtype, T.StringType):
        return stripped(value)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(value) < F.lit(float("inf")), value.cast("string"))
    if isinstance(dtype, T.IntegralType):
        return value.cast("string")
    return F.lit(None).cast("string")


def normalized_label(value: Column, dtype: T.DataType) -> Column:
    """Struct ``(pattern_label, class_index, label_status)`` of a raw, possibly nested, label."""
    depth_invalid = F.lit(False)
    empty = F.lit(False)
    while isinstance(dtype, T.ArrayType):
        depth_invalid = depth_invalid | F.coalesce(F.size(value) > 1, F.lit(False))
        empty = empty | F.coalesce(F.size(value) == 0, F.lit(False))
        value, dtype = F.get(value, F.lit(0)), dtype.elementType
    nothing = F.lit(None).cast("string")
    if isinstance(dtype, T.StringType):
        text = stripped(value)
        alias = F.create_map(*[F.lit(x) for pair in LABEL_ALIASES.items() for x in pair])
        name = F.coalesce(F.element_at(alias, text), text)
        place = F.array_position(F.array(*map(F.lit, CLASS_NAMES)), name)
        known = ~depth_invalid & ~empty & (place > 0)
        status = F.when(depth_invalid, "invalid").when(empty | text.isNull(), "unlabeled").when(
            place > 0, "labeled").otherwise("invalid")
        return F.struct(
            F.when(known, name).otherwise(nothing).alias("pattern_label"),
            F.when(known, (place - 1).cast("int")).alias("class_index"), status.alias("label_status"))
    blank = value.isNull()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        blank = blank | F.isnan(value)
    status = F.when(depth_invalid, "invalid").when(empty | blank, "unlabeled").otherwise("invalid")
    return F.struct(nothing.alias("pattern_label"), F.lit(None).cast("int").alias("class_index"),
                    status.alias("label_status"))


def map_error(cells: Column) -> Column:
    """First failing map rule as a code, or null for a usable map."""
    height, width = F.size(cells), F.size(F.get(cells, F.lit(0)))
    flat = F.flatten(cells)
    shaped = cells.isNotNull() & (height > 0) & F.coalesce(width > 0, F.lit(False)) & F.coalesce(
        F.size(F.array_distinct(F.transform(cells, lambda r: F.size(r)))) == 1, F.lit(False))
    seen = F.array_distinct(flat)
    valid_values = F.size(F.array_except(seen, F.array(*[F.lit(v).cast("tinyint") for v in (0, 1, 2)]))) == 0
    some = F.array_contains(seen, F.lit(1).cast("tinyint")) | F.array_contains(seen, F.lit(2).cast("tinyint"))
    return (
        F.when(~F.coalesce(shaped, F.lit(False)), MAP_ERRORS[0])
        .when(height.cast("bigint") * width > MAX_CELLS, MAP_ERRORS[1])
        .when(~F.coalesce(valid_values, F.lit(False)), MAP_ERRORS[2])
        .when(~F.coalesce(some, F.lit(False)), MAP_ERRORS[3])
    )


def valid_count(cells: Column) -> Column:
    return F.size(F.array_remove(F.flatten(cells), F.lit(0).cast("tinyint")))


def failed_count(cells: Column) -> Column:
    flat = F.flatten(cells)
    return F.size(flat) - F.size(F.array_remove(flat, F.lit(2).cast("tinyint")))


def _uint64_hex(value: Column) -> Column:
    """Little-endian 8-byte hex of a non-negative int."""
    parts = [F.lpad(F.hex(F.shiftright(value.cast("bigint"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)]
    return F.concat(*parts, F.lit("00000000"))


def content_hash(cells: Column) -> Column:
    """SHA-256 over height and width as little-endian 64-bit integers and the row-major cells."""
    body = F.concat(F.lit("0"), F.array_join(F.flatten(cells).cast("array<string>"), "0"))
    text = F.concat(_uint64_hex(F.size(cells)), _uint64_hex(F.size(F.get(cells, F.lit(0)))), body)
    return F.sha2(F.unhex(text), 256)


def resize_geometry(height: Column, width: Column, target_h: int, target_w: int) -> Column:
    """Size and placement of the aspect-preserving resize, in integer arithmetic."""
    h, w = height.cast("bigint"), width.cast("bigint")
    tall = F.lit(target_h) * w <= F.lit(target_w) * h
    top = F.when(tall, F.lit(target_h)).otherwise(F.lit(target_w)).cast("bigint")
    bottom = F.when(tall, h).otherwise(w)

    def scaled(length: Column, limit: int) -> Column:
        doubled = F.floor((2 * length * top + bottom) / (2 * bottom))
        return F.least(F.lit(limit).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), doubled)).cast("int")

    new_h, new_w = scaled(h, target_h), scaled(w, target_w)
    above = F.floor((F.lit(target_h) - new_h) / 2).cast("int")
    left = F.floor((F.lit(target_w) - new_w) / 2).cast("int")
    return F.struct(
        height.cast("int").alias("original_height"), width.cast("int").alias("original_width"),
        new_h.alias("resized_height"), new_w.alias("resized_width"),
        (top.cast("double") / bottom.cast("double")).alias("scale"),
        above.alias("top"), left.alias("left"),
        (F.lit(target_h) - new_h - above).alias("bottom"), (F.lit(target_w) - new_w - left).alias("right"))


def resized(cells: Column, geometry: Column, target_h: int, target_w: int) -> Column:
    """Nearest-cell resize with centred zero padding.

    Output cell i reads source cell ``((2 i + 1) * length) div (2 * new length)``.  Cells
    are gathered with numpy over Arrow batches: a lambda per cell costs several times more
    at model size.  A batch is answered in parts of bounded size.
    """
    g = geometry
    return _gathered(target_h, target_w)(cells, g["resized_height"], g["resized_width"], g["top"], g["left"])


@lru_cache(maxsize=16)
def _gathered(target_h: int, target_w: int):
    def gather(batches):
        import numpy as np
        import pyarrow as pa

        def picks(length, count):
            return ((2 * np.arange(count, dtype=np.int64) + 1) * length) // (2 * count)

        def resize(rows):
            out = np.zeros((len(rows), target_h, target_w), dtype=np.int8)
            known = np.zeros(len(rows), dtype=bool)
            for k, (value, h, w, y, x) in enumerate(rows):
                known[k] = value is not None and None not in (h, w, y, x)
                if known[k]:
                    source = np.array(value, dtype=np.int8)
                    out[k, y:y + h, x:x + w] = source[picks(source.shape[0], h)][:, picks(source.shape[1], w)]
            lines = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, target_w, dtype=np.int32)), pa.array(out.ravel()))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * target_h + 1, target_h, dtype=np.int32)), lines,
                                            mask=pa.array(~known))

        for columns in batches:
            for start in range(0, len(columns[0]), step):
                yield resize(list(zip(*(c.slice(start, step).to_pylist() for c in columns))))

    # A batch of small maps may be large at model size, so it is answered in parts.
    step = max(1, CELLS_HELD // (target_h * target_w))
    return F.arrow_udf(gather, "array<array<tinyint>>", F.ArrowUDFType.SCALAR_ITER)


def channels(cells: Column) -> Column:
    """Two 0/1 masks ``[defect, valid]`` as float arrays."""
    def mask(test) -> Column:
        return F.transform(cells, lambda r: F.transform(r, lambda c: test(c).cast("float")))
    return F.array(mask(lambda c: c == 2), mask(lambda c: c > 0))
