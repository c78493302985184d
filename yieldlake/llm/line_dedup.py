"""Remove lines that repeat an earlier line of the collection, up to one edited character.

Lines are compared in lower case with white space collapsed.  Equal lines are one class,
held by its earliest place; every line that is not blank goes when it repeats (``exact_chars``
may raise the least length).  Lines of ``MIN_CHARS`` characters or more that are near meet in a
deletion-neighbourhood join: two lines are within one edit when they are equal after deleting
one character at the same place (a substitution), or when one of them is the other without a
character.  Every such variant becomes a hashed key; in a group of equal keys each line only
needs the earliest other line, so groups yield minima and not pairs.  What is found is
verified by edit distance.  One edit turns many a short line into another one, so lines
under ``MIN_CHARS`` are only compared as equal.

One edit leaves the first or the second half of a line as it was, so variants are made
only of lines that share a half with another line, and only in the other half.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from yieldlake.llm.shingles import mix
from yieldlake.scale import cut_lineage, lookup_join, scratch_scope

MIN_CHARS = 20  # least length of lines that are compared up to one edit
EXACT_CHARS = 1  # least length of lines that are compared as equal
LINE_BROADCAST = 100_000
_STEP = 0x9E3779B97F4A7C15


def normal(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends (a lone space needs no replacing)."""
    uneven = F.lit(False)
    for part in ("  ", "\t", "\x0b", "\x0c", "\r", "\n"):  # plain searches are far cheaper than the expression
        uneven = uneven | F.contains(line, F.lit(part))
    return F.lower(F.trim(F.when(uneven, F.regexp_replace(line, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")).otherwise(line)))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with their identity ``(r1, r2)``, by which lines find them again."""
    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.select("doc", F.xxhash64("doc", "text").alias("r1"), F.xxhash64(F.lit(7), "text", "doc").alias("r2"), "text")


def _lines(rows: DataFrame, least: int = EXACT_CHARS) -> DataFrame:
    """Lines of ``least`` characters or more with their place, normal form and two hashes of it."""
    split = rows.select("doc", "r1", "r2", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    return split.select("doc", "r1", "r2", "line", normal(F.col("raw")).alias("norm")).where(
        F.length("norm") >= least).select("*", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), "norm").alias("h2"))


def _half_keys(norm: Column) -> list[Column]:
    """Hashes of both halves, for this line's length and the next shorter one; null for a line too short to be near."""
    n = F.length(norm)
    out = []
    for side in ("first", "second"):
        for shorter in (0, 1):
            half = F.floor((n - shorter) / 2).cast("int")
            part = F.substring(norm, F.lit(1), half) if side == "first" else F.substring(norm, n - half + 1, half)
            found = F.xxhash64(F.lit(side), part)
            out.append(F.when((n >= MIN_CHARS) & (n % 2 == 0) if shorter else n >= MIN_CHARS, found))
    return out


def line_table(rows: DataFrame, exact_chars: int = EXACT_CHARS, least: int = EXACT_CHARS) -> DataFrame:
    """Every line's place, whether it stays for its length, hashes and half keys, written once."""
    keys = [k.alias(c) for k, c in zip(_half_keys(F.col("norm")), ("a0", "a1", "b0", "b1"))]
    return cut_lineage(_lines(rows, least).select(
        "doc", "r1", "r2", "line", (F.length("norm") < exact_chars).alias("short"), "h1", "h2", *keys))


def line_classes(lines: DataFrame) -> DataFrame:
    """One row per distinct line: hashes, number of occurrences, earliest place, and its half keys."""
    return cut_lineage(lines.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "r1", "r2", "line")).alias("first"),
        *[F.min(c).alias(c) for c in ("a0", "a1", "b0", "b1")]))


def half_sharers(classes: DataFrame) -> DataFrame:
    """``(h1, h2, in_second, in_first)``: lines that share a half with another line, and where an edit may be."""
    keys = classes.select("h1", "h2", F.explode(F.array(*[
        F.struct(F.col(c).alias("key"), F.lit(c < "b").alias("first_half")) for c in ("a0", "a1", "b0", "b1")])).alias("k")).select(
        "h1", "h2", "k.*").where("key is not null")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("key")
    return keys.join(shared, "key", "left_semi").groupBy("h1", "h2").agg(
        F.max("first_half").alias("in_second"), F.max(~F.col("first_half")).alias("in_first"))


def deletion_keys(line: str, in_first: bool, in_second: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a line and of its one-character deletions, with the deleted place (-1: the line itself)."""
    codes = mix(np.array([ord(c) for c in line], dtype=np.uint64))
    n = len(codes)
    forward = np.full(n, _STEP, np.uint64)
    forward[:1] = 1
    terms = codes * np.cumprod(forward, dtype=np.uint64)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    half = (n - 1) // 2
    places = np.arange(0 if in_first else half, n if in_second else n - half)
    back = np.uint64(pow(_STEP, -1, 1 << 64))
    deleted = upto[places] + (upto[n] - upto[places + 1]) * back
    keys = mix(np.concatenate((upto[n:], deleted))).view(np.int64)
    return keys, np.concatenate(([-1], places))


def near_earlier(candidates: DataFrame) -> DataFrame:
    """``(h1, h2)`` of lines within one edit of a line that occurs earlier.

    ``candidates`` has ``h1, h2, first, in_first, in_second, norm``, one row per line.
    """
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            h1, h2, first, rows, keys, places = batch.column(0), batch.column(1), batch.column(2), [], [], []
            for row, (text, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))):
                found, where = deletion_keys(text, a, b)
                keys.append(found)
                places.append(where)
                rows.append(np.full(len(found), row))
            picked = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(np.concatenate(places) if places else [], pa.int64()),
                h1.take(picked), h2.take(picked), first.take(picked)], ["key", "place", "h1", "h2", "first"])

    kind = candidates.schema["first"].dataType.simpleString()
    variants = candidates.select("h1", "h2", "first", "norm", "in_first", "in_second").mapInArrow(
        run, f"key bigint, place bigint, h1 bigint, h2 bigint, first {kind}")
    # A group holds a string with at most one character put in at each place: the alphabet bounds it.
    together, same_place = Window.partitionBy("key"), Window.partitionBy("key", "place")
    whole = F.col("place") < 0
    earliest = variants.withColumn("whole_first", F.min(F.when(whole, F.col("first"))).over(together)).withColumn(
        "cut_first", F.min(F.when(~whole, F.col("first"))).over(together)).withColumn(
        "place_first", F.min("first").over(same_place))
    partner = F.when(whole, F.col("cut_first")).otherwise(F.least("whole_first", "place_first"))
    met = earliest.withColumn("partner", partner).where("partner < first").select("h1", "h2", "partner").distinct()
    texts = candidates.select("h1", "h2", "norm")
    pairs = met.join(texts, ["h1", "h2"]).join(candidates.select(F.col("first").alias("partner"), F.col("norm").alias("earlier")), "partner")
    return pairs.where(F.levenshtein("norm", "earlier", 1) >= 0).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, key: str, text: str, exact_chars: int = EXACT_CHARS, least: int = EXACT_CHARS) -> DataFrame:
    """``(r1, r2, gone, repeated)``: places of the lines to remove from each row that loses any.

    ``repeated`` has those of ``least`` characters or more that repeat too, but stay for their length.
    """
    with scratch_scope(docs.sparkSession) as keep:
        return keep(_dropped_lines(docs, key, text, exact_chars, min(least, exact_chars)))


def _dropped_lines(docs: DataFrame, key: str, text: str, exact_chars: int, least: int) -> DataFrame:
    rows = _rows(docs, key, text)
    lines = line_table(rows, exact_chars, least)
    classes = line_classes(lines)
    sharers = cut_lineage(half_sharers(classes).join(classes.select("h1", "h2", "first"), ["h1", "h2"]))
    # The text of a candidate comes from its first place: only the rows that hold one are read again.
    places = sharers.select("first.r1", "first.r2").distinct()
    held = F.broadcast(places) if sharers.count() <= LINE_BROADCAST else places
    texts = _lines(rows.join(held, ["r1", "r2"], "left_semi"), MIN_CHARS).select(
        "h1", "h2", "norm", F.struct("doc", "r1", "r2", "line").alias("at")).join(sharers, ["h1", "h2"]).where(
        F.col("at").eqNullSafe(F.col("first"))).select("h1", "h2", "first", "norm", "in_first", "in_second").dropDuplicates(["h1", "h2"])
    near = near_earlier(cut_lineage(texts)).withColumn("near", F.lit(True))
    decided = classes.select("h1", "h2", "n", "first").join(near, ["h1", "h2"], "left").where("n > 1 or near")
    lookup = decided.select(F.concat_ws("|", "h1", "h2").alias("class"), "n", "first", F.coalesce("near", F.lit(False)).alias("near"))
    met = lookup_join(lines.select("doc", "r1", "r2", "line", "short", "h1", "h2").withColumn("class", F.concat_ws("|", "h1", "h2")), lookup, "class", "n")
    gone = met.where(F.col("near") | (F.col("first").isNotNull() & ~F.struct("doc", "r1", "r2", "line").eqNullSafe(F.col("first"))))
    return gone.groupBy("r1", "r2").agg(  # one row's places
        F.collect_set(F.when(~F.col("short"), F.col("line"))).alias("gone"),
        F.collect_set(F.when(F.col("short"), F.col("line"))).alias("repeated"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", exact_chars: int = EXACT_CHARS) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, plus ``n_lines`` and ``gone_lines``.

    A line goes when an earlier line, in the order of (key, row, place), is equal or within
    one edit after normalisation, whether or not that line itself stays.  Rows that repeat
    a key and text are treated alike; a null key comes first.  Null text stays null with 0
    lines; blank lines and those under ``exact_chars`` (at most ``MIN_CHARS``) always stay.  A
    line of any length is one value; its variants are as many 64-bit keys as it has characters.
    An empty table gives no rows.  Columns of ``docs`` with those names are replaced.
    """
    return _cleaned(docs, key, text, exact_chars, exact_chars).drop("__fresh")


def _cleaned(docs: DataFrame, key: str, text: str, exact_chars: int, least: int) -> DataFrame:
    """``dedup_lines`` with ``__fresh``: false when only blanks and repeats of ``least`` characters or more are left."""
    own = docs.drop("n_lines", "gone_lines")
    rows = own.withColumn("__r1", F.xxhash64(F.col(key), F.col(text).cast("string"))).withColumn(
        "__r2", F.xxhash64(F.lit(7), F.col(text).cast("string"), F.col(key)))
    gone = dropped_lines(own, key, text, exact_chars, least).toDF("__r1", "__r2", "__gone", "__repeated")
    lines = F.col("__lines")  # a column of its own: the text is split once
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    joined = rows.withColumn("__lines", F.split(F.col(text), "\n", -1)).join(gone, ["__r1", "__r2"], "left").withColumn(
        "n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))).withColumn(
        "gone_lines", F.coalesce(F.size("__gone"), F.lit(0))).withColumn("__fresh", F.when(
            F.col("gone_lines") == 0, True).otherwise(
            F.exists(F.array_except(stay, F.col("__repeated")), lambda i: normal(F.get(lines, i)) != "")))
    return joined.withColumn(text, F.when(F.col("gone_lines") == 0, F.col(text)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))).select(*own.columns, "n_lines", "gone_lines", "__fresh")


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars",
                   exact_chars: int = EXACT_CHARS) -> DataFrame:
    """``docs`` without repeated lines; a document that lost lines and has only blanks and repeats of any length left goes."""
    return _cleaned(docs, key, text, exact_chars, 1).where("__fresh").withColumn(
        chars, F.when(F.col("gone_lines") > 0, F.length(text).cast("long")).otherwise(F.col(chars))).select(*docs.columns)
