"""Conversations as one training text each, with the part that carries loss, in Spark expressions only.

Adjacent turns of one role form one block::

    ### assistant: first text<and/>second text</turn>\\n

Roles and texts are escaped so that ``#`` and ``<`` occur in the template alone, which
makes the format reversible whatever a text contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, NAMED, NEXT, END = "### ", ": ", "<and/>", "</turn>\n"
_ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]  # the backslash first; undone in reverse
_ROLE_ESCAPES = [*_ESCAPES, (":", "\\c")]


def _swapped(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, pairs: list[tuple[str, str]] = _ESCAPES) -> Column:
    return _swapped(text, pairs)


def unescape(text: Column, pairs: list[tuple[str, str]] = _ESCAPES) -> Column:
    return _swapped(text, [(new, old) for old, new in reversed(pairs)])


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", learned: str = "assistant") -> DataFrame:
    """One row per conversation: ``(conv, segments, formatted)``.

    Turns are sorted by ``(turn, role, text)``, so ties have a fixed order and repeated
    rows are repeated turns; a null turn comes first, a null role or text counts as empty,
    and a null ``conv`` is a conversation of its own.  ``segments`` is the whole text in
    pieces, ``array<struct<text, loss>>``: the texts of role ``learned`` carry loss, marks
    and other roles do not.  ``formatted`` is their concatenation.  A conversation is one
    record, so its turns must fit a task; many conversations spread freely.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # A run starts where the role differs from the turn before.
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (
        F.get("t", i)["role"] != F.get("t", F.greatest(i - 1, F.lit(0)))["role"]))
    runs = sorted_turns.withColumn("starts", starts).withColumn("runs", F.transform("starts", lambda s, k: F.struct(
        F.get("t", s)["role"].alias("role"),
        F.slice("t", s + 1, F.coalesce(F.get("starts", k + 1), F.size("t")) - s).alias("turns"))))

    def block(run: Column) -> Column:
        inner = F.transform(run["turns"], lambda t, i: F.array(
            _segment(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), F.lit(False)),
            _segment(escape(t["text"]), run["role"] == learned)))
        return F.concat(
            F.array(_segment(F.concat(F.lit(HEAD), escape(run["role"], _ROLE_ESCAPES), F.lit(NAMED)), F.lit(False))),
            F.flatten(inner), F.array(_segment(F.lit(END), F.lit(False))))

    made = runs.select("conv", F.filter(
        F.flatten(F.transform("runs", block)), lambda s: s["text"] != "").alias("segments"))
    return made.select(F.col("conv").alias(conv), "segments",
                       F.array_join(F.col("segments.text"), "").alias("formatted"))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def parse_conversations(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turns read back from the text: ``(conv, turns array<struct<role, text>>)`` in order."""
    blocks = F.split(F.col("formatted"), END)

    def turns(block: Column) -> Column:
        at = F.instr(block, F.lit(NAMED))
        role = unescape(F.substring(block, F.lit(len(HEAD) + 1), at - len(HEAD) - 1), _ROLE_ESCAPES)
        return F.transform(F.split(F.substring(block, at + len(NAMED), F.length(block)), NEXT),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    whole = F.slice(blocks, F.lit(1), F.size(blocks) - 1)  # nothing follows the last end mark
    return formatted.select(conv, F.flatten(F.transform(whole, turns)).alias("turns"))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
