"""Mix sources to target weights: whole copies plus a Pareto order sample, in Spark expressions only.

Each source gets a target number of words.  Every document of it is taken ``floor(target /
size)`` times for certain; the rest of the target is an unequal-probability sample of
fixed size, measured in words as the target is.  Documents are ranked by the odds of a
reproducible random number divided by the odds of their inclusion probability, and taken
in that order up to the words that are nearest to the rest.

No source is sorted: words per rank bucket show which bucket holds the cut, and only the
rows of that bucket are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from yieldlake.scale import cut_lineage, lookup_join, running_sum, scratch_scope

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
WEIGHTS = 3  # sources weigh 1, 2, 3, repeating
BUCKETS = 4096
_KEY = "__mix_key"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Source as a sortable key; null sorts last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source key with its words, documents and target.

    ``sizes`` has ``__mix_key`` and ``size``.  Sources share all words by weight; one that
    would exceed ``MOST_COPIES`` times its words stops there, and the others share its
    excess by weight.
    """
    totals = cut_lineage(sizes.groupBy(_KEY).agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"), F.lit(1).cast("long").alias("one")))
    count = totals.count()
    ranked = running_sum(totals, [F.col(_KEY)], ["one"], rows=count)
    capped = ranked.select(
        _KEY, "source_size", "documents", (1 + (F.col("cum_one") - 1) % WEIGHTS).alias("weight"),
        (MOST_COPIES * F.col("source_size")).alias("cap")).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = running_sum(capped, [F.col("ratio"), F.col(_KEY)], ["cap", "weight"], rows=count)
    whole = filled.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # Sources in order of cap per weight: the level holds from the first that it does not fill.
    level = (F.col("all_size") - F.col("cum_cap") + F.col("cap")).cast("double") / (
        F.col("all_weight") - F.col("cum_weight") + F.col("weight"))
    leveled = filled.crossJoin(F.broadcast(whole)).withColumn("level", level)
    first = leveled.where("level <= ratio").agg(F.min_by("level", F.struct("ratio", _KEY)).alias("share"))
    return filled.crossJoin(F.broadcast(first)).select(
        _KEY, "source_size", "documents",
        F.least(F.col("cap").cast("double"), F.coalesce("share", F.lit(0.0)) * F.col("weight")).alias("target"))


def _random(ids: Column, seed: int) -> Column:
    """Reproducible number strictly between 0 and 1 from a document's id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(ids.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def _ranked(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Add the inclusion probability of the sampled copy, its Pareto rank and the rank's bucket.

    Longer documents are preferred: the probability moves from the source's mean share by
    the document's preference, so that the expected words are still the rest exactly.
    """
    share = F.col("rest") / F.col("source_size")
    preferred = F.col("size") / (F.col("size") + F.col("source_size") / F.col("documents"))
    probability = share + F.least(share, 1 - share) * (preferred - F.col("mean_preference"))
    drawn = rows.withColumn("__p", F.when(F.col("source_size") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability))))
    number = _random(F.col(key), seed)
    rank = F.when(F.col("__p") > 0, (number / (1 - number)) * ((1 - F.col("__p")) / F.col("__p")))
    return drawn.withColumn("__rank", rank).withColumn(
        "__bucket", F.floor(BUCKETS * (F.col("__rank") / (1 + F.col("__rank")))))


def mixing_plan(sizes: DataFrame, key: str, seed: int) -> DataFrame:
    """One row per source key: target, certain copies, and the cut of its Pareto ranks."""
    with scratch_scope(sizes.sparkSession) as keep:
        return keep(_mixing_plan(cut_lineage(sizes), key, seed))


def _mixing_plan(sizes: DataFrame, key: str, seed: int) -> DataFrame:
    targets = source_targets(sizes)
    preferred = F.col("size") / (F.col("size") + F.col("source_size") / F.col("documents"))
    known = lookup_join(sizes, targets, _KEY, "documents")
    means = known.where("source_size > 0").groupBy(_KEY).agg(
        F.round(F.sum(preferred * F.col("size")) / F.first("source_size"), 9).alias("mean_preference"))
    plan = cut_lineage(targets.join(means, _KEY, "left").withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    ranked = _ranked(lookup_join(sizes, plan, _KEY, "documents"), key, seed).where("__rank is not null")
    along = Window.partitionBy(_KEY).orderBy("__bucket")
    buckets = ranked.groupBy(_KEY, "__bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest")).withColumn(
        "upto", F.sum("n").over(along))
    cut = buckets.where("upto >= rest").groupBy(_KEY).agg(
        F.min_by(F.struct(F.col("__bucket").alias("cut_bucket"), (F.col("upto") - F.col("n")).alias("before")),
                 "__bucket").alias("c")).select(_KEY, "c.*")
    plan = plan.join(cut, _KEY, "left")
    order = [F.col("__rank"), F.col(key)]
    inside = _ranked(lookup_join(sizes, plan, _KEY, "documents"), key, seed).where("__bucket = cut_bucket").withColumn(
        "upto", F.col("before") + F.sum("size").over(Window.partitionBy(_KEY).orderBy(*order)))
    # Rows with one id enter together (the frame holds peers); the nearest total to the rest wins.
    last = inside.groupBy(_KEY).agg(
        F.min_by(F.struct(F.col("__rank").alias("cut_rank"), F.col(key).alias("cut_id"), F.abs(F.col("upto") - F.col("rest")).alias("off")),
                 F.struct(F.abs(F.col("upto") - F.col("rest")), "upto", "__rank", key)).alias("l")).select(_KEY, "l.*")
    chosen = plan.join(last, _KEY, "left")
    nothing = F.abs(F.col("before") - F.col("rest")) <= F.col("off")  # the cut bucket gives no row at all
    return chosen.withColumn("cut_rank", F.when(nothing, F.lit(-1.0)).otherwise(F.col("cut_rank"))).drop("before", "off")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """``docs`` plus ``size, source_size, target, copies, taken`` (words): how often the mix takes each row.

    Null text and text without words have size 0; a null source is one source, ranked
    last.  Rows that share ``key`` within a source are taken alike.  Empty input gives no
    rows.  Reruns agree for one ``seed``.  Columns of ``docs`` with those names are replaced.
    """
    sized = docs.drop("size", "source_size", "target", "copies", "taken").withColumn("size", word_count(F.col(text))).withColumn(_KEY, _key(F.col(source)))
    plan = mixing_plan(sized.select(F.col(key), _KEY, "size"), key, seed)
    return _with_copies(sized, plan, key, seed)


def _with_copies(rows: DataFrame, plan: DataFrame, key: str, seed: int) -> DataFrame:
    ranked = _ranked(lookup_join(rows, plan, _KEY, "documents"), key, seed)
    before = (F.col("__rank") < F.col("cut_rank")) | (
        (F.col("__rank") == F.col("cut_rank")) & (F.coalesce(F.col(key).cast("string"), F.lit("")) == F.coalesce(F.col("cut_id").cast("string"), F.lit("")))) | (
        (F.col("__rank") == F.col("cut_rank")) & (F.col(key) < F.col("cut_id")))
    extra = F.when(F.col("__bucket") < F.col("cut_bucket"), 1).when(
        (F.col("__bucket") == F.col("cut_bucket")) & before, 1).otherwise(0)
    return ranked.withColumn("copies", (F.col("whole") + extra).cast("long")).withColumn(
        "taken", F.col("copies") * F.col("size")).select(
        *[c for c in rows.columns if c not in (_KEY, "size")], "size", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns only."""
    columns = docs.columns
    return mix(docs, **options).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*columns)
