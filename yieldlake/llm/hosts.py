"""Judge urls by rules and by the reputation of their host, in Spark expressions only.

Labelled page outcomes are counted per host, registered domain and suffix.  Each level's
bad rate is shrunk towards the level above through a beta-binomial prior whose strength is
estimated from all groups of the level.  A host is blocked when the lower bound of its
posterior bad rate exceeds the accepted rate; a host without outcomes has the posterior of
its domain, a domain without outcomes that of its suffix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldlake.scale import lookup_join

MAX_RULES = 10_000  # rules become one constant map in the plan
ACCEPTED_RATE = 0.5
DEVIATIONS = 2.0
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, F.lit("://")) > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Text behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct ``(size, home, rule, verdict)`` of the longest rule ``(host, path, verdict)`` that fits, or null.

    Of equally long rules the one with the longer host wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<size:int,home:int,rule:string,verdict:string>")
    by_host: dict[str, list[Column]] = {}
    for home, start, verdict in rules:
        by_host.setdefault(home, []).append(F.struct(
            F.lit(len(home + start)).alias("size"), F.lit(len(home)).alias("home"),
            F.lit(home + start).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(start).alias("start")))
    table = F.create_map(*[x for home, found in by_host.items() for x in (F.lit(home), F.array(*found))])
    deepest = max(home.count(".") for home in by_host) + 1
    # The last k labels, for every k that some rule's host has.
    tails = F.array(*[F.when(F.size(F.split(host, r"\.")) >= k, F.substring_index(host, ".", -k))
                      for k in range(1, deepest + 1)])
    found = F.flatten(F.transform(F.filter(tails, lambda t: t.isNotNull()), lambda t: F.coalesce(
        F.element_at(table, t), F.slice(F.array(*by_host[rules[0][0]]), 1, 0))))
    best = F.array_max(F.filter(found, lambda r: F.startswith(path, r["start"])))
    return F.when(best.isNotNull(), F.struct(best["size"].alias("size"), best["home"].alias("home"),
                                             best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _shrunk(level: DataFrame, name: str) -> DataFrame:
    """Add ``strength`` of the level's prior, by moments around the rate of the level above.

    Under a beta-binomial, n (p - m)^2 / (m (1 - m)) has mean 1 + (n - 1) r; summed over
    the groups with outcomes this gives r, and the strength is 1 / r - 1.
    """
    scatter = F.sum(F.pow(F.col("bad") / F.col("n") - F.col("above"), 2) * F.col("n") / (F.col("above") * (1 - F.col("above"))))
    groups, total = F.count(F.lit(1)), F.sum("n")
    spread = F.when(total > groups, (scatter - groups) / (total - groups)).otherwise(F.lit(0.5))
    prior = level.where("n > 0").agg(F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.coalesce(spread, F.lit(0.5)))).alias("r"))
    return level.crossJoin(F.broadcast(prior)).withColumn("strength", 1 / F.col("r") - 1).drop("r").withColumn(
        name, (F.col("bad") + F.col("strength") * F.col("above")) / (F.col("n") + F.col("strength")))


def host_reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(host, pages, rate, bound)``: posterior bad rate of each host in ``hosts`` and its lower bound.

    ``hosts`` has ``host`` per page, ``outcomes`` has ``host`` and ``bad`` (0 or 1, null is
    ignored) per labelled page.
    """
    pages = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = outcomes.where("bad is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("bad"))
    known = pages.join(counted, "host", "left").fillna(0, ["n", "bad"]).withColumn(
        "domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = known.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("pages").alias("pages"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("pages").alias("pages"))
    overall = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("above"))
    by_suffix = _shrunk(suffixes.crossJoin(F.broadcast(overall)), "rate").select("suffix", F.col("rate").alias("above"), "pages")
    by_domain = _shrunk(lookup_join(domains, by_suffix.withColumnRenamed("pages", "weight"), "suffix", "weight"), "rate").select(
        "domain", F.col("rate").alias("above"), F.col("pages").alias("weight"))
    by_host = _shrunk(lookup_join(known, by_domain, "domain", "weight"), "rate")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return by_host.select("host", "pages", "rate", (F.col("rate") - DEVIATIONS * spread).alias("bound"))


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]],
                key: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row of ``pages``.

    ``outcomes`` has ``key`` and ``bad``; pages without one are judged by their host's
    posterior.  A fitting rule decides before the method.  A null url, or one without
    ``://``, has an empty host and path: all such pages are one host.  Repeated rows and
    null keys are kept; a key labelled more than once counts each label.
    """
    parsed = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labelled = parsed.join(outcomes.select(F.col(key).alias("page_id"), "bad"), "page_id").select("host", "bad")
    reputation = host_reputations(parsed.select("host"), labelled)
    judged = lookup_join(parsed, reputation, "host", "pages").withColumn(
        "__rule", matched_rule(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(
        F.col("__rule.verdict"), F.when(F.col("bound") > ACCEPTED_RATE, "block").otherwise("allow")).alias("verdict"))
