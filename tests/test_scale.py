import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldlake.profile import Profile
from yieldlake.operators import distribution, metrics, splits
from yieldlake.columns import exact_quantiles
from yieldlake.scale import apply_cuts, as_of_join, hot_keys, lookup_join, quota_cuts, running_sum


def _values(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.integers(0, 40, 300)] + [("cold", float(v)) for v in rng.normal(size=37)]
    rows += [("empty", None), ("hot", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


def test_running_sum_distributed_equals_plain(spark, spread):
    counts = _values(spark).where("v is not null").groupBy("k", "v").count()
    got = {(r.k, r.v): r.cum_count for r in running_sum(counts, [F.desc("v")], ["count"], ["k"]).collect()}
    plain = {(r.k, r.v): r.cum_count for r in running_sum(counts, [F.desc("v")], ["count"], ["k"], rows=0).collect()}
    assert got == plain and len(got) > 40


def test_exact_quantiles_equal_numpy(spark):
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    df = _values(spark)
    found = {r.k: r.quantiles for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    assert found["empty"] is None
    for key in ("hot", "cold"):
        values = [r.v for r in df.where((F.col("k") == key) & F.col("v").isNotNull()).collect()]
        np.testing.assert_allclose(found[key], np.quantile(values, probs))


def test_hot_keys_are_bounded_and_found(spark):
    counts = spark.createDataFrame([("a", 900), ("b", 99), ("c", 1)], "k string, n bigint")
    assert {r.k for r in hot_keys(counts, "n").collect()} == {"a", "b"}


def test_lookup_join_keeps_every_row_with_hot_and_null_keys(spark, spread):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else ("h" if i % 3 else f"k{i}")) for i in range(200)], "i int, k string")
    counts = rows.where("k is not null").groupBy("k").count()
    lookup = counts.withColumn("tag", F.concat(F.lit("t_"), "k")).where("k <> 'k3'")
    joined = lookup_join(rows, lookup, "k", "count").collect()
    assert len(joined) == 200
    for r in joined:
        assert r.tag == (f"t_{r.k}" if r.k and r.k != "k3" else None)


def test_quota_parts_fill_exact_quotas_for_any_partitioning(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("string").alias("s"))
    quotas = spark.createDataFrame(
        [("true", 1, 70), ("true", 2, 85), ("false", 1, 0), ("false", 2, 899)], "s string, part int, upto bigint")
    results = []
    for parts in (1, 16):
        shuffled = df.repartition(parts)
        cuts = quota_cuts(shuffled, quotas, ["s"], ["id"], 5)
        out = apply_cuts(shuffled, cuts, ["s"], ["id"], 5, "part")
        results.append(sorted((r.id, r.part) for r in out.collect()))
    assert results[0] == results[1]
    sizes = {}
    for r in apply_cuts(df, quota_cuts(df, quotas, ["s"], ["id"], 5), ["s"], ["id"], 5, "part").groupBy("s", "part").count().collect():
        sizes[(r.s, r.part)] = r["count"]
    assert sizes == {("true", 1): 70, ("true", 2): 15, ("true", 3): 15, ("false", 2): 899, ("false", 3): 1}


def test_metrics_and_correlations_agree_in_both_forms(spark):
    profile = Profile("t", "label", -1, 1)
    df = spark.range(400).select(
        F.when(F.col("id") % 13 == 0, 1).otherwise(-1).alias("label"), ((F.col("id") * 37) % 101 / 101.0).alias("score"),
        (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 17 / 3.0).alias("b"), (F.col("id") % 2).alias("k"))

    def both():
        m = metrics.binary_metrics(df, profile, "score", 0.5, ["k"]).orderBy("k").collect()
        t = metrics.threshold_table(df, profile, "score", ["k"]).orderBy("k", "threshold").collect()
        c = distribution.correlations(df, ["a", "b", "score"]).orderBy("method", "first", "second").collect()
        return m, t, c

    plain = both()
    spark.conf.set("yieldlake.oneTaskRows", "3")
    try:
        spread_out = both()
    finally:
        spark.conf.unset("yieldlake.oneTaskRows")
    for a, b in zip(plain, spread_out):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            for u, v in zip(x, y):
                assert u == v or abs(u - v) < 1e-9


def test_time_folds_agree_in_both_forms(spark, spread):
    profile = Profile("t", "label", -1, 1, timestamp="ts")
    df = spark.range(40).select(
        F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(cast(id div 2 as int))").alias("ts"),
        F.when(F.col("id") % 5 == 0, 1).otherwise(-1).alias("label"), "id")
    blocks = {r.block: r.n for r in splits.time_blocks(df, profile, 3).groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert blocks == {0: 10, 1: 10, 2: 10, 3: 10}


@pytest.mark.parametrize("parts", ["2", "9"])
def test_as_of_join_finds_the_state_in_force(spark, parts):
    draw = random.Random(8)
    states = [(draw.choice("hc"), draw.randint(0, 300), draw.random()) for _ in range(60)] + [("h", 50, 0.1), ("h", 50, 0.9), (None, 5, 0.5), ("c", None, 0.5)]
    # Two thirds of the rows have one key, many of them one time.
    rows = [(i, draw.choice("hhhhc"), draw.choice([50, 120, draw.randint(-5, 320)])) for i in range(900)]
    rows += [(900, None, 10), (901, "h", None), (902, "nowhere", 10), (0, "h", 50)]
    df = spark.createDataFrame(rows, "id int, k string, t int").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = as_of_join(df, spark.createDataFrame(states, "k string, since int, threshold double"), ["k"], "t", "since", ["threshold"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)

    def in_force(k, t):
        known = [(s, x) for key, s, x in states if k is not None and key == k and s is not None and t is not None and s <= t]
        return max(known, default=(None, None))

    assert sorted(map(repr, ((r.id, r.k, r.t, r.since, r.threshold) for r in got))) == sorted(
        map(repr, ((i, k, t, *in_force(k, t)) for i, k, t in rows)))
    assert as_of_join(df, spark.createDataFrame([], "k string, since int, threshold double"), ["k"], "t", "since", ["threshold"]).where(
        "since is null").count() == len(rows)
