"""Column statistics from Arrow batches against plain loops and Spark's own aggregates."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldlake import columns
from yieldlake.columns import column_moments, column_quantiles, column_values, exact_quantiles

INF = float("inf")


def table(spark, seed=1, size=3000):
    draw = random.Random(seed)

    def wide():
        return draw.choice([draw.uniform(-1, 1), draw.gauss(0, 1e9), draw.randint(-3, 3) + 0.0, 5e-324, -5e-324, -0.0, 0.0, INF, -INF,
                            1.0 + 2 ** -52 * draw.randint(0, 40), None, float("nan")])

    rows = [(draw.choice(["a", "b", None, "c\"d,"]), draw.choice([1, 2, None]), wide(), 7.5 if draw.random() < 0.9 else wide(), None,
             draw.randint(0, 10 ** 12)) for _ in range(size)]
    return spark.createDataFrame(rows, "g string, h int, x double, hot double, gone double, big bigint").repartition(5)


def plain_quantile(values, p):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    if not values:
        return None
    at = (len(values) - 1) * p
    low, high = math.floor(at), math.ceil(at)
    a, b = values[low], values[high]
    return a if low == high or a == b else (high - at) * a + (at - low) * b


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (
        struct.pack("d", a + 0.0) == struct.pack("d", b + 0.0) or (math.isnan(a) and math.isnan(b))))


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
@pytest.mark.parametrize("cells", [100_000, 7])
def test_quantiles_are_exact_to_the_bit(spark, monkeypatch, keys, cells):
    monkeypatch.setattr(columns, "CELLS_AT_ONCE", cells)
    df = table(spark)
    rows = df.collect()
    probs = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    names = ["x", "hot", "gone", "big"]
    got = column_quantiles(df, names, probs, keys, "q").collect()
    groups = {tuple(r[k] for k in keys) for r in rows}
    assert len(got) == len(groups) * len(names)
    for r in got:
        mine = [float(x[r.feature]) if x[r.feature] is not None else None for x in rows if all(x[k] == r[k] for k in keys)]
        want = [plain_quantile(mine, p) for p in probs]
        if want[0] is None:
            assert r.q is None
        else:
            assert all(same(a, b) for a, b in zip(r.q, want)), (r, want)


def test_quantiles_equal_the_builtin_and_ignore_partitions(spark):
    df = table(spark, 2).select("g", F.when(~F.isnan("x") & (F.abs("x") < INF), F.col("x")).alias("x"))
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", [0.1, 0.5, 0.77]).alias("q")).collect()}
    for parts in (1, 7):
        got = {r.g: r.quantiles for r in exact_quantiles(df.repartition(parts), ["g"], "x", [0.1, 0.5, 0.77]).collect()}
        assert got == want
    long = df.withColumn("feature", F.lit("f"))
    assert {(r.g, r.feature): r.quantiles for r in exact_quantiles(long, ["g", "feature"], "x", [0.5]).collect()} == {
        (g, "f"): [q[1]] for g, q in want.items()}
    assert column_quantiles(df.limit(0), ["x"], [0.5]).collect() == []


def test_close_numbers_take_all_passes(spark):
    # Neighbouring doubles differ in the last bits only.
    values = [float(np.nextafter(1.0, 2.0)) if i % 3 else 1.0 for i in range(500)] + [1.0 + i * 2 ** -50 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    got = column_quantiles(df, ["x"], [0.3, 0.5, 0.7], name="q").first().q
    assert all(same(a, plain_quantile(values, p)) for a, p in zip(got, (0.3, 0.5, 0.7)))


@pytest.mark.parametrize("held", [1 << 20, 2])
def test_moments_equal_the_builtin(spark, monkeypatch, held):
    monkeypatch.setattr(columns, "GROUPS_HELD", held)
    df = table(spark, 3).withColumn("shifted", F.col("big") / 1e12 + 1e9)
    names = ["x", "hot", "gone", "big", "shifted"]
    got = {(r.g, r.h, r.feature): r for r in column_moments(df, names, ["g", "h"], finite=True).collect()}
    for c in names:
        value = F.col(c).cast("double")
        known = F.when(~F.isnan(value), value)
        ok = F.when(F.abs(known) < INF, known)
        for r in df.groupBy("g", "h").agg(
                F.count(F.lit(1)).alias("rows"), F.count(known).alias("seen"), F.count(ok).alias("n"), F.avg(ok).alias("mean"),
                F.var_pop(ok).alias("var"), F.min(ok).alias("low"), F.max(ok).alias("high")).collect():
            mine = got[r.g, r.h, c]
            assert (mine.row_count, mine.seen_count, mine.value_count) == (r.rows, r.seen, r.n)
            assert (mine.minimum, mine.maximum) == (r.low, r.high)
            if r.n:
                assert math.isclose(mine.mean, r.mean, rel_tol=1e-12, abs_tol=1e-6)
                assert math.isclose(mine.m2 / r.n, r.var, rel_tol=1e-6 if c == "shifted" else 1e-9, abs_tol=1e-12)
            else:
                assert mine.mean is None and mine.m2 is None
    whole = {r.feature: r for r in column_moments(df, names).collect()}
    assert whole["x"].minimum == -INF and whole["gone"].row_count == 3000
    assert column_moments(df.limit(0), names).collect() == []


def test_values_count_each_distinct_number_once(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (float("nan"), None), (None, "b"), (1.5, "b"), (1.5, "")] * 3,
                               "x double, t string").repartition(4)
    got = sorted(((r.feature, r.bits, r.text, r.n) for r in column_values(df, ["x"], ["t"]).where("bits is not null or text is not null").collect()), key=lambda x: (x[0], x[3]))
    assert [(f, n) for f, _, _, n in got] == [("t", 3), ("t", 6), ("t", 6), ("x", 6), ("x", 6)]
    assert {(r.feature, r.n) for r in column_values(df, ["x"], ["t"]).where("bits is null and text is null").collect()} == {("x", 6), ("t", 3)}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_correlations_look_their_ranks_up_once(spark, monkeypatch, keys):
    """The rows that met their ranks are read by one pass: the means come from the ranked values."""
    from yieldlake.operators import distribution

    looked_up = spark.sparkContext.accumulator(0)
    join = distribution.lookup_join

    def seen(batches):
        for batch in batches:
            looked_up.add(batch.num_rows)
            yield batch

    def counted(*args):
        out = join(*args)
        return out.mapInArrow(seen, out.schema)

    rows = [(i % 3, float(i % 17), float((i * 7) % 23)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    monkeypatch.setattr(distribution, "lookup_join", counted)
    got = {(r.method, r["k"] if keys else None): r.correlation for r in distribution.correlations(df, ["a", "b"], keys).collect()}
    assert looked_up.value == 2 * len(set(r if keys else r[1:] for r in rows))
    for (method, k), value in got.items():
        a, b = (np.array([r[i] for r in rows if k is None or r[0] == k]) for i in (1, 2))
        if method == "spearman":
            a, b = (np.array([(x < v).sum() + ((x == v).sum() - 1) / 2 for v in x]) for x in (a, b))
        assert value == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-12)
