"""Coverage seeds and exchanges of group splits, and the bootstrap, against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldlake.ml import models
from yieldlake.ml.models import bootstrap_copies, stratified_bootstrap
from yieldlake.profile import ContractError, Profile
from yieldlake.wafer import groups

RATIOS = np.array([0.7, 0.15, 0.15])


def counts(spark, matrix):
    rows = [(g, c, n) for g, row in enumerate(matrix) for c, n in enumerate(row) if n]
    return spark.createDataFrame(rows, "gid bigint, class_index int, n bigint")


def table_of(matrix, chosen):
    out = np.zeros((3, 9), dtype=int)
    for gid, split in chosen.items():
        out[groups.SPLITS.index(split)] += matrix[gid]
    return out


def test_cover_finds_an_assignment_whenever_one_exists():
    draw = random.Random(5)
    whole, seen = (1 << 9) - 1, Counter()
    for _ in range(250):
        masks = [sum(1 << k for k in range(9) if draw.random() < draw.choice([0.45, 0.6, 0.8])) for _ in range(6)]
        possible = any(all(_union(m for m, s in zip(masks, slots) if s == t) == whole for t in range(3))
                       for slots in itertools.product(range(3), repeat=6))
        found = groups.cover(list(enumerate(masks)))
        assert (found is not None) == possible
        seen[possible] += 1
        if found:
            assert all(_union(masks[g] for g, s in found.items() if s == t) == whole for t in range(3))
    assert min(seen.values()) > 20


def _union(masks):
    out = 0
    for m in masks:
        out |= m
    return out


def test_a_class_that_is_nowhere_rarest_is_covered(spark):
    # Class 8 occurs in three groups only, which all lean on class 0 too; bands alone could put them into one split.
    matrix = [[3 if c == g % 8 else 0 for c in range(9)] for g in range(48)]
    for g in (0, 8, 16):
        matrix[g][8] = 500
    matrix = [row[:] for row in matrix]
    found = groups.improve_assignment(counts(spark, matrix))
    chosen = {r.gid: r.split for r in found.groups.collect()}
    assert len(chosen) == 48 and (table_of(matrix, chosen) > 0).all()
    assert (table_of(matrix, chosen) == found.final).all()
    assert len({chosen[g] for g in (0, 8, 16)}) == 3


def test_contradicting_support_is_refused(spark):
    matrix = [[int(c != g) for c in range(9)] for g in range(4)]
    with pytest.raises(ContractError, match="NO_FEASIBLE_SPLIT_CANDIDATE"):
        groups.choose_assignment(counts(spark, matrix))


def test_exchanges_lower_the_objective_and_end_at_a_local_optimum(spark):
    draw = random.Random(2)
    matrix = [[draw.choice([0, 0, 1, 5, 40]) for _ in range(9)] for _ in range(60)]
    one = groups.improve_assignment(counts(spark, matrix))
    again = groups.improve_assignment(counts(spark, matrix).repartition(7))
    chosen = {r.gid: r.split for r in one.groups.collect()}
    assert chosen == {r.gid: r.split for r in again.groups.collect()}
    final = table_of(matrix, chosen)
    score = groups.split_objective(final, RATIOS)
    assert score < groups.split_objective(one.seeded, RATIOS) and (final > 0).all()
    # No single group's move helps any more.
    for gid, split in chosen.items():
        for other in groups.SPLITS:
            moved = table_of(matrix, chosen | {gid: other})
            assert other == split or not (moved > 0).all() or groups.split_objective(moved, RATIOS) >= score - 1e-12


def test_objective_by_hand():
    matrix = np.array([[7, 8] + [1] * 7, [2, 1] + [1] * 7, [1, 1] + [1] * 7])
    rows = [(matrix[s].sum() / matrix.sum() - RATIOS[s]) ** 2 for s in range(3)]
    cells = [(matrix[s][c] / matrix[:, c].sum() - RATIOS[s]) ** 2 for s in range(3) for c in range(9)]
    assert float(groups.split_objective(matrix, RATIOS)) == pytest.approx(sum(rows) + sum(cells) / 9)


@pytest.mark.parametrize("parts", [1, 6])
def test_bootstrap_equals_a_plain_draw(spark, parts):
    rows = [(i, 1 if i % 7 == 0 else -1, i * 0.5) for i in range(700)] + [(9000, None, 1.0)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, x double").repartition(parts)
    for repeat in (0, 3):
        want = {}
        for label in (1, -1):
            ordered = sorted((i for i, y, _ in rows if y == label), key=lambda i: (hashlib.md5(f"11|{i}".encode()).hexdigest(), i))
            picks = Counter(int(hashlib.md5(f"11|{repeat}|{label}|{j}".encode()).hexdigest()[:15], 16) % len(ordered) for j in range(len(ordered)))
            want |= {ordered[p]: n for p, n in picks.items()}
        got = {r.row_id: r.copies for r in bootstrap_copies(df, "label", ["row_id"], repeat, 11).collect()}
        assert got == want
    drawn = stratified_bootstrap(df, "label", ["row_id"], 3, 11)
    assert drawn.columns == df.columns
    assert {r.label: r["count"] for r in drawn.groupBy("label").count().collect()} == {1: 100, -1: 600}
    assert drawn.select("row_id").distinct().count() == len(want)
    assert bootstrap_copies(df.limit(0), "label", ["row_id"], 0, 1).count() == 0


def test_bootstrap_draws_rows_as_often_as_chance_does(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), F.lit(1).alias("label"))
    shares = Counter(r.copies for r in bootstrap_copies(df, "label", ["row_id"], 5, 3).collect())
    # Not drawn, once and twice: exp(-1), exp(-1) and exp(-1) / 2 of all rows.
    assert (4000 - sum(shares.values())) / 4000 == pytest.approx(0.368, abs=0.02)
    assert shares[1] / 4000 == pytest.approx(0.368, abs=0.03) and shares[2] / 4000 == pytest.approx(0.184, abs=0.03)


def test_repeats_share_one_draw(spark, monkeypatch):
    """One join gives every repeat the copies that it would get alone; stable selection makes it once."""
    df = spark.range(300).select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 == 0, 1).otherwise(-1).alias("label"),
                                 ((F.col("id") * 7) % 11 + F.col("id") % 5).cast("double").alias("sensor_a"),
                                 ((F.col("id") * 3) % 13).cast("double").alias("sensor_b"))
    together = {r.row_id: list(r.copies) for r in models.bootstrap_counts(df, "label", ["row_id"], [0, 1, 4], 11).collect()}
    for place, repeat in enumerate((0, 1, 4)):
        alone = {r.row_id: r.copies for r in bootstrap_copies(df, "label", ["row_id"], repeat, 11).collect()}
        assert alone == {k: v[place] for k, v in together.items() if v[place]}
    calls, draw = [], models.bootstrap_counts
    monkeypatch.setattr(models, "bootstrap_counts", lambda *a: calls.append(a[3]) or draw(*a))
    chosen = models.stable_selection(df, Profile("t", "label", -1, 1, feature_prefix="sensor_"), models.Candidate(
        "s", selector="stable_forest", top_k=1, trees=3, repeats=3), ["sensor_a", "sensor_b"], ["row_id"])
    assert calls == [[0, 1, 2]] and chosen[0]["bootstrap_repeats"] == 3
