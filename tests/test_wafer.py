import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldlake.functions import dies
from yieldlake.functions.dies import CLASS_NAMES
from yieldlake.profile import ContractError
from yieldlake.wafer import canonical, groups, resize

SCHEMA = "position bigint, die_map array<array<tinyint>>, label string, lot string, wafer int"


def source(spark, rows):
    return canonical.canonical_manifest(spark.createDataFrame(rows, SCHEMA), "v", "position", "die_map", "label", "lot", "wafer")


def one_map(spark, cells, target):
    df = spark.createDataFrame([(cells,)], "map array<array<tinyint>>")
    row = resize.with_resized(df, target).withColumns(resize.preservation(F.col("map"), F.col("resized"))).first()
    return row


def test_identity_and_half_pixel_picks(spark):
    same = one_map(spark, [[0, 1, 2], [1, 2, 0]], (2, 3))
    assert same.resized == [[0, 1, 2], [1, 2, 0]]
    narrow = one_map(spark, [[0, 1, 2, 0]], (1, 2))
    assert narrow.resized == [[1, 0]]


def test_padding_puts_the_odd_rest_below(spark):
    wide = one_map(spark, [[1, 1, 1, 1], [2, 2, 2, 2]], (5, 5))
    g = wide.geometry
    assert (g.resized_height, g.resized_width, g.top, g.bottom, g.left, g.right) == (3, 5, 1, 1, 0, 0)
    flat = one_map(spark, [[1, 2, 1, 2]], (4, 4))
    assert (flat.geometry.top, flat.geometry.bottom) == (1, 2)
    assert flat.resized == [[0] * 4, [1, 2, 1, 2], [0] * 4, [0] * 4]


@pytest.mark.parametrize("h, w, th, tw", [(3, 7, 5, 5), (9, 4, 6, 6), (5, 5, 2, 3), (1, 8, 4, 4), (6, 11, 12, 8)])
def test_resize_matches_integer_arithmetic(spark, h, w, th, tw):
    cells = [[(y * 5 + x * 3) % 3 for x in range(w)] for y in range(h)]
    row = one_map(spark, cells, (th, tw))
    top, bottom = (th, h) if th * w <= tw * h else (tw, w)
    nh = min(th, max(1, (2 * h * top + bottom) // (2 * bottom)))
    nw = min(tw, max(1, (2 * w * top + bottom) // (2 * bottom)))
    want = [[0] * tw for _ in range(th)]
    for y in range(nh):
        for x in range(nw):
            want[(th - nh) // 2 + y][(tw - nw) // 2 + x] = cells[((2 * y + 1) * h) // (2 * nh)][((2 * x + 1) * w) // (2 * nw)]
    assert row.resized == want


def test_lost_region_is_reported(spark):
    lost = one_map(spark, [[1, 1, 2, 1, 1, 1, 1, 1]], (1, 2))
    assert lost.failed_region_lost == (2 not in lost.resized[0]) and not lost.valid_region_lost


def test_manifest_states_hash_and_reasons(spark):
    rows = [(0, [[0, 1, 2, 0]], " none ", "L1", 1), (1, [[0, 0]], "Donut", "L1", 2), (2, [[1, 3]], "Nope", "  ", 3),
            (3, [[1], [1, 2]], None, "L2", 4), (4, None, "", "L2", None)]
    found = {r.source_row_position: r for r in source(spark, rows).collect()}
    body = struct.pack("<QQ", 1, 4) + bytes([0, 1, 2, 0])
    assert found[0].map_hash == hashlib.sha256(body).hexdigest()
    assert (found[0].pattern_label, found[0].class_index, found[0].split, found[0].failed_die_ratio) == ("None", 0, "pending", 0.5)
    assert found[1].reason_codes == ["NO_VALID_DIE"]
    assert found[2].reason_codes == ["INVALID_MAP_VALUES", "MISSING_OR_INVALID_LOT", "INVALID_LABEL"]
    assert found[3].reason_codes == ["INVALID_MAP_STRUCTURE"] and found[3].label_status == "unlabeled"
    assert found[4].map is None and found[4].label_status == "unlabeled"
    manifest = source(spark, rows)
    assert canonical.audit_report(manifest, "v").isEmpty()
    assert canonical.position_continuity(manifest).first().continuous


def graph(spark, pairs):
    rows = [(i, f"h{h}" if h is not None else None, lot, c, "accepted") for i, (lot, h, c) in enumerate(pairs)]
    return spark.createDataFrame(rows, "i int, map_hash string, lot_id string, class_index int, quality_status string")


def test_bridge_lot_joins_two_lots(spark):
    df = graph(spark, [("A", 1, 0), ("bridge", 1, None), ("bridge", 2, None), ("B", 2, 1), ("C", 3, 1), ("D", None, 1)])
    found = {r.lot_id: r.gid for r in groups.lot_groups(df).collect()}
    assert found == {"A": 0, "B": 0, "bridge": 0, "C": 1, "D": 2}


@pytest.mark.parametrize("edges", [500_000, 4])
def test_long_chain_and_hub_converge_in_both_forms(spark, spread, monkeypatch, edges):
    monkeypatch.setattr(groups, "CONTRACTED_EDGES", edges)
    chain = [(f"L{i:03d}", h, 0) for i in range(40) for h in (i, i + 1)]
    hub = [(f"M{i:02d}", 900, 1) for i in range(30)]
    found = {r.lot_id: r.gid for r in groups.lot_groups(graph(spark, chain + hub)).collect()}
    assert {found[k] for k in found if k.startswith("L")} == {0} and {found[k] for k in found if k.startswith("M")} == {1}


def test_conflicting_maps_drop_every_row(spark):
    df = graph(spark, [("A", 1, 0), ("B", 1, 1), ("C", 1, None), ("D", 2, 0), ("E", None, 0)])
    assert sorted(r.lot_id for r in groups.without_conflicts(df).collect()) == ["D", "E"]


def counts(spark, matrix):
    rows = [(g, c, n) for g, row in enumerate(matrix) for c, n in enumerate(row) if n]
    return spark.createDataFrame(rows, "gid bigint, class_index int, n bigint")


def test_three_groups_per_class_reach_all_splits(spark):
    matrix = [[1 if c == k else 0 for c in range(9)] for k in range(9) for _ in range(3)]
    chosen = groups.choose_assignment(counts(spark, matrix))
    per_split = {r.split: r.n for r in chosen.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert per_split == {"train": 9, "validation": 9, "test": 9}
    again = groups.choose_assignment(counts(spark, matrix).repartition(9))
    assert sorted(chosen.collect()) == sorted(again.collect())


def test_too_few_groups_are_rejected(spark):
    with pytest.raises(ContractError):
        groups.choose_assignment(counts(spark, [[1 if c == k else 0 for c in range(9)] for k in range(9)]))


def test_shares_follow_the_ratios(spark):
    matrix = [[5 if c == g % 9 else 0 for c in range(9)] for g in range(450)]
    sized = counts(spark, matrix).join(groups.choose_assignment(counts(spark, matrix)), "gid")
    shares = {r.split: r.n / 2250 for r in sized.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert shares["train"] == pytest.approx(0.7, abs=0.06) and shares["test"] == pytest.approx(0.15, abs=0.06)


def test_input_table_is_gated_and_written(spark, tmp_path):
    rows = [(i, [[1, 2], [2, 1]], CLASS_NAMES[i % 9], f"L{i}", i) for i in range(27)]
    split = source(spark, rows).withColumn("split", F.element_at(
        F.array(*map(F.lit, groups.SPLITS)), (F.col("source_row_position") % 3 + 1).cast("int")))
    report = resize.preservation_report(resize.preservation_rows(split, (4, 4)))
    path = str(tmp_path / "table")
    resize.write_input_table(split, report, path, (4, 4))
    back = spark.read.parquet(path)
    assert back.count() == 27
    first = resize.input_violations(back, (4, 4)).first().asDict()
    assert first.pop("rows") == 27 and not any(first.values())
    with pytest.raises(ContractError):
        resize.write_input_table(split, report.where("split = 'train'"), str(tmp_path / "other"), (4, 4))
    with pytest.raises(FileExistsError):
        resize.write_input_table(split, report, path, (4, 4))
    # A row that breaks the contract is seen by the job that writes it: nothing is published or left.
    broken = split.withColumn("class_index", F.when(F.col("source_row_position") == 5, 11).otherwise(F.col("class_index")))
    with pytest.raises(ContractError, match="wrong_class"):
        resize.write_input_table(broken, report, str(tmp_path / "broken"), (4, 4))
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_small_maps_are_resized_in_parts(spark, monkeypatch):
    """A batch of small maps is answered in parts, so that a task never holds the batch at model size."""
    monkeypatch.setattr(dies, "CELLS_HELD", 3 * 5 * 7)
    dies._gathered.cache_clear()
    sizes = []
    maps = [[[i % 3, 1], [2, i % 2]] if i % 10 else None for i in range(40)]

    class Batch(list):
        def slice(self, start, count):
            sizes.append(count)
            return Batch(self[start:start + count])

        def to_pylist(self):
            return list(self)

    columns = [Batch(c) for c in (maps, [5] * 40, [5] * 40, [0] * 40, [1] * 40)]
    parts = list(dies._gathered(5, 7).func(iter([columns])))
    dies._gathered.cache_clear()
    assert max(len(p) for p in parts) == 3 and sum(len(p) for p in parts) == 40 and set(sizes) == {3}
    rows = [r for p in parts for r in p.to_pylist()]
    for value, got in zip(maps, rows):
        if value is None:
            assert got is None
        else:
            want = np.zeros((5, 7), dtype=int)
            want[:, 1:6] = np.array(value)[[0, 0, 1, 1, 1]][:, [0, 0, 1, 1, 1]]
            assert got == want.tolist()
