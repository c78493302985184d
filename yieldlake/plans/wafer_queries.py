"""Queries over the die-map manifest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import dies
from ..functions.scalars import rounded
from ..operators import distribution
from ..scale import cut_lineage, scratch_path
from ..sources.tables import wafer_source
from ..wafer import canonical, groups, resize, summary
from .registry import query

VERSION = "w1"
_NAMES = "['None', 'Center', 'Donut', 'Edge-Loc', 'Edge-Ring', 'Loc', 'Near-Full', 'Random', 'Scratch']"

# Flat cells, lots and labels; a broken map has three in its second row.
_SOURCE = f"""ce AS (SELECT vec_id, label AS k, list_transform(embedding, lambda x, i:
  CASE WHEN i IN (1, 8, 57, 64) THEN 0 WHEN CAST(x AS DOUBLE) > CAST(0.1 AS DOUBLE) THEN 2 ELSE 1 END) AS cells FROM embeddings),
src AS (SELECT vec_id * 4 AS pos, cells, 'lot_' || (vec_id // 5) AS lot, vec_id % 25 AS wafer, k, FALSE AS bad FROM ce
 UNION ALL SELECT vec_id * 4 + 1, cells, 'twin_' || vec_id, vec_id % 25, k, FALSE FROM ce WHERE vec_id % 50 = 0
 UNION ALL SELECT vec_id * 4 + 2, cells, 'clash_' || vec_id, vec_id % 25, (k + 1) % 9, FALSE FROM ce WHERE vec_id % 100 = 0
 UNION ALL SELECT vec_id * 4 + 3, CASE WHEN vec_id % 240 = 7 THEN cells ELSE NULL END,
  CASE WHEN vec_id % 240 = 7 THEN NULL ELSE 'lot_x' END, vec_id % 25, NULL, TRUE FROM ce WHERE vec_id % 120 = 7),
mf AS (SELECT pos AS source_row_position, '{VERSION}:' || pos AS sample_id, lot AS lot_id, CAST(wafer AS VARCHAR) AS wafer_index,
 CASE WHEN k < 9 THEN ({_NAMES})[k + 1] END AS pattern_label, CASE WHEN k < 9 THEN k END AS class_index,
 CASE WHEN bad THEN 'invalid' WHEN k < 9 THEN 'labeled' ELSE 'unlabeled' END AS label_status,
 CASE WHEN bad THEN 'quarantined' ELSE 'accepted' END AS quality_status,
 CASE WHEN bad THEN 'quarantined' WHEN k < 9 THEN 'pending' ELSE 'unlabeled' END AS split,
 CASE WHEN cells IS NULL THEN 'INVALID_MAP_VALUES,' ELSE '' END
 || CASE WHEN bad AND lot IS NULL THEN 'MISSING_OR_INVALID_LOT,' ELSE '' END || CASE WHEN bad THEN 'INVALID_LABEL' ELSE '' END AS reasons,
 cells, CASE WHEN cells IS NOT NULL THEN sha256(unhex('08000000000000000800000000000000' ||
  list_aggregate(list_transform(cells, lambda c: '0' || c), 'string_agg', ''))) END AS map_hash,
 CASE WHEN cells IS NOT NULL THEN 8 END AS map_height, CASE WHEN cells IS NOT NULL THEN 8 END AS map_width,
 CAST(len(list_filter(cells, lambda c: c > 0)) AS INTEGER) AS valid_die_count,
 CAST(len(list_filter(cells, lambda c: c = 2)) AS INTEGER) AS failed_die_count,
 len(list_filter(cells, lambda c: c = 2)) / CAST(len(list_filter(cells, lambda c: c > 0)) AS DOUBLE) AS failed_die_ratio FROM src)"""


def manifest(spark, folder):
    """The canonical manifest; it stays lazy, so a query reads only the columns that it needs."""
    return canonical.canonical_manifest(
        wafer_source(spark, folder), VERSION, "position", "wafer_map", "failure_type", "lot_name", "wafer_index")


@query("W1 W2 W3 W4 W5 W6 P8", f"""WITH {_SOURCE} SELECT sample_id, source_row_position, lot_id, wafer_index, pattern_label,
CAST(class_index AS INTEGER) AS class_index, label_status, quality_status, split, reasons, map_hash, map_height, map_width,
valid_die_count, failed_die_count, ROUND(failed_die_ratio, 6) AS failed_die_ratio FROM mf""")
def canonical_manifest(spark, folder):
    out = manifest(spark, folder).withColumn("reasons", F.array_join("reason_codes", ","))
    return rounded(out.select(
        "sample_id", "source_row_position", "lot_id", "wafer_index", "pattern_label", "class_index", "label_status",
        "quality_status", "split", "reasons", "map_hash", "map_height", "map_width", "valid_die_count",
        "failed_die_count", "failed_die_ratio"))


@query("W1", """SELECT vec_id, CASE WHEN vec_id % 7 = 1 THEN 'invalid' WHEN vec_id % 7 IN (0, 2, 4, 5) THEN
 CASE WHEN vec_id % 7 = 0 THEN 'labeled' WHEN vec_id % 7 = 5 THEN 'invalid' ELSE 'unlabeled' END ELSE 'labeled' END AS label_status,
 CASE vec_id % 7 WHEN 0 THEN 'None' WHEN 3 THEN 'Near-Full' WHEN 6 THEN 'Edge-Ring' END AS pattern_label FROM embeddings""")
def nested_label_normalization(spark, folder):
    """Labels wrapped in two array levels, empty, blank, repeated and unknown."""
    kind = F.col("vec_id") % 7
    one = F.when(kind == 0, " none ").when(kind == 2, "  ").when(kind == 3, "Near-full").when(
        kind == 5, "Blob").when(kind == 6, "Edge-Ring")
    raw = F.when(kind == 1, F.array(F.array(F.lit("Loc"), F.lit("Donut")))).when(
        kind == 4, F.array(F.expr("cast(array() as array<string>)"))).otherwise(F.array(F.array(one)))
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", raw.alias("raw"))
    label = dies.normalized_label(F.col("raw"), rows.schema["raw"].dataType)
    return rows.select("vec_id", label["label_status"].alias("label_status"), label["pattern_label"].alias("pattern_label"))


@query("W6 Q17", f"""WITH {_SOURCE} SELECT kind, item, COUNT(*) AS rows FROM (
SELECT 'rows' AS kind, 'all' AS item FROM mf UNION ALL SELECT 'status', quality_status FROM mf
UNION ALL SELECT 'status', label_status FROM mf UNION ALL SELECT 'class', pattern_label FROM mf WHERE label_status = 'labeled'
UNION ALL SELECT 'reason', r FROM (SELECT UNNEST(string_split(rtrim(reasons, ','), ',')) AS r FROM mf WHERE reasons <> '')) GROUP BY kind, item""")
def manifest_counts(spark, folder):
    return canonical.manifest_counts(manifest(spark, folder))


@query("Q17", f"""WITH {_SOURCE} SELECT 'class' AS kind, 'Donut' AS item, COUNT(*) + 1 AS declared, COUNT(*) AS observed
FROM mf WHERE pattern_label = 'Donut'""")
def count_reconciliation(spark, folder):
    """Declared counts with one false entry."""
    rows = manifest(spark, folder)
    declared = canonical.manifest_counts(rows).withColumn("rows", F.col("rows") + F.when(F.col("item") == "Donut", 1).otherwise(0))
    return canonical.reconcile_counts(rows, declared)


@query("W6", f"""WITH {_SOURCE} SELECT COUNT(DISTINCT pattern_label) AS classes,
CASE WHEN COUNT(DISTINCT pattern_label) = 9 THEN 'complete' ELSE 'incomplete' END AS label_coverage_status FROM mf""")
def label_coverage(spark, folder):
    return canonical.label_coverage(manifest(spark, folder))


def _damaged(rows):
    p = F.col("source_row_position")
    return rows.withColumns({
        "sample_id": F.when(p % 40 == 0, "odd").otherwise(F.col("sample_id")),
        "class_index": F.when(p % 60 == 4, F.lit(8)).otherwise(F.col("class_index")),
        "split": F.when(p % 36 == 8, "train").otherwise(F.col("split")),
        "map_hash": F.when(p % 44 == 12, "xyz").otherwise(F.col("map_hash")),
        "failed_die_count": F.when(p % 52 == 16, F.lit(99)).otherwise(F.col("failed_die_count"))})


_BAD = f"""{_SOURCE}, v AS (
SELECT 'manifest' AS stage, 'INVALID_SAMPLE_ID' AS code FROM mf WHERE source_row_position % 40 = 0
UNION ALL SELECT 'manifest', 'LABEL_MAPPING_MISMATCH' FROM mf WHERE source_row_position % 60 = 4 AND label_status = 'labeled' AND class_index <> 8
UNION ALL SELECT 'manifest', 'INVALID_EMPTY_LABEL' FROM mf WHERE source_row_position % 60 = 4 AND label_status <> 'labeled'
UNION ALL SELECT 'manifest', 'INVALID_ROW_STATE' FROM mf WHERE source_row_position % 36 = 8
UNION ALL SELECT 'manifest', 'INVALID_MAP_HASH' FROM mf WHERE source_row_position % 44 = 12 AND cells IS NOT NULL
UNION ALL SELECT 'manifest', 'MISSING_MAP_REFERENCE' FROM mf WHERE source_row_position % 44 = 12 AND cells IS NULL
UNION ALL SELECT 'maps', 'MAP_HASH_MISMATCH' FROM mf WHERE source_row_position % 44 = 12 AND cells IS NOT NULL
UNION ALL SELECT 'maps', 'MAP_STATISTIC_MISMATCH' FROM mf WHERE source_row_position % 52 = 16 AND cells IS NOT NULL)"""


@query("W7 W8 W9", f"WITH {_BAD} SELECT stage, code, COUNT(*) AS rows FROM v GROUP BY stage, code")
def manifest_audit(spark, folder):
    """Codes found in a manifest damaged on purpose."""
    return canonical.audit_report(_damaged(manifest(spark, folder)), VERSION)


@query("W7 W8", """SELECT CAST(0 AS BIGINT) AS violations, COUNT(*) >= 0 AS read FROM embeddings""")
def intact_manifest_audit(spark, folder):
    return canonical.audit_report(manifest(spark, folder), VERSION).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("violations"), F.lit(True).alias("read"))


@query("S5 W7", f"""WITH {_SOURCE} SELECT COUNT(*) AS rows, COUNT(DISTINCT source_row_position) AS distinct_positions,
MIN(source_row_position) AS first_position, MAX(source_row_position) AS last_position, FALSE AS mixed_versions,
MIN(source_row_position) = 0 AND MAX(source_row_position) = COUNT(*) - 1 AS continuous FROM mf""")
def position_continuity(spark, folder):
    return canonical.position_continuity(manifest(spark, folder))


@query("W17", f"""WITH {_SOURCE} SELECT CASE WHEN cells IS NULL THEN 'INVALID_MAP_VALUES' ELSE 'valid' END AS map_status,
'8x8' AS shape, 'string' AS label_type, label_status, COUNT(*) AS rows FROM mf GROUP BY ALL""")
def source_profile(spark, folder):
    return canonical.source_profile(wafer_source(spark, folder), "wafer_map", "failure_type", None)


@query("Q13", f"""WITH {_SOURCE} SELECT c.pattern_label, COUNT(mf.sample_id) AS labeled_samples,
COUNT(*) FILTER (quality_status = 'accepted') AS accepted_labeled_samples,
COUNT(DISTINCT lot_id) FILTER (quality_status = 'accepted') AS accepted_lot_count
FROM (SELECT UNNEST({_NAMES}) AS pattern_label) c LEFT JOIN mf ON mf.pattern_label = c.pattern_label GROUP BY 1""")
def wafer_class_table(spark, folder):
    return summary.class_table(manifest(spark, folder))


@query("Q14 P6", f"WITH {_SOURCE} SELECT label_status, quality_status, COUNT(*) AS rows FROM mf GROUP BY 1, 2")
def wafer_status_table(spark, folder):
    return summary.status_table(manifest(spark, folder))


@query("Q15", f"WITH {_SOURCE} SELECT map_height, map_width, COUNT(*) AS rows FROM mf WHERE map_hash IS NOT NULL GROUP BY 1, 2")
def wafer_shape_table(spark, folder):
    return summary.shape_table(manifest(spark, folder))


@query("Q16", f"""WITH {_SOURCE} SELECT rows_per_lot, COUNT(*) AS lots FROM (SELECT lot_id, COUNT(*) AS rows_per_lot FROM mf
WHERE lot_id IS NOT NULL GROUP BY lot_id) GROUP BY rows_per_lot""")
def wafer_lot_sizes(spark, folder):
    return summary.lot_sizes(manifest(spark, folder))


@query("Q16", f"""WITH {_SOURCE}, h AS (SELECT map_hash, COUNT(*) AS n, COUNT(DISTINCT class_index) AS c FROM mf
WHERE map_hash IS NOT NULL GROUP BY map_hash)
SELECT (SELECT COUNT(*) FROM mf) AS row_count, (SELECT COUNT(map_hash) FROM mf) AS rows_with_valid_map,
(SELECT COUNT(DISTINCT lot_id) FROM mf) AS lot_count, COUNT(*) FILTER (n > 1) AS duplicate_map_groups,
CAST(COALESCE(SUM(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_duplicate_groups,
COUNT(*) FILTER (c > 1) AS map_label_conflict_groups FROM h""")
def wafer_statistics(spark, folder):
    return summary.statistics(manifest(spark, folder))


@query("W14", f"""WITH {_SOURCE} SELECT pattern_label, MIN(source_row_position) AS source_row_position FROM mf
WHERE quality_status = 'accepted' AND label_status = 'labeled' GROUP BY pattern_label""")
def first_class_examples(spark, folder):
    return summary.first_examples(manifest(spark, folder))


@query("R10", f"""WITH {_SOURCE}, s AS (SELECT MIN(failed_die_count) AS lo, MAX(failed_die_count) AS hi FROM mf WHERE map_hash IS NOT NULL),
b AS (SELECT LEAST(CAST(FLOOR((failed_die_count - lo) / ((hi - lo) / CAST(10 AS DOUBLE))) AS INTEGER), 9) AS bin FROM mf, s WHERE map_hash IS NOT NULL)
SELECT bin, COUNT(*) AS rows FROM b GROUP BY bin""")
def failed_die_histogram(spark, folder):
    rows = manifest(spark, folder).where("map_hash is not null")
    return distribution.histogram(rows, "failed_die_count", 10).select("bin", "rows")


_CORR = ["map_height", "map_width", "valid_die_count", "failed_die_count", "failed_die_ratio", "aspect_ratio"]


def _map_corr(key):
    head = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    part = f"PARTITION BY {key}" if key else ""
    ranks = ", ".join(
        f"RANK() OVER ({part} ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {head}{c}) - 1) / 2.0 AS r_{c}" for c in _CORR)
    cells = " UNION ALL ".join(
        f"""SELECT {head}COUNT(*) AS rows, '{m}' AS method, '{a}' AS first, '{b}' AS second, CASE WHEN COUNT(*) < 3
OR STDDEV_POP({p}{a}) = 0 OR STDDEV_POP({p}{b}) = 0 THEN NULL ELSE ROUND(CORR({p}{a}, {p}{b}), 6) END AS correlation FROM rk {group}"""
        for m, p in (("pearson", ""), ("spearman", "r_")) for i, a in enumerate(_CORR) for b in _CORR[i + 1:])
    where = "AND pattern_label IS NOT NULL" if key else ""
    return f"""WITH {_SOURCE}, ok AS (SELECT *, map_width / CAST(map_height AS DOUBLE) AS aspect_ratio FROM mf
WHERE map_hash IS NOT NULL AND quality_status = 'accepted' {where}), rk AS (SELECT *, {ranks} FROM ok) {cells}"""


@query("R11", _map_corr(""))
def map_correlations(spark, folder):
    return rounded(summary.map_correlations(manifest(spark, folder)))


@query("R12", _map_corr("pattern_label"))
def map_correlations_by_class(spark, folder):
    return rounded(summary.class_correlations(manifest(spark, folder)))


_CONFLICT = f"""{_SOURCE}, cf AS (SELECT map_hash FROM mf WHERE map_hash IS NOT NULL GROUP BY map_hash
HAVING COUNT(DISTINCT class_index) > 1),
ac AS (SELECT * FROM mf WHERE map_hash IS NULL OR map_hash NOT IN (SELECT map_hash FROM cf))"""


@query("T13", f"WITH {_CONFLICT} SELECT sample_id FROM ac")
def conflict_exclusion(spark, folder):
    return groups.without_conflicts(manifest(spark, folder)).select("sample_id")


def _components(source, tag):
    return f"""e{tag} AS (SELECT DISTINCT a.lot_id AS u, b.lot_id AS v FROM {source} a JOIN {source} b ON a.map_hash = b.map_hash
 WHERE a.lot_id IS NOT NULL AND b.lot_id IS NOT NULL),
r{tag} AS (SELECT DISTINCT lot_id AS u, lot_id AS v FROM {source} WHERE lot_id IS NOT NULL
 UNION SELECT r{tag}.u, e{tag}.v FROM r{tag} JOIN e{tag} ON r{tag}.v = e{tag}.u),
m{tag} AS (SELECT u AS lot_id, MIN(v) AS root FROM r{tag} GROUP BY u),
g{tag} AS (SELECT lot_id, DENSE_RANK() OVER (ORDER BY root) - 1 AS gid FROM m{tag})"""


@query("T14 T13", f"WITH RECURSIVE {_CONFLICT}, {_components('ac', '1')} SELECT lot_id, gid FROM g1")
def lot_groups(spark, folder):
    return groups.lot_groups(groups.without_conflicts(manifest(spark, folder)))


@query("T19", f"""WITH {_SOURCE}, h AS (SELECT COUNT(*) AS n, COUNT(DISTINCT class_index) AS c FROM mf WHERE map_hash IS NOT NULL GROUP BY map_hash),
w AS (SELECT 1 FROM mf WHERE lot_id IS NOT NULL AND wafer_index IS NOT NULL GROUP BY lot_id, wafer_index
 HAVING COUNT(DISTINCT map_hash) > 1 OR COUNT(DISTINCT class_index) > 1)
SELECT COUNT(*) FILTER (n > 1) AS duplicate_map_groups, COUNT(*) FILTER (c > 1) AS map_label_conflicts,
(SELECT COUNT(*) FROM w) AS wafer_id_conflicts FROM h""")
def duplicate_audit(spark, folder):
    return groups.duplicate_audit(manifest(spark, folder))


def _grouped(spark, folder):
    return _groups_of(manifest(spark, folder))


def _groups_of(rows):
    active = cut_lineage(groups.without_conflicts(rows.drop("map")))
    lots = cut_lineage(groups.lot_groups(active))
    return active, lots, cut_lineage(groups.group_class_counts(active, lots))


_SUPPORT = f"""{_CONFLICT}, {_components('ac', '1')}, gc AS (SELECT gid, class_index, COUNT(*) AS n FROM ac JOIN g1 USING (lot_id)
WHERE quality_status = 'accepted' AND class_index IS NOT NULL GROUP BY gid, class_index)"""


@query("T14 T20", f"""WITH RECURSIVE {_SUPPORT} SELECT CAST(i AS INTEGER) AS class_index, ({_NAMES})[i + 1] AS pattern_label,
COUNT(DISTINCT gid) AS groups, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS samples
FROM (SELECT UNNEST(range(9)) AS i) LEFT JOIN gc ON gc.class_index = i GROUP BY i""")
def class_group_support(spark, folder):
    return groups.class_group_support(_grouped(spark, folder)[2])


@query("T20", f"""WITH RECURSIVE {_SUPPORT}, z AS (SELECT gid, SUM(n) AS n FROM gc GROUP BY gid),
x AS (SELECT ROUND(MAX(n) / CAST(SUM(n) AS DOUBLE), 6) AS largest_group_ratio FROM z),
s AS (SELECT MIN(c) AS lo, MAX(c) AS hi FROM (SELECT i, COUNT(DISTINCT gid) AS c FROM (SELECT UNNEST(range(9)) AS i)
 LEFT JOIN gc ON gc.class_index = i GROUP BY i)),
w AS (SELECT COUNT(*) AS k FROM (SELECT 1 FROM ac WHERE lot_id IS NOT NULL AND wafer_index IS NOT NULL GROUP BY lot_id, wafer_index
 HAVING COUNT(DISTINCT map_hash) > 1 OR COUNT(DISTINCT class_index) > 1))
SELECT largest_group_ratio, 'MAP_LABEL_CONFLICT' AS code, TRUE AS passed FROM x
UNION ALL SELECT largest_group_ratio, 'WAFER_ID_CONFLICT', k = 0 FROM x, w
UNION ALL SELECT largest_group_ratio, 'NO_LABELED_GROUPS', hi > 0 FROM x, s
UNION ALL SELECT largest_group_ratio, 'INSUFFICIENT_CLASS_GROUPS', lo >= 3 FROM x, s
UNION ALL SELECT largest_group_ratio, 'LARGE_CONNECTED_GROUP', largest_group_ratio <= 0.2 FROM x""")
def split_feasibility(spark, folder):
    active, _, counts = _grouped(spark, folder)
    return rounded(groups.split_feasibility(groups.duplicate_audit(active), counts))


@query("T15", f"""WITH RECURSIVE {_SUPPORT} SELECT COUNT(DISTINCT gid) AS groups, CAST(3 AS BIGINT) AS splits,
TRUE AS every_class_in_every_split FROM gc""")
def group_assignment(spark, folder):
    """Every labeled group is assigned once and every class reaches every split."""
    _, _, counts = _grouped(spark, folder)
    chosen = groups.choose_assignment(counts)
    cells = counts.join(chosen, "gid").groupBy("split", "class_index").agg(F.count(F.lit(1)).alias("n"))
    totals = chosen.agg(F.count_distinct("gid").alias("groups"), F.count_distinct("split").alias("splits"))
    return totals.crossJoin(cells.agg((F.count(F.lit(1)) == 27).alias("every_class_in_every_split")))


@query("T15", f"""WITH RECURSIVE {_SUPPORT} SELECT CAST(UNNEST(range(32)) AS INTEGER) AS candidate,
(SELECT COUNT(DISTINCT gid) FROM gc) AS groups, (SELECT CAST(SUM(n) AS BIGINT) FROM gc) AS samples""")
def assignment_candidate_totals(spark, folder):
    """Each of the 32 candidates places every labeled group and row exactly once."""
    counts = _grouped(spark, folder)[2]
    placed = groups.assignment_candidates(counts, groups.GroupSplitConfig())
    size = sum((F.col(f"c{c}") for c in range(9)), F.lit(0))
    return placed.groupBy("candidate").agg(F.count_distinct("gid").alias("groups"), F.sum(size).alias("samples"))


@query("T15", f"""WITH RECURSIVE {_SUPPORT}, ct AS (SELECT class_index, SUM(n) AS total FROM gc GROUP BY class_index),
mx AS (SELECT gid, SUM(n) AS size, arg_min(class_index, (total, class_index)) AS rare FROM gc JOIN ct USING (class_index) GROUP BY gid),
cd AS (SELECT *, md5('42|' || candidate || '|' || gid) AS h FROM mx, (SELECT UNNEST(range(32)) AS candidate)),
pl AS (SELECT *, (SUM(size) OVER (PARTITION BY candidate, rare ORDER BY h, gid) - size / 2.0::DOUBLE) / SUM(size) OVER (PARTITION BY candidate, rare) AS middle FROM cd)
SELECT CAST(candidate AS INTEGER) AS candidate, gid, CASE WHEN middle < 0.7::DOUBLE THEN 0 WHEN middle < 0.7::DOUBLE + 0.15::DOUBLE THEN 1 ELSE 2 END AS slot FROM pl""")
def assignment_bands(spark, folder):
    """The split that each candidate's bands give every labeled group, before seeds and exchanges."""
    return groups.assignment_bands(_grouped(spark, folder)[2], groups.GroupSplitConfig()).select("candidate", "gid", "slot")


@query("T15 T20", f"""WITH RECURSIVE {_SUPPORT} SELECT gid, CAST(SUM(n) AS BIGINT) AS samples, COUNT(*) AS classes, 1 AS splits,
9 AS classes_in_split, TRUE AS no_worse_than_seeded FROM gc GROUP BY gid""")
def improved_assignment(spark, folder):
    """Every labeled group with its one split, the classes that split holds, and the objective after exchanges."""
    counts = _grouped(spark, folder)[2]
    found = groups.improve_assignment(counts)
    ratios = np.array(groups.GroupSplitConfig().ratios)
    better = bool(groups.split_objective(found.final, ratios) <= groups.split_objective(found.seeded, ratios))
    placed = counts.join(found.groups, "gid")
    held = placed.groupBy("split").agg(F.count_distinct("class_index").cast("int").alias("classes_in_split"))
    return placed.groupBy("gid").agg(
        F.sum("n").alias("samples"), F.count_distinct("class_index").alias("classes"), F.count_distinct("split").cast("int").alias("splits"),
        F.max("split").alias("split")).join(held, "split").select(
        "gid", "samples", "classes", "splits", "classes_in_split", F.lit(better).alias("no_worse_than_seeded"))


def _split_rows(spark, folder, with_map=True):
    """The split without maps, which join by sample at the end where they are wanted."""
    whole = manifest(spark, folder)
    rows = cut_lineage(whole.drop("map"))
    _, lots, counts = _groups_of(rows)
    assignment = groups.choose_assignment(counts)
    split = groups.split_manifest(rows, lots, assignment, "p1")
    return split.join(whole.select("sample_id", "map"), "sample_id") if with_map else split, lots, assignment, rows


@query("T16", """SELECT CAST(0 AS BIGINT) AS lot_id_overlap, CAST(0 AS BIGINT) AS map_hash_overlap FROM (SELECT COUNT(*) AS n FROM embeddings) t""")
def assignment_overlap(spark, folder):
    active, lots, counts = _grouped(spark, folder)
    return groups.assignment_overlap(active, lots, groups.choose_assignment(counts))


@query("S9 T13 T15", f"""WITH {_CONFLICT} SELECT sample_id, map_hash IN (SELECT map_hash FROM cf) AND map_hash IS NOT NULL AS excluded,
CASE WHEN (map_hash IS NOT NULL AND map_hash IN (SELECT map_hash FROM cf)) OR quality_status <> 'accepted' THEN 'quarantined'
WHEN label_status <> 'labeled' THEN 'unlabeled' ELSE 'assigned' END AS state FROM mf""")
def split_manifest_states(spark, folder):
    rows = _split_rows(spark, folder, False)[0]
    return rows.select("sample_id", (F.size("exclusion_reasons") > 0).alias("excluded"),
                       F.when(F.col("split").isin(*groups.SPLITS), "assigned").otherwise(F.col("split")).alias("state"))


@query("T17", f"""WITH {_SOURCE} SELECT * FROM (SELECT 'SOURCE_ROW_CHANGED' AS code, COUNT(*) FILTER (source_row_position % 40 = 0) AS rows FROM mf
UNION ALL SELECT 'PROTOCOL_MISMATCH', COUNT(*) FILTER (source_row_position % 60 = 0) FROM mf) WHERE rows > 0""")
def split_manifest_audit(spark, folder):
    """Audit codes of a derived manifest with some rows changed on purpose."""
    derived, _, _, rows = _split_rows(spark, folder, False)
    p = F.col("source_row_position")
    derived = derived.withColumns({
        "wafer_index": F.when(p % 40 == 0, "changed").otherwise(F.col("wafer_index")),
        "split_protocol_id": F.when(p % 60 == 0, "other").otherwise(F.col("split_protocol_id"))})
    return groups.split_manifest_violations(derived, rows.drop("map"), "p1")


@query("T18", f"""WITH RECURSIVE {_CONFLICT}, {_components('mf', '0')}, {_components('ac', '1')},
b AS (SELECT class_index, COUNT(*) AS s, COUNT(DISTINCT mf.lot_id) AS l, COUNT(DISTINCT gid) AS g FROM mf LEFT JOIN g0 ON g0.lot_id = mf.lot_id
 WHERE quality_status = 'accepted' AND class_index IS NOT NULL GROUP BY class_index),
a AS (SELECT class_index, COUNT(*) AS s, COUNT(DISTINCT ac.lot_id) AS l, COUNT(DISTINCT gid) AS g FROM ac LEFT JOIN g1 ON g1.lot_id = ac.lot_id
 WHERE quality_status = 'accepted' AND class_index IS NOT NULL GROUP BY class_index)
SELECT CAST(i AS INTEGER) AS class_index, ({_NAMES})[i + 1] AS pattern_label, COALESCE(b.s, 0) AS samples_before,
COALESCE(b.l, 0) AS lots_before, COALESCE(b.g, 0) AS groups_before, COALESCE(b.g, 0) >= 3 AS minimum_groups_met_before,
COALESCE(a.s, 0) AS samples_after, COALESCE(a.l, 0) AS lots_after, COALESCE(a.g, 0) AS groups_after,
COALESCE(a.g, 0) >= 3 AS minimum_groups_met_after, COALESCE(b.s, 0) - COALESCE(a.s, 0) AS excluded_labeled_samples
FROM (SELECT UNNEST(range(9)) AS i) LEFT JOIN b ON b.class_index = i LEFT JOIN a ON a.class_index = i""")
def exclusion_comparison(spark, folder):
    return groups.exclusion_comparison(manifest(spark, folder))


@query("T21", f"""WITH {_CONFLICT}, n AS (SELECT COUNT(*) AS n FROM ac WHERE quality_status = 'accepted' AND label_status = 'labeled')
SELECT CAST(27 AS BIGINT) AS cells, n AS samples, TRUE AS shares_sum_to_one FROM n""")
def split_class_summary(spark, folder):
    table = groups.split_summary(_split_rows(spark, folder, False)[0])
    return table.agg(
        F.count(F.lit(1)).alias("cells"), F.sum("samples").alias("samples"),
        (F.abs(F.sum(F.col("split_ratio")) / 9 - 1) < 1e-9).alias("shares_sum_to_one"))


def _picks(new, old):
    """Source index (1-based) of each output index for an ``old`` to ``new`` resize."""
    return [((2 * i + 1) * old) // (2 * new) + 1 for i in range(new)]


# An 8x8 map at 12x20: scale 12/8, twelve by twelve cells, four columns of padding on both sides.
_RESIZE_COLS = _picks(12, 8)
_RESIZED = "flatten([list_concat([0, 0, 0, 0], " + "), list_concat([0, 0, 0, 0], ".join(
    "[" + ", ".join(f"cells[{(y - 1) * 8 + x}]" for x in _RESIZE_COLS) + "], [0, 0, 0, 0]" for y in _RESIZE_COLS) + ")])"


@query("W10", f"""WITH {_SOURCE} SELECT sample_id, 12 AS resized_height, 12 AS resized_width, ROUND(1.5, 6)::DOUBLE AS scale,
0 AS top, 4 AS left, 0 AS bottom, 4 AS right, list_aggregate({_RESIZED}, 'string_agg', '') AS cells FROM mf WHERE cells IS NOT NULL""")
def resized_maps(spark, folder):
    rows = resize.with_resized(manifest(spark, folder).where("map is not null"), (12, 20))
    return rounded(rows.select(
        "sample_id", "geometry.resized_height", "geometry.resized_width", "geometry.scale", "geometry.top", "geometry.left",
        "geometry.bottom", "geometry.right",
        F.array_join(F.flatten("resized").cast("array<string>"), "").alias("cells")))


@query("W11", f"""WITH {_SOURCE} SELECT sample_id, list_aggregate(list_transform(cells, lambda c: CASE WHEN c = 2 THEN '1' ELSE '0' END), 'string_agg', '') AS defect,
list_aggregate(list_transform(cells, lambda c: CASE WHEN c > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS valid FROM mf WHERE cells IS NOT NULL""")
def channel_masks(spark, folder):
    rows = resize.as_channels(manifest(spark, folder).where("map is not null"))

    def text(i):
        return F.array_join(F.flatten(F.get("channels", F.lit(i))).cast("array<int>").cast("array<string>"), "")

    return rows.select("sample_id", text(0).alias("defect"), text(1).alias("valid"))


_SMALL = [_picks(3, 8)[i] for i in range(3)]
_SMALL_CELLS = "[" + ", ".join(f"cells[{(y - 1) * 8 + x}]" for y in _SMALL for x in _SMALL) + "]"


@query("W12 W13", f"""WITH {_SOURCE}, t AS (SELECT sample_id, cells, {_SMALL_CELLS} AS tc, pattern_label, valid_die_count AS v0, failed_die_count AS f0,
 failed_die_ratio AS r0 FROM mf WHERE cells IS NOT NULL),
c AS (SELECT *, len(list_filter(tc, lambda c: c > 0)) AS v1, len(list_filter(tc, lambda c: c = 2)) AS f1 FROM t)
SELECT sample_id, v0 AS original_valid_dies, f0 AS original_failed_dies, CAST(v1 AS INTEGER) AS transformed_valid_pixels,
CAST(f1 AS INTEGER) AS transformed_failed_pixels, ROUND(r0, 6) AS original_failed_ratio,
ROUND(CASE WHEN v1 > 0 THEN f1 / CAST(v1 AS DOUBLE) END, 6) AS transformed_failed_ratio,
ROUND(ABS(CASE WHEN v1 > 0 THEN f1 / CAST(v1 AS DOUBLE) END - r0), 6) AS absolute_ratio_delta,
f0 > 0 AND f1 = 0 AS failed_region_lost, v1 = 0 AS valid_region_lost FROM c""")
def preservation_metrics(spark, folder):
    rows = resize.with_resized(manifest(spark, folder).where("map is not null"), (3, 3))
    measured = rows.withColumns(resize.preservation(F.col("map"), F.col("resized")))
    return rounded(measured.select("sample_id", *resize.preservation(F.col("map"), F.col("resized"))))


@query("W13 W15", """SELECT CAST(18 AS BIGINT) AS cells, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS gate_breaks FROM (SELECT COUNT(*) AS n FROM embeddings) t""")
def preservation_report(spark, folder):
    """Report cells of the development splits, lost regions and gate breaks at model size."""
    rows = cut_lineage(_split_rows(spark, folder)[0])
    report = cut_lineage(resize.preservation_report(resize.preservation_rows(rows)))
    totals = report.agg(F.count(F.lit(1)).alias("cells"),
                        F.sum(F.col("failed_region_lost") + F.col("valid_region_lost")).alias("lost"))
    return totals.crossJoin(resize.check_gate(report, rows).agg(F.count(F.lit(1)).alias("gate_breaks")))


@query("W14")
def resize_examples(spark, folder):
    rows = _split_rows(spark, folder)[0]
    return resize.example_picks(resize.preservation_rows(rows))


@query("W16 S8", f"""WITH {_CONFLICT} SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS repeated_ids, CAST(0 AS BIGINT) AS wrong_shape,
CAST(0 AS BIGINT) AS wrong_values, CAST(0 AS BIGINT) AS defect_outside_valid, CAST(0 AS BIGINT) AS wrong_class,
CAST(0 AS BIGINT) AS wrong_split FROM ac WHERE quality_status = 'accepted' AND label_status = 'labeled'""")
def input_table_contract(spark, folder):
    """The gated input table at model size, written by split and read back."""
    rows = cut_lineage(_split_rows(spark, folder)[0])
    report = cut_lineage(resize.preservation_report(resize.preservation_rows(rows)))
    path = scratch_path(spark)
    resize.write_input_table(rows, report, path)
    return resize.input_violations(spark.read.parquet(path))


@query("S8")
def input_class_weights(spark, folder):
    return rounded(resize.class_weights(_split_rows(spark, folder, False)[0]))
