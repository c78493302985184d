"""Queries over splits, folds and leakage checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import leakage, splits
from ..profile import PROTOCOL_ID, SOURCE_ROW_ID, SPLIT_ROLE
from ..sources.tables import NUMERIC_PROFILE, monthly_groups, sensor_frame, table
from . import sql
from .registry import query

STAMP = "yyyy-MM-dd HH:mm:ss"
GROUPED = replace(NUMERIC_PROFILE, excluded=("row_id",), groups=("grp",))
EVENTS = replace(NUMERIC_PROFILE, excluded=(), groups=(), feature_prefix="value")


def _tagged(spark, folder, strategy):
    return splits.tag_splits(sensor_frame(spark, folder), NUMERIC_PROFILE, "row_id").where(
        F.col("strategy") == strategy)


@query("T1", f"WITH {sql.B1}, {sql.split()} SELECT row_id, role FROM sp")
def time_split(spark, folder):
    return splits.time_split(sensor_frame(spark, folder), NUMERIC_PROFILE, role="role").select("row_id", "role")


@query("T1", f"""WITH {sql.B1}, g AS (SELECT year(ts) * 12 + month(ts) AS m, COUNT(*) AS n FROM b1 GROUP BY 1),
c AS (SELECT m, CAST(SUM(n) OVER (ORDER BY m) AS BIGINT) AS b, SUM(n) OVER () AS n FROM g),
t AS (SELECT CAST(FLOOR(MAX(n) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS t1,
 CAST(FLOOR(MAX(n) * CAST(0.85 AS DOUBLE)) AS BIGINT) AS t2, MAX(n) AS n FROM c),
s AS (SELECT m, b, ABS(b - t1) AS g1, ABS(b - t2) AS g2, MAX(b) OVER () AS lastb FROM c, t WHERE b < t.n),
a AS (SELECT b FROM s WHERE b < lastb ORDER BY g1, b LIMIT 1),
v AS (SELECT s.b FROM s, a WHERE s.b > a.b ORDER BY g2, s.b LIMIT 1)
SELECT a.b AS train_rows, v.b - a.b AS validation_rows, CAST(t.n - v.b AS BIGINT) AS test_rows FROM a, v, t""")
def time_split_whole_groups(spark, folder):
    """Calendar months stay whole, so the nearest month ends replace the plain cuts."""
    cut = splits.time_split(monthly_groups(sensor_frame(spark, folder)), GROUPED, role="role")
    return cut.agg(*[F.count_if(F.col("role") == r).alias(f"{r}_rows") for r in splits.ROLES])


@query("T2 L9", f"""WITH {sql.B1}, {sql.blocks('b1', 3)}, f AS (SELECT 1 AS fold UNION ALL SELECT 2 UNION ALL SELECT 3)
SELECT fold, COUNT(*) FILTER (block < fold) AS train_samples, COUNT(*) FILTER (block < fold AND label = 1) AS train_fail,
strftime(MIN(ts) FILTER (block < fold), '%Y-%m-%d %H:%M:%S') AS train_start,
strftime(MAX(ts) FILTER (block < fold), '%Y-%m-%d %H:%M:%S') AS train_end,
COUNT(*) FILTER (block = fold) AS evaluation_samples,
COUNT(*) FILTER (block = fold AND label = 1) AS evaluation_fail,
strftime(MIN(ts) FILTER (block = fold), '%Y-%m-%d %H:%M:%S') AS evaluation_start,
strftime(MAX(ts) FILTER (block = fold), '%Y-%m-%d %H:%M:%S') AS evaluation_end FROM bl, f GROUP BY fold""")
def temporal_fold_periods(spark, folder):
    blocked = splits.time_blocks(sensor_frame(spark, folder), NUMERIC_PROFILE, 3)
    periods = splits.fold_periods(splits.fold_membership(blocked, 3), NUMERIC_PROFILE)
    return periods.withColumns({c: F.date_format(c, STAMP) for c in periods.columns if c.endswith(("start", "end"))})


@query("T2", f"WITH {sql.B1}, {sql.blocks('b1', 4)} SELECT row_id, block FROM bl")
def temporal_fold_blocks(spark, folder):
    out = splits.time_blocks(sensor_frame(spark, folder), NUMERIC_PROFILE, 4)
    return out.select("row_id", F.col("block").cast("bigint").alias("block"))


@query("T2 P5", f"""WITH {sql.B1}, {sql.blocks('b1', 3)}, f AS (SELECT 1 AS fold UNION ALL SELECT 2 UNION ALL SELECT 3),
k AS (SELECT fold, grp, MAX(block < fold) AS a, MAX(block = fold) AS e FROM bl, f WHERE block <= fold GROUP BY fold, grp)
SELECT fold, COUNT(*) FILTER (a AND e) AS shared_keys FROM k GROUP BY fold""")
def temporal_fold_group_overlap(spark, folder):
    blocked = splits.time_blocks(sensor_frame(spark, folder), NUMERIC_PROFILE, 3)
    return splits.fold_key_overlap(splits.fold_membership(blocked, 3), ["grp"])


@query("T3", f"""WITH {sql.B1}, {sql.blocks('b1', 3)}, late AS (SELECT row_id, ts FROM bl WHERE block = 3),
lr AS (SELECT ts, ROW_NUMBER() OVER (ORDER BY ts) AS r, COUNT(*) OVER () AS m FROM (SELECT DISTINCT ts FROM late)),
bk AS (SELECT ts, CASE WHEN r <= (m % 3) * (m // 3 + 1) THEN (r - 1) // (m // 3 + 1) + 1
  ELSE (m % 3) + (r - 1 - (m % 3) * (m // 3 + 1)) // (m // 3) + 1 END AS block FROM lr)
SELECT row_id, CAST(block AS BIGINT) AS block FROM late JOIN bk USING (ts)""")
def post_selection_blocks(spark, folder):
    """Blocks of the rows after the selection blocks of the same frame."""
    late = splits.time_blocks(sensor_frame(spark, folder), NUMERIC_PROFILE, 3).where("block = 3").drop("block")
    return splits.later_blocks(late, NUMERIC_PROFILE, 3).select("row_id", F.col("block").cast("bigint").alias("block"))


_QUOTA = f"""WITH {sql.B1}, n AS (SELECT COUNT(*) AS n, CAST(CEIL(COUNT(*) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS later FROM b1),
c AS (SELECT label, COUNT(*) AS k FROM b1 GROUP BY label),
a AS (SELECT label, k, n, later, k * (n - later) / CAST(n AS DOUBLE) AS x FROM c, n),
a1 AS (SELECT *, CAST(FLOOR(x) AS BIGINT) + CASE WHEN ROW_NUMBER() OVER (ORDER BY x - FLOOR(x) DESC, CAST(label AS VARCHAR))
  <= (n - later) - SUM(CAST(FLOOR(x) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS tr FROM a),
b AS (SELECT *, (k - tr) * (later - CAST(CEIL(later * CAST(0.5 AS DOUBLE)) AS BIGINT)) / CAST(SUM(k - tr) OVER () AS DOUBLE) AS y FROM a1),
b1q AS (SELECT *, CAST(FLOOR(y) AS BIGINT) + CASE WHEN ROW_NUMBER() OVER (ORDER BY y - FLOOR(y) DESC, CAST(label AS VARCHAR))
  <= (later - CAST(CEIL(later * CAST(0.5 AS DOUBLE)) AS BIGINT)) - SUM(CAST(FLOOR(y) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS va FROM b)"""


@query("T4", f"""{_QUOTA}, r AS (SELECT row_id, label,
 ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), CAST(row_id AS VARCHAR)) AS rn FROM b1)
SELECT row_id, CASE WHEN rn <= tr THEN 'train' WHEN rn <= tr + va THEN 'validation' ELSE 'test' END AS role
FROM r JOIN b1q USING (label)""")
def random_split(spark, folder):
    return splits.random_split(sensor_frame(spark, folder), NUMERIC_PROFILE, ["row_id"], role="role").select(
        "row_id", "role")


@query("T5", f"""WITH {sql.B1}, g AS (SELECT grp, ROW_NUMBER() OVER (ORDER BY md5('42|' || grp), CAST(grp AS VARCHAR)) AS rn,
COUNT(*) OVER () AS n FROM (SELECT DISTINCT grp FROM b1)),
q AS (SELECT *, CAST(CEIL(n * CAST(0.3 AS DOUBLE)) AS BIGINT) AS later FROM g),
z AS (SELECT grp, CASE WHEN rn <= n - later THEN 'train'
 WHEN rn <= n - CAST(CEIL(later * CAST(0.5 AS DOUBLE)) AS BIGINT) THEN 'validation' ELSE 'test' END AS role FROM q)
SELECT row_id, role FROM b1 JOIN z USING (grp)""")
def random_group_split(spark, folder):
    return splits.random_group_split(sensor_frame(spark, folder), ["grp"], role="role").select("row_id", "role")


@query("T6", f"""WITH {sql.B1}, r AS (SELECT row_id, label, rep, COUNT(*) OVER (PARTITION BY rep, label) AS n,
ROW_NUMBER() OVER (PARTITION BY rep, label ORDER BY md5((41 + rep) || '|' || row_id), CAST(row_id AS VARCHAR)) AS rn
FROM b1, (SELECT 1 AS rep UNION ALL SELECT 2))
SELECT row_id, label, rep AS repeat, CASE WHEN rn <= n * 1 // 5 THEN 1 WHEN rn <= n * 2 // 5 THEN 2
WHEN rn <= n * 3 // 5 THEN 3 WHEN rn <= n * 4 // 5 THEN 4 ELSE 5 END AS fold FROM r""")
def stratified_folds(spark, folder):
    return splits.stratified_folds(sensor_frame(spark, folder), NUMERIC_PROFILE, ["row_id"], 5, 2)


@query("T7", f"""WITH {sql.B1}, s AS (SELECT grp, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS pos FROM b1 GROUP BY grp),
r AS (SELECT grp, rep, ROW_NUMBER() OVER (PARTITION BY rep, pos > 0 ORDER BY pos DESC, n DESC,
  md5((41 + rep) || '|' || '{{"grp":' || grp || '}}'), '{{"grp":' || grp || '}}') - 1 AS k
  FROM s, (SELECT 1 AS rep UNION ALL SELECT 2)),
f AS (SELECT grp, rep, CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END + 1 AS fold FROM r)
SELECT row_id, rep AS repeat, CAST(fold AS INTEGER) AS fold FROM b1 JOIN f USING (grp)""")
def stratified_group_folds(spark, folder):
    return splits.group_folds(sensor_frame(spark, folder), GROUPED, ["row_id"], 5, 2).select("row_id", "repeat", "fold")


@query("T7", f"""WITH {sql.B1} SELECT CAST(rep AS INTEGER) AS repeat, 5 AS folds, COUNT(DISTINCT label) = 2 AS both_labels,
5 * COUNT(*) // 5 AS rows FROM b1, (SELECT 1 AS rep UNION ALL SELECT 2) GROUP BY rep""")
def group_fold_coverage(spark, folder):
    """Both labels in every fold, every row in exactly one fold per repeat."""
    members = splits.group_folds(sensor_frame(spark, folder), GROUPED, ["row_id"], 5, 2)
    cover = splits.fold_label_coverage(members, GROUPED, ["repeat", "fold"])
    return cover.groupBy("repeat").agg(
        F.count(F.lit(1)).cast("int").alias("folds"), F.min("both_labels").alias("both_labels"),
        F.sum("rows").alias("rows"))


@query("T8", f"""WITH {sql.B1}, {sql.split()} SELECT row_id AS __source_row_id, role AS __split_role,
'time' AS strategy, TRUE AS one_protocol FROM sp""")
def tagged_time_split(spark, folder):
    tagged = _tagged(spark, folder, "time")
    digest = F.split(PROTOCOL_ID, ":")
    return tagged.select(SOURCE_ROW_ID, SPLIT_ROLE, "strategy",
                         ((F.element_at(digest, 1) == "time") & (F.length(F.element_at(digest, 2)) == 64))
                         .alias("one_protocol"))


@query("T8", f"""WITH {sql.B1}, {sql.split()} SELECT 'time' AS strategy, COUNT(DISTINCT label) AS labels, COUNT(*) AS rows,
ROUND(COUNT(*) FILTER (label = 1) / CAST(COUNT(*) AS DOUBLE), 6) AS positive_ratio FROM sp WHERE role = 'train'""")
def train_label_coverage(spark, folder):
    return rounded(splits.train_label_coverage(_tagged(spark, folder, "time"), NUMERIC_PROFILE))


@query("P4", f"""WITH {sql.B1} SELECT CAST(0 AS BIGINT) AS not_train_rows, CAST(0 AS BIGINT) AS null_ids,
COUNT(*) - COUNT(DISTINCT row_id) AS repeated_ids, CAST(0 AS BIGINT) AS null_protocols, 0 AS mixed_protocols FROM b1""")
def train_role_contract(spark, folder):
    return leakage.train_role_violations(_tagged(spark, folder, "time").where(F.col(SPLIT_ROLE) == "train"))


_PAIR = f"""SELECT COUNT(*) FILTER (role = 'train') AS train_rows, COUNT(*) FILTER (role = 'validation') AS later_rows,
CAST(0 AS BIGINT) AS shared_rows, 0 AS mixed_protocols, CAST(0 AS BIGINT) AS wrong_role_rows,
(SELECT COUNT(*) FROM (SELECT grp FROM sp WHERE role <> 'test' GROUP BY grp HAVING COUNT(DISTINCT role) = 2)) AS shared_groups,
COUNT(*) FILTER (ts IS NULL) AS bad_times,
CASE WHEN MAX(ts) FILTER (role = 'train') >= MIN(ts) FILTER (role = 'validation') THEN 1 ELSE 0 END AS time_overlap"""


@query("P5", f"WITH {sql.B1}, {sql.split()} {_PAIR} FROM sp")
def pair_leakage_time(spark, folder):
    tagged = _tagged(spark, folder, "time").drop("strategy")
    role = F.col(SPLIT_ROLE)
    return leakage.pair_violations(tagged.where(role == "train"), tagged.where(role == "validation"), GROUPED, True)


@query("P9", f"""WITH {sql.B1}, {sql.split()} SELECT CAST(COUNT(DISTINCT label) AS BIGINT) AS labels,
COUNT(*) FILTER (role = 'test') AS test_rows,
COALESCE(CAST(MAX(ts) FILTER (role = 'train') >= MIN(ts) FILTER (role = 'test') AS INTEGER), 1) AS time_overlap FROM sp""")
def final_pair_contract(spark, folder):
    tagged = _tagged(spark, folder, "time").drop("strategy")
    train, test = tagged.where(F.col(SPLIT_ROLE) == "train"), tagged.where(F.col(SPLIT_ROLE) == "test")
    pair = leakage.pair_violations(train, test, NUMERIC_PROFILE, True, later_role="test")
    labels = test.agg(F.count_distinct("label").alias("labels"))
    return pair.crossJoin(labels).select("labels", F.col("later_rows").alias("test_rows"), "time_overlap")


@query("P10", """SELECT COUNT(*) FILTER (o_orderkey % 10 = 3) AS only_left,
COUNT(*) FILTER (o_orderkey % 10 = 4) AS only_right, CAST(0 AS BIGINT) AS repeated_keys FROM orders""")
def same_rows_check(spark, folder):
    frame = sensor_frame(spark, folder)
    return leakage.same_rows(frame.where("row_id % 10 <> 4"), frame.where("row_id % 10 <> 3"), ["row_id", "label"])


@query("P7", f"""WITH {sql.B1}, {sql.blocks('b1', 3)}, f AS (SELECT 1 AS fold UNION ALL SELECT 2 UNION ALL SELECT 3),
p AS (SELECT fold, bl.* FROM bl, f WHERE block < fold), m AS (SELECT fold, MAX(ts) AS latest FROM p GROUP BY fold)
SELECT p.fold, row_id FROM p JOIN m ON p.fold = m.fold WHERE ts >= latest - INTERVAL 180 DAY""")
def recent_window_rows(spark, folder):
    blocked = splits.time_blocks(sensor_frame(spark, folder), NUMERIC_PROFILE, 3)
    return splits.recent_rows(splits.fold_membership(blocked, 3), NUMERIC_PROFILE, 180).select("fold", "row_id")


def _pairs_sql(keys, source="sp"):
    return f"""k AS (SELECT {keys}, MAX(role = 'train') AS a, MAX(role = 'validation') AS b, MAX(role = 'test') AS c
FROM {source} GROUP BY {keys}), o AS (SELECT COUNT(*) FILTER (a AND b) AS ab, COUNT(*) FILTER (a AND c) AS ac,
COUNT(*) FILTER (b AND c) AS bc FROM k)"""


def _check_sql(check, keys, info=False):
    status = "'INFO'" if info else "CASE WHEN ab + ac + bc = 0 THEN 'PASS' ELSE 'FAIL' END"
    return f"""WITH {sql.B1}, {sql.split()}, {_pairs_sql(keys)} SELECT '{check}' AS "check", {status} AS status,
ab AS train_validation, ac AS train_test, bc AS validation_test FROM o"""


@query("T9", _check_sql("duplicate_row_overlap", "label, machine, sensor_1, sensor_4"))
def duplicate_row_leakage(spark, folder):
    """Content without times and ids, so that equal sensor rows on both sides show."""
    frame = splits.time_split(sensor_frame(spark, folder), NUMERIC_PROFILE, role="role")
    return leakage.duplicate_content(frame.select("label", "machine", "sensor_1", "sensor_4", "role"), "role")


@query("T10", _check_sql("timestamp_overlap", "ts"))
def timestamp_leakage_time(spark, folder):
    frame = splits.time_split(sensor_frame(spark, folder), NUMERIC_PROFILE, role="role")
    return leakage.timestamp_overlap(frame, NUMERIC_PROFILE, "time", "role")


@query("T10", f"""{_QUOTA}, r AS (SELECT row_id, label, ts,
 ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), CAST(row_id AS VARCHAR)) AS rn FROM b1),
sp AS (SELECT ts, CASE WHEN rn <= tr THEN 'train' WHEN rn <= tr + va THEN 'validation' ELSE 'test' END AS role
FROM r JOIN b1q USING (label)), {_pairs_sql('ts')} SELECT 'timestamp_overlap' AS "check", 'INFO' AS status,
ab AS train_validation, ac AS train_test, bc AS validation_test FROM o""")
def timestamp_leakage_random(spark, folder):
    frame = splits.random_split(sensor_frame(spark, folder), NUMERIC_PROFILE, ["row_id"], role="role")
    return leakage.timestamp_overlap(frame, NUMERIC_PROFILE, "random", "role")


@query("T11", _check_sql("metadata_overlap:grp", "grp"))
def group_leakage(spark, folder):
    frame = splits.time_split(sensor_frame(spark, folder), NUMERIC_PROFILE, role="role")
    return leakage.metadata_overlap(frame, ["grp"], "role")


@query("T9 T10 T11", f"""WITH {sql.B1} SELECT "check", 'PASS' AS status, CAST(0 AS BIGINT) AS train_validation,
CAST(0 AS BIGINT) AS train_test, CAST(0 AS BIGINT) AS validation_test, 'time' AS split_type FROM b1,
(VALUES ('duplicate_row_overlap'), ('timestamp_overlap'), ('metadata_overlap:__source_row_id')) v("check")
GROUP BY "check" """)
def leakage_gate(spark, folder):
    return leakage.leakage_checks(_tagged(spark, folder, "time"), NUMERIC_PROFILE, "time")


@query("T12", f"""WITH {sql.B1}, {sql.split()}, e AS (SELECT strftime(MAX(ts) FILTER (role = 'train'), '%Y-%m-%d %H:%M:%S') AS a,
strftime(MIN(ts) FILTER (role = 'validation'), '%Y-%m-%d %H:%M:%S') AS b,
strftime(MAX(ts) FILTER (role = 'validation'), '%Y-%m-%d %H:%M:%S') AS c,
strftime(MIN(ts) FILTER (role = 'test'), '%Y-%m-%d %H:%M:%S') AS d FROM sp)
SELECT 'train_max < valid_min' AS "check", CASE WHEN a < b THEN 'PASS' ELSE 'FAIL' END AS status, a AS earlier_end,
 b AS later_start FROM e
UNION ALL SELECT 'valid_max < test_min', CASE WHEN c < d THEN 'PASS' ELSE 'FAIL' END, c, d FROM e
UNION ALL SELECT 'timestamp_parsing', 'PASS', NULL, NULL FROM e
UNION ALL SELECT 'overall', CASE WHEN a < b AND c < d THEN 'PASS' ELSE 'FAIL' END, a, d FROM e""")
def time_boundaries(spark, folder):
    frame = splits.time_split(sensor_frame(spark, folder), NUMERIC_PROFILE, role="role")
    out = leakage.time_boundaries(frame, NUMERIC_PROFILE, "role")
    return out.withColumns({c: F.date_format(c, STAMP) for c in ("earlier_end", "later_start")})


@query("T1 S1", """WITH t AS (SELECT ts, SUM(COUNT(*)) OVER (ORDER BY ts) AS b FROM events GROUP BY ts),
g AS (SELECT COUNT(*) AS n, CAST(FLOOR(COUNT(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS t1,
CAST(FLOOR(COUNT(*) * CAST(0.85 AS DOUBLE)) AS BIGINT) AS t2 FROM events),
c AS (SELECT MIN(ts) FILTER (b >= t1) AS c1, MIN(ts) FILTER (b >= t2) AS c2 FROM t, g)
SELECT COUNT(*) FILTER (ts <= c1) AS train_rows, COUNT(*) FILTER (ts > c1 AND ts <= c2) AS validation_rows,
COUNT(*) FILTER (ts > c2) AS test_rows FROM events, c""")
def event_time_split(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "value", F.lit(1).alias("label"))
    cut = splits.time_split(events, EVENTS, role="role")
    return cut.agg(*[F.count_if(F.col("role") == r).alias(f"{r}_rows") for r in splits.ROLES])
