"""Queries over the sensor frame: quality, drift, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import distribution, drift, quality
from ..operators.splits import fold_membership, time_blocks, time_split
from ..profile import feature_frame, label_violations
from ..columns import column_quantiles
from ..sources.tables import NUMERIC_PROFILE, SENSOR_PROFILE, SENSORS, score_frame, sensor_frame
from . import sql
from .registry import query

STAMP = "yyyy-MM-dd HH:mm:ss"


def split_frame(spark, folder, profile=SENSOR_PROFILE):
    return time_split(sensor_frame(spark, folder), profile, role="role")


@query("P2", f"""WITH {sql.B1} SELECT COUNT(*) AS row_count, COUNT(*) FILTER (label IS NULL) AS null_labels,
COUNT(*) FILTER (label NOT IN (-1, 1)) AS unknown_labels, COUNT(*) FILTER (label = -1) AS negative_rows,
COUNT(*) FILTER (label = 1) AS positive_rows FROM b1""")
def label_contract(spark, folder):
    return label_violations(sensor_frame(spark, folder), SENSOR_PROFILE)


@query("P1 P3", f"""WITH {sql.B1} SELECT machine, {', '.join(f'ROUND({f}, 6) AS {f}' for f in sql.FEATURES)}, label
FROM b1""")
def feature_projection(spark, folder):
    frame = sensor_frame(spark, folder)
    order = [*reversed(SENSORS), "machine"]
    return rounded(feature_frame(frame, SENSOR_PROFILE, order))


@query("Q1", f"""WITH {sql.B1}, d AS (SELECT DISTINCT label, sensor_1, sensor_4, machine FROM b1)
SELECT (SELECT COUNT(*) FROM b1) - (SELECT COUNT(*) FROM d) AS duplicate_row_count""")
def duplicate_rows(spark, folder):
    return quality.duplicate_row_count(
        sensor_frame(spark, folder).select("label", "sensor_1", "sensor_4", "machine"))


@query("Q2 Q7", f"""WITH {sql.B1} SELECT CAST(label AS VARCHAR) AS "class", COUNT(*) AS "count",
ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 6) AS ratio FROM b1 GROUP BY label""")
def class_distribution(spark, folder):
    return rounded(quality.class_distribution(sensor_frame(spark, folder), "label"))


@query("Q8", f"""WITH {sql.B1} """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT(*) FILTER ({c} IS NULL) AS missing_count,
    ROUND(COUNT(*) FILTER ({c} IS NULL) / CAST(COUNT(*) AS DOUBLE), 6) AS missing_rate FROM b1"""
    for c in ["row_id", "ts", "grp", "label", *sql.FEATURES, "machine"]))
def missing_summary(spark, folder):
    return rounded(quality.missing_summary(sensor_frame(spark, folder)))


@query("Q3 Q9", """WITH t AS (SELECT CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 'not a time'
  ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS raw,
  CASE WHEN event_id % 50 IN (0, 1) THEN NULL ELSE date_trunc('second', ts) END AS ts FROM events)
SELECT COUNT(*) FILTER (raw IS NULL) AS missing_count, COUNT(*) FILTER (raw IS NOT NULL AND ts IS NULL)
  AS parse_failure_count, COUNT(ts) - COUNT(DISTINCT ts) AS duplicate_count, COUNT(DISTINCT ts) AS unique_count,
  strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS minimum, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS maximum FROM t""")
def timestamp_profile(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        F.when(F.col("event_id") % 50 == 0, None).when(F.col("event_id") % 50 == 1, "not a time")
        .otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).alias("stamp"))
    out = quality.timestamp_profile(events, "stamp", "dd/MM/yyyy HH:mm:ss")
    return out.withColumns({c: F.date_format(c, STAMP) for c in ("minimum", "maximum")})


@query("Q9", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, COUNT(*) AS rows FROM events GROUP BY 1")
def rows_per_day(spark, folder):
    out = quality.rows_per_day(spark.read.parquet(f"{folder}/events.parquet"), "ts")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_STATUS = f"""st AS (SELECT feature, COUNT(*) FILTER (value IS NULL) / CAST(COUNT(*) AS DOUBLE) AS missing_ratio,
COUNT(DISTINCT value) AS unique_count FROM ({sql.long('b1', 'row_id')}) GROUP BY feature),
sv AS (SELECT *, missing_ratio > 0.5 AS high_missing, missing_ratio <= 0.5 AND unique_count <= 1 AS constant FROM st)"""


@query("Q4 Q5 Q11", f"""WITH {sql.B1}, {_STATUS} SELECT feature, ROUND(missing_ratio, 6) AS missing_ratio, unique_count,
high_missing, constant, CASE WHEN high_missing THEN 'removed_high_missing' WHEN constant THEN 'removed_constant'
ELSE 'used' END AS status FROM sv""")
def quality_filter_status(spark, folder):
    return rounded(quality.feature_profile(sensor_frame(spark, folder), NUMERIC_PROFILE))


@query("Q6", f"""WITH {sql.B1}, {_STATUS} SELECT COUNT(*) AS feature_count,
COUNT(*) FILTER (high_missing) AS high_missing_count, COUNT(*) FILTER (constant) AS constant_count,
COUNT(*) FILTER (NOT high_missing AND NOT constant) AS remaining_count FROM sv""")
def feature_summary(spark, folder):
    return quality.feature_summary(quality.feature_profile(sensor_frame(spark, folder), NUMERIC_PROFILE))


@query("Q1 Q2 Q3 Q4 Q5 Q6", f"""WITH {sql.B1}, {_STATUS}, dd AS (SELECT DISTINCT * FROM b1)
SELECT 'dataset' AS category, 'row_count' AS item, CAST(COUNT(*) AS VARCHAR) AS value, 'all rows' AS rule,
 'record' AS action FROM b1
UNION ALL SELECT 'dataset', 'column_count', '11', 'all columns', 'record'
UNION ALL SELECT 'dataset', 'duplicate_row_count',
 CAST((SELECT COUNT(*) FROM b1) - (SELECT COUNT(*) FROM dd) AS VARCHAR), 'exact full-row duplicate', 'review'
UNION ALL SELECT 'label_distribution', CAST(label AS VARCHAR), CAST(COUNT(*) AS VARCHAR), 'column=label', 'record'
 FROM b1 GROUP BY label
UNION ALL SELECT 'timestamp', 'missing_count', CAST(COUNT(*) FILTER (ts IS NULL) AS VARCHAR), 'column=ts', 'review' FROM b1
UNION ALL SELECT 'timestamp', 'parse_failure_count', '0', 'format=None', 'review'
UNION ALL SELECT 'timestamp', 'duplicate_count', CAST(COUNT(ts) - COUNT(DISTINCT ts) AS VARCHAR),
 'parsed timestamp duplicate', 'review' FROM b1
UNION ALL SELECT 'timestamp', 'minimum', strftime(MIN(ts), '%Y-%m-%d %H:%M:%S'), 'format=None', 'record' FROM b1
UNION ALL SELECT 'timestamp', 'maximum', strftime(MAX(ts), '%Y-%m-%d %H:%M:%S'), 'format=None', 'record' FROM b1
UNION ALL SELECT 'feature_missing_ratio', feature, CAST(ROUND(missing_ratio, 6) AS VARCHAR), 'missing_ratio > 0.5',
 CASE WHEN high_missing THEN 'eda_candidate_drop' ELSE 'keep' END FROM sv
UNION ALL SELECT 'feature_constant_check', feature, CAST(unique_count AS VARCHAR), 'unique_non_missing_count <= 1',
 CASE WHEN constant THEN 'eda_candidate_drop' ELSE 'keep' END FROM sv WHERE NOT high_missing
UNION ALL SELECT 'feature_summary', 'feature_count', CAST(COUNT(*) AS VARCHAR), 'Dataset Profile selection', 'record' FROM sv
UNION ALL SELECT 'feature_summary', 'high_missing_candidate_count', CAST(COUNT(*) FILTER (high_missing) AS VARCHAR),
 'missing_ratio > 0.5', 'eda_only' FROM sv
UNION ALL SELECT 'feature_summary', 'constant_candidate_count', CAST(COUNT(*) FILTER (constant) AS VARCHAR),
 'unique_non_missing_count <= 1', 'eda_only' FROM sv
UNION ALL SELECT 'feature_summary', 'remaining_feature_candidate_count',
 CAST(COUNT(*) FILTER (NOT high_missing AND NOT constant) AS VARCHAR),
 'feature_count - high_missing_candidates - constant_candidates', 'eda_only' FROM sv""")
def quality_log(spark, folder):
    return quality.quality_log(sensor_frame(spark, folder), NUMERIC_PROFILE)


@query("Q10", f"""WITH {sql.B1}, {sql.split()}, g AS (SELECT s.role, c.label FROM (SELECT DISTINCT role FROM sp) s,
 (SELECT * FROM (VALUES (-1), (1), (0)) v(label)) c)
SELECT g.role AS split, CAST(g.label AS VARCHAR) AS "class", COUNT(sp.label) AS "count",
ROUND(COUNT(sp.label) / CAST(SUM(COUNT(sp.label)) OVER (PARTITION BY g.role) AS DOUBLE), 6) AS ratio
FROM g LEFT JOIN sp ON sp.role = g.role AND sp.label = g.label GROUP BY g.role, g.label""")
def split_summary(spark, folder):
    return rounded(quality.split_summary(
        split_frame(spark, folder), "role", "label", [-1, 1, 0], ["train", "validation", "test"]))


@query("Q12", f"""WITH {sql.B1}, {sql.blocks('b1', 3)}, f AS (SELECT 1 AS fold UNION ALL SELECT 2 UNION ALL SELECT 3),
fm AS (SELECT f.fold, b.* FROM bl b, f WHERE b.block < f.fold),
st AS (SELECT fold, feature, COUNT(*) FILTER (value IS NULL) / CAST(COUNT(*) AS DOUBLE) AS mr,
 COUNT(DISTINCT value) AS u FROM ({sql.long('fm', 'fold')}) GROUP BY fold, feature),
sv AS (SELECT *, mr > 0.5 AS h, mr <= 0.5 AND u <= 1 AS c FROM st)
SELECT fold, COUNT(*) AS input_feature_count, COUNT(*) FILTER (h) AS high_missing_removed_count,
COUNT(*) FILTER (c) AS constant_removed_count, COUNT(*) FILTER (h OR c) AS removed_feature_count,
COUNT(*) FILTER (NOT h AND NOT c) AS retained_feature_count,
COALESCE(STRING_AGG(feature, ',' ORDER BY feature) FILTER (h), '') AS high_missing_features,
COALESCE(STRING_AGG(feature, ',' ORDER BY feature) FILTER (c), '') AS constant_features
FROM sv GROUP BY fold""")
def quality_filter_by_fold(spark, folder):
    blocked = time_blocks(sensor_frame(spark, folder), NUMERIC_PROFILE, 3)
    fit = fold_membership(blocked, 3).where("fold_role = 'fit'").select(
        "fold", "row_id", "ts", "grp", "label", *SENSORS)
    return quality.quality_filter_by_fold(fit, NUMERIC_PROFILE)


_EDGES = [i / 10 for i in range(11)]
_PSI = f"""lg AS (SELECT * FROM ({sql.long('sp', 'role')}) WHERE value IS NOT NULL AND role <> 'test'),
ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {_EDGES}))) AS e FROM lg WHERE role = 'train'
  GROUP BY feature),
e3 AS (SELECT * FROM ed WHERE len(e) >= 3),
bn AS (SELECT lg.feature, role, len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) AS bin FROM lg JOIN e3 USING (feature)),
bc AS (SELECT feature, bin, COUNT(*) FILTER (role = 'train') AS t, COUNT(*) FILTER (role = 'validation') AS v
  FROM bn GROUP BY feature, bin),
bt AS (SELECT feature, SUM(t) AS tt, SUM(v) AS vv FROM bc GROUP BY feature),
gr AS (SELECT feature, UNNEST(range(len(e) - 1)) AS bin FROM e3),
rt AS (SELECT gr.feature, GREATEST(COALESCE(t, 0) / CAST(tt AS DOUBLE), 1e-6) AS t,
  GREATEST(COALESCE(v, 0) / CAST(vv AS DOUBLE), 1e-6) AS v
  FROM gr LEFT JOIN bc ON gr.feature = bc.feature AND gr.bin = bc.bin JOIN bt ON bt.feature = gr.feature),
ps AS (SELECT feature, SUM((v - t) * LN(v / t)) AS psi FROM rt GROUP BY feature)"""


@query("R1", f"""WITH {sql.B1}, {sql.split()}, {_PSI} SELECT feature, ROUND(psi, 6) AS population_stability_index FROM ps""")
def psi_by_feature(spark, folder):
    frame = split_frame(spark, folder).where("role <> 'test'")
    return rounded(drift.column_psi(frame, drift.quantile_edges(frame, SENSORS, "role", "train"), "role", "train", "validation"))


_NUMERIC = f"""ns AS (SELECT feature,
  COUNT(*) FILTER (role = 'train' AND value IS NULL) / CAST(COUNT(*) FILTER (role = 'train') AS DOUBLE) AS tm,
  COUNT(*) FILTER (role = 'validation' AND value IS NULL) / CAST(COUNT(*) FILTER (role = 'validation') AS DOUBLE) AS vm,
  AVG(value) FILTER (role = 'train') AS ta, AVG(value) FILTER (role = 'validation') AS va,
  STDDEV_POP(value) FILTER (role = 'train') AS ts, STDDEV_POP(value) FILTER (role = 'validation') AS vs,
  quantile_cont(value, 0.5) FILTER (role = 'train') AS tq, quantile_cont(value, 0.5) FILTER (role = 'validation') AS vq
  FROM ({sql.long('sp', 'role')}) GROUP BY feature),
nd AS (SELECT ns.feature, 'numeric' AS feature_type, tm AS train_missing_ratio, vm AS validation_missing_ratio,
  vm - tm AS missing_ratio_delta, ta AS train_mean, va AS validation_mean, tq AS train_median, vq AS validation_median,
  CASE WHEN SQRT((ts * ts + vs * vs) / 2) = 0 THEN NULL ELSE (va - ta) / SQRT((ts * ts + vs * vs) / 2) END
    AS standardized_mean_difference, psi AS population_stability_index,
  CAST(NULL AS DOUBLE) AS unseen_category_ratio, CAST(NULL AS DOUBLE) AS category_distribution_tvd
  FROM ns LEFT JOIN ps USING (feature))"""


def _round_report(alias=""):
    return ", ".join(c if c in ("feature", "feature_type") else f"ROUND({c}, 6) AS {c}" for c in drift.REPORT_COLUMNS)


@query("R2", f"""WITH {sql.B1}, {sql.split()}, {_PSI}, {_NUMERIC} SELECT {_round_report()} FROM nd""")
def numeric_drift(spark, folder):
    return rounded(drift.numeric_drift(split_frame(spark, folder), SENSORS, "role"))


_SEG = """cs AS (SELECT sp.*, CASE WHEN role = 'validation' AND row_id % 7 = 0 THEN 'NEW' WHEN row_id % 11 = 0 THEN NULL
  ELSE machine END AS tool FROM sp WHERE role <> 'test'),
cc AS (SELECT tool, COUNT(*) FILTER (role = 'train') AS t, COUNT(*) FILTER (role = 'validation') AS v FROM cs GROUP BY tool),
ca AS (SELECT SUM(t) AS ta, SUM(v) AS va, SUM(t) FILTER (tool IS NOT NULL) AS ts, SUM(v) FILTER (tool IS NOT NULL) AS vs,
  COALESCE(SUM(v) FILTER (tool IS NOT NULL AND t = 0), 0) AS vn FROM cc),
cd AS (SELECT 'machine' AS feature, 'categorical' AS feature_type, (ta - ts) / CAST(ta AS DOUBLE) AS train_missing_ratio,
  (va - vs) / CAST(va AS DOUBLE) AS validation_missing_ratio,
  (va - vs) / CAST(va AS DOUBLE) - (ta - ts) / CAST(ta AS DOUBLE) AS missing_ratio_delta,
  CAST(NULL AS DOUBLE) AS train_mean, CAST(NULL AS DOUBLE) AS validation_mean, CAST(NULL AS DOUBLE) AS train_median,
  CAST(NULL AS DOUBLE) AS validation_median, CAST(NULL AS DOUBLE) AS standardized_mean_difference,
  CAST(NULL AS DOUBLE) AS population_stability_index, vn / CAST(vs AS DOUBLE) AS unseen_category_ratio,
  (SELECT SUM(ABS(t / CAST(ts AS DOUBLE) - v / CAST(vs AS DOUBLE))) / 2 FROM cc WHERE tool IS NOT NULL)
    AS category_distribution_tvd FROM ca)"""


def _with_new_category(frame):
    return frame.withColumn("machine", F.when((F.col("role") == "validation") & (F.col("row_id") % 7 == 0), "NEW")
                            .when(F.col("row_id") % 11 == 0, None).otherwise(F.col("machine")))


@query("R3", f"""WITH {sql.B1}, {sql.split()}, {_SEG} SELECT {_round_report()} FROM cd""")
def categorical_drift(spark, folder):
    return rounded(drift.categorical_drift(_with_new_category(split_frame(spark, folder)), ["machine"], "role"))


_REPORT = f"""ur AS (SELECT * FROM nd UNION ALL SELECT * FROM cd),
dr AS (SELECT *, GREATEST(ABS(missing_ratio_delta) / 0.10, ABS(standardized_mean_difference) / 0.50,
  population_stability_index / 0.25, unseen_category_ratio / 0.10, category_distribution_tvd / 0.20)
  AS drift_priority_score FROM ur),
rp AS (SELECT *, CASE WHEN drift_priority_score >= 1 THEN 'high' WHEN drift_priority_score >= 0.5 THEN 'medium'
  ELSE 'low' END AS drift_priority FROM dr)"""
_FULL_REPORT = f"{sql.B1}, {sql.split()}, {_PSI}, {_NUMERIC}, {_SEG}, {_REPORT}"


@query("R4", f"""WITH {_FULL_REPORT} SELECT {_round_report()}, ROUND(drift_priority_score, 6) AS drift_priority_score,
drift_priority FROM rp""")
def drift_report(spark, folder):
    return rounded(drift.drift_report(_with_new_category(split_frame(spark, folder)), SENSOR_PROFILE, "role"))


@query("M23 R4", f"""WITH {_FULL_REPORT} SELECT feature, ROUND(drift_priority_score, 6) AS drift_priority_score FROM rp
WHERE drift_priority_score IS NOT NULL ORDER BY drift_priority_score DESC, feature LIMIT 3""")
def top_drift_sensors(spark, folder):
    report = drift.drift_report(_with_new_category(split_frame(spark, folder)), SENSOR_PROFILE, "role")
    return rounded(report.where("drift_priority_score is not null").orderBy(
        F.desc("drift_priority_score"), "feature").limit(3).select("feature", "drift_priority_score"))


@query("R5", f"""WITH {sql.B1}, {sql.split()}, l AS (SELECT * FROM (VALUES (-1), (1)) v(x)),
t AS (SELECT COUNT(*) FILTER (role = 'train') AS ta, COUNT(*) FILTER (role = 'validation') AS va FROM sp)
SELECT CAST(x AS VARCHAR) AS label, COUNT(*) FILTER (role = 'train' AND sp.label = x) AS train_count,
COUNT(*) FILTER (role = 'validation' AND sp.label = x) AS validation_count,
ROUND(COUNT(*) FILTER (role = 'train' AND sp.label = x) / CAST(MAX(ta) AS DOUBLE), 6) AS train_ratio,
ROUND(COUNT(*) FILTER (role = 'validation' AND sp.label = x) / CAST(MAX(va) AS DOUBLE), 6) AS validation_ratio,
ROUND(COUNT(*) FILTER (role = 'validation' AND sp.label = x) / CAST(MAX(va) AS DOUBLE)
 - COUNT(*) FILTER (role = 'train' AND sp.label = x) / CAST(MAX(ta) AS DOUBLE), 6) AS ratio_delta
FROM sp, l, t GROUP BY x""")
def label_drift(spark, folder):
    return rounded(drift.label_drift(split_frame(spark, folder), SENSOR_PROFILE, "role"))


@query("R6", f"""WITH {_FULL_REPORT} SELECT feature, ROUND(drift_priority_score, 6) AS drift_priority_score,
drift_priority, feature IN ('sensor_0', 'sensor_2') AS selected FROM rp""")
def selected_sensor_drift(spark, folder):
    report = drift.drift_report(_with_new_category(split_frame(spark, folder)), SENSOR_PROFILE, "role")
    chosen = report.where(F.col("feature").isin("sensor_0", "sensor_2")).select("feature")
    return rounded(drift.flag_selected(report, chosen).select(
        "feature", "drift_priority_score", "drift_priority", "selected"))


@query("R6", f"""WITH {sql.B1}, {sql.split()}, lm AS ({sql.long('sp', "role, strftime(ts, '%Y-%m') AS month, label",
       SENSORS)})
SELECT role AS split, month, feature, COUNT(*) AS row_count, COUNT(value) AS observed_count,
ROUND(COUNT(*) FILTER (value IS NULL) / CAST(COUNT(*) AS DOUBLE), 6) AS missing_ratio, ROUND(AVG(value), 6) AS mean,
ROUND(quantile_cont(value, 0.5), 6) AS median, COUNT(*) FILTER (label = 1) AS failure_count,
ROUND(COUNT(*) FILTER (label = 1) / CAST(COUNT(*) AS DOUBLE), 6) AS failure_ratio
FROM lm WHERE role <> 'test' GROUP BY role, month, feature""")
def monthly_sensor_statistics(spark, folder):
    frame = split_frame(spark, folder).where("role <> 'test'")
    return rounded(drift.monthly_statistics(frame, SENSOR_PROFILE, "role", SENSORS))


@query("R7", f"""WITH {sql.B1}, {sql.split()} SELECT feature, role AS split, COUNT(*) AS row_count,
COUNT(value) AS observed_count, ROUND(COUNT(*) FILTER (value IS NULL) / CAST(COUNT(*) AS DOUBLE), 6) AS missing_ratio,
ROUND(MIN(value), 6) AS minimum, ROUND(MAX(value), 6) AS maximum, ROUND(STDDEV_POP(value), 6) AS std_pop,
ROUND(quantile_cont(value, 0.1), 6) AS p10, ROUND(quantile_cont(value, 0.5), 6) AS median,
ROUND(quantile_cont(value, 0.9), 6) AS p90 FROM ({sql.long('sp', 'role')}) GROUP BY feature, role""")
def sensor_detail(spark, folder):
    return rounded(drift.detail_summary(split_frame(spark, folder), SENSORS, "role"))


@query("R8 T2", f"""WITH {sql.B1}, {sql.blocks('b1', 3)}, lb AS ({sql.long('bl', 'block, label')}),
pp AS (SELECT CAST(block AS VARCHAR) AS period, * FROM lb UNION ALL SELECT 'all', * FROM lb)
SELECT period, label AS "class", feature, COUNT(*) AS row_count, COUNT(value) AS observed_count,
ROUND(COUNT(*) FILTER (value IS NULL) / CAST(COUNT(*) AS DOUBLE), 6) AS missing_ratio,
ROUND(quantile_cont(value, 0.5), 6) AS median, ROUND(quantile_cont(value, 0.1), 6) AS p10,
ROUND(quantile_cont(value, 0.9), 6) AS p90 FROM pp GROUP BY period, label, feature""")
def class_period_distribution(spark, folder):
    blocked = time_blocks(sensor_frame(spark, folder), NUMERIC_PROFILE, 3)
    return rounded(distribution.class_period_distribution(blocked, NUMERIC_PROFILE, SENSORS))


@query("R9", f"""WITH {sql.B2}, c AS (SELECT label, score, COUNT(*) AS n FROM b2 GROUP BY label, score)
SELECT label, ROUND(score, 6) AS score, CAST(SUM(n) OVER w AS BIGINT) AS upto,
ROUND(SUM(n) OVER w / CAST(SUM(n) OVER (PARTITION BY label) AS DOUBLE), 6) AS share
FROM c WINDOW w AS (PARTITION BY label ORDER BY score)""")
def score_ecdf(spark, folder):
    return rounded(distribution.ecdf(score_frame(spark, folder), "score", ["label"]))


@query("R10", """WITH s AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events),
b AS (SELECT event_type, LEAST(CAST(FLOOR((value - lo) / ((hi - lo) / 50)) AS INTEGER), 49) AS bin, lo, hi FROM events, s)
SELECT event_type, bin, ROUND(lo + bin * ((hi - lo) / 50), 6) AS low, ROUND(lo + (bin + 1) * ((hi - lo) / 50), 6) AS high,
COUNT(*) AS rows FROM b GROUP BY event_type, bin, lo, hi""")
def value_histogram(spark, folder):
    return rounded(distribution.histogram(
        spark.read.parquet(f"{folder}/events.parquet"), "value", 50, keys=["event_type"]))


@query("R10", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
 quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, COUNT(value) AS observed, ROUND(MAX(q1), 6) AS q1, ROUND(MAX(med), 6) AS median,
ROUND(MAX(q3), 6) AS q3, ROUND(MIN(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
ROUND(MAX(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
FROM events JOIN q USING (event_type) GROUP BY event_type""")
def box_statistics(spark, folder):
    return rounded(distribution.box_statistics(
        spark.read.parquet(f"{folder}/events.parquet"), "value", ["event_type"]))


@query("R13", """SELECT event_id, value FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 5000""")
def display_sample(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "value")
    return distribution.display_sample(events, ["event_id"])


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]


def _corr_sql(key):
    part = f"PARTITION BY {key}" if key else ""
    group = f"GROUP BY {key}" if key else ""
    head = f"{key}, " if key else ""
    ranks = ", ".join(
        f"RANK() OVER ({part} ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {head}{c}) - 1) / 2.0 AS r_{c}"
        for c in _CORR_COLS)
    cells = " UNION ALL ".join(
        f"""SELECT {head}COUNT(*) AS rows, '{m}' AS method, '{a}' AS first, '{b}' AS second,
        ROUND(CORR({p}{a}, {p}{b}), 6) AS correlation FROM rk {group}"""
        for m, p in (("pearson", ""), ("spearman", "r_")) for a, b in _PAIRS)
    return f"WITH rk AS (SELECT *, {ranks} FROM lineitem) {cells}"


@query("R11", _corr_sql(""))
def correlation_matrix(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return rounded(distribution.correlations(lines, _CORR_COLS))


@query("R12", _corr_sql("l_returnflag"))
def correlation_by_class(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return rounded(distribution.correlations(lines, _CORR_COLS, ["l_returnflag"]))


@query("R1 R7", f"""WITH {sql.B1} SELECT feature, ROUND(quantile_cont(value, 0.05), 6) AS p05,
ROUND(quantile_cont(value, 0.95), 6) AS p95 FROM ({sql.long('b1', 'row_id')}) GROUP BY feature""")
def exact_sensor_quantiles(spark, folder):
    q = column_quantiles(sensor_frame(spark, folder), SENSORS, [0.05, 0.95])
    return rounded(q.select("feature", F.get("quantiles", F.lit(0)).alias("p05"),
                            F.get("quantiles", F.lit(1)).alias("p95")))
