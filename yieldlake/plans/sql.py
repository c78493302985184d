"""SQL fragments that derive the same frames as ``sources.tables`` for the comparison queries."""

from __future__ import annotations

FEATURES = ["sensor_0", "sensor_1", "sensor_2", "sensor_3", "sensor_4", "sensor_5"]

B1 = """b1 AS (
  SELECT o_orderkey AS row_id, o_orderdate AS ts, o_custkey AS grp,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE -1 END AS label,
         o_totalprice AS sensor_0, c_acctbal AS sensor_1,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 1000 END AS sensor_2,
         CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE c_acctbal END AS sensor_3,
         CAST(1.0 AS DOUBLE) AS sensor_4,
         CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS sensor_5,
         c_mktsegment AS machine
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

B2 = B1 + """, b2 AS (
  SELECT b1.*, ((row_id * 7919) % 1000) / CAST(1000.0 AS DOUBLE) AS score, row_id % 5 AS fold FROM b1)"""


def long(source: str, keep: str, features: list[str] | None = None) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {source}"
        for f in (features or FEATURES))


def split(source: str = "b1", name: str = "sp") -> str:
    """Role per row of a 70/15/15 time split whose moved cuts are safe."""
    return f"""tb AS (
  SELECT ts, SUM(COUNT(*)) OVER (ORDER BY ts) AS b FROM {source} GROUP BY ts),
tg AS (SELECT COUNT(*) AS n,
  GREATEST(1, LEAST(CAST(FLOOR(COUNT(*) * CAST(0.7 AS DOUBLE)) AS BIGINT), COUNT(*) - 2)) AS t1,
  CAST(FLOOR(COUNT(*) * CAST(0.85 AS DOUBLE)) AS BIGINT) AS t2 FROM {source}),
ct AS (SELECT MIN(CASE WHEN b >= t1 THEN ts END) AS c1, MIN(CASE WHEN b >= t2 THEN ts END) AS c2 FROM tb, tg),
{name} AS (SELECT s.*, CASE WHEN ts <= c1 THEN 'train' WHEN ts <= c2 THEN 'validation' ELSE 'test' END AS role
  FROM {source} s, ct)"""


def blocks(source: str, k: int, name: str = "bl") -> str:
    """Time block 0..k per row: m // (k + 1) distinct times per evaluated block."""
    return f"""rk AS (SELECT ts, ROW_NUMBER() OVER (ORDER BY ts) AS r, COUNT(*) OVER () AS m
  FROM (SELECT DISTINCT ts FROM {source})),
{name} AS (SELECT s.*, CASE WHEN r <= m - {k} * (m // {k + 1}) THEN 0
  ELSE (r - 1 - (m - {k} * (m // {k + 1}))) // (m // {k + 1}) + 1 END AS block
  FROM {source} s JOIN rk USING (ts))"""


def curve(source: str, keys: str, score: str = "score") -> str:
    return f"""sg AS (SELECT {keys}, {score} AS score, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS pos
  FROM {source} GROUP BY {keys}, {score}),
cv AS (SELECT *, SUM(n) OVER w AS cn, SUM(pos) OVER w AS cp FROM sg
  WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC))"""


def metrics(keys: str, threshold: str) -> str:
    """Metric record per key from the ``cv`` curve."""
    return f"""mm AS (SELECT {keys}, SUM(n) AS nn, SUM(pos) AS p,
   COALESCE(SUM(pos) FILTER (score >= {threshold}), 0) AS tp,
   COALESCE(SUM(n - pos) FILTER (score >= {threshold}), 0) AS fp,
   SUM(pos * cp / CAST(cn AS DOUBLE)) AS ap, SUM((n - pos) * (cp - pos / 2.0)) AS auc
   FROM cv GROUP BY {keys}),
mr AS (SELECT {keys}, CAST(nn AS BIGINT) AS support, CAST(p AS BIGINT) AS positive_support,
   ROUND(tp / CAST(p AS DOUBLE), 6) AS recall,
   ROUND(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
   ROUND(CASE WHEN 2 * tp + fp + (p - tp) = 0 THEN 0 ELSE 2 * tp / CAST(tp + fp + p AS DOUBLE) END, 6) AS f1,
   ROUND(ap / p, 6) AS average_precision,
   ROUND(CAST(auc AS DOUBLE) / (CAST(p AS DOUBLE) * (nn - p)), 6) AS roc_auc,
   CAST(nn - p - fp AS BIGINT) AS true_negative, CAST(fp AS BIGINT) AS false_positive,
   CAST(p - tp AS BIGINT) AS false_negative, CAST(tp AS BIGINT) AS true_positive,
   ROUND((tp + fp) / CAST(nn AS DOUBLE), 6) AS reinspection_ratio FROM mm)"""


def thresholds(source: str, keys: str, score: str = "score") -> str:
    """Threshold table ``tt`` at 101 score quantiles and 0.5 per key, by a direct count per candidate."""
    return f"""qq AS (SELECT {keys}, UNNEST(list_concat(quantile_cont({score}, {[i / 100 for i in range(101)]}), [0.5]))
   AS threshold FROM {source} GROUP BY {keys}),
cd AS (SELECT DISTINCT {keys}, threshold FROM qq),
tc AS (SELECT {keys}, threshold, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS p,
   COUNT(*) FILTER ({score} >= threshold) AS flagged,
   COUNT(*) FILTER ({score} >= threshold AND label = 1) AS tp
   FROM {source} JOIN cd USING ({keys}) GROUP BY {keys}, threshold),
tt AS (SELECT {keys}, threshold, n AS support, p AS positive_support, tp AS true_positive,
   flagged - tp AS false_positive, p - tp AS false_negative, n - p - flagged + tp AS true_negative,
   tp / CAST(p AS DOUBLE) AS recall,
   CASE WHEN flagged = 0 THEN 0 ELSE tp / CAST(flagged AS DOUBLE) END AS precision,
   CASE WHEN flagged + p = 0 THEN 0 ELSE 2 * tp / CAST(flagged + p AS DOUBLE) END AS f1,
   flagged / CAST(n AS DOUBLE) AS reinspection_ratio FROM tc)"""
