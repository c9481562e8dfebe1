"""Queries of the general training-data problems (6: intervals, 7: orphan references) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noetia.operators import intervals, orphans
from noetia.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.relationship_gaps(table(spark, d, "relationships"))


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.relationship_periods(table(spark, d, "relationships"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.relationship_orphans(table(spark, d, "relationships"), table(spark, d, "entities"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("relationship_id", "ref_field")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d)).withColumn("n_orphans", F.col("n_orphans").cast("bigint"))


QUERIES = {"p6_found": p6_found, "p6_periods": p6_periods, "p7_found": p7_found, "p7_report": p7_report}

_T = "trim({}, E' \\t\\n\\r\\x0b\\x0c')"
_P6 = f"""
WITH r AS (
  SELECT nullif(lower({_T.format('source_id')}), '') AS source_id, lower({_T.format('relation_type')}) AS relation_type,
         coalesce(epoch_us(valid_from), -4611686018427387904) AS s, coalesce(epoch_us(valid_until), 4611686018427387904) AS e
  FROM relationships),
m AS (
  SELECT *, max(e) OVER (PARTITION BY source_id, relation_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM r WHERE source_id IS NOT NULL AND s <= e)
"""
_P7 = f"""
WITH e AS (
  SELECT DISTINCT ON (id) * FROM (
    SELECT lower({_T.format('id')}) AS id, lower({_T.format('memory_id')}) AS memory_id, upper(trim(state)) AS state, created_at FROM entities)),
r AS (
  SELECT DISTINCT ON (id) * FROM (
    SELECT lower({_T.format('id')}) AS id, lower({_T.format('memory_id')}) AS memory_id, created_at,
           nullif(lower({_T.format('source_id')}), '') AS s, nullif(lower({_T.format('target_id')}), '') AS t FROM relationships)),
x AS (
  SELECT id, memory_id, created_at, 'source_id' AS ref_field, s AS target FROM r WHERE s IS NOT NULL
  UNION ALL SELECT id, memory_id, created_at, 'target_id', t FROM r WHERE t IS NOT NULL),
o AS (
  SELECT x.id AS relationship_id, x.ref_field, x.created_at,
         CASE WHEN e.id IS NULL THEN 'missing' WHEN e.state = 'DELETED' THEN 'deleted'
              WHEN e.memory_id <> x.memory_id THEN 'other_memory' WHEN e.created_at > x.created_at THEN 'created_later' END AS reason
  FROM x LEFT JOIN e ON e.id = x.target)
"""
SQL = {
    "p6_found": _P6 + "SELECT source_id, relation_type, CAST(floor(before / 1e6) AS BIGINT) AS gap_from, CAST(floor(s / 1e6) AS BIGINT) AS gap_until FROM m WHERE s - before > 1000000",
    "p6_periods": _P6
    + """, i AS (SELECT *, sum(CASE WHEN before IS NULL OR s - before > 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, relation_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT source_id, relation_type, CAST(floor(nullif(min(s), -4611686018427387904) / 1e6) AS BIGINT) AS period_from,
       CAST(floor(nullif(max(e), 4611686018427387904) / 1e6) AS BIGINT) AS period_until FROM i GROUP BY source_id, relation_type, island""",
    "p7_found": _P7 + "SELECT relationship_id, ref_field FROM o WHERE reason IS NOT NULL",
    "p7_report": _P7 + "SELECT ref_field, strftime(timezone('UTC', created_at), '%Y-%m') AS month, reason, count(*) AS n_orphans FROM o WHERE reason IS NOT NULL GROUP BY ALL",
}
