"""Clean views of the test tables, for Spark and as SQL text. ``AS_OF`` stands for the current time everywhere."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noetia.operators.retrieve import MemoryQuery
from noetia.session import BLANKS, norm_id, table

AS_OF = "2024-01-31 00:00:00"
NOW_SQL = f"TIMESTAMPTZ '{AS_OF}+00'"


def now():
    return F.lit(AS_OF).cast("timestamp")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Entities once each: ids normalised, blank users empty."""
    e = table(spark, d, "entities")
    user = F.coalesce(F.btrim("user_id", F.lit(BLANKS)), F.lit(""))
    return e.withColumns({"id": norm_id("id"), "memory_id": norm_id("memory_id"), "user_id": user}).where("id is not null").dropDuplicates(["id"])


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Relationships once each, the latest delivery: ids and relation types normalised, blank states ACTIVE."""
    r = table(spark, d, "relationships")
    state = F.when(F.trim("state") == "", F.lit("ACTIVE")).otherwise(F.col("state"))
    r = r.withColumns({"id": norm_id("id"), "memory_id": norm_id("memory_id"), "source_id": norm_id("source_id"), "target_id": norm_id("target_id"), "relation_type": F.lower(F.btrim("relation_type", F.lit(BLANKS))), "state": state})
    r = r.where("id is not null")
    return r.groupBy("id").agg(F.max_by(F.struct(*[c for c in r.columns if c != "id"]), F.struct(F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp")), F.coalesce("access_count", F.lit(-1)))).alias("x")).select("id", "x.*")


def linked(spark: SparkSession, d: str) -> DataFrame:
    """Edges with both ends known."""
    return edges(spark, d).where("source_id is not null and target_id is not null")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clusters").withColumns({"id": norm_id("id"), "memory_id": norm_id("memory_id")}).dropDuplicates(["id"])


def vector(seed: int, dim: int = 64) -> tuple[float, ...]:
    """A fixed vector of three decimals."""
    return tuple(round(math.sin(seed * 12.9898 + i * (7.233 + seed)), 3) for i in range(dim))


TEXTS = (
    "Who founded Nuraive Logistics?",
    "interviews about query latency",
    "Sebastian Kubinaisi and the audit trail",
    "Which supplier contracts ran out?",
    "Project Skarduporgru",
    "the memory graph in Mesubra",
)
QUERIES = [MemoryQuery(i, t, vector(i + 1)) for i, t in enumerate(TEXTS)]

_T = "trim({}, E' \\t\\n\\r\\x0b\\x0c')"
NODES = f"""nodes AS MATERIALIZED (
  SELECT DISTINCT ON (id) * REPLACE (lower({_T.format('id')}) AS id, lower({_T.format('memory_id')}) AS memory_id, coalesce({_T.format('user_id')}, '') AS user_id) FROM entities)"""
EDGES = f"""edges AS MATERIALIZED (
  SELECT * FROM (SELECT * REPLACE (lower({_T.format('id')}) AS id, lower({_T.format('memory_id')}) AS memory_id, nullif(lower({_T.format('source_id')}), '') AS source_id,
           nullif(lower({_T.format('target_id')}), '') AS target_id, lower({_T.format('relation_type')}) AS relation_type, CASE WHEN trim(state) = '' THEN 'ACTIVE' ELSE state END AS state) FROM relationships)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, coalesce(access_count, -1) DESC) = 1)"""
LINKED = "linked AS MATERIALIZED (SELECT * FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"
CLUSTERS = f"cl AS (SELECT DISTINCT ON (id) * REPLACE (lower({_T.format('id')}) AS id, lower({_T.format('memory_id')}) AS memory_id) FROM clusters)"


def _lit(v: tuple[float, ...]) -> str:
    return "[" + ",".join(f"CAST({x} AS FLOAT)" for x in v) + "]"


QUESTIONS = "questions AS (" + " UNION ALL ".join(f"SELECT {q.query_id} AS query_id, '{q.query}' AS query, {_lit(q.embedding)} AS q_embedding" for q in QUERIES) + ")"
COSINE = """CASE WHEN len({a}) > 0 AND len({a}) = len({b}) THEN coalesce(
  CASE WHEN list_dot_product(list_transform({a}, lambda x: CAST(x AS DOUBLE)), list_transform({a}, lambda x: CAST(x AS DOUBLE))) > 0 AND list_dot_product(list_transform({b}, lambda x: CAST(x AS DOUBLE)), list_transform({b}, lambda x: CAST(x AS DOUBLE))) > 0
  THEN list_dot_product(list_transform({a}, lambda x: CAST(x AS DOUBLE)), list_transform({b}, lambda x: CAST(x AS DOUBLE)))
     / sqrt(list_dot_product(list_transform({a}, lambda x: CAST(x AS DOUBLE)), list_transform({a}, lambda x: CAST(x AS DOUBLE)))) / sqrt(list_dot_product(list_transform({b}, lambda x: CAST(x AS DOUBLE)), list_transform({b}, lambda x: CAST(x AS DOUBLE)))) END, 0) ELSE 0 END"""
