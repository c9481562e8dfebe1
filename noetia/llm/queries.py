"""Queries pN_... of the problems solved in this package, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noetia.llm import chunk_split, density, knn, mixing, names, stuffing, survivors, tokens
from noetia.session import cut, table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunk_split.split_chunks(table(spark, d, "chunks"), table(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return chunk_split.oversized_chunks(p1_pieces(spark, d))


def p1_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Of every chunk that was cut: whether its pieces keep the limit, and the hash of the text they give together."""
    return chunk_split.rejoined(p1_pieces(spark, d))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar entities of every entity, lone ones too."""
    near = knn.most_similar(table(spark, d, "entities"), wide=True)
    return near.select(F.col("id").alias("entity_id"), "neighbour", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("int").alias("rank"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.similar_pairs(knn.most_similar(table(spark, d, "entities"), min_cosine=0.85), 0.85)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(table(spark, d, "entities"), table(spark, d, "nicknames"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each person or organisation by id with the class of its entity, and how many other ids are linked to it."""
    return names.classes_of_ids(table(spark, d, "entities"), table(spark, d, "nicknames"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.field_winners(table(spark, d, "entities"))


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    s = survivors.survivors(table(spark, d, "entities"))
    return s.withColumn("accessed_us", F.unix_micros("accessed_at")).drop("accessed_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return density.density_clusters(table(spark, d, "entities")).select("cluster_id", "entity_id")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "entities")
    return density.describe_clusters(entities, cut(density.density_clusters(entities)))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The hash of what the ids of each text decode to, and whether it has none."""
    return tokens.round_trip(table(spark, d, "documents")).select("doc_id", "text_hash", (F.col("n_tokens") == 0).alias("no_tokens"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_labels(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.label_pages(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(p10_labels(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rejoined": p1_rejoined,
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_survivors": p4_survivors,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_labels": p10_labels,
}

_T = "trim({}, E' \\t\\n\\r\\x0b\\x0c')"
_V = f"""
WITH v AS (
  SELECT DISTINCT ON (id) id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM (
    SELECT lower({_T.format('id')}) AS id, embedding FROM entities)
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id)
"""
_LETTERS = "trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}]+', ' ', 'g'))"
_FLAT = "trim(regexp_replace(description, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"
_P4 = f"""
WITH r AS (
  SELECT memory_id, entity_type, canonical_name, lower({_T.format('id')}) AS entity_id, description, importance, access_count, accessed_at, created_at,
         {_LETTERS.format('description')} AS d, {_LETTERS.format('name')} AS n, {_LETTERS.format('entity_type')} AS t FROM entities),
empty AS (
  SELECT d FROM (SELECT d, t, count(*) AS n, min(canonical_name) AS lo, max(canonical_name) AS hi FROM r WHERE d <> '' GROUP BY d, t)
  GROUP BY d HAVING count(*) > 1 AND min(lo) <> max(hi) AND max(n) <= 0.8 * sum(n)),
g AS (SELECT memory_id, entity_type, canonical_name, min(entity_id) AS group_id FROM r GROUP BY ALL HAVING count(DISTINCT entity_id) > 1),
x AS (
  SELECT *, 'description' AS field_name, CAST(length({_FLAT}) AS BIGINT) AS v FROM r
    WHERE d NOT IN ('', n, t, n || ' ' || t, t || ' ' || n) AND NOT regexp_matches(d, '^x+$')
      AND d NOT IN ('todo', 'tbd', 'tba', 'n a', 'na', 'none', 'null', 'nil', 'unknown', 'no description', 'description pending', 'unbekannt', 'keine beschreibung', 'beschreibung folgt', 'inconnu', 'sans description', 'desconocido', 'sin descripción') AND d NOT IN (SELECT d FROM empty)
  UNION ALL SELECT *, 'importance', CAST(importance AS BIGINT) FROM r WHERE importance IN (0, 1, 3, 5, 6, 8, 10)
  UNION ALL SELECT *, 'accessed_at', epoch_us(accessed_at) FROM r
    WHERE accessed_at BETWEEN TIMESTAMPTZ '2000-01-01 00:00:00+00' AND TIMESTAMPTZ '2024-01-31 00:00:00+00' AND (created_at IS NULL OR accessed_at >= created_at)
  UNION ALL SELECT *, 'access_count', access_count FROM r WHERE access_count BETWEEN 0 AND 999999)
SELECT group_id, field_name, entity_id FROM x JOIN g USING (memory_id, entity_type, canonical_name)
QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY v DESC, entity_id) = 1
"""
_P4_FIELDS = ("description", "importance", "accessed_at", "access_count")
_P4_ALL = (
    _P4.replace("SELECT group_id, field_name, entity_id FROM x JOIN g", ", w AS (SELECT group_id, field_name, entity_id, x.description, x.importance, x.accessed_at, x.access_count FROM x JOIN g")
    + f"""),
u AS (SELECT memory_id, entity_type, canonical_name, entity_id, {', '.join(f"max(CASE WHEN field_name = '{f}' THEN v END) AS {f}" for f in _P4_FIELDS)} FROM (SELECT DISTINCT memory_id, entity_type, canonical_name, entity_id, field_name, v FROM x) GROUP BY ALL),
o AS (SELECT DISTINCT memory_id, entity_type, canonical_name, entity_id FROM r),
b AS (SELECT g.group_id, o.memory_id, o.entity_type, o.canonical_name, o.entity_id AS base_id, count(*) OVER (PARTITION BY g.group_id) AS n_records FROM o JOIN g USING (memory_id, entity_type, canonical_name) LEFT JOIN u USING (memory_id, entity_type, canonical_name, entity_id)
  QUALIFY row_number() OVER (PARTITION BY g.group_id ORDER BY (CASE WHEN u.description IS NULL THEN 0 ELSE 1 END + CASE WHEN u.importance IS NULL THEN 0 ELSE 1 END + CASE WHEN u.accessed_at IS NULL THEN 0 ELSE 1 END + CASE WHEN u.access_count IS NULL THEN 0 ELSE 1 END) DESC, u.importance DESC NULLS LAST, u.accessed_at DESC NULLS LAST, o.entity_id) = 1),
f AS (SELECT group_id, {', '.join(f"max(CASE WHEN field_name = '{f}' THEN entity_id END) AS {f}_from" for f in _P4_FIELDS)}, max(CASE WHEN field_name = 'description' THEN {_FLAT} END) AS description, max(CASE WHEN field_name = 'importance' THEN importance END) AS importance,
  epoch_us(max(CASE WHEN field_name = 'accessed_at' THEN accessed_at END)) AS accessed_us, max(CASE WHEN field_name = 'access_count' THEN access_count END) AS access_count FROM w GROUP BY group_id)
SELECT b.*, f.* EXCLUDE (group_id) FROM b LEFT JOIN f USING (group_id)"""
)
SQL = {
    "p1_found": "SELECT DISTINCT lower(" + _T.format("id") + ") AS chunk_id FROM chunks WHERE octet_length(encode(trim(content, E' \\t\\n\\r'))) > 1000",
    "p1_rejoined": "SELECT lower(" + _T.format("id") + ") AS chunk_id, true AS within_limit, md5(trim(arg_max(content, octet_length(encode(content))), E' \\t\\n\\r')) AS text_hash FROM chunks WHERE octet_length(encode(trim(content, E' \\t\\n\\r'))) > 1000 GROUP BY 1",
    "p2_found": _V
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM p WHERE c >= 0.85)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM n WHERE r <= 5""",
    "p4_found": _P4,
    "p4_survivors": _P4_ALL,
    "p8_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS text_hash, coalesce(text, '') = '' AS no_tokens FROM documents",
    "p5_found": _V
    + """, s AS (SELECT a, least(a, min(b)) AS cluster_id, count(*) AS n FROM p WHERE c >= 0.85 GROUP BY a)
SELECT cluster_id, a AS entity_id FROM s WHERE n >= 2""",
}
