"""Queries over the graph tables: ids, scalars, filters, joins, aggregations, ranking, evolution, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from noetia.functions import expr as X
from noetia.operators import evolve, graph, rank, retrieve
from noetia.plans import views as V
from noetia.session import cut, table
from noetia.sources import stores

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def W(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + "\n"


N, E, L, C, Q = V.NODES, V.EDGES, V.LINKED, V.CLUSTERS, V.QUESTIONS
NOW = V.NOW_SQL
BUCKET = "CASE WHEN {s} >= 9 THEN 10 WHEN {s} >= 7 THEN 8 WHEN {s} >= 5.5 THEN 6 WHEN {s} >= 4 THEN 5 WHEN {s} >= 2 THEN 3 WHEN {s} >= 0.5 THEN 1 ELSE 0 END"
LABEL = "CASE {c} WHEN 0 THEN 'EPHEMERAL' WHEN 1 THEN 'VERY_LOW' WHEN 3 THEN 'LOW' WHEN 5 THEN 'MEDIUM' WHEN 6 THEN 'HIGH' WHEN 8 THEN 'VERY_HIGH' WHEN 10 THEN 'CRITICAL' ELSE 'UNKNOWN' END"
AGE = f"((epoch_us({NOW}) - epoch_us({{t}})) / 86400000000.0)"
CLEAN = "trim(regexp_replace({c}, '\\s+', ' ', 'g'), ' \"''')"


# -- ids and scalars -------------------------------------------------------------------------------------------------------
@query(W(N) + "SELECT id, substr(sha256(coalesce(name,'')||':'||coalesce(entity_type,'')||':'||coalesce(user_id,'')||':'||coalesce(memory_id,'')),1,32) AS node_id FROM nodes")
def node_ids(s, d):
    return V.nodes(s, d).select("id", X.node_id().alias("node_id"))


@query(W(E) + "SELECT id, substr(sha256(coalesce(source_id,'')||':'||coalesce(target_id,'')||':'||coalesce(relation_type,'')||':'||coalesce(memory_id,'')),1,32) AS edge_id FROM edges")
def edge_ids(s, d):
    return V.edges(s, d).select("id", X.edge_id().alias("edge_id"))


@query(W(N) + f"SELECT id, {CLEAN.format(c='name')} AS clean_name, substr(sha256(lower({CLEAN.format(c='name')})),1,32) AS resolver_key FROM nodes")
def resolver_keys(s, d):
    return V.nodes(s, d).select("id", X.clean_name("name").alias("clean_name"), X.resolver_key().alias("resolver_key"))


@query(W(E) + f"SELECT id, {BUCKET.format(s='(weight * 10)')} AS bucket, {LABEL.format(c=BUCKET.format(s='(weight * 10)'))} AS label FROM edges WHERE weight IS NOT NULL")
def importance_bucket(s, d):
    b = X.importance_bucket(F.col("weight") * 10)
    return V.edges(s, d).where("weight is not null").select("id", b.alias("bucket"), X.importance_label(b).alias("label"))


_TOK = "list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')), lambda x: x NOT IN ('the','a','an','of','and','inc','ltd','llc','corp','co','company','limited','corporation'))"


@query(W(N) + f""", t AS (SELECT id, {_TOK.format(c="name")} AS a, {_TOK.format(c="coalesce(aliases[len(aliases)], '')")} AS b FROM nodes)
SELECT id, array_to_string(list_sort(a), ' ') AS tokens, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) ELSE 0.0 END AS similarity FROM t""")
def tokenize_jaccard(s, d):
    last = F.coalesce(F.try_element_at(F.col("aliases"), F.lit(-1)), F.lit(""))
    n = V.nodes(s, d).select("id", X.entity_tokens("name").alias("a"), X.entity_tokens(last).alias("b"))
    return n.select("id", F.array_join(F.array_sort("a"), " ").alias("tokens"), F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(W(N) + """, t AS (SELECT id, list_filter(list_distinct(regexp_extract_all(lower(name), '\\b[a-z]{2,}\\b')), lambda x: x NOT IN ('the','dr','mr','ms','mrs','prof','professor','inc','corp','llc')) AS a,
  list_transform(regexp_extract_all(name, '[A-Za-z]{2,}'), lambda x: lower(x)) AS w FROM nodes)
SELECT id, array_to_string(list_sort(a), ' ') AS tokens, coalesce(list_filter(w, lambda x: x NOT IN ('dr','mr','ms','mrs','prof','professor','jr','sr','phd','md','the'))[-1], w[-1]) AS last_name FROM t""")
def consolidation_tokens(s, d):
    return V.nodes(s, d).select("id", F.array_join(F.array_sort(X.consolidation_tokens("name")), " ").alias("tokens"), X.last_name("name").alias("last_name"))


def _lcs_sql(pairs: str) -> str:
    """CTEs that end in ``lcs``: the rows of ``pairs(k, a, b)`` with their ratio; the table's rows one after the other."""
    cell = "greatest(row[j], CASE WHEN y[j] = x[i + 1] THEN CASE WHEN j > 1 THEN row[j - 1] ELSE 0 END + 1 ELSE 0 END)"
    return f"""lp AS (SELECT k, lower(a) = lower(b) AS same, regexp_extract_all(hex(encode(lower(a))), '..') AS x, regexp_extract_all(hex(encode(lower(b))), '..') AS y FROM ({pairs})),
lr AS (SELECT k, x, y, 0 AS i, list_transform(y, lambda c: 0) AS row FROM lp
  UNION ALL SELECT k, x, y, i + 1, list_transform(range(1, len(y) + 1), lambda j: list_max(m[1:j])) FROM (SELECT *, list_transform(range(1, len(y) + 1), lambda j: {cell}) AS m FROM lr WHERE i < len(x))),
lcs AS (SELECT k, 2.0::DOUBLE * row[len(y)] / (len(x) + len(y)) AS ratio FROM lr WHERE i = len(x) AND len(x) > 0 AND len(y) > 0)"""


@query(W(N, _lcs_sql("SELECT DISTINCT {'id': id, 'alias': alias, 'name': name} AS k, name AS a, alias AS b FROM (SELECT id, name, unnest(aliases) AS alias FROM nodes) WHERE alias <> name")) + "SELECT DISTINCT k.id AS id, k.alias AS alias, round(ratio, 6) AS similarity FROM lcs")
def name_similarity_lcs(s, d):
    n = V.nodes(s, d).select("id", "name", F.explode("aliases").alias("alias")).where("alias <> name")
    return n.select("id", "alias", F.round(evolve.name_similarity("name", "alias"), 6).alias("similarity")).distinct()


_WRITTEN = ["strftime(timezone('UTC', valid_from), '%Y-%m-%d')", "strftime(timezone('UTC', valid_from), '%Y-%m')", "strftime(timezone('UTC', valid_from), '%Y')", "strftime(timezone('UTC', valid_from), '%B %Y')", "strftime(timezone('UTC', valid_from), '%b %Y')", "'around ' || strftime(timezone('UTC', valid_from), '%Y') || ' or so'", "'present'", "'no idea'"]
_MONTHS = "['january','february','march','april','may','june','july','august','september','october','november','december']"


@query(W(E) + ", w AS (SELECT id, CASE ascii(id) % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_WRITTEN)) + f""" END AS written FROM edges WHERE valid_from IS NOT NULL),
p AS (SELECT *, lower(trim(written)) AS s FROM w)
SELECT id, written, epoch_us(CASE WHEN s IN ('', 'none', 'present') THEN NULL WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime(s, '%Y-%m-%d')
  WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}$') THEN try_strptime(s || '-01', '%Y-%m-%d')
  WHEN regexp_matches(s, '^[a-z]+ \\d{{4}}$') THEN make_timestamp(CAST(s[-4:] AS BIGINT), list_position(list_transform({_MONTHS}, lambda m: m[1:3]), s[1:3]), 1, 0, 0, 0)
  WHEN regexp_extract(s, '\\b((?:19|20)\\d{{2}})\\b', 1) <> '' THEN make_timestamp(CAST(regexp_extract(s, '\\b((?:19|20)\\d{{2}})\\b', 1) AS BIGINT), 1, 1, 0, 0, 0) END) AS parsed_us FROM p""")
def parse_dates(s, d):
    forms = ["yyyy-MM-dd", "yyyy-MM", "yyyy", "MMMM yyyy", "MMM yyyy"]
    k = F.ascii("id") % 8
    w = F.when(k == 0, F.date_format("valid_from", forms[0]))
    for i, f in enumerate(forms[1:], 1):
        w = w.when(k == i, F.date_format("valid_from", f))
    w = w.when(k == 5, F.concat(F.lit("around "), F.date_format("valid_from", "yyyy"), F.lit(" or so"))).when(k == 6, F.lit("present")).otherwise(F.lit("no idea"))
    e = V.edges(s, d).where("valid_from is not null").select("id", w.alias("written"))
    return e.select("id", "written", F.unix_micros(X.parse_date("written")).alias("parsed_us"))


_H = f"exp(-0.693 * {AGE.format(t='accessed_at')} / {{life}})"


@query(W(N) + f"""SELECT id, round({_H.format(life='30.0')}, 6) AS recency, CASE WHEN d < 1 THEN 10.0 WHEN d < 7 THEN 8.0 WHEN d < 30 THEN 5.0 WHEN d < 90 THEN 3.0 ELSE 1.0 END AS recency_steps,
  CASE WHEN coalesce(access_count, 0) <= 0 THEN 0.0 ELSE round(least(1.0, ln(1 + access_count) / ln(101)), 6) END AS frequency,
  round(exp(-0.693 * d / (30.0 * (0.5 + importance / 20.0) * least(1.0, 0.5 + ln(1 + greatest(coalesce(access_count, 0), 0)) / 10))), 4) AS strength
FROM (SELECT *, {AGE.format(t='accessed_at')} AS d FROM nodes) WHERE accessed_at IS NOT NULL""")
def node_strength(s, d):
    n = V.nodes(s, d).where("accessed_at is not null")
    return n.select("id", F.round(X.recency("accessed_at", V.now()), 6).alias("recency"), X.recency_steps("accessed_at", V.now()).alias("recency_steps"), F.round(X.frequency("access_count"), 6).alias("frequency"), F.round(X.node_strength("accessed_at", V.now(), "importance", "access_count"), 4).alias("strength"))


@query(W(E) + f"SELECT id, round(exp(-0.693 * {AGE.format(t='accessed_at')} / greatest(1.0, 30.0 * least(1.0, weight / 5.0) * confidence)), 6) AS strength FROM edges WHERE accessed_at IS NOT NULL AND weight IS NOT NULL AND confidence IS NOT NULL")
def edge_strength(s, d):
    e = V.edges(s, d).where("accessed_at is not null and weight is not null and confidence is not null")
    return e.select("id", F.round(X.edge_strength("accessed_at", V.now(), "weight", "confidence"), 6).alias("strength"))


@query(W(N) + "SELECT id, coalesce(json_extract_string(properties, '$.city'), '') AS city, coalesce(try_cast(json_extract_string(properties, '$.year') AS BIGINT), 0) AS year, coalesce(try_cast(json_extract_string(properties, '$.score') AS DOUBLE), 0.5) AS score, md5(coalesce(description, '')) AS text_hash FROM nodes")
def typed_properties(s, d):
    return V.nodes(s, d).select("id", X.json_get("properties", "city", "").alias("city"), X.json_get("properties", "year", 0).alias("year"), X.json_get("properties", "score", 0.5).alias("score"), F.md5(F.coalesce("description", F.lit(""))).alias("text_hash"))


@query(W(N) + "SELECT id, md5(name || ':' || 10 || ':0.500000:' || coalesce(entity_type, '')) AS search_key FROM nodes")
def search_keys(s, d):
    return V.nodes(s, d).select("id", X.search_key(F.col("name"), F.lit(10), F.lit(0.5), F.coalesce("entity_type", F.lit(""))).alias("search_key"))


# -- filters -----------------------------------------------------------------------------------------------------------------
@query(W(N) + "SELECT id, importance, state FROM nodes WHERE state = 'ACTIVE' AND importance >= 5 AND importance <> 0")
def active_filter(s, d):
    return V.nodes(s, d).where("state = 'ACTIVE' and importance >= 5 and importance <> 0").select("id", "importance", "state")


@query(W(N) + "SELECT id, memory_id, user_id FROM nodes WHERE user_id IS NULL OR trim(user_id) = '' OR user_id = 'u0001'")
def tenant_scope(s, d):
    return V.nodes(s, d).where(X.tenant("u0001")).select("id", "memory_id", "user_id")


@query(W(N) + "SELECT id FROM nodes WHERE lower(entity_type) = 'person' AND importance >= 3 AND state = 'ACTIVE' AND (json_extract_string(properties, '$.lang') IS NULL OR json_extract_string(properties, '$.lang') = 'en')")
def filter_map(s, d):
    return V.nodes(s, d).where(X.matches_filters({"entity_type": "PERSON", "min_importance": 3, "state": "ACTIVE", "lang": "en"})).select("id")


_AT = "TIMESTAMPTZ '2005-06-15 00:00:00+00'"


def _at():
    return F.lit("2005-06-15 00:00:00").cast("timestamp")


@query(W(E) + f"SELECT id, source_id, target_id, relation_type FROM edges WHERE (valid_from IS NULL OR valid_from <= {_AT}) AND (valid_until IS NULL OR valid_until >= {_AT}) AND lower(relation_type) = 'works_at'")
def edges_valid_at(s, d):
    return V.edges(s, d).where(X.valid_at(_at()) & (F.lower("relation_type") == "works_at")).select("id", "source_id", "target_id", "relation_type")


@query(W(E) + f"SELECT id, relation_type FROM edges WHERE (valid_from IS NULL OR valid_from <= {_AT}) AND (valid_until IS NULL OR valid_until > {_AT}) AND relation_type = 'member_of'")
def edges_valid_at_halfopen(s, d):
    return V.edges(s, d).where(X.valid_at(_at(), half_open=True) & (F.col("relation_type") == "member_of")).select("id", "relation_type")


@query(W(E) + f"SELECT id FROM edges WHERE valid_from <= {_AT} AND (valid_until IS NULL OR valid_until >= {_AT})")
def edges_valid_at_known_start(s, d):
    return V.edges(s, d).where(X.valid_at(_at(), known_start=True)).select("id")


@query(W(E) + f"SELECT id, epoch_us(CASE WHEN h THEN {NOW} ELSE valid_until END) AS valid_until_us, CASE WHEN h THEN 'ARCHIVED' ELSE state END AS state, h AS matched FROM (SELECT *, coalesce(relation_type = 'ceo_of' AND valid_until IS NULL, false) AS h FROM edges)")
def supersede(s, d):
    e = graph.supersede(V.edges(s, d), (F.col("relation_type") == "ceo_of") & F.col("valid_until").isNull(), V.now())
    return e.select("id", F.unix_micros("valid_until").alias("valid_until_us"), "state", "matched")


@query(W(N, E, C) + """SELECT 'node' AS kind, id, name AS a, entity_type AS b, CAST(importance AS VARCHAR) AS c FROM nodes
UNION ALL SELECT 'edge', id, source_id, target_id, relation_type FROM edges UNION ALL SELECT 'cluster', id, summary, CAST(coalesce(len(entities), -1) AS VARCHAR), NULL FROM cl""")
def graph_view(s, d):
    n, e, c = graph.graph_view(graph.MemoryGraph(V.nodes(s, d), V.edges(s, d), V.clusters(s, d)))
    row = lambda k, df, a, b, x: df.select(F.lit(k).alias("kind"), "id", F.col(a).alias("a"), F.col(b).cast("string").alias("b"), x.cast("string").alias("c"))
    c = c.withColumn("size", F.coalesce("size", F.lit(-1)))
    return row("node", n, "name", "type", F.col("importance")).union(row("edge", e, "source", "target", F.col("relation"))).union(row("cluster", c, "summary", "size", F.lit(None)))


@query(W(N) + """, p AS (SELECT id, unnest(json_keys(coalesce(properties, '{}'))) AS k, properties FROM nodes),
v AS (SELECT id, k, json_extract_string(properties, '$."' || k || '"') AS v FROM p WHERE k NOT IN ('source', 'year') UNION ALL SELECT id, 'source', 'import' FROM nodes UNION ALL SELECT id, 'year', '2024' FROM nodes)
SELECT id, '{' || string_agg(CAST(to_json(k) AS VARCHAR) || ':' || CAST(to_json(v) AS VARCHAR), ',' ORDER BY k) || '}' AS properties FROM v WHERE v IS NOT NULL GROUP BY id""")
def property_merge(s, d):
    return V.nodes(s, d).select("id", X.json_merge("properties", F.lit('{"source": "import", "year": "2024"}')).alias("properties"))


@query(W(N) + f"SELECT id, CASE WHEN id = m THEN 'renamed' ELSE name END AS name, CASE WHEN id = m THEN 8 ELSE importance END AS importance, epoch_us(CASE WHEN id = m THEN {NOW} ELSE updated_at END) AS updated_us FROM nodes, (SELECT min(id) AS m FROM nodes)")
def partial_update(s, d):
    g = graph.MemoryGraph(V.nodes(s, d), V.edges(s, d))
    first = g.nodes.agg(F.min("id").alias("m")).first()["m"]
    return g.update_node(first, V.now(), name="renamed", importance=8).nodes.select("id", "name", "importance", F.unix_micros("updated_at").alias("updated_us"))


# -- joins -----------------------------------------------------------------------------------------------------------------
_TOPIDS = "top AS (SELECT id FROM nodes WHERE state = 'ACTIVE' AND importance >= 8)"


@query(W(N, E, _TOPIDS) + "SELECT id, source_id, target_id FROM edges WHERE state = 'ACTIVE' AND source_id IN (SELECT id FROM top) AND target_id IN (SELECT id FROM top)")
def induced_subgraph(s, d):
    ids = V.nodes(s, d).where("state = 'ACTIVE' and importance >= 8")
    return graph.touching(V.edges(s, d).where("state = 'ACTIVE'"), ids, "both").select("id", "source_id", "target_id")


@query(W(N, E) + ", gone AS (SELECT id FROM nodes WHERE state = 'DELETED') SELECT id FROM edges WHERE (source_id IS NULL OR source_id NOT IN (SELECT id FROM gone)) AND (target_id IS NULL OR target_id NOT IN (SELECT id FROM gone))")
def cascade_delete(s, d):
    g = graph.MemoryGraph(V.nodes(s, d), V.edges(s, d))
    return g.remove_nodes(g.nodes.where("state = 'DELETED'")).edges.select("id")


_IDX = "idx AS (SELECT memory_id, lower(term) AS term, max(id) AS id FROM (SELECT memory_id, id, name AS term FROM nodes UNION ALL SELECT memory_id, id, unnest(aliases) FROM nodes) WHERE term IS NOT NULL GROUP BY ALL)"


@query(W(N, E, L, _IDX) + """, w AS (SELECT l.id, l.memory_id, l.relation_type, upper(a.name) AS s, b.name AS t FROM linked l JOIN nodes a ON a.id = l.source_id JOIN nodes b ON b.id = l.target_id)
SELECT w.relation_type, x.id AS source_id, y.id AS target_id, count(*) AS n FROM w JOIN idx x ON x.memory_id = w.memory_id AND x.term = lower(w.s) JOIN idx y ON y.memory_id = w.memory_id AND y.term = lower(w.t) GROUP BY ALL""")
def edge_resolution(s, d):
    n = V.nodes(s, d)
    a, b = n.select(F.col("id").alias("source_id"), F.upper("name").alias("sn")), n.select(F.col("id").alias("target_id"), F.col("name").alias("tn"))
    written = V.linked(s, d).join(a, "source_id").join(b, "target_id").withColumn("source_id", F.col("sn")).withColumn("target_id", F.col("tn")).drop("sn", "tn")
    return graph.resolve_endpoints(written, n).groupBy("relation_type", "source_id", "target_id").agg(F.count("*").alias("n"))


@query(W(N, E, C) + """, m AS (SELECT DISTINCT c.id AS cluster_id, n.id AS node_id FROM (SELECT id, memory_id, unnest(entities) AS name FROM cl) c JOIN nodes n ON n.memory_id = c.memory_id AND n.name = c.name),
o AS (SELECT cluster_id, target_id AS node_id FROM m JOIN edges ON source_id = node_id UNION SELECT cluster_id, source_id FROM m JOIN edges ON target_id = node_id)
SELECT cluster_id, node_id, true AS member FROM m UNION ALL (SELECT cluster_id, node_id, false FROM o WHERE node_id IN (SELECT id FROM nodes) EXCEPT SELECT cluster_id, node_id, false FROM m)""")
def community_neighbourhood(s, d):
    return graph.community_neighbourhood(V.clusters(s, d), V.nodes(s, d), V.edges(s, d))


_PATH = """, e AS (SELECT * FROM linked WHERE state = 'ACTIVE' AND confidence >= 0.7),
p AS (SELECT x.memory_id, x.source_id, x.target_id AS via_id, y.target_id, least(x.weight, y.weight) * 0.5 AS weight, x.confidence * y.confidence * 0.8 AS confidence
      FROM e x JOIN e y ON x.memory_id = y.memory_id AND x.target_id = y.source_id AND x.source_id <> y.target_id
      WHERE NOT EXISTS (SELECT 1 FROM linked h WHERE h.memory_id = x.memory_id AND h.source_id = x.source_id AND h.target_id = y.target_id)),
b AS (SELECT *, round(confidence, 9) AS k FROM p QUALIFY row_number() OVER (PARTITION BY memory_id, source_id, target_id ORDER BY k DESC, via_id, weight) = 1)
"""


@query(W(N, E, L) + _PATH + "SELECT memory_id, source_id, via_id, target_id, round(weight, 6) AS weight, round(k, 6) AS confidence FROM b QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY k DESC, source_id, target_id) <= 10")
def transitive_inference(s, d):
    t = graph.transitive_links(V.linked(s, d))
    return t.select("memory_id", "source_id", "via_id", "target_id", F.round("weight", 6).alias("weight"), F.round("confidence", 6).alias("confidence"))


@query(W(N, E, L) + "SELECT l.id FROM linked l WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.id = l.source_id AND n.memory_id = l.memory_id) AND EXISTS (SELECT 1 FROM nodes n WHERE n.id = l.target_id AND n.memory_id = l.memory_id)")
def edges_with_known_ends(s, d):
    return graph.with_known_ends(V.linked(s, d), V.nodes(s, d)).select("id")


_DUP = "m AS (SELECT id AS old_id, g AS new_id FROM (SELECT id, min(id) OVER (PARTITION BY memory_id, entity_type, canonical_name) AS g FROM nodes) WHERE id <> g)"


@query(W(N, E, _DUP) + "SELECT e.id, coalesce(a.new_id, e.source_id) AS source_id, coalesce(b.new_id, e.target_id) AS target_id FROM edges e LEFT JOIN m a ON a.old_id = e.source_id LEFT JOIN m b ON b.old_id = e.target_id")
def remap_endpoints(s, d):
    n = V.nodes(s, d)
    key = ["memory_id", "entity_type", "canonical_name"]
    first = n.groupBy(*key).agg(F.min("id").alias("new_id"))
    m = n.select("id", *key).join(first, key).where("id <> new_id").select(F.col("id").alias("old_id"), "new_id")
    return graph.remap_endpoints(V.edges(s, d), m).select("id", "source_id", "target_id")


@query("SELECT lower(trim(c.id)) AS chunk_id, d.doc_id, d.modality AS doc_modality FROM (SELECT DISTINCT ON (lower(trim(id))) * FROM chunks) c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = trim(c.source_id)")
def chunk_documents(s, d):
    c = table(s, d, "chunks").select(F.lower(F.trim("id")).alias("chunk_id"), F.trim("source_id").alias("k")).dropDuplicates(["chunk_id"])
    return c.join(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("k"), "doc_id", F.col("modality").alias("doc_modality")), "k").select("chunk_id", "doc_id", "doc_modality")


# -- aggregations ------------------------------------------------------------------------------------------------------------
@query(W(E, L) + """SELECT memory_id, source_id, target_id, relation_type, count(*) AS n, round(least(10.0, sum(weight)), 6) AS weight, round(least(1.0, avg(confidence) * 1.1), 6) AS confidence
FROM linked GROUP BY ALL HAVING count(*) > 1""")
def reinforce_edges(s, d):
    r = graph.reinforce_edges(V.linked(s, d))
    return r.select("memory_id", "source_id", "target_id", "relation_type", "n", F.round("weight", 6).alias("weight"), F.round("confidence", 6).alias("confidence"))


@query(W(N) + """, g AS (SELECT *, memory_id || '|' || entity_type || '|' || canonical_name AS grp FROM nodes)
SELECT grp, arg_min(id, (-octet_length(encode(name)), -coalesce(access_count, 0), id)) AS id, count(*) AS n_merged, CAST(sum(coalesce(access_count, 0)) AS BIGINT) AS access_count, max(importance) AS importance,
  max(octet_length(encode(description))) AS description_bytes FROM g GROUP BY grp HAVING count(*) > 1""")
def merge_nodes_agg(s, d):
    n = V.nodes(s, d).withColumn("grp", F.concat_ws("|", "memory_id", "entity_type", "canonical_name"))
    m = graph.merge_nodes(n, "grp").where("n_merged > 1")
    return m.select("grp", "id", "n_merged", "access_count", "importance", F.octet_length("description").cast("bigint").alias("description_bytes"))


@query(W(N) + f"SELECT memory_id, {LABEL.format(c='importance')} AS label, count(*) AS n_nodes FROM nodes GROUP BY ALL")
def importance_histogram(s, d):
    return graph.importance_histogram(V.nodes(s, d))


@query(W(N, E, C) + """, a AS (SELECT memory_id, count(*) AS n_nodes, count(*) FILTER (state = 'ACTIVE') AS n_active, count(*) FILTER (state = 'ARCHIVED') AS n_archived, count(*) FILTER (state = 'DELETED') AS n_deleted FROM nodes GROUP BY 1),
b AS (SELECT memory_id, count(*) AS n_edges FROM edges GROUP BY 1), c AS (SELECT memory_id, count(*) AS n_clusters FROM cl GROUP BY 1)
SELECT memory_id, coalesce(n_nodes,0) AS n_nodes, coalesce(n_active,0) AS n_active, coalesce(n_archived,0) AS n_archived, coalesce(n_deleted,0) AS n_deleted, coalesce(n_edges,0) AS n_edges, coalesce(n_clusters,0) AS n_clusters
FROM a FULL JOIN b USING (memory_id) FULL JOIN c USING (memory_id)""")
def memory_stats(s, d):
    return graph.memory_stats(V.nodes(s, d), V.edges(s, d), V.clusters(s, d))


@query(W(E) + "SELECT id, count(*) AS degree, round(least(1.0, ln(1 + count(*)) / ln(51)), 6) AS connectivity FROM (SELECT id AS eid, source_id AS id FROM edges UNION SELECT id, target_id FROM edges) WHERE id IS NOT NULL GROUP BY id")
def connectivity(s, d):
    g = graph.degrees(V.edges(s, d))
    return g.select("id", "degree", F.round(X.connectivity("degree"), 6).alias("connectivity"))


@query(W(E, L) + "SELECT source_id AS id, count(*) AS out_degree, round(sum(weight), 6) AS out_strength FROM linked GROUP BY 1")
def out_degree(s, d):
    return V.linked(s, d).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("out_degree"), F.round(F.sum("weight"), 6).alias("out_strength"))


@query("""WITH c AS (SELECT DISTINCT ON (lower(trim(id))) lower(trim(id)) AS id, trim(source_id) AS k, len(entities) AS ne, len(key_phrases) AS nr, CASE WHEN content IS NULL THEN 'no content' END AS error FROM chunks),
r AS (SELECT k, count(*) AS n_chunks, coalesce(sum(coalesce(ne, 0)), 0) AS e, coalesce(sum(coalesce(nr, 0)), 0) AS r, min(error) AS error FROM c GROUP BY k)
SELECT doc_id, coalesce(n_chunks, 0) AS n_chunks, CAST(coalesce(e, 0) AS BIGINT) AS n_entities, CAST(coalesce(r, 0) AS BIGINT) AS n_relations, coalesce(e, 0) + coalesce(r, 0) > 0 AS success, CASE WHEN coalesce(e, 0) + coalesce(r, 0) > 0 THEN NULL ELSE error END AS error
FROM documents LEFT JOIN r ON k = CAST(doc_id AS VARCHAR)""")
def ingest_rollup(s, d):
    c = table(s, d, "chunks").withColumn("id", F.lower(F.trim("id"))).dropDuplicates(["id"])
    r = c.select(F.trim("source_id").try_cast("bigint").alias("doc_id"), F.coalesce(F.array_size("entities"), F.lit(0)).cast("bigint").alias("n_entities"), F.coalesce(F.array_size("key_phrases"), F.lit(0)).cast("bigint").alias("n_relations"), F.when(F.col("content").isNull(), F.lit("no content")).alias("error"))
    return graph.ingest_rollup(table(s, d, "documents"), r)


# -- ranking -------------------------------------------------------------------------------------------------------------------
def _pr_sql(steps: int) -> str:
    out = W(N, E, L) + ", v AS MATERIALIZED (SELECT id, (SELECT count(*) FROM nodes) AS n FROM nodes), dg AS MATERIALIZED (SELECT source_id, count(*) AS deg FROM linked GROUP BY 1), ee AS MATERIALIZED (SELECT source_id, target_id, deg FROM linked JOIN dg USING (source_id)), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS pr FROM v)"
    for i in range(steps):
        out += f", r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / n + 0.85 * coalesce(x, 0) AS pr FROM v LEFT JOIN (SELECT target_id, sum(pr / deg) AS x FROM ee JOIN r{i} ON id = source_id GROUP BY 1) ON target_id = v.id)"
    return out


@query(_pr_sql(20) + " SELECT id, round(pr, 9) AS pagerank FROM r20")
def pagerank_unweighted(s, d):
    return rank.pagerank(V.nodes(s, d), V.linked(s, d)).select("id", F.round("pagerank", 9).alias("pagerank"))


def _prw_sql(steps: int) -> str:
    out = W(N, E, L) + """, v AS MATERIALIZED (SELECT id, (SELECT count(*) FROM nodes) AS n FROM nodes),
e0 AS MATERIALIZED (SELECT source_id, target_id, coalesce(weight, 1) * coalesce(confidence, 1) AS w FROM linked WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)),
ee AS MATERIALIZED (SELECT source_id, target_id, sum(CASE WHEN w = 0 THEN 1.0 ELSE w END / CASE WHEN t = 0 THEN k ELSE t END) AS share FROM e0 JOIN (SELECT source_id, sum(w) AS t, count(*) AS k FROM e0 GROUP BY 1) USING (source_id) GROUP BY 1, 2),
sk AS MATERIALIZED (SELECT id FROM v WHERE id NOT IN (SELECT source_id FROM ee)), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS pr FROM v)"""
    for i in range(steps):
        out += f", r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / n + 0.85 * (SELECT coalesce(sum(pr), 0) FROM r{i} JOIN sk USING (id)) / n + 0.85 * coalesce(x, 0) AS pr FROM v LEFT JOIN (SELECT target_id, sum(pr * share) AS x FROM ee JOIN r{i} ON id = source_id GROUP BY 1) ON target_id = v.id)"
    return out


#: Steps after which both sides agree to the digits compared (damping to the power of the steps is below them).
_STEPS = 40


@query(_prw_sql(_STEPS) + f" SELECT id, round(pr / (SELECT max(pr) FROM r{_STEPS}), 5) AS pagerank FROM r{_STEPS}")
def pagerank_weighted(s, d):
    return rank.pagerank_weighted(V.nodes(s, d), V.linked(s, d), iterations=_STEPS).select("id", F.round("pagerank", 5).alias("pagerank"))


_FREQ = "CASE WHEN coalesce(access_count, 0) <= 0 THEN 0.0 ELSE least(1.0, ln(1 + access_count) / ln(101)) END"


@query(_prw_sql(_STEPS) + f" SELECT g.id, round(least(10.0, greatest(0.0, 10 * (0.3 * exp(-0.693 * {AGE.format(t='accessed_at')} / 30) + 0.3 * {_FREQ} + 0.2 * coalesce(pr / (SELECT max(pr) FROM r{_STEPS}), 0) + 0.2 * importance / 10))), 4) AS score FROM nodes g LEFT JOIN r{_STEPS} r ON r.id = g.id")
def node_importance(s, d):
    n = cut(V.nodes(s, d).select("id", "accessed_at", "access_count", "importance"))
    r = rank.pagerank_weighted(n, V.linked(s, d), iterations=_STEPS)
    return rank.node_importance(n, r, V.now()).select("id", F.round("score", 4).alias("score"))


@query(W(N, E, L) + f""", i AS (SELECT id, max(importance) AS imp FROM nodes GROUP BY 1)
SELECT l.id, round(least(10.0, greatest(0.0, 10 * (0.25 * exp(-0.693 * {AGE.format(t='l.accessed_at')} / 30) + 0.2 * {_FREQ} + 0.2 * least(1.0, weight / 5) + 0.15 * confidence + 0.2 * (coalesce(a.imp / 10, 0.5) + coalesce(b.imp / 10, 0.5)) / 2))), 6) AS score
FROM linked l LEFT JOIN i a ON a.id = source_id LEFT JOIN i b ON b.id = target_id WHERE l.accessed_at IS NOT NULL AND confidence IS NOT NULL""")
def edge_importance(s, d):
    e = V.linked(s, d).where("accessed_at is not null and confidence is not null")
    return rank.edge_importance(e, V.nodes(s, d), V.now()).select("id", F.round("score", 6).alias("score"))


# -- evolution ------------------------------------------------------------------------------------------------------------------
_EXPD = f"importance * exp(-0.6931471805599453 * {AGE.format(t='accessed_at')} / 30)"


@query(W(N) + f""", b AS (SELECT *, {BUCKET.format(s='(' + _EXPD + ')')} AS new_importance FROM nodes WHERE state = 'ACTIVE' AND importance < 10 AND accessed_at IS NOT NULL)
SELECT id, memory_id, importance, new_importance, CASE WHEN new_importance = 0 THEN 'DECAYING' ELSE state END AS new_state FROM b WHERE importance - new_importance >= 2""")
def decay_facade(s, d):
    return evolve.facade_decay(V.nodes(s, d), V.now())


@query(_pr_sql(20) + f""", b AS (SELECT g.*, 0.3 * CASE WHEN {AGE.format(t='accessed_at')} < 1 THEN 10 WHEN {AGE.format(t='accessed_at')} < 7 THEN 8 WHEN {AGE.format(t='accessed_at')} < 30 THEN 5 WHEN {AGE.format(t='accessed_at')} < 90 THEN 3 ELSE 1 END
  + 0.3 * coalesce(access_count, 0) / 100 + 0.2 * coalesce(pr, 0) * 10 + 0.2 * importance AS sc FROM nodes g LEFT JOIN r20 r ON r.id = g.id WHERE state = 'ACTIVE' AND accessed_at IS NOT NULL AND importance IS NOT NULL)
SELECT id, memory_id, importance, {BUCKET.format(s='sc')} AS new_importance FROM b WHERE abs({BUCKET.format(s='sc')} - importance) >= 2""")
def reinforce_scores(s, d):
    return evolve.facade_reinforce(V.nodes(s, d), rank.pagerank(V.nodes(s, d), V.linked(s, d)), V.now())


_STRENGTH = f"exp(-0.693 * {AGE.format(t='accessed_at')} / (30.0 * (0.5 + importance / 20.0) * least(1.0, 0.5 + ln(1 + greatest(coalesce(access_count, 0), 0)) / 10)))"
_NODE_SCORE = f"least(10.0, greatest(0.0, 10 * (0.3 * exp(-0.693 * {AGE.format(t='accessed_at')} / 30) + 0.3 * {_FREQ} + 0.2 * coalesce(pr / (SELECT max(pr) FROM r{_STEPS}), 0) + 0.2 * importance / 10)))"


@query(_prw_sql(_STEPS) + f""", q AS (SELECT g.*, {_STRENGTH} AS strength, {_NODE_SCORE} AS score FROM nodes g LEFT JOIN r{_STEPS} r ON r.id = g.id WHERE state <> 'DELETED' AND importance < 10 AND accessed_at IS NOT NULL),
z AS (SELECT *, CASE WHEN importance < 1 AND strength <= 0.05 THEN 'DELETED' WHEN importance < 1 AND strength <= 0.2 THEN 'ARCHIVED' ELSE state END AS new_state FROM q)
SELECT id, memory_id, round(strength, 4) AS strength, new_state, CASE WHEN new_state <> state THEN importance ELSE {BUCKET.format(s='score')} END AS new_importance FROM z""")
def decay_nodes(s, d):
    n = cut(V.nodes(s, d).select("id", "memory_id", "state", "accessed_at", "access_count", "importance"))
    r = rank.pagerank_weighted(n, V.linked(s, d), iterations=_STEPS)
    out = evolve.decay_nodes(n, rank.node_importance(n, r, V.now()), V.now())
    return out.select("id", "memory_id", F.round("strength", 4).alias("strength"), "new_state", "new_importance")


@query(W(N, E, L) + f""", s AS (SELECT l.*, exp(-0.693 * {AGE.format(t='accessed_at')} / greatest(1.0, 30.0 * least(1.0, weight / 5.0) * confidence)) AS strength,
  source_id IN (SELECT id FROM nodes WHERE state = 'DELETED') OR target_id IN (SELECT id FROM nodes WHERE state = 'DELETED') AS dead FROM linked l WHERE state <> 'DELETED' AND coalesce(importance, 5) < 10 AND accessed_at IS NOT NULL AND confidence IS NOT NULL AND weight IS NOT NULL)
SELECT id, round(strength, 6) AS strength, CASE WHEN dead OR strength <= 0.05 THEN 'DELETED' ELSE state END AS new_state, round(CASE WHEN NOT dead AND strength > 0.05 AND strength < 0.5 THEN weight * strength ELSE weight END, 6) AS new_weight FROM s""")
def decay_edges(s, d):
    return evolve.decay_edges(V.linked(s, d), V.nodes(s, d), V.now()).select("id", F.round("strength", 6).alias("strength"), "new_state", F.round("new_weight", 6).alias("new_weight"))


_SIM = W(N) + f""", a AS (SELECT * FROM nodes WHERE state = 'ACTIVE' AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0)
SELECT x.memory_id, x.entity_type, x.id AS id_a, y.id AS id_b, round({V.COSINE.format(a='x.embedding', b='y.embedding')}, 6) AS similarity
FROM a x JOIN a y ON x.memory_id = y.memory_id AND x.entity_type = y.entity_type AND x.id < y.id AND len(x.embedding) = len(y.embedding) WHERE {V.COSINE.format(a='x.embedding', b='y.embedding')} >= 0.85"""


@query(_SIM)
def similar_pairs(s, d):
    """Pairs with vectors on both sides; the name rule for the others is in name_similar_pairs."""
    n = V.nodes(s, d).where(F.size("embedding") > 0)
    return evolve.similar_pairs(n).select("memory_id", "entity_type", "id_a", "id_b", F.round("similarity", 6).alias("similarity"))


_ACT = "act AS (SELECT * FROM nodes WHERE state = 'ACTIVE' AND entity_type IS NOT NULL)"
_BY_NAME = _lcs_sql("""SELECT {'m': x.memory_id, 't': x.entity_type, 'a': x.id, 'b': y.id} AS k, x.name AS a, y.name AS b FROM act x JOIN act y ON x.memory_id = y.memory_id AND x.entity_type = y.entity_type AND x.id < y.id WHERE (coalesce(len(x.embedding), 0) = 0 OR coalesce(len(y.embedding), 0) = 0) AND 2.0 * least(octet_length(encode(x.name)), octet_length(encode(y.name))) / (octet_length(encode(x.name)) + octet_length(encode(y.name))) >= 0.84""")


@query(W(N, _ACT, _BY_NAME) + "SELECT k.m AS memory_id, k.t AS entity_type, k.a AS id_a, k.b AS id_b, round(ratio, 6) AS similarity FROM lcs WHERE ratio >= 0.85")
def name_similar_pairs(s, d):
    """The pairs of the whole rule of which one node at least has no vector, so the names decide."""
    n = cut(V.nodes(s, d))
    bare = n.where(F.coalesce(F.size("embedding"), F.lit(0)) <= 0).select("id")
    p = evolve.similar_pairs(n)
    hit = lambda c: bare.select(F.col("id").alias(c))
    a = p.join(hit("id_a"), "id_a", "left_semi").select(p.columns)
    b = p.join(hit("id_a"), "id_a", "left_anti").join(hit("id_b"), "id_b", "left_semi").select(p.columns)
    return a.union(b).select("memory_id", "entity_type", "id_a", "id_b", F.round("similarity", 6).alias("similarity"))


_LASTN = "CASE WHEN len(w) > 0 THEN coalesce(list_filter(w, lambda x: x NOT IN ('dr','mr','ms','mrs','prof','professor','jr','sr','phd','md','the'))[-1], w[-1]) END"
_DUPS = f"""dk AS MATERIALIZED (SELECT *, {_LASTN} AS last FROM (
  SELECT memory_id, coalesce(nullif(lower(entity_type), ''), 'unknown') AS kind, id, lower(trim(coalesce(name, ''))) AS n, coalesce(nullif(lower(trim(coalesce(canonical_name, ''))), ''), lower(trim(coalesce(name, '')))) AS p,
    list_filter(list_transform(coalesce(aliases, []), lambda x: lower(trim(coalesce(x, '')))), lambda x: x <> '') AS al, embedding AS e,
    list_transform(regexp_extract_all(coalesce(nullif(trim(canonical_name), ''), name), '[A-Za-z]{{2,}}'), lambda x: lower(x)) AS w,
    list_filter(list_distinct(regexp_extract_all(lower(coalesce(nullif(trim(canonical_name), ''), name)), '\\b[a-z]{{2,}}\\b')), lambda x: x NOT IN ('the','dr','mr','ms','mrs','prof','professor','inc','corp','llc')) AS tk FROM nodes)),
dp AS (SELECT x.memory_id, x.kind, x.id AS id_a, y.id AS id_b, x.p AS xp, y.p AS yp, x.n AS xn, y.n AS yn, x.al AS xa, y.al AS ya, x.last AS xl, y.last AS yl, x.tk AS xt, y.tk AS yt,
    CASE WHEN len(list_filter(x.e, lambda v: NOT isfinite(v))) = 0 AND len(list_filter(y.e, lambda v: NOT isfinite(v))) = 0 THEN {V.COSINE.format(a='x.e', b='y.e')} ELSE 0 END AS c
  FROM dk x JOIN dk y ON x.memory_id = y.memory_id AND x.kind = y.kind AND x.id < y.id),
dup AS (SELECT memory_id, kind, id_a, id_b FROM dp WHERE (xp <> '' AND (xp = yp OR xp = yn)) OR (yp <> '' AND yp = xn) OR len(list_intersect(xa, ya)) > 0 OR list_contains(ya, xp) OR list_contains(xa, yp)
  OR (xp <> '' AND yp <> '' AND (contains(xp, yp) OR contains(yp, xp))) OR (xl = yl AND length(xl) >= 3 AND c >= 0.65)
  OR (len(xt) > 0 AND len(yt) > 0 AND len(list_intersect(xt, yt)) / least(len(xt), len(yt)) >= 0.5 AND c >= 0.6) OR c >= 0.75)"""


@query(W(N, _DUPS) + "SELECT * FROM dup")
def duplicate_pairs(s, d):
    return evolve.duplicate_pairs(V.nodes(s, d))


@query()
def duplicate_groups(s, d):
    """Star groups of the duplicates; tested against the greedy order on a fixture."""
    n = cut(V.nodes(s, d))
    return evolve.star_groups(evolve.duplicate_pairs(n), n)


@query()
def consolidate_fully(s, d):
    """Merged nodes after duplicates, repeated edges and inferred links."""
    out, _, _, _ = evolve.consolidate_fully(cut(V.nodes(s, d)), V.linked(s, d), V.now())
    return out.select("id", "memory_id", "name", "access_count", "importance", F.size("aliases").alias("n_aliases"))


@query()
def consolidation_log(s, d):
    """How many merges and folds a full consolidation logs per memory."""
    _, _, _, log = evolve.consolidate_fully(cut(V.nodes(s, d)), V.linked(s, d), V.now())
    return log.groupBy("memory_id", "evolution_type").agg(F.count("*").alias("n_events"))


_SIMILAR = f"""sa AS (SELECT * FROM act WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
sp AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM sa x JOIN sa y ON x.memory_id = y.memory_id AND x.entity_type = y.entity_type AND x.id < y.id AND len(x.embedding) = len(y.embedding) WHERE {V.COSINE.format(a='x.embedding', b='y.embedding')} >= 0.85
  UNION ALL SELECT k.a, k.b FROM lcs WHERE ratio >= 0.85),
sy AS MATERIALIZED (SELECT a, b FROM sp UNION SELECT b, a FROM sp),
cl0 AS (SELECT DISTINCT a AS id, a AS root FROM sy UNION SELECT sy.b, cl0.root FROM cl0 JOIN sy ON sy.a = cl0.id),
comp AS MATERIALIZED (SELECT id, min(root) AS g FROM cl0 GROUP BY id),
keep AS (SELECT g, arg_max(id, (coalesce(access_count, 0), coalesce(importance, 0), id)) AS new_id FROM comp JOIN nodes USING (id) GROUP BY g),
mv AS MATERIALIZED (SELECT id AS old_id, new_id FROM comp JOIN keep USING (g) WHERE id <> new_id),
got AS (SELECT new_id, list_distinct(flatten(list(list_append(coalesce(n.aliases, []), n.name)))) AS al, sum(coalesce(n.access_count, 0)) AS ac FROM mv JOIN nodes n ON n.id = old_id GROUP BY new_id)"""


@query(W(N, _ACT, _BY_NAME, _SIMILAR) + """SELECT n.id, n.memory_id, CASE WHEN m.old_id IS NOT NULL THEN 'DELETED' ELSE n.state END AS state, CAST(coalesce(n.access_count, 0) + coalesce(ac, 0) AS BIGINT) AS access_count,
  array_to_string(list_sort(list_filter(CASE WHEN al IS NOT NULL THEN list_distinct(list_concat(coalesce(n.aliases, []), al)) ELSE n.aliases END, lambda x: x IS NOT NULL)), '|') AS aliases
FROM nodes n LEFT JOIN got ON got.new_id = n.id LEFT JOIN mv m ON m.old_id = n.id""")
def consolidate_nodes(s, d):
    n = cut(V.nodes(s, d))
    out, _, _ = evolve.consolidate(n, V.edges(s, d), evolve.similar_pairs(n), V.now())
    return out.select("id", "memory_id", "state", "access_count", F.array_join(F.array_sort("aliases"), "|").alias("aliases"))


@query()
def evolve_memories(s, d):
    """The three default steps in order; the log of events."""
    _, _, log = evolve.evolve(cut(V.nodes(s, d)), V.linked(s, d), V.now())
    return log.select("id", "evolution_type", "memory_id", F.array_join("affected_nodes", ",").alias("affected_nodes"), "before_state", "after_state")


@query(f"SELECT id FROM memories WHERE updated_at IS NULL OR epoch_us({NOW}) - epoch_us(updated_at) >= 3600000000")
def evolve_due(s, d):
    return evolve.due(table(s, d, "memories"), V.now()).select("id")


_V1 = V._lit(V.vector(1))
_PROD = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] * p[2] AS DOUBLE)))"
_COS1 = f"CASE WHEN len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND {_PROD.format(a='embedding', b='embedding')} > 0 THEN {_PROD.format(a='embedding', b=_V1)} / (sqrt({_PROD.format(a='embedding', b='embedding')}) * sqrt({_PROD.format(a=_V1, b=_V1)})) ELSE 0 END"
_RH = f"""rh AS (SELECT memory_id, id, state, round(least(1.0, {_COS1} * CASE WHEN state = 'ARCHIVED' THEN 1.1 ELSE 1.0 END), 5) AS relevance FROM nodes),
rt AS MATERIALIZED (SELECT * FROM rh WHERE relevance >= 0.2 QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY relevance DESC, id) <= 10)"""


@query(W(N, _RH) + "SELECT memory_id, id, relevance, CASE WHEN state IN ('ARCHIVED', 'DECAYING') THEN 'ACTIVE' ELSE state END AS new_state, CASE WHEN state IN ('ARCHIVED', 'DECAYING') THEN 'restored' WHEN state = 'ACTIVE' THEN 'strengthened' ELSE 'unchanged' END AS action FROM rt")
def rehydrate(s, d):
    return evolve.rehydrate(V.nodes(s, d), V.vector(1), threshold=0.2, limit=10)


@query(W(N, E, L, _RH) + ", g AS (SELECT id FROM rt WHERE state IN ('ARCHIVED', 'DECAYING')) SELECT id, 'ACTIVE' AS state FROM linked WHERE state <> 'ACTIVE' AND (source_id IN (SELECT id FROM g) OR target_id IN (SELECT id FROM g))")
def rehydrate_edges(s, d):
    r = evolve.rehydrate(V.nodes(s, d), V.vector(1), threshold=0.2, limit=10)
    return evolve.rehydrated_edges(V.linked(s, d), r).select("id", "state")


# -- retrieval -------------------------------------------------------------------------------------------------------------------
_LOWTOK = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower({c}), '\\s+'), lambda x: trim(x, '.,!?;:''\"')), lambda x: octet_length(encode(x)) > 2))"
_HYB = W(N, Q) + f""", h AS (SELECT query_id, id, name, entity_type, description, embedding, q_embedding, aliases, lower(query) AS q, lower(name) AS n, {_LOWTOK.format(c='query')} AS qt, {_LOWTOK.format(c='name')} AS nt
  FROM nodes, questions WHERE state = 'ACTIVE' AND importance >= 1),
sc AS MATERIALIZED (SELECT query_id, id, name, round(CASE WHEN contains(q, n) OR contains(n, q) THEN 1.0
  WHEN len(list_filter(coalesce(aliases, []), lambda a: contains(q, lower(a)) OR contains(lower(a), q))) > 0 THEN 0.95
  WHEN coalesce(len(embedding), 0) > 0 THEN {V.COSINE.format(a='embedding', b='q_embedding')}
  WHEN len(list_intersect(qt, nt)) > 0 THEN 0.5 + 0.3 * len(list_intersect(qt, nt)) / len(qt) ELSE 0.0 END, 6) AS score FROM h),
fl AS (SELECT * FROM sc WHERE score >= 0.3 AND NOT isnan(score)),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fl QUALIFY rank <= 10)
"""


def _scored(s, d):
    return retrieve.score_nodes(V.nodes(s, d), V.QUERIES, floor=0.3).where(~F.isnan("score"))


@query(_HYB + "SELECT query_id, id, name, score, CAST(rank AS INT) AS rank FROM tp")
def hybrid_retrieve(s, d):
    return retrieve._top(_scored(s, d), 10).select("query_id", "id", "name", "score", "rank")


@query(_HYB + "SELECT query_id, round(avg(score), 6) AS confidence, count(*) AS n FROM fl GROUP BY 1")
def retrieval_confidence(s, d):
    return _scored(s, d).groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("confidence"), F.count("*").alias("n"))


@query(_HYB.replace("RECURSIVE nodes", "RECURSIVE " + E + ", nodes", 1) + "SELECT t.query_id, e.id FROM edges e JOIN tp t ON t.id = e.source_id JOIN tp u ON u.id = e.target_id AND u.query_id = t.query_id WHERE e.state = 'ACTIVE'")
def retrieved_edges(s, d):
    top = cut(retrieve._top(_scored(s, d), 10))
    return retrieve.retrieved_edges(top, V.edges(s, d)).select("query_id", "id")


@query(_HYB + "SELECT query_id, array_to_string(list(name ORDER BY rank), '|') AS sources FROM (SELECT query_id, name, min(rank) AS rank FROM tp GROUP BY 1, 2) GROUP BY 1")
def retrieval_sources(s, d):
    return retrieve.sources(retrieve._top(_scored(s, d), 10)).select("query_id", F.array_join("sources", "|").alias("sources"))


@query(_HYB.replace("RECURSIVE nodes", "RECURSIVE " + E + ", nodes", 1) + """, nl AS (SELECT t.query_id, string_agg('- ' || t.name || ' (' || n.entity_type || '): ' || coalesce(n.description, ''), chr(10) ORDER BY t.rank) AS x FROM tp t JOIN nodes n ON n.id = t.id WHERE t.name IS NOT NULL AND n.entity_type IS NOT NULL GROUP BY 1),
el AS (SELECT t.query_id, string_agg('- ' || e.source_id || ' ' || e.relation_type || ' ' || e.target_id || ': ' || coalesce(e.description, ''), chr(10) ORDER BY e.id) AS y FROM edges e JOIN tp t ON t.id = e.source_id JOIN tp u ON u.id = e.target_id AND u.query_id = t.query_id WHERE e.state = 'ACTIVE' GROUP BY 1)
SELECT query_id, 'Entities:' || chr(10) || x || CASE WHEN y IS NOT NULL THEN chr(10) || chr(10) || 'Relationships:' || chr(10) || y ELSE '' END AS context FROM nl LEFT JOIN el USING (query_id)""")
def retrieval_context(s, d):
    top = cut(retrieve._top(_scored(s, d), 10))
    return retrieve.context_text(top, retrieve.retrieved_edges(top, V.edges(s, d)))


_LIN = "list_filter(coalesce(aliases, []), lambda a: {})"
_SEM = W(N, Q) + f""", sm AS (SELECT query_id, id, name, canonical_name, importance, access_count, accessed_at, lower(query) AS q, regexp_split_to_array(lower(query), '[ \\t\\n\\f\\r\\x0b]+') AS qw, aliases,
    CASE WHEN len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 THEN {V.COSINE.format(a='embedding', b='q_embedding')} ELSE 0 END AS sim
  FROM nodes, questions WHERE importance <> 0 AND state = 'ACTIVE'),
sb AS (SELECT *, greatest(CASE WHEN len({_LIN.format('contains(q, lower(a))')}) > 0 THEN 0.30 ELSE 0.0 END,
    CASE WHEN len({_LIN.format("list_has_any(regexp_split_to_array(lower(a), '[ \\t\\n\\f\\r\\x0b]+'), qw)")}) > 0 THEN 0.15 ELSE 0.0 END,
    CASE WHEN len(coalesce(aliases, [])) > 0 AND (contains(q, lower(coalesce(canonical_name, name))) OR contains(q, lower(name))) THEN 0.25 ELSE 0.0 END) AS boost,
    (epoch_us({NOW}) - epoch_us(accessed_at)) / 3600000000.0 AS hours FROM sm),
ss AS (SELECT query_id, id, round(0.5 * sim + 0.25 * importance / 10.0 + 0.15 * (boost * 3.33) + CASE WHEN hours < 24 THEN 0.1 * (1 - hours / 24) ELSE 0.0 END + least(0.1, 0.01 * coalesce(access_count, 0)), 6) AS score, least(1.0, sim + boost) AS near FROM sb)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM ss WHERE near >= 0.2 QUALIFY rank <= 10"""


@query(_SEM)
def semantic_search(s, d):
    return retrieve.semantic_search(V.nodes(s, d), V.QUERIES, V.now(), floor=0.2, filters={"state": "ACTIVE"}).select("query_id", "id", "score", "rank")


@query(_SEM)
def search_cached(s, d):
    """The same questions a second time, from the cache of search results."""
    c, n = stores.CacheTable(s), V.nodes(s, d)
    ask = lambda: retrieve.cached_search(c, n, V.QUERIES, V.now(), "u", "m", floor=0.2, filters={"state": "ACTIVE"})
    ask().count()
    return ask().select("query_id", "id", "score", "rank")


def _asked(s, d):
    """The first nodes of each question with all their columns; some get source texts and counts as an ingestion leaves them."""
    n = V.nodes(s, d)
    chunk = F.concat(F.lit("About "), "name", F.lit(" as told: "), F.coalesce("description", F.lit("")))
    given = F.to_json(F.struct(chunk.alias("source_chunk"), F.array(F.concat(F.lit("Type "), "entity_type"), F.lit(None).cast("string"), F.lit("")).alias("source_chunks"), F.length("name").alias("occurrence_count")))
    top = retrieve._top(_scored(s, d), 25).select("query_id", "id", "rank")
    return cut(top.join(n.withColumn("properties", F.when(F.length("name") % 2 == 0, given).otherwise(F.col("properties"))), "id"))


_ASKED = _HYB + """, tq AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM fl QUALIFY rk <= 25),
aq AS MATERIALIZED (SELECT t.query_id, t.rk AS rank, n.*, CASE WHEN length(n.name) % 2 = 0 THEN 'About ' || n.name || ' as told: ' || coalesce(n.description, '') END AS chunk, length(n.name) AS times FROM tq t JOIN nodes n USING (id)),
ch AS (SELECT query_id, rank, i, CASE WHEN i = 0 THEN 'Type ' || entity_type ELSE chunk END AS c FROM aq, (SELECT unnest([0, 3]) AS i) WHERE chunk IS NOT NULL),
qs AS (SELECT DISTINCT query_id FROM aq)"""
_ORDERED = "(SELECT query_id, c, row_number() OVER (PARTITION BY query_id ORDER BY min((rank, i))) AS p FROM ch WHERE rank <= {n} AND c <> '' GROUP BY query_id, c QUALIFY p <= {k})"
_OTHER = "list_sort(list_filter(list_distinct(coalesce(aliases, [])), lambda a: a IS NOT NULL AND a <> name))[1:{n}]"


@query(_ASKED + ", x AS (SELECT query_id, string_agg('[Source ' || p || ']: ' || c || chr(10) || chr(10), '' ORDER BY p) AS t FROM " + _ORDERED.format(n=10, k=5) + " GROUP BY 1) SELECT query_id, coalesce(t, 'No source text available') AS sources FROM qs LEFT JOIN x USING (query_id)")
def source_chunks(s, d):
    return retrieve.source_chunks(_asked(s, d))


@query(_ASKED + ", x AS (SELECT query_id, string_agg('- ' || name || ' (' || coalesce(entity_type, '') || ')' || CASE WHEN len(" + _OTHER.format(n=5) + ") > 0 THEN ' [also known as: ' || array_to_string(" + _OTHER.format(n=5) + ", ', ') || ']' ELSE '' END || ': ' || coalesce(nullif(description, ''), 'No description') || chr(10), '' ORDER BY rank) AS t FROM aq WHERE rank <= 15 GROUP BY 1) SELECT query_id, coalesce(t, 'No entity details available.') AS entities FROM qs LEFT JOIN x USING (query_id)")
def prompt_entities(s, d):
    return retrieve.prompt_entities(_asked(s, d))


def _asked_edges(s, d, top):
    ends = top.select("query_id", "id").distinct()
    e = V.linked(s, d).where("state = 'ACTIVE'")
    a = e.join(ends.withColumnRenamed("id", "source_id"), "source_id").select("query_id", *e.columns)
    b = e.join(ends.withColumnRenamed("id", "target_id"), "target_id").select("query_id", *e.columns)
    return a.union(b).dropDuplicates(["query_id", "id"])


_ASKED_EDGES = _ASKED.replace("RECURSIVE nodes", "RECURSIVE " + E + ", " + L + ", nodes", 1) + """, ae AS (SELECT DISTINCT ON (a.query_id, e.id) a.query_id, e.* FROM linked e JOIN aq a ON a.id = e.source_id OR a.id = e.target_id WHERE e.state = 'ACTIVE'),
fe AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS p, source_id || ' --[' || coalesce(relation_type, '') || ']--> ' || target_id AS line, strftime(timezone('UTC', valid_from), '%Y') || ' → ' || coalesce(strftime(timezone('UTC', valid_until), '%Y'), 'present') AS years FROM ae)
"""


@query(_ASKED_EDGES + ", x AS (SELECT query_id, string_agg('- ' || line || CASE WHEN years IS NOT NULL THEN ' [' || years || ']' ELSE '' END || chr(10), '' ORDER BY p) AS t FROM fe WHERE p <= 15 GROUP BY 1) SELECT query_id, coalesce(t, 'No relationships available.') AS relationships FROM qs LEFT JOIN x USING (query_id)")
def prompt_relationships(s, d):
    top = _asked(s, d)
    return retrieve.prompt_relationships(_asked_edges(s, d, top), top)


@query(_ASKED_EDGES + """, a AS (SELECT query_id, string_agg(chr(10) || '[Source ' || p || ']:' || chr(10) || c || chr(10), '' ORDER BY p) AS t FROM """ + _ORDERED.format(n=15, k=10) + """ GROUP BY 1),
b AS (SELECT query_id, string_agg(chr(10) || '• ' || name || ' (' || coalesce(entity_type, '') || ')' || CASE WHEN len(""" + _OTHER.format(n=8) + """) > 0 THEN ' [Also known as: ' || array_to_string(""" + _OTHER.format(n=8) + """, ', ') || ']' ELSE '' END
  || chr(10) || '  Description: ' || coalesce(nullif(description, ''), 'No description') || chr(10) || CASE WHEN chunk IS NOT NULL AND times > 1 THEN '  [Mentioned ' || times || ' times across documents]' || chr(10) ELSE '' END, '' ORDER BY rank) AS t FROM aq WHERE rank <= 20 GROUP BY 1),
r AS (SELECT query_id, string_agg('• ' || line || CASE WHEN years IS NOT NULL THEN ' [valid: ' || years || ']' ELSE '' END || chr(10) || CASE WHEN description <> '' THEN '  Detail: ' || description || chr(10) ELSE '' END, '' ORDER BY p) AS t FROM fe WHERE p <= 40 GROUP BY 1)
SELECT query_id, CASE WHEN a.t <> '' THEN '## ORIGINAL SOURCE TEXT (contains full details)' || chr(10) || a.t ELSE '' END || chr(10) || chr(10) || '## EXTRACTED ENTITIES' || chr(10) || coalesce(b.t, '')
  || CASE WHEN r.t IS NOT NULL THEN chr(10) || chr(10) || '## RELATIONSHIPS' || chr(10) || r.t ELSE '' END AS context FROM qs LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id) LEFT JOIN r USING (query_id)""")
def entity_context(s, d):
    top = _asked(s, d)
    return retrieve.entity_context(top, _asked_edges(s, d, top))


_VEC = W(N, Q) + f", v AS (SELECT query_id, id, importance, name, round({V.COSINE.format(a='embedding', b='q_embedding')}, 6) AS score FROM (SELECT * FROM nodes WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0), questions) "


def _vectors(s, d):
    return V.nodes(s, d).where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: F.isnan(x)))


@query(_VEC + "SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM v WHERE importance <> 0 AND score >= 0.25 QUALIFY rank <= 10")
def vector_topk(s, d):
    return retrieve.vector_search(_vectors(s, d), V.QUERIES, 10, 0.25).select("query_id", "id", "score", "rank")


@query(_VEC + "SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM v QUALIFY rank <= 10")
def vector_topk_no_floor(s, d):
    return retrieve.vector_search(_vectors(s, d), V.QUERIES, 10, None, keep_ephemeral=True).select("query_id", "id", "score", "rank")


@query(_VEC + ", w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS f FROM v QUALIFY f <= 100), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM w WHERE score >= 0.2 QUALIFY rank <= 10) SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM x WHERE importance <> 0")
def vector_topk_over_fetch(s, d):
    return retrieve.vector_search(_vectors(s, d), V.QUERIES, 10, 0.2, over_fetch=100).select("query_id", "id", "score", "rank")


@query(_VEC + "SELECT query_id, name, max(score) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, name) AS INT) AS rank FROM v GROUP BY query_id, name QUALIFY rank <= 10")
def similar_entity_names(s, d):
    return retrieve.similar_names(_vectors(s, d), V.QUERIES).select("query_id", "name", "score", "rank")


@query(f"""WITH p AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS id, round({V.COSINE.format(a='q.embedding', b='b.embedding')}, 6) AS score FROM embeddings q JOIN embeddings b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(id), id) AS INT) AS rank FROM p QUALIFY rank <= 10""")
def retrieve_many(s, d):
    v = table(s, d, "embeddings")
    return retrieve.exact_top_k(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 10)
