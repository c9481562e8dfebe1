"""Queries over texts, communities, resolution, context, stores and streams."""

from __future__ import annotations


import uuid

from pyspark.sql import functions as F

from noetia.engine import EmbeddingCache, Engine, HashingEmbedding, NoEmbedding, embed
from noetia.functions import expr as X
from noetia.functions import text as T
from noetia.operators import community, context, graph, resolve
from noetia.plans import views as V
from noetia.plans.graph_queries import W
from noetia.session import cut, shared_dir, table
from noetia.sources import stores

QUERIES, SQL = {}, {}
N, E, L, C = V.NODES, V.EDGES, V.LINKED, V.CLUSTERS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(s, d):
    return table(s, d, "documents")


# -- texts -----------------------------------------------------------------------------------------------------------------
def _html_sql(c: str) -> str:
    for pattern in ("<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<(?:nav|header|footer|aside)[^>]*>.*?</(?:nav|header|footer|aside)>"):
        c = f"regexp_replace({c}, '(?is){pattern}', '', 'g')"
    main = "'(?is)<(?:main|article)[^>]*>(.*?)</(?:main|article)>'"
    c = f"CASE WHEN regexp_matches({c}, {main}) THEN regexp_extract({c}, {main}, 1) ELSE {c} END"
    c = f"regexp_replace(regexp_replace({c}, '<!--.*?-->', '', 'g'), '<[^>]+>', ' ', 'g')"
    for name, ch in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''")):
        c = f"replace({c}, '&{name};', '{ch}')"
    return f"trim(regexp_replace({c}, '[ \\t\\n\\f\\r\\x0b]+', ' ', 'g'), ' ')"


@query("SELECT doc_id, md5(" + _html_sql("text") + ") AS text_hash FROM documents WHERE text IS NOT NULL")
def html_to_text(s, d):
    return docs(s, d).where("text is not null").select("doc_id", F.md5(X.html_text("text")).alias("text_hash"))


@query()
def html_dom(s, d):
    """Every text read as a page."""
    pages = docs(s, d).where("text is not null").select("doc_id", "text", F.lit("webpage").alias("modality"))
    return T.chunk_table(pages, T.process).select("id", "source_id", "chunk_index", F.md5("content").alias("content_hash"), F.element_at("metadata", "title").alias("title"))


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))) AS text_hash FROM documents WHERE text IS NOT NULL""")
def clean_text(s, d):
    return docs(s, d).where("text is not null").select("doc_id", F.md5(X.clean_text("text")).alias("text_hash"))


@query("SELECT doc_id, CAST(floor(octet_length(encode(text)) * 0.25) AS BIGINT) AS tokens, octet_length(encode(text)) > 200 AS cut FROM documents WHERE text IS NOT NULL")
def token_estimates(s, d):
    return docs(s, d).where("text is not null").select("doc_id", X.token_estimate("text").alias("tokens"), (F.octet_length("text") > 200).alias("cut"))


@query("SELECT doc_id, octet_length(encode(text)) > 200 AS cut, md5(encode(text)[1:200]) AS bytes_hash FROM documents WHERE text IS NOT NULL")
def byte_prefixes(s, d):
    """The bytes before a cut; what becomes of a split character is tested apart."""
    t = docs(s, d).where("text is not null")
    return t.select("doc_id", X.byte_prefix("text", 200, "...").endswith("...") & (F.octet_length("text") > 200), F.md5(F.substring(F.encode("text", "UTF-8"), 1, 200)).alias("bytes_hash")).toDF("doc_id", "cut", "bytes_hash")


_SPACES_SQL = "[\\s\\x{0b}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@query(f"""WITH t AS (SELECT doc_id, list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(text, '{_SPACES_SQL}'), lambda x: trim(x, '.,!?;:''"')), lambda x: octet_length(encode(x)) > 2), lambda x: lower(x))) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(list_sort(w), ' ')) AS token_hash FROM t""")
def retrieval_tokens(s, d):
    t = docs(s, d).where("text is not null").select("doc_id", X.retrieval_tokens("text").alias("w"))
    return t.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("token_hash"))


_KINDS = "'.md': 'markdown', '.markdown': 'markdown', '.pdf': 'pdf', '.png': 'image', '.jpg': 'image', '.jpeg': 'image', '.gif': 'image', '.webp': 'image', '.bmp': 'image', '.mp3': 'audio', '.wav': 'audio', '.m4a': 'audio', '.flac': 'audio', '.ogg': 'audio', '.py': 'code', '.go': 'code', '.js': 'code', '.ts': 'code', '.java': 'code', '.cpp': 'code', '.c': 'code', '.rs': 'code', '.json': 'json', '.csv': 'csv', '.html': 'webpage', '.htm': 'webpage'"


@query("SELECT doc_id, coalesce(map_extract_value(MAP {" + _KINDS + "}, ext), CASE WHEN regexp_matches(u, '^https?://') THEN 'webpage' WHEN starts_with(text, '%PDF') THEN 'pdf' ELSE 'text' END) AS modality FROM (SELECT doc_id, text, coalesce(source_uri, '') AS u, regexp_extract(lower(coalesce(source_uri, '')), '(\\.[^./\\\\]+)$', 1) AS ext FROM documents)")
def detect_modality(s, d):
    return docs(s, d).select("doc_id", X.detect_modality("source_uri", F.encode("text", "UTF-8")).alias("modality"))


_HEADS = ("89504E470D0A1A0A", "FFD8FFE000104A46", "4749463839610000", "52494646000000005745425000", "255044462D312E34", "8950")


@query("SELECT doc_id, k IN (0, 1, 2, 3) AS is_image, k IN (0, 1) AS is_image_by_magic, k = 4 AS is_pdf FROM (SELECT doc_id, doc_id % 6 AS k FROM documents WHERE text IS NOT NULL)")
def image_signature(s, d):
    """The first bytes of files before every document's own; and what their content makes of files without an extension."""
    t = docs(s, d).where("text is not null")
    head = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in _HEADS]), (F.col("doc_id") % 6 + 1).cast("int"))
    content = F.when(F.col("doc_id") % 6 == 5, head).otherwise(F.concat(head, F.encode("text", "UTF-8")))
    kind = X.detect_modality(F.lit("file"), content)
    return t.select("doc_id", X.is_image(content).alias("is_image"), (kind == "image").alias("is_image_by_magic"), (kind == "pdf").alias("is_pdf"))


@query("""WITH p AS (SELECT doc_id, unnest(range(0, CAST(greatest(ceil((octet_length(encode(text)) - 2000) / 1800.0), 0) AS BIGINT) + 1)) AS i, encode(text) AS b FROM documents WHERE length(text) > 0)
SELECT doc_id || '_' || i AS id, doc_id, CAST(i AS INT) AS chunk_index, md5(b[i * 1800 + 1:i * 1800 + 2000]) AS content_hash FROM p""")
def pipeline_chunks(s, d):
    return T.fixed_chunks(docs(s, d)).select("id", "doc_id", "chunk_index", F.md5("raw").alias("content_hash"))


@query("SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS part_index, md5(unnest(p)) AS part_hash FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?][ \\t\\n\\f\\r]+[A-Z]') AS p FROM documents WHERE text IS NOT NULL)")
def sentence_split_parity(s, d):
    return T.sentence_split(docs(s, d)).select("doc_id", "part_index", F.md5("part").alias("part_hash"))


def _chunks(df, f, uri=None):
    return T.chunk_table(df, f, uri=uri).select("id", "source_id", "chunk_index", "start_char", "end_char", F.md5("content").alias("content_hash"))


@query()
def chunk_document(s, d):
    return _chunks(docs(s, d), lambda t, m: T.chunk_document(t))


@query()
def chunk_markdown(s, d):
    return _chunks(docs(s, d).where("modality = 'markdown'"), lambda t, m: T.chunk_markdown(t, 500, 50))


@query()
def chunk_code(s, d):
    return _chunks(docs(s, d).where("modality = 'code'"), T.process, "source_uri")


@query()
def chunk_kg(s, d):
    return _chunks(docs(s, d), lambda t, m: T.chunk_sentences(t))


@query()
def process_documents(s, d):
    """Every document by its modality."""
    return _chunks(docs(s, d), T.process, "source_uri")


@query()
def table_functions(s, d):
    """The chunkers as table functions of SQL."""
    T.register_table_functions(s)
    docs(s, d).createOrReplaceTempView("noetia_documents")
    return s.sql("SELECT d.doc_id, c.chunk_index, c.start_char, c.end_char, md5(c.content) AS content_hash FROM noetia_documents d, LATERAL chunk_text(d.text, 1000, 200) c")


@query("WITH x AS (SELECT doc_id, array_to_string((list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\r\\x0b\\x0c')), lambda x: x <> '' AND NOT starts_with(x, '#')))[1:5], ' ') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, octet_length(encode(t)) > 500 AS cut, CASE WHEN octet_length(encode(t)) <= 500 THEN t END AS summary, (SELECT count(*) FROM x) > 0 AS summarised FROM x")
def summarise(s, d):
    """Summaries that need no cut come out whole; where the cut falls is tested apart."""
    t = docs(s, d).where("text is not null").select("doc_id", context.summarise("text").alias("s"), context.summarise("text", 1 << 30).alias("whole"))
    cut_ = F.octet_length("whole") > 500
    return t.select("doc_id", cut_.alias("cut"), F.when(~cut_, F.col("s")).alias("summary"), F.octet_length("s").between(0, 503).alias("summarised"))


# -- model answers -----------------------------------------------------------------------------------------------------------
_TRIPLES = W(N, E, L) + """, t AS (SELECT l.id, '("entity"$$$$' || a.name || '$$$$' || a.entity_type || '$$$$about ' || a.name || '$$$$x, y) and ("relationship"$$$$' || a.name || '$$$$' || b.name || '$$$$' || relation_type || '$$$$text$$$$2001$$$$present)' AS answer
  FROM linked l JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id)
"""


def _answers(s, d):
    n = V.nodes(s, d)
    e = V.linked(s, d).join(n.select(F.col("id").alias("source_id"), F.col("name").alias("an"), F.col("entity_type").alias("at")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("name").alias("bn")), "target_id")
    t = F.concat(F.lit('("entity"$$$$'), "an", F.lit("$$$$"), "at", F.lit("$$$$about "), "an", F.lit('$$$$x, y) and ("relationship"$$$$'), "an", F.lit("$$$$"), "bn", F.lit("$$$$"), "relation_type", F.lit("$$$$text$$$$2001$$$$present)"))
    return e.select("id", t.alias("answer"))


_G = r"""regexp_extract(answer, '\("relationship"\$\$\$\$([^$]*)\$\$\$\$([^$]*)\$\$\$\$([^$]*)\$\$\$\$([^$]*)\$\$\$\$([^$]*)\$\$\$\$([^)$]*)\)', {})"""


@query(_TRIPLES + "SELECT id, trim(" + _G.format(1) + ") AS source, trim(" + _G.format(2) + ") AS target, trim(" + _G.format(3) + ") AS relation, 1 AS n_entities FROM t WHERE " + _G.format(1) + " <> ''")
def parse_triples(s, d):
    a = _answers(s, d)
    rel = X.parse_tuples("answer", X.RELATION_TUPLE, ("source", "target", "relation", "description", "valid_from", "valid_until"))
    ent = X.parse_tuples("answer", X.ENTITY_TUPLE, ("name", "type", "description", "aliases"))
    x = a.select("id", F.explode(rel).alias("r"), F.size(ent).alias("n_entities"))
    return x.select("id", "r.source", "r.target", "r.relation", "n_entities").where("source <> ''")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'yes ' || doc_id WHEN 1 THEN 'no' ELSE 'plain text ' || doc_id END AS answer, CAST(CASE doc_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 3 ELSE 5 END AS INT) AS confidence FROM documents""")
def parse_answers(s, d):
    k, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit('{"answer": "yes '), i, F.lit('", "confidence": 8}'))).when(k == 1, F.lit('Sure: {"answer": "no", "confidence": 3} as asked')).otherwise(F.concat(F.lit("plain text "), i))
    return docs(s, d).select("doc_id", X.parse_answer(raw).alias("x")).select("doc_id", "x.answer", "x.confidence")


@query("""WITH l AS (SELECT doc_id, string_split('1, 2' || chr(10) || '3' || chr(10) || 'foo, 4, 5' || chr(10) || (doc_id % 9) || ', 6', chr(10)) AS x FROM documents),
g AS (SELECT doc_id, list_transform(x, lambda s: list_filter(list_transform(string_split(s, ','), lambda v: try_cast(trim(v) AS INT)), lambda v: v BETWEEN 1 AND 6)) AS y FROM l)
SELECT doc_id, CAST(to_json(list_filter(y, lambda v: len(v) >= 2)) AS VARCHAR) AS groups FROM g""")
def parse_groups(s, d):
    raw = F.concat(F.lit("1, 2\n3\nfoo, 4, 5\n"), (F.col("doc_id") % 9).cast("string"), F.lit(", 6"))
    return docs(s, d).select("doc_id", F.to_json(X.parse_groups(raw, F.lit(6))).alias("groups"))


# -- communities -------------------------------------------------------------------------------------------------------------
@query()
def label_propagation(s, d):
    return community.label_propagation(V.nodes(s, d), V.linked(s, d))


@query()
def greedy_modularity(s, d):
    return community.greedy_modularity(V.nodes(s, d), V.linked(s, d))


_ADJ = "one AS MATERIALIZED (SELECT memory_id, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, arg_max(coalesce(weight, 1), id) AS w FROM linked WHERE source_id <> target_id GROUP BY ALL)"


@query(W(N, E, L, _ADJ) + "SELECT memory_id, round(CASE WHEN sum(w) = 0 THEN 1 ELSE sum(w) END, 6) AS total_weight FROM one GROUP BY 1")
def total_edge_weight(s, d):
    t = community.total_weight(community.adjacency(V.linked(s, d)))
    return t.select("memory_id", F.round("total_weight", 6).alias("total_weight"))


@query(W(N, E, L, _ADJ) + """, m AS (SELECT memory_id, id, entity_type AS community FROM nodes),
i AS (SELECT o.memory_id, x.community, count(*) AS k FROM one o JOIN m x ON x.memory_id = o.memory_id AND x.id = o.a JOIN m y ON y.memory_id = o.memory_id AND y.id = o.b AND y.community = x.community GROUP BY ALL)
SELECT memory_id, community, n, CAST(coalesce(k, 0) AS DOUBLE) AS internal, round(CASE WHEN n <= 1 THEN 1 ELSE least(1, coalesce(k, 0) / (n * (n - 1) / 2)) END, 6) AS coherence
FROM (SELECT memory_id, community, count(*) AS n FROM m GROUP BY ALL) LEFT JOIN i USING (memory_id, community)""")
def cluster_metrics(s, d):
    m = V.nodes(s, d).select("memory_id", "id", F.col("entity_type").alias("community"))
    c = community.cluster_metrics(m, V.linked(s, d))
    return c.select("memory_id", "community", "n", "internal", F.round("coherence", 6).alias("coherence"))


@query(W(N, E, L) + """, m AS (SELECT memory_id, id, name, importance, entity_type AS community FROM nodes),
e AS (SELECT x.memory_id, x.community, count(*) AS k FROM linked l JOIN m x ON x.memory_id = l.memory_id AND x.id = l.source_id JOIN m y ON y.memory_id = l.memory_id AND y.id = l.target_id AND y.community = x.community GROUP BY ALL),
g AS (SELECT memory_id, community, count(*) AS n, greatest(5, max(importance)) AS importance, list_sort(list(name)) AS names FROM m GROUP BY ALL HAVING count(*) >= 2)
SELECT memory_id, community, n, importance, 'Community about: ' || array_to_string(names[1:5], ', ') || '. Contains ' || n || ' entities and ' || coalesce(k, 0) || ' relationships.' AS summary FROM g LEFT JOIN e USING (memory_id, community)""")
def cluster_rollup(s, d):
    n = V.nodes(s, d)
    m = n.select("memory_id", "id", F.col("entity_type").alias("community"))
    return community.cluster_rollup(m, n, V.linked(s, d)).select("memory_id", "community", "n", "importance", "summary")


@query(W(C) + "SELECT id, importance FROM cl ORDER BY importance DESC NULLS LAST, id LIMIT 20")
def top_communities(s, d):
    return community.top_communities(V.clusters(s, d), 20).select("id", "importance")


@query(W(C) + """, a AS (SELECT memory_id AS query_id, id, (importance % 10) AS confidence, row_number() OVER (PARTITION BY memory_id ORDER BY importance % 10 DESC, id) AS r FROM cl WHERE importance IS NOT NULL)
SELECT query_id, round(sum(confidence) / 3 / 10, 6) AS confidence FROM a WHERE r <= 3 GROUP BY 1""")
def community_confidence(s, d):
    a = V.clusters(s, d).where("importance is not null").select(F.col("memory_id").alias("query_id"), F.col("id").alias("answer_id"), (F.col("importance") % 10).alias("confidence"))
    return context.community_confidence(a).select("query_id", F.round("confidence", 6).alias("confidence"))


# -- resolution and context ------------------------------------------------------------------------------------------------------
@query()
def resolve_entities(s, d):
    r = resolve.resolve(cut(V.nodes(s, d)))
    return r.select("memory_id", "user_id", "resolved_id", "name", "entity_type", F.array_join("aliases", "|").alias("aliases"), "n_merged")


@query(W(N) + """, t AS (SELECT memory_id || '|' || entity_type || '|' || canonical_name AS grp, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM nodes WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0)
SELECT grp, round(sum(CASE WHEN i = 1 THEN m END), 4) AS first, round(sum(abs(m)), 3) AS norm FROM (SELECT grp, i, avg(x) AS m FROM t GROUP BY 1, 2) GROUP BY 1""")
def blended_embeddings(s, d):
    n = V.nodes(s, d).where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: F.isnan(x))).withColumn("grp", F.concat_ws("|", "memory_id", "entity_type", "canonical_name"))
    b = resolve.blend_embeddings(n, "grp")
    return b.select("grp", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))), 3).alias("norm"))


#: Bytes of a text that is cut to n bytes with three dots; a character that the cut splits becomes one of three bytes.
_CUT_BYTES = "CASE WHEN octet_length(encode({c})) <= {n} THEN octet_length(encode({c})) ELSE 3 + {n} + CASE WHEN NOT regexp_matches(hex(encode({c})[{n} + 1:{n} + 1]), '^[89AB]') THEN 0 WHEN regexp_matches(hex(encode({c})[{n}:{n}]), '^[CDEF]') THEN 2 WHEN regexp_matches(hex(encode({c})[{n} - 1:{n} - 1]), '^[CDEF]') THEN 1 ELSE 0 END END"


def _lines_sql(name: str, table: str, key: str, order: str, size: str, budget: int) -> str:
    """CTEs that end in ``name``: the items of each memory that fit."""
    return f"""{name}_l AS (SELECT memory_id, {key} AS id, {order} AS o, CAST(floor(({size}) * 0.25) AS BIGINT) AS tokens FROM {table} WHERE memory_id IS NOT NULL),
{name}_u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY memory_id ORDER BY o DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM {name}_l WHERE tokens > 0),
{name} AS (SELECT * FROM {name}_u WHERE used <= {budget})"""


_ENTITY_SIZE = "octet_length(encode('• ' || name || ' (' || coalesce(entity_type, '') || '): ')) + 1 + " + _CUT_BYTES.format(c="(CASE WHEN description <> '' THEN description ELSE name END)", n=200)
_EDGE_SIZE = "octet_length(encode('• ' || source_id || ' --[' || coalesce(relation_type, '') || ']--> ' || target_id)) + 1 + CASE WHEN description <> '' THEN 2 + " + _CUT_BYTES.format(c="description", n=100) + " ELSE 0 END"


@query(W(N, _lines_sql("fit", "(SELECT * FROM nodes WHERE name IS NOT NULL AND importance IS NOT NULL)", "id", "importance", _ENTITY_SIZE, 500)) + "SELECT memory_id, id, tokens, used FROM fit")
def context_budget(s, d):
    n = V.nodes(s, d).where("name is not null and importance is not null")
    return context.within_budget(n, "memory_id", [F.desc("importance"), F.col("id")], context.entity_line(), 500).select("memory_id", "id", "tokens", "used")


_QUESTION = "Who founded Apple?"
_SECTIONS = {  # the budget is 8000 less 6 for the question; shares in the order of the sections
    "communities": ("(SELECT * FROM cl WHERE summary IS NOT NULL)", "id", "coalesce(importance, 0)", "octet_length(encode('• ' || summary)) + 1", 2797),
    "entities": ("(SELECT * FROM nodes WHERE name IS NOT NULL)", "id", "coalesce(importance, 0)", _ENTITY_SIZE, 2398),
    "relationships": ("linked", "id", "coalesce(weight * confidence, 0)", _EDGE_SIZE, 1598),
    "documents": ("(SELECT * FROM documents WHERE text IS NOT NULL)", "-doc_id", "0", "2 + " + _CUT_BYTES.format(c="text", n=500), 1199),
}


def _window_sql() -> str:
    out = W(N, E, L, C, *(_lines_sql(f"fit_{k}", *x).replace("o DESC, id ROWS", "o DESC, id DESC ROWS" if k == "documents" else "o DESC, id ROWS") for k, x in _SECTIONS.items()))
    for k, (table_, *_) in _SECTIONS.items():
        out += f", {k}_t AS (SELECT memory_id, CAST(sum(tokens) AS BIGINT) AS t, count(*) AS kept FROM fit_{k} GROUP BY 1), {k}_h AS (SELECT memory_id, count(*) AS have FROM {table_} WHERE memory_id IS NOT NULL GROUP BY 1), {k}_x AS (SELECT memory_id, coalesce(t, 0) AS t, coalesce(kept, 0) BETWEEN 1 AND have - 1 AS c FROM {k}_h LEFT JOIN {k}_t USING (memory_id))"
    out += " SELECT memory_id, " + " OR ".join(f"coalesce({k}_x.c, false)" for k in _SECTIONS) + " AS truncated, " + ", ".join(f"coalesce({k}_x.t, 0) AS {k}_tokens" for k in _SECTIONS)
    return out + " FROM communities_x FULL JOIN entities_x USING (memory_id) FULL JOIN relationships_x USING (memory_id) FULL JOIN documents_x USING (memory_id)"


@query(_window_sql())
def context_window(s, d):
    """What each section of every memory's context costs; the text is tested apart."""
    c = context.context_windows(V.nodes(s, d), V.linked(s, d), V.clusters(s, d), docs(s, d), _QUESTION)
    return c.select("memory_id", "truncated", *[f"{k}_tokens" for k in _SECTIONS])


@query()
def context_text(s, d):
    """The context of every memory, documents first."""
    c = context.context_windows(V.nodes(s, d), V.linked(s, d), V.clusters(s, d), docs(s, d), _QUESTION, 2000, "documents")
    return c.select("memory_id", "tokens_used", "truncated", F.md5("content").alias("content_hash"))


@query(W(E, L) + "SELECT id, CASE WHEN valid_from IS NULL THEN '' ELSE '[valid: ' || strftime(timezone('UTC', valid_from), '%Y') || ' to ' || coalesce(strftime(timezone('UTC', valid_until), '%Y'), 'present') || ']' END AS span FROM linked")
def relationship_spans(s, d):
    return V.linked(s, d).select("id", context.validity_span().alias("span"))


# -- stores ------------------------------------------------------------------------------------------------------------------
@query(W(N, E, C) + "SELECT 'node' AS kind, id, name AS a, importance AS n FROM nodes UNION ALL SELECT 'edge', id, relation_type, access_count FROM edges UNION ALL SELECT 'cluster', id, summary, importance FROM cl")
def store_round_trip(s, d):
    """All tables as one memory through a parquet store, saved again from what was loaded, and back."""
    store = stores.ParquetStore(s, f"{shared_dir(s)}/noetia-store-{uuid.uuid4().hex}")
    store.save(graph.MemoryGraph(V.nodes(s, d), V.edges(s, d), V.clusters(s, d), "all"))
    store.save(store.load("all"))
    g = store.load("all")
    row = lambda k, df, a, n: df.select(F.lit(k).alias("kind"), "id", F.col(a).alias("a"), F.col(n).cast("bigint").alias("n"))
    return row("node", g.nodes, "name", "importance").union(row("edge", g.edges, "relation_type", "access_count")).union(row("cluster", g.clusters, "summary", "importance"))


@query(W(N) + ", k AS (SELECT 'c:query:' || user_id || ':' || memory_id || ':' || md5(name) AS key, max(description) AS value FROM nodes GROUP BY 1) SELECT key, value FROM k WHERE key IS NOT NULL")
def cache_lookup(s, d):
    n = V.nodes(s, d).where("memory_id is not null and name is not null")
    rows = n.select(F.concat_ws(":", F.lit("c"), F.lit("query"), "user_id", "memory_id", F.md5("name")).alias("key"), F.col("description").alias("value"))
    c = stores.CacheTable(s)
    c.put(rows, V.now())
    return c.get(rows.select("key"), V.now()).select("key", "value")


@query("SELECT vec_id, true AS same, 256 AS n_bytes FROM embeddings")
def vector_blobs(s, d):
    blob = stores.vector_to_blob("embedding")
    v = table(s, d, "embeddings").select("vec_id", "embedding", blob.alias("b"), stores.blob_to_vector(blob).alias("back"))
    return v.select("vec_id", (F.col("embedding") == F.col("back")).alias("same"), F.octet_length("b").alias("n_bytes"))


# -- access logs, upserts, pipeline ----------------------------------------------------------------------------------------------
@query("SELECT date_trunc('day', ts) AS day, user_id, count(*) AS n_accesses FROM events GROUP BY ALL")
def access_windows(s, d):
    e = table(s, d, "events").groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("n_accesses"))
    return e.select(F.col("window.start").alias("day"), "user_id", "n_accesses")


@query("SELECT event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_stream(s, d):
    """Events through a stream into a table of the shared folder, and its sums."""
    root = f"{shared_dir(s)}/events-{uuid.uuid4().hex}"
    kinds = table(s, d, "events").schema
    stream = s.readStream.schema(kinds).parquet(f"{d}/events*.parquet").select("event_id", "event_type", "value")
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))


_HITS = "h AS (SELECT source_id AS id, count(*) AS hits FROM linked GROUP BY 1)"


@query(W(N, E, L, _HITS) + f"SELECT n.id, coalesce(access_count, 0) + coalesce(hits, 0) AS access_count, epoch_us(CASE WHEN hits > 0 THEN greatest(accessed_at, {V.NOW_SQL}) ELSE accessed_at END) AS accessed_us FROM nodes n LEFT JOIN h ON h.id = n.id")
def record_access(s, d):
    hits = V.linked(s, d).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("hits"))
    g = graph.MemoryGraph(V.nodes(s, d), V.edges(s, d)).record_access(hits, V.now())
    return g.nodes.select("id", "access_count", F.unix_micros("accessed_at").alias("accessed_us"))


@query(W(N) + "SELECT id, CASE WHEN importance >= 8 THEN 'reviewed' ELSE description END AS description FROM nodes")
def upsert_nodes(s, d):
    n = V.nodes(s, d)
    new = n.where("importance >= 8").withColumn("description", F.lit("reviewed"))
    return graph.MemoryGraph(n, V.edges(s, d)).add_nodes(new).nodes.select("id", "description")


@query(W(N) + "SELECT id, array_to_string(list_sort(list_distinct(list_append(coalesce(aliases, []), name))), '|') AS aliases FROM nodes WHERE name IS NOT NULL")
def alias_union(s, d):
    a = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))
    return V.nodes(s, d).where("name is not null").select("id", F.array_join(F.array_sort(F.filter(a, lambda x: x.isNotNull())), "|").alias("aliases"))


@query(W(N) + "SELECT id, array_to_string(list_filter(list_transform(string_split(description, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS parts FROM nodes WHERE description IS NOT NULL")
def list_parts(s, d):
    return V.nodes(s, d).where("description is not null").select("id", F.array_join(X.split_list("description"), "|").alias("parts"))


@query("""WITH c AS (SELECT DISTINCT ON (lower(trim(id))) trim(source_id) AS k, coalesce(len(entities), 0) AS ne, coalesce(len(key_phrases), 0) AS nr FROM chunks),
r AS (SELECT doc_id, CAST(coalesce(sum(ne), 0) AS BIGINT) AS e, CAST(coalesce(sum(nr), 0) AS BIGINT) AS r FROM documents LEFT JOIN c ON k = CAST(doc_id AS VARCHAR) GROUP BY doc_id)
SELECT count(*) FILTER (e + r > 0) AS processed, count(*) FILTER (e + r = 0) AS failed, CAST(sum(e) AS BIGINT) AS total_entities, CAST(sum(r) AS BIGINT) AS total_relations, round(20000.0 / count(*), 6) AS ms_per_document, count(*) / 20.0 AS documents_per_second FROM r""")
def ingest_statistics(s, d):
    """Statistics of an ingestion that took twenty seconds."""
    c = table(s, d, "chunks").withColumn("id", F.lower(F.trim("id"))).dropDuplicates(["id"])
    size = lambda x: F.coalesce(F.array_size(x), F.lit(0)).cast("bigint")
    r = c.select(F.trim("source_id").try_cast("bigint").alias("doc_id"), size("entities").alias("n_entities"), size("key_phrases").alias("n_relations"), F.lit(None).cast("string").alias("error"))
    t = graph.throughput(graph.ingest_rollup(docs(s, d), r), 20.0)
    return t.select("processed", "failed", "total_entities", "total_relations", F.round("ms_per_document", 6).alias("ms_per_document"), "documents_per_second")


@query()
def ingest_pipeline(s, d):
    """Chunk, extract and count: a row per document."""
    return Engine(s, "pipeline", store=stores.ParquetStore(s, f"{shared_dir(s)}/pipeline")).extract(docs(s, d).select("doc_id", "text"), V.now())[2]


@query()
def embed_documents(s, d):
    e = embed(docs(s, d), HashingEmbedding(), "doc_id", F.col("text"))
    return e.select("id", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 1), 4).alias("first"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, true AS same, regexp_matches(coalesce(text, ''), '\\w') AS has_vector FROM documents WHERE text IS NULL OR regexp_full_match(text, '[\\x00-\\x7f]*')")
def embed_cached(s, d):
    """Texts whose vectors come from the cache are the same as without it; ASCII ones, where a word is the same to both sides."""
    t = docs(s, d).where(F.col("text").isNull() | ~F.col("text").rlike("[^\\x00-\\x7f]")).select("doc_id", "text")
    cache = EmbeddingCache(s)
    first = cache.embed(t, HashingEmbedding(), "doc_id", F.col("text"))
    again = cache.embed(t, NoEmbedding(), "doc_id", F.col("text"))
    j = first.withColumnRenamed("embedding", "a").join(again.withColumnRenamed("embedding", "b"), "id")
    return j.select("id", F.col("a").eqNullSafe(F.col("b")).alias("same"), F.col("b").isNotNull().alias("has_vector"))


@query()
def json_to_text(s, d):
    j = docs(s, d).where("modality = 'json'")
    return T.chunk_table(j, lambda t, m: [(0, len(t), *T.json_text(t))]).select("source_id", F.md5("content").alias("content_hash"), F.element_at("metadata", "structured").alias("structured"))
