"""Hybrid and vector retrieval. A batch of questions runs in one job; a question set is a list of literals, so scoring is a
projection of the node scan and not a join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noetia.functions import expr as X
from noetia.session import cut

#: Questions of one batch at most; they travel inside the plan.
MAX_QUESTIONS = 1000


@dataclass(frozen=True)
class MemoryQuery:
    query_id: int
    query: str
    embedding: tuple[float, ...] = ()
    memory_id: str | None = None
    top_k: int = 10
    min_similarity: float = 0.5
    min_importance: int = 1
    filters: dict = field(default_factory=dict)


def _asked(nodes: DataFrame, queries: list[MemoryQuery]) -> DataFrame:
    if len(queries) > MAX_QUESTIONS:
        raise ValueError(f"at most {MAX_QUESTIONS} questions in a batch")
    q = F.array(*[F.struct(F.lit(q.query_id).alias("query_id"), F.lit(q.query).alias("query"), F.array(*map(F.lit, q.embedding)).cast("array<float>").alias("q_embedding"), F.lit(q.memory_id).alias("q_memory")) for q in queries])
    d = nodes.withColumn("q", F.explode(q)).select("*", "q.*").drop("q")
    return d.where(F.col("q_memory").isNull() | (F.col("q_memory") == F.col("memory_id")))


def hybrid_score(name="name", aliases="aliases", embedding="embedding", query="query", q_embedding="q_embedding") -> Column:
    """1 where name and question contain each other, .95 for an alias, else the cosine where both vectors exist, else the
    share of the question's words in the name (from .5 to .8), else 0."""
    q, n = F.lower(X.col(query)), F.lower(X.col(name))
    within = lambda a: F.contains(q, F.lower(a)) | F.contains(F.lower(a), q)
    qt, nt = X.retrieval_tokens(query), X.retrieval_tokens(name)
    overlap = F.size(F.array_intersect(qt, nt))
    both = (F.coalesce(F.size(X.col(embedding)), F.lit(0)) > 0) & (F.size(X.col(q_embedding)) > 0)
    return (
        F.when(within(n), 1.0)
        .when(F.exists(F.coalesce(X.col(aliases), F.array().cast("array<string>")), within), 0.95)
        .when(both, X.cosine(embedding, q_embedding))
        .when(overlap > 0, 0.5 + 0.3 * overlap / F.size(qt))
        .otherwise(0.0)
    )


def _top(scored: DataFrame, k: int, extra: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def score_nodes(nodes: DataFrame, queries: list[MemoryQuery], min_importance: int = 1, floor: float = 0.5) -> DataFrame:
    """query_id, id, name, score of every active node above the floors."""
    d = _asked(nodes.where((F.col("state") == "ACTIVE") & (F.col("importance") >= min_importance)), queries)
    return d.select("query_id", "id", "name", "entity_type", "description", F.round(hybrid_score(), 6).alias("score")).where(F.col("score") >= floor)


def retrieve(nodes: DataFrame, queries: list[MemoryQuery], top_k: int = 10, min_importance: int = 1, floor: float = 0.5) -> DataFrame:
    return _top(score_nodes(nodes, queries, min_importance, floor), top_k)


def retrieved_edges(top: DataFrame, edges: DataFrame) -> DataFrame:
    """Active edges of which both ends are among a question's nodes: query_id and the edge."""
    t = top.select("query_id", "id")
    e = edges.where(F.col("state") == "ACTIVE").join(t.withColumnRenamed("id", "source_id"), "source_id")
    return e.join(t.withColumnRenamed("id", "target_id"), ["query_id", "target_id"], "left_semi")


def confidence(scored: DataFrame) -> DataFrame:
    """Mean score of all nodes above the floor, per question."""
    return scored.groupBy("query_id").agg(F.avg("score").alias("confidence"))


def sources(top: DataFrame) -> DataFrame:
    """Distinct node names per question, best first."""
    g = top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("x"))
    return g.select("query_id", F.array_distinct(F.transform("x", lambda s: s["name"])).alias("sources"))


def context_text(top: DataFrame, edges: DataFrame) -> DataFrame:
    """The context a question's answer is made from: its entities and the relationships among them, one line each."""
    n = top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit("): "), F.coalesce("description", F.lit(""))).alias("line")))).alias("n"))
    line = F.concat(F.lit("- "), "source_id", F.lit(" "), "relation_type", F.lit(" "), "target_id", F.lit(": "), F.coalesce("description", F.lit("")))
    e = edges.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("e"))
    text = lambda c: F.concat_ws("\n", F.transform(c, lambda s: s["line"]))
    j = n.join(e, "query_id", "left")
    return j.select("query_id", F.concat(F.lit("Entities:\n"), text("n"), F.when(F.size("e") > 0, F.concat(F.lit("\n\nRelationships:\n"), text("e"))).otherwise(F.lit(""))).alias("context"))


# How many nodes, chunks, aliases and edges each prompt part takes, and where it cuts texts
CONTEXT_LIMITS = {"chunk_nodes": 15, "chunks": 10, "chunk_bytes": 2000, "nodes": 20, "aliases": 8, "edges": 40}
PROMPT_LIMITS = {"nodes": 15, "aliases": 5, "bytes": 200, "edges": 15}
SOURCE_LIMITS = {"nodes": 10, "chunks": 5, "bytes": 1500}
NO_SOURCES, NO_ENTITIES, NO_RELATIONS, NO_DESCRIPTION = "No source text available", "No entity details available.", "No relationships available.", "No description"


def _chunks(top: DataFrame, nodes: int, chunks: int) -> DataFrame:
    """query_id, place, chunk: the first distinct source chunks of a question's first nodes, lists before single ones."""
    many = F.from_json(F.get_json_object("properties", "$.source_chunks"), "array<string>")
    one = F.get_json_object("properties", "$.source_chunk")
    all_ = F.concat(F.coalesce(many, F.array().cast("array<string>")), F.array(one))
    c = top.where(F.col("rank") <= nodes).select("query_id", "rank", F.posexplode(all_).alias("i", "chunk")).where("chunk <> ''")
    first = c.groupBy("query_id", "chunk").agg(F.min(F.struct("rank", "i")).alias("k"))
    w = Window.partitionBy("query_id").orderBy("k")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= chunks).select("query_id", "place", "chunk")


def _text(lines: DataFrame, name: str, order: str = "place") -> DataFrame:
    """query_id and the lines in order as one text; bounded by the limits above."""
    g = lines.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(order, "line"))).alias("x"))
    return g.select("query_id", F.array_join(F.transform("x", lambda s: s["line"]), "").alias(name))


def source_chunks(top: DataFrame) -> DataFrame:
    """query_id, sources: the source texts that ``top(query_id, rank, properties)`` came from; one row per question."""
    c = _chunks(top, SOURCE_LIMITS["nodes"], SOURCE_LIMITS["chunks"])
    line = F.concat(F.lit("[Source "), F.col("place").cast("string"), F.lit("]: "), X.byte_prefix("chunk", SOURCE_LIMITS["bytes"]), F.lit("\n\n"))
    return top.select("query_id").distinct().join(_text(c.withColumn("line", line), "sources"), "query_id", "left").select("query_id", F.coalesce("sources", F.lit(NO_SOURCES)).alias("sources"))


def _also(limit: int, label: str) -> Column:
    """Other names of a node, in order; empty where there are none."""
    names = F.slice(F.array_sort(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != F.col("name")))), 1, limit)
    return F.when(F.size(names) > 0, F.concat(F.lit(f" [{label}: "), F.array_join(names, ", "), F.lit("]"))).otherwise(F.lit(""))


def _described() -> Column:
    return F.coalesce(F.when(F.col("description") != "", F.col("description")), F.lit(NO_DESCRIPTION))


def prompt_entities(top: DataFrame) -> DataFrame:
    """query_id, entities: a line for each of a question's first nodes."""
    line = F.concat(F.lit("- "), "name", F.lit(" ("), F.coalesce("entity_type", F.lit("")), F.lit(")"), _also(PROMPT_LIMITS["aliases"], "also known as"), F.lit(": "), X.byte_prefix(_described(), PROMPT_LIMITS["bytes"]), F.lit("\n"))
    lines = top.where((F.col("rank") <= PROMPT_LIMITS["nodes"]) & F.col("name").isNotNull()).select("query_id", F.col("rank").alias("place"), line.alias("line"))
    return top.select("query_id").distinct().join(_text(lines, "entities"), "query_id", "left").select("query_id", F.coalesce("entities", F.lit(NO_ENTITIES)).alias("entities"))


def _edge_line(start: str, span: Column) -> Column:
    return F.concat(F.lit(start), "source_id", F.lit(" --["), F.coalesce("relation_type", F.lit("")), F.lit("]--> "), "target_id", F.when(span != "", F.concat(F.lit(" "), span)).otherwise(F.lit("")), F.lit("\n"))


def _first_edges(edges: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("id")
    return edges.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def prompt_relationships(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, relationships: a line with its years for each of a question's first edges (in order of id)."""
    from noetia.operators.context import validity_span

    e = _first_edges(edges.where("source_id is not null and target_id is not null"), PROMPT_LIMITS["edges"])
    text = _text(e.withColumn("line", _edge_line("- ", validity_span(" → ", ""))), "relationships")
    return questions.select("query_id").distinct().join(text, "query_id", "left").select("query_id", F.coalesce("relationships", F.lit(NO_RELATIONS)).alias("relationships"))


def entity_context(top: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, context: source texts, entities and relationships of a question's nodes, for the prompt of an answer.

    ``top``: query_id, rank, id, name, entity_type, description, aliases, properties; ``edges``: query_id and edge columns.
    Of the first edges (in order of id) those that touch a node of the question come out.
    """
    from noetia.operators.context import validity_span

    lim = CONTEXT_LIMITS
    c = _chunks(top, lim["chunk_nodes"], lim["chunks"])
    chunk = F.concat(F.lit("\n[Source "), F.col("place").cast("string"), F.lit("]:\n"), X.byte_prefix("chunk", lim["chunk_bytes"]), F.lit("\n"))
    times = F.get_json_object("properties", "$.occurrence_count").try_cast("int")
    seen = F.when(times > 1, F.concat(F.lit("  [Mentioned "), times.cast("string"), F.lit(" times across documents]\n"))).otherwise(F.lit(""))
    node = F.concat(F.lit("\n• "), "name", F.lit(" ("), F.coalesce("entity_type", F.lit("")), F.lit(")"), _also(lim["aliases"], "Also known as"), F.lit("\n  Description: "), _described(), F.lit("\n"), seen)
    nodes = top.where((F.col("rank") <= lim["nodes"]) & F.col("name").isNotNull()).select("query_id", F.col("rank").alias("place"), node.alias("line"))
    ends = top.select("query_id", "id").distinct()
    first = _first_edges(edges.where("source_id is not null and target_id is not null"), lim["edges"])
    hit = first.join(ends.select("query_id", F.col("id").alias("source_id"), F.lit(True).alias("_s")), ["query_id", "source_id"], "left").join(ends.select("query_id", F.col("id").alias("target_id"), F.lit(True).alias("_t")), ["query_id", "target_id"], "left").where("_s or _t")
    detail = F.when(F.col("description") != "", F.concat(F.lit("  Detail: "), "description", F.lit("\n"))).otherwise(F.lit(""))
    rel = hit.withColumn("line", F.concat(_edge_line("• ", validity_span(" → ")), detail))
    have = first.select("query_id").distinct().withColumn("_e", F.lit("\n\n## RELATIONSHIPS\n"))
    out = top.select("query_id").distinct()
    for part, df in (("a", c.withColumn("line", chunk)), ("b", nodes), ("c", rel)):
        out = out.join(_text(df, part), "query_id", "left")
    out = out.join(have, "query_id", "left")
    head = F.when(F.col("a") != "", F.concat(F.lit("## ORIGINAL SOURCE TEXT (contains full details)\n"), "a")).otherwise(F.lit(""))
    return out.select("query_id", F.concat(head, F.lit("\n\n## EXTRACTED ENTITIES\n"), F.coalesce("b", F.lit("")), F.coalesce("_e", F.lit("")), F.coalesce("c", F.lit(""))).alias("context"))


def cached_search(cache, nodes: DataFrame, queries: list[MemoryQuery], now: Column, user_id: str, memory_id: str, top_k: int = 10, floor: float = 0.5, filters: dict | None = None) -> DataFrame:
    """:func:`semantic_search` through a cache table: query_id, id, score, rank. Questions whose results are cached and have
    not expired aren't searched again; only results that aren't empty are stored, and only for a named memory."""
    import json

    spark = nodes.sparkSession
    asked = spark.createDataFrame([(q.query_id, q.query) for q in queries], "query_id int, query string")
    rest = F.lit(json.dumps(filters or {}, sort_keys=True, separators=(",", ":")))
    key = F.concat_ws(":", F.lit("search"), F.lit(user_id), F.lit(memory_id), X.search_key(F.col("query"), F.lit(top_k), F.lit(floor), rest))
    asked = asked.withColumn("key", key)
    kind = "array<struct<id:string,score:double,rank:int>>"
    if not memory_id:
        return semantic_search(nodes, queries, now, top_k, floor, filters).select("query_id", "id", "score", "rank")
    hit = cut(cache.get(asked, now).join(asked, "key").select("query_id", F.from_json("value", kind).alias("v")))
    known = {r["query_id"] for r in hit.select("query_id").collect()}  # at most a batch of questions
    old = hit.select("query_id", F.explode("v").alias("x")).select("query_id", "x.*")
    todo = [q for q in queries if q.query_id not in known]
    if not todo:
        return old
    new = cut(semantic_search(nodes, todo, now, top_k, floor, filters).select("query_id", "id", "score", "rank"))
    found = new.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("rank", "id", "score")))).alias("value"))
    cache.put(found.join(asked, "query_id").select("key", "value"), now)
    return old.unionByName(new)


def semantic_score(now: Column) -> tuple[Column, Column]:
    """(ranking score, similarity with the alias boost, capped at 1)."""
    q = F.lower("query")
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>"))
    words = lambda c: F.split(F.lower(c), r"\s+")
    has = F.size(aliases) > 0
    inside = F.exists(aliases, lambda a: F.contains(q, F.lower(a)))
    shared = F.exists(aliases, lambda a: F.arrays_overlap(words(a), words(F.col("query"))))
    named = has & (F.contains(q, F.lower(F.coalesce("canonical_name", "name"))) | F.contains(q, F.lower("name")))
    boost = F.greatest(F.when(inside, 0.30).otherwise(0.0), F.when(shared, 0.15).otherwise(0.0), F.when(named, 0.25).otherwise(0.0))
    sim = X.cosine("embedding", "q_embedding")
    hours = (F.unix_micros(now) - F.unix_micros(F.col("accessed_at").cast("timestamp"))) / F.lit(3_600_000_000.0)
    recent = F.when(hours < 24, 0.1 * (1 - hours / 24)).otherwise(0.0)
    used = F.least(F.lit(0.1), 0.01 * F.coalesce("access_count", F.lit(0)))
    score = 0.5 * sim + 0.25 * F.col("importance") / 10.0 + 0.15 * (boost * 3.33) + recent + used
    return score, F.least(F.lit(1.0), sim + boost)


def semantic_search(nodes: DataFrame, queries: list[MemoryQuery], now: Column, top_k: int = 10, floor: float = 0.5, filters: dict | None = None) -> DataFrame:
    d = _asked(nodes.where((F.col("importance") != 0) & X.matches_filters(filters or {})), queries)
    score, near = semantic_score(now)
    d = d.select("query_id", "id", F.round(score, 6).alias("score"), near.alias("near")).where((F.col("near") >= floor) & F.col("score").isNotNull())
    return _top(d.drop("near"), top_k)


def vector_search(nodes: DataFrame, queries: list[MemoryQuery], top_k: int = 10, floor: float | None = None, keep_ephemeral: bool = False, over_fetch: int | None = None, single: bool = False) -> DataFrame:
    """Top nodes by cosine alone. With ``over_fetch`` the tenant's floor applies after a first cut to so many rows and
    ephemeral nodes leave last, so fewer than ``top_k`` may come out."""
    d = _asked(nodes if over_fetch or keep_ephemeral else nodes.where(F.col("importance") != 0), queries)
    d = d.select("query_id", "id", "importance", F.round(X.cosine("embedding", "q_embedding", single), 6).alias("score"))
    if over_fetch:
        d = _top(d, over_fetch).drop("rank")
    if floor is not None:
        d = d.where(F.col("score") >= floor)
    out = _top(d, top_k)
    return (out.where(F.col("importance") != 0) if over_fetch else out).drop("importance")


def similar_names(nodes: DataFrame, queries: list[MemoryQuery], top_k: int = 10) -> DataFrame:
    """Names nearest to the question; the best vector of a name counts."""
    d = _asked(nodes, queries).groupBy("query_id", F.col("name").alias("id")).agg(F.round(F.max(X.cosine("embedding", "q_embedding")), 6).alias("score"))
    return _top(d, top_k).withColumnRenamed("id", "name")


# -- many query vectors against all rows -----------------------------------------------------------------------------------
BASE_BLOCK = 20_000


def exact_top_k(queries: DataFrame, base: DataFrame, k: int, floor: float | None = None, block_rows: int = BASE_BLOCK) -> DataFrame:
    """query_id, id, score, rank: the exact k nearest by cosine of every row of ``queries(query_id, vec)`` among
    ``base(id, vec)``, a row never its own neighbour.

    The base is cut into blocks of about ``block_rows``; each query visits every block once and brings back its k best, so
    no task holds more than a block. Vectors of another length than the first usable one of a block and zero vectors give
    a score of 0 and are left out.
    """
    nb = max(1, -(-base.count() // block_rows))
    b = base.select(F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("block"), F.lit(0).cast("tinyint").alias("kind"), F.col("id").cast("string").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("block"), F.lit(1).cast("tinyint").alias("kind"), F.col("query_id").cast("string").alias("id"), F.col("vec").cast("array<float>").alias("vec"))

    def unit(vs):
        dim = max((len(v) for v in vs if v), default=0)
        m = np.zeros((len(vs), dim))
        for i, v in enumerate(vs):
            if v is not None and len(v) == dim and None not in v:
                m[i] = v
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.where((n > 0) & np.isfinite(n), m / np.where(n > 0, n, 1), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vecs, m = None, [], [], None
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            asked: list[tuple] = []

            def answer():
                nonlocal m
                if not asked or not ids:
                    asked.clear()
                    return None
                if m is None:
                    m = unit(vecs)
                u = unit([v for _, v in asked])
                if u.shape[1] != m.shape[1]:
                    asked.clear()
                    return None
                s = u @ m.T
                names = np.array(ids, object)
                qi, ni, sc = [], [], []
                for i, (qid, _) in enumerate(asked):
                    row = s[i]
                    ok = (names != qid) & (row != 0) if floor is None else (names != qid) & (row >= floor - 1e-9)
                    at = np.flatnonzero(ok)
                    if len(at) > k:
                        cut = np.partition(row[at], len(at) - k)[len(at) - k]
                        at = at[row[at] >= cut - 1e-6]  # ties are settled by id, over all blocks
                    qi += [qid] * len(at)
                    ni += names[at].tolist()
                    sc += row[at].tolist()
                asked.clear()
                return pa.RecordBatch.from_arrays([pa.array(qi, pa.string()), pa.array(ni, pa.string()), pa.array(sc, pa.float64())], names=["query_id", "id", "score"])

            for blk, kind, i, v in rows:
                if blk != block:
                    if (out := answer()) is not None:
                        yield out
                    block, ids, vecs, m = blk, [], [], None
                if kind == 0:
                    ids.append(i), vecs.append(v)
                else:
                    asked.append((i, v))
                    if len(asked) >= 512 and (out := answer()) is not None:
                        yield out
            if (out := answer()) is not None:
                yield out

    found = b.unionByName(q).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, "query_id string, id string, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("id"), "id")
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
