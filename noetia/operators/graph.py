"""Property-graph tables: builders, lookups, mutation, joins and aggregations over nodes, edges and clusters."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noetia.functions import expr as X
from noetia.schemas import EDGES, NODES
from noetia.session import cut


def with_defaults(df: DataFrame, schema, values: dict[str, Column]) -> DataFrame:
    """The canonical columns in order: given ones cast, missing ones from ``values`` or null."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        if f.name in values:
            c = F.coalesce(c, values[f.name]) if f.name in have else values[f.name]
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def new_nodes(df: DataFrame, memory_id: str, user_id: str = "default", now: Column | None = None) -> DataFrame:
    """Nodes with defaults: medium importance, active, own name as canonical name and alias, id from its content."""
    now = F.current_timestamp() if now is None else now
    d = with_defaults(df, NODES, {"memory_id": F.lit(memory_id), "user_id": F.lit(user_id), "importance": F.lit(5), "state": F.lit("ACTIVE"), "access_count": F.lit(0), "created_at": now, "updated_at": now, "accessed_at": now, "properties": F.lit("{}")})
    d = d.withColumn("canonical_name", F.coalesce("canonical_name", "name")).withColumn("aliases", F.coalesce("aliases", F.array("name")))
    return d.withColumn("id", F.coalesce("id", X.node_id()))


def new_edges(df: DataFrame, memory_id: str, now: Column | None = None) -> DataFrame:
    """Edges with defaults: weight and confidence 1, medium importance, active."""
    now = F.current_timestamp() if now is None else now
    d = with_defaults(df, EDGES, {"memory_id": F.lit(memory_id), "weight": F.lit(1.0), "confidence": F.lit(1.0), "importance": F.lit(5), "state": F.lit("ACTIVE"), "access_count": F.lit(0), "created_at": now, "updated_at": now, "accessed_at": now, "properties": F.lit("{}")})
    return d.withColumn("id", F.coalesce("id", X.edge_id()))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("memory_id", "id")) -> DataFrame:
    """Rows of ``new`` replace those with the same key; the others stay."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def touching(edges: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Edges with an end in ``ids(id)``: ``any``, ``both`` or ``none``. OR is a union of two semi joins."""
    i = ids.select("id").distinct()
    s, t = i.withColumnRenamed("id", "source_id"), i.withColumnRenamed("id", "target_id")
    if how == "both":
        return edges.join(s, "source_id", "left_semi").join(t, "target_id", "left_semi").select(edges.columns)
    if how == "none":
        return edges.join(s, "source_id", "left_anti").join(t, "target_id", "left_anti").select(edges.columns)
    by_source = edges.join(s, "source_id", "left_semi").select(edges.columns)
    by_target = edges.join(s, "source_id", "left_anti").join(t, "target_id", "left_semi").select(edges.columns)
    return by_source.unionByName(by_target)


@dataclass(frozen=True)
class MemoryGraph:
    """A memory as tables. Every change gives a new graph; the old one stays as it was."""

    nodes: DataFrame
    edges: DataFrame
    clusters: DataFrame | None = None
    memory_id: str = ""
    version: int = 1

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def edge(self, edge_id: str) -> DataFrame:
        return self.edges.where(F.col("id") == edge_id)

    def add_nodes(self, rows: DataFrame) -> MemoryGraph:
        return replace(self, nodes=upsert(self.nodes, rows))

    def add_edges(self, rows: DataFrame) -> MemoryGraph:
        return replace(self, edges=upsert(self.edges, rows))

    def remove_nodes(self, ids: DataFrame) -> MemoryGraph:
        """Without the nodes and every edge that touches them."""
        return replace(self, nodes=self.nodes.join(ids.select("id"), "id", "left_anti"), edges=touching(self.edges, ids, "none"))

    def remove_edges(self, ids: DataFrame) -> MemoryGraph:
        return replace(self, edges=self.edges.join(ids.select("id"), "id", "left_anti"))

    def record_access(self, hits: DataFrame, now: Column) -> MemoryGraph:
        """``hits(id, hits)``: access counts grow, the last access becomes ``now``."""
        n = self.nodes.join(hits.groupBy("id").agg(F.sum("hits").alias("_h")), "id", "left")
        n = n.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_h", F.lit(0))).withColumn("accessed_at", F.when(F.col("_h") > 0, F.greatest("accessed_at", now)).otherwise(F.col("accessed_at")))
        return replace(self, nodes=n.drop("_h").select(self.nodes.columns))

    def update_node(self, node_id: str, now: Column, **values) -> MemoryGraph:
        """Sets name, description, importance; every other key goes into the properties."""
        own = {k: v for k, v in values.items() if k in ("name", "description", "importance")}
        hit = F.col("id") == node_id
        n = self.nodes
        for k, v in own.items():
            n = n.withColumn(k, F.when(hit, F.lit(v)).otherwise(F.col(k)))
        rest = {k: str(v) for k, v in values.items() if k not in own}
        if rest:
            n = n.withColumn("properties", F.when(hit, X.json_merge("properties", F.to_json(F.create_map(*[F.lit(x) for kv in rest.items() for x in kv])))).otherwise(F.col("properties")))
        return replace(self, nodes=n.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))))

    def counts(self) -> DataFrame:
        parts = [("nodes", self.nodes), ("edges", self.edges)] + ([("clusters", self.clusters)] if self.clusters is not None else [])
        out = None
        for k, df in parts:
            row = df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
            out = row if out is None else out.union(row)
        return out


def graph_view(g: MemoryGraph) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What a user interface shows of nodes, edges and clusters."""
    n = g.nodes.select("id", "name", F.col("entity_type").alias("type"), "description", "importance", "state")
    e = g.edges.select("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("relation"), "weight", "confidence")
    c = None if g.clusters is None else g.clusters.select("id", "summary", F.size("entities").alias("size"))
    return n, e, c


def supersede(edges: DataFrame, hit: Column, at: Column) -> DataFrame:
    """Matching edges end at ``at`` and are archived; ``matched`` tells which."""
    m = F.col("matched")
    return edges.withColumn("matched", F.coalesce(hit, F.lit(False))).withColumn("valid_until", F.when(m, at).otherwise(F.col("valid_until"))).withColumn("state", F.when(m, F.lit("ARCHIVED")).otherwise(F.col("state")))


# -- joins -----------------------------------------------------------------------------------------------------------------
def name_index(nodes: DataFrame) -> DataFrame:
    """(memory_id, term, id): every name and alias in lower case with the node that answers to it; the largest id on ties."""
    terms = F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term")
    t = nodes.select("memory_id", "id", terms).where("term is not null").select("memory_id", F.lower("term").alias("term"), "id")
    return t.groupBy("memory_id", "term").agg(F.max("id").alias("id"))


def resolve_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are written as names get the nodes' ids and an id of their own; unknown ends drop the edge."""
    idx = name_index(nodes)
    s = idx.select("memory_id", F.col("term").alias("_s"), F.col("id").alias("_sid"))
    t = idx.select("memory_id", F.col("term").alias("_t"), F.col("id").alias("_tid"))
    e = edges.withColumn("_s", F.lower("source_id")).withColumn("_t", F.lower("target_id")).join(s, ["memory_id", "_s"]).join(t, ["memory_id", "_t"])
    e = e.withColumn("source_id", F.col("_sid")).withColumn("target_id", F.col("_tid"))
    return e.withColumn("id", X.edge_id()).select(edges.columns)


def community_neighbourhood(clusters: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, node_id, member): members by name, and their one-hop neighbours."""
    named = clusters.select("memory_id", F.col("id").alias("cluster_id"), F.explode("entities").alias("name")).distinct()
    members = named.join(nodes.select("memory_id", "name", F.col("id").alias("node_id")), ["memory_id", "name"]).select("cluster_id", "node_id").distinct()
    out = members.join(edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other")), "node_id").select("cluster_id", F.col("other").alias("node_id"))
    back = members.join(edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("other")), "node_id").select("cluster_id", F.col("other").alias("node_id"))
    known = nodes.select(F.col("id").alias("node_id")).distinct()
    near = out.union(back).distinct().join(known, "node_id", "left_semi").join(members, ["cluster_id", "node_id"], "left_anti")
    return members.withColumn("member", F.lit(True)).unionByName(near.select("cluster_id", "node_id").withColumn("member", F.lit(False)))


#: Edges per middle node and side from which the bound of :func:`transitive_links` is found.
BOUND_EDGES = 32


def _paths(a: DataFrame, b: DataFrame, have: DataFrame) -> DataFrame:
    """One path per pair of ends that have no edge yet: the most confident, then the smallest middle node."""
    path = a.join(b, ["memory_id", "b"]).where("a <> c").select("memory_id", "a", "b", "c", (F.least("w1", "w2") * 0.5).alias("weight"), (F.col("c1") * F.col("c2") * 0.8).alias("confidence"))
    key = F.struct(F.round(-F.col("confidence"), 9).alias("k"), "b", "weight")
    best = path.groupBy("memory_id", "a", "c").agg(F.min(key).alias("x"))  # partial sums keep a hub's paths small
    best = best.join(have, ["memory_id", "a", "c"], "left_anti")
    return best.select("memory_id", F.col("a").alias("source_id"), F.col("x.b").alias("via_id"), F.col("c").alias("target_id"), "x.weight", (-F.col("x.k")).alias("confidence"))


def transitive_links(edges: DataFrame, min_confidence: float = 0.7, limit: int | None = 10) -> DataFrame:
    """A to C over a middle node, both edges confident, without an edge from A to C yet. One path per pair (highest
    confidence, then the middle node's id); the ``limit`` best per memory.

    A hub's edges in and out would all be paired. With a limit, the best edges of each middle node alone give a confidence
    that the result can't fall below; of all edges only those that can reach it with the best partner are then paired.
    """
    e = edges.where((F.col("state") == "ACTIVE") & (F.col("confidence") >= min_confidence)).select("memory_id", "source_id", "target_id", "weight", "confidence")
    have = edges.select("memory_id", F.col("source_id").alias("a"), F.col("target_id").alias("c")).distinct()
    if limit is not None:
        e, have = cut(e), cut(have)
    a = e.select("memory_id", F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("weight").alias("w1"), F.col("confidence").alias("c1"))
    b = e.select("memory_id", F.col("source_id").alias("b"), F.col("target_id").alias("c"), F.col("weight").alias("w2"), F.col("confidence").alias("c2"))
    if limit is None:
        return _paths(a, b, have)
    w = Window.partitionBy("memory_id").orderBy(F.desc("confidence"), "source_id", "target_id")
    top = lambda p: p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    first = lambda df, c, end: df.withColumn("_r", F.row_number().over(Window.partitionBy("memory_id", "b").orderBy(F.desc(c), end))).where(F.col("_r") <= BOUND_EDGES).drop("_r")
    bound = top(_paths(first(a, "c1", "a"), first(b, "c2", "c"), have)).where(F.col("rank") == limit).select("memory_id", (F.col("confidence") - 1e-8).alias("bound"))
    bound = cut(bound)
    reach = lambda df, c, other, best: df.join(other.groupBy("memory_id", "b").agg(F.max(best).alias("_best")), ["memory_id", "b"]).join(bound, "memory_id", "left").where(F.col(c) * F.col("_best") * 0.8 >= F.coalesce("bound", F.lit(0.0))).drop("_best", "bound")
    return top(_paths(reach(a, "c1", b, "c2"), reach(b, "c2", a, "c1"), have)).drop("rank")


def remap_endpoints(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """``merged(old_id, new_id)``: both ends follow the nodes that took others over."""
    s = merged.select(F.col("old_id").alias("source_id"), F.col("new_id").alias("_s"))
    t = merged.select(F.col("old_id").alias("target_id"), F.col("new_id").alias("_t"))
    e = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    return e.withColumn("source_id", F.coalesce("_s", "source_id")).withColumn("target_id", F.coalesce("_t", "target_id")).select(edges.columns)


def with_known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist in their memory, as a graph store keeps them."""
    k = nodes.select("memory_id", "id").distinct()
    return edges.join(k.withColumnRenamed("id", "source_id"), ["memory_id", "source_id"], "left_semi").join(k.withColumnRenamed("id", "target_id"), ["memory_id", "target_id"], "left_semi").select(edges.columns)


# -- aggregations ----------------------------------------------------------------------------------------------------------
def reinforce_edges(edges: DataFrame) -> DataFrame:
    """Repeated (source, target, relation) as one edge: the strongest survives with the capped sum of weights and the
    raised mean confidence."""
    key = ["memory_id", "source_id", "target_id", "relation_type"]
    strength = F.struct("weight", "confidence", "id")
    g = edges.groupBy(*key).agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.avg("confidence").alias("c"), F.max(strength).alias("best"))
    return g.where("n > 1").select(*key, "n", F.col("best.id").alias("kept_id"), F.least(F.lit(10.0), "w").alias("weight"), F.least(F.lit(1.0), F.col("c") * 1.1).alias("confidence"))


#: Fields that a merged node takes from its group.
MERGED = ("name", "aliases", "access_count", "importance", "description")


def merge_nodes(nodes: DataFrame, group: str) -> DataFrame:
    """One node per ``group``: all aliases and names, accesses summed, highest importance, longest description; the name
    is the longest (then most accessed, then smallest id)."""
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    best = F.min(F.struct((-F.octet_length("name")).alias("a"), (-F.coalesce("access_count", F.lit(0))).alias("b"), "id", "name"))
    g = nodes.groupBy(group).agg(
        best.alias("x"),
        F.count("*").alias("n_merged"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(names)))).alias("aliases"),
        F.sum(F.coalesce("access_count", F.lit(0))).alias("access_count"),
        F.max("importance").alias("importance"),
        F.max(F.struct(F.octet_length("description").alias("n"), F.col("description").alias("d"))).alias("y"),
    )
    return g.select(group, F.col("x.id").alias("id"), F.col("x.name").alias("name"), "n_merged", F.filter("aliases", lambda a: a.isNotNull()).alias("aliases"), "access_count", "importance", F.col("y.d").alias("description"), F.lit("ACTIVE").alias("state"))


def importance_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("memory_id", X.importance_label("importance").alias("label")).agg(F.count("*").alias("n_nodes"))


def memory_stats(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    state = lambda s: F.count_if(F.col("state") == s)
    n = nodes.groupBy("memory_id").agg(F.count("*").alias("n_nodes"), state("ACTIVE").alias("n_active"), state("ARCHIVED").alias("n_archived"), state("DELETED").alias("n_deleted"))
    e = edges.groupBy("memory_id").agg(F.count("*").alias("n_edges"))
    c = clusters.groupBy("memory_id").agg(F.count("*").alias("n_clusters"))
    out = n.join(e, "memory_id", "full").join(c, "memory_id", "full")
    return out.select("memory_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("n_nodes", "n_active", "n_archived", "n_deleted", "n_edges", "n_clusters")])


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at either end; a self loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def throughput(results: DataFrame, seconds: float) -> DataFrame:
    """One row of an ingestion's statistics from its results per document (see :func:`ingest_rollup`) and the time it took."""
    n = F.count("*")
    return results.agg(
        F.count_if("success").alias("processed"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum("n_entities"), F.lit(0)).alias("total_entities"),
        F.coalesce(F.sum("n_relations"), F.lit(0)).alias("total_relations"),
        F.lit(float(seconds)).alias("seconds"),
        F.when(n > 0, F.lit(1000.0 * seconds) / n).otherwise(F.lit(0.0)).alias("ms_per_document"),
        (n / F.lit(float(seconds)) if seconds > 0 else F.lit(0.0)).alias("documents_per_second"),
    )


def ingest_rollup(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Per document: chunks, entities, relations, success (anything found) and the first error otherwise."""
    r = results.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("n_entities").alias("n_entities"), F.sum("n_relations").alias("n_relations"), F.min("error").alias("error"))
    d = documents.select("doc_id").join(r, "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    ok = (n("n_entities") + n("n_relations")) > 0
    return d.select("doc_id", n("n_chunks").alias("n_chunks"), n("n_entities").alias("n_entities"), n("n_relations").alias("n_relations"), ok.alias("success"), F.when(~ok, F.col("error")).alias("error"))
