"""Entity resolution: nodes that mean one entity become one candidate, per tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np

from noetia.functions import expr as X
from noetia.operators.components import connected_components
from noetia.operators.pairs import block_pairs, cosines

# Thresholds of the resolver
TOKEN_LIMIT, COSINE_LIMIT = 0.7, 0.85


def alias_links(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes of a tenant that share a cleaned name or alias, as stars around the smallest id."""
    terms = F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("t")
    t = nodes.select("memory_id", "user_id", "id", F.lower("entity_type").alias("kind"), terms).withColumn("t", F.lower(X.clean_name("t"))).where("t <> ''")
    low = t.groupBy("memory_id", "user_id", "kind", "t").agg(F.min("id").alias("a"))
    return t.join(low, ["memory_id", "user_id", "kind", "t"]).where("id <> a").select(F.col("a"), F.col("id").alias("b")).distinct()


def similarity_links(nodes: DataFrame) -> DataFrame:
    """(a, b): each node of a tenant with its best match among those of smaller id and compatible type.

    A match needs enough token overlap or near vectors; the best is that of the highest score, which is the overlap or,
    if that is more, 0.4 of it and 0.6 of the cosine. An empty type is compatible with all. Names' tokens and aliases' count.
    """
    words = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    tokens = F.array_distinct(F.flatten(F.transform(F.filter(words, lambda x: x.isNotNull()), lambda x: X.entity_tokens(X.clean_name(x)))))
    d = nodes.select("memory_id", "user_id", F.lower(F.coalesce("entity_type", F.lit(""))).alias("kind"), "id", X.entity_tokens(X.clean_name("name")).alias("own"), tokens.alias("tokens"), "embedding")

    def kernel(left, right, same):
        """The smaller id is the candidate, with its aliases' tokens; the larger one is matched by its name's."""
        cos = cosines(left, right)
        pairs = set(zip(*(x.tolist() for x in np.nonzero(cos >= COSINE_LIMIT))))
        index: dict[str, list[int]] = {}
        for j, r in enumerate(right):
            for t in set(r["tokens"] or ()) | set(r["own"] or ()):
                index.setdefault(t, []).append(j)
        for i, r in enumerate(left):
            for t in set(r["tokens"] or ()) | set(r["own"] or ()):
                pairs.update((i, j) for j in index.get(t, ()))
        best: dict[str, tuple[float, str]] = {}
        for i, j in pairs:
            x, y = left[i], right[j]
            if x["id"] == y["id"] or (same and i > j) or (x["kind"] and y["kind"] and x["kind"] != y["kind"]):
                continue
            old, new = (x, y) if x["id"] < y["id"] else (y, x)
            a, b = set(new["own"] or ()), set(old["tokens"] or ())
            overlap = len(a & b) / len(a | b) if a and b else 0.0
            c = float(cos[i, j])
            score = max(overlap, 0.4 * overlap + 0.6 * c) if c > 0 else overlap
            if score > 0 and (overlap >= TOKEN_LIMIT or c >= COSINE_LIMIT):
                got = best.get(new["id"])
                if got is None or (-score, old["id"]) < (-got[0], got[1]):
                    best[new["id"]] = (score, old["id"])
        for b, (score, a) in best.items():
            yield a, b, score

    found = block_pairs(d, ["memory_id", "user_id"], "id", kernel, "a string, b string, score double")
    top = found.groupBy("b").agg(F.min(F.struct((-F.col("score")).alias("s"), "a")).alias("x"))
    return top.select(F.col("x.a").alias("a"), "b")


def resolve(nodes: DataFrame) -> DataFrame:
    """memory_id, user_id, resolved_id, name, entity_type, aliases, n_merged: the final candidates.

    Nodes count as arriving in order of id. A shared name or alias decides; else a node joins its best match before it, and
    stays alone where there is none. What hangs together by these links is one candidate, so no order of rows matters; the name is the
    one with the most words (then the longest, then the smallest id).
    """
    links = alias_links(nodes).union(similarity_links(nodes))
    comp = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    n = nodes.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    words = F.size(F.split(X.clean_name("name"), " "))
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    g = n.groupBy("memory_id", "user_id", "component").agg(
        F.min(F.struct((-words).alias("w"), (-F.length("name")).alias("l"), "id", "name", "entity_type")).alias("x"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(names)))).alias("aliases"),
        F.count("*").alias("n_merged"),
    )
    return g.select("memory_id", "user_id", X.resolver_key(F.col("x.name")).alias("resolved_id"), F.col("x.name").alias("name"), F.col("x.entity_type").alias("entity_type"), "aliases", "n_merged")


def blend_embeddings(nodes: DataFrame, group: str) -> DataFrame:
    """The mean vector of each group, component by component; vectors of other lengths than the longest are left out."""
    dim = nodes.groupBy(group).agg(F.max(F.size("embedding")).alias("dim"))
    v = nodes.join(dim, group).where(F.size("embedding") == F.col("dim")).select(group, F.posexplode("embedding").alias("i", "x"))
    m = v.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"].cast("float")).alias("embedding"))
