"""Communities: adjacency, synchronous modularity moves and label propagation, metrics and summaries.

Both detectors are rounds of joins and aggregations over the edge table, so a memory of any size is spread over tasks; for
modularity, a memory of up to ``TASK_ROWS`` nodes and edges is one task, which runs the same rounds over arrays.
In a round only the nodes of one hash half move, which keeps neighbours from swapping places for ever. Rounds end when
neither half moves, on the test data after about twenty, or after a hundred.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noetia.session import cut, drop_cut

TASK_ROWS = 1_000_000
_PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def adjacency(edges: DataFrame) -> DataFrame:
    """(memory_id, u, v, w) in both directions without self loops; of parallel edges the one with the largest id counts."""
    return _both(_single(edges))


def _single(edges: DataFrame) -> DataFrame:
    e = edges.where("source_id <> target_id").select("memory_id", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.coalesce("weight", F.lit(1.0)).alias("w"), "id")
    return e.groupBy("memory_id", "a", "b").agg(F.max_by("w", "id").alias("w"))


def _both(one: DataFrame) -> DataFrame:
    return one.select("memory_id", F.col("a").alias("u"), F.col("b").alias("v"), "w").union(one.select("memory_id", F.col("b").alias("u"), F.col("a").alias("v"), "w"))


def total_weight(adj: DataFrame) -> DataFrame:
    """Undirected edge weight per memory; 1 where it is 0."""
    t = adj.groupBy("memory_id").agg((F.sum("w") / 2).alias("t"))
    return t.select("memory_id", F.when(F.col("t") == 0, 1.0).otherwise(F.col("t")).alias("total_weight"))


def _rounds(nodes: DataFrame, adj: DataFrame, step, rounds: int) -> DataFrame:
    label = cut(nodes.select("memory_id", F.col("id").alias("u")).distinct().withColumn("label", F.col("u")))
    adj = cut(adj.join(label.select("u"), "u", "left_semi").join(label.select(F.col("u").alias("v")), "v", "left_semi"))
    still = False
    for i in range(rounds):
        moves = step(label, adj).where(F.pmod(F.xxhash64("u", F.lit(i // 2)), F.lit(2)) == i % 2)
        moved = label.join(moves, ["memory_id", "u"], "left").select("memory_id", "u", F.coalesce("to", "label").alias("label"), (F.col("to").isNotNull() & (F.col("to") != F.col("label"))).alias("moved"))
        moved = cut(moved)
        n = moved.where("moved").limit(1).count()
        drop_cut(label)
        label = moved.drop("moved")
        label._noetia_path = moved._noetia_path
        if i % 2 and still and not n:  # neither half moves
            break
        still = not n
    return label.select("memory_id", F.col("u").alias("id"), F.col("label").alias("community"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(memory_id, id, community): each node takes the label with the most weight among its neighbours, the smallest on
    ties; nodes without neighbours stay alone."""

    def step(label, adj):
        near = adj.join(label.select("memory_id", F.col("u").alias("v"), F.col("label").alias("l")), ["memory_id", "v"]).groupBy("memory_id", "u", "l").agg(F.sum("w").alias("w"))
        return near.groupBy("memory_id", "u").agg(F.min(F.struct((-F.round("w", 9)).alias("k"), "l")).alias("x")).select("memory_id", "u", F.col("x.l").alias("to"))

    return _rounds(nodes, adjacency(edges), step, rounds)


def _half(seed: np.ndarray, k: int) -> np.ndarray:
    """The last bit of ``xxhash64(u, k)``, where ``seed`` is ``xxhash64(u)``."""
    p1, p2, p3, p5 = _PRIMES
    h = (seed.view(np.uint64) + p5 + np.uint64(4)) ^ np.uint64(k * int(p1) % (1 << 64))
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return ((h ^ h >> np.uint64(32)) & np.uint64(1)).astype(int)


def _modularity_of_memory(rounds: int):
    """The rounds of :func:`_modularity` for one memory: nodes are numbered in order of id, so ties go the same way."""

    def move(key, nodes, edges):
        nodes = nodes.sort_by("u")
        ids, n = nodes["u"].combine_chunks(), nodes.num_rows
        seed, label = nodes["seed"].to_numpy(), np.arange(n)
        a, b = (pc.fill_null(pc.index_in(edges[c], ids), -1).to_numpy() for c in "ab")
        w = edges["w"].to_numpy()
        total = w.sum() or 1.0
        deg = np.bincount(a[a >= 0], w[a >= 0], n) + np.bincount(b[b >= 0], w[b >= 0], n)
        known = (a >= 0) & (b >= 0)
        u, v, w = np.concatenate([a[known], b[known]]), np.concatenate([b[known], a[known]]), np.concatenate([w[known]] * 2)
        still = False
        for i in range(rounds if len(u) else 0):
            e = np.flatnonzero((_half(seed, i // 2) == i % 2)[u])
            moved = False
            if len(e):
                pair = u[e] * np.int64(n) + label[v[e]]
                order = np.argsort(pair, kind="stable")
                pair = pair[order]
                first = np.flatnonzero(np.diff(pair, prepend=-1))
                win, x, to = np.add.reduceat(w[e][order], first), pair[first] // n, pair[first] % n
                mine = to == label[x]
                strength = np.bincount(label, deg / 2, n)[to] - np.where(mine, deg[x] / 2, 0.0)
                gain = np.round((win - deg[x] * strength / total) / total, 12)
                stay = np.zeros(n)
                stay[x[mine]] = gain[mine]
                x, to, gain = x[~mine], to[~mine], gain[~mine]
                order = np.lexsort((to, -gain, x))
                x, to, gain = x[order], to[order], gain[order]
                go = (np.diff(x, prepend=-1) > 0) & (gain > 0) & (gain > stay[x])
                label[x[go]] = to[go]
                moved = bool(go.any())
            if i % 2 and still and not moved:
                break
            still = not moved
        return pa.table({"memory_id": pa.array([key[0].as_py()] * n, pa.string()), "id": ids.cast(pa.string()), "community": ids.take(pa.array(label)).cast(pa.string())})

    return move


def _modularity(nodes: DataFrame, adj: DataFrame, rounds: int) -> DataFrame:
    degree = cut(adj.groupBy("memory_id", "u").agg(F.sum("w").alias("deg")))
    total = cut(total_weight(adj))

    def step(label, a):
        size = label.join(degree, ["memory_id", "u"]).groupBy("memory_id", F.col("label").alias("l")).agg((F.sum("deg") / 2).alias("s"))
        near = a.join(label.select("memory_id", F.col("u").alias("v"), F.col("label").alias("l")), ["memory_id", "v"]).groupBy("memory_id", "u", "l").agg(F.sum("w").alias("win"))
        own = label.join(degree, ["memory_id", "u"])
        g = near.join(own, ["memory_id", "u"]).join(size, ["memory_id", "l"]).join(total, "memory_id")
        mine = F.col("l") == F.col("label")
        strength = F.col("s") - F.when(mine, F.col("deg") / 2).otherwise(0.0)
        g = g.select("memory_id", "u", "l", "label", F.round((F.col("win") - F.col("deg") * strength / F.col("total_weight")) / F.col("total_weight"), 12).alias("gain"))
        stay = g.where(F.col("l") == F.col("label")).select("memory_id", "u", F.col("gain").alias("stay"))
        best = g.where(F.col("l") != F.col("label")).groupBy("memory_id", "u").agg(F.min(F.struct((-F.col("gain")).alias("k"), "l")).alias("x"))
        b = best.join(stay, ["memory_id", "u"], "left")
        return b.where((-F.col("x.k") > 0) & (-F.col("x.k") > F.coalesce("stay", F.lit(0.0)))).select("memory_id", "u", F.col("x.l").alias("to"))

    return _rounds(nodes, adj, step, rounds)


def greedy_modularity(nodes: DataFrame, edges: DataFrame, rounds: int = 100, max_size: int = 100) -> DataFrame:
    """(memory_id, id, community): nodes move to the neighbouring community of the highest positive gain
    ``(in - degree * strength / W) / W``; communities above ``max_size`` are cut into runs of that size in order of id."""
    nodes = cut(nodes.select("memory_id", F.col("id").alias("u"), F.xxhash64("id").alias("seed")).distinct())
    one = cut(_single(edges))
    sizes = nodes.select("memory_id", F.lit(0.0).alias("w")).union(one.select("memory_id", F.abs("w"))).groupBy("memory_id").agg(F.count("*").alias("n"), F.max("w").alias("w"))
    small = cut(sizes.where((F.col("n") <= TASK_ROWS) & (F.col("w") < float("inf"))).select("memory_id"))
    fit = lambda d: d.join(small, "memory_id", "left_semi").groupBy("memory_id")
    found = cut(fit(nodes).cogroup(fit(one)).applyInArrow(_modularity_of_memory(rounds), "memory_id string, id string, community string"))
    rest = cut(nodes.join(small, "memory_id", "left_anti").select("memory_id", F.col("u").alias("id")))
    if rest.limit(1).count():
        found = found.union(_modularity(rest, cut(_both(one.join(small, "memory_id", "left_anti"))), rounds))
    w = Window.partitionBy("memory_id", "community").orderBy("id")
    part = F.floor((F.row_number().over(w) - 1) / F.lit(max_size)).cast("int")
    return found.select("memory_id", "id", F.concat_ws("#", "community", part.cast("string")).alias("community"))


def detect(nodes: DataFrame, edges: DataFrame, algorithm: str = "greedy_modularity", **options) -> DataFrame:
    return (label_propagation if algorithm == "label_propagation" else greedy_modularity)(nodes, edges, **options)


def cluster_metrics(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """memory_id, community, n, internal (undirected edges inside), coherence; a single node coheres fully."""
    m = membership.select("memory_id", "id", "community")
    adj = adjacency(edges)
    inside = adj.join(m.withColumnRenamed("id", "u"), ["memory_id", "u"]).join(m.select("memory_id", F.col("id").alias("v"), F.col("community").alias("c2")), ["memory_id", "v"]).where(F.col("community") == F.col("c2"))
    inside = inside.groupBy("memory_id", "community").agg((F.count("*") / 2).alias("internal"))
    size = m.groupBy("memory_id", "community").agg(F.count("*").alias("n"))
    j = size.join(inside, ["memory_id", "community"], "left").withColumn("internal", F.coalesce("internal", F.lit(0.0)))
    return j.select("memory_id", "community", "n", "internal", F.when(F.col("n") <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.col("internal") / (F.col("n") * (F.col("n") - 1) / 2))).alias("coherence"))


def cluster_rollup(membership: DataFrame, nodes: DataFrame, edges: DataFrame, min_size: int = 2) -> DataFrame:
    """Communities as cluster rows: names and ids of the members, edges inside, importance, coherence."""
    m = membership.join(nodes.select("id", "name", "importance", "description"), "id")
    g = m.groupBy("memory_id", "community").agg(F.count("*").alias("n"), F.greatest(F.lit(5), F.max("importance")).alias("importance"), F.array_sort(F.collect_list("name")).alias("entities"), F.array_sort(F.collect_list("id")).alias("entity_ids")).where(F.col("n") >= min_size)
    key = membership.select("memory_id", "id", "community")
    e = edges.join(key.withColumnRenamed("id", "source_id"), ["memory_id", "source_id"]).join(key.select("memory_id", F.col("id").alias("target_id"), F.col("community").alias("c2")), ["memory_id", "target_id"]).where(F.col("community") == F.col("c2"))
    e = e.groupBy("memory_id", "community").agg(F.array_sort(F.collect_list("id")).alias("edges"))
    names = F.array_join(F.slice("entities", 1, 5), ", ")
    out = g.join(e, ["memory_id", "community"], "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<string>")))
    return out.withColumn("summary", F.concat(F.lit("Community about: "), names, F.lit(". Contains "), F.col("n").cast("string"), F.lit(" entities and "), F.size("edges").cast("string"), F.lit(" relationships.")))


def top_communities(clusters: DataFrame, n: int) -> DataFrame:
    """The ``n`` most important clusters, smallest id first on ties."""
    return clusters.orderBy(F.desc("importance"), "id").limit(n)
