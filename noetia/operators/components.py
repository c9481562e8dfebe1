"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetia.session import cut, drop_cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` to ``(node, component)``; component is the smallest node of it.

    Alternates large-star and small-star steps until no edge changes. Each step aggregates with map-side combine and
    joins on the node, so a hub with a large share of all edges is split by AQE's skew join. Null ends and self loops
    add no link; nodes that occur only in self loops come out as their own component. An empty table gives no rows.
    Every round shortens the paths by a constant factor; if ``max_rounds`` don't suffice, an error is raised, never a result
    that isn't final.
    """
    e = edges.select(F.col("src"), F.col("dst")).where("src is not null and dst is not null")
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst"))).distinct()
    cur = cut(e.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    nodes = cut(nodes)
    before = None
    for _ in range(max_rounds):
        nxt = cut(_small_star(_large_star(cur)))
        drop_cut(cur)
        cur = nxt
        now = tuple(cur.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = cur.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("v", "node").alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return sym.join(low, sym.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    d = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = d.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    j = d.join(low, d.u == low.k)
    return j.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
