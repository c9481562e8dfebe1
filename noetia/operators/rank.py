"""PageRank and importance scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from noetia.functions import expr as X
from noetia.session import cut, cut_by, drop_cut

CUT_EVERY = 5
#: Rounds of a job of the weighted PageRank; nodes and edges of a block at most, on average.
ROUNDS, BLOCK_NODES, BLOCK_EDGES = 10, 1 << 19, 1 << 21


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, pagerank), unweighted: every edge counts for its source's out-degree, mass of nodes without edges is lost.

    The edges lie in buckets of their source and the nodes in buckets of their id, so a round moves ranks and their sums
    only; sums are partial before they move, which a target with a large share of all edges needs.
    """
    v = cut_by(nodes.select("id").distinct(), "id")
    n = max(v.count(), 1)
    out = edges.groupBy("source_id").agg(F.count("*").alias("deg"))
    e = cut_by(edges.select("source_id", "target_id").join(out, "source_id").join(v.withColumnRenamed("id", "target_id"), "target_id", "left_semi"), "source_id")
    pr = v.withColumn("pr", F.lit(1.0 / n))
    old = None
    for i in range(iterations):
        got = e.join(pr, e.source_id == pr.id).groupBy("target_id").agg(F.sum(F.col("pr") / F.col("deg")).alias("x"))
        pr = v.join(got, v.id == got.target_id, "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("x", F.lit(0.0))).alias("pr"))
        if i % CUT_EVERY == CUT_EVERY - 1 and i < iterations - 1:
            pr = cut(pr)
            if old is not None:
                drop_cut(old)
            old = pr
    return pr.withColumnRenamed("pr", "pagerank")


def _slots(spark, n: int) -> list[int]:
    """A key for each of ``n`` hash partitions, in their order."""
    got = spark.range(50 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("k")).collect()
    return [k for _, k in sorted((r["p"], r["k"]) for r in got)]


def _numbers(c, kind: str) -> np.ndarray:
    return np.frombuffer(c.as_py(), kind)


def _layout(slots: list[int]):
    """A block's edges, cut by the block of their target: (b, to, src, share, starts, at).

    The edges of ``src`` with ``share`` are in order of their target; ``starts`` is where each of the targets ``at`` begins.
    The row without ``to`` has the number of the block's nodes in ``starts`` and those without edges in ``at``.
    """

    def layout(key, nodes, edges):
        n = nodes.num_rows
        s, tb, t, x, w, k = (edges[c].to_numpy() for c in ("si", "tb", "ti", "x", "w", "k"))
        total, many = np.bincount(s, w, n), np.bincount(s, k, n)
        share = x / np.where(total == 0, many, total)[s]
        order = np.lexsort((s, t, tb))
        s, tb, t, share = s[order].astype("i4"), tb[order], t[order].astype("i4"), share[order]
        rows = [(key[0].as_py(), None, b"", b"", np.array([n], "i4").tobytes(), np.flatnonzero(many == 0).astype("i4").tobytes())]
        for to in slots:
            lo, hi = np.searchsorted(tb, [to, to + 1])
            starts = np.flatnonzero(np.diff(t[lo:hi], prepend=-1)).astype("i4")
            rows.append((key[0].as_py(), to, s[lo:hi].tobytes(), share[lo:hi].tobytes(), starts.tobytes(), t[lo:hi][starts].tobytes()))
        return pa.table([pa.array(c, f) for c, f in zip(zip(*rows), _EDGES.types)], schema=_EDGES)

    return layout


_EDGES = pa.schema([("b", pa.int64()), ("to", pa.int64()), ("src", pa.binary()), ("share", pa.binary()), ("starts", pa.binary()), ("at", pa.binary())])
_SENT = pa.schema([("to", pa.int64()), ("b", pa.int64()), ("at", pa.binary()), ("x", pa.binary()), ("dangling", pa.float64()), ("was", pa.binary())])
_RANKS = pa.schema([("b", pa.int64()), ("pr", pa.binary()), ("delta", pa.float64()), ("top", pa.float64())])


def _send(b: int, own: pa.Table, pr: np.ndarray) -> pa.Table:
    """What a block's ranks add to the targets in every block, and the mass of its nodes without edges."""
    alone = own.filter(pc.is_null(own["to"]))
    dangling = float(pr[_numbers(alone["at"][0], "i4")].sum())
    rows = []
    for to, src, share, starts, at in zip(*(own.filter(pc.is_valid(own["to"]))[c] for c in ("to", "src", "share", "starts", "at"))):
        begin = _numbers(starts, "i4")
        x = np.add.reduceat(pr[_numbers(src, "i4")] * _numbers(share, "f8"), begin) if len(begin) else np.zeros(0)
        rows.append((to.as_py(), b, at.as_py(), x.tobytes(), dangling, pr.tobytes() if to.as_py() == b else None))
    return pa.table([pa.array(c, f) for c, f in zip(zip(*rows), _SENT.types)], schema=_SENT)


def _receive(sent: pa.Table, n: int, damping: float) -> tuple[np.ndarray, np.ndarray]:
    """The block's new ranks and its old ones; sums run in order of the sending blocks, so they are the same in any run."""
    sent = sent.sort_by("b")
    was = _numbers(sent["was"].drop_null()[0], "f8")
    x = np.zeros(len(was))
    for at, add in zip(sent["at"], sent["x"]):
        x[_numbers(at, "i4")] += _numbers(add, "f8")
    return (1 - damping) / n + damping * sum(sent["dangling"].to_pylist()) / n + damping * x, was


def pagerank_weighted(nodes: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float = 1e-12) -> DataFrame:
    """(id, pagerank) in 0..1 relative to the highest: weight times confidence, dangling mass spread evenly, edges to
    absent nodes ignored. Stops early once the total change is below ``tolerance``.

    Nodes are numbered within blocks of a hash of their id, and each block keeps its edges as arrays. A round is one stage:
    every block sends every block one sum for each of its targets there. Jobs of ``ROUNDS`` rounds each end with the
    change; where all fits one block, its rounds need neither stages nor jobs. Blocks grow in number with nodes and edges, so
    a task holds a bounded part of either.
    """
    spark = nodes.sparkSession
    ids = cut(nodes.select("id").distinct())
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) * F.coalesce(F.col("confidence"), F.lit(1.0))
    ends = cut(edges.select("source_id", "target_id", weight.alias("w")))
    n, m = max(ids.count(), 1), ends.count()
    few = max(-(-n // BLOCK_NODES), -(-m // BLOCK_EDGES), 1)
    slots = _slots(spark, max(few, spark.sparkContext.defaultParallelism) if few > 1 else 1)
    block = F.element_at(F.array(*map(F.lit, slots)).cast("array<bigint>"), (F.pmod(F.xxhash64("id"), F.lit(len(slots))) + 1).cast("int"))
    v = cut_by(ids.select("id", block.alias("b")).withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1), "b", len(slots))
    e = ends.join(v.select(F.col("id").alias("source_id"), F.col("b").alias("sb"), F.col("i").alias("si")), "source_id").join(v.select(F.col("id").alias("target_id"), F.col("b").alias("tb"), F.col("i").alias("ti")), "target_id")
    e = e.repartition(len(slots), "sb").groupBy("sb", "si", "tb", "ti").agg(F.sum(F.when(F.col("w") == 0, 1.0).otherwise(F.col("w"))).alias("x"), F.sum("w").alias("w"), F.count("*").alias("k"))
    own = cut_by(_together(v.select("b", "i"), "b", e, "sb", _layout([r.b for r in v.select("b").distinct().collect()]), _EDGES), "b", len(slots))
    drop_cut(ids)
    drop_cut(ends)

    def start(key, part):
        size = int(_numbers(part.filter(pc.is_null(part["to"]))["starts"][0], "i4")[0])
        return pa.table([pa.array([key[0].as_py()]), pa.array([np.full(size, 1.0 / n).tobytes()], pa.binary()), pa.array([0.0]), pa.array([1.0 / n])], schema=_RANKS)

    def send(key, part, ranks):
        return _send(key[0].as_py(), part, _numbers(ranks["pr"][0], "f8"))

    def stay(key, part, ranks):
        pr, sums = _numbers(ranks["pr"][0], "f8"), (0.0, 1.0 / n)
        for _ in range(iterations):
            pr, was = _receive(_send(key[0].as_py(), part, pr), n, damping)
            sums = float(np.abs(pr - was).sum()), float(pr.max())
            if sums[0] < tolerance:
                break
        return pa.table([pa.array([key[0].as_py()]), pa.array([pr.tobytes()], pa.binary()), *([x] for x in sums)], schema=_RANKS)

    def again(key, part, sent):
        return _send(key[0].as_py(), part, _receive(sent, n, damping)[0])

    def settle(key, sent):
        pr, was = _receive(sent, n, damping)
        return pa.table([pa.array([key[0].as_py()]), pa.array([pr.tobytes()], pa.binary()), pa.array([float(np.abs(pr - was).sum())]), pa.array([float(pr.max())])], schema=_RANKS)

    ranks = cut_by(own.groupBy("b").applyInArrow(start, from_arrow_schema(_RANKS)), "b", len(slots))
    done, delta = 0, np.inf
    if len(slots) == 1:
        ranks, done = cut_by(_together(own, "b", ranks, "b", stay, _RANKS), "b", 1), iterations
    while done < iterations and delta >= tolerance:
        rounds = min(ROUNDS, iterations - done)
        sent = _together(own, "b", ranks, "b", send, _SENT)
        for _ in range(rounds - 1):
            sent = _together(own, "b", sent, "to", again, _SENT)
        was, ranks = ranks, cut_by(sent.groupBy("to").applyInArrow(settle, from_arrow_schema(_RANKS)), "b", len(slots))
        drop_cut(was)
        done += rounds
        delta = ranks.agg(F.sum("delta")).first()[0] or 0.0
    top = ranks.agg(F.max("top")).first()[0] or 1.0

    def named(key, part, ranks):
        return pa.table({"id": part["id"].cast(pa.string()), "pagerank": _numbers(ranks["pr"][0], "f8")[part["i"].to_numpy()] / top})

    return v.groupBy("b").cogroup(ranks.groupBy("b")).applyInArrow(named, "id string, pagerank double")


def _together(a: DataFrame, by: str, b: DataFrame, key: str, f, schema: pa.Schema) -> DataFrame:
    return a.groupBy(by).cogroup(b.groupBy(key)).applyInArrow(f, from_arrow_schema(schema))


def node_importance(nodes: DataFrame, ranks: DataFrame, now: Column, weights: tuple[float, float, float, float] = (0.3, 0.3, 0.2, 0.2)) -> DataFrame:
    """(id, score) 0..10 of recency, frequency, PageRank and the node's own importance."""
    a, b, c, d = weights
    n = nodes.join(ranks, "id", "left")
    s = 10 * (a * X.recency("accessed_at", now) + b * X.frequency("access_count") + c * F.coalesce("pagerank", F.lit(0.0)) + d * F.col("importance") / 10.0)
    return n.select("id", F.least(F.lit(10.0), F.greatest(F.lit(0.0), s)).alias("score"))


def edge_importance(edges: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    """(id, score) 0..10 of recency, frequency, weight, confidence and the ends' importance (half for a missing end)."""
    imp = nodes.groupBy("id").agg(F.max("importance").alias("imp"))
    s, t = imp.select(F.col("id").alias("source_id"), F.col("imp").alias("si")), imp.select(F.col("id").alias("target_id"), F.col("imp").alias("ti"))
    e = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    end = lambda c: F.coalesce(F.col(c) / 10.0, F.lit(0.5))
    v = 10 * (0.25 * X.recency("accessed_at", now) + 0.2 * X.frequency("access_count") + 0.2 * F.least(F.lit(1.0), F.col("weight") / 5.0) + 0.15 * F.col("confidence") + 0.2 * (end("si") + end("ti")) / 2)
    return e.select("id", F.least(F.lit(10.0), F.greatest(F.lit(0.0), v)).alias("score"))
