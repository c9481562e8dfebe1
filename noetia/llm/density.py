"""Grouping records into similarity clusters: density clustering over spatial cells with overlapping margins.

A vector goes to the cell of its nearest centre and to every further cell whose centre comes within a margin, however many
these are. The margin covers the search radius by a test, not by a bound: at cosine 0.85 the bisecting planes of 124 cells
rule out 2% of them, so cells with an exact margin would all hold everything. A pair is found if either vector reaches the
other's cell. Each cell clusters by itself around core vectors; clusters of different cells that share a core vector are
one, found as connected components of (member, local cluster) links, so no cell's pairs leave its task. Members that are
dissimilar to their cluster as a whole are dropped by the cluster's vector sum, which is exact and linear in its size. The
most typical members are those nearest the cluster's mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noetia.llm.vectors import Lists, copies, fit_lists, joined, representatives, unit_vectors, unpack
from noetia.operators.components import connected_components
from noetia.session import cut, norm_id

MIN_COSINE, MIN_POINTS = 0.85, 3
ROWS_PER_CELL, CELLS_PER_SHARD = 2500, 2
#: How far a cell's centre may fall behind the nearest one, in cosine. Of the pairs at the very radius about 1 in 100,000 is
#: missed from both sides (7 to 1,240 cells, 100,000 pairs drawn for each), of closer ones fewer.
MARGIN = 0.2
#: Columns of the reduced vectors; they bound a pair's distance from below. Rows compared at once.
REDUCED = 32
TILE, WIDE = 1024, 4096
#: Mean cosine with the other members that a member needs, below the radius: outliers first, then all that fall short.
SLACK = (0.05, 0.0)


def _to_cells(lists: Lists, dim: int, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = lists.rows_at_once
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                row, cell, home = lists.probes(unpack(part.column(1), dim), margin, len(lists.centres))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.shard[cell].astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(cell == home[row]), *(part.column(i).take(take) for i in range(3))],
                    names=["shard", "cell", "own", "node", "vec", "copied"],
                )

    return run


def _reduced(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first columns and half their squared length."""
    head = np.ascontiguousarray(u[:, :REDUCED])
    return head, 0.5 * np.einsum("ij,ij->i", head, head)


def close_vectors(u: np.ndarray, v: np.ndarray, same: bool, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of all pairs of cosine at least ``min_cosine``, i < j where ``v`` is ``u``.

    The distance of the first columns is never more than the whole distance, so it rules out no similar pair.
    """
    (hu, lu), (hv, lv) = _reduced(u), _reduced(v)
    left = np.hstack([hu, np.ones((len(u), 1), np.float32)])
    right = np.hstack([hv, -lv[:, None]])
    floor = lu - (1 - min_cosine) - 1e-5
    for lo in range(0, len(u), TILE):
        for at in range(lo if same else 0, len(v), WIDE):
            near = left[lo : lo + TILE] @ right[at : at + WIDE].T >= floor[lo : lo + TILE, None]
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            i, j = i + lo, j + at
            if same:
                i, j = i[i < j], j[i < j]
            for a in range(0, len(i), 65_536):
                x, y = i[a : a + 65_536], j[a : a + 65_536]
                ok = np.einsum("ij,ij->i", u[x], v[y]) >= min_cosine - 2e-6
                yield x[ok], y[ok]


def _local_labels(n: int, i: np.ndarray, j: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Per row the smallest core of its local cluster, ``n`` where it is in none. Borders join none."""
    label = np.where(core, np.arange(n), n)
    both = core[i] & core[j]
    ci, cj = i[both], j[both]
    while len(ci):  # the smallest label along links between cores, with pointer jumping
        new = label.copy()
        np.minimum.at(new, ci, label[cj])
        np.minimum.at(new, cj, label[ci])
        inside = new < n
        new[inside] = new[new[inside]]
        if np.array_equal(new, label):
            break
        label = new
    out = label.copy()
    for a, b in ((i, j), (j, i)):
        border = core[a] & ~core[b]
        np.minimum.at(out, b[border], label[a[border]])
    return out


def _local(dim: int, min_cosine: float, min_points: int):
    """Per cell: (member, label, core) of every row in a local cluster; the label is the cluster's smallest core."""

    def cluster(ids: np.ndarray, own: np.ndarray, u: np.ndarray, copied: np.ndarray) -> pa.RecordBatch:
        mine, others = np.flatnonzero(own), np.flatnonzero(~own)
        found = [(mine[x], mine[y]) for x, y in close_vectors(u[mine], u[mine], True, min_cosine)]
        found += [(mine[x], others[y]) for x, y in close_vectors(u[mine], u[others], False, min_cosine)]
        i, j = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        # copies of a vector are neighbours too: one that has any counts twice
        degree = np.bincount(i, 1.0 + copied[j], len(u)) + np.bincount(j, 1.0 + copied[i], len(u)) + copied
        core = degree >= min_points - 1
        label = _local_labels(len(u), i, j, core)
        at = np.flatnonzero(label < len(u))
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]]), pa.array(core[at])], names=["member", "label", "core"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            order = np.argsort(columns[0])
            return cluster(*(c[order] for c in columns))

        flags = lambda c: c.to_numpy(zero_copy_only=False).astype(bool)
        for b in batches:
            cell = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(cell) != 0) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                if lo == hi:
                    continue
                if cell[lo] != now:
                    if held:
                        yield flush()
                    now, held = cell[lo], []
                part = b.slice(lo, hi - lo)
                held.append((part.column(2).to_numpy(), flags(part.column(1)), unpack(part.column(3), dim), flags(part.column(4))))
        if held:
            yield flush()

    return run


def _typical(member: DataFrame, least: float, dim: int) -> DataFrame:
    """Those of ``member(component, node, vec)`` whose mean cosine with the others of their component is at least ``least``.

    With the component's sum S of n unit vectors, a member u has (u S - 1) / (n - 1): one pass for the sums, one for the
    members, whatever the component's size. A component of one vector (with copies) stays.
    """
    sums = vector_sums(member, "component", dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b.column(4).to_numpy().astype(float)
                dot = np.einsum("ij,ij->i", unpack(b.column(2), dim).astype(float), np.frombuffer(joined(b.column(3)), "<f8").reshape(-1, dim))
                ok = (n == 1) | ((dot - 1) / np.maximum(n - 1, 1) >= least - 1e-4)
                yield pa.RecordBatch.from_arrays(b.columns[:3], names=["component", "node", "vec"]).filter(pa.array(ok))

    return member.join(sums, "component").select("component", "node", "vec", "total", "n").mapInArrow(run, "component bigint, node bigint, vec binary")


def density_clusters(entities: DataFrame, min_cosine: float = MIN_COSINE, min_points: int = MIN_POINTS, dim: int = 64, margin: float = MARGIN) -> DataFrame:
    """``cluster_id`` (its smallest id), ``entity_id``, ``size`` of every member of a cluster of at least ``min_points``.

    Neighbours are vectors of cosine at least ``min_cosine``; a vector with ``min_points - 1`` of them is a core. Members
    whose mean cosine with the others is below the radius are left out. Unusable vectors and null ids belong to no
    cluster, redelivered rows count once. Exact copies are clustered once, as their smallest id, which counts
    as two neighbours, and come out with all their ids; a group of copies alone is a cluster if it is large enough. An empty table gives no rows.
    """
    vectors = unit_vectors(entities, dim)
    # numbers for names: written once, so they are the same wherever they are read
    reps = cut(representatives(vectors).withColumn("node", F.monotonically_increasing_id()))
    n = reps.count()
    lists = fit_lists(reps, n, ROWS_PER_CELL, CELLS_PER_SHARD, dim)
    copied = (F.col("id") != F.col("last_id")).alias("copied")
    cells = reps.select("node", "vec", copied).mapInArrow(_to_cells(lists, dim, margin), "shard int, cell int, own boolean, node bigint, vec binary, copied boolean")
    by_cell = cells.repartitionById(lists.n_shards, "shard").sortWithinPartitions("cell").select("cell", "own", "node", "vec", "copied")
    rows = cut(by_cell.mapInArrow(_local(dim, min_cosine, min_points), "member bigint, label bigint, core boolean"))
    cores = rows.where("core").select("member").distinct()
    links = rows.join(cores, "member", "left_semi").select(F.col("member").alias("src"), F.col("label").alias("dst")).distinct()
    comp = cut(connected_components(links))
    # borders must not join clusters; each goes to the smallest that has it
    border = rows.join(cores, "member", "left_anti").join(comp.withColumnRenamed("node", "label"), "label").groupBy(F.col("member").alias("node")).agg(F.min("component").alias("component"))
    ok = cut(comp.union(border).join(reps.select("node", "vec"), "node").select("component", "node", "vec"))
    for slack in SLACK:
        ok = cut(_typical(ok, min_cosine - slack, dim))
    many = reps.where("id <> last_id")
    if many.limit(1).count():
        group = cut(copies(vectors, reps))
        alone = many.join(ok, "node", "left_anti").select("node", F.col("node").alias("component"))
        member = ok.select("node", "component").union(alone).join(reps.select("node", F.col("id").alias("rep")), "node").join(group.withColumnRenamed("id", "copy"), "rep", "left")
        member = member.select(F.coalesce("copy", "rep").alias("entity_id"), "component")
    else:
        member = ok.join(reps.select("node", F.col("id").alias("entity_id")), "node").select("entity_id", "component")
    total = member.groupBy("component").agg(F.count("*").alias("size"), F.min("entity_id").alias("cluster_id")).where(F.col("size") >= min_points)
    return member.join(total, "component").select("cluster_id", "entity_id", "size")


def vector_sums(m: DataFrame, key: str, dim: int) -> DataFrame:
    """``key``, ``total``, ``n``: sum and number of the vectors ``vec`` of each key, added up within each partition first."""
    schema = f"{key} {m.schema[key].dataType.simpleString()}, total binary, n bigint"
    parts = m.select(key, "vec").mapInArrow(_partial_sums(key, dim), schema)
    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(_fold_sums(key), schema)


def _partial_sums(key: str, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(0).dictionary_encode()
            at, k = names.indices.to_numpy(), len(names.dictionary)
            order = np.argsort(at, kind="stable")
            total = np.add.reduceat(unpack(b.column(1), dim).astype(np.float64)[order], np.searchsorted(at[order], np.arange(k)), axis=0)
            yield pa.RecordBatch.from_arrays([names.dictionary, pa.array([r.tobytes() for r in total], pa.binary()), pa.array(np.bincount(at, minlength=k))], names=[key, "total", "n"])

    return run


def _fold_sums(key: str):
    """Adds the partial sums of each key; rows come sorted by key, one batch's keys are in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key of the batch before, whose sum may go on
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(0).dictionary_encode()
            at, k = names.indices.to_numpy(), len(names.dictionary)  # sorted, as the rows are
            first = np.searchsorted(at, np.arange(k))
            total = np.add.reduceat(np.frombuffer(joined(b.column(1)), "<f8").reshape(len(at), -1), first, axis=0)
            n = np.add.reduceat(b.column(2).to_numpy(), first)
            if held is not None:
                if held[0].equals(names.dictionary.slice(0, 1)):
                    total[0] += held[1]
                    n[0] += held[2]
                else:
                    yield rows(held[0], held[1][None], [held[2]])
            if k > 1:
                yield rows(names.dictionary.slice(0, k - 1), total[:-1], n[:-1])
            held = (names.dictionary.slice(k - 1), total[-1].copy(), int(n[-1]))
        if held is not None:
            yield rows(held[0], held[1][None], [held[2]])

    def rows(keys, total, n):
        return pa.RecordBatch.from_arrays([keys, pa.array([r.tobytes() for r in total], pa.binary()), pa.array(n, pa.int64())], names=[key, "total", "n"])

    return run


def _closeness(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = np.frombuffer(joined(b.column(3)), "<f8").reshape(-1, dim)
                t = t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-30)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", unpack(b.column(2), dim), t))], names=["cluster_id", "entity_id", "closeness"])

    return run


def describe_clusters(entities: DataFrame, members: DataFrame, most_typical: int = 3, dim: int = 64) -> DataFrame:
    """``cluster_id``, ``size``, ``entities`` (names of the most typical members, nearest the mean first), ``medoid_id``.

    Null names are left out of ``entities``.
    """
    vectors = unit_vectors(entities, dim).groupBy("id").agg(F.min("vec").alias("vec"))
    named = entities.select(norm_id("id").alias("id"), "name").groupBy("id").agg(F.min("name").alias("name"))
    m = cut(members.join(vectors, members.entity_id == vectors.id).select("cluster_id", "entity_id", "size", "vec"))
    mean = vector_sums(m, "cluster_id", dim)
    close = m.join(mean, "cluster_id").select("cluster_id", "entity_id", "vec", "total").mapInArrow(_closeness(dim), "cluster_id string, entity_id string, closeness double")
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("closeness", 5)), "entity_id")
    top = close.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most_typical)
    top = top.join(named, top.entity_id == named.id, "left")
    out = top.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("rank", "name")))).alias("t"), F.min(F.when(F.col("rank") == 1, F.col("entity_id"))).alias("medoid_id"))
    size = members.groupBy("cluster_id").agg(F.max("size").alias("size"))
    return out.join(size, "cluster_id").select("cluster_id", "size", F.col("t.name").alias("entities"), "medoid_id")
