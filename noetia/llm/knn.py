"""Most similar vectors for every vector: inverted lists with an adaptive scan of the dimensions.

Vectors are rotated, so that the first columns estimate a distance without bias. Lists of near vectors are packed into
shards; a vector goes to its own shard and to the other shards whose lists it probes. Inside a list the columns are taken
block by block; after each block a hypothesis test on the partial distance abandons the pairs that are unlikely to beat the
query's current k-th best. While many pairs are left, a block is one matrix product; few are followed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noetia.llm.vectors import Lists, blobs, copies, fit_lists, joined, representatives, unit_vectors, unpack
from noetia.session import cut

#: Beyond ``MAX_LISTS`` lists (11 million different vectors) lists grow instead, as a sample of bounded size fits no more.
ROWS_PER_LIST, LISTS_PER_SHARD, WIDE_LISTS_PER_SHARD, MAX_LISTS = 700, 8, 128, 16_384
#: Columns after which the partial distance is tested, and the significance of each test (standard errors).
TESTS, EPSILON = (16, 32, 48), 2.1
#: Share of the pairs up to which those left are followed one by one.
SPARSE = 0.03
QUERY_BLOCK = 2048
#: Lists that serve vectors without near neighbours, and how many of them are probed, each by the root of the number before.
WIDE_LISTS, WIDE_PROBES = 2.4, 3.5


def _spread(lists: Lists, dim: int, margin: float, most: int):
    """Each vector to its shard (kind 0, base and query) and to the other shards it probes (kind 1, query only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = lists.rows_at_once
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                yield place(whole.slice(at, step))

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        u = unpack(b.column(1), dim)
        row, lst, home = lists.probes(u, margin, most)
        shard = lists.shard[lst]
        foreign = lst != home[row]  # the home list comes first, so that kind 0 names it
        order = np.lexsort((lst, foreign, shard, row))
        row, lst, shard = row[order], lst[order], shard[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(shard) != 0)]))
        n_lists = np.diff(np.append(first, len(row)))
        r, s = row[first], shard[first]
        kind = (s != lists.shard[home[r]]).astype(np.int8)
        take = pa.array(r)
        return pa.RecordBatch.from_arrays(
            [pa.array(s.astype(np.int32)), pa.array(kind), b.column(0).take(take), blobs(n_lists * 2, lst.astype("<i2").tobytes()), b.column(1).take(take)],
            names=["shard", "kind", "id", "lists", "vec"],
        )

    return run


class _Shard:
    """The base vectors of one shard, by list."""

    def __init__(self, dim: int):
        self.dim, self.ids, self.vecs, self.lists, self.ready = dim, [], [], [], None

    def add(self, ids, vecs, lists):
        self.ids.append(ids), self.vecs.append(vecs), self.lists.append(lists)

    def close(self):
        if self.ready is None:
            home = np.array([int.from_bytes(x[:2], "little", signed=True) for p in self.lists for x in p])
            order = np.argsort(home, kind="stable")
            u = np.concatenate(self.vecs)[order]
            self.id_array = pa.concat_arrays(self.ids).take(pa.array(order))
            self.raw_lists = [x for p in self.lists for x in p]
            self.order = order
            self.u = u
            steps = [t for t in TESTS if t < self.dim]
            self.blocks = list(zip([0, *steps], [*steps, self.dim]))
            self.columns = [np.ascontiguousarray(u[:, x:y].T) for x, y in self.blocks]
            # half the squared length of the first columns, after each block
            self.half = np.stack([0.5 * np.einsum("ij,ij->i", u[:, :y], u[:, :y]) for _, y in self.blocks])
            names, first = np.unique(home[order], return_index=True)
            self.span = dict(zip(names.tolist(), zip(first.tolist(), np.append(first[1:], len(u)).tolist())))
            self.ready = True

    def search(self, q: np.ndarray, own: np.ndarray, lists: list[bytes], k: int, floor: float):
        """(query row, base row, cosine) of the k best per query above the floor; ``own``: a query's base row or -1."""
        best = np.full((len(q), k), -2.0, np.float32)
        arg = np.full((len(q), k), -1, np.int64)
        want: dict[int, list[int]] = {}
        for i, x in enumerate(lists):
            for name in np.frombuffer(x, "<i2").tolist():
                want.setdefault(name, []).append(i)
        for name, rows in want.items():
            if (span := self.span.get(name)) is not None:
                rows = np.array(rows)
                for i in range(0, len(rows), QUERY_BLOCK):
                    self._scan(q, own, rows[i : i + QUERY_BLOCK], *span, best, arg, floor)
        r, c = np.nonzero(arg >= 0)
        return r, arg[r, c], best[r, c]

    def _scan(self, q, own, rows, lo, hi, best, arg, floor):
        k, dim = best.shape[1], self.dim
        bar = np.maximum(best[rows, k - 1], floor)
        open_ = bar <= -1.0  # no k-th best yet and no floor: nothing can be abandoned
        x = q[rows]
        i = j = None  # the pairs left, once they are few
        dot = np.zeros((len(x), hi - lo), np.float32)
        for n, (a, b) in enumerate(self.blocks):
            if i is None:
                dot += x[:, a:b] @ self.columns[n][:, lo:hi]
            else:
                for at in range(0, len(i), 65_536):
                    s = slice(at, at + 65_536)
                    dot[s] += np.einsum("ij,ij->i", x[i[s], a:b], self.u[lo + j[s], a:b])
            if b == dim:
                break
            # abandon where the partial squared distance, scaled to all columns, is too far beyond the bar's
            factor = (1 + EPSILON / np.sqrt(b)) ** 2 * b / dim
            limit = 0.5 * np.einsum("ij,ij->i", x[:, :b], x[:, :b]) - factor * (1 - bar)
            limit[open_] = -np.inf
            if i is not None:
                keep = dot - self.half[n][lo + j] > limit[i]
                i, j, dot = i[keep], j[keep], dot[keep]
            elif not open_.any():
                mask = dot - self.half[n][lo:hi] > limit[:, None]
                if np.count_nonzero(mask) <= SPARSE * mask.size:
                    i, j = np.nonzero(mask)
                    dot = dot[i, j]
        if i is None:
            if open_.any() and hi - lo > k + 1:  # such a query sets its bar by this list's own k + 1 best (one may be itself)
                bar[open_] = np.partition(dot[open_], -(k + 1), axis=1)[:, -(k + 1)] - 1e-6
            i, j = np.nonzero(dot > bar[:, None])
            score = dot[i, j]
        else:
            keep = dot > bar[i]
            i, j, score = i[keep], j[keep], dot[keep]
        j = j + lo
        ok = own[rows[i]] != j
        i, j, score = i[ok], j[ok], score[ok]
        if not len(i):
            return
        touched = np.unique(i)
        at = rows[touched]
        i = np.concatenate([i, np.repeat(touched, k)])
        j = np.concatenate([j, arg[at].ravel()])
        score = np.concatenate([score, best[at].ravel()])
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
        start = np.searchsorted(i, touched)
        for c in range(k):  # every touched row has at least k entries
            best[at, c], arg[at, c] = score[start + c], j[start + c]


def _search(dim: int, k: int, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, _Shard(dim)
        for b in batches:
            number, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                if lo == hi:
                    continue
                if number[lo] != shard:
                    yield from _own(held)
                    shard, held = number[lo], _Shard(dim)
                ids, lists, u = b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo).to_pylist(), unpack(b.column(4).slice(lo, hi - lo), dim)
                if kind[lo] == 0:
                    held.add(ids, u, lists)
                elif held.ids:
                    held.close()
                    yield _rows(ids, held, *held.search(u, np.full(len(u), -1), lists, k, floor))
        yield from _own(held)

    def _own(held):
        if not held.ids:
            return
        held.close()
        where = np.empty(len(held.order), np.int64)
        where[held.order] = np.arange(len(held.order))
        for i in range(0, len(held.order), 8192):
            rows = held.order[i : i + 8192]
            yield _rows(held.id_array.slice(i, len(rows)), held, *held.search(held.u[i : i + 8192], where[rows], [held.raw_lists[r] for r in rows], k, floor))

    def _rows(ids, held, r, j, score):
        return pa.RecordBatch.from_arrays([ids.take(pa.array(r)), held.id_array.take(pa.array(j)), pa.array(score.astype(np.float64))], names=["id", "neighbour", "cosine"])

    return run


def neighbours(reps: DataFrame, k: int = 5, min_cosine: float | None = None, margin: float = 0.15, probes: int = 12, dim: int = 64, wide: bool = False) -> DataFrame:
    """``id``, ``neighbour``, ``cosine``, ``rank`` of the k most similar other rows of every row of ``reps(id, vec)``.

    ``reps`` is read several times; pass a written table. A row probes the lists whose centres come within ``margin`` of
    its nearest centre's cosine, ``probes`` at most. Near neighbours are found with a fixed number of probes in lists of a
    fixed size. Vectors without near neighbours have theirs scattered: ``wide`` makes lists by the root of the rows and probes
    by the root of the lists, so the rows scanned for a vector grow with about the power 0.75 of all rows. With
    ``min_cosine`` only neighbours at least that similar come out, and the scan abandons all others. Ties go to the smaller id.
    """
    n = reps.count()
    if wide:
        n_lists = max(1, round(WIDE_LISTS * n**0.5))
        probes, margin = int(np.ceil(WIDE_PROBES * n_lists**0.5)), 2.0
        lists = fit_lists(reps, n, -(-n // n_lists) if n else 1, WIDE_LISTS_PER_SHARD, dim, MAX_LISTS)
    else:
        lists = fit_lists(reps, n, ROWS_PER_LIST, LISTS_PER_SHARD, dim, MAX_LISTS)
    floor = -2.0 if min_cosine is None else float(np.nextafter(np.float32(min_cosine) - np.float32(2e-6), np.float32(-2)))
    spread = reps.select("id", "vec").mapInArrow(_spread(lists, dim, margin, probes), "shard int, kind tinyint, id string, lists binary, vec binary")
    found = spread.repartitionById(lists.n_shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_search(dim, k, floor), "id string, neighbour string, cosine double")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def most_similar(entities: DataFrame, k: int = 5, min_cosine: float | None = None, margin: float = 0.15, probes: int = 12, dim: int = 64, wide: bool = False) -> DataFrame:
    """The k most similar entities of every entity with a usable embedding, over all memories.

    ``id``, ``neighbour``, ``cosine``, ``rank``; see :func:`neighbours`. Exact copies of a vector are searched once, as
    their smallest id, and come out as neighbours of each other: every member of such a group gets its k smallest other
    members, and in groups smaller than that the representative's neighbours besides. Unusable vectors (null, empty, of
    another length, zero, not finite) and null ids give no rows, redelivered rows count once, an empty table or one with
    a single vector gives no rows.
    """
    vectors = unit_vectors(entities, dim)
    reps = cut(representatives(vectors))
    near = neighbours(reps, k, min_cosine, margin, probes, dim, wide)
    if not reps.where("id <> last_id").limit(1).count():
        return near
    group = cut(copies(vectors, reps))
    w = Window.partitionBy("rep").orderBy("id")
    anchor = group.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).select("rep", F.col("id").alias("neighbour"))
    inside = group.join(anchor, "rep").where("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("cosine"))
    # a neighbour that stands for copies brings its k smallest, a query that stands for copies hands on to all of them
    heads = anchor.select(F.col("rep").alias("r"), F.col("neighbour").alias("member"))
    wide = near.join(heads, near.neighbour == heads.r, "left").select("id", F.coalesce("member", "neighbour").alias("neighbour"), "cosine")
    tails = group.groupBy("rep").count().where(F.col("count") <= k).select("rep").join(group, "rep").select(F.col("rep").alias("r"), F.col("id").alias("member"))
    out = wide.join(tails, wide.id == tails.r, "left").select(F.coalesce("member", "id").alias("id"), "neighbour", "cosine").union(inside)
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(nearest: DataFrame, min_cosine: float) -> DataFrame:
    """``id_a`` < ``id_b``: pairs at least that similar of which one is among the nearest of the other."""
    return nearest.where(F.col("cosine") >= min_cosine - 2e-6).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).where("id_a <> id_b").distinct()
