"""Unit vectors in compact form, and the lists and shards they are spread over."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetia.session import norm_id

#: Rows the list centres are fitted on at most; every row is indexed.
FIT_ROWS = 65_536
SEED = 20_240_131


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation: afterwards any block of columns is a fair sample of a vector's length."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def pack(u: np.ndarray) -> pa.Array:
    """Unit vectors as 16-bit integers scaled by each vector's largest component; cosines keep about five digits."""
    scale = 32767.0 / np.maximum(np.abs(u).max(axis=1, keepdims=True), 1e-30)
    q = np.rint(u * scale).astype("<i2")
    return blobs(np.full(len(q), q.shape[1] * 2, np.int64), q.tobytes())


def blobs(lengths: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def joined(col: pa.Array) -> bytes:
    return b"".join(col.to_pylist())


def unpack(col: pa.Array, dim: int) -> np.ndarray:
    u = np.frombuffer(joined(col), "<i2").reshape(-1, dim).astype(np.float32)
    u /= np.sqrt(np.einsum("ij,ij->i", u, u, dtype=np.float64)).astype(np.float32)[:, None]
    return u


def unit_vectors(df: DataFrame, dim: int = 64, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``id``, ``vec`` (packed, rotated, of unit length) of every usable row.

    Usable are vectors of ``dim`` finite numbers that aren't all zero, under a non-blank id. Null, empty, short, NaN and
    zero vectors are left out, repeated rows stay.
    """
    # in double precision: a copy packs to the same bytes in whatever batch it comes
    rot = rotation(dim).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.equal(pc.fill_null(pc.list_value_length(b.column(1)), 0), dim))
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            top = np.abs(x).max(axis=1)
            ok = np.isfinite(top) & (top > 0)
            x = x[ok] / top[ok, None]
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pack(x @ rot)], names=["id", "vec"])

    src = df.select(norm_id(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    return src.mapInArrow(run, "id string, vec binary")


@dataclass
class Lists:
    """Centres of the lists, the shard of each list, and the number of shards."""

    centres: np.ndarray
    shard: np.ndarray
    n_shards: int

    @property
    def rows_at_once(self) -> int:
        """Rows whose products with all centres take some tens of megabytes."""
        return max(64, min(4096, 2**23 // max(1, len(self.centres))))

    def probes(self, u: np.ndarray, margin: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, home list per row): lists whose centre is within ``margin`` of the best cosine, ``most`` at most."""
        a = u @ self.centres.T
        home = a.argmax(axis=1)
        keep = a >= (a[np.arange(len(u)), home] - margin)[:, None]
        if most < a.shape[1]:
            over = np.flatnonzero(keep.sum(axis=1) > most)
            if len(over):
                cut = np.partition(a[over], -most, axis=1)[:, -most]
                keep[over] &= a[over] >= cut[:, None]
        row, lst = np.nonzero(keep)
        return row, lst, home


def fit_lists(reps: DataFrame, n: int, rows_per_list: int, lists_per_shard: int, dim: int, most: int = 16_384) -> Lists:
    """Spherical k-means on a bounded sample (``FIT_ROWS``), and a balanced spatial tree of its centres as shards."""
    k = int(np.clip(round(n / rows_per_list), 1, most))
    bucket = max(1, int(round(2**20 * min(1.0, min(FIT_ROWS, max(4096, 48 * k)) / max(n, 1)))))
    got = reps.where(F.pmod(F.xxhash64("id"), F.lit(2**20)) < bucket).select("vec").limit(2 * FIT_ROWS).toPandas()["vec"]
    if not len(got):
        return Lists(np.zeros((1, dim), np.float32), np.zeros(1, np.int64), 1)
    t = unpack(pa.array(list(map(bytes, got)), pa.binary()), dim)
    t = t[np.lexsort(t.T[:4])]
    k = min(k, max(1, len(t) // 2))
    rng = np.random.default_rng(SEED)
    c = t[rng.choice(len(t), k, replace=False)].copy()
    for _ in range(6):
        near = np.concatenate([(t[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(t), 4096)])
        order = np.argsort(near, kind="stable")
        present, first = np.unique(near[order], return_index=True)
        c[present] = np.add.reduceat(t[order], first, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    shard = np.zeros(k, np.int64)
    parts = [np.arange(k)]
    while max(map(len, parts)) > lists_per_shard:
        parts = [h for p in parts for h in (_halves(c, p) if len(p) > lists_per_shard else [p])]
    for i, p in enumerate(parts):
        shard[p] = i
    return Lists(c.astype(np.float32), shard, len(parts))


def _halves(c: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    x = c[p] - c[p].mean(axis=0)
    axis = np.linalg.svd(x, full_matrices=False)[2][0]
    order = p[np.argsort(x @ axis, kind="stable")]
    return [order[: len(p) // 2], order[len(p) // 2 :]]


def representatives(vectors: DataFrame) -> DataFrame:
    """One row per different vector: ``id`` (smallest), ``vec``, ``last_id`` (largest; differs where there are copies).

    Exact copies, which may be a large share of all rows, fold together before the shuffle.
    """
    return vectors.groupBy("vec").agg(F.min("id").alias("id"), F.max("id").alias("last_id")).select("id", "vec", "last_id")


def copies(vectors: DataFrame, reps: DataFrame) -> DataFrame:
    """``rep``, ``id`` of every member of a group of exact copies, the representative itself included."""
    many = reps.where("id <> last_id").select(F.col("id").alias("rep"), "vec")
    return vectors.join(many, "vec").select("rep", "id").distinct()
