"""References to records that do not exist.

Keys are hashed to 64 bits and the hash space is range-partitioned. Each range holds its parents as sorted arrays; the
references stream past in Arrow batches and are probed by vectorised binary search, so a task keeps one range of
parents in memory and never its references. Ranges whose references are hot (one key may draw a third of them) are
split over several tasks, each with a copy of that one range of parents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetia.session import norm_id

#: Parents and references of a range, about; the larger need sets the number of ranges. Beyond ``MAX_RANGES`` ranges hold more
#: parents (a task's memory is enough for some millions).
PARENTS_PER_RANGE, REFERENCES_PER_RANGE = 50_000, 50_000
MAX_RANGES = 16_384
#: A range with more references than this times the mean is split.
HOT = 2.0
UNKNOWN_TIME = -(2**63)
REASONS = ("missing", "deleted", "other_memory", "created_later")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, is_ref): a range's parents come first, then its references."""
    held: list[list[np.ndarray]] = []
    arrays, part = None, None
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        num = {n: cols[n].to_numpy(zero_copy_only=False) for n in ("part", "is_ref", "k", "k2", "scope", "created", "deleted")}
        edges = np.flatnonzero((np.diff(num["part"]) != 0) | (np.diff(num["is_ref"]) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
            if lo == hi:
                continue
            if num["part"][lo] != part:
                part, held, arrays = num["part"][lo], [], None
            piece = {n: v[lo:hi] for n, v in num.items()}
            if not num["is_ref"][lo]:
                held.append([piece[n] for n in ("k", "k2", "scope", "created", "deleted")])
                arrays = None
                continue
            if arrays is None:
                arrays = _sorted(held)
                held = [arrays]
            yield _misses(arrays, piece, cols, lo, hi)


def _sorted(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    if not held:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.int8)]
    a = [np.concatenate(x) for x in zip(*held)]
    order = np.lexsort((a[3], a[2], a[1], a[0]))
    a = [x[order] for x in a]
    first = np.ones(len(a[0]), bool)
    first[1:] = (np.diff(a[0]) != 0) | (np.diff(a[1]) != 0)
    return [x[first] for x in a]


def _misses(a: list[np.ndarray], r: dict[str, np.ndarray], cols: dict, lo: int, hi: int) -> pa.RecordBatch:
    k, k2, scope, created, deleted = a
    at = np.searchsorted(k, r["k"])
    reason = np.zeros(hi - lo, np.int8)  # 1 + index into REASONS; 0 where the reference holds
    if len(k) == 0:
        reason[:] = 1
    else:
        at = np.minimum(at, len(k) - 1)
        # equal 64-bit keys of different ids are told apart by the second hash; there are next to none
        step = (k[at] == r["k"]) & (k2[at] != r["k2"]) & (at + 1 < len(k))
        at = np.where(step & (k[np.minimum(at + 1, len(k) - 1)] == r["k"]), at + 1, at)
        found = (k[at] == r["k"]) & (k2[at] == r["k2"])
        later = (created[at] > r["created"]) & (created[at] != UNKNOWN_TIME) & (r["created"] != UNKNOWN_TIME)
        for n, bad in ((4, later), (3, scope[at] != r["scope"]), (2, deleted[at] != 0), (1, ~found)):
            reason[bad] = n
    miss = np.flatnonzero(reason)
    take = pa.array(miss + lo)
    return pa.RecordBatch.from_arrays(
        [cols["ref_id"].take(take), cols["field"].take(take), cols["created"].take(take), pa.array(reason[miss] - 1, pa.int32())],
        names=["ref_id", "field", "created", "reason"],
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a valid parent, with the reason.

    ``refs``: ref_id, field, target, scope STRING, created TIMESTAMP. ``parents``: id, scope STRING, deleted BOOLEAN,
    created TIMESTAMP. A reference is an orphan when no parent has its target (``missing``), else when that parent is
    deleted (``deleted``), else when its scope differs (``other_memory``), else when both creation times are known and
    the parent's is later (``created_later``). Returns ref_id, field, created_us (BIGINT, null if unknown), reason; one
    row per (ref_id, field). Null or blank targets are no references. Repeated rows count once. Of parents with equal
    ids and different values, the smallest (scope hash, created) holds. A null scope equals a null scope only. With no
    parents every reference is missing; with no references the result is empty.
    """
    n_ranges = int(min(MAX_RANGES, max(1, -(-parents.count() // PARENTS_PER_RANGE), -(-refs.count() // REFERENCES_PER_RANGE))))
    # equal-width ranges of the signed 64-bit hash, a power of two of them: the top bits name the range
    bits = max(1, (n_ranges - 1).bit_length())
    n_ranges = 1 << bits
    span = lambda k: (F.shiftright(F.col(k), 64 - bits) + F.lit(n_ranges // 2)).cast("int")
    micros = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(UNKNOWN_TIME).cast("bigint"))
    hashed = lambda df, key: df.select("*", F.xxhash64(key).alias("k"), F.hash(key).cast("bigint").alias("k2"), F.xxhash64("scope").alias("scope64"), micros("created").alias("created_us"))
    r = hashed(refs.select("ref_id", "field", norm_id("target").alias("target"), "scope", "created").where("target is not null"), "target")
    p = hashed(parents.select(norm_id("id").alias("id"), "scope", "deleted", "created").where("id is not null"), "id")
    r, p = r.withColumn("range", span("k")), p.withColumn("range", span("k"))

    counts = dict(r.groupBy("range").count().collect())  # at most MAX_RANGES rows
    mean = sum(counts.values()) / n_ranges
    salts = [max(1, -(-counts.get(i, 0) // max(1, int(HOT * mean)))) for i in range(n_ranges)]
    first = np.concatenate([[0], np.cumsum(salts)[:-1]]).tolist()
    salt_of, first_of = (F.array(*[F.lit(int(x)) for x in xs]) for xs in (salts, first))
    at = lambda xs: F.get(xs, F.col("range"))
    r = r.withColumn("part", at(first_of) + F.pmod(F.xxhash64("ref_id", "field"), at(salt_of)).cast("int"))
    p = p.withColumn("part", F.explode(F.sequence(at(first_of), at(first_of) + at(salt_of) - 1)))
    cols = lambda df, ref: df.select("part", F.lit(ref).cast("tinyint").alias("is_ref"), "k", "k2", F.col("scope64").alias("scope"), F.col("created_us").alias("created"), (F.coalesce("deleted", F.lit(False)).cast("tinyint") if not ref else F.lit(0).cast("tinyint")).alias("deleted"), (F.col("ref_id") if ref else F.lit(None).cast("string")).alias("ref_id"), (F.col("field") if ref else F.lit(None).cast("string")).alias("field"))
    both = cols(p, 0).unionByName(cols(r, 1)).repartition(sum(salts), "part").sortWithinPartitions("part", "is_ref")
    miss = both.mapInArrow(_probe, "ref_id string, field string, created bigint, reason int")
    one = miss.groupBy("ref_id", "field").agg(F.min("created").alias("c"), F.min("reason").alias("r"))
    return one.select("ref_id", "field", F.when(F.col("c") != UNKNOWN_TIME, F.col("c")).alias("created_us"), F.get(F.array(*map(F.lit, REASONS)), F.col("r")).alias("reason"))


def relationship_orphans(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Orphans among source_id and target_id of relationships: relationship_id, ref_field, created_us, reason."""
    ends = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("target")) for f in ("source_id", "target_id")])).alias("e")
    refs = relationships.select(norm_id("id").alias("ref_id"), norm_id("memory_id").alias("scope"), F.col("created_at").alias("created"), "source_id", "target_id")
    refs = refs.select("ref_id", "scope", "created", ends).select("ref_id", "scope", "created", "e.field", "e.target")
    parents = entities.select("id", norm_id("memory_id").alias("scope"), (F.upper(F.trim("state")) == "DELETED").alias("deleted"), F.col("created_at").alias("created"))
    return orphan_references(refs, parents).withColumnsRenamed({"ref_id": "relationship_id", "field": "ref_field"})


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphans per field, month of creation (yyyy-MM, null if unknown) and reason."""
    month = F.date_format(F.timestamp_micros("created_us"), "yyyy-MM")
    return orphans.groupBy("ref_field", month.alias("month"), "reason").agg(F.count("*").alias("n_orphans"))
