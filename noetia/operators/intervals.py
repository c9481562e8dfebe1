"""Overlapping and gapped time intervals: continuous periods per key and the gaps between them.

Each key's periods are kept as an ordered map of disjoint intervals. An insertion finds the overlapped stretch by two
binary searches and merges it in place. The union of intervals is associative, so the map runs twice: on each input
partition before the shuffle, and again on the merged parts after it. Timelines are cut into buckets of
``BUCKET_YEARS`` years after the first merge, and the buckets of keys that still hold very many intervals into equal parts,
so a key that holds a large share of all rows is spread over as many tasks as it needs; the edges are stitched by a window.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noetia.session import BLANKS, cut, norm_id

ALWAYS_BEFORE, ALWAYS_AFTER = -(2**62), 2**62
TOLERANCE_US = 1_000_000
BUCKET_YEARS = 8
BUCKET_US = BUCKET_YEARS * 31_557_600 * 1_000_000
#: Timeline buckets from 1970 to 2050; what lies outside falls into the outermost ones.
FIRST_BUCKET, LAST_BUCKET = 0, 9
#: Keys that a map-side worker holds before it passes its merged intervals on.
HELD_KEYS = 20_000
#: Intervals of one key and bucket that a task takes; more are cut into parts, up to so many of a bucket (two days each).
PART_ROWS, PARTS = 500_000, 1440
#: Hash slots by which hot keys are looked for.
SLOTS = 4096


class IntervalMap:
    """Disjoint intervals in order. Those at most ``tolerance`` apart count as one."""

    __slots__ = ("starts", "ends", "tolerance")

    def __init__(self, tolerance: int = TOLERANCE_US):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.tolerance = tolerance

    def insert(self, start: int, end: int) -> None:
        i = bisect_left(self.ends, start - self.tolerance)
        j = bisect_right(self.starts, end + self.tolerance)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j] = [start]
        self.ends[i:j] = [end]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))


def _columns(batch: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in batch.columns]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: merge what one partition holds of each key, then cut the merged intervals at the bucket edges."""
    held: dict[tuple, IntervalMap] = {}
    schema = None

    def flush() -> pa.RecordBatch:
        rows = []
        for k, m in held.items():
            for s, e in zip(m.starts, m.ends):
                first, last = (min(max(x // BUCKET_US, FIRST_BUCKET), LAST_BUCKET) for x in (s, e))
                for b in range(first, last + 1):
                    rows.append((*k, b, s if b == first else b * BUCKET_US, e if b == last else (b + 1) * BUCKET_US))
        held.clear()
        *ks, start, end = schema
        types = [*(f.type for f in ks), pa.int32(), start.type, end.type]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*(f.name for f in ks), "bucket", "start", "end"])

    for batch in batches:
        schema = batch.schema
        *ks, starts, ends = _columns(batch)
        for k, s, e in zip(zip(*ks), starts, ends):
            m = held.get(k)
            if m is None:
                m = held[k] = IntervalMap()
            m.insert(s, e)
        if len(held) >= HELD_KEYS:
            yield flush()
    if held:
        yield flush()


def _sorted_groups(keys: int, emit):
    """Reduce side: rows arrive sorted by key; one key's map is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, IntervalMap(), []
        for batch in batches:
            *ks, starts, ends = _columns(batch)
            for k, s, e in zip(zip(*ks), starts, ends):
                if k != now:
                    if now is not None:
                        out.extend(emit(now, held))
                    now, held = k, IntervalMap()
                held.insert(s, e)
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if now is not None:
            out.extend(emit(now, held))
        if out:
            yield _batch(out)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), run.types)], names=run.names)

    return run


def _bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end) in microseconds to the same per bucket, merged within each input partition. ``bucket`` counts parts:
    a bucket is ``PARTS`` numbers wide, of which all but the hot keys' use the first."""
    schema = ", ".join([*(f"{k} string" for k in keys), "bucket int, start bigint, end bigint"])
    rows = df.select(*keys, "start", "end").mapInArrow(_combine, schema)
    return _parted(cut(rows), [*keys, "bucket"]).withColumn("bucket", F.col("bucket") * PARTS + F.col("part")).drop("part")


def _parted(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the ``part`` of its bucket; rows of hot keys are cut at the parts' edges.

    A key can be hot only if its hash slot is, so keys are counted in hot slots alone, and not at all where none is.
    """
    slot = F.pmod(F.xxhash64(*by), F.lit(SLOTS))
    hot = [r["s"] for r in rows.groupBy(slot.alias("s")).agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS).collect()]  # at most SLOTS
    if hot:
        n = rows.where(slot.isin(*hot)).groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS)
        parts = cut(n.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(by)], F.least(F.ceil(F.col("n") / F.lit(PART_ROWS)), F.lit(PARTS)).cast("int").alias("parts")))
        hot = parts.limit(1).count()
    if not hot:
        return rows.withColumn("part", F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(by)]
    r = rows.join(parts, same, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop(*[f"_h{i}" for i in range(len(by))])
    r = r.withColumn("from", F.col("bucket").cast("bigint") * F.lit(BUCKET_US)).withColumn("width", F.expr(f"{BUCKET_US} div parts"))
    at = lambda c: F.least(F.greatest(F.expr(f"({c} - `from`) div width"), F.lit(0)), F.col("parts") - 1).cast("int")
    r = r.withColumn("fp", at("start")).withColumn("lp", at("end")).withColumn("part", F.explode(F.sequence("fp", "lp")))
    edge = lambda k: F.col("from") + (F.col("part") + k).cast("bigint") * F.col("width")
    keys = [k for k in by if k != "bucket"]
    return r.select(*keys, "bucket", F.when(F.col("part") == F.col("fp"), F.col("start")).otherwise(edge(0)).alias("start"), F.when(F.col("part") == F.col("lp"), F.col("end")).otherwise(edge(1)).alias("end"), "part")


def _merged(df: DataFrame, keys: list[str], emit, extra: str) -> DataFrame:
    part = _bucketed(df, keys)
    by = [*keys, "bucket"]
    run = _sorted_groups(len(by), emit)
    names = [*by, *[x.split()[0] for x in extra.split(", ")]]
    run.names = names
    run.types = [pa.string()] * len(keys) + [pa.int32()] + [pa.int64() if x.endswith("bigint") else pa.int32() for x in extra.split(", ")]
    schema = ", ".join([*(f"{k} string" for k in keys), "bucket int", extra])
    return part.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _own_names(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys under names of this module's own, so that a key may have any name."""
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "start", "end").where("start <= end")


def interval_gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between the continuous periods of each key.

    ``df`` has string ``keys`` and ``start``, ``end`` (BIGINT, microseconds; use ALWAYS_BEFORE and ALWAYS_AFTER for open
    ends). Returns keys, ``gap_from``, ``gap_until`` in microseconds: the end of one period and the start of the next,
    where they are more than one second apart. Rows with a null or reversed bound do not count; repeated rows change
    nothing; null keys form a group of their own; an empty table gives no rows.
    """
    names, keys, df = keys, [f"_k{i}" for i in range(len(keys))], _own_names(df, keys)

    def emit(k, m):
        yield (*k, 0, m.starts[0], m.ends[-1])
        for f, u in m.gaps():
            yield (*k, 1, f, u)

    rows = _merged(df, keys, emit, "kind int, a bigint, b bigint")
    # kind 0: the extent of a bucket or part, few per key; kind 1: gaps inside it, each a window group of its own
    w = Window.partitionBy(*keys, "kind", F.when(F.col("kind") == 1, F.col("a")).otherwise(F.lit(0))).orderBy("bucket")
    before = F.lag("b").over(w)
    out = rows.select(*keys, "kind", F.when(F.col("kind") == 1, F.col("a")).otherwise(before).alias("gap_from"), F.when(F.col("kind") == 1, F.col("b")).otherwise(F.col("a")).alias("gap_until"))
    return out.where(F.col("gap_until") - F.col("gap_from") > TOLERANCE_US).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "gap_from", "gap_until")


def interval_periods(df: DataFrame, keys: list[str]) -> DataFrame:
    """Continuous periods of each key: keys, ``period_from``, ``period_until`` in microseconds, null where open.

    Same input and rules as :func:`interval_gaps`. Periods merged per bucket are stitched at the bucket edges.
    """
    names, keys, df = keys, [f"_k{i}" for i in range(len(keys))], _own_names(df, keys)

    def emit(k, m):
        for s, e in zip(m.starts, m.ends):
            yield (*k, s, e)

    rows = _merged(df, keys, emit, "start bigint, end bigint")
    w = Window.partitionBy(*keys).orderBy("bucket", "start")
    new = (F.col("start") - F.lag("end").over(w) > TOLERANCE_US) | F.lag("end").over(w).isNull()
    island = rows.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(*keys, "island").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    return out.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.when(F.col("s") > ALWAYS_BEFORE, F.col("s")).alias("period_from"), F.when(F.col("e") < ALWAYS_AFTER, F.col("e")).alias("period_until"))


def relationship_intervals(relationships: DataFrame) -> DataFrame:
    """``source_id``, ``relation_type`` (lower case, no outer blanks) and the validity period of each relationship.

    Rows without a source or with reversed bounds are left out; null bounds are open.
    """
    r = relationships.select(
        norm_id("source_id").alias("source_id"),
        F.lower(F.btrim(F.col("relation_type"), F.lit(BLANKS))).alias("relation_type"),
        F.coalesce(F.unix_micros(F.col("valid_from").cast("timestamp")), F.lit(ALWAYS_BEFORE)).alias("start"),
        F.coalesce(F.unix_micros(F.col("valid_until").cast("timestamp")), F.lit(ALWAYS_AFTER)).alias("end"),
    )
    return r.where("source_id is not null and start <= end")


def relationship_gaps(relationships: DataFrame) -> DataFrame:
    """Gaps per source and relation type in whole seconds since 1970."""
    g = interval_gaps(relationship_intervals(relationships), ["source_id", "relation_type"])
    sec = lambda c: F.floor(F.col(c) / F.lit(1_000_000)).cast("bigint")
    return g.select("source_id", "relation_type", sec("gap_from").alias("gap_from"), sec("gap_until").alias("gap_until"))


def relationship_periods(relationships: DataFrame) -> DataFrame:
    """Continuous periods per source and relation type in whole seconds since 1970, null where open."""
    p = interval_periods(relationship_intervals(relationships), ["source_id", "relation_type"])
    sec = lambda c: F.floor(F.col(c) / F.lit(1_000_000)).cast("bigint")
    return p.select("source_id", "relation_type", sec("period_from").alias("period_from"), sec("period_until").alias("period_until"))
