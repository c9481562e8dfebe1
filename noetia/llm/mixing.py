"""Mixing sources to target weights.

Each source's documents are laid end to end in a pseudorandom order and cut into blocks of ``BLOCK_TOKENS`` tokens. The
output is shards of ``SHARD_BLOCKS`` slots. How many slots of a shard each source gets is a multinomial draw on condition
that the shards add up to the sources' quotas, which is a draw without replacement. It runs down a binary tree of the
shards, so any shard can be drawn by itself, at any number of shards in the same way. A source's slots run through pseudorandom permutations of its blocks, one per repetition, and the
blocks are joined by their index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noetia.llm.tokens import count_tokens
from noetia.session import BLANKS, cut

BLOCK_TOKENS, SHARD_BLOCKS = 1024, 256
SEED = 9_2024
#: Buckets of a source's documents: prefix sums run within a bucket and over the buckets' totals.
BUCKETS = 4096
#: Standard deviations around the mode within which a count is drawn; what lies beyond has no weight in double precision.
TAIL = 12


def source_name(c: Column) -> Column:
    """A source in lower case, with underscores for hyphens and blanks; null if blank."""
    t = F.regexp_replace(F.lower(F.btrim(c, F.lit(BLANKS))), r"[-\s]+", "_")
    return F.when(F.length(t) > 0, t)


@dataclass(frozen=True)
class Plan:
    """Quota in blocks, number of blocks and seed number of each source, in order of name."""

    sources: tuple[str, ...]
    blocks: tuple[int, ...]
    quota: tuple[int, ...]

    @property
    def n_shards(self) -> int:
        return -(-sum(self.quota) // SHARD_BLOCKS)


def quotas(shares: dict[str, float], repeats: dict[str, float], blocks: dict[str, int], total: int | None = None) -> Plan:
    """The largest mixture (or ``total`` blocks, if that is less) that keeps every share and no source above its repeats.

    Shares are taken relative to the sources that have blocks, as an empty source can't contribute.
    """
    names = sorted(s for s, x in shares.items() if x > 0 and blocks.get(s, 0) > 0 and repeats[s] > 0)
    weight = sum(shares[s] for s in names)
    cap = {s: math.floor(repeats[s] * blocks[s] + 1e-9) for s in names}
    if not names:
        return Plan((), (), ())
    most = min(cap[s] * weight / shares[s] for s in names)
    most = most if total is None else min(most, total)
    want = {s: most * shares[s] / weight for s in names}
    got = {s: min(cap[s], math.floor(want[s] + 1e-9)) for s in names}
    for s in sorted(names, key=lambda s: (got[s] - want[s], s))[: int(round(sum(want.values()))) - sum(got.values())]:
        got[s] += got[s] < cap[s]
    return Plan(tuple(names), tuple(blocks[s] for s in names), tuple(got[s] for s in names))


def drawn(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` draws without replacement from ``good + bad`` are good: inversion around the mode.

    Neighbouring probabilities have a simple ratio, so no factorials are needed and any size of numbers will do.
    """
    lo, hi = max(0, n - bad), min(good, n)
    if lo == hi:
        return lo
    total = good + bad
    p = good / total
    reach = int(TAIL * math.sqrt(n * p * (1 - p) * (total - n) / max(total - 1, 1))) + TAIL
    mode = (n + 1) * (good + 1) // (total + 2)
    lo, hi = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    below = np.cumsum(np.exp(weight - weight.max()))
    return lo + int(np.searchsorted(below, rng.random() * below[-1], "right"))


def split_counts(counts: np.ndarray, left: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of each source fall into the first ``left`` of all slots, source by source."""
    rest = int(counts.sum())
    if left >= rest:
        return counts.copy()
    rng = np.random.default_rng(seed)
    out = np.zeros_like(counts)
    for i, c in enumerate(counts.tolist()):
        out[i] = drawn(c, rest - c, left, rng)
        rest, left = rest - c, left - int(out[i])
    return out


def shard_counts(plan: Plan, shard: int, memo: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before the shard, slots in it), by walking down the tree of shards."""
    lo, hi = 0, plan.n_shards
    counts, before = np.array(plan.quota, np.int64), np.zeros(len(plan.quota), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = None if memo is None else memo.get((lo, hi))
        if left is None:
            left = split_counts(counts, (mid - lo) * SHARD_BLOCKS, (SEED, lo, hi))
            if memo is not None:
                memo[(lo, hi)] = left
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, counts, before = mid, counts - left, before + left
    return before, counts


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, computed for single places: a Feistel network with cycle walking."""
    if n <= 1:
        return np.zeros_like(i)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = i.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        y = x[todo]
        a, b = y >> np.uint64(half), y & mask
        for r in range(6):
            h = (b + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            a, b = b, (a ^ (h >> np.uint64(33))) & mask
        x[todo] = (a << np.uint64(half)) | b
        todo[todo] = x[todo] >= np.uint64(n)
    return x.astype(np.int64)


SLOT = "shard bigint, slot int, source string, repetition int, block bigint"


def _slots(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            for shard in b.column(0).to_pylist():
                before, here = shard_counts(plan, shard, memo)
                who = np.repeat(np.arange(len(here)), here)
                if not len(who):
                    continue
                nth = np.concatenate([np.arange(x, x + k) for x, k in zip(before, here)])
                n = np.array(plan.blocks)[who]
                rep, block = nth // n, np.empty(len(who), np.int64)
                for s in np.unique(who):
                    for r in np.unique(rep[who == s]):
                        at = (who == s) & (rep == r)
                        block[at] = permute((nth % n)[at], plan.blocks[s], SEED + 1000 * int(s) + int(r) * 1_000_003)
                order = np.random.default_rng((SEED, shard, 7)).permutation(len(who))
                who, rep, block = who[order], rep[order], block[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(who), shard)), pa.array(np.arange(len(who), dtype=np.int32)), pa.array([plan.sources[s] for s in who]), pa.array(rep.astype(np.int32)), pa.array(block)],
                    names=["shard", "slot", "source", "repetition", "block"],
                )
            if len(memo) > 100_000:
                memo.clear()

    return run


def segments(counted: DataFrame) -> DataFrame:
    """``source``, ``block``, ``doc_id``, ``token_from``, ``token_to``: which tokens of which documents make up each block.

    ``counted``: doc_id, source, n_tokens > 0. A source that holds a large share of all documents is spread over
    ``BUCKETS`` buckets of a hash order; only the buckets' totals are summed up over the whole source.
    """
    d = counted.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("bucket", F.shiftrightunsigned("h", 64 - int(math.log2(BUCKETS))))
    total = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = total.select("source", "bucket", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("base"))
    w = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(start, ["source", "bucket"]).withColumn("at", F.col("at") + F.col("base"))
    first, last = F.expr(f"at div {BLOCK_TOKENS}"), F.expr(f"(at + n_tokens - 1) div {BLOCK_TOKENS}")
    d = d.select("source", "doc_id", "at", "n_tokens", F.explode(F.sequence(first, last)).alias("block"))
    edge = F.col("block") * BLOCK_TOKENS - F.col("at")
    return d.select("source", "block", "doc_id", F.greatest(edge, F.lit(0)).alias("token_from"), F.least(edge + BLOCK_TOKENS, F.col("n_tokens")).alias("token_to"))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    The mixture has shard, slot, source, repetition, block, doc_id, token_from, token_to: the documents' tokens in the
    order of the output. The shares have, per target source, target_share, max_repeats, available_tokens, used_tokens,
    share and repeats as reached. Without ``total_tokens`` the mixture is as large as the caps allow.

    Sources are compared in lower case with underscores. Documents without tokens (null, empty text), without a source or
    with a source that has no target are not used. A target without documents, share or repeats gets a share of 0 and the
    others keep their proportions. Targets with a null source, share or cap are left out; of several rows for one source
    the largest values hold. Repeated texts under other ids count as documents of their own. With no documents or targets
    the mixture is empty.
    """
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share >= 0 and max_repeats >= 0")
    t = t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    d = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("doc_id is not null and source is not null and text <> ''").join(t.select("source"), "source", "left_semi")
    counted = cut(count_tokens(d, ["doc_id", "source"], path=path).where("n_tokens > 0"))
    have = {r["source"]: r["n"] for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per target
    rows = t.collect()
    blocks = {s: -(-n // BLOCK_TOKENS) for s, n in have.items()}
    plan = quotas({r["source"]: r["target_share"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows}, blocks, None if total_tokens is None else -(-total_tokens // BLOCK_TOKENS))
    spark = documents.sparkSession
    shards = spark.range(0, plan.n_shards, 1, min(max(1, plan.n_shards), 4 * spark.sparkContext.defaultParallelism))
    # the slots are as many as the blocks of the output, which their plan's size estimate doesn't show: no broadcast
    slots = shards.mapInArrow(_slots(plan), SLOT).hint("merge")
    mixed = slots.join(segments(counted), ["source", "block"]).select("shard", "slot", "source", "repetition", "block", "doc_id", "token_from", "token_to")
    used = mixed.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used_tokens"))
    total = used.agg(F.sum("used_tokens").alias("all_tokens"))
    avail = counted.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    out = t.join(avail, "source", "left").join(used, "source", "left").join(F.broadcast(total))  # one row
    shares = out.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
        F.coalesce(F.col("used_tokens") / F.col("available_tokens"), F.lit(0.0)).alias("repeats"),
    )
    return mixed, shares
