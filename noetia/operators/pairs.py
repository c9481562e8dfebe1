"""Similar pairs inside groups, found block by block: only pairs that pass come out, never a group's full square."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2048


def block_pairs(df: DataFrame, group: list[str], id_col: str, kernel: Callable, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs ``kernel(left, right, same)`` on every pair of row blocks of every group.

    ``left`` and ``right`` are lists of rows (dicts) of at most about ``block_rows`` each; ``same`` tells that they are one
    block. The kernel yields tuples of ``schema``. A group of any size is spread over its block pairs, so no task holds
    more than two blocks.
    """
    size = df.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("_nb"))
    d = df.join(size, group).withColumn("_b", F.pmod(F.xxhash64(id_col), F.col("_nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_o")
    d = d.select(*df.columns, "_b", other).withColumn("_lo", F.least("_b", "_o")).withColumn("_hi", F.greatest("_b", "_o"))
    keys = [*group, "_lo", "_hi"]
    cols = d.columns
    names = [x.strip().split()[0] for x in schema.split(",")]
    at = [cols.index(k) for k in keys]
    b_at, lo_at, hi_at = cols.index("_b"), cols.index("_lo"), cols.index("_hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, right, out = None, [], [], []

        def flush():
            lo, hi = now[-2:]
            out.extend(kernel(left, left if lo == hi else right, lo == hi))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple(row[i] for i in at)
                if key != now:
                    if now is not None:
                        flush()
                    now, left, right = key, [], []
                    if len(out) > 20_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])
                        out = []
                (left if row[b_at] == row[lo_at] else right).append(dict(zip(cols, row)))
        if now is not None:
            flush()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])

    return d.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def cosines(left: list[dict], right: list[dict]) -> np.ndarray:
    """Cosines of all pairs; 0 where lengths differ, or a vector is missing, zero or not finite."""
    out = np.zeros((len(left), len(right)))
    dims = {len(r["embedding"] or ()) for r in left} & {len(r["embedding"] or ()) for r in right}
    for d in dims - {0}:
        at, to = ([i for i, r in enumerate(rows) if len(r["embedding"] or ()) == d] for rows in (left, right))
        a, b = (np.array([rows[i]["embedding"] for i in ix], float) for rows, ix in ((left, at), (right, to)))
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            s = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
        out[np.ix_(at, to)] = np.where(np.isfinite(s), s, 0.0)
    return out
