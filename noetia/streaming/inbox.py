"""Streams: an inbox folder, and keyed state over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from noetia.operators.intervals import IntervalMap
from noetia.sources.stores import extracted


def watch_inbox(spark: SparkSession, folder: str, archive: str, checkpoint: str, ingest: Callable[[DataFrame, int], None], reject: Callable[[DataFrame, int], None], once: bool = False):
    """Every file that appears in ``folder`` is extracted and passed to ``ingest``; files with an error go to ``reject``.
    Done files move to ``archive``. With ``once`` the query ends when nothing is left."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("cleanSource", "archive").option("sourceArchiveDir", archive).load(folder)

    def batch(df: DataFrame, number: int) -> None:
        rows = extracted(df).persist()
        ingest(rows.where("error is null"), number)
        reject(rows.where("error is not null"), number)
        rows.unpersist()

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def stream_results(docs: DataFrame, chunker: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Chunks of documents batch by batch, as they arrive."""
    return docs.writeStream.foreachBatch(lambda df, n: sink(chunker(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def access_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Accesses per user and window of event time, late events up to the watermark."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n_accesses")).select(F.col("window.start").alias("window_start"), "user_id", "n_accesses")


def interval_state(periods: DataFrame) -> DataFrame:
    """Streamed periods (key, start, end in microseconds) to their merged timeline: each key's disjoint intervals are kept
    in state, and every batch gives the changed keys with the number of periods and gaps they have now."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        m = IntervalMap()
        if state.exists:
            m.starts, m.ends = (list(x) for x in state.get)
        for pdf in frames:
            for s, e in zip(pdf["start"], pdf["end"]):
                if s <= e:
                    m.insert(int(s), int(e))
        state.update((m.starts, m.ends))
        yield pd.DataFrame({"key": [key[0]], "n_periods": [len(m.starts)], "n_gaps": [len(m.gaps())]})

    return periods.groupBy("key").applyInPandasWithState(update, "key string, n_periods int, n_gaps int", "starts array<bigint>, ends array<bigint>", "update", GroupStateTimeout.NoTimeout)
