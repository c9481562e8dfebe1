"""Context windows under a token budget, and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noetia.functions import expr as X

# Order of the sections for each priority, the share of the budget by place, and the sections' headings
ORDERS = {
    "communities": ("communities", "entities", "relationships", "documents"),
    "entities": ("entities", "relationships", "communities", "documents"),
    "relationships": ("relationships", "entities", "communities", "documents"),
    "documents": ("documents", "entities", "relationships", "communities"),
    "balanced": ("communities", "entities", "relationships", "documents"),
}
SHARES = (0.35, 0.30, 0.20, 0.15)
HEADINGS = {"communities": "Topic Summaries", "entities": "Relevant Entities", "relationships": "Relationships", "documents": "Supporting Documents"}
SEPARATORS = {"communities": "\n", "entities": "\n", "relationships": "\n", "documents": "\n\n"}


def allocate(budget: int, priority: str, empty: frozenset[str] = frozenset()) -> dict[str, int]:
    """Tokens of each section; an empty section's share is not passed on."""
    return {s: 0 if s in empty else int(budget * w) for s, w in zip(ORDERS.get(priority, ORDERS["balanced"]), SHARES)}


def within_budget(items: DataFrame, group: str, order: list[Column], line: Column, budget: int, separator: str = "\n") -> DataFrame:
    """The first items of each group whose lines fit: everything from the first overflow on is left out.

    Adds ``line``, ``tokens`` (of the line and its separator), ``place`` and ``used``. Every line costs a token at least, so
    the first ``budget`` items of a group hold all that fit: the window's group limit cuts each input partition to so many
    before the shuffle, and a group with a large share of all rows is never sorted in one task. Lines that cost nothing
    (empty ones) are left out.
    """
    d = items.withColumn("line", line).withColumn("tokens", X.token_estimate(F.concat("line", F.lit(separator)))).where("tokens > 0")
    w = Window.partitionBy(group).orderBy(*order)
    d = d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(budget, 0))
    return d.withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def entity_line() -> Column:
    text = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.col("name"))
    return F.concat(F.lit("• "), F.col("name"), F.lit(" ("), F.coalesce("entity_type", F.lit("")), F.lit("): "), X.byte_prefix(text, 200, "..."))


def relationship_line() -> Column:
    ends = F.concat(F.lit("• "), "source_id", F.lit(" --["), F.coalesce("relation_type", F.lit("")), F.lit("]--> "), "target_id")
    return F.when(F.col("description") != "", F.concat(ends, F.lit(": "), X.byte_prefix("description", 100, "..."))).otherwise(ends)


def validity_span(arrow: str = " to ", label: str = "valid: ") -> Column:
    """``[valid: yyyy to yyyy|present]``, empty where the start is unknown."""
    y = lambda c: F.date_format(c, "yyyy")
    return F.when(F.col("valid_from").isNotNull(), F.concat(F.lit(f"[{label}"), y("valid_from"), F.lit(arrow), F.coalesce(y("valid_until"), F.lit("present")), F.lit("]"))).otherwise(F.lit(""))


def section(kept: DataFrame, group: str, separator: str = "\n") -> DataFrame:
    """The kept lines of each group as one text, with their tokens and number."""
    g = kept.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("x"), F.sum("tokens").alias("tokens"), F.count("*").alias("kept"))
    return g.select(group, F.array_join(F.transform("x", lambda s: s["line"]), separator).alias("text"), "tokens", "kept")


def context_windows(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, documents: DataFrame, query: str, limit: int = 8000, priority: str = "balanced", include_query: bool = True) -> DataFrame:
    """The context of each memory for a question: memory_id, content, tokens_used, truncated, and for every section its text
    and its tokens.

    The question is charged first. Each section gets its share of the rest by its place in the order of the priority; what
    a memory without items leaves is not passed on. ``truncated``: a section with a text has left items out.
    """
    budget = limit - (int(len(f"Query: {query}\n\n".encode()) * 0.25) if include_query and query else 0)
    share = allocate(budget, priority)
    desc = lambda c: F.desc(F.coalesce(c, F.lit(0)))
    items = {
        "entities": (nodes.where("name is not null"), [desc(F.col("importance")), F.col("id")], entity_line()),
        "relationships": (edges.where("source_id is not null and target_id is not null"), [desc(F.col("weight") * F.col("confidence")), F.col("id")], relationship_line()),
        "communities": (clusters.where("summary is not null"), [desc(F.col("importance")), F.col("id")], F.concat(F.lit("• "), "summary")),
        "documents": (documents.where("text is not null"), [F.col("doc_id")], X.byte_prefix("text", 500, "...")),
    }
    out = None
    for k, (df, order, line) in items.items():
        df = df.where("memory_id is not null")
        s = section(within_budget(df, "memory_id", order, line, share[k], SEPARATORS[k]), "memory_id", SEPARATORS[k])
        have = df.groupBy("memory_id").agg(F.count("*").alias("have"))
        s = have.join(s, "memory_id", "left").select("memory_id", F.col("text").alias(k), F.coalesce("tokens", F.lit(0)).alias(f"{k}_tokens"), (F.coalesce("kept", F.lit(0)).between(1, F.col("have") - 1)).alias(f"{k}_cut"))
        out = s if out is None else out.join(s, "memory_id", "full")
    order = ORDERS.get(priority, ORDERS["balanced"])
    head = [F.lit(f"Query: {query}")] if include_query and query else []
    parts = [F.when(F.col(k) != "", F.concat(F.lit(f"\n## {HEADINGS[k]}\n"), F.col(k))) for k in order]
    truncated = F.greatest(*[F.coalesce(f"{k}_cut", F.lit(False)) for k in order])
    out = out.withColumn("content", F.concat_ws("\n", *head, *parts)).withColumn("tokens_used", X.token_estimate("content")).withColumn("truncated", truncated)
    return out.select("memory_id", "content", "tokens_used", "truncated", *order, *[F.coalesce(f"{k}_tokens", F.lit(0)).alias(f"{k}_tokens") for k in order])


def summarise(c: Column | str, limit: int = 500) -> Column:
    """The first five lines with text that are no headings, joined and cut to so many bytes."""
    lines = F.filter(F.transform(F.split(X.col(c), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: (x != "") & ~x.startswith("#"))
    return X.byte_prefix(F.array_join(F.slice(lines, 1, 5), " "), limit)


def model_summaries(texts: DataFrame, model, limit: int = 500) -> DataFrame:
    """``texts(id, text)``: id, summary by a language model in Arrow batches, cut to so many bytes; the cut text where the
    model fails, the extract of :func:`summarise` where there is no model."""
    if model is None:
        return texts.select("id", summarise("text", limit).alias("summary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                try:
                    s = None if t is None else model.complete(f"Summarize the following context in {limit} characters or less:\n\n{t}\n\nSummary:")
                except Exception:  # noqa: BLE001 - the text stands for a summary that failed
                    s = t
                out.append(None if s is None else s.encode()[:limit].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "summary"])

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, summary string")


def community_confidence(answers: DataFrame) -> DataFrame:
    """``answers(query_id, answer_id, confidence)``: the mean of a question's three best answers on the scale 0..1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "answer_id")
    return answers.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("query_id").agg((F.sum("confidence") / 3 / 10).alias("confidence"))
