"""The engine's facade: ingest texts, ask questions, evolve the memory, edit the graph.

A language model and an embedding service are plug-ins; without them deterministic offline ones are used, so that every
result can be repeated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noetia.functions import expr as X
from noetia.functions import text as T
from noetia.operators import evolve as E
from noetia.operators import graph as G
from noetia.operators import resolve as R
from noetia.operators import retrieve as V
from noetia.operators.community import cluster_rollup, detect
from noetia.operators.graph import MemoryGraph
from noetia.schemas import CLUSTERS, EDGES, NODES, EngineConfig, IngestionError, QueryError
from noetia.session import cut, drop_cut, shared_dir
from noetia.sources.stores import ParquetStore, Store, read_files, web_pages

# The answers where nothing is found, and the confidence of a direct answer
NOTHING_FOUND = "No relevant information found in memory."
DIRECT_CONFIDENCE = 0.7
NO_ANSWER = "I don't have information about that in my memory."


#: Small edits of a graph after which its tables are written anew.
COMPACT_EVERY = 16


class LanguageModel(Protocol):
    def complete(self, prompt: str) -> str: ...


class EmbeddingModel(Protocol):
    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class VisionModel(Protocol):
    def describe(self, image: bytes) -> str: ...


class HashingEmbedding:
    """A bag of hashed words and word parts as a unit vector; empty texts have none."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in re.findall(r"\w+", (t or "").lower()):
                for part in (w, *(w[i : i + 4] for i in range(len(w) - 3))):
                    h = hashlib.blake2b(part.encode(), digest_size=8).digest()
                    v[int.from_bytes(h[:4], "little") % self.dim] += 1.0 if h[4] & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out


class RuleExtractor:
    """Entities and relations from capitalised phrases: ``X <verb> Y`` in one sentence relates X and Y."""

    VERBS = ("founded", "acquired", "joined", "left", "runs", "owns", "manages", "created", "works at", "works for", "is", "was", "uses", "supplies")
    ORG = re.compile(r"\b(?:Inc|Ltd|LLC|GmbH|Corp|Corporation|Company|AG|SARL|BV|Oy)\b")
    NAME = re.compile(r"(?:[A-Z][\w'’.-]*|[A-Z]{2,})(?:\s+(?:[A-Z][\w'’.-]*|of|de|van)(?=\s|[,.;:!?]|$))*")

    def complete(self, prompt: str) -> str:
        out: list[str] = []
        seen: set[str] = set()
        for s in re.split(r"(?<=[.!?])\s+|\n+", prompt.replace("$", "")):
            names = [(m.start(), m.end(), m.group().rstrip(".,;:'’")) for m in self.NAME.finditer(s)]
            names = [x for x in names if len(x[2]) > 2 and x[2].lower() not in {"the", "this", "that", "they", "about", "when", "only", "and"}]
            for _, _, n in names:
                if n not in seen:
                    seen.add(n)
                    kind = "Organization" if self.ORG.search(n) else "Person" if n.count(" ") in (1, 2) else "Concept"
                    about = re.sub(r"[$()]", " ", s.strip())
                    out.append(f'("entity"$$$${n}$$$${kind}$$$${about}$$$$)')
            for (_, e1, a), (b2, _, b) in zip(names, names[1:]):
                between = s[e1:b2].strip().lower()
                for v in self.VERBS:
                    if re.search(rf"\b{v}\b", between) and len(between) < 40:
                        year = re.search(r"\b(?:19|20)\d{2}\b", s)
                        about = re.sub(r"[$()]", " ", s.strip())
                        out.append(f'("relationship"$$$${a}$$$${b}$$$${v.replace(" ", "_")}$$$${about}$$$${year.group() if year else ""}$$$$)')
                        break
        return "\n".join(out)


def _embed_batches(model: EmbeddingModel, size: int = 100):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for i in range(0, len(texts), size):
                try:
                    out += model.embed([(t or "").encode()[:2000].decode("utf-8", "ignore") for t in texts[i : i + size]])
                except Exception:  # noqa: BLE001 - a failed batch leaves its rows without a vector
                    out += [None] * len(texts[i : i + size])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "embedding"])

    return run


def embed(df: DataFrame, model: EmbeddingModel, id_col: str, text: Column) -> DataFrame:
    """id, embedding of every row, in batches."""
    return df.select(F.col(id_col).cast("string").alias("id"), text.alias("t")).mapInArrow(_embed_batches(model), "id string, embedding array<float>")


class NoEmbedding:
    """A service that has no vector for anything."""

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [None] * len(texts)


class EmbeddingCache:
    """Vectors by the MD5 of their text, as a written table: texts that are known aren't embedded again, and a text that
    occurs often is embedded once."""

    SCHEMA = "key string, embedding array<float>"

    def __init__(self, spark: SparkSession):
        self.table = self._before = spark.createDataFrame([], self.SCHEMA)

    def embed(self, df: DataFrame, model: EmbeddingModel, id_col: str, text: Column) -> DataFrame:
        """id, embedding of every row; null texts have none."""
        rows = df.select(F.col(id_col).cast("string").alias("id"), text.alias("t")).withColumn("key", F.md5("t"))
        missing = rows.where("key is not null").groupBy("key").agg(F.min("t").alias("t")).join(self.table, "key", "left_anti")
        new = embed(missing, model, "key", F.col("t")).where("embedding is not null").select(F.col("id").alias("key"), "embedding")
        old, self._before, self.table = self._before, self.table, cut(self.table.unionByName(new))
        drop_cut(old)  # the table before is kept for results that still read it
        return rows.select("id", "key").join(self.table, "key", "left").select("id", "embedding")


def _ask(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers, errors = [], []
            for t in b.column(2).to_pylist():
                try:
                    answers.append(model.complete(t))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a failed chunk is reported, the others go on
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "chunk_index", "content", "answer", "error"])

    return run


ENTITY_FIELDS = ("name", "entity_type", "description", "aliases")
RELATION_FIELDS = ("source_id", "target_id", "relation_type", "description", "valid_from", "valid_until")


class Engine:
    """One memory of one user."""

    def __init__(self, spark: SparkSession, memory_id: str = "default", user_id: str = "default", config: EngineConfig | None = None, store: Store | None = None, model: LanguageModel | None = None, embedding: EmbeddingModel | None = None):
        self.spark, self.memory_id, self.user_id = spark, memory_id, user_id or "default"
        self.config = config or EngineConfig.from_env()
        self.store = store or ParquetStore(spark, f"{shared_dir(spark)}/memories")
        self.model, self.embedding = model or RuleExtractor(), embedding or HashingEmbedding(self.config.embedding_dim)
        self.graph = self.store.load(memory_id, self.user_id) or MemoryGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), spark.createDataFrame([], CLUSTERS), memory_id)
        self.events: DataFrame | None = None
        self.evolved_at: int | None = None
        self._pending = 0
        self.metrics = {"ingested": 0, "queries": 0, "evolutions": 0}

    # -- ingest ------------------------------------------------------------------------------------------------------------
    def extract(self, documents: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, results per document) of ``documents(doc_id, text)``."""
        size, overlap = self.config.kg_chunk_size, self.config.kg_chunk_overlap
        chunks = T.chunk_table(documents.withColumn("modality", F.lit("text")), lambda t, m: T.chunk_sentences(t, size, overlap))
        said = cut(chunks.select(F.col("source_id").alias("doc_id"), "chunk_index", "content").mapInArrow(_ask(self.model), "doc_id string, chunk_index int, content string, answer string, error string"))
        ent, rel = X.parse_tuples("answer", X.ENTITY_TUPLE, ENTITY_FIELDS), X.parse_tuples("answer", X.RELATION_TUPLE, RELATION_FIELDS)
        e = said.select("doc_id", X.byte_prefix("content", 500).alias("chunk"), F.explode(ent).alias("e")).where("e.name <> ''")
        found = e.groupBy(F.col("e.name").alias("name"), F.col("e.entity_type").alias("entity_type")).agg(
            F.max_by(F.col("e.description"), F.length("e.description")).alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(X.split_list(F.col("e.aliases")))))).alias("al"), F.min("chunk").alias("chunk")
        )
        found = found.select("name", "entity_type", "description", F.array_union(F.array("name"), "al").alias("aliases"), F.to_json(F.struct(F.col("chunk").alias("source_chunk"))).alias("properties"))
        nodes = G.new_nodes(found, self.memory_id, self.user_id, now)
        vec = embed(nodes, self.embedding, "id", F.concat_ws(": ", "name", "description"))
        nodes = cut(nodes.drop("embedding").join(vec, "id", "left").select(NODES.fieldNames()))
        r = said.select("doc_id", F.explode(rel).alias("r")).select("doc_id", "r.*").where("source_id <> '' and target_id <> ''")
        raw = r.groupBy("source_id", "target_id", "relation_type").agg(F.max("description").alias("description"), F.min(X.parse_date("valid_from")).alias("valid_from"), F.max(X.parse_date("valid_until")).alias("valid_until"))
        edges = G.resolve_endpoints(G.new_edges(raw, self.memory_id, now), nodes).dropDuplicates(["id"])
        per = said.select("doc_id", F.size(F.coalesce(ent, F.array())).cast("bigint").alias("n_entities"), F.size(F.coalesce(rel, F.array())).cast("bigint").alias("n_relations"), "error")
        docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"))
        return nodes, cut(edges), G.ingest_rollup(docs, per)

    def ingest(self, documents: DataFrame | str, metadata: dict | None = None, now: Column | None = None, progress: Callable[[str, int], None] | None = None) -> DataFrame:
        """Adds what texts say to the memory; returns a row per document. New nodes replace those with the same id.

        ``progress(step, rows)`` is called as the nodes and the edges are found and when the memory is updated."""
        now = F.current_timestamp() if now is None else now
        if isinstance(documents, str):
            documents = self.spark.createDataFrame([("text", documents)], "doc_id string, text string")
        if not {"doc_id", "text"} <= set(documents.columns):
            raise IngestionError("documents need doc_id and text", columns=documents.columns)
        nodes, edges, result = self.extract(documents, now)
        if metadata:
            extra = F.to_json(F.create_map(*[F.lit(str(x)) for kv in sorted(metadata.items()) for x in kv]))
            nodes = nodes.withColumn("properties", X.json_merge("properties", extra))
        tell = progress or (lambda step, rows: None)
        tell("nodes", nodes.count())
        tell("edges", edges.count())
        self._set(self.graph.add_nodes(nodes).add_edges(edges))
        self.metrics["ingested"] += 1
        tell("stored", self.metrics["ingested"])
        if self.config.auto_evolve:
            self.evolve(now=now, force=False)
        return result

    def ingest_files(self, path: str, vision: VisionModel | None = None, **options) -> tuple[DataFrame, DataFrame]:
        """(results, errors) of every file under a folder; images by what a vision model says of them."""
        files = cut(read_files(self.spark, path, vision=vision))
        done = self.ingest(files.where("error is null and text is not null").select(F.col("uri").alias("doc_id"), "text"), **options)
        return done, files.where("error is not null").select("uri", "error")

    def ingest_pages(self, pages: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
        """(results, errors) of ``pages(url, html)`` that the caller fetched."""
        got = cut(web_pages(pages))
        done = self.ingest(got.where("error is null and text is not null").select(F.col("url").alias("doc_id"), "text"), **options)
        return done, got.where("error is not null").select("url", "error")

    # -- query -------------------------------------------------------------------------------------------------------------
    def query(self, text: str, top_k: int | None = None, now: Column | None = None) -> dict:
        """answer, context, confidence, sources, nodes and edges for a question; the nodes found count an access."""
        if text is None:
            raise QueryError("a question is needed")
        now = F.current_timestamp() if now is None else now
        k = top_k or self.config.top_k
        q = V.MemoryQuery(0, text, tuple(self.embedding.embed([text])[0] or ()))
        scored = cut(V.score_nodes(self.graph.nodes, [q], self.config.min_importance, self.config.min_similarity))
        top = cut(V._top(scored, k))
        edges = cut(V.retrieved_edges(top, self.graph.edges))
        got = top.count()
        self.metrics["queries"] += 1
        if not got:
            return {"answer": NO_ANSWER, "context": NOTHING_FOUND, "confidence": 0.0, "sources": [], "nodes": top, "edges": edges}
        context = V.context_text(top, edges).first()["context"]
        self._set(self.graph.record_access(top.select("id", F.lit(1).alias("hits")), now), save=False)
        conf = V.confidence(scored).first()["confidence"]
        return {"answer": context, "context": context, "confidence": conf, "sources": V.sources(top).first()["sources"], "nodes": top, "edges": edges}

    def answer(self, text: str, clusters: DataFrame | None = None, now: Column | None = None) -> tuple[str, float]:
        """An answer of the language model and its confidence from 0 to 1.

        From the question's own context first, whose answers all count as equally sure; if it has none, or if ``clusters`` are
        given to be asked, from each community (in one distributed job), where a sure answer stands for itself and otherwise
        the five best are put together.
        """
        found = self.query(text, now=now)
        if not found["sources"]:
            return NOTHING_FOUND, 0.0
        direct = self._complete(f"Context:\n{found['context']}\n\nQuestion: {text}\nAnswer:")
        if direct and clusters is None:
            return direct, DIRECT_CONFIDENCE
        if clusters is not None:
            prompts = clusters.select(F.col("community").alias("doc_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("Community:\n"), "summary", F.lit(f"\n\nQuestion: {text}\nReply as JSON with answer and confidence (0-10).")).alias("content"))
            said = prompts.mapInArrow(_ask(self.model), "doc_id string, chunk_index int, content string, answer string, error string").where("answer is not null")
            best = said.select("doc_id", X.parse_answer("answer").alias("a")).where("a.answer <> ''").orderBy(F.desc("a.confidence"), "doc_id").limit(5).collect()
            if best:
                if len(best) == 1 or best[0].a.confidence >= 9:
                    return best[0].a.answer, best[0].a.confidence / 10
                joined = "\n".join(f"- {r.a.answer}" for r in best)
                whole = self._complete(f"Answers:\n{joined}\n\nQuestion: {text}\nCombine them:")
                return whole or best[0].a.answer, sum(r.a.confidence for r in best[:3]) / 3 / 10
        return (direct, DIRECT_CONFIDENCE) if direct else (found["context"], found["confidence"])

    def _complete(self, prompt: str) -> str:
        try:
            return (self.model.complete(prompt) or "").strip()
        except Exception:  # noqa: BLE001 - without the model the caller falls back
            return ""

    # -- evolve ------------------------------------------------------------------------------------------------------------
    def evolve(self, steps: tuple[str, ...] = ("CONSOLIDATION", "DECAY", "REINFORCEMENT"), now: Column | None = None, force: bool = True) -> DataFrame | None:
        """The log of the steps; None where the last evolution lies less than the interval back and ``force`` is off."""
        now = F.current_timestamp() if now is None else now
        at = self.spark.range(1).select(F.unix_micros(now).alias("t")).first()["t"]
        if not force and self.evolved_at is not None and at - self.evolved_at < self.config.evolve_interval_seconds * 1_000_000:
            return None
        self.evolved_at = at
        nodes, edges, log = E.evolve(self.graph.nodes, self.graph.edges, now, steps)
        self._set(replace(self.graph, nodes=nodes, edges=edges, version=self.graph.version + 1))
        self.events = log if self.events is None or log is None else self.events.unionByName(log)
        self.metrics["evolutions"] += 1
        return log

    def communities(self, algorithm: str = "greedy_modularity") -> DataFrame:
        m = detect(self.graph.nodes, self.graph.edges, algorithm)
        return cluster_rollup(m, self.graph.nodes, self.graph.edges, self.config.min_cluster_size)

    def resolve(self) -> DataFrame:
        return R.resolve(self.graph.nodes)

    # -- graph -------------------------------------------------------------------------------------------------------------
    def add_node(self, **values) -> str:
        row = cut(G.new_nodes(self.spark.createDataFrame([values]), self.memory_id, self.user_id))
        self._set(self.graph.add_nodes(row), small=True)
        return row.first()["id"]

    def add_edge(self, **values) -> str:
        row = cut(G.new_edges(self.spark.createDataFrame([values]), self.memory_id))
        self._set(self.graph.add_edges(row), small=True)
        return row.first()["id"]

    def get_node(self, node_id: str):
        return self.graph.node(node_id).first()

    def get_edge(self, edge_id: str):
        return self.graph.edge(edge_id).first()

    def update_node(self, node_id: str, **values) -> None:
        if self.get_node(node_id) is None:
            raise QueryError(f"no node {node_id}")
        at = F.lit(self.spark.range(1).select(F.current_timestamp().alias("t")).first()["t"])  # one time, however often it is read
        self._set(self.graph.update_node(node_id, at, **values), small=True)

    def delete_node(self, node_id: str) -> bool:
        known = self.get_node(node_id) is not None
        self._set(self.graph.remove_nodes(self.spark.createDataFrame([(node_id,)], "id string")), small=True)
        return known

    def delete_edge(self, edge_id: str) -> bool:
        known = self.get_edge(edge_id) is not None
        self._set(self.graph.remove_edges(self.spark.createDataFrame([(edge_id,)], "id string")), small=True)
        return known

    @staticmethod
    def has_results(response: dict) -> bool:
        """Whether a question found any node or edge."""
        return bool(response["sources"]) or response["nodes"].limit(1).count() > 0 or response["edges"].limit(1).count() > 0

    def stats(self) -> dict:
        return {r["kind"]: r["n"] for r in self.graph.counts().collect()} | self.metrics | {"version": self.graph.version}

    def save(self) -> None:
        self.store.save(self.graph)

    def clear(self) -> None:
        self.store.delete(self.memory_id)
        self.graph = MemoryGraph(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES), self.spark.createDataFrame([], CLUSTERS), self.memory_id)

    def _set(self, graph: MemoryGraph, save: bool = False, small: bool = False) -> None:
        """Later steps read tables, not an ever longer plan. A ``small`` change stays a plan over the last tables until
        ``COMPACT_EVERY`` of them have come together, so one edit doesn't write the whole memory."""
        self._pending = self._pending + 1 if small else 0
        if small and self._pending < COMPACT_EVERY:
            self.graph = graph
        else:
            self._pending = 0
            self.graph = replace(graph, nodes=cut(graph.nodes), edges=cut(graph.edges))
        if save:
            self.save()
