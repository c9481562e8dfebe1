"""Stores of memories, a cache table, and file readers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from typing import Protocol
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from noetia.functions import expr as X
from noetia.functions import text as T
from noetia.operators.graph import MemoryGraph, touching, with_known_ends
from noetia.schemas import CLUSTERS, EDGES, NODES, StorageError
from noetia.session import cut, drop_cut


class Store(Protocol):
    def save(self, graph: MemoryGraph) -> None: ...
    def load(self, memory_id: str, user_id: str = "") -> MemoryGraph | None: ...
    def delete(self, memory_id: str) -> None: ...
    def clear(self, memory_id: str) -> None: ...
    def list(self) -> DataFrame: ...
    def close(self) -> None: ...
    def health(self) -> bool: ...


class Cache(Protocol):
    def put(self, rows: DataFrame, now: Column, ttl_seconds: int = 3600) -> None: ...
    def get(self, keys: DataFrame, now: Column) -> DataFrame: ...
    def invalidate(self, prefix: str = "") -> None: ...


class ParquetStore:
    """A folder of parquet tables. A save writes a new version of the memory beside the current one and then commits it by
    making one marker file, so a memory that is being read, or saved from itself, is never lost; a load prunes to the folder
    of the last version committed. The version before it is kept until the next save, for graphs that were loaded from it."""

    TABLES = ("nodes", "edges", "clusters")

    def __init__(self, spark: SparkSession, path: str, keep_dangling: bool = True):
        self.spark, self.path, self.keep_dangling = spark, path.rstrip("/"), keep_dangling

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _marks(self, memory_id: str) -> str:
        return f"{self.path}/_versions/{quote(memory_id, safe='')}"

    def _folder(self, name: str, memory_id: str, version: int) -> str:
        return f"{self.path}/{name}/{quote(memory_id, safe='')}/{version:012d}"

    def version(self, memory_id: str) -> int:
        """The last version committed, 0 for none."""
        return max((int(x) for x in self._names(self._marks(memory_id))), default=0)

    def save(self, graph: MemoryGraph) -> None:
        if not graph.memory_id:
            raise StorageError("a memory without an id can't be saved")
        edges = graph.edges if self.keep_dangling else with_known_ends(graph.edges, graph.nodes)
        m, was = graph.memory_id, self.version(graph.memory_id)
        for name, df, schema in zip(self.TABLES, (graph.nodes, edges, graph.clusters), (NODES, EDGES, CLUSTERS)):
            if df is None:
                df = self._read(name, schema, m, was)
            df.withColumn("memory_id", F.lit(m)).write.mode("overwrite").parquet(self._folder(name, m, was + 1))
        fs, mark = self._fs(f"{self._marks(m)}/{was + 1}")
        fs.create(mark, True).close()
        for old in self._names(self._marks(m)):
            if int(old) < was:
                self._drop(m, int(old))

    def _drop(self, memory_id: str, version: int) -> None:
        for path in (f"{self._marks(memory_id)}/{version}", *(self._folder(n, memory_id, version) for n in self.TABLES)):
            fs, p = self._fs(path)
            fs.delete(p, True)

    def _read(self, name: str, schema, memory_id: str, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._folder(name, memory_id, version))

    def load(self, memory_id: str, user_id: str = "", valid_at: Column | None = None) -> MemoryGraph | None:
        """Nodes of the user and those without one, and the edges among them; None where the memory is unknown."""
        version = self.version(memory_id)
        if not version:
            return None
        nodes, edges = (self._read(n, s, memory_id, version) for n, s in (("nodes", NODES), ("edges", EDGES)))
        if user_id:
            nodes = nodes.where(X.tenant(user_id))
            edges = touching(edges, nodes, "both")
        if valid_at is not None:
            edges = edges.where(X.valid_at(valid_at))
        return MemoryGraph(nodes, edges, self._read("clusters", CLUSTERS, memory_id, version), memory_id)

    def delete(self, memory_id: str) -> None:
        fs, p = self._fs(self._marks(memory_id))
        fs.delete(p, True)  # the memory is gone from here on
        for name in self.TABLES:
            fs, p = self._fs(f"{self.path}/{name}/{quote(memory_id, safe='')}")
            fs.delete(p, True)

    clear = delete

    def list(self) -> DataFrame:
        ids = [(unquote(x),) for x in self._names(f"{self.path}/_versions")]
        return self.spark.createDataFrame(ids, "memory_id string")

    def close(self) -> None:
        """Nothing is held open."""

    def health(self) -> bool:
        """Whether the folder's file system answers."""
        fs, p = self._fs(self.path)
        return fs.exists(p) or fs.mkdirs(p)


class JdbcStore:
    """The same tables in a database; filters are pushed to it. Vectors are stored as bytes, lists as JSON.

    A save goes to staging tables first; one transaction then replaces the memory's rows, so a second save doubles nothing
    and a failed one leaves the rows as they were.
    """

    SCHEMAS = {"nodes": NODES, "edges": EDGES, "clusters": CLUSTERS}
    #: Columns that a database must be able to compare.
    KEYS = ("id", "memory_id", "user_id", "source_id", "target_id", "state")

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    def _run(self, *statements: str) -> None:
        """The statements as one transaction."""
        jvm = self.spark._jvm
        props = jvm.java.util.Properties()
        for k, v in self.options.items():
            props.setProperty(k, v)
        if "driver" in self.options:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        c = jvm.java.sql.DriverManager.getConnection(self.url, props)
        try:
            c.setAutoCommit(False)
            for s in statements:
                st = c.createStatement()
                st.executeUpdate(s)
                st.close()
            c.commit()
        except Exception as e:
            c.rollback()
            raise StorageError("the database refused a statement", cause=str(e)[:300]) from e
        finally:
            c.close()

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options).load()

    def _exists(self, name: str) -> bool:
        try:
            return bool(self._table(name).columns)
        except Exception:  # noqa: BLE001 - the drivers' errors for a missing table differ
            return False

    def _flat(self, df: DataFrame, name: str) -> DataFrame:
        out = []
        for f in self.SCHEMAS[name].fields:
            kind, c = f.dataType.simpleString(), F.col(f.name) if f.name in df.columns else F.lit(None)
            out.append((vector_to_blob(c) if kind == "array<float>" else F.to_json(c) if kind.startswith(("array", "map")) else c.cast(kind)).alias(f.name))
        return df.select(*out)

    def _back(self, df: DataFrame, name: str) -> DataFrame:
        out = []
        have = {c.lower(): c for c in df.columns}
        for f in self.SCHEMAS[name].fields:
            kind, c = f.dataType.simpleString(), F.col(have[f.name])
            out.append((blob_to_vector(c) if kind == "array<float>" else F.from_json(c, kind) if kind.startswith(("array", "map")) else c.cast(kind)).alias(f.name))
        return df.select(*out)

    def _write(self, df: DataFrame, name: str, mode: str) -> None:
        keys = ", ".join(f"{k} VARCHAR(512)" for k in self.KEYS if k in df.columns)
        df.write.format("jdbc").options(url=self.url, dbtable=name, createTableColumnTypes=keys, **self.options).mode(mode).save()

    def save(self, graph: MemoryGraph) -> None:
        if not graph.memory_id:
            raise StorageError("a memory without an id can't be saved")
        mine, moves, staged = f"'{graph.memory_id.replace(chr(39), chr(39) * 2)}'", [], []
        for name, df in (("nodes", graph.nodes), ("edges", graph.edges), ("clusters", graph.clusters)):
            if df is None:
                continue
            flat = self._flat(df.withColumn("memory_id", F.lit(graph.memory_id)), name)
            stage = f"{name}_{uuid.uuid4().hex[:16]}"
            self._write(flat, stage, "overwrite")
            staged.append(stage)
            if not self._exists(name):
                self._write(flat.limit(0), name, "append")
            moves += [f'DELETE FROM {name} WHERE "memory_id" = {mine}', f"INSERT INTO {name} SELECT * FROM {stage}"]
        try:
            self._run(*moves)
        finally:
            self._run(*(f"DROP TABLE {s}" for s in staged))

    def load(self, memory_id: str, user_id: str = "", valid_at: Column | None = None) -> MemoryGraph | None:
        if not self._exists("nodes"):
            return None
        got = {n: self._table(n).where(F.col("memory_id") == memory_id) if self._exists(n) else self.spark.createDataFrame([], s) for n, s in self.SCHEMAS.items()}
        nodes, edges, clusters = (self._back(df, n) for n, df in got.items())
        if not nodes.limit(1).count() and not edges.limit(1).count():
            return None
        if user_id:
            nodes = nodes.where(X.tenant(user_id))
            edges = touching(edges, nodes, "both")
        if valid_at is not None:
            edges = edges.where(X.valid_at(valid_at))
        return MemoryGraph(nodes, edges, clusters, memory_id)

    def delete(self, memory_id: str) -> None:
        mine = memory_id.replace("'", "''")
        self._run(*(f"DELETE FROM {n} WHERE \"memory_id\" = '{mine}'" for n in self.SCHEMAS if self._exists(n)))

    clear = delete

    def list(self) -> DataFrame:
        if not self._exists("nodes"):
            return self.spark.createDataFrame([], "memory_id string")
        return self._table("nodes").select("memory_id").distinct()

    def close(self) -> None:
        """Connections last for one statement only."""

    def health(self) -> bool:
        try:
            self._run()
            return True
        except Exception:  # noqa: BLE001
            return False


def with_retries(f, attempts: int = 3, delay_seconds: float = 1.0, retry=lambda e: True):
    """The result of ``f()``; an error that ``retry`` says may pass is waited out, a fixed time between the attempts."""
    for left in range(attempts - 1, -1, -1):
        try:
            return f()
        except Exception as e:
            if not left or not retry(e):
                raise
            time.sleep(delay_seconds)


class GraphDatabaseStore:
    """Memories in a property-graph database, through sessions that the executors open themselves.

    ``connect()`` gives a session with ``run(statement, rows)``, which returns rows as dicts, and ``close()``; it must be
    picklable. A save merges nodes, then the edges of which both ends exist, then clusters, each in batches from the tasks
    that hold them; merging by id makes a repeated task harmless. What the memory no longer has is removed at the end.
    Vectors travel as lists, other lists and properties as they are; times as microseconds.
    """

    BATCH = 500
    # The statements
    STATEMENTS = {
        "memory": "UNWIND $rows AS r MERGE (m:Memory {id: r.id}) SET m.saved = r.saved",
        "nodes": "UNWIND $rows AS r MERGE (n:Entity {id: r.id, memory_id: r.memory_id}) SET n += r",
        "edges": "UNWIND $rows AS r MATCH (s:Entity {id: r.source_id, memory_id: r.memory_id}) MATCH (t:Entity {id: r.target_id, memory_id: r.memory_id}) MERGE (s)-[e:RELATES {id: r.id}]->(t) SET e += r",
        "clusters": "UNWIND $rows AS r MERGE (c:Cluster {id: r.id, memory_id: r.memory_id}) SET c += r",
        "old edges": "UNWIND $rows AS r MATCH (:Entity {memory_id: r.id})-[e:RELATES]->() WHERE e.saved <> r.saved DELETE e",
        "old nodes": "UNWIND $rows AS r MATCH (n:Entity {memory_id: r.id}) WHERE n.saved <> r.saved DETACH DELETE n",
        "old clusters": "UNWIND $rows AS r MATCH (c:Cluster {memory_id: r.id}) WHERE c.saved <> r.saved DELETE c",
        "get nodes": "UNWIND $rows AS r MATCH (n:Entity {memory_id: r.id}) RETURN properties(n) AS row",
        "get edges": "UNWIND $rows AS r MATCH (:Entity {memory_id: r.id})-[e:RELATES]->() RETURN properties(e) AS row",
        "get clusters": "UNWIND $rows AS r MATCH (c:Cluster {memory_id: r.id}) RETURN properties(c) AS row",
        "delete": "UNWIND $rows AS r MATCH (x) WHERE x.memory_id = r.id OR (x:Memory AND x.id = r.id) DETACH DELETE x",
        "list": "MATCH (m:Memory) RETURN m.id AS memory_id",
        "health": "RETURN 1 AS ok",
    }
    SCHEMAS = {"nodes": NODES, "edges": EDGES, "clusters": CLUSTERS}

    def __init__(self, spark: SparkSession, connect, attempts: int = 3, delay_seconds: float = 1.0):
        self.spark, self.connect, self.attempts, self.delay = spark, connect, attempts, delay_seconds

    def _run(self, name: str, rows: list[dict] | None = None) -> list[dict]:
        def once():
            session = self.connect()
            try:
                return list(session.run(self.STATEMENTS[name], rows or []))
            finally:
                session.close()

        return with_retries(once, self.attempts, self.delay)

    def _sink(self, df: DataFrame, name: str, saved: str) -> int:
        connect, statement, size, attempts, delay = self.connect, self.STATEMENTS[name], self.BATCH, self.attempts, self.delay
        flat = df.select(*[F.unix_micros(f.name).alias(f.name) if f.dataType.simpleString() == "timestamp" else F.col(f.name) for f in df.schema.fields], F.lit(saved).alias("saved"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            session, n = connect(), 0
            try:
                for b in batches:
                    for at in range(0, b.num_rows, size):
                        rows = b.slice(at, size).to_pylist()
                        with_retries(lambda rows=rows: list(session.run(statement, rows)), attempts, delay)
                        n += len(rows)
            finally:
                session.close()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        return flat.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def save(self, graph: MemoryGraph) -> None:
        if not graph.memory_id:
            raise StorageError("a memory without an id can't be saved")
        saved = uuid.uuid4().hex
        mine = lambda df: df.withColumn("memory_id", F.lit(graph.memory_id))
        row = [{"id": graph.memory_id, "saved": saved}]
        self._run("memory", row)
        self._sink(mine(graph.nodes), "nodes", saved)
        self._sink(with_known_ends(mine(graph.edges), mine(graph.nodes)), "edges", saved)
        if graph.clusters is not None:
            self._sink(mine(graph.clusters), "clusters", saved)
        for name in ("old edges", "old nodes", *(["old clusters"] if graph.clusters is not None else [])):
            self._run(name, row)

    def _read(self, name: str, memory_id: str) -> DataFrame:
        """One memory's rows, read in one task of an executor."""
        connect, statement, schema, attempts, delay = self.connect, self.STATEMENTS[f"get {name}"], self.SCHEMAS[name], self.attempts, self.delay
        times = [f.name for f in schema.fields if f.dataType.simpleString() == "timestamp"]
        plain = T_.StructType([T_.StructField(f.name, T_.LongType() if f.name in times else f.dataType) for f in schema.fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            for b in batches:
                for key in b.column(0).to_pylist():
                    session = connect()
                    try:
                        rows = with_retries(lambda key=key: [r["row"] for r in session.run(statement, [{"id": key}])], attempts, delay)
                    finally:
                        session.close()
                    for at in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], to_arrow_schema(plain))

        got = self.spark.createDataFrame([(memory_id,)], "id string").mapInArrow(run, plain)
        return cut(got.select(*[F.timestamp_micros(f.name).alias(f.name) if f.name in times else F.col(f.name) for f in schema.fields]))

    def load(self, memory_id: str, user_id: str = "", valid_at: Column | None = None) -> MemoryGraph | None:
        nodes, edges, clusters = (self._read(n, memory_id) for n in self.SCHEMAS)
        if not nodes.limit(1).count() and not edges.limit(1).count():
            return None
        if user_id:
            nodes = nodes.where(X.tenant(user_id))
            edges = touching(edges, nodes, "both")
        if valid_at is not None:
            edges = edges.where(X.valid_at(valid_at))
        return MemoryGraph(nodes, edges, clusters, memory_id)

    def delete(self, memory_id: str) -> None:
        self._run("delete", [{"id": memory_id}])

    clear = delete

    def list(self) -> DataFrame:
        return self.spark.createDataFrame([(r["memory_id"],) for r in self._run("list")], "memory_id string")

    def close(self) -> None:
        """Sessions last for one statement or one task."""

    def health(self) -> bool:
        try:
            return bool(self._run("health"))
        except Exception:  # noqa: BLE001
            return False


class CacheTable:
    """(key, value, expires_at) as a written table: reads skip what has expired, invalidation is by key prefix. A change
    writes the table anew without what has expired, so neither the plan nor the table grows with the number of calls."""

    SCHEMA = "key string, value string, expires_at timestamp"

    def __init__(self, spark: SparkSession):
        self.table = self._before = spark.createDataFrame([], self.SCHEMA)

    @staticmethod
    def key(prefix: str, kind: str, user: str, memory: str, text: Column) -> Column:
        return F.concat_ws(":", F.lit(prefix), F.lit(kind), F.lit(user), F.lit(memory), F.md5(text))

    def _become(self, table: DataFrame) -> None:
        old, self._before, self.table = self._before, self.table, cut(table)
        drop_cut(old)  # the table before is kept for results that still read it

    def put(self, rows: DataFrame, now: Column, ttl_seconds: int = 3600) -> None:
        """Of several rows for one key the largest value stays."""
        new = rows.groupBy("key").agg(F.max("value").alias("value")).withColumn("expires_at", F.timestamp_micros(F.unix_micros(now) + ttl_seconds * 1_000_000))
        self._become(self.table.where(F.col("expires_at") > now).join(new.select("key"), "key", "left_anti").unionByName(new))

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        return self.table.where(F.col("expires_at") > now).join(keys.select("key").distinct(), "key", "left_semi")

    def invalidate(self, prefix: str = "") -> None:
        self._become(self.table.where(~F.col("key").startswith(prefix)) if prefix else self.table.limit(0))


# -- vectors as bytes --------------------------------------------------------------------------------------------------------
def _to_blob(s: pd.Series) -> pd.Series:
    import numpy as np

    return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def _from_blob(s: pd.Series) -> pd.Series:
    import numpy as np

    return s.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())


def vector_to_blob(c: str | Column) -> Column:
    return F.pandas_udf(_to_blob, "binary")(c)


def blob_to_vector(c: str | Column) -> Column:
    """Little-endian floats; bytes of another length become null."""
    return F.pandas_udf(_from_blob, "array<float>")(c)


# -- files -----------------------------------------------------------------------------------------------------------------
def _decode(content: pd.Series, modality: pd.Series, ext: pd.Series) -> pd.Series:
    def one(b, m, x):
        if b is None:
            return None
        b = bytes(b)
        if x == ".docx":
            return T.docx_text(b)
        return T.pdf_text(b) if m == "pdf" else b.decode("utf-8", errors="replace") if m != "image" else None

    return pd.Series([one(*r) for r in zip(content, modality, ext)])


def read_files(spark: SparkSession, path: str, streaming: bool = False, vision=None) -> DataFrame:
    """uri, modality, text, error of every file under a folder; unsupported files carry an error instead of a text."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if streaming else spark.read
    return extracted(reader.format("binaryFile").load(path), vision)


def extracted(files: DataFrame, vision=None) -> DataFrame:
    """The same of ``files(path, content)`` from any source. An image's text is what ``vision.describe(bytes)`` says of it,
    or a note of its size without such a model or where it fails."""
    ext = X.extension("path")
    d = files.withColumn("modality", X.detect_modality("path", F.col("content"))).withColumn("ext", ext)
    ok = F.col("ext").isin(*X.EXTENSIONS, ".txt", ".docx")
    text = F.when(F.col("modality") == "image", F.pandas_udf(_describer(vision), "string")("content")).otherwise(F.pandas_udf(_decode, "string")("content", "modality", "ext"))
    d = d.withColumn("text", F.when(ok, text))
    return d.select(F.col("path").alias("uri"), "modality", "text", F.when(~ok, F.concat(F.lit("unsupported file type "), "ext")).alias("error"))


def _describer(vision):
    def describe(content: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            try:
                if vision is not None and (said := vision.describe(bytes(b))):
                    return said
            except Exception:  # noqa: BLE001 - the note stands for a description that failed
                pass
            return f"[Image of {len(b)} bytes]"

        return content.map(one)

    return describe


def web_pages(pages: DataFrame) -> DataFrame:
    """``pages(url, html)``: url, text, error; addresses other than http(s) are errors. Fetching is left to the caller."""
    ok = F.col("url").rlike("^https?://")
    return pages.select("url", F.when(ok, X.html_text("html")).alias("text"), F.when(~F.coalesce(ok, F.lit(False)), F.lit("not a web address")).alias("error"))
