import datetime as dt

import pytest
from pyspark.sql import functions as F

from noetia.engine import Engine
from noetia.operators.graph import MemoryGraph, new_edges, new_nodes
from noetia.schemas import CLUSTERS
from noetia.sources.stores import CacheTable, GraphDatabaseStore, JdbcStore, ParquetStore, extracted, web_pages, with_retries
from tests.conftest import rows



def now(at="2024-01-31 00:00:00"):
    return F.lit(at).cast("timestamp")


def graph(spark, memory="m'1/a", n=5):
    nodes = new_nodes(spark.createDataFrame([(f"n{i}", f"Name {i}", [f"a{i}", "b"], [0.5, float(i)]) for i in range(n)], "id string, name string, aliases array<string>, embedding array<float>"), memory, "u", now())
    edges = new_edges(spark.createDataFrame([(f"e{i}", f"n{i}", f"n{(i + 1) % n}", "knows", dt.datetime(2001, 2, 3, 4, 5, 6)) for i in range(n)], "id string, source_id string, target_id string, relation_type string, valid_from timestamp"), memory, now())
    clusters = spark.createDataFrame([("c1", memory, "about", ["Name 1"], None, 5, 0.5, None, None, None, "{}")], CLUSTERS)
    return MemoryGraph(nodes, edges, clusters, memory)


def same(a, b):
    for x, y in ((a.nodes, b.nodes), (a.edges, b.edges), (a.clusters, b.clusters)):
        assert rows(x.select(sorted(x.columns))) == rows(y.select(sorted(y.columns)))


def test_a_loaded_memory_can_be_saved(spark, tmp_path):
    st, g = ParquetStore(spark, str(tmp_path)), graph(spark)
    st.save(g)
    first = st.load(g.memory_id)
    same(first, g)
    st.save(first)
    same(st.load(g.memory_id), g)
    same(first, g)  # still readable after one more save
    assert [r.memory_id for r in st.list().collect()] == [g.memory_id] and st.health()
    for _ in range(3):
        Engine(spark, g.memory_id, "u", store=st).save()
    same(st.load(g.memory_id), g)
    st.delete(g.memory_id)
    assert st.load(g.memory_id) is None and st.list().count() == 0


def test_a_save_that_breaks_keeps_the_rows(spark, tmp_path):
    st, g = ParquetStore(spark, str(tmp_path)), graph(spark)
    st.save(g)
    bad = MemoryGraph(g.nodes, g.edges.withColumn("weight", F.raise_error(F.lit("broken")).cast("double")), g.clusters, g.memory_id)
    with pytest.raises(Exception):
        st.save(bad)
    same(st.load(g.memory_id), g)


def test_database_store(spark, tmp_path):
    st = JdbcStore(spark, f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    g, other = graph(spark), graph(spark, "m2", 3)
    assert st.load(g.memory_id) is None and st.health()
    for x in (g, other, g):
        st.save(x)
    same(st.load(g.memory_id), g)
    same(st.load("m2", "u"), other)
    assert st.load("m2", "someone").nodes.count() == 0
    st.delete(g.memory_id)
    assert st.load(g.memory_id) is None and [r.memory_id for r in st.list().collect()] == ["m2"]


def test_cache_plan_does_not_grow(spark):
    c = CacheTable(spark)
    for i in range(4):
        c.put(spark.createDataFrame([(f"k:{i}", str(i)), (f"k:{i}", "0"), ("same", str(i))], "key string, value string"), now())
    assert rows(c.get(c.table, now())) and {r.key: r.value for r in c.get(c.table, now()).collect()} == {"k:0": "0", "k:1": "1", "k:2": "2", "k:3": "3", "same": "3"}
    assert len(c.table._jdf.queryExecution().toString()) < 3000
    later = now("2024-01-31 02:00:00")
    assert c.get(c.table, later).count() == 0
    c.invalidate("k:")
    assert [r.key for r in c.table.collect()] == ["same"]


class Database:
    """A property-graph database in one file; it does what the store's statements say. Every third call fails once."""

    def __init__(self, path):
        self.path = path

    def __call__(self):
        return self

    def close(self):
        pass

    def run(self, statement, rows):
        import fcntl
        import pickle
        from pathlib import Path

        with open(f"{self.path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            f = Path(self.path)
            db = pickle.loads(f.read_bytes()) if f.exists() else {"Memory": {}, "Entity": {}, "RELATES": {}, "Cluster": {}, "calls": 0}
            db["calls"] += 1
            if db["calls"] % 3 == 2:
                f.write_bytes(pickle.dumps(db))
                raise ConnectionError("try again")
            out = self.do(db, statement, rows)
            f.write_bytes(pickle.dumps(db))
            return out

    def do(self, db, statement, rows):
        name = next(k for k, v in GraphDatabaseStore.STATEMENTS.items() if v == statement)
        into = {"memory": "Memory", "nodes": "Entity", "edges": "RELATES", "clusters": "Cluster"}
        if name in into:
            for r in rows:
                if name != "edges" or all((r[x], r["memory_id"]) in db["Entity"] for x in ("source_id", "target_id")):
                    db[into[name]][(r["id"], r.get("memory_id"))] = r
        kind = {"old edges": "RELATES", "old nodes": "Entity", "old clusters": "Cluster", "get nodes": "Entity", "get edges": "RELATES", "get clusters": "Cluster"}.get(name)
        if name.startswith("old"):
            db[kind] = {k: v for k, v in db[kind].items() if k[1] != rows[0]["id"] or v["saved"] == rows[0]["saved"]}
        if name.startswith("get"):
            return [{"row": v} for k, v in db[kind].items() if k[1] == rows[0]["id"]]
        if name == "delete":
            for t in into.values():
                db[t] = {k: v for k, v in db[t].items() if rows[0]["id"] not in (k[1], k[0] if t == "Memory" else None)}
        return [{"memory_id": k[0]} for k in db["Memory"]] if name == "list" else [{"ok": 1}] if name == "health" else []


def test_graph_database_store(spark, tmp_path):
    st = GraphDatabaseStore(spark, Database(str(tmp_path / "db")), delay_seconds=0.0)
    g = graph(spark, "m1", 7)
    dangling = new_edges(spark.createDataFrame([("x", "n1", "gone", "knows")], "id string, source_id string, target_id string, relation_type string"), "m1", now())
    assert st.load("m1") is None and st.health()
    st.save(MemoryGraph(g.nodes, g.edges.unionByName(dangling), g.clusters, "m1"))
    same(st.load("m1"), g)
    st.save(graph(spark, "m2", 2))
    smaller = graph(spark, "m1", 3)
    st.save(smaller)
    same(st.load("m1"), smaller)
    assert sorted(r.memory_id for r in st.list().collect()) == ["m1", "m2"]
    st.delete("m1")
    assert st.load("m1") is None and st.load("m2") is not None


def test_retries_end():
    calls = []

    def f():
        calls.append(1)
        raise ValueError("no")

    with pytest.raises(ValueError):
        with_retries(f, 3, 0.0)
    assert len(calls) == 3
    with pytest.raises(ValueError):
        with_retries(f, 3, 0.0, retry=lambda e: False)
    assert len(calls) == 4


class Sees:
    def describe(self, image):
        if len(image) > 20:
            raise ValueError("too large")
        return f"a picture of {len(image)} bytes"


def test_files_of_all_kinds(spark, tmp_path):
    import io
    import zipfile
    import zlib

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<w:p><w:t>Hello</w:t></w:p><w:p><w:t>there</w:t></w:p>")
    page = lambda t: b"<< >>\nstream\n" + zlib.compress(b"BT (" + t + b") Tj ET") + b"\nendstream\n"
    files = {"a.pdf": b"%PDF-1.4\n" + page(b"first") + page(b"second"), "b.docx": z.getvalue(), "c.bmp": b"BM123", "d.png": b"\x89PNG" + b"x" * 40, "e.txt": "é".encode(), "f.zip": b"x"}
    rows_ = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {r.uri: (r.modality, r.text) for r in extracted(rows_, Sees()).collect()}
    assert got == {"a.pdf": ("pdf", "first\nsecond"), "b.docx": ("text", "Hello \n there"), "c.bmp": ("image", "a picture of 5 bytes"), "d.png": ("image", "[Image of 44 bytes]"), "e.txt": ("text", "é"), "f.zip": ("text", None)}
    pages = spark.createDataFrame([("https://a.example", "<p>x &amp; y</p>"), ("ftp://b", "<p>z</p>"), (None, "q")], "url string, html string")
    assert {(r.url, r.text, r.error) for r in web_pages(pages).collect()} == {("https://a.example", "x & y", None), ("ftp://b", None, "not a web address"), (None, None, "not a web address")}
    done, bad = Engine(spark, "files", "u", store=ParquetStore(spark, str(tmp_path / "s"))).ingest_pages(pages)
    assert [r.doc_id for r in done.collect()] == ["https://a.example"] and bad.count() == 2


def test_edits_in_small_steps_and_progress(spark, tmp_path):
    import noetia.engine as en

    steps = []
    e = Engine(spark, "m", "u", store=ParquetStore(spark, str(tmp_path)))
    r = e.ingest("Ann Lee founded Acme Corp in 1999.", progress=lambda s, n: steps.append((s, n)))
    assert r.first().success and [s for s, _ in steps] == ["nodes", "edges", "stored"]
    ids = [e.add_node(name=f"N{i}", entity_type="T") for i in range(en.COMPACT_EVERY + 2)]
    e.update_node(ids[0], description="new")
    assert e.delete_node(ids[1]) and e.get_node(ids[1]) is None
    assert e.get_node(ids[0]).description == "new" and e.graph.nodes.where("name like 'N%'").count() == en.COMPACT_EVERY + 1
    eid = e.add_edge(source_id=ids[0], target_id=ids[2], relation_type="knows")
    assert e.get_edge(eid).target_id == ids[2] and e.delete_edge(eid) and e.get_edge(eid) is None
    q = e.query("Who is N0?")
    assert e.has_results(q) and not e.has_results(e.query("zzzz qqqq"))
    assert e.evolve((), now=now()) is None and e.evolve(("DECAY",), now=now(), force=False) is None
    e.save()
    assert Engine(spark, "m", "u", store=e.store).get_node(ids[0]).description == "new"
