import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noetia.functions import expr as X
from noetia.functions import text as T
from noetia.operators import community, context, evolve, graph, rank, resolve, retrieve
from noetia.operators.components import connected_components
from noetia.operators.pairs import block_pairs
from noetia.plans import graph_queries
from noetia.schemas import EngineConfig, RateLimitError, StorageError
from tests.conftest import rows

def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_node_id(spark):
    assert one(spark, X.node_id(F.lit("Test Entity"), F.lit("Person"), F.lit("user1"), F.lit("memory1"))) == "6eb858193e688ac5f89c6053e3963fd0"


@pytest.mark.parametrize("score,level", [(10, 10), (9.5, 10), (8, 8), (6, 6), (5, 5), (3, 3), (1, 1), (0, 0)])
def test_importance_bucket(spark, score, level):
    assert one(spark, X.importance_bucket(F.lit(float(score)))) == level


def test_cosine(spark):
    v = lambda *xs: F.array(*map(F.lit, xs)).cast("array<float>")
    assert one(spark, X.cosine(v(1.0, 2.0), v(1.0, 2.0))) == pytest.approx(1)
    assert one(spark, X.cosine(v(1.0, 0.0), v(0.0, 1.0))) == 0
    assert one(spark, X.cosine(v(1.0), v(1.0, 2.0))) == 0
    assert one(spark, X.cosine(F.lit(None).cast("array<float>"), v(1.0))) == 0


def test_strengths(spark):
    at = lambda d: F.lit(dt.datetime(2024, 1, 31) - dt.timedelta(days=d))
    assert one(spark, X.node_strength(at(10), now(), F.lit(5), F.lit(0))) == pytest.approx(0.540101, abs=1e-6)
    assert one(spark, X.node_strength(at(30), now(), F.lit(10), F.lit(100))) == pytest.approx(0.486392, abs=1e-6)
    assert one(spark, X.edge_strength(at(30), now(), F.lit(1.0), F.lit(1.0))) == pytest.approx(0.031273, abs=1e-6)
    assert one(spark, X.edge_strength(at(30), now(), F.lit(5.0), F.lit(1.0))) == pytest.approx(0.500074, abs=1e-6)


def test_dates_and_answers(spark):
    y = lambda s: one(spark, X.parse_date(F.lit(s)))
    assert y("January 2024") == dt.datetime(2024, 1, 1) and y("2024-02") == dt.datetime(2024, 2, 1) and y("around 1999.") == dt.datetime(1999, 1, 1)
    assert y("present") is None and y("") is None and y("soon") is None
    a = one(spark, X.parse_answer(F.lit('x {"answer": "a", "confidence": 7} y')))
    assert (a.answer, a.confidence) == ("a", 7)
    a = one(spark, X.parse_answer(F.lit("plain")))
    assert (a.answer, a.confidence) == ("plain", 5)


def test_valid_at_and_filters(spark):
    d = spark.createDataFrame([(1, None, None), (2, dt.datetime(2024, 1, 30), None), (3, dt.datetime(2024, 2, 1), None), (4, None, dt.datetime(2024, 1, 31))], "i int, valid_from timestamp, valid_until timestamp")
    ids = lambda c: [r.i for r in d.where(c).orderBy("i").collect()]
    assert ids(X.valid_at(now())) == [1, 2, 4] and ids(X.valid_at(now(), half_open=True)) == [1, 2] and ids(X.valid_at(now(), known_start=True)) == [2]


def test_lcs():
    assert evolve.lcs_ratio("Steve Jobs", "Steven Jobs") == pytest.approx(0.952381, abs=1e-6)
    assert evolve.lcs_ratio("Steve Jobs", "Tim Cook") == pytest.approx(1 / 3, abs=1e-6)
    assert evolve.lcs_ratio("", "x") == 0 and evolve.lcs_ratio("A", "a") == 1


@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
@settings(max_examples=150, deadline=None)
def test_lcs_against_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    want = 2 * t[-1][-1] / (len(a) + len(b)) if a and b else 0.0
    assert evolve.lcs_ratio(a, b) == pytest.approx(want)


def test_components(spark):
    r = random.Random(1)
    e = [(f"n{r.randint(0, 60)}", f"n{r.randint(0, 60)}") for _ in range(45)] + [(f"n{i}", f"n{i + 1}") for i in range(70, 110)] + [("s", "s"), (None, "x"), ("hub", "hub")] + [("hub", f"z{i}") for i in range(300)]
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in e:
        if a is not None:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in p)
    assert rows(connected_components(spark.createDataFrame(e, "src string, dst string"))) == want
    assert connected_components(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_block_pairs_cover_every_pair_once(spark):
    d = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(90)], "g string, id long")
    got = block_pairs(d, ["g"], "id", lambda left, right, same: ((x["id"], y["id"]) for i, x in enumerate(left) for y in (right[i + 1 :] if same else right)), "i long, j long", 7)
    pairs = [tuple(sorted(r)) for r in got.collect()]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if (i % 3 == 0) == (j % 3 == 0)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def hub(spark):
    n = [("A", 5, 0, 0), ("B", 5, 10, 1), ("C", 5, 20, 2), ("D", 5, 30, 3), ("E", 5, 40, 4)]
    nodes = spark.createDataFrame([(i, imp, acc, dt.datetime(2024, 1, 31) - dt.timedelta(days=d)) for i, imp, acc, d in n], "id string, importance int, access_count long, accessed_at timestamp")
    edges = spark.createDataFrame([("A", x, 1.0, 1.0) for x in "BCDE"], "source_id string, target_id string, weight double, confidence double")
    return nodes, edges


def test_pageranks_and_importance(spark):
    nodes, edges = hub(spark)
    p = dict(map(tuple, rank.pagerank(nodes, edges).collect()))
    assert p["A"] == pytest.approx(0.03, abs=1e-6) and p["B"] == pytest.approx(0.036375, abs=1e-6)
    w = rank.pagerank_weighted(nodes, edges)
    p = dict(map(tuple, w.collect()))
    assert p["A"] == pytest.approx(0.824742, abs=1e-6) and p["E"] == pytest.approx(1.0, abs=1e-9)
    s = dict(map(tuple, rank.node_importance(nodes, w, now()).collect()))
    assert [s[x] for x in "ABCDE"] == pytest.approx([5.649484, 7.490215, 7.843606, 8.031360, 8.149181], abs=1e-5)


def test_facade_decay(spark):
    n = spark.createDataFrame([("x", "m", 6, "ACTIVE", dt.datetime(2024, 1, 31) - dt.timedelta(days=100))], "id string, memory_id string, importance int, state string, accessed_at timestamp")
    assert [tuple(r) for r in evolve.facade_decay(n, now()).collect()] == [("x", "m", 6, 1, "ACTIVE")]


def cliques(spark):
    n = [(f"{g}{i}", "m", f"{g}{i}", g, 5) for g in "pq" for i in range(4)]
    nodes = spark.createDataFrame(n, "id string, memory_id string, name string, entity_type string, importance int")
    e = [(f"e{a}{b}", "m", a, b, 1.0) for g in "pq" for i in range(4) for j in range(i + 1, 4) for a, b in [(f"{g}{i}", f"{g}{j}")]]
    return nodes, spark.createDataFrame(e, "id string, memory_id string, source_id string, target_id string, weight double")


def test_communities(spark):
    nodes, edges = cliques(spark)
    for algorithm in ("greedy_modularity", "label_propagation"):
        m = community.detect(nodes, edges, algorithm)
        by = {}
        for r in m.collect():
            by.setdefault(r.community, set()).add(r.id)
        assert len(by) >= 2 and all(len({x[0] for x in v}) == 1 for v in by.values())
    m = nodes.select("memory_id", "id", F.col("entity_type").alias("community"))
    assert {r.coherence for r in community.cluster_metrics(m, edges).collect()} == {1.0}


def test_graph_changes_leave_the_old_graph(spark):
    nodes = graph.new_nodes(spark.createDataFrame([("Jane", "Person"), ("Acme", "Organization")], "name string, entity_type string"), "m")
    ids = {r.name: r.id for r in nodes.collect()}
    edges = graph.new_edges(spark.createDataFrame([(ids["Jane"], ids["Acme"], "works_at")], "source_id string, target_id string, relation_type string"), "m")
    g = graph.MemoryGraph(nodes, edges, None, "m")
    assert g.nodes.first().importance == 5 and g.nodes.first().state == "ACTIVE"
    h = g.remove_nodes(spark.createDataFrame([(ids["Jane"],)], "id string"))
    assert (h.nodes.count(), h.edges.count()) == (1, 0) and (g.nodes.count(), g.edges.count()) == (2, 1)
    u = g.update_node(ids["Jane"], now(), description="boss", city="Oslo").node(ids["Jane"]).first()
    assert u.description == "boss" and '"city":"Oslo"' in u.properties


def test_transitive_links(spark):
    s = "memory_id string, source_id string, target_id string, weight double, confidence double, state string"
    e = spark.createDataFrame([("m", "a", "b", 2.0, 0.9, "ACTIVE"), ("m", "b", "c", 1.0, 0.8, "ACTIVE"), ("m", "b", "a", 1.0, 0.9, "ACTIVE"), ("m", "c", "d", 1.0, 0.5, "ACTIVE")], s)
    t = graph.transitive_links(e).collect()
    assert [(r.source_id, r.via_id, r.target_id, r.weight) for r in t] == [("a", "b", "c", 0.5)] and t[0].confidence == pytest.approx(0.576)


def test_exact_top_k(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    v[5] = v[6]
    base = spark.createDataFrame([(str(i), [float(x) for x in v[i]]) for i in range(300)] + [("z", [0.0] * 8), ("n", None)], "id string, vec array<float>")
    q = base.where("id in ('5','17','z')").select(F.col("id").alias("query_id"), "vec")
    got = retrieve.exact_top_k(q, base, 4, block_rows=50)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in (5, 17):
        s = u @ u[i]
        want = sorted((j for j in range(300) if j != i), key=lambda j: (-round(s[j], 6), len(str(j)), str(j)))[:4]
        assert [int(r.id) for r in got.where(F.col("query_id") == str(i)).orderBy("rank").collect()] == want
    assert got.where("query_id = 'z'").count() == 0


def test_hybrid_score_order(spark):
    n = spark.createDataFrame([("a", "m", "Apple", ["Apple"], None, "ACTIVE", 5, "T", ""), ("b", "m", "Pear Ltd", ["apple pie"], None, "ACTIVE", 5, "T", ""), ("c", "m", "Apple", [], None, "DELETED", 5, "T", ""), ("d", "m", "founded things", None, None, "ACTIVE", 5, "T", None)], "id string, memory_id string, name string, aliases array<string>, embedding array<float>, state string, importance int, entity_type string, description string")
    top = retrieve.retrieve(n, [retrieve.MemoryQuery(0, "Who founded Apple pie?")])
    assert [(r.id, r.score) for r in top.orderBy("rank").collect()] == [("a", 1.0), ("b", 0.95), ("d", pytest.approx(0.575))]


def test_resolution(spark):
    n = spark.createDataFrame([(str(i), "m", "u", x, "Company", a, None) for i, (x, a) in enumerate([("Apple Inc.", ["Apple", "AAPL"]), ("Apple", []), ("AAPL", []), ("Google", ["Alphabet"]), ("Alphabet Inc.", [])])], "id string, memory_id string, user_id string, name string, entity_type string, aliases array<string>, embedding array<float>")
    got = {r.name: r.n_merged for r in resolve.resolve(n).collect()}
    assert got == {"Apple Inc.": 3, "Google": 1, "Alphabet Inc.": 1}


def test_context_budget_stops_at_the_first_overflow(spark):
    d = spark.createDataFrame([("g", 1, "a" * 40), ("g", 2, "b" * 400), ("g", 3, "c")], "g string, i int, t string")
    assert [r.i for r in context.within_budget(d, "g", [F.col("i")], F.col("t"), 50).collect()] == [1]
    assert context.allocate(7994, "balanced") == {"communities": 2797, "entities": 2398, "relationships": 1598, "documents": 1199}
    assert context.allocate(7994, "entities", frozenset({"documents"})) == {"entities": 2797, "relationships": 2398, "communities": 1598, "documents": 0}


def test_chunkers():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(5))
    assert len(T.chunk_document(text, 500, 100, 50)) >= 2
    code = "package x\n\nfunc A() {\n}\n\nfunc B() {\n}\n\ntype C struct {\n}\n\nfunc (c C) D() {\n}\n"
    assert [c[3]["symbol"] for c in T.chunk_code(code, "go")] == ["func A", "func B", "type C"]
    assert [c[3]["symbol"] for c in T.chunk_code("const a = 1\nlet b\nclass C {}\n", "javascript")] == ["const a", "let b", "class C"]
    assert T.chunk_document("") == [] and T.chunk_document("  \n ") == []
    assert T.csv_text("name,type\na,b\nc,d\n")[1]["row_count"] == "3" and T.csv_text("a,b\nc\n")[1] == {}
    assert T.json_text('{"b": [1, {"x": null}], "a": true}')[0].startswith("a: true")
    assert T.html_dom_text("<title>T</title><nav>n</nav><p>é</p>") == ("é", "T", "")


@given(st.text("ab .!?\nÄ€", max_size=300), st.integers(20, 60))
@settings(max_examples=100, deadline=None)
def test_character_chunks_end_and_cover(text, size):
    b = text.encode()
    at = 0
    for s, e, _, _ in T.by_characters(b, size, size // 4, 5):
        assert e > s and e - s <= size
        at = max(at, e)
    assert at == len(b) or not b.strip() or not b[at:].strip()


def test_config_and_errors():
    c = EngineConfig.from_env({"NOETIA_TOP_K": "7", "NOETIA_MIN_SIMILARITY": "x", "NOETIA_AUTO_EVOLVE": "yes"})
    assert (c.top_k, c.min_similarity, c.auto_evolve) == (7, 0.5, True)
    assert RateLimitError("slow").recoverable and not StorageError("x").recoverable and "[STORAGE]" in str(StorageError("x", cause=ValueError("y")))
    assert math.isclose(sum(context.SHARES), 1)


def test_queries_over_all_texts_and_descriptions(spark, tmp_path):
    import hashlib
    import re

    from noetia.plans.text_queries import QUERIES

    texts = ["Plain words, here. Words", "Élan vital : « Straße » été; ÉLAN", "“quoted” it’s", "", "año　nuevo"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for i, t in enumerate(texts):
        w = {x.lower() for x in (y.strip(".,!?;:'\"") for y in re.split(r"\s+", t)) if len(x.encode()) > 2}
        want.add((i, len(w), hashlib.md5(" ".join(sorted(w)).encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["retrieval_tokens"](spark, str(tmp_path)).collect()} == want
    nodes = [("a", "m", "u", "n1", 8, "d" * 300, "T"), ("b", "m", "u", "n2", 6, None, "T"), ("c", "m", "u", "n3", 5, "d" * 200, "T")]
    spark.createDataFrame(nodes, "id string, memory_id string, user_id string, name string, importance int, description string, entity_type string").write.parquet(str(tmp_path / "entities.parquet"))
    line = lambda name, text: (len(f"• {name} (T): \n".encode()) + (len(text) if len(text) <= 200 else 203)) // 4
    t = [line("n1", "d" * 300), line("n2", "n2"), line("n3", "d" * 200)]
    got = {tuple(r) for r in QUERIES["context_budget"](spark, str(tmp_path)).collect()}
    assert got == {("m", x, n, sum(t[: k + 1])) for k, (x, n) in enumerate(zip("abc", t))}


def test_context_text_sections_and_cuts(spark):
    n = spark.createDataFrame([("a", "m", "Ann", "Person", "é" * 150, 8), ("b", "m", "Bob", None, None, None)], "id string, memory_id string, name string, entity_type string, description string, importance int")
    e = spark.createDataFrame([("e1", "m", "a", "b", "knows", "", 1.0, 0.5), ("e2", "m", "b", "a", "likes", "much", 2.0, 1.0)], "id string, memory_id string, source_id string, target_id string, relation_type string, description string, weight double, confidence double")
    c = spark.createDataFrame([("c", "m", "All of it", 5), ("d", "other", "Else", 5)], "id string, memory_id string, summary string, importance int")
    d = spark.createDataFrame([(1, "m", "one"), (2, "m", "x" * 9000), (3, "m", "three")], "doc_id long, memory_id string, text string")
    got = {r.memory_id: r for r in context.context_windows(n, e, c, d, "who?").collect()}
    cut = ("é" * 100) + "..."
    want = f"Query: who?\n\n## Topic Summaries\n• All of it\n\n## Relevant Entities\n• Ann (Person): {cut}\n• Bob (): Bob\n\n## Relationships\n• b --[likes]--> a: much\n• a --[knows]--> b\n\n## Supporting Documents\none\n\n{'x' * 500}...\n\nthree"
    assert got["m"].content == want and not got["m"].truncated and got["m"].tokens_used == len(want.encode()) // 4
    assert got["other"].content == "Query: who?\n\n## Topic Summaries\n• Else"
    small = {r.memory_id: r for r in context.context_windows(n, e, c, d, "who?", 60, "documents").collect()}["m"]
    assert small.truncated and small.documents == "one" and small.content.startswith("Query: who?\n\n## Supporting Documents\none")
    odd = spark.createDataFrame([("a" + "é" * 150,)], "t string").select(X.byte_prefix("t", 200, "...").alias("t")).first().t
    assert odd == "a" + "é" * 99 + "\ufffd..."


class _Says:
    def complete(self, prompt):
        if "fail" in prompt:
            raise ValueError("no")
        return "é" * 400


def test_summaries_of_a_model(spark):
    t = spark.createDataFrame([("1", "# head\nfirst\n\n second \nthird"), ("2", "fail " + "y" * 900), ("3", None)], "id string, text string")
    assert {r.id: r.summary for r in context.model_summaries(t, None).collect()} == {"1": "first second third", "2": "fail " + "y" * 495, "3": None}
    got = {r.id: r.summary for r in context.model_summaries(t, _Says(), 501).collect()}
    assert got == {"1": "é" * 250 + "\ufffd", "2": "fail " + "y" * 496, "3": None}


def test_star_groups_follow_the_greedy_order(spark):
    r = random.Random(3)
    for n, k in ((30, 40), (60, 50), (12, 60)):
        pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(k)}
        near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in range(n)}
        want, used = {}, set()
        for i in range(n):
            if i not in used:
                group = {i} | {j for j in near[i] if j > i and j not in used}
                if len(group) > 1:
                    want[i] = group
                    used |= group
        df = spark.createDataFrame([(f"{b:03d}", f"{a:03d}") for a, b in pairs], "id_a string, id_b string")
        nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(n)], "id string")
        got = {}
        for x in evolve.star_groups(df, nodes).collect():
            got.setdefault(int(x.center), set()).add(int(x.id))
        assert got == want
    assert evolve.star_groups(df.limit(0), nodes).collect() == []


class _Groups:
    def complete(self, prompt):
        return "1, 2\n3" if "Person" in prompt or "person" in prompt else "nothing"


def test_full_consolidation_and_groups_of_a_model(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    n = graph.new_nodes(spark.createDataFrame([("a", "Ann Lee", "Person", "short", 2), ("b", "Ann Lee", "Person", "a longer one", 3), ("c", "Zed", "Person", "z", 1), ("d", "Thing", "Object", "t", 1)], "id string, name string, entity_type string, description string, access_count long"), "m", "u", now)
    e = graph.new_edges(spark.createDataFrame([("1", "a", "c", "knows", 1.0, 0.5), ("2", "b", "c", "knows", 2.0, 0.9), ("3", "c", "d", "has", 1.0, 1.0)], "id string, source_id string, target_id string, relation_type string, weight double, confidence double"), "m", now)
    nodes, edges, new, log = evolve.consolidate_fully(n, e, now)
    got = {r.id: r for r in nodes.collect()}
    assert set(got) == {"b", "c", "d"} and got["b"].access_count == 5 and got["b"].description == "a longer one"
    left = {(r.source_id, r.target_id): (r.weight, round(r.confidence, 3)) for r in edges.collect()}
    assert left == {("b", "c"): (3.0, 0.77), ("c", "d"): (1.0, 1.0)}
    assert [(r.source_id, r.target_id) for r in new.collect()] == [("b", "d")]
    assert sorted(r.evolution_type for r in log.collect()) == ["CONSOLIDATION", "REINFORCEMENT"]
    assert {(r.center, r.id) for r in evolve.model_groups(n, _Groups()).collect()} == {("a", "a"), ("a", "b")}


def test_table_functions_equal_the_chunkers(spark):
    T.register_table_functions(spark)
    text = "One sentence here. Another one follows. " * 60
    got = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got.createOrReplaceTempView("tf_docs")
    r = spark.sql("SELECT d.doc_id, c.* FROM tf_docs d, LATERAL chunk_text(d.text, 500, 50) c ORDER BY chunk_index").collect()
    assert [x.content for x in r] == [c[2] for c in T.chunk_document(text, 500, 50)] and {x.doc_id for x in r} == {1}


def test_each_node_joins_its_best_match_only(spark):
    n = [
        ("a", "Acme Solar Power", [1.0, 0.0], "Company"),
        ("b", "Acme Solar Plant Power", [0.0, 1.0], "company"),  # overlap 0.75 with a
        ("c", "Solar Plant Power Acme Two", [0.0, 1.0], ""),  # cosine and overlap with b beat a
        ("d", "Acme Solar Power", [1.0, 0.0], "Person"),  # another type
        ("e", "Zeta", [float("nan"), 1.0], "Company"),
    ]
    df = spark.createDataFrame([(i, "m", "u", x, t, None, v) for i, x, v, t in n], "id string, memory_id string, user_id string, name string, entity_type string, aliases array<string>, embedding array<float>")
    assert {(r.a, r.b) for r in resolve.similarity_links(df).collect()} == {("a", "b"), ("b", "c")}


def test_links_over_a_hub_are_exact(spark):
    r = random.Random(11)
    rows_, n = [], 0
    for m in ("m1", "m2"):
        for _ in range(700):
            hub = r.random() < 0.6
            s, t = (r.choice(["hub", f"n{r.randint(0, 90)}"]) if hub else f"n{r.randint(0, 90)}"), (f"n{r.randint(0, 90)}" if hub else r.choice(["hub", f"n{r.randint(0, 90)}"]))
            rows_.append((f"e{n}", m, s, t, r.choice([1.0, 2.0]), round(r.choice([0.6, 0.7, 0.8, 0.9, 1.0, r.random()]), 3), "ACTIVE"))
            n += 1
    e = spark.createDataFrame(rows_, "id string, memory_id string, source_id string, target_id string, weight double, confidence double, state string")
    cols = ["memory_id", "source_id", "via_id", "target_id", "weight", "confidence"]
    every = {}
    for x in graph.transitive_links(e, limit=None).select(cols).collect():
        every.setdefault(x.memory_id, []).append(tuple(x))
    want = {y for v in every.values() for y in sorted(v, key=lambda y: (-y[5], y[1], y[3]))[:10]}
    assert {tuple(x) for x in graph.transitive_links(e).select(cols).collect()} == want and len(want) == 20


def test_last_names_and_communities_of_next_to_nothing(spark):
    n = lambda a, b: one(spark, X.share_last_name(F.lit(a), F.lit(b)))
    assert n("Dr. Ann Lee", "Lee") and not n("Ann Wu", "Bo Wu") and not n("", "Lee") and n("Ann Gray Jr", "Gray")
    node = "id string, memory_id string"
    edge = "id string, memory_id string, source_id string, target_id string, weight double"
    none, empty = spark.createDataFrame([], edge), spark.createDataFrame([], node)
    few = spark.createDataFrame([("a", "m"), ("b", "m")], node)
    loop = spark.createDataFrame([("e", "m", "a", "a", 1.0)], edge)
    for f in (community.label_propagation, community.greedy_modularity):
        assert f(empty, none).count() == 0
        assert len({x.community for x in f(few, none).collect()}) == 2
        assert len({x.community for x in f(few, loop).collect()}) == 2
    pair = spark.createDataFrame([("e", "m", "a", "b", 2.0)], edge)
    assert len({x.community for x in community.label_propagation(few, pair).collect()}) == 1


def jobs(spark, f):
    """What ``f`` returns, and the number of Spark jobs that it took."""
    sc, group = spark.sparkContext, f"jobs-{random.random()}"
    sc.setJobGroup(group, "")
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def ranked(spark, **options):
    """A graph with sinks, lone nodes, loops, parallel edges, a hub, weights of 0 and none, and ends without a node."""
    r = random.Random(4)
    names = [f"n{i}" for i in range(60)]
    e = [(r.choice(["n0", *names[:40]]), r.choice(["n1", *names[:50], "absent"]), r.choice([0.0, 1.0, 2.5, None]), r.choice([0.5, 1.0, None])) for _ in range(400)] + [("absent", "n3", 1.0, 1.0), ("n7", "n7", 0.0, 1.0), (None, "n3", 1.0, 1.0)]
    nodes = spark.createDataFrame([(x,) for x in names], "id string")
    edges = spark.createDataFrame(e, "source_id string, target_id string, weight double, confidence double")
    at = {x: i for i, x in enumerate(names)}
    a = np.zeros((60, 60))
    w = [(at[s], at[t], (1.0 if w is None else w) * (1.0 if c is None else c)) for s, t, w, c in e if s in at and t in at]
    for s in range(60):
        own = [(t, x) for s2, t, x in w if s2 == s]
        total = sum(x for _, x in own) or len(own)
        for t, x in own:
            a[t, s] += (x or 1.0) / total
    pr = np.full(60, 1 / 60)
    for _ in range(options.get("iterations", 100)):
        pr = 0.15 / 60 + 0.85 * pr[a.sum(0) == 0].sum() / 60 + 0.85 * a @ pr
    got, n = jobs(spark, lambda: dict(map(tuple, rank.pagerank_weighted(nodes, edges, **options).collect())))
    assert got == pytest.approx(dict(zip(names, pr / pr.max())), abs=1e-12)
    return n


def test_weighted_pagerank_takes_no_jobs_a_round(spark):
    assert ranked(spark, iterations=40, tolerance=0.0) <= ranked(spark, iterations=1) + 2
    ranked(spark)


def test_weighted_pagerank_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rank, "BLOCK_EDGES", 60)
    one = ranked(spark, iterations=1)
    assert ranked(spark, iterations=23, tolerance=0.0) <= one + 2 * (one + 12)
    monkeypatch.setattr(rank, "BLOCK_NODES", 3)  # more blocks than some have edges
    ranked(spark, iterations=12)


def test_node_importance_of_tables(spark, tmp_path):
    nodes, edges = hub(spark)
    nodes.withColumns({"id": F.concat(F.lit(" "), "id"), "memory_id": F.lit("m"), "user_id": F.lit(None).cast("string"), "state": F.lit("ACTIVE")}).write.parquet(str(tmp_path / "entities.parquet"))
    edges.withColumns({"id": F.col("target_id"), "memory_id": F.lit("m"), "relation_type": F.lit("x"), "state": F.lit("ACTIVE"), "updated_at": now(), "access_count": F.lit(0)}).write.parquet(str(tmp_path / "relationships.parquet"))
    got, n = jobs(spark, lambda: dict(map(tuple, graph_queries.node_importance(spark, str(tmp_path)).collect())))
    assert [got[x] for x in "abcde"] == pytest.approx([5.6495, 7.4902, 7.8436, 8.0314, 8.1492], abs=1e-4)
    assert n < 60  # a job a round would be 40 more


def test_decay_nodes_of_tables(spark, tmp_path):
    nodes, edges = hub(spark)
    extra = {"id": F.concat(F.lit(" "), "id"), "memory_id": F.lit("m"), "user_id": F.lit(None).cast("string"), "state": F.when(F.col("id") == "E", "DELETED").otherwise("ACTIVE"), "importance": F.when(F.col("id") == "D", 0).otherwise(F.col("importance"))}
    nodes.withColumns(extra).write.parquet(str(tmp_path / "entities.parquet"))
    edges.withColumns({"id": F.col("target_id"), "memory_id": F.lit("m"), "relation_type": F.lit("x"), "state": F.lit("ACTIVE"), "updated_at": now(), "access_count": F.lit(0)}).write.parquet(str(tmp_path / "relationships.parquet"))
    got, n = jobs(spark, lambda: {r.id: (r.new_state, r.new_importance) for r in graph_queries.decay_nodes(spark, str(tmp_path)).collect()})
    assert got == {"a": ("ACTIVE", 6), "b": ("ACTIVE", 8), "c": ("ACTIVE", 8), "d": ("ACTIVE", 8)}
    assert n < 60  # a job a round would be 40 more


def test_modularity_in_one_task_and_in_many(spark, monkeypatch):
    r = random.Random(6)
    nodes = [(m, f"{m}{i}é") for m in "mnp" for i in range(70)] + [(None, "lone"), (None, "too"), ("q", "only")]
    e = [(f"e{i}", m, f"{m}{r.randint(0, 75)}é", f"{r.choice([m, m, m, 'n'])}{r.randint(0, 75)}é", r.choice([1.0, 2.0, None, 0.0, r.random()])) for i in range(500) for m in ["p" if i < 3 else r.choice("mn")]]
    e += [("x", None, "lone", "too", 1.0), ("y", "empty", "a", "b", 1.0), ("z", "p", "p1é", "p2é", float("nan"))]
    nodes = spark.createDataFrame(nodes, "memory_id string, id string")
    edges = spark.createDataFrame(e, "id string, memory_id string, source_id string, target_id string, weight double")
    for k in (0, 1, 7):
        assert [x[0] for x in nodes.select(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2))).collect()] == list(community._half(np.array([x[0] for x in nodes.select(F.xxhash64("id")).collect()]), k))
    for rounds in (1, 5, 100):
        found = {}
        for limit in (0, 10**6):
            monkeypatch.setattr(community, "TASK_ROWS", limit)
            found[limit] = rows(community.greedy_modularity(nodes, edges, rounds=rounds, max_size=9))
        assert found[0] == found[10**6] and len(found[0]) == 213
    few = edges.where("memory_id in ('m', 'n')"), nodes.where("memory_id in ('m', 'n')")
    _, n = jobs(spark, lambda: community.greedy_modularity(few[1], few[0]).collect())
    assert n < 40  # several jobs a round before
