import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noetia.llm import mixing as M
from noetia.llm import stuffing as P
from noetia.llm import tokens as T

BPE = T.load(T.vocabulary_path())
ALPHABET = ["a", "b", "the", "ing", " ", "  ", "\n", "1", "23", "é", "漢", "'", "'s", "!", "--", "\t", "ü", "_", "Ab", "\u00a0", "😀"]


def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.vocabulary_path().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@given(st.lists(st.sampled_from(ALPHABET), max_size=60), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_any_cutting_gives_the_same_ids(parts, step):
    text = "".join(parts)
    want = BPE._native.encode_ordinary(text)
    assert [i for p in BPE.encode_stream(text[i : i + step] for i in range(0, len(text), step)) for i in p] == want == BPE.encode(text)
    assert BPE.decode(want) == text


def test_same_ids_as_the_public_library():
    t, r = reference(), random.Random(4)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 400))) for _ in range(300)] + ["<|endoftext|> x", "", " ", "\n" * 30000 + "x", "a" * 20000 + "'ll", " " * 20000, "!" * 20000 + " b"]
    assert [BPE.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@given(st.text("abcdefghijklmnopqrstuvwxyzéü", min_size=1, max_size=600), st.integers(1, 300))
@settings(max_examples=60, deadline=None)
def test_long_word_transducer(word, step):
    w, b, out = T._LongWord(BPE), word.encode(), []
    for i in range(0, len(b), step):
        out += w.push(b[i : i + step])
    assert out + w.finish() == BPE._merge(b)


def test_long_words_need_bounded_memory():
    w, r = T._LongWord(BPE), random.Random(1)
    for _ in range(12):
        w.push("".join(r.choice("abcdefghijklmnop") for _ in range(2048)).encode())
        assert len(w.last) < 2048


def test_tables(spark):
    d = spark.createDataFrame([(1, "Hello"), (2, None), (3, ""), (3, "Hello"), (None, "x" * 9000)], "doc_id long, text string")
    got = {(r.doc_id, tuple(r.ids)) for r in T.encode_texts(d).collect()}
    assert (2, ()) in got and (3, ()) in got and (3, tuple(BPE.encode("Hello"))) in got and len(got) == 5
    assert all(r.exact for r in T.round_trip(d).collect())
    assert T.encode_texts(d.limit(0)).collect() == []


# -- mixing ------------------------------------------------------------------------------------------------------------------
def test_permutation_is_one():
    import numpy as np

    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(M.permute(np.arange(n), n, 5)) == list(range(n))


def test_counts_of_shards_are_exact():
    import numpy as np

    plan = M.Plan(("a", "b", "c"), (900, 50, 7), (1700, 333, 28))
    got = [M.shard_counts(plan, s) for s in range(plan.n_shards)]
    assert all(c.sum() == M.SHARD_BLOCKS for _, c in got[:-1])
    assert tuple(np.sum([c for _, c in got], axis=0)) == plan.quota
    assert all((b == np.sum([c for _, c in got[:i]], axis=0)).all() for i, (b, _) in enumerate(got) if i)


def test_counts_follow_the_hypergeometric_law():
    from math import comb

    import numpy as np

    rng = np.random.default_rng(3)
    for good, bad, n in ((5, 7, 6), (1, 30, 4), (40, 2, 41), (0, 5, 3)):
        got = np.bincount([M.drawn(good, bad, n, rng) for _ in range(4000)], minlength=n + 1) / 4000
        want = [comb(good, k) * comb(bad, n - k) / comb(good + bad, n) if k <= good and n - k <= bad else 0 for k in range(n + 1)]
        assert np.abs(got - want).max() < 0.035
    big = [M.drawn(3 * 10**11, 7 * 10**11, 5 * 10**11, rng) for _ in range(3)]  # no other rule for large numbers
    assert all(abs(x - 1.5 * 10**11) < 3_000_000 for x in big) and len(set(big)) == 3


def test_mixture_shares_caps_and_coverage(spark):
    r = random.Random(2)
    rows = [(i, s, "word " * r.randint(1, 4000)) for i, s in enumerate(["Big-Source"] * 120 + ["small", "SMALL "] * 6 + ["tiny"] * 3 + ["other"] * 5 + [None] * 3)]
    rows += [(900, "big_source", None), (901, "big_source", ""), (902, "small", " ")]
    docs = spark.createDataFrame([(*x, 1, "b") for x in rows], "doc_id long, source string, text string, block int, h string")
    targets = spark.createDataFrame([("big_source", 0.5, 1.0), ("small", 0.3, 3.0), ("tiny", 0.1, 4.0), ("absent", 0.1, 2.0), (None, 0.1, 1.0), ("zero", 0.0, 1.0)], "source string, target_share double, max_repeats double")
    mixed, shares = M.mixture(docs, targets)
    s = {x.source: x for x in shares.collect()}
    assert set(s) == {"big_source", "small", "tiny", "absent", "zero"} and s["absent"].share == 0
    for k, x in s.items():
        assert x.repeats <= x.max_repeats + 1e-9
        if k in ("big_source", "small", "tiny"):
            assert abs(x.share - x.target_share / 0.9) < 0.03
    # every block is used as often as any other, give or take one
    use = mixed.select("source", "block", "repetition").distinct().groupBy("source", "block").count().groupBy("source").agg(F.min("count").alias("lo"), F.max("count").alias("hi")).collect()
    assert all(x.hi - x.lo <= 1 or x.source == "big_source" for x in use)
    seg = mixed.groupBy("source", "block", "repetition").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n"))
    assert seg.agg(F.max("n")).first()[0] == M.BLOCK_TOKENS
    none, empty = M.mixture(docs.limit(0), targets)
    assert none.collect() == [] and {x.share for x in empty.collect()} == {0.0}


def test_segments_lay_documents_end_to_end(spark):
    d = spark.createDataFrame([(i, "s", 1 + i * 37 % 3000) for i in range(200)], "doc_id long, source string, n_tokens long")
    seg = M.segments(d).collect()
    by_doc, by_block = {}, {}
    for x in seg:
        by_doc.setdefault(x.doc_id, []).append((x.token_from, x.token_to))
        by_block[x.block] = by_block.get(x.block, 0) + x.token_to - x.token_from
    for i in range(200):
        spans = sorted(by_doc[i])
        assert spans[0][0] == 0 and spans[-1][1] == 1 + i * 37 % 3000 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(n == M.BLOCK_TOKENS for b, n in by_block.items() if b != max(by_block))


# -- stuffed pages -------------------------------------------------------------------------------------------------------------
def pages():
    r = random.Random(6)
    w = lambda n: " ".join(r.choice("zolu meran stipa korve balin dastor venok hilpe".split()) for _ in range(n))
    prose = lambda k: " ".join(f"The {w(2)} of the {w(1)} was in {w(1)} and they have seen that it is not {w(2)}." for _ in range(k))
    good, bad = [], []
    for _ in range(60):
        good += [prose(6), prose(4) + "\ntags: zolu, meran, stipa", "\n".join(f"2023-01-0{i + 1}T10:00:00Z INFO worker-{i} ms={i}" for i in range(8)), "name,type,city\n" + "\n".join(f"{w(1)},Person,{w(1)}" for _ in range(9)), prose(2) + " (https://a.example/x)\n\n" + prose(3), "def f(x):\n    return x\n\nclass A:\n    pass\n"]
        k = w(2)
        bad += [", ".join(f"{k} {r.choice(['buy', 'cheap', 'price', 'online'])}" for _ in range(40)), "\n".join(f"https://{w(1)}.test/{w(1)}" for _ in range(15)), " ".join(k for _ in range(60)), "\n".join(f"[{w(2)}](https://x{i}.example/a)" for i in range(12)), "".join(f"<li>{k} {w(1)}</li>" for _ in range(20)), prose(1) + " " + " ".join(f"https://{w(1)}.test/{i} {w(1)}" for i in range(30))]
    return good, bad


def test_pages_are_told_apart(spark):
    good, bad = pages()
    rows = [(i, t) for i, t in enumerate(good)] + [(10_000 + i, t) for i, t in enumerate(bad)] + [(-1, None), (-2, ""), (-3, " \t "), (-4, "zolu " * 30_000)]
    d = spark.createDataFrame([(*x, 1.0, "x") for x in rows], "doc_id long, text string, tags double, n_words string")
    labels = P.label_pages(d)
    found = {r.doc_id for r in P.stuffed_pages(labels).collect()}
    assert len([i for i in found if i >= 10_000]) >= 0.97 * len(bad) and -4 in found
    assert len([i for i in found if 0 <= i < 10_000]) <= 0.01 * len(good)
    assert {r.doc_id for r in labels.collect()}.isdisjoint({-1, -2, -3})
    assert P.stuffed_pages(P.label_pages(d.limit(0))).collect() == []
    few = P.fit_model(d.select("doc_id", "text").where("text <> ''"), 100 * len(rows), 100)  # about one text
    assert [e.shape for e in few.emit] == [(5, s) for s in P.SIZES]


def test_viterbi_equals_exhaustive_search():
    import itertools

    import numpy as np

    good, bad = pages()
    m = P.fit(good[:30] + bad[:30])
    xs = [P.observe(P.units(t))[:5] for t in (good[0], bad[0], good[3], bad[1])]
    for x, y in zip(xs, m.label(xs)):
        score = lambda z: m.start[z[0]] + sum(m.move[a, b] for a, b in zip(z, z[1:])) + sum(e[s, x[i, f]] for i, s in enumerate(z) for f, e in enumerate(m.emit))  # noqa: E731, B023
        assert np.isclose(score(tuple(y)), max(map(score, itertools.product(range(5), repeat=len(x)))))


def test_markdown_links_count_as_links():
    us = P.units("[Sometime chat](https://a.example/x) [other word](http://b.test)\n\n![pic](https://c.test/i.png)\nSee [the note] and (that).")
    assert us == ["Sometime chat https://a.example/x) other word http://b.test)", "pic https://c.test/i.png)", "See [the note] and (that)."]
