import random

from hypothesis import given, settings
from hypothesis import strategies as st

from noetia.llm import chunk_split as S


def check(b, limit, overlap):
    pieces = S.split_bytes(b, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(b)
    for s, e in pieces:
        assert 0 < e - s <= limit or len(b) == 0
        b[s:e].decode()
    for (s0, e0), (s1, e1) in zip(pieces, pieces[1:]):
        assert s0 < s1 <= e0 < e1 and min(overlap, e0) - 3 <= e0 - s1 <= overlap + 12
    rebuilt = b[: pieces[0][1]] + b"".join(b[p[1] : q[1]] for p, q in zip(pieces, pieces[1:]))
    assert rebuilt == b
    return pieces


@given(st.text("ab .,!\n\tÄ€漢。😀\u0301", min_size=1, max_size=900), st.integers(60, 200))
@settings(max_examples=300, deadline=None)
def test_limits_overlap_and_round_trip(text, limit):
    check(text.encode(), limit, limit // 5)


def test_sentences_are_the_ends():
    r = random.Random(2)
    b = " ".join(" ".join("word" * r.randint(1, 3) for _ in range(r.randint(4, 12))) + "." for _ in range(150)).encode()
    pieces = check(b, 1000, 200)
    assert all(b[e - 1 : e] == b"." for _, e in pieces)
    assert len(pieces) <= -(-(len(b) - 200) // 800) + 2  # balanced: next to the fewest possible


def test_text_without_boundaries_and_very_long():
    check(("x" * 5003).encode(), 1000, 200)
    check(("漢" * 2001).encode(), 1000, 200)
    check(("a" + "\u0301" * 3000).encode(), 1000, 200)
    assert S.split_bytes(b"short") == [(0, 5)]


SC = "id string, source_id string, chunk_index int, start_char int, end_char int, content string, modality string, doc_text string, c int"


def test_table_offsets_nulls_and_repeats(spark):
    text = "é. " + "Some words here. " * 200
    body = text.encode()[200:1700].decode()
    data = [
        (" A ", "1", 0, 200, 1700, body, "text", "x", 1),
        ("a", "1", 0, 200, 1700, body, "text", "x", 1),
        ("b", "1", 0, None, None, "\n  " + body, "text", "x", 1),
        ("c", "9", 0, 7, 8, "unknown " * 200, "odd", None, None),
        ("d", "1", 0, 0, 3, None, "text", None, None),
        ("e", "1", 0, 0, 3, "", "text", None, None),
        ("f", "1", 0, 0, 3, " " * 3000 + "x" + "\n" * 3000, "text", None, None),
        (None, "1", 0, 0, 3, "y" * 2000, "text", None, None),
        ("g", None, None, None, None, "y" * 2000, None, None, None),
    ]
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    p = S.split_chunks(spark.createDataFrame(data, SC), docs).collect()
    assert {r.chunk_id for r in p} == {"a", "b", "c", "g"}
    for r in p:
        assert len(r.content.encode()) <= 1000
        if r.chunk_id in "ab":
            assert text.encode()[r.start_char : r.end_char].decode() == r.content and r.located
    assert [r.start_char for r in p if r.chunk_id == "c" and r.piece_index == 0] == [7]
    assert [r.start_char for r in p if r.chunk_id == "g"][0] is None
    assert len([r for r in p if r.chunk_id == "a" and r.piece_index == 0]) == 1
    empty = spark.createDataFrame([], SC)
    assert S.split_chunks(empty, docs).collect() == []
    assert sorted(r.chunk_id for r in S.oversized_chunks(S.split_chunks(spark.createDataFrame(data, SC), docs)).collect()) == ["a", "b", "c", "g"]


def test_a_document_with_very_many_chunks_and_rejoining(spark, monkeypatch):
    import hashlib

    text = " ".join(f"Sentence number {i} goes on for a while." for i in range(2000))
    b = text.encode()
    spans = [(i * 150, i * 150 + 1500 + i % 7) for i in range(200)]
    data = [(f"c{i:03d}", "1", 0, s, e, b[s:e].decode(), "text", "x", 1) for i, (s, e) in enumerate(spans)]
    docs = spark.createDataFrame([(1, text), (2, "other"), (None, text)], "doc_id long, text string")
    chunks = spark.createDataFrame(data, SC)
    plain = sorted(map(tuple, S.split_chunks(chunks, docs).collect()))
    monkeypatch.setattr(S, "CHUNKS_PER_TASK", 30)
    assert sorted(map(tuple, S.split_chunks(chunks, docs).collect())) == plain
    monkeypatch.setattr(S, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, S.split_chunks(chunks, docs).collect())) == plain
    assert all(b[x[6] : x[7]].decode() == x[9] and x[8] for x in plain)
    got = {r.chunk_id: (r.within_limit, r.text_hash) for r in S.rejoined(S.split_chunks(chunks, docs)).collect()}
    assert got == {f"c{i:03d}": (True, hashlib.md5(b[s:e].strip()).hexdigest()) for i, (s, e) in enumerate(spans)}
