import datetime as dt

from noetia.llm import survivors as S

T = dt.datetime
E = "id string, memory_id string, entity_type string, canonical_name string, name string, description string, importance int, accessed_at timestamp, access_count long, created_at timestamp, rank int, value string, group_id string, field_name string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "", "", "") for r in rows], E)


def test_winners_ties_and_unusable_values(spark):
    c = T(2020, 1, 1)
    rows = [
        ("B ", "m", "Person", "X", "X", "short text", 5, T(2023, 1, 1), 5, c),
        ("a", "m", "Person", "X", "X", "a  longer\n text", 7, T(2025, 1, 1), -1, c),
        ("c", "m", "Person", "X", "X", "a longer text ", 5, T(2019, 1, 1), 1_000_000, c),
        ("d", "m", "Person", "X", "X", "Beschreibung folgt", 99, T(1999, 1, 1), None, None),
        ("e", "m", "Person", "Y", "Y", "alone", 5, None, 1, None),
        ("f", "m", "Person", "Z", "Zed Q", "Person: Zed Q", None, None, None, None),
        ("g", "m", "Person", "Z", "Zed Q", "???", -1, None, None, None),
        (None, "m", "Person", "Z", "Zed Q", "a real description", 5, None, 1, None),
        ("h", None, "Person", "Z", "Z", "one", 5, None, 1, None),
        ("i", None, "Person", "Z", "Z", "two", 5, None, 1, None),
    ]
    df = frame(spark, rows + rows[:2])
    got = {tuple(r) for r in S.field_winners(df).collect() if r.group_id != "h"}
    assert got == {("a", "description", "a"), ("a", "importance", "b"), ("a", "accessed_at", "b"), ("a", "access_count", "b")}
    s = {r.group_id: r for r in S.survivors(df).collect()}
    assert s["a"].n_records == 4 and s["a"].description == "a longer text" and s["a"].base_id == "b" and s["f"].n_records == 2 and s["f"].description is None


def test_a_large_group_and_empty_tables(spark, monkeypatch):
    rows = [(f"i{i:05d}", "m", "Concept", "C", "C", "d" * (i % 50), i % 11, None, i, None) for i in range(3000)]
    got = {r.field_name: r.entity_id for r in S.field_winners(frame(spark, rows)).collect()}
    assert got == {"description": "i00049", "importance": "i00010", "access_count": "i02999"}
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    assert {r.field_name: r.entity_id for r in S.field_winners(frame(spark, rows)).collect()} == got
    assert S.field_winners(frame(spark, rows).limit(0)).collect() == [] and S.survivors(frame(spark, rows).limit(0)).collect() == []


def test_sentences_that_say_nothing_come_from_the_corpus(spark):
    """A filler that no list has: shared by things of several types. A formula of one type, and a text of one thing, stay."""
    filler = "Someone at the desk will write this some day, promised!"
    rows = [(f"f{i}", "m", ["Person", "Concept", "Product"][i % 3], f"N{i}", f"N{i}", filler, 5, None, 1, None) for i in range(9)]
    rows += [(f"g{i}", "m", "Person", f"N{i}", f"N{i}", "Clerk since 1999", 5, None, 1, None) for i in range(0, 9, 3)]
    rows += [(f"h{i}", "m", kind, "Same", "Same", "One thing under two types, told at length and in every detail", 5, None, 1, None) for i, kind in enumerate(("Person", "Concept"))]
    rows += [("h2", "m", "Person", "Same", "Same", "short", 5, None, 1, None)]
    rows += [(f"k{i}", "m", "Person", f"K{i}", f"K{i}", "a formula of one type", 5, None, 1, None) for i in range(9)] + [("k9", "m", "Concept", "K9", "K9", "a formula of one type", 5, None, 1, None)]
    rows += [(f"l{i}", "m", "Person", f"K{i}", f"K{i}", "brief", 5, None, 1, None) for i in range(2)]
    got = {r.group_id: r.entity_id for r in S.field_winners(frame(spark, rows)).where("field_name = 'description'").collect()}
    assert got == {"f0": "g0", "f3": "g3", "f6": "g6", "h0": "h0", "k0": "k0", "k1": "k1"}
