import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from noetia.operators import intervals as I
from tests.conftest import rows

US = 1_000_000


def brute(spans, tol):
    out = []
    for s, e in sorted(spans):
        if out and s - out[-1][1] <= tol:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 30)), max_size=40), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_map_equals_sorted_sweep(spans, tol):
    spans = [(s, s + n) for s, n in spans]
    m = I.IntervalMap(tol)
    for s, e in spans:
        m.insert(s, e)
    assert m.periods() == brute(spans, tol)
    assert m.gaps() == [(a[1], b[0]) for a, b in zip(m.periods(), m.periods()[1:])]


def test_gaps_and_periods_over_buckets_and_a_hot_key(spark):
    r = random.Random(3)
    data = []
    for k in ["hot"] * 3000 + [f"k{i % 40}" for i in range(800)] + [None] * 30:
        s = r.randint(0, 70 * 365 * 86400) * US
        data.append((k, "t", s, s + r.choice([0, 60, 86400 * 30, 86400 * 4000]) * US))
    data += [("k1", "t", I.ALWAYS_BEFORE, 5 * US), ("k2", "t", 10 * US, I.ALWAYS_AFTER), ("k3", "t", 9, 3), ("k4", "t", None, 4)]
    df = spark.createDataFrame(data, "key string, kind string, start long, end long").repartition(5)
    gaps, periods = set(), set()
    by = {}
    for k, t, s, e in data:
        if s is not None and s <= e:
            by.setdefault((k, t), []).append((s, e))
    for (k, t), spans in by.items():
        ps = brute(spans, US)
        gaps |= {(k, t, a[1], b[0]) for a, b in zip(ps, ps[1:])}
        periods |= {(k, t, None if a == I.ALWAYS_BEFORE else a, None if b == I.ALWAYS_AFTER else b) for a, b in ps}
    assert set(map(tuple, I.interval_gaps(df, ["key", "kind"]).collect())) == gaps
    assert set(map(tuple, I.interval_periods(df, ["key", "kind"]).collect())) == periods
    twice = I.interval_gaps(df.union(df), ["key", "kind"])
    assert set(map(tuple, twice.collect())) == gaps and twice.count() == len(gaps)


def test_relationships_nulls_blanks_and_extra_columns(spark):
    t = dt.datetime
    s = "source_id string, relation_type string, valid_from timestamp, valid_until timestamp, start string, bucket int, kind string"
    data = [
        (" A ", "Works_At ", t(2001, 1, 1), t(2001, 2, 1), "x", 1, "y"),
        ("a", "WORKS_AT", t(2001, 3, 1), None, "x", 1, "y"),
        ("a", "works_at", None, t(2000, 1, 1), None, None, None),
        ("a", "works_at", t(2001, 2, 1, 0, 0, 1), t(2001, 2, 2), None, None, None),
        ("a", "works_at", t(2005, 1, 1), t(2004, 1, 1), None, None, None),
        (None, "works_at", t(2001, 1, 1), t(2001, 2, 1), None, None, None),
        ("  ", "works_at", t(2001, 1, 1), t(2001, 2, 1), None, None, None),
    ]
    df = spark.createDataFrame(data, s)
    sec = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())
    assert rows(I.relationship_gaps(df)) == sorted([("a", "works_at", sec(2000, 1, 1), sec(2001, 1, 1)), ("a", "works_at", sec(2001, 2, 2), sec(2001, 3, 1))], key=repr)
    assert (None, sec(2000, 1, 1)) in [tuple(r)[2:] for r in I.relationship_periods(df).collect()]
    assert I.relationship_gaps(df.limit(0)).collect() == []


def test_hot_keys_are_cut_into_parts(spark, monkeypatch):
    r = random.Random(5)
    day = 86400 * US
    data = [("hot", s := r.randint(0, 300) * day * 70 + r.randint(0, 9) * US, s + r.choice([0, 40, 86400 * 20, 86400 * 900]) * US) for _ in range(900)]
    data += [("hot", I.ALWAYS_BEFORE, -5 * day), ("hot", 25_000 * day, I.ALWAYS_AFTER), (None, 5, 6), ("cold", 1, 2), ("cold", 9 * day, 10 * day)]
    df = spark.createDataFrame(data, "key string, start long, end long").repartition(6)
    plain = rows(I.interval_gaps(df, ["key"])), rows(I.interval_periods(df, ["key"]))
    want = brute([x[1:] for x in data if x[0] == "hot"], US)
    assert [x[1:] for x in plain[0] if x[0] == "hot"] == sorted([(a[1], b[0]) for a, b in zip(want, want[1:])], key=repr)
    monkeypatch.setattr(I, "PART_ROWS", 20)
    monkeypatch.setattr(I, "SLOTS", 8)
    assert (rows(I.interval_gaps(df, ["key"])), rows(I.interval_periods(df, ["key"]))) == plain
    monkeypatch.setattr(I, "PARTS", 4)
    assert (rows(I.interval_gaps(df, ["key"])), rows(I.interval_periods(df, ["key"]))) == plain
