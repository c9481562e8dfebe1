import datetime as dt
import random

from noetia.operators import orphans as O
from tests.conftest import rows

T = dt.datetime
REFS = "ref_id string, field string, target string, scope string, created timestamp, k string, part int"
PARENTS = "id string, scope string, deleted boolean, created timestamp, k string"


def brute(refs, parents):
    by = {}
    for i, sc, d, c, _ in parents:
        if i and i.strip():
            by.setdefault(i.strip().lower(), (sc, d, c))
    out = set()
    for rid, f, t, sc, c, *_ in refs:
        t = (t or "").strip().lower()
        if not t:
            continue
        if t not in by:
            out.add((rid, f, "missing"))
            continue
        psc, d, pc = by[t]
        if d:
            out.add((rid, f, "deleted"))
        elif psc != sc:
            out.add((rid, f, "other_memory"))
        elif pc and c and pc > c:
            out.add((rid, f, "created_later"))
    return out


def test_against_brute_force_with_a_hot_target(spark):
    r = random.Random(5)
    parents = [(f"p{i}", f"m{i % 3}", i % 17 == 0, T(2020, 1, 1 + i % 28) if i % 5 else None, "x") for i in range(400)] + [("  ", "m", False, None, "x"), (None, "m", False, None, "x")]
    refs = []
    for i in range(3000):
        t = "P7 " if i % 3 == 0 else r.choice([f"p{r.randint(0, 500)}", None, " ", "ü€"])
        refs.append((f"r{i}", r.choice(["source_id", "target_id"]), t, f"m{r.randint(0, 2)}", T(2020, 1, r.randint(1, 28)) if r.random() < 0.9 else None, "x", 1))
    refs += refs[:200]
    got = O.orphan_references(spark.createDataFrame(refs, REFS).repartition(4), spark.createDataFrame(parents + parents[:50], PARENTS))
    found = [(x.ref_id, x.field, x.reason) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(refs, parents)


def test_empty_tables(spark):
    refs, parents = spark.createDataFrame([("a", "f", "x", "m", None, "", 1)], REFS), spark.createDataFrame([], PARENTS)
    assert [tuple(r) for r in O.orphan_references(refs, parents).collect()] == [("a", "f", None, "missing")]
    assert O.orphan_references(refs.limit(0), parents).collect() == []


def test_report_counts_by_month(spark):
    d = spark.createDataFrame([("a", "source_id", 1577836800000000, "missing"), ("b", "source_id", 1577836800000001, "missing"), ("c", "target_id", None, "deleted")], "relationship_id string, ref_field string, created_us long, reason string")
    assert rows(O.orphan_report(d)) == sorted([("source_id", "2020-01", "missing", 2), ("target_id", None, "deleted", 1)], key=repr)
