import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from noetia.llm import names as N

GIVEN = "sebastian zachary elizabeth jules henrik gabriel edward wilhelmina anouk johannes".split()
LEX = N.Lexicon(GIVEN, ["energy", "robotics", "research", "institute", "textiles", "insurance", "instruments", "pharma"], [("Johannes", "Hannes"), ("Elizabeth", "Liz"), ("Zachary", "Zac")])


def plain_distance(a, b):
    """Shortest edit path by breadth-first search over strings, for short words."""
    seen, edge, n = {a}, {a}, 0
    letters = set(a + b)
    while b not in seen:
        nxt = set()
        for s in edge:
            for i in range(len(s) + 1):
                nxt.update(s[:i] + c + s[i:] for c in letters)
                if i < len(s):
                    nxt.add(s[:i] + s[i + 1 :])
                    nxt.update(s[:i] + c + s[i + 1 :] for c in letters)
                if i + 1 < len(s):
                    nxt.add(s[:i] + s[i + 1] + s[i] + s[i + 2 :])
        edge = {x for x in nxt - seen if len(x) <= max(len(a), len(b)) + 1}
        seen |= edge
        n += 1
    return n


@given(st.text("abc", max_size=4), st.text("abc", max_size=4))
@settings(max_examples=60, deadline=None)
def test_distance_is_the_shortest_path(a, b):
    assert N.edit_distance(a, b) == plain_distance(a, b)


@given(*[st.text("abcd", max_size=7)] * 3)
@settings(max_examples=200, deadline=None)
def test_distance_is_a_metric(a, b, c):
    d = N.edit_distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)
    assert N.edit_distance(a, b, 1) == min(d(a, b), 2)


@given(st.lists(st.text("abcd", min_size=4, max_size=9), max_size=30, unique=True))
@settings(max_examples=60, deadline=None)
def test_radius_join_is_exact(parts):
    want = {(i, j) for i, j in itertools.combinations(range(len(parts)), 2) if N.edit_distance(parts[i], parts[j]) <= min(N.radius(parts[i]), N.radius(parts[j]))}
    assert {(i, j) for i, j, _ in N.close_parts(parts, 7)} == want


def test_parsing():
    p = lambda s: N.parse_person(s, LEX)
    assert p("Skilbrarduja, Zac") == N.Form("skilbrarduja", "zac")
    assert p("Prof. HENRIK  Filvlarborfa").part == "filvlarborfa" and p("Jenklukai Anouk").lead == "anouk"
    assert p("Darles T.").initial == "t" and p("Leonhard Gro Jr.").suffix == "jr" and p("the boss") is None and p("Mum") is None
    assert p("Gabriel Vorlo-rjafor").part == "vorlorjafor"
    o = lambda s: N.parse_organisation(s, LEX)
    assert o("VorstilRobotics") == o("Robotics Vorstil") == N.Form("vorstil", "robotics", acronyms=o("Robotics Vorstil").acronyms)
    assert o("The Legartaihi Pharma Company").part == "legartaihi" and "lgthpa" in o("Legartaihi Pharma AG").acronyms
    assert o("the company") is None and o("Klumar Res. Inst. S.A.").lead.startswith("research")


E = "id string, memory_id string, entity_type string, name string, aliases array<string>, node string, kind string, part string"


def table(spark):
    rows, n = [], 0
    people = [  # (class, memory, names)
        ("a", "m1", ["Sebastian Kubinaisi", "Kubinaisi, Basti", "Sebastian Kubinai5i", "Sebastian Kubínaisi", "KUBINAISI SEBASTIAN"]),
        ("b", "m1", ["Edward Vlaiklo", "E. Vlaiklo"]),
        ("c", "m2", ["Sebastian Kubinaisi"]),
        ("d", "m1", ["Gabriel Drodaigrunai"]),
        ("e", "m1", ["Edward Drodaigrunai"]),
        ("f", "m1", ["J. Drodaigrunai"]),
        ("g", "m1", ["Henrik Suhisilor Jr."]),
        ("h", "m1", ["Henrik Suhisilor Sr."]),
        ("i", "m1", ["Elizabeth Praskarperar", "Elizabeth Praskarprear", "E. Praskarperar"]),
        ("j", "m1", ["Elizabeth Graito", "X. Other"]),
    ]
    orgs = [("o", "m1", ["Vlarvabimar Energy Inc.", "Vlarvabimar Energy Incorporated", "Vlarvabimar Group / Energy", "vlarvabimar-energy, inc"]), ("p", "m1", ["Vlarvabimar Robotics Inc."])]
    filler = [(f"f{i}", f"m{i % 9}", [f"{GIVEN[i % len(GIVEN)].title()} {w}xenvor{w[::-1]}"]) for i, w in enumerate("aq bw ce dr et fy gu hi jo kp lz mx nc ov pb qn rm sw tk ul".split() * 2)]
    for kind, src in (("Person", people + filler), ("Organization", orgs)):
        for cls, m, ns in src:
            for x in ns:
                rows.append((f"{cls}{n:03d}", m, kind, x, [x, "the boss"] if n % 2 else None, "z", "z", "z"))
                n += 1
    rows += [(None, "m1", "Person", "Edward Vlaiklo", None, "", "", ""), ("nul", "m1", "Person", None, None, "", "", ""), ("blank", "m1", "Person", " ", None, "", "", ""), ("concept", "m1", "Concept", "Sebastian Kubinaisi", None, "", "", "")]
    return spark.createDataFrame(rows + rows[:20], E)


def test_pairs(spark):
    nick = spark.createDataFrame([("Elizabeth", "Liz"), ("Sebastian", "Seb"), ("Edward", "Eddie"), ("Gabriel", "Gabi"), ("Henrik", "Henk"), (None, "x")], "given_name string, nickname string")
    got = {(r.id_a, r.id_b) for r in N.name_pairs(table(spark), nick).collect()}
    ids = sorted({r.id for r in table(spark).collect() if r.id and r.name and r.name.strip() and r.entity_type != "Concept"})
    want = {(x, y) for x, y in itertools.combinations(ids, 2) if x[0] == y[0] and x[0] in "abio"}
    assert got == want
    empty = spark.createDataFrame([], E)
    assert N.name_pairs(empty, nick.limit(0)).collect() == []


def test_copies_of_a_name_stay_linear(spark):
    rows = [(f"c{i:04d}", "m", "Person", "Elizabeth Praskarperar", None, "", "", "") for i in range(300)] + [("v1", "m", "Person", "Elizabeth Praskarprear", None, "", "", "")]
    nick = spark.createDataFrame([("Elizabeth", "Liz")], "given_name string, nickname string")
    got = N.name_pairs(spark.createDataFrame(rows, E), nick)
    assert got.count() == 300 and {r.id_b for r in got.collect()} == {"v1"}


def test_every_pair_of_ids_under_two_names_comes_out(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_IDS", 30, raising=False)
    ids = {name: [f"{name[-1]}{i:03d}" for i in range(n)] for name, n in (("Elizabeth Praskarperar", 90), ("Elizabeth Praskarprea", 80))}
    rows = [(x, "m", "Person", name, None, "", "", "") for name, xs in ids.items() for x in xs]
    nick = spark.createDataFrame([("Elizabeth", "Liz")], "given_name string, nickname string")
    got = [tuple(r) for r in N.name_pairs(spark.createDataFrame(rows, E), nick).collect()]
    want = {tuple(sorted(p)) for p in itertools.product(*ids.values())}
    assert len(got) == len(set(got)) and set(got) == want


def test_rare_given_names_meet(spark):
    """Given names that are no pivots: a typo in one, in the surname, or an initial."""
    people = [("a", ["Xiomara Lopezan", "Xiomra Lopezan", "Xiomara Lopzean", "X. Lopezan"]), ("b", ["Quillon Lopezan"]), ("c", ["Thorsa Vandermeer", "Thorsa Vandremer"]), ("d", ["Thorvi Vandermeer"]), ("e", ["Hannes Skolbrad", "H. Skolbrad"])]
    rows = [(f"{c}{i}", "m", "Person", x, None, "", "", "") for c, ns in people for i, x in enumerate(ns)]
    nick = spark.createDataFrame([("Johannes", "Hannes")], "given_name string, nickname string")
    got = {(r.id_a, r.id_b) for r in N.name_pairs(spark.createDataFrame(rows, E), nick).collect()}
    ids = sorted(r[0] for r in rows)
    assert got == {(x, y) for x, y in itertools.combinations(ids, 2) if x[0] == y[0]}


@given(st.text("abcd", min_size=5, max_size=9), st.text("abcd", min_size=5, max_size=9))
@settings(max_examples=300, deadline=None)
def test_strings_within_the_radius_share_a_deletion(a, b):
    r = min(N.radius(a), N.radius(b))
    assert N.edit_distance(a, b) > r or N.deletions(a, r) & N.deletions(b, r)


def _found(spark, rows, nick=()):
    nicknames = spark.createDataFrame([*nick, (None, "x")], "given_name string, nickname string")
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], E)
    return {(r.id_a, r.id_b) for r in N.name_pairs(df, nicknames).collect()}, df, nicknames


def test_short_forms_are_learned_from_shared_surnames(spark):
    """No table has them; relatives that share a surname now and then teach nothing."""
    rows = [(f"f{i}", f"m{i % 6}", "Person", f"{g} {w}xenvor{w[::-1]}", None) for i, (g, w) in enumerate(itertools.product(("Ignacio", "Margaret", "Johannes"), "aq bw ce dr et".split()))]
    rows += [(f"{w}{k}", f"m{i}", "Person", n, None) for i, w in enumerate(("zolvrem", "tarvik", "pelhonar")) for k, n in enumerate((f"Ignacio {w}", f"Nacho {w}"))]
    rows += [(f"r{w}{k}", f"m{i}", "Person", n, None) for i, (w, g) in enumerate((("skandor", "Margaret"), ("brolnik", "Johannes"))) for k, n in enumerate((f"{g} {w}", f"Quillby {w}"))]
    got, df, nick = _found(spark, rows)
    assert got == {(f"{w}0", f"{w}1") for w in ("zolvrem", "tarvik", "pelhonar")}


def test_aliases_count_by_what_they_have_of_the_name(spark):
    rows = [(f"f{i}", f"m{i % 6}", "Person", f"{g} {w}xenvor{w[::-1]}", None) for i, (g, w) in enumerate(itertools.product(("Robert", "Johannes"), "aq bw ce dr et fy".split()))]
    rows += [("a1", "m", "Person", "Robert Kelvarin", ["team lead"]), ("a2", "m", "Person", "Johannes Miltrov", ["team lead"])]  # a phrase
    rows += [(f"b{i}", f"m{i}", "Person", "Robert Smithson", ["Robert Smithsen"]) for i in range(6)]  # a namesake in many memories
    rows += [("c1", "m3", "Person", "Robert Smithsen", None)]
    rows += [("d1", "m", "Person", "Robert Wu", None), ("d2", "m", "Person", "Dr. ROBERT WU", None), ("d3", "m", "Person", "Robert Li", None)]
    got, *_ = _found(spark, rows)
    assert got == {("b3", "c1"), ("d1", "d2")}


def test_a_cell_in_blocks_gives_the_same(spark, monkeypatch):
    import random

    r = random.Random(8)
    w = lambda n: "".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(n))
    rows = []
    for i in range(120):
        core = w(4)
        for k, s in enumerate((core, core[:3] + "x" + core[4:], core[:-1])):
            rows.append((f"p{i:03d}{k}", "m", "Person", f"{('Elizabeth', 'Johannes')[i % 2]} {s.title()}", [f"{'EJ'[i % 2]}. {s.title()}"]))
            rows.append((f"q{i:03d}{k}", "m", "Organization", f"{s.title()} Robotics AG", None))
    plain, df, nick = _found(spark, rows)
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    cut_up = {(x.id_a, x.id_b) for x in N.name_pairs(df, nick).collect()}
    assert len(plain) > 300 and cut_up == plain
    c = {x.entity_id: x for x in N.classes_of_ids(df, nick).collect()}
    assert len(c) == len(rows) and all(c[a].class_id == c[b].class_id and c[a].n_links >= 1 for a, b in plain)
