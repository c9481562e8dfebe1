import numpy as np
import pytest

from noetia.llm import density, knn
from noetia.llm.vectors import fit_lists, pack, representatives, unit_vectors, unpack

S = "id string, embedding array<float>, rank int, label string, vec string"
BAD = [("bad1", None), ("bad2", []), ("bad3", [1.0] * 32), ("bad4", [0.0] * 64), ("bad5", [float("nan")] * 64), ("bad6", [None] * 64), ("bad7", [float("inf")] + [1.0] * 63)]


def data(seed=0, groups=60, lone=900):
    rng = np.random.default_rng(seed)
    out, member = [], {}
    for g in range(groups):
        c = rng.normal(size=64)
        for k in range(rng.integers(3, 12)):
            v = c / np.linalg.norm(c) + rng.normal(size=64) * 0.025
            out.append(v * rng.uniform(0.1, 9))
            member[len(out) - 1] = g
    out += list(rng.normal(size=(lone, 64)))
    return np.array(out), member


def frame(spark, v, extra=()):
    rows = [(f" ID{i:05d} ", [float(x) for x in w], 1, "x", "y") for i, w in enumerate(v)]
    return spark.createDataFrame(rows + [(i, w, 1, "x", "y") for i, w in [*BAD, (None, [1.0] * 64), *extra]] + rows[:30], S).repartition(4)


def test_pack_keeps_cosines():
    v = np.random.default_rng(1).normal(size=(50, 64)).astype(np.float32)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert np.abs(unpack(pack(u), 64) @ u.T - u @ u.T).max() < 3e-5


def brute(v, k, floor=-2.0):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(i, int(j)) for i in range(len(v)) for j in order[i] if s[i, j] >= floor}, s


def test_neighbours_against_brute_force(spark):
    v, _ = data()
    got = knn.most_similar(frame(spark, v), 5, margin=0.35, probes=24).collect()
    pairs = {(int(r.id[2:]), int(r.neighbour[2:])) for r in got}
    want, s = brute(v, 5)
    assert len(pairs) == len(got) and len(pairs & want) / len(want) >= 0.97
    assert all(abs(r.cosine - s[int(r.id[2:]), int(r.neighbour[2:])]) < 1e-4 for r in got)
    near = {(int(r.id[2:]), int(r.neighbour[2:])) for r in knn.most_similar(frame(spark, v), 5, 0.85).collect()}
    want, _ = brute(v, 5, 0.85)
    assert len(near & want) / len(want) >= 0.98 and near <= want | {(a, b) for a, b in near if abs(s[a, b] - min(s[a, c] for x, c in want if x == a)) < 1e-4}


def test_copies_fold_and_empty_tables(spark):
    v, _ = data(2, 10, 100)
    same = [(f"copy{i:03d}", [float(x) for x in v[0]]) for i in range(40)]
    got = knn.most_similar(frame(spark, v, same), 5, 0.85).where("id like 'copy%'").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.neighbour)
    assert len(by) == 40 and all(sorted(x) == [y for y in ["copy000", "copy001", "copy002", "copy003", "copy004", "copy005"] if y != i][:5] for i, x in by.items())
    few = [("copya", [float(x) for x in v[0]])]
    got = {(r.id, r.neighbour) for r in knn.most_similar(frame(spark, v, few), 5, 0.85).collect()}
    assert ("copya", "id00000") in got and any(a == "copya" and b not in ("id00000",) for a, b in got)
    empty = spark.createDataFrame([], S)
    assert knn.most_similar(empty, 5).collect() == [] and knn.most_similar(frame(spark, v[:0]), 5).collect() == []
    assert density.density_clusters(empty).collect() == []


def test_clusters_against_brute_force(spark):
    v, member = data(3)
    got = {(r.cluster_id, r.entity_id, r.size) for r in density.density_clusters(frame(spark, v)).collect()}
    groups = {}
    for i, g in member.items():
        groups.setdefault(g, []).append(f"id{i:05d}")
    assert got == {(min(m), x, len(m)) for m in groups.values() for x in m}


def test_clusters_of_copies_and_description(spark):
    v, member = data(4, 5, 50)
    lone = len(v) - 1
    same = [(f"z{i}", [float(x) for x in v[lone]]) for i in range(2)]
    e = frame(spark, v, same)
    d = density.density_clusters(e)
    assert {r.entity_id for r in d.where(f"cluster_id = 'id{lone:05d}'").collect()} == {f"id{lone:05d}", "z0", "z1"}
    named = e.selectExpr("id", "embedding", "concat('n', trim(id)) as name")
    c = {r.cluster_id: r for r in density.describe_clusters(named, d).collect()}
    assert len(c) == 6 and all(len(r.entities) == 3 and r.medoid_id for r in c.values())


def test_a_chain_of_pairs_is_no_cluster_but_copies_count(spark):
    rng = np.random.default_rng(9)
    basis, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    near = lambda i, j: basis[i] + 0.3 * basis[j]
    v = [basis[0], near(0, 1), basis[10], near(10, 11), *basis[20:60]]
    same = [("zz", [float(x) for x in basis[10]])]
    got = {(r.cluster_id, r.entity_id) for r in density.density_clusters(frame(spark, np.array(v), same)).collect()}
    assert got == {("id00002", x) for x in ("id00002", "id00003", "zz")}


def test_fit_is_bounded_and_lists_cover(spark):
    v, _ = data(5, 20, 300)
    reps = representatives(unit_vectors(frame(spark, v)))
    lists = fit_lists(reps, reps.count(), 20, 4, 64)
    assert lists.n_shards >= 4 and len(lists.centres) == len(lists.shard)
    row, lst, home = lists.probes(v.astype(np.float32), 0.1, 3)
    assert set(row) == set(range(len(v))) and all(np.bincount(row) <= 3) and len(lst) == len(row)
    assert len(home) == pytest.approx(len(v))


def test_no_member_is_lost_with_many_vectors(spark, tmp_path):
    """Groups of three just above the radius, spread over all directions: nearest cells lose some of them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(11)
    c = rng.normal(size=(6000, 1, 64))
    c /= np.linalg.norm(c, axis=2, keepdims=True)
    v = (c + rng.normal(size=(6000, 3, 64)) * 0.046).reshape(-1, 64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = [f"id{i:05d}" for i in range(len(v))]
    pq.write_table(pa.table({"id": ids, "embedding": pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32()))}), tmp_path / "e.parquet")
    pairs = []
    for lo in range(0, len(v), 2000):
        i, j = np.nonzero(v[lo : lo + 2000] @ v.T >= 0.8501)
        pairs += [(a + lo, b) for a, b in zip(i.tolist(), j.tolist()) if a + lo != b]
    near = set(pairs)
    whole = [g for g in range(6000) if all((3 * g + a, 3 * g + b) in near for a, b in ((0, 1), (0, 2), (1, 2)))]
    got = {(r.cluster_id, r.entity_id) for r in density.density_clusters(spark.read.parquet(str(tmp_path / "e.parquet"))).collect()}
    want = {(ids[3 * g], ids[3 * g + k]) for g in whole for k in range(3)}
    assert len(want) > 1000 and want <= got


def test_close_vectors_are_all_pairs():
    rng = np.random.default_rng(12)
    c = np.repeat(rng.normal(size=(40, 64)), 30, axis=0)
    u = (c + rng.normal(size=c.shape) * 0.35).astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for v, same in ((u, True), (u[:700], False)):
        s = u @ v.T
        want = {(i, j) for i, j in zip(*np.nonzero(s >= 0.85)) if not same or i < j}
        got = [(i, j) for x, y in density.close_vectors(u, v, same, 0.85) for i, j in zip(x, y)]
        assert len(got) == len(set(got)) and {p for p in set(got) ^ want if abs(s[p] - 0.85) > 1e-5} == set() and want


def test_wide_probing_finds_the_neighbours_of_lone_vectors(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(21)
    topics = rng.normal(size=(40, 64))
    v = np.concatenate([topics[rng.integers(0, 40, 5000)] * 0.7 + rng.normal(size=(5000, 64)), rng.normal(size=(1000, 64))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pq.write_table(pa.table({"id": [f"id{i:05d}" for i in range(len(v))], "embedding": pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32()))}), tmp_path / "e.parquet")
    got = knn.most_similar(spark.read.parquet(str(tmp_path / "e.parquet")), 5, wide=True).select("id", "neighbour").collect()
    pairs = {(int(r.id[2:]), int(r.neighbour[2:])) for r in got}
    want, _ = brute(v, 5)
    lone = {(a, b) for a, b in want if a >= 5000}
    assert len(pairs) == 5 * len(v) and len(pairs & want) >= 0.93 * len(want) and len(pairs & lone) >= 0.9 * len(lone)


def test_vector_sums_fold_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(22)
    keys = np.sort(rng.integers(0, 30, 500))
    u = rng.normal(size=(500, 64)).astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    batch = lambda at, to: pa.RecordBatch.from_arrays([pa.array(keys[at:to]), pack(u[at:to])], names=["k", "vec"])
    cuts = [0, 3, 3, 200, 201, 460, 500]
    parts = list(density._partial_sums("k", 64)(batch(a, b) for a, b in zip(cuts, cuts[1:])))
    out = {}
    for b in density._fold_sums("k")(iter(parts)):
        for k, t, n in zip(*(c.to_pylist() for c in b.columns)):
            assert k not in out
            out[k] = (np.frombuffer(t, "<f8"), n)
    assert set(out) == set(keys.tolist())
    assert all(n == (keys == k).sum() and np.allclose(t, u[keys == k].sum(axis=0), atol=1e-3) for k, (t, n) in out.items())
