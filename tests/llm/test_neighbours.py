import datetime as dt

import numpy as np

from lodestone.llm import neighbours as nb

SCHEMA = "unit_id long, dim int, v_min float, v_max float, data array<smallint>, written_at timestamp"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def record(i, data, minute=0, low=-1.0, high=1.0, dim=None):
    return (i, len(data) if dim is None else dim, low, high, [int(x) for x in data], dt.datetime(2025, 1, 1, 0, minute))


def brute(ids, vectors, k=5):
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(v @ v.T, 6)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-sims[a, b], ids[b]))[:k]
        out[i] = [ids[b] for b in order]
    return out


def clusters(n, seed=0, dim=96):
    pick = np.random.default_rng(seed)
    centres = pick.standard_normal((max(1, n // 40), dim))
    return np.clip(np.round(127.5 + 40 * (centres[pick.integers(0, len(centres), n)] + 0.4 * pick.standard_normal((n, dim)))), 0, 255)


def test_recall_against_brute_force(spark):
    data = clusters(2500)
    ids = [int(i) for i in np.random.default_rng(1).permutation(9000)[: len(data)]]
    found = {}
    keys = spark.createDataFrame([(i,) for i in ids], "id long")
    for r in nb.nearest(table(spark, [record(i, d) for i, d in zip(ids, data)]), keys, budget=100).collect():
        found.setdefault(r["unit_id"], {})[r["rank"]] = r["other"]
    true = brute(ids, -1 + data / 255 * 2)
    hit = sum(len(set(true[i]) & set(found[i].values())) for i in ids)
    assert hit / (5 * len(ids)) >= 0.97


def test_a_third_of_near_copies_and_loose_vectors(spark):
    pick = np.random.default_rng(5)
    data = pick.integers(0, 256, (3000, 96))
    data[:1000] = np.clip(data[0] + pick.integers(-1, 2, (1000, 96)), 0, 255)
    ids = [int(i) for i in pick.permutation(9000)[: len(data)]]
    found = {}
    for r in nb.nearest(table(spark, [record(i, d) for i, d in zip(ids, data)]), spark.createDataFrame([(i,) for i in ids], "id long"), budget=100).collect():
        found.setdefault(r["unit_id"], set()).add(r["other"])
    true = brute(ids, -1 + data / 255 * 2)
    assert all(len(found[i]) == 5 for i in ids)
    for part in (ids[:1000], ids[1000:]):
        assert sum(len(set(true[i]) & found[i]) for i in part) / (5 * len(part)) >= 0.99


def test_a_third_of_equal_vectors_and_ties(spark):
    data = clusters(300, 3)
    data[:100] = data[0]
    ids = list(range(1, 301))
    got = {}
    for r in nb.nearest(table(spark, [record(i, d) for i, d in zip(ids, data)]), spark.createDataFrame([(i,) for i in ids], "id long")).collect():
        got.setdefault(r["unit_id"], []).append((r["rank"], r["other"]))
    true = brute(ids, -1 + data / 255 * 2)
    assert [o for _, o in sorted(got[50])] == true[50] == [1, 2, 3, 4, 5]
    assert [o for _, o in sorted(got[3])] == [1, 2, 4, 5, 6]


def test_only_usable_and_latest_records_count(spark):
    a, b, zero = [10] * 95 + [200], [12] * 95 + [190], [0] * 96
    rows = [
        record(1, zero, 5, 0.0, 0.0), record(1, a, 9), record(2, b), record(3, a, 1), (3, 96, -1.0, 1.0, None, dt.datetime(2025, 2, 1)), record(4, [1] * 8), record(5, zero, 0, 0.0, 1.0), record(6, a),
        (7, 96, None, 1.0, a, dt.datetime(2025, 1, 1)), record(8, a[:95], dim=96), record(1, a, 9),
    ]
    keys = spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 4, 5, 7, 8)], "id long")
    pairs = nb.similar_pairs(nb.nearest(table(spark, rows), keys))
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]


def test_none_and_one(spark):
    keys = spark.createDataFrame([(1,)], "id long")
    assert nb.nearest(table(spark, []), keys).count() == 0
    assert nb.nearest(table(spark, [record(1, [1] * 96)]), keys).count() == 0


def strings(words):
    return np.array(words, np.uint64).view(np.int64)


def test_descent_and_ascent_on_small_trees():
    """Four places share 2 bits, two of them 5; a fifth shares none."""
    top = np.uint64(1) << np.uint64(59)
    words = np.sort(strings([0b00000 * top, 0b00001 * top, 0b01000 * top, 0b01001 * top, 0b10000 * top]).view(np.uint64)).view(np.int64)
    fines = np.zeros(5, np.int64)
    lcp = nb.beside(words, fines)
    assert lcp.tolist() == [4, 1, 4, 0]
    steps, bounds = nb.descend(lcp, 10)
    assert [[(int(s) >> 20, int(s) & 0xFFFFF) for s in steps[a:b]] for a, b in zip(bounds, bounds[1:])] == [[(4, 1), (1, 2), (0, 1)]] * 4 + [[(0, 4)]]
    # two trees alike: two others at 4 bits, six at 1 bit
    both, ends = np.concatenate([steps[:3], steps[:3], steps[-1:]]), np.array([0, 6, 7])
    assert nb.ascend(both, ends, 2).tolist() == [4, 0] and nb.ascend(both, ends, 3).tolist() == [1, 0] and nb.ascend(both, ends, 100).tolist() == [0, 0]
    begin, end = nb.block_of(lcp, np.array([4, 1, 0, 128]), np.array([0, 0, 4, 2]))
    assert list(zip(begin.tolist(), end.tolist())) == [(0, 2), (0, 4), (0, 5), (2, 3)]


def test_halos_give_all_places_of_a_prefix(spark, monkeypatch):
    """Where ranges are small, the halos give what one range gives."""
    data = clusters(1500, 4)
    ids = list(range(1, 1501))
    vectors = table(spark, [record(i, d) for i, d in zip(ids, data)])
    keys = spark.createDataFrame([(i,) for i in ids], "id long")
    near = []
    for rows in (1 << 20, 3000):
        monkeypatch.setattr(nb, "RANGE_ROWS", rows)
        hashed = nb.hash_strings(nb._pack(nb.usable_vectors(vectors, keys)), 4).checkpoint()
        found = nb.class_candidates(hashed, 1500, 5, 4, 20).groupBy("unit_id").agg(nb.merged(5), nb.F.first("depth").alias("depth"))
        near.append({r["unit_id"]: [x["other"] for x in r["near"]] for r in found.collect()})
    same = sum(near[0][i] == near[1][i] for i in ids)
    assert same >= 0.99 * len(ids)


def test_more_trees_settle_what_would_be_compared_with_all(spark, monkeypatch):
    """Vectors whose fifth neighbour is far, but which have near ones, need no comparison with all others."""
    data = clusters(3000, 6)
    data[::2] = np.random.default_rng(7).integers(0, 256, data[::2].shape)
    ids = [int(i) for i in np.random.default_rng(8).permutation(9000)[: len(data)]]
    for name, value in (("LEAF", 64), ("LEAST_ASKED", 30)):
        monkeypatch.setattr(nb, name, value, raising=False)
    in_blocks, among_all = [], nb.among_all
    monkeypatch.setattr(nb, "among_all", lambda queries, *rest: in_blocks.append(queries.count()) or among_all(queries, *rest))
    keys = spark.createDataFrame([(i,) for i in ids], "id long")
    vectors = table(spark, [record(i, d) for i, d in zip(ids, data)])
    found = {tuple(r) for r in nb.similar_pairs(nb.nearest(vectors, keys, budget=20, least=0.8)).collect()}
    v = -1 + data / 255 * 2
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = {(min(i, o), max(i, o)) for a, (i, others) in enumerate(brute(ids, v).items()) for o in others if np.round(v[a] @ v[ids.index(o)], 6) >= 0.8}
    assert len(found & true) >= 0.99 * len(true) > 3000 and len(found - true) <= 0.01 * len(true)
    assert in_blocks[0] < 0.05 * len(ids)


def test_leaves_hold_all_places_once():
    words = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 1000)
    words[:300] = words[0]
    parts = list(nb.leaves(words, 0, 50))
    assert sorted(np.concatenate([p for p, _ in parts]).tolist()) == list(range(1000))
    for places, depth in parts:
        assert len(set((words[places].view(np.uint64) >> np.uint64(64 - depth)).tolist())) == 1
        assert len(places) <= 50 or depth == nb.BITS
