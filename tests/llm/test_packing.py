import random
from collections import defaultdict

import numpy as np

from lodestone.llm import packing


def test_tree_gives_the_leftmost_fit():
    pick = random.Random(3)
    for _ in range(20):
        sizes = sorted((pick.randint(0, 10) for _ in range(60)), reverse=True)
        rooms, slow = [10] * 60, []
        for s in sizes:
            at = next(i for i, r in enumerate(rooms) if r >= s)
            rooms[at] -= s
            slow.append(at)
        assert packing.first_fit_decreasing(sizes, 10) == slow


def check(rows, sizes, capacity):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["container"]].append(r)
        docs[(r["doc_id"], r["copy"])].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at
            at += r["n_tokens"]
        assert at <= capacity
    totals = defaultdict(list)
    for (doc, _), pieces in docs.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["piece_start"] for r in pieces] == [capacity * i for i in range(len(pieces))]
        total = sum(r["n_tokens"] for r in pieces)
        assert len(pieces) == max(1, -(-total // capacity))
        totals[doc].append(total)
    wanted = defaultdict(list)
    for doc, size in sizes:
        wanted[doc].append(size or 0)
    assert {k: sorted(v) for k, v in totals.items()} == {k: sorted(v) for k, v in wanted.items()}
    return bins


def test_every_token_has_its_place(spark):
    pick = np.random.default_rng(1)
    sizes = [(i, int(s)) for i, s in enumerate(pick.lognormal(4, 1.5, 3000).astype(int))] + [(5000, 0), (5001, None), (5002, 2048), (5003, 2049), (5004, 9999), (7, 12), (7, 12)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), group_items=700).collect()
    bins = check(rows, sizes, 2048)
    assert sum(s or 0 for _, s in sizes) / (len(bins) * 2048) > 0.98


def test_a_third_of_equal_rows_and_empty_tables(spark):
    sizes = [(9, 100)] * 400 + [(i, 30) for i in range(800)]
    check(packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), capacity=256, group_items=300).collect(), sizes, 256)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_documents_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 5), (2, None, "y", 6), (3, "word " * 5000, "z", 7)], "doc_id long, text string, container string, n_tokens int")
    packed = packing.pack_documents(docs)
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3}
    report = packing.fill_report(packed).first()
    assert report["n_tokens"] == sum(r["n_tokens"] for r in rows) and 0 < report["filled"] <= 1


def test_a_rerun_is_equal(spark):
    sizes = spark.createDataFrame([(i, (i * 7919) % 900) for i in range(500)], "doc_id long, n_tokens long")
    one, two = (sorted(map(tuple, packing.pack(sizes.repartition(n), group_items=100).collect())) for n in (3, 5))
    assert one == two


def test_a_hot_key_is_spread_over_groups(spark):
    rows = [(1, i % 7 + 1) for i in range(3000)] + [(i, 5) for i in range(2, 3002)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(5).checkpoint()
    got = packing.pack(sizes, 100, 500).toPandas()
    assert len(got) == len(rows) and got.n_tokens.sum() == sum(n for _, n in rows)
    assert not got.duplicated(["doc_id", "copy", "piece"]).any() and got.groupby("container").n_tokens.sum().max() <= 100
    hot = got[got.doc_id == 1]
    assert (hot.container // (1 << 32)).nunique() >= 5 and hot.groupby(hot.container // (1 << 32)).size().max() < 1500
