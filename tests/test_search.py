import math

import numpy as np
import pytest

from lodestone.operators import federated, fusion, graph, ivf, lexical, vectors

UNITS = "repo string, id long, file_path string, language string, unit_type string, name string, full_signature string, docstring string, line_start int, line_end int, body string, calls array<string>, complexity int, has_embedding boolean, embedding_model string"


def unit(i, name, body="", path="src/a.py", language="python", repo="r", sig=None, doc=None, lines=(1, 5), calls=(), kind="function"):
    return (repo, i, path, language, kind, name, sig, doc, *lines, body, list(calls), 1, False, None)


@pytest.fixture(scope="module")
def units(spark):
    rows = [
        unit(1, "process_payment", "charge the card and process payment", "src/pay.py"),
        unit(2, "refund", "refund the payment of a process", "src/refund.py", sig="def refund(x:", doc="Gives payment back."),
        unit(3, "helper", "nothing to see", "tests/unit/test_pay.py"),
        unit(4, "test_payment", "payment payment payment", "src/test/pay_test.py"),
        unit(5, "charge", "card card", "src/b.rs", "rust", calls=("refund", "missing")),
    ]
    return spark.createDataFrame(rows, UNITS).cache()


@pytest.fixture(scope="module")
def index(units):
    return lexical.build_postings(units).cache(), lexical.field_stats(units).cache()


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(
    "query,found",
    [
        ("payment", {1, 2, 4}), ("process_payment", {1}), ('"payment process"', set()), ("payment -refund", {1, 4}), ("+payment +card", {1}), ("payment AND card", {1}), ("card OR refund", {1, 2, 5}), ("name:refund", {2}), ("name:payment", {1, 4}),
        ("(card OR refund) AND process", {1, 2}), ("NOT payment", set()), ("payment AND", {1, 2, 4}), ("((", set()), ("zzz", set()), ("", set()), ("   ", set()), ("unknown:refund", set()), ("a+b:c*?", set()), ("xyz_function_name_zzz", set()),
    ],
)
def test_query_language(index, query, found):
    assert set(ids(lexical.scores(*index, lexical.parse_query(query)))) == found


def test_score_is_bm25(index, units):
    score = {r["id"]: r["score"] for r in lexical.scores(*index, lexical.parse_query("card")).collect()}
    n, df = 5, 2
    mean = sum(len(b.split()) for b in ["charge the card and process payment", "refund the payment of a process", "nothing to see", "payment payment payment", "card card"]) / 5
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    assert score[5] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2 / mean)))


def test_filters_see_the_overfetched_rows_only(index, units):
    only = lexical.SearchFilter(language="python", exclude_tests=True)
    assert set(ids(lexical.filtered_search(units, *index, "payment", 10, only))) == {1, 2}
    assert len(ids(lexical.filtered_search(units, *index, "payment", 1))) == 1
    assert set(ids(lexical.filtered_search(units, *index, "payment card", 10, lexical.SearchFilter(path="b.rs")))) == {5}
    rows = lexical.filtered_search(units, *index, "payment", 10).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3]
    assert {r["id"]: r["snippet"] for r in rows}[2] == "def refund(x:"
    assert lexical.SearchFilter().is_empty() and not only.is_empty()


def test_modified_since(spark, index, units):
    files = spark.createDataFrame([("src/pay.py", 100), ("src/refund.py", 10)], "file_path string, last_indexed long")
    rows = lexical.filtered_search(units, *index, "payment", 10)
    assert ids(lexical.modified_since(rows, files, 50)) == [1]


def test_fusion_lifts_an_exact_name(spark):
    rows = spark.createDataFrame([(1, 10.0, "process_payment"), (2, 8.0, "refund"), (3, 6.0, "charge_customer")], "id long, score double, name string")
    fused = fusion.ordered(fusion.fuse(rows, "charge_customer")).orderBy("rank").collect()
    assert [r["id"] for r in fused][0] == 3 and {r["id"] for r in fused} == {1, 2, 3}
    assert fused[0]["score"] == pytest.approx(1000 * (1 / 63 + 1 / 6))
    assert fusion.fuse(rows.where("false"), "x").count() == 0
    near = spark.createDataFrame([(2, 0.9), (77, 0.99)], "id long, similarity double")
    three = {r["id"]: r["vector_rank"] for r in fusion.fuse_hybrid(rows, "refund", near).collect()}
    assert three == {1: 3, 2: 1, 3: 3}


def test_call_graph(spark, units):
    edges = graph.edges_of(units)
    assert sorted(tuple(r) for r in edges.collect()) == [(5, "missing", 1), (5, "refund", 1)]
    assert ids(graph.callers_of(units, edges, "refund")) == [5]
    assert ids(graph.callees_of(units, edges, 5)) == [2]
    assert ids(graph.unused_functions(units, edges)) == [5, 1, 4, 3]
    more = edges.union(spark.createDataFrame([(99, "x", 1)], edges.schema))
    assert graph.orphan_edges(units, more).count() == 1 and graph.live_edges(units, more).count() == 2
    context = {r["id"]: (r["callers"], r["callees"]) for r in graph.context(units, edges, units.select("id", "name")).collect()}
    assert context[2] == (["charge"], []) and context[5] == ([], ["refund"])
    assert {r["name"]: r["n_callers"] for r in graph.popularity(units, edges).collect()}["refund"] == 1


def test_smallest_unit_at_a_line(spark):
    rows = spark.createDataFrame([unit(1, "outer", lines=(1, 50)), unit(2, "inner", lines=(5, 15))], UNITS)
    assert ids(graph.unit_at_line(rows, "src/a.py", 10)) == [2] and ids(graph.unit_at_line(rows, "src/a.py", 20)) == [1] and ids(graph.unit_at_line(rows, "src/a.py", 60)) == []


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.95, 0.1, 0.0, 0.0])], "unit_id long, vector array<double>")
    records = vectors.to_records(rows, dim=4)
    best = vectors.nearest_to(records, [1.0, 0.0, 0.0, 0.0], 2).collect()
    assert [r["id"] for r in best] == [1, 3] and best[0]["similarity"] > 0.99
    assert vectors.nearest_to(records, [0.0] * 4, 2).count() == 0 and vectors.nearest_to(records, [1.0], 2).count() == 0
    assert vectors.upsert(records, records.where("unit_id = 1")).count() == 3
    with pytest.raises(Exception, match="expected 5 dimensions"):
        vectors.to_records(rows, dim=5).collect()


def test_inverted_file_against_brute_force(spark):
    pick = np.random.default_rng(5)
    centres = pick.standard_normal((20, 16))
    data = centres[pick.integers(0, 20, 1500)] + 0.3 * pick.standard_normal((1500, 16))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<double>")
    fitted = ivf.fit_centroids(rows)
    queries = rows.where("id % 100 = 0").selectExpr("id AS query_id", "vector")
    found = {}
    for r in ivf.search(ivf.with_cells(rows, fitted), queries, fitted, 10, probes=8).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hit = sum(len(found[q] & set(np.lexsort((np.arange(1500), -np.round(unit @ unit[q], 9)))[:10].tolist())) for q in range(0, 1500, 100))
    assert hit / 150 >= 0.9
    assert ivf.fit_centroids(rows.where("false")).size == 0


def test_several_repositories(spark):
    rows = [unit(i, "same" if i % 3 == 0 else f"n{i}", "payment " * (i % 5 + 1), repo=f"r{i % 2}", path=f"src/{i}.py") for i in range(1, 13)]
    units = spark.createDataFrame(rows, UNITS)
    repos = spark.createDataFrame([("r0", 1), ("r1", 2), ("empty", 3)], "name string, ordinal int")
    index = lexical.build_postings(units), lexical.field_stats(units)
    got = federated.search_repos(units, *index, repos, "payment", 10).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    names = [r["name"] for r in got]
    assert len(names) == len(set(names)) and {r["repo"] for r in got} == {"r0", "r1"}
    assert federated.search_repos(units, *index, repos, "payment", 3, lexical.SearchFilter(language="go")).count() == 0


def test_similar_units_leave_out_the_unit_itself(spark):
    units = spark.createDataFrame([unit(1, "a", "one", path="x.py"), unit(2, "b", "two", path="y.py"), unit(3, "b", "two", repo="q", path="z.py"), unit(4, "c", "three", repo="q", path="w.py")], UNITS)
    records = vectors.to_records(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.9, 0.1]), (4, [0.0, 1.0])], "unit_id long, vector array<double>"))
    got = federated.find_similar(units, records, "r", "x.py", 3).collect()
    assert [r["name"] for r in got] == ["b", "c"]


def test_models_by_name(spark):
    import pickle

    import numpy as np

    from lodestone import models

    own = models.load_model("tokens-32")
    a, b, c, d = np.array(own.embed_batch(["load the user record", "load the user table", "spin fast motors", ""]))
    assert own.dimension == len(a) == 32 and abs(np.linalg.norm(a) - 1) < 1e-9 and a @ b > a @ c and not d.any()
    assert np.allclose(pickle.loads(pickle.dumps(own)).embed_batch(["load the user record"])[0], a)
    models.register_model("mine", lambda: own)
    assert models.load_model("mine") is own
    with pytest.raises(KeyError):
        models.load_model("other")


def test_near_copies_with_hot_buckets(spark, monkeypatch):
    import numpy as np

    from lodestone.operators import vector_copies

    monkeypatch.setattr(vector_copies, "CELL", 16)
    pick = np.random.default_rng(3)
    base = pick.integers(0, 256, (60, 8))
    rows = [np.clip(base[i % 60 if i < 120 else 0] + (pick.integers(-2, 3, 8) if i >= 60 else 0), 0, 255) for i in range(240)] + [base[5], base[5], np.zeros(8, int)]
    table = spark.createDataFrame([(i, 8, 0.0, 1.0, [int(x) for x in r]) for i, r in enumerate(rows)], "unit_id long, dim int, v_min float, v_max float, data array<smallint>")
    got = {r["unit_id"]: r["copy_of"] for r in vector_copies.near_copies(table, 8).collect()}
    v = np.array(rows, float)[:-1]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(v @ v.T, 6)
    assert got == {i: int(np.flatnonzero(sims[i, :i] >= 0.99)[0]) for i in range(len(v)) if (sims[i, :i] >= 0.99).any()}
