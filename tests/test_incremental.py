import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import incremental as inc

SCANS = "scan_id long, repo string, file_path string, event_kind string, file_hash string, observed_at timestamp, received_at timestamp"
INDEX = "repo string, file_path string, file_hash string, last_indexed long, needs_reindex boolean"
RUNS = "run_id long, repo string, started_at long, finished_at long, run_status string"


def at(minute):
    return dt.datetime(2025, 1, 1, 0, minute)


def found(spark, scans, index, runs):
    scans = [(i, *s[:4], s[4], s[4]) for i, s in enumerate(scans)]
    out = inc.files_to_process(spark.createDataFrame(scans, SCANS), spark.createDataFrame(index, INDEX), spark.createDataFrame(runs, RUNS))
    return {(r["repo"], r["file_path"]): r["change"] for r in out.collect()}


def test_new_changed_and_same(spark):
    scans = [("r", "a.py", "seen", "AA", at(1)), ("r", "b.py", "seen", "bb", at(1)), ("r", "c.py", "seen", "cc", at(1)), ("r", "d.py", "seen", "dd", at(1))]
    index = [("r", "a.py", "aa", 150, False), ("r", "b.py", "zz", 150, False), ("r", "d.py", "dd", 150, True)]
    assert found(spark, scans, index, [(1, "r", 100, 200, "ok")]) == {("r", "b.py"): "changed", ("r", "c.py"): "new", ("r", "d.py"): "changed"}


def test_paths_and_hashes_are_made_plain(spark):
    scans = [("r", ".\\x\\\\y.py", "seen", "sha256:AB", at(1)), ("r", "./x//y.py", "seen", "ab", at(2))]
    assert found(spark, scans, [("r", "x/y.py", "ab", 150, False)], [(1, "r", 100, 200, "ok")]) == {}
    assert found(spark, scans, [], []) == {("r", "x/y.py"): "new"}


def test_latest_observation_counts_and_seen_without_hash_does_not(spark):
    scans = [("r", "a", "seen", "a1", at(5)), ("r", "a", "gone", None, at(4)), ("r", "b", "seen", "b1", at(1)), ("r", "b", "gone", None, at(2)), ("r", "c", "seen", "c1", at(1)), ("r", "c", "seen", None, at(9))]
    assert found(spark, scans, [], []) == {("r", "a"): "new", ("r", "c"): "new"}
    # equal times go by scan_id
    assert found(spark, [("r", "a", "seen", "x", at(1)), ("r", "a", "gone", None, at(1))], [], []) == {}


@pytest.mark.parametrize("run", [(1, "r", 100, 200, "failed"), (1, "r", 100, None, "ok"), (1, "q", 100, 200, "ok"), (1, "r", 151, 200, "ok"), (1, "r", 100, 149, "ok")])
def test_rows_outside_an_ok_run_do_not_count(spark, run):
    assert found(spark, [("r", "a", "seen", "aa", at(1))], [("r", "a", "aa", 150, False)], [run]) == {("r", "a"): "new"}


@pytest.mark.parametrize("moment", [100, 200])
def test_run_bounds_are_inclusive(spark, moment):
    assert found(spark, [("r", "a", "seen", "aa", at(1))], [("r", "a", "aa", moment, False)], [(1, "r", 100, 200, "ok")]) == {}


def test_latest_valid_row_counts_across_hours(spark):
    runs = [(1, "r", 0, 90_000, "ok"), (2, "r", 90_001, 95_000, "failed")]
    index = [("r", "a", "old", 10, False), ("r", "a", "aa", 80_000, False), ("r", "a", "zz", 92_000, False)]
    assert found(spark, [("r", "a", "seen", "aa", at(1))], index, runs) == {}


def test_empty_tables_and_nulls(spark):
    assert found(spark, [], [], []) == {}
    assert found(spark, [(None, "a", "seen", "aa", at(1)), ("r", "b", None, "bb", at(1))], [(None, None, None, None, None)], [(1, None, None, None, None)]) == {(None, "a"): "new"}


def test_row_hash_tells_null_from_empty_and_places(spark):
    rows = spark.createDataFrame([("a", ""), ("a", None), ("", "a"), ("a:", "b")], "x string, y string")
    assert rows.select(inc.row_hash([F.col("x"), F.col("y")]).alias("h")).distinct().count() == 4


def test_state_survives_a_run_that_breaks_off(spark, tmp_path):
    store = inc.StateStore(spark, str(tmp_path / "state"), ["key"])
    rows = lambda *x: spark.createDataFrame(list(x), "key string, file_hash string")
    seen = []

    def process(df):
        seen.append(sorted(r["key"] for r in df.collect()))

    def breaks(df):
        process(df)
        raise ValueError("broke off")

    now = rows(("a", "1"), ("b", "1"))
    with pytest.raises(ValueError):
        inc.run_incremental(now, store, breaks)
    assert store.version() == 0
    assert inc.run_incremental(now, store, process) == 1
    assert inc.run_incremental(now, store, process) == 2
    inc.run_incremental(rows(("a", "1"), ("b", "2"), ("c", "1")), store, process)
    assert seen == [["a", "b"], ["a", "b"], [], ["b", "c"]]
    with pytest.raises(RuntimeError):
        store.commit(now, 1)  # a run that began from an older version


def test_rows_that_change_or_arrive_during_a_run_are_left_to_the_next(spark, tmp_path):
    source = tmp_path / "source.txt"
    source.write_text("a 1\nb 1")
    path = str(source)

    def read(batches):  # again at each evaluation
        import pyarrow as pa

        for _ in batches:
            with open(path) as f:
                rows = [x.split() for x in f]
            yield pa.RecordBatch.from_pydict({"key": [r[0] for r in rows], "file_hash": [r[1] for r in rows]})

    now = spark.range(1, numPartitions=1).mapInArrow(read, "key string, file_hash string")
    store = inc.StateStore(spark, str(tmp_path / "state"), ["key"])
    seen = []

    def process(df):
        seen.append(sorted((r["key"], r["file_hash"]) for r in df.collect()))
        source.write_text("a 1\nb 2\nc 1")

    for _ in range(3):
        inc.run_incremental(now, store, process)
    assert seen == [[("a", "1"), ("b", "1")], [("b", "2"), ("c", "1")], []]


def test_removed_keys(spark):
    now = spark.createDataFrame([("a",)], "key string")
    was = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    assert {r["key"] for r in inc.removed(now, was, ["key"]).collect()} == {"b", None}


def test_of_two_runs_from_one_version_one_wins(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "key string, file_hash string")
    first, second = (inc.StateStore(spark, str(tmp_path / "state"), ["key"]) for _ in range(2))
    inc.run_incremental(rows(("a", "1")), first, lambda df: df.count())

    def meanwhile(df):
        inc.run_incremental(rows(("a", "1"), ("b", "1")), second, lambda d: d.count())

    with pytest.raises(RuntimeError):
        inc.run_incremental(rows(("a", "1"), ("c", "1")), first, meanwhile)
    assert {r["key"] for r in first.read(rows(("a", "1"))).collect()} == {"a", "b"}
    # both past the test of the version: the pointer decides
    assert second._publish(3, "v=3-x") and not first._publish(3, "v=3-y")
    assert first.folder(3).endswith("v=3-x")


def test_prune_and_hashes_of_content(spark, tmp_path):
    store = inc.StateStore(spark, str(tmp_path / "state"), ["key"], "h")
    seen = []
    for text in ("x", "y", "y"):
        inc.run_incremental(spark.createDataFrame([("a", text), ("b", None)], "key string, text string"), store, lambda df: seen.append(sorted(r["key"] for r in df.collect())), ["text"])
    assert seen == [["a", "b"], ["a"], []]
    assert store.prune(1) == 2 and store.version() == 3
    assert store.read(spark.createDataFrame([], "key string, h string")).count() == 2


def test_runs_of_any_length(spark):
    runs = spark.createDataFrame([("r", 0, 2_000_000_000, "ok"), ("r", 2_000_000_100, 2_000_000_100, "ok"), ("s", 50, 20_000, "ok"), ("s", 30_000, 29_000, "ok")], "repo string, started_at long, finished_at long, run_status string")
    index = spark.createDataFrame([("r", "a", "h", 1_999_999_999, False), ("r", "b", "h", 2_000_000_100, False), ("r", "c", "h", 2_000_000_050, False), ("s", "d", "h", 20_000, False), ("s", "e", "h", 20_001, False), ("s", "f", "h", 49, None), ("s", "g", "h", 50, None)], "repo string, file_path string, file_hash string, last_indexed long, needs_reindex boolean")
    assert {r["file_path"] for r in inc.valid_index_rows(index, runs).collect()} == {"a", "b", "d", "g"}
