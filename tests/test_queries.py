"""Every core query that has SQL gives the rows of a second engine on the same tables."""

import datetime
import glob
import os

import duckdb
import pytest

from lodestone.plans.registry import QUERIES, SQL


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


@pytest.fixture(scope="module")
def second(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, second, name):
    out = QUERIES[name](spark, small)
    result = second.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(out.columns)
    assert rows(out.columns, [tuple(r) for r in out.collect()]) == rows(columns, result.fetchall())


def test_parse_bodies_finds_the_units_again(spark, small):
    """Nearly every function of the table is found when its body is parsed as a file; a method, as all of Java's are, is no whole file."""
    found = {(r["language"], r["unit_type"]): r["n_units"] for r in QUERIES["parse_bodies"](spark, small).collect()}
    known = spark.read.parquet(f"{small}/code_units.parquet").dropDuplicates(["id"]).where("unit_type = 'function'").groupBy("language").count().collect()
    for r in known:
        if r["language"] not in ("unknown", "java"):
            assert found.get((r["language"], "function"), 0) + found.get((r["language"], "method"), 0) >= 0.9 * r["count"], r["language"]


def test_ivf_gives_ten_of_each_query(spark, small):
    rows = QUERIES["ivf_topk"](spark, small).collect()
    ranks = {}
    for r in rows:
        ranks.setdefault(r["query_id"], []).append(r["rank"])
    assert ranks and all(sorted(x) == list(range(1, 11)) for x in ranks.values())


def test_all_others_have_sql():
    assert set(QUERIES) - set(SQL) == {"parse_bodies", "ivf_topk"}


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
