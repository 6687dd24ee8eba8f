"""The call graph: edges by name, who calls whom, what nothing calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS = 10


def edges_of(units: DataFrame) -> DataFrame:
    """(caller_id, callee_name, line_number) from the calls of units; the line is the caller's first."""
    return units.select(F.col("id").alias("caller_id"), F.explode("calls").alias("callee_name"), F.col("line_start").alias("line_number")).where("callee_name IS NOT NULL")


def callers_of(units: DataFrame, edges: DataFrame, name: str, limit: int = NEIGHBOURS) -> DataFrame:
    """Units that call ``name``, by id. The name reaches the scan of the edges as a filter."""
    ids = edges.where(F.col("callee_name") == name).select(F.col("caller_id").alias("id")).distinct()
    return units.join(ids, "id").select("id", "name", "file_path", "line_start").orderBy("id").limit(limit)


def callees_of(units: DataFrame, edges: DataFrame, unit_id: int, limit: int = NEIGHBOURS) -> DataFrame:
    """Units whose name the unit calls, by id; names without a unit drop out, homonyms all count."""
    names = edges.where(F.col("caller_id") == unit_id).select(F.col("callee_name").alias("name")).distinct()
    return units.join(names, "name").select("id", "name", "file_path", "line_start").orderBy("id").limit(limit)


def context(units: DataFrame, edges: DataFrame, results: DataFrame, limit: int = NEIGHBOURS) -> DataFrame:
    """(id, callers, callees): up to ``limit`` names each, of all results at once."""
    people = units.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    wanted = results.select("id", "name").distinct()
    by_name = Window.partitionBy("id").orderBy("other_id")
    calling = wanted.join(edges, F.col("name") == F.col("callee_name")).select("id", F.col("caller_id").alias("other_id")).distinct().join(people, "other_id")
    called = wanted.join(edges, F.col("id") == F.col("caller_id")).select("id", F.col("callee_name").alias("other_name")).distinct().join(people, "other_name")

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        few = rows.withColumn("at", F.row_number().over(by_name)).where(F.col("at") <= limit)
        return few.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "other_name"))), lambda x: x["other_name"]).alias(name))

    empty = F.array().cast("array<string>")
    return wanted.select("id").join(gathered(calling, "callers"), "id", "left").join(gathered(called, "callees"), "id", "left").select("id", F.coalesce("callers", empty).alias("callers"), F.coalesce("callees", empty).alias("callees"))


def unused_functions(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods that no edge names. One name with very many edges weighs nothing: edges are reduced to names first."""
    names = edges.select(F.col("callee_name").alias("name")).where("name IS NOT NULL").distinct()
    return units.where(F.col("unit_type").isin("function", "method")).join(names, "name", "left_anti").select("id", "name", "unit_type", "file_path", "line_start").orderBy("file_path", "line_start", "id")


def unit_at_lines(units: DataFrame, places: DataFrame) -> DataFrame:
    """(file_path, line, id, name): the smallest unit around each place (repo, file_path, line)."""
    keys = [c for c in ("repo", "file_path") if c in places.columns]
    rows = units.select(*keys, "id", "name", "line_start", "line_end").join(places, keys).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    smallest = rows.groupBy(*keys, "line").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "id", "name")).alias("u"))
    return smallest.select(*keys, "line", "u.id", "u.name")


def unit_at_line(units: DataFrame, file_path: str, line: int) -> DataFrame:
    inside = units.where((F.col("file_path") == file_path) & F.lit(line).between(F.col("line_start"), F.col("line_end")))
    return inside.orderBy(F.col("line_end") - F.col("line_start"), "id").limit(1)


def live_edges(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose caller still exists."""
    return edges.join(units.select(F.col("id").alias("caller_id")).distinct(), "caller_id", "left_semi").select(*edges.columns)


def orphan_edges(units: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(units.select(F.col("id").alias("caller_id")).distinct(), "caller_id", "left_anti").select(*edges.columns)


def popularity(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, n_callers): in-degree by name. Counted map-side before the join."""
    degree = edges.where("callee_name IS NOT NULL").select("caller_id", "callee_name").distinct().groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("n_callers"))
    return units.select("id", "name").join(degree, "name", "left").select("id", "name", F.coalesce("n_callers", F.lit(0)).alias("n_callers"))


def popularity_ranks(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Results (few, by their limit) with ``popularity_rank`` from 0: most callers first, then by id."""
    counted = popularity(results, edges).select("id", "n_callers")
    return results.join(counted, "id").withColumn("popularity_rank", F.row_number().over(Window.orderBy(F.desc("n_callers"), "id")) - 1)
