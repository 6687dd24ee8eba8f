"""Statistics of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import integer_percent


def by_type(units: DataFrame) -> DataFrame:
    return units.groupBy("unit_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit_type")


def by_language(units: DataFrame) -> DataFrame:
    """(language, n, percent), percent truncated."""
    counts = units.groupBy("language").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", integer_percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0))))).orderBy(F.desc("n"), "language")


def one_row(*parts: DataFrame) -> DataFrame:
    """Single rows with different columns as one row, without a join."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def summary(units: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row of totals. Each table is scanned once."""
    u = units.agg(
        F.count("*").alias("n_units"),
        F.count_if(F.coalesce("docstring", F.lit("")) != "").alias("n_documented"),
        F.count_if("has_embedding").alias("n_embedded"),
        F.min("embedding_model").alias("embedding_model"),
    )
    f = files.agg(F.countDistinct("repo", "file_path").alias("n_files"), F.max("last_indexed").alias("last_indexed"))
    e = edges.agg(F.count("*").alias("n_edges"))
    joined = one_row(u, f, e)
    return joined.withColumn("coverage", integer_percent(F.col("n_embedded"), F.col("n_units")))


def metadata_totals(units: DataFrame, files: DataFrame) -> DataFrame:
    return one_row(units.agg(F.count("*").alias("num_units")), files.agg(F.countDistinct("repo", "file_path").alias("num_files")))
