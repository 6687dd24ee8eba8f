"""Reciprocal rank fusion of lexical, name and vector ranks.

``results`` holds (id, score, name, ...) of one search, few rows by its limit. Ranks count
from 0; equal name scores keep the lexical order, so ranks are row numbers, never shared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.names import name_match_score
from lodestone.operators import lexical, vectors
from lodestone.session import ship

LEXICAL_K, NAME_K, VECTOR_K, POPULARITY_K, SCALE = 60, 5, 60, 60, 1000.0


def with_ranks(results: DataFrame, query: str, by: list[str] | None = None) -> DataFrame:
    """Adds lexical_rank, name_score and name_rank, within each group of ``by`` columns."""
    ship(results.sparkSession)
    group = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(0))
    first = results.withColumn("lexical_rank", F.row_number().over(group.orderBy(*lexical.by_score())) - 1)
    named = first.withColumn("name_score", name_match_score(F.lit(query), F.col("name")))
    return named.withColumn("name_rank", F.row_number().over(group.orderBy(F.round("name_score", 9).desc(), "lexical_rank")) - 1)


def term(rank: Column, k: int) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + rank.cast("double") + 1)


def fuse(results: DataFrame, query: str, by: list[str] | None = None) -> DataFrame:
    """The same rows with ``score`` fused from lexical and name rank."""
    rows = with_ranks(results, query, by)
    return rows.withColumn("score", SCALE * (term(F.col("lexical_rank"), LEXICAL_K) + term(F.col("name_rank"), NAME_K)))


def fuse_hybrid(results: DataFrame, query: str, vector_hits: DataFrame) -> DataFrame:
    """Fused from three ranks. Vectors add no rows: a row without vector rank gets the number of rows as its rank."""
    rows = with_ranks(results, query)
    hits = vector_hits.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.round("similarity", 9).desc(), "id")) - 1).select("id", "vector_rank")
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    joined = rows.withColumn("n_rows", n).join(F.broadcast(hits), "id", "left").withColumn("vector_rank", F.coalesce("vector_rank", "n_rows")).drop("n_rows")
    return joined.withColumn("score", SCALE * (term(F.col("lexical_rank"), LEXICAL_K) + term(F.col("name_rank"), NAME_K) + term(F.col("vector_rank"), VECTOR_K)))


def weighted(results: DataFrame, now: int, lexical_weight: float = 0.3, name_weight: float = 0.2, vector_weight: float = 0.5) -> DataFrame:
    """Variant with weights, a bonus for fresh files and a penalty for complex units; wants last_indexed and complexity."""
    age_days = (F.lit(now) - F.col("last_indexed")) / 86400.0
    bonus = F.when(age_days <= 30, 0.1).otherwise(0.0)
    penalty = F.when(F.col("complexity") > 10, 0.05).otherwise(0.0)
    base = lexical_weight * term(F.col("lexical_rank"), LEXICAL_K) + name_weight * term(F.col("name_rank"), NAME_K) + vector_weight * term(F.coalesce("vector_rank", F.lit(1_000_000)), VECTOR_K)
    return results.withColumn("score", SCALE * base * (1 + bonus - penalty))


def fuse_popular(results: DataFrame, query: str) -> DataFrame:
    """Fused from lexical, name and call-graph ranks; wants popularity_rank."""
    rows = with_ranks(results, query)
    return rows.withColumn("score", SCALE * (term(F.col("lexical_rank"), LEXICAL_K) + term(F.col("name_rank"), NAME_K) + term(F.col("popularity_rank"), POPULARITY_K)))


def ordered(results: DataFrame) -> DataFrame:
    """By fused score, then lexical rank, with a rank from 1."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "lexical_rank")))


def hybrid(units: DataFrame, postings: DataFrame, stats: DataFrame, query: str, limit: int = 10, only: lexical.SearchFilter | None = None, records: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
    """Lexical search fused with names, and with vectors where there are records and an embedding function."""
    found = lexical.filtered_search(units, postings, stats, query, limit, only).drop("rank")
    if records is not None and embed is not None:
        try:
            near = vectors.nearest_to(records, [float(x) for x in embed(query)], limit)
        except Exception:  # vectors only refine; a failing model leaves the lexical result
            near = None
        if near is not None:
            return ordered(fuse_hybrid(found, query, near))
    return ordered(fuse(found, query))


def semantic_only(units: DataFrame, records: DataFrame, query_vector: list[float], limit: int = 10, only: lexical.SearchFilter | None = None) -> DataFrame:
    """The ``limit`` nearest units, then filtered, so fewer may be left. Ids without a unit drop out."""
    near = vectors.nearest_to(records, query_vector, limit)
    rows = units.join(F.broadcast(near), "id")
    if only is not None:
        if only.language is not None:
            rows = rows.where(F.col("language") == only.language)
        if only.path:
            rows = rows.where(F.col("file_path").contains(only.path))
        if only.exclude_tests:
            rows = rows.where(~tx.is_test_file_semantic(F.col("file_path")))
    shown = rows.select("id", F.col("similarity").alias("score"), "name", "unit_type", "language", "file_path", "line_start", "line_end", F.coalesce("full_signature", F.lit("")).alias("snippet"))
    return lexical.ranked(shown)
