"""Search over several repositories as one, and units similar to a given one.

All repositories are one table with a ``repo`` column; every window is partitioned by it, so
repositories run side by side. Fused scores derive from ranks and tie across repositories;
ties go by the order of the registry, then by the rank within the repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import fusion, graph, lexical, vectors

LEAST_QUOTA = 5


def quota(limit: int) -> int:
    return max(limit, LEAST_QUOTA)


def first_of_copies(rows: DataFrame, name: str = "name", body: str | None = None) -> DataFrame:
    """The best-placed row of each fingerprint (name and, where there is one, the begin of the body); wants ``place``."""
    text = F.col(body) if body else F.lit("")
    marked = rows.withColumn("fingerprint", F.sha2(tx.body_fingerprint(F.col(name), text), 256))
    return marked.withColumn("copy", F.row_number().over(Window.partitionBy("fingerprint").orderBy("place"))).where("copy = 1").drop("fingerprint", "copy")


def search_repos(units: DataFrame, postings: DataFrame, stats: DataFrame, repos: DataFrame, query: str, limit: int = 10, only: lexical.SearchFilter | None = None) -> DataFrame:
    """(rank, repo, score, name, ...): best rows of each repo, fused within it, merged, without copies by name.

    ``repos`` has (name, ordinal); repositories without units are skipped. Lexical only.
    """
    only = only or lexical.SearchFilter()
    parsed = lexical.parse_query(query)
    found = lexical.scores(postings, stats, parsed)
    shown = units.select("id", "name", "unit_type", "language", "file_path", "line_start", "line_end")
    placed = found.join(units.select("id", "repo"), "id").join(repos.select(F.col("name").alias("repo"), "ordinal"), "repo")
    within = Window.partitionBy("repo").orderBy(*lexical.by_score())
    fetch = quota(limit) * (1 if only.is_empty() else lexical.OVER_FETCH)
    # only the few best of each repository are joined with what is shown of them
    best = placed.withColumn("at", F.row_number().over(within)).where(F.col("at") <= fetch).join(shown, "id")
    if not only.is_empty():
        best = best.where(only.column()).withColumn("at", F.row_number().over(within)).where(F.col("at") <= quota(limit))
    fused = fusion.fuse(best.drop("at"), query, by=["repo"])
    in_repo = Window.partitionBy("repo").orderBy(F.round("score", 9).desc(), "lexical_rank")
    placed = fused.withColumn("in_repo_rank", F.row_number().over(in_repo))
    merged = placed.withColumn("place", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "ordinal", "in_repo_rank")))
    kept = first_of_copies(merged).orderBy("place").limit(limit)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy("place"))).drop("place", "ordinal", "in_repo_rank")


def find_similar(units: DataFrame, records: DataFrame, repo: str, file_path: str, line: int, limit: int = 10) -> DataFrame:
    """(repo, id, similarity, name, file_path): units like the one at a place, over all repositories, without itself and copies."""
    own = graph.unit_at_line(units.where(F.col("repo") == repo), file_path, line).select(F.col("id").alias("unit_id"), "name", "file_path").first()
    query = vectors.vector_of(records, own["unit_id"]).first() if own else None
    near = vectors.similarities(records, query["vector"] if query else [0.0])
    near = near.withColumns({"own_name": F.lit(own["name"] if own else None).cast("string"), "own_path": F.lit(own["file_path"] if own else None).cast("string")})
    placed = near.join(units.select("repo", "id", "name", "file_path"), "id")
    by_repo = Window.partitionBy("repo").orderBy(F.round("similarity", 9).desc(), "id")
    best = placed.withColumn("at", F.row_number().over(by_repo)).where(F.col("at") <= quota(limit)).join(units.select("id", "body"), "id")
    others = best.where(~((F.col("name") == F.col("own_name")) & (F.col("file_path") == F.col("own_path"))))
    placed = others.withColumn("place", F.row_number().over(Window.orderBy(F.round("similarity", 9).desc(), "repo", "id")))
    kept = first_of_copies(placed, body="body").orderBy("place").limit(limit)
    return kept.select("repo", "id", F.round("similarity", 6).alias("similarity"), "name", "file_path")


def with_bodies(results: DataFrame, units: DataFrame) -> DataFrame:
    """Results (few, by their limit) with the body of each unit; null where the unit is gone."""
    if "body" in results.columns:
        return results
    bodies = units.select("id", "body").join(F.broadcast(results.select("id").distinct()), "id")
    return results.join(bodies, "id", "left")


def cached_vectors(units: DataFrame, files: DataFrame, records: DataFrame, hashes: DataFrame) -> DataFrame:
    """(file_hash, unit_id): vectors that exist for contents with the wanted hashes in any repository."""
    has = units.join(files.select("repo", "file_path", "file_hash"), ["repo", "file_path"]).join(hashes.select("file_hash").distinct(), "file_hash")
    return has.join(records.select(F.col("unit_id").alias("id")).distinct(), "id", "left_semi").groupBy("file_hash").agg(F.min("id").alias("unit_id"))


def repo_rollup(units: DataFrame) -> DataFrame:
    """(repo, n_files, n_units, n_functions, languages)."""
    return units.groupBy("repo").agg(
        F.countDistinct("file_path").alias("n_files"),
        F.count("*").alias("n_units"),
        F.count_if(F.col("unit_type").isin("function", "method")).alias("n_functions"),
        F.array_sort(F.collect_set("language")).alias("languages"),
    )
