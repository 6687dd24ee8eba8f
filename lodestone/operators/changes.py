"""Changes between listings, files and units, and how tables follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.stats import one_row

CLASSES = ["new", "changed", "same", "deleted"]


def classify(listing: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, file_path, file_hash, change) with change new, changed, same or deleted.

    Both sides have (repo, file_path, file_hash); null hashes never equal.
    """
    now = listing.select("repo", "file_path", F.col("file_hash").alias("new_hash"), F.lit(True).alias("now"))
    was = files.select("repo", "file_path", F.col("file_hash").alias("old_hash"), F.lit(True).alias("was"))
    both = now.join(was, ["repo", "file_path"], "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("new_hash") == F.col("old_hash"), "same").otherwise("changed")
    return both.select("repo", "file_path", F.coalesce("new_hash", "old_hash").alias("file_hash"), change.alias("change"))


def run_counters(classified: DataFrame, new_units: DataFrame) -> DataFrame:
    """(indexed, skipped, removed, new_units) of one run."""
    counts = classified.agg(*[F.count_if(F.col("change").isin(*c)).alias(n) for n, c in (("indexed", ["new", "changed"]), ("skipped", ["same"]), ("removed", ["deleted"]))])
    return one_row(counts, new_units.agg(F.count("*").alias("new_units")))


def replace_files(table: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``table`` without those of the files in ``gone``, plus ``new``. Edges and vectors follow their units."""
    return table.join(gone.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti").unionByName(new.select(*table.columns))


def upsert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    return replace_files(files, new, new)


def missing_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of the index that the listing lacks."""
    return files.join(listing.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti")


def unit_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, file_path, name, change): units added, removed or modified between two states, matched by file, name and line."""
    keys = ["repo", "file_path", "name", "line_start"]
    a = old.select(*keys, F.sha2("body", 256).alias("old_body")).dropDuplicates(keys)
    b = new.select(*keys, F.sha2("body", 256).alias("new_body")).dropDuplicates(keys)
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("old_body").isNull(), "added").when(F.col("new_body").isNull(), "removed").when(F.col("old_body") != F.col("new_body"), "modified")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")


def hash_sums(table: DataFrame) -> DataFrame:
    """(n_rows, sum_a, sum_b): sums of two hashes of each row, as text. They add up over parts of a table, in any order."""
    names = [F.col(c) for c in table.columns]
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")  # noqa: E731  no sum overflows
    return table.agg(F.count("*").alias("n_rows"), total(F.xxhash64(*names)).alias("sum_a"), total(F.xxhash64(F.lit(1), *names)).alias("sum_b"))


def table_checksum(table: DataFrame) -> DataFrame:
    """(n_rows, checksum): content hash that no order of rows changes."""
    return hash_sums(table).select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), "sum_a", "sum_b"), 256).alias("checksum"))


def row_digest(table: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, digest): the same for comparison between engines: the sum of the first 15 hex digits of each row's MD5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return table.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
