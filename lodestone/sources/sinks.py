"""How results leave: JSON, CSV and plain text, as columns or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import csv_field

JSON_KEYS = ["rank", "score", "name", "unit_type", "language", "file_path", "line_start", "line_end", "signature", "docstring", "snippet"]
REPO_KEYS = ["rank", "repo", "score", "name", "unit_type", "language", "file_path", "line_start"]
CSV_COLUMNS = ["rank", "score", "name", "unit_type", "language", "file_path", "line_start"]


def to_json_rows(results: DataFrame) -> DataFrame:
    """(rank, json): one object per result with the keys of its kind of search."""
    keys = REPO_KEYS if "repo" in results.columns else JSON_KEYS
    return results.select("rank", F.to_json(F.struct(*[F.col(k) for k in keys if k in results.columns]), {"ignoreNullFields": "false"}).alias("json"))


def to_csv_rows(results: DataFrame) -> DataFrame:
    """(rank, csv): one line per result, scores with four decimals."""
    columns = (["repo"] if "repo" in results.columns else []) + CSV_COLUMNS
    fields = [F.format_string("%.4f", F.col(c)) if c == "score" else csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return results.select("rank", F.concat_ws(",", *fields).alias("csv"))


def csv_header(results: DataFrame) -> str:
    return ",".join((["repo"] if "repo" in results.columns else []) + CSV_COLUMNS)


def plain_line(results: DataFrame, colour: bool = False) -> Column:
    """``[repo] path:line  name  type · language``."""
    paint = (lambda code, c: F.concat(F.lit(f"\x1b[{code}m"), c, F.lit("\x1b[0m"))) if colour else (lambda code, c: c)
    repo = F.concat(paint("2", F.concat(F.lit("["), F.col("repo"), F.lit("]"))), F.lit(" ")) if "repo" in results.columns else F.lit("")
    place = F.concat(paint("36", F.col("file_path")), paint("2", F.concat(F.lit(":"), F.col("line_start").cast("string"))))
    return F.concat(repo, place, F.lit("  "), paint("1;33", F.col("name")), F.lit("  "), paint("32", F.col("unit_type")), paint("2", F.concat(F.lit(" · "), F.col("language"))))


def to_plain_rows(results: DataFrame, colour: bool = False) -> DataFrame:
    second = F.concat(F.lit("\n  "), F.trim(F.element_at(F.split(F.col("snippet"), "\n"), 1))) if "snippet" in results.columns else F.lit("")
    return results.select("rank", F.concat(plain_line(results, colour), F.coalesce(second, F.lit(""))).alias("text"))


def report_rows(unused: DataFrame) -> DataFrame:
    """(file_path, text): unused units of each file. The report's unit is a file, so the lists are bounded by it."""
    line = F.concat(F.lit("  "), F.col("line_start").cast("string"), F.lit("  "), F.col("name"), F.lit("  "), F.col("unit_type"))
    return unused.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def write_results(results: DataFrame, path: str, kind: str) -> None:
    """Results as files of JSON, CSV or text lines; a search has few, so they go to one file."""
    if kind == "json":
        to_json_rows(results).orderBy("rank").coalesce(1).select("json").write.mode("overwrite").text(path)
    elif kind == "csv":
        columns = (["repo"] if "repo" in results.columns else []) + CSV_COLUMNS
        results.orderBy("rank").coalesce(1).select(*[F.format_string("%.4f", F.col(c)).alias(c) if c == "score" else F.col(c) for c in columns]).write.mode("overwrite").csv(path, header=True)
    elif kind == "plain":
        to_plain_rows(results).orderBy("rank").coalesce(1).select("text").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"plain, json or csv, not {kind!r}")
