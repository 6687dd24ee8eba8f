"""Working trees as a data source: ``spark.read.format("source_tree").load(root)``.

Folders are walked without following links; hidden ones, blocked ones and what ignore files
exclude is left out. Each folder near the root is a partition that executors walk and read on
their own, so neither listings nor contents pass through the driver. Spark's own file sources
are no help here: they drop names that begin with ``_`` or ``.``, as ``__init__.py``.
"""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions.text import content_hash, path_language
from lodestone.sources import heuristics

SCHEMA = "file_path string, length bigint, modified timestamp, content binary"


class IgnoreRules:
    """Patterns of one ignore file, below its folder."""

    def __init__(self, folder: str, text: str) -> None:
        self.folder = folder
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            pattern = line[1:] if negated else line
            pattern = pattern[1:] if pattern.startswith("\\") else pattern
            only_folder = pattern.endswith("/")
            pattern = pattern.rstrip("/")
            if pattern:
                anchored = "/" in pattern
                body = self._regex(pattern.lstrip("/"))
                self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z", re.S), negated, only_folder))

    @staticmethod
    def _regex(pattern: str) -> str:
        out, i = "", 0
        while i < len(pattern):
            if pattern.startswith("**/", i):
                out += "(?:.*/)?"
                i += 3
            elif pattern.startswith("/**", i) and i + 3 == len(pattern):
                out += "/.*"
                i += 3
            elif pattern.startswith("**", i):
                out += ".*"
                i += 2
            elif pattern[i] == "*":
                out += "[^/]*"
                i += 1
            elif pattern[i] == "?":
                out += "[^/]"
                i += 1
            elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
                inner = pattern[i + 1 : end]
                out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
                i = end + 1
            elif pattern[i] == "\\" and i + 1 < len(pattern):
                out += re.escape(pattern[i + 1])
                i += 2
            else:
                out += re.escape(pattern[i])
                i += 1
        return out

    def verdict(self, path: str, is_folder: bool) -> bool | None:
        """True for ignored, False for taken back in, None for not mentioned."""
        below = os.path.relpath(path, self.folder)
        out = None
        for pattern, negated, only_folder in self.rules:
            if (is_folder or not only_folder) and pattern.match(below):
                out = not negated
        return out


def users_ignore_file() -> str:
    """Git's ignore file of the user, which holds for all trees."""
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")


def rules_of(folder: str, root: str) -> list[IgnoreRules]:
    """Rules of the ignore files of a folder; at the root also those of the user and of the clone, which any other rule outdoes."""
    names = [os.path.join(folder, name) for name in heuristics.IGNORE_FILES]
    if folder == root:
        names = [users_ignore_file(), os.path.join(folder, ".git/info/exclude"), *names]
    out = []
    for name in names:
        try:
            with open(name, encoding="utf-8", errors="replace") as f:
                out.append(IgnoreRules(folder, f.read()))
        except OSError:
            continue
    return out


def is_ignored(path: str, is_folder: bool, rules: list[IgnoreRules]) -> bool:
    """The innermost ignore file that mentions a path decides."""
    for own in reversed(rules):
        if (said := own.verdict(path, is_folder)) is not None:
            return said
    return False


def entries(folder: str, root: str, rules: list[IgnoreRules]) -> tuple[list[str], list[str], list[IgnoreRules]]:
    """Folders and files to go on with, and the rules below this folder."""
    rules = [*rules, *rules_of(folder, root)]
    folders, files = [], []
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return [], [], rules
    for e in found:
        if e.name.startswith(".") or e.is_symlink():
            continue
        if e.is_dir(follow_symlinks=False):
            if not heuristics.is_blocked_folder(e.name) and not is_ignored(e.path, True, rules):
                folders.append(e.path)
        elif e.is_file(follow_symlinks=False) and not is_ignored(e.path, False, rules):
            files.append(e.path)
    return folders, files, rules


class Part(InputPartition):
    def __init__(self, folder: str, deep: bool) -> None:
        self.folder, self.deep = folder, deep


def chain(folder: str, root: str) -> list[IgnoreRules]:
    """Rules of all folders from the root down to above ``folder``."""
    rules: list[IgnoreRules] = []
    parts = os.path.relpath(folder, root).split(os.sep)
    at = root
    for p in parts if parts != ["."] else []:
        rules += rules_of(at, root)
        at = os.path.join(at, p)
    return rules


class TreeReader(DataSourceReader):
    FOLDERS = 256

    def __init__(self, root: str, with_content: bool) -> None:
        self.root, self.with_content = os.path.abspath(root), with_content

    def partitions(self) -> list[InputPartition]:
        # the driver looks into folders level by level until there are enough to share out
        out: list[InputPartition] = []
        level = [self.root]
        while level and len(level) < self.FOLDERS:
            below = []
            for folder in level:
                out.append(Part(folder, False))
                below += entries(folder, self.root, chain(folder, self.root))[0]
            level = below
        return out + [Part(f, True) for f in level]

    def read(self, partition: Part) -> Iterator[tuple]:
        stack = [(partition.folder, chain(partition.folder, self.root))]
        while stack:
            folder, above = stack.pop()
            folders, files, rules = entries(folder, self.root, above)
            for path in files:
                try:
                    stat = os.stat(path)
                    content = None
                    if self.with_content and 0 < stat.st_size <= heuristics.MAX_BYTES:
                        with open(path, "rb") as f:
                            content = f.read()
                except OSError:
                    continue
                yield os.path.relpath(path, self.root), stat.st_size, datetime.datetime.fromtimestamp(stat.st_mtime), content
            if partition.deep:
                stack += [(f, rules) for f in reversed(folders)]


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return TreeReader(self.options["path"], self.options.get("content", "true").lower() == "true")


def _as_sources(files: DataFrame, repo: str) -> DataFrame:
    valid = heuristics.source_files(files).withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).where("text IS NOT NULL")
    return valid.select(F.lit(repo).alias("repo"), "file_path", "text", content_hash(F.col("text")).alias("file_hash"), path_language(F.col("file_path")).alias("language"))


def read_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, file_path, text, file_hash, language) of the files of a working tree that are source."""
    spark.dataSource.register(SourceTree)
    return _as_sources(spark.read.format("source_tree").load(root), repo)


def read_paths(spark: SparkSession, root: str, repo: str, paths: list[str]) -> DataFrame:
    """The same for given paths below the root; those that are gone, hidden, ignored or no source are left out."""
    base = os.path.abspath(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for below in batch.column(0).to_pylist():
                path = os.path.join(base, below)
                folder, rules, hidden = base, [], False
                for part in below.split("/")[:-1]:
                    rules += rules_of(folder, base)
                    folder = os.path.join(folder, part)
                    hidden = hidden or part.startswith(".") or os.path.islink(folder) or is_ignored(folder, True, rules)
                rules += rules_of(folder, base)
                if hidden or os.path.basename(below).startswith(".") or os.path.islink(path) or not os.path.isfile(path) or is_ignored(path, False, rules):
                    continue
                size = os.path.getsize(path)
                with open(path, "rb") as f:
                    out.append((below, size, f.read(heuristics.MAX_BYTES + 1)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["file_path", "length", "content"])

    names = spark.createDataFrame([(p,) for p in sorted(set(paths))], "file_path string")
    return _as_sources(names.mapInArrow(run, "file_path string, length bigint, content binary"), repo)
