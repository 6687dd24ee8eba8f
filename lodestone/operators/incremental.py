"""Processing only new or changed records.

Key and content-hash state is kept in versioned Parquet folders. A run hashes the current
rows, joins them with the state, processes what is new or changed and then swaps the state
version: a pointer file named after it is made whole and only if there is none yet. A run that
breaks off leaves no pointer, so nothing is skipped; a committed run is never repeated; of two
runs from one version the first to make the pointer wins and the other one fails.

Edge cases: null keys are keys of their own (null-safe join); a null hash never equals
another hash, so such a current row is selected until it has one; empty tables give
empty results; repeated rows collapse to the latest one per key. ``run_incremental`` expects
one row per key; of several with different hashes the largest hash is kept as state.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut, drop

RUN_BUCKET_SECONDS = 3600


def plain_path(path: Column) -> Column:
    """Forward slashes, none doubled, no leading ``./``."""
    unified = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/")
    return F.regexp_replace(unified, r"^(\./)+", "")


def plain_hash(value: Column) -> Column:
    """Lower case, without an algorithm name in front. Blank becomes null."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z0-9_-]+[:=]", "")
    return F.when(bare != "", bare)


def row_hash(columns: Sequence[Column]) -> Column:
    """Content hash of a row; nulls and empty strings differ, order of columns counts."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def latest_observations(scans: DataFrame) -> DataFrame:
    """(repo, file_path, file_hash) of files whose latest observation says ``seen``.

    Latest is by observed_at, then scan_id; ``seen`` without a hash is no observation.
    """
    rows = scans.select(
        "repo",
        plain_path(F.col("file_path")).alias("file_path"),
        "event_kind",
        plain_hash(F.col("file_hash")).alias("file_hash"),
        F.struct("observed_at", "scan_id").alias("at"),
    ).where((F.col("event_kind") == "gone") | ((F.col("event_kind") == "seen") & F.col("file_hash").isNotNull()))
    last = rows.groupBy("repo", "file_path").agg(F.max(F.struct("at", "event_kind", "file_hash")).alias("last"))
    return last.where(F.col("last.event_kind") == "seen").select("repo", "file_path", F.col("last.file_hash").alias("file_hash"))


def valid_index_rows(index: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest row per file among those written within an ``ok`` run of their repo.

    The containment join goes over (repo, level, bucket of time): each run stands in the two or
    three buckets of its level, whose width is its length rounded up to a power of two hours, so
    a repo with many runs or files spreads over many keys and a run of any length over few.
    """
    hour = lambda c: F.floor(c / F.lit(RUN_BUCKET_SECONDS)).cast("bigint")
    runs = (
        runs.where((F.col("run_status") == "ok") & (F.col("started_at") <= F.col("finished_at")))
        .select(F.col("repo").alias("run_repo"), "started_at", "finished_at", F.greatest(F.lit(0), F.ceil(F.log2((F.col("finished_at") - F.col("started_at")) / F.lit(float(RUN_BUCKET_SECONDS))))).cast("int").alias("level"))
        .fillna(0, ["level"])
        .distinct()
        .withColumns({"first": hour(F.col("started_at")), "last": hour(F.col("finished_at"))})
    )
    levels = sorted(r["level"] for r in runs.select("level").distinct().collect())  # at most 64
    ok = runs.withColumn("bucket", F.explode(F.expr("sequence(shiftright(first, level), shiftright(last, level))"))).select("run_repo", "started_at", "finished_at", F.col("level").alias("run_level"), F.col("bucket").alias("run_bucket"))
    rows = index.select(
        "repo",
        plain_path(F.col("file_path")).alias("file_path"),
        plain_hash(F.col("file_hash")).alias("file_hash"),
        "last_indexed",
        F.coalesce("needs_reindex", F.lit(False)).alias("needs_reindex"),
        F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("level"),
    ).withColumn("hour", hour(F.col("last_indexed")))
    valid = rows.join(
        ok,
        (F.col("repo") == F.col("run_repo")) & (F.col("level") == F.col("run_level")) & (F.expr("shiftright(hour, level)") == F.col("run_bucket")) & F.col("last_indexed").between(F.col("started_at"), F.col("finished_at")),
        "left_semi",
    )
    last = valid.groupBy("repo", "file_path").agg(F.max(F.struct("last_indexed", "needs_reindex", "file_hash")).alias("last"))
    return last.select("repo", "file_path", F.col("last.file_hash").alias("file_hash"), F.col("last.needs_reindex").alias("needs_reindex"))


def select_changed(current: DataFrame, state: DataFrame, keys: Sequence[str], value: str = "file_hash", force: str | None = None) -> DataFrame:
    """Rows of ``current`` without an equal row in ``state``, with a ``change`` of new or changed.

    ``force`` names a boolean state column that marks rows to process regardless.
    """
    known = state.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__value"), (F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False)).alias("__force"), F.lit(True).alias("__there"))
    on = None
    for i, k in enumerate(keys):
        same = current[k].eqNullSafe(known[f"__k{i}"])
        on = same if on is None else on & same
    joined = current.join(known, on, "left")
    differs = F.col("__there").isNull() | F.col("__force") | ~F.coalesce(F.col(value) == F.col("__value"), F.lit(False))
    return joined.where(differs).withColumn("change", F.when(F.col("__there").isNull(), "new").otherwise("changed")).select(*current.columns, "change")


def removed(current: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys in the state that no current row has."""
    now = current.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    on = None
    for i, k in enumerate(keys):
        same = state[k].eqNullSafe(now[f"__k{i}"])
        on = same if on is None else on & same
    return state.join(now, on, "left_anti").select(*keys)


def files_to_process(scans: DataFrame, index: DataFrame, runs: DataFrame) -> DataFrame:
    """(repo, file_path, file_hash, change) of the files the next run has to process."""
    return select_changed(latest_observations(scans), valid_index_rows(index, runs), ["repo", "file_path"], force="needs_reindex")


class StateStore:
    """Versioned key/hash state under a folder of any Hadoop file system with atomic renames, or of a mounted one.

    ``<root>/v=<n>-<id>`` holds a draft or a version, ``<root>/live/<n>`` names the folder of
    version n. The highest pointer is the live one. Pointers are tiny and stay; folders that
    no run reads any more go with ``prune``.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], value: str = "file_hash") -> None:
        self.spark, self.root, self.keys, self.value = spark, root.rstrip("/"), list(keys), value
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/live"))

    def _pointers(self) -> dict[int, str]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/live"))]
        return {int(n): f"{self.root}/live/{n}" for n in names if n.isdigit()}

    def version(self) -> int:
        return max(self._pointers(), default=0)

    def folder(self, version: int) -> str:
        stream = self._fs.open(self._path(self._pointers()[version]))
        try:
            return f"{self.root}/" + self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def read(self, like: DataFrame, version: int | None = None) -> DataFrame:
        columns = [*self.keys, self.value]
        now = self.version() if version is None else version
        if not now:
            return like.select(*columns).limit(0)
        return self.spark.read.schema(like.select(*columns).schema).parquet(self.folder(now)).select(*columns)

    def _publish(self, version: int, folder: str) -> bool:
        """Makes the pointer of a version whole; False if there is one."""
        draft, pointer = (self._path(f"{self.root}/live/{name}") for name in (f".{folder}", f"{version:012d}"))
        out = self._fs.create(draft, True)
        out.write(bytearray(folder, "ascii"))
        out.close()
        qualified = self._fs.makeQualified(pointer).toUri()
        try:
            if qualified.getScheme() == "file":
                os.link(self._fs.makeQualified(draft).toUri().getPath(), qualified.getPath())
                return True
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            nothing = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(draft, pointer, nothing)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError:
            if self._fs.exists(pointer):
                return False
            raise
        finally:
            self._fs.delete(draft, False)

    def commit(self, state: DataFrame, base: int) -> int:
        """Write ``state`` as the version after ``base`` and make it live; fails if another run came first."""
        new = base + 1
        folder = f"v={new}-{uuid.uuid4().hex}"
        if self.version() == base:
            state.select(*self.keys, self.value).write.mode("errorifexists").parquet(f"{self.root}/{folder}")
            if self._publish(new, folder):
                return new
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        raise RuntimeError(f"state moved on from version {base} to {self.version()}")

    def prune(self, keep: int = 2) -> int:
        """Deletes the folders of all but the last ``keep`` versions. Drafts of running or broken-off runs are left. Returns their number."""
        old = sorted(self._pointers())[:-keep] if keep else []
        return sum(bool(self._fs.delete(self._path(self.folder(n)), True)) for n in old)


def run_incremental(current: DataFrame, store: StateStore, process: Callable[[DataFrame], None], content: Sequence[str] | None = None) -> int:
    """Process new and changed rows of ``current`` once, then commit its keys and hashes as the new state.

    With ``content`` the hash of a row is made from these columns and added under the store's name for it. ``current`` is read once and kept
    in the checkpoint folder: what changes or arrives in its source during a run is left to the next one. ``process`` gets the selected rows
    and must be idempotent for a rerun of the same version, for instance by overwriting an output named after it.
    """
    base = store.version()
    if content is not None:
        current = current.withColumn(store.value, row_hash([F.col(c) for c in content]))
    current = cut(current)
    process(select_changed(current, store.read(current, base), store.keys, store.value))
    version = store.commit(current.groupBy(*store.keys).agg(F.max(store.value).alias(store.value)), base)
    drop(current)
    return version
