"""One index over one or more repositories: build, search, explore, keep fresh."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone import config
from lodestone.functions.text import embed_text, parse_file_line
from lodestone.model import DEAD, GONE, OWNER, TABLES
from lodestone.models import load_model
from lodestone.operators import changes, federated, fusion, graph, lexical, stats, vectors
from lodestone.session import ship
from lodestone.sources import parse, sinks, tree
from lodestone.streaming import events, watch


MOST_SEGMENTS = 16
MOST_PATHS = 1000
LOCK_WAIT_SECONDS = 60


class CodeIndex:
    """An index as segments below ``root``; one file, ``metadata.json``, says which are live and is replaced as a whole.

    A commit writes one segment ``root/seg=<n>-<id>`` with the rows of new and changed files and with
    the ids (``dead``) and paths (``gone``) that it takes out of older segments, so that its cost
    follows the changes, not the size of the index. Readers leave out what later segments took
    out. More than ``MOST_SEGMENTS`` segments are put together into one. The state before stays as the
    backup ``metadata.<n>.json``; segments of neither state are deleted.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        ship(spark)

    # --- state --------------------------------------------------------------------------------------------------

    @property
    def metadata_path(self) -> str:
        return f"{self.root}/metadata.json"

    def metadata(self) -> config.Metadata:
        """The live state; one of another layout has no segments, so that the next run builds it anew."""
        try:
            return config.Metadata.load(self.metadata_path)
        except (TypeError, ValueError):
            return config.Metadata()

    def exists(self) -> bool:
        return bool(self.metadata().segments)

    def _has(self, segment: str, name: str) -> bool:
        return os.path.exists(f"{self.root}/{segment}/{name}/_SUCCESS")

    def _parts(self, name: str, schema: str, segments: list[str]) -> DataFrame | None:
        """Rows of a table in the given segments, with the number ``seg`` of theirs."""
        rows = None
        for number, segment in enumerate(segments):
            if self._has(segment, name):
                # with its schema, as a table without rows may have no files
                part = self.spark.read.schema(schema).parquet(f"{self.root}/{segment}/{name}").withColumn("seg", F.lit(number))
                rows = part if rows is None else rows.unionByName(part)
        return rows

    def table(self, name: str, segments: list[str] | None = None) -> DataFrame:
        """Live rows of a table."""
        segments = self.metadata().segments if segments is None else segments
        if not segments:
            raise FileNotFoundError(f"no index below {self.root}")
        rows = self._parts(name, TABLES[name], segments)
        if rows is None:
            return self.spark.createDataFrame([], TABLES[name])
        if name == "totals" or len(segments) == 1:
            return rows.drop("seg")
        if name == "files":
            dead, keys = self._parts("gone", GONE, segments), ["repo", "file_path"]
            out = dead.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max("seg").alias("__until"))
        else:
            dead, keys = self._parts("dead", DEAD, segments), [OWNER[name]]
            out = dead.groupBy(F.col("id").alias(f"__{keys[0]}")).agg(F.max("seg").alias("__until"))
        on = F.col("seg") < F.col("__until")
        for k in keys:
            on = on & (F.col(k) == F.col(f"__{k}"))
        return rows.join(out, on, "left_anti").drop("seg")

    @staticmethod
    def _checked(units: DataFrame) -> DataFrame:
        return units.select("repo", "id", "file_path", "name", "body", "line_start", "line_end")

    def _sums(self, units: DataFrame) -> tuple[int, int, int]:
        row = changes.hash_sums(self._checked(units)).first()
        return row["n_rows"], int(row["sum_a"]), int(row["sum_b"])

    def _commit(self, units: DataFrame, files: DataFrame, gone: DataFrame, dead: DataFrame, records: DataFrame | None = None, whole: bool = False) -> None:
        """Makes a segment of new rows live, without the units ``dead`` (rows of the live table) and the files ``gone``. ``whole`` starts anew."""
        meta = self.metadata()
        meta.migrate()
        segment = f"seg={meta.commit + 1}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/{segment}"
        units.sortWithinPartitions("file_path").write.partitionBy("repo").parquet(f"{at}/units")
        new = self.spark.read.schema(TABLES["units"]).parquet(f"{at}/units")
        files.write.parquet(f"{at}/files")
        graph.edges_of(new).write.parquet(f"{at}/edges")
        lexical.write_postings(lexical.build_postings(new), f"{at}/postings")
        lost = None if whole else dead
        if lost is not None:
            lost.select("id").write.parquet(f"{at}/dead")
        else:
            self.spark.createDataFrame([], DEAD).write.parquet(f"{at}/dead")
        gone.select("repo", "file_path").write.parquet(f"{at}/gone")
        totals = lexical.field_totals(new)
        if lost is not None:
            totals = totals.unionByName(lexical.field_totals(lost).select("field", (-F.col("n_units")).alias("n_units"), (-F.col("n_terms")).alias("n_terms")))
        totals.coalesce(1).write.parquet(f"{at}/totals")
        if records is not None:
            records.select("unit_id", "dim", "v_min", "v_max", "data").write.option("compression", "zstd").parquet(f"{at}/vectors")
        added, taken = self._sums(new), (0, 0, 0) if lost is None else self._sums(lost)
        before = (0, 0, 0) if whole else (meta.num_units, *meta.sums)
        meta.num_units, *meta.sums = (b + a - t for b, a, t in zip(before, added, taken))
        segments = [segment] if whole else [*meta.segments, segment]
        meta.num_files = self.table("files", segments).count()
        meta.checksum = self._checksum(meta.num_units, *meta.sums)
        now = int(time.time())
        meta.created_at, meta.last_updated = meta.created_at or now, now
        backup = f"{self.root}/metadata.{meta.commit}.json"
        if meta.commit:
            config.Metadata.load(self.metadata_path).save(backup)
        meta.commit, meta.segments = meta.commit + 1, segments
        meta.save(self.metadata_path)
        self._sweep()
        if len(segments) > MOST_SEGMENTS:
            self._merge()

    @staticmethod
    def _checksum(n: int, a: int, b: int) -> str:
        return hashlib.sha256(f"{n}|{a}|{b}".encode()).hexdigest()

    def _backup(self) -> config.Metadata | None:
        path = f"{self.root}/metadata.{self.metadata().commit - 1}.json"
        return config.Metadata.load(path) if os.path.exists(path) else None

    def _sweep(self) -> None:
        """Deletes what neither the live state nor the one before needs."""
        backup = self._backup()
        kept = set(self.metadata().segments) | set(backup.segments if backup else [])
        for name in os.listdir(self.root):
            if name.startswith("seg=") and name not in kept:
                shutil.rmtree(f"{self.root}/{name}", ignore_errors=True)
            elif name.startswith("metadata.") and name not in ("metadata.json", f"metadata.{self.metadata().commit - 1}.json"):
                os.unlink(f"{self.root}/{name}")

    def _merge(self) -> None:
        """Puts all segments together into one."""
        records = self.table("vectors")
        none = self.spark.createDataFrame([], GONE)
        self._commit(self.table("units"), self.table("files"), none, none, None if records.isEmpty() else records, whole=True)

    def validate(self, whole: bool = False) -> None:
        """A state that lacks a segment or, looked at as a ``whole``, doesn't match its checksum is put back to the one before, and an error raised."""
        meta = self.metadata()
        if not meta.segments:
            return
        sound = meta.checksum == self._checksum(meta.num_units, *meta.sums) and all(self._has(s, t) for s in meta.segments for t in ("units", "files", "edges", "postings", "totals", "dead", "gone"))
        if sound and whole:
            sound = meta.checksum == self._checksum(*self._sums(self.table("units")))
        if not sound:
            backup = self._backup()
            if backup:
                backup.save(self.metadata_path)
            raise RuntimeError("the index does not match its checksum" + ("; the state before it was restored" if backup else ""))

    # --- building -----------------------------------------------------------------------------------------------

    def index(self, path: str, repo: str | None = None, now: int | None = None) -> dict[str, int]:
        """Takes in a working tree: only new and changed files are parsed, files that are gone leave."""
        repo = repo or os.path.basename(os.path.abspath(path))
        with config.Lock(f"{self.root}/lock"):
            self.validate()
            return self._update(tree.read_tree(self.spark, path, repo), repo, now)

    def update_paths(self, path: str, repo: str, paths: Sequence[str], now: int | None = None) -> dict[str, int]:
        """Takes in given files only: new and changed ones are parsed, those that are gone leave."""
        with config.Lock(f"{self.root}/lock"):
            return self._update(tree.read_paths(self.spark, path, repo, list(paths)), repo, now, list(paths))

    def _of_files(self, rows: DataFrame, files: DataFrame) -> DataFrame:
        """Rows of some files. Few paths reach the scan as a filter, which prunes by the order of paths."""
        few = files.select("repo", "file_path").distinct().limit(MOST_PATHS + 1).collect()
        if len(few) <= MOST_PATHS:
            rows = rows.where(F.col("repo").isin(sorted({r["repo"] for r in few})) & F.col("file_path").isin(sorted({r["file_path"] for r in few})))
        return rows.join(files.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi")

    def _update(self, listing: DataFrame, repo: str, now: int | None, paths: list[str] | None = None, anew: bool = False) -> dict[str, int]:
        now = int(time.time()) if now is None else now
        listing = listing.cache()
        try:
            has = self.exists()
            files = self.table("files") if has else self.spark.createDataFrame([], TABLES["files"])
            own = files.where(F.col("repo") == repo)
            if paths is not None:
                own = own.where(F.col("file_path").isin(paths))
            known = own.where("false") if anew else own.where(~F.col("needs_reindex"))
            classed = changes.classify(listing, known).cache()
            counts = {r["change"]: r["count"] for r in classed.groupBy("change").count().collect()}
            fresh = classed.where(F.col("change").isin("new", "changed")).select("repo", "file_path")
            if has and not anew and not (counts.get("new") or counts.get("changed") or counts.get("deleted")):
                return {"indexed": 0, "skipped": counts.get("same", 0), "removed": 0, "new_units": 0}
            new_files = listing.join(fresh, ["repo", "file_path"], "left_semi")
            units = parse.parse_units(new_files)
            leaving = own.select("repo", "file_path") if anew else classed.where("change <> 'same'").select("repo", "file_path")
            state = new_files.select("repo", "file_path", "file_hash", F.lit(now).cast("bigint").alias("last_indexed"), F.lit(False).alias("needs_reindex"))
            before = self.metadata().num_units
            dead = self._of_files(self.table("units"), leaving).cache() if has else units.where("false")
            lost = dead.count() if has else 0
            self._commit(units, state, leaving, dead)
            new_units = self.metadata().num_units - before + lost
            return {"indexed": counts.get("new", 0) + counts.get("changed", 0), "skipped": counts.get("same", 0), "removed": counts.get("deleted", 0), "new_units": new_units}
        finally:
            listing.unpersist()

    def rebuild(self, path: str, repo: str | None = None) -> dict[str, int]:
        """Forgets what is known of the tree and takes it in again, in one commit."""
        repo = repo or os.path.basename(os.path.abspath(path))
        with config.Lock(f"{self.root}/lock"):
            return self._update(tree.read_tree(self.spark, path, repo), repo, None, anew=True)

    def cleanup(self, path: str, repo: str) -> dict[str, int]:
        """Drops files that are no longer in the tree, with their units."""
        with config.Lock(f"{self.root}/lock"):
            listing = tree.read_tree(self.spark, path, repo).select("repo", "file_path")
            files = self.table("files")
            gone = changes.missing_files(files.where(F.col("repo") == repo), listing).select("repo", "file_path").cache()
            dead = self._of_files(self.table("units"), gone).cache()
            n_files, n_units = gone.count(), dead.count()
            if n_files:
                self._commit(dead.where("false"), files.where("false"), gone, dead)
            return {"removed_files": n_files, "removed_units": n_units}

    def optimize(self) -> None:
        """Puts all segments together into one, without what is dead."""
        with config.Lock(f"{self.root}/lock"):
            self._merge()

    def pending(self) -> DataFrame:
        """Units without a vector, by id."""
        return self.table("units").where(~F.col("has_embedding")).orderBy("id")

    def embed_with(self, name: str) -> int:
        """Makes vectors for units without one by the model of a name."""
        model = load_model(name)
        return self.embed(model.embed_batch, model.name)

    def embed(self, model: Callable[[Sequence[str]], Sequence[Sequence[float]]], name: str, only: DataFrame | None = None) -> int:
        """Makes vectors for units without one, of all or of those with ids in ``only``, by a user's function over batches of texts. Returns their number."""
        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([[float(x) for x in v] for v in model(list(texts))])

        with config.Lock(f"{self.root}/lock"):
            pending = self.pending()
            if only is not None:
                pending = pending.join(only.select("id").distinct(), "id", "left_semi").select(*pending.columns)
            pending = pending.cache()
            n = pending.count()
            if n:
                new = vectors.to_records(pending.select(F.col("id").alias("unit_id"), run(embed_text(F.col("name"), F.col("body"))).alias("vector")))
                marked = pending.withColumn("embedding_model", F.lit(name)).withColumn("has_embedding", F.lit(True))
                none = self.spark.createDataFrame([], TABLES["files"])
                self._commit(marked, none, none, pending, new)
            return n

    # --- look-ups -----------------------------------------------------------------------------------------------

    def unit(self, unit_id: int) -> DataFrame:
        return self.table("units").where(F.col("id") == unit_id)

    def units_of_file(self, repo: str, file_path: str) -> DataFrame:
        return self.table("units").where((F.col("repo") == repo) & (F.col("file_path") == file_path)).orderBy("line_start", "id")

    def with_bodies(self, results: DataFrame) -> DataFrame:
        """Results with the bodies of their units; null for units that are gone."""
        return federated.with_bodies(results, self.table("units"))

    def field_stats(self) -> DataFrame:
        return lexical.stats_of_totals(self.table("totals"))

    # --- searching ----------------------------------------------------------------------------------------------

    def search(self, query: str, limit: int = 10, only: lexical.SearchFilter | None = None, embed: Callable[[str], list[float]] | None = None, semantic: bool = False, path: str | None = None, auto_index: bool = False) -> DataFrame:
        """Ranked results; with ``auto_index`` a missing index is built from ``path`` first."""
        if not self.exists() and auto_index and path:
            self.index(path)
        units = self.table("units")
        if semantic:
            if embed is None:
                raise ValueError("semantic search needs an embedding function")
            return fusion.semantic_only(units, self.table("vectors"), [float(x) for x in embed(query)], limit, only)
        records = self.table("vectors") if embed is not None else None
        rows = fusion.hybrid(units, self.table("postings"), self.field_stats(), query, limit, only, records, embed)
        if only is not None and only.modified_since is not None:
            rows = lexical.modified_since(rows, self.table("files"), only.modified_since)
        return rows

    def search_lazily(self, query: str, model: str, limit: int = 10, only: lexical.SearchFilter | None = None) -> DataFrame:
        """Ranked results with vectors that are made when they are first needed: those of the best units by words that have none yet are
        made by the model of a name and kept; then words, names and vectors are fused."""
        own = load_model(model)
        best = lexical.search(self.table("postings"), self.field_stats(), query, limit * lexical.OVER_FETCH)
        self.embed(own.embed_batch, own.name, best)
        return self.search(query, limit, only, embed=lambda text: own.embed_batch([text])[0])

    def search_repos(self, query: str, repos: DataFrame, limit: int = 10, only: lexical.SearchFilter | None = None) -> DataFrame:
        return federated.search_repos(self.table("units"), self.table("postings"), self.field_stats(), repos, query, limit, only)

    def find_similar(self, repo: str, place: str, limit: int = 10) -> DataFrame:
        path, line = parse_file_line(place)
        return federated.find_similar(self.table("units"), self.table("vectors"), repo, path, line, limit)

    def context(self, results: DataFrame) -> DataFrame:
        return graph.context(self.table("units"), self.table("edges"), results)

    def unused_functions(self) -> DataFrame:
        return graph.unused_functions(self.table("units"), self.table("edges"))

    def stats(self) -> DataFrame:
        return stats.summary(self.table("units"), self.table("edges"), self.table("files"))

    def sizes(self) -> dict[str, int]:
        """Bytes of each table of the live segments."""
        at = [f"{self.root}/{s}" for s in self.metadata().segments]
        return {t: sum(os.path.getsize(os.path.join(d, f)) for a in at for d, _, names in os.walk(f"{a}/{t}") for f in names) for t in TABLES if any(os.path.exists(f"{a}/{t}") for a in at)}

    def show(self, results: DataFrame, kind: str = "plain") -> list[str]:
        """Lines of a result for a terminal; a result is as small as its limit."""
        rows = {"plain": sinks.to_plain_rows, "json": sinks.to_json_rows, "csv": sinks.to_csv_rows}[kind](results)
        lines = [r[1] for r in rows.orderBy("rank").collect()]
        return [sinks.csv_header(results), *lines] if kind == "csv" else lines

    def watch(self, path: str, repo: str, checkpoint: str, seconds: int | None = watch.POLL_SECONDS, source: str = "auto") -> StreamingQuery:
        """A streaming query that follows the tree's changes.

        A batch that asks for a full scan, as the first one and any after a change of git's
        index, takes in the tree, as does one with more than MOST_PATHS paths; others take in their
        paths. A batch that meets a lock waits for it up to LOCK_WAIT_SECONDS; that and any other
        failure ends the query, whose checkpoint then still has the batch to be done.
        """
        self.spark.dataSource.register(events.TreeEvents)
        changes_ = self.spark.readStream.format("tree_events").option("source", source).load(path)

        def apply(batch: DataFrame, _: int) -> None:
            found = batch.select("check_all", F.when(~F.col("check_all"), F.col("file_path")).alias("file_path")).distinct().limit(MOST_PATHS + 1).collect()
            paths = sorted({r["file_path"] for r in found if r["file_path"] is not None})
            if not found:
                return
            end = time.time() + LOCK_WAIT_SECONDS
            while True:
                try:
                    if len(found) > MOST_PATHS or any(r["check_all"] for r in found):
                        self.index(path, repo)
                    else:
                        self.update_paths(path, repo, paths)
                    return
                except config.Locked:
                    if time.time() > end:
                        raise
                    time.sleep(0.5)

        writer = changes_.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
