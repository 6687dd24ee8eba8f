"""Queries of the core operators, by name, with their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import config
from lodestone.api import CodeIndex
from lodestone.functions import names, text, vectors as vx
from lodestone.operators import changes, federated, fusion, graph, incremental, ivf, lexical, stats, vector_copies, vectors
from lodestone.plans import fixture
from lodestone.plans.sql import SQL
from lodestone.session import cut, shared_folder, table
from lodestone.sources import heuristics, parse, sinks, tree, vector_file
from lodestone.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]

QUERY = "ledger registry deadline"
STORED_QUERIES = ["ledger registry deadline", "name:split", "validate tenant", "+lane -wallet"]
PHRASE = '"waiting lane" +profile -wallet'
EPOCH = 1_764_547_200
ROUND_END = "2026-01-01 00:00:00"

__all__ = ["QUERIES", "SQL", "flagship"]


def units_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units table: repeated rows once."""
    return table(spark, sf_dir, "code_units").dropDuplicates(["id"])


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "call_graph").select("caller_id", "callee_name", "line_number").distinct()


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One valid row per file of the index."""
    index, runs = table(spark, sf_dir, "file_index"), table(spark, sf_dir, "index_runs")
    return incremental.valid_index_rows(index, runs)


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest usable records of dimension 96."""
    last = vectors.latest(table(spark, sf_dir, "vectors"))
    return last.where((F.col("dim") == 96) & (F.size("data") == 96))


def lexical_index(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    return lexical.build_postings(units), lexical.field_stats(units)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


# --- functions --------------------------------------------------------------------------------------------------


def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = units_of(spark, sf_dir).select("language", text.tokens(F.col("body")).alias("t"))
    return terms.groupBy("language").agg(F.sum(F.size("t")).cast("bigint").alias("n_tokens"), F.max(F.size("t")).cast("bigint").alias("longest"))


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    rows = table(spark, sf_dir, "code_units").select("file_path").union(table(spark, sf_dir, "file_index").select("file_path")).distinct()
    return rows.select("file_path", text.path_language(path).alias("language"), text.is_test_file(path).alias("is_test"), text.is_test_file_semantic(path).alias("is_test_semantic"), heuristics.has_blocked_suffix(path).alias("is_blocked"), heuristics.in_blocked_folder(path).alias("in_blocked_folder"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units_of(spark, sf_dir).select("id", text.snippet(F.col("full_signature"), F.col("docstring"), F.col("name")).alias("snippet"), text.list_to_json(F.col("calls")).alias("calls_json"), F.size(text.list_from_json(text.list_to_json(F.col("calls")))).cast("bigint").alias("n_calls"))


def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units_of(spark, sf_dir).select("name").distinct()
    wanted = ["validate_tenant_account", "sync lower registry", "split", "zz"]
    scored = [rows.select("name", F.lit(q).alias("query"), F.round(names.name_match_score(F.lit(q), F.col("name")), 6).alias("score")) for q in wanted]
    out = scored[0]
    for s in scored[1:]:
        out = out.unionByName(s)
    return out


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within three edits of a word, for typing errors."""
    distance = F.levenshtein(F.lower("name"), F.lit("splitrow"), 3)
    return units_of(spark, sf_dir).select("name").distinct().withColumn("distance", distance.cast("bigint")).where(F.col("distance") >= 0)


def format_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce("n_chars", F.lit(0)).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", text.thousands(n).alias("thousands"), text.size_text(n * 1000).alias("size"), text.age_text(n * 20 - 60).alias("age"), text.duration_text(n).alias("duration"), text.percent_bar(n % 120, 10).alias("bar"))


def sizes_of_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bodies would pass the scan's rules on content."""
    rows = units_of(spark, sf_dir).select("id", F.encode("body", "UTF-8").alias("content"), "body")
    return rows.select("id", heuristics.head_is_source(F.col("content")).alias("head_ok"), heuristics.has_fit_size(F.length("content")).alias("size_ok"), heuristics.within_line_limit(F.col("body")).alias("lines_ok"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units_of(spark, sf_dir).select("id", text.content_hash(F.col("body")).alias("body_hash"))


# --- search -----------------------------------------------------------------------------------------------------


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(spark, sf_dir)
    return rounded(lexical.search(*lexical_index(units), QUERY, 20))


def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(spark, sf_dir)
    return rounded(lexical.scores(*lexical_index(units), lexical.parse_query(PHRASE)))


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(spark, sf_dir)
    rows = lexical.filtered_search(units, *lexical_index(units), QUERY, 10, lexical.SearchFilter(language="python", path="/", exclude_tests=True))
    return rounded(rows).select("rank", "id", "score", "name", "file_path", "snippet")


def bm25_filter_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(spark, sf_dir)
    rows = lexical.filtered_search(units, *lexical_index(units), QUERY, 10, lexical.SearchFilter(language="python", path="/", exclude_tests=True), pushdown=True)
    return rounded(rows).select("rank", "id", "score", "name", "file_path", "snippet")


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(spark, sf_dir)
    return lexical.filtered_search(units, *lexical_index(units), QUERY, 30).drop("rank")


def rrf_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.ordered(fusion.fuse(_top(spark, sf_dir), QUERY))
    return rounded(rows).select("rank", "id", "score", "lexical_rank", "name_rank")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest usable unit, as a stand-in for an embedded query."""
    first = vectors.decoded(records_of(spark, sf_dir)).orderBy("unit_id").first()
    return first["vector"] if first else [0.0] * 96


def rrf_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.nearest_to(records_of(spark, sf_dir), _query_vector(spark, sf_dir), 2000)
    rows = fusion.ordered(fusion.fuse_hybrid(_top(spark, sf_dir), QUERY, hits))
    return rounded(rows).select("rank", "id", "score", "lexical_rank", "name_rank", "vector_rank")


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.with_ranks(_top(spark, sf_dir), QUERY).join(units_of(spark, sf_dir).select("id", "repo", "complexity"), "id")
    last = table(spark, sf_dir, "file_index").groupBy("repo", "file_path").agg(F.max("last_indexed").alias("last_indexed"))
    rows = rows.join(last, ["repo", "file_path"], "left").withColumn("last_indexed", F.coalesce("last_indexed", F.lit(0))).withColumn("vector_rank", F.lit(None).cast("int"))
    return rounded(fusion.weighted(rows, EPOCH)).select("id", "score")


def semantic_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.semantic_only(units_of(spark, sf_dir), records_of(spark, sf_dir), _query_vector(spark, sf_dir), 50, lexical.SearchFilter(language="python"))
    return rounded(rows).select("rank", "id", "score", "name", "snippet")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth embedding, against all."""
    records = vectors.to_records(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector")))
    queries = vectors.decoded(records.where(F.col("unit_id") % 100 == 0)).select(F.col("unit_id").alias("query_id"), "vector")
    return vectors.nearest_to_many(records, queries, 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth embedding, looked for in the nearest cells of an inverted file."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    centres = ivf.fit_centroids(rows)
    queries = rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")
    return ivf.search(ivf.with_cells(rows, centres), queries, centres, 10, ivf.probes_for(rows, centres)).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"), vx.quantize(F.col("embedding")).alias("q"))
    back = vx.dequantize(F.col("q.data"), F.col("q.v_min"), F.col("q.v_max"))
    worst = F.array_max(F.zip_with("v", back, lambda a, b: F.abs(a.cast("double") - b)))
    return rows.select("vec_id", F.round("q.v_min", 6).alias("v_min"), F.round("q.v_max", 6).alias("v_max"), F.round(worst, 6).alias("worst"), F.round(vx.cosine(F.col("v"), back), 6).alias("cosine"), F.aggregate("q.data", F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint")).alias("total"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.decoded(records_of(spark, sf_dir))
    return rows.select("unit_id", F.round(vx.norm(F.col("vector")), 6).alias("norm"), F.size(vx.sparse(F.col("vector"), 0.1)).cast("bigint").alias("n_large"))


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after the latest ones of the last days were put over the older state."""
    raw = table(spark, sf_dir, "vectors")
    day = "timestamp'2025-12-25 00:00:00'"
    merged = vectors.upsert(vectors.latest(raw.where(f"written_at < {day}")), vectors.latest(raw.where(f"written_at >= {day}")))
    return merged.select("unit_id", "dim", "written_at")


# --- call graph -------------------------------------------------------------------------------------------------


def _popular_name(edges: DataFrame) -> str:
    row = edges.groupBy("callee_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee_name").first()
    return row["callee_name"] if row else ""


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_of(spark, sf_dir)
    return graph.callers_of(units_of(spark, sf_dir), edges, _popular_name(edges))


def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, units = edges_of(spark, sf_dir), units_of(spark, sf_dir)
    resolved = graph.live_edges(units, edges).join(units.select(F.col("name").alias("callee_name")).distinct(), "callee_name", "left_semi")
    first = resolved.agg(F.min("caller_id").alias("id")).first()["id"]
    return graph.callees_of(units, edges, first if first is not None else -1)


def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(spark, sf_dir)
    rows = graph.context(units, edges_of(spark, sf_dir), _top(spark, sf_dir))
    return rows.select("id", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


def unused_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unused_functions(units_of(spark, sf_dir), edges_of(spark, sf_dir))


def unused_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report_rows(unused_functions(spark, sf_dir))


def orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphan_edges(units_of(spark, sf_dir), edges_of(spark, sf_dir))


def live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.live_edges(units_of(spark, sf_dir), edges_of(spark, sf_dir))


def edges_from_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_of(units_of(spark, sf_dir))


def unit_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest unit around each place that the call graph mentions."""
    units = units_of(spark, sf_dir)
    places = edges_of(spark, sf_dir).join(units.select(F.col("id").alias("caller_id"), "repo", "file_path"), "caller_id").select("repo", "file_path", F.col("line_number").alias("line")).distinct()
    return graph.unit_at_lines(units, places)


def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.popularity(units_of(spark, sf_dir), edges_of(spark, sf_dir))


# --- several repositories ---------------------------------------------------------------------------------------


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repos").withColumn("ordinal", F.row_number().over(Window.orderBy("added_at", "name")))


def federated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(spark, sf_dir)
    rows = federated.search_repos(units, *lexical_index(units), _repos(spark, sf_dir), QUERY, 25)
    return rounded(rows).select("rank", "repo", "id", "score", "name")


def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, records = units_of(spark, sf_dir), records_of(spark, sf_dir)
    place = units.join(records.select(F.col("unit_id").alias("id")), "id", "left_semi").orderBy("id").select("repo", "file_path", "line_start").first()
    return federated.find_similar(units, records, *(place or ("", "", 0)), 20)


def dedup_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units_of(spark, sf_dir).withColumn("place", F.col("id"))
    return federated.first_of_copies(rows, body="body").select("id", "name")


def repo_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.repo_rollup(units_of(spark, sf_dir)).withColumn("languages", F.array_join("languages", ","))


def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, sf_dir)
    return federated.cached_vectors(units_of(spark, sf_dir), files, records_of(spark, sf_dir), files)


# --- statistics and changes -------------------------------------------------------------------------------------


def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_type(units_of(spark, sf_dir))


def stats_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_language(units_of(spark, sf_dir))


def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(units_of(spark, sf_dir), edges_of(spark, sf_dir), table(spark, sf_dir, "file_index"))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.latest_observations(table(spark, sf_dir, "file_scan"))


def cdc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.classify(_listing(spark, sf_dir), files_of(spark, sf_dir))


def cdc_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.run_counters(cdc_classify(spark, sf_dir), units_of(spark, sf_dir).select("id"))


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.missing_files(files_of(spark, sf_dir).select("repo", "file_path"), _listing(spark, sf_dir))


def files_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files table after the next run has taken in what is new or changed."""
    files, listing = files_of(spark, sf_dir).select("repo", "file_path", "file_hash"), _listing(spark, sf_dir)
    fresh = incremental.select_changed(listing, files_of(spark, sf_dir), ["repo", "file_path"], force="needs_reindex").select("repo", "file_path", "file_hash")
    return changes.upsert_files(files, fresh)


def units_after_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(spark, sf_dir).select("repo", "file_path", "id")
    return units.join(missing_files(spark, sf_dir), ["repo", "file_path"], "left_anti").select("repo", "file_path", "id")


def unit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that change when line ends are made uniform."""
    units = units_of(spark, sf_dir)
    return changes.unit_diff(units, units.withColumn("body", F.replace("body", F.lit("\r\n"), F.lit("\n"))))


def modified_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.modified_since(units_of(spark, sf_dir), table(spark, sf_dir, "file_index"), EPOCH).select("id", "file_path")


def table_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.row_digest(units_of(spark, sf_dir), ["repo", "id", "file_path", "name", "body", "line_start", "line_end"])


def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rounded(lexical.ranked(_top(spark, sf_dir)))
    return sinks.to_json_rows(rows)


def search_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.to_csv_rows(lexical.ranked(_top(spark, sf_dir)))


def search_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.to_plain_rows(lexical.ranked(_top(spark, sf_dir)))


# --- scans and streams ------------------------------------------------------------------------------------------


def parse_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units found again when each body is parsed as a file of its own."""
    files = units_of(spark, sf_dir).select("repo", F.concat("file_path", F.lit("#"), F.col("id").cast("string")).alias("file_path"), "language", F.col("body").alias("text"))
    return parse.parse_units(files).groupBy("language", "unit_type").agg(F.count("*").alias("n_units"), F.sum(F.size("calls")).alias("n_calls"))


def debounce_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = watch.debounced(table(spark, sf_dir, "file_scan").distinct(), "repo", "observed_at", 600.0)
    return rows.groupBy("repo", "batch").agg(F.count("*").alias("n"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))


def coalesce_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = watch.debounced(table(spark, sf_dir, "file_scan").distinct(), "repo", "observed_at", 600.0)
    out = watch.coalesced(rows, ["repo", "batch"], "file_path", F.col("event_kind") == "gone")
    return out.select("repo", "batch", "check_all", F.array_join("paths", ",").alias("paths"))


def watched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    extensions = [e for own in text.EXTENSIONS.values() for e in own]
    plain = table(spark, sf_dir, "file_scan").withColumn("file_path", incremental.plain_path(F.col("file_path")))
    return watch.watched_paths(plain, heuristics.BLOCKED_FOLDERS, extensions).select("scan_id", "file_path").distinct()


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations as a stream of files into a keyed table, read at its end."""
    source = table(spark, sf_dir, "file_scan")
    at = f"{shared_folder(spark)}/stream-{spark._jvm.java.util.UUID.randomUUID()}"
    whole, folder = f"{sf_dir.rstrip('/')}/file_scan.parquet", sf_dir.rstrip("/")
    is_folder = spark._jvm.org.apache.hadoop.fs.Path(whole).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(whole)).isDirectory()
    reader = spark.readStream.schema(source.schema)
    stream = reader.parquet(whole) if is_folder else reader.option("pathGlobFilter", "file_scan.parquet").parquet(folder)
    done: list[int] = []

    def apply(rows: DataFrame, batch_id: int) -> None:
        # the version follows from the batch, so a batch that runs again or after a restart writes the same one
        state = rows if not batch_id else watch.last_per_key(spark.read.parquet(f"{at}/v={batch_id}").unionByName(rows), ["repo", "file_path"], ["observed_at", "scan_id"])
        state.write.mode("overwrite").parquet(f"{at}/v={batch_id + 1}")
        done.append(batch_id + 1)

    query = watch.start_upserts(stream, f"{at}/checkpoint", apply, ["repo", "file_path"], ["observed_at", "scan_id"])
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    state = spark.read.parquet(f"{at}/v={done[-1]}") if done else source.limit(0)
    return state.select("repo", "file_path", "observed_at", "scan_id", "event_kind")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind in windows of an hour."""
    return watch.event_counts(table(spark, sf_dir, "events"), "ts", "event_type", "10 minutes", "1 hour")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the next run has to process."""
    return incremental.files_to_process(*(table(spark, sf_dir, t) for t in ("file_scan", "file_index", "index_runs"))).select("repo", "file_path")


# --- stored indexes, working trees and files --------------------------------------------------------------------


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of a small working tree, with ignore rules, blocked folders, names and contents left out."""
    root = fixture.plant(fixture.work_folder(spark, "tree"))
    return tree.read_tree(spark, root, "small").select("repo", "file_path", "language", "file_hash")


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for given paths, some of which are ignored or gone."""
    root = fixture.plant(fixture.work_folder(spark, "tree"))
    return tree.read_paths(spark, root, "small", ["cmd/main.go", "skipped/a.py", "no.py", "web/boot.js", "b.tmp.py"]).select("file_path", "file_hash")


def tree_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that the parsers find in the small tree."""
    root = fixture.plant(fixture.work_folder(spark, "tree"))
    units = parse.parse_units(tree.read_tree(spark, root, "small"))
    return units.select("file_path", "name", "unit_type", "line_start", "line_end", F.array_join("calls", ",").alias("calls"))


def index_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of runs over the small tree: first, again, after changes, by paths, cleanup, rebuild; each state is checked as a whole."""
    at = fixture.work_folder(spark, "index")
    root, index = fixture.plant(f"{at}/small"), CodeIndex(spark, f"{at}/index")
    done = [("1 first", index.index(root, "small", 1)), ("2 again", index.index(root, "small", 2))]
    fixture.plant(root, fixture.CHANGED)
    os.unlink(f"{root}/{fixture.GONE}")
    done.append(("3 changed", index.index(root, "small", 3)))
    fixture.plant(root, {"web/boot.js": fixture.TREE["web/boot.js"]})
    done.append(("4 paths", index.update_paths(root, "small", ["web/boot.js", "notes.txt"], 4)))
    os.unlink(f"{root}/web/boot.js")
    gone = index.cleanup(root, "small")
    done.append(("5 cleanup", {"indexed": 0, "skipped": 0, "removed": gone["removed_files"], "new_units": gone["removed_units"]}))
    done.append(("6 rebuild", index.rebuild(root, "small")))
    index.validate(whole=True)
    return spark.createDataFrame([(step, c["indexed"], c["skipped"], c["removed"], c["new_units"]) for step, c in done], "step string, indexed int, skipped int, removed int, new_units int")


def _stored(spark: SparkSession) -> CodeIndex:
    at = fixture.work_folder(spark, "index")
    index = CodeIndex(spark, f"{at}/index")
    index.index(fixture.plant(f"{at}/small"), "small", 1)
    return index


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best result of each of some searches in a stored index."""
    index = _stored(spark)
    out = None
    for query, _, _ in fixture.FOUND:
        rows = index.search(query, 5).where("rank = 1").select(F.lit(query).alias("query"), F.col("rank").cast("int").alias("rank"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out


def index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of a stored index after an update, and what is recorded of them."""
    at = fixture.work_folder(spark, "index")
    root, index = fixture.plant(f"{at}/small"), CodeIndex(spark, f"{at}/index")
    index.index(root, "small", 1)
    fixture.plant(root, fixture.CHANGED)
    index.index(root, "small", 2)
    index.embed(lambda texts: [[float(len(t)), 1.0] for t in texts], "length")
    meta = index.metadata()
    counts = [(name, index.table(name).count()) for name in ("units", "edges", "files", "vectors")]
    counts += [("recorded units", meta.num_units), ("recorded files", meta.num_files), ("pending", index.pending().count()), ("coverage", index.stats().first()["coverage"])]
    return spark.createDataFrame(counts, "what string, n bigint")


def index_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a file, each looked up by its id, with its body and the unit at its first line."""
    index = _stored(spark)
    ids = [r["id"] for r in index.units_of_file("small", "services/auth/login.py").collect()]
    out = None
    for i in ids:
        rows = index.with_bodies(index.unit(i).select("id", "name", "line_start"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("name", "line_start", F.split("body", "\n")[0].alias("first_line"))


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best units of several queries, read from postings that were written once, sorted by term."""
    units, at = units_of(spark, sf_dir), f"{shared_folder(spark)}/postings-{spark._jvm.java.util.UUID.randomUUID()}"
    lexical.write_postings(lexical.build_postings(units), at)
    postings, stats_ = spark.read.parquet(at), cut(lexical.field_stats(units))
    out = None
    for q in STORED_QUERIES:
        rows = rounded(lexical.search(postings, stats_, q, 20)).select(F.lit(q).alias("query"), "id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def stored_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries in one pass."""
    units, at = units_of(spark, sf_dir), f"{shared_folder(spark)}/postings-{spark._jvm.java.util.UUID.randomUUID()}"
    lexical.write_postings(lexical.build_postings(units), at)
    found = lexical.search_many(spark.read.parquet(at), lexical.field_stats(units), {q: q for q in STORED_QUERIES}, 20)
    return rounded(found).select("query", "id", "score")


def vector_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written to one packed file and read again."""
    path = f"{fixture.work_folder(spark, 'vectors')}/vectors.bin"
    vector_file.write_vectors(records_of(spark, sf_dir), path)
    rows = vector_file.read_vectors(spark, path)
    return rows.select("unit_id", "dim", F.round("v_min", 4).alias("v_min"), F.round("v_max", 4).alias("v_max"), F.aggregate("data", F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint")).alias("total"))


def repos_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of the table as a registry file, looked up by names."""
    registry = config.Registry(f"{fixture.work_folder(spark, 'registry')}/repos.json")
    for r in table(spark, sf_dir, "repos").orderBy("added_at", "name").collect():  # a fixed table of a few rows
        registry.add(r["name"], r["path"], r["added_at"])
    again = config.Registry(registry.path)
    names = sorted(e.name for e in again.entries)[:3]
    return spark.createDataFrame([(e.name, e.path, e.added_at) for e in again.resolve(", ".join(names))], "name string, path string, added_at bigint")


def settings_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings after some were set, saved and loaded."""
    path = f"{fixture.work_folder(spark, 'settings')}/config.toml"
    own = config.Config.load(path)
    for key, value in (("search.limit", "25"), ("search.exclude_tests", "yes"), ("search.format", "csv")):
        own.set(key, value)
    own.save(path)
    return spark.createDataFrame([(k, v) for k, v, _ in config.Config.load(path).list()], "key string, value string")


def rrf_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical, name and call-graph ranks fused."""
    rows = graph.popularity_ranks(_top(spark, sf_dir), edges_of(spark, sf_dir))
    return rounded(fusion.ordered(fusion.fuse_popular(rows, QUERY))).select("rank", "id", "score", "n_callers", "popularity_rank")


def near_copy_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at a cosine of 0.99 or more to one with a smaller id."""
    return vector_copies.near_copies(records_of(spark, sf_dir), 96)


def similar_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar units as a view of the context shows them."""
    return find_similar(spark, sf_dir).select("id", text.similarity_percent(F.col("similarity")).alias("percent"))


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the inverted file finds nine of ten true neighbours of every hundredth embedding."""
    true = vector_topk(spark, sf_dir).select("query_id", "id")
    hits = ivf_topk(spark, sf_dir).select("query_id", "id").join(true, ["query_id", "id"], "left_semi").count()
    return true.agg(F.countDistinct("query_id").alias("n_queries"), (F.lit(hits) >= 0.9 * F.count("*")).alias("recall_at_least_090"))


def p3_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs over the observations process, with state kept between them: those received up to a day, then all."""
    at = f"{shared_folder(spark)}/rounds-{spark._jvm.java.util.UUID.randomUUID()}"
    store = incremental.StateStore(spark, f"{at}/state", ["repo", "file_path"])
    scans = table(spark, sf_dir, "file_scan")
    for number, seen in enumerate((scans.where(F.col("received_at") < F.lit(ROUND_END).cast("timestamp")), scans), 1):
        incremental.run_incremental(incremental.latest_observations(seen), store, lambda df, n=number: df.write.mode("overwrite").parquet(f"{at}/out/round={n}"))
    rows = spark.read.schema("repo string, file_path string, file_hash string, change string, round int").parquet(f"{at}/out")
    return rows.select("round", "repo", "file_path", "file_hash", "change")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p3_found, p3_rounds, tokenize_stats, path_functions, snippets, name_match, fuzzy_names, format_helpers, sizes_of_heads, content_hashes,
        bm25_search, bm25_phrase, bm25_filtered, bm25_filter_first, rrf_two_way, rrf_three_way, rrf_weighted, semantic_only, vector_topk, ivf_topk, quantize_roundtrip, vector_norms, vector_upsert,
        callers, callees, search_context, unused_functions, unused_report, orphan_edges, live_edges, edges_from_units, unit_at_line, popularity,
        federated_search, find_similar, dedup_fingerprint, repo_rollup, cached_vectors, stats_by_type, stats_by_language, stats_summary,
        cdc_classify, cdc_counters, missing_files, files_after_run, units_after_cleanup, unit_diff, modified_since, table_checksum, search_json, search_csv, search_plain,
        tree_files, tree_paths, tree_units, index_cycle, index_search, index_tables, index_lookups, stored_search, stored_search_many, vector_file_roundtrip, repos_resolved, settings_listed, rrf_popular, near_copy_vectors, similar_percent, ivf_recall,
        parse_bodies, debounce_batches, coalesce_batches, watched_events, stream_upsert, event_windows,
    )
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrf_two_way(spark, sf_dir)
