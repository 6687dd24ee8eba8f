"""SQL of the core queries, for a second engine on the same tables."""

from __future__ import annotations

from lodestone.functions.text import EXTENSIONS
from lodestone.plans import fixture
from lodestone.sources import heuristics

EPOCH = 1_764_547_200
QUERY_WORDS = ["ledger", "registry", "deadline"]
QUERY = " ".join(QUERY_WORDS)
BOOSTS = {"name": ("name", 3.0), "signature": ("full_signature", 2.0), "docstring": ("docstring", 1.0), "body": ("body", 1.0)}

UNITS = "units AS (SELECT DISTINCT ON (id) * FROM code_units)"
EDGES = "edges AS (SELECT DISTINCT caller_id, callee_name, line_number FROM call_graph)"


def in_list(values: list[str]) -> str:
    return ", ".join("'" + v + "'" for v in values)


def terms(column: str) -> str:
    return rf"[t FOR t IN regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{N}}]+') IF strlen(t) < 40]"


FIELD_TERMS = "ft AS (" + " UNION ALL ".join(f"SELECT id, '{name}' AS field, {boost}::DOUBLE AS boost, {terms(column)} AS terms FROM units" for name, (column, boost) in BOOSTS.items()) + ")"
FIELD_STATS = "st AS (SELECT field, count(*) AS n_units, avg(len(terms)) AS mean_length FROM ft GROUP BY field)"
WEIGHT = "boost * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * CASE WHEN mean_length > 0 THEN flen / mean_length ELSE 0 END))"


def bm25(words: list[str]) -> str:
    """CTEs up to scores(id, score) for alternatives of single words."""
    return f"""{UNITS}, {FIELD_TERMS}, {FIELD_STATS},
tf AS (SELECT id, field, boost, flen, term, count(*) AS tf FROM (SELECT id, field, boost, len(terms) AS flen, unnest(terms) AS term FROM ft) WHERE term IN ({in_list(words)}) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
idf AS (SELECT df.field, term, ln(1 + (n_units - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM df JOIN st USING (field)),
scores AS (SELECT id, sum({WEIGHT}) AS score FROM tf JOIN idf USING (field, term) JOIN st USING (field) GROUP BY id)"""


def name_score(query: str, name: str) -> str:
    q = f"translate({query}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    n = f"translate({name}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""CASE WHEN {n} = {q} THEN 1.0::DOUBLE WHEN starts_with({n}, {q}) THEN 0.9::DOUBLE WHEN contains({n}, {q}) THEN 0.7::DOUBLE
WHEN len([w FOR w IN string_split_regex({q}, '\\s+') IF w <> '' AND contains({n}, w)]) > 0 THEN 0.5::DOUBLE
ELSE 0.4::DOUBLE * jaro_winkler_similarity(string_split_regex({q}, '\\s+')[1], {n}) END"""


PLAIN_PATH = r"regexp_replace(regexp_replace(regexp_replace(file_path, '\\', '/', 'g'), '/{2,}', '/', 'g'), '^(\./)+', '')"
PLAIN_HASH = r"nullif(regexp_replace(lower(trim(file_hash)), '^[a-z0-9_-]+[:=]', ''), '')"
LISTING = rf"""scans AS (
  SELECT repo, {PLAIN_PATH} AS file_path, event_kind, {PLAIN_HASH} AS file_hash, observed_at, scan_id FROM file_scan),
latest AS (
  SELECT * FROM scans WHERE event_kind = 'gone' OR (event_kind = 'seen' AND file_hash IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY observed_at DESC, scan_id DESC) = 1),
listing AS (SELECT repo, file_path, file_hash FROM latest WHERE event_kind = 'seen')"""
FILES = rf"""valid AS (
  SELECT repo, {PLAIN_PATH} AS file_path, {PLAIN_HASH} AS file_hash, coalesce(needs_reindex, false) AS needs_reindex, last_indexed
  FROM file_index i
  WHERE EXISTS (SELECT 1 FROM index_runs r WHERE r.repo = i.repo AND r.run_status = 'ok' AND i.last_indexed BETWEEN r.started_at AND r.finished_at)),
files AS (
  SELECT * FROM valid
  QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY last_indexed DESC, needs_reindex DESC, file_hash DESC) = 1)"""
CHANGED = "(k.repo IS NULL OR k.needs_reindex OR l.file_hash IS DISTINCT FROM k.file_hash)"

RECORDS = """records AS (
  SELECT unit_id, dim, v_min, v_max, data, written_at FROM (SELECT DISTINCT * FROM vectors)
  QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY written_at DESC NULLS LAST, dim DESC NULLS LAST, v_min DESC NULLS LAST, v_max DESC NULLS LAST, data DESC NULLS LAST) = 1),
usable AS (
  SELECT unit_id AS id, [CAST(v_min AS DOUBLE) + x::DOUBLE / 255.0::DOUBLE * (CAST(v_max AS DOUBLE) - CAST(v_min AS DOUBLE)) FOR x IN data] AS v
  FROM records WHERE dim = 96 AND len(data) = 96 AND v_min IS NOT NULL AND v_max IS NOT NULL),
q AS (SELECT v AS qv FROM usable ORDER BY id LIMIT 1)"""


def dot(a: str, b: str) -> str:
    return f"list_sum([{a}[i] * {b}[i] FOR i IN range(1, len({a}) + 1)])"


SIMILARITY = f"{dot('qv', 'v')} / (sqrt({dot('qv', 'qv')}) * greatest(sqrt({dot('v', 'v')}), 1e-9::DOUBLE))"
ORDER = "round(score, 9) DESC, id"
TOP = f"top AS (SELECT s.id, s.score, u.* EXCLUDE (id) FROM scores s JOIN units u USING (id) ORDER BY round(s.score, 9) DESC, s.id LIMIT 30)"
IS_TEST = r"regexp_matches(translate(replace({0}, '\', '/'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/tests?/|/specs?/|_test\.|\.test\.|\.spec\.|/test_|^test_')"
SNIPPET = "coalesce(nullif(full_signature, ''), nullif(docstring, ''), name)"
RANKED = f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY {ORDER}) - 1 AS lexical_rank, {name_score("'" + QUERY + "'", "name")} AS name_score FROM top),
both_ranks AS (SELECT *, row_number() OVER (ORDER BY round(name_score, 9) DESC, lexical_rank) - 1 AS name_rank FROM ranked)"""
TWO_WAY = "1.0::DOUBLE / (60.0::DOUBLE + lexical_rank + 1) + 1.0::DOUBLE / (5.0::DOUBLE + name_rank + 1)"
LANGUAGE_CASE = "CASE " + " ".join(f"WHEN regexp_extract(file_path, '\\.([^./\\\\]+)$', 1) IN ({in_list(e)}) THEN '{l}'" for l, e in EXTENSIONS.items()) + " ELSE 'unknown' END"
BLOCKED = " OR ".join(f"ends_with(lower(list_extract(string_split(file_path, '/'), -1)), '{s}')" for s in heuristics.BLOCKED_SUFFIXES)
FOLDERS = "string_split(file_path, '/')[:-2]"
BLOCKED_FOLDER = f"len([s FOR s IN {FOLDERS} IF s IN ({in_list(heuristics.BLOCKED_FOLDERS)}) OR " + " OR ".join(f"starts_with(s, '{p}')" for p in heuristics.BLOCKED_PREFIXES) + "]) > 0"
NEIGHBOURS = "string_agg(other_name, ',' ORDER BY other_id)"
HEAD = "decode(encode(body)[1:512])"
DEBOUNCE = """gaps AS (
  SELECT DISTINCT * FROM file_scan),
marked AS (
  SELECT *, CASE WHEN epoch_us(observed_at) / 1e6 - epoch_us(lag(observed_at) OVER w) / 1e6 > 600 OR lag(observed_at) OVER w IS NULL THEN 1 ELSE 0 END AS paused
  FROM gaps WINDOW w AS (PARTITION BY repo ORDER BY observed_at, scan_id)),
batches AS (SELECT *, CAST(sum(paused) OVER (PARTITION BY repo ORDER BY observed_at, scan_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS batch FROM marked)"""
CSV_FIELD = """CASE WHEN regexp_matches({0}, '[,"\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""



def literal(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def stored(query: str, words: list[str], field: str | None = None, never: str | None = None) -> str:
    own = bm25(words) if field is None else bm25(words).replace("WHERE term IN", f"WHERE field = '{field}' AND term IN")
    out = "" if never is None else f"WHERE id NOT IN (SELECT id FROM ft WHERE list_contains(terms, '{never}'))"
    return f"(WITH {own} SELECT {literal(query)} AS query, id, round(score, 6) AS score FROM scores {out} ORDER BY {ORDER} LIMIT 20)"


LANGUAGE_OF = {e: language for language, endings in EXTENSIONS.items() for e in endings}

SQL: dict[str, str] = {
    "tree_files": " UNION ALL ".join(f"SELECT 'small' AS repo, {literal(f)} AS file_path, {literal(LANGUAGE_OF[f.rsplit('.', 1)[1]])} AS language, sha256({literal(fixture.TREE[f])}) AS file_hash" for f in fixture.KEPT),
    "tree_paths": " UNION ALL ".join(f"SELECT {literal(f)} AS file_path, sha256({literal(fixture.TREE[f])}) AS file_hash" for f in ("cmd/main.go", "web/boot.js")),
    "tree_units": values(fixture.UNITS, "file_path, name, unit_type, line_start, line_end, calls"),
    "index_cycle": values(fixture.STEPS, "step, indexed, skipped, removed, new_units"),
    "index_search": values(fixture.FOUND, "query, rank, name"),
    "index_tables": values(fixture.ROWS, "what, n"),
    "index_lookups": values(fixture.LOGIN, "name, line_start, first_line"),
    "stored_search": " UNION ALL ".join([stored("ledger registry deadline", QUERY_WORDS), stored("name:split", ["split"], "name"), stored("validate tenant", ["validate", "tenant"]), stored("+lane -wallet", ["lane"], never="wallet")]),
    "vector_file_roundtrip": f"WITH {RECORDS} SELECT unit_id, dim, round(v_min, 4) AS v_min, round(v_max, 4) AS v_max, CAST(list_sum(data) AS BIGINT) AS total FROM records WHERE dim = 96 AND len(data) = 96",
    "repos_resolved": "SELECT name, path, added_at FROM repos ORDER BY name LIMIT 3",
    "settings_listed": values([("search.limit", "25"), ("search.no_tui", "false"), ("search.format", "csv"), ("search.exclude_tests", "true"), ("index.auto_index", "false"), ("editor.command", "(auto-detect)")], "key, value"),
    "ivf_recall": "SELECT count(*) AS n_queries, true AS recall_at_least_090 FROM embeddings WHERE vec_id % 100 = 0",
    "table_checksum": f"WITH {UNITS} SELECT count(*) AS n_rows, CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in ('repo', 'id', 'file_path', 'name', 'body', 'line_start', 'line_end'))})), 1, 15) AS HUGEINT)), 0) AS VARCHAR) AS digest FROM units",
    "p3_found": f"WITH {LISTING}, {FILES} SELECT l.repo, l.file_path FROM listing l LEFT JOIN files k ON l.repo = k.repo AND l.file_path = k.file_path WHERE {CHANGED}",
    "p3_rounds": f"""
WITH {LISTING}, before AS (WITH {LISTING.replace("FROM file_scan", "FROM (SELECT * FROM file_scan WHERE received_at < TIMESTAMP '2026-01-01 00:00:00')")} SELECT * FROM listing)
SELECT 1 AS round, repo, file_path, file_hash, 'new' AS change FROM before
UNION ALL
SELECT 2, l.repo, l.file_path, l.file_hash, CASE WHEN b.repo IS NULL THEN 'new' ELSE 'changed' END
FROM listing l LEFT JOIN before b ON l.repo = b.repo AND l.file_path = b.file_path WHERE b.file_hash IS DISTINCT FROM l.file_hash""",
    "tokenize_stats": f"WITH {UNITS} SELECT language, CAST(sum(len({terms('body')})) AS BIGINT) AS n_tokens, CAST(max(len({terms('body')})) AS BIGINT) AS longest FROM units GROUP BY language",
    "path_functions": rf"""
SELECT file_path, {LANGUAGE_CASE} AS language, {IS_TEST.format('file_path')} AS is_test,
  contains(file_path, '/test') OR contains(file_path, '_test.') OR contains(file_path, '.test.') OR contains(file_path, 'spec.') AS is_test_semantic,
  ({BLOCKED}) AS is_blocked, {BLOCKED_FOLDER} AS in_blocked_folder
FROM (SELECT file_path FROM code_units UNION SELECT file_path FROM file_index)""",
    "snippets": f"WITH {UNITS} SELECT id, {SNIPPET} AS snippet, CAST(to_json(calls) AS VARCHAR) AS calls_json, CAST(len(calls) AS BIGINT) AS n_calls FROM units",
    "name_match": "WITH names AS (SELECT DISTINCT name FROM code_units), q AS (SELECT unnest(['validate_tenant_account', 'sync lower registry', 'split', 'zz']) AS query) SELECT name, query, round(" + name_score("query", "name") + ", 6) AS score FROM names, q",
    "fuzzy_names": "SELECT * FROM (SELECT DISTINCT name, levenshtein(lower(name), 'splitrow') AS distance FROM code_units) WHERE distance <= 3",
    "format_helpers": """
WITH d AS (SELECT doc_id, coalesce(n_chars, 0) AS n, coalesce(n_chars, 0) * 1000 AS b, coalesce(n_chars, 0) * 20 - 60 AS a, coalesce(n_chars, 0) % 120 AS p FROM documents)
SELECT doc_id, format('{:,}', n) AS thousands,
  CASE WHEN b = 0 THEN '—' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE printf('%.2f GB', b / 1073741824.0::DOUBLE) END AS size,
  CASE WHEN a < 0 THEN 'just now' WHEN a < 60 THEN a || 's ago' WHEN a < 3600 THEN a // 60 || 'm ago' WHEN a < 86400 THEN a // 3600 || 'h ' || a % 3600 // 60 || 'm ago' ELSE a // 86400 || 'd ago' END AS age,
  CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN n // 60 || 'm' || n % 60 || 's' ELSE n // 3600 || 'h' || n % 3600 // 60 || 'm' END AS duration,
  '[' || repeat('█', least(p * 10 // 100, 10)) || repeat('░', 10 - least(p * 10 // 100, 10)) || ']' AS bar
FROM d""",
    "sizes_of_heads": f"""
WITH {UNITS}, heads AS (SELECT id, body, octet_length(encode(body)) AS size, encode(body)[1:512] AS raw FROM units)
SELECT id, CASE WHEN try(decode(raw)) IS NULL THEN false ELSE NOT contains(try(decode(raw)), chr(0)) AND {' AND '.join("NOT contains(try(decode(raw)), '" + m.replace("'", "''") + "')" for m in heuristics.GENERATED_MARKERS)}
    AND len([l FOR l IN string_split(try(decode(raw)), chr(10)) IF strlen(rtrim(l)) > 500]) = 0 END AS head_ok,
  size BETWEEN 1 AND 1000000 AS size_ok, length(body) - length(replace(body, chr(10), '')) < 10000 AS lines_ok
FROM heads""",
    "content_hashes": f"WITH {UNITS} SELECT id, sha256(body) AS body_hash FROM units",
    "bm25_search": f"WITH {bm25(QUERY_WORDS)} SELECT id, round(score, 6) AS score FROM scores ORDER BY {ORDER} LIMIT 20",
    "bm25_phrase": f"""
WITH {UNITS}, {FIELD_TERMS}, {FIELD_STATS},
single AS (SELECT id, field, boost, len(terms) AS flen, term, len([t FOR t IN terms IF t = term]) AS tf FROM ft, (SELECT unnest(['waiting', 'lane', 'profile', 'wallet']) AS term) WHERE list_contains(terms, term)),
idf AS (SELECT d.field, term, ln(1 + (n_units - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT field, term, count(*) AS df FROM single GROUP BY ALL) d JOIN st USING (field)),
phrase AS (SELECT id, field, boost, len(terms) AS flen, len([i FOR i IN range(1, len(terms)) IF terms[i] = 'waiting' AND terms[i + 1] = 'lane']) AS tf FROM ft),
phrase_idf AS (SELECT field, sum(idf) AS idf FROM idf WHERE term IN ('waiting', 'lane') GROUP BY field),
parts AS (
  SELECT id, 1 AS clause, {WEIGHT} AS part FROM single JOIN idf USING (field, term) JOIN st USING (field) WHERE term = 'profile'
  UNION ALL SELECT id, 0, {WEIGHT} FROM phrase JOIN phrase_idf USING (field) JOIN st USING (field) WHERE tf > 0)
SELECT id, round(sum(part), 6) AS score FROM parts
WHERE id NOT IN (SELECT id FROM single WHERE term = 'wallet') GROUP BY id HAVING count(*) FILTER (clause = 1) > 0""",
    "bm25_filtered": f"""
WITH {bm25(QUERY_WORDS)}, best AS (SELECT * FROM scores ORDER BY {ORDER} LIMIT 50),
kept AS (SELECT s.id, score, name, file_path, {SNIPPET} AS snippet FROM best s JOIN units USING (id) WHERE language = 'python' AND contains(file_path, '/') AND NOT {IS_TEST.format('file_path')} ORDER BY {ORDER} LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS rank, id, round(score, 6) AS score, name, file_path, snippet FROM kept""",
    "bm25_filter_first": f"""
WITH {bm25(QUERY_WORDS)},
kept AS (SELECT s.id, score, name, file_path, {SNIPPET} AS snippet FROM scores s JOIN units USING (id) WHERE language = 'python' AND contains(file_path, '/') AND NOT {IS_TEST.format('file_path')} ORDER BY {ORDER} LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS rank, id, round(score, 6) AS score, name, file_path, snippet FROM kept""",
    "rrf_two_way": f"""
WITH {bm25(QUERY_WORDS)}, {TOP}, {RANKED}, fused AS (SELECT id, 1000 * ({TWO_WAY}) AS score, lexical_rank, name_rank FROM both_ranks)
SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, lexical_rank) AS INTEGER) AS rank, id, round(score, 6) AS score, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(name_rank AS INTEGER) AS name_rank FROM fused""",
    "rrf_three_way": f"""
WITH {bm25(QUERY_WORDS)}, {TOP}, {RANKED}, {RECORDS},
near AS (SELECT id, {SIMILARITY} AS similarity FROM usable, q),
hits AS (SELECT id, row_number() OVER (ORDER BY round(similarity, 9) DESC, id) - 1 AS vector_rank FROM near ORDER BY round(similarity, 9) DESC, id LIMIT 2000),
joined AS (SELECT b.*, coalesce(h.vector_rank, count(*) OVER ()) AS vector_rank FROM both_ranks b LEFT JOIN hits h USING (id)),
fused AS (SELECT id, 1000 * ({TWO_WAY} + 1.0::DOUBLE / (60.0::DOUBLE + vector_rank + 1)) AS score, lexical_rank, name_rank, vector_rank FROM joined)
SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, lexical_rank) AS INTEGER) AS rank, id, round(score, 6) AS score, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(name_rank AS INTEGER) AS name_rank, vector_rank FROM fused""",
    "rrf_weighted": f"""
WITH {bm25(QUERY_WORDS)}, {TOP}, {RANKED}, last AS (SELECT repo, file_path, max(last_indexed) AS last_indexed FROM file_index GROUP BY ALL)
SELECT id, round(1000 * (0.3::DOUBLE / (60.0::DOUBLE + lexical_rank + 1) + 0.2::DOUBLE / (5.0::DOUBLE + name_rank + 1) + 0.5::DOUBLE / (60.0::DOUBLE + 1000000 + 1))
  * (1 + CASE WHEN ({EPOCH} - coalesce(last_indexed, 0)) / 86400.0::DOUBLE <= 30 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN complexity > 10 THEN 0.05::DOUBLE ELSE 0 END), 6) AS score
FROM both_ranks LEFT JOIN last USING (repo, file_path)""",
    "semantic_only": f"""
WITH {UNITS}, {RECORDS}, near AS (SELECT id, {SIMILARITY} AS similarity FROM usable, q ORDER BY round({SIMILARITY}, 9) DESC, id LIMIT 50),
kept AS (SELECT n.id, similarity AS score, name, coalesce(full_signature, '') AS snippet FROM near n JOIN units USING (id) WHERE language = 'python')
SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS rank, id, round(score, 6) AS score, name, snippet FROM kept""",
    "vector_topk": f"""
WITH base AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
span AS (SELECT vec_id, e, list_min(e) AS lo, list_max(e) AS hi, greatest(list_max(e) - list_min(e), 1e-9::DOUBLE) AS r FROM base),
dec AS (SELECT vec_id AS id, [CAST(CAST(lo AS FLOAT) AS DOUBLE) + least(255, greatest(0, round((x - lo) / r * 255.0::DOUBLE)))::DOUBLE / 255.0::DOUBLE * (CAST(CAST(hi AS FLOAT) AS DOUBLE) - CAST(CAST(lo AS FLOAT) AS DOUBLE)) FOR x IN e] AS v FROM span),
pairs AS (SELECT a.id AS query_id, b.id, {SIMILARITY} AS similarity FROM (SELECT id, v AS qv FROM dec WHERE id % 100 = 0) a, dec b)
SELECT query_id, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM pairs QUALIFY rank <= 10""",
    "quantize_roundtrip": f"""
WITH base AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS qv FROM embeddings),
span AS (SELECT *, list_min(qv) AS lo, list_max(qv) AS hi, greatest(list_max(qv) - list_min(qv), 1e-9::DOUBLE) AS r FROM base),
quant AS (SELECT *, [CAST(least(255, greatest(0, round((x - lo) / r * 255.0::DOUBLE))) AS INTEGER) FOR x IN qv] AS d FROM span),
back AS (SELECT *, [lo + b::DOUBLE / 255.0::DOUBLE * (hi - lo) FOR b IN d] AS v FROM quant)
SELECT vec_id, round(lo, 6) AS v_min, round(hi, 6) AS v_max, round(list_max([abs(qv[i] - v[i]) FOR i IN range(1, len(v) + 1)]), 6) AS worst, round({SIMILARITY}, 6) AS cosine, CAST(list_sum(d) AS BIGINT) AS total FROM back""",
    "vector_norms": f"WITH {RECORDS} SELECT id AS unit_id, round(sqrt({dot('v', 'v')}), 6) AS norm, CAST(len([x FOR x IN v IF abs(x) >= 0.1::DOUBLE]) AS BIGINT) AS n_large FROM usable",
    "vector_upsert": """
WITH parts AS (SELECT *, written_at >= TIMESTAMP '2025-12-25 00:00:00' AS late FROM (SELECT DISTINCT * FROM vectors)),
last AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY unit_id, late ORDER BY written_at DESC, dim DESC NULLS LAST, v_min DESC NULLS LAST, v_max DESC NULLS LAST, data DESC NULLS LAST) = 1)
SELECT unit_id, dim, written_at FROM last QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY late DESC) = 1""",
    "callers": f"""
WITH {UNITS}, {EDGES}, popular AS (SELECT callee_name FROM edges GROUP BY callee_name ORDER BY count(*) DESC, callee_name LIMIT 1)
SELECT id, name, file_path, line_start FROM units WHERE id IN (SELECT caller_id FROM edges WHERE callee_name = (SELECT callee_name FROM popular)) ORDER BY id LIMIT 10""",
    "callees": f"""
WITH {UNITS}, {EDGES}, first AS (SELECT min(caller_id) AS id FROM edges WHERE caller_id IN (SELECT id FROM units) AND callee_name IN (SELECT name FROM units))
SELECT id, name, file_path, line_start FROM units WHERE name IN (SELECT callee_name FROM edges WHERE caller_id = (SELECT id FROM first)) ORDER BY id LIMIT 10""",
    "search_context": f"""
WITH {bm25(QUERY_WORDS)}, {TOP}, {EDGES},
calling AS (SELECT DISTINCT t.id, u.id AS other_id, u.name AS other_name FROM top t JOIN edges e ON e.callee_name = t.name JOIN units u ON u.id = e.caller_id QUALIFY dense_rank() OVER (PARTITION BY t.id ORDER BY u.id) <= 10),
called AS (SELECT DISTINCT t.id, u.id AS other_id, u.name AS other_name FROM top t JOIN edges e ON e.caller_id = t.id JOIN units u ON u.name = e.callee_name QUALIFY dense_rank() OVER (PARTITION BY t.id ORDER BY u.id) <= 10)
SELECT t.id, coalesce(a.names, '') AS callers, coalesce(b.names, '') AS callees FROM top t
LEFT JOIN (SELECT id, {NEIGHBOURS} AS names FROM calling GROUP BY id) a ON a.id = t.id LEFT JOIN (SELECT id, {NEIGHBOURS} AS names FROM called GROUP BY id) b ON b.id = t.id""",
    "unused_functions": f"WITH {UNITS}, {EDGES} SELECT id, name, unit_type, file_path, line_start FROM units u WHERE unit_type IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.callee_name = u.name)",
    "unused_report": f"""
WITH {UNITS}, {EDGES}, unused AS (SELECT id, name, unit_type, file_path, line_start FROM units u WHERE unit_type IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.callee_name = u.name))
SELECT file_path, string_agg('  ' || line_start || '  ' || name || '  ' || unit_type, chr(10) ORDER BY line_start, id) AS text FROM unused GROUP BY file_path""",
    "orphan_edges": f"WITH {EDGES} SELECT * FROM edges WHERE caller_id NOT IN (SELECT id FROM code_units)",
    "live_edges": f"WITH {EDGES} SELECT * FROM edges WHERE caller_id IN (SELECT id FROM code_units)",
    "edges_from_units": f"WITH {UNITS} SELECT id AS caller_id, unnest(calls) AS callee_name, line_start AS line_number FROM units",
    "unit_at_line": f"""
WITH {UNITS}, {EDGES}, places AS (SELECT DISTINCT u.repo, u.file_path, e.line_number AS line FROM edges e JOIN units u ON u.id = e.caller_id)
SELECT repo, file_path, line, u.id, u.name FROM places p JOIN units u USING (repo, file_path) WHERE line BETWEEN line_start AND line_end
QUALIFY row_number() OVER (PARTITION BY repo, file_path, line ORDER BY line_end - line_start, u.id) = 1""",
    "popularity": f"WITH {UNITS}, {EDGES}, d AS (SELECT callee_name, count(DISTINCT caller_id) AS n FROM edges GROUP BY callee_name) SELECT id, name, coalesce(n, 0) AS n_callers FROM units LEFT JOIN d ON name = callee_name",
    "federated_search": f"""
WITH {bm25(QUERY_WORDS)}, o AS (SELECT name AS repo, row_number() OVER (ORDER BY added_at, name) AS ordinal FROM repos),
best AS (SELECT s.id, score, name, repo, ordinal FROM scores s JOIN units USING (id) JOIN o USING (repo) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY {ORDER}) <= 25),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {ORDER}) - 1 AS lexical_rank, {name_score("'" + QUERY + "'", "name")} AS ns FROM best),
n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(ns, 9) DESC, lexical_rank) - 1 AS name_rank FROM r),
f AS (SELECT id, repo, ordinal, name, lexical_rank, 1000 * ({TWO_WAY}) AS score FROM n),
g AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(score, 9) DESC, lexical_rank) AS in_repo FROM f),
p AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, ordinal, in_repo) AS place FROM g),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY place) = 1 ORDER BY place LIMIT 25)
SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS rank, repo, id, round(score, 6) AS score, name FROM k""",
    "find_similar": f"""
WITH {UNITS}, {RECORDS}, place AS (SELECT repo, file_path, line_start FROM units WHERE id IN (SELECT id FROM usable) ORDER BY id LIMIT 1),
own AS (SELECT u.id, u.name, u.file_path FROM units u JOIN place p ON u.repo = p.repo AND u.file_path = p.file_path WHERE p.line_start BETWEEN u.line_start AND u.line_end ORDER BY u.line_end - u.line_start, u.id LIMIT 1),
oq AS (SELECT v AS qv, own.name AS own_name, own.file_path AS own_path FROM usable JOIN own USING (id)),
near AS (SELECT x.id, {SIMILARITY} AS score, own_name, own_path FROM usable x, oq),
best AS (SELECT n.*, u.repo, u.name, u.file_path, u.body FROM near n JOIN units u USING (id) QUALIFY row_number() OVER (PARTITION BY u.repo ORDER BY round(score, 9) DESC, n.id) <= 20),
p AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, repo, id) AS place FROM best WHERE NOT (name = own_name AND file_path = own_path)),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY name, left(body, 80) ORDER BY place) = 1 ORDER BY place LIMIT 20)
SELECT repo, id, round(score, 6) AS similarity, name, file_path FROM k""",
    "dedup_fingerprint": f"WITH {UNITS} SELECT id, name FROM units QUALIFY row_number() OVER (PARTITION BY name, encode(body)[1:80] ORDER BY id) = 1",
    "repo_rollup": f"WITH {UNITS} SELECT repo, count(DISTINCT file_path) AS n_files, count(*) AS n_units, count(*) FILTER (unit_type IN ('function', 'method')) AS n_functions, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages FROM units GROUP BY repo",
    "cached_vectors": f"WITH {UNITS}, {FILES}, {RECORDS} SELECT file_hash, min(id) AS unit_id FROM units JOIN files USING (repo, file_path) WHERE file_hash IS NOT NULL AND id IN (SELECT unit_id FROM records WHERE dim = 96 AND len(data) = 96) GROUP BY file_hash",
    "stats_by_type": f"WITH {UNITS} SELECT unit_type, count(*) AS n FROM units GROUP BY unit_type",
    "stats_by_language": f"WITH {UNITS} SELECT language, count(*) AS n, CAST(count(*) * 100 // (SELECT count(*) FROM units) AS BIGINT) AS percent FROM units GROUP BY language",
    "stats_summary": f"""
WITH {UNITS}, {EDGES}
SELECT count(*) AS n_units, count(*) FILTER (coalesce(docstring, '') <> '') AS n_documented, count(*) FILTER (has_embedding) AS n_embedded, min(embedding_model) AS embedding_model,
  (SELECT count(*) FROM (SELECT DISTINCT repo, file_path FROM file_index)) AS n_files, (SELECT max(last_indexed) FROM file_index) AS last_indexed, (SELECT count(*) FROM edges) AS n_edges,
  CAST(count(*) FILTER (has_embedding) * 100 // count(*) AS BIGINT) AS coverage FROM units""",
    "cdc_classify": f"""
WITH {LISTING}, {FILES}
SELECT coalesce(l.repo, f.repo) AS repo, coalesce(l.file_path, f.file_path) AS file_path, coalesce(l.file_hash, f.file_hash) AS file_hash,
  CASE WHEN f.repo IS NULL THEN 'new' WHEN l.repo IS NULL THEN 'deleted' WHEN l.file_hash = f.file_hash THEN 'same' ELSE 'changed' END AS change
FROM listing l FULL JOIN files f ON l.repo = f.repo AND l.file_path = f.file_path""",
    "cdc_counters": f"""
WITH {LISTING}, {FILES}, c AS (
SELECT CASE WHEN f.repo IS NULL THEN 'new' WHEN l.repo IS NULL THEN 'deleted' WHEN l.file_hash = f.file_hash THEN 'same' ELSE 'changed' END AS change
FROM listing l FULL JOIN files f ON l.repo = f.repo AND l.file_path = f.file_path)
SELECT count(*) FILTER (change IN ('new', 'changed')) AS indexed, count(*) FILTER (change = 'same') AS skipped, count(*) FILTER (change = 'deleted') AS removed, (SELECT count(DISTINCT id) FROM code_units) AS new_units FROM c""",
    "missing_files": f"WITH {LISTING}, {FILES} SELECT repo, file_path FROM files f WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.repo = f.repo AND l.file_path = f.file_path)",
    "files_after_run": f"""
WITH {LISTING}, {FILES}, fresh AS (SELECT l.* FROM listing l LEFT JOIN files k ON l.repo = k.repo AND l.file_path = k.file_path WHERE {CHANGED})
SELECT repo, file_path, file_hash FROM files f WHERE NOT EXISTS (SELECT 1 FROM fresh l WHERE l.repo = f.repo AND l.file_path = f.file_path) UNION ALL SELECT repo, file_path, file_hash FROM fresh""",
    "units_after_cleanup": f"""
WITH {UNITS}, {LISTING}, {FILES}, gone AS (SELECT repo, file_path FROM files f WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.repo = f.repo AND l.file_path = f.file_path))
SELECT repo, file_path, id FROM units u WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo = u.repo AND g.file_path = u.file_path)""",
    "unit_diff": f"WITH {UNITS} SELECT DISTINCT repo, file_path, name, line_start, 'modified' AS change FROM units WHERE contains(body, chr(13) || chr(10))",
    "modified_since": f"WITH {UNITS} SELECT id, file_path FROM units WHERE file_path IN (SELECT file_path FROM file_index WHERE last_indexed >= {EPOCH})",
    "rrf_popular": f"""
WITH {bm25(QUERY_WORDS)}, {TOP}, {RANKED}, {EDGES},
callers AS (SELECT callee_name, count(DISTINCT caller_id) AS n FROM edges WHERE callee_name IS NOT NULL GROUP BY callee_name),
popular AS (
  SELECT b.*, coalesce(n, 0) AS n_callers, CAST(row_number() OVER (ORDER BY coalesce(n, 0) DESC, id) - 1 AS INT) AS popularity_rank FROM both_ranks b LEFT JOIN callers ON b.name = callee_name),
fused AS (SELECT *, 1000.0::DOUBLE * ({TWO_WAY} + 1.0::DOUBLE / (60.0::DOUBLE + popularity_rank + 1)) AS fused FROM popular)
SELECT CAST(row_number() OVER (ORDER BY round(fused, 9) DESC, lexical_rank) AS INT) AS rank, id, round(fused, 6) AS score, n_callers, popularity_rank FROM fused""",
    "search_json": f"""
WITH {bm25(QUERY_WORDS)}, {TOP},
shown AS (SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS INT) AS rank, * FROM top)
SELECT rank, CAST(json_object('rank', rank, 'score', round(score, 6), 'name', name, 'unit_type', unit_type, 'language', language, 'file_path', file_path, 'line_start', line_start, 'line_end', line_end,
  'signature', nullif(full_signature, ''), 'docstring', nullif(docstring, ''), 'snippet', {SNIPPET}) AS VARCHAR) AS json FROM shown""",
    "search_csv": f"""
WITH {bm25(QUERY_WORDS)}, {TOP}
SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS rank,
  row_number() OVER (ORDER BY {ORDER}) || ',' || printf('%.4f', score) || ',' || {CSV_FIELD.format('name')} || ',' || unit_type || ',' || language || ',' || {CSV_FIELD.format('file_path')} || ',' || line_start AS csv FROM top""",
    "search_plain": f"""
WITH {bm25(QUERY_WORDS)}, {TOP}
SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS rank, file_path || ':' || line_start || '  ' || name || '  ' || unit_type || ' · ' || language || chr(10) || '  ' || trim(string_split({SNIPPET}, chr(10))[1]) AS text FROM top""",
    "debounce_batches": f"WITH {DEBOUNCE} SELECT repo, batch, count(*) AS n, min(observed_at) AS first_at, max(observed_at) AS last_at FROM batches GROUP BY repo, batch",
    "coalesce_batches": f"WITH {DEBOUNCE} SELECT repo, batch, bool_or(event_kind = 'gone') AS check_all, CASE WHEN bool_or(event_kind = 'gone') THEN '' ELSE array_to_string(list_sort(list_distinct(list(file_path))), ',') END AS paths FROM batches GROUP BY repo, batch",
    "watched_events": rf"""
WITH plain AS (SELECT scan_id, {PLAIN_PATH} AS file_path FROM file_scan)
SELECT DISTINCT scan_id, file_path FROM plain WHERE len([s FOR s IN string_split(file_path, '/') IF s IN ({in_list(heuristics.BLOCKED_FOLDERS)})]) = 0
  AND regexp_extract(file_path, '\.([^./]+)$', 1) IN ({in_list([e for own in EXTENSIONS.values() for e in own])})""",
    "stream_upsert": "SELECT repo, file_path, observed_at, scan_id, event_kind FROM file_scan QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY observed_at DESC, scan_id DESC, event_kind DESC) = 1",
    "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
SQL["stored_search_many"] = SQL["stored_search"]
SQL["near_copy_vectors"] = f"""
WITH {RECORDS}, lengths AS (SELECT id, v, sqrt({dot('v', 'v')}) AS length FROM usable)
SELECT b.id AS unit_id, min(a.id) AS copy_of FROM lengths a JOIN lengths b ON a.id < b.id AND a.length > 0 AND b.length > 0 AND round(list_inner_product(a.v, b.v) / (a.length * b.length), 6) >= 0.99 GROUP BY b.id"""
SQL["similar_percent"] = f"SELECT id, CAST(CAST(floor(greatest(similarity, 0) * 100 + 1e-9) AS BIGINT) AS VARCHAR) || '%' AS percent FROM ({SQL['find_similar']})"
