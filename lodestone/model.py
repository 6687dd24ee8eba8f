"""Schemas of the tables of an index."""

from __future__ import annotations

UNITS = (
    "repo string, id bigint, file_path string, language string, unit_type string, name string, full_signature string, docstring string, line_start int, line_end int, body string, "
    "parameters array<string>, return_type string, calls array<string>, imports array<string>, complexity int, has_embedding boolean, embedding_model string"
)
EDGES = "caller_id bigint, callee_name string, line_number int"
FILES = "repo string, file_path string, file_hash string, last_indexed bigint, needs_reindex boolean"
VECTORS = "unit_id bigint, dim int, v_min float, v_max float, data array<smallint>"
POSTINGS = "term string, field string, id bigint, positions array<int>, field_length int"
TOTALS = "field string, n_units bigint, n_terms bigint"

TABLES = {"units": UNITS, "edges": EDGES, "files": FILES, "vectors": VECTORS, "postings": POSTINGS, "totals": TOTALS}

# What a segment takes out of those before it.
GONE = "repo string, file_path string"
DEAD = "id bigint"

#: The column of each table by which rows of older segments are dead.
OWNER = {"units": "id", "edges": "caller_id", "vectors": "unit_id", "postings": "id"}
