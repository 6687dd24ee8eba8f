"""Scalar functions over paths, names and texts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of the supported languages.
EXTENSIONS = {
    "python": ["py"],
    "rust": ["rs"],
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "go": ["go"],
    "java": ["java"],
    "cpp": ["cpp", "cc", "cxx", "c", "h", "hpp"],
}
LANGUAGES = [*EXTENSIONS, "unknown"]
UNIT_TYPES = ["function", "method", "class", "struct", "enum", "interface", "trait", "module"]

# Characters that the query language gives a meaning.
QUERY_SPECIAL = '\\+-!(){}[]^"~*?:'

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_TOKEN_BYTES = 40


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def extension_language(extension: Column) -> Column:
    """Language of a file extension (case-sensitive), else unknown."""
    out = F.lit(None).cast("string")
    for language, extensions in EXTENSIONS.items():
        out = F.when(extension.isin(extensions), language).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def path_language(path: Column) -> Column:
    return extension_language(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def known_language(name: Column) -> Column:
    """The name itself if it is a supported language, else unknown."""
    return F.when(name.isin(LANGUAGES), name).otherwise("unknown")


def is_test_file(path: Column) -> Column:
    """Whether the path is a test's, as the lexical search sees it. A root folder ``tests/`` is none."""
    return ascii_lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(r"/tests?/|/specs?/|_test\.|\.test\.|\.spec\.|/test_|^test_")


def is_test_file_semantic(path: Column) -> Column:
    """Whether the path is a test's, as the semantic search sees it."""
    return path.contains("/test") | path.contains("_test.") | path.contains(".test.") | path.contains("spec.")


def snippet(signature: Column, docstring: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(signature, F.lit("")), F.nullif(docstring, F.lit("")), name)


def body_fingerprint(name: Column, body: Column) -> Column:
    """Name and first 80 bytes of the body, as bytes; a character that they cut counts by its first bytes."""
    return F.concat(F.encode(name, "UTF-8"), F.lit(b"\0"), F.substring(F.encode(F.coalesce(body, F.lit("")), "UTF-8"), 1, 80))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, shorter than 40 bytes, in order."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(runs, lambda t: F.octet_length(t) < MAX_TOKEN_BYTES)


def tokenize(text: str) -> list[str]:
    """The same on the driver, for query texts."""
    return [t for t in re.findall(r"[^\W_]+", text.lower()) if len(t.encode()) < MAX_TOKEN_BYTES]


def embed_text(name: Column, body: Column) -> Column:
    return F.concat(F.lit("name: "), name, F.lit("\n"), body)


def escape_query(query: str) -> str:
    return "".join("\\" + c if c in QUERY_SPECIAL else c for c in query)


def parse_file_line(text: str) -> tuple[str, int]:
    """``FILE:LINE`` to its parts; the last colon counts."""
    file, colon, line = text.rpartition(":")
    if not colon or not file:
        raise ValueError(f"expected FILE:LINE, got {text!r}")
    if not line.isdigit():
        raise ValueError(f"not a line number: {line!r}")
    return file, int(line)


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; paths elsewhere stay as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


# --- presentation ----------------------------------------------------------------------------------------------


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def size_text(n: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n == 0, "—")
        .when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, F.format_string("%.1f KB", F.bround(n / kb, 1)))
        .when(n < gb, F.format_string("%.1f MB", F.bround(n / mb, 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(n / gb, 2)))
    )


def percent_bar(percent: Column, width: int) -> Column:
    filled = F.least(F.floor(percent * width / 100).cast("int"), F.lit(width))
    return F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled), F.lit("]"))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("bigint").cast("string")


def age_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 0, "just now")
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(_div(seconds, 60), F.lit("m ago")))
        .when(seconds < 86400, F.concat(_div(seconds, 3600), F.lit("h "), _div(seconds % 3600, 60), F.lit("m ago")))
        .otherwise(F.concat(_div(seconds, 86400), F.lit("d ago")))
    )


def duration_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(_div(seconds, 60), F.lit("m"), (seconds % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(_div(seconds, 3600), F.lit("h"), _div(seconds % 3600, 60), F.lit("m")))
    )


def integer_percent(part: Column, whole: Column) -> Column:
    """Truncated; 0 of nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 100 / whole)).cast("bigint")


def days_before(now_seconds: int, days: int) -> int:
    return now_seconds - days * 86400


def similarity_percent(similarity: Column) -> Column:
    """A similarity as whole percent, ``97%``; below zero counts as none."""
    return F.concat(F.floor(F.greatest(similarity, F.lit(0.0)) * 100 + F.lit(1e-9)).cast("string"), F.lit("%"))


def parse_bool(text: str) -> bool:
    low = text.lower()
    if low in ("true", "yes", "1", "on"):
        return True
    if low in ("false", "no", "0", "off"):
        return False
    raise ValueError(f"expected true/false, got {text!r}")


def csv_field(value: Column) -> Column:
    """Quoted only where a comma, quote or line end asks for it."""
    return F.when(value.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def version_is_newer(a: str, b: str) -> bool:
    """Whether version ``a`` is newer than ``b``; missing or bad parts count as 0."""

    def triple(v: str) -> list[int]:
        parts = [int(p) if p.isdigit() else 0 for p in v.lstrip("v").split(".")[:3]]
        return parts + [0] * (3 - len(parts))

    return triple(a) > triple(b)


def list_to_json(values: Column) -> Column:
    return F.to_json(values)


def list_from_json(text: Column) -> Column:
    """A list of strings; bad or missing JSON becomes an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
