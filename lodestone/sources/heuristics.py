"""Which files of a working tree are source to be indexed: rules over paths, sizes and first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import EXTENSIONS

# Folders never entered, beginnings of such names, endings of file names skipped.
BLOCKED_FOLDERS = [".lodestone", ".git", ".svn", ".hg", ".idea", ".vscode", "__pycache__", "target", ".DS_Store"]
BLOCKED_PREFIXES = ["dist-", "build-", ".cache-", "bazel-"]
BLOCKED_SUFFIXES = [".d.ts", ".d.mts", ".d.cts", ".min.js", ".min.mjs", ".min.css", ".bundle.js", ".chunk.js", ".pb.go", ".pb.js", ".pb.ts", "_pb.js", "_pb.d.ts", ".generated.ts", ".generated.go", ".generated.js", ".gen.go", ".gen.ts"]
# Texts in the first bytes of generated files.
GENERATED_MARKERS = [
    "// Code generated",
    "// DO NOT EDIT",
    "// This file is auto-generated",
    "// This file was automatically generated",
    "// AUTO-GENERATED FILE",
    "// AUTOGENERATED FILE",
    "// Generated by",
    "/* Generated by",
    "/* eslint-disable */",
    "# This file is auto-generated",
    "# DO NOT EDIT",
    "# Generated by",
    "# GENERATED FILE",
    "// Generated by the protocol buffer compiler",
    "@javax.annotation.Generated",
    "@jakarta.annotation.Generated",
    "* Do not edit the class manually",
    "* @auto-generated",
]
MAX_BYTES, MAX_LINES, HEAD_BYTES, MAX_LINE_BYTES = 1_000_000, 10_000, 512, 500
IGNORE_FILES = (".gitignore", ".ignore", ".lodestoneignore")


def is_blocked_folder(name: str) -> bool:
    return name in BLOCKED_FOLDERS or name.startswith(tuple(BLOCKED_PREFIXES))


def in_blocked_folder(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    blocked = lambda s: s.isin(BLOCKED_FOLDERS) | F.coalesce(s.rlike("^(" + "|".join(p.replace(".", r"\.") for p in BLOCKED_PREFIXES) + ")"), F.lit(False))
    return F.exists(folders, blocked)


def has_blocked_suffix(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.lit(False)
    for suffix in BLOCKED_SUFFIXES:
        out = out | name.endswith(suffix)
    return out


def has_supported_extension(path: Column) -> Column:
    """The case of the extension counts."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1).isin([e for own in EXTENSIONS.values() for e in own])


def has_fit_size(length: Column) -> Column:
    return length.between(1, MAX_BYTES)


def head_is_source(content: Column) -> Column:
    """The first 512 bytes hold no NUL, are UTF-8, and have neither marker nor a line of over 500 bytes."""
    head = F.substring(content, 1, HEAD_BYTES)
    text = F.make_valid_utf8(head.cast("string"))
    ok = F.is_valid_utf8(head.cast("string")) & ~text.contains("\0")
    for marker in GENERATED_MARKERS:
        ok = ok & ~text.contains(marker)
    return ok & ~F.exists(F.split(text, "\n"), lambda line: F.octet_length(F.rtrim(line)) > MAX_LINE_BYTES)


def within_line_limit(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) < MAX_LINES


def source_files(listing: DataFrame) -> DataFrame:
    """Rows of (file_path, length, content) that the index takes in."""
    return listing.where(~in_blocked_folder(F.col("file_path")) & ~has_blocked_suffix(F.col("file_path")) & has_supported_extension(F.col("file_path")) & has_fit_size(F.col("length")) & head_is_source(F.col("content")))
