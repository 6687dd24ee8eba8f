"""Generated, minified, vendored and data files, so that only hand-written source remains.

A file counts by its path (folders of third parties and of tools' output, names that tools
give) or by one of its bodies: a marker in the comment it begins with, or its layout. Layout
statistics of every body are made in numpy over flat byte arrays: maximum and mean line
length, shares of white space and of alphanumeric characters, density of numeric literals,
the longest encoded run, lines that are rows of numbers, and the longest run of lines of one
shape that begin with the same word. Thresholds are kept per language.

Null paths and bodies show nothing; a file without bodies is judged by its path. Repeated
rows and files named in both tables come once. Backslashes in paths count as slashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import word_keys
from lodestone.session import ship

PART_BYTES = 1 << 20

# First words of lines that people write in rows too: declarations, imports, branches, logging.
ROW_WORDS = "private public protected internal static final readonly const constexpr let var val auto fn pub func def type field import from use using include require export package return if elif else for while case when match switch break continue throw raise assert yield await self this super console logger log LOG debug info warn print println printf fmt std new class struct enum interface trait impl int long short float double bool boolean char string String void unsigned".split()

# Folders of third-party code, folders of tools' output, folders of generators and builds.
VENDORED_FOLDERS = ["node_modules", "bower_components", "jspm_packages", "vendor", "_vendor", "third_party", "thirdparty", "third-party", "3rdparty", "3rd_party", "external", "externals", "extern", "deps", "godeps", "site-packages", "dist-packages", "pods", "carthage"]
GENERATED_FOLDERS = ["generated", "__generated__", "_generated", "generated-sources", "generated_sources", "autogen", "auto_generated", "gen", "dist", "gensrc", "gen-src"]
OWN_GENERATORS = ["tools", "scripts", "script", "bin", "hack", "devtools"]

# Endings of names that tools give, with the languages they are used in.
GENERATED_NAMES = r"(?i:[._]generated\.\w+$|\.(gen|pb|g|moc|auto|designer)\.\w+$|[.-]min\.(js|mjs|cjs|css)$|\.(bundle|chunk|packed)\.(js|mjs|cjs)$|^moc_\w+\.cpp$|^zz_generated\b)|_pb\.(js|ts|d\.ts)$|_pb2(_grpc)?\.pyi?$|(Grpc|OuterClass)\.java$|_(gen|string|enumer|easyjson)\.go$|\.d\.ts$"

# What the comment at the top of a file says of its making: that something made it, that it must not be changed or that changes
# get lost, or where it was taken from. The words are fixed values; how they stand together is what counts.
MADE = r"@generated\b|\bauto-?generated\b(?!\s+(?:method|constructor|catch|function)\b)|\bmachine[- ](?:made|generated)\b|(?:^\W*|\b(?:code|file|was|is|fichier|automatically|automatisch)\s+)(?:generated|produced|emitted|transpiled|erzeugt|generiert|généré|produit|generado)\s+(?:by|from|with|using|automatically|aus|par|por|de|desde)\b|<auto-?generated|\b(?:generado|erzeugt|généré) autom"
KEPT_OUT = r"\b(?:do not|don't) (?:edit|modify)\b|\bnicht (?:hier )?(?:bearbeiten|ändern)\b|\bne pas (?:modifier|éditer)\b|\bno (?:editar|modificar)\b"
LOST = r"\b(?:changes|edits|modifications|patches)\s+(?:\w+\s+){0,2}(?:lost|vanish|overwritten|discarded)\b|\bchanges are not applied\b|\bpatches go to the\b|\b(?:re|over)writes this file\b"
TAKEN = r"^\W*(?:vendored|imported|copied|bundled|mirrored|taken)\s+(?:\w+\s+){0,2}(?:from|of|copy)\b|\bbundled copy of\b|\bthird[- ]party:|\bfremdbibliothek\b"
MARKERS = re.compile(f"(?i){MADE}|{KEPT_OUT}|{LOST}|{TAKEN}")
STUB = re.compile(r"(?i)auto-?generated (method|constructor|catch|function) (stub|block)")

#: Layout thresholds. line: characters of a minified line; mean: mean line length of such a body; white: most white
#: space of it; literal: characters of a literal that is all of a body; encoded: characters of an encoded run;
#: digits: share of numeric literals among the words of a table; rows: its rows; same: lines of one shape.
DEFAULT = {"line": 400, "mean": 160, "white": 0.12, "literal": 250, "encoded": 250, "digits": 0.6, "rows": 5, "same": 6}
PER_LANGUAGE = {
    "javascript": {"line": 320, "mean": 140},
    "typescript": {"line": 320, "mean": 140},
    "python": {"line": 500, "white": 0.08},
    "java": {"line": 500},
    "go": {"line": 500},
    "rust": {"line": 500},
    "cpp": {"line": 500},
}

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[range(48, 58)] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ENCODED = np.zeros(256, bool)
ENCODED[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 61]] = True


def path_kind(path: Column) -> Column:
    """``vendored``, ``generated`` or null, as the path shows."""
    plain = F.regexp_replace(path, r"\\", "/")
    low = F.lower(plain)
    folders = F.filter(F.slice(F.split(low, "/"), 1, F.greatest(F.size(F.split(low, "/")) - 1, F.lit(0))), lambda s: s != "")
    vendored = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in VENDORED_FOLDERS]))
    # a folder of output, unless it stands in one of tools: that holds the generator or the build
    output = F.exists(F.sequence(F.lit(1), F.greatest(F.size(folders), F.lit(1))), lambda i: F.coalesce(F.get(folders, i - 1).isin(GENERATED_FOLDERS) & ~F.coalesce(F.get(folders, i - 2).isin(OWN_GENERATORS), F.lit(False)), F.lit(False)))
    name = F.element_at(F.split(plain, "/"), -1)
    return F.when(vendored, "vendored").when(output | name.rlike(GENERATED_NAMES), "generated")


def _spelled(words: list[str]) -> np.ndarray:
    """Keys of words, as ``layout`` makes them of the first word of a line."""
    ends = np.cumsum([len(w.encode()) for w in words])
    begins = np.append(0, ends[:-1])
    return np.sort(word_keys(np.frombuffer("".join(words).encode(), np.uint8), begins, ends))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _longest(flags: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Longest run of true flags of each owner; runs end with their owner."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    out = np.zeros(n, np.int64)
    np.maximum.at(out, owner[begin], end - begin)
    return out


def layout(bodies: list[bytes]) -> dict[str, np.ndarray]:
    """Layout statistics of each body."""
    count = len(bodies)
    whole = b"\n".join([*bodies, b""])
    raw = np.frombuffer(whole, np.uint8)
    n = len(raw)
    sizes = np.fromiter(map(len, bodies), np.int64, count) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.flatnonzero(raw == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    length = ends - begins
    of = np.searchsorted(bounds, begins, side="right") - 1
    lines = np.bincount(of, minlength=count)
    first_line = np.concatenate([[0], np.cumsum(lines)])[:-1]
    word, digit, space = WORD[raw], DIGIT[raw], SPACE[raw]
    # a point between digits belongs to the number
    dot = np.flatnonzero(raw[1:-1] == 46) + 1
    dot = dot[digit[dot - 1] & digit[dot + 1]]
    word = word.copy()
    word[dot] = True
    starts = word & ~np.concatenate([[False], word[:-1]])
    at = np.flatnonzero(starts)
    words, numbers = _sums(starts, bounds), _sums(starts & digit, bounds)
    # shape of a line: words as one sign, white space left out; first word of a line
    kept = starts | (~word & ~space)
    order = np.cumsum(kept) - 1
    signs = np.where(starts, 1, raw.astype(np.uint32) + 2)
    before = np.concatenate([[0], order + 1])
    lo, hi = before[begins], before[ends]
    shape = word_keys(signs[kept].astype(np.uint64), lo, hi)
    signs_in = hi - lo
    word_end = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    k = np.minimum(np.searchsorted(at, begins), max(0, len(at) - 1))
    if len(at):
        has = (at[k] >= begins) & (at[k] < ends)
        first = np.where(has, word_keys(raw, at[k] * has, word_end[k] * has), np.uint64(0))
    else:
        first = np.zeros(len(begins), np.uint64)
    full = np.flatnonzero(signs_in >= 4)  # lines of less than four signs, as lone braces, end no run and make none
    same = np.zeros(len(full), bool)
    shape, first, full_of = shape[full], first[full], of[full]
    same[1:] = (shape[1:] == shape[:-1]) & (first[1:] == first[:-1]) & (full_of[1:] == full_of[:-1]) & ~np.isin(first[1:], _spelled(ROW_WORDS))
    run = _longest(same, full_of, count)
    run = np.where(2 * (run + 1) >= np.bincount(full_of, minlength=count), run, 0)
    line_words = np.concatenate([[0], np.cumsum(starts)])
    line_numbers = np.concatenate([[0], np.cumsum(starts & digit)])
    lw, ln = line_words[ends] - line_words[begins], line_numbers[ends] - line_numbers[begins]
    rows = np.bincount(of[(ln >= 5) & (ln >= lw - 1)], minlength=count)
    owner_of_byte = np.repeat(np.arange(count), sizes)
    return {
        "n_chars": sizes - 1,
        "n_lines": lines,
        "max_line": np.maximum.reduceat(length, first_line) if count else lines,
        "mean_line": (sizes - 1) / np.maximum(1, lines),
        "white_share": (_sums(space, bounds) - 1) / np.maximum(1, sizes - 1),
        "alnum_share": _sums(word, bounds) / np.maximum(1, sizes - 1),
        "number_density": numbers / np.maximum(1, words),
        "number_rows": rows,
        "encoded_run": _longest(ENCODED[raw], owner_of_byte, count),
        "same_lines": np.where(run > 0, run + 1, 0),
    }


COMMENT_LINE = re.compile(r"\s*(//|#(?!\[|!\[|include|define|pragma|if|end)|/\*|\*|<!--|--)")
DOC_LINE = re.compile(r"\s*(///|//!|/\*\*)")


def marked(body: str) -> bool:
    """Whether the comment that a body begins with says it was generated or vendored."""
    if body[:1] not in "#/*<-; \t\r\n﻿":
        return False
    for line in body.lstrip("﻿ \t\r\n").split("\n"):
        if not COMMENT_LINE.match(line):
            return False
        if not DOC_LINE.match(line) and MARKERS.search(line) and not STUB.search(line):
            return True
    return False


LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`')
DOC_LITERAL = re.compile(r'"""(?s:.*?)"""|\'\'\'(?s:.*?)\'\'\'')
IDLE_LINE = re.compile(r"\s*(?:$|//|#|/\*|\*|@|[\])}{(;,]+\s*$)")


def all_literal(body: str, least: int) -> bool:
    """Whether a body is one long literal and nothing else but its header, its return and comments."""
    code = DOC_LITERAL.sub(lambda m: "" if len(m.group()) < 4 * least else '"' + "x" * len(m.group()) + '"', body)
    longest = max(map(len, LITERAL.findall(code)), default=0)
    if longest < least:
        return False
    rest = LITERAL.sub(lambda m: '"\x00"' if len(m.group()) >= least else '""', code)
    statements = [x for x in rest.split("\n") if not IDLE_LINE.match(x)]
    header = 0 if statements and "\x00" in statements[0] else 1
    return all("\x00" in x for x in statements[header:])


def body_kind(body: str, stats: dict[str, float], language: str | None) -> str | None:
    """``generated``, ``minified``, ``data`` or None for one body with its statistics."""
    t = DEFAULT | PER_LANGUAGE.get(language or "", {})
    if marked(body):
        return "generated"
    if stats["number_rows"] >= t["rows"] and stats["number_density"] >= t["digits"]:
        return "data"
    if stats["same_lines"] >= t["same"]:
        return "generated"
    if (stats["max_line"] >= t["literal"] or stats["encoded_run"] >= t["encoded"]) and all_literal(body, t["literal"]):
        return "data"
    if stats["max_line"] >= t["line"] and stats["white_share"] <= t["white"] and stats["alnum_share"] <= 0.9:
        code = LITERAL.sub("", body)
        longest = max(map(len, code.split("\n")))
        if longest >= t["line"] and len(code) / max(1, code.count("\n") + 1) >= t["mean"]:
            return "minified"
    return None


def body_kinds(units: DataFrame) -> DataFrame:
    """(repo, file_path, kind) of the bodies that show what their file is, with their layout. No shuffle."""
    ship(units.sparkSession)
    keys = ["number_rows", "number_density", "same_lines", "max_line", "encoded_run", "white_share", "alnum_share", "mean_line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            raw = [t.encode("utf-8", "replace") for t in texts]
            languages = batch.column(2).to_pylist()
            begin = size = 0
            for i, body in enumerate(raw):
                size += len(body)
                if size < PART_BYTES and i < len(raw) - 1:
                    continue
                stats = layout(raw[begin : i + 1])
                picked, kinds = [], []
                least = min(x.get("literal", DEFAULT["literal"]) for x in [DEFAULT, *PER_LANGUAGE.values()])
                head = np.array([t[:1] in "#/*<-; \t\r\n﻿" for t in texts[begin : i + 1]])
                maybe = head | (stats["number_rows"] >= DEFAULT["rows"]) | (stats["same_lines"] >= DEFAULT["same"]) | (stats["max_line"] >= least) | (stats["encoded_run"] >= DEFAULT["encoded"])
                for j in np.flatnonzero(maybe).tolist():
                    kind = body_kind(texts[begin + j], {k: stats[k][j] for k in keys}, languages[begin + j])
                    if kind:
                        picked.append(begin + j)
                        kinds.append(kind)
                at = pa.array(picked, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(kinds, pa.string())], names=["repo", "file_path", "kind"])
                begin, size = i + 1, 0

    return units.select("repo", "file_path", "language", "body").where("body IS NOT NULL").mapInArrow(run, "repo string, file_path string, kind string")


def not_handwritten(index: DataFrame, units: DataFrame) -> DataFrame:
    """(repo, file_path, kind) of every file of either table that is not hand-written source.

    Only paths and the few kinds found are shuffled, never bodies.
    """
    paths = index.select("repo", "file_path").unionByName(units.select("repo", "file_path")).where("file_path IS NOT NULL").distinct()
    by_path = paths.withColumn("kind", path_kind(F.col("file_path"))).where("kind IS NOT NULL")
    return by_path.unionByName(body_kinds(units).where("file_path IS NOT NULL")).groupBy("repo", "file_path").agg(F.min("kind").alias("kind"))
