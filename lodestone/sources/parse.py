"""Code units and their calls from source texts.

Python goes through the standard parser, and by indents where a file has syntax errors. The
brace languages share a scanner: strings and comments are blanked, declarations found by
pattern, bodies by matching braces. One function, ``parse_units``, is the place to put a full
grammar instead. Equality with a grammar on arbitrary code is not claimed.

Per language: Python methods count as functions, nested functions count; Rust looks into
``impl`` and ``mod`` but not into functions and traits; JavaScript and TypeScript into
classes; Go at the top level only; Java into types; C++ into classes and namespaces. Texts
of ten thousand lines or more and unknown languages give no units.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship
from lodestone.sources.heuristics import MAX_LINES


@dataclass
class Unit:
    unit_type: str
    name: str
    begin: int
    end: int
    signature: str | None = None
    docstring: str | None = None
    calls: list[str] = field(default_factory=list)


# --- Python -----------------------------------------------------------------------------------------------------


def _offsets(text: str) -> list[int]:
    out = [0]
    for line in text.splitlines(keepends=True):
        out.append(out[-1] + len(line))
    return out


def python_signature(body: str) -> str:
    """Text through the first colon."""
    head, colon, _ = body.partition(":")
    return (head + colon).strip()


def _python_calls(node: ast.AST) -> list[str]:
    found = set()
    for x in ast.walk(node):
        if isinstance(x, ast.Call):
            if isinstance(x.func, ast.Name):
                found.add(x.func.id)
            elif isinstance(x.func, ast.Attribute):
                found.add(x.func.attr)
    return sorted(found)


def python_units(text: str) -> list[Unit]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _python_by_indent(text)
    lines = text.splitlines(keepends=True)
    starts = _offsets(text)
    out: list[Unit] = []

    def place(row: int, column: int) -> int:
        return starts[row - 1] + len(lines[row - 1].encode()[:column].decode("utf-8", "ignore"))

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                a, b = place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)
                if isinstance(child, ast.ClassDef):
                    out.append(Unit("class", child.name, a, b))
                else:
                    out.append(Unit("function", child.name, a, b, python_signature(text[a:b]), ast.get_docstring(child), _python_calls(child)))
            visit(child)

    visit(tree)
    return out


PY_HEADER = re.compile(r"(?m)^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")


def _python_by_indent(text: str) -> list[Unit]:
    out = []
    for m in PY_HEADER.finditer(text):
        indent, end, at = len(m.group(1).expandtabs()), len(text), text.find("\n", m.end())
        last = m.end() if at < 0 else at
        while 0 <= at < len(text):
            stop = text.find("\n", at + 1)
            line = text[at + 1 : stop if stop >= 0 else len(text)]
            if line.strip():
                if len(line.expandtabs()) - len(line.expandtabs().lstrip()) <= indent and not line.lstrip().startswith((")", "]", "}")):
                    break
                last = stop if stop >= 0 else len(text)
            at = stop
        end = last
        a = m.start() + len(m.group(1))
        body = text[a:end]
        if m.group(2) == "class":
            out.append(Unit("class", m.group(3), a, end))
        else:
            calls = sorted({x for x in re.findall(r"(?<!def )\b([A-Za-z_]\w*)\(", body[body.find("(") + 1 :]) if x not in PY_WORDS})
            doc = re.match(r"[^\n]*:\s*\n\s*[rRuU]?(\"\"\"|''')(.*?)\1", body, re.S)
            out.append(Unit("function", m.group(3), a, end, python_signature(body), doc.group(2).strip() if doc else None, calls))
    return out


PY_WORDS = frozenset("if elif for while and or not in is lambda return print_ assert with except yield del raise".split())

# --- brace languages --------------------------------------------------------------------------------------------

BLANKED = {
    "rust": re.compile(r'//[^\n]*|/\*.*?\*/|r#*".*?"#*|b?"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\\n])\'', re.S),
    "go": re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.[^\']*|[^\'\\\n])\'', re.S),
    "script": re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|(?<=[=(,:;!&|?\[{}])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[gimsuy]*', re.S),
    "c": re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.[^\']*|[^\'\\\n])\'', re.S),
}
WORDS = frozenset("if for while switch catch return match loop else do fn func function new sizeof typeof await yield throw case super this constructor import export delete void in of instanceof defer go select range make_ let const var static async unsafe move where impl dyn synchronized assert alignof decltype noexcept static_assert".split())
CALL = re.compile(r"([A-Za-z_$][\w$]*)\s*(?:::\s*<[^<>()]*>|<[\w, .&\[\]]*>)?\(")


def blanked(text: str, kind: str) -> str:
    """The text with strings and comments as blanks, line ends kept."""
    return BLANKED[kind].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def closing(code: str, at: int) -> int:
    """Behind the brace that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _before_name(code: str, at: int) -> tuple[bool, str, str]:
    """Of the name at ``at``: whether a dot stands before it, the name before that dot, and the word before the whole path."""
    end = at
    while end and code[end - 1].isspace():
        end -= 1
    dotted = code[end - 1 : end] == "."
    begin = end = end - 1 if dotted else at
    while dotted and begin and (code[begin - 1].isalnum() or code[begin - 1] in "_$"):
        begin -= 1
    owner = code[begin:end]
    while begin and (code[begin - 1].isalnum() or code[begin - 1] in "_.$"):
        begin -= 1
    end = begin
    while end and code[end - 1].isspace():
        end -= 1
    begin = end
    while begin and code[begin - 1].isalpha():
        begin -= 1
    return dotted, owner, code[begin:end]


def _calls(code: str, members: bool = True, objects: bool = False) -> list[str]:
    """Names called in a body, without macros and object creation; ``objects`` takes the owner of a member's call instead."""
    found = set()
    for m in CALL.finditer(code):
        name = m.group(1)
        dotted, owner, word = _before_name(code, m.start())
        if name in WORDS or word == "new" or not dotted and word in ("fn", "func", "function"):
            continue
        if dotted and not members:
            continue
        found.add(owner if dotted and objects and owner else name)
    return sorted(found)


def _before_brace(text: str) -> str:
    head, brace, _ = text.partition("{")
    return (head if brace else text.split("\n", 1)[0]).strip()


def _body_brace(code: str, at: int) -> int:
    """The brace that opens a body behind a header, or -1 if a semicolon comes first (outside brackets)."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and c == ";":
            return -1
        elif depth <= 0 and c == "{":
            return i
    return -1


RUST = re.compile(r"(?:\bpub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+)*\b(fn|struct|enum|trait|impl|mod)\b\s*(?:<[^{;]*?>\s*)?([A-Za-z_]\w*)?")


def rust_units(text: str) -> list[Unit]:
    code = blanked(text, "rust")
    out: list[Unit] = []

    def scan(a: int, b: int) -> None:
        at = a
        while m := RUST.search(code, at, b):
            word, name = m.group(1), m.group(2)
            brace = _body_brace(code, m.end())
            semicolon = code.find(";", m.end())
            if brace < 0 or brace >= b:
                end = semicolon + 1 if 0 <= semicolon < b else b
                if word == "struct" and name:
                    out.append(Unit("struct", name, m.start(), end))
                at = max(end, m.end())
                continue
            end = closing(code, brace)
            if word == "fn" and name:
                out.append(Unit("function", name, m.start(), end, _before_brace(text[m.start() : end]), None, _calls(code[brace:end], members=False)))
            elif word in ("struct", "enum", "trait") and name:
                out.append(Unit(word, name, m.start(), end))
            elif word in ("impl", "mod"):
                scan(brace + 1, end - 1)
            at = end

    scan(0, len(code))
    return out


SCRIPT = re.compile(r"\b(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)|\bclass\s+([A-Za-z_$][\w$]*)|\b([A-Za-z_$][\w$]*)\s*(?::[^=;(){}]+)?=\s*(?:async\s+)?(?:<[^>]*>\s*)?(?:\((?:[^()]|\([^()]*\))*\)|[A-Za-z_$][\w$]*)\s*(?::\s*[^={;]+)?=>")
SCRIPT_METHOD = re.compile(r"(?:\b(?:public|private|protected|static|async|override|readonly|get|set|abstract)\s+)*(?:\*\s*)?(#?[A-Za-z_$][\w$]*)\s*(?:<[^>{}()]*>)?\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?::\s*[^{};=]+)?(?=\{)")


def script_units(text: str) -> list[Unit]:
    code = blanked(text, "script")
    out: list[Unit] = []

    def members(a: int, b: int) -> None:
        at = a
        while m := SCRIPT_METHOD.search(code, at, b):
            if m.group(1) in WORDS - {"constructor"}:
                at = closing(code, m.end())
                continue
            end = closing(code, m.end())
            out.append(Unit("method", m.group(1), m.start(), end, None, None, _calls(code[m.end() : end])))
            at = end

    at = 0
    while m := SCRIPT.search(code, at):
        function, owner, arrow = m.groups()
        if arrow:
            rest = re.compile(r"\s*").match(code, m.end()).end()
            end = closing(code, rest) if code[rest : rest + 1] == "{" else next((i for i in (code.find(";", rest), code.find("\n", rest)) if i >= 0), len(code))
            out.append(Unit("function", arrow, m.start(), end, None, None, _calls(code[m.end() : end])))
            at = max(end, m.end())
            continue
        brace = _body_brace(code, m.end())
        if brace < 0:
            at = m.end()
            continue
        end = closing(code, brace)
        if owner:
            out.append(Unit("class", owner, m.start(), end))
            members(brace + 1, end - 1)
        else:
            out.append(Unit("function", function, m.start(), end, None, None, _calls(code[brace:end])))
        at = end
    return out


GO = re.compile(r"(?m)^func\s+(\([^)]*\)\s*)?([A-Za-z_]\w*)|^type\s+(?:\(|([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(struct|interface)?)")
GO_SPEC = re.compile(r"(?m)^\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(struct|interface|[\w*\[\].]+)")


def go_units(text: str) -> list[Unit]:
    code = blanked(text, "go")
    out: list[Unit] = []
    for m in GO.finditer(code):
        if m.group(2):
            brace = _body_brace(code, m.end())
            if brace < 0:
                continue
            end = closing(code, brace)
            out.append(Unit("method" if m.group(1) else "function", m.group(2), m.start(), end, None, None, _calls(code[brace:end])))
        elif m.group(3):
            brace = code.find("{", m.end())
            end = closing(code, brace) if m.group(4) and brace >= 0 else (code.find("\n", m.end()) if code.find("\n", m.end()) >= 0 else len(code))
            out.append(Unit(m.group(4) or "type", m.group(3), m.start() + len("type "), end))
        else:
            stop = code.find("\n)", m.end())
            at = m.end()
            while s := GO_SPEC.search(code, at, stop if stop >= 0 else len(code)):
                brace = code.find("{", s.end())
                nested = s.group(2) in ("struct", "interface")
                end = closing(code, brace) if nested and brace >= 0 else s.end()
                out.append(Unit(s.group(2) if nested else "type", s.group(1), s.start(1), end))
                at = end
    return out


JAVA_TYPE = re.compile(r"(?:\b(?:public|private|protected|static|final|abstract|sealed|strictfp)\s+)*\b(class|interface|enum|record)\s+([A-Za-z_]\w*)")
JAVA_METHOD = re.compile(r"(?:\b(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>{}()]*>\s*)?(?:[\w.<>\[\],?& ]+?[\s\]>])?\b([A-Za-z_]\w*)\s*\((?:[^()]|\([^()]*\))*\)\s*(?:throws\s+[\w., ]+)?(?=[{;])")


def java_units(text: str) -> list[Unit]:
    code = blanked(text, "c")
    out: list[Unit] = []

    def scan(a: int, b: int, inside: bool) -> None:
        at = a
        while at < b:
            t = JAVA_TYPE.search(code, at, b)
            m = JAVA_METHOD.search(code, at, b) if inside else None
            if m and m.group(1) in WORDS:
                at = m.end()
                continue
            if t and (not m or t.start() <= m.start()):
                brace = code.find("{", t.end(), b)
                if brace < 0:
                    return
                end = closing(code, brace)
                out.append(Unit("class" if t.group(1) == "record" else t.group(1), t.group(2), t.start(), end))
                scan(brace + 1, end - 1, True)
                at = end
            elif m:
                end = closing(code, m.end()) if code[m.end()] == "{" else m.end() + 1
                begin = m.start() + len(m.group()) - len(m.group().lstrip())
                out.append(Unit("method", m.group(1), begin, end, None, None, _calls(code[m.end() : end], objects=True)))
                at = end
            else:
                return

    scan(0, len(code), False)
    return out


CPP = re.compile(r"\b(class|struct|namespace)\s+(?:[A-Z_]+\s+)?([A-Za-z_]\w*)?[^;{}()=]*(?=\{)|(?m:^[ \t]*)((?:template\s*<[^{}]*?>\s*)?(?:[\w:<>,*&~\[\]]+\s+)*[\w:<>,*&\[\]]+[\s*&]+((?:\w+::)*~?\w+)\s*\((?:[^()]|\([^()]*\))*\)\s*(?:const|noexcept|override|final|->\s*[\w:<>]+|\s)*)(?=\{)")


def cpp_units(text: str) -> list[Unit]:
    code = blanked(text, "c")
    out: list[Unit] = []

    def scan(a: int, b: int) -> None:
        at = a
        while m := CPP.search(code, at, b):
            end = closing(code, m.end())
            if m.group(1):
                if m.group(1) != "namespace" and m.group(2):
                    out.append(Unit(m.group(1), m.group(2), m.start(), end))
                scan(m.end() + 1, end - 1)
            else:
                name = m.group(4)
                if name.split("::")[-1] not in WORDS:
                    begin = m.start(3)
                    out.append(Unit("function", name, begin, end, _before_brace(text[begin:end]), None, _calls(code[m.end() : end])))
            at = end

    scan(0, len(code))
    return out


PARSERS: dict[str, Callable[[str], list[Unit]]] = {"python": python_units, "rust": rust_units, "javascript": script_units, "typescript": script_units, "go": go_units, "java": java_units, "cpp": cpp_units}


def parse_text(text: str, language: str) -> list[Unit]:
    """Units in order of their begin."""
    parser = PARSERS.get(language)
    if parser is None or text.count("\n") >= MAX_LINES:
        return []
    return sorted(parser(text), key=lambda u: (u.begin, -u.end))


UNITS = (
    "repo string, file_path string, language string, ordinal int, unit_type string, name string, full_signature string, docstring string, line_start int, line_end int, body string, calls array<string>"
)


def parse_units(files: DataFrame) -> DataFrame:
    """(repo, file_path, language, text) to the units table, with ids that a rerun repeats."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("repo", pa.string()), ("file_path", pa.string()), ("language", pa.string()), ("ordinal", pa.int32()), ("unit_type", pa.string()), ("name", pa.string()), ("full_signature", pa.string()), ("docstring", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("body", pa.string()), ("calls", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for repo, path, language, text in zip(*(c.to_pylist() for c in batch.columns)):
                for i, u in enumerate(parse_text(text or "", language)):
                    first = text.count("\n", 0, u.begin) + 1
                    body = text[u.begin : u.end]
                    rows.append((repo, path, language, i, u.unit_type, u.name, u.signature, u.docstring, first, first + body.rstrip("\n").count("\n"), body, u.calls))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    found = files.select("repo", "file_path", "language", "text").mapInArrow(run, UNITS)
    empty = F.array().cast("array<string>")
    return found.select(
        "repo", F.xxhash64("repo", "file_path", "ordinal").alias("id"), "file_path", "language", "unit_type", "name", "full_signature", "docstring", "line_start", "line_end", "body",
        empty.alias("parameters"), F.lit(None).cast("string").alias("return_type"), "calls", empty.alias("imports"), F.lit(1).alias("complexity"), F.lit(False).alias("has_embedding"), F.lit(None).cast("string").alias("embedding_model"),
    )
