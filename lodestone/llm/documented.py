"""Functions paired with their documentation.

A lexer turns every text into tokens with their offsets: comment lines, annotations, function
headers, literals at the start of a block, blank lines, lines of code that change the depth
(braces, or indents in Python) and runs of lines that don't. The tokens are exploded into rows,
and window SQL puts functions together: a running sum of changes gives the depth, gaps and
islands join comment lines, lag and lead windows attach the comment before a header and the
literal behind it. Every token at which the depth falls stands for the levels it closes; the
next one of a header's own level ends its function, whose code is cut out by offsets. A header
that opens nothing is a function by itself.

What is attached is then judged: text counts only if something is left beyond the function's
name, labels, bare tags, notes of work to be done, references, notices on origin, licence or
author, tool directives, decoration and commented-out code.

Null bodies give no tokens; their units are judged by docstring alone. Rows repeated as a
whole give one result, rows without an id none. Comments among statements never count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.handwritten import MARKERS, STUB
from lodestone.session import ship

TOKENS = "unit_row bigint, id bigint, unit_name string, tokens array<struct<pos:int,kind:string,delta:int,name:string,text:string,begin:int,end:int>>"

COMMENT, NOTE, HEADER, LITERAL, BLANK, CODE = "c", "a", "h", "s", "b", "k"

NAMED_HEADER = {
    "python": re.compile(r"(?:async\s+)?def\s+(\w+)\s*[\[(]"),
    "rust": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)"),
    "go": re.compile(r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]"),
    "script": re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)|(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>)|(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?(?!(?:if|for|while|switch|catch|return|function|else|do)\b)(\w+)\s*\([^;]*\)\s*(?::[^={]+)?\{\s*$"),
    "java": re.compile(r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?[\w.<>\[\],? ]+\s+(?!(?:if|for|while|switch|catch|return|else|new|throw)\b)(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w., ]+)?\{\s*$"),
    "cpp": re.compile(r"(?:(?:static|inline|virtual|constexpr|explicit|extern|friend)\s+)*[\w:<>,*&~ ]+[\s*&]+(?:\w+::)*(?!(?:if|for|while|switch|catch|return|else|new|throw)\b)(~?\w+)\s*\([^;]*\)\s*(?:const|noexcept|override|final|\s)*\{\s*$"),
}
FAMILY = {"python": "python", "rust": "rust", "go": "go", "javascript": "script", "typescript": "script", "java": "java", "cpp": "cpp"}
EXTENSION = {"py": "python", "pyi": "python", "rs": "rust", "go": "go", "js": "script", "jsx": "script", "mjs": "script", "ts": "script", "tsx": "script", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp"}
STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|`[^`]*`')
PY_LITERAL = re.compile(r"\s*[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')")
INDENT = re.compile(r"[ \t]*")
LINE_END = re.compile(r"\r\n?|\n")
MARKS = re.compile(r"^[ \t]*(?:/{2,}!?|/\*+!?|\*+/|\*+(?!\w)|#+!?)|\*+/[ \t]*$")


def family(language: str | None, path: str | None, body: str) -> str:
    own = FAMILY.get(language or "") or EXTENSION.get((path or "").rsplit(".", 1)[-1].lower())
    return own or ("python" if re.search(r"(?m)^\s*(?:async\s+)?def \w+\(.*:\s*$", body) else "script")


def lex(body: str, kind: str, unit_name: str | None) -> list[dict]:
    """Tokens of a text in order. A unit's first line of code is a header, whatever it looks like."""
    tokens: list[tuple] = []
    python = kind == "python"
    header = NAMED_HEADER[kind]
    marks = [m.span() for m in LINE_END.finditer(body)]
    starts = [0, *(e for _, e in marks)]
    lines = [body[x:y] for x, y in zip(starts, [*(b for b, _ in marks), len(body)])]
    n, i, fresh = len(lines), 0, True
    starts.append(len(body))
    indents = [-1]
    in_code = False

    def add(kind_: str, first: int, last: int, delta: int = 0, name: str | None = None, text_: str | None = None) -> None:
        """A token of the lines from ``first`` to before ``last``."""
        nonlocal in_code
        tokens.append((kind_, delta, name, text_, starts[first], starts[last] if last > first else starts[first]))
        in_code = False

    def code(delta: int, first: int, last: int) -> None:
        nonlocal in_code
        if in_code and not delta:
            tokens[-1] = (*tokens[-1][:5], starts[last])
        else:
            add(CODE, first, last, delta)
            in_code = not delta

    while i < n:
        line = lines[i]
        text = line.lstrip()
        here = i
        i += 1
        if not text:
            if not in_code:
                add(BLANK, here, i)
            continue
        mark = text[0]
        if mark == "/" and text[1:2] == "*" and not python:
            part = [text]
            while "*/" not in part[-1][2 if len(part) == 1 else 0 :] and i < n:
                part.append(lines[i])
                i += 1
            tail = part[-1].partition("*/")[2] if "*/" in part[-1] else ""
            for k, x in enumerate(part):
                add(COMMENT, here + k, here + k + 1, text_=x)
            if tail.strip():
                code(0, i - 1, i)
            continue
        if (mark == "/" and text[1:2] == "/" and not python) or (mark == "#" and python):
            add(COMMENT, here, i, text_=text)
            continue
        if (mark == "@" and not text.startswith("@interface")) or (mark == "#" and kind in ("rust", "cpp")) or text.startswith(("template<", "template <", "[[")):
            add(NOTE, here, i)
            continue
        if python:
            # change of indent before this line
            depth = len(line) - len(text)
            delta = 0
            while indents[-1] >= depth:
                indents.pop()
                delta -= 1
            if delta:
                # comments and annotations that stand no deeper belong to what comes
                k = len(tokens)
                while k and tokens[k - 1][0] in (COMMENT, NOTE, BLANK) and (tokens[k - 1][0] == BLANK or INDENT.match(body, tokens[k - 1][4]).end() - tokens[k - 1][4] <= depth):
                    k -= 1
                at = tokens[k - 1][5] if k else 0
                tokens.insert(k, (CODE, delta, None, None, at, at))
                in_code = False
        found = None
        if fresh or mark in "adefpcgsuvlxotr~" or mark.isupper() or kind in ("script", "java", "cpp"):
            found = header.match(text)
        if found or fresh:
            name = next((g for g in found.groups() if g), None) if found else unit_name
            head = [text]
            open_ = text.count("(") - text.count(")")
            while open_ > 0 and i < n:
                head.append(lines[i])
                open_ += head[-1].count("(") - head[-1].count(")")
                i += 1
            if python:
                indents.append(len(line) - len(text))
                delta = 1
            else:
                if "{" not in "".join(head) and not head[-1].rstrip().endswith((";", ",")):
                    k = i  # the brace may stand on a line of its own
                    while k < n and not lines[k].strip():
                        k += 1
                    if k < n and lines[k].lstrip().startswith("{"):
                        head += lines[i : k + 1]
                        i = k + 1
                bare = "".join(STRINGS.sub("", x) for x in head)
                delta = bare.count("{") - bare.count("}")
            add(HEADER, here, i, delta, name)
            fresh = False
            if python and head[-1].rstrip().endswith(":"):
                j = i
                while j < n and not lines[j].strip():
                    j += 1
                opening = PY_LITERAL.match(lines[j]) if j < n else None
                if opening:
                    quote = opening.group(1)
                    rest = lines[j][opening.end() :]
                    part = []
                    while quote not in rest and len(quote) == 3 and j + 1 < n:
                        part.append(rest)
                        j += 1
                        rest = lines[j]
                    part.append(rest.partition(quote)[0])
                    if not rest.partition(quote)[2].strip() or rest.partition(quote)[2].lstrip()[0] in "#;":
                        add(LITERAL, i, j + 1, text_="\n".join(part))
                        i = j + 1
            continue
        if not python and ("{" in text or "}" in text):
            bare = STRINGS.sub("", text) if '"' in text or "'" in text or "`" in text else text
            closing = len(bare) - len(bare.lstrip("}")) if bare[:1] == "}" else 0
            rest = bare.count("{") - bare.count("}") + closing
            if closing and rest > 0:  # as in "} else {": what it closes, then what it opens
                code(-closing, here, i)
                code(rest, here, i)
            else:
                code(rest - closing, here, i)
        else:
            code(0, here, i)
    return [{"pos": p, "kind": t[0], "delta": t[1], "name": t[2], "text": t[3], "begin": t[4], "end": t[5]} for p, t in enumerate(tokens)]


def lexed(units: DataFrame) -> DataFrame:
    """One row per unit with its tokens; see TOKENS."""
    ship(units.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, language, path, name in zip(*(batch.column(c).to_pylist() for c in ("body", "language", "file_path", "name"))):
                rows.append(lex(body, family(language, path, body), name))
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("delta", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("unit_row"), batch.column("id"), batch.column("name"), pa.array(rows, kind)], names=["unit_row", "id", "unit_name", "tokens"])

    rows = units.where("body IS NOT NULL").select(F.monotonically_increasing_id().alias("unit_row"), F.col("id").cast("bigint"), "name", "language", "file_path", "body")
    return rows.mapInArrow(run, TOKENS)


def functions(units: DataFrame) -> DataFrame:
    """(unit_row, id, unit_name, number, name, comment, literal, begin, end): every function in a text, from 1, with what is attached and the offsets of its code.

    One shuffle, of the exploded tokens by text; every window runs on that partitioning.
    """
    tokens = lexed(units).select("unit_row", "id", "unit_name", F.explode("tokens").alias("t")).select("unit_row", "id", "unit_name", "t.*")
    order = Window.partitionBy("unit_row").orderBy("pos")
    depth = tokens.withColumn("depth", F.coalesce(F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    solid = depth.where(F.col("kind") != NOTE)
    # comment lines whose places among the others differ by the same amount are one island
    islands = solid.withColumn("place", F.row_number().over(order)).withColumn("island", F.col("place") - F.row_number().over(Window.partitionBy("unit_row", "kind").orderBy("pos")))
    block = F.when(F.col("kind") == COMMENT, F.col("island")).otherwise(-F.col("place"))
    first = lambda c: F.first(c).alias(c)
    joined = (
        islands.withColumn("block", block)
        .groupBy("unit_row", "block", "kind")
        .agg(F.min("pos").alias("pos"), first("id"), first("unit_name"), F.min("depth").alias("depth"), F.sum("delta").alias("delta"), F.first("name", True).alias("name"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))).alias("text"))
    )
    around = joined.withColumns(
        {
            "comment": F.when(F.lag("kind").over(order) == COMMENT, F.lag("text").over(order)),
            "literal": F.when(F.lead("kind").over(order) == LITERAL, F.lead("text").over(order)),
            "last": F.max("end").over(Window.partitionBy("unit_row")),
        }
    ).drop("text")
    # a header stands at its own level, a token at which the depth falls at every level that it closes
    is_header = F.col("kind") == HEADER
    levels = F.when(is_header, F.array("depth")).otherwise(F.sequence(F.col("depth") + F.col("delta"), F.col("depth") - 1))
    placed = around.where(is_header | (F.col("delta") < 0)).withColumn("level", F.explode(levels))
    behind = Window.partitionBy("unit_row", "level").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    closes = F.first(F.when(F.col("kind") == CODE, F.col("end")), True).over(behind)
    ended = placed.withColumn("stop", F.when(F.col("delta") > 0, F.coalesce(closes, F.col("last"))).otherwise(F.col("end"))).where(is_header)
    return ended.select("unit_row", "id", "unit_name", F.row_number().over(order).alias("number"), "name", "comment", "literal", "begin", F.col("stop").alias("end"))


# --- what a text says -------------------------------------------------------------------------------------------

# Words that say nothing about a function by themselves.
EMPTY_WORDS = frozenset(
    "a an the this that it its is are be was were does do did of to for and or in on at by with from as into which what called named here there see above below same before base class super parent "
    "function functions method methods constructor destructor helper helpers wrapper getter setter accessor internal private public protected implementation impl routine procedure utility util stub main default generic misc note "
    "deprecated param params parameter parameters arg args argument arguments return returns value void self cls tbd todo fixme xxx hack wip n a none nothing done "
    "siehe oben unten voir ci dessus ver arriba funktion methode fonction función método hilfsfunktion die der das le la el los les un une una".split()
)
WORK = re.compile(r"(?i)^\W*(todo|fixme|xxx|hack|tbd|wip|to do)\b")
REFERENCE = re.compile(r"(?i)^\W*(see|see also|cf\.?|refer to|refs?:?|siehe|vgl\.?|voir|véase|ver|same as|as above|inherited from|overrides)\b")
NOTICE = re.compile(r"(?i)copyright|\(c\)\s*\d{4}|spdx-license|licen[sc]ed? (under|by|to)|all rights reserved|subject to the terms|^\W*(@?(author|authors|date|created|modified|version|since|maintainer|owner|license|autor|auteur|datum|fecha)s?)\b\s*[:=]|^\W*@(author|since|version|date|license)\b|^\W*(created|written|added) (by|on) ")
DIRECTIVE = re.compile(r"(?i)^\W*(noqa\b|nolint|nosonar|nosec|eslint-|tslint:|jshint |jslint |prettier-|stylelint-|type:\s*ignore|pylint:|flake8:|mypy:|ruff:|isort:|yapf:|fmt:\s*(on|off|skip)|pragma\b|@ts-|clang-format|clang-tidy|rustfmt|coverage:|istanbul |c8 |v8 |lint:|go:\w+|\+build|checkstyle:|@?suppress|region\b|endregion\b|cspell:|spell-?checker:|vim:|-\*-|!/)")
INHERIT = re.compile(r"(?i)\{?@(inherit-?doc|override|overload|see|link|internal|private|public|deprecated|ignore|hidden)\b[^}]*\}?")
TAG = re.compile(r"(?i)^\W*[@:\\](param|arg|argument|tparam|parameter|keyword|type|rtype|return|returns|raises?|throws?|exception|yields?|brief|details|short|note|remarks?|summary|desc|description)\b(?:\[[^\]]*\])?:?\s*")
BRIEF = re.compile(r"(?i)^\W*[@\\](?:brief|short|details|note|summary|remarks?)\b\s*")
PARAM = re.compile(r"(?i)^\W*[@:\\](param|arg|argument|tparam|parameter|keyword|type|raises?|throws?|exception)\b")
CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*[})\]]|^\s*[\w.\[\]\"'$>-]+(?:\s*,\s*[\w.\[\]\"']+)*\s*(?:=|\+=|-=|:=|\?\?=|<-)\s*\S|^\s*[\w.:>-]+\([^ ]*(?:, ?[^ ]+)*\)\??;?\s*$|^\s*(?:const|let|var|auto|final)\s+[\w{\[]|^\s*(?:if|for|while|with|elif|switch|match|try|except|else|case|default|catch|finally|do|go|defer|await|async|raise|throw|assert|return|break|continue|yield|del|import|from|use|print)\b(?=.*[(.=<>\[:_{]|\s*$).*[:({)\]_\w;]\s*$"
)
PROSE_END = re.compile(r"[a-zà-ÿ)\d][.!?]\s*$")
WORDS = re.compile(r"[^\W\d_]+")
CASED = re.compile(r"[A-Z]?[a-zà-ÿß]+|[A-Z]+(?![a-z])|[^\W\d_A-Za-z]+")
PLAIN = re.compile(r"[^@\\{}:;=()\[\]<>_/#*]+[.]")
# Words that any of the patterns above may be about; a plain sentence without them needs no pattern.
TRIGGERS = frozenset(
    "todo fixme xxx hack tbd wip see cf refer ref refs siehe vgl voir véase ver same inherited overrides copyright c spdx license licence licensed licenced rights author authors date created modified version since maintainer owner autor auteur datum fecha written added "
    "noqa nolint nosonar nosec eslint tslint jshint jslint prettier stylelint type pylint flake mypy ruff isort yapf fmt pragma ts clang rustfmt coverage istanbul v lint go build checkstyle suppress region endregion cspell spell spellchecker vim "
    "generated generiert generado erzeugt autogenerated auto edit modify machine hand automatisch bearbeiten ändern fichier modifier éditer editar modificar vendored imported copied third fremdbibliothek upstream bundled produced changes taken patches rewrites stub file code".split()
)
WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def _stem(word: str) -> str:
    for end in ("ization", "ations", "ation", "ings", "ing", "ies", "ied", "ers", "er", "es", "ed", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def name_stems(name: str | None) -> set[str]:
    return {_stem(w.lower()) for w in CASED.findall(name or "")}


def _new_words(line: str, known: set[str]) -> int:
    """Number of different words that are neither empty nor part of the name; counting stops at two."""
    first = None
    for word in WORDS.findall(line):
        for part in (word,) if word.islower() or word.istitle() else CASED.findall(word):
            low = part.lower()
            if low != first and low not in EMPTY_WORDS and _stem(low) not in known:
                if first is not None:
                    return 2
                first = low
    return 0 if first is None else 1


def says_something(text: str | None, name: str | None) -> bool:
    """Whether a documentation text says more than the name of its function."""
    if not text:
        return False
    own = name_stems(name)
    note_open = False
    for raw in text.split("\n"):
        line = MARKS.sub("", MARKS.sub("", raw.strip())).strip()
        if not line or not WORDS.search(line):
            note_open = False
            continue
        if not note_open and PLAIN.fullmatch(line) and TRIGGERS.isdisjoint(WORDS.findall(line.lower())):
            if _new_words(line, own) >= 2:
                return True
            continue
        if WORK.match(line):
            note_open = not PROSE_END.search(line)
            continue
        if note_open and (line[0] == "(" or line[0].islower()):
            note_open = not PROSE_END.search(line) and line[-1] != ")"
            continue
        note_open = False
        if NOTICE.search(line) or DIRECTIVE.match(line) or STUB.search(line) or MARKERS.search(line) or REFERENCE.match(line):
            continue
        known = own
        line = BRIEF.sub("", line)
        is_param = PARAM.match(line)
        line = TAG.sub("", INHERIT.sub("", line)).strip()
        if is_param:
            head, _, line = line.partition(":") if re.match(r"[\w.$\[\]]+\s*:", line) else line.partition(" ")
            known = own | name_stems(head)
        if CODE_LINE.search(line) and not PROSE_END.search(line):
            continue
        if len(WIDE.findall(line)) >= 4 or _new_words(line, known) >= 2:
            return True
    return False


def documented(units: DataFrame) -> DataFrame:
    """(id, number, name, source, description, begin, end) of functions with documentation that says something.

    Number 1 is the unit itself, others are further functions in its body. Of a unit the docstring field comes first, then the literal at
    the start of the body, then the comment before the header. ``begin`` and ``end`` are offsets in the body.
    """
    own = units.where(F.col("unit_type").isin("function", "method") & F.col("id").isNotNull())
    name = F.when(F.col("number") == 1, F.col("unit_name")).otherwise(F.col("name"))
    source = lambda number, text: F.struct(F.lit(number).alias("s"), F.col(text).alias("t"))
    texts = functions(own).select("id", "number", name.alias("name"), "begin", "end", F.explode(F.array(source(2, "literal"), source(3, "comment"))).alias("x")).select("id", "number", "name", F.col("x.s").alias("source"), F.col("x.t").alias("description"), "begin", "end")
    fields = own.select(F.col("id").cast("bigint"), F.lit(1).alias("number"), "name", F.lit(1).alias("source"), F.col("docstring").alias("description"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            says = [says_something(t, n) for t, n in zip(batch.column("description").to_pylist(), batch.column("name").to_pylist())]
            kept = [t if ok else None for t, ok in zip(batch.column("description").to_pylist(), says)]
            yield batch.set_column(4, "description", pa.array(kept, pa.string()))

    wanted = fields.unionByName(texts).where("description IS NOT NULL OR number = 1 AND source = 2")  # the latter for its offsets
    said = wanted.mapInArrow(run, "id bigint, number int, name string, source int, description string, begin int, end int")
    best = F.min(F.when(F.col("description").isNotNull(), F.struct("source", "description", "name"))).alias("x")
    return said.groupBy("id", "number").agg(best, F.max("begin").alias("begin"), F.max("end").alias("end")).where("x IS NOT NULL").select("id", "number", "x.name", "x.source", "x.description", "begin", "end")


def documented_pairs(units: DataFrame) -> DataFrame:
    """(id, number, name, full_signature, description, code): one pair of code and description for each documented function."""
    code = units.where("id IS NOT NULL").select(F.col("id").cast("bigint"), F.nullif("full_signature", F.lit("")).alias("full_signature"), "body").dropDuplicates(["id"])
    cut_out = F.rtrim(F.regexp_replace(F.substring("body", F.col("begin") + 1, F.col("end") - F.col("begin")), r"(\s*\n\s*(#[^\n]*)?)+$", ""))
    return documented(units).join(code, "id").select("id", "number", "name", F.when(F.col("number") == 1, F.col("full_signature")).alias("full_signature"), "description", cut_out.alias("code"))
