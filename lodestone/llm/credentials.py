"""Credentials embedded in source code: finding and redacting them.

1. Every run of eight and more characters without blanks, quotes or separators is measured in
   characters per subword under a public tokenizer's vocabulary: names and words take three
   and more characters a subword, random strings less than two. Unnatural strings mark the
   lines that are looked at.
2. Context rules accept or reject what stands there: what the value is assigned or passed to,
   settings without quotes, markup, headers, URLs, command lines, connection strings, prose;
   placeholders, look-ups, names of secrets, digests, ids, public keys and embedded data are
   no credentials. A string without any such context must be random beyond doubt.
3. Pass phrases are made of words, so no measure tells them from names. They count only where a
   value is expected to be a credential, and only if they look like one: words with a number
   behind them, or four and more plain words under a name of a phrase.

Redaction puts an asterisk in the place of every character of a credential, so that all
offsets and lines stay. Values may have any length.

Null and empty texts have none and stay as they are. Lines end in ``\\n`` and count from 1.
Rows repeated as a whole give one result. Places of rows without an id cannot be named and are
left out; such rows are redacted like any other. Other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import TOKENIZER, TOKENIZER_DIR, Encoder, encoder
from lodestone.session import ship

#: Characters per subword, at most, of a string that is unnatural, and of one that counts without a context.
UNNATURAL_CPS = 2.1
RANDOM_CPS = 1.9
LEAST = 8
#: A string without any context that is longer than keys are is embedded data.
KEY_MOST = 140
KNOWN = 200_000

#: Endings of identifiers that are about a credential without being one.
ABOUT = re.compile(r"(?i)(?:^|[_\-.]|(?<=[a-z]))(?:names?|labels?|headers?|rules?|patterns?|regexp?|length|len|size|count|min|max|refs?|references?|ids?|url|uri|path|file|fields?|params?|prompts?|policy|hints?|types?|formats?|kind|messages?|msg|text|title|column|ttl|expiry|expires|age|env|var|variable|arn|alias|placeholders?|templates?|masks?|hash|digest|checksum|fingerprint|public|pub|cert|endpoint|scope|provider|store|manager|service|class|error|limit|budget|quota)$")
PUBLIC = re.compile(r"(?i)hash|sha\d*\b|digest|checksum|etag|uuid|guid|integrity|fingerprint|revision|commit|icon|pixel|logo|image|img|\bcert|certificate|public|pubkey|signature_of|content_?id|trace_?id|request_?id|pattern|rule|regex|alphabet|charset")
# Beginnings of tokens that services issue.
ISSUED = re.compile(r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}\b|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|npm_[A-Za-z0-9]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9]{16,}|xox[abeoprs]-[\w-]{16,}|AIza[\w-]{30,}|hvs\.[\w-]{16,}|dop_v1_\w{20,}|shp(?:at|ss)_\w{20,}|pypi-[\w-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})")
PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.•\-_#?0]+|<.*|\[.*\]|\$.*|%.*%|%[sdvr@]|%\(.*|\{.*|#\{.*|@.*@|.*(?:\*{3,}|x{4,}|\.{3,}|…).*|.*\b(?:your|insert|changeme|change[-_]me|example|dummy|placeholder|redacted|masked|hidden|replace|enter|here|fake|sample|goes|todo|tbd|fixme|removed|secret-?name|not-?set|unset|empty|none|null|nil|undefined)\b.*|changeit|pass(?:word|wd|phrase)?\d{0,4}|secret\d{0,4}|token\d{0,4}|test(?:ing)?\d{0,4}|admin\d{0,4}|foo(?:bar)?|hunter2|n/?a|abc(?:123)?|12345\d*|qwerty\w*)$"
)
LOOKUP = re.compile(r"(?i)(?:getenv|environ|env::var|process\.env|getproperty|env\.get|os\.get|config\.get|get_?secret|read_?secret|vault|keyring|ssm|prompt|getpass|input|ask|unwrap_or|lookup_?env)")


PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s\"'`,+\\#*/]|\\n|\\r)*")
URL_USER = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s/:@\"'`<>]*:([^\s@\"'`]+)@[\w.\-]")
URL_QUERY = re.compile(r"(?i)[?&;](?:access_?token|auth_?token|id_?token|refresh_?token|token|sig|signature|key|api_?key|apikey|password|passwd|pwd|secret|client_?secret|auth|code_verifier)=([^&\s\"'`#]{8,})")
QUOTED = re.compile(r"[\"'`]([A-Za-z0-9_+/=.\-]{20,})\\?[\"'`]")
PIECE = re.compile(r"[^=&?:@/]{8,}")
RUN = re.compile(r"[^\s\"'`<>,;(){}\[\]\\|]{8,}")
JOINT = re.compile(r"[=&?:@/]")
RANDOM_RUN = re.compile(r"(?<![^\s(\[])[A-Za-z0-9_+/=\-]{20,}(?=[\s.,;:)\]]|$)")
NOUN = re.compile(r"(?i)pass|pwd|\bpw\b|token|secret|\bkey|credential|\bcode\b|login|kennwort|contrase|mot de passe|bearer")
PHRASE_LIKE = re.compile(r"[A-Za-z][-_.]?\d\d|[A-Za-z]{2,}(?:[ \-_][A-Za-z]{2,}){3}")
WORDY = re.compile(r"(?=.{8})(?=(?:[^A-Za-z]*[A-Za-z]){5})[A-Za-z]+(?:[-_.][A-Za-z]+)*[-_.]?\d{2,}[!?#$%&*+.]*")
PHRASE = re.compile(r"[A-Za-z]{2,}(?:[ \-_][A-Za-z]{2,}){3,}")
MARKUP = re.compile(r"(?i)<([\w:.\-]*(?:password|passwd|pwd|secret|token|api_?-?key|access_?-?key|private_?-?key|credential)[\w.\-]*)(?:\s[^<>]*)?>\s*([^<>\s]{8,})\s*</")
LINE_SETTING = re.compile(r"^\s*(?:[-*]\s+|export\s+|set\s+)?[\"']?([\w.\-]+)[\"']?\s*(?:=|:)\s*([^\s\"'`()<>{}\[\],;]{8,})\s*(?:[#;].*)?\r?$")
ASSIGNED = re.compile(
    r"""(?ix)((?:pass_?wd|passw(?:or[dt])?|pass[_-]?phrase|passcode|pwd|secret|token|api[_-]?key|credentials?|kennwort|contrase[nñ]a|mot_?de_?passe|bearer|
    (?:signing|private|access|encryption|enc|decryption|crypto|hmac|master|shared|auth|service|account)[_-]?key|(?:smtp|db|mail|ftp|user|root|admin|svc)[_-]?pass|(?<![a-z])pass(?![a-z])|(?<![a-z])pw(?![a-z])|(?<=[a-z_])P(?:w|ass)(?![a-z]))[\w\-]*)
    (\\?["'`]?\]?\s*(?::\s*[\w:<>&'\s]+?\s*=|:=|=>|=|:|,)\s*)(?:(?:new\s+)?[\w:.]+\(\s*)?""",
)
SECRET_NAME = re.compile(r"(?i)pass_?wd|passw|pass_?phrase|(?:^|[_.\-])(?:pass|pwd|pw)$|secret|token|api[_-]?key|credential|kennwort|(?:signing|private|access|encryption|master|auth|service|account)[_-]?key")
STRING = re.compile(r"[fFrRbBuUL]{0,2}\\?(\"\"\"|'''|[\"'`])((?:(?!\1)[^\\\n]|\\(?!\1).)+?)\\?\1")
JOIN = re.compile(r"\s*(?:\+|\.\.|,|\|\||<<|\.)?\s*")
BARE = re.compile(r"[^\s\"'`;,()<>]{8,}")
CALL = re.compile(r"(?i)\b\w*(?:log_?[io]n|sign_?in|authenticate|connect|auth|open_?session|bind)\w*\(\s*(?:(\\?[\"'`])((?:(?!\1).)*?)\1|[\w.&]+)\s*,\s*(?=\\?[\"'`])")
HEADER = re.compile(r"(?i)\b(?:proxy-)?authorization\b[\"'`\]]*\s*(?:,|\]?\s*=|:|=>)?\s*\(?\s*[\"'`]?\s*(?:(bearer|basic|token|apikey|digest|aws4-hmac-sha256)\s+|(?:token|key|secret)\s*=\s*\"?)([^\s\"'`]{8,})")
COMMAND = re.compile(r"(?i)\b(?:mysql\w*|mariadb\w*|sshpass|mongo\w*|redis-cli|pg_\w+|psql)\b[^\n\"]*?\s-p\s?([^\s\"'`]{6,})|--?(?:password|passwd|pass|token|secret|api-?key)[= ]\s*[\"']?([^\s\"'`]{6,})|\s(?:-u|--user)\s+[\"']?[\w.\-]+:([^\s\"'`]{6,})")
EXPORT = re.compile(r"(?:\bexport\s+|\bset\s+|\bENV\s+|^\s*|-e\s+)([A-Z][A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|PASSWD|PWD|PW|KEY|CREDENTIALS?))=[\"']?([^\s\"'`;&]{8,})")
SETTING = re.compile(r"(?i)(?<=[;\"'` ])(?:pwd|password|accountkey|sharedaccesskey|sharedsecret)=([^;\"'`\s&()]{6,})(?=[;\"'`\n]|$)")
SAID = re.compile(r"(?i)\b(?:password|passwd|passphrase|pass|pw|pwd|token|secret|api key|key|kennwort|passwort|contraseña|mot de passe|login)\s+(?:was|is|are|=|:|ist|war|es|est|set to|changed to)\s*:?\s*[\"'`]?([^\s\"'`,;]{8,})")
DEFAULT = re.compile(r"(?i)(?:getenv|env_?or\w*|environ(?:\.get)?|env::var|process\.env\.?\w*|getproperty|env\.get|lookup_?env|os\.get\w*|config\.get\w*|getordefault)")
COMMENT = re.compile(r"^\s*(?://|#|\*|/\*|--|>>>|\.\.\.)")
HEX = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?i)^(?:sha\d*|md5|blake2\w*|crc32)[-:=]")
DIGIT, UPPER, LOWER = re.compile(r"\d"), re.compile(r"[A-Z]"), re.compile(r"[a-z]")


def owner(before: str) -> str:
    """The name that the value behind ``before`` is assigned to, or nothing. Read backwards, so that long lines cost nothing."""
    end = len(before) - (before[-1:] in ("\"", "'", "`"))
    sign = max(before.rfind("=", 0, end), before.rfind(":", 0, end))
    if sign < 0 or any(before.rfind(q, sign + 1, end) >= 0 for q in "\"'`"):
        return ""
    end = sign - (before[sign - 1 : sign] == ":")
    while end and (before[end - 1].isspace() or before[end - 1] in "\"'`]"):
        end -= 1
    begin = end
    while begin and (before[begin - 1].isalnum() or before[begin - 1] in "_.-$"):
        begin -= 1
    return before[begin:end]


class Finder:
    """Finds credentials in texts with one tokenizer's vocabulary."""

    def __init__(self, own: Encoder) -> None:
        self.encoder = own
        self.known: dict[str, float] = {}

    def measure(self, values: list[str]) -> None:
        """Takes the measure of many strings at once."""
        new = list({v for v in values if v not in self.known})
        if new:
            self.known.update(zip(new, [len(v) / max(1, n) for v, n in zip(new, self.encoder.counts(new).tolist())]))

    def per_subword(self, value: str) -> float:
        """Characters per subword."""
        if value not in self.known:
            self.measure([value])
        return self.known[value]

    def unnatural(self, value: str) -> bool:
        """Whether a string is neither words nor a name."""
        if self.per_subword(value) > UNNATURAL_CPS:
            return False
        mixed = UPPER.search(value) and LOWER.search(value)
        return bool(DIGIT.search(value) and (UPPER.search(value) or LOWER.search(value)) or len(value) >= 10 and (mixed or re.search(r"[^\w\-./:]", value)))

    def literal(self, value: str) -> bool:
        """Whether a value in a place of credentials is one, and not a placeholder, a name or a word."""
        if len(value) < LEAST or any(c.isspace() for c in value) or PLACEHOLDER.match(value) or value[0] in "<{$^%" and value[-1] in ">}$":
            return False
        if DIGEST.match(value) or value.startswith(("data:", "-----BEGIN", "http://", "https://", "ssh-rsa ", "^")):
            return False
        return self.unnatural(value) or bool(WORDY.fullmatch(value))

    def neutral(self, value: str, before: str) -> bool:
        """Whether an unnamed literal is random enough to be a key."""
        if len(value) > KEY_MOST or not DIGIT.search(value) or not UPPER.search(value) or not LOWER.search(value):
            return False
        if HEX.fullmatch(value) or UUID.fullmatch(value) or DIGEST.match(value) or PLACEHOLDER.match(value):
            return False
        if PUBLIC.search(owner(before)) or before.rstrip(" \"'`").endswith(("base64,", "BEGIN")):
            return False
        return self.per_subword(value) <= RANDOM_CPS and math.log2(len(set(value))) >= 3.2

    def find(self, text: str) -> list[tuple[int, int]]:
        """[begin, end) of each credential, in order, without overlaps."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        if len(self.known) > KNOWN:
            self.known.clear()
        pieces = []
        for text in texts:
            own = []
            for m in RUN.finditer(text):
                run = m.group()
                own.append((m.start(), run))
                if JOINT.search(run):
                    own += [(m.start() + p.start(), p.group()) for p in PIECE.finditer(run)]
            pieces.append(own)
        self.measure([value for own in pieces for _, value in own])
        return [self._find(text, [at for at, value in own if self.per_subword(value) <= UNNATURAL_CPS]) for text, own in zip(texts, pieces)]

    def _find(self, text: str, unnatural: list[int]) -> list[tuple[int, int]]:
        spans: list[tuple[int, int]] = []
        if unnatural and "PRIVATE KEY" in text:
            for m in PEM.finditer(text):
                end = text.find("-----END", m.end())
                body = text[m.end() : end] if end >= 0 else PEM_BODY.match(text, m.end()).group()
                key = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", body)
                if len(key) >= 40 and self.per_subword(key) <= UNNATURAL_CPS and not PLACEHOLDER.match(key[:60]):
                    stop = re.compile(r"-----END[A-Z0-9 ]*-----").match(text, end) if end >= 0 else None
                    spans.append((m.start(), stop.end() if stop else m.end() + len(body)))
        if "://" in text:
            for m in URL_USER.finditer(text):
                if "@" in text[m.start() : m.end()] and not PLACEHOLDER.match(m.group(1)) and len(m.group(1)) >= 4 and "{" not in m.group(1) and "%s" != m.group(1):
                    spans.append(m.span(1))
        done = -1
        for at in unnatural:
            if at < done:
                continue
            begin, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
            done = len(text) if end < 0 else end
            spans += self._without_name(text, begin, done)
            spans += self._in_line(text, begin, done)
        for a, b in self._lines(text):
            spans += self._in_line(text, a, b)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(set(spans)):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def _without_name(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """Strings of a line that are credentials by their own looks."""
        line, spans = text[a:b], []
        for m in URL_QUERY.finditer(line):
            if "://" in line[: m.start()] and self.literal(m.group(1)):
                spans.append(m.span(1))
        for m in ISSUED.finditer(line):
            if self.unnatural(m.group()) and not PLACEHOLDER.match(m.group()) and not line[: m.start()].endswith("base64,"):
                spans.append(m.span())
        for m in QUOTED.finditer(line):
            if self.neutral(m.group(1), line[: m.start()]):
                spans.append(m.span(1))
        for m in RANDOM_RUN.finditer(line):
            if NOUN.search(line, 0, m.start()) and not PUBLIC.search(line[: m.start()]) and self.neutral(m.group(), line[: m.start()]):
                spans.append(m.span())
        return [(a + x, a + y) for x, y in spans]

    # Fixed values, in lower case: whatever ASSIGNED, CALL, HEADER, COMMAND, EXPORT, SETTING, SAID and DEFAULT match has one of these.
    KEYS = ("pass", "pw", "secret", "token", "key", "cred", "kennwort", "contrase", "bearer", "login", "logon", "log_in", "log_on", "signin", "sign_in", "auth", "connect", "bind", "opensession", "open_session", "mysql", "mariadb", "mongo", "redis-cli", "pg_", "psql", "-u")

    def _lines(self, text: str) -> list[tuple[int, int]]:
        """Lines with a word that credentials stand by and with what may be a pass phrase."""
        found = set()
        low = text.lower()
        if len(low) != len(text):  # places differ; every line is looked at
            ends = [m.start() for m in re.finditer(r"\n|\Z", text)]
            return [(a, b) for a, b in zip([0, *(end + 1 for end in ends)], ends)]
        for key in self.KEYS:
            at = low.find(key)
            while at >= 0:
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
                begin = text.rfind("\n", 0, at) + 1
                if PHRASE_LIKE.search(text, begin, end):
                    found.add((begin, end))
                at = low.find(key, end)
        return sorted(found)

    def _strings(self, line: str, at: int) -> Iterator[re.Match]:
        """The literal at a place and those joined to it."""
        while m := STRING.match(line, at):
            yield m
            at = JOIN.match(line, m.end()).end()
            if at == m.end():
                return

    def _in_line(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        line, spans = text[a:b], []
        quoted = '"' in line or "'" in line or "`" in line

        def add(span: tuple[int, int], value: str, plain: bool = False) -> None:
            value = value.rstrip("\\.,;)") if plain else value
            if self.literal(value):
                spans.append((a + span[0], a + span[0] + len(value)))

        if quoted:
            for m in ASSIGNED.finditer(line):
                begin = m.start()
                while begin and (line[begin - 1].isalnum() or line[begin - 1] in "_-.$"):
                    begin -= 1
                name = line[begin : m.end(1)]
                if ABOUT.search(name) or name.lower().startswith(("max", "min", "num")):
                    continue
                sign, at = m.group(2), m.end()
                if "," in sign and not re.search(r"[\"'`]", sign):
                    continue
                rest = line[at:]
                if LOOKUP.search(line[begin : m.end()]) or LOOKUP.match(rest):
                    continue
                opening = re.match(r"(?:\"\"|'')\s*\.join\(\[\s*|\(\s*", rest)
                for s in self._strings(line, at + (opening.end() if opening else 0)):
                    add(s.span(2), s.group(2))
                    if re.search(r"(?i)phrase", name) and PHRASE.fullmatch(s.group(2)) and not re.search(r"(?i)\b(?:the|must|enter|your|is|not|invalid|wrong|please|should|for|change|here|example)\b", s.group(2).replace("_", " ").replace("-", " ")):
                        spans.append((a + s.start(2), a + s.end(2)))
            for m in CALL.finditer(line):
                for s in self._strings(line, m.end()):
                    add(s.span(2), s.group(2))
                    break
            for m in DEFAULT.finditer(line):
                strings = list(STRING.finditer(line, m.end()))
                for s in strings:
                    gap = line[m.end() : s.start()]
                    if re.search(r"(?:,|\|\||\?\?|\bor\b|unwrap_or\w*\(|orElse\(|\?:|default\w*[(=])\s*(?:\|\w*\|\s*)?\(?$", gap) and not re.fullmatch(r"[A-Z][A-Z0-9_]+", s.group(2)):
                        if re.search(r"(?i)key|token|secret|pass|pwd|pw\b|_pw|cred|auth", line):
                            add(s.span(2), s.group(2))
        for m in MARKUP.finditer(line):
            if not ABOUT.search(m.group(1)):
                add(m.span(2), m.group(2))
        if (m := LINE_SETTING.match(line)) and SECRET_NAME.search(m.group(1)) and not ABOUT.search(m.group(1)) and not PUBLIC.search(m.group(1)):
            if not LOOKUP.search(m.group(2)) and not re.fullmatch(r"[A-Z][A-Z0-9_]+|[\w.]+\.[a-z_]\w*", m.group(2)):
                add(m.span(2), m.group(2))
        for m in HEADER.finditer(line):
            if not re.match(r"[\"'`]\s*\+", line[m.end(2) :]) or len(m.group(2)) > 12:
                add(m.span(2), m.group(2))
        for m in COMMAND.finditer(line):
            k = m.lastindex
            add(m.span(k), m.group(k), plain=m.group(k)[-1] in "\\")
        for m in EXPORT.finditer(line):
            if not ABOUT.search(m.group(1)):
                add(m.span(2), m.group(2))
        for m in SETTING.finditer(line):
            if quoted or COMMENT.match(line):
                add(m.span(1), m.group(1))
        if COMMENT.match(line) or not quoted:
            for m in SAID.finditer(line):
                if re.search(r"[\"'`#*/]|^\s*[A-Za-z]", line):
                    add(m.span(1), m.group(1), plain=True)
        return spans


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with an asterisk for every character of the spans but line ends."""
    parts, at = [], 0
    for a, b in spans:
        parts += [text[at:a], re.sub(r"[^\r\n]", "*", text[a:b])]
        at = b
    return "".join([*parts, text[at:]])


_FINDERS: dict[tuple[str, str], Finder] = {}


def finder(tokenizer_dir: str, name: str) -> Finder:
    key = (tokenizer_dir, name)
    if key not in _FINDERS:
        _FINDERS[key] = Finder(encoder(tokenizer_dir, name))
    return _FINDERS[key]


FIELDS = ("body", "docstring")


def credential_places(units: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(id, field_name, line_no, begin, length) of every credential, once each. Only places are shuffled, never texts."""
    ship(units.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = finder(tokenizer_dir, name)
        for batch in batches:
            rows: list[int] = []
            out: list[list] = [[], [], [], []]
            for c, field in enumerate(FIELDS, 1):
                texts = [t or "" for t in batch.column(c).to_pylist()]
                for i, (text, spans) in enumerate(zip(texts, own.find_all(texts))):
                    for a, b in spans:
                        rows.append(i)
                        for column, value in zip(out, (field, text.count("\n", 0, a) + 1, a, b - a)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["id", "field_name", "line_no", "begin", "length"])

    rows = units.where("id IS NOT NULL").select(F.col("id").cast("bigint"), *FIELDS)
    return rows.mapInArrow(run, "id bigint, field_name string, line_no bigint, begin bigint, length bigint").distinct()


def redacted(units: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(id, body, docstring, n_credentials): every row with its credentials masked, all other text unchanged. No shuffle."""
    ship(units.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = finder(tokenizer_dir, name)
        for batch in batches:
            counts = [0] * batch.num_rows
            columns = []
            for c in (1, 2):
                texts = batch.column(c).to_pylist()
                for i, spans in enumerate(own.find_all([t or "" for t in texts])):
                    if spans:
                        texts[i] = redact(texts[i], spans)
                        counts[i] += len(spans)
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(counts, pa.int32())], names=["id", "body", "docstring", "n_credentials"])

    return units.select(F.col("id").cast("bigint"), *FIELDS).mapInArrow(run, "id bigint, body string, docstring string, n_credentials int")
