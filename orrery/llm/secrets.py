"""Secret scans (operator 6): assignment-aware lexing.

The lexer reads source and configuration syntax anywhere in a text: ``name = "literal"``, ``name: literal``, ``:=``, ``=>``,
``map["name"] = ...``, annotated names (``name: str = ...``), JSON and YAML keys, ``--name literal``, ``call("name",
"literal")``, ``{"name": "NAME", "value": "literal"}``, ``<name>literal</name>`` and ``scheme://user:literal@host``. Values
are strings, joined strings, other names, and templates (``${name}``, ``f"{name}"``): the constants that earlier (or, failing
that, later) assignments gave to those names are propagated into them, through any number of names. A name whose value leads
back to itself is unknown. Text in comments and prose is read alike.

A literal's score is the sensitivity of its target name (of its words: password, token, key ...) times the strength of the
literal (its entropy against what such names need; placeholders have none). Those of ``threshold`` or more are reported:
doc_id, line (from 1), start (character at which the value begins), name, kind (string, bare, joined, reference, element,
call, pair, flag, url), length, digest (SHA-256 of the literal, which itself isn't repeated) and score.

Each assignment is worked out once. A value put together of several parts is spelled out up to ``EXPANDED`` characters; of a
longer one (twenty lines that double each other have a million characters) only the length, the count of each character and
both ends are carried, from which its length and score follow exactly, whatever its size. Such a finding is reported like any
other, but its digest is null, and whether it is a placeholder is judged by its ends.

Texts without a sensitive word stem or an operator can have no finding and aren't lexed; all others are read whole.

Cases: null and empty texts have no findings; null ids are carried; rows are scanned one by one, so repeated rows give
repeated findings; of several values at one place the best scored one counts; an empty table gives an empty result; the
result has the columns named above only, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts_of

THRESHOLD = 0.5
#: Characters up to which a value of several parts is spelled out, and those of its ends that are kept beyond.
EXPANDED = 1 << 14
_ENDS = 64

#: Stems by the sensitivity they give a name and the bits of entropy at which a literal counts fully.
_SENSITIVE: list[tuple[float, int, tuple[str, ...]]] = [
    (1.0, 18, ("password", "passwd", "passphrase", "pwd", "passcode")),
    (1.0, 40, ("secret", "token", "apikey", "accesskey", "secretkey", "privatekey", "signingkey", "encryptionkey", "authkey", "credential", "credentials")),
    (0.7, 60, ("bearer", "authorization", "auth", "signature", "salt", "cookie", "session")),
    (0.6, 90, ("key", "cert", "pin")),
]
_WEAKER = {"public", "name", "file", "path", "url", "uri", "length", "len", "count", "type", "field", "label", "hint", "policy", "column", "expires", "expiry", "ttl", "header", "prefix", "id", "size", "limit", "max", "min", "index"}
#: A name's parts are joined before they are compared, so that anything but letters and digits may lie within a stem.
_STEMS = re.compile("|".join(["://", *("[^A-Za-z0-9]*".join(stem) for stem in sorted({s for _, _, stems in _SENSITIVE for s in stems} - {"apikey", "accesskey", "secretkey", "privatekey", "signingkey", "encryptionkey", "authkey", "credentials", "password", "passwd"} | {"passw"}))]), re.IGNORECASE)
_STEM_PATTERN = "(?i)" + _STEMS.pattern
_OPERATOR = re.compile(r"=>|:=|[+|]?=|:")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_STRING = re.compile(r"""([rRbBuUfF]{0,2})(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`)""", re.DOTALL)
_REFERENCE = re.compile(r"[A-Za-z_][\w$]*(?:(?:\.|->|::)[A-Za-z_][\w$]*)*(?![\w(\-/+=@!%^&*~])")
_BARE = re.compile(r"""(?:\$\{[^}\n]*\}|[^\s"'`;,(){}\[\]<>])+""")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\|\||\.(?=\s*['\"$]))\s*|\s*\\\n\s*|[ \t]+(?=['\"])")
_TEMPLATE = re.compile(r"\$\{\s*([\w.]+)\s*\}|\$([A-Za-z_]\w*)|#\{\s*([\w.]+)\s*\}")
_FORMAT = re.compile(r"\{\s*([A-Za-z_][\w.]*)\s*\}")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*)(?:\s[^<>]*)?>([^<>\n]+)</\1\s*>")
_CALL = re.compile(r"""\(\s*(["'])([\w.\-]+)\1\s*,\s*(["'])([^"'\n]*)\3""")
_PAIR = re.compile(r"""(?:name|key)["']?\s*[=:]\s*(["'])([\w.\-]+)\1\s*,?\s*["']?value["']?\s*[=:]\s*(["'])([^"'\n]*)\3""", re.IGNORECASE)
_FLAG = re.compile(r"""(?<!\S)--?([A-Za-z][\w\-]+)[ \t]+([^\s\-"'][^\s"']*)""")
_URL = re.compile(r"[A-Za-z][\w+.\-]*://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:|none|null|nil|true|false|undefined|changeme|change[_-]?me|example.*|placeholder|todo|fixme|tbd|redacted|hidden|dummy|sample|your[_\- ].*|my[_\- ]?(?:password|secret|token|key)|"
    r"pass(?:word|wd)?|secret|token|api[_-]?key|str(?:ing)?|int|bool|text|(.)\1*|<.*>|\[.*\]|\{\{.*\}\}|\$\{.*\}|\$\w+|%\w+%?|os\.environ.*|process\.env.*|env\..*)$"
)


class Finding(NamedTuple):
    line: int
    start: int
    name: str
    kind: str
    length: int
    digest: str | None
    score: float


class Assignment(NamedTuple):
    name: str
    start: int  #: of the value
    kind: str
    terms: list[tuple[str, str]]  #: (literal, template, format or reference; its text)


def sensitivity(name: str) -> tuple[float, int]:
    """How sensitive a name is, and the bits that a literal of that name should have."""
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(len(words), i + 3) + 1)} | {w.rstrip("s") for w in words}
    for weight, bits, stems in _SENSITIVE:
        if any(s in joined for s in stems):
            return (weight * 0.3 if words and (words[-1] in _WEAKER or words[0] == "public") else weight), bits
    return 0.0, 0


class Value(NamedTuple):
    """What a name holds: its text, or of a long one the counts of its characters and its ends."""

    length: int
    text: str | None
    counts: Counter | None = None
    ends: tuple[str, str] = ("", "")


def joined(parts: list[Value]) -> Value:
    """The parts one after another."""
    if len(parts) == 1:
        return parts[0]
    length = sum(p.length for p in parts)
    if length <= EXPANDED:
        return Value(length, "".join(p.text or "" for p in parts))
    counts: Counter = Counter()
    head = tail = ""
    for p in parts:
        counts.update(p.counts if p.text is None else Counter(p.text))
        if len(head) < _ENDS:
            head = (head + (p.ends[0] if p.text is None else p.text[:_ENDS]))[:_ENDS]
        tail = (tail + (p.ends[1] if p.text is None else p.text[-_ENDS:]))[-_ENDS:]
    return Value(length, None, counts, (head, tail))


def strength(value: Value, bits: int) -> float:
    """A literal's entropy over ``bits``, at most 1; phrases count less, placeholders nothing."""
    literal = value.text.strip() if value.text is not None else None
    counts, n = (Counter(literal), len(literal)) if literal is not None else (value.counts, value.length)
    if len(counts) < 2 or _PLACEHOLDER.match("".join(value.ends) if literal is None else literal):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    if bits > 18 and not any(c.isdigit() for c in counts):
        entropy *= 0.5
    return min(1.0, entropy * n / bits) * (0.3 if any(c.isspace() for c in counts) else 1.0)


def _name_before(text: str, end: int) -> tuple[str, int]:
    """The name that ends before ``end``, and where it begins."""
    i = end
    while i and text[i - 1] in " \t":
        i -= 1
    if i and text[i - 1] == "]":
        i -= 1
        while i and text[i - 1] in " \t":
            i -= 1
    if i and text[i - 1] in "\"'":
        j = text.rfind(text[i - 1], max(0, text.rfind("\n", 0, i - 1)), i - 1)
        return (text[j + 1 : i - 1], j) if j >= 0 else ("", i)
    j = i
    while j and (text[j - 1].isalnum() or text[j - 1] in "_.-$"):
        j -= 1
    return text[j:i].lstrip("-.$"), j


def _terms(text: str, at: int) -> tuple[int, str, list[tuple[str, str]]]:
    """The value that begins at ``at``: its start, kind and terms."""
    while at < len(text) and text[at] in " \t":
        at += 1
    first, terms, kind = at, [], ""
    while True:
        if m := _STRING.match(text, at):
            body = next((g for g in m.groups()[1:] if g is not None), "")
            terms.append(("format" if "f" in m[1].lower() else "template", body))
            kind = kind and "joined" or "string"
        elif (m := _REFERENCE.match(text, at)) and not m[0].isdigit():
            terms.append(("reference", m[0]))
            kind = kind and "joined" or "reference"
        elif not terms and (m := _BARE.match(text, at)):
            terms.append(("template", m[0]))
            return first, "bare", terms
        else:
            break
        joint = _JOIN.match(text, m.end())
        if not joint:
            break
        at = joint.end()
    return first, kind, terms


def assignments(text: str) -> Iterator[Assignment]:
    """The name-value pairs of a text, in order of their operators."""
    for m in _OPERATOR.finditer(text):
        a, b = m.span()
        if a and text[a - 1] in "=!<>:" or b < len(text) and text[b] in "=:>" or (m[0] == ":" and text.startswith("//", b)):
            continue
        name, begin = _name_before(text, a)
        if not name:
            continue
        if m[0] == "=" and (k := text.rfind(":", max(0, text.rfind("\n", 0, begin)), begin)) >= 0 and not text[k + 1 : begin].strip(" \t"):
            name = _name_before(text, k)[0] or name  # an annotation lies between
        start, kind, terms = _terms(text, b)
        if terms:
            yield Assignment(name, start, kind, terms)
    if "</" in text:
        yield from (Assignment(m[1], m.start(2), "element", [("template", m[2])]) for m in _ELEMENT.finditer(text))
    if "(" in text:
        yield from (Assignment(m[2], m.start(4), "call", [("template", m[4])]) for m in _CALL.finditer(text))
    if "value" in text.lower():
        yield from (Assignment(m[2], m.start(4), "pair", [("template", m[4])]) for m in _PAIR.finditer(text))
    if "-" in text:
        yield from (Assignment(m[1], m.start(2), "flag", [("template", m[2])]) for m in _FLAG.finditer(text))
    if "://" in text:
        yield from (Assignment("url.password", m.start(1), "url", [("literal", m[1])]) for m in _URL.finditer(text))


def _last(name: str) -> str:
    return re.split(r"\.|->|::", name)[-1]


class Definitions:
    """The assignments of a text by name, and which of them a reference means."""

    def __init__(self, found: list[Assignment]):
        self.found = found
        self.by_name: dict[str, list[tuple[int, int]]] = {}
        for i, a in enumerate(found):
            for key in {a.name, _last(a.name)}:
                self.by_name.setdefault(key, []).append((a.start, i))
        for places in self.by_name.values():
            places.sort()

    def meant(self, at: int, name: str) -> int | None:
        """The last assignment to ``name`` before assignment ``at``; else the first after it; else none."""
        places = self.by_name.get(name) or self.by_name.get(_last(name)) or []
        start = self.found[at].start
        before = bisect_left(places, (start, -1))
        if before:
            return places[before - 1][1]
        after = bisect_left(places, (start + 1, -1))
        return places[after][1] if after < len(places) else None

    def parts(self, at: int) -> list[list[tuple[str | None, int | None]]]:
        """For each term of an assignment its pieces: texts, and names with the assignment that is meant."""
        out = []
        for kind, body in self.found[at].terms:
            if kind == "reference":
                out.append([(None, self.meant(at, body))])
                continue
            pieces, end = [], 0
            if kind in ("template", "format"):
                for m in (_FORMAT if kind == "format" else _TEMPLATE).finditer(body):
                    pieces += [(body[end : m.start()], None), (None, self.meant(at, next(g for g in m.groups() if g)))]
                    end = m.end()
            out.append([*pieces, (body[end:], None)])
        return out


def _groups(roots: list[int], needs: dict[int, set[int]]) -> Iterator[list[int]]:
    """Everything that ``roots`` need, in groups that need each other, each after those that it needs (by Tarjan's method, without recursion)."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on: set[int] = set()
    for root in roots:
        work = [(root, iter(needs[root]))] if root not in index else []
        while work:
            node, rest = work[-1]
            if node not in index:
                index[node] = low[node] = len(index)
                stack.append(node)
                on.add(node)
            for other in rest:
                if other not in index:
                    work.append((other, iter(needs[other])))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    yield group


def _values(known: Definitions, wanted: list[int]) -> Iterator[tuple[int, Value]]:
    """The values of the ``wanted`` assignments that can be worked out; others are let go once nothing needs them any more."""
    parts: dict[int, list] = {}
    needs: dict[int, set[int]] = {}
    todo = list(wanted)
    while todo:
        at = todo.pop()
        if at not in needs:
            parts[at] = known.parts(at)
            needs[at] = {i for term in parts[at] for _, i in term if i is not None}
            todo += needs[at]
    uses = Counter(i for at in needs for i in needs[at])
    value: dict[int, Value | None] = {}
    asked = set(wanted)
    for group in _groups(wanted, needs):
        inside = set(group)
        for at in group:
            a, pieces = known.found[at], []
            for (kind, body), term in zip(a.terms, parts[at], strict=True):
                for text, i in term:
                    piece = Value(len(text), text) if text is not None else value.get(i) if i is not None and i not in inside else None
                    if piece is None and kind == "reference" and len(a.terms) == 1 and a.kind == "reference":
                        piece = Value(len(body), body)  # nothing defines it: a bare word, as in configuration files
                    pieces.append(piece)
            value[at] = None if any(p is None for p in pieces) else joined(pieces)
            if at in asked and value[at] is not None:
                yield at, value[at]
        for i in [i for at in group for i in needs[at]]:
            uses[i] -= 1
            if not uses[i]:
                value.pop(i, None)
        for at in group:
            if not uses[at]:
                value.pop(at, None)


def findings(text: str, threshold: float = THRESHOLD) -> list[Finding]:
    """What a text assigns to sensitive names."""
    found = list(assignments(text))
    weights = [(1.0, 18) if a.kind == "url" else sensitivity(a.name) for a in found]
    best: dict[int, Finding] = {}
    for at, value in _values(Definitions(found), [i for i, (weight, _) in enumerate(weights) if weight]):
        a, (weight, bits) = found[at], weights[at]
        if value.text == a.name:
            continue
        score = weight * strength(value, bits)
        if a.kind == "reference" and value.text == a.terms[0][1] and not any(c.isdigit() for c in value.text):
            score *= 0.4  # a mere word
        if score >= threshold and (a.start not in best or (score, a.name) > (best[a.start].score, best[a.start].name)):
            digest = hashlib.sha256(value.text.encode()).hexdigest() if value.text is not None else None
            best[a.start] = Finding(text.count("\n", 0, a.start) + 1, a.start, a.name, a.kind, min(value.length, (1 << 63) - 1), digest, round(score, 4))
    return [best[k] for k in sorted(best)]


def secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The findings of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def worker(batches):
        for batch in batches:
            index, rows = [], []
            for i, text in enumerate(texts_of(batch).to_pylist()):
                if text and _STEMS.search(text):
                    for f in findings(text, threshold):
                        index.append(i)
                        rows.append(f)
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *Finding._fields])

    likely = docs.select("doc_id", "text").where("text LIKE '%=%' OR text LIKE '%:%' OR text LIKE '%</%' OR text LIKE '%(%' OR text LIKE '%-%'")
    # A JVM-side test leaves few texts for Python: without a stem no name is sensitive.
    likely = likely.where(likely["text"].rlike(_STEM_PATTERN))
    return likely.mapInArrow(worker, f"doc_id {kind}, line int, start int, name string, kind string, length long, digest string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding in the whole table ``documents``."""
    return secrets(table(spark, sf_dir, "documents"))
