"""Secret scan: fixed patterns and assignment-aware lexing.

Base spans come from three patterns (assigned credentials, access key ids, long
hex runs).  The method adds ``literal`` spans: the text is lexed for
name-literal pairs in source and configuration syntax (``name = "x"``,
``name: x``, ``"name": "x"``, ``name := x``, ``map["name"] = "x"``, typed
declarations, joined string parts), literals bound to a name are carried on to
later assignments from that name, and each literal is scored by how sensitive
its target names are and how much it looks like a credential.  A literal of more
than ``MAX_LITERAL`` characters is data, not a credential.  Any text is lexed in
time proportional to its length.

Spans are (kind, start, end) in code points, end exclusive, over the whole text.
Edge cases: null counts as empty and has no spans; repeated rows repeat their
answer; overlapping spans of different kinds all stay; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, map_rows

KINDS = ("assign", "access", "hex", "literal")
MIN_SCORE = 0.5

_ASSIGN = re.compile(r"(?:(?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                     r"([A-Za-z0-9+/_.=-]+)")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# equal to the runs of [0-9a-f]+ that have 16 characters or more
_HEX = re.compile(r"[0-9a-f]{16,}")

# -- lexing

_BINDS = re.compile(r"[=:]")
_QUOTED = re.compile(r"""[ \t]*(?:"((?:\\.|[^"\\\n])*)"|'((?:\\.|[^'\\\n])*)'|`([^`\n]*)`)""")
_BLANK = re.compile(r"[ \t]*")
_RUN = re.compile(r"""[^\s"'`,;(){}\[\]]*""")
_JOIN = re.compile(r"[ \t]*\+(?!=)")
_NAME = re.compile(r"[A-Za-z_$][\w$.]*$")
#: characters that a type may be written with
_TYPE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.[]<>, \t")
#: a longer literal, joined from parts or not, is data and no credential
MAX_LITERAL = 4096

# how sensitive a word of a target name is
_WORDS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "pw": 0.8,
          "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
          "credentials": 0.9, "cred": 0.8, "auth": 0.6, "authorization": 0.7, "bearer": 0.8,
          "private": 0.6, "signing": 0.6, "encryption": 0.6, "access": 0.4, "key": 0.5, "salt": 0.5,
          "dsn": 0.6, "pin": 0.5, "webhook": 0.5, "session": 0.4, "cookie": 0.4}
# words that say the value is about a credential, not one itself
_MILD = {"id", "name", "url", "uri", "path", "file", "type", "count", "length", "size", "public",
         "prompt", "label", "field", "hint", "policy", "expiry", "ttl", "limit", "max", "min"}
_PLACEHOLDER = re.compile(
    r"example|change.?me|placeholder|your|dummy|sample|todo|redacted|undefined|^(?:null|none|true|false)$"
    r"|^(.)\1*$|[x*.]{6,}|\$\{|\{\{|%\(|%s|<[^>]*>", re.I)


def name_score(name: str) -> float:
    """0..1: how strongly a target name says that its value is a credential."""
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    words = [w.lower() for w in words]
    known = sorted((_WORDS[w] for w in words if w in _WORDS), reverse=True)
    score = min(1.0, sum(known[:2])) if known else 0.0
    if words and words[-1] in _MILD:
        score -= 0.6
    return max(0.0, score)


def literal_score(text: str) -> float:
    """0..1: how much a literal looks like a credential."""
    if not 8 <= len(text) <= MAX_LITERAL or any(c.isspace() for c in text) or _PLACEHOLDER.search(text):
        return 0.0
    counts = Counter(text)
    bits = -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values())
    classes = sum(any(f(c) for c in text) for f in (str.islower, str.isupper, str.isdigit)) \
        + any(not c.isalnum() for c in text)
    return min(1.0, 0.2 * classes + bits / 8 + min(len(text), 32) / 100)


def _back(text: str, at: int, chars) -> int:
    """The start of the run of ``chars`` (a set, or a test) that ends at ``at``."""
    test = chars if callable(chars) else chars.__contains__
    while at and test(text[at - 1]):
        at -= 1
    return at


def _in_name(c: str) -> bool:
    return c.isalnum() or c in "_$.-"


def _name_before(text: str, at: int) -> str | None:
    """The plain, quoted or subscripted name that ends at ``at``, blanks aside.

    Looks at no character twice for two binding signs but for the blanks and
    quotes around a name, so a text is lexed in linear time.
    """
    at = _back(text, at, " \t")
    last = text[at - 1] if at else ""
    if last == "]":
        end = _back(text, at - 1, " \t")
        if not end or text[end - 1] not in "\"'":
            return None
        at, last = end, text[end - 1]
    if last in ("'", '"'):
        start = text.rfind(last, 0, at - 1)
        name = text[start + 1:at - 1] if start >= 0 else ""
        return name if name and len(name) <= MAX_LITERAL and "\n" not in name else None
    start = _back(text, at, _in_name)
    while start < at and not (text[start].isalpha() or text[start] in "_$"):
        start += 1
    return text[start:at] or None


def _target(text: str, at: int) -> str | None:
    """The name that the binding sign at ``at`` binds."""
    end = _back(text, at, " \t")
    if text[at] == "=" and end and text[end - 1] == ":":
        return _name_before(text, end - 1)                 # name := value
    if text[at] == "=" and end:
        start = _back(text, end, _TYPE)                     # name: some type = value
        kind = text[start:end].lstrip()
        if start and text[start - 1] == ":" and (kind[:1].isalpha() or kind[:1] == "_"):
            typed = _name_before(text, start - 1)
            if typed:
                return typed
    return _name_before(text, end)


class _Runs:
    """Ends of unquoted runs; a run is read once, however many signs it holds."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, 0, 0

    def end_of(self, at: int) -> int:
        if not self.start <= at < self.end:
            self.start, self.end = at, _RUN.match(self.text, at).end()
        return self.end


def _binding(text: str, at: int, runs: _Runs) -> tuple[str, list[tuple[str, int, int]], list[str]] | None:
    """(target name, literals, names referred to) of the = or : at ``at``."""
    nxt = text[at + 1:at + 2]
    if nxt == "=" and text[at] == "=" or text[at - 1:at] in ("=", "!", "<", ">") or nxt == ":" \
            or text[at - 1:at + 1] == "::" or text.startswith("//", at + 1):
        return None
    if text[at] == ":" and nxt == "=":
        return None                                     # taken at its =
    target = _target(text, at)
    if not target:
        return None
    place = at + 1 + (nxt == ">" and text[at] == "=")
    literals, names = [], []
    while True:
        piece = _QUOTED.match(text, place)
        if piece:
            start, end = piece.span(piece.lastindex)
            after = piece.end()
        else:
            start = _BLANK.match(text, place).end()
            end = after = runs.end_of(start)
        if start == end and not piece or end - start > MAX_LITERAL:
            break
        value = text[start:end]
        if piece:
            literals.append((value, start, end))
        elif place > at + 2 and _BINDS.search(value):
            break                                       # the next pair, not a part of this one
        elif _NAME.match(value):
            names.append(value)
            if text[at] == ":" or at == 0 or text[at - 1] not in " \t":   # unquoted configuration value
                literals.append((value, start, end))
        else:
            literals.append((value, start, end))
        join = _JOIN.match(text, after)
        if not join:
            break
        place = join.end()
    return target, literals, names


class _Value:
    """What an assignment binds: literals of its own and the values it refers to."""

    __slots__ = ("literals", "of", "text", "weight", "whole")

    def __init__(self, literals: list[tuple[str, int, int]], of: list[_Value]):
        self.literals, self.of = literals, of
        text = "".join(x[0] for x in literals)
        for value in of:
            text = None if text is None or value.text is None else text + value.text
            if text is None or len(text) > MAX_LITERAL:
                text = None
        self.text = text                 # joined, if that is short enough to be one credential
        self.weight = self.whole = 0.0   # of the most sensitive names it reaches


def literal_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that sensitive names are bound to, directly
    or through other names.

    An assignment keeps references to the values it uses, so what a name carries is
    never copied out; the sensitivity of names flows back through the references
    once, from the last assignment to the first.
    """
    runs = _Runs(text)
    bound: dict[str, _Value] = {}
    values: list[_Value] = []
    for hit in _BINDS.finditer(text):
        pair = _binding(text, hit.start(), runs)
        if pair is None:
            continue
        target, literals, names = pair
        carried = list({id(bound[n]): bound[n] for n in names if n in bound}.values())
        if carried:
            literals = [x for x in literals if x[0] not in names]
        if not literals and not carried:
            continue
        value = _Value(literals, carried)
        values.append(value)
        if _NAME.match(target):
            bound[target] = value
        value.weight = name_score(target)
        if value.weight > 0:
            value.whole = value.weight * literal_score(value.text or "")
    best: dict[tuple[int, int], float] = {}
    for value in reversed(values):
        if value.weight <= 0:
            continue
        for used in value.of:
            used.weight, used.whole = max(used.weight, value.weight), max(used.whole, value.whole)
        for literal, start, end in value.literals:
            score = round(max(value.whole, value.weight * literal_score(literal)), 6)
            if score >= min_score and end > start:
                best[start, end] = max(best.get((start, end), 0.0), score)
    return sorted((a, b, s) for (a, b), s in best.items())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind as listed."""
    out = []
    lowered = text.lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return _ordered(out)


def _ordered(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(text: str, min_score: float = MIN_SCORE) -> tuple[list, list]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    return base, _ordered(base + [("literal", a, b) for a, b, _ in literal_spans(text, min_score)])


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: id, ``n_assign``, ``n_access``, ``n_hex``,
    ``n_literal``, ``base_sha256`` and ``spans`` (kind:start:end, joined by
    commas)."""

    def make():
        def work(ids, texts):
            out = {"id": ids, "n_assign": [], "n_access": [], "n_hex": [], "n_literal": [],
                   "base_sha256": [], "spans": []}
            for text in map(pa.StringScalar.as_py, texts):
                base, spans = scan(text, min_score)
                count = Counter(k for k, _, _ in spans)
                for kind in KINDS:
                    out[f"n_{kind}"].append(count[kind])
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            return out
        return work

    slim = docs.select(F.col(id_col).cast("long").alias("id"), clean_text(text_col).alias("t"))
    return map_rows(slim, "id long, n_assign long, n_access long, n_hex long, n_literal long, "
                          "base_sha256 string, spans string", make).withColumnRenamed("id", id_col)
