"""Secrets: fixed patterns, and assignment-aware lexing beside them.

The patterns (``base_spans``) are exact and always kept.  A linear lexer cuts the text into strings (prefixed,
triple-quoted, escaped), operators, names, elements and setter calls of the common source and configuration
families, and reads off name-literal pairs: assignments with or without a type, subscripts, JSON and YAML keys, block scalars,
XML elements and attributes, ``define("NAME", "literal")`` and its like, ``ENV NAME literal``; chains of ``+`` are one value.  A
bare name on the right side stands for the literal it was given before (or, failing that, after), so
constants are propagated to the names they end up under; other bare names are no literals.  A literal is scored by the words of all
names that reach it (password, token, private key; but not token_count or key_file) and by
its own look (length, character mix, entropy; not a placeholder), and is reported where the
score is high enough and no pattern's span holds it already.

Edge cases: null and empty texts have no span; an empty table gives an empty result; repeated rows
are scanned each; very long words and lines cost linear time; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# The patterns of the task's contract, with the letters of the names in either case.
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in _NAMES)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "literal")

# What the words of a name say about its value.
NAME_WORDS = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 3.0, "pass": 2.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "bearer": 2.5, "auth": 1.5, "authorization": 1.5, "key": 1.0, "private": 1.5,
    "access": 0.5, "api": 0.5, "signing": 1.0, "encryption": 1.0, "client": 0.2, "salt": 1.0, "webhook": 1.0, "dsn": 1.0,
    "id": -1.0, "name": -2.0, "file": -2.5, "path": -2.5, "dir": -2.5, "url": -1.5, "uri": -1.5, "count": -3.0,
    "length": -3.0, "len": -3.0, "size": -3.0, "max": -2.0, "min": -2.0, "type": -2.5, "ttl": -3.0, "expiry": -3.0,
    "policy": -2.5, "hint": -2.0, "field": -2.0, "label": -2.0, "public": -3.0, "reset": -1.0, "limit": -3.0,
}
# A placeholder is one as a whole: words with separators and templates, at least one of which says so.
WORDY = re.compile(
    r"(?:(?:[A-Z]++[0-9!]*+|[0-9!]++)(?![A-Z0-9!])|\*++|<[^<>]*+>|\$\{[^{}]*+\}|\{\{[^{}]*+\}\}|[-_. :/@]++)++", re.I)
STANDS_IN = re.compile(
    r"(?<![A-Z])(?:changeme|example|placeholder|x{3,}|your(?=[-_ ]))(?![A-Z])|\*\*\*|<|\$\{|\{\{|^(?:none|null|true|false|todo|test)$",
    re.I)
MIN_SCORE = 4.0
# Values of passphrases: several plain words under a name at least this sensitive.
PHRASE_NAME, PHRASE = 3.0, re.compile(r"[a-z0-9]+(?:[ -][a-z0-9]+)+")

# --- lexer: what a text is cut into; everything else is skipped by the search itself ---------------
STRING = r"""(?P<string>(?<![\w\\])[fFrRbBuU]{0,2}(?:\"{3}(?P<t3>(?s:.*?))\"{3}|'{3}(?P<s3>(?s:.*?))'{3}|"(?P<d1>(?:[^"\\\n]++|\\.)*+)"
    |'(?P<s1>(?:[^'\\\n]++|\\.)*+)'|`(?P<b1>[^`\n]*+)`))"""
SCAN = re.compile(STRING + r"""
    |(?P<op>=>|:=|[=!<>]=|=|:(?!//))
    |<(?P<tag>[A-Za-z_][\w.:-]*+)(?P<attributes>[^<>\n]*+)>(?P<inner>[^<>\n]++)</(?P=tag)>
    |\b(?P<call>(?:define|[sS]et\w*|[pP]ut\w*|add\w*|register\w*|export)\s*+\()
    |^[ \t]*+(?:ENV|ARG|setx?|export)[ \t]++(?P<env>[A-Za-z_]\w*+)[ \t]++(?P<given>[^\s=][^\n]*+)$""", re.X | re.M)
BARE = re.compile(r"[A-Za-z0-9+/_.=$~^!%-]++")
VALUE_STRING = re.compile(STRING, re.X)
GAP = re.compile(r"[ \t]*+(?:\\\n[ \t]*+|\([ \t]*+\n?[ \t]*+)?+")
JOIN = re.compile(r"[ \t]*+(?:[+.][ \t]++(?=[\"'`A-Za-z_])|\+(?=[\"'`A-Za-z_])|(?=[\"']))")
JOIN_OPEN = re.compile(r"\s*+(?:[+.]\s*+(?=[\"'`A-Za-z_])|(?=[\"'`]))")
BLOCK = re.compile(r"[ \t]*+[|>][-+0-9]*+[ \t]*+\n")
TYPE = re.compile(r"[ \t]*+[A-Za-z_][\w.]*+(?:\[[^\[\]\n]*+\])?(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+)*+[ \t]*+=(?!=)")
AFTER_STRING = re.compile(r"[ \t]*+\]?[ \t]*+")
SECOND = re.compile(r"\s*+,\s*+")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
# A bare value like these names something else: words in a row, digits at their ends only.
NAME_LIKE = re.compile(r"_*(?:[A-Z]?[a-z]+|[A-Z]+(?![a-z]))(?:[_.-]*(?:[A-Z]?[a-z]+|[A-Z]+(?![a-z])))*[_.-]*[0-9]*\Z")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """All spans of the three patterns, by start and kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def name_score(name: str) -> float:
    return sum(NAME_WORDS.get(w.lower(), 0.0) for w in WORDS.findall(name))


class Value:
    """What a chain of literals and constants looks like.  Sums over its parts, so that a constant is
    never spelled out again where it is used and long or nested chains cost linear time."""

    __slots__ = ("size", "counts", "words", "open_left", "open_right", "wordy", "stands_in", "phrase", "named", "span", "parts")

    def __init__(self, literal: str = "", start: int = 0, end: int = 0):
        self.size, self.counts, self.words = len(literal), Counter(literal), len(literal.split())
        self.open_left, self.open_right = literal[:1].strip() != "", literal[-1:].strip() != ""
        self.wordy = not literal or WORDY.fullmatch(literal) is not None
        self.stands_in = self.wordy and STANDS_IN.search(literal) is not None
        self.phrase = PHRASE.fullmatch(literal) is not None
        self.named, self.span, self.parts = -math.inf, (start, end), []

    @classmethod
    def chain(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = cls()
        for p in parts:
            out.words += p.words - (out.open_right and p.open_left)
            if p.size:
                out.open_left, out.open_right = out.open_left if out.size else p.open_left, p.open_right
            out.size += p.size
            out.counts.update(p.counts)
            out.wordy, out.stands_in = out.wordy and p.wordy, out.stands_in or p.stands_in
            out.phrase = p.phrase if not out.size else False
            out.named = max(out.named, p.named)
            if out.size > 1 << 50:  # constants doubled over and over: only the shares matter from here
                out.size, out.words = out.size / 1024, min(out.words, 1 << 50)
                out.counts = Counter({c: n / 1024 for c, n in out.counts.items()})
        out.parts = parts
        return out

    def under(self, name: str) -> Value:
        """The same value as it is known under one more name."""
        out = Value()
        for k in self.__slots__:
            setattr(out, k, getattr(self, k))
        out.named, out.parts = max(self.named, name_score(name)), [self]
        return out

    def score(self) -> float:
        """How much it looks like a secret: entropy, mix and length; -inf for what cannot be one."""
        if self.size < 6 or self.wordy and self.stands_in:
            return -math.inf
        if self.counts[" "] and self.words > 4 and not (self.phrase and self.named >= PHRASE_NAME):
            return -math.inf
        entropy = -sum(n / self.size * math.log2(n / self.size) for n in self.counts.values() if n)
        mix = sum(any(f(c) for c in self.counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        return min(2.0, entropy / 2) + 0.5 * (mix - 1) + (0.5 if self.size >= 16 else 0.0)


def literal_score(literal: str) -> float:
    return Value(literal).score()


def inner(m: re.Match) -> tuple[int, int]:
    """Where the text of a string literal lies, without prefix and quotes."""
    return m.span(next(g for g in ("t3", "s3", "d1", "s1", "b1") if m[g] is not None))


def name_end(text: str, low: int, end: int) -> tuple[int, int]:
    """The name that ends before ``end`` (blanks between), not before ``low``."""
    while end > low and text[end - 1] in " \t":
        end -= 1
    start = end
    while start > low and (text[start - 1].isalnum() or text[start - 1] in "_.-$"):
        start -= 1
    while start < end and not (text[start].isalpha() or text[start] == "_"):
        start += 1
    return start, end


def block_scalar(text: str, line: int, at: int) -> tuple[int, int]:
    """The indented lines that follow a block mark (``line``: start of the mark's line)."""
    depth = 0
    while line + depth < len(text) and text[line + depth] in " \t":
        depth += 1
    first = last = at
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        body = at
        while body < end and text[body] in " \t":
            body += 1
        if body < end:
            if body - at <= depth:
                break
            first = body if first == last else first
            last = end
        at = end + 1
    return first, last


ENV_LINE = re.compile(r"^[ \t]*+(?:ENV|ARG|setx?|export)[ \t]", re.M)


class Lexer:
    """Pairs (name, parts) of one text; a part is a literal (start, end) or a reference (name, start, end)."""

    def __init__(self, text: str):
        self.text, self.found, self.whole = text, [], True

    def value(self, at: int) -> tuple[list, int]:
        """Parts of the chain of strings and bare words at ``at``, and where it ends."""
        text, parts = self.text, []
        gap = GAP.match(text, at)
        at, join = gap.end(), JOIN_OPEN if "(" in gap[0] else JOIN
        while True:
            if m := VALUE_STRING.match(text, at):
                parts.append(inner(m))
            elif m := BARE.match(text, at):
                parts.append((m[0], m.start(), m.end()))
            else:
                break
            at = m.end()
            more = join.match(text, at)
            if not more or more.end() == at and not VALUE_STRING.match(text, at):
                break
            at = more.end()
        return parts, at

    def pair(self, name: str, at: int, line: int = -1) -> int:
        """Note the pair of ``name`` and the value at ``at``; where the value ends."""
        if line >= 0 and (m := BLOCK.match(self.text, at)):
            start, end = block_scalar(self.text, line, m.end())
            if end > start:
                self.found.append((name, [(start, end)]))
                return end
            return m.end()
        parts, end = self.value(at)
        if parts and name:
            self.found.append((name, parts))
        for part in parts:
            if len(part) == 2:
                self.inside(*part)
        return end if parts else at

    def inside(self, start: int, end: int) -> None:
        """Lex what a string of the text itself holds (not the strings in it)."""
        if self.whole and any(c in self.text[start:end] for c in "=:"):
            self.whole = False
            self.run(start, end)
            self.whole = True

    def run(self, low: int, high: int) -> None:
        """Lex text[low:high]; strings that are neither name nor value are lexed inside once more."""
        text, done, at, annotated = self.text, low, low, None
        setter = False
        while m := SCAN.search(text, at, high):
            at, kind = m.end(), m.lastgroup
            if m["string"] is not None:
                start, end = inner(m)
                after = AFTER_STRING.match(text, at).end()
                sign = next((s for s in ("=>", ":=", "=", ":") if text.startswith(s, after)), "")
                if sign and not text.startswith(("==", "://"), after):
                    at = done = self.pair(text[start:end], after + len(sign), text.rfind("\n", 0, start) + 1 if sign == ":" else -1)
                elif setter and (comma := SECOND.match(text, at)):
                    at = done = self.pair(text[start:end], comma.end())
                else:
                    self.inside(start, end)
                setter = False
            elif m["op"]:
                op = m["op"]
                if op in ("==", "!=", "<=", ">=") or op == ":" and text.startswith(":", at):
                    continue
                if op == "=" and annotated and annotated[1] == m.end():
                    name = annotated[0]
                else:
                    start, end = name_end(text, done, m.start())
                    if start == end:
                        continue
                    name = text[start:end]
                    if op == ":" and (kind := TYPE.match(text, at)):  # name: type = value
                        annotated, at = (name, kind.end()), kind.end() - 1
                        continue
                at = done = max(at, self.pair(name, at, text.rfind("\n", 0, m.start()) + 1 if op == ":" else -1))
            elif m["tag"]:
                self.found.append((m["tag"], [m.span("inner")]))
                if "=" in m["attributes"]:
                    self.run(*m.span("attributes"))
                done = at
            elif m["call"]:
                setter = True
            elif m["env"]:
                at = done = max(m.start("given"), self.pair(m["env"], m.start("given")))


def pairs(text: str) -> Iterator[Value]:
    """The value of every assignment with the best score of the names it came through, constants propagated: a bare name
    stands for the literal it was given before or, if there is none, by its first assignment after."""
    lexer = Lexer(text)
    lexer.run(0, len(text))
    constants: dict[str, Value] = {}
    first: dict[str, Value] = {}
    late: list[tuple[str, list]] = []
    for name, parts in lexer.found:
        built, waits = [], False
        for part in parts:
            if len(part) == 2:
                built.append(Value(text[part[0]:part[1]], *part))
                continue
            word, start, end = part
            named = IDENTIFIER.match(word)
            if named and (origin := constants.get(word)):
                built.append(origin)
            elif NAME_LIKE.match(word):
                waits = True
                built.append(word)
            else:
                built.append(Value(word, start, end))
        if waits:
            late.append((name, built))
            if all(isinstance(v, str) for v in built):
                continue
        value = Value.chain([v for v in built if not isinstance(v, str)]).under(name)
        constants[name] = value
        first.setdefault(name, value)
        yield value
    for name, built in late:
        known = [v for v in (first.get(p) if isinstance(p, str) else p for p in built) if v is not None]
        if known:
            yield Value.chain(known).under(name)


def literal_spans(text: str, base: list[Span]) -> list[Span]:
    """Literals that sensitive names reach, outside the patterns' spans."""
    if not any(c in text for c in "=:<(") and not ENV_LINE.search(text):
        return []
    reached = [v for v in pairs(text) if v.named >= 1 and v.named + v.score() >= MIN_SCORE]
    seen: set[Value] = set()
    best: set[tuple[int, int]] = set()
    while reached:
        value = reached.pop()
        if value in seen:
            continue
        seen.add(value)
        reached += value.parts
        if not value.parts and value.span[1] > value.span[0]:
            best.add(value.span)
    return [("literal", s, e) for s, e in best if not any(b <= s and e <= f for _, b, f in base)]


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, in_order(base + literal_spans(text, base))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find_spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b, _ in rows]),
                 pa.array([digest(every) for _, every in rows], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS[:3]), "base_sha256", "spans"])

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return common.texts(df).mapInArrow(run, schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return scan(common.documents(spark, sf_dir))
