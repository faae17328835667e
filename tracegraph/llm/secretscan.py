"""Secret scans: base patterns, and literals that source or configuration syntax assigns to sensitive names.

Base kinds are ``assign``, ``access`` and ``hex``; leftmost non-overlapping matches of each, of which failing ones are
dropped. The kind ``literal`` comes from a lexer that reads names, strings, numbers, operators and comments, parses
``name = value``, ``name: value``, ``name := value`` and ``name => value`` (a value is a literal, a name, or such parts joined by +
or a full stop), and propagates constants: a name stands for the literals last assigned to it in its scope or one around it. The literals that reach
a sensitive name are scored by that name and by their own length, variety and entropy.

* A quote opens a string after an operator or at the start of a line, so apostrophes and quotes of prose open none.
* ``word: name = value`` assigns to ``name``; dotted names and calls are no literals.
* Functions, classes and braces that hold keys are scopes: in braces, or by indentation after ``def`` and ``class``. Blocks after ``if`` and the like aren't.
* Comments are read too, each in a scope of its own: what they assign reaches no code.

Spans are in code points, end exclusive. Null counts as empty; a text without findings has counts 0 and empty spans. Whole texts are read, in time
in proportion to their length. Repeated rows give a row each; an empty table gives an empty result. Of spans that several kinds share all are given.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("assign", "access", "hex", "literal")
#: Least score of a literal.
THRESHOLD = 1.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_MARK = bytes(104 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
_BASE_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

#: Parts of a name that make it sensitive, with their weights.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.8, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0}
_MARKS = (b"passw", b"pwd", b"passphrase", b"secret", b"token", b"key", b"credential")
#: What may stand between adjacent parts of a name.
_BETWEEN = bytes(c for c in range(256) if not (48 <= c <= 57 or 97 <= c <= 122))
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|change_?me.*|your[_-].*|example.*|todo|none|null|true|false)$", re.I)

_LEX = re.compile(r"""
    (?P<line>\n)
  | (?P<note>/\*|(?:(?<![^\s;{}(),])(?:\#|//|--(?=\s)|<!--)))
  | (?P<string>(?:[bBrRuUfF]{1,2}(?=["']))?(?:\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|\'{3}(?:[^'\\]|\\.|'(?!''))*\'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))
  | (?P<op>:=|=>|==|!=|<=|>=|[=:+.,;(){}\[\]])
  | (?P<name>[A-Za-z_][A-Za-z0-9_-]*)
  | (?P<number>[0-9][A-Za-z0-9_]*)
  | (?P<bare>[^\s"':=+.,;(){}\[\]]+)
  | (?P<quote>["'])
  | (?P<space>[^\S\n]+)
""", re.X | re.S)
_QUOTE = re.compile("[\"']")
_DOTTED = re.compile(r"[A-Za-z_][A-Za-z_]*(?:\.[A-Za-z_][A-Za-z_]*)+")
_BARE = re.compile(r"""[^\s"'#;,(){}\[\]]+""")
_ASSIGN_OPS = ("=", ":", ":=", "=>")
#: Words before a block that is no scope.
_CONTROL = {"if", "for", "while", "switch", "catch", "else", "elif", "try", "do", "finally", "with", "foreach", "unless", "until", "match"}
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    """The weight of the most sensitive part, or pair of adjacent parts, of a name."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max([0.0, *(SENSITIVE.get(p, 0.0) for p in parts), *(SENSITIVE.get(a + b, 0.0) for a, b in zip(parts, parts[1:], strict=False))])


def variety(literal: str) -> float:
    """0 to 1: by length, kinds of characters and entropy a character."""
    if len(literal) < 8 or _PLACEHOLDER.match(literal):
        return 0.0
    kinds = sum(any(t(c) for c in literal) for t in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in Counter(literal).values())
    return min(1.0, len(literal) / 16) * 0.4 + kinds / 4 * 0.3 + min(1.0, entropy / 4) * 0.3


def lex(text: str, at: int, stop: int, comments: bool = True) -> list[tuple[str, str, int, int]]:
    """(kind, word, start, end); a note is a whole comment, without its mark. Strings only open where a value can begin."""
    out: list[tuple[str, str, int, int]] = []
    closed = True  # whether a block comment may still end
    while at < stop:
        m = _LEX.match(text, at, stop)
        kind, word, a, b = m.lastgroup, m.group(), at, m.end()
        if kind == "string" and not (not out or out[-1][0] == "line" or (out[-1][0] == "op" and out[-1][1] not in ".)]}")):
            b = _QUOTE.search(text, a).end()
            kind = "quote"
        elif kind == "note":
            if not comments:
                kind = "bare"
            elif word in ("/*", "<!--"):
                mark = "*/" if word == "/*" else "-->"
                end = text.find(mark, b, stop) if closed else -1
                closed = end >= 0
                if closed:
                    out.append(("note", "", b, end))
                    at = end + len(mark)
                    continue
                kind = "bare"
            else:
                end = text.find("\n", b, stop)
                end = stop if end < 0 else end
                out.append(("note", "", b, end))
                at = end
                continue
        at = b
        if kind not in ("space", "quote"):
            out.append((kind, word, a, b))
    return out


class _Scopes:
    """What names stand for: a stack of values for each, from which a scope that ends takes back its own."""

    def __init__(self) -> None:
        self.known: dict[str, list[list]] = {}
        #: (indentation, or -1 for braces; names assigned, or None if it is no scope)
        self.frames: list[tuple[int, set[str] | None]] = []
        self.inner: list[set[str]] = [set()]
        self.braces = 0

    def enter(self, column: int, scope: bool = True) -> None:
        names: set[str] | None = set() if scope else None
        self.frames.append((column, names))
        self.braces += column < 0
        if names is not None:
            self.inner.append(names)

    def _leave(self) -> None:
        column, names = self.frames.pop()
        self.braces -= column < 0
        if names is not None:
            for name in names:
                self.known[name].pop()
            self.inner.pop()

    def close(self) -> None:
        """A closing brace; what is indented in it ends too."""
        if self.braces:
            while self.frames[-1][0] >= 0:
                self._leave()
            self._leave()

    def line(self, column: int) -> None:
        while self.frames and column <= self.frames[-1][0]:
            self._leave()

    def get(self, name: str) -> list | None:
        found = self.known.get(name)
        return found[-1] if found else None

    def put(self, name: str, parts: list) -> None:
        stack = self.known.setdefault(name, [])
        if name in self.inner[-1]:
            stack[-1] = parts
        else:
            self.inner[-1].add(name)
            stack.append(parts)


class _Parser:
    """Assignments of one text or comment, in order."""

    def __init__(self, text: str, tokens: list[tuple[str, str, int, int]], stop: int):
        self.text, self.tokens, self.stop = text, tokens, stop
        self.scopes = _Scopes()
        self.notes: list[tuple[int, int]] = []
        self.found: set[tuple[int, int]] = set()
        self._held: list[list] = []  # keeps all constants, so that ids aren't used again
        self._reached: dict[float, set[int]] = {}  # by weight, the constants whose literals have been scored

    def _assigned(self, i: int) -> bool:
        """Whether a sign of assignment follows token ``i``."""
        return i + 1 < len(self.tokens) and self.tokens[i + 1][0] == "op" and self.tokens[i + 1][1] in _ASSIGN_OPS

    def _nested(self, i: int) -> bool:
        """Whether the name ``i``, where a value could stand, is assigned to itself: the sign has a space or a quote beside it, and a value."""
        if self.tokens[i][0] != "name" or not self._assigned(i) or i + 2 >= len(self.tokens) or self.tokens[i + 2][0] in ("line", "note"):
            return False
        _, _, a, b = self.tokens[i + 1]
        return self.text[a - 1].isspace() or self.text[b] in " \t\"'"

    def run(self) -> None:
        tokens, scopes = self.tokens, self.scopes
        heads: list[str] = []  # what stands before each open parenthesis
        head, last, fresh, i = "", "", True, 0
        if tokens and tokens[0][0] == "line":
            fresh = False
        while i < len(tokens):
            kind, word, a, b = tokens[i]
            i += 1
            if kind == "note":
                self.notes.append((a, b))
                continue
            if kind == "line":
                if i < len(tokens) and tokens[i][0] not in ("line", "note"):
                    scopes.line(tokens[i][2] - b)
                    fresh = True
                continue
            if fresh and kind == "name" and word in ("def", "class"):
                scopes.enter(a - (self.text.rfind("\n", 0, a) + 1))
            fresh = False
            if kind == "op":
                if word == "(":
                    heads.append(last)
                elif word == ")":
                    head = heads.pop() if heads else ""
                elif word == "{":
                    scopes.enter(-1, (head if last == ")" else last) not in _CONTROL)
                elif word == "}":
                    scopes.close()
            last = word
            if kind in ("name", "string") and self._assigned(i - 1):
                i = self._assignment(i - 1)
                last = ""

    def _assignment(self, i: int) -> int:
        """Reads the names and the value that begin at token ``i``; returns where the parser goes on."""
        tokens, text = self.tokens, self.text
        names = [tokens[i][1].strip("\"'")]
        i += 2
        while i < len(tokens) and self._nested(i):
            names.append(tokens[i][1])
            i += 2
        parts: list = []
        while i < len(tokens):
            kind, word, a, b = tokens[i]
            if kind == "string":
                quote = _QUOTE.search(word).start()
                size = 3 if len(word) >= quote + 6 and word[quote : quote + 3] in ('"""', "'''") else 1
                parts.append((a + quote + size, b - size))
            elif kind == "name" and self.scopes.get(word) is not None and not self._assigned(i):
                parts.append(self.scopes.get(word))
            elif not parts and kind in ("name", "number", "bare"):
                m = _BARE.match(text, a, self.stop)
                while i + 1 < len(tokens) and tokens[i + 1][2] < m.end():
                    i += 1
                if text[m.end() : m.end() + 1] not in ("(", "[") and not _DOTTED.fullmatch(m.group()):
                    parts.append(m.span())
            else:
                break
            i += 1
            if i < len(tokens) and tokens[i][1] in ("+", "."):
                i += 1
            else:
                break
        if parts:
            self._held.append(parts)
            for name in names:
                self.scopes.put(name, parts)
            for weight in {sensitivity(name) for name in names} - {0.0}:
                self._reach(parts, weight)
        return i

    def _reach(self, parts: list, weight: float) -> None:
        """Scores the literals of a constant, and of the constants (as they were) that it is built from."""
        seen, waiting = self._reached.setdefault(weight, set()), [parts]
        while waiting:
            for p in waiting.pop():
                if isinstance(p, tuple):
                    if weight + variety(self.text[p[0] : p[1]]) >= THRESHOLD + 0.5:
                        self.found.add(p)
                elif id(p) not in seen:
                    seen.add(id(p))
                    waiting.append(p)


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name."""
    code = _Parser(text, lex(text, 0, len(text)), len(text))
    code.run()
    found = code.found
    for a, b in code.notes:
        note = _Parser(text, lex(text, a, b, comments=False), b)
        note.run()
        found |= note.found
    return sorted(found)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    spans: list[tuple[int, int, int]] = []
    if any(w in low for w in _BASE_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in raw.translate(_HEX_MARK):
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    joined = low.translate(None, _BETWEEN) if b"=" in raw or b":" in raw else b""
    if any(w in joined for w in _MARKS):
        spans += [(a, 3, b) for a, b in literals(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def find_secrets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and ``findings``, an array of (kind, a, b). A column of that name gives way to it."""
    keep = [c for c in keep if c != "findings"]
    seen = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = [f for f in seen.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", findings array<struct<kind:string,a:int,b:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "a": a, "b": b} for k, a, b in scan(t)] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(found, kind)], [*(f.name for f in fields), "findings"])

    return map_texts(seen, lambda: work, schema)
