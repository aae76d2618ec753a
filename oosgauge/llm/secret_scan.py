"""Secret scans by reading source and configuration text as assignments.

A lexer passes over strings with escapes (also over several lines), comments, operators and
braces and turns ``export DB_PASS='x'``, ``"client_secret": "x"``, ``key := A + "rest"``,
nested keys, block scalars and markup elements into (name, value) pairs. Names are bound in the
order of the text: a pair whose value is a name takes what that name holds there, a name that is
bound only further down takes its last value. Pairs in comments are scored and bind nothing; the
result of a call is unknown. A literal counts as a secret when the words of its name, or of
what encloses a neutral name, end in a sensitive one and the literal itself looks random enough.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.llm.text import and_row, per_batch, pick, whole_row

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
NAMED = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: where the lexer stops; everything between is passed over
TOKEN = re.compile(r"""\\[\s\S]|"|'|:=|=>|\+=|={1,3}|[!<>]=|:|#|//|--|/\*|\*/|<|[{}\[\]]""")
JOINTS = {":=", "=>", "+=", "=", "==", "===", "!=", ":"}
COMPARED = {"==", "===", "!="}
STRING = re.compile(
    r'''[rRbBuUfF]{0,2}(?:"{3}(?P<t>[\s\S]*?)"{3}|'{3}(?P<u>[\s\S]*?)'{3}|"(?P<d>[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+)"|'(?P<s>[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+)')'''
)
BARE = re.compile(r"[A-Za-z0-9+/_.=@$!%^&*~-]++")
REFERENCE = re.compile(r"\$\{\{?[ ]*+(?P<braced>[A-Za-z_][A-Za-z0-9_.]*+)[ ]*+\}\}?|\$?(?P<plain>[A-Za-z_][A-Za-z0-9_.]*+)(?![A-Za-z0-9+/=@$!%^&*~-])")
BLANKS, GAP = re.compile(r"[ \t]*+"), re.compile(r"(?:\s|\\\n)*+")
ANNOTATION = re.compile(r"[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+(?:\[[A-Za-z0-9_., ]*+\])?[ \t]*+=(?!=)")
ELEMENT = re.compile(r"<(?P<tag>[A-Za-z_][A-Za-z0-9_.:-]*+)(?P<more>[^<>]*+)>(?P<body>[^<>]*+)</(?P=tag)")
ATTRIBUTE = re.compile(r"""([A-Za-z_][A-Za-z0-9_.:-]*+)[ \t]*+=[ \t]*+["']([^"'<>\n]*+)["']""")
OPENING = re.compile(r"<[A-Za-z_][^<>]*+")
SECTION = re.compile(r"\[([A-Za-z_][A-Za-z0-9_.:-]*+)\][ \t]*+(?:\n|$)")
BLOCK = re.compile(r"[ \t]*+[|>][+-]?[ \t]*+\n")
FOLDED = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|$)")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
NAME_START = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]")
ESCAPED = re.compile(r"\\([\s\S])")
MARGIN = re.compile(r"\n[ \t]+")
ARMOUR = re.compile(r"-----[A-Z ]+-----")

#: fixed values: weight of the last words of a name
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0,
    "privatekey": 1.0, "secretkey": 1.0, "authkey": 0.9, "credential": 0.8, "credentials": 0.8, "bearer": 0.9, "authorization": 0.6, "auth": 0.6, "key": 0.4, "salt": 0.5, "pin": 0.4,
}
#: fixed values: last words of names that say nothing themselves, so that what encloses them decides; names of types between a name and its joint
NEUTRAL = {"value", "val", "key", "data", "default", "current", "raw", "content", "literal"}
TYPES = {"str", "string", "String", "char", "text", "const"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{?.*\}?|changeme|example|none|null|true|false|your[-_].*|password|secret|token)$")
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> float:
    """Weight of the most sensitive ending of a name, by its words."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    return max((SENSITIVE.get(x, 0.0) for x in ("".join(words[-2:]), words[-1] if words else "")), default=0.0)


def path_weight(name: str, parent: str) -> float:
    """Weight of a name, or of what encloses it if the name itself is neutral."""
    words = NAME_WORDS.findall(name)
    own = name_weight(name)
    return max(own, 0.9 * name_weight(parent)) if parent and words and words[-1].lower() in NEUTRAL else own


class Value:
    """What a name is bound to: a literal of the text, or two values one after the other."""

    __slots__ = ("span", "parts", "text", "counts")

    def __init__(self, span=None, text=None, parts=None):
        self.span, self.parts, self.text, self.counts = span, parts, text, None
        if parts:
            self.counts = parts[0].characters() + parts[1].characters()

    def characters(self) -> Counter:
        if self.counts is None:
            self.counts = Counter(ARMOUR.sub("", self.text))
        return self.counts

    def weight(self) -> float:
        """0 for placeholders, plain words and short strings, towards 1 for long mixed ones."""
        if self.text is not None and (len(self.text) < 8 or PLACEHOLDER.match(self.text)):
            return 0.0
        counts = self.characters()
        n = sum(counts.values())
        if n < 8 or " " in counts:
            return 0.0
        low, high, digit = (any(c in counts for c in s) for s in (LOW, HIGH, DIGIT))
        kinds = low + high + digit + any(not (c.isascii() and c.isalnum()) for c in counts)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        return 0.0 if kinds < 2 else min(1.0, entropy / 4.0) * min(1.0, 0.5 + 0.25 * (kinds - 1))


LOW, HIGH, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def name_before(text: str, least: int, end: int, typed: bool = True) -> tuple[str, int] | None:
    """The name, quoted or not, that ends at ``end`` but for blanks and one line end, and begins at ``least`` or later, with its place."""
    z = end - (end > least and text[end - 1] == "\n")  # the joint may begin the next line
    while z > least and text[z - 1] in " \t":
        z -= 1
    if z > least and text[z - 1] == "]":  # config["name"] = ...
        z -= 1
    quote = text[z - 1] if z > least and text[z - 1] in "\"'" else ""
    z -= len(quote)
    a = z
    while a > least and text[a - 1] in NAME_CHARS:
        a -= 1
    name = text[a:z]
    if not quote:
        m = NAME_START.search(name)
        if typed and m and name[m.start() :] in TYPES:  # a typed declaration: the name stands before its type
            return name_before(text, least, a + m.start(), False) or (name[m.start() :], a + m.start())
        return (name[m.start() :], a + m.start()) if m else None
    q = a - 1
    whole = q >= least and text[q] == quote and (q == least or not (text[q - 1] == "_" or text[q - 1].isascii() and text[q - 1].isalnum()))
    return (name, q) if whole and NAME_START.match(name) else None


class Reader:
    """One text read from the front: bindings in their order, and the literals that sensitive names get."""

    def __init__(self, text: str, least: float):
        self.text, self.least = text, least
        self.bound: dict[str, Value] = {}
        self.aliases: dict[str, str] = {}
        self.later: list[tuple[float, str]] = []
        self.found: set[tuple[int, int]] = set()
        self.seen: set[int] = set()
        self.kept: list[Value] = []

    def literal(self, m: re.Match) -> Value:
        kind = next(k for k in "tuds" if m[k] is not None)
        a, b = m.span(kind)
        if kind in "tu":  # blank margins of a literal over several lines are not part of it
            inner = m[kind].strip()
            a += len(m[kind]) - len(m[kind].lstrip())
            b = a + len(inner)
        return Value((a, b), ESCAPED.sub(r"\1", MARGIN.sub("\n", self.text[a:b])))

    def lookup(self, name: str) -> Value | None:
        return self.bound.get(name) or self.bound.get(name.rpartition(".")[2])

    def term(self, at: int) -> tuple[Value | str | None, int]:
        """A literal, a bound name's value, or an unbound name, and where it ends."""
        text = self.text
        m = STRING.match(text, at)
        if m:
            return self.literal(m), m.end()
        m = REFERENCE.match(text, at)
        if m:
            name, end = m["braced"] or m["plain"], m.end()
            if text[end : end + 1] == "(":
                return None, end  # a call: its result is unknown
            known = self.lookup(name)
            if known or m["braced"] or text[at] == "$" or name.replace("_", "").replace(".", "").isalpha():
                return known or name, end
        m = BARE.match(text, at)
        if not m:
            return None, at
        raw, end = m[0], m.end()
        if text[end : end + 1] == "(":
            return None, end
        more = raw.endswith("+") and text[end : end + 1] in ('"', "'")  # name+"literal": the sign is left to the caller
        pieces = (raw[:-1] if more else raw).split("+")
        known = [self.lookup(p) for p in pieces] if more or len(pieces) > 1 else []
        if known and all(known):
            whole = known[0]
            for k in known[1:]:
                whole = Value(parts=(whole, k))
            return whole, end - more
        if more:
            return raw[:-1], end - 1
        return Value((at, end), raw), end

    def value(self, at: int) -> tuple[Value | str | None, int]:
        """The expression at ``at``: terms joined by plus signs, or literals side by side."""
        text = self.text
        at = BLANKS.match(text, at).end()
        inside = at < len(text) and text[at] == "("
        if inside:
            at = GAP.match(text, at + 1).end()
        out, end = self.term(at)
        while out is not None:
            near = (GAP if inside else BLANKS).match(text, end).end()
            if text[near : near + 1] == "\\" and text[near + 1 : near + 2] == "\n":
                near = GAP.match(text, near).end()
            plus = text[near : near + 1] == "+" and text[near + 1 : near + 2] not in ("=", "+")
            if plus:
                near = GAP.match(text, near + 1).end()
            elif not (isinstance(out, Value) and text[near : near + 1] in ('"', "'") and STRING.match(text, near) and text[end - 1] in "\"'"):
                break
            following, stop = self.term(near)
            if following is None:
                break
            if isinstance(out, Value) and isinstance(following, Value):
                out = Value(parts=(out, following))
            elif isinstance(following, Value):  # an unknown part leaves the known one
                out = following
            end = stop
        return out, end

    def block(self, at: int, indent: int) -> tuple[Value | None, int]:
        """A block scalar: the following lines that are indented deeper than their key."""
        a = b = None
        lines = []
        while at < len(self.text):
            m = FOLDED.match(self.text, at)
            if m[2].strip() and len(m[1]) <= indent:
                break
            if m[2].strip():
                a, b = m.start(2) if a is None else a, m.start(2) + len(m[2].rstrip())
                lines.append(m[2].rstrip())
            at = m.end()
        return (Value((a, b), "\n".join(lines)) if lines else None), at

    def report(self, weight: float, value: Value) -> None:
        if weight * value.weight() < self.least:
            return
        todo = [value]
        while todo:
            v = todo.pop()
            if id(v) not in self.seen:
                self.seen.add(id(v))
                self.kept.append(v)  # alive, so that its id stays its own
                todo += v.parts or ()
                if v.span:
                    self.found.add(v.span)

    def pair(self, name: str, parent: str, value: Value | str | None, binds: bool, adds: bool = False) -> None:
        """A name meets a value: bindings follow the order of the text, an unbound name is looked up at its end."""
        if adds and isinstance(value, Value) and name in self.bound:
            value = Value(parts=(self.bound[name], value))
        weight = path_weight(name, parent)
        if weight and isinstance(value, Value):
            self.report(weight, value)
        elif weight and value:
            self.later.append((weight, value))
        if binds:
            for n in (name, f"{parent}.{name}") if parent else (name,):
                self.bound.pop(n, None), self.aliases.pop(n, None)
                if isinstance(value, Value):
                    self.bound[n] = value
                elif value:
                    self.aliases[n] = value

    def settle(self) -> None:
        """Names that were bound only further down, through chains of names; loops end."""
        for weight, name in self.later:
            chain = []
            while not self.lookup(name) and name in self.aliases:
                chain.append(name)
                name = self.aliases.pop(name)
            value = self.lookup(name)
            if value:
                self.bound.update(dict.fromkeys(chain, value))
                self.report(weight, value)

    def indent(self, at: int) -> int | None:
        """Columns before ``at`` if only blanks and list dashes stand there."""
        a = at
        while a > 0 and self.text[a - 1] in " \t-":
            a -= 1
        return at - a if a == 0 or self.text[a - 1] == "\n" else None

    def read(self) -> list[tuple[int, int]]:
        text, at, least = self.text, 0, 0
        comment, string, close = -1, -1, -1  # ends of the comment and string that are being read
        braces: list[str] = []
        nested: list[tuple[int, str]] = []
        section, opened = "", None
        while m := TOKEN.search(text, at):
            mark, at = m[0], m.end()
            if m.start() == close:
                continue
            if mark in ('"', "'"):
                before = text[m.start() - 1 : m.start()]
                s = STRING.match(text, m.start()) if not (mark == "'" and (before == "_" or before.isalnum())) else None
                if s:  # its inside is read as well: connection strings, embedded configuration
                    string, close = max(string, s.end()), s.end() - 1
            elif mark in JOINTS:
                named = name_before(text, least, m.start())
                if not named:
                    continue
                name, place = named
                deep = self.indent(place)
                if deep is not None:
                    while nested and nested[-1][0] >= deep:
                        nested.pop()
                if mark == ":":
                    typed = ANNOTATION.match(text, at)
                    at = typed.end() if typed else at
                parent = (braces[-1] if braces else "") or (nested[-1][1] if nested and deep is not None else "") or section
                after = BLANKS.match(text, at).end()
                if text[after : after + 1] in ("{", "["):
                    opened, least = (after, name), after
                    continue
                folded = BLOCK.match(text, at) if mark == ":" and deep is not None else None
                if folded:
                    value, end = self.block(folded.end(), deep)
                elif text[after : after + 1] == "\n" and mark == ":":
                    if deep is not None:
                        nested.append((deep, name))
                    continue
                else:
                    value, end = self.value(at)
                if end > at:
                    self.pair(name, parent, value, mark not in COMPARED and m.start() >= comment, mark == "+=")
                    quoted = text[after : after + 1] in ('"', "'")
                    least = after if quoted else end
                    at = after if quoted else max(end, at)  # a literal's inside is read once more
            elif mark in ("#", "//", "--"):
                if m.start() >= comment and (m.start() == 0 or text[m.start() - 1] in " \t\n;") and m.start() >= string:
                    end = text.find("\n", at)
                    comment = len(text) if end < 0 else end
            elif mark == "/*":
                end = text.find("*/", at) if m.start() >= comment else -1
                comment = max(comment, end)
            elif mark == "<":
                self.element(m.start())
            elif m.start() >= string:
                if mark in "{[":
                    head = SECTION.match(text, m.start()) if mark == "[" and self.indent(m.start()) == 0 else None
                    section = head[1] if head else section
                    braces.append(opened[1] if opened and opened[0] == m.start() else braces[-1] if braces else "")
                elif mark in "}]" and braces:
                    braces.pop()
        self.settle()
        return sorted(self.found)

    def element(self, at: int) -> None:
        """Markup: an element's text under its name or the name it gives itself, a ``value`` beside such a name."""
        opening = OPENING.match(self.text, at)
        if not opening:
            return
        given = {m[1]: m for m in ATTRIBUTE.finditer(self.text, at, opening.end())}
        own = next((given[k][2] for k in ("name", "key", "id") if k in given), "")
        m = ELEMENT.match(self.text, at)
        if m and m["body"].strip():
            inner = m["body"].strip()
            a = m.start("body") + len(m["body"]) - len(m["body"].lstrip())
            self.pair(own or m["tag"], m["tag"] if own else "", Value((a, a + len(inner)), inner), False)
        if own and "value" in given:
            self.pair(own, "", Value(given["value"].span(2), given["value"][2]), False)


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without those within another."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def literals(text: str, least: float = 0.45) -> list[tuple[int, int]]:
    """Spans of the literals that a sensitive name gets, directly, through names or in parts, in order."""
    return outermost(Reader(text, least).read())


def scan(text: str, raw_text: bytes) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of every span in order: base rules, then the method's literals not within one of them."""
    out = []
    low = raw_text.lower()
    if any(x in low for x in NAMED):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw_text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if b"=" in raw_text or b":" in raw_text or b"</" in raw_text:
        base = list(out)
        out += [(a, 3, b) for a, b in literals(text) if not any(s <= a and b <= e for s, _, e in base)]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], mark] if a >= at else []
        at = b
    return "".join(out) + text[at:]


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per row of ``docs``: counts by kind, the digest of the base spans, all spans and, if asked, the text without them.

    Positions are code points, ends exclusive. A null text is empty: no spans, and null
    again when redacted. Rows are read each by itself, so repeated rows repeat their answer.
    """
    more = ", redacted string" if redact else ""

    def make():
        def step(b):
            got: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans", "redacted")}
            for value in b.column("text").cast(pa.binary()).to_pylist():
                text = (value or b"").decode("utf-8", "replace")
                spans = scan(text, value or b"")
                for i, k in enumerate(KINDS):
                    got[f"n_{k}"].append(sum(x[1] == i for x in spans))
                got["base_sha256"].append(hashlib.sha256(written([x for x in spans if x[1] < 3]).encode()).hexdigest())
                got["spans"].append(written(spans))
                if redact:
                    got["redacted"].append(None if value is None else redacted(text, spans))
            names = [k for k in got if redact or k != "redacted"]
            cols = [pa.array(got[k], pa.int64() if k[:2] == "n_" else pa.string()) for k in names]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *names])

        return step

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string" + more
    return per_batch(pick(docs, id_col, text_col), schema, make)


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with every span of ``secret_scan`` replaced; ``length_col`` is set to the new length."""

    def make():
        def step(b):
            out = []
            for value in b.column("text").cast(pa.binary()).to_pylist():
                text = (value or b"").decode("utf-8", "replace")
                out.append(None if value is None else redacted(text, scan(text, value)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column("carry")], ["_clean", "carry"])

        return step

    rows = per_batch(pick(docs, id_col, text_col, whole_row(docs)), and_row("_clean string", docs), make)
    new = {text_col: F.col("_clean")} | ({length_col: F.length("_clean").cast(docs.schema[length_col].dataType)} if length_col else {})
    return rows.select(*(new.get(c, F.col(f"carry.`{c}`")).alias(c) for c in docs.columns))
