"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base findings. Beside them a lexer reads source
and configuration syntax as tokens: names, strings (prefixed, triple-quoted,
back-quoted), operators, brackets and line starts with their indentation. From
the tokens a parser takes name-literal pairs: assignments of any spelling,
entries of mappings in braces or by indentation, block scalars, elements and
attributes of markup, and calls that set a name. Literals joined by a plus sign
or by standing side by side are one; a literal's braces and dollar signs, names,
and arguments of wrapping calls are references; a looked-up environment name is
none. Constants are propagated: a name gives its sensitivity to every literal
that its references reach, in any order of the text and over reassignments.
Literals are scored by the most sensitive name that reaches them, their
alphabet and entropy; those of THRESHOLD or more become spans of kind literal.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from locusframe.llm.common import id_text, slices

THRESHOLD = 0.75

_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

_TOKEN = re.compile(
    r"""(?P<line>\n[\x20\t]*+)|(?P<space>[\x20\t\r\x0b\x0c]++)"""
    r"""|(?P<string>(?<![A-Za-z0-9_\\])(?P<prefix>[rRbBfFuU]{0,2})(?:\"{3}(?P<s1>.*?)\"{3}|'{3}(?P<s2>.*?)'{3}|"(?P<s3>(?:[^"\\\n]|\\.)*+)"|'(?P<s4>(?:[^'\\\n]|\\.)*+)'|`(?P<s5>[^`\n]*+)`))"""
    r"""|(?P<name>[A-Za-z_$@][A-Za-z0-9_.$-]*+)|(?P<op>:=|=>|->|==|!=|<=|>=|\+=|\|\||&&|\?\?|[=:+,;(){}\[\]<>|])|(?P<rest>[^\s"'`,;(){}\[\]<>=:+|]++|.)""",
    re.S,
)
#: An unquoted value: what stands before white space, a comma or a semicolon.
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_BLOCK = re.compile(r"[|>][-+0-9]{0,2}[\x20\t]*+(?=\n)")
_BLOCK_LINE = re.compile(r"\n(?:([\x20\t]*+)[^\n]*+)")
_REFERENCE = re.compile(r"\$?\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}|\$([A-Za-z_][A-Za-z0-9_]*)|%\(([A-Za-z_][A-Za-z0-9_]*)\)s|\$\(([A-Za-z_][A-Za-z0-9_]*)\)")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*+>")
_ATTRIBUTES = re.compile(r"""\b(?:name|key|id)\s*=\s*(["'])([A-Za-z_][A-Za-z0-9_.-]*)\1\s+value\s*=\s*(["'])([^"'<>\n]*)\3""", re.I)
_QUOTED_NAME = re.compile(r"[A-Za-z_$@][A-Za-z0-9_.$ -]*+")
#: Words before a name that belong to its declaration.
_DECLARES = {"export", "set", "const", "let", "var", "final", "static", "public", "private", "readonly", "my", "our", "local", "val", "define", "string", "String", "str", "auto", "char", "setenv"}
#: Last parts of names of calls whose first argument names what is looked up, and of calls that set the name that their first argument gives.
_LOOKS_UP = {"getenv", "get", "env", "environ", "config", "lookup", "fetch", "getProperty", "get_secret", "get_secret_value", "getSecret", "read"}
_SETS = {"define", "setenv", "putenv", "set", "put", "setProperty", "setdefault", "addHeader", "header", "append", "set_password"}
_ASSIGNS = {"=", ":", ":=", "=>", "+="}
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: Parts of target names and what they add to a literal's score.
SENSITIVE = {"password": 0.7, "passwd": 0.7, "passphrase": 0.7, "pwd": 0.6, "secret": 0.7, "token": 0.6, "apikey": 0.7, "privatekey": 0.7, "accesskey": 0.6, "credential": 0.6, "authkey": 0.6, "auth": 0.4, "signature": 0.3, "salt": 0.3, "cert": 0.3, "key": 0.3}
_PLACEHOLDER = re.compile(r"(?:x{3,}|\*{3,}|<.*>|\$\{.*\}|%.*%|changeme|example|dummy|placeholder|none|null|true|false|your.*)", re.I | re.A)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _name_score(name: str) -> float:
    flat = re.sub(r"[^a-z]", "", name.lower())
    return max((v for k, v in SENSITIVE.items() if k in flat), default=0.0)


def _literal_score(value: str) -> float:
    """What the literal itself speaks for: mixed alphabet, entropy and length; placeholders speak against."""
    if len(value) < 6 or _PLACEHOLDER.fullmatch(value):
        return -1.0
    letters = set(value)
    kinds = sum(any(f(c) for c in letters) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in letters)
    return 0.1 * (kinds - 1) + 0.05 * min(4.0, max(0.0, _entropy(value) - 2)) - 0.3 * (" " in value) - 0.2 * value.isalpha()


class Token:
    """kind (name, string, op, line, rest, end), text, and start and end; of a string without its quotes. pre: a string's prefix."""

    __slots__ = ("kind", "text", "start", "end", "pre", "after")

    def __init__(self, kind: str, text: str, start: int, end: int, pre: str = "", after: int = 0):
        self.kind, self.text, self.start, self.end, self.pre, self.after = kind, text, start, end, pre, after or end


def tokens(text: str) -> list[Token]:
    """Tokens of a text, white space within lines left out; a line token's text is the indentation."""
    out = [Token("line", "", 0, 0)]
    if text[:1] in " \t":
        out[0].text = text[: len(text) - len(text.lstrip(" \t"))]
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if m["string"] is not None:
            g = next(k for k in ("s1", "s2", "s3", "s4", "s5") if m[k] is not None)
            out.append(Token("string", m[g], m.start(g), m.end(g), m["prefix"], m.end()))
        elif kind == "line":
            out.append(Token("line", m.group()[1:], m.start(), m.end()))
        elif kind != "space":
            out.append(Token(kind, m.group(), m.start(), m.end()))
    out.append(Token("end", "", len(text), len(text)))
    return out


def _bare_name(name: str) -> str:
    """The last part of a name, without signs before it."""
    return name.lstrip("$@-").rpartition(".")[2]


class Lexer:
    """Name-literal pairs of one text: literals as (start, end, value), and for each name its literals and the names that it refers to."""

    def __init__(self, text: str):
        self.text, self.t = text, tokens(text)
        self.literals: list[tuple[int, int, str]] = []
        self.known: dict[tuple[int, int], int] = {}
        self.holds: dict[str, set[int]] = {}
        self.refers: dict[str, set[str]] = {}
        self.named: dict[str, float] = {}
        self.maybe: dict[tuple[int, int], str] = {}  # unquoted values that may be a name
        self.above: list[tuple[str, int, float]] = []  # open mappings and brackets: bracket or blank, indentation, greatest sensitivity so far
        self._pairs()
        self._markup()

    def _open(self, bracket: str, indent: int, score: float = 0.0) -> None:
        self.above.append((bracket, indent, max(score, self.above[-1][2] if self.above else 0.0)))

    def _bind(self, name: str, found: list[tuple[int, int, str]], names: set[str], above: float = 0.0) -> None:
        key = _bare_name(name)
        self.named[key] = max(self.named.get(key, 0.0), _name_score(name), above)
        held = self.holds.setdefault(key, set())
        for s, e, value in found:
            if (s, e) not in self.known:
                self.known[s, e] = len(self.literals)
                self.literals.append((s, e, value))
            held.add(self.known[s, e])
            names = names | {_bare_name(next(filter(None, m))) for m in _REFERENCE.findall(value)}
        self.refers.setdefault(key, set()).update(names - {key})

    def _markup(self) -> None:
        if "<" in self.text:
            for m in _ELEMENT.finditer(self.text):
                value = m[2].strip()
                if value:
                    start = m.start(2) + len(m[2]) - len(m[2].lstrip())
                    self._bind(m[1], [(start, start + len(value), value)], set())
            for m in _ATTRIBUTES.finditer(self.text):
                self._bind(m[2], [(m.start(4), m.end(4), m[4])], set())

    def _pairs(self) -> None:
        t, i, above = self.t, 0, self.above
        indent = 0
        while i < len(t) - 1:
            x = t[i]
            if x.kind == "line":
                if t[i + 1].kind not in ("line", "end"):
                    indent = len(x.text.expandtabs(4))
                    while above and above[-1][0] == " " and above[-1][1] >= indent:
                        above.pop()
                i += 1
                continue
            if x.kind == "op":
                if x.text in "{[(":
                    self._open(x.text, indent)
                elif x.text in _CLOSES:
                    while above and above[-1][0] == " ":
                        above.pop()
                    if above and above[-1][0] == _CLOSES[x.text]:
                        above.pop()
            if x.kind in ("name", "string") and (x.kind == "name" or _QUOTED_NAME.fullmatch(x.text)):
                inherited = above[-1][2] if above else 0.0
                j = i + 1
                if t[j].kind == "op" and t[j].text == ":" and t[j + 1].kind == "name" and t[j + 2].kind == "op" and t[j + 2].text == "=":
                    j += 2  # a type stands between the name and its value
                if t[j].kind == "op" and t[j].text in _ASSIGNS and x.text not in _DECLARES:
                    nxt = t[j + 1]
                    if nxt.kind == "op" and nxt.text in "{[" and t[j].text != "+=":
                        self._open(nxt.text, indent, _name_score(x.text) - 0.1)
                        i = j + 2
                        continue
                    if t[j].text == ":" and (block := _BLOCK.match(self.text, nxt.start)):
                        i = self._block(x.text, block.end(), indent, inherited)
                        continue
                    if t[j].text == ":" and nxt.kind in ("line", "end"):
                        self._open(" ", indent, _name_score(x.text) - 0.1)
                        i = j + 1
                        continue
                    i = self._value(x.text, j + 1, inherited, indent)
                    continue
                if x.kind == "name" and t[j].kind == "op" and t[j].text == "(" and _bare_name(x.text) in _SETS and t[j + 1].kind == "string" and t[j + 2].kind == "op" and t[j + 2].text in ",":
                    i = self._value(t[j + 1].text, j + 3, inherited, indent)
                    continue
                if x.text == "setenv" and t[j].kind == "name" and t[j + 1].kind not in ("op", "line", "end"):
                    i = self._value(t[j].text, j + 1, inherited, indent)
                    continue
            i += 1

    def _block(self, name: str, at: int, indent: int, above: float) -> int:
        """Takes the more indented lines from `at` on as one literal; the index of the token behind it."""
        start = end = -1
        for m in _BLOCK_LINE.finditer(self.text, at):
            body = m.group()[1:]
            if m.start() != at or body.strip() and len(m[1].expandtabs(4)) <= indent:
                break
            if body.strip():
                start = m.end(1) if start < 0 else start
                end = m.start() + 1 + len(body.rstrip())
            at = m.end()
        if start >= 0:
            self._bind(name, [(start, end, self.text[start:end])], set(), above)
        return self._index(at)

    def _index(self, at: int) -> int:
        """Index of the first token from place `at` on."""
        low, high = 0, len(self.t) - 1
        while low < high:
            mid = (low + high) // 2
            if self.t[mid].start < at:
                low = mid + 1
            else:
                high = mid
        return low

    def _value(self, name: str, i: int, above: float, indent: int) -> int:
        """Reads the value that begins at token i and binds it to the name; the index of the token behind it, or of a pair's name within its brackets."""
        t = self.t
        found: list[tuple[int, int, str]] = []
        names: set[str] = set()
        if t[i].kind in ("name", "rest"):
            m = _BARE.match(self.text, t[i].start)
            value, end = m.group(), m.end()
            follows = self.text[end : end + 1]
            k = self._index(end)
            joined = t[k].kind == "op" and t[k].text in ("+", "||", "??")
            if follows not in ("(", "[", '"', "'", "`") and not joined and value not in ("or", "await", "new", "return"):
                if re.fullmatch(r"[$@]?\{?[A-Za-z_][A-Za-z0-9_]*\}?(?:\.[A-Za-z_]+)*", value):
                    names.add(_bare_name(value.strip("${}@")))
                    self.maybe[t[i].start, end] = _bare_name(value.strip("${}@"))
                if not re.fullmatch(r"[a-zA-Z_]+(?:\.[a-zA-Z_]+)+", value):
                    cut = value.rstrip(".:") if value[-1:] in ".:" else value
                    found.append((t[i].start, t[i].start + len(cut), cut))
                self._bind(name, found, names, above)
                return k
        run: list[tuple[int, int, str]] = []  # literals that are joined
        plus = False
        opened: list[str] = []
        lookups: list[int] = []  # depths of calls whose first argument is a name
        while t[i].kind != "end":
            x, depth = t[i], len(opened)
            if x.kind == "line":
                before = t[i - 1]
                ahead = next((y for y in t[i + 1 : i + 4] if y.kind != "line"), t[-1])
                if not depth and not (before.kind == "op" and before.text in ("+", "=", "||", "??")) and not (ahead.kind == "op" and ahead.text == "+"):
                    break
            elif x.kind == "op":
                if x.text in "([{":
                    if t[i - 1].kind == "name" and x.text != "{" and (_bare_name(t[i - 1].text) in _LOOKS_UP):
                        lookups.append(depth + 1)
                    opened.append(x.text)
                elif x.text in _CLOSES:
                    if not depth:
                        break
                    if lookups and lookups[-1] == depth:
                        lookups.pop()
                    opened.pop()
                elif x.text in ",;":
                    if not depth:
                        break
                    if lookups and lookups[-1] == depth:
                        lookups.pop()  # what follows is a default
                elif x.text in _ASSIGNS and x.text != "+=":
                    if not depth:
                        break
                    if t[i - 1].kind in ("name", "string"):  # a pair of its own, which the brackets' name stands above
                        if run and t[i - 1].kind == "string":
                            run.pop()
                        worth = max(above, _name_score(name)) - 0.1
                        for b in opened:
                            self._open(b, indent, worth)
                        self._bind(name, found + self._joined(run), names - {_bare_name(t[i - 1].text)}, above)
                        return i - 1
                plus = x.text == "+"
                if not plus and x.text not in "()":
                    found += self._joined(run)
                    run = []
            elif x.kind == "string":
                if not lookups or lookups[-1] != depth:
                    beside = t[i - 1].kind == "string" or t[i - 1].kind == "line" and depth and t[i - 2].kind == "string"
                    if not plus and not beside:
                        found += self._joined(run)
                        run = []
                    run.append((x.start, x.end, x.text))
                plus = False
            elif x.kind == "name":
                if not depth and t[i - 1].kind in ("name", "string", "rest") and x.text not in ("or", "if", "else", "await", "new") and t[i - 1].text not in ("or", "if", "else", "await", "new", "return"):
                    break  # the next sentence or attribute
                if t[i + 1].text not in ("(", "["):
                    names.add(_bare_name(x.text))
                plus = False
            i += 1
        found += self._joined(run)
        self._bind(name, found, names, above)
        return i

    @staticmethod
    def _joined(run: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        return [(run[0][0], run[-1][1], "".join(v for _, _, v in run))] if run else []

    def scored(self) -> list[tuple[int, int, float]]:
        """Spans of the literals that sensitive names reach and their scores, in the order of the text."""
        best: dict[int, float] = {}
        seen: set[str] = set()
        for key, score in sorted(self.named.items(), key=lambda x: -x[1]):
            todo = [key] if score else []
            while todo:  # whatever was reached before has a score as high
                k = todo.pop()
                if k in seen:
                    continue
                seen.add(k)
                for i in self.holds.get(k, ()):
                    best.setdefault(i, score)
                todo += self.refers.get(k, ())
        out = [(s, e, round(v + _literal_score(value), 4)) for i, v in best.items() for s, e, value in [self.literals[i]] if e > s and self.maybe.get((s, e)) not in self.named]
        return sorted(x for x in out if x[2] >= THRESHOLD)


_HINT = re.compile(r"pass|secret|token|api_?key|pwd|key|auth|cred|salt|cert|signature", re.I | re.A)
#: A name, each run of its characters taken once, before what assigns to it, quotes it, opens its element or hands it to a call.
_TARGET = re.compile(r"""(?<![A-Za-z0-9_.$@-])(<)?([A-Za-z0-9_.$@-]++)(?:["'`]?[\x20\t]*+(?:[:=>,]|\()|["'`]|(?(1)\s|(?!)))""")
_QUOTED_TARGET = re.compile(r"""["'`]([A-Za-z_$@][A-Za-z0-9_.$ -]*+)["'`]\s*+[:=,]""")
_SETENV = re.compile(r"\bsetenv[\x20\t]++([A-Za-z0-9_.$@-]++)")


def _may_hold(text: str) -> bool:
    """Whether some name that literals can be bound to is sensitive, in time proportional to the text."""
    return any(_HINT.search(m[m.lastindex]) for p in (_TARGET, _QUOTED_TARGET, _SETENV) for m in p.finditer(text))


def literals(text: str) -> list[tuple[int, int, float]]:
    """Spans of literals and their scores; a literal takes the most sensitive name that reaches it."""
    return Lexer(text).scored() if _may_hold(text) else []


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings, by start and kind."""
    found: list[tuple[int, int, int]] = []
    hinted = _HINT.search(text)
    if hinted and ("=" in text or ":" in text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if hinted:  # elements, calls and setenv bind names without either sign
        found += [(s, 3, e) for s, e, _ in literals(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows = []
            for text in part.column(1).to_pylist():
                found = scan(text) if text else []
                base = [x for x in found if x[2] != "literal"]
                count = Counter(k for _, _, k in base)
                joined = lambda xs: ",".join(f"{k}:{s}:{e}" for s, e, k in xs)
                rows.append((count["assign"], count["access"], count["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types[1:], strict=True))], schema=_SCHEMA)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans count code points, ends exclusive. Null and empty texts hold nothing
    (the hash is that of the empty string); repeated rows get their own result
    each; an empty table gives no rows. Other columns stay outside.
    """
    return id_text(docs, id_col, text_col).mapInArrow(_run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
