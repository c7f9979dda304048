"""Secret scans by assignment-aware lexing.

Source and configuration text is read as name-literal pairs (``name = "literal"``, ``name: literal``, ``"name": "literal"``,
``NAME=literal``, ``name := name2``, ``"a" + "b"``, triple-quoted literals over several lines, ``name("literal")``,
``put("name", "literal")``, ``x["name"] = "literal"``, ``a, b = "literal", "literal"``, ``name = (`` with the literal on the
next line, ``<add key="name" value="literal">``, ``<name>literal</name>``, ``scheme://user:literal@host``, and what stands in
braces under a name); values are
followed through assignments (a name that is assigned another name takes that name's literal, through any chain), and each
literal is scored by the most sensitive name that it reaches and by how random it looks. Literals that score high add
``lexed`` spans to those of the base patterns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced, tagged

# The base patterns. Runs that are too short fail; for ``access`` and ``hex`` a bound in the pattern
# finds the same runs, since both take whole runs from the left.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN_LEAST = 6
#: Parts of names that tell of a secret, and their weights.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "privatekey": 3, "accesskey": 3, "signingkey": 3, "encryptionkey": 3, "credential": 2, "auth": 1, "bearer": 2, "cookie": 1, "session": 1, "salt": 1, "key": 1}
#: Of weight 1, but specific, so that a random literal suffices; ``key`` does as a part of a longer name.
SPECIFIC = ("auth", "cookie", "session", "salt")
#: What a name is made of: ``DB_passwordHash2`` has db, password, hash and 2.
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Elements of markup, and credentials in addresses.
ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*)(?:\x20[^<>\n]*)?>([^<>\n]+)</\1\s*>", re.ASCII)
ADDRESS = re.compile(r"""://[^\s/:@"'<>]*:([^\s/@"'<>]+)@""")
#: Letters that may stand before a string's quote.
PREFIXES = ("f", "r", "b", "u", "rb", "br", "fr", "rf")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example.*|your.*|none|null|true|false|todo|test|<.*>|\$\{.*\}|%.*%)$")
NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
#: What a line needs for it to be lexed: an assignment sign, a brace, or a call with a quoted argument.
SIGN = re.compile(r"""[=:{}]|\(["']""")


def _lexer(*quotes: str) -> re.Pattern:
    strings = "|".join(rf"{q}(?:[^{q}\\\n]|\\.)*+{q}" for q in quotes)
    return re.compile(
        rf"""(?P<triple>\"\"\"|''')"""
        + (rf"""|(?P<string>{strings})|(?P<open>[{"".join(quotes)}])""" if quotes else "")
        + rf"""|(?P<assign>:=|=>|=(?!=)|:(?!:))|(?P<plus>\+)|(?P<end>[\n;,{{}}()\[\]])|(?P<word>{NAME})|(?P<bare>[A-Za-z0-9+/_.\-=]+)"""
    )


#: Lexers by the quotes that can still be closed on the line.
LEXERS = {q: _lexer(*q) for q in ('"\'', '"', "'", "")}
#: Names under which markup gives the name of a value.
LABELS = ("key", "name")
DEEPEST = 64
#: A literal counts as found from this score on: the name's weight plus one for looking random.
LEAST_SCORE = 3
LITERAL_LEAST = 8


@lru_cache(1 << 16)
def sensitivity(name: str) -> int:
    """By whole parts of the name, or neighbouring parts together; words of weight 2 and 3 also where a part ends with one."""
    parts = [p.lower() for p in PARTS.findall(name)]
    weight = 0
    for k, part in enumerate(parts):
        for word in (part, part.removesuffix("s"), parts[k - 1] + part if k else part):
            w = SENSITIVE.get(word, 0)
            weight = max(weight, 2 if w == 1 and (word in SPECIFIC or len(parts) > 1) else w)
        if weight < 3:
            weight = max(weight, max((w for word, w in SENSITIVE.items() if w > 1 and part.removesuffix("s").endswith(word)), default=0))
    return weight


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def looks_random(value: str) -> bool:
    return entropy(value) >= 3.0 and re.search(r"[0-9]", value) is not None


class Pair:
    """A name and what it is assigned: a literal's span, or another name. ``joined`` is the literal that this is a part of.

    ``outer`` is the weight of the names whose braces it stands in.
    """

    __slots__ = ("end", "joined", "name", "outer", "ref", "start")

    def __init__(self, name: str, start: int, end: int, ref: str | None, joined: Pair | None = None, outer: int = 0):
        self.name, self.start, self.end, self.ref, self.joined, self.outer = name, start, end, ref, joined, outer


def pairs(text: str) -> Iterator[Pair]:
    """Name-literal and name-name pairs in the order of the text."""
    name, name_end, armed = None, -1, False
    joined: Pair | None = None
    given = False  # an assignment sign has been on the line
    word_end, label, argument = -1, None, None  # end of the last bare word; key="..." of markup; first argument of a call
    nest: list[int] = []
    depth, wrapped = 0, False  # brackets that are open on the line; a value that goes on in parentheses
    names: list[str] = []  # those of "a, b = ..." before the last, then those that still wait for a value
    for kind, start, end in _tokens(text):
        if kind == "word" and end < len(text) and text[end] in "\"'" and text[start:end].lower() in PREFIXES:
            continue
        if kind == "end":
            mark = text[start]
            given = given and mark != "\n"
            depth = 0 if mark == "\n" else depth + 1 if mark in "([{" else max(depth - 1, 0) if mark in ")]}" else depth
            if armed and name is not None and (mark == "(" and word_end != start or mark == "\n" and wrapped):
                wrapped = True
                continue
            wrapped = False
            if mark == "]" and name is not None and not armed and text[name_end:start].strip("\"'") == "":
                name_end = end  # x["name"] is named so
                continue
            if mark == "," and depth == 0 and name is not None and not armed and argument is None:
                names.append(name)
            elif mark == "," and depth == 0 and names and given:
                name, armed, joined = names.pop(0), True, None
                continue
            elif mark != ",":
                names = []
            calls, follows = mark == "(" and name is not None and word_end == start, mark == "," and argument is not None
            if mark == "{" and len(nest) < DEEPEST:
                nest.append(max(nest[-1] if nest else 0, sensitivity(name) if armed and name else 0))
            elif mark == "}" and nest:
                nest.pop()
            elif mark == "\n":
                label = None
            name, armed = (name, True) if calls else (argument, True) if follows else (None, False)
            argument, joined = "" if calls else None, None
        elif kind == "blank":
            nest.clear()
        elif kind == "assign":
            armed, joined = name is not None and text[name_end:start].strip("\"' \t") == "", None
            argument = None
            if not armed:
                name = None
            elif names:
                names.append(name)
                name = names.pop(0)
            given = armed
        elif kind == "plus":
            if joined is None:
                name, armed = None, False
        elif armed and name is not None:
            ref = text[start:end] if kind == "word" else None
            plain = name.lower()
            if kind == "string" and label and plain == "value":
                name = label
            got = Pair(name, start, end, ref, None, nest[-1] if nest else 0)
            if kind != "string" and argument == "":
                armed = False  # only quoted arguments are literals
                continue
            yield got
            value = text[start:end] if kind == "string" and end - start <= 64 and re.fullmatch(NAME, text[start:end]) else None
            if plain in LABELS and value:
                label = value
            argument = value if argument == "" else None
            joined, armed = got, False
            name, name_end = (ref, end) if ref else (None, -1)
        elif joined is not None and kind == "string" and text[joined.end : start].strip("\"' \t") == "+":
            joined = Pair(joined.name, start, end, None, joined.joined or joined, joined.outer)  # a further part of a joined literal
            yield joined
        else:
            name = text[start:end] if kind in ("word", "string") else None
            name_end, joined, word_end = end, None, end if kind == "word" else -1


def _tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of each token; of strings, what is between the quotes. ``blank`` is an empty line.

    Only lines with a ``SIGN`` are lexed; all other text is skipped. A quote that isn't closed on its line is passed over:
    then none of its kind after it is closed either, so that each line is read a bounded number of times.
    """
    at, n = 0, len(text)
    unclosed: set[str] = set()  # triple quotes that the rest of the text doesn't close
    goes_on = False  # the line before ended with a parenthesis that it opened
    while at < n:
        if not goes_on:
            sign = SIGN.search(text, at)
            if sign is None:
                return
            begin = max(text.rfind("\n", at, sign.start()) + 1, at)
            if begin > at and text.find("\n\n", max(at - 1, 0), begin) >= 0:
                yield "blank", begin, begin
            stop = text.find("\n", sign.start()) + 1 or n
        else:
            begin, stop = at, text.find("\n", at) + 1 or n
        quotes, at = "\"'", begin
        while at < stop:
            resume = stop
            for m in LEXERS[quotes].finditer(text, at, stop):
                kind = m.lastgroup
                if kind == "string":
                    yield kind, m.start() + 1, m.end() - 1
                elif kind == "triple":
                    close = -1 if m.group() in unclosed else text.find(m.group(), m.end())
                    if close < 0:
                        unclosed.add(m.group())
                        continue
                    yield "string", m.end(), close
                    resume = close + 3
                    if resume > stop:
                        quotes, stop = "\"'", text.find("\n", resume) + 1 or n
                    break
                elif kind == "open":
                    quotes, resume = quotes.replace(m.group(), ""), m.end()
                    break
                else:
                    yield kind, m.start(), m.end()
            at = resume
        goes_on = text[begin:stop].rstrip().endswith("(")


def lexed(text: str) -> list[tuple[int, int, int]]:
    """Start, end and score of the literals that reach a sensitive name."""
    found = list(pairs(text))
    found += [Pair(m[1], *m.span(2), None) for m in ELEMENT.finditer(text)] + [Pair("password", *m.span(1), None) for m in ADDRESS.finditer(text)]
    if not found:
        return []
    assigned = {p.name for p in found}
    for p in found:
        if p.ref not in assigned:
            p.ref = None  # a bare word that names nothing is a literal
    score: dict[str, int] = {}
    reads: dict[str, set[str]] = {}  # name -> names that are assigned it
    for p in found:
        score[p.name] = max(score.get(p.name, 0), sensitivity(p.name))
        if p.ref:
            reads.setdefault(p.ref, set()).add(p.name)
    # constants flow along assignments, so sensitivity flows back to the names that they come from
    todo = [n for n, s in score.items() if s]
    back: dict[str, set[str]] = {}
    for ref, names in reads.items():
        for n in names:
            back.setdefault(n, set()).add(ref)
    while todo:
        n = todo.pop()
        for ref in back.get(n, ()):
            if score.get(ref, 0) < score[n]:
                score[ref] = score[n]
                todo.append(ref)
    # the parts of a joined literal are judged as one, once
    parts: dict[Pair, list[str]] = {}
    for p in found:
        parts.setdefault(p.joined or p, []).append("" if p.ref else text[p.start : p.end])
    random: dict[Pair, bool | None] = {}
    for first, texts in parts.items():
        value = "".join(texts)
        random[first] = None if len(value) < LITERAL_LEAST or PLACEHOLDER.match(value) else looks_random(value)
    out: dict[tuple[int, int], int] = {}
    for p in found:
        looks = random[p.joined or p]
        if p.ref or p.start == p.end or looks is None:
            continue
        weight = max(score[p.name], p.outer)
        if weight and weight + looks >= LEAST_SCORE:
            out[p.start, p.end] = max(out.get((p.start, p.end), 0), weight + looks)
    return [(a, b, s) for (a, b), s in sorted(out.items())]


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans as kind, start, end (code points, end exclusive), by start, then kind in the order of ``KINDS``."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    out += [("lexed", a, b) for a, b, _ in lexed(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by ``[SECRET]``."""
    out, at = [], 0
    for _, a, b in sorted(found, key=lambda s: (s[1], s[2])):
        if b > at:
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = b
    return "".join(out) + text[at:]


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        n, sha, listed, cleaned = [], [], [], []
        for text in b.column("text").to_pylist():
            found = scan(text or "")
            base = [s for s in found if s[0] != "lexed"]
            n.append([sum(s[0] == k for s in found) for k in KINDS])
            sha.append(hashlib.sha256(",".join(f"{k}:{x}:{y}" for k, x, y in base).encode()).hexdigest())
            listed.append(",".join(f"{k}:{x}:{y}" for k, x, y in found))
            cleaned.append(redact(text, found) if found else text)
        cols = [pa.array([x[k] for x in n], pa.int64()) for k in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(sha, pa.string()), pa.array(listed, pa.string()), pa.array(cleaned, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted"])


def _redact(at: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, at):
        texts = pa.array([t and redact(t, scan(t)) for t in b.column(at).to_pylist()], b.schema.field(at).type)
        yield pa.RecordBatch.from_arrays([texts if k == at else b.column(k) for k in range(b.num_columns)], schema=b.schema)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_assign, n_access, n_hex, n_lexed, base_sha256, spans, redacted``.

    ``spans`` and the base spans behind ``base_sha256`` are ``kind:start:end``, comma-joined; a text without spans has an
    empty string. Null texts count as empty and stay null in ``redacted``. Repeated rows, repeated or null ids each keep
    a row of their own; an empty table gives an empty result; other columns are not looked at.
    """
    rows = tagged(docs, id_col, text_col).select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"doc_id {id_type}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, redacted string")


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` replaced; every row and column stays."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _redact(at, it), docs.schema)
