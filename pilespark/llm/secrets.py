"""Secrets in whole texts: fixed patterns, and literals assigned to sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Kinds in the order in which spans of one start are listed; `named` is what the lexer adds.
KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run that is too short holds no long enough run, so the length may stand in the pattern (not so in ASSIGN).
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Tokens, tried in this order at each place; what is repeated is possessive, so no length is bounded and the time is
#: linear. A string may hold escapes; one that does not end on its line is no string, and its quote stands alone.
TOKEN = re.compile(
    r"""
    (?P<long>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+''')
    |(?P<string>"(?:[^"\\\n]|\\(?s:.))*+"|'(?:[^'\\\n]|\\(?s:.))*+'|`[^`\n]*+`)
    |(?P<comment>/\*(?:[^*]|\*(?!/))*+\*/)
    |<(?P<element>[A-Za-z_][\w.:-]*+)(?:\s++[\w.:-]++\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))*+\s*+>(?P<body>[^<]*+)</(?P=element)\s*+>
    |(?P<continued>\\\r?\n[\x20\t]*+)
    |(?P<name>[A-Za-z_$][\w.$-]*+)
    |(?P<bind>:=|=>|->|=(?!=)|:(?!:))
    |(?P<space>[\x20\t]++)
    |(?P<line>\r?\n)
    |(?P<join>\+|\.(?=\s*+["'A-Za-z_]))
    |(?P<other>==|::|[0-9]++|.)
    """,
    re.VERBOSE | re.ASCII,
)
#: A word of a configuration file, without quotes, up to what ends a value there.
BARE = re.compile(r"""[^\s"',;(){}\[\]<>|]++""")
PLUS = re.compile(r"[\x20\t]*+\+[\x20\t]*+")
REFERENCE = re.compile(r"[A-Za-z_$][\w.$]*+", re.ASCII)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Weights of words of a target name: fixed values.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "credential": 2.5, "credentials": 2.5, "token": 2.5, "apikey": 3.0, "auth": 1.5, "bearer": 2.0, "key": 1.5, "private": 1.0, "access": 1.0, "api": 1.0, "signing": 1.0, "encryption": 1.0, "client": 0.5}
HARMLESS = {"example": -2.0, "test": -1.0, "public": -2.0, "name": -1.5, "path": -1.5, "file": -1.5, "url": -1.0, "id": -0.5, "count": -1.5, "type": -1.5}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|changeme|your[_-].*|example.*|none|null|true|false|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%)$")
LEAST_SCORE, LEAST_NAME = 5.0, 1.5
#: Strings within strings that are read for statements of their own.
DEPTH = 3


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    return sum(SENSITIVE.get(w, 0.0) + HARMLESS.get(w, 0.0) for w in words)


def literal_score(value: str) -> float:
    """Up to 4: length, bits a character, mixed character classes; a placeholder or prose scores below 0."""
    if len(value) < 8 or PLACEHOLDER.match(value):
        return -9.0
    return counted_score(Counter(value), len(value))


def counted_score(counts: Counter, n: int) -> float:
    """literal_score() of n characters that are no placeholder, from their counts."""
    if n < 8 or any(c.isspace() for c in counts):
        return -9.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    distinct = "".join(counts)
    classes = sum(bool(re.search(p, distinct)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, n / 16) + min(2.0, bits / 2) + (0.5 * (classes - 1) if re.search("[0-9]", distinct) else -0.5)


class Statements:
    """Name-literal pairs of one text: (name, place of the value, parts); a part is (name referred to or None, begin, end).

    A name is a word, a quoted key, a quoted item in brackets, or the name of an element; a value is quoted parts and
    references joined by + or . or by standing next to each other, over continued lines too, the body of an element, or
    else a bare word up to white space or punctuation. Statements within comments, strings and bare words are read too.
    """

    def __init__(self, text: str):
        self.text = text
        self.found: list[tuple[str, int, list]] = []
        self.bare: dict[int, list[int]] = {}
        self.bare_end = 0
        self.nested: dict[int, int] = {}
        self.read(0, len(text), 0)

    def read(self, begin: int, end: int, depth: int) -> None:
        match, text, self.bare_end = TOKEN.match, self.text, 0
        name = key = None  # the last name; what is bound to the right of an operator
        inside: list[tuple[int, int]] = []
        at, bracket = begin, False
        while at < end and (m := match(text, at, end)):
            kind, at = m.lastgroup, m.end()
            if kind == "element" or kind == "body":
                b, e = m.span("body")
                self.value_of(m["element"].rpartition(":")[2], b, e, depth)
                name = None
            elif kind == "comment":
                inside.append((m.start() + 2, m.end() - 2))
            elif kind == "long" or kind == "string":
                skip = 3 if kind == "long" else 1
                span = m.start() + skip, m.end() - skip
                inside.append(span)
                if name is None or not bracket:
                    name = text[span[0] : span[1]] if span[1] - span[0] <= 256 and "\n" not in m.group() else None
                else:
                    name = text[span[0] : span[1]]  # an item in brackets names the pair
            elif kind == "name":
                name, bracket = m.group(), False
            elif kind == "bind":
                if name is not None:
                    key, name = name, None
                    at = self.right_side(key, at, end, inside)
                bracket = False
            elif kind == "line" or kind == "space" or kind == "continued":
                if kind == "line":
                    name, bracket = None, False
            elif m.group() == "[":
                bracket = True
            elif m.group() == "]" or m.group() in "?!":
                pass
            else:
                name, bracket = None, False
        if depth < DEPTH:
            for b, e in inside:
                if e - b > 8 and (text.find("=", b, e) >= 0 or text.find(":", b, e) >= 0):
                    self.read(b, e, depth + 1)

    def value_of(self, name: str, b: int, e: int, depth: int) -> None:
        """The body of an element is one literal without the white space around it."""
        body = self.text[b:e]
        first = b + len(body) - len(body.lstrip())
        last = b + len(body.rstrip())
        if first < last:
            self.found.append((name, first, [(None, first, last)]))
            if depth < DEPTH and ("=" in body or ":" in body):
                self.read(first, last, depth + 1)

    def right_side(self, name: str, at: int, end: int, inside: list) -> int:
        """Read the value that begins at `at`; the place after it, or where a pair within it may begin."""
        text, match, parts = self.text, TOKEN.match, []
        place = None
        joined = True  # whether the next part belongs to the value
        while at < end and (m := match(text, at, end)):
            kind = m.lastgroup
            if kind == "space" or kind == "continued":
                at = m.end()
                continue
            if kind == "string" or kind == "long":
                skip = 3 if kind == "long" else 1
                b, e = m.start() + skip, m.end() - skip
                place = m.start() if place is None else place
                parts.append((None, b, e))
                inside.append((b, e))
                at, joined = m.end(), False
                continue
            if kind == "join" and parts and m.start() > place:
                at, joined = m.end(), True
                continue
            if kind == "name" and parts and joined:
                if ref := REFERENCE.fullmatch(m.group()):
                    parts.append((ref.group(), m.start(), m.end()))
                    at, joined = m.end(), False
                    continue
            break
        if parts:
            self.found.append((name, place, parts))
            return at
        if at < self.bare_end or (m := BARE.match(text, at, end)):
            # within a bare word read before, this one ends where that one does
            b, e = (at, min(self.bare_end, end)) if at < self.bare_end else m.span()
            self.bare_end = max(self.bare_end, e)
            if REFERENCE.fullmatch(text, b, e):
                # a bare word may be a reference followed by parts that it is joined with
                parts, at = [(text[b:e], b, e)], e
                while (j := PLUS.match(text, at, end)) and (x := TOKEN.match(text, j.end(), end)) and x.lastgroup in ("string", "name"):
                    if x.lastgroup == "string":
                        parts.append((None, x.start() + 1, x.end() - 1))
                        inside.append(parts[-1][1:])
                    else:
                        parts.append((x.group(), x.start(), x.end()))
                    at = x.end()
                self.found.append((name, b, parts if len(parts) > 1 else [parts[0], (None, b, e)]))
                return at if len(parts) > 1 else b  # else it may be a name itself
            self.found.append((name, b, [(None, b, e)]))
            self.bare.setdefault(e, []).append(b)
            if e not in self.nested:  # the last place of an operator within the word, looked for once
                self.nested[e] = max(text.rfind("=", b, e), text.rfind(":", b, e))
            return b if self.nested[e] >= b else e
        return at


def named_literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals bound, directly or through constants, to names that are sensitive.

    One pass reads name-literal pairs. Then the sensitive names pass their weight on to the constants that their values
    refer to (of a constant's bindings the last before the use, else the first after it), each binding taking the
    greatest weight that reaches it: bindings are visited once, in falling order of weight, so cycles end and the time is
    linear but for a sort. A binding's literals are scored as one text, with the weight that reached it.
    """
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    read = Statements(text)
    uses = read.found
    places: dict[str, list[int]] = {}
    order: dict[str, list[int]] = {}
    for k in sorted(range(len(uses)), key=lambda k: uses[k][1]):
        short = uses[k][0].rpartition(".")[2]
        places.setdefault(short, []).append(uses[k][1])
        order.setdefault(short, []).append(k)
    scores: dict[tuple[int, int], float] = {}
    for end, begins in read.bare.items():
        if len(begins) > 1:  # bare words within one another are counted once, from the last on
            counts, after = Counter(), end
            for b in sorted(set(begins), reverse=True):
                counts.update(text[b:after])
                after = b
                scores[b, end] = -9.0 if PLACEHOLDER.match(text[b : min(end, b + 64)]) else counted_score(counts, end - b)
    found: set[tuple[int, int]] = set()
    queue = sorted(((-by, k) for k, (name, _, _) in enumerate(uses) if (by := name_score(name)) >= LEAST_NAME), key=lambda x: (x[0], x[1]))
    seen = [False] * len(uses)
    weights = sorted({by for by, _ in queue})
    waiting: dict[float, list[int]] = {by: [k for b, k in queue if b == by] for by in weights} if len(weights) <= 64 else {}
    if not waiting and queue:
        for by, k in queue:
            waiting.setdefault(by, []).append(k)
        weights = sorted(waiting)
    for by in weights:  # from the greatest weight on, which is the least of the negatives
        stack = waiting[by]
        while stack:
            k = stack.pop()
            if seen[k]:
                continue
            seen[k] = True
            name, at, parts = uses[k]
            if len(parts) == 2 and parts[0][0] is not None and parts[0][1:] == parts[1][1:]:
                # a bare word: a reference if another binding has that name, else a literal
                short = parts[0][0].rpartition(".")[2]
                parts = parts[:1] if short in order and short != name.rpartition(".")[2] else parts[1:]
            for ref, _, _ in parts:
                if ref is not None and (short := ref.rpartition(".")[2]) in order:
                    i = bisect_left(places[short], at) - 1
                    stack.append(order[short][max(i, 0)])
            literal = [(b, e) for ref, b, e in parts if ref is None]
            if literal:
                fits = scores.get(literal[0]) if len(literal) == 1 else None
                if fits is None:
                    fits = literal_score("".join(text[b:e] for b, e in literal))
                if fits - by >= LEAST_SCORE:
                    found.update(literal)
    return sorted((b, e) for b, e in found if e > b)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in spans)


def all_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets of one text, in order; `named` ones only where no base span covers them."""
    if not text:
        return []
    spans = base_spans(text)
    added, reach, i = [], -1, 0
    for b, e in named_literals(text):
        while i < len(spans) and spans[i][0] <= b:  # base spans that begin no later, by the farthest end
            reach = max(reach, spans[i][2])
            i += 1
        if reach < e:
            added.append((b, 3, e))
    return sorted(spans + added)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>: every secret in each whole text, in one pass without a shuffle.

    Offsets count code points, ends are exclusive. Base kinds are assign, access and hex; `named` spans are literals
    that the assignment-aware lexer finds and no base span of any kind covers. Null and empty texts give an empty
    list; a row stays a row, with null or repeated ids kept; other columns are not read; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": b, "end": e} for b, k, e in all_spans(text)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of secret_spans()."""
    base = F.filter("spans", lambda s: s["kind"] != "named")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def digest_of(text: str) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()
