"""Secret scans: fixed patterns, and a lexer that knows assignments.

The lexer reads source and configuration syntax (``name = value``, ``name:
value``, ``"name": "value"``, ``name := value``, ``name => value``, ``name:
type = value``, ``x["name"] = value``, ``<name>value</name>``) into pairs of a
name and the terms of its value: quoted literals, bare words and names of
other constants, joined by ``+``. A constant's literals are propagated to the
names that it is assigned to. A value is scored by how sensitive its target
name is and how much like a secret it looks; literals that reach ``THRESHOLD``
are spans of kind ``literal``, each at its own place.

A constant is kept as its own terms and references to the constants it is made
of, with a summary of its value (length, counts of characters, both ends), so
that its size doesn't follow the length of what it stands for.

Defined cases: a null or empty text has no spans; equal texts have equal
spans; texts, names and gaps of any length are read whole. Of a name assigned
more than once, the latest value before a use holds; a name that is never
assigned has no literals and counts as a bare word. Spans of one start are
ordered by kind, then end. Repeated rows are scanned as often as they occur;
an empty table gives no rows. ``scan`` returns columns of its own only, and
``redacted`` all columns as they came but ``text`` and ``n_chars``, whatever
other columns are named.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verbascope.llm.common import give_up, over_batches, small_batches, table

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of fewer is no match wherever it is entered, so the bound can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "literal")

OPERATOR = re.compile(r":=|=>|(?<![=!<>:])=(?![=>])|:(?![:=/])")
#: A name with a closing quote or subscript, read from right to left.
NAME_BEFORE = re.compile(r"""[ \t]*(?:\][ \t]*["']|["']?)([A-Za-z0-9_.\-]*[A-Za-z_])""")
#: The type between a name's colon and its equals sign.
TYPE = re.compile(r"[ \t]*[A-Za-z_][A-Za-z0-9_.\[\], |]*\Z")
#: What may stand between an operator and a literal that isn't right behind it.
OPENED = re.compile(r"[ \t]*(?:\([ \t]*)?(?:\r?\n[ \t]*)?")
KEY = re.compile(r"[ \t]*[:=]")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.\-]*)>([^<>]+)</\1>")
BLANKS = re.compile(r"[ \t]*")
LITERAL = re.compile(r"""[bBrRuU]{0,2}(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)""", re.DOTALL)
BARE = re.compile(r"""[^\s"'`,;|(){}\[\]<>#]+""")
CONSTANT = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
JOINED = re.compile(r"[ \t]*\+[ \t]*(?:\n[ \t]*)?")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: How sensitive the parts of a name are, alone or next to each other.
NAMES = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "pass": 1.5, "secret": 3.0, "token": 2.5, "credential": 2.5,
    "credentials": 2.5, "apikey": 3.0, "api key": 3.0, "access key": 3.0, "private key": 3.0, "secret key": 3.0, "auth key": 2.5,
    "signing key": 2.5, "encryption key": 2.5, "auth": 1.0, "bearer": 2.0,
}
HARMLESS = re.compile(r"(?i)\A(?:true|false|none|null|nil|undefined|yes|no|on|off|todo|changeme|example|placeholder|redacted|your.*|x+|\*+|\.+|-+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)\Z")
THRESHOLD = 5.0


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int
    value_end: int

    def order(self) -> tuple:
        return self.start, KINDS.index(self.kind), self.end


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and apart within each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [Span("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [Span("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [Span("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return out


def sensitivity(name: str) -> float:
    parts = [x.lower() for x in PARTS.findall(name)]
    pairs = [" ".join(x) for x in zip(parts, parts[1:], strict=False)]
    return max((NAMES.get(x, 0.0) for x in parts + pairs), default=0.0)


#: Characters of each end that a summary keeps; beyond so many characters counts are shares.
END, MOST = 32, 2.0**50


class Value:
    """What scoring needs of a value: length, counts of characters, first and last characters."""

    __slots__ = ("counts", "head", "length", "tail")

    def __init__(self, text: str = ""):
        self.length, self.counts = float(len(text)), Counter(text)
        self.head, self.tail = text[: 2 * END], text[-2 * END :]

    def add(self, other: Value) -> None:
        """Puts ``other`` behind."""
        self.head = (self.head + other.head)[: 2 * END] if self.length < 2 * END else self.head
        self.tail = (self.tail + other.tail)[-2 * END :] if other.length < 2 * END else other.tail
        for c, n in other.counts.items():
            self.counts[c] += n
        self.length += other.length
        if self.length > MOST:
            for c in self.counts:
                self.counts[c] *= MOST / self.length
            self.length = MOST

    def alike(self) -> str:
        """The value, or one with the same ends and characters where it is long."""
        return self.head if self.length <= 2 * END else self.head[:END] + "".join(self.counts) + self.tail[-END:]


def strength(value: Value) -> float:
    """Up to 4: for length, entropy and kinds of characters; below 0 for what stands in for a secret."""
    text = value.alike()
    if value.length < 6 or HARMLESS.match(text):
        return -10.0
    shares = [n / value.length for n in value.counts.values()]
    entropy = -sum(x * math.log2(x) for x in shares if x > 0)
    kinds = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w\s]"))
    blank = 2.0 * bool(re.search(r"\s", text))
    return min(1.5, value.length / 16) + min(1.5, max(0.0, entropy - 2) * 0.75) + 0.5 * (kinds - 1) - blank


class Constant:
    """A value as its own places and the constants that it is made of."""

    __slots__ = ("found", "parts", "places", "value")

    def __init__(self, text: str, parsed: list[tuple[str, int, int]], constants: dict[str, Constant]):
        self.places: list[tuple[int, int]] = []
        self.parts: list[Constant] = []
        self.value, self.found = Value(), False
        for kind, start, end in parsed:
            known = constants.get(text[start:end]) if kind == "bare" and CONSTANT.match(text, start, end) else None
            if known is None:
                self.places.append((start, end))
                # white space at a term's ends isn't part of a secret
                self.value.add(Value(text[start:end].strip()))
            else:
                if known not in self.parts:
                    self.parts.append(known)
                self.value.add(known.value)

    def spans(self) -> Iterator[Span]:
        """The places that it comes from; those of a constant are given once in a text."""
        left = [self]
        while left:
            at = left.pop()
            if not at.found:
                at.found = True
                yield from (Span("literal", a, b, a, b) for a, b in at.places if a < b)
                left += at.parts


def name_before(text: str, at: int) -> str | None:
    """The name that ends before ``at``, of whatever length and behind whatever gap."""
    window = 64
    while True:
        left = max(0, at - window)
        m = NAME_BEFORE.match(text[left:at][::-1])
        if left == 0 or m and m.end() < at - left or not m and text[left:at].strip(" \t"):
            return m[1][::-1] if m else None
        window *= 8


def terms(text: str, at: int) -> tuple[list[tuple[str, int, int]], int]:
    """The terms of a value from ``at``: (kind, start, end), kind one of literal and bare; and where it ends."""
    out = []
    while True:
        at = BLANKS.match(text, at).end()
        if m := LITERAL.match(text, at):
            out.append(("literal", *m.span(m.lastindex)))
        elif m := BARE.match(text, at):
            out.append(("bare", *m.span()))
        else:
            return out, at
        at = m.end()
        if not (m := JOINED.match(text, at)) or m.end() >= len(text):
            return out, at
        at = m.end()


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or by way of constants."""
    found: dict[tuple[int, int], Span] = {}
    constants: dict[str, Constant] = {}
    colon: tuple[str, int] | None = None
    for m in OPERATOR.finditer(text):
        name = name_before(text, m.start())
        names = {name} if name else set()
        if m[0] == "=" and colon and TYPE.match(text, colon[1], m.start()):
            names.add(colon[0])
        colon = (name, m.end()) if m[0] == ":" and name else None
        if not names:
            continue
        parsed, _ = terms(text, m.end())
        if not parsed:
            at = OPENED.match(text, m.end()).end()
            if (first := LITERAL.match(text, at)) and not KEY.match(text, first.end()):
                parsed, _ = terms(text, at)
        if not parsed:
            continue
        made = Constant(text, parsed, constants)
        if not made.places and len(made.parts) == 1 and len(parsed) == 1:
            made = made.parts[0]
        constants.update(dict.fromkeys(names, made))
        worth = max(map(sensitivity, names))
        if worth and worth + strength(made.value) >= THRESHOLD:
            found |= {(x.start, x.end): x for x in made.spans()}
    for m in ELEMENT.finditer(text):
        worth = sensitivity(m[1])
        if worth and worth + strength(Value(m[2].strip())) >= THRESHOLD:
            found[m.span(2)] = Span("literal", *m.span(2), *m.span(2))
    return list(found.values())


def spans(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    more = literal_spans(text) if "=" in text or ":" in text else []
    return sorted(base_spans(text) + more, key=Span.order)


def joined(found: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of every row of ``docs``."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch["doc_id"], "spans": [[x._asdict() for x in spans(t)] for t in batch["text"].to_pylist()]}

        return step

    rows = docs.select(docs.doc_id.cast("long").alias("doc_id"), "text")
    return over_batches(rows, "doc_id long, spans array<struct<kind:string,start:int,end:int,value_start:int,value_end:int>>", make)


def redacted_text(text: str, mark: str = "[REDACTED]") -> str:
    """``text`` with the values of its spans replaced; values that overlap are replaced together."""
    out, at = [], 0
    reach = None
    for a, b in sorted((x.value_start, x.value_end) for x in spans(text)):
        if reach is not None and a < reach:
            reach = max(reach, b)
            at = reach
            continue
        out += [text[at:a], mark]
        at = reach = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text``, and ``n_chars``, if there, counted anew where the text changed."""
    names = docs.columns
    small_batches(docs.sparkSession)

    def run(batches):
        give_up()
        for batch in batches:
            texts = batch["text"].to_pylist()
            after = [x if not x else redacted_text(x) for x in texts]
            columns = {n: batch[n] for n in names}
            if after != texts:
                columns["text"] = pa.array(after, batch["text"].type)
                if "n_chars" in columns:
                    old = batch["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([o if a == t else len(a) for o, a, t in zip(old, after, texts, strict=True)], batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for text in batch["text"].to_pylist():
                found = spans(text)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(x.kind == kind for x in found))
                out["base_sha256"].append(hashlib.sha256(joined([x for x in found if x.kind != "literal"]).encode()).hexdigest())
                out["spans"].append(joined(found))
            return out

        return step

    docs = table(spark, sf_dir, "documents")
    rows = docs.select(docs.doc_id.cast("long").alias("doc_id"), "text")
    return over_batches(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)
