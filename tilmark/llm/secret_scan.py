"""Secret scan: fixed base patterns, and assignment-aware lexing with constant propagation.

Base kinds are `assign`, `access` and `hex`, the leftmost non-overlapping matches of each pattern, those that are
too short dropped. The method adds kind `literal`: assignments.py lexes source and configuration syntax and reads it into name-literal pairs;
a value is a sum of literals and of names bound before, which stand for the literals last bound to them. A pair scores the sensitivity of
its target names (whole words of the name, split at case and punctuation) times the plausibility of the literal (length, variety of
characters, no placeholder). At MIN_SCORE or more every literal that flows into the target is a span, also where it is written under an
innocent name. Literals and names are of any length, and any number of literals flows on.

Spans are in code points, end exclusive. Defined cases: a null or empty text has no spans; a literal that reaches
several targets is one span; spans of different kinds may overlap; spans that start at one place are ordered by kind; a very long text is
read whole, in time that grows with its length; repeated rows and rows with a null id give one
row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmark.llm import textvec as tv
from tilmark.llm.assignments import Value, read

KINDS = ("assign", "access", "hex", "literal")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base patterns with their least lengths (of group 2, or of the match).
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(f"({'|'.join(map(_either, NAMES))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 12
ACCESS, ACCESS_LEAST = re.compile(r"AKIA[A-Z0-9]+"), 18
HEX = re.compile(r"[0-9a-f]{16,}")  # the leftmost runs of the pattern [0-9a-f]+ that have 16 or more characters

#: Name words and their weight as the target of a literal.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "auth": 0.7, "signature": 0.6, "salt": 0.6, "pin": 0.5,
}
#: Pairs of neighbouring name words, as above.
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0, ("account", "key"): 0.9, ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("client", "key"): 0.8}
#: Names that speak of a secret without holding one.
HARMLESS = {"url", "uri", "path", "file", "name", "length", "len", "type", "field", "label", "hint", "regex", "count", "limit", "expiry", "ttl", "policy"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|(?:your|my|some|example|sample|dummy|test|change|insert|enter|todo|none|null|true|false|undefined|redacted).*)$")
GATE = ("pass", "pwd", "secret", "token", "key", "cred", "bearer", "auth", "signature", "salt", "pin")
MIN_SCORE = 0.5
MIN_LITERAL = 8
ENDS = 32
_CODE = re.compile(r"[=:<]|--[A-Za-z]|#define")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rule."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def name_weight(name: str) -> float:
    """How strongly a target name promises a secret, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    words = [w[:-1] if w[:-1] in SENSITIVE or w == "keys" else w for w in words]
    if not words:
        return 0.0
    best = max([SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False)])
    return best * (0.3 if words[-1] in HARMLESS else 1.0)


def literal_weight(value: str) -> float:
    """How plausible a literal is as a secret, 0 to 1."""
    return _weight(len(value), Counter(value), value) if len(value) >= MIN_LITERAL else 0.0


def _weight(n: int, counts: Counter, value: str) -> float:
    """literal_weight of a value of n characters by their counts. value may stand for one of equal ends and characters."""
    if n < MIN_LITERAL or PLACEHOLDER.match(value) or any(c.isspace() for c in counts):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum((any(c.isdigit() for c in counts), any(c.islower() for c in counts), any(c.isupper() for c in counts), any(not c.isalnum() for c in counts)))
    return min(1.0, bits / 3.0) * min(n, 12) / 12 * (1.0 if kinds > 1 else 0.4)


Summary = tuple[int, Counter, str, str]


class Flow:
    """How plausible the values of one text are, and which literals a score has reached."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[int, Summary] = {}
        self.score: dict[int, float] = {}
        self.walked: dict[int, float] = {}
        self.held: list[Value] = []  # ids stay theirs as long as the values live

    def sums(self, value: Value, weight: float) -> Iterator[Value]:
        """The sums that a value is a choice of, but for those given for a name of as much weight."""
        stack = [value]
        while stack:
            v = stack.pop()
            if self.walked.get(id(v), 0.0) >= weight:
                continue
            self.walked[id(v)] = weight
            self.held.append(v)
            if v.choice or len(v.parts) == 1 and isinstance(v.parts[0], Value):
                stack += reversed(v.parts)
            else:
                yield v

    def summary(self, value: Value) -> Summary:
        """Length, counts of characters, and the first and last ENDS characters of the joined literals; in a sum, a choice stands for its longest part."""
        stack = [value]
        while stack:
            v = stack[-1]
            todo = [p for p in v.parts if isinstance(p, Value) and id(p) not in self.known]
            if todo:
                stack += todo
                continue
            stack.pop()
            n, counts, head, tail = 0, Counter(), "", ""
            for p in [max(v.parts, key=lambda x: self.known[id(x)][0])] if v.choice and v.parts else v.parts:
                if isinstance(p, Value):
                    k, own, a, b = self.known[id(p)]
                else:
                    part = self.text[p[0] : p[1]]
                    k, own, a, b = len(part), Counter(part), part[:ENDS], part[-ENDS:]
                n, head, tail = n + k, (head + a)[:ENDS], (tail + b)[-ENDS:]
                counts.update(own)
            self.known[id(v)] = n, counts, head, tail
            self.held.append(v)
        return self.known[id(value)]

    def weight(self, value: Value) -> float:
        if not any(isinstance(p, Value) for p in value.parts):
            return literal_weight("".join(self.text[a:b] for a, b in value.parts))
        n, counts, head, tail = self.summary(value)
        return _weight(n, counts, head + "".join(counts) + tail if n > 2 * ENDS else head + tail[max(0, len(head) + len(tail) - n) :])

    def reached(self, value: Value, score: float) -> Iterator[tuple[int, int]]:
        """Spans of all literals, but for those that a score as high has reached."""
        stack = [value]
        while stack:
            v = stack.pop()
            if self.score.get(id(v), 0.0) < score:
                self.score[id(v)] = score
                self.held.append(v)
                yield from (p for p in v.parts if not isinstance(p, Value))
                stack += [p for p in v.parts if isinstance(p, Value)]


def literal_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of literals that flow into sensitive names."""
    low = text.lower()
    if not any(x in low for x in GATE) or not _CODE.search(text):
        return []
    flow, found = Flow(text), {}
    for pair in read(text):
        weight = max(map(name_weight, pair.names))
        for value in flow.sums(pair.value, weight) if weight and pair.value.parts else ():
            score = weight * flow.weight(value)
            if score >= MIN_SCORE:
                for a, b in flow.reached(value, score):
                    if b > a:
                        found[a, b] = max(score, found.get((a, b), 0.0))
    return [(a, 3, b, s) for (a, b), s in found.items()]


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind, end), by start and kind."""
    return sorted([*base_spans(text), *((a, k, b) for a, k, b, _ in literal_spans(text))]) if text else []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tv.chunks(batches):
        found = [spans_of(t) for t in texts]
        rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["id", "spans"])


def secret_scan(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key and spans, an array of (kind, start, end)."""
    kind = texts.schema[key].dataType.simpleString()
    scanned = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_scan, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return scanned.select(F.col("id").alias(key), "spans")


def digest(spans: list[tuple[int, int, int]]) -> str:
    """Lowercase SHA-256 of kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
