"""A lexer and a reader of assignments for source and configuration text.

lex() cuts text into tokens: names, numbers, strings of all kinds (prefixed, triple, raw, back-quoted), comment marks,
operators, brackets and line ends. A quote without its partner, as an apostrophe, is an operator. read() walks the tokens once and yields name-literal pairs:

* `name = value`, `:=`, `=>`, `+=`, `?=`, `:`; with a type between (`name: type = value`, `const char name[] = value`, `var name type = value`);
  chains (`a = b = value`); keys in quotes or in square brackets; `--name value`, `#define name value`, `ENV name value`;
* YAML values on the lines below a key, as a list or more indented; XML elements, and `key=name value=literal` in a tag;
* a value is a sum (`+`, `.` or `&` between blanks, or strings side by side) of strings, bare values, names bound before and
  such sums in parentheses; lines go on after a backslash, an operator or an open bracket. Arguments of a call do not flow;
* choices of values: items of lists and tuples, `a or b`, `a || b`, `a ?? b`, `c ? a : b`, `a if c else b`; each is scored by itself. A format that holds
  nothing but its places is left out (`"%s" % value`). `a, b = value, value` binds name by name.

Names stand for what they were last bound to in the function around them, or around that: a function's bindings end with its braces or
its indentation. Comments are read, but bind nothing outside of them. A string that is neither value nor key is read as text of its own,
with what is bound around it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

NAME, NUMBER, STRING, COMMENT, OP, LINE = range(6)

_NAME = r"[^\W\d][\w$]*+(?:[.\-]+[\w$]++)*+|\$[\w$]++(?:[.\-]+[\w$]++)*+"
#: What may stand before a quote as part of a string.
_PREFIX = r"(?:[rRbBuUfFlL@$]|[rR][bBfF]|[bBfF][rR]|u8|\$@|@\$)?"
_QUOTE = re.compile(rf"""(?<!\w){_PREFIX}(["'`])""")
_FIRST = r"""
    (?P<blank>[ \t\r\f\v]++|\\\r?\n)
  | (?P<line>\n)
  | (?P<comment>//(?<!:\/\/)|/\*|\*/|<!--|-->|\#(?!define\b)(?!\w)(?!\{))"""
_STRING = rf"""
  | (?P<string>(?<![\w]){_PREFIX}(?:\"\"\"(?P<s1>(?:[^"\\]|\\.|"(?!""))*+)\"\"\"|'''(?P<s2>(?:[^'\\]|\\.|'(?!''))*+)'''
      |"(?P<s3>(?:[^"\\\n]|\\.)*+)"|'(?P<s4>(?:[^'\\\n]|\\.)*+)'|`(?!``)(?P<s5>(?:[^`\\]|\\.)*+)`))"""
_LAST = rf"""
  | (?P<name>{_NAME})
  | (?P<number>\d[\w.]*+)
  | (?P<op>:=|=>|->|===?|!==?|<=|>=|\+=|\?=|\.=|::|&&|\|\||--(?=[A-Za-z])|\#define\b|```|.)
"""
_TOKENS, _OTHERS = (re.compile(x, re.X | re.S) for x in (_FIRST + _STRING + _LAST, _FIRST + _LAST))
#: A quote before a Rust lifetime, which has no partner.
_LIFETIME = re.compile(r"(?<=[&<, ])'[a-z_]\w*+(?!')")
_BARE = re.compile(r"[A-Za-z0-9/_$][A-Za-z0-9+/_.=$\-]*+")
_KINDS = {"name": NAME, "number": NUMBER, "string": STRING, "comment": COMMENT, "op": OP, "line": LINE}
_ELEMENT = re.compile(r"""<([A-Za-z_][\w.:\-]*+)(?:[^<>"'\n]|"[^"\n]*+"|'[^'\n]*+')*+(?<!/)>([^<>\n]++)</\1\s*+>""")
_TAG = re.compile(r"""<[A-Za-z_][\w.:\-]*+\s(?:[^<>"'\n]|"[^"\n]*+"|'[^'\n]*+')*+>""")
_ATTRIBUTE = re.compile(r"""(?<![\w\-])([A-Za-z_][\w.:\-]*+)\s*+=\s*+(?:"([^"\n]*+)"|'([^'\n]*+)')""")

ASSIGN = {"=", ":=", "=>", "+=", "?=", ".="}
JOIN = {"+", ".", "&"}
COMPARE = {"==", "===", "!=", "!==", "<", ">", "<=", ">=", "&&"}
_PLACES = re.compile(r"(?:%[-+ #0-9.]*[a-zA-Z])+")
TYPE_OPS = {".", "::", "*", "&", "?", "|", "!", "<", ">", "[", "]", ",", "(", ")"}
#: Names of types and words that declare, which stand between or before the parts of a declaration.
TYPES = {"str", "string", "bytes", "bytearray", "byte", "char", "bool", "boolean", "int", "long", "float", "double", "number", "any", "object", "final", "optional", "nsstring"}
FUNCTIONS = {"function", "func", "fn", "fun", "def", "sub", "class", "void"}
BRANCHES = {"if", "for", "while", "switch", "catch", "else", "with", "foreach", "elif", "match", "try"}


@dataclass(slots=True)
class Token:
    kind: int
    start: int
    end: int
    a: int = 0  # a string's content
    b: int = 0
    text: str = ""  # of names and operators


def lex(text: str) -> list[Token]:
    out: list[Token] = []
    at, n = 0, len(text)
    alone: dict[str, int] = {}  # up to where no quote of a kind has a partner: one that is alone is so for all after it on its line
    while at < n:
        if text[at] == "'" and (m := _LIFETIME.match(text, at)):
            out.append(Token(OP, at, m.end(), text="'"))
            at = m.end()
            continue
        quote = _QUOTE.match(text, at)
        q, three = (quote[1], text.startswith(quote[1] * 3, quote.start(1))) if quote else ("", False)
        tried = quote is not None and (alone.get(q, 0) <= at or three and alone.get(q * 3, 0) <= at)
        m = (_TOKENS if tried or not quote else _OTHERS).match(text, at)
        kind = m.lastgroup if m.lastgroup in _KINDS or m.lastgroup == "blank" else "string"
        end = m.end()
        if tried:
            group = next((g for g in ("s1", "s2", "s3", "s4", "s5") if m[g] is not None), None) if kind == "string" else None
            if three and group not in ("s1", "s2"):
                alone[q * 3] = n
            if group is None:
                line = text.find("\n", at)
                alone[q] = n if q == "`" or line < 0 else line
        if kind == "string":
            out.append(Token(STRING, at, end, m.start(group), m.end(group), text[at : m.start(group)]))
        elif kind != "blank":
            out.append(Token(_KINDS[kind], at, end, text=text[at:end] if kind in ("name", "op", "comment") else ""))
        at = end
    return out


@dataclass(eq=False)
class Value:
    """What a name is bound to: literals (start, end) and values bound before, which are shared and not copied. A
    sum that doubles from line to line stays small so. The parts of a choice are values, one of which is meant."""

    parts: list[tuple[int, int] | Value] = field(default_factory=list)
    choice: bool = False


@dataclass(slots=True)
class Pair:
    names: list[str]
    value: Value


class _Scopes:
    """Bindings by function. A scope ends with its closing brace, or with a line that is indented no more than its first line."""

    def __init__(self) -> None:
        self.stack: list[tuple[dict, int | None, int]] = [({}, None, 0)]

    def get(self, name: str) -> tuple[Value, bool] | None:
        return next((s[name] for s, *_ in reversed(self.stack) if name in s), None)

    def bind(self, name: str, value: Value, as_type: bool) -> None:
        self.stack[-1][0][name] = (value, as_type)

    def open(self, indent: int | None, depth: int) -> None:
        self.stack.append(({}, indent, depth))

    def line(self, indent: int) -> None:
        while self.stack[-1][1] is not None and indent <= self.stack[-1][1]:
            self.stack.pop()

    def brace(self, depth: int) -> None:
        while len(self.stack) > 1 and self.stack[-1][2] > depth:
            self.stack.pop()


class Reader:
    def __init__(self, text: str, offset: int = 0, scopes: _Scopes | None = None):
        self.text, self.offset = text, offset
        self.tokens = lex(text)
        self.starts = [t.start for t in self.tokens]
        self.opens: dict[int, int] = {}  # of each closing square bracket its partner
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == OP and t.text == "[":
                stack.append(i)
            elif t.kind == OP and t.text == "]" and stack:
                self.opens[i] = stack.pop()
        self.closes = {a: b for b, a in self.opens.items()}  # of each opening bracket, round ones too, its partner
        self.inside: list[bool] = []  # whether a token stands in round brackets
        stack = []
        for i, t in enumerate(self.tokens):
            self.inside.append(bool(stack))
            if t.kind == OP and t.text == "(":
                stack.append(i)
            elif t.kind == OP and t.text == ")" and stack:
                self.closes[stack.pop()] = i
        self.asked: set[int] = set()  # colons of conditional expressions
        self.scopes = scopes or _Scopes()
        self.used: set[int] = set()  # strings that are values or keys
        self.inner: list[tuple[int, int]] = []  # strings to be read by themselves

    # places

    def _is(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == OP and self.tokens[i].text in texts

    def _kind(self, i: int) -> int | None:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else None

    def _at(self, place: int) -> int:
        """The first token that begins at or after a place."""
        return bisect_left(self.starts, place)

    def _indent(self, i: int) -> int:
        """Blanks before the token's line."""
        begin = self.text.rfind("\n", 0, self.tokens[i].start) + 1
        end = begin
        while end < len(self.text) and self.text[end] in " \t":
            end += 1
        return end - begin

    # targets

    def _target(self, i: int) -> tuple[list[str], int]:
        """Names that the tokens up to i, before an operator, assign to, and the first of these tokens."""
        if self._is(i, "?", "!"):
            i -= 1
        while self._is(i, "]"):
            j = self.opens.get(i)
            if j is None:
                return [], i
            if j + 2 == i and self._kind(j + 1) == STRING:
                self.used.add(j + 1)
                t = self.tokens[j + 1]
                return [self.text[t.a : t.b]], j
            i = j - 1
        if self._kind(i) == STRING:
            self.used.add(i)
            t = self.tokens[i]
            return [self.text[t.a : t.b]], i
        if self._kind(i) != NAME:
            return [], i
        names = [self.tokens[i].text]
        if names[0].lower() in TYPES and self._kind(i - 1) == NAME:
            names.append(self.tokens[i - 1].text)  # var name type = value
            i -= 1
        return names, i

    def _typed(self, i: int) -> tuple[int, list[str]] | None:
        """If a type and an assignment follow the colon i: where the assignment is, and the last name of the type."""
        depth, j, last = 0, i + 1, []
        while j < len(self.tokens):
            t = self.tokens[j]
            if t.kind == NAME:
                last = [t.text]
            elif t.kind != OP:
                return None
            elif t.text == "=" and not depth:
                blank = t.start > 0 and self.text[t.start - 1] in " \t"
                quoted = self._kind(j + 1) == STRING
                return (j, last) if last and (blank or quoted) else None
            elif t.text in "<[(":
                depth += 1
            elif t.text in ">])":
                depth -= 1
                if depth < 0:
                    return None
            elif t.text == "'":
                pass
            elif t.text not in TYPE_OPS or (t.text == "," and not depth):
                return None
            j += 1
        return None

    # values

    def _ahead(self, i: int, kind: int, text: str) -> int | None:
        """The first token of a kind and text after token i on its line."""
        for j in range(i + 1, min(i + 40, len(self.tokens))):
            if self.tokens[j].kind == LINE:
                return None
            if self.tokens[j].kind == kind and self.tokens[j].text == text:
                return j
        return None

    def _joins(self, i: int) -> bool:
        """Whether operator i stands between parts of a sum: a full stop or `&` has blanks on both sides or on none."""
        t = self.tokens[i]
        return t.text == "+" or t.text in JOIN and self.text[t.start - 1].isspace() == self.text[t.end : t.end + 1].isspace()

    def _either(self, i: int) -> int | None:
        """If token i stands between choices: the token after."""
        if self._kind(i) == NAME and self.tokens[i].text == "or" or self._is(i, "||"):
            return i + 1
        return i + 2 if self._is(i, "?") and self._is(i + 1, "?") else None

    def _asks(self, i: int) -> bool:
        return self._is(i, "?") and not self._is(i + 1, "?") and self._kind(i + 1) in (STRING, NAME, NUMBER, OP) and self._ahead(i, OP, ":") is not None

    def _value(self, i: int, colon: bool) -> tuple[Value, int]:
        """The sum or the choice of sums that begins at token i, and the token after it."""
        first, value, choices, need, depth, asked, listed, back = i, Value(), [], True, 0, 0, False, None

        def turn() -> None:
            nonlocal value, need
            choices.append(value)
            value, need = Value(), True

        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == LINE:
                if not depth and not (need and (value.parts or choices)):
                    break
                i += 1
            elif t.kind == COMMENT and depth:
                while i < len(self.tokens) and self._kind(i) != LINE:
                    i += 1
            elif t.kind == STRING and (need or depth or self._kind(i - 1) == STRING):
                self.used.add(i)
                self._string(t, value)
                need, i = False, i + 1
            elif t.kind == OP and (t.text == "(" and need or t.text == "[" and need and not value.parts and i in self.closes):
                listed |= t.text == "["
                depth, i = depth + 1, i + 1
            elif t.kind == OP and t.text in ")]" and depth:
                depth, i, need = depth - 1, i + 1, False
            elif not need and t.kind == OP and t.text == "," and depth:
                listed = True
                turn()
                i += 1
            elif not need and (after := self._either(i)):
                turn()
                i = after
            elif not need and self._asks(i):  # what stood before is the condition
                value, need, asked, i = Value(), True, asked + 1, i + 1
            elif not need and asked and self._is(i, ":"):
                self.asked.add(i)
                turn()
                asked, i = asked - 1, i + 1
            elif not need and t.kind == OP and t.text in COMPARE and (mark := self._ahead(i, OP, "?")) and self._asks(mark):
                i = mark
            elif not need and t.kind == NAME and t.text == "if" and (other := self._ahead(i, NAME, "else")):
                turn()
                i = other + 1
            elif not need and self._is(i, "%") and self._kind(i - 1) == STRING:
                if value.parts and not isinstance(value.parts[-1], Value) and _PLACES.fullmatch(self.text, value.parts[-1][0] - self.offset, value.parts[-1][1] - self.offset):
                    value.parts.pop()
                need, i = True, i + 1
            elif not need and t.kind == OP and t.text in JOIN and self._joins(i):
                need, i = True, i + 1
            elif need and t.kind in (NAME, NUMBER, OP):
                m = _BARE.match(self.text, t.start)
                if not m:
                    break
                after = self._at(m.end())
                called = self._is(after, "(") and self.tokens[after].start == m.end()
                if called or self._is(after, "[") and self.tokens[after].start == m.end():
                    end = self.closes.get(after, after)
                    more = end > after and (self._either(end + 1) or self._asks(end + 1) or self._is(end + 1, ",") and depth)
                    if called and not more:
                        value, i = Value(), after
                        break
                    if more:  # what is in the brackets is read by the walk
                        back = after if back is None else back
                        value, after = Value(), end + 1
                if not called:
                    self._bare(m, value, colon, bool(choices))
                need, i = False, after
            else:
                break
        if listed:
            self.used.difference_update(range(first, i))  # read as texts of their own, too
        if choices:
            value = Value([v for v in (*choices, value) if v.parts], True)
        return value, i if back is None else back

    def _string(self, t: Token, value: Value) -> None:
        """A string's literal. In a format string the names in braces flow too."""
        a, b = t.a, t.b
        if "{" in (content := self.text[a:b]) and (t.text[:1] in "fF$`" or "${" in content):
            at = a
            for m in re.finditer(r"\$?\{\s*([^\W\d][\w.]*)[^{}\n]*\}", content):
                if a + m.start() > at:
                    value.parts.append((self.offset + at, self.offset + a + m.start()))
                if bound := self.scopes.get(m[1]):
                    value.parts.append(bound[0])
                at = a + m.end()
            if at > a or not content.strip():
                if b > at:
                    value.parts.append((self.offset + at, self.offset + b))
                return
        value.parts.append((self.offset + a, self.offset + b))

    def _bare(self, m: re.Match, value: Value, colon: bool, chosen: bool = False) -> None:
        """A bare value: what a name is bound to, or a literal, but not as a later choice."""
        raw = m[0]
        bound = self.scopes.get(raw)
        if bound is not None:
            # `password: str` names a type that may have stood before a literal, no value
            if bound[0].parts and not (colon and bound[1]):
                value.parts.append(bound[0])
        elif not chosen and any(c.isdigit() for c in raw) or not chosen and not re.fullmatch(_NAME, raw):
            value.parts.append((self.offset + m.start(), self.offset + m.end()))

    def _below(self, i: int, indent: int, block: bool) -> Value:
        """The value of a key at a line's end: list items, or lines more indented that are no keys, up to the next line that is neither. In a
        block, all lines that are more indented, whatever they hold."""
        value = Value()
        while i < len(self.tokens):
            if self._kind(i) == LINE:
                i += 1
                continue
            own = self._indent(i)
            item = self._is(i, "-") and self._kind(i + 1) is not None
            if own < indent or own == indent and not item:
                break
            begin = i + 1 if item else i
            end = begin
            while end < len(self.tokens) and self._kind(end) != LINE:
                end += 1
            t = self.tokens[begin] if begin < end else None
            if t is None:
                break
            if block and not item:
                value.parts.append((self.offset + t.start, self.offset + self.tokens[end - 1].end))
            elif t.kind == STRING and end == begin + 1:
                self.used.add(begin)
                self._string(t, value)
            elif (m := _BARE.match(self.text, t.start)) and self._at(m.end()) == end:
                self._bare(m, value, True)
            elif not item:
                break
            i = end
        return value

    # the walk

    def pairs(self) -> Iterator[Pair]:
        yield from self._markup()
        i, depth, first, comment = 0, 0, True, None
        statement = 0  # its first token
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == LINE:
                first, statement = True, i + 1
                if comment == "line":
                    comment = None
                    self.scopes.stack.pop()
                i += 1
                continue
            if first and comment is None:
                self.scopes.line(self._indent(i))
                if t.kind == NAME and t.text in ("def", "class"):
                    end = i
                    while end < len(self.tokens) and self._kind(end) != LINE:
                        end += 1
                    if self._is(end - 1, ":"):
                        self.scopes.open(self._indent(i), depth)
            first = False
            if t.kind == COMMENT:
                closing = t.text in ("*/", "-->")
                if comment is None and not closing:
                    comment = "block" if t.text in ("/*", "<!--") else "line"
                    self.scopes.open(None, depth)
                elif comment == "block" and closing:
                    comment = None
                    self.scopes.stack.pop()
                i += 1
                continue
            if t.kind != OP:
                i += 1
                continue
            after = None
            if t.text == "{":
                depth += 1
                words = {x.text for x in self.tokens[statement:i][:16] if x.kind == NAME}
                if words & FUNCTIONS or self._is(i - 1, "=>") or self._is(i - 1, ")") and not words & BRANCHES:
                    self.scopes.open(None, depth)
                statement = i + 1
            elif t.text == "}":
                depth -= 1
                self.scopes.brace(depth)
                statement = i + 1
            elif t.text in (";", ","):
                statement = i + 1 if t.text == ";" else statement
            elif t.text in ASSIGN:
                after = yield from self._assign(i, i)
            elif t.text == ":" and i not in self.asked and self._kind(i - 1) in (NAME, STRING, OP):
                typed = self._typed(i)
                if typed:
                    after = yield from self._assign(i, typed[0], typed[1])
                else:
                    after = yield from self._assign(i, i, colon=True)
            elif t.text in ("--", "#define") and self._kind(i + 1) == NAME and self._kind(i + 2) in (STRING, NAME, NUMBER, OP):
                gap = self.text[self.tokens[i + 1].end : self.tokens[i + 2].start]
                if gap.strip(" \t") == "" and gap and not self._is(i + 2, "=", ":", "-", "--"):
                    value, after = self._value(i + 2, False)
                    yield from self._bound([self.tokens[i + 1].text], value, [])
            i = max(i + 1, after or 0)
        if comment is not None:
            self.scopes.stack.pop()
        for k, t in enumerate(self.tokens):
            if t.kind == STRING and k not in self.used and t.b > t.a:
                self.inner.append((t.a, t.b))
        for a, b in self.inner:
            if "=" in (part := self.text[a:b]) or ":" in part or "--" in part:
                self.scopes.open(None, depth)
                yield from Reader(part, self.offset + a, self.scopes).pairs()
                self.scopes.stack.pop()

    def _assign(self, at: int, op: int, type_names: list[str] | None = None, colon: bool = False) -> Iterator[Pair]:
        """Pairs of the assignment whose target ends before token `at` and whose operator is `op`; returns the token to go on from."""
        names, begin = self._target(at - 1)
        if not names:
            return op + 1
        nxt = op + 1
        if not colon and at == op and self._is(op, "=", ":=") and (several := self._several(begin)):
            after = op
            for name in (*several, names):
                value, after = self._value(after + 1, False) if after == op or self._is(after, ",") else (Value(), after)
                yield from self._bound(name if isinstance(name, list) else [name], value, [])
            return after
        while not colon and self._kind(nxt) == NAME and self._is(nxt + 1, "=", ":=") and self.text[self.tokens[nxt].end] in " \t":  # a = b = value
            names.append(self.tokens[nxt].text)
            nxt += 2
        if self._kind(nxt) in (LINE, COMMENT, None) or self._is(nxt, "|", ">") and self._kind(nxt + 1) == LINE:
            block = self._is(nxt, "|", ">")
            value = self._below(nxt + block, self._indent(begin), block) if colon else Value()
            after = nxt
        else:
            value, after = self._value(nxt, colon)
            if colon and self._kind(nxt) == NAME and self._is(nxt + 1, "=", ":", ":=", "=>"):
                after = nxt + 1  # INFO: name=value
            elif colon and "/" in self.text[self.tokens[nxt].start : self.tokens[nxt].start + 2]:
                after = nxt  # a scheme, whose path may hold pairs
        yield from self._bound(names, value, type_names or [])
        return after

    def _several(self, begin: int) -> list[str]:
        """The names before that at token `begin`, if a statement begins with names between commas."""
        out: list[str] = []
        while not self.inside[begin] and self._is(begin - 1, ",") and self._kind(begin - 2) == NAME:
            begin -= 2
            out.append(self.tokens[begin].text)
        if out and (self._kind(begin - 1) in (LINE, None) or self._is(begin - 1, ";", "{")):
            return out[::-1]
        return []

    def _bound(self, names: list[str], value: Value, type_names: list[str]) -> Iterator[Pair]:
        everything = [*names, *type_names]
        yield Pair(everything, value)
        for name in names:
            self.scopes.bind(name, value, False)
        for name in type_names:
            if name.lower() not in TYPES:
                self.scopes.bind(name, value, True)

    def _markup(self) -> Iterator[Pair]:
        if "</" in self.text:
            for m in _ELEMENT.finditer(self.text):
                raw = m[2].strip()
                if raw:
                    a = m.start(2) + m[2].index(raw[0])
                    yield Pair([m[1]], Value([(self.offset + a, self.offset + a + len(raw))]))
        if "<" in self.text and ("value" in self.text or "content" in self.text):
            for tag in _TAG.finditer(self.text):
                found = {m[1].lower(): m for m in _ATTRIBUTE.finditer(tag[0])}
                key, held = next((found[k] for k in ("key", "name", "id") if k in found), None), next((found[k] for k in ("value", "content") if k in found), None)
                if key and held:
                    group = 2 if held[2] is not None else 3
                    yield Pair([key[2] or key[3] or ""], Value([(self.offset + tag.start() + held.start(group), self.offset + tag.start() + held.end(group))]))


def read(text: str) -> Iterator[Pair]:
    """Name-literal pairs of a text, in the order in which they are read."""
    return Reader(text).pairs()
