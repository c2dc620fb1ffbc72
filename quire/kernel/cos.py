"""COS values, their lexer, parser and writer: the sequential byte work that SQL cannot express.

Values are plain Python: None, bool, int, float, bytes (a string), Name, list, dict with bytes
keys in file order, Ref and Stream.  Lexing is driven by compiled patterns over the raw bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any, NamedTuple


class PdfError(ValueError):
    """A document that cannot be read on; `kind` names the sort of fault, `offset` the byte."""

    def __init__(self, kind: str, message: str, offset: int | None = None):
        super().__init__(message)
        self.kind, self.offset = kind, offset


#: What a damaged or hostile file may raise beside PdfError: it costs the file, never the task.
FAULTS = (PdfError, RecursionError, ArithmeticError, AttributeError, LookupError, TypeError, ValueError)


def fault(e: Exception) -> PdfError:
    """Any of FAULTS as a PdfError."""
    return e if isinstance(e, PdfError) else PdfError("internal", f"{type(e).__name__}: {e}"[:200])


class Name(bytes):
    """A name without its slash."""

    def __repr__(self) -> str:
        return "/" + self.decode("latin-1")


class Ref(NamedTuple):
    num: int
    gen: int


@dataclass(eq=False)
class Stream:
    """A dictionary with data; two streams are never equal."""

    dict: dict[bytes, Any]
    data: bytes


class Keyword(bytes):
    """A bare word that is no value."""


class _Mark:
    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return self.name


ARRAY_OPEN, ARRAY_CLOSE, DICT_OPEN, DICT_CLOSE, END = map(_Mark, ("[", "]", "<<", ">>", "end"))
#: No value was found where one could stand.
MISSING = _Mark("missing")

_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NAME = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)")
_NUMBER = re.compile(rb"[+-]?(?:\d+(?:\.\d*)?|\.\d*)?")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_PLAIN_STRING = re.compile(rb"\(([^()\\]*)\)")
_STRING_PART = re.compile(rb"[^()\\]+|\\(?:[0-7]{1,3}|\r\n|.)|[()]", re.S)
_HEX = re.compile(rb"<([^>]*)>?")
_NAME_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")
_REFERENCE = re.compile(rb"(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,10})[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_NOT_HEX = re.compile(rb"[^0-9A-Fa-f]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_NUMERIC = frozenset(b"0123456789+-.")
_INT64 = 1 << 63
#: Arrays and dictionaries may nest this deep; object numbers stay below.
MAX_DEPTH = 200
MAX_NUMBER = 1 << 32


class Lexer:
    """Tokens of a byte string from a position on."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos, self.depth = data, pos, 0

    def skip(self) -> int:
        self.pos = _SKIP.match(self.data, self.pos).end()
        return self.pos

    def token(self) -> Any:
        """The next value, Keyword or mark; END at the end of the data."""
        data = self.data
        at = self.skip()
        if at >= len(data):
            return END
        c = data[at]
        if c in _NUMERIC:
            return self._number(at)
        if c == 0x2F:
            m = _NAME.match(data, at)
            self.pos = m.end()
            raw = m[1]
            return Name(_NAME_ESCAPE.sub(lambda e: bytes([int(e[1], 16)]), raw) if b"#" in raw else raw)
        if c == 0x28:
            return self._string(at)
        if c == 0x3C:
            if data[at + 1 : at + 2] == b"<":
                self.pos = at + 2
                return DICT_OPEN
            m = _HEX.match(data, at)
            self.pos = m.end()
            digits = _NOT_HEX.sub(b"", m[1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 0x3E:
            if data[at + 1 : at + 2] == b">":
                self.pos = at + 2
                return DICT_CLOSE
            raise PdfError("parse", "lone >", at)
        if c == 0x5B:
            self.pos = at + 1
            return ARRAY_OPEN
        if c == 0x5D:
            self.pos = at + 1
            return ARRAY_CLOSE
        m = _WORD.match(data, at)
        if not m:
            raise PdfError("parse", f"stray {chr(c)}", at)
        self.pos = m.end()
        return Keyword(m[0])

    def _number(self, at: int) -> int | float:
        m = _NUMBER.match(self.data, at)
        text = m[0]
        if not text.strip(b"+-."):
            raise PdfError("parse", "number without digits", at)
        self.pos = m.end()
        if b"." not in text and len(text) < 400:
            n = int(text)
            return n if -_INT64 <= n < _INT64 else float(n)
        return float(text)

    def _string(self, at: int) -> bytes:
        m = _PLAIN_STRING.match(self.data, at)
        if m:
            self.pos = m.end()
            return m[1]
        out, depth, pos = [], 1, at + 1
        for m in _STRING_PART.finditer(self.data, at + 1):
            part = m[0]
            pos = m.end()
            if part == b"(":
                depth += 1
            elif part == b")":
                depth -= 1
                if not depth:
                    break
            elif part[:1] == b"\\":
                rest = part[1:]
                if rest[:1].isdigit() and rest[:1] < b"8":
                    part = bytes([int(rest, 8) & 255])
                elif rest in (b"\n", b"\r", b"\r\n"):
                    continue
                else:
                    part = _ESCAPES.get(rest, rest)
            out.append(part)
        self.pos = pos
        return b"".join(out)


def parse_value(lex: Lexer) -> Any:
    """One value, or MISSING when the next token cannot begin one (that token is consumed)."""
    at = lex.skip()
    if at < len(lex.data) and 0x30 <= lex.data[at] <= 0x39:
        m = _REFERENCE.match(lex.data, at)
        if m:
            lex.pos = m.end()
            return Ref(int(m[1]), int(m[2]))
    t = lex.token()
    if t is ARRAY_OPEN or t is DICT_OPEN:
        if lex.depth >= MAX_DEPTH:
            raise PdfError("parse", "nested too deeply", at)
        lex.depth += 1
        value = _array(lex) if t is ARRAY_OPEN else _dict_or_stream(lex)
        lex.depth -= 1
        return value
    if isinstance(t, Keyword):
        return {b"true": True, b"false": False, b"null": None}.get(t, MISSING)
    return MISSING if isinstance(t, _Mark) else t


def _array(lex: Lexer) -> list:
    out: list = []
    while True:
        at = lex.skip()
        if at >= len(lex.data):
            return out
        if lex.data[at] == 0x5D:
            lex.pos = at + 1
            return out
        value = parse_value(lex)
        if value is MISSING:
            return out
        out.append(value)


def _dict_or_stream(lex: Lexer) -> dict | Stream:
    out: dict[bytes, Any] = {}
    while True:
        t = lex.token()
        if t is DICT_CLOSE or t is END:
            break
        if isinstance(t, Name):
            value = parse_value(lex)  # a missing value swallows the closing mark, as readers in the field do
            if value is not MISSING:
                out[bytes(t)] = value
    at = lex.skip()
    if lex.data[at : at + 6] != b"stream":
        return out
    start = at + 6
    if lex.data[start : start + 2] == b"\r\n":
        start += 2
    elif lex.data[start : start + 1] in (b"\n", b"\r"):
        start += 1
    else:
        return out
    length = out.get(b"Length")
    size = length if isinstance(length, int) and not isinstance(length, bool) and length > 0 else 0
    lex.pos = min(start + size, len(lex.data))
    data = lex.data[start : lex.pos]
    at = lex.skip()
    if lex.data[at : at + 9] == b"endstream":
        lex.pos = at + 9
    return Stream(out, data)


def parse_indirect(data: bytes, offset: int) -> tuple[Ref, Any]:
    """`num gen obj value endobj` at an offset; what number it states is not checked."""
    lex = Lexer(data, offset)
    num, gen, word = lex.token(), lex.token(), lex.token()
    if type(num) is not int or type(gen) is not int or word != b"obj":
        raise PdfError("parse", "no indirect object", offset)
    value = parse_value(lex)
    return Ref(num, gen), None if value is MISSING else value


# Access with defaults: a value of another type counts as absent.


def dict_of(value: Any) -> dict[bytes, Any]:
    """The dictionary of a dictionary or stream, else an empty one."""
    return value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else {}


def as_int(value: Any) -> int | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, float):
        return max(-_INT64, min(_INT64 - 1, int(value))) if value == value and abs(value) != float("inf") else None
    return value if isinstance(value, int) else None


def as_float(value: Any) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def as_name(value: Any) -> str | None:
    return value.decode("utf-8", "replace") if isinstance(value, Name) else None


def is_string(value: Any) -> bool:
    return isinstance(value, bytes) and not isinstance(value, (Name, Keyword))


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    for kind, t in (("bool", bool), ("int", int), ("real", float), ("name", Name), ("str", bytes), ("array", list), ("dict", dict), ("ref", Ref), ("stream", Stream)):
        if isinstance(value, t) and not (t is list and isinstance(value, Ref)):
            return kind
    raise TypeError(type(value).__name__)


# Writing.

_REGULAR = frozenset(range(0x21, 0x7F)) - frozenset(b"()<>[]{}/%#")
_STRING_OUT = {0x0A: b"\\n", 0x0D: b"\\r", 0x09: b"\\t", 0x08: b"\\b", 0x0C: b"\\f", 0x28: b"\\(", 0x29: b"\\)", 0x5C: b"\\\\"}
_STRING_BYTES = [_STRING_OUT.get(b, bytes([b]) if 32 <= b <= 126 else b"\\%03o" % b) for b in range(256)]
_NAME_BYTES = [bytes([b]) if b in _REGULAR else b"#%02X" % b for b in range(256)]
_SAFE_STRING = re.compile(rb"[ -'*-\[\]-~]*")


def name_bytes(name: bytes) -> bytes:
    return b"/" + b"".join(map(_NAME_BYTES.__getitem__, name))


def real_text(x: float) -> bytes:
    """Shortest decimal without exponent."""
    if x != x or abs(x) == float("inf"):
        return b"0"
    if x == int(x) and abs(x) < 1e15:
        return b"%d" % int(x)
    text = repr(x)
    if "e" in text or "E" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f")
    return text.encode()


def serialize(value: Any) -> bytes:
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return real_text(value)
    if isinstance(value, Name):
        return name_bytes(value)
    if isinstance(value, bytes):
        inner = value if _SAFE_STRING.fullmatch(value) else b"".join(map(_STRING_BYTES.__getitem__, value))
        return b"(" + inner + b")"
    if isinstance(value, list):
        return b"[" + b" ".join(map(serialize, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b"".join(name_bytes(k) + b" " + serialize(v) + b" " for k, v in value.items()) + b">>"
    head = {**value.dict, b"Length": len(value.data)}
    return serialize(head) + b"\nstream\n" + value.data + b"\nendstream"


def serialize_indirect(ref: Ref, value: Any) -> bytes:
    return b"%d %d obj\n" % ref + serialize(value) + b"\nendobj\n"


HEADER = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"


def serialize_pdf(objects: dict[int, Any], trailer: dict[bytes, Any]) -> bytes:
    """A file of one section: objects by number, one xref subsection with free gaps, the trailer."""
    out, at, offsets = [HEADER], len(HEADER), {}
    for num in sorted(objects):
        part = serialize_indirect(Ref(num, 0), objects[num])
        offsets[num] = at
        out.append(part)
        at += len(part)
    size = max(objects, default=0) + 1
    out.append(b"xref\n0 %d\n" % size)
    out += [b"%010d 00000 n \n" % offsets[n] if n in offsets else b"0000000000 65535 f \n" for n in range(size)]
    out.append(b"trailer\n" + serialize({**trailer, b"Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)
    return b"".join(out)
