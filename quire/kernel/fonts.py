"""Fonts: encoding with differences, ToUnicode maps, widths, and decoding of shown strings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from quire.kernel.cos import Name, PdfError, Ref, Stream, as_float, as_int, as_name, dict_of
from quire.kernel.document import Document
from quire.kernel.encodings import REPLACEMENT, encoding, glyph_text

#: Codes that all ranges of a map, or of widths, may span together.
MAX_CODES = 1 << 20

FONT_TYPES = {"Type1", "TrueType", "Type0", "Type3", "CIDFontType0", "CIDFontType2", "MMType1"}
_SUBSET = re.compile(r"[A-Z]{6}\+.")


def is_subset(base_font: str) -> bool:
    return _SUBSET.match(base_font) is not None


def differences(table: list[str | None], items: list) -> list[str | None]:
    """A number sets the code, each name after it fills one; codes from 256 on are ignored."""
    out, code = list(table), 0
    for item in items:
        if isinstance(item, int) and not isinstance(item, bool):
            code = item
        elif isinstance(item, Name):
            if 0 <= code < 256:
                out[code] = glyph_text(item.decode("utf-8", "replace"))
            code += 1
    return out


_FIELD = re.compile(r"<([^<>]*)>?")


def _hex(text: str) -> int | None:
    try:
        return int(text.strip(), 16)
    except ValueError:
        return None


def _char(code: int) -> str | None:
    return chr(code) if 0 <= code < 0xD800 or 0xE000 <= code <= 0x10FFFF else None


def _hex_text(digits: str) -> str | None:
    digits = digits.strip()
    if len(digits) <= 4:
        code = _hex(digits)
        return None if code is None else _char(code)
    codes = (_hex(digits[i : i + 4]) for i in range(0, len(digits) - 3, 4))
    return "".join(c for c in (_char(x) for x in codes if x is not None) if c) or None


@dataclass
class CMap:
    """Single codes first, then ranges in file order."""

    chars: dict[int, str] = field(default_factory=dict)
    ranges: list[tuple[int, int, int]] = field(default_factory=list)
    _found: dict[int, str | None] = field(default_factory=dict)
    _unfolded: bool = False

    @classmethod
    def parse(cls, data: bytes) -> CMap:
        """One mapping a line; `begin...` must end its line."""
        out, mode = cls(), ""
        for line in data.decode("utf-8", "replace").split("\n"):
            line = line.strip()
            if not mode:
                mode = "char" if line.endswith("beginbfchar") else "range" if line.endswith("beginbfrange") else ""
            elif f"endbf{mode}" in line:
                mode = ""
            else:
                out._line(mode, [p for p in line.split("<") if p])
        return out

    def _line(self, mode: str, parts: list[str]) -> None:
        cells = [p.split(">", 1)[0] for p in parts]
        if mode == "char" and len(cells) >= 2:
            code, text = _hex(cells[0]), _hex_text(cells[1])
            if code is not None and text is not None:
                self.chars[code] = text
        elif mode == "range" and len(cells) >= 3:
            numbers = [_hex(c) for c in cells[:3]]
            if None not in numbers:
                self.ranges.append(tuple(numbers))

    def codes(self) -> list[int]:
        """All mapped codes, in order; of a range at most 65,536."""
        spans = [(a, min(b, a + 65535)) for a, b, _ in self.ranges if a <= b]
        if sum(b - a + 1 for a, b in spans) > MAX_CODES:
            raise PdfError("font", "a map of too many codes")
        return sorted({c for a, b in spans for c in range(a, b + 1)} | set(self.chars))

    def _unfold(self) -> None:
        """All ranges code by code, where there are so many that a look at each would take long."""
        spans = [(a, min(b, 0xFFFF), to) for a, b, to in self.ranges if a <= min(b, 0xFFFF)]
        if sum(b - a + 1 for a, b, _ in spans) > MAX_CODES:
            raise PdfError("font", "a map of too many codes")
        self._found = dict.fromkeys(range(0x10000))
        for a, b, to in spans:
            for code in range(a, b + 1):
                if self._found[code] is None:
                    self._found[code] = _char(to + code - a)
        self._found.update(self.chars)
        self._unfolded = True

    def lookup(self, code: int) -> str | None:
        if len(self.ranges) > 256 and not self._unfolded:
            self._unfold()
        if code not in self._found:
            hits = (_char(to + code - a) for a, b, to in self.ranges if a <= code <= b)
            self._found[code] = self.chars[code] if code in self.chars else next((c for c in hits if c is not None), None)
        return self._found[code]

    def decode(self, data: bytes) -> str:
        """Two-byte codes before one-byte ones; unmapped printable ASCII stands, other bytes vanish."""
        out, i, n = [], 0, len(data)
        known = self._found
        while i < n:
            two = None
            if i + 1 < n:
                code = data[i] << 8 | data[i + 1]
                two = known[code] if code in known else self.lookup(code)
            if two is not None:
                out.append(two)
                i += 2
                continue
            one = self.lookup(data[i])
            if one is not None:
                out.append(one)
            elif 0x20 <= data[i] <= 0x7E:
                out.append(chr(data[i]))
            i += 1
        return "".join(out)

    @property
    def is_empty(self) -> bool:
        return not self.chars and not self.ranges


@dataclass
class Font:
    type: str
    base: str
    table: list[str | None]
    cmap: CMap | None
    widths: dict[int, float]
    default_width: float
    first_char: int

    @property
    def is_cid(self) -> bool:
        return self.type == "Type0"

    def width(self, code: int) -> float:
        return self.widths.get(code, self.default_width)

    def decode(self, data: bytes) -> str:
        if self.cmap is not None:
            return self.cmap.decode(data)
        table = self.table
        return "".join(REPLACEMENT if table[b] is None else table[b] for b in data)


def _encoding_of(head: dict[bytes, Any], doc: Document) -> list[str | None]:
    base, subtype = as_name(head.get(b"BaseFont")) or "", as_name(head.get(b"Subtype")) or ""
    zapf = base == "ZapfDingbats" or base.endswith("+ZapfDingbats")
    greek = base == "Symbol" or base.endswith("+Symbol")
    own = "ZapfDingbatsEncoding" if zapf else "SymbolEncoding" if greek else "WinAnsiEncoding"
    if b"Encoding" not in head:
        return encoding("MacRomanEncoding" if own == "WinAnsiEncoding" and subtype == "TrueType" and is_subset(base) else own)
    spec = doc.resolve(head[b"Encoding"])
    if isinstance(spec, Name):
        return encoding(as_name(spec))
    if isinstance(spec, dict):
        table = encoding(as_name(spec.get(b"BaseEncoding")) or own)
        diffs = spec.get(b"Differences")
        return differences(table, diffs) if isinstance(diffs, list) else table
    return encoding("WinAnsiEncoding")


def _cid_widths(head: dict[bytes, Any], doc: Document) -> tuple[dict[int, float], float]:
    kin = head.get(b"DescendantFonts")
    cid = dict_of(doc.resolve(kin[0])) if isinstance(kin, list) and kin else {}
    default = as_float(cid.get(b"DW"))
    default = 1000.0 if default is None else default
    items = cid.get(b"W")
    out: dict[int, float] = {}
    items = items if isinstance(items, list) else []
    i = spanned = 0
    while i < len(items):
        first, then = as_int(items[i]), items[i + 1] if i + 1 < len(items) else None
        if first is not None and isinstance(then, list) and not isinstance(then, Ref):
            out.update({first + j: float(w) for j, w in enumerate(then) if as_float(w) is not None})
            i += 2
        elif first is not None and as_int(then) is not None and i + 2 < len(items):
            w = as_float(items[i + 2])
            codes = range(first, min(as_int(then), first + 65535) + 1)
            spanned += len(codes)
            if spanned > MAX_CODES:
                raise PdfError("font", "widths of too many codes")
            out.update(dict.fromkeys(codes, default if w is None else w))
            i += 3
        else:
            i += 1
    return out, default


def load_font(value: Any, doc: Document) -> Font:
    head = dict_of(value)
    kind = as_name(head.get(b"Subtype")) or ""
    cmap = None
    source = doc.resolve(head.get(b"ToUnicode"))
    if isinstance(source, Stream):
        try:
            cmap = CMap.parse(doc.decoded(source))
        except PdfError:
            cmap = None
    if kind == "Type0":
        widths, default = _cid_widths(head, doc)
        first = 0
    else:
        first = as_int(head.get(b"FirstChar")) or 0
        missing = as_float(head.get(b"MissingWidth"))
        default = 1000.0 if missing is None else missing
        items = head.get(b"Widths")
        widths = {first + i: float(w) for i, w in enumerate(items if isinstance(items, list) else []) if as_float(w) is not None}
    return Font(kind if kind in FONT_TYPES else "Unknown", as_name(head.get(b"BaseFont")) or "", _encoding_of(head, doc), cmap, widths, default, first)
