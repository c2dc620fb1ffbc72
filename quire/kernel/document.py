"""A PDF file as an object graph: xref chain, object streams, edits and saving."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, NamedTuple

from quire.kernel.cos import END, MAX_NUMBER, MISSING, Keyword, Lexer, Name, PdfError, Ref, Stream, as_int, dict_of, parse_indirect, parse_value, serialize_pdf
from quire.kernel.filters import decode_stream

_TAIL = 1024
_SECTION_KEYS = (b"Prev", b"W", b"Index", b"Filter", b"DecodeParms", b"Length", b"Type", b"XRefStm")
_VERSION = re.compile(rb"%PDF-(\d+\.\d+)")


class Entry(NamedTuple):
    """An xref entry: `inuse` (offset, gen), `free` (next, gen) or `compressed` (stream, index)."""

    kind: str
    a: int
    b: int


def find_startxref(data: bytes) -> int:
    tail = data[-_TAIL:]
    at = tail.rfind(b"startxref")
    if at < 0:
        raise PdfError("parse", "no startxref")
    got = Lexer(tail, at + 9).token()
    if type(got) is not int or got < 0:
        raise PdfError("parse", "startxref without offset")
    return got


def read_field(data: bytes, at: int, width: int, default: int) -> int:
    return int.from_bytes(data[at : at + width], "big") if width else default


def xref_table(data: bytes, offset: int) -> tuple[dict[int, Entry], dict[bytes, Any]]:
    lex = Lexer(data, offset)
    if lex.token() != b"xref":
        raise PdfError("xref", "no xref table", offset)
    out: dict[int, Entry] = {}
    while True:
        start = lex.token()
        if isinstance(start, Keyword) and start == b"trailer":
            break
        if type(start) is not int:
            raise PdfError("xref", "xref section without trailer", lex.pos)
        count = lex.token()
        if type(count) is not int:
            raise PdfError("xref", "xref section without count", lex.pos)
        for num in range(max(0, start), min(start + count, MAX_NUMBER)):
            a, b, mark = lex.token(), lex.token(), lex.token()
            if mark is END:
                break
            if type(a) is int and type(b) is int and mark in (b"n", b"f"):
                out.setdefault(num, Entry("inuse" if mark == b"n" else "free", a, b))
    trailer = parse_value(lex)
    if not isinstance(trailer, dict):
        raise PdfError("xref", "trailer is no dictionary", lex.pos)
    return out, trailer


def xref_stream(head: dict[bytes, Any], data: bytes) -> dict[int, Entry]:
    widths = [as_int(w) or 0 for w in head.get(b"W") or [] if not isinstance(w, (bytes, list, dict))]
    if len(widths) < 3:
        raise PdfError("xref", "xref stream without /W")
    w0, w1, w2 = widths[:3]
    if min(widths[:3]) < 0 or max(widths[:3]) > 8:
        raise PdfError("xref", "xref stream with odd /W")
    size = w0 + w1 + w2
    index = head.get(b"Index")
    ranges = [as_int(x) or 0 for x in index] if isinstance(index, list) else [0, as_int(head.get(b"Size")) or 0]
    out: dict[int, Entry] = {}
    at = 0
    kinds = {0: "free", 1: "inuse", 2: "compressed"}
    for first, count in zip(ranges[::2], ranges[1::2]):
        for num in range(max(0, first), min(first + count, MAX_NUMBER)):
            if not size or at + size > len(data):
                return out
            kind = read_field(data, at, w0, 1)
            entry = Entry(kinds.get(kind, ""), read_field(data, at + w0, w1, 0), read_field(data, at + w0 + w1, w2, 0))
            if entry.kind and max(entry.a, entry.b) < 1 << 63:
                out.setdefault(num, entry)
            at += size
    return out


def xref_sections(data: bytes) -> Iterator[tuple[dict[int, Entry], dict[bytes, Any]]]:
    """Sections of the /Prev chain, newest first; each offset is visited once."""
    offset: int | None = find_startxref(data)
    seen: set[int] = set()
    while offset is not None and offset not in seen:
        seen.add(offset)
        if offset >= len(data) or offset < 0:
            raise PdfError("xref", "xref offset beyond the file", offset)
        lex = Lexer(data, offset)
        at = lex.skip()
        if data[at : at + 4] == b"xref":
            entries, trailer = xref_table(data, at)
        else:
            _, value = parse_indirect(data, offset)
            if not isinstance(value, Stream):
                return
            trailer = value.dict
            try:
                entries = xref_stream(trailer, decode_stream(trailer, value.data))
            except PdfError:
                entries = {}  # an unreadable section still names its predecessor
        yield entries, trailer
        previous = trailer.get(b"Prev")
        offset = previous if type(previous) is int else None


class Document:
    """Objects by number, edits over the file's own; generations are ignored."""

    def __init__(self, data: bytes | None = None):
        self.data = data or b""
        self.entries: dict[int, Entry] = {}
        self.sections: list[dict[int, Entry]] = []
        self.trailer: dict[bytes, Any] = {b"Size": 1}
        self.edits: dict[int, Any] = {}
        self.errors: dict[int, str] = {}
        self._cache: dict[int, Any] = {}
        self._members: dict[int, dict[int, Any]] = {}
        if data is None:
            self.next_num = 1
            self.fonts = {}
            return
        if not data.startswith(b"%PDF-"):
            raise PdfError("parse", "no PDF header", 0)
        trailer: dict[bytes, Any] = {}
        for entries, own in xref_sections(data):
            self.sections.append(entries)
            trailer = trailer or own
            for num, entry in entries.items():
                self.entries.setdefault(num, entry)
        self.trailer = dict(trailer)
        size = as_int(trailer.get(b"Size"))
        self.next_num = 1 if size is None else size
        self.fonts: dict[int, Any] = {}

    @property
    def version(self) -> str | None:
        m = _VERSION.match(self.data)
        return m[1].decode() if m else None

    @property
    def is_modified(self) -> bool:
        return bool(self.edits) or not self.data

    def get(self, num: int) -> Any:
        """The object of a number; None if free, absent or unreadable."""
        if num in self.edits:
            return self.edits[num]
        if num not in self._cache:
            value = None
            entry = self.entries.get(num)
            try:
                if entry is None or entry.kind == "free":
                    pass
                elif entry.kind == "inuse":
                    value = parse_indirect(self.data, entry.a)[1]
                else:
                    value = self.members(entry.a).get(num)
            except PdfError as e:
                self.errors[num] = str(e)
            except RecursionError:
                self.errors[num] = "nested too deeply"
            self._cache[num] = value
        return self._cache[num]

    def members(self, num: int) -> dict[int, Any]:
        """The objects of an object stream, decoded once."""
        if num not in self._members:
            out: dict[int, Any] = {}
            self._members[num] = out
            entry = self.entries.get(num)
            stream = parse_indirect(self.data, entry.a)[1] if entry and entry.kind == "inuse" else None
            if not isinstance(stream, Stream):
                raise PdfError("object", f"object stream {num} is none")
            head = stream.dict
            body = decode_stream(head, stream.data)
            count, first = as_int(head.get(b"N")) or 0, as_int(head.get(b"First")) or 0
            lex = Lexer(body[:first])
            pairs = []
            for _ in range(count):
                pairs.append((lex.token(), lex.token()))
                if pairs[-1][1] is END:
                    break
            starts = [p for p in pairs if type(p[0]) is int and type(p[1]) is int]
            for member, at in starts:
                if first + at < 0 or first + at > len(body):
                    continue
                try:
                    value = parse_value(Lexer(body, first + at))
                    if value is not MISSING:
                        out[member] = value
                except PdfError as e:
                    self.errors[member] = str(e)
        return self._members[num]

    def resolve(self, value: Any) -> Any:
        """One hop along a reference."""
        return self.get(value.num) if isinstance(value, Ref) else value

    def decoded(self, stream: Stream) -> bytes:
        return decode_stream(stream.dict, stream.data)

    def create(self, value: Any) -> Ref:
        ref = Ref(self.next_num, 0)
        self.next_num += 1
        self.edits[ref.num] = value
        return ref

    def update(self, num: int, value: Any) -> None:
        self.edits[num] = value

    def numbers(self) -> list[int]:
        return sorted({n for n, e in self.entries.items() if e.kind != "free"} | set(self.edits))

    def save(self) -> bytes:
        """A full rewrite: object streams expanded, edits merged, one classic xref section."""
        objects = {}
        for num in self.numbers():
            value = self.get(num)
            if num in self.errors and num not in self.edits:
                continue
            if isinstance(value, Stream) and value.dict.get(b"Type") in (b"ObjStm", b"XRef"):
                continue
            objects[num] = value
        trailer = {k: v for k, v in self.trailer.items() if k not in _SECTION_KEYS}
        return serialize_pdf(objects, trailer)

    # Whole-document facade.

    @classmethod
    def empty(cls) -> Document:
        """A document with a catalog and no pages."""
        doc = cls()
        pages = doc.create({b"Type": Name(b"Pages"), b"Kids": [], b"Count": 0})
        doc.trailer[b"Root"] = doc.create({b"Type": Name(b"Catalog"), b"Pages": pages})
        return doc

    def catalog(self) -> dict[bytes, Any]:
        root = self.trailer.get(b"Root")
        if not isinstance(root, Ref):
            raise PdfError("object", "no /Root reference")
        return dict_of(self.get(root.num))

    def pages_ref(self) -> Ref:
        ref = self.catalog().get(b"Pages")
        if not isinstance(ref, Ref):
            raise PdfError("object", "no /Pages reference")
        return ref

    def create_page(self, box: tuple[float, float, float, float], **attributes: Any) -> int:
        """A new last page below the root node; the number of its object."""
        parent = self.pages_ref()
        page = self.create({b"Type": Name(b"Page"), b"Parent": parent, b"MediaBox": list(map(float, box))} | {k.encode(): v for k, v in attributes.items()})
        node = dict(dict_of(self.get(parent.num)))
        kids = [*(node.get(b"Kids") or []), page]
        self.update(parent.num, node | {b"Kids": kids, b"Count": len(kids)})
        return page.num
