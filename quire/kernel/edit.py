"""Building and changing documents: pages, text, images, fields, outlines, links, revisions."""

from __future__ import annotations

import zlib
from typing import Any

from quire.kernel.cos import HEADER, Name, PdfError, Ref, Stream, dict_of, real_text, serialize, serialize_indirect
from quire.kernel.document import Document
from quire.kernel.filters import encode_chain

LETTER = (0.0, 0.0, 612.0, 792.0)


def stream(doc: Document, data: bytes, filters: list[str] | None = None, **head: Any) -> Ref:
    """A stream object whose data is stored through `filters`."""
    names = filters or []
    extra = {b"Filter": Name(names[0].encode()) if len(names) == 1 else [Name(n.encode()) for n in names]} if names else {}
    return doc.create(Stream({k.encode(): v for k, v in head.items()} | extra, encode_chain(data, names)))


def helvetica(doc: Document) -> Ref:
    return doc.create({b"Type": Name(b"Font"), b"Subtype": Name(b"Type1"), b"BaseFont": Name(b"Helvetica"), b"Encoding": Name(b"WinAnsiEncoding")})


def cid_font(doc: Document, chars: str) -> tuple[Ref, dict[str, bytes]]:
    """A two-byte font with a code per character, and the codes; runs of characters become ranges of its map."""
    codes = {c: (256 + i).to_bytes(2, "big") for i, c in enumerate(sorted(set(chars)))}
    ordered = sorted(codes)
    singles, ranges, i = [], [], 0
    while i < len(ordered):
        j = i
        while j + 1 < len(ordered) and ord(ordered[j + 1]) == ord(ordered[j]) + 1:
            j += 1
        if j - i >= 2 and ord(ordered[j]) < 0x10000:
            ranges.append((codes[ordered[i]], codes[ordered[j]], ord(ordered[i])))
        else:
            singles += ordered[i : j + 1]
        i = j + 1
    lines = ["/CIDInit /ProcSet findresource begin", "begincmap", f"{len(singles)} beginbfchar"]
    lines += [f"<{codes[c].hex()}> <{ord(c):04X}>" if ord(c) < 0x10000 else "" for c in singles]
    lines += ["endbfchar", f"{len(ranges)} beginbfrange"]
    lines += [f"<{a.hex()}> <{b.hex()}> <{to:04X}>" for a, b, to in ranges]
    lines += ["endbfrange", "endcmap"]
    cmap = stream(doc, "\n".join(lines).encode(), ["FlateDecode"])
    kin = doc.create({b"Type": Name(b"Font"), b"Subtype": Name(b"CIDFontType2"), b"BaseFont": Name(b"Plain"), b"DW": 500, b"W": [256, [600, 700], 300, 310, 250]})
    head = {b"Type": Name(b"Font"), b"Subtype": Name(b"Type0"), b"BaseFont": Name(b"Plain"), b"Encoding": Name(b"Identity-H"), b"DescendantFonts": [kin], b"ToUnicode": cmap}
    return doc.create(head), codes


def lines_content(lines: list[bytes], font: bytes = b"F1", leading: float = 14.0) -> bytes:
    """Each line shown by the operator that first moves down one."""
    parts = [b"BT /" + font + b" 12 Tf " + real_text(leading) + b" TL 72 720 Td"]
    parts += [serialize(line) + b" '" for line in lines]
    return b"\n".join([*parts, b"ET"])


def text_page(doc: Document, text: str, filters: list[str] | None = None, box=LETTER) -> int:
    """A page that shows the lines of a text, in the Windows code page where that has its characters."""
    try:
        lines, font = [line.encode("cp1252") for line in text.split("\n")], helvetica(doc)
    except UnicodeEncodeError:
        font, codes = cid_font(doc, text.replace("\n", ""))
        lines = [b"".join(codes[c] for c in line) for line in text.split("\n")]
    content = stream(doc, lines_content(lines), filters)
    return doc.create_page(box, Resources={b"Font": {b"F1": font}}, Contents=content)


def raw_image(doc: Document, pixels: bytes, width: int, height: int, color_space: str = "DeviceRGB") -> Ref:
    """8-bit samples as a Flate image."""
    head = {b"Type": Name(b"XObject"), b"Subtype": Name(b"Image"), b"Width": width, b"Height": height, b"ColorSpace": Name(color_space.encode()), b"BitsPerComponent": 8, b"Filter": Name(b"FlateDecode")}
    return doc.create(Stream(head, zlib.compress(pixels)))


def jpeg_size(data: bytes) -> tuple[int, int]:
    """(width, height) from the frame header of a JPEG."""
    if data[:2] != b"\xff\xd8":
        raise PdfError("image", "no JPEG")
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 if mark == 0xFF or mark == 1 or 0xD0 <= mark <= 0xD9 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    raise PdfError("image", "JPEG without frame header")


def jpeg_image(doc: Document, data: bytes) -> Ref:
    """JPEG data as it is."""
    width, height = jpeg_size(data)
    head = {b"Type": Name(b"XObject"), b"Subtype": Name(b"Image"), b"Width": width, b"Height": height, b"ColorSpace": Name(b"DeviceRGB"), b"BitsPerComponent": 8, b"Filter": Name(b"DCTDecode")}
    return doc.create(Stream(head, data))


def add_image(doc: Document, page_num: int, image: Ref, rect: tuple[float, float, float, float], name: str) -> None:
    """Draw an image on a page, after what is there."""
    x1, y1, x2, y2 = rect
    cells = b" ".join(real_text(float(v)) for v in (x2 - x1, 0, 0, y2 - y1, x1, y1))
    drawn = doc.create(Stream({}, b"q " + cells + b" cm /" + name.encode() + b" Do Q"))
    page = dict(dict_of(doc.get(page_num)))
    resources = dict(dict_of(doc.resolve(page.get(b"Resources"))))
    resources[b"XObject"] = {**dict_of(doc.resolve(resources.get(b"XObject"))), name.encode(): image}
    old = page.get(b"Contents")
    listed = doc.resolve(old)
    before = listed if isinstance(listed, list) else [] if old is None else [old if isinstance(old, Ref) else doc.create(old)]
    doc.update(page_num, page | {b"Resources": resources, b"Contents": [*before, drawn]})


def update_catalog(doc: Document, **entries: Any) -> None:
    root = doc.trailer[b"Root"]
    doc.update(root.num, doc.catalog() | {k.encode(): v for k, v in entries.items()})


def outline(doc: Document, tree: list[tuple[str, list]], page: Ref | None = None) -> None:
    """Bookmarks from nested (title, children) lists."""
    root = doc.create({b"Type": Name(b"Outlines")})

    def level(items: list, parent: Ref) -> tuple[Ref, Ref, int] | None:
        refs = [doc.create({}) for _ in items]
        for i, (title, kids) in enumerate(items):
            d = {b"Title": text_string(title), b"Parent": parent}
            if i:
                d[b"Prev"] = refs[i - 1]
            if i + 1 < len(refs):
                d[b"Next"] = refs[i + 1]
            if page is not None:
                d[b"Dest"] = [page, Name(b"XYZ"), 0, 792, None]
            inner = level(kids, refs[i])
            if inner:
                d |= {b"First": inner[0], b"Last": inner[1], b"Count": inner[2]}
            doc.update(refs[i].num, d)
        return (refs[0], refs[-1], len(refs)) if refs else None

    got = level(tree, root)
    doc.update(root.num, {b"Type": Name(b"Outlines")} | ({b"First": got[0], b"Last": got[1], b"Count": got[2]} if got else {}))
    update_catalog(doc, Outlines=root)


def text_string(text: str) -> bytes:
    """ASCII as it is, everything else as marked UTF-16."""
    return text.encode() if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be", "replace")


def _cos(value: Any) -> Any:
    """Python text as a string, lists item by item."""
    return text_string(value) if isinstance(value, str) else [_cos(x) for x in value] if isinstance(value, list) else value


def form(doc: Document, fields: list[dict[str, Any]]) -> None:
    """Fields from nested {T, FT, V, Ff, Opt, DV, MaxLen, Q, Kids} dictionaries of Python values."""

    def make(spec: dict[str, Any]) -> Ref:
        d: dict[bytes, Any] = {}
        for k, v in spec.items():
            d[k.encode()] = [make(x) for x in v] if k == "Kids" else _cos(v)
        return doc.create(d)

    update_catalog(doc, AcroForm=doc.create({b"Fields": [make(f) for f in fields]}))


def annotate(doc: Document, page_num: int, annots: list[dict[bytes, Any]]) -> None:
    page = dict(dict_of(doc.get(page_num)))
    old = page.get(b"Annots")
    doc.update(page_num, page | {b"Annots": [*(old if isinstance(old, list) else []), *(doc.create(a) for a in annots)]})


def revision(data: bytes, changes: dict[int, Any], trailer: dict[bytes, Any], previous: int) -> bytes:
    """The file with an incremental update appended: new versions of objects and a section that names the old one."""
    out, at = [data], len(data)
    body, spots = [], {}
    for num, value in sorted(changes.items()):
        part = serialize_indirect(Ref(num, 0), value)
        spots[num] = at
        body.append(part)
        at += len(part)
    out += body
    out.append(b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in spots.items()))
    out.append(b"trailer\n" + serialize({**trailer, b"Prev": previous}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)
    return b"".join(out)


def compressed_file(objects: dict[int, Any], root: int) -> bytes:
    """A file whose plain objects sit in one object stream, indexed by an xref stream."""
    inner = {n: v for n, v in objects.items() if not isinstance(v, Stream)}
    outer = {n: v for n, v in objects.items() if isinstance(v, Stream)}
    box, index = max(objects) + 1, max(objects) + 2
    parts, pairs, at = [], [], 0
    for n, v in sorted(inner.items()):
        part = serialize(v) + b" "
        pairs.append(b"%d %d" % (n, at))
        parts.append(part)
        at += len(part)
    head = b" ".join(pairs) + b" "
    outer[box] = Stream({b"Type": Name(b"ObjStm"), b"N": len(inner), b"First": len(head), b"Filter": Name(b"FlateDecode")}, zlib.compress(head + b"".join(parts)))
    out, at, spots = [HEADER], len(HEADER), {}
    for n, v in sorted(outer.items()):
        part = serialize_indirect(Ref(n, 0), v)
        spots[n] = at
        out.append(part)
        at += len(part)
    rows = [bytes([0]) + (0).to_bytes(4, "big") + (65535).to_bytes(2, "big")]
    place = {n: i for i, n in enumerate(sorted(inner))}
    for n in range(1, index + 1):
        kind, a, b = (2, box, place[n]) if n in place else (1, spots.get(n, at), 0)
        rows.append(bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big"))
    head = {b"Type": Name(b"XRef"), b"Size": index + 1, b"W": [1, 4, 2], b"Root": Ref(root, 0), b"Filter": Name(b"FlateDecode")}
    out.append(serialize_indirect(Ref(index, 0), Stream(head, zlib.compress(b"".join(rows)))))
    out.append(b"startxref\n%d\n%%%%EOF\n" % at)
    return b"".join(out)


# Annotations and fields.


def annotation(subtype: str, rect: tuple[float, float, float, float], **more: Any) -> dict[bytes, Any]:
    """A new annotation's dictionary."""
    return {b"Type": Name(b"Annot"), b"Subtype": Name(subtype.encode()), b"Rect": list(map(float, rect))} | {k.encode(): _cos(v) for k, v in more.items()}


def set_annotation(doc: Document, num: int, rect=None, flags: int | None = None, contents: str | None = None, color: tuple[float, float, float] | None = None) -> None:
    """Change properties of an annotation; those that are None stay."""
    new = {b"Rect": list(map(float, rect)) if rect else None, b"F": flags, b"Contents": None if contents is None else contents.encode(), b"C": list(map(float, color)) if color else None}
    doc.update(num, dict_of(doc.get(num)) | {k: v for k, v in new.items() if v is not None})


def set_field(doc: Document, num: int, value: str | Name | None) -> None:
    """A field's value as text, as a name (a button's state), or none."""
    d = {k: v for k, v in dict_of(doc.get(num)).items() if k != b"V"}
    doc.update(num, d if value is None else d | {b"V": value if isinstance(value, Name) else value.encode()})


def rgb_of_bgr(pixels: bytes) -> bytes:
    """Samples in the order of the JVM's image source, turned to red, green, blue."""
    out = bytearray(pixels)
    out[0::3], out[2::3] = pixels[2::3], pixels[0::3]
    return bytes(out)
