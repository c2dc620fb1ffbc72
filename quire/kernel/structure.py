"""What a document is made of: pages, text, fonts, annotations, fields, bookmarks, images, metadata.

Every function takes a Document and yields plain rows (dicts), ready for Arrow.  Trees are walked
with a guard against cycles.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import isfinite
from typing import Any

from quire.kernel.content import Op, number, parse_content, string
from quire.kernel.cos import Name, PdfError, Ref, Stream, as_float, as_int, as_name, dict_of, is_string, kind_of
from quire.kernel.document import Document
from quire.kernel.filters import MAX_DECODED, filters_of
from quire.kernel.fonts import Font, load_font

# Text strings.  Four readers of such strings differ only in what they do without a UTF-16 mark.


def _utf16(data: bytes) -> str | None:
    return data[2 : len(data) // 2 * 2].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else None


def info_text(data: bytes) -> str:
    """Metadata: UTF-16 or UTF-8 by mark, else UTF-8."""
    got = _utf16(data)
    return data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace") if got is None else got


_WINDOWS = [bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in range(256)]


def field_text(data: bytes) -> str:
    """Values on a page: UTF-16 or UTF-8 by mark, else the Windows code page."""
    got = _utf16(data)
    if got is None:
        got = data[3:].decode("utf-8", "replace") if data[:3] == b"\xef\xbb\xbf" else "".join(map(_WINDOWS.__getitem__, data))
    return got


def plain_text(data: bytes) -> str:
    """Annotations, fields and bookmarks: UTF-16 by mark, else UTF-8, whose own mark stays."""
    got = _utf16(data)
    return data.decode("utf-8", "replace") if got is None else got


def _text(value: Any, read=plain_text) -> str | None:
    return read(value) if is_string(value) else None


def _numbers(value: Any) -> list[float] | None:
    """The numbers of a direct array, others left out."""
    return [float(x) for x in value if as_float(x) is not None] if isinstance(value, list) and not isinstance(value, Ref) else None


def rect_of(value: Any) -> list[float] | None:
    """Four direct numbers, or nothing."""
    if not isinstance(value, list) or isinstance(value, Ref) or len(value) < 4:
        return None
    got = [as_float(x) for x in value[:4]]
    return None if None in got else got


# Pages.

_INHERITED = (b"MediaBox", b"CropBox", b"Rotate", b"Resources")


def pages(doc: Document) -> Iterator[tuple[int, int, dict[bytes, Any]]]:
    """(page number, object number, attributes with inherited ones) in order.

    A node of type Pages is descended, anything else that is referred to is a page; kids that are
    no references are skipped.
    """
    count = 0
    seen: set[int] = set()

    def walk(num: int, passed: dict[bytes, Any]) -> Iterator[tuple[int, int, dict[bytes, Any]]]:
        nonlocal count
        stack = [(num, passed)]
        while stack:
            at, above = stack.pop()
            node = dict_of(doc.get(at))
            if node.get(b"Type") == b"Pages":
                if at in seen:
                    continue
                seen.add(at)
                below = above | {k: node[k] for k in _INHERITED if k in node}
                kids = doc.resolve(node.get(b"Kids"))
                refs = [k for k in kids if isinstance(k, Ref)] if isinstance(kids, list) else []
                stack += [(k.num, below) for k in reversed(refs)]
            elif node:
                count += 1
                yield count, at, above | node

    yield from walk(doc.pages_ref().num, {})


def page_row(num: int, obj: int, page: dict[bytes, Any]) -> dict[str, Any]:
    """Raw attributes; defaults, rotation and matrices are column expressions."""
    annots = page.get(b"Annots")
    return {
        "page_num": num, "obj_num": obj, "media": rect_of(page.get(b"MediaBox")), "crop": rect_of(page.get(b"CropBox")), "bleed": rect_of(page.get(b"BleedBox")),
        "trim": rect_of(page.get(b"TrimBox")), "art": rect_of(page.get(b"ArtBox")), "rotate": as_int(page.get(b"Rotate")), "unit": as_float(page.get(b"UserUnit")),
        "num_annots": len(annots) if isinstance(annots, list) and not isinstance(annots, Ref) else 0,
    }


def stated_page_count(doc: Document) -> int:
    return as_int(dict_of(doc.get(doc.pages_ref().num)).get(b"Count")) or 0


def content_of(doc: Document, page: dict[bytes, Any]) -> bytes:
    """The page's content: one stream, or an array's streams joined by line ends."""
    value = doc.resolve(page.get(b"Contents"))
    if isinstance(value, Stream):
        return doc.decoded(value)
    if isinstance(value, list):
        out, size = [], 0
        for part in map(doc.resolve, value):
            if isinstance(part, Stream):
                out.append(doc.decoded(part))
                size += len(out[-1]) + 1
                if size > MAX_DECODED:
                    raise PdfError("filter", f"more than {MAX_DECODED} bytes of content")
        return b"\n".join(out)
    return b""


def fonts_of(doc: Document, resources: Any) -> dict[bytes, Font]:
    fonts = doc.resolve(dict_of(doc.resolve(resources)).get(b"Font"))
    out = {}
    for name, value in dict_of(fonts).items():
        head = doc.resolve(value)
        if not isinstance(head, (dict, Stream)):
            continue
        if not isinstance(value, Ref):
            out[name] = load_font(head, doc)
        elif value.num in doc.fonts:
            out[name] = doc.fonts[value.num]
        else:
            out[name] = doc.fonts[value.num] = load_font(head, doc)
    return out


# Text.

_SPACED = ("\n", " ")


def text_of(ops: list[Op], fonts: dict[bytes, Font]) -> str:
    """The text that the operators show.

    What is appended depends on how the text so far ends: moves down a line end it once, moves to
    the right and wide gaps separate words once.
    """
    out: list[str] = []
    tail = ""
    font, inside, fresh = b"", False, False

    def put(s: str) -> None:
        nonlocal tail
        if s:
            out.append(s)
            tail = s[-1]

    def show(data: bytes) -> None:
        nonlocal fresh
        f = fonts.get(font)
        if f is not None:
            put(f.decode(data))
        else:
            try:
                put(data.decode())
            except UnicodeDecodeError:
                put(data.decode("latin-1"))
        fresh = False

    def line(after_space: bool) -> None:
        nonlocal fresh
        if tail and tail != "\n" and (after_space or tail != " "):
            put("\n")
            fresh = True

    def gap() -> None:
        if tail and tail not in _SPACED:
            put(" ")

    for op, args, _ in ops:
        if op == "BT":
            inside = True
        elif op == "ET":
            inside = False
            line(True)
        elif op == "Tf":
            font = bytes(args[0]) if args and isinstance(args[0], Name) else b""
        elif not inside:
            continue
        elif op == "Td" or op == "TD":
            if abs(number(args, 1)) > 1 and not fresh:
                line(False)
            elif op == "Td" and abs(number(args, 1)) <= 1 and number(args, 0) > 1 and not fresh:
                gap()
        elif op == "T*":
            line(True)
        elif op == "Tj":
            show(string(args, 0))
        elif op == "TJ":
            for item in args[0] if args and isinstance(args[0], list) else ():
                if is_string(item):
                    show(item)
                elif (as_float(item) or 0) < -200:
                    gap()
        elif op in ("'", '"'):
            if tail and tail != "\n":
                put("\n")
            show(string(args, 0 if op == "'" else 2))
    return "".join(out).rstrip()


def _appearance_text(doc: Document, annot: dict[bytes, Any]) -> str:
    shown = doc.resolve(dict_of(doc.resolve(annot.get(b"AP"))).get(b"N"))
    if not isinstance(shown, Stream):
        return ""
    try:
        data = doc.decoded(shown)
        return text_of(parse_content(data), fonts_of(doc, shown.dict.get(b"Resources"))) if data else ""
    except PdfError:
        return ""


def annots_of(doc: Document, page: dict[bytes, Any]) -> Iterator[tuple[int | None, dict[bytes, Any]]]:
    listed = doc.resolve(page.get(b"Annots"))
    for value in listed if isinstance(listed, list) else ():
        annot = doc.resolve(value)
        if isinstance(annot, (dict, Stream)):
            yield value.num if isinstance(value, Ref) else None, dict_of(annot)


def widget_text(doc: Document, page: dict[bytes, Any]) -> str:
    """Values of the page's widgets, or else the text of their appearance, a line each."""
    out = []
    for _, annot in annots_of(doc, page):
        if annot.get(b"Subtype") != b"Widget" or not isinstance(annot.get(b"Subtype"), Name):
            continue
        value = annot.get(b"V")
        text = (_text(value, field_text) or "") if not isinstance(value, Name) else ("" if value == b"Off" else as_name(value))
        text = text.strip() or _appearance_text(doc, annot).strip()
        if text:
            out.append(text)
    return "\n".join(out)


def page_text(doc: Document, page: dict[bytes, Any]) -> str:
    shown = text_of(parse_content(content_of(doc, page)), fonts_of(doc, page.get(b"Resources")))
    return "\n".join(t for t in (shown, widget_text(doc, page)) if t).rstrip()


# Metadata.

INFO_KEYS = {"title": b"Title", "author": b"Author", "subject": b"Subject", "keywords": b"Keywords", "creator": b"Creator", "producer": b"Producer", "creation_date": b"CreationDate", "mod_date": b"ModDate"}


def info_row(doc: Document) -> dict[str, str | None]:
    ref = doc.trailer.get(b"Info")
    info = dict_of(doc.get(ref.num)) if isinstance(ref, Ref) else {}
    return {k: _text(info.get(v), info_text) for k, v in INFO_KEYS.items()}


# Annotations.

#: Annotation subtypes, and those that mark up.
ANNOT_TYPES = set("Text Link FreeText Line Square Circle Polygon PolyLine Highlight Underline Squiggly StrikeOut Stamp Caret Ink Popup FileAttachment Sound Movie Widget Screen PrinterMark TrapNet Watermark 3D Redact Projection RichMedia".split())
_BORDERS = {"S": "Solid", "D": "Dashed", "B": "Beveled", "I": "Inset", "U": "Underline"}


def action_row(doc: Document, value: Any) -> dict[str, Any]:
    a = dict_of(value)
    kind = as_name(a.get(b"S"))
    kind = kind if kind in ACTION_TYPES else "Unknown" if a else None
    return {
        "action": kind, "uri": _utf8(a.get(b"URI")) if kind == "URI" else None, "javascript": _utf8(a.get(b"JS")) if kind == "JavaScript" else None,
        "named": as_name(a.get(b"N")) if kind == "Named" else None, **dest_row(a.get(b"D") if kind == "GoTo" else None),
    }


def _utf8(value: Any) -> str | None:
    return value.decode("utf-8", "replace") if is_string(value) else None


#: Action types.
ACTION_TYPES = set("GoTo GoToR GoToE Launch Thread URI Sound Movie Hide Named SubmitForm ResetForm ImportData JavaScript SetOCGState Rendition Trans GoTo3DView RichMediaExecute".split())
#: How many coordinates each way to fit a page has.
FITS = {"XYZ": 3, "Fit": 0, "FitH": 1, "FitV": 1, "FitR": 4, "FitB": 0, "FitBH": 1, "FitBV": 1}


def dest_row(value: Any) -> dict[str, Any]:
    """An explicit destination; named ones stay unresolved."""
    if not isinstance(value, list) or isinstance(value, Ref) or not value:
        return {"dest_obj": None, "fit": None, "coords": None}
    fit = as_name(value[1]) if len(value) > 1 else None
    fit = fit if fit in FITS else "Fit"
    return {"dest_obj": value[0].num if isinstance(value[0], Ref) else None, "fit": fit, "coords": [as_float(value[i]) or 0.0 if i < len(value) else 0.0 for i in range(2, 2 + FITS[fit])]}


def annot_rows(doc: Document) -> Iterator[dict[str, Any]]:
    for num, _, page in pages(doc):
        for seq, (obj, a) in enumerate(annots_of(doc, page)):
            kind = as_name(a.get(b"Subtype"))
            color = _numbers(a.get(b"C"))
            flags = as_int(a.get(b"F"))
            border = a.get(b"BS")
            b = dict_of(border)
            link = a.get(b"A") if isinstance(a.get(b"A"), dict) else None
            opacity = as_float(a.get(b"CA"))
            popup = a.get(b"Popup")
            ink = a.get(b"InkList")
            yield {
                "page_num": num, "seq": seq, "obj_num": obj, "subtype": kind if kind in ANNOT_TYPES else "Unknown", "rect": rect_of(a.get(b"Rect")) or [0.0] * 4, "flags": flags or 0,
                "contents": _text(a.get(b"Contents")), "name": _text(a.get(b"NM")), "title": _text(a.get(b"T")), "subject": _text(a.get(b"Subj")),
                "modified": _text(a.get(b"M")), "created": _text(a.get(b"CreationDate")), "color": color if color is not None and len(color) in (0, 1, 3, 4) else None,
                "opacity": 1.0 if opacity is None else opacity, "popup_obj": popup.num if isinstance(popup, Ref) else None, "quads": _numbers(a.get(b"QuadPoints")),
                "line": rect_of(a.get(b"L")), "vertices": _numbers(a.get(b"Vertices")), "ink": [_numbers(x) or [] for x in ink] if isinstance(ink, list) else None,
                "border_style": _BORDERS.get(as_name(b.get(b"S")) or "S", "Solid") if isinstance(border, dict) else None,
                "border_width": (1.0 if as_float(b.get(b"W")) is None else as_float(b.get(b"W"))) if isinstance(border, dict) else None,
                "border_dash": (_numbers(b.get(b"D")) or ([3.0] if not isinstance(b.get(b"D"), list) else [])) if isinstance(border, dict) else None,
                "link_uri": _utf8(link.get(b"URI")) if link and link.get(b"S") == b"URI" else None,
            }


def action_rows(doc: Document) -> Iterator[dict[str, Any]]:
    """Actions of annotations and bookmarks, each with those that follow it by /Next."""
    owners = [("annotation", obj, a) for _, _, page in pages(doc) for obj, a in annots_of(doc, page)]
    owners += [("bookmark", r["obj_num"], dict_of(doc.get(r["obj_num"]))) for r in bookmark_rows(doc)]
    for kind, obj, owner in owners:
        queue, seen, seq = deque([owner.get(b"A")]), set(), 0
        while queue:
            value = queue.popleft()
            if isinstance(value, Ref):
                if value.num in seen:
                    continue
                seen.add(value.num)
            act = doc.resolve(value)
            if not isinstance(act, dict):
                continue
            yield {"owner": kind, "owner_obj": obj, "seq": seq, **action_row(doc, act)}
            seq += 1
            after = doc.resolve(act.get(b"Next"))
            queue += after if isinstance(after, list) else [act[b"Next"]] if b"Next" in act else []


# Forms.


def _form_roots(doc: Document) -> list:
    form = dict_of(doc.resolve(doc.catalog().get(b"AcroForm")))
    roots = form.get(b"Fields")
    return roots if isinstance(roots, list) and not isinstance(roots, Ref) else []


def _value_text(value: Any) -> str | None:
    if isinstance(value, Name):
        return as_name(value)
    if is_string(value):
        return plain_text(value)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return str(int(value)) if value == int(value) else repr(value)


def field_type(kind: str | None, flags: int) -> str:
    if kind == "Btn":
        return "Button" if flags & 1 << 16 else "Radio" if flags & 1 << 15 else "CheckBox"
    return {"Tx": "Text", "Ch": "Choice", "Sig": "Signature"}.get(kind or "", "Unknown")


def field_rows(doc: Document) -> Iterator[dict[str, Any]]:
    """Fields with full names: a node with a type ends its branch, one with neither type nor kids counts too."""
    seen: set[int] = set()
    stack = [(v, "") for v in reversed(_form_roots(doc))]
    seq = 0
    while stack:
        value, above = stack.pop()
        if isinstance(value, Ref):
            if value.num in seen:
                continue
            seen.add(value.num)
        node = doc.resolve(value)
        if not isinstance(node, (dict, Stream)):
            continue
        d = dict_of(node)
        part = _text(d.get(b"T")) or ""
        name = ".".join(x for x in (above, part) if x)
        kids = d.get(b"Kids")
        kids = kids if isinstance(kids, list) and not isinstance(kids, Ref) else []
        if b"FT" not in d and kids:
            stack += [(k, name) for k in reversed(kids)]
            continue
        flags = (as_int(d.get(b"Ff")) or 0) & 0xFFFFFFFF
        default, options = d.get(b"DV"), d.get(b"Opt")
        shown = []
        for o in options if isinstance(options, list) else ():
            pair = o[1] if isinstance(o, list) and not isinstance(o, Ref) and len(o) >= 2 else o
            text = as_name(pair) if isinstance(pair, Name) and pair is o else _text(pair)
            if text is not None:
                shown.append(text)
        yield {
            "seq": seq, "obj_num": value.num if isinstance(value, Ref) else None, "name": name, "partial_name": part, "type": field_type(as_name(d.get(b"FT")), flags), "flags": flags,
            "value": _value_text(d.get(b"V")), "default_value": _value_text(default) if isinstance(default, bytes) else None, "max_length": as_int(d.get(b"MaxLen")),
            "justification": as_int(d.get(b"Q")) or 0, "options": shown, "has_kids": bool(kids),
        }
        seq += 1


def field_values(doc: Document) -> Iterator[dict[str, Any]]:
    """(partial name, value) of every node with a value other than Off, all kids included."""
    seen: set[int] = set()
    stack = list(reversed(_form_roots(doc)))
    seq = 0
    while stack:
        value = stack.pop()
        if isinstance(value, Ref):
            if value.num in seen:
                continue
            seen.add(value.num)
        d = dict_of(doc.resolve(value))
        v = d.get(b"V")
        text = as_name(v) if isinstance(v, Name) else _text(v, field_text)
        if text and text != "Off":
            yield {"seq": seq, "name": _text(d.get(b"T"), field_text) or "", "value": text}
            seq += 1
        kids = d.get(b"Kids")
        if isinstance(kids, list) and not isinstance(kids, Ref):
            stack += reversed(kids)


# Bookmarks.


def bookmark_rows(doc: Document) -> Iterator[dict[str, Any]]:
    """The outline depth first: an item, what is below it, then its next sibling."""
    root = doc.catalog().get(b"Outlines")
    first = dict_of(doc.get(root.num)).get(b"First") if isinstance(root, Ref) else None
    stack = [(first, 0)] if isinstance(first, Ref) else []
    seen: set[int] = set()
    seq = 0
    while stack:
        ref, depth = stack.pop()
        if ref.num in seen:
            continue
        seen.add(ref.num)
        value = doc.get(ref.num)
        if not isinstance(value, dict):
            raise PdfError("object", f"bookmark {ref.num} is none")
        link = {k: value[v].num if isinstance(value.get(v), Ref) else None for k, v in (("first_obj", b"First"), ("next_obj", b"Next"), ("prev_obj", b"Prev"), ("parent_obj", b"Parent"))}
        own = dest_row(doc.resolve(value.get(b"Dest")))
        act = action_row(doc, doc.resolve(value.get(b"A")))
        style = as_int(value.get(b"F")) or 0
        color = _numbers(value.get(b"C"))
        yield {
            "seq": seq, "depth": depth, "obj_num": ref.num, "title": _text(value.get(b"Title")) or "", **link, "is_open": (as_int(value.get(b"Count")) or 0) > 0,
            "is_italic": bool(style & 1), "is_bold": bool(style & 2), "has_children": link["first_obj"] is not None, "color": color if color and len(color) >= 3 else None,
            **own, "action": act["action"], "uri": act["uri"],
        }
        seq += 1
        stack += [(value[k], d) for k, d in ((b"Next", depth), (b"First", depth + 1)) if isinstance(value.get(k), Ref)]


# Images.

COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3, "DeviceCMYK": 4}


def image_rows(doc: Document) -> Iterator[dict[str, Any]]:
    """Image streams of each page's own resources."""
    for num, _, page in pages(doc):
        listed = doc.resolve(dict_of(doc.resolve(page.get(b"Resources"))).get(b"XObject"))
        for name, value in dict_of(listed).items():
            x = doc.resolve(value)
            if not isinstance(x, Stream) or x.dict.get(b"Subtype") != b"Image":
                continue
            h = x.dict
            width, height, bits = as_int(h.get(b"Width")), as_int(h.get(b"Height")), as_int(h.get(b"BitsPerComponent"))
            if width is None or height is None:
                continue
            space = as_name(h.get(b"ColorSpace")) or "DeviceRGB"
            try:
                decoded = doc.decoded(x)
            except PdfError:
                decoded = None
            yield {
                "page_num": num, "name": name.decode("utf-8", "replace"), "width": width, "height": height, "bits": 8 if bits is None else bits, "color_space": space,
                "components": COMPONENTS.get(space, 3), "is_mask": h.get(b"ImageMask") is True, "interpolate": h.get(b"Interpolate") is True,
                "filters": [f.decode("latin-1") for f in filters_of(h)], "raw": x.data, "decoded": decoded,
            }


# Objects.


def tagged(value: Any) -> Any:
    """A value as JSON data that keeps its type: one key names it."""
    kind = kind_of(value)
    if kind == "null":
        return {"t": "null"}
    if kind == "bool":
        return {"b": value}
    if kind == "int":
        return {"i": value}
    if kind == "real":
        return {"f": value if isfinite(value) else 0.0}
    if kind == "name":
        return {"n": value.decode("utf-8", "replace")}
    if kind == "str":
        return {"s": value.hex()}
    if kind == "ref":
        return {"r": [value.num, value.gen]}
    if kind == "array":
        return {"a": [tagged(v) for v in value]}
    return {"d": {k.decode("utf-8", "replace"): tagged(v) for k, v in dict_of(value).items()}}
