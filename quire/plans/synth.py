"""Corpora made from relational rows: each function turns a row into the bytes of a PDF."""

from __future__ import annotations

from typing import Any

from quire.kernel import edit
from quire.kernel.cos import Name, Ref, Stream, dict_of, real_text, serialize
from quire.kernel.document import Document, find_startxref
from quire.kernel.filters import png_encode


def text_pdf(text: str, filters: list[str] | None = None) -> bytes:
    """One page that shows the lines of a text."""
    doc = Document.empty()
    edit.text_page(doc, text, filters)
    return doc.save()


def predicted_text_pdf(text: str, columns: int = 64) -> bytes:
    """A text page whose content is Flate data of PNG rows."""
    doc = Document.empty()
    font = edit.helvetica(doc)
    data = edit.lines_content([line.encode("cp1252", "replace") for line in text.split("\n")])
    parms = {b"Predictor": 15, b"Columns": columns}
    content = edit.stream(doc, png_encode(data + b" " * (-len(data) % columns), columns, 1, 2), ["FlateDecode"], DecodeParms=parms)
    doc.create_page(edit.LETTER, Resources={b"Font": {b"F1": font}}, Contents=content)
    return doc.save()


def cid_pdf(text: str) -> bytes:
    """A text page in a two-byte font with a Unicode map, whatever the characters."""
    doc = Document.empty()
    font, codes = edit.cid_font(doc, text.replace("\n", ""))
    hexes = {ord(c): code.hex() for c, code in codes.items()}
    lines = [f"<{line.translate(hexes)}> '".encode() for line in text.split("\n")]
    content = edit.stream(doc, b"\n".join([b"BT /F1 12 Tf 14 TL 72 720 Td", *lines, b"ET"]))
    doc.create_page(edit.LETTER, Resources={b"Font": {b"F1": font}}, Contents=content)
    return doc.save()


def multistream_pdf(text: str) -> bytes:
    """A page whose content is an array of streams, one for each line."""
    doc = Document.empty()
    font = edit.helvetica(doc)
    parts = [edit.stream(doc, b"BT /F1 12 Tf 72 720 Td " + serialize(line.encode("cp1252", "replace")) + b" Tj ET", ["ASCIIHexDecode"]) for line in text.split("\n")]
    doc.create_page(edit.LETTER, Resources={b"Font": {b"F1": font}}, Contents=parts)
    return doc.save()


def spaced_pdf(text: str) -> bytes:
    """A page whose words are parted by wide gaps in shown arrays and whose lines by moves."""
    doc = Document.empty()
    font = edit.helvetica(doc)
    parts = [b"BT /F1 12 Tf 72 720 Td"]
    for line in text.split("\n"):
        words = [serialize(w.encode("cp1252", "replace")) for w in line.split(" ")]
        parts.append(b"[" + b" -250 ".join(words) + b"] TJ 0 -14 Td")
    content = edit.stream(doc, b"\n".join([*parts, b"ET"]), ["RunLengthDecode"])
    doc.create_page(edit.LETTER, Resources={b"Font": {b"F1": font}}, Contents=content)
    return doc.save()


def pages_pdf(texts: list[str]) -> bytes:
    doc = Document.empty()
    for t in texts:
        edit.text_page(doc, t, ["FlateDecode"])
    return doc.save()


def boxed_pdf(key: int, size: int) -> bytes:
    """Two pages below a node that states box and rotation; the second page has a box of its own."""
    doc = Document.empty()
    root = doc.pages_ref()
    node = doc.create({b"Type": Name(b"Pages"), b"Parent": root, b"MediaBox": [0, 0, 100 + size, 200 + size], b"Rotate": 90 * (key % 4), b"Kids": [], b"Count": 2})
    first = doc.create({b"Type": Name(b"Page"), b"Parent": node})
    second = doc.create({b"Type": Name(b"Page"), b"Parent": node, b"CropBox": [10, 20, 50.5 + size, 60.25 + size], b"UserUnit": 2})
    doc.update(node.num, {**doc.get(node.num), b"Kids": [first, second]})
    doc.update(root.num, {b"Type": Name(b"Pages"), b"Kids": [node], b"Count": 2})
    return doc.save()


def info_pdf(**entries: str) -> bytes:
    doc = Document.empty()
    doc.trailer[b"Info"] = doc.create({k.encode(): edit.text_string(v) for k, v in entries.items() if v is not None})
    return doc.save()


def customer_form_pdf(name: str, balance: float, segment: str, key: int) -> bytes:
    """A form: text fields below one node, a check box and a choice."""
    doc = Document.empty()
    kids = [
        {"T": "name", "FT": Name(b"Tx"), "V": name, "MaxLen": 40, "Ff": 1 << 1},
        {"T": "balance", "FT": Name(b"Tx"), "V": float(balance), "Q": 2},
        {"T": "segment", "FT": Name(b"Ch"), "V": segment, "DV": "BUILDING", "Opt": ["AUTOMOBILE", ["b", "BUILDING"], segment], "Ff": 1 << 17},
    ]
    edit.form(doc, [{"T": "customer", "Kids": kids}, {"T": "active", "FT": Name(b"Btn"), "V": Name(b"Yes" if key % 2 else b"Off"), "Ff": 0}])
    return doc.save()


def region_outline_pdf(region: str, nations: list[Any]) -> bytes:
    """An outline: the region, its nations, their customers."""
    doc = Document.empty()
    page = Ref(edit.text_page(doc, region), 0)
    edit.outline(doc, [(region, [(n["n_name"], [(c, []) for c in n["customers"]]) for n in nations])], page)
    return doc.save()


def link_pdf(url: str) -> bytes:
    doc = Document.empty()
    page = edit.text_page(doc, "link")
    edit.annotate(doc, page, [{b"Type": Name(b"Annot"), b"Subtype": Name(b"Link"), b"Rect": [0, 0, 10, 10], b"A": {b"S": Name(b"URI"), b"URI": url.encode()}}])
    return doc.save()


MARKS = ("Highlight", "Underline", "StrikeOut", "Link", "Square")


def marked_pdf(lines: list[Any]) -> bytes:
    """A page with an annotation for each line item."""
    doc = Document.empty()
    page = edit.text_page(doc, "marks")
    notes = []
    for r in lines:
        n, x, y = r["l_linenumber"], r["l_quantity"], r["l_extendedprice"]
        quads = [float(v) for v in (x, y, x + 1, y, x, y + 2, x + 1, y + 2)]
        notes.append({
            b"Type": Name(b"Annot"), b"Subtype": Name(MARKS[n % 5].encode()), b"Rect": [float(x), float(y), float(x + n), float(y + 2 * n)], b"F": n + 4, b"C": [r["l_discount"], 0.0, 1.0],
            b"Contents": edit.text_string(r["l_returnflag"]), b"QuadPoints": quads * 2, b"CA": r["l_tax"],
        })
    edit.annotate(doc, page, notes)
    return doc.save()


def image_pdf(data: bytes) -> bytes:
    """A page that draws the bytes as one row of gray samples."""
    doc = Document.empty()
    page = doc.create_page(edit.LETTER)
    edit.add_image(doc, page, edit.raw_image(doc, data, len(data), 1, "DeviceGray"), (100, 600, 200, 700), "Img0")
    return doc.save()


def revised_pdf(old: str, new: str) -> bytes:
    """A file and an update of it that changes one metadata entry."""
    first = info_pdf(Title=old, Author="writer")
    doc = Document(first)
    num = doc.trailer[b"Info"].num
    return edit.revision(first, {num: {**doc.get(num), b"Title": edit.text_string(new)}}, doc.trailer, find_startxref(first))


def compressed_pdf(title: str) -> bytes:
    """The objects of a one-page file within an object stream."""
    doc = Document.empty()
    edit.text_page(doc, title, ["FlateDecode"])
    objects = {n: doc.get(n) for n in doc.numbers()}
    return edit.compressed_file(objects, doc.trailer[b"Root"].num)


def drawing_pdf(size: int) -> bytes:
    """Saved states, paths, colours, marked content, an inline image and an image resource that is missing."""
    doc = Document.empty()
    ops = [b"q 1 0 0 1 %d 0 cm" % size, b"q 0.5 g 1 0 0 RG", b"0 0 m 10 10 l S", b"Q", b"/Span << /MCID 1 >> BDC EMC", b"BI /W 1 /H 1 /BPC 8 /CS /G ID x EI", b"/Im9 Do", b"Q Q", real_text(size / 2) + b" w", b"7 xx"]
    doc.create_page(edit.LETTER, Contents=edit.stream(doc, b"\n".join(ops), ["ASCII85Decode"]))
    return doc.save()


def widget_pdf(value: str, shown: str) -> bytes:
    """A page of two widgets: one with a value, one whose text only its appearance shows."""
    doc = Document.empty()
    page = doc.create_page(edit.LETTER)
    font = edit.helvetica(doc)
    look = doc.create(Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Form"), b"Resources": {b"Font": {b"F1": font}}}, edit.lines_content([shown.encode("cp1252", "replace")])))
    widget = {b"Type": Name(b"Annot"), b"Subtype": Name(b"Widget"), b"Rect": [0, 0, 1, 1]}
    edit.annotate(doc, page, [widget | {b"V": edit.text_string(value)}, widget | {b"V": Name(b"Off"), b"AP": {b"N": look}}])
    return doc.save()


def actions_pdf(url: str, script: str) -> bytes:
    """A link whose action is followed by a script and a named action, and a bookmark that goes to the page."""
    doc = Document.empty()
    page = edit.text_page(doc, "actions")
    last = doc.create({b"S": Name(b"Named"), b"N": Name(b"NextPage")})
    then = doc.create({b"S": Name(b"JavaScript"), b"JS": script.encode(), b"Next": last})
    edit.annotate(doc, page, [{b"Type": Name(b"Annot"), b"Subtype": Name(b"Link"), b"Rect": [0, 0, 1, 1], b"A": {b"S": Name(b"URI"), b"URI": url.encode(), b"Next": then}}])
    edit.outline(doc, [("here", [])])
    mark = next(n for n in doc.numbers() if dict_of(doc.get(n)).get(b"Title"))
    doc.update(mark, doc.get(mark) | {b"A": {b"S": Name(b"GoTo"), b"D": [Ref(page, 0), Name(b"FitH"), 700]}})
    return doc.save()
