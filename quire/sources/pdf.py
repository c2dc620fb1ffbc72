"""PDF corpora as DataFrames.

A document never needs another one, so each derived table is one narrow pass: the bytes of a
document cross into a Python worker once, the byte kernel walks it, and rows come back as Arrow
batches.  No table shuffles; filters, joins, windows and aggregates over them are left to Catalyst.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.kernel import content as content_kernel
from quire.kernel import gstate, structure
from quire.kernel.cos import FAULTS, PdfError, Stream, as_int, as_name, dict_of, fault, kind_of
from quire.kernel.document import Document
from quire.kernel.filters import filters_of
from quire.runtime import ship

_BATCH_BYTES = 8 << 20
_BATCH_ROWS = 1 << 16

RECT = "array<double>"

#: Columns of each table after the document's key.
SCHEMAS = {
    "documents": "length bigint, header_version string, page_count bigint, stated_page_count bigint, next_obj_num bigint, is_encrypted boolean, error struct<kind:string,offset:bigint,message:string>",
    "trailers": "v string, root_num bigint, info_num bigint, size bigint",
    "xref_entries": "section int, obj_num bigint, kind string, offset bigint, gen bigint, next_free bigint, stream_obj bigint, idx bigint",
    "objects": "obj_num bigint, kind string, type_name string, subtype string, v string, key_order array<string>, stream_raw binary, filters array<string>, origin string, error string",
    "raw_pages": f"page_num int, obj_num bigint, media {RECT}, crop {RECT}, bleed {RECT}, trim {RECT}, art {RECT}, rotate bigint, unit double, num_annots int",
    "doc_info": "title string, author string, subject string, keywords string, creator string, producer string, creation_date string, mod_date string",
    "content_ops": "page_num int, seq int, op string, nums array<double>, names array<string>, strs array<binary>, props string, data binary, depth int",
    "graphics_states": "page_num int, seq int, op string, depth int, ctm array<double>, line_width double, line_cap int, line_join int, miter_limit double, dash array<double>, dash_phase double, rendering_intent string, flatness double, stroke_space string, fill_space string, stroke_color array<double>, fill_color array<double>, stroke_opacity double, fill_opacity double, ext_state string, char_spacing double, word_spacing double, horizontal_scaling double, leading double, font string, font_size double, render_mode int, rise double",
    "fonts": "page_num int, font_name string, font_type string, base_font string, is_cid boolean, has_tounicode boolean, encoding array<string>, cmap map<bigint,string>, widths map<int,double>, default_width double, first_char int",
    "page_text": "page_num int, text string, error string",
    "raw_annotations": f"page_num int, seq int, obj_num bigint, subtype string, rect {RECT}, flags bigint, contents string, name string, title string, subject string, modified string, created string, color array<double>, opacity double, popup_obj bigint, quads array<double>, line {RECT}, vertices array<double>, ink array<array<double>>, border_style string, border_width double, border_dash array<double>, link_uri string",
    "raw_fields": "seq int, obj_num bigint, name string, partial_name string, type string, flags bigint, value string, default_value string, max_length bigint, justification bigint, options array<string>, has_kids boolean",
    "form_values": "seq int, name string, value string",
    "bookmarks": "seq int, depth int, obj_num bigint, title string, first_obj bigint, next_obj bigint, prev_obj bigint, parent_obj bigint, is_open boolean, is_italic boolean, is_bold boolean, has_children boolean, color array<double>, dest_obj bigint, fit string, coords array<double>, action string, uri string",
    "actions": "owner string, owner_obj bigint, seq int, action string, uri string, javascript string, named string, dest_obj bigint, fit string, coords array<double>",
    "images": "page_num int, name string, width bigint, height bigint, bits bigint, color_space string, components int, is_mask boolean, interpolate boolean, filters array<string>, raw binary, decoded binary",
}


#: What converting odd values to Arrow may raise.
_ODD = (pa.ArrowException, OverflowError, TypeError, ValueError)


@dataclass(frozen=True)
class _Table:
    """A table's rows from the bytes of a file, or `of` a document that is already parsed."""

    of: Callable[[Document], Iterable[dict[str, Any]]]

    def __call__(self, data: bytes) -> Iterable[dict[str, Any]]:
        return self.of(Document(data))


def _document_rows(data: bytes) -> Iterator[dict[str, Any]]:
    row: dict[str, Any] = {"length": len(data or b"")}
    try:
        if data is None:
            raise PdfError("io", "no content")
        doc = Document(data)
        row |= {"header_version": doc.version, "next_obj_num": doc.next_num, "is_encrypted": b"Encrypt" in doc.trailer}
        row |= {"stated_page_count": structure.stated_page_count(doc), "page_count": sum(1 for _ in structure.pages(doc))}
    except FAULTS as raised:
        e = fault(raised)
        row["error"] = {"kind": e.kind, "offset": e.offset, "message": str(e)}
    yield row


def _json(value: Any) -> str:
    return json.dumps(structure.tagged(value), separators=(",", ":"), allow_nan=False)


def _trailer_rows(doc: Document) -> Iterator[dict[str, Any]]:
    t = doc.trailer
    root, info = t.get(b"Root"), t.get(b"Info")
    yield {"v": _json(t), "root_num": getattr(root, "num", None), "info_num": getattr(info, "num", None), "size": as_int(t.get(b"Size"))}


def _xref_rows(doc: Document) -> Iterator[dict[str, Any]]:
    for section, entries in enumerate(doc.sections):
        for num, (kind, a, b) in entries.items():
            row = {"section": section, "obj_num": num, "kind": kind}
            yield row | ({"offset": a, "gen": b} if kind == "inuse" else {"next_free": a, "gen": b} if kind == "free" else {"stream_obj": a, "idx": b})


def _object_rows(doc: Document) -> Iterator[dict[str, Any]]:
    for num in doc.numbers():
        value = doc.get(num)
        head = dict_of(value)
        stream = value if isinstance(value, Stream) else None
        entry = doc.entries.get(num)
        yield {
            "obj_num": num, "kind": kind_of(value), "type_name": as_name(head.get(b"Type")), "subtype": as_name(head.get(b"Subtype")), "v": _json(value),
            "key_order": [k.decode("utf-8", "replace") for k in head] if head else None, "stream_raw": stream.data if stream else None,
            "filters": [f.decode("latin-1") for f in filters_of(head)] if stream else None, "origin": "objstm" if entry and entry.kind == "compressed" else "inuse", "error": doc.errors.get(num),
        }


def _page_rows(doc: Document) -> Iterator[dict[str, Any]]:
    for num, obj, page in structure.pages(doc):
        yield structure.page_row(num, obj, page)


def _op_rows(doc: Document) -> Iterator[dict[str, Any]]:
    for num, _, page in structure.pages(doc):
        try:
            ops = content_kernel.parse_content(structure.content_of(doc, page))
        except PdfError:
            continue
        for seq, (op, depth) in enumerate(zip(ops, content_kernel.graphics_depths(ops))):
            nums, names, strs, props = content_kernel.columns(op)
            yield {
                "page_num": num, "seq": seq, "op": op.op.removeprefix("?"), "nums": nums, "names": [n.decode("utf-8", "replace") for n in names], "strs": strs,
                "props": None if props is None else _json(props), "data": op.data, "depth": depth,
            }


def _state_rows(doc: Document) -> Iterator[dict[str, Any]]:
    for num, _, page in structure.pages(doc):
        try:
            ops = content_kernel.parse_content(structure.content_of(doc, page))
        except PdfError:
            continue
        for seq, (op, (depth, state)) in enumerate(zip(ops, gstate.states(ops))):
            yield {"page_num": num, "seq": seq, "op": op.op.removeprefix("?"), "depth": depth, **state}


def _font_rows(doc: Document) -> Iterator[dict[str, Any]]:
    for num, _, page in structure.pages(doc):
        for name, font in structure.fonts_of(doc, page.get(b"Resources")).items():
            cmap = None
            if font.cmap:
                cmap = {c: s for c in font.cmap.codes() if (s := font.cmap.lookup(c)) is not None}
            yield {
                "page_num": num, "font_name": name.decode("utf-8", "replace"), "font_type": font.type, "base_font": font.base, "is_cid": font.is_cid, "has_tounicode": font.cmap is not None,
                "encoding": font.table, "cmap": list(cmap.items()) if cmap is not None else None, "widths": list(font.widths.items()), "default_width": font.default_width, "first_char": font.first_char,
            }


def _text_rows(doc: Document) -> Iterator[dict[str, Any]]:
    for num, _, page in structure.pages(doc):
        try:
            yield {"page_num": num, "text": structure.page_text(doc, page)}
        except PdfError as e:
            yield {"page_num": num, "error": str(e)}


_MAKERS: dict[str, Callable[[bytes], Iterator[dict[str, Any]]]] = {
    "documents": _document_rows, "trailers": _Table(_trailer_rows), "xref_entries": _Table(_xref_rows), "objects": _Table(_object_rows), "raw_pages": _Table(_page_rows),
    "doc_info": _Table(lambda d: [structure.info_row(d)]), "content_ops": _Table(_op_rows), "graphics_states": _Table(_state_rows), "fonts": _Table(_font_rows), "page_text": _Table(_text_rows),
    "raw_annotations": _Table(structure.annot_rows), "raw_fields": _Table(structure.field_rows), "form_values": _Table(structure.field_values), "bookmarks": _Table(structure.bookmark_rows),
    "actions": _Table(structure.action_rows), "images": _Table(structure.image_rows),
}


@dataclass(frozen=True)
class Corpus:
    """A DataFrame of (key, content) whose content is PDF bytes.

    Documents that cannot be read, whatever is wrong with them, give no further rows but in
    `documents`, which states the error; with `fail_fast` they end the query instead.
    """

    files: DataFrame
    key: str = "doc_id"
    content: str = "content"
    fail_fast: bool = False

    def table(self, name: str) -> DataFrame:
        """One of SCHEMAS, keyed by the document."""
        make = _MAKERS[name]
        return self._rows(SCHEMAS[name], lambda raw: make(raw) if raw is not None or name == "documents" else ())

    def tables(self, *names: str) -> DataFrame:
        """Several of SCHEMAS in one pass: `table` names a row's table, whose struct column alone is not null.

        Files are read and parsed once, whatever is then aggregated, or split by `table`.
        """
        plain, strict = [n for n in names if n != "documents"], self.fail_fast

        def rows(raw: bytes | None) -> Iterator[dict[str, Any]]:
            if "documents" in names:
                yield from ({"table": "documents", "documents": row} for row in _document_rows(raw))
            if raw is None or not plain:
                return
            doc = Document(raw)
            for n in plain:
                try:
                    yield from ({"table": n, n: row} for row in _MAKERS[n].of(doc))
                except FAULTS:
                    if strict:
                        raise

        fields = ", ".join(f"{n} {StructType.fromDDL(SCHEMAS[n]).simpleString()}" for n in names)
        return self._rows(f"table string, {fields}", rows)

    def _rows(self, ddl: str, make: Callable[[bytes | None], Iterable[dict[str, Any]]]) -> DataFrame:
        """Rows of every document, keyed; one that raises has those that came before, one whose values Arrow cannot hold none."""
        src = self.files.select(F.col(self.key), F.col(self.content).alias("content"))
        ddl = f"`{self.key}` {src.schema[0].dataType.simpleString()}, {ddl}"
        schema = to_arrow_schema(StructType.fromDDL(ddl))
        strict, name = self.fail_fast, self.key

        def converted(documents: list[list[dict[str, Any]]]) -> Iterator[pa.RecordBatch]:
            try:
                yield pa.RecordBatch.from_pylist([row for rows in documents for row in rows], schema=schema)
                return
            except _ODD:
                if strict:
                    raise
            for rows in documents:
                try:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                except _ODD:
                    continue

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                documents: list[list[dict[str, Any]]] = []
                held = count = 0
                for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                    raw = data.as_py()
                    mine: list[dict[str, Any]] = []
                    try:
                        for row in make(raw):
                            mine.append({name: key, **row})
                    except FAULTS as e:
                        if strict:
                            raise fault(e) from e
                    documents.append(mine)
                    held += len(raw or b"")
                    count += len(mine)
                    if held >= _BATCH_BYTES or count >= _BATCH_ROWS:
                        yield from converted(documents)
                        documents, held, count = [], 0, 0
                if count:
                    yield from converted(documents)

        ship(self.files.sparkSession)
        return src.mapInArrow(run, ddl)

    def objects(self, as_variant: bool = True) -> DataFrame:
        """The object graph, a row per object; `v` is VARIANT, or its JSON text."""
        t = self.table("objects")
        return t.withColumn("v", F.parse_json("v")) if as_variant else t


def from_bytes(df: DataFrame, key: str = "doc_id", content: str = "content", fail_fast: bool = False) -> Corpus:
    """A corpus over any DataFrame with a binary column."""
    return Corpus(df, key, content, fail_fast)


def read_pdf(spark: SparkSession, path: str, glob: str = "*.pdf", fail_fast: bool = False) -> Corpus:
    """The PDF files below a path that Spark can read, keyed by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return Corpus(files.select("path", "content", "length", "modificationTime"), "path", "content", fail_fast)


def corpus_stats(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(files, bytes) below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
