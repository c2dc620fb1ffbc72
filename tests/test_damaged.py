"""Damaged and hostile files: each costs its own rows, and little time."""

import random
import time
import zlib

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.kernel import edit, filters
from quire.kernel.cos import FAULTS, Lexer, PdfError, parse_value
from quire.kernel.document import Document, xref_stream, xref_table
from quire.kernel.fonts import CMap
from quire.plans import synth
from quire.sources import pdf
from quire.sources.pdf import SCHEMAS, Corpus


@pytest.fixture(scope="module")
def arrow(spark):
    return {name: to_arrow_schema(StructType.fromDDL(ddl)) for name, ddl in SCHEMAS.items()}


def samples() -> list[bytes]:
    customers = [{"n_name": "N", "customers": ["a", "b"]}]
    lines = [{"l_linenumber": i, "l_quantity": 2.0, "l_extendedprice": 9.0, "l_discount": 0.1, "l_tax": 0.2, "l_returnflag": "R"} for i in range(3)]
    return [
        synth.text_pdf("one\ntwo é", ["FlateDecode"]), synth.cid_pdf("日本 text"), synth.predicted_text_pdf("rows " * 30), synth.spaced_pdf("a b\nc"), synth.boxed_pdf(3, 7), synth.info_pdf(Title="t", Author="ä"),
        synth.customer_form_pdf("n", 1.5, "s", 3), synth.region_outline_pdf("r", customers), synth.marked_pdf(lines), synth.image_pdf(b"abc"), synth.revised_pdf("a", "b"), synth.compressed_pdf("z"),
        synth.drawing_pdf(5), synth.widget_pdf("v", "w"), synth.actions_pdf("http://x", "s()"),
    ]


def content_pdf(content: bytes) -> bytes:
    doc = Document.empty()
    doc.create_page(edit.LETTER, Contents=edit.stream(doc, content))
    return doc.save()


def hostile() -> dict[str, bytes]:
    plain = synth.text_pdf("x")
    at = plain.index(b"xref\n0 ")
    section = lambda text: plain[:at] + text + b"\nstartxref\n%d\n%%%%EOF" % at
    doc = Document.empty()
    doc.create_page(edit.LETTER, Contents=edit.stream(doc, zlib.compress(bytes(1 << 20) * 300), None, Filter=pdf.structure.Name(b"FlateDecode")))
    bomb = doc.save()
    doc = Document.empty()
    ranges = "\n".join(["1 beginbfrange", *(f"<{i:04X}> <FFFFFFFF> <0041>" for i in range(20_000)), "endbfrange"])
    cmap = edit.stream(doc, ranges.encode())
    font = doc.create({b"Type": edit.Name(b"Font"), b"Subtype": edit.Name(b"Type0"), b"ToUnicode": cmap, b"DescendantFonts": [{b"W": [v for i in range(3000) for v in (i, i + 65_000, 5)]}]})
    doc.create_page(edit.LETTER, Resources={b"Font": {b"F1": font}}, Contents=edit.stream(doc, b"BT /F1 1 Tf (abc) Tj ET"))
    wide = doc.save()
    return {
        "count": section(b"xref\n0 9999999999\n0000000000 65535 f \n"), "count without end": section(b"xref\n0 99999999999999"), "start": section(b"xref\n-5 9000000000000000000\n0 0 n"),
        "arrays": content_pdf(b"[" * 3000), "dictionaries": content_pdf(b"<</A" * 3000), "closed arrays": content_pdf(b"[" * 3000 + b"]" * 3000 + b" TJ"), "digits": content_pdf(b"9" * 100_000 + b" w " + b"9" * 300 + b".5 w"),
        "whole numbers": content_pdf(b"1" + b"0" * 30 + b" J " + b"1" + b"0" * 30 + b" Tr"), "bomb": bomb, "codes": wide, "brackets": content_pdf(b"(" * 200_000), "hex": content_pdf(b"<" * 200_000), "names": content_pdf(b"/" * 100_000),
        "inline": content_pdf(b"BI ID EIx " * 20_000), "references": content_pdf(b"1 " * 100_000), "large references": plain.replace(b"/Count 1", b"/Count 99999999999999999999 0 R"),
        "nested objects": plain.replace(b"/Type /Catalog", b"/Type /Catalog /X " + b"[" * 5000), "no header": b"no pdf", "empty": b"", "header only": b"%PDF-1.4",
    }


def read_all(data: bytes, limit: float, arrow: dict) -> None:
    for name, make in pdf._MAKERS.items():
        begin = time.perf_counter()
        rows = []
        try:
            rows = list(make(data))
        except FAULTS as e:
            assert name != "documents", e
        took = time.perf_counter() - begin
        assert took < limit, (name, took)
        try:
            pa.RecordBatch.from_pylist(rows, schema=arrow[name])
        except pdf._ODD:
            pass


def test_hostile_files_cost_little(arrow):
    for name, data in hostile().items():
        try:
            read_all(data, 3.0 if name == "bomb" else 1.5, arrow)
        except AssertionError as e:
            raise AssertionError(name) from e


def test_mutated_files(arrow):
    rng = random.Random(77)
    alphabet = b"0123456789<>[]()/% \nRfn\x00\xff"
    for data in samples():
        for _ in range(12):
            raw = bytearray(data)
            for _ in range(rng.randrange(1, 6)):
                at = rng.randrange(len(raw))
                kind = rng.randrange(4)
                if kind == 0:
                    raw[at] = rng.choice(alphabet)
                elif kind == 1:
                    del raw[at : at + rng.randrange(1, 20)]
                elif kind == 2:
                    raw[at:at] = bytes(rng.choices(alphabet, k=rng.randrange(1, 12)))
                else:
                    raw[at:at] = raw[: rng.randrange(40)]
            read_all(bytes(raw), 1.5, arrow)


def test_lzw_of_very_short_runs():
    for run in ([256], [256, 65]):
        bits = "".join(format(c, "09b") for c in run) * 100_000 + format(66, "09b") + format(257, "09b")
        data = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
        begin = time.perf_counter()
        assert filters.lzw_decode(data) == b"A" * (100_000 * (len(run) - 1)) + b"B" and time.perf_counter() - begin < 2


def test_limits_are_errors():
    with pytest.raises(PdfError, match="deeply"):
        parse_value(Lexer(b"[" * 3000))
    assert parse_value(Lexer(b"[" * 150 + b"]" * 150)) is not None
    with pytest.raises(PdfError, match="decoded"):
        filters.flate_decode(zlib.compress(bytes(filters.MAX_DECODED + 1)))
    with pytest.raises(PdfError, match="decoded"):
        filters.runlength_decode(b"\x81x" * (filters.MAX_DECODED // 128 + 1))
    with pytest.raises(PdfError):
        xref_table(b"xref\n0 9999999999\n0000000007 00000 n \ntrailer << /Size 1 >>", 0)  # the section has swallowed its trailer
    assert xref_stream({b"W": [1, 8, 1], b"Size": 2}, b"\x01" + b"\xff" * 8 + b"\0" + b"\x01" + (5).to_bytes(8, "big") + b"\0") == {1: ("inuse", 5, 0)}
    with pytest.raises(PdfError):
        xref_stream({b"W": [1, 99, 1], b"Size": 2}, b"\x01" * 400)
    assert CMap(ranges=[(0, 9, 65)] * 3).codes() == list(range(10))
    many = CMap(chars={3: "x"}, ranges=[(i, i, 65 + i % 20) for i in range(1000)])
    few = CMap(chars={3: "x"}, ranges=many.ranges[:200])
    assert [many.lookup(c) for c in range(200)] == [few.lookup(c) for c in range(200)] and many.lookup(2000) is None


def test_a_bad_document_costs_its_own_rows(spark):
    bad = hostile()
    rows = [(f"bad {name}", data) for name, data in bad.items()] + [(f"good {i}", data) for i, data in enumerate(samples())] + [("null", None)]
    corpus = Corpus(spark.createDataFrame(rows, "doc_id string, content binary").repartition(3))
    documents = {r.doc_id: r for r in corpus.table("documents").collect()}
    assert len(documents) == len(rows)
    assert all(documents[f"good {i}"].error is None for i in range(len(samples()))) and documents["null"].error.kind == "io"
    assert {"bad no header", "bad empty", "bad header only"} <= {k for k, r in documents.items() if r.error}
    for name in SCHEMAS:
        seen = {r.doc_id for r in corpus.table(name).select("doc_id").distinct().collect()}
        alone = {r.doc_id for r in Corpus(spark.createDataFrame(rows[len(bad) : -1], "doc_id string, content binary")).table(name).select("doc_id").distinct().collect()}
        assert alone <= seen
    strict = Corpus(corpus.files, fail_fast=True)
    with pytest.raises(Exception, match="PdfError"):
        strict.table("raw_pages").collect()


def test_one_pass_gives_the_same_tables(spark):
    rows = list(enumerate([*samples(), b"no pdf", None]))
    corpus = Corpus(spark.createDataFrame(rows, "doc_id bigint, content binary"))
    names = ["documents", "xref_entries", "objects", "page_text", "bookmarks"]
    both = corpus.tables(*names).cache()
    for name in names:
        want = corpus.table(name).collect()
        got = both.where(both["table"] == name).select("doc_id", f"{name}.*").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
