import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import codecs, dates
from quire.functions import geometry as g
from quire.kernel.document import Document
from quire.operators import annotations, pages, search, write
from quire.plans import queries, synth
from quire.sources.pdf import SCHEMAS, Corpus, corpus_stats, from_bytes, read_pdf
from quire.streaming import arrivals

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, oracle, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.SQL:
        pd.testing.assert_frame_equal(ordered(got), ordered(oracle.sql(queries.SQL[name]).df()), check_dtype=False)


def test_contexts_of_every_hit(spark):
    """By a plain scan of long texts with hits at both ends, next to each other and beside wide characters."""
    body = {1: "the" + " x" * 30 + "thethe é the " + "日本 " * 40 + "The end of the", 2: "a the " * 20_000 + "the", 3: "none", 4: None}
    frame = spark.createDataFrame([(k, 1, t) for k, t in body.items() if t], "doc_id bigint, page_num int, text string")
    got = search.search_text(frame, "doc_id", "the", search.SearchOptions(case_sensitive=True)).collect()
    want = [(k, len(t[:i].encode()), t[max(0, i - 41) : i + 43]) for k, t in body.items() if t for i in range(len(t)) if t.startswith("the", i)]
    assert sorted((r.doc_id, r.offset, r.context) for r in got) == sorted(want) and len(want) == 20_006


def test_no_hit_is_left_out(spark, oracle):
    """The registered query has as many rows as the texts have occurrences, not one a document."""
    want = oracle.sql("SELECT CAST(sum(len(regexp_extract_all(text, 'the'))) AS BIGINT) FROM documents").fetchall()[0][0]
    hits = queries.QUERIES["search_contexts"](spark, SF)
    assert hits.count() == want > 5 * hits.select("doc_id").distinct().count()


def corpus(spark) -> Corpus:
    rows = [(1, synth.text_pdf("Hello World\nhello again")), (2, b"broken"), (3, None), (4, synth.pages_pdf(["one", "two hello"])), (5, synth.text_pdf("日本 hello"))]
    return from_bytes(spark.createDataFrame(rows, "doc_id bigint, content binary"))


def test_every_table_of_odd_documents(spark):
    c = corpus(spark)
    for name in SCHEMAS:
        rows = c.table(name).collect()
        assert {r.doc_id for r in rows} <= ({1, 2, 3, 4, 5} if name == "documents" else {1, 4, 5})
    assert {r.doc_id: r.error is None for r in c.table("documents").collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}
    with pytest.raises(Exception, match="no PDF header"):
        Corpus(c.files.where("doc_id = 2"), fail_fast=True).table("page_text").collect()


def test_no_exchange_below_a_table(spark):
    plan = corpus(spark).table("page_text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_search_options(spark):
    c = corpus(spark)
    hits = lambda *a, **k: sorted((r.doc_id, r.page_num, r.match_text, r.offset) for r in search.search(c, *a, **k).collect())
    assert hits("HELLO") == [(1, 1, "Hello", 0), (1, 1, "hello", 12), (4, 2, "hello", 4), (5, 1, "hello", 7)]
    assert hits("hello", search.SearchOptions(case_sensitive=True, max_results=1)) == [(1, 1, "hello", 12), (4, 2, "hello", 4), (5, 1, "hello", 7)]
    assert hits("hello", search.SearchOptions(start_page=2)) == [(4, 2, "hello", 4)] and hits("one", search.SearchOptions(end_page=1)) == [(4, 1, "one", 0)]
    assert hits("wor", search.SearchOptions(whole_word=True)) == [] and hits("wor.d", search.SearchOptions(is_regex=True)) == [(1, 1, "World", 6)]
    assert hits("price: $10.00") == []
    with pytest.raises(ValueError):
        search.compile_pattern("(", search.SearchOptions(is_regex=True))
    assert {r.doc_id: r.matches for r in search.count(c, "hello").collect()} == {1: 2, 4: 1, 5: 1}
    assert {r.doc_id: r.found for r in search.contains(c, "WORLD").collect()} == {1: True, 4: False, 5: False}


@pytest.mark.parametrize("pattern, text, whole, want", [("hello world", "Say Hello World", False, 1), ("the", "the other the", True, 2), (r"price: $10.00", "price: $10.00!", False, 1), ("é", "É", False, 1), (r"a\Eb", r"a\Eb", False, 1)])
def test_patterns_agree(spark, pattern, text, whole, want):
    options = search.SearchOptions(whole_word=whole)
    assert len(search.compile_pattern(pattern, options).findall(text)) == want
    assert spark.createDataFrame([(text,)], "t string").select(search.matches(F.col("t"), pattern, options)).first()[0] == want


def test_files_and_streams(spark, tmp_path):
    c = corpus(spark)
    written = write.write_files(c, str(tmp_path / "out")).collect()
    assert {r.doc_id for r in written} == {1, 2, 4, 5}
    files = read_pdf(spark, str(tmp_path / "out"))
    assert files.table("page_text").count() == 4
    stats = corpus_stats(spark, str(tmp_path / "out")).first()
    assert (stats.files, stats.bytes) == (4, sum(r.bytes for r in written))
    for name, frame, mode in (("hits", arrivals.watch(spark, str(tmp_path / "out"), "hello"), "append"), ("counts", arrivals.arrivals(spark, str(tmp_path / "out")), "complete")):
        stream = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        stream.awaitTermination(120)
    assert sorted(r.matches for r in spark.table("hits").collect()) == [1, 1, 2]
    assert sum(r.files for r in spark.table("counts").collect()) == 4


def png(width: int, height: int, rgb: bytes) -> bytes:
    part = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    rows = b"".join(b"\0" + rgb[i * width * 3 : (i + 1) * width * 3] for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"\x08\x02\0\0\0") + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_image_files(spark, tmp_path):
    rgb = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 8, 7])
    (tmp_path / "a.png").write_bytes(png(2, 2, rgb))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00\xff\xd9")
    (tmp_path / "c.txt").write_bytes(b"no image")
    got = {r.doc_id[-5:]: r for r in annotations.images(write.image_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.png", "b.jpg"} and got["a.png"].decoded == rgb and (got["b.jpg"].width, got["b.jpg"].height, got["b.jpg"].decoded) == (7, 5, None)


def test_edits(spark):
    c = write.edit(corpus(spark), lambda doc, row: doc.create_page((0, 0, 300, 400)))
    assert {r.doc_id: r.page_count for r in pages.page_counts(c).collect()} == {1: 2, 2: None, 3: None, 4: 3, 5: 2}
    with pytest.raises(ValueError):
        pages.get_page(c, 0)
    new = Document(Document.empty().save())
    assert list(new.catalog()) == [b"Type", b"Pages"]


def test_annotation_defaults(spark):
    c = from_bytes(spark.createDataFrame([(1, synth.link_pdf("http://x")), (2, synth.widget_pdf("v", "s"))], "doc_id bigint, content binary"))
    r = annotations.annotations(c).where("doc_id = 1").first()
    assert (r.subtype, r.is_markup, r.flags, r.opacity, r.color, r.quad_points, r.link_uri) == ("Link", False, 0, 1.0, None, None, "http://x")
    assert annotations.images(c).count() == 0 and annotations.bookmarks(c).count() == 0


def test_dates(spark):
    texts = ["D:20231015120000+05'30'", "D:2023", "20231015120000Z", "D:20231315", "D:20", "x", None, "D:20231015120000-08'00'"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", dates.parse_pdf_date(F.col("t")).alias("d"))
    got = {r.i: r for r in rows.select("i", "d", dates.to_pdf_string(F.col("d")).alias("s"), dates.to_timestamp(F.col("d")).alias("ts")).collect()}
    assert got[0].s == texts[0] and str(got[0].ts) == "2023-10-15 06:30:00" and got[1].s == "D:20230101000000Z" and got[2].s == "D:20231015120000Z"
    assert got[3].d.month == 13 and got[3].ts is None and got[4].d is None and got[5].d is None and got[6].d is None and str(got[7].ts) == "2023-10-15 20:00:00"


def test_geometry(spark):
    one = spark.range(1)
    first = lambda c: one.select(c.alias("c")).first().c
    r = g.rect(10.0, 20.0, 110.0, 70.0)
    assert first(g.width(r)) == 100 and first(g.height(r)) == 50 and first(g.contains(r, 10, 70)) and not first(g.contains(r, 9, 30))
    assert first(g.intersect(r, g.rect(200.0, 0.0, 300.0, 10.0))) is None and tuple(first(g.intersect(r, g.rect(110.0, 70.0, 120.0, 80.0)))) == (110, 70, 110, 70)
    assert tuple(first(g.normalize(g.rect(5.0, 6.0, 1.0, 2.0)))) == (1, 2, 5, 6) and tuple(first(g.inflate(r, 1, 2))) == (9, 18, 111, 72)
    turned = g.matrix(*first(g.multiply(g.scale(2.0, 3.0), g.rotation(0.5))))
    m = g.matrix(*first(g.multiply(turned, g.translation(7.0, -4.0))))
    back = first(g.multiply(m, g.matrix(*first(g.inverse(m)))))
    assert all(abs(x - y) < 1e-9 for x, y in zip(back, (1, 0, 0, 1, 0, 0))) and first(g.inverse(g.scale(0.0, 1.0))) is None
    assert tuple(first(g.transform_point(g.translation(1.0, 2.0), g.point(3.0, 4.0)))) == (4, 6)
    assert first(g.quads(F.array(*[F.lit(float(i)) for i in range(17)])))[1].p4.y == 15.0 and first(g.quads(F.array(F.lit(1.0)))) is None


def test_codecs(spark):
    rows = spark.createDataFrame([(b"Hello", b"48 65 6C 6C 6F>"), (b"", b">"), (None, None), (b"\xab\xc0", b"ABC>")], "raw binary, hex binary")
    for r in rows.select("raw", codecs.asciihex_decode(F.col("hex")).alias("d"), codecs.decode_stream(codecs.encode_stream(F.col("raw"), "LZWDecode"), "LZWDecode").alias("t")).collect():
        assert r.d == r.raw and r.t == r.raw
    assert rows.select(codecs.decode_stream(F.lit(b"\xff\xff\xff"), "FlateDecode").alias("d")).where("d is not null").count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
