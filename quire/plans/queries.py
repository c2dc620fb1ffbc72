"""Registered queries of the PDF engine and the SQL that states their results.

Rows of the driver's tables are rendered as PDFs by the writer, read back by the reader, and
compared with what SQL says about the original rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import codecs, dates
from quire.functions import geometry as g
from quire.functions import objects as o_
from quire.functions import text as t
from quire.kernel import edit as kernel_edit
from quire.kernel.cos import Name, dict_of
from quire.kernel.document import Document
from quire.operators import annotations as a
from quire.operators import pages as p
from quire.operators import search as s
from quire.operators import write as w
from quire.plans import handmade, synth
from quire.runtime import shared_folder, ship
from quire.sources import pdf as pdf_source
from quire.sources.pdf import Corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its own name, with its SQL if there is one."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(rows: DataFrame) -> int:
    """Partitions for work by the row, which is heavy however few bytes the rows have."""
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def build(rows: DataFrame, key: str, make: Callable[[dict], bytes]) -> Corpus:
    """One document per row; rows that come from few pieces of a file are first dealt to all cores."""
    plan = rows._jdf.queryExecution()
    if "AdaptiveSparkPlan" not in plan.executedPlan().toString() and plan.toRdd().getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(tasks(rows))
    return w.build(rows, key, make)


def documents(spark: SparkSession, sf_dir: str, make: Callable[[str], bytes]) -> Corpus:
    return build(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", lambda r: make(r["text"] or ""))


def texts(corpus: Corpus) -> DataFrame:
    return corpus.table("page_text").select(corpus.key, "text")


#: What a page shows of a text: line ends never repeat, the end has no white space.
SHOWN = r"rtrim(ltrim(regexp_replace(text, '\n+', chr(10), 'g'), chr(10)), chr(10) || ' ')"


@query(f"SELECT doc_id, {SHOWN} AS text FROM documents")
def text_roundtrip(spark, sf_dir):
    return texts(documents(spark, sf_dir, synth.text_pdf))


@query(f"SELECT doc_id, {SHOWN} AS text FROM documents")
def text_flate(spark, sf_dir):
    return texts(documents(spark, sf_dir, lambda x: synth.text_pdf(x, ["FlateDecode"])))


@query(f"SELECT doc_id, {SHOWN} AS text FROM documents")
def text_filter_chain(spark, sf_dir):
    return texts(documents(spark, sf_dir, lambda x: synth.text_pdf(x, ["ASCII85Decode", "FlateDecode"])))


@query(f"SELECT doc_id, {SHOWN} AS text FROM documents")
def text_lzw(spark, sf_dir):
    return texts(documents(spark, sf_dir, lambda x: synth.text_pdf(x, ["LZWDecode"])))


@query(f"SELECT doc_id, {SHOWN} AS text FROM documents")
def text_predicted(spark, sf_dir):
    return texts(documents(spark, sf_dir, synth.predicted_text_pdf))


@query(f"SELECT doc_id, {SHOWN} AS text FROM documents")
def text_cid_cmap(spark, sf_dir):
    return texts(documents(spark, sf_dir, synth.cid_pdf))


@query(f"SELECT doc_id, {SHOWN} AS text FROM documents")
def text_multistream(spark, sf_dir):
    return texts(documents(spark, sf_dir, synth.multistream_pdf))


@query(f"SELECT doc_id, {SHOWN} AS text FROM documents")
def text_spaced(spark, sf_dir):
    return texts(documents(spark, sf_dir, synth.spaced_pdf))


@query("SELECT turn, role || ': ' || conv_id AS text, conv_id FROM conversations")
def page_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role").alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    made = build(rows, "conv_id", lambda r: synth.pages_pdf([f"{x['role']}: {r['conv_id']}" for x in r["xs"]]))
    turns = rows.select("conv_id", F.posexplode("xs").alias("i", "x")).select("conv_id", (F.col("i") + 1).alias("page_num"), "x.turn")
    return made.table("page_text").join(turns, ["conv_id", "page_num"]).select("conv_id", "turn", "text")


@query("SELECT conv_id, count(*) AS pages, count(*) AS stated FROM conversations GROUP BY conv_id")
def page_count(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    return p.page_counts(build(rows, "conv_id", lambda r: synth.pages_pdf(r["roles"]))).select("conv_id", F.col("page_count").alias("pages"), F.col("stated_page_count").alias("stated"))


@query("SELECT doc_id, '1.7' AS version, CAST(1 AS BIGINT) AS pages, FALSE AS broken FROM documents")
def doc_scan(spark, sf_dir):
    d = documents(spark, sf_dir, synth.text_pdf).table("documents")
    return d.select("doc_id", F.col("header_version").alias("version"), F.col("page_count").alias("pages"), F.col("error").isNotNull().alias("broken"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'parse' WHEN 2 THEN 'xref' WHEN 3 THEN 'xref' WHEN 4 THEN 'parse' WHEN 5 THEN 'object' END AS error_kind, CAST(CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS texts FROM documents")
def broken_documents(spark, sf_dir):
    """Damaged files, among them sections of billions of entries and thousands of open brackets, cost their own rows only."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = build(rows, "doc_id", lambda r: handmade.broken(r["doc_id"] % 6, r["text"] or "")).tables("documents", "page_text")
    return made.groupBy("doc_id").agg(F.max("documents.error.kind").alias("error_kind"), F.count("page_text").alias("texts"))


def _boxed(spark, sf_dir) -> Corpus:
    return build(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", lambda r: synth.boxed_pdf(r["p_partkey"], r["p_size"]))


_BOXES = """
WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, CAST(90 * (p_partkey % 4) AS INTEGER) AS r FROM part),
x AS (SELECT p_partkey, 1 AS page_num, r, 0.0 AS x1, 0.0 AS y1, 100 + s AS x2, 200 + s AS y2, 1.0 AS unit FROM b
      UNION ALL SELECT p_partkey, 2, r, 10.0, 20.0, 50.5 + s, 60.25 + s, 2.0 FROM b)
"""


@query(_BOXES + """
SELECT p_partkey, CAST(page_num AS INTEGER) AS page_num, r AS rotation, CASE WHEN r IN (90, 270) THEN y2 - y1 ELSE x2 - x1 END AS width,
       CASE WHEN r IN (90, 270) THEN x2 - x1 ELSE y2 - y1 END AS height, CAST(unit AS DOUBLE) AS user_unit, CAST(x1 AS DOUBLE) AS crop_x1, CAST(y2 AS DOUBLE) AS crop_y2 FROM x
""")  # fmt: skip
def page_boxes(spark, sf_dir):
    return p.pages(_boxed(spark, sf_dir)).select("p_partkey", "page_num", "rotation", "width", "height", "user_unit", F.col("crop_box.x1").alias("crop_x1"), F.col("trim_box.y2").alias("crop_y2"))


@query(_BOXES + """
, m AS (SELECT *, CASE r WHEN 0 THEN [1, 0, 0, 1, 0, 0] WHEN 90 THEN [0, -1, 1, 0, 0, x2 - x1] WHEN 180 THEN [-1, 0, 0, -1, x2 - x1, y2 - y1] ELSE [0, 1, -1, 0, y2 - y1, 0] END AS q FROM x)
SELECT p_partkey, CAST(page_num AS INTEGER) AS page_num, CAST(q[1] AS DOUBLE) AS a, CAST(q[2] AS DOUBLE) AS b, CAST(q[5] - x1 AS DOUBLE) AS h, CAST(q[6] - y1 AS DOUBLE) AS v FROM m
""")  # fmt: skip
def default_matrix(spark, sf_dir):
    m = F.col("default_matrix")
    return p.pages(_boxed(spark, sf_dir)).select("p_partkey", "page_num", (m["a"] + 0.0).alias("a"), (m["b"] + 0.0).alias("b"), m["h"].alias("h"), m["v"].alias("v"))


@query("SELECT p_partkey, CAST(2 AS INTEGER) AS page_num FROM part")
def get_page(spark, sf_dir):
    return p.get_page(_boxed(spark, sf_dir), 2).select("p_partkey", "page_num")


@query("SELECT page_id, url AS title, 'page ' || page_id AS author, CAST(NULL AS VARCHAR) AS subject FROM pages")
def doc_info(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    return build(rows, "page_id", lambda r: synth.info_pdf(Title=r["url"], Author=f"page {r['page_id']}")).table("doc_info").select("page_id", "title", "author", "subject")


def _forms(spark, sf_dir) -> Corpus:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return build(rows, "c_custkey", lambda r: synth.customer_form_pdf(r["c_name"], r["c_acctbal"], r["c_mktsegment"], r["c_custkey"]))


@query("""
SELECT c_custkey, CAST(0 AS INTEGER) AS seq, 'customer.name' AS name, 'Text' AS type, c_name AS value, TRUE AS is_required, FALSE AS is_combo, CAST(40 AS BIGINT) AS max_length, CAST(0 AS BIGINT) AS justification FROM customer
UNION ALL SELECT c_custkey, 2, 'customer.segment', 'Choice', c_mktsegment, FALSE, TRUE, -1, 0 FROM customer
UNION ALL SELECT c_custkey, 3, 'active', 'CheckBox', CASE WHEN c_custkey % 2 = 1 THEN 'Yes' ELSE 'Off' END, FALSE, FALSE, -1, 0 FROM customer
""")
def form_fields(spark, sf_dir):
    f = a.form_fields(_forms(spark, sf_dir)).where("name <> 'customer.balance'")
    return f.select("c_custkey", "seq", "name", "type", "value", "is_required", "is_combo", F.coalesce("max_length", F.lit(-1)).alias("max_length"), "justification")


@query("SELECT c_custkey, 'customer.balance' AS name, c_acctbal AS balance, CAST(2 AS BIGINT) AS justification FROM customer")
def form_numbers(spark, sf_dir):
    f = a.form_fields(_forms(spark, sf_dir)).where("name = 'customer.balance'")
    return f.select("c_custkey", "name", F.col("value").cast("double").alias("balance"), "justification")


@query("SELECT c_custkey, array_to_string(['AUTOMOBILE', 'BUILDING', c_mktsegment], '|') AS options, 'BUILDING' AS default_value, 'COMBO' AS flags FROM customer")
def field_options(spark, sf_dir):
    f = a.form_fields(_forms(spark, sf_dir)).where("partial_name = 'segment'")
    return f.select("c_custkey", F.array_join("options", "|").alias("options"), "default_value", F.array_join("flag_names", "|").alias("flags"))


@query("""
SELECT c_custkey, 'name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'active', 'Yes' FROM customer WHERE c_custkey % 2 = 1
""")
def form_values(spark, sf_dir):
    return _forms(spark, sf_dir).table("form_values").select("c_custkey", "name", "value")


@query("SELECT c_custkey, 'Text' AS type, c_name AS value FROM customer")
def find_field(spark, sf_dir):
    return a.find_field(_forms(spark, sf_dir), "customer.name").select("c_custkey", "type", "value")


@query("SELECT c_custkey, CAST(4 AS BIGINT) AS fields FROM customer")
def field_count(spark, sf_dir):
    return a.field_count(_forms(spark, sf_dir))


@query("""
SELECT c_custkey, 'name' AS partial_name, upper(c_name) AS value FROM customer UNION ALL SELECT c_custkey, 'segment', NULL FROM customer
UNION ALL SELECT c_custkey, 'active', CASE WHEN c_custkey % 2 = 1 THEN 'Off' ELSE 'Yes' END FROM customer
""")
def form_edit(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    made = build(rows, "c_custkey", lambda r: synth.customer_form_pdf(r["c_name"], r["c_acctbal"], r["c_mktsegment"], r["c_custkey"]))

    def shout(doc, row):
        """The name in capitals, the segment cleared, the check box turned over."""
        for num in doc.numbers():
            d = dict_of(doc.get(num))
            if d.get(b"T") == b"name":
                kernel_edit.set_field(doc, num, d[b"V"].decode().upper())
            elif d.get(b"T") == b"segment":
                kernel_edit.set_field(doc, num, None)
            elif d.get(b"T") == b"active":
                kernel_edit.set_field(doc, num, Name(b"Off" if d[b"V"] == b"Yes" else b"Yes"))

    return w.edit(made, shout).table("raw_fields").select("c_custkey", "partial_name", "value").where("partial_name <> 'balance'")


#: Customers of an outline: one document lists those whose keys share all but these last digits.
_LISTED = 1000


def _outlines(spark, sf_dir) -> Corpus:
    """A document for each nation and thousand of customer keys, so that no document grows with the corpus."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.expr(f"c_custkey div {_LISTED}").alias("part")).agg(F.sort_array(F.collect_list("c_name")).alias("customers"))
    rows = people.join(table(spark, sf_dir, "nation"), "n_nationkey").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.concat_ws("/", "n_nationkey", "part").alias("outline"), "r_name", "n_name", "customers")
    return build(rows, "outline", lambda r: synth.region_outline_pdf(r["r_name"], [r]))


_OUTLINE = f"""
WITH p AS (SELECT n_nationkey || '/' || (c_custkey // {_LISTED}) AS outline, r_name, n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT DISTINCT outline, r_name AS title, 0 AS depth, '' AS c FROM p UNION ALL SELECT DISTINCT outline, n_name, 1, '' FROM p UNION ALL SELECT outline, c_name, 2, c_name FROM p)
"""


@query(_OUTLINE + "SELECT outline, CAST(row_number() OVER (PARTITION BY outline ORDER BY depth, c) - 1 AS INTEGER) AS seq, CAST(depth AS INTEGER) AS depth, title FROM o")
def outline_dfs(spark, sf_dir):
    return a.bookmarks(_outlines(spark, sf_dir)).select("outline", "seq", "depth", "title")


@query(_OUTLINE + "SELECT outline, CAST(depth AS INTEGER) AS depth, count(*) AS items, 'XYZ' AS fit, CAST(1 AS INTEGER) AS page_num FROM o GROUP BY outline, depth")
def outline_pages(spark, sf_dir):
    return a.bookmark_pages(_outlines(spark, sf_dir)).groupBy("outline", "depth", "fit", "page_num").agg(F.count("*").alias("items"))


@query("SELECT page_id, url AS uri FROM pages")
def link_uris(spark, sf_dir):
    return a.links(build(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", lambda r: synth.link_pdf(r["url"] or ""))).select("page_id", "uri")


@query("""
SELECT page_id, 'annotation' AS owner, CAST(0 AS INTEGER) AS seq, 'URI' AS action, url AS target FROM pages UNION ALL SELECT page_id, 'annotation', 1, 'JavaScript', 'alert(' || page_id || ')' FROM pages
UNION ALL SELECT page_id, 'annotation', 2, 'Named', 'NextPage' FROM pages UNION ALL SELECT page_id, 'bookmark', 0, 'GoTo', 'FitH 700' FROM pages
""")
def actions(spark, sf_dir):
    made = build(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", lambda r: synth.actions_pdf(r["url"] or "", f"alert({r['page_id']})"))
    target = F.coalesce("uri", "javascript", "named", F.concat_ws(" ", "fit", F.get("coords", F.lit(0)).cast("int").cast("string")))
    return made.table("actions").select("page_id", "owner", "seq", "action", target.alias("target"))


def _marked(spark, sf_dir) -> Corpus:
    cols = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *cols)
    rows = items.repartition(tasks(items), "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("lines"))
    return build(rows, "l_orderkey", lambda r: synth.marked_pdf(r["lines"]))


@query("""
SELECT ['Highlight', 'Underline', 'StrikeOut', 'Link', 'Square'][l_linenumber % 5 + 1] AS subtype, l_linenumber % 5 <> 3 AS is_markup, count(*) AS n, CAST(sum((l_linenumber + 4) // 4 % 2) AS BIGINT) AS printed
FROM lineitem GROUP BY 1, 2
""")
def annots_by_type(spark, sf_dir):
    n = a.annotations(_marked(spark, sf_dir))
    return n.groupBy("subtype", "is_markup").agg(F.count("*").alias("n"), F.sum(a.has_flag(F.col("flags"), 2).cast("bigint")).alias("printed"))


@query("""
SELECT l_orderkey, count(*) AS annots, round(sum(l_linenumber * 2.0 * l_linenumber), 2) AS area, min(l_quantity) AS x1, max(l_extendedprice + 2.0 * l_linenumber) AS y2,
       round(max(l_discount), 4) AS red, round(min(l_tax), 4) AS opacity FROM lineitem GROUP BY l_orderkey
""")
def annot_rects(spark, sf_dir):
    n = a.annotations(_marked(spark, sf_dir))
    box = g.union_agg(F.col("rect"))
    area = F.round(F.sum(F.round(g.width(F.col("rect")), 6) * F.round(g.height(F.col("rect")), 6)), 2)
    out = n.groupBy("l_orderkey").agg(F.count("*").alias("annots"), area.alias("area"), box.alias("box"), F.round(F.max("color.c0"), 4).alias("red"), F.round(F.min("opacity"), 4).alias("opacity"))
    return out.select("l_orderkey", "annots", "area", F.col("box.x1").alias("x1"), F.col("box.y2").alias("y2"), "red", "opacity")


@query("SELECT l_orderkey, 2 * count(*) AS quads, round(sum(2 * (l_quantity + 1)), 2) AS right_edges FROM lineitem GROUP BY l_orderkey")
def quad_points(spark, sf_dir):
    quads = a.annotations(_marked(spark, sf_dir)).select("l_orderkey", F.explode("quad_points").alias("q"))
    return quads.groupBy("l_orderkey").agg(F.count("*").alias("quads"), F.round(F.sum("q.p2.x"), 2).alias("right_edges"))


@query("SELECT doc_id, 'Img0' AS name, CAST(strlen(text) AS BIGINT) AS width, CAST(1 AS BIGINT) AS height, CAST(1 AS INTEGER) AS components, md5(text) AS pixels FROM documents")
def images(spark, sf_dir):
    i = a.images(documents(spark, sf_dir, lambda x: synth.image_pdf(x.encode())))
    return i.select("doc_id", "name", "width", "height", "components", F.md5("decoded").alias("pixels"))


@query("SELECT o_orderkey, o_orderstatus || '/new' AS title, 'writer' AS author, CAST(2 AS BIGINT) AS sections FROM orders")
def xref_newest_wins(spark, sf_dir):
    """Sections and metadata from one parse of each file."""
    made = build(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", lambda r: synth.revised_pdf(r["o_orderstatus"], r["o_orderstatus"] + "/new"))
    both = made.tables("xref_entries", "doc_info").groupBy("o_orderkey")
    return both.agg(F.max("doc_info.title").alias("title"), F.max("doc_info.author").alias("author"), F.size(F.collect_set("xref_entries.section")).cast("bigint").alias("sections"))


@query("SELECT o_orderkey, CAST(3 AS BIGINT) AS in_use, CAST(1 AS BIGINT) AS replaced FROM orders")
def xref_merge(spark, sf_dir):
    """The newest entry of each object, by a window over the sections."""
    made = build(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", lambda r: synth.revised_pdf(r["o_orderstatus"], "x"))
    entries = made.table("xref_entries").where("kind = 'inuse'")
    newest = entries.groupBy("o_orderkey", "obj_num").agg(F.min("section").alias("section"), F.count("*").alias("n"))
    return newest.groupBy("o_orderkey").agg(F.count("*").alias("in_use"), F.sum((F.col("n") > 1).cast("bigint")).alias("replaced"))


@query("SELECT n_nationkey, n_name AS text, CAST(4 AS BIGINT) AS members FROM nation")
def objstm_expand(spark, sf_dir):
    made = build(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", lambda r: synth.compressed_pdf(r["n_name"]))
    both = made.tables("page_text", "objects").groupBy("n_nationkey")
    return both.agg(F.max("page_text.text").alias("text"), F.count(F.when(F.col("objects.origin") == "objstm", 1)).alias("members"))


@query("SELECT n_nationkey, n_name AS text, CAST(0 AS BIGINT) AS boxes FROM nation")
def save_rewrites(spark, sf_dir):
    made = w.save(build(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", lambda r: synth.compressed_pdf(r["n_name"])))
    both = made.tables("page_text", "objects").groupBy("n_nationkey")
    return both.agg(F.max("page_text.text").alias("text"), F.count(F.when(F.col("objects.type_name").isin("ObjStm", "XRef"), 1)).alias("boxes"))


@query("SELECT o_orderkey, o_orderstatus AS title, o_orderpriority AS subject FROM orders")
def overlay_save(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    made = build(rows, "o_orderkey", lambda r: synth.info_pdf(Title=r["o_orderstatus"], Keywords=r["o_orderpriority"]))

    def change(doc, row):
        num = doc.trailer[b"Info"].num
        doc.update(num, doc.get(num) | {b"Subject": doc.get(num)[b"Keywords"]})

    return w.edit(made, change).table("doc_info").select("o_orderkey", "title", "subject")


@query("SELECT s_suppkey, CAST(2 AS BIGINT) AS pages, CAST(300 AS DOUBLE) AS width FROM supplier")
def create_page(spark, sf_dir):
    made = build(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", lambda r: synth.text_pdf(r["s_name"]))
    added = w.edit(made, lambda doc, row: doc.create_page((0, 0, 300, 400)))
    return p.pages(added).groupBy("s_suppkey").agg(F.count("*").alias("pages"), F.max_by("width", "page_num").alias("width"))


@query("SELECT s_suppkey, s_name AS text, 'Stamp' AS image FROM supplier")
def add_image(spark, sf_dir):
    made = build(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", lambda r: synth.text_pdf(r["s_name"]))

    def stamp(doc, row):
        page = next(n for n in doc.numbers() if dict_of(doc.get(n)).get(b"Type") == b"Page")
        kernel_edit.add_image(doc, page, kernel_edit.raw_image(doc, bytes(12), 2, 2), (0, 0, 10, 10), "Stamp")

    both = w.edit(made, stamp).tables("page_text", "images").groupBy("s_suppkey")
    return both.agg(F.max("page_text.text").alias("text"), F.max(F.when(F.col("images.name") == "Stamp", F.col("images.name"))).alias("image"))


@query("SELECT doc_id, 'Img0' AS name, md5(text) AS pixels FROM documents")
def find_image(spark, sf_dir):
    found = a.find_image(documents(spark, sf_dir, lambda x: synth.image_pdf(x.encode())), "Img0")
    return found.select("doc_id", "name", F.md5("decoded").alias("pixels"))


@query("""
SELECT p_partkey, CAST(17 AS BIGINT) AS ops, CAST(2 AS INTEGER) AS deepest, CAST(p_size / 2.0 AS DOUBLE) AS line_width, CAST(p_size AS DOUBLE) AS moved, 'Span' AS tag, 'x' AS inline_image, CAST(1 AS BIGINT) AS unknown FROM part
""")
def content_ops(spark, sf_dir):
    ops = build(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", lambda r: synth.drawing_pdf(r["p_size"])).table("content_ops")
    pick = lambda name, value: F.max(F.when(F.col("op") == name, value))
    return ops.groupBy("p_partkey").agg(
        F.count("*").alias("ops"), F.max("depth").alias("deepest"), pick("w", F.get("nums", F.lit(0))).alias("line_width"), pick("cm", F.get("nums", F.lit(4))).alias("moved"),
        pick("BDC", F.get("names", F.lit(0))).alias("tag"), pick("BI", F.col("data").cast("string")).alias("inline_image"), F.sum((F.col("op") == "xx").cast("bigint")).alias("unknown"),
    )


@query("SELECT doc_id, 'Type0' AS font_type, TRUE AS has_tounicode, CAST(600 AS DOUBLE) AS first_width, CAST(length(list_aggregate(list_distinct(string_split(replace(text, chr(10), ''), '')), 'string_agg', '')) AS BIGINT) AS mapped FROM documents")
def fonts(spark, sf_dir):
    f = documents(spark, sf_dir, synth.cid_pdf).table("fonts")
    return f.select("doc_id", "font_type", "has_tounicode", F.try_element_at("widths", F.lit(256)).alias("first_width"), F.size("cmap").cast("bigint").alias("mapped"))


@query("SELECT s_suppkey, 'Catalog' AS root_type, CAST(1 AS BIGINT) AS kids FROM supplier")
def object_graph(spark, sf_dir):
    """Reference to object by an equi-join on (document, number), values read through VARIANT paths."""
    made = build(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", lambda r: synth.text_pdf(r["s_name"]))
    objects = made.objects()
    roots = made.table("trailers").select("s_suppkey", F.col("root_num").alias("obj_num"))
    catalog = objects.join(roots, ["s_suppkey", "obj_num"]).select("s_suppkey", F.col("type_name").alias("root_type"), F.try_variant_get("v", "$.d.Pages.r[0]", "bigint").alias("obj_num"))
    pages = objects.select("s_suppkey", "obj_num", F.try_variant_get("v", "$.d.Count.i", "bigint").alias("kids"))
    return catalog.join(pages, ["s_suppkey", "obj_num"]).select("s_suppkey", "root_type", "kids")


@query("SELECT kind, count(*) * n AS objects FROM supplier, (VALUES ('dict', 4), ('stream', 1)) AS k(kind, n) GROUP BY kind, n")
def object_kinds(spark, sf_dir):
    made = build(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", lambda r: synth.text_pdf(r["s_name"]))
    return made.objects(False).groupBy("kind").agg(F.count("*").alias("objects"))


@query("SELECT s_suppkey, s_name || chr(10) || 'shown ' || s_suppkey AS text FROM supplier")
def widget_text(spark, sf_dir):
    made = build(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", lambda r: synth.widget_pdf(r["s_name"], f"shown {r['s_suppkey']}"))
    return made.table("page_text").select("s_suppkey", "text")


# Search.


def _shown(spark, sf_dir) -> Corpus:
    return documents(spark, sf_dir, synth.text_pdf)


def _by_page(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("offset").alias("first_offset"))


def _search_sql(pattern: str, where: str = "hits > 0") -> str:
    found = f"CAST(len(regexp_extract_all(t, '{pattern}')) AS BIGINT)"
    cut = f"CAST(strlen(regexp_extract(t, '(?s)^(.*?)(?:{pattern})', 1)) AS BIGINT)"
    return f"WITH d AS (SELECT doc_id, {SHOWN} AS t FROM documents), h AS (SELECT doc_id, {found} AS hits, {cut} AS first_offset FROM d) SELECT doc_id, hits, first_offset FROM h WHERE {where}"


@query(_search_sql("(?i)the"))
def search_literal(spark, sf_dir):
    return _by_page(s.search(_shown(spark, sf_dir), "THE"))


@query(_search_sql("The"))
def search_case(spark, sf_dir):
    return _by_page(s.search(_shown(spark, sf_dir), "The", s.SearchOptions(case_sensitive=True)))


@query(_search_sql("(?i)[0-9]{3}[ -][0-9]{4}"))
def search_regex(spark, sf_dir):
    return _by_page(s.search_regex(_shown(spark, sf_dir), r"[0-9]{3}[ -][0-9]{4}"))


@query(r"""
WITH c AS (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(t, '(?i)\bthe\b')) AS BIGINT) AS hits FROM c WHERE len(regexp_extract_all(t, '(?i)\bthe\b')) > 0
""")
def search_word(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("text"))
    made = build(rows, "doc_id", lambda r: synth.text_pdf(r["text"] or ""))
    return s.search(made, "the", s.SearchOptions(whole_word=True)).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query(f"WITH d AS (SELECT doc_id, {SHOWN} AS t FROM documents) SELECT doc_id, least(2, len(regexp_extract_all(t, '(?i)en'))) AS hits FROM d WHERE len(regexp_extract_all(t, '(?i)en')) > 0")
def search_limit(spark, sf_dir):
    return s.search(_shown(spark, sf_dir), "en", s.SearchOptions(max_results=2)).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query(f"""
WITH d AS (SELECT doc_id, {SHOWN} AS t FROM documents), p AS (SELECT doc_id, t, string_split(t, 'the') AS parts FROM d WHERE t <> ''),
b AS (SELECT doc_id, t, unnest(list_transform(range(1, len(parts)), lambda k: array_to_string(parts[1:k], 'the'))) AS before FROM p)
SELECT doc_id, 'the' AS match_text, CAST(strlen(before) AS BIGINT) AS "offset",
       substr(t, greatest(0, len(before) - 41) + 1, len(before) - greatest(0, len(before) - 41) + 43) AS context FROM b
""")
def search_contexts(spark, sf_dir):
    """Offset and context of every hit."""
    hits = s.search(_shown(spark, sf_dir), "the", s.SearchOptions(case_sensitive=True))
    return hits.select("doc_id", "match_text", "offset", "context")


@query(f"WITH d AS (SELECT doc_id, {SHOWN} AS t FROM documents) SELECT doc_id, CAST(len(regexp_extract_all(t, '(?i)tion')) AS BIGINT) AS matches FROM d WHERE t <> ''")
def search_count(spark, sf_dir):
    return s.count(_shown(spark, sf_dir), "tion")


@query(f"WITH d AS (SELECT doc_id, {SHOWN} AS t FROM documents) SELECT doc_id, regexp_matches(t, '(?i)license') AS found FROM d WHERE t <> ''")
def search_contains(spark, sf_dir):
    return s.contains(_shown(spark, sf_dir), "License")


@query(f"""
WITH d AS (SELECT lang, source, len(regexp_extract_all({SHOWN}, '(?i)the')) AS n FROM documents)
SELECT lang, source, CAST(sum(n) AS BIGINT) AS matches, count(*) AS docs FROM d GROUP BY ROLLUP (lang, source)
""")
def search_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = s.count(documents(spark, sf_dir, synth.text_pdf), "the")
    return docs.select("doc_id", "lang", "source").join(hits, "doc_id", "left").rollup("lang", "source").agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"), F.count("*").alias("docs"))


@query("SELECT CAST(3 AS BIGINT) + count(*) AS files, CAST(7 * 3 + 2 * sum(strlen(n_name)) AS BIGINT) AS bytes FROM nation")
def corpus_stats(spark, sf_dir):
    """Files and bytes below a folder; three of them lie deeper."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.concat("n_name", "n_name").cast("binary").alias("content"))
    folder = shared_folder(spark)
    w.write_files(Corpus(rows, "key"), folder).count()
    w.write_files(Corpus(spark.range(3).select(F.col("id").alias("key"), F.lit("1234567").cast("binary").alias("content")), "key"), f"{folder}/deeper/still").count()
    return pdf_source.corpus_stats(spark, folder)


@query("SELECT s_suppkey, s_name || chr(10) || s_nationkey AS text, '1.7' AS version FROM supplier")
def file_roundtrip(spark, sf_dir):
    """Documents written as files and read back by path."""
    folder = shared_folder(spark)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("\n", "s_name", F.col("s_nationkey").cast("string")).alias("text"))
    w.write_files(build(rows, "s_suppkey", lambda r: synth.text_pdf(r["text"])), folder).count()
    both = pdf_source.read_pdf(spark, folder).tables("documents", "page_text").groupBy("path")
    read = both.agg(F.max("page_text.text").alias("text"), F.max("documents.header_version").alias("version"))
    return read.select(F.regexp_extract("path", r"([0-9]+)\.pdf$", 1).cast(table(spark, sf_dir, "supplier").schema["s_suppkey"].dataType).alias("s_suppkey"), "text", "version")


# Scalars.


@query("""
SELECT event_id, strftime(ts, 'D:%Y%m%d%H%M%SZ') AS text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed, CAST(year(ts) AS INTEGER) AS year, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS shifted FROM events
""")
def pdf_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "'D:'yyyyMMddHHmmss").alias("head"))
    e = e.withColumn("d", dates.parse_pdf_date(F.concat("head", F.lit("Z")))).withColumn("o", dates.parse_pdf_date(F.concat("head", F.lit("+05'30'"))))
    shown = lambda c: F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), dates.to_timestamp(c).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", dates.to_pdf_string(F.col("d")).alias("text"), shown(F.col("d")).alias("parsed"), F.col("d.year").alias("year"), shown(F.col("o")).alias("shifted"))


def _rects(spark, sf_dir) -> DataFrame:
    one = g.rect(F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice"), F.col("l_discount"))
    two = g.rect(F.lit(10.0), F.lit(0.0), F.lit(2000.0), F.lit(0.05))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", one.alias("r"), two.alias("q"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, least(l_quantity, l_extendedprice) AS x1, least(l_tax, l_discount) AS y1, greatest(l_quantity, l_extendedprice) AS x2, greatest(l_tax, l_discount) AS y2 FROM lineitem)
SELECT l_orderkey, l_linenumber, x2 - x1 AS width, 20.0 BETWEEN x1 AND x2 AND 0.03 BETWEEN y1 AND y2 AS has_point,
       CASE WHEN greatest(x1, 10) <= least(x2, 2000) AND greatest(y1, 0) <= least(y2, 0.05) THEN least(x2, 2000) END AS common_x2, greatest(x2, 2000) AS union_x2, x1 - 1 AS inflated_x1 FROM r
""")
def rect_ops(spark, sf_dir):
    r = _rects(spark, sf_dir).withColumn("n", g.normalize(F.col("r")))
    n, q = F.col("n"), F.col("q")
    return r.select("l_orderkey", "l_linenumber", g.width(n).alias("width"), g.contains(n, 20.0, 0.03).alias("has_point"), g.intersect(n, q)["x2"].alias("common_x2"), g.union(n, q)["x2"].alias("union_x2"), g.inflate(n, 1.0, 1.0)["x1"].alias("inflated_x1"))


@query("SELECT l_returnflag, min(l_quantity) AS x1, min(l_tax) AS y1, max(l_extendedprice) AS x2, max(l_discount) AS y2 FROM lineitem GROUP BY l_returnflag")
def bbox_agg(spark, sf_dir):
    return _rects(spark, sf_dir).groupBy("l_returnflag").agg(g.union_agg(F.col("r")).alias("b")).select("l_returnflag", "b.*")


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b, l_discount AS c, 1 + l_tax AS d, l_linenumber * 1.0 AS h, 5.0 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a * d - b * c, 6) AS det, round(a * 2 + c * 3 + h, 6) AS px, round(b * 2 + d * 3 + v, 6) AS py, CAST(2 AS DOUBLE) AS back_x, round(3 * a, 6) AS scaled_a FROM m
""")
def matrix_ops(spark, sf_dir):
    m = g.matrix(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), 1 + F.col("l_tax"), F.col("l_linenumber"), F.lit(5.0))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m.alias("m")).withColumn("p", g.transform_point(F.col("m"), g.point(2.0, 3.0)))
    back = g.transform_point(g.inverse(F.col("m")), F.col("p"))
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(g.determinant(F.col("m")), 6).alias("det"), F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"), F.round(back["x"], 6).alias("back_x"),
        F.round(g.multiply(g.scale(3.0, 1.0), F.col("m"))["a"], 6).alias("scaled_a"),
    )


@query("SELECT doc_id, hex(encode(text)) || '>' AS encoded, md5(text) AS decoded FROM documents")
def hex_codec(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", codecs.asciihex_encode(F.col("text").cast("binary")).alias("e"))
    return d.select("doc_id", F.col("e").cast("string").alias("encoded"), F.md5(codecs.asciihex_decode(F.col("e"))).alias("decoded"))


@query("SELECT doc_id, md5(text) AS flate, md5(text) AS ascii85, md5(text) AS lzw, md5(text) AS runlength, md5(text) AS chain FROM documents")
def codec_roundtrips(spark, sf_dir):
    data = F.col("text").cast("binary")
    trip = lambda names: F.md5(codecs.decode_stream(codecs.encode_stream(data, names), names))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", trip("FlateDecode").alias("flate"), trip("ASCII85Decode").alias("ascii85"), trip("LZWDecode").alias("lzw"), trip("RunLengthDecode").alias("runlength"), trip("ASCIIHexDecode+FlateDecode").alias("chain"))


@query("SELECT doc_id, md5(rpad(t, CAST(ceil(length(t) / 48.0) * 48 AS INTEGER), ' ')) AS png_sub, md5(rpad(t, CAST(ceil(length(t) / 48.0) * 48 AS INTEGER), ' ')) AS png_up, md5(rpad(t, CAST(ceil(length(t) / 48.0) * 48 AS INTEGER), ' ')) AS tiff FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents)")
def predictors(spark, sf_dir):
    plain = F.regexp_replace("text", "[^ -~]", "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.rpad(plain, (F.ceil(F.length(plain) / 48) * 48).cast("int"), " ").cast("binary").alias("d"))
    trip = lambda kind, colors: F.md5(codecs.undo_predictor(codecs.apply_predictor(F.col("d"), kind, 48 // colors, colors), kind, 48 // colors, colors))
    return d.select("doc_id", trip("sub", 1).alias("png_sub"), trip("up", 3).alias("png_up"), trip("tiff", 3).alias("tiff"))


@query("SELECT doc_id, md5(text) AS utf16, md5(text) AS utf8_mark, md5(text) AS latin, md5(text) AS lossy FROM documents")
def text_decoding(spark, sf_dir):
    text = F.col("text")
    marked = F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))
    utf8 = F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary"))
    d = table(spark, sf_dir, "documents")
    md5 = lambda c: F.md5(c.cast("binary"))
    return d.select("doc_id", md5(t.decode_plain_text(marked)).alias("utf16"), md5(t.decode_info_text(utf8)).alias("utf8_mark"), md5(t.decode_field_text(F.encode(text, "ISO-8859-1"))).alias("latin"), md5(t.decode_lossy_utf8(text.cast("binary"))).alias("lossy"))


@query("""
SELECT p_partkey, CAST(2 AS INTEGER) AS depth, CAST(p_size AS DOUBLE) AS moved, CAST(1 AS DOUBLE) AS width_before, CAST(p_size / 2.0 AS DOUBLE) AS width_after, 'DeviceRGB' AS stroke_space, CAST(0.5 AS DOUBLE) AS fill_gray FROM part
""")
def graphics_states(spark, sf_dir):
    states = build(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", lambda r: synth.drawing_pdf(r["p_size"])).table("graphics_states")
    at = lambda op, value: F.max(F.when(F.col("op") == op, value))
    return states.groupBy("p_partkey").agg(
        at("S", F.col("depth")).alias("depth"), at("S", F.get("ctm", F.lit(4))).alias("moved"), at("S", F.col("line_width")).alias("width_before"), at("xx", F.col("line_width")).alias("width_after"),
        at("S", F.col("stroke_space")).alias("stroke_space"), at("S", F.get("fill_color", F.lit(0))).alias("fill_gray"),
    )


@query("SELECT c_custkey, c_name AS name, floor(c_acctbal) + CASE WHEN c_acctbal < 0 AND c_acctbal <> floor(c_acctbal) THEN 1 ELSE 0 END AS whole, c_acctbal AS balance, CAST(3 AS INTEGER) AS options, TRUE AS is_name, FALSE AS is_null FROM customer")
def object_access(spark, sf_dir):
    """Typed access to values of the object table through VARIANT paths."""
    o = _forms(spark, sf_dir).objects().select("c_custkey", o_.as_text(o_.member(F.col("v"), "T")).alias("t"), "v")
    value, pick = o_.member(F.col("v"), "V"), lambda t, c: F.max(F.when(F.col("t") == t, c))
    return o.groupBy("c_custkey").agg(
        pick("name", o_.as_text(value)).alias("name"), pick("balance", o_.as_i64(value)).cast("double").alias("whole"), pick("balance", o_.as_f64(value)).alias("balance"),
        pick("segment", o_.array_size(o_.member(F.col("v"), "Opt"))).alias("options"), pick("active", o_.is_kind(value, "name")).alias("is_name"), pick("active", o_.is_kind(value, "null")).alias("is_null"),
    )


@query("SELECT r_regionkey, CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS seq, unnest(['dict_open', 'name', 'integer', 'string', 'dict_close']) AS kind, unnest(['', 'N', CAST(r_regionkey AS VARCHAR), r_name, '']) AS text FROM region")
def token_rows(spark, sf_dir):
    o_.register_tokens(spark)
    table(spark, sf_dir, "region").selectExpr("r_regionkey", "cast(concat('<< /N ', r_regionkey, ' (', r_name, ') >>') as binary) AS data").createOrReplaceTempView("quire_tokens_in")
    return spark.sql("SELECT r_regionkey, seq, kind, text FROM quire_tokens_in, LATERAL pdf_tokens(data)")


@query("SELECT s_suppkey, 'Highlight' AS subtype, s_name AS contents, CAST(132 AS INTEGER) AS flags, CAST(220 AS DOUBLE) AS y2, CAST(0.5 AS DOUBLE) AS green FROM supplier")
def annot_edit(spark, sf_dir):
    made = build(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", lambda r: synth.text_pdf(r["s_name"]))

    def mark(doc, row):
        page = next(n for n in doc.numbers() if dict_of(doc.get(n)).get(b"Type") == b"Page")
        kernel_edit.annotate(doc, page, [kernel_edit.annotation("Highlight", (0, 0, 1, 1))])
        note = doc.next_num - 1
        kernel_edit.set_annotation(doc, note, (100, 200, 300, 220), 4 | 128, row["s_name"], (1, 0.5, 0))

    named = Corpus(made.files.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey"), "s_suppkey")
    n = a.annotations(w.edit(named, mark, "s_name"))
    return n.select("s_suppkey", "subtype", "contents", "flags", F.col("rect.y2").alias("y2"), F.col("color.c1").alias("green"))


@query("""
SELECT * FROM (VALUES ('Eacute', 'É'), ('alpha', 'α'), ('Omega', 'Ω'), ('grave', '‘'), ('minus', '-'), ('guilsinglleft', '«'), ('uni00E9', 'é'), ('u1F600', '😀'), ('seven', '7'), ('nosuchglyph', 'nosuchglyph'), ('A', 'A')) AS g(name, ch)
""")
def glyph_names(spark, sf_dir):
    ship(spark)
    names = "Eacute alpha Omega grave minus guilsinglleft uni00E9 u1F600 seven nosuchglyph A".split()
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", t.glyph_text(F.col("name")).alias("ch"))


@query("SELECT doc_id, text AS decoded, CAST(250 AS DOUBLE) AS known, CAST(1000 AS DOUBLE) AS other FROM documents")
def byte_decoding(spark, sf_dir):
    """Bytes by an encoding table and widths by code, within the JVM."""
    d = table(spark, sf_dir, "documents").withColumn("table", t.encoding_array("WinAnsiEncoding"))
    widths = F.create_map(F.lit(32), F.lit(250.0))
    return d.select("doc_id", t.decode_bytes(F.encode("text", "ISO-8859-1"), F.col("table")).alias("decoded"), t.char_width(widths, F.lit(32), F.lit(1000.0)).alias("known"), t.char_width(widths, F.lit(33), F.lit(1000.0)).alias("other"))


@query("""
WITH c AS (SELECT CAST(unnest(range(1, 256)) AS INTEGER) AS code),
mac AS (SELECT code, CASE WHEN code < 128 THEN chr(code) ELSE substr('ÄÅÇÉÑÖÜáàâäãåçéèêëíìîïñóòôöõúùûü†°¢£§•¶ß®©™´¨≠ÆØ∞±≤≥¥µ∂∑∏π∫ªºΩæø¿¡¬√ƒ≈∆«»… ÀÃÕŒœ–—“”‘’÷◊ÿŸ⁄€‹›ﬁﬂ‡·‚„‰ÂÊÁËÈÍÎÏÌÓÔÒÚÛÙıˆ˜¯˘˙˚¸˝˛ˇ', code - 127, 1) END AS ch FROM c),
win AS (SELECT code, CASE WHEN code BETWEEN 128 AND 159 THEN substr('€?‚ƒ„…†‡ˆ‰Š‹Œ?Ž??‘’“”•–—˜™š›œ?žŸ', code - 127, 1) ELSE chr(code) END AS ch FROM c),
greek AS (SELECT code, substr('ΑΒΧΔΕΦΓΗΙ?ΚΛΜΝΟΠΘΡΣΤΥ?ΩΞΨΖ', code - 64, 1) AS ch FROM c WHERE code BETWEEN 65 AND 90 UNION ALL SELECT code, substr('αβχδεφγηι?κλμνοπθρστυ?ωξψζ', code - 96, 1) FROM c WHERE code BETWEEN 97 AND 122),
zapf AS (SELECT code, CASE code WHEN 37 THEN '☎' WHEN 42 THEN '☛' WHEN 43 THEN '☞' WHEN 72 THEN '★' WHEN 108 THEN '●' WHEN 110 THEN '■' WHEN 115 THEN '▲' WHEN 116 THEN '▼' WHEN 117 THEN '◆' WHEN 119 THEN '◗' ELSE chr(9985 + code - 33) END AS ch FROM c WHERE code BETWEEN 33 AND 126),
std AS (SELECT code, CASE code WHEN 39 THEN '’' WHEN 96 THEN '‘' ELSE chr(code) END AS ch FROM c WHERE code < 127 UNION ALL SELECT * FROM (VALUES (162, '¢'), (164, '⁄'), (172, 'ﬁ'), (173, 'ﬂ'), (176, '–'), (177, '†'), (208, '—'), (225, 'Æ'), (251, 'ß')) AS v(code, ch))
SELECT 'MacRomanEncoding' AS encoding, code, ch FROM mac UNION ALL SELECT 'WinAnsiEncoding', code, ch FROM win WHERE ch <> '?' OR code = 63 UNION ALL SELECT 'SymbolEncoding', code, ch FROM greek WHERE ch <> '?' UNION ALL SELECT 'ZapfDingbatsEncoding', code, ch FROM zapf UNION ALL SELECT 'StandardEncoding', code, ch FROM std
""")
def encodings(spark, sf_dir):
    """Whole tables of the two code pages, and of the others the letters and what stands apart."""
    e = t.encoding_table(spark, "WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding", "SymbolEncoding", "ZapfDingbatsEncoding")
    return e.where(F.expr("""code > 0 and case encoding when 'MacRomanEncoding' then true when 'WinAnsiEncoding' then code not in (129, 141, 143, 144, 157)
        when 'SymbolEncoding' then (code between 65 and 90 or code between 97 and 122) and code not in (74, 86, 106, 118) when 'ZapfDingbatsEncoding' then code between 33 and 126
        else code < 127 or code in (162, 164, 172, 173, 176, 177, 208, 225, 251) end"""))


@query("SELECT * FROM (VALUES ('Courier', CAST(600 AS DOUBLE), FALSE), ('Helvetica-Bold', 278, FALSE), ('Symbol', 250, FALSE), ('ABCDEF+Arial', NULL, TRUE)) AS f(font, width, subset)")
def standard_fonts(spark, sf_dir):
    rows = spark.createDataFrame([(n,) for n in ("Courier", "Helvetica-Bold", "Symbol", "ABCDEF+Arial")], "font string")
    return rows.select("font", t.standard_width(F.col("font")).alias("width"), t.is_subset_font(F.col("font")).alias("subset"))


# Files put together by hand: the reader alone is under test.


def _handmade(spark, sf_dir, name: str, key: str, make: Callable[[dict], bytes], *more: str) -> Corpus:
    return build(table(spark, sf_dir, name).select(key, *more), key, make)


def _joined(values: F.Column) -> F.Column:
    return F.array_join(F.transform(values, lambda x: x.cast("bigint").cast("string")), " ")


@query("""
SELECT p_partkey, CAST(seq AS INTEGER) AS seq, op, replace(nums, '%', CAST(p_size AS VARCHAR)) AS nums, names, strs FROM part, (VALUES
(0, 'q', '', '', ''), (1, 'cm', '1 0 0 1 % 0', '', ''), (2, 'J', '2', '', ''), (3, 'j', '1', '', ''), (4, 'M', '4', '', ''), (5, 'd', '3 % 1', '', ''), (6, 'ri', '', 'Perceptual', ''), (7, 'i', '50', '', ''), (8, 'gs', '', 'G1', ''), (9, 'w', '7', '', ''),
(10, 'm', '% 0', '', ''), (11, 'l', '% 1', '', ''), (12, 'c', '1 2 3 4 5 %', '', ''), (13, 'v', '1 2 3 %', '', ''), (14, 'y', '4 3 2 %', '', ''), (15, 'h', '', '', ''), (16, 're', '0 0 % 9', '', ''), (17, 'S', '', '', ''),
(18, 's', '', '', ''), (19, 'f', '', '', ''), (20, 'F', '', '', ''), (21, 'f*', '', '', ''), (22, 'B', '', '', ''), (23, 'B*', '', '', ''), (24, 'b', '', '', ''), (25, 'b*', '', '', ''), (26, 'n', '', '', ''), (27, 'W', '', '', ''), (28, 'W*', '', '', ''),
(29, 'CS', '', 'Cs1', ''), (30, 'cs', '', 'Cs2', ''), (31, 'SC', '1 2 3 %', '', ''), (32, 'SCN', '1 %', '', ''), (33, 'sc', '3', '', ''), (34, 'scn', '% 4', '', ''), (35, 'G', '1', '', ''), (36, 'g', '0', '', ''), (37, 'RG', '1 0 %', '', ''), (38, 'rg', '0 1 %', '', ''), (39, 'K', '1 2 3 %', '', ''), (40, 'k', '4 3 2 %', '', ''),
(41, 'sh', '', 'Sh1', ''), (42, 'MP', '', 'T1', ''), (43, 'DP', '', 'T2', ''), (44, 'BMC', '', 'T3', ''), (45, 'EMC', '', '', ''), (46, 'BX', '', '', ''), (47, 'EX', '', '', ''), (48, 'Q', '', '', ''),
(49, 'BT', '', '', ''), (50, 'Tc', '2', '', ''), (51, 'Tw', '3', '', ''), (52, 'Tz', '90', '', ''), (53, 'TL', '14', '', ''), (54, 'Tf', '%', 'F1', ''), (55, 'Tr', '1', '', ''), (56, 'Ts', '5', '', ''), (57, 'Td', '10 %', '', ''), (58, 'TD', '0 -%', '', ''), (59, 'Tm', '1 0 0 1 % 2', '', ''),
(60, 'T*', '', '', ''), (61, 'Tj', '', '', 'a'), (62, 'TJ', '-100', '', 'b|c'), (63, chr(39), '', '', 'd'), (64, '"', '1 2', '', 'e'), (65, 'ET', '', '', '')) AS o(seq, op, nums, names, strs)
""")
def every_operator(spark, sf_dir):
    ops = _handmade(spark, sf_dir, "part", "p_partkey", lambda r: handmade.every_operator(r["p_size"]), "p_size").table("content_ops")
    strs = F.array_join(F.transform("strs", lambda x: x.cast("string")), "|")
    return ops.select("p_partkey", "seq", "op", _joined(F.col("nums")).alias("nums"), F.array_join("names", " ").alias("names"), strs.alias("strs"))


@query("""
SELECT p_partkey, CAST(2 AS INTEGER) AS line_cap, CAST(1 AS INTEGER) AS line_join, CAST(4 AS DOUBLE) AS miter_limit, '3 ' || p_size AS dash, CAST(1 AS DOUBLE) AS dash_phase, 'Perceptual' AS rendering_intent, CAST(50 AS DOUBLE) AS flatness, 'G1' AS ext_state,
       'DeviceCMYK' AS stroke_space, 'DeviceCMYK' AS fill_space, '1 2 3 ' || p_size AS stroke_color, '4 3 2 ' || p_size AS fill_color, '1 0 0 1 ' || p_size || ' 0' AS ctm FROM part
""")
def drawing_states(spark, sf_dir):
    """What painting depends on before the state is restored."""
    states = _handmade(spark, sf_dir, "part", "p_partkey", lambda r: handmade.every_operator(r["p_size"]), "p_size").table("graphics_states").where("op = 'EX'")
    joined = [_joined(F.col(c)).alias(c) for c in ("dash", "stroke_color", "fill_color", "ctm")]
    return states.select("p_partkey", "line_cap", "line_join", "miter_limit", "dash_phase", "rendering_intent", "flatness", "ext_state", "stroke_space", "fill_space", *joined)


@query("""
SELECT p_partkey, CAST(2 AS DOUBLE) AS char_spacing, CAST(3 AS DOUBLE) AS word_spacing, CAST(90 AS DOUBLE) AS horizontal_scaling, CAST(p_size AS DOUBLE) AS leading, 'F1' AS font, CAST(p_size AS DOUBLE) AS font_size,
       CAST(1 AS INTEGER) AS render_mode, CAST(5 AS DOUBLE) AS rise, CAST(0 AS INTEGER) AS line_cap, 'DeviceGray' AS fill_space, CAST(0 AS INTEGER) AS depth FROM part
""")
def text_states(spark, sf_dir):
    """What showing text depends on at its end; the drawing's state was restored before it."""
    states = _handmade(spark, sf_dir, "part", "p_partkey", lambda r: handmade.every_operator(r["p_size"]), "p_size").table("graphics_states").where("op = 'ET'")
    return states.select("p_partkey", "char_spacing", "word_spacing", "horizontal_scaling", "leading", "font", "font_size", "render_mode", "rise", "line_cap", "fill_space", "depth")


@query("SELECT s_suppkey, array_to_string([s_name, 'two', 'three widenear', 'fivesix', 'sevena bc', 'after'], chr(10)) AS text FROM supplier")
def text_fold(spark, sf_dir):
    return texts(_handmade(spark, sf_dir, "supplier", "s_suppkey", lambda r: handmade.folded_text(r["s_name"]), "s_name"))


@query("""
SELECT p_partkey, 'AÉα€Ä ' || p_size AS text, 'TrueType' AS font_type, 'ABCDEF+Own' AS base_font, CAST(65 AS INTEGER) AS first_char, CAST(p_size AS DOUBLE) AS width_a, CAST(333 AS DOUBLE) AS width_c, CAST(111 AS DOUBLE) AS other_width, 'É€Ä' AS mapped FROM part
""")
def simple_fonts(spark, sf_dir):
    both = _handmade(spark, sf_dir, "part", "p_partkey", lambda r: handmade.simple_font(r["p_size"]), "p_size").tables("page_text", "fonts").groupBy("p_partkey")
    width = lambda code: F.max(F.try_element_at("fonts.widths", F.lit(code)))
    mapped = F.concat(*[F.get("fonts.encoding", F.lit(c)) for c in (66, 200, 128)])
    return both.agg(
        F.max("page_text.text").alias("text"), F.max("fonts.font_type").alias("font_type"), F.max("fonts.base_font").alias("base_font"), F.max("fonts.first_char").alias("first_char"),
        width(65).alias("width_a"), width(67).alias("width_c"), F.max("fonts.default_width").alias("other_width"), F.max(mapped).alias("mapped"),
    )


@query("""
SELECT s_suppkey, CAST(s_suppkey + 10 AS BIGINT) AS width, CAST(2 * s_suppkey + 5 AS BIGINT) AS height, 'DCTDecode' AS filter, TRUE AS undecoded,
       'FFD8FFE000104A46494600010100000100010000FFC0001108' || printf('%04X', 2 * s_suppkey + 5) || printf('%04X', s_suppkey + 10) || '03011100021100031100FFD9' AS raw FROM supplier
""")
def jpeg_images(spark, sf_dir):
    def embed(row: dict) -> bytes:
        doc = Document.empty()
        k = row["s_suppkey"]
        kernel_edit.add_image(doc, doc.create_page(kernel_edit.LETTER), kernel_edit.jpeg_image(doc, handmade.jpeg(k + 10, 2 * k + 5)), kernel_edit.LETTER, "Photo")
        return doc.save()

    i = a.find_image(_handmade(spark, sf_dir, "supplier", "s_suppkey", embed), "Photo")
    return i.select("s_suppkey", "width", "height", F.array_join("filters", " ").alias("filter"), F.col("decoded").isNull().alias("undecoded"), F.hex("raw").alias("raw"))


@query("SELECT s_suppkey, CAST(s_suppkey + 10 AS BIGINT) AS width, CAST(2 * s_suppkey + 5 AS BIGINT) AS height, TRUE AS is_photo FROM supplier")
def image_files(spark, sf_dir):
    """JPEG files below a folder, each made into a document of one page."""
    folder = shared_folder(spark)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    w.write_files(build(rows, "s_suppkey", lambda r: handmade.jpeg(r["s_suppkey"] + 10, 2 * r["s_suppkey"] + 5)), folder).count()
    i = a.images(w.image_files(spark, folder))
    key = F.regexp_extract("doc_id", r"([0-9]+)\.pdf$", 1).cast(rows.schema["s_suppkey"].dataType)
    return i.select(key.alias("s_suppkey"), "width", "height", codecs.is_jpeg(F.col("raw")).alias("is_photo"))


@query("""
SELECT s_suppkey, 'Line' AS subtype, CAST(s_suppkey AS DOUBLE) AS shape_x, CAST(1 AS BIGINT) AS shapes, 'Dashed' AS border, CAST(s_suppkey AS DOUBLE) AS border_width, '3 ' || s_suppkey AS dash, CAST(8 AS BIGINT) AS popup, 'n' || s_suppkey AS name, 'Author' AS title, 'about' AS subject, CAST(2024 AS INTEGER) AS modified, CAST(2023 AS INTEGER) AS created, CAST(1 AS DOUBLE) AS opacity, 'PRINT' AS flags FROM supplier
UNION ALL SELECT s_suppkey, 'Ink', s_suppkey, 2, 'Solid', 1, '3', NULL, NULL, NULL, NULL, NULL, NULL, 1, '' FROM supplier
UNION ALL SELECT s_suppkey, 'Polygon', s_suppkey, 3, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.5, '' FROM supplier
""")
def annot_details(spark, sf_dir):
    n = a.annotations(_handmade(spark, sf_dir, "supplier", "s_suppkey", lambda r: handmade.annotated(r["s_suppkey"])))
    ink, corners = F.col("ink_lists"), F.col("vertices")
    x = F.coalesce(F.get("line", F.lit(2)), F.get(F.get(ink, F.lit(0)), F.lit(1))["x"], F.get(corners, F.lit(1))["x"])
    shapes = F.when(F.col("line").isNotNull(), 1).when(ink.isNotNull(), F.size(ink)).otherwise(F.size(corners)).cast("bigint")
    return n.select(
        "s_suppkey", "subtype", x.alias("shape_x"), shapes.alias("shapes"), F.col("border_style").alias("border"), "border_width", _joined(F.col("border_dash")).alias("dash"), F.col("popup_obj").alias("popup"),
        "name", "title", "subject", F.col("modified.year").alias("modified"), F.col("created.year").alias("created"), "opacity", F.array_join("flag_names", " ").alias("flags"),
    )


@query("""
SELECT n_nationkey, CAST(0 AS INTEGER) AS seq, n_name AS title, n_nationkey % 3 = 2 AS is_open, n_nationkey % 2 = 1 AS is_italic, n_nationkey % 4 >= 2 AS is_bold, n_nationkey % 2 = 1 AS has_children, CAST(0.5 AS DOUBLE) AS blue, NULL AS fit FROM nation
UNION ALL SELECT n_nationkey, 1, 'below', FALSE, FALSE, FALSE, FALSE, NULL, 'FitH' FROM nation WHERE n_nationkey % 2 = 1
""")
def bookmark_flags(spark, sf_dir):
    marks = a.bookmarks(_handmade(spark, sf_dir, "nation", "n_nationkey", lambda r: handmade.styled_bookmark(r["n_nationkey"], r["n_name"]), "n_name"))
    return marks.select("n_nationkey", "seq", "title", "is_open", "is_italic", "is_bold", "has_children", F.get("color", F.lit(2)).alias("blue"), "fit")


@query("""
SELECT s_suppkey, TRUE AS b, 'Name' || s_suppkey AS n, '3 0 R' AS r, TRUE AS x_is_y, FALSE AS x_is_z, CAST(s_suppkey AS BIGINT) AS i, CAST(-s_suppkey AS BIGINT) AS f, CAST(-s_suppkey - 0.75 AS DOUBLE) AS f64, 'text' AS s, TRUE AS o, CAST(3 AS INTEGER) AS size, TRUE AS is_number, CAST(NULL AS BIGINT) AS wrong FROM supplier
""")
def variant_access(spark, sf_dir):
    o = _handmade(spark, sf_dir, "supplier", "s_suppkey", lambda r: handmade.typed_values(r["s_suppkey"])).objects().where("obj_num = 5")
    m = lambda key: o_.member(F.col("v"), key)
    ref, same = o_.as_ref(m("R")), F.lit("array")
    return o.select(
        "s_suppkey", o_.as_bool(m("B")).alias("b"), o_.as_name(m("N")).alias("n"), o_.ref_text(ref["num"], ref["gen"]).alias("r"), o_.equal(m("X"), m("Y"), same, same).alias("x_is_y"), o_.equal(m("X"), m("Z"), same, same).alias("x_is_z"),
        o_.as_i64(m("I")).alias("i"), o_.as_i64(m("F")).alias("f"), o_.as_f64(m("F")).alias("f64"), o_.as_text(m("S")).alias("s"), o_.is_kind(m("O"), "null").alias("o"), o_.array_size(m("X")).alias("size"),
        o_.is_number(m("F")).alias("is_number"), o_.as_i64(m("N")).alias("wrong"),
    )


@query("""
SELECT l_orderkey, l_linenumber, round(2 * l_quantity, 6) AS a, round(5 * l_tax + 7 * (1 + l_tax), 6) AS d, round(11 * l_quantity + 13 * l_discount + l_linenumber, 6) AS h FROM lineitem
""")
def matrix_concat(spark, sf_dir):
    """A matrix put before another: m.concat(n) is n, then m."""
    m = g.matrix(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), 1 + F.col("l_tax"), F.col("l_linenumber"), F.lit(0.0))
    both = g.concat(m, g.matrix(2, 0, 5, 7, 11, 13))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", both.alias("n"))
    return rows.select("l_orderkey", "l_linenumber", F.round("n.a", 6).alias("a"), F.round("n.d", 6).alias("d"), F.round("n.h", 6).alias("h"))


@query("""
SELECT * FROM (VALUES ('ASCII85Decode', '<~87cURD]j7BEbo80~>', 'Hello world!'), ('ASCIIHexDecode', '48 656C6c 6F>zz', 'Hello'), ('ASCIIHexDecode', '4>', '@')) AS v(filter, encoded, decoded)
UNION ALL SELECT * FROM (VALUES ('FlateDecode', '789ccb48cdc9c95728cf2fca4901001a0b045d', 'hello world'), ('LZWDecode', '800b6050220c0c8501', '-----A---B'), ('RunLengthDecode', '0268656cfe6c006f80', 'hellllo')) AS h(filter, encoded, decoded)
""")
def codec_vectors(spark, sf_dir):
    """Encoded bytes that other programs and the format's specification give."""
    ship(spark)
    plain = [("ASCII85Decode", "<~87cURD]j7BEbo80~>"), ("ASCIIHexDecode", "48 656C6c 6F>zz"), ("ASCIIHexDecode", "4>")]
    coded = [("FlateDecode", "789ccb48cdc9c95728cf2fca4901001a0b045d"), ("LZWDecode", "800b6050220c0c8501"), ("RunLengthDecode", "0268656cfe6c006f80")]
    rows = spark.createDataFrame([(f, e, e.encode()) for f, e in plain] + [(f, e, bytes.fromhex(e)) for f, e in coded], "filter string, encoded string, data binary")
    decoded = F.coalesce(*[F.when(F.col("filter") == f, codecs.decode_stream(F.col("data"), f)) for f in sorted({f for f, _ in plain + coded})])
    return rows.select("filter", "encoded", decoded.cast("string").alias("decoded"))
