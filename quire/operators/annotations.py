"""Annotations, links and form fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.dates import parse_pdf_date
from quire.sources.pdf import Corpus

#: Flags of annotations by bit.
ANNOT_FLAGS = {"INVISIBLE": 0, "HIDDEN": 1, "PRINT": 2, "NO_ZOOM": 3, "NO_ROTATE": 4, "NO_VIEW": 5, "READ_ONLY": 6, "LOCKED": 7, "TOGGLE_NO_VIEW": 8, "LOCKED_CONTENTS": 9}
#: Subtypes that mark up a page.
MARKUP = "Text FreeText Line Square Circle Polygon PolyLine Highlight Underline Squiggly StrikeOut Stamp Caret Ink FileAttachment Sound Redact".split()
#: Flags of fields by bit; two share one.
FIELD_FLAGS = {
    "READ_ONLY": 0, "REQUIRED": 1, "NO_EXPORT": 2, "MULTILINE": 12, "PASSWORD": 13, "NO_TOGGLE_TO_OFF": 14, "RADIO": 15, "PUSHBUTTON": 16, "COMBO": 17, "EDIT": 18, "SORT": 19,
    "FILE_SELECT": 20, "MULTI_SELECT": 21, "DO_NOT_SPELL_CHECK": 22, "DO_NOT_SCROLL": 23, "COMB": 24, "RADIOS_IN_UNISON": 25, "RICH_TEXT": 25, "COMMIT_ON_SEL_CHANGE": 26,
}


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(1 << bit)) != 0


def flag_names(flags: Column, bits: dict[str, int]) -> Column:
    return F.array_compact(F.array(*[F.when(has_flag(flags, b), F.lit(n)) for n, b in bits.items()]))


def annotations(corpus: Corpus) -> DataFrame:
    """One row per annotation with typed properties and their defaults."""
    raw = corpus.table("raw_annotations")
    known = sum(1 << b for b in ANNOT_FLAGS.values())
    return raw.select(
        corpus.key, "page_num", "seq", "obj_num", "subtype", F.col("subtype").isin(MARKUP).alias("is_markup"), g.rect_of(F.col("rect")).alias("rect"),
        F.col("flags").bitwiseAND(F.lit(known)).cast("int").alias("flags"), flag_names(F.col("flags"), ANNOT_FLAGS).alias("flag_names"), "contents", "name", "title", "subject",
        parse_pdf_date(F.col("modified")).alias("modified"), parse_pdf_date(F.col("created")).alias("created"), g.color(F.col("color")).alias("color"), "opacity", "popup_obj",
        g.quads(F.col("quads")).alias("quad_points"), "line", g.points(F.col("vertices")).alias("vertices"),
        F.transform("ink", lambda stroke: g.points(stroke)).alias("ink_lists"), "border_style", "border_width", "border_dash", "link_uri",
    )


def links(corpus: Corpus) -> DataFrame:
    """(key, page_num, seq, rect, uri) of link annotations with a direct URI action."""
    return annotations(corpus).where((F.col("subtype") == "Link") & F.col("link_uri").isNotNull()).select(corpus.key, "page_num", "seq", "rect", F.col("link_uri").alias("uri"))


def form_fields(corpus: Corpus) -> DataFrame:
    """One row per field, in the order of the tree, with flags and what they mean for its type."""
    raw = corpus.table("raw_fields")
    kind, flags = F.col("type"), F.col("flags")
    known = 0
    for b in FIELD_FLAGS.values():
        known |= 1 << b
    return raw.select(
        corpus.key, "seq", "obj_num", "name", "partial_name", "type", flags.bitwiseAND(F.lit(known)).alias("flags"), flag_names(flags, FIELD_FLAGS).alias("flag_names"), "value", "default_value",
        "max_length", "justification", "options", "has_kids", has_flag(flags, 0).alias("is_read_only"), has_flag(flags, 1).alias("is_required"),
        ((kind == "Choice") & has_flag(flags, 17)).alias("is_combo"), ((kind == "Text") & has_flag(flags, 12)).alias("is_multiline"), ((kind == "Text") & has_flag(flags, 13)).alias("is_password"),
    )


def find_field(corpus: Corpus, name: str) -> DataFrame:
    """The first field of that full name in each document."""
    return form_fields(corpus).where(F.col("name") == name).groupBy(corpus.key).agg(F.min_by(F.struct("name", "type", "value", "flags"), "seq").alias("f")).select(corpus.key, "f.*")


def field_count(corpus: Corpus) -> DataFrame:
    return form_fields(corpus).groupBy(corpus.key).agg(F.count("*").alias("fields"))


def bookmarks(corpus: Corpus) -> DataFrame:
    """The outline, depth first."""
    return corpus.table("bookmarks")


def bookmark_pages(corpus: Corpus) -> DataFrame:
    """(key, seq, depth, title, fit, page_num) of bookmarks whose destination is a page of the document."""
    marks = corpus.table("bookmarks").select(corpus.key, "seq", "depth", "title", "fit", "dest_obj")
    pages = corpus.table("raw_pages").select(corpus.key, F.col("obj_num").alias("dest_obj"), "page_num")
    return marks.join(pages, [corpus.key, "dest_obj"], "left").drop("dest_obj")


def images(corpus: Corpus) -> DataFrame:
    """Image resources of each page, raw and decoded; decoded is null if a filter is not supported."""
    return corpus.table("images")


def find_image(corpus: Corpus, name: str) -> DataFrame:
    """Per document and page the image of that resource name."""
    return images(corpus).where(F.col("name") == name)
