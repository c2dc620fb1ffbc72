"""Pages with boxes, rotation, size and default matrix, as expressions over the raw attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.sources.pdf import Corpus


def pages(corpus: Corpus) -> DataFrame:
    """One row per page.

    The media box is US letter by default, the crop box the media box, the others the crop box; a
    rotation that is no multiple of 90 counts as none; width and height are those of the crop box,
    swapped when turned by 90 or 270; the unit is 1 by default.
    """
    raw = corpus.table("raw_pages")
    raw = raw.withColumn("media_box", F.coalesce(g.rect_of(F.col("media")), g.rect(0.0, 0.0, 612.0, 792.0)))
    raw = raw.withColumn("crop_box", F.coalesce(g.rect_of(F.col("crop")), F.col("media_box")))
    for box in ("bleed", "trim", "art"):
        raw = raw.withColumn(f"{box}_box", F.coalesce(g.rect_of(F.col(box)), F.col("crop_box")))
    turn = F.pmod(F.coalesce("rotate", F.lit(0)), F.lit(360))
    raw = raw.withColumn("rotation", F.when(turn.isin(90, 180, 270), turn).otherwise(0).cast("int"))
    crop = g.normalize(F.col("crop_box"))
    across, up = g.width(crop), g.height(crop)
    turned = F.col("rotation").isin(90, 270)
    raw = raw.withColumn("width", F.when(turned, up).otherwise(across)).withColumn("height", F.when(turned, across).otherwise(up))
    base = g.translation(-crop["x1"], -crop["y1"])
    spins = {90: g.matrix(0, -1, 1, 0, 0, across), 180: g.matrix(-1, 0, 0, -1, across, up), 270: g.matrix(0, 1, -1, 0, up, 0)}
    matrix = base
    for degrees, spin in spins.items():
        matrix = F.when(F.col("rotation") == degrees, g.multiply(spin, base)).otherwise(matrix)
    return raw.select(
        corpus.key, "page_num", "obj_num", "media_box", "crop_box", "bleed_box", "trim_box", "art_box", "rotation", "width", "height",
        F.coalesce("unit", F.lit(1.0)).alias("user_unit"), "num_annots", matrix.alias("default_matrix"),
    )


def get_page(corpus: Corpus, page_num: int) -> DataFrame:
    """The n-th page, from 1, of each document that has one."""
    if page_num < 1:
        raise ValueError("pages are numbered from 1")
    return pages(corpus).where(F.col("page_num") == page_num)


def page_counts(corpus: Corpus) -> DataFrame:
    """(key, page_count of the tree, stated_page_count of the root node)."""
    return corpus.table("documents").select(corpus.key, "page_count", "stated_page_count")
