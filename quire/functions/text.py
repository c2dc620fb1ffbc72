"""Text decoding, glyph names and encodings as column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire.kernel import encodings, structure
from quire.runtime import ship


def _reader(read):
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else read(bytes(b)))

    return run


def decode_info_text(data: Column) -> Column:
    """UTF-16 or UTF-8 by mark, else UTF-8."""
    return _reader(structure.info_text)(data)


def decode_field_text(data: Column) -> Column:
    """UTF-16 or UTF-8 by mark, else the Windows code page."""
    return _reader(structure.field_text)(data)


def decode_plain_text(data: Column) -> Column:
    """UTF-16 by mark, else UTF-8."""
    return _reader(structure.plain_text)(data)


def decode_lossy_utf8(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def glyph_text(name: Column) -> Column:
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else encodings.glyph_text(n))

    return run(name)


def encoding_table(spark, *names: str):
    """(encoding, code, ch) of named encodings, for broadcast joins; unmapped codes are null."""
    rows = [(n, code, ch) for n in names for code, ch in enumerate(encodings.encoding(n))]
    return spark.createDataFrame(rows, "encoding string, code int, ch string")


def encoding_array(name: str) -> Column:
    """The 256 characters of a named encoding, null where it has none."""
    return F.array(*[F.lit(c).cast("string") for c in encodings.encoding(name)])


def standard_width(base_font: Column) -> Column:
    """Default width of a standard font, null for others."""
    table = F.create_map(*[F.lit(x) for pair in encodings.STANDARD_14.items() for x in pair])
    return F.try_element_at(table, base_font)


def is_subset_font(base_font: Column) -> Column:
    return base_font.rlike(r"^[A-Z]{6}\+.")


def char_width(widths: Column, code: Column, default: Column) -> Column:
    """The width of a code by a font's map, in thousandths of the text size."""
    return F.coalesce(F.try_element_at(widths, code), default)


def decode_bytes(data: Column, encoding: Column) -> Column:
    """Each byte by an array of 256 characters, U+FFFD where it has none; no Python."""
    codes = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))
    text = F.array_join(F.transform(codes, lambda c: F.coalesce(F.get(encoding, c), F.lit(encodings.REPLACEMENT))), "")
    return F.when(F.length(data) > 0, text).when(data.isNotNull(), "")
