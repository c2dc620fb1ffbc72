"""Predicates and typed access over VARIANT values of the object table, and token rows.

A value of another type than asked for is null, never an error, and references are not followed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire.kernel.cos import ARRAY_CLOSE, ARRAY_OPEN, DICT_CLOSE, DICT_OPEN, END, Keyword, Lexer, Name, PdfError
from quire.runtime import ship

#: Kind of a value -> the key that tags it.
TAGS = {"null": "t", "bool": "b", "int": "i", "real": "f", "name": "n", "str": "s", "array": "a", "dict": "d", "ref": "r"}


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def member(v: Column, key: str) -> Column:
    """The value of a dictionary's or stream's key."""
    return _get(v, f"$.d['{key}']", "variant")


def item(v: Column, i: int) -> Column:
    """The i-th value, from 0, of an array."""
    return _get(v, f"$.a[{i}]", "variant")


def is_kind(v: Column, kind: str) -> Column:
    """Whether a value is of a kind; a stream's dictionary is told apart by the table's own `kind`."""
    return F.coalesce(_get(v, f"$.{TAGS[kind]}", "variant").isNotNull(), F.lit(False))


def is_number(v: Column) -> Column:
    return is_kind(v, "int") | is_kind(v, "real")


def as_bool(v: Column) -> Column:
    return _get(v, "$.b", "boolean")


def as_f64(v: Column) -> Column:
    return F.coalesce(_get(v, "$.i", "double"), _get(v, "$.f", "double"))


def as_i64(v: Column) -> Column:
    """An integer, or a real cut towards zero and held within 64 bits."""
    real = _get(v, "$.f", "double")
    cut = F.when(real >= 2.0**63, F.lit(2**63 - 1)).when(real <= -(2.0**63), F.lit(-(2**63))).otherwise(real.try_cast("bigint"))
    return F.coalesce(_get(v, "$.i", "bigint"), cut)


def as_name(v: Column) -> Column:
    return _get(v, "$.n", "string")


def as_bytes(v: Column) -> Column:
    return F.unhex(_get(v, "$.s", "string"))


def as_text(v: Column) -> Column:
    """A string's bytes as UTF-8, damage replaced."""
    return F.make_valid_utf8(as_bytes(v).cast("string"))


def as_ref(v: Column) -> Column:
    """(num, gen) of a reference."""
    num = _get(v, "$.r[0]", "bigint")
    return F.when(num.isNotNull(), F.struct(num.alias("num"), _get(v, "$.r[1]", "int").alias("gen")))


def ref_text(num: Column, gen: Column) -> Column:
    return F.format_string("%d %d R", num, gen)


def array_size(v: Column) -> Column:
    return F.size(_get(v, "$.a", "array<variant>"))


def equal(a: Column, b: Column, kind_a: Column, kind_b: Column) -> Column:
    """Structural equality; streams are never equal, an integer never equals a real."""
    return (kind_a == kind_b) & (kind_a != "stream") & (F.to_json(a) == F.to_json(b))


_MARKS = {ARRAY_OPEN: "array_open", ARRAY_CLOSE: "array_close", DICT_OPEN: "dict_open", DICT_CLOSE: "dict_close"}


class Tokens:
    """Rows (seq, kind, text) of the tokens of a byte string; a fault is the last row."""

    def eval(self, data: bytes) -> Iterator[tuple[int, str, str]]:
        lex, seq = Lexer(bytes(data or b"")), 0
        while True:
            try:
                t = lex.token()
            except PdfError as e:
                yield seq, "error", str(e)
                return
            if t is END:
                return
            if isinstance(t, bytes):
                yield seq, "name" if isinstance(t, Name) else "keyword" if isinstance(t, Keyword) else "string", t.decode("utf-8", "replace")
            elif isinstance(t, (int, float)):
                yield seq, "integer" if isinstance(t, int) else "real", str(t)
            else:
                yield seq, _MARKS[t], ""
            seq += 1


def register_tokens(spark: SparkSession, name: str = "pdf_tokens") -> None:
    """The table function `name(binary)` for SQL, to be used with LATERAL."""
    ship(spark)
    spark.udtf.register(name, F.udtf(Tokens, returnType="seq int, kind string, text string"))
