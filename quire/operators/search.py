"""Search over page texts: literal or regular, with byte offsets and context."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import ship
from quire.sources.pdf import Corpus

#: Characters of context before and after a match.
BEFORE, AFTER = 41, 40


@dataclass(frozen=True)
class SearchOptions:
    """Literal and case-insensitive over all pages unless told otherwise; 0 means no limit."""

    case_sensitive: bool = False
    whole_word: bool = False
    is_regex: bool = False
    start_page: int = 1
    end_page: int = 0
    max_results: int = 0


def compile_pattern(pattern: str, options: SearchOptions) -> regex.Pattern:
    """Word boundaries enclose the pattern as it stands, so those of an alternation hold at its outer ends only."""
    text = pattern if options.is_regex else regex.escape(pattern, special_only=True, literal_spaces=True)
    text = rf"\b{text}\b" if options.whole_word else text
    try:
        return regex.compile(text, regex.V0 | (0 if options.case_sensitive else regex.I))
    except regex.error as e:
        raise ValueError(f"invalid search pattern: {e}") from None


def java_pattern(pattern: str, options: SearchOptions) -> str:
    """The same pattern for the JVM's functions."""
    text = pattern if options.is_regex else r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    text = rf"\b{text}\b" if options.whole_word else text
    return ("(?U)" if options.case_sensitive else "(?iuU)") + text


def _pages(corpus: Corpus, options: SearchOptions) -> DataFrame:
    text = corpus.table("page_text").where((F.col("text") != "") & (F.col("page_num") >= max(1, options.start_page)))
    return text.where(F.col("page_num") <= options.end_page) if options.end_page > 0 else text


def search_text(pages: DataFrame, key: str, pattern: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(key, page_num, match_text, offset in UTF-8 bytes, context) of the matches in (key, page_num, text) rows."""
    found = compile_pattern(pattern, options)
    ship(pages.sparkSession)
    src = pages.select(key, "page_num", "text")
    key_field = src.schema[0]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, nums, texts, offsets, contexts = [], [], [], [], []
            for i, (num, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                at = byte = 0
                for m in found.finditer(text):
                    byte += len(text[at : m.start()].encode())
                    at = m.start()
                    which.append(i), nums.append(num), texts.append(m.group()), offsets.append(byte)
                    contexts.append(text[max(0, m.start() - BEFORE) : m.end() + AFTER])
            fields = [pa.field(key, b.schema.field(0).type), pa.field("page_num", pa.int32()), pa.field("match_text", pa.string()), pa.field("offset", pa.int64()), pa.field("context", pa.string())]
            cols = [b.column(0).take(pa.array(which, pa.int64())), *(pa.array(v, f.type) for v, f in zip((nums, texts, offsets, contexts), fields[1:]))]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

    hits = src.mapInArrow(run, f"`{key}` {key_field.dataType.simpleString()}, page_num int, match_text string, offset bigint, context string")
    if options.max_results > 0:
        order = Window.partitionBy(key).orderBy("page_num", "offset")
        hits = hits.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= options.max_results).drop("_rank")
    return hits


def search(corpus: Corpus, pattern: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Non-overlapping matches by page and place; pages whose content cannot be read are skipped.

    The page range is a filter on the table below the kernel's output; a limit holds per document.
    """
    return search_text(_pages(corpus, options), corpus.key, pattern, options)


def search_regex(corpus: Corpus, pattern: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    return search(corpus, pattern, SearchOptions(options.case_sensitive, options.whole_word, True, options.start_page, options.end_page, options.max_results))


def matches(text: Column, pattern: str, options: SearchOptions = SearchOptions()) -> Column:
    """How often a text column matches, within the JVM."""
    return F.regexp_count(text, F.lit(java_pattern(pattern, options)))


def count(corpus: Corpus, pattern: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(key, matches) of every document with readable pages, zero included."""
    return _pages(corpus, options).groupBy(corpus.key).agg(F.sum(matches(F.col("text"), pattern, options)).alias("matches"))


def contains(corpus: Corpus, pattern: str) -> DataFrame:
    """(key, found): whether the literal occurs, in any case."""
    return _pages(corpus, SearchOptions()).groupBy(corpus.key).agg(F.bool_or(F.col("text").rlike(java_pattern(pattern, SearchOptions()))).alias("found"))
