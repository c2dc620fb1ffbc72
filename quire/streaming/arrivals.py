"""Streams of arriving PDF files: the same narrow tables, kept up as files come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.search import SearchOptions, matches
from quire.sources.pdf import Corpus


def read_pdf_stream(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_trigger: int = 1000) -> Corpus:
    """A corpus over files as they arrive; every table of it is a streaming DataFrame."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return Corpus(files, "path", "content")


def arrivals(spark: SparkSession, path: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, files, bytes) by modification time; files later than `late` are left out."""
    corpus = read_pdf_stream(spark, path)
    timed = corpus.files.select("modificationTime", "length").withWatermark("modificationTime", late)
    return timed.groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def watch(spark: SparkSession, path: str, pattern: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(path, page_num, matches) of arriving pages that match."""
    text = read_pdf_stream(spark, path).table("page_text")
    return text.select("path", "page_num", matches(F.col("text"), pattern, options).alias("matches")).where("matches > 0")
