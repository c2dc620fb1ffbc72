"""Changing and saving corpora: each document is rewritten within its own row, nothing shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.codecs import is_jpeg
from quire.kernel.cos import FAULTS
from quire.kernel.document import Document
from quire.kernel.edit import LETTER, add_image, jpeg_image, raw_image, rgb_of_bgr
from quire.runtime import ship
from quire.sources.pdf import Corpus


def edit(corpus: Corpus, change: Callable[[Document, dict], None], *columns: str) -> Corpus:
    """Each readable document after `change(document, row of the named columns)`, saved anew.

    Documents that cannot be read become null.
    """
    src = corpus.files.select(corpus.key, F.col(corpus.content).alias("content"), *columns)
    key = src.schema[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    doc = Document(row["content"]) if row["content"] is not None else None
                    if doc is not None:
                        change(doc, row)
                    out.append(doc.save() if doc is not None else None)
                except FAULTS:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key.name, "content"])

    ship(corpus.files.sparkSession)
    return Corpus(src.mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, content binary"), corpus.key, "content", corpus.fail_fast)


def save(corpus: Corpus) -> Corpus:
    """A full rewrite of every document: object streams expanded, one classic section, no revisions."""
    return edit(corpus, lambda doc, row: None)


def build(rows: DataFrame, key: str, make: Callable[[dict], bytes]) -> Corpus:
    """A corpus of one document per row, made from the row's columns."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = b.column(b.schema.get_field_index(key)), [make(row) for row in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.binary())], names=[key, "content"])

    ship(rows.sparkSession)
    return Corpus(rows.mapInArrow(run, f"`{key}` {kind}, content binary"), key)


def write_files(corpus: Corpus, path: str) -> DataFrame:
    """One file <key>.pdf per document below a path of any filesystem that Arrow knows; (key, bytes) written.

    Files are written under a temporary name and renamed, so a task that runs again does no harm.
    """
    src = corpus.files.select(corpus.key, F.col(corpus.content).alias("content")).where(F.col("content").isNotNull())
    key = src.schema[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, root = FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = f"{root}/{str(k).replace('/', '_')}.pdf"
                with fs.open_output_stream(f"{name}.{attempt}.part") as f:
                    f.write(data)
                fs.move(f"{name}.{attempt}.part", name)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(d) for d in b.column(1).to_pylist()], pa.int64())], names=[key.name, "bytes"])

    return src.mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, bytes bigint")


def image_files(spark: SparkSession, path: str) -> Corpus:
    """A corpus of one page per image file below a path; JPEG data is kept as it is, other formats are decoded by the JVM.

    Files that are no images give no document.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "content").where(is_jpeg(F.col("content")))
    decoded = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    decoded = decoded.where(F.col("nChannels") == 3).join(raw, F.col("origin") == F.col("doc_id"), "left_anti").withColumnRenamed("origin", "doc_id")

    def jpeg(row: dict) -> bytes:
        doc = Document.empty()
        add_image(doc, doc.create_page(LETTER), jpeg_image(doc, row["content"]), LETTER, "Img0")
        return doc.save()

    def pixels(row: dict) -> bytes:
        doc = Document.empty()
        add_image(doc, doc.create_page(LETTER), raw_image(doc, rgb_of_bgr(row["data"]), row["width"], row["height"]), LETTER, "Img0")
        return doc.save()

    return Corpus(build(raw, "doc_id", jpeg).files.unionByName(build(decoded, "doc_id", pixels).files))
