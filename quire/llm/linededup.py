"""Line dedup by content-defined chunks of lines, and by whole repeated runs of lines.

A rolling hash over the last WINDOW line hashes ends a chunk wherever it is divisible by DIVISOR,
so equal stretches of lines are cut alike wherever they stand.  A line of LONG_LINE words or more
is a chunk by itself.  A chunk counts if it has several lines or LONG_LINE words; if it occurs
again anywhere in the corpus, byte for byte, all occurrences but the first (smallest document,
then place) are removed.

Chunks alone miss the head and tail of a repeated run, and runs in which no two boundaries fall.
So `dedup_runs` also compares windows: the shortest runs of LONG_LINE words that begin, or that
end, at a line.  A run of LONG_LINE words or more is covered by the windows inside it, and which
those are depends on its own lines only; so every run that occurs again goes whole, in whatever
context, but for blank lines at its edges.  `dedup` is the chunks alone.

Only documents that lose something meet what they lose in a shuffle; a Bloom filter lets the others
pass, and decides nothing.

Edge cases: null text stays null and has no chunks; empty texts, and documents of one short line,
are left alone; where `dedup_runs` leaves blank lines only, the empty text remains; a document is
known by its doc_id and a hash of its text, so repeats of a row count as one occurrence and are
treated alike, while rows that share a doc_id, null or not, and differ in text are documents each,
ordered by that hash; a null doc_id comes last; texts of any length are cut whole; all columns of
the input, whatever their names, are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bloom import bloom_of, maybe
from quire.llm.common import batch_of, heavy_aware_join, sliced
from quire.runtime import checkpoint, ship

WINDOW = 2
DIVISOR = 3
LONG_LINE = 50
_SIGN = 1 << 63
#: Bytes of pieces in a batch, about.
_BATCH = 8 << 20


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGN else x


def chunks(text: str) -> list[tuple[int, int, bytes, bool]]:
    """(first line, lines, bytes, counts) of each chunk; the bytes leave out the last line's end."""
    lines = text.encode().split(b"\n")
    out, begin, before = [], 0, 0
    for i, line in enumerate(lines):
        own = xxhash.xxh3_64_intdigest(line)
        long = line.count(b" ") >= LONG_LINE - 1 and len(line.split()) >= LONG_LINE
        if long:
            if begin < i:
                part = lines[begin:i]
                out.append((begin, len(part), b"\n".join(part), len(part) > 1))
            out.append((i, 1, line, True))
            begin, before = i + 1, 0
            continue
        rolled = own * 0x9E3779B97F4A7C15 + before * 0xD6E8FEB86659FD93 & (1 << 64) - 1
        before = own
        if (rolled >> 32) % DIVISOR == 0:
            part = lines[begin : i + 1]
            out.append((begin, len(part), b"\n".join(part), len(part) > 1))
            begin = i + 1
    if begin < len(lines):
        part = lines[begin:]
        out.append((begin, len(part), b"\n".join(part), len(part) > 1))
    return out


def _hashes(chunk: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(chunk)
    return _signed(h & (1 << 64) - 1), _signed(h >> 64)


def counted(text: str) -> list[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of each chunk that counts."""
    return [(first, lines, data) for first, lines, data, counts in chunks(text) if counts]


def windows(text: str) -> list[tuple[int, int, memoryview]]:
    """(first line, lines, bytes) of each shortest run of LONG_LINE words from a line on, or up to one; none begins or ends with a blank line."""
    data = text.encode()
    lines = data.split(b"\n")
    start, before = [0], [0]  # bytes and words before each line
    for line in lines:
        start.append(start[-1] + len(line) + 1)
        before.append(before[-1] + len(line.split()))
    spans, end, begin = set(), 0, 0
    for i in range(len(lines)):
        if before[i] == before[i + 1]:
            continue
        while end < len(lines) and before[end + 1] - before[i] < LONG_LINE:
            end += 1
        if end < len(lines):
            spans.add((i, end))
        while before[i + 1] - before[begin + 1] >= LONG_LINE:
            begin += 1
        if before[i + 1] - before[begin] >= LONG_LINE:
            spans.add((begin, i))
    view = memoryview(data)
    return [(i, j - i + 1, view[start[i] : start[j + 1] - 1]) for i, j in sorted(spans)]


def pieces(text: str) -> list[tuple[int, int, bytes | memoryview]]:
    """Chunks that count, and windows, each stretch once."""
    return list({(first, lines): (first, lines, data) for first, lines, data in (*windows(text), *counted(text))}.values())


def _rows(src: DataFrame, cut: Callable, sieve=None, with_data: bool = False) -> DataFrame:
    """(id, tag, at, lines, h1, h2[, data]) of every piece, or of those that pass the sieve; batches are cut by their bytes."""
    ship(src.sparkSession)
    names = [("at", pa.int64()), ("lines", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), *([("data", pa.binary())] if with_data else [])]

    def run(batches):
        for b in sliced(batches):
            fields = [("id", b.schema.field(0).type), ("tag", pa.int64()), *names]
            cols, held = [[] for _ in range(len(names) + 1)], 0

            def out():
                rows = pa.array(cols[0], pa.int64())  # noqa: B023
                return batch_of(fields, [b.column(0).take(rows), b.column(1).take(rows), *cols[1:]])  # noqa: B023

            for i, t in enumerate(b.column(2).to_pylist()):
                found = [(first, lines, *_hashes(data), data) for first, lines, data in cut(t)]
                if sieve is not None and found:
                    found = [x for x, may in zip(found, maybe(sieve.value, [x[2] for x in found])) if may]
                for x in found:
                    for col, v in zip(cols, (i, *x[:4], bytes(x[4]))) if with_data else zip(cols, (i, *x[:4])):
                        col.append(v)
                    held += len(x[4]) if with_data else 40
                    if held > _BATCH:
                        yield out()
                        cols, held = [[] for _ in range(len(names) + 1)], 0
            if cols[0]:
                yield out()

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, tag bigint, at bigint, lines bigint, h1 bigint, h2 bigint" + ", data binary" * with_data)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: Callable = counted) -> DataFrame:
    """(id, tag, removed array<struct<at, lines, h1, h2>>): the pieces that go, for documents that lose any."""
    src = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("tag"), docs[text_col].alias("text")).where(F.col("text").isNotNull())
    again = checkpoint(_rows(src, cut).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1"))
    sieve = bloom_of(again, "h1")
    seen = checkpoint(_rows(src, cut, sieve))
    # The bytes are compared by grouping on them; one row per task and piece is shuffled.
    place = F.struct(F.col("id").isNull().alias("none"), "id", "tag", "at")
    same = _rows(src, cut, sieve, with_data=True).groupBy("h1", "h2", "data").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    # Two contents under one 128-bit hash: neither is removed.
    repeated = checkpoint(
        same.groupBy("h1", "h2").agg(F.count("*").alias("contents"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("last").alias("last"))
        .where("contents = 1 and n > 1 and first <> last").select("h1", "h2", "n", "first")
    )
    total = seen.count()
    pair = F.struct("h1", "h2")
    met = heavy_aware_join(seen.withColumn("pair", pair), repeated.select(pair.alias("pair"), "n", "first"), "pair", "n", total)
    gone = met.where("first is not null").where(~(place.eqNullSafe(F.col("first"))))
    return gone.groupBy("id", "tag").agg(F.collect_set(F.struct("at", "lines", "h1", "h2")).alias("removed"))


def strip(text: str, removed: set[tuple[int, int, int, int]], cut: Callable = counted) -> tuple[str, int]:
    """The text without the removed pieces, and how many of the pieces it had."""
    found = [(first, lines) for first, lines, data in cut(text) if (first, lines, *_hashes(data)) in removed]
    gone = {i for first, lines in found for i in range(first, first + lines)}
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone), len(found)


def strip_runs(text: str, removed: set[tuple[int, int, int, int]]) -> tuple[str, int]:
    """The same for `pieces`, counting the stretches of lines that go; blank lines do not stay alone."""
    gone = {i for first, lines, data in pieces(text) if (first, lines, *_hashes(data)) in removed for i in range(first, first + lines)}
    left = [line for i, line in enumerate(text.split("\n")) if i not in gone]
    return "\n".join(left) if not gone or any(line.encode().split() for line in left) else "", sum(i - 1 not in gone for i in gone)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of `docs`, repeated chunks taken out of the text, plus `n_removed`, their number."""
    return _without(docs, decide(docs, id_col, text_col), strip, id_col, text_col, length_col)


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of `docs`, repeated chunks and all repeated runs of LONG_LINE words taken out of the text, plus `n_removed`, the number of stretches of lines that went."""
    return _without(docs, decide(docs, id_col, text_col, pieces), strip_runs, id_col, text_col, length_col)


def _without(docs: DataFrame, gone: DataFrame, strip: Callable, id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    gone = checkpoint(gone.withColumnsRenamed({"id": "dedup id", "tag": "dedup tag", "removed": "dedup removed"}))
    sieve = bloom_of(gone, "dedup tag")
    tagged = docs.withColumn("dedup mark", F.xxhash64(docs[text_col]))
    names = docs.columns
    text_at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def split(wanted: bool):
        def run(batches):
            for b in sliced(batches):
                may = maybe(sieve.value, b.column(len(names)).to_numpy())
                yield b.filter(pa.array(may == wanted))

        return run

    def run(batches):
        for b in sliced(batches):
            texts, marks = b.column(text_at).to_pylist(), b.column(len(names)).to_pylist()
            counts = [0] * len(texts)
            for i, (t, removed) in enumerate(zip(texts, marks)):
                if t is not None and removed:
                    texts[i], counts[i] = strip(t, {(r["at"], r["lines"], r["h1"], r["h2"]) for r in removed})
            cols = [b.column(i) for i in range(len(names))]
            cols[text_at] = pa.array(texts, b.schema.field(text_at).type)
            if length_at is not None:
                old = cols[length_at].to_pylist()
                cols[length_at] = pa.array([len(t) if c else n for t, c, n in zip(texts, counts, old)], b.schema.field(length_at).type)
            fields = [b.schema.field(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], schema=pa.schema([*fields, pa.field("n_removed", pa.int64())]))

    some = tagged.mapInArrow(split(True), tagged.schema)
    met = some.join(gone, some[id_col].eqNullSafe(gone["dedup id"]) & (some["dedup mark"] == gone["dedup tag"]), "left").drop("dedup id", "dedup tag", "dedup mark")
    rest = tagged.mapInArrow(split(False), tagged.schema).select(*(F.col(f"`{n}`") for n in names), F.lit(0).cast("long").alias("n_removed"))
    return met.mapInArrow(run, f"{schema}, n_removed bigint").union(rest)
