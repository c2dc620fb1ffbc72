"""What the training-data operators share: Arrow plumbing and joins that keep hot keys apart."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import ship

#: The words of every operator: maximal runs outside space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: At most so many keys can each hold more than 1/HEAVY of the rows; only those are ever broadcast.
HEAVY = 1024


#: What this worker keeps between tasks: one thing at a time, and only while tasks use it.
_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]):
    """`make()`, remembered until a task asks for something else or for nothing."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def _slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of a batch stays small; for tasks that keep nothing."""
    _KEPT.clear()
    yield from _slices(batches, rows)


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], keeps: bool = False) -> Callable:
    """A mapInArrow function: `make` runs once per task, its result once per batch of bounded rows."""
    ship(SparkSession.active())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _KEPT.clear()
        each = make()
        for batch in _slices(batches, 1024):
            out = each(batch)
            if out is not None and out.num_rows:
                yield out

    return run


def batch_of(schema: str | list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    """A record batch of (name, type) fields over plain Python or numpy columns."""
    fields = [pa.field(n, t) for n, t in schema]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, (_, t) in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))


def heavy_aware_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """left LEFT JOIN right USING (key), for a `right` with one row per key and the key's number of left rows.

    Keys with more than total/HEAVY rows, at most HEAVY of them by pigeonhole, are broadcast; the
    rest, none of which can fill a task, meet by an ordinary shuffle.
    """
    hot = F.broadcast(right.where(F.col(count) * HEAVY > total))
    cold = right.where(F.col(count) * HEAVY <= total)
    return left.join(hot, key, "inner").unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Memo(dict):
    """A bounded memo of `make`; indexing it is a plain dictionary access where the key is known.

    When it is full it becomes the old generation, which still answers, and the older one goes.
    Long keys rarely come back and are not kept, so the bound on entries is one on bytes.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got
