"""Exact top-k inner products by a KD-tree per shard.

A coarse KD partition of a bounded sample cuts the space into cells; a cell of many vectors is dealt
into several shards.  Each shard becomes a KD-tree (median splits, tight bounding boxes).  A query
visits the nodes of a tree best first by the largest inner product that the node's box allows and
stops once that falls below its k-th best score.  Each query first searches one shard of the cell
whose box allows it most; the k-th score found there travels with it to the shards of all the cells
whose boxes allow as much, and to no others.

A tree is unpickled once for each GROUP queries that meet it; neither trees nor queries are copied
into rows of pairs.  Results do not depend on the sample, the cells or the shards.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part, nor do
rows with a null id; a vector is compared with vectors of its own length only; every row but the
query's own is a candidate, also one that repeats its id; every row that is a query has its own
result; ties go to the smaller id; fewer candidates than k are all returned; extra columns are
ignored; no vectors, no rows.  Scores are exact; one that 64 bits cannot hold counts as the largest
that they can.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import batch_of, heavy_aware_join, sliced
from quire.runtime import checkpoint, ship

#: Rows of a shard: at least the first, and the second where there are very many.
SHARD_ROWS = 8192
MOST_SHARD_ROWS = 65_536
#: Queries that a tree meets at once.
GROUP = 4096
LEAF = 128
#: Cells of the coarse partition for each vector length, lengths that have one, and rows that it is made from.
CELLS = 256
LENGTHS = 16
SAMPLE = 16_384
#: Tables of cells up to this many rows are broadcast.
_SMALL = 20_000
_EXACT = 1 << 53
_LARGEST = (1 << 63) - 1


def _kind(query: np.ndarray, largest: int):
    """float64 where products and sums of such integers are exact, and BLAS is fast; else Python integers."""
    return np.float64 if int(np.abs(query).max(initial=0)) * max(1, largest) * max(1, query.shape[1]) < _EXACT else object


def allowed(query: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each query row and box the largest inner product that the box allows."""
    kind = _kind(query, int(max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0))))
    q = query.astype(kind)
    return np.maximum(q, 0) @ hi.astype(kind).T + np.minimum(q, 0) @ lo.astype(kind).T


class KDTree:
    """Rows reordered by leaf; nodes as arrays with boxes, children (-1: leaf) and row ranges."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, uids: np.ndarray | None = None):
        order = np.arange(len(ids))
        lo, hi, kids, span = [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            part = rows[order[a:b]]
            me = len(span)
            lo.append(part.min(axis=0))
            hi.append(part.max(axis=0))
            span.append((a, b))
            kids.append([-1, -1])
            if parent >= 0:
                kids[parent][side] = me
            width = hi[-1] - lo[-1]
            if b - a > LEAF and len(width) and width.max() > 0:
                axis, mid = int(width.argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid, kind="introselect")]
                stack += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.ids, self.rows = ids[order], rows[order]
        self.uids = self.ids if uids is None else uids[order]
        if np.abs(rows).max(initial=0) < 1 << 31:
            self.rows = self.rows.astype(np.int32)
        self.lo, self.hi, self.kids, self.span = np.array(lo), np.array(hi), np.array(kids), span
        self.largest = int(np.abs(rows).max(initial=0))

    def search(self, query: np.ndarray, own: np.ndarray, kth: list, k: int) -> list[list[tuple[int, int]]]:
        """For each query row its best (score, id) here that can still be among its k best.

        `kth` holds, per query, the k-th best score known so far, or None; `own` the row that it is.
        """
        kind = _kind(query, self.largest)
        q, rows = query.astype(kind), self.rows.astype(kind)
        bound = allowed(query, self.lo, self.hi)
        found = []
        for i in range(len(q)):
            best: list[tuple[int, int]] = []  # a heap of (score, -id): its root is the worst kept
            floor = kth[i]
            todo = [(-bound[i, 0], 0)]
            while todo:
                most, node = heapq.heappop(todo)
                if floor is not None and -most < floor:
                    break
                left, right = self.kids[node]
                if left >= 0:
                    heapq.heappush(todo, (-bound[i, left], left))
                    heapq.heappush(todo, (-bound[i, right], right))
                    continue
                a, b = self.span[node]
                score = rows[a:b] @ q[i]
                other = self.uids[a:b] != own[i]
                for j in np.flatnonzero(other if floor is None else other & (score >= floor)).tolist():
                    item = (int(score[j]), -int(self.ids[a + j]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k and (floor is None or best[0][0] > floor):
                    floor = best[0][0]
            found.append([(s, -i) for s, i in best])
        return found


class Cells:
    """A coarse KD partition: medians of the widest axis until there are `count` cells."""

    def __init__(self, rows: np.ndarray, count: int):
        self.axis, self.cut, self.kids, self.cell = [], [], [], []
        todo = [(rows, count, -1, 0)]
        cells = 0
        while todo:
            part, want, parent, side = todo.pop()
            me = len(self.axis)
            if parent >= 0:
                self.kids[parent][side] = me
            width = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(0)
            axis = int(width.argmax()) if len(width) else 0
            cut = int(np.sort(part[:, axis])[(len(part) - 1) // 2]) if len(width) else 0
            right = part[:, axis] > cut if len(width) else np.zeros(0, bool)
            inner = want > 1 and right.any()
            self.axis.append(axis), self.cut.append(cut), self.kids.append([me, me]), self.cell.append(-1 if inner else cells)
            if inner:
                todo += [(part[~right], want // 2, me, 0), (part[right], want - want // 2, me, 1)]
            else:
                cells += 1
        self.axis, self.cut, self.kids, self.cell = map(np.array, (self.axis, self.cut, self.kids, self.cell))

    def of(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        if not rows.shape[1]:
            return at
        here = np.arange(len(rows))
        while (self.cell[at] < 0).any():
            at = self.kids[at, (rows[here, self.axis[at]] > self.cut[at]).astype(int)]
        return self.cell[at]


def _by_length(ids, vecs):
    """(length, places, matrix) of the vectors of each length in an Arrow list column."""
    offsets = vecs.offsets.to_numpy()
    flat = vecs.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    size = np.diff(offsets)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield dim, at, flat[offsets[at][:, None] + np.arange(dim)]


def vectors(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<bigint>) of the rows that take part, components floor(1024 * x)."""
    v = embeddings[vec_col]
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & embeddings[id_col].isNotNull()
    return embeddings.where(fine).select(embeddings[id_col].cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * 1024.0)).alias("v"))


_SHARD = ["dim", "cell", "sub"]


def top_k(embeddings: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id, score) for every row that `is_query` (a function of the id column) picks."""
    ship(embeddings.sparkSession)
    spark = embeddings.sparkSession
    read = vectors(embeddings, id_col, vec_col)
    total = read.count()
    shard_rows = max(shard_rows, min(MOST_SHARD_ROWS, total // CELLS))

    # Cells from a sample of bounded size, of the most frequent vector lengths.
    sample = read.orderBy(F.xxhash64(F.monotonically_increasing_id())).limit(SAMPLE).select("v").collect()
    lengths = Counter(len(r.v) for r in sample).most_common(LENGTHS)
    wanted = max(1, min(CELLS, -(-total // shard_rows)))
    coarse = spark.sparkContext.broadcast({dim: Cells(np.array([r.v for r in sample if len(r.v) == dim], np.int64).reshape(n, dim), wanted) for dim, n in lengths})

    def assign(batches):
        for b in sliced(batches):
            dims, cells = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            for dim, at, rows in _by_length(b.column(0), b.column(1)):
                dims[at] = dim
                if dim in coarse.value:
                    cells[at] = coarse.value[dim].of(rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(cells)], names=["id", "v", "uid", "dim", "cell"])

    numbered = read.withColumn("uid", F.monotonically_increasing_id())
    celled = checkpoint(numbered.mapInArrow(assign, "id bigint, v array<bigint>, uid bigint, dim int, cell int"))
    sizes = checkpoint(celled.groupBy("dim", "cell").agg(F.count("*").alias("n")).withColumn("subs", F.ceil(F.col("n") / shard_rows)))
    sizes = F.broadcast(sizes) if sizes.count() <= _SMALL else sizes
    deal = F.pmod(F.xxhash64("uid"), F.col("subs")).cast("int").alias("sub")

    def build(key, table):
        dim, rows = key[0].as_py(), table.column("v").combine_chunks()
        (_, _, matrix), *_ = _by_length(None, rows)
        tree = KDTree(table.column("id").to_numpy(), matrix, table.column("uid").to_numpy())
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": [key[1].as_py()], "sub": [key[2].as_py()], "lo": [tree.lo[0].tolist()], "hi": [tree.hi[0].tolist()], "tree": [pickle.dumps(tree, 5)]}, schema=_arrow("dim cell sub lo hi tree"))

    key = F.struct("dim", "cell")
    sized = heavy_aware_join(celled.withColumn("key", key), sizes.select(key.alias("key"), "n", "subs"), "key", "n", total)
    trees = checkpoint(sized.select("id", "v", "uid", "dim", "cell", deal).groupBy(*_SHARD).applyInArrow(build, "dim int, cell int, sub int, lo array<bigint>, hi array<bigint>, tree binary"))

    # The box of each cell, of the lengths that have several: at most LENGTHS * CELLS boxes.
    listed = [dim for dim, _ in lengths]
    sides = trees.where(F.col("dim").isin(listed)).select("dim", "cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "side"))
    sides = sides.groupBy("dim", "cell", "axis").agg(F.min("side.lo").alias("lo"), F.max("side.hi").alias("hi"))
    side = F.sort_array(F.collect_list(F.struct("axis", "lo", "hi")))
    found = sides.groupBy("dim", "cell").agg(side.alias("sides")).collect()
    boxes = {}
    for dim in {r.dim for r in found}:
        mine = sorted((r for r in found if r.dim == dim), key=lambda r: r.cell)
        lo, hi = (np.array([[s[i] for s in r.sides] for r in mine], np.int64).reshape(len(mine), dim) for i in (1, 2))
        boxes[dim] = (np.array([r.cell for r in mine], np.int32), lo, hi)
    boxes = spark.sparkContext.broadcast(boxes)

    def homes(batches):
        """The queries with the cell whose box allows them most."""
        for b in sliced(batches):
            cells = np.zeros(b.num_rows, np.int32)
            for dim, at, rows in _by_length(b.column(0), b.column(1)):
                if dim in boxes.value:
                    names, lo, hi = boxes.value[dim]
                    cells[at] = names[allowed(rows, lo, hi).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(cells)], names=["id", "v", "uid", "dim", "cell"])

    def others(batches):
        """Each query with every cell whose box allows its k-th score."""
        for b in sliced(batches, 256):
            floors = b.column(6).to_pylist()
            for dim, at, rows in _by_length(b.column(0), b.column(1)):
                if dim in boxes.value:
                    names, lo, hi = boxes.value[dim]
                    bound = allowed(rows, lo, hi)
                    far = [np.flatnonzero(bound[i] >= floors[p]) if floors[p] is not None else np.arange(len(names)) for i, p in enumerate(at.tolist())]
                else:
                    names, far = np.zeros(1, np.int32), [np.zeros(1, np.int64)] * len(at)
                which = pa.array(np.repeat(at, [len(f) for f in far]))
                if len(which):
                    cell = pa.array(names[np.concatenate(far)], pa.int32())
                    id_, v, uid, dims, home_cell, home, floor = (c.take(which) for c in b.columns)
                    yield pa.RecordBatch.from_arrays([id_, v, uid, dims, cell, home_cell, home, floor], names=["id", "v", "uid", "dim", "cell", "home_cell", "home", "floor"])

    def hunt(pairs: DataFrame) -> DataFrame:
        """The best of each query, whose k-th score so far is `floor`, in its shard; very busy shards are searched in several groups."""

        def run(tree_table, queries):
            rows = []
            if tree_table.num_rows and queries.num_rows:
                tree = pickle.loads(tree_table.column("tree")[0].as_py())
                (_, _, matrix), *_ = _by_length(None, queries.column("v").combine_chunks())
                uids, ids = queries.column("uid").to_numpy(), queries.column("id").to_pylist()
                for uid, i, best in zip(uids.tolist(), ids, tree.search(matrix, uids, queries.column("floor").to_pylist(), k)):
                    rows += [(uid, i, n, max(-_LARGEST, min(_LARGEST, s))) for s, n in best]
            cols = list(map(list, zip(*rows))) or [[]] * 4
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("uid", "query_id", "id", "score"), cols)})

        pairs = checkpoint(pairs)
        load = pairs.groupBy(*_SHARD).agg(F.count("*").alias("q")).withColumn("groups", F.ceil(F.col("q") / GROUP))
        busy = load.where("groups > 1")
        if busy.isEmpty():
            spread, copies = pairs.withColumn("group", F.lit(0).cast("long")), trees.join(load.select(*_SHARD), _SHARD, "left_semi").withColumn("group", F.lit(0).cast("long"))
        else:
            shard = F.struct(*_SHARD)
            met = heavy_aware_join(pairs.withColumn("shard", shard), load.select(shard.alias("shard"), "q", "groups"), "shard", "q", pairs.count())
            spread = met.withColumn("group", F.pmod(F.xxhash64("uid"), F.col("groups"))).drop("shard", "q", "groups")
            copies = trees.join(load, _SHARD).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        keys = [*_SHARD, "group"]
        left, right = copies.select(*keys, "tree").groupBy(*keys), spread.select(*keys, "id", "v", "uid", "floor").groupBy(*keys)
        return left.cogroup(right).applyInArrow(run, "uid bigint, query_id bigint, id bigint, score bigint")

    queries = celled.where(is_query(F.col("id")))
    home = queries.select("id", "v", "uid", "dim", "cell").mapInArrow(homes, "id bigint, v array<bigint>, uid bigint, dim int, cell int").join(sizes, ["dim", "cell"])
    home = checkpoint(home.select("id", "v", "uid", "dim", "cell", deal))
    first = checkpoint(hunt(home.withColumn("floor", F.lit(None).cast("long"))))
    kth = first.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).drop("n")
    known = home.join(kth, "uid", "left").select("id", "v", "uid", "dim", "cell", F.col("sub").alias("home"), "floor")
    far = known.mapInArrow(others, "id bigint, v array<bigint>, uid bigint, dim int, cell int, home_cell int, home int, floor bigint").join(sizes, ["dim", "cell"])
    subs = F.explode(F.sequence(F.lit(0), (F.col("subs") - 1).cast("int"))).alias("sub")
    far = far.select("id", "v", "uid", "dim", "cell", "home_cell", "home", "floor", subs).where("not (cell = home_cell and sub = home)")
    every = first.unionByName(hunt(far.select("id", "v", "uid", *_SHARD, "floor")))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _arrow(names: str) -> pa.Schema:
    kinds = {"lo": pa.list_(pa.int64()), "hi": pa.list_(pa.int64()), "tree": pa.binary()}
    return pa.schema([(n, kinds.get(n, pa.int32())) for n in names.split()])
