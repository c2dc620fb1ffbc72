"""N-gram Jaccard join: size-aware, heavy and light, and its connected components.

A document's set is its distinct n-word shingles.  Equal sets are one class.  Classes link when
their Jaccard similarity reaches the threshold, which for sizes a <= b means an overlap of
c(a, b) = ceil(t / (1 + t) * (a + b)).

Light: two small sets link exactly when they share a subset of c(a, b) shingles, so each small set
enumerates its subsets of that fixed size.  Heavy: a large set scans the inverted lists of its
rarest shingles; of the first size - ceil(t * size) + size / SPARE in any common order, two linked
sets always share as many as the smaller one's share of SPARE, and a set that has fewer in common
with others leaves the lists.  The order is by corpus frequency from a counting sketch of all documents.  The
boundary between small and large is where enumerating starts to cost more than scanning.

A list of k classes is not expanded into pairs.  Its smallest class is compared with the others
(a star); lists whose members then lie in one component are done, because further links could not
change the components.  Of what remains, classes without enough shared rare shingles to link with
another component leave again.  The rest is gathered into clusters and cut into blocks of BLOCK
classes of one band of sizes; blocks meet those of their band and the next within their cluster, for
linked sizes differ by less than a band, and every two classes of different components that may link
are compared in some pair of blocks, their overlaps coming from one matrix product.  No link between
different components is lost.

Lists longer than HOT_LIST are dealt out by class before they are sorted, and their smallest class is
broadcast; a class that very many others are compared with has its shingles once for every SPOKES.

A class is known by a 64-bit hash of its set.  A second one is compared for every document; where two
sets share the first, the second names their classes.  Shingles are 64-bit hashes: for n of them the
chance that any two collide is n**2 / 2**65, which adds at most one to an overlap.

Edge cases: null, empty and blank texts have the empty set, link with nothing and are their own
component; fewer than n words make one shingle; repeated rows share a class; a null doc_id takes
part in links but never names a component, and a component of null ids only has a null name; texts
of any length are read whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bloom import bloom_of, maybe
from quire.llm.common import batch_of, heavy_aware_join, sliced, union_all
from quire.llm.graph import connected
from quire.llm.shingles import mix64, shingle_sets
from quire.runtime import checkpoint, materialised, ship

WORDS = 5
#: Jaccard threshold as a fraction.
NUM, DEN = 4, 5
BLOCK = 128
#: What a list costs at most, in rows: a star replaces its pairs.
LIST_COST = 16

_U = np.uint64
#: Counters of each of the sketch's two rows, and how many of them travel together.
_WIDTH = 1 << 20
_SEGMENT = 1 << 14
#: Prefixes are longer by one shingle in SPARE than one common shingle needs, and so linked sets share as many.
SPARE = 10

#: Lists that may be longer are dealt out by class.
HOT_LIST = 1 << 18
#: Rows of one key that may meet in a task of a join.
HOT_ROWS = 1024
#: Comparisons with one class that share one copy of its shingles.
SPOKES = 4096
#: Partitions to which pairs of blocks are dealt in turn.
MOST_DEALS = 4096

_FIRST, _SECOND, _MUTUAL, _LIST = 0, 1, 2, 3


def overlap_needed(a: int, b: int, num: int = NUM, den: int = DEN) -> int:
    return -(-num * (a + b) // (num + den))


def largest_partner(n: int, num: int = NUM, den: int = DEN) -> int:
    return n * den // num


def common_rare(n: int) -> int:
    """How many shingles two linked sets have in common within their prefixes, the smaller of n shingles."""
    return -(-n // SPARE)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + common_rare(n)


def light_cost(n: int, num: int = NUM, den: int = DEN) -> int:
    """Subsets that a set of n shingles enumerates."""
    total = comb(n, n - overlap_needed(n, n, num, den)) if overlap_needed(n, n, num, den) < n else 0
    for m in range(n + 1, largest_partner(n, num, den) + 1):
        total += 2 * comb(n, n - overlap_needed(n, m, num, den))
    for m in range(1, n):
        if largest_partner(m, num, den) >= n:
            total += 2 * comb(n, n - overlap_needed(m, n, num, den))
    return total


def boundary(list_length: float, num: int = NUM, den: int = DEN) -> int:
    """The largest size up to which enumerating is cheaper than scanning lists of that mean length."""
    n = 0
    while light_cost(n + 1, num, den) <= prefix_length(n + 1, num, den) * (1 + min(list_length, LIST_COST)):
        n += 1
    return n


def class_of(shingles: np.ndarray, bits: int = 64) -> int:
    """One 64-bit id of a non-empty set, of which tests may use fewer bits."""
    total = mix64(shingles).sum(dtype=_U, keepdims=True) + np.array([len(shingles)], _U) * _U(0xA24BAED4963EE407)
    return int((mix64(total) >> _U(64 - bits))[0].astype(np.int64))


def second_of(shingles: np.ndarray) -> int:
    """Another 64-bit id, independent of the first."""
    total = mix64(shingles * _U(0xD6E8FEB86659FD93) + _U(0x589965CC75374CC3)).sum(dtype=_U, keepdims=True)
    return int(mix64(total)[0].astype(np.int64))


def namer(bits: int, shared: frozenset[int]) -> Callable[[np.ndarray], int]:
    """The name of a set's class, where the ids in `shared` belong to several sets."""

    def name(shingles: np.ndarray) -> int:
        first = class_of(shingles, bits)
        return second_of(shingles) if first in shared else first

    return name


def _light(shingles: np.ndarray, bound: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """(signature, role) of a small set's subsets, once for each order of the two sizes."""
    n = len(shingles)
    mixed = mix64(shingles ^ _U(0x5BD1E9955BD1E995))
    whole = mixed.sum(dtype=_U, keepdims=True)

    def subsets(gone: int) -> np.ndarray:
        out = np.array(list(combinations(range(n), gone)), np.int64).reshape(comb(n, gone), gone)
        return whole - mixed[out].sum(axis=1, dtype=_U)

    for m in range(1, bound + 1):
        a, b = min(n, m), max(n, m)
        need = overlap_needed(a, b, num, den)
        if b > largest_partner(a, num, den) or need > a or (a == b and need >= a):
            continue
        for turned in (0, 1) if a != b else (0,):
            salt = np.array([(a * 4096 + b) * 2 + turned], _U) * _U(0x9E3779B97F4A7C15)
            role = _MUTUAL if a == b else (_FIRST if (n == a) ^ turned else _SECOND)
            for s in mix64(subsets(n - need) + salt).astype(np.int64).tolist():
                yield s, role


def _places(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each shingle in either row of the sketch."""
    return (shingles & _U(_WIDTH - 1)).astype(np.int64), (shingles >> _U(32) & _U(_WIDTH - 1)).astype(np.int64)


def prefix(shingles: np.ndarray, counts: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a set, as many as guarantee a common one with any linked set, and how often each occurs at most."""
    rare = np.minimum(*(row[at] for row, at in zip(counts, _places(shingles))))
    first = np.lexsort((shingles, rare))[: prefix_length(len(shingles), num, den)]
    return shingles[first], rare[first]


def _first_pass(words: int, bits: int):
    """One row per document (id, n, cls, second, mark) and, per task, the segments of a counting sketch."""

    def run(batches):
        counts = np.zeros((2, _WIDTH), np.int64)
        kinds = None
        for b in sliced(batches):
            kinds = b.schema.field(0).type
            sets = shingle_sets(b.column(1).to_pylist(), words)
            if sets:
                for row, at in zip(counts, _places(np.concatenate(sets))):
                    row += np.bincount(at, minlength=_WIDTH)
            yield _first_batch(b.column(0), [len(s) for s in sets], [class_of(s, bits) if len(s) else None for s in sets], [second_of(s) if len(s) else None for s in sets], b.column(2))
        if kinds is not None:
            parts = counts.reshape(-1, _SEGMENT)
            full = np.flatnonzero(parts.any(axis=1)).tolist()
            none = pa.nulls(len(full), pa.int64())
            yield _first_batch(pa.nulls(len(full), kinds), none, none, none, none, full, [TaskContext.get().partitionId()] * len(full), [_pack(parts[i]) for i in full])

    return run


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.uint64).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def _first_batch(ids, sizes, classes, seconds, marks, segments=None, tasks=None, counts=None):
    k = len(ids)
    fields = [("id", ids.type), ("n", pa.int64()), ("cls", pa.int64()), ("second", pa.int64()), ("mark", pa.int64()), ("segment", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())]
    return batch_of(fields, [ids, sizes, classes, seconds, marks, segments or [None] * k, tasks or [None] * k, counts or [None] * k])


def _sketch(first: DataFrame) -> np.ndarray:
    """The 2 x _WIDTH counters summed over all tasks, in two steps so that no group grows with the square."""

    def add(key, table):
        total = np.zeros(_SEGMENT, np.int64)
        for c in table.column("counts"):
            total += _unpack(c.as_py())
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_pack(total)], pa.binary())})

    parts = first.where("segment is not null").select("segment", F.expr("task div 256").alias("some"), "counts")
    some = parts.groupBy("segment", "some").applyInArrow(add, "segment int, counts binary")
    out = np.zeros(2 * _WIDTH, np.int64)
    for r in some.groupBy("segment").applyInArrow(add, "segment int, counts binary").collect():  # 128 rows of 128 KB before compression
        out[r.segment * _SEGMENT : (r.segment + 1) * _SEGMENT] = _unpack(r.counts)
    return out.reshape(2, _WIDTH)


def mean_list_length(counts: np.ndarray) -> float:
    """Second frequency moment over the first: the list length that a random occurrence sees."""
    total = float(counts[0].sum())
    if not total:
        return 0.0
    moment = min((float((c.astype(float) ** 2).sum()) - total**2 / _WIDTH) * _WIDTH / (_WIDTH - 1) for c in counts)
    return max(1.0, moment / total)


def _signatures(words: int, num: int, den: int, bound: int, counts, name: Callable[[np.ndarray], int], hot: int):
    def run(batches):
        sketch, seen = counts.value, set()
        for b in sliced(batches):
            sig, role, cls, size, deal = [], [], [], [], []
            for s in shingle_sets(b.column(0).to_pylist(), words):
                n = len(s)
                if not n:
                    continue
                c = name(s)
                if c in seen:  # a class once per task
                    continue
                seen.add(c)
                if n <= bound:
                    for x, r in _light(s, bound, num, den):
                        sig.append(np.array([x])), role.append(np.array([r], np.int8)), cls.append(np.array([c])), size.append(np.array([n])), deal.append(np.zeros(1, np.int32))
                if n > bound or largest_partner(n, num, den) > bound:
                    rare, often = prefix(s, sketch, num, den)
                    x = mix64(rare + _U(0x2545F4914F6CDD1D)).astype(np.int64)
                    sig.append(x), role.append(np.full(len(x), _LIST, np.int8)), cls.append(np.full(len(x), c)), size.append(np.full(len(x), n))
                    deal.append(np.where(often > hot, 1 + c % np.maximum(1, -(-often // hot)), 0).astype(np.int32))
            if sig:
                fields = [("sig", pa.int64()), ("role", pa.int8()), ("cls", pa.int64()), ("n", pa.int64()), ("deal", pa.int32())]
                yield batch_of(fields, [pa.array(np.concatenate(x)) for x in (sig, role, cls, size, deal)])

    return run


def _shared(batches):
    """Sorted (sig, role, cls, n, deal) rows in; those of lists with several classes, or that are dealt out, each once, out."""
    held = None  # the last row, not yet out because no other class has followed it
    last = None  # sig and cls of the last row
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(5)]
        if held is not None:
            cols = [np.concatenate([np.array([v], c.dtype), c]) for v, c in zip(held, cols)]
        sig, role, cls, *_ = cols
        if not len(sig):
            continue
        again = np.zeros(len(sig), bool)
        again[1:] = (sig[1:] == sig[:-1]) & (cls[1:] == cls[:-1]) & (role[1:] == role[:-1])
        if held is None and last is not None:
            again[0] = last == (sig[0], cls[0])
        cols = [c[~again] for c in cols]
        sig = cols[0]
        if not len(sig):
            continue
        hit = cols[4] > 0
        same = sig[1:] == sig[:-1]
        hit[1:] |= same
        hit[:-1] |= same
        if held is None and last is not None and last[0] == sig[0]:
            hit[0] = True
        last = (cols[0][-1], cols[2][-1])
        held = None if hit[-1] else tuple(c[-1] for c in cols)
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in cols[:4]], names=["sig", "role", "cls", "n"])


def _stars(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, role, cls, n, hub, hub_n) of each list's classes but its smallest, which is the hub.

    A class without enough shared rare shingles to link with anything leaves its lists first.
    """
    heavy = rows.where(f"role = {_LIST}")
    shared = heavy.groupBy("cls", "n").agg(F.count("*").alias("k"))
    smallest = F.ceil(F.col("n") * num / den)
    able = shared.where(F.col("k") >= F.ceil(smallest / SPARE)).select("cls")
    rows = checkpoint(heavy.join(able, "cls").select(*rows.columns).union(rows.where(f"role < {_LIST}")))
    first = checkpoint(rows.groupBy("sig").agg(F.min(F.struct("role", "cls", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1"))
    members = _met(rows, first, "sig", "members").where("cls <> hub.cls")
    meets = f"(role >= {_MUTUAL} or hub.role = {_FIRST} and role = {_SECOND})"
    return members.where(meets).select("sig", "role", "cls", "n", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n"))


def _met(rows: DataFrame, first: DataFrame, key: str, count: str) -> DataFrame:
    """rows JOIN first USING (key); keys too hot for one task, if there are any, apart."""
    longest = first.agg(F.max(count)).first()[0] or 0
    if longest <= HOT_ROWS:
        return rows.join(first, key)
    return heavy_aware_join(rows, first, key, count, rows.count()).where(F.col(count).isNotNull())


def _alike(a: str, b: str, num: int, den: int) -> str:
    """SQL: sizes that can reach the threshold."""
    return f"{den} * least({a}, {b}) >= {num} * greatest({a}, {b})"


def _sets(texts: DataFrame, wanted: DataFrame, words: int, name: Callable[[np.ndarray], int]) -> DataFrame:
    """(cls, shingles binary) of the classes whose representative text has a hash among `wanted`.mark."""
    sieve = bloom_of(wanted, "mark")

    def run(batches):
        seen = set()
        for b in sliced(batches):
            may = maybe(sieve.value, b.column(1).to_numpy())
            cls, sets = [], []
            for s in shingle_sets(b.column(0).filter(pa.array(may)).to_pylist(), words):
                c = name(s) if len(s) else None
                if c is not None and c not in seen:
                    seen.add(c)
                    cls.append(c), sets.append(s.tobytes())
            if cls:
                yield batch_of([("cls", pa.int64()), ("shingles", pa.binary())], [cls, sets])

    found = texts.mapInArrow(run, "cls bigint, shingles binary")
    return checkpoint(found.groupBy("cls").agg(F.first("shingles").alias("shingles")))


def _with_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, cls, x, y): pairs with the shingles of both; a hub of very many pairs has one copy of its own for each SPOKES."""
    met = pairs.join(sets, "cls").withColumnsRenamed({"shingles": "x"})
    hubs = sets.withColumnsRenamed({"cls": "hub", "shingles": "y"})
    spokes = pairs.groupBy("hub").agg(F.count("*").alias("spokes"))
    if (spokes.agg(F.max("spokes")).first()[0] or 0) <= SPOKES:
        return met.join(hubs, "hub")
    spokes = checkpoint(spokes.withColumn("copies", F.ceil(F.col("spokes") / SPOKES)))
    met = heavy_aware_join(met, spokes, "hub", "spokes", pairs.count()).withColumn("copy", F.pmod("cls", "copies")).drop("spokes", "copies")
    hubs = hubs.join(spokes, "hub").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("spokes", "copies")
    return met.join(hubs, ["hub", "copy"])


def _verify(num: int, den: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, t = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = int(np.isin(s, t, assume_unique=True, kind="sort").sum()) if len(s) <= len(t) else int(np.isin(t, s, assume_unique=True, kind="sort").sum())
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _block_links(num: int, den: int):
    """One pair of blocks: one link for each two components that have any."""

    def run(key, table):
        side, comp, cls = (table.column(c).to_numpy() for c in ("side", "comp", "cls"))
        sets = [np.frombuffer(s, _U) for s in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        token, index = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        common = np.bincount(index, minlength=len(token)) > 1
        place = np.cumsum(common) - 1
        use = common[index]
        row, col = owner[use], place[index[use]]
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(common.sum()), 8192):  # sums of at most 2**24 ones are exact
            some = (col >= lo) & (col < lo + 8192)
            dense = np.zeros((len(sets), 8192), np.float32)
            dense[row[some], col[some] - lo] = 1
            both += dense[left] @ dense[right].T
        linked = den * both >= num * (size[left][:, None] + size[right][None, :] - both)
        linked &= comp[left][:, None] != comp[right][None, :]
        i, j = np.nonzero(linked)
        x, y = comp[left[i]], comp[right[j]]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def _several(rows: DataFrame) -> DataFrame:
    """The rows of lists that hold several components, with the list's smallest class as `low`."""
    split = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cls").alias("low"), F.count("*").alias("members")).where("lo <> hi")
    return _met(rows, checkpoint(split.select("sig", "low", "members")), "sig", "members").drop("members")


def _cluster_links(lists: DataFrame, comps: DataFrame, fetch: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(a, b) links between components, from the lists that stars left in several components."""
    rows = checkpoint(lists.join(comps.select(F.col("node").alias("cls"), "comp"), "cls", "left").select("sig", "cls", "n", F.coalesce("comp", "cls").alias("comp")))
    open_rows = checkpoint(_several(rows))
    # Links to other components need as many open lists as linked sets share rare shingles; what leaves may close more lists.
    enough = F.ceil(F.ceil(F.col("n") * num / den) / SPARE)
    able = open_rows.groupBy("cls", "n").agg(F.count("*").alias("k")).where(F.col("k") >= enough).select("cls")
    open_rows = checkpoint(_several(checkpoint(open_rows.drop("low").join(able, "cls"))))
    cluster_of = connected(open_rows.select(F.col("cls").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("cls"), F.col("comp").alias("cluster"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(den / num))).alias("band")
    members = checkpoint(open_rows.select("cls", "n", "comp", band).distinct().join(cluster_of, "cls"))
    # Blocks within bands of sizes: a component of BLOCK members or more has its own, the small ones share.
    per = checkpoint(members.groupBy("cluster", "band", "comp").agg(F.count("*").alias("size")))
    small = F.sum(F.when(F.col("size") < BLOCK, F.col("size")).otherwise(0))
    bands = checkpoint(per.groupBy("cluster", "band").agg(small.alias("rest"), F.count("*").alias("comps")).withColumn("at", F.struct("cluster", "band")).drop("cluster", "band"))
    per = _met(per.withColumn("at", F.struct("cluster", "band")), bands, "at", "comps").drop("at", "comps")
    own = F.struct("comp", F.pmod("cls", F.ceil(F.col("size") / BLOCK)).alias("part"))
    shared = F.struct(F.lit(None).cast("long").alias("comp"), F.pmod("comp", F.greatest(F.lit(1), F.ceil(F.col("rest") / BLOCK))).alias("part"))
    pair = F.struct("cluster", "band", "comp")
    sized = heavy_aware_join(members.withColumn("pair", pair), per.select(pair.alias("pair"), "size", "rest"), "pair", "size", members.count())
    members = checkpoint(sized.drop("pair").withColumn("block", F.xxhash64("band", F.when(F.col("size") >= BLOCK, own).otherwise(shared))).drop("size", "rest"))
    pairs = _block_pairs(members, num, den)
    same = F.when(F.col("block_x") == F.col("block_y"), F.array(F.struct(F.col("block_x").alias("block"), F.lit(2).alias("side"))))
    ends = same.otherwise(F.array(F.struct(F.col("block_x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block_y").alias("block"), F.lit(1).alias("side"))))
    roles = pairs.select("cluster", "pair", "deal", F.explode(ends).alias("end")).select("cluster", "pair", "deal", "end.block", "end.side")
    work = members.join(roles, ["cluster", "block"]).select("deal", "pair", "side", "cls", "comp").join(fetch(members.select("cls")), "cls")
    return work.repartition(_partitions(work), "deal").groupBy("deal", "pair").applyInArrow(_block_links(num, den), "a bigint, b bigint")


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _evenly(pairs: DataFrame) -> DataFrame:
    """Adds `deal`, by whose hash the rows go to all partitions in turn: a pair is much work, and few fall unevenly."""
    count = _partitions(pairs)
    place = F.pmod(F.hash("id"), F.lit(count)).alias("place")
    to = {r.place: r.id for r in pairs.sparkSession.range(32 * count).select("id", place).groupBy("place").agg(F.min("id").alias("id")).orderBy("place").limit(MOST_DEALS).collect()}
    number = F.monotonically_increasing_id()
    turn = F.pmod(F.shiftright(number, 33) + number.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(len(to)))
    return pairs.withColumn("deal", F.get(F.array(*[F.lit(v).cast("bigint") for v in to.values()]), turn.cast("int")))


def _block_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """(cluster, block_x, block_y, pair, deal) of the blocks of (cluster, band, block, n, comp) rows that can hold a link between components."""
    blocks = checkpoint(members.groupBy("cluster", "band", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1")))
    one, two = (blocks.withColumnsRenamed({c: f"{c}_{s}" for c in ("block", "lo", "hi", "c0", "c1")}) for s in ("x", "y"))
    one = one.withColumn("own", F.col("band")).withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    pairs = one.join(two, ["cluster", "band"]).where("(own < band or block_x <= block_y) and not (c0_x = c1_x and c0_y = c1_y and c0_x = c0_y)")
    pairs = pairs.where(f"{den} * hi_x >= {num} * lo_y and {den} * hi_y >= {num} * lo_x")
    return checkpoint(_evenly(pairs.select("cluster", "block_x", "block_y", F.xxhash64("cluster", "block_x", "block_y").alias("pair"))))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN, bits: int = 64) -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    first = checkpoint(src.withColumn("mark", F.xxhash64("text")).mapInArrow(_first_pass(words, bits), f"id {kind}, n bigint, cls bigint, second bigint, mark bigint, segment int, task int, counts binary"))
    keys = first.where("segment is null").select("id", "n", "cls", "second", "mark")
    counts = _sketch(first)
    # Ids that several sets share: none, but for n**2 / 2**65 of n sets.
    ids = keys.where("cls is not null").groupBy("cls").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b")
    shared = frozenset(r.cls for r in ids.select("cls").toLocalIterator())
    if shared:
        keys = keys.withColumn("cls", F.when(F.col("cls").isin(*shared), F.col("second")).otherwise(F.col("cls")))
    named = materialised(lambda: _named(src, keys.drop("second"), counts, words, num, den, namer(bits, shared)), spark)
    out = heavy_aware_join(keys.where("cls is not null"), named, "cls", "copies", keys.count())
    cols = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("name").alias("component_id")]
    return union_all([out.select(*cols), keys.where("cls is null").withColumn("name", F.col("id")).select(*cols)])


def _named(src: DataFrame, keys: DataFrame, counts: np.ndarray, words: int, num: int, den: int, name: Callable[[np.ndarray], int]) -> DataFrame:
    """(cls, copies, name): each class with the smallest id of its component."""
    bound = boundary(mean_list_length(counts), num, den)
    classes = checkpoint(keys.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("id").alias("low"), F.min("mark").alias("mark")))

    signatures = _signatures(words, num, den, bound, src.sparkSession.sparkContext.broadcast(counts), name, HOT_LIST)
    rows = src.select("text").mapInArrow(signatures, "sig bigint, role tinyint, cls bigint, n bigint, deal int")
    sorted_rows = rows.repartition("sig", "deal").sortWithinPartitions("sig", "role", "cls")
    spark = src.sparkSession
    lists = materialised(lambda: _stars(checkpoint(sorted_rows.mapInArrow(_shared, "sig bigint, role tinyint, cls bigint, n bigint")), num, den), spark)
    pairs = checkpoint(lists.where(_alike("hub_n", "n", num, den)).select("hub", "cls").distinct())
    texts = src.select("text", F.xxhash64("text").alias("mark")).where("text is not null")

    def fetch(some: DataFrame) -> DataFrame:
        return _sets(texts, some.join(classes, "cls").select("mark"), words, name)

    def star_links() -> DataFrame:
        sets = fetch(pairs.select("cls").union(pairs.select("hub")).distinct())
        return connected(_with_both(pairs, sets).select("hub", "cls", "x", "y").mapInArrow(_verify(num, den), "a bigint, b bigint"))

    comps = materialised(star_links, spark)
    across = materialised(lambda: connected(_cluster_links(lists.where(f"role = {_LIST}").select("sig", "cls", "n"), comps, fetch, num, den)), spark)

    # Classes with links, by final component; a class that only `across` knows is a component of itself.
    # A component may hold a large share of the classes, so joins on components keep large ones apart.
    roots = comps.select("comp", "n").distinct()
    merged = across.select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    alone = merged.join(roots, "comp", "left_anti").select(F.col("comp").alias("cls"), "whole")
    linked = heavy_aware_join(comps.select(F.col("node").alias("cls"), "comp"), roots.join(merged, "comp"), "comp", "n", comps.count())
    linked = linked.select("cls", F.coalesce("whole", "comp").alias("whole")).union(alone)
    linked = checkpoint(linked.join(classes.select("cls", "low"), "cls"))
    names = linked.groupBy("whole").agg(F.min("low").alias("name"), F.count("*").alias("size"))
    of_class = heavy_aware_join(linked, names, "whole", "size", linked.count()).select("cls", "name")
    return classes.join(of_class, "cls", "left").select("cls", "copies", F.coalesce("name", "low").alias("name"))
