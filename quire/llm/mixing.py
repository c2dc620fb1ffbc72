"""Mixing sources to target weights, in DataFrame operations only.

Each source's words, its documents laid end to end in a hashed order, are packed into blocks of
BLOCK words; only the last block of a source may be shorter.  A source is to give `target` words,
so it has slots: one per block for each whole pass over the source, then as many as the rest
needs.  There is an output shard for every SHARD_SLOTS slots.  The counts of a source's slots over
the shards are drawn from a multinomial whose total is that number of slots (with free totals small
sources would miss their targets, and others would pass twice their size).  Within a source, slots
are numbered shard by shard; slot i of a pass is mapped to a block by a swap-or-not permutation
keyed by source and pass, and blocks meet the documents by an equi-join on (source, block).  No pass
repeats a block, and targets stop at twice the source, so no document is taken more than twice.

Equal rows are laid out as one row with a count and unfold in portions, so that copies of one row
never gather in a task; rows meet their texts by 128 bits of hash.

Edge cases: null or empty text has size 0 and is taken 0 times; sources rank by code point, the
null source last; a source without words has target 0; repeated rows take part each; documents of
any length span as many blocks as they need; extra columns are ignored by `mix` and kept by
`mixed_documents`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from quire.llm.common import HEAVY, WORD, heavy_aware_join, union_all
from quire.runtime import checkpoint

BLOCK = 512
SHARD_SLOTS = 16_384
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20_240_607
ROUNDS = 24
_BUCKET_DOCS = 64
_SUPER = 256
#: Rows that one row unfolds to at once.
_PORTION = 4096
#: Source tables up to this many rows are broadcast and ranked in one task; larger ones are joined with hot sources apart and ranked by range.
_SMALL = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranked(sources: DataFrame, small: int) -> DataFrame:
    """Adds `rank` from 1 in code point order, null last."""
    order = F.asc_nulls_last("source")
    if sources.count() <= small:
        return sources.withColumn("rank", F.row_number().over(Window.orderBy(order)))
    ranges = checkpoint(sources.repartitionByRange(_partitions(sources), order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    begins = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return ranges.withColumn("within", within).join(F.broadcast(begins), "range").withColumn("rank", F.col("begin") + F.col("within")).drop("range", "within", "begin")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds `weight` and `target` to (source, source_size): `share` of all words, by weight, none above `most` times its size.

    The excess of capped sources goes to the others by weight, round by round, until none is above;
    a round brings three numbers to the driver, however many sources there are.
    """
    place = ((F.col("rank") - 1) % len(weights) + 1).cast("int")
    w = _ranked(sources, _SMALL).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("double"))
    w = checkpoint(w.withColumn("cap", most * F.col("source_size").cast("double")).drop("rank"))
    words, weight = w.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = share * (words or 0) / weight if weight else 0.0, 0
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        full, free, now = w.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if now == capped or not free:
            return w.withColumn("target", F.when(over, F.col("cap")).otherwise(F.lit(level) * F.col("weight"))).drop("cap")
        level, capped = (share * words - full) / free, now


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """The place of i under a swap-or-not permutation of 0..n-1, chosen by `key`.

    Each round pairs i with (K - i) mod n and swaps the two or not by one hashed bit of the larger.
    """

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - at, n)
        bit = F.pmod(F.xxhash64(F.lit(SEED + 1), r, F.greatest(at, other), *key), F.lit(2)) == 1
        return F.when(bit, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i.cast("long"), step)


def _unhashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _unhashable(kind.elementType)
    if isinstance(kind, StructType):
        return any(_unhashable(f.dataType) for f in kind.fields)
    return isinstance(kind, (MapType, VariantType))


def _marks(docs: DataFrame, names: list[str]) -> tuple[Column, Column]:
    """128 bits of hash of the named columns, nulls included."""
    cols = [F.to_json(F.struct(docs[c])) if _unhashable(docs.schema[c].dataType) else docs[c] for c in names]
    nulls = F.array(*[c.isNull() for c in cols])
    return F.xxhash64(F.lit(SEED + 3), nulls, *cols), F.xxhash64(F.lit(SEED + 4), nulls, *cols)


def _unfolded(rows: DataFrame, count: str, name: str, spread: bool = False) -> DataFrame:
    """Each row `count` times, with the number of the copy as `name`.

    Rows of many copies, or with `spread` all rows, are dealt out in portions before they unfold.
    """
    last = F.col(count) - 1
    many = rows if spread else rows.where(f"{count} > {_PORTION}")
    portions = many.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {_PORTION}"))))
    first = F.col(name) * _PORTION
    out = portions.repartition(_partitions(rows), *rows.columns[:2], name).withColumn(name, F.explode(F.sequence(first, F.least(first + (_PORTION - 1), last))))
    if not spread:
        out = out.unionByName(rows.where(f"{count} <= {_PORTION}").withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last))))
    return out


def _laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str, whole_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(distinct rows with their place in their source and their number, sources with targets), both materialised.

    Rows are told apart by id, source and text, or by all their columns.
    """
    text = docs[text_col]
    mark, second = _marks(docs, [id_col, text_col])
    a, b = _marks(docs, docs.columns) if whole_rows else (mark, second)
    read = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), mark.alias("mark"), a.alias("a"), b.alias("b"), size_of(text).alias("size"))
    read = read.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = checkpoint(read.groupBy("a", "b", "skey", "source", "mark", "id", "size").agg(F.count("*").alias("copies")))
    stats = rows.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows"), F.count("*").alias("n"))
    sources = checkpoint(targets(checkpoint(stats)).drop("source"))
    rows = rows.drop("source")
    counted = sources.agg(F.count("*"), F.sum("n")).first()
    if counted[0] <= _SMALL:
        rows = rows.join(F.broadcast(sources), "skey", "left")
    else:
        rows = heavy_aware_join(rows, sources, "skey", "n", counted[1] or 0)
    # A running sum in three levels, so that no task holds more than a bucket, or a list of totals.
    words = F.col("size") * F.col("copies")
    rows = rows.withColumn("bucket", F.pmod(F.col("mark"), F.ceil(F.col("n") / _BUCKET_DOCS)))
    totals = rows.groupBy("skey", "bucket").agg(F.sum(words).alias("words")).withColumn("part", F.expr(f"bucket div {_SUPER}"))
    inner = Window.partitionBy("skey", "part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("skey", "part").agg(F.sum("words").alias("words")).select("skey", "part", F.coalesce(F.sum("words").over(outer), F.lit(0)).alias("base"))
    begins = totals.join(parts, ["skey", "part"]).select("skey", "bucket", (F.col("base") + F.coalesce(F.sum("words").over(inner), F.lit(0))).alias("begin"))
    within = Window.partitionBy("skey", "bucket").orderBy("mark", "a", "b", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(begins, ["skey", "bucket"]).withColumn("start", F.col("begin") + F.coalesce(F.sum(words).over(within), F.lit(0)))
    return checkpoint(placed.select("a", "b", "id", "skey", "size", "source_size", "target", "start", "copies")), sources


def draws(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(skey, shard, n, first, and what slots need of their source): the multinomial counts of each source over the shards.

    Every slot of a source draws a shard; counted, that is one multinomial a source.  `first` is the
    number of a shard's first slot within its source.
    """
    s = sources.where("source_size > 0").select("skey", "source_size", F.least(F.round("target"), MOST * F.col("source_size")).cast("long").alias("need"))
    s = s.withColumn("full", F.expr(f"source_size div {block}")).withColumn("blocks", F.ceil(F.col("source_size") / block))
    s = s.withColumn("passes", F.expr("need div source_size"))
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil((F.col("need") - F.col("passes") * F.col("source_size")) / block)).where("slots > 0")
    shards = max(1, -(-(s.agg(F.sum("slots")).first()[0] or 0) // shard_slots))
    drawn = _unfolded(s, "slots", "slot", spread=True).withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED + 2), "skey", "slot"), F.lit(shards)))
    about = ["skey", "source_size", "need", "full", "blocks"]
    counts = drawn.groupBy("shard", *about).agg(F.count("*").alias("n"))
    before = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("shard", *about, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(skey, slot, epoch, block, shard, take): what each slot of each source takes of which block, for which shard."""
    drawn = checkpoint(draws(sources, block, shard_slots))
    each = _unfolded(drawn, "n", "i", spread=True).withColumn("slot", F.col("first") + F.col("i"))
    each = each.withColumn("epoch", F.expr("slot div blocks")).withColumn("i", F.expr("slot % blocks"))
    # The short last block, if any, ends each pass; all others are permuted.
    each = each.withColumn("block", F.when(F.col("i") < F.col("full"), permuted(F.col("i"), F.col("full"), F.col("skey"), F.col("epoch"))).otherwise(F.col("i")))
    done = F.col("epoch") * F.col("source_size") + F.col("i") * block
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    return each.select("skey", "slot", "epoch", "block", "shard", F.least(length, F.col("need") - done).alias("take"))


def spans(placed: DataFrame, sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(document columns, copy, epoch, shard, from_word, words): the stretches of each document that the mix takes."""
    rows = _unfolded(placed.where("size > 0"), "copies", "copy").withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    pieces = rows.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    lo = F.greatest("start", F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.withColumn("from_word", lo - F.col("start")).withColumn("at", lo - F.col("block") * block).withColumn("length", hi - lo)
    # What the slots unfold to grows with the corpus: never broadcast it.
    met = pieces.join(slots(sources, block, shard_slots).hint("merge"), ["skey", "block"], "left")
    words = F.when(F.col("take") > F.col("at"), F.least(F.col("length"), F.col("take") - F.col("at"))).otherwise(0)
    return met.withColumn("words", words).drop("at", "length", "take", "slot")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(id, size, source_size, target, taken, shards) of every document; `shards` are the output shards that hold words of it."""
    placed, sources = _laid_out(docs, id_col, text_col, source_col)
    shard = F.sort_array(F.collect_set(F.when(F.col("words") > 0, F.col("shard"))))
    some = spans(placed, sources, block, shard_slots).groupBy("skey", "start", "id", "size", "source_size", "target").agg(F.sum("words").alias("taken"), shard.alias("shards"))
    none = _unfolded(placed.where("size = 0"), "copies", "copy").withColumn("taken", F.lit(0)).withColumn("shards", F.array().cast("array<bigint>"))
    cols = [F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "shards"]
    return union_all([some.select(*cols), none.select(*cols)])


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", block: int = BLOCK, shard_slots: int = SHARD_SLOTS, shard_col: str | None = None
) -> DataFrame:
    """The mix as documents: one row per document and pass, with the columns of `docs`.

    A document that a pass takes whole keeps its text; otherwise its text is the words taken,
    joined by single spaces.  `length_col`, if given, is the new length; `shard_col`, if given, is
    the output shard in which what was taken begins.
    """
    placed, sources = _laid_out(docs, id_col, text_col, source_col, whole_rows=True)
    stretch = F.struct("from_word", "words", "shard")
    taken = spans(placed, sources, block, shard_slots).where("words > 0").groupBy("skey", "start", "epoch", "a", "b", "copy", "size")
    got = taken.agg(F.sort_array(F.collect_list(stretch)).alias("got"), F.sum("words").alias("taken")).select("a", "b", "copy", "size", "got", "taken")
    got = got.withColumnsRenamed({c: f"mix {c}" for c in got.columns})
    a, b = _marks(docs, docs.columns)
    texts = docs.withColumn("mix a", a).withColumn("mix b", b).dropDuplicates(["mix a", "mix b"])
    key = ["mix a", "mix b"]
    # Rows with very many copies, at most HEAVY by pigeonhole, are joined in portions of their copies.
    total = sources.agg(F.sum("rows")).first()[0] or 0
    hot = placed.where(f"copies > {_PORTION} and copies * {HEAVY} > {total}").select(F.col("a").alias("mix a"), F.col("b").alias("mix b"), F.expr(f"(copies - 1) div {_PORTION}").alias("mix last"))
    if not hot.isEmpty():
        portion = F.when(F.col("mix last").isNotNull(), F.expr(f"`mix copy` div {_PORTION}")).otherwise(0)
        got = got.join(F.broadcast(hot), key, "left").withColumn("mix part", portion.cast("long")).drop("mix last")
        texts = texts.join(F.broadcast(hot), key, "left").withColumn("mix part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("mix last", F.lit(0))))).drop("mix last")
        key = [*key, "mix part"]
    met = texts.join(got.hint("merge"), key)
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), 1)
    picked = F.array_join(F.flatten(F.transform("mix got", lambda g: F.slice(words, (g["from_word"] + 1).cast("int"), g["words"].cast("int")))), " ")
    out = met.withColumn(text_col, F.when(F.col("mix taken") == F.col("mix size"), F.col(text_col)).otherwise(picked))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns, *([F.get("mix got", F.lit(0))["shard"].alias(shard_col)] if shard_col else []))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """`mixed_documents` as Parquet below `path`, a folder `shard=N` for each output shard."""
    out = mixed_documents(docs, shard_col="shard", **options)
    out.repartition(_partitions(docs), "shard").write.partitionBy("shard").parquet(path)
