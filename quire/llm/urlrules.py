"""URL filters: explicit host/path rules, and association rules mined by FP-growth for the rest.

Every URL becomes a list of tokens (its host and each parent domain, and its path segments by
place).  A page is labelled through the document whose number ends its path: it is to be blocked if
that document is marked as of low quality or toxic.  FP-growth over the whole labelled URLs gives
all token combinations, of any length and from anywhere in a URL, that go with a block with enough
support and confidence.  A URL that no explicit rule decides is matched against them through an
inverted index, which lists each rule under the one of its tokens that fewest rules share.

Nothing is cut to keep the mining small; what cannot change a verdict is left out.  Tokens below the
support are in no rule.  A token that is a rule by itself need not be combined.  Tokens that occur in
the same labelled URLs are one, whichever of them a URL has.  Where no labelled URL keeps more than
ITEMS tokens, Spark's FP-growth enumerates every combination, 2**ITEMS / support of them at most.
Where one does, FP-growth by shards (`_grow`) follows only free combinations, those that fit fewer
labelled URLs than any part of theirs known so far, and not beyond a rule.  Both give the same rules,
as a combination that is not free equals a part of it, and one beyond a rule matches nothing more.
The second one's time has no bound but the number of free combinations that reach the support.

Edge cases: a null URL, or one without "://", has an empty host and path, no tokens, no rule, and
is allowed; explicit rules never fit an empty path; without labelled URLs, or without blocked
ones, nothing is mined and the method allows everything; labels that are null or neither 0 nor 1
say nothing, several labels of a document block if any does; repeated URLs get equal verdicts; URLs
of any length and any number of segments are read whole; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import groupby, product
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import heavy_aware_join, sliced
from quire.runtime import checkpoint, ship

#: (host, path prefix, verdict), fixed by the contract; the longest that fits decides.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.9
#: Blocked URLs that a rule needs, however few there are in all: fewer are no evidence.
MIN_URLS = 20
#: Tokens of the rules that `mine` lists; `judge` takes rules of any length.
MAX_TOKENS = 3
#: Tokens of a labelled URL up to which every combination is enumerated; longer ones are mined by free combinations.
ITEMS = 10
#: Shards of the mining of longer ones.
SHARDS = 128
#: Rows times items up to which a shard counts pairs by a matrix product instead of in a tree.
DENSE = 2_000_000
_BLOCK = -1


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """host:<domain> for the host and each parent domain, path<i>:<segment> for each path segment."""
    labels = F.split(host, r"\.")
    hosts = F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    )
    segments = F.transform(F.split(path, "/"), lambda s, i: F.when(s != "", F.concat(F.lit("path"), i.cast("string"), F.lit(":"), s)))
    return F.array_distinct(F.concat(hosts, F.filter(segments, lambda s: s.isNotNull())))


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode()) - (1 << 63)


class Index:
    """Combinations by the token that fewest of them share."""

    def __init__(self, combos: list[tuple[int, ...]]):
        self.combos = combos
        shared = Counter(t for c in combos for t in c)
        self.lists: dict[int, list[int]] = defaultdict(list)
        for i, c in enumerate(combos):
            self.lists[min(c, key=lambda t: (shared[t], t))].append(i)

    def fits(self, here: set[int]):
        """The places of all combinations whose tokens are all there, each once."""
        for t in here:
            for i in self.lists.get(t, ()):
                if here.issuperset(self.combos[i]):
                    yield i


class Tree:
    """An FP-tree: rows of items in ascending order as paths from the root, with (rows, blocked rows) at each node."""

    def __init__(self):
        self.item, self.parent, self.n, self.bad = [-1], [0], [0], [0]
        self.below: dict[tuple[int, int], int] = {}
        self.heads: dict[int, list[int]] = defaultdict(list)

    def add(self, items, n: int, bad: int) -> None:
        at = 0
        for item in items:
            node = self.below.get((at, item))
            if node is None:
                node = self.below[at, item] = len(self.item)
                self.item.append(item)
                self.parent.append(at)
                self.n.append(0)
                self.bad.append(0)
                self.heads[item].append(node)
            at = node
            self.n[at] += n
            self.bad[at] += bad

    def before(self, item: int):
        """The (items, n, bad) of the paths that lead to an item, without it."""
        for node in self.heads[item]:
            path, at = [], self.parent[node]
            while at:
                path.append(self.item[at])
                at = self.parent[at]
            yield path[::-1], self.n[node], self.bad[node]


_DEALT = pa.schema([("shard", pa.int32()), ("items", pa.list_(pa.int32())), ("n", pa.int64()), ("bad", pa.int64())])
_FOUND = pa.schema([("combo", pa.list_(pa.int32())), ("n", pa.int64()), ("bad", pa.int64())])


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _extend(rows: list, combo: tuple[int, ...], n_combo: int, part: dict[int, list[int]], need: int, sure: float, stop: float, longest: int | None, dense: int):
    """The (combination, n, bad) of the rules that extend `combo` by items of its `rows`; `part` has the counts without its last item."""
    counts: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for items, n, bad in rows:
        for item in items:
            held = counts[item]
            held[0] += n
            held[1] += bad
    on = set()
    for item, (n, bad) in counts.items():
        if bad < need or n == n_combo or (item in part and part[item][0] == n):
            continue
        if bad >= sure * n:
            yield (*combo, item), n, bad
        if bad < stop * n and (longest is None or len(combo) + 1 < longest):
            on.add(item)
    if len(on) < 2:
        return
    if len(rows) * len(on) <= dense:
        items = sorted(on)
        place = {item: i for i, item in enumerate(items)}
        has = np.zeros((len(rows), len(items)))
        for row, (held, _, _) in zip(has, rows):
            row[[place[i] for i in held if i in on]] = 1
        yield from _pairs(has, np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float), np.array(items), combo, need, sure, stop, longest)
        return
    tree = Tree()
    for items, n, bad in rows:
        tree.add((i for i in items if i in on), n, bad)
    for item in sorted(tree.heads):
        yield from _extend(list(tree.before(item)), (*combo, item), counts[item][0], counts, need, sure, stop, longest, dense)


def _pairs(has: np.ndarray, n: np.ndarray, bad: np.ndarray, items: np.ndarray, combo: tuple[int, ...], need: int, sure: float, stop: float, longest: int | None):
    """As `_extend`, by two items or more, of which no single one is left out; `has` tells which row has which item."""
    both, blocked = (has * n[:, None]).T @ has, (has * bad[:, None]).T @ has  # whole numbers, exact below 2**53
    own = np.diag(both)
    fine = np.tril((blocked >= need) & (both != own) & (both != own[:, None]), -1)
    for a, b in zip(*np.nonzero(fine & (blocked >= sure * both))):
        yield (*combo, int(items[a]), int(items[b])), int(both[a, b]), int(blocked[a, b])
    if longest is not None and len(combo) + 2 >= longest:
        return
    fine &= blocked < stop * both
    for a in np.flatnonzero(fine.sum(1) > 1):
        rows = has[:, a] > 0
        yield from _pairs(has[rows][:, fine[a]], n[rows], bad[rows], items[fine[a]], (*combo, int(items[a])), need, sure, stop, longest)


def _grow(rows: DataFrame, need: int, sure: float, stop: float, longest: int | None, dense: int) -> DataFrame:
    """(combo, n, bad) of the rules of two items or more over distinct (items, n, bad) rows, items ascending.

    A combination belongs to its last item, and that to a shard, which has every row up to its last
    item of the shard.
    """

    def deal(batches):
        for b in sliced(batches, 128):
            out, held = [], 0
            for items, n, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                dealt = set()
                for at in range(len(items) - 1, -1, -1):
                    shard = items[at] % SHARDS
                    if shard not in dealt:
                        dealt.add(shard)
                        out.append((shard, items[: at + 1], n, bad))
                        held += at + 1
                        if held > 500_000:
                            yield _batch(out, _DEALT)
                            out, held = [], 0
            if out:
                yield _batch(out, _DEALT)

    def mine_shards(batches):
        each = (row for b in sliced(batches, 128) for row in zip(*(c.to_pylist() for c in b.columns)))
        for shard, rows in groupby(each, key=lambda r: r[0]):
            tree = Tree()
            for _, items, n, bad in rows:
                tree.add(items, n, bad)
            for item in sorted(i for i in tree.heads if i % SHARDS == shard):
                total = sum(tree.n[node] for node in tree.heads[item])
                paths = list(tree.before(item))
                found = []
                for rule in _extend(paths, (item,), total, {}, need, sure, stop, longest, dense):
                    found.append(rule)
                    if len(found) == 10_000:
                        yield _batch(found, _FOUND)
                        found = []
                if found:
                    yield _batch(found, _FOUND)

    dealt = rows.mapInArrow(deal, "shard int, items array<int>, n bigint, bad bigint").groupBy("shard", "items").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return dealt.repartition(SHARDS, "shard").sortWithinPartitions("shard").mapInArrow(mine_shards, "combo array<int>, n bigint, bad bigint")


def _enumerated(rows: DataFrame, need: int, sure: float, longest: int | None) -> DataFrame:
    """(combo, n, bad) of the rules of two items or more over (items, blocked) rows, by Spark's FP-growth."""
    items = checkpoint(rows.select(F.when(F.col("blocked"), F.array_append("items", F.lit(_BLOCK))).otherwise(F.col("items")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / items.count(), minConfidence=1.0).fit(items)  # Spark rounds its product up to `need`
    combo = F.array_sort(F.array_remove("items", _BLOCK)).alias("combo")
    sets = model.freqItemsets.select(combo, F.array_contains("items", _BLOCK).alias("blocked"), "freq")
    count = lambda blocked: F.max(F.when(F.col("blocked") == blocked, F.col("freq")))
    counts = sets.where(F.size("combo").between(2, longest or ITEMS)).groupBy("combo").agg(count(False).alias("n"), count(True).alias("bad"))
    return counts.where(F.col("bad") >= F.lit(float(sure)) * F.col("n"))


def _items(rows: DataFrame, place: dict[str, int]) -> DataFrame:
    """(items, blocked): the places of the tokens that have one, ascending, of the rows that have any."""
    held = rows.sparkSession.sparkContext.broadcast(place)

    def run(batches):
        place = held.value
        for b in sliced(batches, 128):
            items = [sorted({place[t] for t in tokens if t in place}) for tokens in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.int32())), b.column(1)], names=["items", "blocked"])

    return rows.mapInArrow(run, "items array<int>, blocked boolean").where("size(items) > 0")


def rules_of(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS, stop: float | None = None, longest: int | None = None) -> tuple[list[tuple[tuple[str, ...], float]], dict[str, str]]:
    """(rules, names) of the rules that imply a block, from (tokens, blocked) rows.

    Rules are (token combination, confidence) without those that have a more general rule at least
    as sure, or as sure as `stop`, which by default is what a rule needs: longer ones match nothing
    more.  `names` gives the name under which rules know a token that occurs in the same rows as
    another.  `longest` is for lists of short rules only.
    """
    ship(labelled.sparkSession)
    stop = min_confidence if stop is None else stop
    rows = checkpoint(labelled.select(F.array_distinct("tokens").alias("tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked")))
    total, bad = rows.agg(F.count("*"), F.count_if("blocked")).first()
    if not bad:
        return [], {}
    need = max(1, ceil(max(min_support * total, min_urls)))
    per = rows.select(F.explode("tokens").alias("token"), "blocked").groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"))
    often = sorted(((r.token, r.n, r.bad) for r in per.where(F.col("bad") >= need).toLocalIterator()), key=lambda r: (-r[1], r[0]))  # the tokens of a URL / min_support at most
    sure = {(t,): b / n for t, n, b in often if b >= min_confidence * n}
    names: dict[str, str] = {}
    open_ = [r for r in often if r[2] < stop * r[1] and r[1] < total]  # a token of every row adds nothing to another
    if len(open_) > 1 and longest != 1:
        found, names = _combined(rows, open_, need, min_confidence, stop, longest)
        sure = {(names.get(c[0], c[0]),): conf for c, conf in sure.items()} | found
    combos = sorted(sure, key=lambda c: (len(c), c))
    number = {t: i for i, t in enumerate(sorted({t for c in combos for t in c}))}
    index = Index([tuple(number[t] for t in c) for c in combos])
    general = lambda c: any(combos[i] != c and sure[combos[i]] >= min(stop, sure[c]) for i in index.fits({number[t] for t in c}))
    return [(c, sure[c]) for c in combos if not general(c)], names


def _combined(rows: DataFrame, often: list[tuple[str, int, int]], need: int, sure: float, stop: float, longest: int | None) -> tuple[dict[tuple[str, ...], float], dict[str, str]]:
    """The rules of two tokens or more among the (token, n, bad) given, the most frequent first, and the names of those that are one."""
    items = checkpoint(_items(rows, {t: i for i, (t, _, _) in enumerate(often)}))
    distinct = checkpoint(items.groupBy("items").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad")))
    marks = distinct.select(F.explode("items").alias("item"), F.xxhash64("items").alias("a"), F.xxhash64(F.lit(1), "items").alias("b"))
    first: dict[tuple, int] = {}
    one = list(range(len(often)))
    for r in sorted(marks.groupBy("item").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).collect()):
        one[r.item] = first.setdefault((often[r.item][1:], r.a, r.b), r.item)
    names = {often[i][0]: often[k][0] for i, k in enumerate(one) if i != k}
    merged = items
    if names:
        merged = checkpoint(_items(rows, {t: one[i] for i, (t, _, _) in enumerate(often)}))
        distinct = merged.groupBy("items").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"))
    most = merged.agg(F.max(F.size("items"))).first()[0]
    if most < 2:
        found = []
    elif most <= ITEMS:
        found = _enumerated(merged, need, sure, longest).collect()
    else:
        found = _grow(distinct, need, sure, stop, longest, DENSE).collect()
    return {tuple(sorted(often[i][0] for i in r.combo)): r.bad / r.n for r in found}, names


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS) -> list[tuple[tuple[str, ...], float]]:
    """(token combination, confidence) of the rules of up to MAX_TOKENS tokens, written out, surer ones beside more general ones; a list to read, which `judge` does not use."""
    rules, names = rules_of(labelled, min_support, min_confidence, min_urls, 1.0, MAX_TOKENS)
    same = defaultdict(list)
    for token, name in names.items():
        same[name].append(token)
    return [(tuple(sorted(c)), conf) for combo, conf in rules for c in product(*([t, *same[t]] for t in combo))]


def match(urls: DataFrame, rules: list[tuple[tuple[str, ...], float]], names: dict[str, str] | None = None) -> DataFrame:
    """All columns of `urls` (which has `tokens`) and `blocked`: whether some rule's tokens, or others of the same names, are all there."""
    ship(urls.sparkSession)
    used = {t for c, _ in rules for t in c}
    held = urls.sparkSession.sparkContext.broadcast(([tuple(map(_hash, t)) for t, _ in rules], {_hash(t): _hash(name) for t, name in (names or {}).items() if name in used}))

    def run(batches):
        combos, named = held.value
        index = Index(combos)
        for b in batches:
            here = ({named.get(h, h) for h in map(_hash, tokens)} for tokens in b.column(b.schema.get_field_index("tokens")).to_pylist())
            yield b.append_column("blocked", pa.array([next(index.fits(h), None) is not None for h in here], pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInArrow(run, f"{schema}, blocked boolean")


def document_of(path: Column) -> Column:
    """The number that ends a path, before a suffix or a slash; null without one."""
    return F.regexp_extract(path, r"/([0-9]+)(?:\.[a-z]+)?/?$", 1).try_cast("bigint")


def labelled_urls(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, blocked) of the (host, path) rows whose document has a label."""
    mark = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isin(0, 1) | F.col("toxic").isin(0, 1), 0)
    marks = labels.select(F.col("doc_id").alias("doc"), mark.alias("mark")).where("doc is not null and mark is not null").groupBy("doc").agg(F.max("mark").alias("mark"))
    rows = parts.select("host", "path", document_of(F.col("path")).alias("doc")).where("doc is not null")
    per = rows.groupBy("doc").agg(F.count("*").alias("n")).join(marks, "doc")
    met = heavy_aware_join(rows, per, "doc", "n", rows.count()).where("mark is not null")
    return met.select(tokens_of(F.col("host"), F.col("path")).alias("tokens"), (F.col("mark") == 1).alias("blocked"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS) -> DataFrame:
    """(id, host, path, rule, verdict) of every URL; `labels` has doc_id, quality and toxic."""
    url = pages[url_col]
    parts = pages.select(pages[id_col].alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    known = parts.select("*", rule.alias("rule"), verdict.alias("given"), tokens_of(F.col("host"), F.col("path")).alias("tokens"))
    mined, names = rules_of(labelled_urls(parts, labels), min_support, min_confidence, min_urls)
    return match(known, mined, names).select(id_col, "host", "path", "rule", F.coalesce("given", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
