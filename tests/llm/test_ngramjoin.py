import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from quire.llm import graph, ngramjoin
from quire.llm.shingles import shingle_set, shingle_sets
from tests.llm.conftest import same, sample_texts, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, num=80, den=100):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return [(key, len(sets[i]), low.get(find(i))) for i, (key, _) in enumerate(rows)]


def run(frame, **more):
    return [tuple(r) for r in ngramjoin.components(frame, **more).select("doc_id", "n_shingles", "component_id").collect()]


def test_matches_brute_force(docs):
    assert same(run(docs), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_clashing_columns_are_ignored(docs, wide_docs):
    assert same(run(wide_docs), run(docs))


def test_empty_table(no_docs):
    assert run(no_docs) == []


def test_random_small_sets(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 16), 3))) for i in range(150)]
    rows += [(1000 + i, " ".join(f"q{k}" for k in range(20) if k != rng.randrange(40))) for i in range(60)]
    assert same(run(spark.createDataFrame(rows, "doc_id bigint, text string")), brute(rows))


def test_dense_group_around_the_threshold(spark, monkeypatch):
    """Near copies of one text that only partly link, cut into blocks of a few classes."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    rng = random.Random(7)
    base = words(rng, 150, 10_000)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w[: rng.randrange(125, 151)])))
    assert same(run(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)), brute(rows))


def test_sets_that_share_an_id(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert same(run(docs, bits=3), brute(rows))


def test_long_lists_and_busy_hubs(spark, docs, monkeypatch):
    """Every list and hub is treated as one that is too hot for a task."""
    monkeypatch.setattr(ngramjoin, "HOT_LIST", 3)
    monkeypatch.setattr(ngramjoin, "HOT_ROWS", 1)
    monkeypatch.setattr(ngramjoin, "SPOKES", 2)
    assert same(run(docs), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_one_giant_templated_cluster(spark, monkeypatch):
    """Texts of one template whose own parts are just too large to link: few pairs of blocks are compared, no link is lost."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    counted = []
    real = ngramjoin._block_pairs

    def counting(members, num, den):
        pairs = real(members, num, den)
        blocks = members.select("cluster", "block").distinct().count()
        counted.append((pairs.count(), blocks))
        return pairs

    monkeypatch.setattr(ngramjoin, "_block_pairs", counting)
    rng = random.Random(19)
    template = words(rng, 400, 10**6)
    rows = []
    for i in range(200):
        size = rng.randrange(60, 400)
        own = [f"o{i}x{k}" for k in range(int(size * rng.choice([0.05, 0.12, 0.2, 0.3])))]
        rows.append((i, " ".join([*own, *template[:size]])))
    assert same(run(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)), brute(rows))
    ((pairs, blocks),) = counted
    assert blocks > 4 and pairs < 0.6 * blocks * (blocks + 1) / 2


def test_pairs_are_dealt_evenly(spark):
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ngramjoin._evenly(spark.range(25 * count, numPartitions=1)).repartition(count, "deal")
    sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sizes == [25] * count


def test_signatures_lose_no_link():
    """Each linked pair of light sets shares a subset, each other linked pair enough of its prefixes."""
    rng = random.Random(1)
    counts = np.array(np.random.default_rng(0).integers(0, 5, (2, ngramjoin._WIDTH)))
    bound = 9
    for _ in range(3000):
        n = rng.randrange(1, 60)
        a = np.array(sorted(rng.sample(range(1, 10**6), n)), np.uint64)
        keep = a[np.array(sorted(rng.sample(range(n), max(1, n - rng.randrange(0, 1 + n // 8)))))]
        b = np.unique(np.concatenate([keep, np.array(rng.sample(range(10**6, 2 * 10**6), rng.randrange(0, 1 + n // 9)), np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 5 * both < 4 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        if max(len(a), len(b)) <= bound:
            x, y = (dict(ngramjoin._light(s, bound, 4, 5)) for s in (a, b))
            assert any(s in y and (x[s] != y[s] or x[s] == ngramjoin._MUTUAL) for s in x)
        else:
            x, y = (ngramjoin.prefix(s, counts)[0] for s in (a, b))
            small = min(len(a), len(b))
            assert len(np.intersect1d(x, y)) >= ngramjoin.common_rare(small) >= -(--(-(-max(len(a), len(b)) * 4 // 5)) // ngramjoin.SPARE) - 1


def test_batched_hashing_is_the_same():
    texts = sample_texts()
    assert all(np.array_equal(shingle_set(t, 5), s) for t, s in zip(texts, shingle_sets(texts, 5)))


@pytest.mark.parametrize("at_once", [0, 1000])
def test_components_of_long_chains(spark, at_once):
    rng = random.Random(2)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)]
    edges = list(zip(ids[:39], ids[1:40])) + [(ids[250], ids[251])]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: (r.comp, r.n) for r in graph.connected(frame, at_once).collect()}
    assert len({got[i] for i in ids[:40]}) == 1 and got[ids[0]][1] == 40
    assert got[ids[250]] == got[ids[251]] and got[ids[250]] != got[ids[0]]
