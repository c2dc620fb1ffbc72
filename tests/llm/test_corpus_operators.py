"""Mixing, line dedup, quality, URL filters and exact top-k against brute force."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import linededup, mixing, quality, topk, urlrules
from tests.llm.conftest import DOCS, same

# Mixing.


def brute_targets(sizes: dict) -> dict:
    """Share 150 % by weights 5, 2, 1 in code point order, hand excess back until none is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = dict.fromkeys(names, 0.0), set()
    pool = 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = pool - sum(2 * sizes[s] for s in capped)
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = 2.0 * sizes[s]
        capped |= set(over)


def check_mix(frame):
    rows = frame.select("doc_id", "text", "source").collect()
    got = mixing.mix(frame, block=16).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    total = Counter()
    for r in rows:
        total[r.source] += size(r.text)
    want = brute_targets(dict(total))
    assert same([(r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got], [(r.doc_id, size(r.text), total[r.source], round(want[r.source], 6)) for r in rows])
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
    per = Counter((total[s], round(want[s], 6)) for s in total)
    assert all(abs(v - k[1] * per[k]) <= per[k] for k, v in taken.items())
    return got


def test_mix(docs, wide_docs):
    first = check_mix(docs)
    assert same(first, mixing.mix(docs, block=16).collect())
    assert same(first, mixing.mix(wide_docs.repartition(5), block=16).collect())


def test_mix_of_empty_tables(no_docs, spark):
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], DOCS)
    assert same(mixing.mix(blank).collect(), [(1, 0, 0, 0.0, 0, []), (2, 0, 0, 0.0, 0, [])])


def test_mix_with_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_SMALL", 2)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 90), "en", "hot" if i % 3 else f"s{rng.randrange(9)}", 1) for i in range(400)]
    check_mix(spark.createDataFrame(rows, DOCS))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("key"))).collect()]
        assert sorted(got) == list(range(n))


def test_draws_are_multinomial(spark):
    sizes = [40_000, 10_000, 3, 0, 2_000]
    sources = spark.createDataFrame([(f"s{i}", n, 1.5 * n) for i, n in enumerate(sizes)], "skey string, source_size bigint, target double")
    drawn = mixing.draws(sources, 4, 1000)
    half_up = lambda n: int(1.5 * n + 0.5)
    want = {f"s{i}": -(-n // 4) + -(-(half_up(n) - n) // 4) for i, n in enumerate(sizes) if n}
    rows = sorted((r.skey, r.shard, r.n, r["first"]) for r in drawn.collect())
    shards = -(-sum(want.values()) // 1000)
    for s, total in want.items():
        mine = [r for r in rows if r[0] == s]
        assert sum(r[2] for r in mine) == total and all(0 <= r[1] < shards for r in mine)
        assert [r[3] for r in mine] == list(np.cumsum([0, *(r[2] for r in mine)])[:-1])
        if total > 1000:  # counts vary as a multinomial does: neither equal nor wild
            counts = [r[2] for r in mine]
            expected = total / shards
            chi = sum((c - expected) ** 2 / expected for c in counts) + (shards - len(counts)) * expected
            assert 0.2 * shards < chi < 3 * shards
    slots = mixing.slots(sources, 4, 1000).collect()
    assert Counter((r.skey, r.shard) for r in slots) == {r[:2]: r[2] for r in rows}
    assert all(c == 1 for c in Counter((r.skey, r.epoch, r.block) for r in slots).values())
    assert {s: sum(r.take for r in slots if r.skey == s) for s in want} == {f"s{i}": half_up(n) for i, n in enumerate(sizes) if n}


def test_the_draw_is_in_the_plan(docs):
    for out in (mixing.mix(docs, block=16, shard_slots=8), mixing.mixed_documents(docs, block=16, shard_slots=8, shard_col="shard")):
        assert "shard" in out._jdf.queryExecution().optimizedPlan().toString()
    shards = {x for r in mixing.mix(docs, block=16, shard_slots=8).collect() for x in r.shards}
    assert len(shards) > 10
    whole = mixing.mixed_documents(docs, block=16, shard_slots=8, shard_col="shard")
    assert set(whole.select("shard").distinct().toPandas().shard) <= shards


def test_shard_files(docs, tmp_path):
    mixing.write_shards(docs, str(tmp_path / "mix"), block=16, shard_slots=32)
    back = docs.sparkSession.read.parquet(str(tmp_path / "mix"))
    assert same(back.select(*docs.columns, "shard").collect(), mixing.mixed_documents(docs, block=16, shard_slots=32, shard_col="shard").collect())


def test_targets_of_very_many_sources(spark, monkeypatch):
    rng = random.Random(4)
    sizes = {f"h{i}": rng.choice([0, 1, 5, 100, 3000]) for i in range(300)} | {None: 77}
    frame = spark.createDataFrame([(f"k{s}", s, n) for s, n in sizes.items()], "skey string, source string, source_size bigint")
    want = brute_targets(sizes)
    monkeypatch.setattr(mixing, "_SMALL", 20)
    got = {r.source: (r.target, r.weight) for r in mixing.targets(frame).collect()}
    assert all(abs(got[s][0] - want[s]) < 1e-6 for s in sizes) and len(got) == len(sizes)


def test_copies_of_one_row_unfold_in_portions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_PORTION", 8)
    hot = (None, "a b c d e f g h i j", "en", "a", 19)
    rows = [hot] * 150 + [(i, f"x{i} " * (i % 7), "en", "ab"[i % 2], 1) for i in range(150)] + [(None, "", "en", "b", 0)] * 20
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    got = check_mix(frame)
    assert same(got, mixing.mix(frame.repartition(2), block=16).collect())
    out = mixing.mixed_documents(frame, block=16).collect()
    taken = sum(len(r.text.split()) for r in out if r.doc_id is None)
    assert taken == sum(r.taken for r in got if r.doc_id is None) and all(set(r.text.split()) <= set("abcdefghij") for r in out if r.doc_id is None)


def test_rows_that_differ_in_other_columns_keep_them(spark):
    rows = [(1, "w " * 40, "en", "a", 1, {"k": 1}), (1, "w " * 40, "de", "a", 2, None), (1, "w " * 40, None, "a", 3, {})]
    frame = spark.createDataFrame(rows, DOCS + ", m map<string,int>")
    out = mixing.mixed_documents(frame, block=16)
    assert out.columns == frame.columns
    assert all((r.lang, r.m) in [("en", {"k": 1}), ("de", None), (None, {})] for r in out.collect())
    assert sum(len(r.text.split()) for r in out.collect()) == 180


def test_mixed_documents(docs, wide_docs):
    for frame in (docs, wide_docs):
        out = mixing.mixed_documents(frame, block=16)
        assert out.columns == frame.columns
        taken = {r.doc_id: r.t for r in mixing.mix(frame, block=16).groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()}
        words = defaultdict(int)
        texts = defaultdict(set)
        for r in frame.collect():
            texts[r.doc_id].add(tuple((r.text or "").encode().split()))
        for r in out.collect():
            w = r.text.encode().split()
            words[r.doc_id] += len(w)
            assert r.n_chars == len(r.text) and any(set(w) <= set(t) for t in texts[r.doc_id])
        assert {k: v for k, v in taken.items() if v} == dict(words)


# Line dedup.


def brute_dedup(rows):
    """Drop every chunk whose bytes occur at an earlier place."""
    seen = {}
    for key, text in sorted(((k, t) for k, t in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        for at, _, data, counts in linededup.chunks(text):
            if counts:
                place = (key is None, key or 0, at)
                seen[data] = min(seen.get(data, place), place)
    out = []
    for key, text in rows:
        kept = None if text is None else "\n".join(d.decode() for at, _, d, counts in linededup.chunks(text) if not counts or seen[d] == (key is None, key or 0, at))
        out.append((key, kept))
    return out


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(12)
    lines = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    passage = lines[:8]
    long_line = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(60):
        body = [rng.choice(lines) for _ in range(rng.randrange(1, 12))]
        if i % 3 == 0:
            body[rng.randrange(len(body)) : 0] = passage
        if i % 4 == 0:
            body.insert(rng.randrange(len(body) + 1), long_line)
        rows.append((i, "\n".join(body), "en", "s", 1))
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "one line", "en", "s", 8), (103, "one line", "en", "s", 8), (None, "\n".join(passage), "en", "s", 1), rows[3], rows[0], (104, long_line + "\n" + long_line, "en", "s", 9), (105, "\n\n\n", "en", "s", 3)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_line_dedup(lined):
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    got = linededup.dedup(lined).collect()
    assert same([(r.doc_id, r.text) for r in got], brute_dedup(rows))
    assert sum(r.n_removed for r in got) > 20
    assert {r.doc_id for r in got if "p0 p1 p2" in (r.text or "")} == {0}


def test_line_dedup_edges(lined, docs, wide_docs, no_docs):
    assert linededup.dedup(no_docs).collect() == []
    got = linededup.dedup(wide_docs)
    assert got.columns == [*wide_docs.columns, "n_removed"]
    assert same(got.select("doc_id", "text").collect(), brute_dedup([(r.doc_id, r.text) for r in docs.collect()]))


def test_chunks_put_together_are_the_text(lined):
    for r in lined.where("text is not null").collect():
        assert "\n".join(d.decode() for _, _, d, _ in linededup.chunks(r.text)) == r.text


def test_boundaries_depend_on_two_lines_only():
    """Whether a chunk ends after a line follows from it and the one before, wherever they stand; about a third of lines end one."""
    rng = random.Random(14)
    lines = [f"line {i}" for i in range(40)] + [" ".join(f"l{k}" for k in range(50 + i)) for i in range(3)]
    ends, count = {}, Counter()
    for _ in range(300):
        text = [rng.choice(lines) for _ in range(rng.randrange(2, 60))]
        found = linededup.chunks("\n".join(text))
        assert [at for at, *_ in found] == list(np.cumsum([0, *(n for _, n, _, _ in found)])[:-1])
        assert all(counts == (n > 1 or len(data.split()) >= 50) for _, n, data, counts in found)
        last = {at + n - 1 for at, n, _, _ in found}
        for i in range(1, len(text) - 1):
            if len(text[i].split()) >= 50 or len(text[i + 1].split()) >= 50:
                continue  # a long line is a chunk, so one ends before it too
            before = None if len(text[i - 1].split()) >= 50 else text[i - 1]
            assert ends.setdefault((before, text[i]), i in last) == (i in last)
    share = sum(ends.values()) / len(ends)
    assert 0.25 < share < 0.42


def test_boundaries_do_not_shift():
    rng = random.Random(3)
    lines = [f"line {rng.randrange(10**9)}" for _ in range(200)]
    a = {d for _, _, d, _ in linededup.chunks("\n".join(lines))}
    b = {d for _, _, d, _ in linededup.chunks("\n".join(["new", "lines", *lines]))}
    assert len(a - b) <= 2


def brute_runs(rows):
    """Drop every run of lines with 50 words that stands at an earlier place; knows nothing of chunks and windows."""
    first, runs = {}, []
    for n, (key, text) in enumerate(rows):
        lines = text.split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(lines[a : b + 1])
                if sum(len(x.split()) for x in run) >= 50:
                    runs.append((n, a, b, run))
                    first[run] = min(first.get(run, (key, a)), (key, a))
    gone = {(n, i) for n, a, b, run in runs if first[run] != (rows[n][0], a) for i in range(a, b + 1)}
    return [(key, "\n".join(x for i, x in enumerate(text.split("\n")) if (n, i) not in gone)) for n, (key, text) in enumerate(rows)]


def test_repeated_runs_go_whole(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(-(-60 // n) + rng.randrange(4)) for _ in range(n)] for n in (*range(2, 11), *range(2, 11))]
    passages.append([line(30), line(30), line(5)])  # the tail is in no shortest run from a line on
    passages.append([line(5), line(30), line(30)])
    passages.append([line(9), line(60), line(3)])
    short = [line(12) for _ in range(3)]  # under 50 words, and never two in a row
    rows = []
    for k in range(4 * len(passages)):
        own = lambda: [line(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 5))]
        rows.append((k, "\n".join([*own(), *passages[k % len(passages)], *own(), rng.choice(short), *own()])))
    rows.append((900, "\n".join([line(40)] * 5)))
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOCS).repartition(3)
    got = linededup.dedup_runs(frame).collect()
    assert same([(r.doc_id, r.text) for r in got], brute_runs(rows))
    assert all(r.n_chars == len(r.text) for r in got) and sum(r.n_removed for r in got) == 3 * len(passages) + 1


def test_repeated_runs_edges(spark, wide_docs, no_docs):
    assert linededup.dedup_runs(no_docs).collect() == []
    assert linededup.dedup_runs(wide_docs).columns == [*wide_docs.columns, "n_removed"]
    page = "\n\n" + "\n\n".join(f"a{i} " * 20 for i in range(4)) + "\n\n"
    rows = [(1, page), (2, page), (2, page), (3, "one line"), (4, "one line"), (5, None), (6, ""), (None, page + "own")]
    got = linededup.dedup_runs(spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS)).collect()
    assert same([(r.doc_id, r.text) for r in got if r.doc_id], [(1, page), (2, ""), (2, ""), (3, "one line"), (4, "one line"), (5, None), (6, "")])
    assert [r.text.split() for r in got if not r.doc_id] == [["own"]]


def test_line_dedup_of_null_and_repeated_ids(spark):
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(20)) for i in range(4))
    rows = [(None, f"{passage}\nown {k}") for k in range(40)] + [(7, f"{passage}\nother {k}") for k in range(5)] + [(None, f"{passage}\nown 3")]
    frame = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS).repartition(3)
    got = linededup.dedup_runs(frame).collect()
    whole = [r for r in got if "p0x0" in r.text]
    assert [r.doc_id for r in whole] == [7]  # the smallest document; null ids come last
    tails = [t.split("\n")[-1] for _, t in rows]
    tails.remove(whole[0].text.split("\n")[-1])
    assert sorted(r.text for r in got if r is not whole[0]) == sorted(tails)


def test_only_affected_documents_are_shuffled(lined):
    plan = linededup.dedup_runs(lined)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan


def test_long_lines_parted_by_tabs(spark):
    long = "\t".join(f"t{i}" for i in range(60))
    rows = [(k, f"own {k}\n{long}\nlast {k}", "en", "s", 1) for k in range(3)]
    got = linededup.dedup_runs(spark.createDataFrame(rows, DOCS)).collect()
    assert same([(r.doc_id, r.text) for r in got], [(0, rows[0][1]), (1, "own 1\nlast 1"), (2, "own 2\nlast 2")])


# Quality.


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(21)
    rows, marks = [], []
    for i in range(600):
        good = i % 4 != 0
        w = [f"{rng.choice('abcdefgh')}{rng.choice(['and', 'er', 'ing', 'ou'])}" for _ in range(rng.randrange(20, 80))]
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w), "en", "s", 1))
        if i % 2:
            marks.append((i, int(good), 0))
        elif i % 8 == 0:
            marks.append((i, 0, 0))
    rows += [(7000, None, None, None, None), (7001, "", "en", "s", 0), (None, "some text here", "en", "s", 1), rows[0]]
    marks += [(None, 1, 0), (1, None, 0), (3, 9, 0)]
    return spark.createDataFrame(rows, DOCS).cache(), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").cache()


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    out = [r for r in got if r.held_out and r.doc_id < 7000]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in out]) > 0.97


def test_held_out_labels_are_not_read(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert same(quality.score(docs, quality.fit(docs, flipped)).collect(), quality.score(docs, quality.fit(docs, labels)).collect())


def test_quality_edges(labelled, docs, wide_docs, no_docs):
    own, labels = labelled
    trees = quality.fit(own, labels)
    assert quality.score(no_docs, trees).collect() == []
    assert same(quality.score(docs, trees).collect(), quality.score(wide_docs, trees).collect())
    assert quality.score(docs, quality.fit(no_docs, labels)).where("score <> 0.5").isEmpty()
    assert quality.fit(own, labels.where("quality = 1")).score(np.zeros((1, len(quality.STATISTICS))))[0] > 0.99
    kept = quality.keep_good(wide_docs, trees)
    assert kept.columns == wide_docs.columns
    assert same(kept.select("doc_id", "text").collect(), wide_docs.join(quality.score(wide_docs, trees).where("predicted = 1").select(F.col("doc_id").alias("k")).distinct(), F.expr("doc_id <=> k")).select("doc_id", "text").collect())


def test_labels_are_compared_as_they_are(labelled):
    docs, labels = labelled
    odd = labels.withColumn("quality", F.col("quality").cast("double"))
    odd = odd.unionByName(labels.select("doc_id", F.when(F.col("quality") == 1, 0.9).otherwise(1.7).alias("quality"), "toxic"))
    x = np.random.default_rng(2).normal(size=(20, len(quality.STATISTICS)))
    assert (quality.fit(docs, odd).score(x) == quality.fit(docs, labels).score(x)).all()


def test_trees_walk_like_plain_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    trees = quality.grow(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=10, depth=3)
    for row, got in zip(x[:50], trees.score(x[:50])):
        total = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += leaf[node - len(f)]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12


# URL filters.

URLS = [
    (1, "http://A.Example.ORG/es/x?q=1", "a.example.org", "/es/x", "example.org/es/", "block"), (2, "https://b.org", "b.org", "", None, "allow"), (3, "https://b.org/", "b.org", "/", "org/", "allow"),
    (4, "http://example.org/en/12#top", "example.org", "/en/12", "example.org/en/1", "block"), (5, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (6, "http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), (7, "http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"), (8, None, "", "", None, "allow"), (9, "no scheme", "", "", None, "allow"),
    (10, "http://", "", "", None, "allow"), (11, "a://b://c/d", "b:", "//c/d", None, "allow"), (12, "http://x.net:80?/fr/", "x.net:80", "", None, "allow"),
]


def test_url_rules(spark):
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u, *_ in URLS] + [(1, URLS[0][1], "x", "y")], "page_id bigint, url string, host string, tokens string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = urlrules.judge(frame, none)
    assert same(got.collect(), [(i, h, p, r, v) for i, _, h, p, r, v in URLS] + [(1, *URLS[0][2:])])
    assert urlrules.judge(frame.limit(0), none).collect() == []


def test_mined_rules_against_counting(spark):
    rng = random.Random(31)
    rows = []
    for i in range(800):
        host, first = f"{rng.choice('ab')}.site{rng.randrange(3)}.net", rng.choice(["shop", "blog", "news"])
        rows.append((f"http://{host}/{first}/{rng.randrange(5)}", first == "shop" and host.endswith("site1.net")))
    frame = spark.createDataFrame(rows, "url string, blocked boolean")
    tokens = frame.select(urlrules.tokens_of(urlrules.host_of(F.col("url")), urlrules.path_of(F.col("url"))).alias("tokens"), "blocked")
    rules = urlrules.mine(tokens, 0.01, 0.95, 1)
    assert ("host:site1.net", "path1:shop") in [t for t, _ in rules]
    sets = [(set(r.tokens), r.blocked) for r in tokens.collect()]
    for t, sure in rules:
        hits = [b for s, b in sets if set(t) <= s]
        assert len(hits) >= 8 and abs(sum(hits) / len(hits) - sure) < 1e-9 and sure >= 0.95
        assert not any(set(o) < set(t) and s >= sure for o, s in rules)
    got = urlrules.match(tokens.select("tokens"), rules).collect()
    assert [r.blocked for r in got] == [any(set(t) <= set(r.tokens) for t, _ in rules) for r in got]


def brute_rules(rows, min_support, min_confidence):
    """Rules by counting every combination of up to MAX_TOKENS tokens, then without those that a part of theirs makes needless."""
    n, bad = Counter(), Counter()
    for tokens, blocked in rows:
        for k in range(1, urlrules.MAX_TOKENS + 1):
            for combo in combinations(sorted(set(tokens)), k):
                n[combo] += 1
                bad[combo] += blocked
    sure = {c: bad[c] / n[c] for c in n if bad[c] >= min_support * len(rows) and bad[c] >= min_confidence * n[c]}
    return {c for c in sure if not any(sure.get(part, -1) >= sure[c] for k in range(1, len(c)) for part in combinations(c, k))}


def test_judge_end_to_end_and_on_held_out_urls(spark):
    rng = random.Random(5)
    hosts = [f"{sub}.{name}.example.net" for sub in ("www", "m") for name in ("win-casino", "cheap-pills", "news", "blog", "wiki", "shop")]
    rows, marks = [], []
    for i in range(3000):
        host, first = rng.choice(hosts), rng.choice(["en", "fr", "deals", "archive"])
        rows.append((i, f"http://{host}/{first}/{i}{rng.choice(['', '.html', '/', '?page=1'])}"))
        bad = "casino" in host or "shop" in host and first == "deals"
        if i % 2:
            marks.append((i, int(not bad) if rng.random() > 0.02 else int(bad), 0))
    marks += [(1, None, None), (None, 0, 1), (3, 7, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r for r in urlrules.judge(pages, labels, min_support=0.01, min_urls=1).collect()}
    plain = lambda u: (u.split("://")[1].split("/")[0], "/" + u.split("://")[1].split("/", 1)[1].split("?")[0])

    def tokens(u):
        host, path = plain(u)
        names = host.split(".")
        return ["host:" + ".".join(names[k:]) for k in range(len(names))] + [f"path{k}:{x}" for k, x in enumerate(path.split("/")) if x]

    truth = {i: q == 0 for i, q, _ in marks if i is not None and q in (0, 1)}
    rules = brute_rules([(tokens(u), truth[i]) for i, u in rows if i in truth], 0.01, urlrules.MIN_CONFIDENCE)
    assert ("host:win-casino.example.net",) in rules and ("host:shop.example.net", "path1:deals") in rules
    for i, u in rows:
        assert got[i].verdict == ("block" if any(set(c) <= set(tokens(u)) for c in rules) else "allow")
    out = [(got[i].verdict == "block", "casino" in u or "shop" in u and "deals" in u) for i, u in rows if i not in truth]
    hits = sum(a and b for a, b in out)
    assert hits / sum(a for a, _ in out) > 0.98 and hits / sum(b for _, b in out) > 0.98


def test_mining_of_very_long_paths_is_bounded(spark):
    rng = random.Random(6)
    rows = [([f"path{k}:s{k}" for k in range(60)], True) for _ in range(40)]
    rows += [([f"path{k}:{rng.choice('ab')}" for k in range(rng.randrange(1, 30))], rng.random() < 0.2) for _ in range(160)]
    frame = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    rules = urlrules.mine(frame, 0.02, 0.9, 1)
    assert {(f"path{k}:s{k}",) for k in range(60)} <= {c for c, _ in rules} and max(len(c) for c, _ in rules) <= urlrules.MAX_TOKENS
    for c, sure in rules:
        fit = [blocked for t, blocked in rows if set(c) <= set(t)]
        assert abs(sure - sum(fit) / len(fit)) < 1e-12 and sum(fit) >= 0.02 * len(rows)
    assert all(sum(blocked for t, blocked in rows if set(c) <= set(t)) >= 20 for c, _ in urlrules.mine(frame, 0.02, 0.9))
    short = [r for r in rows if len(r[0]) <= urlrules.ITEMS]
    got = {c for c, _ in urlrules.mine(spark.createDataFrame(short, "tokens array<string>, blocked boolean"), 0.05, 0.3, 1)}
    assert got == brute_rules(short, 0.05, 0.3)
    parts = spark.createDataFrame([("http://h.net/" + "/".join("x" * (k % 7 + 1) for k in range(5000)),), ("http://" + ".".join("abc") + "/" + "z" * 200_000,)], "url string")
    long = parts.select(urlrules.tokens_of(urlrules.host_of(F.col("url")), urlrules.path_of(F.col("url"))).alias("tokens"), F.lit(True).alias("blocked"))
    assert all(len(c) <= urlrules.MAX_TOKENS for c, _ in urlrules.mine(long, 0.9, 0.9, 1))


def all_rules(rows, least, min_confidence):
    """The smallest sure combinations of any length, by counting every one."""
    n, bad = Counter(), Counter()
    for tokens, blocked in rows:
        for k in range(1, len(tokens) + 1):
            for combo in combinations(sorted(set(tokens)), k):
                n[combo] += 1
                bad[combo] += blocked
    sure = {c for c in n if bad[c] >= least and bad[c] >= min_confidence * n[c]}
    return {c for c in sure if not any(part in sure for k in range(1, len(c)) for part in combinations(c, k))}


def test_mined_rules_of_any_length_against_counting(spark, monkeypatch):
    rng, longest = random.Random(12), 0
    for _ in range(2):
        rows = [([f"path{k}:{rng.choice('abc' if k % 3 else 'aab')}" for k in range(rng.randrange(1, 10))], rng.random() < 0.3) for _ in range(300)]
        rows = [(t + [f"same{x[4:]}" for x in t if x in ("path1:a", "path4:b")], b or set(t) >= {"path0:a", "path2:b", "path5:a", "path6:a"}) for t, b in rows]
        want = all_rules(rows, 4, 0.7)
        longest = max(longest, *map(len, want))
        frame = spark.createDataFrame(rows, "tokens array<string>, blocked boolean").repartition(3)
        for items, dense in ((20, 0), (0, 0), (0, 3000), (0, 2_000_000)):  # by enumerating, and by free combinations in trees, matrices and both
            monkeypatch.setattr(urlrules, "ITEMS", items)
            monkeypatch.setattr(urlrules, "DENSE", dense)
            rules, names = urlrules.rules_of(frame, 0.0, 0.7, 4)
            assert sorted(c for c, _ in rules) == sorted({tuple(sorted(names.get(t, t) for t in c)) for c in want})
            assert len(names) == 2
            got = urlrules.match(frame.select("tokens"), rules, names).collect()
            assert [r.blocked for r in got] == [any(set(c) <= set(r.tokens) for c in want) for r in got]
    assert longest > urlrules.MAX_TOKENS


def test_rules_join_distant_and_many_tokens(spark):
    """What a window of ten tokens or a limit of three would miss, with 19-digit numbers of documents."""
    rng = random.Random(8)
    base = 9_000_000_000_000_000_000
    rows, marks = [], []
    for i in range(1500):
        path = [rng.choice("ab") if k in (0, 4, 9, 14) else "x" * (k + 1) for k in range(15)]
        far = i % 3 == 0
        bad = path[0] == path[14] == "a" if far else path[0] == path[4] == path[9] == path[14] == "b"
        rows.append((i, f"http://{'far' if far else 'near'}.net/{'/'.join(path)}/{base + i}", bad))
        if i % 2:
            marks.append((base + i, int(not bad), 0))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urlrules.judge(pages, labels).collect()}
    assert got == {i: "block" if bad else "allow" for i, _, bad in rows}


def test_nested_paths_of_many_depths_are_mined_whole(spark):
    """Every prefix reaches the support and has rows of its own: 2**80 frequent combinations, of which 80 are free."""
    rows = [([f"path{k}:s{k}" for k in range(depth)], depth > 60) for depth in range(1, 81) for _ in range(25)]
    rules, names = urlrules.rules_of(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"))
    assert {c for c, _ in rules} == {(f"path{k}:s{k}",) for k in range(80) if min(80 - k, 20) >= 0.9 * (80 - k)} and not names


# Exact top-k.


def brute_top(rows, step, k):
    out = []
    fine = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for own, (q, v) in enumerate(fine):
        if q % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for other, (i, w) in enumerate(fine) if other != own and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    return [(i, (centres[i % 5] + 0.2 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("shard_rows, group", [(64, 4096), (64, 3), (100_000, 4096)])
def test_top_k(spark, monkeypatch, shard_rows, group):
    monkeypatch.setattr(topk, "GROUP", group)
    rows = vectors(1, 700, 8)
    rows += [(1000 + i, rows[3][1]) for i in range(15)]  # ties
    rows += [(2000, None), (2010, [1.0, None] * 4), (2020, [float("nan")] * 8), (2030, [float("inf")] * 8), (None, rows[0][1]), (2040, []), (2041, []), (2050, [1.0, 2.0]), (2051, [3.0, -1.0]), (41, rows[41][1]), (50, rows[50][1]), (50, rows[51][1])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    got = topk.top_k(frame.withColumn("id", F.lit("x")).withColumn("score", F.lit(1)), lambda i: i % 10 == 0, 10, shard_rows=shard_rows).select("query_id", "rank", "vec_id", "score").collect()
    assert same(got, brute_top(rows, 10, 10))


def test_top_k_of_large_components(spark):
    rows = [(i, [float((-1) ** i * 2.0**12 * (i + 1)), 1.5, float(i)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert same(topk.top_k(frame, lambda i: i % 4 == 0, 3).select("query_id", "rank", "vec_id", "score").collect(), brute_top(rows, 4, 3))


def test_top_k_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(frame, lambda i: i % 10 == 0).collect() == []


def test_cells_cut_the_space():
    rng = np.random.default_rng(4)
    rows = rng.integers(-100, 100, (2000, 6))
    cells = topk.Cells(rows[:500], 16)
    of = cells.of(rows)
    assert set(of.tolist()) == set(range(16)) and np.bincount(cells.of(rows[:500])).min() >= 15
    same_rows = topk.Cells(np.ones((50, 3), np.int64), 16)
    assert set(same_rows.of(np.ones((9, 3), np.int64)).tolist()) == {0}
    assert topk.Cells(np.zeros((5, 0), np.int64), 4).of(np.zeros((2, 0), np.int64)).tolist() == [0, 0]
    boxes = np.array([rows[of == c].min(axis=0) for c in range(16)]), np.array([rows[of == c].max(axis=0) for c in range(16)])
    most = topk.allowed(rows[:40], *boxes)
    for i in range(40):
        for c in range(16):
            assert most[i, c] >= (rows[of == c] @ rows[i]).max()


def test_boxes_spare_shards(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 4)) * 50
    rows = [(i, (centres[i % 8] + 0.01 * rng.normal(size=4)).astype(np.float32).tolist()) for i in range(1600)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk.top_k(frame, lambda i: i % 100 == 0, 5, shard_rows=100)
    assert same(got.select("query_id", "rank", "vec_id", "score").collect(), brute_top(rows, 100, 5))


def test_one_vector_on_very_many_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(600)] + [(1000 + i, [float(i), 0.5, -1.0]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    got = topk.top_k(frame, lambda i: i % 50 == 0, 4, shard_rows=64)
    assert same(got.select("query_id", "rank", "vec_id", "score").collect(), brute_top(rows, 50, 4))


def test_boxes_are_tight():
    tree = topk.KDTree(np.arange(1000), np.random.default_rng(3).integers(-50, 50, (1000, 4)))
    for (a, b), lo, hi in zip(tree.span, tree.lo, tree.hi):
        assert (tree.rows[a:b].min(axis=0) == lo).all() and (tree.rows[a:b].max(axis=0) == hi).all()
