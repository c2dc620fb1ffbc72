import hashlib
import random

import pytest

import corpus_pipeline
from tests.llm.conftest import DOCS
from tests.llm.test_corpus_operators import brute_dedup
from tests.llm.test_ngramjoin import brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(17)
    rows, marks = [], []
    for i in range(240):
        good = i % 5 != 0
        lines = [" ".join(f"{rng.choice('abcdefgh')}{rng.choice(['and', 'er', 'ing'])}{rng.randrange(40)}" for _ in range(12)) for _ in range(rng.randrange(1, 6))]
        text = "\n".join(lines) if good else "\n".join(line.upper().replace(" ", "!! ") for line in lines)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 3:
            marks.append((i, int(good), 0))
    rows += [(300 + k, rows[k][1], "en", "s1", rows[k][4]) for k in range(1, 20)]
    rows += [(400 + k, rows[k][1] + " tail", "en", "s2", rows[k][4] + 5) for k in range(21, 40)]
    rows += [(500, None, None, None, None), (501, "", "en", None, 0), (None, "null id text and more words", "en", "s3", 27)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_follow_each_other(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    by_name = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        by_name[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == columns
    before, after = by_name["quality"]
    kept = {r.doc_id for r in after.collect()}
    good = {r.doc_id for r in before.collect() if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 5}
    assert len(good - kept) <= 0.02 * len(good)
    assert len([i for i in kept if i is not None and i < 240 and i % 5 == 0]) <= 3

    before, after = by_name["line_dedup"]
    want = [(k, t) for (k, t), old in zip(brute_dedup([(r.doc_id, r.text) for r in before.collect()]), before.collect()) if t is None or t == old.text or t.strip()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in after.collect())

    before, after = by_name["near_dup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    numbered = [(float("inf") if k is None else k, t) for k, t in rows]
    stays = {k for k, _, c in brute(numbered) if k == c}
    assert sorted(map(str, {r for r, (k, _) in zip(rows, numbered) if k in stays})) == sorted(str((r.doc_id, r.text)) for r in after.collect())

    before, after = by_name["mixing"]
    size = lambda f: sum(len((r.text or "").encode().split()) for r in f.collect())
    assert abs(size(after) - 1.5 * size(before)) <= 8
    assert after.groupBy("doc_id").count().where("count > 2").isEmpty()

    before, after = by_name["bpe"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in before.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, list(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in after.collect())


def test_run_is_the_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))


def test_pipeline_of_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []


def test_near_duplicates_with_repeated_ids(spark):
    rng = random.Random(6)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    a, b, c, d = text(), text(), text(), text()
    near = lambda w: " ".join([*w, "tail"])
    rows = [(2, " ".join(a)), (2, " ".join(b)), (1, near(b)), (5, " ".join(c)), (5, near(c)), (7, " ".join(d)), (7, " ".join(d)), (8, None), (8, ""), (None, " ".join(a)), (None, "solo " * 30), (None, "solo " * 30), (None, None)]
    got = corpus_pipeline.near_dup_stage(spark, spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS), "").collect()
    assert sorted((r.doc_id, r.text or "") for r in got if r.doc_id not in (5, None)) == sorted([(2, " ".join(a)), (1, near(b)), (7, " ".join(d)), (8, ""), (8, "")])
    assert [r.text in (" ".join(c), near(c)) for r in got if r.doc_id == 5] == [True]
    assert sorted(r.text or "" for r in got if r.doc_id is None) == ["", "solo " * 30]  # a text known under an id goes, and copies under none are one row
