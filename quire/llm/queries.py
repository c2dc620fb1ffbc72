"""The registered queries of this subpackage, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, gif, htmltext, mixing, ngramjoin, quality, topk, urlrules, wordpiece
from quire.runtime import ship

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(spark: SparkSession, name: str = VOCABULARY):
    import public_tokenizers

    return bpe.vocabulary(spark, public_tokenizers.path(name))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.components(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary(spark))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), vocabulary(spark))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import linededup

    return linededup.dedup_runs(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "n_removed")


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_html_extraction, op3_bpe, op4_mixing, op5_url_filters, op6_token_counts, op7_line_dedup, op8_gif_media, op9_quality_classifier, op10_exact_top_k)}

SQL = {
    "op10_exact_top_k": """
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS a FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, q.n, CAST(list_sum(list_transform(list_zip(q.a, c.a), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.n <> c.n AND c.vec_id IS NOT NULL AND len(q.a) = len(c.a)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
g AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
      ELSE list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.node)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, min(reach.root) AS component_id FROM g JOIN reach ON reach.node = g.doc_id GROUP BY g.doc_id, len(g.s)
""",
}
