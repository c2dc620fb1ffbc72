"""From raw documents to token ids in five stages, each over all that its predecessor kept.

quality     documents that the classifier rejects go
line_dedup  repeated runs of lines go; documents of which nothing is left go
near_dup    one row of each group of near duplicates stays, that with the smallest doc_id (null last), then hash of the text
mixing      documents as often, and as much of them, as the target weights say
bpe         token ids, with digests of the round trip

Rows that share a doc_id, or have none, are told apart by their texts; repeats of a doc_id and text
are one row after `near_dup`.  The last two stages give a row for each document and pass of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, linededup, mixing, ngramjoin, quality
from quire.llm.queries import table, vocabulary
from quire.runtime import materialised


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_runs(docs)
    return out.where((F.col("n_removed") == 0) | (F.trim("text") != "")).drop("n_removed")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark = [F.xxhash64(F.lit(k), "text").alias(f"mark{k}") for k in range(2)]
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), *mark)
    rows = docs.withColumn("near_dup row", row)
    found = ngramjoin.components(rows, "near_dup row")
    stays = found.where("`near_dup row` = component_id").select("near_dup row").distinct()
    return rows.join(stays, "near_dup row", "left_semi").dropDuplicates(["near_dup row"]).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded_documents(docs, vocabulary(spark))


STAGES = [("quality", quality_stage), ("line_dedup", line_dedup_stage), ("near_dup", near_dup_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Trees, rolling hashes and the permutation of the mix have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each materialised in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialised(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
