"""Stages of the corpus pipeline: each applies one operator and lets its decisions take effect.

Defined cases, for every stage: an empty table gives an empty result; null and empty texts and nulls in any other column are rows like any
other (a text without words fails the quality rules, and has nothing to mask, mix or encode); texts of any length are processed whole; repeated
rows are judged, masked and encoded each, and are copies of one another for near-dedup; columns beyond those of ``documents`` are carried along,
whatever their names, up to the last stage, which returns the columns of the BPE query."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import host_rules, mixing, pii, queries, simhash


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id (null last; ties by row
    hash). Repeated rows count as copies, so one of them stays. All columns of ``docs`` come back unchanged."""
    cols = docs.columns
    row_key = F.xxhash64(*[F.col(c) for c in cols])
    groups = simhash.simhash_groups(docs, row_key=row_key)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("m"))
    keys = first.select(F.col("m.doc_id").alias("_sh_keep_id"), F.col("m.row_key").alias("_sh_keep_row"))
    mine = docs.withColumn("_sh_own_row", row_key)
    kept = mine.join(keys, (F.col("_sh_own_row") == F.col("_sh_keep_row")) & F.col("doc_id").eqNullSafe(F.col("_sh_keep_id")), "left_semi")
    return kept.dropDuplicates(["_sh_own_row", "doc_id"]).select(*cols)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules reject go."""
    return host_rules.judge(docs).filter("_hq_kept").select(*docs.columns)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the new text. No document goes."""
    masked = pii.masked(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the mix: a document comes once for every round that takes words of it, with these
    words as its text and n_chars."""
    mixed = mixing.mixed_rows(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's text encoded by byte-level BPE and decoded again: counts and digests."""
    return queries.bpe_digests(docs)
