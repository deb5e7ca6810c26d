"""Registered queries of the subpackage, with DuckDB SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import angular_negatives, bpe, fingerprints, host_rules, html_crf, line_dedup, mixing, pii, posting_search, quality_embed, simhash, token_align, toxicity
from ragloom.llm.common import read_table


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(read_table(spark, sf_dir, "documents")).taken()


def op7_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_next(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 by whole lines only, a row per removed run: what SQL can express of it."""
    return spelled_runs(line_dedup.removed_runs(read_table(spark, sf_dir, "documents")))


def spelled_runs(runs: DataFrame) -> DataFrame:
    return runs.select("doc_id", "start", "stop", "n_units", "n_words", F.array_join(F.col("kept_in").cast("array<string>"), ",").alias("kept_in"))


def op3_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_quality_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_embed.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_crf.main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.report(read_table(spark, sf_dir, "documents"))


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"), ranks_path)


def bpe_digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, a row per row. Null and empty texts have no tokens (the digests of nothing); repeated rows,
    null ids and texts of any length are rows like any other; an empty table gives an empty result; other columns aren't read."""
    import public_tokenizers

    coded = bpe.round_trip(docs.select("doc_id", "text"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_align.report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angular_negatives.report(read_table(spark, sf_dir, "embeddings"))


def op13_posting_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_search.report(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_angular_negatives": op11_angular_negatives, "op13_posting_search": op13_posting_search, "op12_token_alignment": op12_token_alignment, "op6_html_main_text": op6_html_main_text, "op3_toxicity_ftrl": op3_toxicity_ftrl, "op5_quality_embeddings": op5_quality_embeddings, "op7_prefix_fingerprints": op7_prefix_fingerprints, "op9_line_dedup": op9_line_dedup, "line_runs": line_runs, "op1_mix_sources": op1_mix_sources, "op2_byte_bpe": op2_byte_bpe, "op10_bootstrapped_pii": op10_bootstrapped_pii, "op8_host_quality_rules": op8_host_quality_rules, "op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLE = {"op11_angular_negatives": angular_negatives.SQL, "line_runs": line_dedup.SQL, "op8_host_quality_rules": host_rules.SQL}
