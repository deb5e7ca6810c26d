"""The corpus pipeline. STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and reread as the next one's docs. All but the last return the columns of documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm.common import read_table, stored
from ragloom.llm.stages import mix_sources, near_dedup, pii_masking, quality_rules, tokenise

STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", pii_masking),
    ("mix_sources", mix_sources),
    ("byte_bpe", tokenise),
]

#: Fingerprints, learned patterns and merges by rank can't be written as SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. Each stage's rows are written under the shared checkpoint folder and reread, so
    that a lost executor costs at most one stage; the folders go when the driver's JVM ends."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"corpus-pipeline-{k}-{name}")
    return docs
