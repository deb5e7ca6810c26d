"""Parquet table access. Spark takes the schema from the file footer (no inference pass), and
column pruning / filter pushdown reach the scan because every plan selects what it uses."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {TABLES}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread_small(df) if spread else df


#: A table of at most so many bytes (by the scan's own statistics) may be dealt out to all cores.
SPREAD_MAX_BYTES = 64 * 1024 * 1024


def spread_small(df: DataFrame, max_bytes: int = SPREAD_MAX_BYTES) -> DataFrame:
    """A small file with one row group is one task, whatever the cores: deal its rows out round-robin. Only
    inputs of at most ``max_bytes`` are shuffled for this, however many cores there are; larger ones are
    read as they are split. Rows are the same either way."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > max_bytes:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """Lazy accessor: ``Tables(spark, dir).documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)
