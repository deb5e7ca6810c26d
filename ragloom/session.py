"""Session helpers: one place for the settings every plan relies on."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "ragloom") -> SparkSession:
    """Build (or reuse) a session with AQE on, UTC time zone and the UI off.

    On a cluster the master, memory and shuffle sizing come from spark-submit; the
    values here are only the defaults for local runs and tests.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # shuffles are sized by bytes, not by a fixed count: AQE coalesces to ~128 MB partitions
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        # checkpoint files of intermediates are removed once no plan references them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder for ``DataFrame.checkpoint``: the shared folder the cluster names
    in spark.checkpoint.dir (Spark derives the context's folder from it at start-up).

    Only in local mode, when the session has none, do we create a scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = local_scratch(spark)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def local_scratch(spark: SparkSession) -> str:
    """A scratch folder for local runs and tests; executors of a cluster couldn't share it."""
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="ragloom-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def checkpoint_base(spark: SparkSession) -> str:
    """The stable base folder (spark.checkpoint.dir itself, not the per-application subfolder) for
    state that must survive restarts, such as streaming checkpoints."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        ensure_checkpoint_dir(spark)
        d = spark.conf.get("spark.checkpoint.dir")
    return d
