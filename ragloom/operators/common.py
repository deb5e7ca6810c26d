"""Shared plan helpers: size-checked broadcast, deterministic ids, checkpoints."""
from __future__ import annotations

import threading
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OWN = threading.local()


def cached(df: DataFrame) -> DataFrame:
    """Persist an intermediate that a plan reads more than once. It is remembered for the calling thread
    only (each stream's micro-batches run in a thread of their own), so ``release_cached`` never
    touches another caller's intermediates."""
    df = df.persist()
    if not hasattr(_OWN, "frames"):
        _OWN.frames = []
    _OWN.frames.append(df)
    return df


def release_cached() -> int:
    """Unpersist what this thread cached through ``cached``; returns how many were released."""
    frames = getattr(_OWN, "frames", [])
    n = len(frames)
    while frames:
        try:
            frames.pop().unpersist()
        except Exception:  # noqa: BLE001 - a stopped session has nothing left to release
            pass
    return n


# Limits for a side we broadcast: beyond either one we shuffle both sides instead.
DEFAULT_BROADCAST_MAX_ROWS = 1_000_000
DEFAULT_BROADCAST_MAX_BYTES = 32 * 1024 * 1024


def row_bytes(df: DataFrame):
    """Bytes of a row: UTF-8 length of strings, 16 per array element, 8 for anything else."""
    parts = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        parts.append(F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 16 if kind in ("array", "map") else F.lit(8))
    return reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0)).cast("long") for p in parts])


def broadcast_size(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes), summed up per partition first: one small row per task is shuffled, never the data."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    return int(r["n"]), int(r["b"])


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_MAX_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows and ``max_bytes`` bytes. Returns
    ``(df_or_hinted_df, was_broadcast)``; without the hint the planner picks the join."""
    df = cached(df)  # the check computes the side once; the join then reads it from the cache
    n, b = broadcast_size(df)
    return (F.broadcast(df), True) if n <= max_rows and b <= max_bytes else (df, False)


def chunk_id_col(strategy, doc_id, position, text, language=None):
    """Deterministic chunk id: the same chunk always gets the same id, so re-runs upsert, not append."""
    parts = [strategy, *([language] if language else []), doc_id, position, text]
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256)


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder (never a local checkpoint)."""
    from ragloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as compressed Parquet under the shared checkpoint folder and read back, with its folder: for rows with long texts, which a
    checkpoint would write uncompressed and read whole. The folder goes when the driver's JVM ends, if it isn't deleted before."""
    from ragloom.session import checkpoint_base

    spark = df.sparkSession
    path = f"{checkpoint_base(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path), path


#: rows of an Arrow batch that become Python objects at a time
SLICE_ROWS = 512


def in_slices(run, schema, rows: int | None = None):
    """A function of pandas frames (as for ``mapInPandas``) for ``mapInArrow``: it sees an Arrow batch in slices of ``rows`` rows, so a task
    holds the Python objects (words, sentences) of a slice, not those of a whole batch of 10,000 rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    columns, rows = to_arrow_schema(schema), rows or SLICE_ROWS

    def sliced(batches):
        frames = (b.slice(i, rows).to_pandas() for b in batches for i in range(0, b.num_rows, rows))
        for pdf in run(frames):
            yield from pa.Table.from_pandas(pdf, schema=columns, preserve_index=False).to_batches()

    return sliced
