"""Structured Streaming jobs.

* ``answer_stream``  questions arriving as files -> the same batch ``answer_batch`` per micro-batch
  against the static chunk index (``foreachBatch``). Each micro-batch writes its own ``epoch=N`` folder
  with overwrite, so a replayed batch (after a failure) replaces its output instead of duplicating it. With
  ``repeat_within`` a question id that was answered is not answered again when it comes again within that time of
  ``asked_at`` (state: the ids of that time). Late data: a question older than the watermark (the latest ``asked_at`` seen less
  ``repeat_within``) is dropped, since its first sending can't be told any more. A question without a time counts as asked
  when it is read.
* ``index_stream``   passage rows arriving as files -> chunk -> idempotent upsert into the index
  (deterministic chunk ids make replays add nothing).
* ``change_stream``  versions of documents arriving as files -> per-document state of the chunk ids that it has -> only the added
  and removed chunks, a log folder per micro-batch (replays overwrite theirs); ``current_chunks`` folds the log into the index.
* ``latency_stream`` stage-timing rows -> event-time tumbling windows with a watermark -> approximate
  percentiles per stage (bounded-memory sketch), appended once a window closes.

Checkpoints go under the session's shared ``spark.checkpoint.dir`` (stable across restarts) unless a
location is given.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.operators import chunking as C
from ragloom.operators import index as IDX
from ragloom.plans.pipeline import answer_batch
from ragloom.operators.common import release_cached
from ragloom.session import checkpoint_base

QUESTION_SCHEMA = T.StructType([T.StructField("question_id", T.LongType()), T.StructField("question", T.StringType())])
STAGE_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("request_group", T.LongType()), T.StructField("stage", T.StringType()),
    T.StructField("ms", T.DoubleType()), T.StructField("ts", T.TimestampType()), T.StructField("ok", T.BooleanType()),
])


def _ckpt(spark: SparkSession, name: str, location: str | None) -> str:
    # stable across restarts: under spark.checkpoint.dir itself, not the per-application subfolder
    return location or os.path.join(checkpoint_base(spark), "streams", name)


def _flat_result(res: DataFrame) -> DataFrame:
    return res.withColumn("citations", F.array_join("citations", "|")).withColumn("flagged_claims", F.to_json("flagged_claims"))


def answer_stream(spark: SparkSession, question_dir: str, chunks: DataFrame, c_keys: list[str], c_text: str, out_dir: str,
                  checkpoint: str | None = None, fmt: str = "json", available_now: bool = True, repeat_within: str | None = None, **kw):
    timed = T.StructType([*QUESTION_SCHEMA.fields, T.StructField("asked_at", T.TimestampType())])
    src = spark.readStream.schema(timed if repeat_within is not None else QUESTION_SCHEMA).format(fmt).load(question_dir)
    if repeat_within is not None:
        src = (src.withColumn("asked_at", F.coalesce("asked_at", F.current_timestamp())).withWatermark("asked_at", repeat_within)
               .dropDuplicatesWithinWatermark(["question_id"]))
    src = src.select("question_id", "question")

    def run(batch: DataFrame, epoch: int) -> None:
        res = answer_batch(batch, "question_id", "question", chunks, c_keys, c_text, **kw)
        _flat_result(res).write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={epoch}"))
        release_cached()  # this micro-batch's intermediates; a long stream must not accumulate them

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", _ckpt(spark, "answers", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def index_stream(spark: SparkSession, passage_dir: str, index_path: str, checkpoint: str | None = None, embed=None,
                 available_now: bool = True, **chunk_kw):
    from ragloom.sources.readers import PASSAGES_SCHEMA

    src = spark.readStream.schema(PASSAGES_SCHEMA).parquet(passage_dir)

    def run(batch: DataFrame, epoch: int) -> None:
        IDX.upsert(spark, C.build_index_chunks(batch, **chunk_kw), index_path, embed)
        release_cached()

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", _ckpt(spark, "index", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


DOCUMENT_SCHEMA = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("version", T.LongType()), T.StructField("text", T.StringType())])
CHANGE_SCHEMA = "doc_id string, version long, change string, chunk_id string, position int, text string"


def chunk_lists(documents: DataFrame, window: int = 256, overlap: float = 0.15) -> DataFrame:
    """(doc_id, version, chunks): the fixed chunks of a document as one array, without a shuffle; a null text has none."""
    step = max(1, int(window * (1 - overlap)))
    words = C.tokens("text")
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    d = documents.select("doc_id", "version", F.coalesce(words, F.array().cast("array<string>")).alias("_w"))
    texts = F.transform(starts, lambda s: F.array_join(F.slice("_w", s + 1, window), " "))
    d = d.select("doc_id", "version", texts.alias("_t"))
    made = lambda t, i: F.struct(F.sha2(F.concat_ws("|", F.lit("fixed"), F.col("doc_id"), i.cast("string"), t), 256).alias("chunk_id"),
                                 i.alias("position"), t.alias("text"))
    return d.select("doc_id", "version", F.transform("_t", made).alias("chunks"))


def chunk_changes(chunked: DataFrame) -> DataFrame:
    """Added and removed chunks (CHANGE_SCHEMA) of a stream of ``chunk_lists``. The state of a document is its newest version and the
    ids of its chunks, so unchanged chunks are told without reading the index. An older version than the state's is late and changes nothing; of
    versions in one micro-batch the newest counts."""
    import pandas as pd

    def diff(key, batches, state):
        version, held = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        newest = None
        for b in batches:
            for v, chunks in zip(b["version"], b["chunks"]):
                if (version is None or v > version) and (newest is None or v > newest[0]):
                    newest = (v, chunks)
        out = []
        if newest is not None:
            v, chunks = int(newest[0]), list(newest[1])
            now, before = {c["chunk_id"] for c in chunks}, set(held)
            out = [(key[0], v, "removed", i, None, None) for i in held if i not in now]
            out += [(key[0], v, "added", c["chunk_id"], int(c["position"]), c["text"]) for c in chunks if c["chunk_id"] not in before]
            state.update((v, [c["chunk_id"] for c in chunks]))
        yield pd.DataFrame(out, columns=["doc_id", "version", "change", "chunk_id", "position", "text"]).astype({"position": "Int32", "version": "Int64"})

    return chunked.where("doc_id is not null and version is not null").groupBy("doc_id").applyInPandasWithState(
        diff, CHANGE_SCHEMA, "version long, ids array<string>", "append", "NoTimeout")


def change_stream(spark: SparkSession, document_dir: str, log_dir: str, checkpoint: str | None = None, fmt: str = "json",
                  available_now: bool = True, **chunk_kw):
    src = spark.readStream.schema(DOCUMENT_SCHEMA).format(fmt).load(document_dir)

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(log_dir, f"epoch={epoch}"))

    w = chunk_changes(chunk_lists(src, **chunk_kw)).writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", _ckpt(spark, "changes", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def current_chunks(spark: SparkSession, log_dir: str) -> DataFrame:
    """(doc_id, chunk_id, position, text) after all changes: the last change of each chunk, unless it is its removal."""
    log = spark.read.schema(CHANGE_SCHEMA + ", epoch long").parquet(log_dir)
    last = log.groupBy("doc_id", "chunk_id").agg(F.max_by(F.struct("change", "position", "text"), F.col("version")).alias("c"))
    return last.where("c.change = 'added'").select("doc_id", "chunk_id", "c.position", "c.text")


def latency_windows(stages: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Per (window, stage): count and approximate P50/P70/P100 of ms. Works on batch or stream input."""
    s = stages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    g = s.groupBy(F.window("ts", window).alias("w"), "stage").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("ms", [0.5, 0.7, 1.0], 10000).alias("p"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "stage", "n",
                    F.col("p")[0].alias("p50"), F.col("p")[1].alias("p70"), F.col("p")[2].alias("p100"))


def latency_stream(spark: SparkSession, stage_dir: str, out_dir: str, checkpoint: str | None = None,
                   window: str = "5 minutes", watermark: str = "10 minutes", available_now: bool = True):
    src = spark.readStream.schema(STAGE_SCHEMA).parquet(stage_dir)
    w = (latency_windows(src, window, watermark).writeStream.outputMode("append").format("parquet")
         .option("path", out_dir).option("checkpointLocation", _ckpt(spark, "latency", checkpoint)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
