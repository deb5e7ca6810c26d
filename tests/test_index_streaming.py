"""Index upsert is idempotent; streams give the batch result."""
import os

from pyspark.sql import functions as F

from ragloom.operators import chunking as C
from ragloom.operators import index as IDX
from ragloom.plans.pipeline import answer_batch
from ragloom.sources.readers import PASSAGES_SCHEMA
from ragloom.streaming import jobs


def nested_rows():
    return [(i, "t", f"question {i}?", "a", "eq", "ea", ([1, 0], ["x", "y"], [f"Passage {i} one. It has 12 words.", f"Second {i}."]),
             "en", "hi", {}) for i in range(6)]


def test_upsert_idempotent(spark, tmpdir_path):
    nested = spark.createDataFrame(nested_rows(), PASSAGES_SCHEMA)
    ch = C.build_index_chunks(nested, threshold=0.1)
    path = os.path.join(tmpdir_path, "index")
    n1 = IDX.upsert(spark, ch, path)
    n2 = IDX.upsert(spark, ch, path)
    assert n1 > 0 and n2 == 0
    assert IDX.read_index(spark, path).count() == n1
    assert IDX.read_index(spark, path, "structured").count() == 12


def test_upsert_replaces_changed_documents_and_loses_nothing(spark, tmpdir_path):
    schema = "query_id long, query string, language string, passages array<string>, is_selected array<int>"
    first = [(1, "q", "hi", ["a one", "a two", "a three"], [1]), (1, "q", "en", ["a one"], [1]), (None, "x", "hi", ["b"], []), (None, "y", "hi", ["b"], [])]
    path = os.path.join(tmpdir_path, "index")
    embedded = []

    def embed(c):
        embedded.append(1)
        return F.array(F.length(c).cast("float"))

    build = lambda rows: C.chunk_structured(spark.createDataFrame(rows, schema))
    assert IDX.upsert(spark, build(first), path, embed) == 6
    assert IDX.upsert(spark, build(first), path, embed) == 0
    changed = [(1, "q", "hi", ["a one", "changed"], [1])]  # one text changed, one passage gone
    assert IDX.upsert(spark, build(changed), path, embed) == 1
    got = sorted((r.language, r.query_text, r.text) for r in IDX.read_index(spark, path).collect())
    assert got == [("en", "q", "a one"), ("hi", "q", "a one"), ("hi", "q", "changed"), ("hi", "x", "b"), ("hi", "y", "b")]
    assert all(len(r.embedding) == 1 for r in IDX.read_index(spark, path).collect())


def test_uniform_embeddings(spark, tmpdir_path):
    import pytest

    ch = C.chunk_structured(spark.createDataFrame([(1, "q", ["a", "bb"], [1])], "query_id long, query string, passages array<string>, is_selected array<int>"))
    with pytest.raises(ValueError):
        IDX.upsert(spark, ch, os.path.join(tmpdir_path, "bad"), lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: i.cast("float")))


def test_strategy_is_a_partition_filter(spark, tmpdir_path):
    from ragloom.operators.embedding import hashed_terms
    from ragloom.plans.pipeline import retrieve_dense

    nested = spark.createDataFrame(nested_rows(), PASSAGES_SCHEMA)
    path = os.path.join(tmpdir_path, "index")
    IDX.upsert(spark, C.build_index_chunks(nested, threshold=0.1), path, hashed_terms())
    q = spark.createDataFrame([(1, "Passage 3 one"), (2, "  ")], "qid long, q string")
    h = retrieve_dense(q, "qid", "q", IDX.read_index(spark, path, "structured"), hashed_terms(), 3)
    assert "PartitionFilters: [isnotnull(strategy" in h._jdf.queryExecution().toString().replace("`", "")
    assert {r.strategy for r in h.collect()} == {"structured"} and {r.qid for r in h.collect()} == {1}


def test_index_stream_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "passages")
    spark.createDataFrame(nested_rows(), PASSAGES_SCHEMA).write.parquet(src)
    path = os.path.join(tmpdir_path, "index")
    q = jobs.index_stream(spark, src, path, checkpoint=os.path.join(tmpdir_path, "ck"), threshold=0.1)
    q.awaitTermination(120)
    nested = spark.createDataFrame(nested_rows(), PASSAGES_SCHEMA)
    batch_ids = {r.chunk_id for r in IDX.conform(C.build_index_chunks(nested, threshold=0.1)).collect()}
    assert {r.chunk_id for r in IDX.read_index(spark, path).collect()} == batch_ids


def test_answer_stream_equals_batch(spark, tmpdir_path):
    chunks = spark.createDataFrame([(1, 0, "Ravenport was founded in 1888. Eastmoor is the capital.", "c1"),
                                    (2, 0, "Unrelated passage about rivers.", "c2")], "doc_id long, position int, text string, chunk_id string")
    qs = [(1, "When was Ravenport founded?"), (2, "bomb"), (3, "   ")]
    qdir = os.path.join(tmpdir_path, "q")
    spark.createDataFrame(qs, jobs.QUESTION_SCHEMA).write.json(qdir)
    out = os.path.join(tmpdir_path, "out")
    kw = dict(threshold=0.2, rules=("symbol", "repeat"))
    q = jobs.answer_stream(spark, qdir, chunks, ["doc_id", "position"], "text", out, checkpoint=os.path.join(tmpdir_path, "ck"), **kw)
    q.awaitTermination(180)
    got = {r.question_id: (r.stopped_at, r.answer) for r in spark.read.parquet(out).collect()}
    batch = answer_batch(spark.createDataFrame(qs, jobs.QUESTION_SCHEMA), "question_id", "question", chunks,
                         ["doc_id", "position"], "text", **kw)
    exp = {r.question_id: (r.stopped_at, r.answer) for r in batch.collect()}
    assert got == exp
    assert exp[1][0] == "verify" and exp[2][0] == "classify_query" and exp[3][1] == "Empty query text provided."


def test_latency_windows(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1, "view", float(i), t0 + dt.timedelta(minutes=i), True) for i in range(12)]
    df = spark.createDataFrame(rows, jobs.STAGE_SCHEMA)
    w = {r.window_start: r for r in jobs.latency_windows(df).collect()}
    assert sum(r.n for r in w.values()) == 12 and w[t0].p100 == 4.0


def test_latency_stream_closed_windows_equal_batch(spark, tmpdir_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, ["view", "click"][i % 2], float(i % 17), t0 + dt.timedelta(minutes=i), True) for i in range(60)]
    src = os.path.join(tmpdir_path, "stages")
    spark.createDataFrame(rows, jobs.STAGE_SCHEMA).write.parquet(src)
    out = os.path.join(tmpdir_path, "lat")
    q = jobs.latency_stream(spark, src, out, checkpoint=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(180)
    got = {(r.window_start, r.stage): (r.n, r.p50, r.p100) for r in spark.read.parquet(out).collect()}
    batch = {(r.window_start, r.stage): (r.n, r.p50, r.p100) for r in jobs.latency_windows(spark.createDataFrame(rows, jobs.STAGE_SCHEMA)).collect()}
    assert got and all(batch[k] == v for k, v in got.items())  # every emitted (closed) window equals the batch result


def test_release_cached(spark):
    from ragloom.operators.common import bounded_broadcast, release_cached

    release_cached()
    df, small = bounded_broadcast(spark.range(5))
    assert small and df.count() == 5
    assert release_cached() == 1 and release_cached() == 0
