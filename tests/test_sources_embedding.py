"""Readers (eval CSV, question file) and the embedder hook in chunking and the index."""
import os

import numpy as np
from pyspark.sql import functions as F

from ragloom.operators import chunking as C
from ragloom.operators import index as IDX
from ragloom.operators.embedding import embedder_udf, letter_profile_model
from ragloom.sources import readers as S


def test_eval_csv_and_question_file(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "eval.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("query,expected_doc_id\nwhere is ravenport,d1\nकब,d2\n")
    assert [(r.query, r.expected_doc_id) for r in S.read_eval_pairs(spark, p).collect()] == [("where is ravenport", "d1"), ("कब", "d2")]
    q = os.path.join(tmpdir_path, "q.txt")
    with open(q, "w", encoding="utf-8") as f:
        f.write("  first question \n\n\t\nsecond\nthird\n")
    assert [r.question for r in S.read_question_file(spark, q).orderBy("line_no").collect()] == ["first question", "second", "third"]
    assert [r.question for r in S.read_question_file(spark, q, n=2).orderBy("line_no").collect()] == ["first question", "second"]
    assert S.dataset_path("/d", "hi") == "/d/train/hintrain.parquet" and S.dataset_path("/d", "ta", "validation") == "/d/validation/tamval.parquet"
    try:
        S.dataset_path("/d", "te")
        raise AssertionError("Telugu must be rejected")
    except ValueError as e:
        assert "Available" in str(e)


def test_embedder_hook_in_semantic_chunking_and_index(spark, tmpdir_path):
    emb = embedder_udf(letter_profile_model(16))
    docs = spark.createDataFrame([(1, "aaa aaa. aaa aab. zzz zzy! zzz."), (2, "")], "doc_id long, text string")
    b = C.semantic_boundaries(docs, "text", ["doc_id"], threshold=0.5, embed=emb).orderBy("pos").collect()
    assert [r.is_boundary for r in b] == [True, False, True, False]
    ch = C.chunk_semantic(docs, "text", ["doc_id"], 0.5, 12, embed=emb).orderBy("position").collect()
    assert [r.text for r in ch] == ["aaa aaa. aaa aab.", "zzz zzy! zzz."]
    rows = IDX.conform(C.chunk_fixed(docs, "text", ["doc_id"], 4, 0.0).withColumn("doc_id", F.col("doc_id").cast("string")),
                       embed=embedder_udf(letter_profile_model(16), prefix=IDX.PASSAGE_PREFIX)).collect()
    assert all(r.model_input.startswith("passage: ") and abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in rows)


def test_language_resolver_table_form(spark):
    df = spark.createDataFrame([(1, "hi"), (2, "te"), (3, "ta")], "doc_id long, lang string")
    out = {r.doc_id: (r.code, r.file_path, r.status) for r in S.resolve_languages(df, "lang", "/d").collect()}
    assert out[1] == ("hin", "/d/train/hintrain.parquet", "ok")
    assert out[2] == (None, None, "unknown language")
    assert out[3][0] == "tam"


def test_completed_calls_filter(spark):
    from ragloom.operators import latency as L

    log = spark.createDataFrame([(1, 200, 5.0), (2, 500, 9.0), (3, 200, 7.0)], "seq long, status int, ms double")
    assert sorted(r.seq for r in L.completed_calls(log).collect()) == [1, 3]


def test_passage_reader_ordered_limit(spark, tmpdir_path):
    rows = [(i, "t", f"q{i}", "a", "eq", "ea", ([1], ["x"], [f"p{i}"]), "en", "hi", {"k": "v"}) for i in (5, 2, 9, 1)]
    path = os.path.join(tmpdir_path, "passages")
    spark.createDataFrame(rows, S.PASSAGES_SCHEMA).write.parquet(path)
    got = [r.query_id for r in S.read_passages(spark, path, limit=2).collect()]
    assert got == [1, 2]
    assert S.read_passages(spark, [path]).count() == 4


def test_speech_language_null_and_absent(spark):
    from ragloom.sources.readers import parse_stt_response

    df = spark.createDataFrame([(1, '{"text": "a", "language_code": null}'), (2, '{"text": "a"}'), (3, '{"transcript": "", "text": " b ", "language_code": "en-IN"}'), (4, None)], "i int, j string")
    got = {r.i: r.r for r in df.select("i", parse_stt_response("j").alias("r")).collect()}
    assert got[1].language is None and got[2].language == "hi-IN" and (got[3].transcript, got[3].language) == ("b", "en-IN")


def test_empty_question_file_is_refused(spark, tmpdir_path):
    import os

    import pytest

    from ragloom.sources.readers import read_question_file

    path = os.path.join(tmpdir_path, "q.txt")
    with open(path, "w") as f:
        f.write("\n  \n")
    for n in (None, 3):
        with pytest.raises(ValueError):
            read_question_file(spark, path, n)


def test_dataset_paths(spark):
    import pytest

    from ragloom.sources.readers import dataset_path

    assert dataset_path("/r/", "hi") == "/r/train/hintrain.parquet" and dataset_path("/r", "bn", "validation") == "/r/validation/benval.parquet"
    with pytest.raises(ValueError):
        dataset_path("/r", "te")
