"""Findings of round 3, second pass: common lines without a row per occurrence, flags by one generator, sentences and index blocks without shuffles of terms."""
import random

import pytest
from pyspark.sql import functions as F

from ragloom.llm import line_dedup


def test_common_lines_make_no_row_per_occurrence(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 20)
    shared = "a line that every one of these texts holds, word for word and more"
    rows = [(None if i == 3 else 100 + i, f"{shared}\n{shared}\nown line number {i} of this text alone") for i in range(60)] + [(7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    runs = line_dedup.removed_runs(df)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.start, r.stop, r.n_units, r.n_words, r.kept_in) for r in runs.collect())
    n = len(shared)
    want = [(i == 3, 0 if i == 3 else 100 + i, n + 1 if i == 0 else 0, 2 * n + 1, 1 if i == 0 else 2, len(shared.split()) * (1 if i == 0 else 2), [100]) for i in range(60)]
    assert got == sorted(want)
    joins = [x for x in runs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert joins and not any("d1" in x for x in joins)  # common digests are looked up in the documents' arrays


def test_flags_need_one_generator_and_each_claim_once(spark):
    from ragloom.operators import verification as V

    answers = spark.createDataFrame([(1, "It has 12 parts [1][7]. 40 and 7 are new. No 9x here [2]. 30% [2]!"), (2, None), (3, "5 [1]. 6"), (None, "8 is 8. 9 [1]")], "q long, text string")
    hits = spark.createDataFrame([(1, 1, "a", "12 parts"), (1, 2, "b", None), (1, 3, "c", "7 new"), (3, 1, "d", "६ or 6")], "q long, rank int, chunk_id string, text string")
    f = V.flagged_claims(answers, "q", "text", hits)
    assert f.schema.simpleString() == "struct<q:bigint,sent_no:int,claim:string,citation_index:bigint,chunk_id:string,reason:string>"
    got = {(r.q, r.sent_no, r.claim, r.citation_index, r.chunk_id, r.reason) for r in f.collect()}
    none, missed, absent = V.REASON_NO_CHUNK, V.REASON_NOT_IN_ANY, V.REASON_NOT_IN_CITED
    assert got == {(1, 0, "12", 7, None, none % 7), (1, 1, "40", None, None, missed % "40"), (1, 3, "30", 2, "b", none % 2), (3, 0, "5", 1, "d", absent % ("5", 1, "d")),
                   (None, 0, "8", None, None, missed % "8"), (None, 1, "9", 1, None, none % 1)}
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count(V.WORD_BOUNDARY) == 1  # the boundary regex runs once per sentence


def test_claims_are_those_between_word_boundaries(spark):
    from ragloom.operators import verification as V

    rnd = random.Random(2)
    texts = ["".join(rnd.choice("12a_ .%é९ि[]-") for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = V.WORD_BOUNDARY + r"[0-9]+(?:\.[0-9]+)?%?" + V.WORD_BOUNDARY
    every = lambda p: F.regexp_extract_all("t", F.lit(p), 0)
    assert df.where(every(both) != every(V.CLAIM_PATTERN)).count() == 0
    assert df.where(F.size(every(both)) > 0).count() > 100


def test_sentence_terms_are_not_shuffled(spark):
    from ragloom.operators import chunking as C

    rnd = random.Random(4)
    docs = [(i, " ".join(" ".join(rnd.choice("abc") * 2 for _ in range(rnd.randint(1, 4))) + "." for _ in range(rnd.randint(0, 40)))) for i in range(30)] + [(90, None), (91, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sims = C.semantic_boundaries(df, "text", ["doc_id"], 0.5)
    assert "Exchange" not in sims._jdf.queryExecution().executedPlan().toString()
    rows = lambda m: sorted(map(tuple, C.chunk_semantic(df, "text", ["doc_id"], 0.5, 3, method=m).collect()))
    assert rows("relational") == rows("arrays")


@pytest.mark.parametrize("piece", [2, 5])
def test_pieces_of_null_keys_are_numbered(spark, piece):
    from ragloom.operators import chunking as C

    marks = [True, False, False, False, True, False, False, False, False, False, True]
    rows = [(d, p, m) for d in (None, 1) for p, m in enumerate(marks)] + [(2, 0, True)]
    df = spark.createDataFrame(rows, "doc long, pos int, is_boundary boolean")
    got = {(r.doc, r.pos): r.position for r in C._numbered(df, ["doc"], 3, piece).collect()}
    want = [0, 0, 0, 1, 2, 2, 2, 3, 3, 3, 4]
    assert got == {**{(d, p): w for d in (None, 1) for p, w in enumerate(want)}, (2, 0): 0}


def test_model_calls_hold_a_slice_of_a_batch(spark, monkeypatch):
    from ragloom.operators import embedding as M

    monkeypatch.setattr(M, "CALL_ROWS", 4)

    def factory():
        return lambda texts: [[len(texts), 1.0, len(t)] for t in texts]

    df = spark.createDataFrame([(i, None if i == 5 else "w" * i) for i in range(11)], "i int, t string").coalesce(1)
    seen = {r.i: list(r.v) for r in df.select("i", M.embedder_udf(factory, prefix="p", normalize=False)("t").alias("v")).collect()}
    assert [seen[i][0] for i in range(11)] == [4.0] * 8 + [3.0] * 3  # a batch of 11 rows is no call of its own
    assert [seen[i][2] for i in range(11)] == [1.0 + (0 if i == 5 else i) for i in range(11)]
    assert df.limit(0).select(M.embedder_udf(factory)("t")).collect() == []
