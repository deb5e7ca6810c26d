"""Findings of round 3, fourth pass: the batch's answers are made once, and questions of a search are broadcast up to a bound of bytes."""
import random

import pyarrow as pa
from pyspark.sql import functions as F

from ragloom.operators import generation as G
from ragloom.operators import retrieval as R
from ragloom.plans.pipeline import answer_batch


def _texts(n: int, longest: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return [" ".join(f"w{min(300, int(rnd.paretovariate(0.5)))}" for _ in range(rnd.randint(1, longest))) for _ in range(n)]


# ------------------------------------------------------------------------------ F16-F20: answers of a batch
def test_sentences_are_compared_once(spark):
    q = spark.createDataFrame([(1, "red fox"), (2, "blue")], "q long, text string")
    hits = spark.createDataFrame([(1, 1, "A dog. The red fox! A Fox"), (1, 2, None), (2, 1, "Blue. Sky"), (2, 2, "")], "q long, rank int, text string")
    a = G.extractive_answers(q, "q", "text", hits)
    assert a._jdf.queryExecution().optimizedPlan().toString().count("array_intersect(") == 1
    assert sorted(map(tuple, a.collect())) == [(1, "The red fox [1]!"), (2, "Blue [1].")]


def test_answers_of_a_batch_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def generator(prompts):
        calls.add(len(prompts))
        return ["The sky is blue [1]." for _ in prompts]

    q = spark.createDataFrame([(i, f"what colour has the sky {i}") for i in range(7)], "qid long, question string")
    c = spark.createDataFrame([("a", "the sky is blue what colour"), ("b", "the sea what colour has it")], "chunk_id string, text string")
    r = answer_batch(q, "qid", "question", c, ["chunk_id"], "text", threshold=0.1, generator=generator).collect()
    assert len(r) == 7 and {x.stopped_at for x in r} == {"verify"} and all(len(x.citations) == 1 for x in r)
    assert calls.value == 7


# ------------------------------------------------------------------------------ F5, F16-F20: the search of a batch
def test_texts_are_not_shuffled_for_questions_within_the_bound(spark):
    q = spark.range(11_000).select(F.col("id").alias("qid"), F.format_string("w%s w%s", F.col("id") % 7, F.col("id") % 50).alias("q"))
    c = spark.createDataFrame(list(enumerate(_texts(60, 10, 1))), "doc long, body string").repartition(200)
    h = R.knn_lexical(q, "qid", "q", c, ["doc"], "body", 2)
    plan = h._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan  # no group of texts is sent to each group of questions
    assert f"Repartition {R.SCAN_TASKS * spark.sparkContext.defaultParallelism}, false" in plan  # rows found don't grow with the tasks of a larger input
    few = R.knn_lexical(q.where("qid < 40"), "qid", "q", c, ["doc"], "body", 2, max_questions=10)  # by groups
    assert sorted(map(tuple, h.where("qid < 40").collect())) == sorted(map(tuple, few.collect())) != []


def test_slices_give_only_hits_that_may_enter(monkeypatch):
    monkeypatch.setattr(R, "LEXICAL_ROWS", 50)
    asked = pa.table({"q": list(range(40)), "_asked": _texts(40, 8, 2)})
    texts = _texts(1000, 30, 3)
    held = pa.table({"c": list(range(1000)), "_held": texts})
    slices = [held.slice(i, 50) for i in range(0, 1000, 50)]
    given, best_of = [], R._lexical_meeting

    def counted(*a):
        meet = best_of(*a)
        return lambda *b: given.append(meet(*b)) or given[-1]

    monkeypatch.setattr(R, "_lexical_meeting", counted)
    best = R._lexical_hits(asked, slices, "q", ["c"], 3, None)
    assert sum(map(len, given)) < 20 * len(best)  # 20 slices, each with 3 hits a question if it knew nothing of the others
    monkeypatch.setattr(R, "LEXICAL_ROWS", 1000)
    rows = lambda t: sorted(zip(*(t[c].to_pylist() for c in ("q", "c", "score"))))
    assert rows(best) == rows(R._lexical_hits(asked, [held], "q", ["c"], 3, None))
