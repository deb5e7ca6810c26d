"""Containment by the automaton against Python's ``in``."""
import random

import pytest

from ragloom.operators.matching import contains_join


def cases():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 6)))
    hays = [(2**60 + i, "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    hays += [(None, "abab"), (3, None), (4, ""), (5, "日本語 ab 😀"), (hays[0][0], hays[0][1])]
    needles = [(2**60 + 1000 + i, word()) for i in range(80)] + [(1, ""), (2, None), (None, "ab"), (7, "語 a"), (8, "😀"), (9, "zzz"), (9, "b"), (9, "b")]
    return needles, hays


@pytest.mark.parametrize("limits", [{}, {"needle_rows": 20, "text_bytes": 300}, {"needle_bytes": 200, "text_bytes": 1}])
def test_all_needles_in_all_texts(spark, limits):
    needles, hays = cases()
    expected = {(n, h) for n, a in needles for h, b in hays if a is not None and b is not None and a in b}
    n = spark.createDataFrame(needles, "item_id long, needle string")
    h = spark.createDataFrame(hays, "doc_id long, hay string").repartition(3)
    got = [tuple(r) for r in contains_join(n, h, "item_id", "needle", "doc_id", "hay", **limits).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    spelled = contains_join(n.withColumn("item_id", n.item_id.cast("string")), h.withColumn("doc_id", h.doc_id.cast("string")), "item_id", "needle", "doc_id", "hay", **limits)
    text = lambda x: None if x is None else str(x)
    assert {tuple(r) for r in spelled.collect()} == {(text(a), text(b)) for a, b in expected}


@pytest.mark.parametrize("limits", [{}, {"needle_rows": 1}])
def test_no_needles_or_no_texts(spark, limits):
    n = spark.createDataFrame([(1, "a"), (2, "")], "item_id long, needle string")
    h = spark.createDataFrame([(1, "a")], "doc_id long, hay string")
    assert contains_join(n.limit(0), h, "item_id", "needle", "doc_id", "hay", **limits).collect() == []
    assert contains_join(n, h.limit(0), "item_id", "needle", "doc_id", "hay", **limits).collect() == []


def test_texts_are_scanned_once(spark):
    n = spark.createDataFrame([(1, "lorem"), (2, "x")], "item_id long, needle string")
    h = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = contains_join(n, h, "item_id", "needle", "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and "Generate" not in plan
