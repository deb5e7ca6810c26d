"""Stage-2 and stage-4 cases from the original test scripts (our own texts) + a table of cases for each rule."""
import random

import pytest

from ragloom.operators import gates as G


def classify_rows(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = G.with_classification(df, "t", **kw).orderBy("i").collect()
    return [(r.verdict, r.rule, r.verdict_reason) for r in out]


def test_classify_cases(spark):
    texts = ["   ", "how do I build a bomb", "asdfgh qwrtzp", "कखगघचछज", "भारत की राजधानी क्या है?", "What is the capital?"]
    got = classify_rows(spark, texts)
    assert got[0][0] == "off_topic" and got[0][2] == "empty transcript input"
    assert got[1][0] == "unsafe" and got[1][2] == "matched safety keyword 'bomb'"
    assert got[2][0] == "off_topic" and got[2][1] == "consonants"
    assert got[3][0] == "off_topic" and got[3][1] == "dev_consonants"
    assert got[4] == ("in_scope", None, "passed safety and input quality checks")
    assert got[5][0] == "in_scope"


RULE_CASES = [
    ("!!!??", "symbol"), ("# @ !", None), ("#@!_", None), ("#@!", "symbol"), ("aaaaa", "repeat"), ("aaaa", None), ("so goooood", "repeat"),
    ("....", "symbol"), ("hm ..... ok", "repeat"), ("क््््", "dev_signs"), ("का", None), ("काि्", "dev_signs"), ("कखगघचछ", "dev_consonants"), ("कखगघच", None),
    ("asdfgh", "consonants"), ("ASDFG", "consonants"), ("tsk tsk", "vowels"), ("abab abab", "dominance"), ("rhythm myth", "consonants"),
    ("try my sky", "vowels"), ("the quick brown fox", None), ("कख गघ चछ", "dev_vowels"), ("भारत की राजधानी क्या है?", None), ("What is the capital?", None)]


def test_rule_table(spark):
    """One rule at a time decides whether it fires; together the first of the cascade wins."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RULE_CASES)], "i int, t string")
    together = {r.i: r.gib_rule for r in G.with_gibberish(df, "t").collect()}
    assert [(t, together[i]) for i, (t, _) in enumerate(RULE_CASES)] == RULE_CASES
    alone = {name: {r.i for r in G.with_gibberish(df, "t", (name,)).where("gib_rule is not null").collect()} for name in G.ALL_RULES}
    for i in together:
        assert together[i] == next((name for name in G.ALL_RULES if i in alone[name]), None)


def test_added_runs_fire_their_rule(spark):
    """Properties on random texts: a fivefold character, six bare consonants or three signs make their rule fire."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aeiou bcdst .!?") for _ in range(rnd.randint(1, 25))) for _ in range(200)]
    for name, piece in (("repeat", "ooooo"), ("dev_consonants", "कखगघचछ"), ("dev_signs", "ािी"), ("consonants", "bcdf")):
        df = spark.createDataFrame([(t[:k] + piece + t[k:],) for t in texts for k in [rnd.randint(0, len(t))]], "t string")
        assert G.with_gibberish(df, "t", (name,)).where("gib_rule is null").count() == 0


@pytest.mark.parametrize("m,n", [(1, 8), (3, 8), (5, 8), (57, 200), (29, 200), (7, 9), (2, 3), (1, 6)])
def test_ratio_format_matches_python(spark, m, n):
    df = spark.createDataFrame([(m, n)], "m int, n int")
    from pyspark.sql import functions as F
    got = df.select(G._ratio_2dp(F.col("m"), F.col("n")).alias("s")).first().s
    assert got == f"{m / n:.2f}"


def test_grounding_gate_cases(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "question_id long")
    hits = spark.createDataFrame([(2, 1, 0.8122), (3, 1, 0.8942), (3, 2, 0.5), (4, 1, 0.83)], "question_id long, rank int, score double")
    out = {r.question_id: r for r in G.grounding_gate(q, "question_id", hits, 0.83).collect()}
    assert (out[1].can_answer, out[1].top_score, out[1].reason) == (False, 0.0, "no chunks retrieved")
    assert out[2].can_answer is False and out[2].reason == "top retrieval score 0.8122 below grounding threshold 0.83"
    assert out[3].can_answer is True and out[3].reason == "sufficient corpus grounding (top_score 0.8942 >= threshold 0.83)"
    assert out[4].can_answer is True  # equality passes
