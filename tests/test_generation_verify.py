"""Stage-5/6 cases: citations, refusal, finalisation, extractive answers, numeric-claim verification."""
from ragloom.operators import generation as GEN
from ragloom.operators import verification as VER


def test_cited_ranks(spark):
    df = spark.createDataFrame([("A [2] b [1, 2, 9] c [०१] [3]", 3), ("none", 3), ("[1]", 0)], "t string, n int")
    got = [r.c for r in df.select(GEN.cited_ranks("t", "n").alias("c")).collect()]
    assert got == [[2, 1, 3], [], []]


def test_citations_refusal_finalize(spark):
    answers = spark.createDataFrame([(1, "Ravenport is small [1]. It was founded in 1888 [2]."), (2, "The answer is not mentioned [1]."),
                                     (3, "No tags here ,  ."), (4, "")], "q long, text string")
    hits = spark.createDataFrame([(1, 1, "c-a"), (1, 2, "c-b"), (2, 1, "c-c")], "q long, rank int, chunk_id string")
    out = {r.q: r for r in GEN.answer_citations(answers, "q", "text", hits).collect()}
    assert out[1].citations == ["c-a", "c-b"] and out[1].final_text == "Ravenport is small [1]. It was founded in 1888 [2]."
    assert out[2].refusal and out[2].citations == [] and out[2].final_text == "The answer is not mentioned."
    assert out[3].final_text == "No tags here." and out[4].final_text == ""


def test_prompt_and_extractive(spark):
    q = spark.createDataFrame([(1, " When was Ravenport founded? ")], "q long, text string")
    hits = spark.createDataFrame([(1, 1, "Ravenport is a town. Ravenport was founded in 1888."), (1, 2, "Unrelated text here.")],
                                 "q long, rank int, text string")
    p = GEN.prompt_build(q, "q", "text", hits).first()
    assert "[1] Ravenport is a town. Ravenport was founded in 1888.\n\n[2] Unrelated text here." in p.prompt
    assert p.prompt.endswith("Question: When was Ravenport founded?\n\nAnswer:") and p.n_context == 2
    a = GEN.extractive_answers(q, "q", "text", hits).first().answer
    assert a == "Ravenport was founded in 1888 [1]."


def test_verify_cases(spark):
    answers = spark.createDataFrame([
        (1, ""), (2, "No numbers at all."), (3, "Ravenport was founded in 1899 [1]. It became a city in 1987 [1]."),
        (4, "The fair opened in 1888 [7]."), (5, "About 1888 people came."), (6, "वर्ष १८८८ में [1]।")], "q long, text string")
    hits = spark.createDataFrame([(q, 1, f"{q}-1", "Ravenport was founded in 1888 and became a city in 1987.") for q in range(1, 7)],
                                 "q long, rank int, chunk_id string, text string")
    v = {r.q: r for r in VER.verify_answers(answers, "q", "text", hits).collect()}
    assert v[1].is_fully_grounded and v[2].is_fully_grounded
    assert not v[3].is_fully_grounded and [f.claim for f in v[3].flagged_claims] == ["1899"]
    assert v[3].flagged_claims[0].reason == "numeric claim '1899' not found in cited chunk [1] (3-1)"
    assert v[4].flagged_claims[0].reason == "citation index [7] has no matching retrieved chunk"
    assert v[5].is_fully_grounded  # uncited claim found in a hit
    assert v[6].is_fully_grounded  # Devanagari digits normalised


def test_claim_regex_python_semantics(spark):
    df = spark.createDataFrame([("50% of 3 and 1939में and 12abc 7",)], "s string")
    got = df.select(VER.numeric_claims("s").alias("c")).first().c
    assert sorted(got) == ["3", "50", "7"]
