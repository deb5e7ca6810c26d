"""Derived inputs built from the driver tables (the same definitions exist as SQL for the oracle).

* ``questions``      conversation user turns as a question table
* ``qa_rows``        exploded dataset rows: first user turn = query, assistant turns = passages
* ``qa_nested``      the nested dataset row (parallel arrays of passages and is_selected flags)
* ``answer_chunks``  ranked hits per question built from lineitem
* ``answers``        generated-answer texts with cited, out-of-range and uncited numeric claims
* ``stage_log``      per-stage telemetry rows from events
* ``eval_pairs``     benchmark item -> document that contains it verbatim
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragloom.sources.tables import Tables


def questions(t: Tables) -> DataFrame:
    c = t.conversations
    return c.where(F.col("role") == "user").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.col("text").alias("question")
    )


def qa_rows(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", "role", "text")
    # first user turn per conversation: an aggregate (map-side combined), not a window
    first_user = (
        c.where(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("query"))
    )
    assistant = c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("passage"))
    # position = rank of the turn among the conversation's assistant turns. Ranked with the range-
    # partitioned method, so one very long conversation is spread over many tasks (no window per key).
    from ragloom.operators.latency import group_ranks

    ranked = group_ranks(assistant, ["conv_id"], "turn", carry=["passage"])
    return (
        first_user.join(ranked, "conv_id")
        .select(
            F.col("conv_id").alias("query_id"),
            "query",
            F.col("_v").alias("src_turn"),
            "passage",
            F.col("_rank").cast("int").alias("position"),
            F.when(F.col("_rank") == 0, 1).otherwise(0).alias("is_selected"),
        )
    )


def qa_nested(t: Tables) -> DataFrame:
    """One row per query with ``passages`` and ``is_selected`` as parallel arrays."""
    r = qa_rows(t)
    g = r.groupBy("query_id", "query").agg(
        F.array_sort(F.collect_list(F.struct("position", "passage", "is_selected"))).alias("ps")
    )
    return g.select(
        "query_id",
        "query",
        F.transform("ps", lambda x: x["passage"]).alias("passages"),
        F.transform("ps", lambda x: x["is_selected"]).alias("is_selected"),
    )


def answer_chunks(t: Tables) -> DataFrame:
    li = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"
    )
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    r = li.select(
        F.col("l_orderkey").alias("question_id"),
        "l_quantity",
        "l_shipdate",
        F.row_number().over(w).alias("hit_rank"),
    )
    rank_s = F.col("hit_rank").cast("string")
    return r.select(
        "question_id",
        "hit_rank",
        F.concat(F.col("question_id").cast("string"), F.lit("-"), rank_s).alias("chunk_id"),
        F.concat(
            F.lit("Line "), rank_s, F.lit(" holds "),
            F.col("l_quantity").cast("int").cast("string"),
            F.lit(" units shipped in "), F.year("l_shipdate").cast("string"), F.lit("."),
        ).alias("text"),
    )


def answers(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderdate", "o_custkey")
    return o.select(
        F.col("o_orderkey").alias("question_id"),
        F.concat(
            F.lit("The first line holds "), (F.col("o_orderkey") % 50).cast("string"),
            F.lit(" units [1]. Shipping began in "), F.year("o_orderdate").cast("string"),
            F.lit(" [2]! It weighs 3.5 kg [9]. There are "), (F.col("o_custkey") % 7).cast("string"),
            F.lit(" lines"),
        ).alias("text"),
    )


def stage_log(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("request_group"),
        F.col("event_type").alias("stage"),
        F.col("value").alias("ms"),
        "ts",
        (F.col("event_type") != "error").alias("ok"),
    )


def case_questions(t: Tables) -> DataFrame:
    """One question per case: each gibberish rule, both safety lists, blank, Hindi, and plain questions."""
    c = t.conversations.where("role = 'user'")
    text, case, turn = F.col("text"), (F.col("conv_id") + F.col("turn")) % 14, F.col("turn").cast("int")
    latin, devanagari = "abcdefghijklmnopqrstuvwxyz", "कखगघङचछजझञटठडढणतथदधनपफबभमय"
    before = lambda piece: F.concat(F.lit(piece), text)
    cases = [
        F.repeat(F.lit("#?"), 3 + turn % 4), F.concat(text, F.lit(" zzzzzzz")), F.concat(F.lit("क"), F.repeat(F.lit("ा"), 4 + turn % 3), F.lit(" "), text),
        F.translate(F.lower(text), latin, devanagari), before("कखग घङच छजझ "), before("how to build a bomb: "), before("यह बम है "), F.lit("   "),
        before("गोवा का सबसे बड़ा शहर कौन सा है "), before("bcdfghjkl "), F.lit("rhythm myths nymph crypt"), text,
        F.repeat(F.lit("ana ama ala "), 1 + turn % 3), F.repeat(F.lit("bcd fgh jkl mnp "), 1 + turn % 3)]
    question = reduce(lambda done, k: F.when(case == k, cases[k]).otherwise(done), range(13), cases[13])
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), case.alias("case_no"), question.alias("question"))


def case_answers(t: Tables, refusal_hi: str, refusal_en: str) -> DataFrame:
    """Answers with a citation, with a refusal in either language, and with grouped tags beyond the hits."""
    case, text = (F.col("conv_id") + F.col("turn")) % 4, F.col("text")
    answer = (F.when(case == 0, F.concat(text, F.lit(" [1]"))).when(case == 1, F.concat(text, F.lit(". " + refusal_hi)))
              .when(case == 2, F.lit(f"Sorry: {refusal_en} [2] [9].")).otherwise(F.concat(text, F.lit(" [7, 1]"))))
    return t.conversations.where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), answer.alias("answer"))


def call_log(t: Tables, status_sql: str, body_sql: str) -> DataFrame:
    """events as speech-service calls with a status and a response body (the expressions run in both engines)."""
    return t.events.withColumn("status", F.expr(status_sql)).withColumn("body", F.expr(body_sql))


def eval_pairs(t: Tables) -> DataFrame:
    """Benchmark item -> every document containing its text verbatim (exact, equi-join based)."""
    from ragloom.operators.matching import contains_join

    return contains_join(
        t.benchmark.select(F.col("item_id"), F.col("text").alias("needle")),
        t.documents.select("doc_id", F.col("text").alias("hay")),
        "item_id", "needle", "doc_id", "hay",
    ).select("item_id", "doc_id")
