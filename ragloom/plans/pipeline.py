"""``answer_batch``: the six-stage question-answering flow as one DataFrame plan.

Each gate ends some rows; every later stage reads only the rows still open (the filter sits below the
join, so stopped questions never reach retrieval or generation). The exits are unioned into one result
table with ``stopped_at`` in {transcribe, classify_query, check_grounding, verify}.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import is_hindi, strip
from ragloom.operators import gates as G
from ragloom.operators.common import checkpoint, stored
from ragloom.operators.generation import answer_citations, extractive_answers, generate_with, prompt_build
from ragloom.operators.index import QUERY_PREFIX
from ragloom.operators.retrieval import attach_chunks, knn_dense, knn_lexical
from ragloom.operators.telemetry import NoLog, StageLog
from ragloom.operators.verification import verify_answers

# Messages for rows that stop early (by stage, cause and answer language).
MSG_STT_FAILED = "Sorry, I didn't catch that — could you try again?"
MSG_NO_SPEECH = "I couldn't hear any clear speech in the audio file — please try recording again."
MSG_EMPTY_TEXT = "Empty query text provided."
MSG_UNSAFE_HI = "मैं इस अनुरोध में सहायता नहीं कर सकता।"
MSG_UNSAFE_EN = "I can't help with that request."
MSG_OFF_TOPIC_HI = "यह विषय इस डेटासेट के दायरे से बाहर है, इसलिए मेरे पास इसका उत्तर नहीं है।"
MSG_OFF_TOPIC_EN = "That's outside what this dataset covers, so I don't have a grounded answer for it."
MSG_NOT_GROUNDED_HI = "मेरे पास इस सवाल का उत्तर देने के लिए डेटासेट में पर्याप्त जानकारी उपलब्ध नहीं है।"
MSG_NOT_GROUNDED_EN = "I don't have enough information in the dataset to answer that confidently."

RESULT_COLS = ["transcript", "verdict", "verdict_reason", "top_score", "grounding_reason", "stopped_at", "answer",
               "citations", "is_fully_grounded", "n_flags", "flagged_claims", "generation_failed"]


def stop_message(cause, hindi) -> Column:
    """cause in {stt_failed, no_speech, empty, unsafe, off_topic, not_grounded}."""
    c, hi = F.col(cause) if isinstance(cause, str) else cause, F.col(hindi) if isinstance(hindi, str) else hindi
    return (F.when(c == "stt_failed", F.lit(MSG_STT_FAILED))
            .when(c == "no_speech", F.lit(MSG_NO_SPEECH))
            .when(c == "empty", F.lit(MSG_EMPTY_TEXT))
            .when(c == "unsafe", F.when(hi, F.lit(MSG_UNSAFE_HI)).otherwise(F.lit(MSG_UNSAFE_EN)))
            .when(c == "off_topic", F.when(hi, F.lit(MSG_OFF_TOPIC_HI)).otherwise(F.lit(MSG_OFF_TOPIC_EN)))
            .when(c == "not_grounded", F.when(hi, F.lit(MSG_NOT_GROUNDED_HI)).otherwise(F.lit(MSG_NOT_GROUNDED_EN))))


def retrieve_dense(questions: DataFrame, q_key: str, q_text: str, index: DataFrame, embed, k: int = 5) -> DataFrame:
    """Embed the questions (with the query prefix; blank ones retrieve nothing) and search the embedding column of an
    index table: (q_key, rank, score) and the chunk's payload columns. Pass ``read_index(spark, path, strategy)`` to
    search one collection: the strategy is a partition of the table."""
    asked = questions.select(q_key, strip(q_text).alias("_t")).where(F.col("_t") != "")
    asked = asked.select(q_key, embed(F.concat(F.lit(QUERY_PREFIX), F.col("_t"))).alias("_qv"))
    hits = knn_dense(asked, q_key, "_qv", index, "chunk_id", "embedding", k)
    payload = [c for c in index.columns if c not in ("chunk_id", "embedding", "model_input", "shard")]
    return attach_chunks(hits, index, ["chunk_id"], payload)


def answer_speech(transcripts: DataFrame, q_key: str, text_col: str, ok_col: str, *args, **options) -> DataFrame:
    """``answer_batch`` behind the speech stage: a failed call or a blank transcript stops at ``transcribe``."""
    t = transcripts.select(q_key, F.coalesce(strip(text_col), F.lit("")).alias("_t"), F.coalesce(F.col(ok_col), F.lit(False)).alias("_ok"))
    stop = t.where(~F.col("_ok") | (F.col("_t") == "")).select(
        q_key, F.lit("").alias("_t"), F.lit(False).alias("_hi"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("verdict_reason"),
        F.when(F.col("_ok"), F.lit("no_speech")).otherwise(F.lit("stt_failed")).alias("_cause"))
    heard = t.where(F.col("_ok") & (F.col("_t") != "")).select(q_key, F.col("_t").alias(text_col))
    return _stopped(stop, q_key, "transcribe", F.col("_cause")).unionByName(answer_batch(heard, q_key, text_col, *args, **options))


_FLAG_T = "array<struct<sent_no:int,claim:string,citation_index:bigint,chunk_id:string,reason:string>>"


def _stopped(df: DataFrame, q_key: str, stage: str, cause: Column) -> DataFrame:
    return df.select(
        q_key, F.col("_t").alias("transcript"), "verdict", "verdict_reason",
        (F.col("top_score") if "top_score" in df.columns else F.lit(None).cast("double")).alias("top_score"),
        (F.col("grounding_reason") if "grounding_reason" in df.columns else F.lit(None).cast("string")).alias("grounding_reason"),
        F.lit(stage).alias("stopped_at"), stop_message(cause, F.col("_hi")).alias("answer"),
        F.array().cast("array<string>").alias("citations"), F.lit(True).alias("is_fully_grounded"),
        F.lit(0).cast("long").alias("n_flags"), F.array().cast(_FLAG_T).alias("flagged_claims"),
        F.lit(False).alias("generation_failed"))


def answer_batch(questions: DataFrame, q_key: str, q_text: str, chunks: DataFrame, c_keys: list[str], c_text: str,
                 chunk_id_col: str = "chunk_id", k: int = 5, threshold: float = 0.83, rules=G.ALL_RULES,
                 unsafe_words=G.UNSAFE_PATTERNS, generator=None, max_hits: int | None = None, chunk_postings=None,
                 retriever=None, log: StageLog | None = None) -> DataFrame:
    """Questions -> one result row each (see ``RESULT_COLS``). Hits come from ``retriever(open_questions)``, a DataFrame
    (q_key, rank, score, text, chunk_id) such as ``retrieve_dense`` gives (then ``chunks`` may be None), or else from a
    lexical search of ``chunks``. With ``log`` the batch runs to its end here, and the log has a row per stage."""
    note = log or NoLog()
    q = questions.select(q_key, strip(q_text).alias("_t")).withColumn("_hi", is_hindi("_t"))
    q = G.with_classification(q, "_t", unsafe_words, rules).select(q_key, "_t", "_hi", "verdict", "verdict_reason")
    # The classified questions, hits and citations feed several exits. They are questions x k at most, so
    # a reliable checkpoint in the shared folder is cheap; it cuts the lineage (later plans stay small)
    # and a lost executor does not send the job back to the start.
    with note.timed("classify_query"):
        q = checkpoint(note.watch(q, "classify_query", stopped=(F.col("_t") == "") | (F.col("verdict") != G.IN_SCOPE)))

    empty = q.where(F.col("_t") == "")
    cls_stop = q.where((F.col("_t") != "") & (F.col("verdict") != G.IN_SCOPE))
    open_q = q.where((F.col("_t") != "") & (F.col("verdict") == G.IN_SCOPE))

    with note.timed("retrieve"):
        if retriever is not None:
            hits = retriever(open_q.select(q_key, F.col("_t").alias(q_text))).select(q_key, "rank", "score", "text", F.col("chunk_id").alias(chunk_id_col))
        else:
            hits = knn_lexical(open_q, q_key, "_t", chunks, c_keys, c_text, k, chunk_postings=chunk_postings)
        hits = note.watch(hits, "retrieve")
        hits = checkpoint(hits) if retriever is None else stored(hits, "hits")[0]  # with texts: compressed, and read by column
    gate = G.grounding_gate(open_q, q_key, hits, threshold).join(open_q, q_key)
    gate = gate.withColumnRenamed("reason", "grounding_reason")
    if log is not None:  # its own step only where it is timed
        with note.timed("check_grounding"):
            gate = checkpoint(note.watch(gate, "check_grounding", stopped=~F.col("can_answer")))
    not_grounded = gate.where(~F.col("can_answer"))
    ok = gate.where(F.col("can_answer"))

    ok_hits = hits.join(ok.select(q_key), q_key, "left_semi")
    if retriever is None:
        ok_hits, _ = stored(attach_chunks(ok_hits, chunks, c_keys, [c for c in (c_text, chunk_id_col) if c not in c_keys]).withColumnRenamed(c_text, "text"), "hits")
    if generator is None:
        raw = extractive_answers(ok, q_key, "_t", ok_hits, max_hits)
    else:
        raw = generate_with(prompt_build(ok, q_key, "_t", ok_hits), q_key, generator)
    with note.timed("generate"):
        # citations read the answers twice: they are made once
        raw = checkpoint(note.watch(raw, "generate", rows_out=F.count(F.when(strip("answer") != "", 1))))
        cit = checkpoint(answer_citations(raw, q_key, "answer", ok_hits, chunk_id_col=chunk_id_col))
    ver = verify_answers(cit, q_key, "final_text", ok_hits, chunk_id_col=chunk_id_col)
    done = ok.join(cit, q_key).join(ver, q_key).select(
        q_key, F.col("_t").alias("transcript"), "verdict", "verdict_reason", "top_score", "grounding_reason",
        F.lit("verify").alias("stopped_at"), F.col("final_text").alias("answer"), "citations", "is_fully_grounded",
        "n_flags", F.col("flagged_claims").cast(_FLAG_T).alias("flagged_claims"),
        (strip("raw") == "").alias("generation_failed"))

    done = note.watch(done, "verify")
    result = (
        _stopped(empty, q_key, "classify_query", F.lit("empty"))
        .unionByName(_stopped(cls_stop, q_key, "classify_query", F.col("verdict")))
        .unionByName(_stopped(not_grounded, q_key, "check_grounding", F.lit("not_grounded")))
        .unionByName(done)
    )
    if log is None:
        return result
    with note.timed("verify"):
        return checkpoint(result)


ALL_STAGES = ("transcribe", "classify_query", "retrieve", "check_grounding", "generate", "verify")


def result_json(results: DataFrame, q_key: str, timings: DataFrame | None = None) -> DataFrame:
    """The API response shape as one JSON string per question. ``timings`` is a batch's stage table (stage, ms; see
    ``StageLog``): a question carries the batch times of the stages it reached, since a batch plan has no times per row;
    without it the times are null."""
    names = F.array(*[F.lit(s) for s in ALL_STAGES])
    reached = F.slice(names, 1, F.greatest(F.array_position(names, F.col("stopped_at")).cast("int"), F.lit(1)))
    one = {r["stage"]: r["ms"] for r in timings.groupBy("stage").agg(F.round(F.sum("ms"), 2).alias("ms")).collect()} if timings is not None else {}
    ms = F.create_map(*[x for s in ALL_STAGES for x in (F.lit(s), F.lit(one.get(s)).cast("double"))])  # one entry per stage
    results = results.withColumn("_ms", ms)
    stages = F.map_from_arrays(reached, F.transform(reached, lambda s: F.element_at("_ms", s)))
    total = F.round(F.aggregate(F.map_values(stages), F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x, a, x)), 2)
    flags = F.transform("flagged_claims", lambda f: F.struct(f["claim"].alias("claim_text"), f["citation_index"].alias("citation_index"),
                                                             f["chunk_id"].alias("chunk_id"), f["reason"].alias("reason")))
    body = F.struct(F.col("answer"), F.col("transcript"), F.col("citations"), F.col("is_fully_grounded"), flags.alias("flagged_claims"),
                    F.col("stopped_at"), F.struct(total.alias("total"), stages.alias("stages")).alias("latency_ms"))
    return results.select(q_key, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
