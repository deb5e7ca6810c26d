"""Query catalogue: every operator as a runnable query over the driver tables, with its oracle SQL.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and ``ORACLE[name] = DuckDB SQL`` (absent where the
operator has no SQL form). Output conventions shared by both sides: integers BIGINT, doubles rounded to
6 places, texts long enough to be unwieldy are compared by md5, arrays joined with '|'.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import text as X
from ragloom.functions import vectors as VEC
from ragloom.operators import chunking as C
from ragloom.operators import evaluation as E
from ragloom.operators import gates as G
from ragloom.operators import impact as IMP
from ragloom.operators import generation as GEN
from ragloom.operators import latency as L
from ragloom.operators import retrieval as R
from ragloom.operators import sketches as SK
from ragloom.operators import verification as VER
from ragloom.operators.common import cached, checkpoint, chunk_id_col
from ragloom.operators import index as IDX
from ragloom.operators.embedding import embedder_udf, hashed_terms, letter_profile_model, padding
from ragloom.operators.index import upsert_plan
from ragloom.operators.telemetry import StageLog
from ragloom.plans import oracle as O
from ragloom.plans import pipeline as P
from ragloom.plans.pipeline import answer_batch, answer_speech, result_json, retrieve_dense
from ragloom.sources import readers as S
from ragloom.sources import views as V
from ragloom.session import checkpoint_base
from ragloom.sources.tables import Tables

QUERIES: dict = {}
ORACLE: dict = {}

# Parameters of the registered queries (chosen for the driver data; defaults of the library stay as in
# the original system: grounding 0.83, semantic 0.55).
K = 5
SEM_THR, SEM_MAX = 0.1, 12
GROUND_THR = 0.3
PIPE_RULES = tuple(r for r in G.ALL_RULES if r != "consonants")  # invented words trip the consonant rule
EXTRA_UNSAFE = ["und", "was"]
SWEEP = [round(0.05 * i, 2) for i in range(1, 20)]
LANG_ROOT = "/data/passages"
STOP_TEXTS = {  # cause -> (English, Hindi)
    "empty": (P.MSG_EMPTY_TEXT, P.MSG_EMPTY_TEXT), "unsafe": (P.MSG_UNSAFE_EN, P.MSG_UNSAFE_HI), "off_topic": (P.MSG_OFF_TOPIC_EN, P.MSG_OFF_TOPIC_HI),
    "not_grounded": (P.MSG_NOT_GROUNDED_EN, P.MSG_NOT_GROUNDED_HI), "no_speech": (P.MSG_NO_SPEECH, P.MSG_NO_SPEECH), "stt_failed": (P.MSG_STT_FAILED, P.MSG_STT_FAILED)}


def key(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def lng(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ----------------------------------------------------------------------------------- shared pieces
def fixed_doc_chunks(t: Tables, window=256, overlap=0.15) -> DataFrame:
    return C.chunk_fixed(t.documents.select("doc_id", "text"), "text", ["doc_id"], window, overlap)


def semantic_doc_chunks(t: Tables) -> DataFrame:
    return C.chunk_semantic(t.documents.select("doc_id", "text"), "text", ["doc_id"], SEM_THR, SEM_MAX)


def with_ids(ch: DataFrame) -> DataFrame:
    return ch.withColumn("chunk_id", chunk_id_col("strategy", "doc_id", "position", "text"))


def bench_hits(t: Tables, chunks: DataFrame | None = None) -> DataFrame:
    ch = chunks if chunks is not None else fixed_doc_chunks(t)
    return R.knn_lexical(t.benchmark, "item_id", "text", ch, ["doc_id", "position"], "text", K)


SQL_FIXED = O.fixed_chunks("documents", "doc_id", "text", 256, 0.15)
SQL_FIXED_IDS = ("SELECT *, sha256(concat_ws('|', 'fixed', CAST(doc_id AS VARCHAR), CAST(position AS VARCHAR), text)) AS chunk_id "
                 "FROM fx")


def sql_bench_hits(csrc="fx", p="k_"):
    return O.knn_ctes(p, "benchmark", "item_id", "text", csrc, ["doc_id", "position"], "text", K)


# ------------------------------------------------------------------------------------------ sources
@key("src_limit", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 200")
def q_src_limit(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return S.first_rows(t.documents.select("doc_id", "lang", "source", "n_chars"), 200, "doc_id")


_LANG_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in sorted(S.LANG_CODE_MAP.items()))


@key("src_lang_map", f"""WITH m(lang, code) AS (VALUES {_LANG_VALUES})
SELECT d.doc_id, d.lang, m.code,
  CASE WHEN m.code IS NOT NULL THEN '{LANG_ROOT}/train/' || m.code || 'train.parquet' END AS file_path,
  CASE WHEN m.code IS NOT NULL THEN 'ok' ELSE 'unknown language' END AS status
FROM documents d LEFT JOIN m ON d.lang = m.lang""")
def q_src_lang_map(spark, d):
    t = Tables(spark, d)
    return S.resolve_languages(t.documents.select("doc_id", "lang"), "lang", LANG_ROOT).select(
        "doc_id", "lang", "code", "file_path", "status")


@key("src_question_lines", O.with_(O.views("questions"), f"""SELECT question_id, line_no, question FROM (
  SELECT question_id, line_no, {O.strip('ln')} AS question FROM (
    SELECT question_id, unnest(range(len(ls)))::BIGINT AS line_no, unnest(ls) AS ln
    FROM (SELECT question_id, string_split(question, chr(10)) AS ls FROM questions) z) y) x WHERE question <> ''"""))
def q_src_question_lines(spark, d):
    t = Tables(spark, d)
    lines = V.questions(t).select("question_id", F.posexplode(F.split("question", "\n")).alias("line_no", "value"))
    return S.question_lines(lines, "value").select("question_id", lng("line_no").alias("line_no"), "question")


def _stt_json(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", "text")
    m = (F.col("conv_id") + F.col("turn")) % 4
    body = F.struct(
        F.when(m == 0, F.col("text")).when(m == 1, F.lit("")).when(m == 3, F.lit("   ")).alias("transcript"),
        F.when(m.isin(1, 2), F.col("text")).alias("text"),
        F.when(m == 0, F.lit("hi-IN")).when(m == 2, F.lit("en-IN")).alias("language_code"),
        F.when(m == 0, F.lit(0.9)).when(m == 2, F.lit(0.0)).alias("confidence"),
        F.when(m == 1, F.lit(0.75)).when(m == 2, F.lit(0.5)).alias("language_probability"))
    return c.select("conv_id", "turn", F.to_json(body).alias("response"))


@key("stt_response_parse", f"""SELECT conv_id, turn, md5(transcript) AS transcript_md5, language, confidence FROM (
  SELECT conv_id, turn,
    {O.strip("coalesce(nullif(json_extract_string(j, '$.transcript'), ''), nullif(json_extract_string(j, '$.text'), ''), '')")} AS transcript,
    coalesce(json_extract_string(j, '$.language_code'), 'hi-IN') AS language,
    coalesce(nullif(CAST(json_extract(j, '$.confidence') AS DOUBLE), 0), CAST(json_extract(j, '$.language_probability') AS DOUBLE)) AS confidence
  FROM (SELECT conv_id, turn, json_object(
      'transcript', CASE (conv_id + turn) % 4 WHEN 0 THEN text WHEN 1 THEN '' WHEN 3 THEN '   ' END,
      'text', CASE WHEN (conv_id + turn) % 4 IN (1, 2) THEN text END,
      'language_code', CASE (conv_id + turn) % 4 WHEN 0 THEN 'hi-IN' WHEN 2 THEN 'en-IN' END,
      'confidence', CASE (conv_id + turn) % 4 WHEN 0 THEN 0.9 WHEN 2 THEN 0.0 END,
      'language_probability', CASE (conv_id + turn) % 4 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 END) AS j
    FROM conversations) z) y""")
def q_stt_response_parse(spark, d):
    t = Tables(spark, d)
    p = _stt_json(t).select("conv_id", "turn", S.parse_stt_response("response").alias("r"))
    return p.select("conv_id", "turn", F.md5("r.transcript").alias("transcript_md5"), F.col("r.language").alias("language"),
                    F.col("r.confidence").alias("confidence"))


# ----------------------------------------------------------------------------------------- chunking
_QA_NESTED_SQL = f"""SELECT query_id, string_agg(passage, ' ' ORDER BY position) FILTER (WHERE passage IS NOT NULL AND {O.strip('passage')} <> '') AS flat,
  count(*) FILTER (WHERE passage IS NOT NULL AND {O.strip('passage')} <> '') AS n_passages FROM qa_rows GROUP BY query_id"""


@key("passage_flatten", O.with_(O.views("qa_rows") + [("qn", _QA_NESTED_SQL)],
     "SELECT query_id, n_passages::BIGINT AS n_passages, md5(coalesce(flat, '')) AS text_md5 FROM qn"))
def q_passage_flatten(spark, d):
    n = V.qa_nested(Tables(spark, d))
    return n.select("query_id", lng(F.size(F.filter("passages", lambda x: x.isNotNull() & (X.strip(x) != "")))).alias("n_passages"),
                    F.md5(C.flatten_passages("passages")).alias("text_md5"))


@key("chunk_structured", O.with_(O.views("qa_rows"), f"""SELECT CAST(query_id AS VARCHAR) || '_' || CAST(position AS VARCHAR) AS chunk_id,
  CAST(query_id AS VARCHAR) AS query_id, position::BIGINT AS position, is_selected::BIGINT AS is_selected, md5({O.strip('passage')}) AS text_md5
FROM qa_rows WHERE passage IS NOT NULL AND {O.strip('passage')} <> ''"""))
def q_chunk_structured(spark, d):
    s = C.chunk_structured(V.qa_nested(Tables(spark, d)))
    return s.select(F.col("passage_id").alias("chunk_id"), "query_id", lng("position").alias("position"), lng("is_selected").alias("is_selected"),
                    F.md5("text").alias("text_md5"))


@key("ground_truth", O.with_(O.views("qa_rows"), f"""SELECT query_id, position::BIGINT AS position, md5({O.strip('passage')}) AS text_md5
FROM qa_rows WHERE is_selected = 1 AND passage IS NOT NULL AND {O.strip('passage')} <> '' AND {O.strip('query')} <> ''"""))
def q_ground_truth(spark, d):
    g = E.ground_truth(V.qa_nested(Tables(spark, d)))
    return g.select("query_id", lng("position").alias("position"), F.md5("gt_text").alias("text_md5"))


@key("chunk_fixed", f"SELECT doc_id, position, n_words, md5(text) AS text_md5 FROM ({SQL_FIXED}) z")
def q_chunk_fixed(spark, d):
    c = fixed_doc_chunks(Tables(spark, d))
    return c.select("doc_id", lng("position").alias("position"), lng("n_words").alias("n_words"), F.md5("text").alias("text_md5"))


@key("chunk_fixed_small", "SELECT doc_id, position, n_words, md5(text) AS text_md5 FROM ("
     + O.fixed_chunks("documents", "doc_id", "text", 32, 0.25) + ") z")
def q_chunk_fixed_small(spark, d):
    c = fixed_doc_chunks(Tables(spark, d), 32, 0.25)
    return c.select("doc_id", lng("position").alias("position"), lng("n_words").alias("n_words"), F.md5("text").alias("text_md5"))


@key("sentences", "SELECT doc_id, pos, md5(sentence) AS sentence_md5 FROM (" + O.sentence_rows("documents", "doc_id", "text") + ") z")
def q_sentences(spark, d):
    s = C.sentences(Tables(spark, d).documents, "text", ["doc_id"])
    return s.select("doc_id", lng("pos").alias("pos"), F.md5("sentence").alias("sentence_md5"))


@key("verify_sentences", "SELECT doc_id, pos, md5(sentence) AS sentence_md5 FROM ("
     + O.sentence_rows("documents", "doc_id", "text", O.verify_sents) + ") z")
def q_verify_sentences(spark, d):
    s = Tables(spark, d).documents.select("doc_id", F.posexplode(X.verify_sentences("text")).alias("pos", "sentence"))
    return s.select("doc_id", lng("pos").alias("pos"), F.md5("sentence").alias("sentence_md5"))


@key("tokens", f"SELECT doc_id, len({O.tokens('text')})::BIGINT AS n_tokens, len(list_distinct({O.tokens('text')}))::BIGINT AS n_distinct FROM documents")
def q_tokens(spark, d):
    t = Tables(spark, d).documents.select("doc_id", X.tokens("text").alias("w"))
    return t.select("doc_id", lng(F.size("w")).alias("n_tokens"), lng(F.size(F.array_distinct("w"))).alias("n_distinct"))


_SEM_DOCS = O.semantic_ctes("s_", "documents", "doc_id", "text", SEM_THR, SEM_MAX)


@key("semantic_boundaries", O.with_(_SEM_DOCS, "SELECT doc_id, pos, round(sim, 6) AS sim, is_boundary FROM s_sb"))
def q_semantic_boundaries(spark, d):
    b = C.semantic_boundaries(Tables(spark, d).documents, "text", ["doc_id"], SEM_THR)
    return b.select("doc_id", lng("pos").alias("pos"), r6("sim").alias("sim"), "is_boundary")


@key("chunk_semantic", O.with_(_SEM_DOCS, "SELECT doc_id, position, n_sentences, md5(text) AS text_md5 FROM s_chunks"))
def q_chunk_semantic(spark, d):
    c = semantic_doc_chunks(Tables(spark, d))
    return c.select("doc_id", lng("position").alias("position"), lng("n_sentences").alias("n_sentences"), F.md5("text").alias("text_md5"))


@key("chunk_semantic_scan", ORACLE["chunk_semantic"])
def q_chunk_semantic_scan(spark, d):
    """The same chunks as rows: sentences numbered by a segmented scan, as an injected embedder's are."""
    c = C.chunk_semantic(Tables(spark, d).documents.select("doc_id", "text"), "text", ["doc_id"], SEM_THR, SEM_MAX, method="relational")
    return c.select("doc_id", lng("position").alias("position"), lng("n_sentences").alias("n_sentences"), F.md5("text").alias("text_md5"))


# index build over the nested dataset rows (three strategies)
def index_chunks(t: Tables) -> DataFrame:
    return C.build_index_chunks(V.qa_nested(t), threshold=SEM_THR, max_sentences=SEM_MAX)


_QA_FLAT = ("qf", "SELECT CAST(query_id AS VARCHAR) AS doc_id, coalesce(flat, '') AS text FROM qn")
_IDX_CTES = (O.views("qa_rows") + [("qn", _QA_NESTED_SQL), _QA_FLAT, ("ifx", O.fixed_chunks("qf", "doc_id", "text", 256, 0.15))]
             + O.semantic_ctes("is_", "qf", "doc_id", "text", SEM_THR, SEM_MAX)
             + [("ist", f"""SELECT CAST(query_id AS VARCHAR) AS doc_id, position::BIGINT AS position, {O.strip('passage')} AS text
FROM qa_rows WHERE passage IS NOT NULL AND {O.strip('passage')} <> ''"""),
                ("idx", """SELECT 'fixed' AS strategy, doc_id, position, text FROM ifx UNION ALL
SELECT 'semantic', doc_id, position, text FROM is_chunks UNION ALL SELECT 'structured', doc_id, position, text FROM ist""")])


@key("index_build_counts", O.with_(_IDX_CTES, f"""SELECT strategy, count(*)::BIGINT AS n_chunks, count(DISTINCT doc_id)::BIGINT AS n_docs,
  sum(len({O.tokens('text')}))::BIGINT AS n_words FROM idx GROUP BY strategy"""))
def q_index_build_counts(spark, d):
    c = index_chunks(Tables(spark, d))
    return c.groupBy("strategy").agg(lng(F.count(F.lit(1))).alias("n_chunks"), lng(F.countDistinct("doc_id")).alias("n_docs"),
                                     lng(F.sum(F.size(X.tokens("text")))).alias("n_words"))


@key("chunk_size_stats", O.with_(_IDX_CTES, f"""SELECT strategy, count(*)::BIGINT AS n_chunks, round(avg(length(text)), 6) AS avg_chars,
  round(avg(len({O.tokens('text')})), 6) AS avg_words FROM idx GROUP BY strategy"""))
def q_chunk_size_stats(spark, d):
    s = E.chunk_size_stats(index_chunks(Tables(spark, d)))
    return s.select("strategy", lng("n_chunks").alias("n_chunks"), r6("avg_chars").alias("avg_chars"), r6("avg_words").alias("avg_words"))


@key("index_upsert", O.with_([
    ("fx", "SELECT f.*, d.lang FROM (" + SQL_FIXED + ") f JOIN documents d USING (doc_id)"),
    ("fxi", "SELECT *, sha256(concat_ws('|', 'fixed', CAST(doc_id AS VARCHAR), CAST(position AS VARCHAR), text)) AS chunk_id FROM fx"),
    ("a", "SELECT * FROM fxi WHERE lang IN ('en', 'fr')"),
    ("b", "SELECT * FROM fxi WHERE lang IN ('fr', 'de', 'es')"),
    ("u", "SELECT * FROM a UNION ALL SELECT * FROM b WHERE chunk_id NOT IN (SELECT chunk_id FROM a)")],
    "SELECT lang, count(*)::BIGINT AS n_chunks, count(DISTINCT chunk_id)::BIGINT AS n_ids FROM u GROUP BY lang"))
def q_index_upsert(spark, d):
    t = Tables(spark, d)
    ch = with_ids(C.chunk_fixed(t.documents.select("doc_id", "text", "lang"), "text", ["doc_id"], keep_cols=["lang"]))
    a = ch.where(F.col("lang").isin("en", "fr"))
    b = ch.where(F.col("lang").isin("fr", "de", "es"))
    u = a.unionByName(upsert_plan(b, a))
    return u.groupBy("lang").agg(lng(F.count(F.lit(1))).alias("n_chunks"), lng(F.countDistinct("chunk_id")).alias("n_ids"))


# ----------------------------------------------------------------------------- answer text functions
@key("lang_script", O.with_(O.views("answers"), """SELECT question_id, regexp_matches(text, '[\\x{0900}-\\x{097F}]') AS is_hindi,
  CASE WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'hi-IN' ELSE 'en-US' END AS speech_lang FROM answers"""))
def q_lang_script(spark, d):
    a = V.answers(Tables(spark, d))
    return a.select("question_id", X.is_hindi("text").alias("is_hindi"), X.speech_lang("text").alias("speech_lang"))


@key("normalize_digits", O.with_(O.views("answers"), f"SELECT question_id, {O.norm_digits('text')} AS text FROM answers"))
def q_normalize_digits(spark, d):
    return V.answers(Tables(spark, d)).select("question_id", X.normalize_digits("text").alias("text"))


@key("spoken_text", O.with_(O.views("answers"), f"SELECT question_id, {O.spoken('text')} AS spoken FROM answers"))
def q_spoken_text(spark, d):
    return V.answers(Tables(spark, d)).select("question_id", X.spoken_text("text").alias("spoken"))


@key("clean_answer", O.with_(O.views("answers"), f"SELECT question_id, {O.clean('text')} AS cleaned FROM answers"))
def q_clean_answer(spark, d):
    return V.answers(Tables(spark, d)).select("question_id", X.clean_answer("text").alias("cleaned"))


@key("refusal_flag", f"SELECT conv_id, turn, {O.refusal('text')} AS refusal FROM conversations WHERE role = 'assistant'")
def q_refusal_flag(spark, d):
    c = Tables(spark, d).conversations.where(F.col("role") == "assistant")
    return c.select("conv_id", "turn", GEN.refusal_flag("text").alias("refusal"))


_CIT_CTES = O.views("answers", "answer_chunks") + O.citation_ctes("c_", "answers", "question_id", "text", "answer_chunks", "hit_rank")


def _citations(spark, d) -> DataFrame:
    t = Tables(spark, d)
    hits = V.answer_chunks(t).withColumnRenamed("hit_rank", "rank")
    return GEN.answer_citations(V.answers(t), "question_id", "text", hits)


@key("citations", O.with_(_CIT_CTES, "SELECT question_id, citations, n_cited FROM c_cit"))
def q_citations(spark, d):
    c = _citations(spark, d)
    return c.select("question_id", F.array_join("citations", "|").alias("citations"), lng(F.size("citations")).alias("n_cited"))


@key("finalize_answer", O.with_(_CIT_CTES, "SELECT question_id, refusal, md5(final_text) AS final_md5, citations FROM c_cit"))
def q_finalize_answer(spark, d):
    c = _citations(spark, d)
    return c.select("question_id", "refusal", F.md5("final_text").alias("final_md5"), F.array_join("citations", "|").alias("citations"))


# ---------------------------------------------------------------------------------------- gates
UNSAFE_WORDS = G.UNSAFE_PATTERNS + EXTRA_UNSAFE


@key("unsafe_match", f"SELECT conv_id, turn, {O.unsafe(O.strip('text'), UNSAFE_WORDS)} AS unsafe_match FROM conversations")
def q_unsafe_match(spark, d):
    c = Tables(spark, d).conversations
    return c.select("conv_id", "turn", G.unsafe_match(X.strip("text"), UNSAFE_WORDS).alias("unsafe_match"))


_GIB_CONV = O.gibberish_ctes("g_", "(SELECT conv_id * 100 + turn AS ct_id, text FROM conversations)", "ct_id", "text")


def _conv_rules(spark, d) -> DataFrame:
    c = Tables(spark, d).conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("ct_id"), "text")
    return G.with_rule_columns(c, "text")


@key("gib_symbol", O.with_(_GIB_CONV, "SELECT ct_id, f_symbol AS fires FROM g_ms"))
def q_gib_symbol(spark, d):
    return _conv_rules(spark, d).select("ct_id", F.col("symbol_f").alias("fires"))


@key("gib_repeat", O.with_(_GIB_CONV, "SELECT ct_id, m_repeat AS match FROM g_ms"))
def q_gib_repeat(spark, d):
    c = Tables(spark, d).conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("ct_id"), X.strip("text").alias("t"))
    return c.select("ct_id", F.nullif(F.regexp_extract("t", G.REPEATED_CHAR, 0), F.lit("")).alias("match"))


@key("gib_consonants", O.with_(_GIB_CONV, "SELECT ct_id, m_con AS match FROM g_ms"))
def q_gib_consonants(spark, d):
    c = Tables(spark, d).conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("ct_id"), X.strip("text").alias("t"))
    return c.select("ct_id", F.nullif(F.regexp_extract("t", G.ENGLISH_CONSONANT_RUN % 4, 0), F.lit("")).alias("match"))


@key("gib_dominance", O.with_(_GIB_CONV, """SELECT ct_id, n_ns::BIGINT AS n_chars, top::BIGINT AS top_count,
  (n_ns >= 6 AND top::DOUBLE / n_ns::DOUBLE > 0.45) AS fires FROM g_ms"""))
def q_gib_dominance(spark, d):
    c = Tables(spark, d).conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("ct_id"),
                                               G.char_dominance(X.strip("text")).alias("m"))
    return c.select("ct_id", lng("m.n").alias("n_chars"), lng("m.top").alias("top_count"),
                    ((F.col("m.n") >= 6) & (F.col("m.top") / F.col("m.n") > 0.45)).alias("fires"))


@key("gib_vowels", O.with_(_GIB_CONV, """SELECT ct_id, n_let::BIGINT AS letters, n_vow::BIGINT AS vowels,
  (n_let >= 6 AND n_vow::DOUBLE / n_let::DOUBLE < 0.22) AS fires FROM g_ms"""))
def q_gib_vowels(spark, d):
    r = _conv_rules(spark, d)
    t = F.col("text")
    return r.select("ct_id", lng(F.length(F.regexp_replace(X.strip(t), "[^A-Za-z]", ""))).alias("letters"),
                    lng(F.length(F.regexp_replace(X.strip(t), "[^AEIOUaeiou]", ""))).alias("vowels"), F.col("vowels_f").alias("fires"))


@key("gibberish_reason", O.with_(_GIB_CONV, "SELECT ct_id, rule, reason FROM g_gib"))
def q_gibberish_reason(spark, d):
    c = Tables(spark, d).conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("ct_id"), "text")
    return G.with_gibberish(c, "text").select("ct_id", F.col("gib_rule").alias("rule"), F.col("gib_reason").alias("reason"))


_CLS_Q = O.views("questions") + O.classify_ctes("q_", "questions", "question_id", "question", G.UNSAFE_PATTERNS)


def _classified(spark, d) -> DataFrame:
    return G.with_classification(V.questions(Tables(spark, d)), "question")


@key("classify_questions", O.with_(_CLS_Q, "SELECT question_id, verdict, rule, verdict_reason FROM q_cls"))
def q_classify_questions(spark, d):
    return _classified(spark, d).select("question_id", "verdict", "rule", "verdict_reason")


@key("verdict_counts", O.with_(_CLS_Q, "SELECT verdict, count(*)::BIGINT AS n FROM q_cls GROUP BY verdict"))
def q_verdict_counts(spark, d):
    return _classified(spark, d).groupBy("verdict").agg(lng(F.count(F.lit(1))).alias("n"))


# ------------------------------------------------------------------------------------------- dense
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z_: z_[1]::DOUBLE * z_[2]::DOUBLE))"
_NA = "sqrt(list_sum(list_transform(a.embedding, lambda x_: x_::DOUBLE * x_::DOUBLE)))"
_NB = "sqrt(list_sum(list_transform(b.embedding, lambda x_: x_::DOUBLE * x_::DOUBLE)))"


@key("l2_normalize", """SELECT vec_id, round(n, 6) AS norm_in,
  round(list_sum(list_transform(embedding, lambda x_: (x_::DOUBLE / n) * (x_::DOUBLE / n))), 6) AS norm_out,
  round(list_sum(list_transform(embedding, lambda x_: x_::DOUBLE / n)), 6) AS sum_out
FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x_: x_::DOUBLE * x_::DOUBLE))) AS n FROM embeddings) z""")
def q_l2_normalize(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", VEC.l2_norm("embedding").alias("n"), VEC.l2_normalize("embedding").alias("u"))
    sq = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    sm = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", r6("n").alias("norm_in"), r6(sq).alias("norm_out"), r6(sm).alias("sum_out"))


@key("cosine_pairs", f"""SELECT a.vec_id, b.vec_id AS next_id, a.label = b.label AS same_label,
  round({_DOT} / ({_NA} * {_NB}), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_cosine_pairs(spark, d):
    e = Tables(spark, d).embeddings
    a = e.select("vec_id", "label", F.col("embedding").alias("ea"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("label").alias("lb"), F.col("embedding").alias("eb"))
    j = a.join(b, "vec_id")
    return j.select("vec_id", "next_id", (F.col("label") == F.col("lb")).alias("same_label"), r6(VEC.cosine("ea", "eb")).alias("cosine"))


_KNN_DENSE_SQL = f"""SELECT q_id, rank::BIGINT AS rank, vec_id, round(score, 6) AS score FROM (
  SELECT a.vec_id AS q_id, b.vec_id, {_DOT} / ({_NA} * {_NB}) AS score,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT} / ({_NA} * {_NB}), 6) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) z WHERE rank <= {K}"""


@key("knn_dense", _KNN_DENSE_SQL)
def q_knn_dense(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", "embedding")
    h = R.knn_dense(e.withColumnRenamed("vec_id", "q_id"), "q_id", "embedding", e, "vec_id", "embedding", K, exclude_self=True)
    return h.select("q_id", lng("rank").alias("rank"), "vec_id", r6("score").alias("score"))


IVF_CELLS, IVF_PROBE = 16, 10
_UNIT = "list_transform(embedding, lambda x_: x_::DOUBLE / n)"
_UDOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z_: z_[1] * z_[2]))"
_IVF = [
    ("unit", f"""SELECT vec_id, {_UNIT} AS u FROM (SELECT vec_id, embedding,
  sqrt(list_sum(list_transform(embedding, lambda y_: y_::DOUBLE * y_::DOUBLE))) AS n FROM embeddings) z"""),
    ("pivots", f"SELECT * FROM (SELECT u AS p, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS c FROM unit) z WHERE c <= {IVF_CELLS}"),
    ("near", f"""SELECT vec_id, u, c, row_number() OVER (PARTITION BY vec_id ORDER BY round({_UDOT.format(a='u', b='p')}, 6) DESC, c) AS nth
FROM unit CROSS JOIN pivots"""),
    ("ivf", f"""SELECT q.vec_id AS q_id, x.vec_id, {_UDOT.format(a='q.u', b='x.u')} AS score FROM near q JOIN near x ON q.c = x.c AND x.nth = 1
AND q.nth <= {IVF_PROBE} AND q.vec_id <> x.vec_id"""),
    ("ivf_hits", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM ivf) z
WHERE rank <= {K}"""),
]


def _ivf(spark, d) -> DataFrame:
    e = Tables(spark, d).embeddings.select("vec_id", "embedding")
    return R.knn_ivf(e.withColumnRenamed("vec_id", "q_id"), "q_id", "embedding", e, "vec_id", "embedding", K, n_cells=IVF_CELLS,
                     nprobe=IVF_PROBE, exclude_self=True)


@key("knn_ivf", O.with_(_IVF, "SELECT q_id, rank::BIGINT AS rank, vec_id, round(score, 6) AS score FROM ivf_hits"))
def q_knn_ivf(spark, d):
    return _ivf(spark, d).select("q_id", lng("rank").alias("rank"), "vec_id", r6("score").alias("score"))


@key("ivf_recall", O.with_(_IVF + [("exact", _KNN_DENSE_SQL)], """SELECT count(*)::BIGINT AS n_exact, count(h.vec_id)::BIGINT AS n_found,
  round(count(h.vec_id) / count(*), 6) AS recall FROM exact x LEFT JOIN ivf_hits h ON x.q_id = h.q_id AND x.vec_id = h.vec_id"""))
def q_ivf_recall(spark, d):
    found = _ivf(spark, d).select("q_id", "vec_id", F.lit(1).alias("hit"))
    exact = q_knn_dense(spark, d).select("q_id", "vec_id")
    j = exact.join(found, ["q_id", "vec_id"], "left")
    return j.agg(lng(F.count(F.lit(1))).alias("n_exact"), lng(F.count("hit")).alias("n_found"), r6(F.count("hit") / F.count(F.lit(1))).alias("recall"))


#: cells fitted on a bounded sample, with at least LEAST_RECALL of the exact neighbours on the driver data; no SQL form
FITTED_CELLS, FITTED_PROBE, FITTED_SAMPLE, LEAST_RECALL = 32, 20, 4096, 0.9


@key("knn_ivf_fitted")
def q_knn_ivf_fitted(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", "embedding")
    h = R.knn_ivf(e.withColumnRenamed("vec_id", "q_id"), "q_id", "embedding", e, "vec_id", "embedding", K, n_cells=FITTED_CELLS,
                  nprobe=FITTED_PROBE, exclude_self=True, fit_sample=FITTED_SAMPLE)
    return h.select("q_id", lng("rank").alias("rank"), "vec_id", r6("score").alias("score"))


@key("ivf_fitted_recall")
def q_ivf_fitted_recall(spark, d):
    found = q_knn_ivf_fitted(spark, d).select("q_id", "vec_id", F.lit(1).alias("hit"))
    j = q_knn_dense(spark, d).select("q_id", "vec_id").join(found, ["q_id", "vec_id"], "left")
    return j.agg(lng(F.count(F.lit(1))).alias("n_exact"), lng(F.count("hit")).alias("n_found"), r6(F.count("hit") / F.count(F.lit(1))).alias("recall"))


# ----------------------------------------------------------------------------------------- lexical
_KNN_LEX = [("fx", SQL_FIXED)] + sql_bench_hits()


@key("knn_lexical", O.with_(_KNN_LEX, "SELECT item_id, rank, doc_id, position, round(score, 6) AS score FROM k_hits"))
def q_knn_lexical(spark, d):
    h = bench_hits(Tables(spark, d))
    return h.select("item_id", lng("rank").alias("rank"), "doc_id", lng("position").alias("position"), r6("score").alias("score"))


def _impact_index(spark, t: Tables) -> DataFrame:
    path = scratch_path(spark, "impact")
    IMP.write(IMP.build(fixed_doc_chunks(t), ["doc_id", "position"], "text"), path)
    return IMP.read(spark, path)


@key("knn_lexical_bounded", ORACLE["knn_lexical"])
def q_knn_lexical_bounded(spark, d):
    """The same hits from the written index, reading only blocks whose bound reaches the question's bar."""
    t = Tables(spark, d)
    h = IMP.search(t.benchmark, "item_id", "text", _impact_index(spark, t), ["doc_id", "position"], K)
    return h.select("item_id", lng("rank").alias("rank"), "doc_id", lng("position").alias("position"), r6("score").alias("score"))


@key("lexical_read_share")
def q_lexical_read_share(spark, d):
    """What that search reads: blocks and postings of the questions' terms (the blocks depend on the order of the chunks: no SQL)."""
    t = Tables(spark, d)
    return IMP.read_share(t.benchmark, "item_id", "text", _impact_index(spark, t), ["doc_id", "position"], K)


_SEM_CH = [(n, q) for n, q in _SEM_DOCS] + O.knn_ctes("ks_", "benchmark", "item_id", "text", "s_chunks", ["doc_id", "position"], "text", K)


@key("knn_by_strategy", O.with_(_SEM_CH, "SELECT item_id, rank, doc_id, position, round(score, 6) AS score FROM ks_hits"))
def q_knn_by_strategy(spark, d):
    t = Tables(spark, d)
    idx = fixed_doc_chunks(t).drop("n_words").unionByName(semantic_doc_chunks(t).drop("n_sentences"))
    sem = idx.where(F.col("strategy") == "semantic")  # the other strategy's branch is pruned from the plan
    h = R.knn_lexical(t.benchmark, "item_id", "text", sem, ["doc_id", "position"], "text", K)
    return h.select("item_id", lng("rank").alias("rank"), "doc_id", lng("position").alias("position"), r6("score").alias("score"))


@key("grounding_gate", O.with_(_KNN_LEX, "SELECT item_id, can_answer, round(top_score, 6) AS top_score, reason FROM ("
                               + O.grounding_sql("benchmark", "item_id", "k_hits", GROUND_THR) + ") z"))
def q_grounding_gate(spark, d):
    t = Tables(spark, d)
    g = G.grounding_gate(t.benchmark, "item_id", bench_hits(t), GROUND_THR)
    return g.select("item_id", "can_answer", r6("top_score").alias("top_score"), "reason")


_HT = [("fx", SQL_FIXED), ("fxi", SQL_FIXED_IDS)] + sql_bench_hits("fxi") + [
    ("ht", "SELECT h.item_id, h.rank, f.text, f.chunk_id FROM k_hits h JOIN fxi f ON h.doc_id = f.doc_id AND h.position = f.position")]


def _bench_hits_text(t: Tables) -> DataFrame:
    ch = with_ids(fixed_doc_chunks(t))
    return R.attach_chunks(bench_hits(t, ch), ch, ["doc_id", "position"], ["text", "chunk_id"])


@key("prompt_build", O.with_(_HT, f"""SELECT b.item_id, count(*)::BIGINT AS n_context,
  md5({GEN.DEFAULT_TEMPLATE.split('{context}')[0]!r} || string_agg('[' || CAST(h.rank AS VARCHAR) || '] ' || h.text, chr(10) || chr(10) ORDER BY h.rank)
      || {GEN.DEFAULT_TEMPLATE.split('{context}')[1].split('{question}')[0]!r} || {O.strip('b.text')}
      || {GEN.DEFAULT_TEMPLATE.split('{question}')[1]!r}) AS prompt_md5
FROM benchmark b JOIN ht h ON b.item_id = h.item_id GROUP BY b.item_id, b.text""".replace("\\n", "' || chr(10) || '")))
def q_prompt_build(spark, d):
    t = Tables(spark, d)
    p = GEN.prompt_build(t.benchmark, "item_id", "text", _bench_hits_text(t))
    return p.select("item_id", lng("n_context").alias("n_context"), F.md5("prompt").alias("prompt_md5"))


@key("extractive_answers", O.with_(_HT + O.extractive_ctes("x_", "benchmark", "item_id", "text", "ht"),
                                   "SELECT item_id, md5(answer) AS answer_md5, length(answer)::BIGINT AS answer_len FROM x_raw"))
def q_extractive_answers(spark, d):
    t = Tables(spark, d)
    a = GEN.extractive_answers(t.benchmark, "item_id", "text", _bench_hits_text(t))
    return a.select("item_id", F.md5("answer").alias("answer_md5"), lng(F.length("answer")).alias("answer_len"))


# ------------------------------------------------------------------------------------ verification
_VER = O.views("answers", "answer_chunks") + O.verify_ctes("v_", "answers", "question_id", "text", "answer_chunks", "hit_rank")


def _flags(spark, d) -> DataFrame:
    t = Tables(spark, d)
    hits = V.answer_chunks(t).withColumnRenamed("hit_rank", "rank")
    return VER.flagged_claims(V.answers(t), "question_id", "text", hits)


_FLAG_COLS = ["question_id", "sent_no", "claim", "citation_index", "chunk_id", "reason"]


@key("numeric_claims", O.with_(_VER, "SELECT question_id, sent_no::BIGINT AS sent_no, claim FROM v_claims"))
def q_numeric_claims(spark, d):
    a = V.answers(Tables(spark, d))
    c = VER.claim_rows(a, "question_id", "text")
    return c.select("question_id", lng("sent_no").alias("sent_no"), F.explode("claims").alias("claim"))


@key("verify_cited", O.with_(_VER, "SELECT question_id, sent_no::BIGINT AS sent_no, claim, citation_index, chunk_id, reason FROM v_cited"))
def q_verify_cited(spark, d):
    f = _flags(spark, d).where(F.col("citation_index").isNotNull())
    return f.select(*_FLAG_COLS).withColumn("sent_no", lng("sent_no"))


@key("verify_uncited", O.with_(_VER, "SELECT question_id, sent_no::BIGINT AS sent_no, claim, reason FROM v_uncited"))
def q_verify_uncited(spark, d):
    f = _flags(spark, d).where(F.col("citation_index").isNull())
    return f.select("question_id", lng("sent_no").alias("sent_no"), "claim", "reason")


@key("flagged_claims", O.with_(_VER, "SELECT question_id, sent_no::BIGINT AS sent_no, claim, citation_index, chunk_id, reason FROM v_flags"))
def q_flagged_claims(spark, d):
    return _flags(spark, d).select(*_FLAG_COLS).withColumn("sent_no", lng("sent_no"))


@key("verify_answers", O.with_(_VER, """SELECT a.question_id, coalesce(f.n, 0)::BIGINT AS n_flags, coalesce(f.n, 0) = 0 AS is_fully_grounded
FROM answers a LEFT JOIN (SELECT question_id, count(*) AS n FROM v_flags GROUP BY question_id) f ON a.question_id = f.question_id"""))
def q_verify_answers(spark, d):
    t = Tables(spark, d)
    hits = V.answer_chunks(t).withColumnRenamed("hit_rank", "rank")
    v = VER.verify_answers(V.answers(t), "question_id", "text", hits)
    return v.select("question_id", "n_flags", "is_fully_grounded")


def _option_flags(name: str, change: str, **options) -> None:
    """The flags of a claim option, on answers in which ``change`` (an expression of both engines) makes it matter."""
    changed = [("changed", f"SELECT question_id, {change} AS text FROM answers")]
    sql = O.views("answers", "answer_chunks") + changed + O.verify_ctes("v_", "changed", "question_id", "text", "answer_chunks", "hit_rank",
                                                                        decimals=options.get("decimals", False), grouped=options.get("grouped_tags", False))

    @key(name, O.with_(sql, "SELECT question_id, sent_no::BIGINT AS sent_no, claim, citation_index, chunk_id, reason FROM v_flags"))
    def run(spark, d):
        t = Tables(spark, d)
        hits = V.answer_chunks(t).withColumnRenamed("hit_rank", "rank")
        f = VER.flagged_claims(V.answers(t).withColumn("text", F.expr(change)), "question_id", "text", hits, **options)
        return f.select(*_FLAG_COLS).withColumn("sent_no", lng("sent_no"))


_option_flags("flagged_decimals", "replace(text, '3.5 kg', '3.5 kg or 1.25.75 kg')", decimals=True)
_option_flags("flagged_grouped_tags", "replace(replace(text, '[1]', '[1, 2]'), '[9]', '[ 9]')", grouped_tags=True)


# --------------------------------------------------------------------------------------- evaluation
STRATEGIES = ("fixed", "semantic", "structured")


def _qa_eval(t: Tables):
    nested = cached(V.qa_nested(t))  # read by the ground truth and all three strategies
    gt = cached(E.ground_truth(nested))
    evq = cached(gt.select("query_id", "query_text").distinct())
    idx = cached(C.build_index_chunks(nested, threshold=SEM_THR, max_sentences=SEM_MAX).select(
        "strategy", "doc_id", "position", "text"))  # searched and joined back once per strategy
    keys = ["strategy", "doc_id", "position"]
    hits = R.knn_lexical(evq, "query_id", "query_text", idx, keys, "text", K, group="strategy")  # one search for all strategies
    hits = R.attach_chunks(hits, idx, keys, ["text"])
    return gt, evq, hits


def _qa_eval_sql() -> list[tuple[str, str]]:
    ctes = list(_IDX_CTES) + [
        ("gt", f"""SELECT query_id, {O.strip('query')} AS query_text, position, {O.strip('passage')} AS gt_text FROM qa_rows
WHERE is_selected = 1 AND passage IS NOT NULL AND {O.strip('passage')} <> '' AND {O.strip('query')} <> ''"""),
        ("evq", "SELECT DISTINCT query_id, query_text FROM gt")]
    for s, src in (("fixed", "ifx"), ("semantic", "is_chunks"), ("structured", "ist")):
        ctes += O.knn_ctes(f"e{s[:2]}_", "evq", "query_id", "query_text", src, ["doc_id", "position"], "text", K)
    ctes.append(("ehits", " UNION ALL ".join(
        f"SELECT '{s}' AS strategy, h.query_id, h.rank, h.doc_id, h.position, c.text FROM e{s[:2]}_hits h JOIN {src} c "
        f"ON h.doc_id = c.doc_id AND h.position = c.position"
        for s, src in (("fixed", "ifx"), ("semantic", "is_chunks"), ("structured", "ist")))))
    ov = (f"CASE WHEN least(len(list_distinct({O.tokens('h.text')})), len(list_distinct({O.tokens('g.gt_text')}))) > 0 THEN "
          f"len(list_intersect(list_distinct({O.tokens('h.text')}), list_distinct({O.tokens('g.gt_text')})))::DOUBLE / "
          f"least(len(list_distinct({O.tokens('h.text')})), len(list_distinct({O.tokens('g.gt_text')})))::DOUBLE ELSE 0.0 END")
    ctes.append(("hov", f"""SELECT h.strategy, h.query_id, h.rank, max({ov}) AS best_overlap FROM ehits h JOIN gt g ON h.query_id = g.query_id
GROUP BY h.strategy, h.query_id, h.rank"""))
    ctes.append(("fr", "SELECT strategy, query_id, min(CASE WHEN best_overlap >= 0.5 THEN rank END) AS first_rank FROM hov GROUP BY strategy, query_id"))
    ctes.append(("rk", """SELECT s.strategy, k.k, avg(CASE WHEN f.first_rank <= k.k THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n_queries
FROM (SELECT DISTINCT query_id FROM evq) q CROSS JOIN (VALUES ('fixed'), ('semantic'), ('structured')) s(strategy)
CROSS JOIN (VALUES (1), (3), (5)) k(k) LEFT JOIN fr f ON f.query_id = q.query_id AND f.strategy = s.strategy
GROUP BY s.strategy, k.k"""))
    return ctes


@key("overlap_ratio", O.with_(_qa_eval_sql(), "SELECT strategy, query_id, rank::BIGINT AS rank, round(best_overlap, 6) AS best_overlap FROM hov"))
def q_overlap_ratio(spark, d):
    gt, evq, hits = _qa_eval(Tables(spark, d))
    o = E.hit_overlaps(hits, gt, "query_id", ["strategy"])
    return o.select("strategy", "query_id", lng("rank").alias("rank"), r6("best_overlap").alias("best_overlap"))


def _recall(spark, d) -> DataFrame:
    gt, evq, hits = _qa_eval(Tables(spark, d))
    first = E.first_hit_rank(hits, gt, "query_id", ["strategy"])
    return E.recall_at_k(first, evq, "query_id", "strategy", STRATEGIES)


@key("recall_at_k", O.with_(_qa_eval_sql(), "SELECT strategy, k::BIGINT AS k, round(recall, 6) AS recall, n_queries::BIGINT AS n_queries FROM rk"))
def q_recall_at_k(spark, d):
    r = _recall(spark, d)
    return r.select("strategy", lng("k").alias("k"), r6("recall").alias("recall"), lng("n_queries").alias("n_queries"))


@key("strategy_report", O.with_(_qa_eval_sql(), """SELECT strategy, round(max(recall) FILTER (WHERE k = 1), 6) AS recall_at_1,
  round(max(recall) FILTER (WHERE k = 3), 6) AS recall_at_3, round(max(recall) FILTER (WHERE k = 5), 6) AS recall_at_5 FROM rk GROUP BY strategy"""))
def q_strategy_report(spark, d):
    r = _recall(spark, d)
    return r.groupBy("strategy").agg(*[r6(F.max(F.when(F.col("k") == k, F.col("recall")))).alias(f"recall_at_{k}") for k in (1, 3, 5)])


_DOC_EVAL = (O.views("eval_pairs") + [("fx", SQL_FIXED)] + sql_bench_hits("fx", "kf_") + _SEM_DOCS
             + O.knn_ctes("ksm_", "benchmark", "item_id", "text", "s_chunks", ["doc_id", "position"], "text", K)
             + [("dr", """SELECT 'fixed' AS strategy, p.item_id, p.doc_id, min(h.rank) AS first_rank FROM eval_pairs p
  LEFT JOIN kf_hits h ON p.item_id = h.item_id AND p.doc_id = h.doc_id GROUP BY p.item_id, p.doc_id
UNION ALL SELECT 'semantic', p.item_id, p.doc_id, min(h.rank) FROM eval_pairs p
  LEFT JOIN ksm_hits h ON p.item_id = h.item_id AND p.doc_id = h.doc_id GROUP BY p.item_id, p.doc_id""")])


def _doc_ranks(spark, d) -> DataFrame:
    t = Tables(spark, d)
    pairs = checkpoint(V.eval_pairs(t))  # found once, read for both strategies
    ch = fixed_doc_chunks(t).drop("n_words").unionByName(semantic_doc_chunks(t).drop("n_sentences"))
    h = R.knn_lexical(t.benchmark, "item_id", "text", ch, ["strategy", "doc_id", "position"], "text", K, group="strategy")
    both = pairs.withColumn("strategy", F.explode(F.array(F.lit("fixed"), F.lit("semantic"))))
    return E.doc_rank(h, both, "item_id", group_cols=["strategy"])


@key("doc_rank", O.with_(_DOC_EVAL, "SELECT strategy, item_id, doc_id, first_rank::BIGINT AS first_rank FROM dr"))
def q_doc_rank(spark, d):
    r = _doc_ranks(spark, d)
    return r.select("strategy", "item_id", "doc_id", lng("first_rank").alias("first_rank"))


@key("mrr", O.with_(_DOC_EVAL, """SELECT strategy, round(avg(CASE WHEN first_rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall,
  round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr, count(*)::BIGINT AS n FROM dr GROUP BY strategy"""))
def q_mrr(spark, d):
    m = E.mrr(_doc_ranks(spark, d), ["strategy"])
    return m.select("strategy", r6("recall").alias("recall"), r6("mrr").alias("mrr"), lng("n").alias("n"))


def _top1(spark, d) -> DataFrame:
    t = Tables(spark, d)
    qs = (t.benchmark.select(F.concat(F.lit("in_scope:"), F.col("item_id").cast("string")).alias("qk"), "text")
          .unionByName(V.questions(t).select(F.concat(F.lit("nonsense:"), F.col("question_id").cast("string")).alias("qk"),
                                             F.col("question").alias("text"))))
    h = R.knn_lexical(qs, "qk", "text", fixed_doc_chunks(t), ["doc_id", "position"], "text", 1)
    h = qs.select("qk").join(h, "qk", "left")  # a question with no hit scores 0
    return h.select(F.split("qk", ":")[0].alias("grp"), F.coalesce("score", F.lit(0.0)).alias("score"))


_TOP1 = [("fx", SQL_FIXED), ("cq", """SELECT 'in_scope:' || CAST(item_id AS VARCHAR) AS qk, text FROM benchmark UNION ALL
SELECT 'nonsense:' || CAST(conv_id * 100 + turn AS VARCHAR), text FROM conversations WHERE role = 'user'""")] + \
    O.knn_ctes("t1_", "cq", "qk", "text", "fx", ["doc_id", "position"], "text", 1) + [
    ("top1", "SELECT split_part(q.qk, ':', 1) AS grp, coalesce(h.score, 0.0) AS score FROM cq q LEFT JOIN t1_hits h ON q.qk = h.qk")]


@key("calibration", O.with_(_TOP1, """SELECT grp, count(*)::BIGINT AS n, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
  round(avg(score), 6) AS mean_score FROM top1 GROUP BY grp"""))
def q_calibration(spark, d):
    c = E.calibration(_top1(spark, d))
    return c.select("grp", lng("n").alias("n"), r6("min_score").alias("min_score"), r6("max_score").alias("max_score"),
                    r6("mean_score").alias("mean_score"))


_SWEEP_SQL = ", ".join(f"({t})" for t in SWEEP)


@key("threshold_sweep", O.with_(_TOP1, f"""SELECT grp, round(th, 6) AS threshold, sum(CASE WHEN score >= th THEN 1 ELSE 0 END)::BIGINT AS n_pass,
  round(avg(CASE WHEN score >= th THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
FROM top1 CROSS JOIN (SELECT CAST(v AS DOUBLE) AS th FROM (VALUES {_SWEEP_SQL}) t0(v)) t GROUP BY grp, th"""))
def q_threshold_sweep(spark, d):
    s = E.threshold_sweep(_top1(spark, d), SWEEP)
    return s.select("grp", r6("threshold").alias("threshold"), "n_pass", r6("pass_rate").alias("pass_rate"))


@key("threshold_area", O.with_(_TOP1 + [
    ("rates", f"""SELECT th, avg(CASE WHEN grp = 'nonsense' THEN CASE WHEN score >= th THEN 1.0 ELSE 0.0 END END) AS x,
  avg(CASE WHEN grp = 'in_scope' THEN CASE WHEN score >= th THEN 1.0 ELSE 0.0 END END) AS y
FROM top1 CROSS JOIN (SELECT CAST(v AS DOUBLE) AS th FROM (VALUES {_SWEEP_SQL}) t0(v)) t GROUP BY th"""),
    ("curve", "SELECT -1.0::DOUBLE AS th, 1.0 AS x, 1.0 AS y UNION ALL SELECT th, x, y FROM rates UNION ALL SELECT 9.0, 0.0, 0.0"),
    ("steps", "SELECT (lag(x) OVER (ORDER BY th) - x) * (lag(y) OVER (ORDER BY th) + y) / 2 AS a FROM curve")],
    "SELECT round(sum(a), 6) AS area FROM steps"))
def q_threshold_area(spark, d):
    """How well the top score tells questions of the corpus from others: area under the curve of the sweep."""
    return E.separation(E.threshold_sweep(_top1(spark, d), SWEEP), "in_scope", "nonsense").select(r6("area").alias("area"))


# ------------------------------------------------------------------------------------------ latency
_REQ = O.views("stage_log") + [("req", """SELECT request_group, sum(ms) AS total_ms,
  coalesce(sum(ms) FILTER (WHERE stage = 'view'), 0.0) AS retrieve_ms, count(*) AS n_stages, min(seq) AS first_seq,
  bool_and(ok) AS completed, coalesce(arg_min(stage, seq) FILTER (WHERE NOT ok), 'verify') AS stopped_at
FROM stage_log GROUP BY request_group"""), ("warm", "SELECT * FROM req WHERE first_seq <> (SELECT min(first_seq) FROM req)")]


def _requests(spark, d) -> DataFrame:
    return L.request_totals(V.stage_log(Tables(spark, d)), retrieve_stage="view")


@key("latency_totals", O.with_(_REQ, """SELECT request_group, round(total_ms, 6) AS total_ms, round(retrieve_ms, 6) AS retrieve_ms,
  n_stages::BIGINT AS n_stages, completed, stopped_at FROM req"""))
def q_latency_totals(spark, d):
    r = _requests(spark, d)
    return r.select("request_group", r6("total_ms").alias("total_ms"), r6("retrieve_ms").alias("retrieve_ms"),
                    lng("n_stages").alias("n_stages"), "completed", "stopped_at")


@key("latency_percentiles", O.with_(O.views("stage_log"), """SELECT stage, round(q[1], 6) AS p50, round(q[2], 6) AS p70, round(q[3], 6) AS p100
FROM (SELECT stage, quantile_cont(ms, [0.5, 0.7, 1.0]) AS q FROM stage_log GROUP BY stage) z"""))
def q_latency_percentiles(spark, d):
    p = L.percentiles(V.stage_log(Tables(spark, d)), ["stage"], "ms")
    return p.select("stage", r6("p50").alias("p50"), r6("p70").alias("p70"), r6("p100").alias("p100"))


@key("latency_sketches", O.with_(O.views("stage_log"), """SELECT stage, count(*)::BIGINT AS n, round(min(ms), 6) AS least, round(max(ms), 6) AS greatest,
  TRUE AS p50_within, TRUE AS p70_within, TRUE AS p95_within FROM stage_log GROUP BY stage"""))
def q_latency_sketches(spark, d):
    """Ten-minute sketches merged to hours and these to all time; each percentile's exact rank is within the stated error."""
    log = V.stage_log(Tables(spark, d))
    fine = SK.sketch_windows(log, ["stage"], "ts", "ms", "10 minutes")
    merged = SK.merge_windows(SK.merge_windows(fine, ["stage"], "hour"), ["stage"])
    ps = {"p50": 0.5, "p70": 0.7, "p95": 0.95}
    held = SK.sketch_percentiles(merged, tuple(ps.values()), tuple(ps)).join(merged.select("stage", "least", "greatest"), "stage")
    ranked = log.join(F.broadcast(held), "stage").groupBy("stage", "n", "least", "greatest").agg(
        *[(F.sum((F.col("ms") < F.col(c)).cast("long")) / F.col("n")).alias(f"{c}_low") for c in ps],
        *[(F.sum((F.col("ms") <= F.col(c)).cast("long")) / F.col("n")).alias(f"{c}_high") for c in ps])
    within = [((F.col(f"{c}_low") - 2 * SK.RANK_ERROR <= p) & (p <= F.col(f"{c}_high") + 2 * SK.RANK_ERROR)).alias(f"{c}_within") for c, p in ps.items()]
    return ranked.select("stage", lng("n").alias("n"), r6("least").alias("least"), r6("greatest").alias("greatest"), *within)


@key("latency_nearest_rank", O.with_(O.views("stage_log"), """SELECT stage,
  round(max(ms) FILTER (WHERE rk = least(n - 1, round_even(0.5::DOUBLE * (n - 1), 0))), 6) AS p50,
  round(max(ms) FILTER (WHERE rk = least(n - 1, round_even(0.7::DOUBLE * (n - 1), 0))), 6) AS p70,
  round(max(ms) FILTER (WHERE rk = least(n - 1, round_even(1.0::DOUBLE * (n - 1), 0))), 6) AS p100,
  round(avg(ms), 6) AS mean_ms
FROM (SELECT stage, ms, row_number() OVER (PARTITION BY stage ORDER BY ms) - 1 AS rk, count(*) OVER (PARTITION BY stage) AS n FROM stage_log) z
GROUP BY stage"""))
def q_latency_nearest_rank(spark, d):
    log = V.stage_log(Tables(spark, d))
    p = L.percentiles(log, ["stage"], "ms", method="nearest")
    m = log.groupBy("stage").agg(F.avg("ms").alias("mean_ms"))
    return p.join(m, "stage").select("stage", r6("p50").alias("p50"), r6("p70").alias("p70"), r6("p100").alias("p100"),
                                     r6("mean_ms").alias("mean_ms"))


@key("latency_warm", O.with_(_REQ, """SELECT count(*)::BIGINT AS n_warm, round(quantile_cont(total_ms, 0.5), 6) AS p50,
  round(quantile_cont(total_ms, 0.7), 6) AS p70, round(quantile_cont(total_ms, 1.0), 6) AS p100 FROM warm"""))
def q_latency_warm(spark, d):
    w = L.warm_only(_requests(spark, d)).withColumn("series", F.lit("warm"))
    p = L.percentiles(w, ["series"], "total_ms", with_n=True)
    return p.select(lng("n").alias("n_warm"), r6("p50").alias("p50"), r6("p70").alias("p70"), r6("p100").alias("p100"))


@key("latency_share", O.with_(O.views("stage_log"), """SELECT request_group, stage, round(ms, 6) AS ms,
  round(greatest(5.0, least(100.0, ms / nullif(sum(ms) OVER (PARTITION BY request_group), 0.0) * 100)), 6) AS share
FROM (SELECT request_group, stage, sum(ms) AS ms FROM stage_log GROUP BY request_group, stage) z"""))
def q_latency_share(spark, d):
    s = L.stage_share(V.stage_log(Tables(spark, d)))
    return s.select("request_group", "stage", r6("ms").alias("ms"), r6("share").alias("share"))


@key("benchmark_summary", O.with_(_REQ + [("cold", "SELECT * FROM req WHERE first_seq = (SELECT min(first_seq) FROM req)")], """SELECT
  (SELECT count(*) FROM req)::BIGINT AS n_requests, (SELECT count(*) FROM warm)::BIGINT AS n_warm,
  (SELECT round(max(total_ms), 6) FROM cold) AS cold_total_ms, (SELECT round(max(retrieve_ms), 6) FROM cold) AS cold_retrieve_ms,
  (SELECT round(quantile_cont(retrieve_ms, 0.5), 6) FROM warm) AS retrieval_p50, (SELECT round(quantile_cont(retrieve_ms, 0.7), 6) FROM warm) AS retrieval_p70,
  (SELECT round(quantile_cont(retrieve_ms, 1.0), 6) FROM warm) AS retrieval_p100,
  (SELECT count(*) FROM warm WHERE completed)::BIGINT AS completed_n,
  (SELECT round(coalesce(quantile_cont(total_ms, 0.5), 0.0), 6) FROM warm WHERE completed) AS completed_p50,
  (SELECT round(coalesce(quantile_cont(total_ms, 0.7), 0.0), 6) FROM warm WHERE completed) AS completed_p70,
  (SELECT round(coalesce(quantile_cont(total_ms, 1.0), 0.0), 6) FROM warm WHERE completed) AS completed_p100,
  (SELECT round(quantile_cont(total_ms, 0.5), 6) FROM warm) AS all_p50, (SELECT round(quantile_cont(total_ms, 0.7), 6) FROM warm) AS all_p70,
  (SELECT round(quantile_cont(total_ms, 1.0), 6) FROM warm) AS all_p100,
  (SELECT count(*) FROM warm WHERE NOT completed)::BIGINT AS n_short_circuit"""))
def q_benchmark_summary(spark, d):
    req = cached(_requests(spark, d))
    warm = L.warm_only(req)
    cold = req.join(F.broadcast(req.agg(F.min("first_seq").alias("first_seq"))), "first_seq")
    series = (warm.select(F.lit("retrieval").alias("series"), F.col("retrieve_ms").alias("v"))
              .unionByName(warm.where("completed").select(F.lit("completed").alias("series"), F.col("total_ms").alias("v")))
              .unionByName(warm.select(F.lit("all").alias("series"), F.col("total_ms").alias("v"))))
    p = L.percentiles(series, ["series"], "v")
    # every one-row figure becomes (metric, value) rows; one global aggregate lays them side by side
    kv = p.select(F.explode(F.array(*[F.struct(F.concat(F.col("series"), F.lit(f"_{c}")).alias("m"), F.col(c).cast("double").alias("v"))
                                      for c in ("p50", "p70", "p100")])).alias("x")).select("x.m", "x.v")
    kv = kv.unionByName(warm.agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("n_warm").alias("m"), "v"))
    kv = kv.unionByName(warm.agg(F.sum(F.col("completed").cast("int")).cast("double").alias("v")).select(F.lit("completed_n").alias("m"), "v"))
    kv = kv.unionByName(warm.agg(F.sum((~F.col("completed")).cast("int")).cast("double").alias("v")).select(F.lit("n_short_circuit").alias("m"), "v"))
    kv = kv.unionByName(cold.agg(F.max("total_ms").alias("v")).select(F.lit("cold_total_ms").alias("m"), "v"))
    kv = kv.unionByName(cold.agg(F.max("retrieve_ms").alias("v")).select(F.lit("cold_retrieve_ms").alias("m"), "v"))
    kv = kv.unionByName(req.agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("n_requests").alias("m"), "v"))
    val = lambda m: F.max(F.when(F.col("m") == m, F.col("v")))
    out = [lng(val("n_requests")).alias("n_requests"), lng(val("n_warm")).alias("n_warm"),
           r6(val("cold_total_ms")).alias("cold_total_ms"), r6(val("cold_retrieve_ms")).alias("cold_retrieve_ms")]
    out += [r6(val(f"retrieval_{c}")).alias(f"retrieval_{c}") for c in ("p50", "p70", "p100")]
    out += [lng(val("completed_n")).alias("completed_n")]
    out += [r6(F.coalesce(val(f"completed_{c}"), F.lit(0.0))).alias(f"completed_{c}") for c in ("p50", "p70", "p100")]
    out += [r6(val(f"all_{c}")).alias(f"all_{c}") for c in ("p50", "p70", "p100")] + [lng(val("n_short_circuit")).alias("n_short_circuit")]
    return kv.agg(*out)


# ----------------------------------------------------------------------------------------- pipeline
def _pipeline(spark, d) -> DataFrame:
    t = Tables(spark, d)
    ch = with_ids(fixed_doc_chunks(t))
    return answer_batch(V.questions(t), "question_id", "question", ch, ["doc_id", "position"], "text",
                        threshold=GROUND_THR, rules=PIPE_RULES)


def _pipeline_sql(view: str = "questions", rules=PIPE_RULES, hits=None, generated: str | None = None) -> list[tuple[str, str]]:
    ctes = O.views(view) + [("fx", SQL_FIXED), ("fxi", SQL_FIXED_IDS)]
    ctes += O.classify_ctes("p_", view, "question_id", "question", G.UNSAFE_PATTERNS, rules)
    ctes += [("openq", "SELECT question_id, t FROM p_cls WHERE t <> '' AND verdict = 'in_scope'")]
    ctes += hits or O.knn_ctes("pk_", "openq", "question_id", "t", "fxi", ["doc_id", "position"], "text", K)
    ctes += [("gate", O.grounding_sql("openq", "question_id", "pk_hits", GROUND_THR)),
             ("okq", "SELECT o.question_id, o.t FROM openq o JOIN gate g USING (question_id) WHERE g.can_answer"),
             ("okh", """SELECT h.question_id, h.rank, f.text, f.chunk_id FROM pk_hits h JOIN okq USING (question_id)
JOIN fxi f ON h.doc_id = f.doc_id AND h.position = f.position""")]
    ctes += [("px_raw", f"SELECT question_id, {O.lit(generated)} AS answer FROM okq")] if generated else O.extractive_ctes("px_", "okq", "question_id", "t", "okh")
    ctes += O.citation_ctes("pc_", "px_raw", "question_id", "answer", "okh")
    ctes += O.verify_ctes("pv_", "pc_cit", "question_id", "final_text", "okh")
    def msg(cause: str, text: str = "t") -> str:
        en, hi = STOP_TEXTS[cause]
        return f"CASE WHEN {O.is_hindi(text)} THEN {O.lit(hi)} ELSE {O.lit(en)} END"

    ctes += [("res", f"""SELECT question_id, 'classify_query' AS stopped_at, verdict, NULL::DOUBLE AS top_score, {msg('empty')} AS answer,
  '' AS citations, TRUE AS is_fully_grounded, 0 AS n_flags FROM p_cls WHERE t = ''
UNION ALL SELECT question_id, 'classify_query', verdict, NULL::DOUBLE,
  CASE verdict WHEN 'unsafe' THEN {msg('unsafe')} ELSE {msg('off_topic')} END,
  '', TRUE, 0 FROM p_cls WHERE t <> '' AND verdict <> 'in_scope'
UNION ALL SELECT g.question_id, 'check_grounding', 'in_scope', g.top_score, {msg('not_grounded')}, '', TRUE, 0 FROM gate g JOIN openq USING (question_id) WHERE NOT g.can_answer
UNION ALL SELECT c.question_id, 'verify', 'in_scope', g.top_score, c.final_text, c.citations, coalesce(f.n, 0) = 0, coalesce(f.n, 0)
FROM pc_cit c JOIN gate g USING (question_id) LEFT JOIN (SELECT question_id, count(*) AS n FROM pv_flags GROUP BY question_id) f USING (question_id)""")]
    return ctes


@key("pipeline_batch", O.with_(_pipeline_sql(), """SELECT question_id, stopped_at, verdict, round(top_score, 6) AS top_score,
  md5(answer) AS answer_md5, citations, is_fully_grounded, n_flags::BIGINT AS n_flags FROM res"""))
def q_pipeline_batch(spark, d):
    r = _pipeline(spark, d)
    return r.select("question_id", "stopped_at", "verdict", r6("top_score").alias("top_score"), F.md5("answer").alias("answer_md5"),
                    F.array_join("citations", "|").alias("citations"), "is_fully_grounded", lng("n_flags").alias("n_flags"))


@key("stopped_at_counts", O.with_(_pipeline_sql(), "SELECT stopped_at, count(*)::BIGINT AS n FROM res GROUP BY stopped_at"))
def q_stopped_at_counts(spark, d):
    return _pipeline(spark, d).groupBy("stopped_at").agg(lng(F.count(F.lit(1))).alias("n"))


@key("stop_messages", O.with_(_pipeline_sql(), "SELECT question_id, stopped_at, answer AS message FROM res WHERE stopped_at <> 'verify'"))
def q_stop_messages(spark, d):
    r = _pipeline(spark, d).where(F.col("stopped_at") != "verify")
    return r.select("question_id", "stopped_at", F.col("answer").alias("message"))


_STAGES_SQL = "[" + ", ".join(f"'{s}'" for s in L.STAGES if s != "transcribe") + "]"


@key("stage_status", O.with_(_pipeline_sql(), f"""SELECT question_id, stage, stage_no::BIGINT AS stage_no,
  CASE WHEN stage_no < stop_no THEN 'completed' WHEN stage_no = stop_no AND stopped_at <> 'verify' THEN 'stopped'
       WHEN stage_no = stop_no THEN 'completed' ELSE 'disabled' END AS status
FROM (SELECT question_id, stopped_at, unnest({_STAGES_SQL}) AS stage, unnest(range(5)) AS stage_no,
             list_position({_STAGES_SQL}, stopped_at) - 1 AS stop_no FROM res) z"""))
def q_stage_status(spark, d):
    s = L.stage_status(_pipeline(spark, d), "question_id")
    return s.select("question_id", "stage", lng("stage_no").alias("stage_no"), "status")


@key("result_json", O.with_(_pipeline_sql(), """SELECT question_id, md5(answer) AS answer_md5, citations, is_fully_grounded,
  n_flags::BIGINT AS n_flags, stopped_at, CASE stopped_at WHEN 'classify_query' THEN 'transcribe|classify_query'
  WHEN 'check_grounding' THEN 'transcribe|classify_query|retrieve|check_grounding'
  ELSE 'transcribe|classify_query|retrieve|check_grounding|generate|verify' END AS stages FROM res"""))
def q_result_json(spark, d):
    """The response JSON read back (the times are left out: they differ from run to run)."""
    j = result_json(_pipeline(spark, d), "question_id")
    schema = ("answer string, transcript string, citations array<string>, is_fully_grounded boolean, flagged_claims array<struct<claim_text string, "
              "citation_index long, chunk_id string, reason string>>, stopped_at string, latency_ms struct<total double, stages map<string, double>>")
    r = j.select("question_id", F.from_json("json", schema).alias("r")).select("question_id", "r.*")
    return r.select("question_id", F.md5("answer").alias("answer_md5"), F.array_join("citations", "|").alias("citations"), "is_fully_grounded",
                    lng(F.size("flagged_claims")).alias("n_flags"), "stopped_at", F.array_join(F.map_keys("latency_ms.stages"), "|").alias("stages"))


@key("result_json_times", O.with_(_pipeline_sql(), """SELECT question_id, stopped_at, CASE stopped_at WHEN 'classify_query' THEN 1 WHEN 'check_grounding' THEN 3 ELSE 5 END::BIGINT AS n_timed,
  TRUE AS total_is_sum FROM res"""))
def q_result_json_times(spark, d):
    """The response JSON with the batch's stage times: every stage that a question reached has one, and they add up to the total."""
    t, log = Tables(spark, d), StageLog()
    r = answer_batch(V.questions(t), "question_id", "question", with_ids(fixed_doc_chunks(t)), ["doc_id", "position"], "text", threshold=GROUND_THR, rules=PIPE_RULES, log=log)
    j = result_json(r, "question_id", log.frame(spark)).select("question_id", F.from_json("json", "stopped_at string, latency_ms struct<total double, stages map<string, double>>").alias("r"))
    times = F.filter(F.map_values("r.latency_ms.stages"), lambda x: x.isNotNull())
    return j.select("question_id", "r.stopped_at", lng(F.size(times)).alias("n_timed"),
                    (F.abs(F.aggregate(times, F.lit(0.0), lambda a, x: a + x) - F.col("r.latency_ms.total")) < 0.01).alias("total_is_sum"))


@key("pipeline_stage_log", O.with_(_pipeline_sql(), """SELECT stage, rows_in::BIGINT AS rows_in, rows_out::BIGINT AS rows_out, stopped::BIGINT AS stopped, TRUE AS ok FROM (
  SELECT 'classify_query' AS stage, (SELECT count(*) FROM p_cls) AS rows_in, (SELECT count(*) FROM openq) AS rows_out, (SELECT count(*) FROM p_cls) - (SELECT count(*) FROM openq) AS stopped
  UNION ALL SELECT 'retrieve', (SELECT count(*) FROM pk_hits), (SELECT count(*) FROM pk_hits), 0
  UNION ALL SELECT 'check_grounding', (SELECT count(*) FROM gate), (SELECT count(*) FROM okq), (SELECT count(*) FROM gate WHERE NOT can_answer)
  UNION ALL SELECT 'generate', (SELECT count(*) FROM okq), (SELECT count(*) FROM px_raw WHERE answer <> ''), 0
  UNION ALL SELECT 'verify', (SELECT count(*) FROM okq), (SELECT count(*) FROM okq), 0) z"""))
def q_pipeline_stage_log(spark, d):
    """Rows in, out and stopped of every stage, observed in the jobs of the batch (retrieve: hits)."""
    t, log = Tables(spark, d), StageLog()
    answer_batch(V.questions(t), "question_id", "question", with_ids(fixed_doc_chunks(t)), ["doc_id", "position"], "text", threshold=GROUND_THR, rules=PIPE_RULES, log=log)
    return log.frame(spark).select("stage", "rows_in", "rows_out", "stopped", "ok")


_WRONG_YEAR = "It was so in 1899 [1]. 12 were seen."


@key("pipeline_ungrounded", O.with_(_pipeline_sql(generated=_WRONG_YEAR), """SELECT question_id, stopped_at, md5(answer) AS answer_md5, citations, is_fully_grounded,
  n_flags::BIGINT AS n_flags FROM res"""))
def q_pipeline_ungrounded(spark, d):
    """A generator whose numbers the cited chunks don't hold: answers that end ungrounded, with their flags."""
    t = Tables(spark, d)
    r = answer_batch(V.questions(t), "question_id", "question", with_ids(fixed_doc_chunks(t)), ["doc_id", "position"], "text", threshold=GROUND_THR, rules=PIPE_RULES,
                     generator=lambda prompts: [_WRONG_YEAR for _ in prompts])
    return r.select("question_id", "stopped_at", F.md5("answer").alias("answer_md5"), F.array_join("citations", "|").alias("citations"), "is_fully_grounded",
                    lng("n_flags").alias("n_flags"))


# ------------------------------------------------------------- cases that fire every rule and message
_CASE_COLS = "question_id, case_no, question"


@key("gate_cases", O.with_(O.views("case_questions") + O.classify_ctes("g_", "case_questions", "question_id", "question", G.UNSAFE_PATTERNS),
     f"SELECT question_id, verdict, rule, unsafe_match, md5(verdict_reason) AS reason_md5, {O.is_hindi('t')} AS is_hindi FROM g_cls"))
def q_gate_cases(spark, d):
    c = G.with_classification(V.case_questions(Tables(spark, d)), "question")
    return c.select("question_id", "verdict", "rule", "unsafe_match", F.md5("verdict_reason").alias("reason_md5"), X.is_hindi(X.strip("question")).alias("is_hindi"))


def _one_rule(name: str) -> None:
    sql = O.with_(O.views("case_questions") + O.gibberish_ctes("g_", "case_questions", "question_id", "question", (name,)),
                  "SELECT question_id, rule IS NOT NULL AS fires, reason FROM g_gib")

    @key(f"gib_{name}", sql)
    def run(spark, d):
        g = G.with_gibberish(V.case_questions(Tables(spark, d)), "question", (name,))
        return g.select("question_id", F.col("gib_rule").isNotNull().alias("fires"), F.col("gib_reason").alias("reason"))


for _name in ("dev_signs", "dev_consonants", "dev_vowels"):
    _one_rule(_name)


def _case_pipeline(spark, d, speech: bool) -> DataFrame:
    t = Tables(spark, d)
    args = (with_ids(fixed_doc_chunks(t)), ["doc_id", "position"], "text")
    q = V.case_questions(t)
    if speech:
        return answer_speech(q.withColumn("ok", F.col("case_no") != 11), "question_id", "question", "ok", *args, threshold=GROUND_THR, rules=CASE_RULES)
    return answer_batch(q, "question_id", "question", *args, threshold=GROUND_THR, rules=CASE_RULES)


CASE_RULES = tuple(r for r in G.ALL_RULES if r not in ("consonants", "vowels"))
_CASE_SQL = _pipeline_sql("case_questions", CASE_RULES)


@key("pipeline_cases", O.with_(_CASE_SQL, """SELECT question_id, stopped_at, verdict, round(top_score, 6) AS top_score, md5(answer) AS answer_md5,
  citations, is_fully_grounded, n_flags::BIGINT AS n_flags FROM res"""))
def q_pipeline_cases(spark, d):
    r = _case_pipeline(spark, d, False)
    return r.select("question_id", "stopped_at", "verdict", r6("top_score").alias("top_score"), F.md5("answer").alias("answer_md5"),
                    F.array_join("citations", "|").alias("citations"), "is_fully_grounded", lng("n_flags").alias("n_flags"))


@key("pipeline_speech", O.with_(_CASE_SQL, f"""SELECT q.question_id, CASE WHEN case_no = 11 OR {O.strip('q.question')} = '' THEN 'transcribe' ELSE r.stopped_at END AS stopped_at,
  CASE WHEN case_no = 11 THEN {O.lit(P.MSG_STT_FAILED)} WHEN {O.strip('q.question')} = '' THEN {O.lit(P.MSG_NO_SPEECH)}
    WHEN r.stopped_at <> 'verify' THEN answer END AS message
FROM case_questions q JOIN res r USING (question_id)"""))
def q_pipeline_speech(spark, d):
    r = _case_pipeline(spark, d, True)
    return r.select("question_id", "stopped_at", F.when(F.col("stopped_at") != "verify", F.col("answer")).alias("message"))


@key("normalize_digits_cases", """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || ' / ' || CAST(o_custkey AS VARCHAR) AS normalised FROM orders""")
def q_normalize_digits_cases(spark, d):
    """Numbers written in Devanagari digits come back in Latin ones."""
    o = Tables(spark, d).orders
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit(" / "), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", X.normalize_digits(F.translate(text, X.LATIN_DIGITS, X.DEVANAGARI_DIGITS)).alias("normalised"))


_REFUSAL_VIEW = f"""SELECT conv_id * 100 + turn AS question_id, CASE (conv_id + turn) % 4
  WHEN 0 THEN text || ' [1]' WHEN 1 THEN text || '. ' || {O.lit(GEN.REFUSAL_PHRASES[0])} WHEN 2 THEN 'Sorry: ' || {O.lit(GEN.REFUSAL_PHRASES[-1])} || ' [2] [9].'
  ELSE text || ' [7, 1]' END AS answer FROM conversations WHERE role = 'assistant'"""
_CASE_HITS = """SELECT question_id, rank, 'c' || CAST(question_id AS VARCHAR) || '-' || CAST(rank AS VARCHAR) AS chunk_id
FROM (SELECT question_id, unnest([1, 2]) AS rank FROM cited) z"""


@key("refusals", O.with_([("cited", _REFUSAL_VIEW), ("case_hits", _CASE_HITS)] + O.citation_ctes("rf_", "cited", "question_id", "answer", "case_hits"),
     "SELECT question_id, refusal, md5(final_text) AS text_md5, citations, n_cited FROM rf_cit"))
def q_refusals(spark, d):
    """Refusals in both languages, citations beyond the hits and grouped tags."""
    a = V.case_answers(Tables(spark, d), GEN.REFUSAL_PHRASES[0], GEN.REFUSAL_PHRASES[-1])
    hits = a.select("question_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")).withColumn(
        "chunk_id", F.concat(F.lit("c"), F.col("question_id").cast("string"), F.lit("-"), F.col("rank").cast("string")))
    c = GEN.answer_citations(a, "question_id", "answer", hits)
    return c.select("question_id", "refusal", F.md5("final_text").alias("text_md5"), F.array_join("citations", "|").alias("citations"),
                    lng(F.size("citations")).alias("n_cited"))


@key("src_lang_known", f"""WITH m(lang, code) AS (VALUES {_LANG_VALUES}), x AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'hi' WHEN 'fr' THEN 'bn' WHEN 'de' THEN 'te' ELSE lang END AS lang FROM documents)
SELECT x.doc_id, x.lang, m.code, CASE WHEN m.code IS NOT NULL THEN '{LANG_ROOT}/validation/' || m.code || 'val.parquet' END AS file_path,
  CASE WHEN m.code IS NOT NULL THEN 'ok' ELSE 'unknown language' END AS status FROM x LEFT JOIN m ON x.lang = m.lang""")
def q_src_lang_known(spark, d):
    x = Tables(spark, d).documents.select("doc_id", F.when(F.col("lang") == "en", "hi").when(F.col("lang") == "fr", "bn").when(F.col("lang") == "de", "te").otherwise(F.col("lang")).alias("lang"))
    return S.resolve_languages(x, "lang", LANG_ROOT, split="validation").select("doc_id", "lang", "code", "file_path", "status")


_STATUS = "CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 11 = 0 THEN 422 WHEN event_id % 13 = 0 THEN 503 ELSE 200 END"
_BODY = """CASE event_id % 5 WHEN 0 THEN '{"error": {"message": "m' || event_id || '"}, "detail": "d"}' WHEN 1 THEN '{"error": {"message": ""}, "detail": "d' || event_id || '"}'
  WHEN 2 THEN '{"message": "only ' || event_id || '"}' WHEN 3 THEN '{"detail": ""}' ELSE 'plain ' || event_id END"""


@key("completed_calls", f"SELECT event_type AS stage, count(*)::BIGINT AS n, round(sum(value), 4) AS ms FROM (SELECT *, {_STATUS} AS status FROM events) z WHERE status = 200 GROUP BY event_type")
def q_completed_calls(spark, d):
    e = V.call_log(Tables(spark, d), _STATUS, _BODY)
    return L.completed_calls(e).groupBy(F.col("event_type").alias("stage")).agg(lng(F.count(F.lit(1))).alias("n"), F.round(F.sum("value"), 4).alias("ms"))


@key("stt_errors", f"""SELECT event_id, status >= 400 AND status NOT IN (400, 401, 403, 422) AS retryable,
  CASE event_id % 5 WHEN 0 THEN 'm' || event_id WHEN 1 THEN 'd' || event_id WHEN 2 THEN CASE WHEN status = 422 THEN 'only ' || event_id ELSE body END ELSE body END AS message
FROM (SELECT event_id, ({_STATUS})::INT AS status, {_BODY} AS body FROM events) z WHERE status >= 400""")
def q_stt_errors(spark, d):
    e = V.call_log(Tables(spark, d), _STATUS, _BODY).where("status >= 400")
    return e.select("event_id", S.classify_stt_error("status", "body").alias("x")).select("event_id", "x.retryable", "x.message")


# ----------------------------------------------------------------------- the written index, dense search
_ROWS_SQL = O.views("qa_rows") + [("two", f"""SELECT query_id, position, is_selected, {O.strip('passage')} AS text, {O.strip('query')} AS query_text, lang,
  CASE WHEN query_id % 7 = 0 THEN NULL ELSE CAST(query_id AS VARCHAR) END AS qid FROM (
    SELECT *, 'hi' AS lang FROM qa_rows UNION ALL SELECT * REPLACE (passage || ' again' AS passage), 'en' FROM qa_rows) z""")]


def _two_languages(t: Tables) -> DataFrame:
    """Nested rows in two languages under the same query ids; every seventh query has none."""
    n = V.qa_nested(t).withColumn("query_type", F.lit("description")).withColumn("answer", F.concat(F.lit("answer to "), F.col("query_id").cast("string")))
    n = n.withColumn("query_id", F.when(F.col("query_id") % 7 != 0, F.col("query_id")))
    other = n.withColumn("passages", F.transform("passages", lambda p: F.concat(p, F.lit(" again"))))
    return n.withColumn("language", F.lit("hi")).unionByName(other.withColumn("language", F.lit("en")))


@key("index_rows", O.with_(_ROWS_SQL, """SELECT coalesce(qid, 'unknown') AS query_id, coalesce(qid, 'unknown') || '_' || CAST(position AS VARCHAR) AS passage_id,
  position::BIGINT AS position, md5(text) AS text_md5, md5(query_text) AS query_md5, 'description' AS query_type, 'answer to ' || CAST(query_id AS VARCHAR) AS answer_text,
  is_selected::BIGINT AS is_selected, lang AS language FROM two WHERE text <> ''"""))
def q_index_rows(spark, d):
    s = C.chunk_structured(_two_languages(Tables(spark, d)))
    return s.select("query_id", "passage_id", lng("position").alias("position"), F.md5("text").alias("text_md5"), F.md5(X.strip("query_text")).alias("query_md5"),
                    "query_type", "answer_text", lng("is_selected").alias("is_selected"), "language")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_base(spark)}/{name}-{uuid.uuid4().hex}"


@key("index_write_upsert", O.with_(_ROWS_SQL, """SELECT language, is_changed, count(*)::BIGINT AS n, count(DISTINCT md5(text))::BIGINT AS n_texts FROM (
  SELECT lang AS language, query_id % 5 = 0 AS is_changed, CASE WHEN query_id % 5 = 0 THEN text || ' changed' ELSE text END AS text
  FROM two WHERE text <> '') z GROUP BY language, is_changed"""))
def q_index_write_upsert(spark, d):
    """Structured chunks written, written again with every fifth query's passages changed, and read back."""
    rows = _two_languages(Tables(spark, d)).withColumn("_n", F.regexp_extract("answer", "([0-9]+)$", 1).cast("long"))
    changed = rows.withColumn("passages", F.when(F.col("_n") % 5 == 0, F.transform("passages", lambda p: F.concat(X.strip(p), F.lit(" changed")))).otherwise(F.col("passages")))
    # rows without a query id are told apart by their content, so their key stays that of the first version
    path = scratch_path(spark, "index")
    for version in (rows, changed, changed):
        keyed = version.withColumn("query_id", F.coalesce(F.col("query_id").cast("string"), F.concat(F.lit("n"), F.col("_n").cast("string"))))
        IDX.upsert(spark, C.chunk_structured(keyed.drop("_n")), path)
    s = IDX.read_index(spark, path, "structured")
    s = s.withColumn("is_changed", F.regexp_extract("answer_text", "([0-9]+)$", 1).cast("long") % 5 == 0)
    return s.groupBy("language", "is_changed").agg(lng(F.count(F.lit(1))).alias("n"), lng(F.count_distinct(F.md5("text"))).alias("n_texts"))


_PLACES = "list_transform({x}, lambda w_: 'b' || CAST(CAST('0x' || substr(md5(w_), 1, 4) AS INT) % 64 AS VARCHAR))"


def _hashed(name: str, src: str, cols: str, text: str, prefix: str) -> tuple[str, str]:
    """``src`` with the hash places of its prefixed text as a text of their own, so that the lexical SQL searches them."""
    terms = O.terms("pt")
    return name, f"SELECT {cols}, array_to_string({_PLACES.format(x=terms)}, ' ') AS places FROM (SELECT *, '{prefix}' || {text} AS pt FROM {src}) z"


_DENSE_SQL = [("fx", SQL_FIXED), ("fxi", SQL_FIXED_IDS), _hashed("hc", "fxi", "chunk_id", "text", IDX.PASSAGE_PREFIX)]


def _dense_index(spark, d, t: Tables) -> DataFrame:
    """Fixed and semantic chunks embedded and written as a partitioned index; the fixed collection read back."""
    path = scratch_path(spark, "index")
    chunks = fixed_doc_chunks(t).drop("n_words").unionByName(semantic_doc_chunks(t).drop("n_sentences"))
    IDX.upsert(spark, with_ids(chunks), path, embed=hashed_terms())
    return IDX.read_index(spark, path, "fixed")


@key("retrieve_dense", O.with_(_DENSE_SQL + [_hashed("hq", f"(SELECT item_id, {O.strip('text')} AS q FROM benchmark WHERE {O.strip('text')} <> '') y", "item_id", "q", IDX.QUERY_PREFIX)]
     + O.knn_ctes("dn_", "hq", "item_id", "places", "hc", ["chunk_id"], "places", K),
     "SELECT h.item_id, h.rank, h.chunk_id, CAST(f.doc_id AS VARCHAR) AS doc_id, md5(f.text) AS text_md5, round(h.score, 6) AS score FROM dn_hits h JOIN fxi f USING (chunk_id)"))
def q_retrieve_dense(spark, d):
    t = Tables(spark, d)
    h = retrieve_dense(t.benchmark, "item_id", "text", _dense_index(spark, d, t), hashed_terms(), K)
    return h.select("item_id", lng("rank").alias("rank"), "chunk_id", "doc_id", F.md5("text").alias("text_md5"), r6("score").alias("score"))


_DENSE_HITS = [_hashed("hc", "fxi", "doc_id, position, chunk_id", "text", IDX.PASSAGE_PREFIX), _hashed("hq", "openq", "question_id", "t", IDX.QUERY_PREFIX)] + \
    O.knn_ctes("pd_", "hq", "question_id", "places", "hc", ["chunk_id"], "places", K) + \
    [("pk_hits", "SELECT h.question_id, h.rank, h.score, c.doc_id, c.position FROM pd_hits h JOIN hc c USING (chunk_id)")]
DENSE_THR = 0.8


@key("pipeline_dense", O.with_(_pipeline_sql(hits=_DENSE_HITS), """SELECT question_id, stopped_at, round(top_score, 6) AS top_score, md5(answer) AS answer_md5,
  citations, is_fully_grounded FROM res""").replace(f">= {GROUND_THR}", f">= {DENSE_THR}").replace(f"< {GROUND_THR}", f"< {DENSE_THR}"))
def q_pipeline_dense(spark, d):
    t = Tables(spark, d)
    index = _dense_index(spark, d, t)
    r = answer_batch(V.questions(t), "question_id", "question", None, [], "text", threshold=DENSE_THR, rules=PIPE_RULES,
                     retriever=lambda q: retrieve_dense(q, "question_id", "question", index, hashed_terms(), K))
    return r.select("question_id", "stopped_at", r6("top_score").alias("top_score"), F.md5("answer").alias("answer_md5"),
                    F.array_join("citations", "|").alias("citations"), "is_fully_grounded")


EMBED_BUDGET = 16_384


@key("embed_packed", "SELECT doc_id, TRUE AS same_vector FROM documents")
def q_embed_packed(spark, d):
    """Vectors of calls packed by length against those of plain calls."""
    docs = Tables(spark, d).documents.select("doc_id", "text")
    plain, by_length = embedder_udf(letter_profile_model()), embedder_udf(letter_profile_model(), token_budget=EMBED_BUDGET)
    return docs.select("doc_id", (plain(F.col("text")) == by_length(F.col("text"))).alias("same_vector"))


@key("embed_padding", f"SELECT count(*)::BIGINT AS n_texts, sum(len({O.tokens('text')}) + 2)::BIGINT AS tokens, TRUE AS fewer_padded FROM documents")
def q_embed_padding(spark, d):
    """Padded tokens of packed calls against calls of as many rows in table order (the counts depend on the Arrow batches)."""
    p = padding(Tables(spark, d).documents, "text", EMBED_BUDGET)
    return p.select("n_texts", "tokens", (F.col("padded") < F.col("padded_in_order")).alias("fewer_padded"))


# ------------------------------------------------------------------------- files written and read back
@key("sink_summary_json", f"""SELECT n_requests AS queries_attempted, n_warm AS warm_benchmark_sample_size, round_even(cold_total_ms, 2) AS cold_total,
  round_even(retrieval_p50, 2) AS retrieval_p50, completed_n AS completed_n, round_even(all_p100, 2) AS all_p100, n_short_circuit AS n_stopped
FROM ({ORACLE['benchmark_summary']}) z""")
def q_sink_summary_json(spark, d):
    """The nested summary record written as JSON and read back."""
    path = scratch_path(spark, "summary")
    stopped = L.warm_only(_requests(spark, d)).where(~F.col("completed")).groupBy("stopped_at").agg(F.count(F.lit(1)).alias("n"))
    L.write_summary_json(L.summary_record(q_benchmark_summary(spark, d), stopped), path)
    r = spark.read.schema("""queries_attempted long, warm_benchmark_sample_size long, cold_start_query struct<cold_start_first_request_total_ms double>,
      retrieval_only_latency_ms struct<P50 double>, full_pipeline_completed_only_latency_ms struct<sample_size long>,
      full_pipeline_incl_short_circuits_latency_ms struct<P100 double, short_circuit_breakdown map<string, long>>""").json(path)
    return r.select("queries_attempted", "warm_benchmark_sample_size", F.col("cold_start_query.cold_start_first_request_total_ms").alias("cold_total"),
                    F.col("retrieval_only_latency_ms.P50").alias("retrieval_p50"), F.col("full_pipeline_completed_only_latency_ms.sample_size").alias("completed_n"),
                    F.col("full_pipeline_incl_short_circuits_latency_ms.P100").alias("all_p100"),
                    lng(F.aggregate(F.map_values("full_pipeline_incl_short_circuits_latency_ms.short_circuit_breakdown"), F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_stopped"))


@key("src_eval_csv", "SELECT regexp_replace(text, '\\s+', ' ', 'g') AS query, CAST(item_id AS VARCHAR) AS expected_doc_id FROM benchmark")
def q_src_eval_csv(spark, d):
    """Evaluation pairs written as CSV with a header and read by the pair reader."""
    path = scratch_path(spark, "eval-pairs")
    b = Tables(spark, d).benchmark
    (b.select(F.regexp_replace("text", r"\s+", " ").alias("query"), F.col("item_id").cast("string").alias("expected_doc_id"))
     .write.option("header", True).csv(path))
    return S.read_eval_pairs(spark, path)


@key("sink_latency_csv", O.with_(_REQ, "SELECT CAST(request_group AS VARCHAR) AS query, round_even(total_ms, 2) AS latency_ms FROM req"))
def q_sink_latency_csv(spark, d):
    """The per-request report as written, read back."""
    path = scratch_path(spark, "latency")
    L.write_request_latencies(_requests(spark, d), path)
    return spark.read.option("header", True).schema("query string, latency_ms double").csv(path)
