"""Answer generation as a batch step.

The prompt is assembled per question from its top-k hits (a group of at most k rows). The generator
is injected: any ``pandas.Series(prompt) -> pandas.Series(text)`` function runs in ``mapInPandas``
over the prompt table (one call per Arrow batch; the function owns its rate limits and retries).
The built-in default is **extractive** and needs no service: for each of the top hits, the sentence
sharing most question terms, tagged with the hit's rank. Citation parsing, refusal detection, cleanup
and finalisation are Column expressions.
"""
from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import chunk_sentences, clean_answer, col_, normalize_digits, strip, terms

# Refusal phrases (lower-cased answer contains any -> refusal).
REFUSAL_PHRASES = [
    "उत्तर उपलब्ध नहीं है",
    "जानकारी नहीं है",
    "संदर्भ में उत्तर नहीं है",
    "उल्लेख नहीं है",
    "नहीं दिया गया",
    "स्पष्ट नहीं है",
    "नहीं है",
    "no answer available",
    "not provided in the context",
    "not mentioned",
    "cannot be answered",
]

DEFAULT_TEMPLATE = (
    "Answer the question using only the numbered context passages below. End each claim with the "
    "number of the passage that supports it, e.g. [1]. If the context does not contain the answer, "
    "say that the answer is not available.\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:"
)


def prompt_build(questions: DataFrame, q_key: str, q_text: str, hits: DataFrame, template: str = DEFAULT_TEMPLATE,
                 rank_col: str = "rank", text_col: str = "text") -> DataFrame:
    """(q_key, prompt, n_context): context blocks ``[rank] text`` joined by a blank line, in rank order."""
    ctx = hits.groupBy(q_key).agg(F.array_sort(F.collect_list(F.struct(rank_col, text_col))).alias("_h"))  # <= k rows
    block = F.array_join(F.transform("_h", lambda h: F.concat(F.lit("["), h[rank_col].cast("string"), F.lit("] "), h[text_col])), "\n\n")
    before, rest = template.split("{context}", 1)
    middle, after = rest.split("{question}", 1)
    j = questions.select(q_key, strip(q_text).alias("_q")).join(ctx, q_key)
    return j.select(q_key, F.concat(F.lit(before), block, F.lit(middle), F.col("_q"), F.lit(after)).alias("prompt"),
                    F.size("_h").alias("n_context"))


def cited_ranks(text, n_hits) -> Column:
    """Tags ``[1]``, ``[1, 2]`` -> distinct ranks in first-seen order, only those in 1..n_hits."""
    groups = F.regexp_extract_all(col_(text), F.lit(r"(?U)\[([\d,\s]+)\]"), 1)
    parts = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda p: normalize_digits(strip(p)))
    nums = F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]+$")), lambda p: p.try_cast("int"))
    n = col_(n_hits)
    return F.array_distinct(F.filter(nums, lambda x: x.isNotNull() & (x >= 1) & (x <= n)))


def refusal_flag(text, phrases=REFUSAL_PHRASES) -> Column:
    low = F.lower(col_(text))
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def finalize(text, ranks, refusal) -> Column:
    """struct(text, ranks): refusal or no valid citation -> cleaned text and no citations."""
    t, r = col_(text), col_(ranks)
    plain = col_(refusal) | (F.size(r) == 0)
    return F.struct(F.when(plain, clean_answer(t)).otherwise(t).alias("text"),
                    F.when(plain, F.array().cast("array<int>")).otherwise(r).alias("ranks"))


def answer_citations(answers: DataFrame, q_key: str, text_col: str, hits: DataFrame, phrases=REFUSAL_PHRASES,
                     chunk_id_col: str = "chunk_id", rank_col: str = "rank") -> DataFrame:
    """(q_key, raw, refusal, final_text, citations): ranks mapped to chunk ids through the hit table."""
    n = hits.groupBy(q_key).agg(F.count(F.lit(1)).alias("_n"))
    a = answers.select(q_key, F.col(text_col).alias("raw")).join(n, q_key, "left").fillna(0, ["_n"])
    a = a.withColumn("_ranks", cited_ranks("raw", "_n")).withColumn("refusal", refusal_flag("raw", phrases))
    a = a.withColumn("_fin", finalize("raw", "_ranks", "refusal"))
    e = a.select(q_key, F.posexplode("_fin.ranks").alias("_i", rank_col))
    ids = e.join(hits.select(q_key, rank_col, chunk_id_col), [q_key, rank_col]).groupBy(q_key).agg(
        F.array_sort(F.collect_list(F.struct("_i", chunk_id_col))).alias("_c"))  # at most k entries
    out = a.join(ids, q_key, "left")
    return out.select(q_key, "raw", "refusal", F.col("_fin.text").alias("final_text"),
                      F.coalesce(F.transform("_c", lambda x: x[chunk_id_col]), F.array().cast("array<string>")).alias("citations"))


def extractive_answers(questions: DataFrame, q_key: str, q_text: str, hits: DataFrame, max_hits: int | None = None,
                       rank_col: str = "rank", text_col: str = "text") -> DataFrame:
    """(q_key, answer): for each hit (or the top ``max_hits``), its sentence with most distinct question
    terms (ties: earliest), ``[rank]`` placed before the sentence's final ender; sentences joined by a
    space in rank order. Hits with no overlapping sentence add nothing; no sentence -> empty answer."""
    qt = questions.select(q_key, terms(q_text).alias("_w")).groupBy(q_key).agg(F.array_distinct(F.flatten(F.collect_list("_w"))).alias("_qt"))
    top = hits if max_hits is None else hits.where(F.col(rank_col) <= max_hits)
    # sentences are compared inside the row of a hit; a rank has several texts only where chunk keys repeat, and then counts their sentences together
    j = top.select(q_key, rank_col, text_col).join(qt, q_key).groupBy(q_key, rank_col).agg(F.collect_list(text_col).alias("_texts"), F.first("_qt").alias("_qt"))
    # what is used more than once is a lambda's parameter: a column that a filter or a later expression reads again would be evaluated again for each
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    shared = lambda s: F.coalesce(F.size(F.array_intersect(terms(s), F.col("_qt"))), F.lit(0))
    counts = lambda ss, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(
        F.transform(ss, lambda s: F.when(i < F.size(s), shared(F.get(s, i))).otherwise(0)), F.lit(0), lambda a, x: a + x))
    tag = F.concat(F.lit(" ["), F.col(rank_col).cast("string"), F.lit("]"))
    tagged = lambda s: F.when(s.rlike("[.!?।॥]$"), F.concat(F.substring(s, F.lit(1), F.length(s) - 1), tag, F.substring(s, F.length(s), F.lit(1)))
                              ).otherwise(F.concat(s, tag))
    at = lambda ss, i: F.transform(F.filter(F.transform(ss, lambda s: F.get(s, i)), lambda s: s.isNotNull()), lambda s: F.struct(F.col(rank_col).alias("r"), tagged(s).alias("_t")))
    picked = lambda ss, o: let(F.array_max(o), lambda most: F.when(most > 0, at(ss, (F.array_position(o, most) - 1).cast("int"))))
    best = let(F.transform("_texts", lambda t: chunk_sentences(t)), lambda ss: let(F.array_max(F.transform(ss, lambda s: F.size(s))), lambda n: F.when(
        n > 0, let(counts(ss, n), lambda o: picked(ss, o)))))
    parts = j.select(q_key, best.alias("_p")).groupBy(q_key).agg(F.array_sort(F.flatten(F.collect_list("_p"))).alias("_p"))  # at most k
    ans = parts.select(q_key, F.array_join(F.transform("_p", lambda x: x["_t"]), " ").alias("answer"))
    return questions.select(q_key).join(ans, q_key, "left").select(q_key, F.coalesce("answer", F.lit("")).alias("answer"))


def generate_with(prompts: DataFrame, q_key: str, fn, prompt_col: str = "prompt") -> DataFrame:
    """Run an injected generator ``fn(pandas.Series[str]) -> pandas.Series[str]`` over the prompt table: (q_key, answer). A call that
    fails is made again for each of its prompts alone; a prompt whose own call fails has an empty answer, as if the generator had
    given none, and the others keep theirs. A null answer is empty as well."""
    def one(prompt: str) -> str:
        try:
            return list(fn(pd.Series([prompt])))[0] or ""
        except Exception:  # noqa: BLE001 - whatever the injected function raises is this row's result, not the job's
            return ""

    def run(batches):
        for b in batches:
            texts = b.column(prompt_col).to_pylist()
            try:
                answers = [a or "" for a in fn(pd.Series(texts))] if texts else []
            except Exception:  # noqa: BLE001 - as above
                answers = [one(t) for t in texts]
            if len(answers) != len(texts):
                raise ValueError(f"the generator gave {len(answers)} answers to {len(texts)} prompts")
            yield pa.RecordBatch.from_arrays([b.column(q_key), pa.array(answers, pa.string())], [q_key, "answer"])

    schema = prompts.select(q_key).schema.add("answer", "string")
    return prompts.select(q_key, prompt_col).mapInArrow(run, schema)
