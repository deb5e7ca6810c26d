"""Numeric-claim verification of answers against their hits, as joins.

Answer -> sentences (split on runs of ``। . ? !`` and newlines) -> per sentence: citation tags ``[n]``
and numeric claims (Devanagari digits normalised, tags removed, whole-word numbers with optional
decimal part and ``%``). A claim in a sentence with tags must be a substring of *every* cited hit
(left equi-join on (question, rank); no hit -> out-of-range flag). A claim in a sentence without tags
must be a substring of *any* hit of the question (anti join on question + ``contains``). Partners per
question are its k hits, never all pairs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import WORD_BOUNDARY, WORD_CHAR, col_, normalize_digits, verify_sentences

# Claim and tag patterns, and the flag reasons.
# A number begins at a word boundary where no word character is before its first digit; the digit is looked for first.
CLAIM_PATTERN = r"(?=[0-9])(?<!" + WORD_CHAR + r")[0-9]+(?:\.[0-9]+)?%?" + WORD_BOUNDARY
TAG_PATTERN = r"(?U)\[(\d+)\]"
GROUP_PATTERN = r"(?U)\[(\d[\d,\s]*)\]"
REASON_NO_CHUNK = "citation index [%s] has no matching retrieved chunk"
REASON_NOT_IN_CITED = "numeric claim '%s' not found in cited chunk [%s] (%s)"
REASON_NOT_IN_ANY = "uncited numeric claim '%s' not found in any retrieved chunk"


def sentence_tags(sentence, grouped: bool = False) -> Column:
    """Citation numbers of ``[n]`` tags; with ``grouped`` also of ``[1, 2]``."""
    if not grouped:
        tags = F.regexp_extract_all(col_(sentence), F.lit(TAG_PATTERN), 1)
    else:
        tags = F.flatten(F.transform(F.regexp_extract_all(col_(sentence), F.lit(GROUP_PATTERN), 1), lambda g: F.split(g, r"(?U)[,\s]+")))
        tags = F.filter(tags, lambda x: x != "")
    return F.array_distinct(F.transform(tags, lambda x: normalize_digits(x).try_cast("long")))


def numeric_claims(sentence, decimals: bool = False, grouped: bool = False) -> Column:
    """Whole-word numbers outside the tags. Sentences are split at every point, so a decimal number is two claims;
    ``decimals`` keeps it whole (``verify_sentences`` then doesn't split between digits)."""
    s = normalize_digits(col_(sentence))
    s = F.regexp_replace(s, GROUP_PATTERN if grouped else TAG_PATTERN.replace("(\\d+)", "\\d+"), "")
    return F.array_distinct(F.regexp_extract_all(s, F.lit(CLAIM_PATTERN), 0))


#: stands for a decimal point while a text is split into sentences (a private-use character)
POINT = "\uE000"


def claim_rows(answers: DataFrame, q_key: str, text_col: str, decimals: bool = False, grouped_tags: bool = False) -> DataFrame:
    """(q_key, sent_no, sentence, tags, claims) for sentences with at least one claim."""
    text = F.col(text_col)
    if decimals:
        text = F.regexp_replace(text, "(?<=[0-9\u0966-\u096F])\\.(?=[0-9\u0966-\u096F])", POINT)
    s = answers.select(q_key, F.posexplode(verify_sentences(text)).alias("sent_no", "sentence"))
    if decimals:
        s = s.withColumn("sentence", F.replace(F.col("sentence"), F.lit(POINT), F.lit(".")))
    # claims and tags need a digit: a cheap test first, the boundary regexes only where it passes
    s = s.where(F.col("sentence").rlike("[0-9\u0966-\u096F]"))
    # as rows of a generator they are evaluated once, however often they are read later on
    found = F.struct(sentence_tags("sentence", grouped_tags).alias("tags"), numeric_claims("sentence", decimals, grouped_tags).alias("claims"))
    return s.select(q_key, "sent_no", "sentence", F.inline(F.array(found))).where(F.size("claims") > 0)


def flagged_claims(answers: DataFrame, q_key: str, text_col: str, hits: DataFrame, rank_col: str = "rank",
                   hit_text: str = "text", chunk_id_col: str = "chunk_id", **claim_options) -> DataFrame:
    """(q_key, sent_no, claim, citation_index, chunk_id, reason) - one row per flag.

    Answers are dealt by question, so the regexes run in as many tasks as the shuffle has, however small the answers' file is. A
    question's k hits are gathered beside its claims by one join on the question; the comparisons are array expressions inside
    the row, and one generator gives the flags of cited and uncited claims."""
    c = claim_rows(answers.select(q_key, text_col).repartition(q_key), q_key, text_col, **claim_options)
    h = hits.select(q_key, F.struct(F.col(rank_col).cast("long").alias("i"), F.col(chunk_id_col).alias("c"), normalize_digits(hit_text).alias("t")).alias("_h"))
    h = h.groupBy(q_key).agg(F.collect_list("_h").alias("_hits"))  # k entries
    j = c.join(h, q_key, "left").withColumn("_hits", F.coalesce("_hits", F.array().cast(h.schema["_hits"].dataType)))

    def flag(claim, index, chunk, reason) -> Column:
        return F.struct(claim.alias("claim"), index.cast("long").alias("citation_index"), chunk.cast("string").alias("chunk_id"), reason.alias("reason"))

    def against_cited(claim, tag) -> Column:
        idx_s, of = tag.cast("string"), F.filter("_hits", lambda x: x["i"] == tag)
        wrong = F.filter(of, lambda x: x["t"].isNull() | ~F.contains(x["t"], claim))
        no_chunk = F.format_string(REASON_NO_CHUNK, idx_s)
        return F.when(F.size(of) == 0, F.array(flag(claim, tag, F.lit(None), no_chunk))).otherwise(F.transform(wrong, lambda x: flag(
            claim, tag, x["c"], F.when(x["t"].isNull(), no_chunk).otherwise(F.format_string(REASON_NOT_IN_CITED, claim, idx_s, x["c"])))))

    cited = F.flatten(F.transform("claims", lambda claim: F.flatten(F.transform("tags", lambda tag: against_cited(claim, tag)))))
    missed = F.filter("claims", lambda claim: ~F.exists("_hits", lambda x: F.coalesce(F.contains(x["t"], claim), F.lit(False))))
    uncited = F.transform(missed, lambda claim: flag(claim, F.lit(None), F.lit(None), F.format_string(REASON_NOT_IN_ANY, claim)))
    return j.select(q_key, "sent_no", F.inline(F.when(F.size("tags") > 0, cited).otherwise(uncited)))


def verify_answers(answers: DataFrame, q_key: str, text_col: str, hits: DataFrame, **kw) -> DataFrame:
    """(q_key, n_flags, is_fully_grounded, flagged_claims): no flag (or empty answer) -> grounded."""
    f = flagged_claims(answers, q_key, text_col, hits, **kw)
    agg = f.groupBy(q_key).agg(
        F.count(F.lit(1)).alias("n_flags"),
        F.array_sort(F.collect_list(F.struct("sent_no", "claim", "citation_index", "chunk_id", "reason"))).alias("flagged_claims"))
    out = answers.select(q_key).join(agg, q_key, "left")
    return out.select(q_key, F.coalesce("n_flags", F.lit(0)).cast("long").alias("n_flags"),
                      F.coalesce(F.col("n_flags") == 0, F.lit(True)).alias("is_fully_grounded"),
                      F.coalesce("flagged_claims", F.array().cast(agg.schema["flagged_claims"].dataType)).alias("flagged_claims"))
