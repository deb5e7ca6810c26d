"""Question gates: safety match, gibberish cascade, classification, grounding gate.

All rules are Column expressions (JVM-side regexes and array functions), so a question table of any
size is gated in one narrow pass; the grounding gate is a left join to the rank-1 hits.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import WORD_BOUNDARY, WORD_BOUNDARY_UNICODE, col_, strip

# Unsafe keyword patterns (English, then Hindi); each is matched as a whole word.
UNSAFE_PATTERNS = [
    r"bomb", r"weapon(s)?", r"kill", r"suicide", r"self-harm", r"explosive(s)?",
    r"हत्या", r"बम", r"हथियार", r"आत्महत्या",
]

# Gibberish rules, in cascade order (first match wins).
SYMBOL_SPAM = r"(?U)^[^\p{L}\p{N}_\s]+$"
REPEATED_CHAR = r"(?d)(.)\1{4,}"
DEVANAGARI_SIGN_SPAM = r"[\u094D\u0900-\u0903\u093A-\u094C]{3,}"
DEVANAGARI_BARE_CONSONANTS = r"[\u0915-\u0939\u0958-\u095F]{6,}"
ENGLISH_CONSONANT_RUN = "[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{%d,}"
DOMINANCE_MIN_CHARS, DOMINANCE_MAX_SHARE = 6, 0.45
VOWEL_MIN_LETTERS, VOWEL_MIN_SHARE = 6, 0.22
DEV_MIN_CHARS, DEV_MIN_SIGN_SHARE = 6, 0.10
DEV_VOWEL_OR_SIGN = r"[\u0904-\u0914\u0900-\u0903\u093A-\u094F]"

ALL_RULES = ("symbol", "repeat", "dev_signs", "dev_consonants", "consonants", "dominance", "vowels", "dev_vowels")

# Verdicts and reason texts (%s = matched text or formatted ratio / score).
IN_SCOPE, OFF_TOPIC, UNSAFE = "in_scope", "off_topic", "unsafe"
REASON_EMPTY = "empty transcript input"
REASON_PASSED = "passed safety and input quality checks"
REASON_UNSAFE = "matched safety keyword '%s'"
REASON_GIBBERISH = "detected gibberish/nonsense input (%s)"
RULE_TEXT = {
    "symbol": "pure symbol/punctuation spam",
    "repeat": "repeated character sequence '%s'",
    "dev_signs": "Devanagari halant/matra spam '%s'",
    "dev_consonants": "Devanagari bare consonant sequence '%s'",
    "consonants": "keyboard mash consonant sequence '%s'",
    "dominance": "high character dominance ratio (%s)",
    "vowels": "low English vowel ratio (%s) in text",
    "dev_vowels": "low Devanagari matra/vowel ratio (%s) in Hindi text",
}
REASON_NO_CHUNKS = "no chunks retrieved"
REASON_BELOW = "top retrieval score %s below grounding threshold %s"
REASON_ABOVE = "sufficient corpus grounding (top_score %s >= threshold %s)"


def _ratio_2dp(m: Column, n: Column) -> Column:
    """``f"{m/n:.2f}"`` exactly as Python prints it, for 0 <= m <= n.

    Off exact ties, Java's ``%.2f`` and Python agree. At exact ties (m/n = (2j+1)/200) Python rounds the
    nearest double, whose side of the tie is fixed per j; the strings are precomputed below.
    """
    tie_strs = F.array(*[F.lit(f"{(2 * j + 1) / 200:.2f}") for j in range(100)])
    n = F.nullif(n, F.lit(0))
    t200 = m.cast("long") * 200
    q = (t200 / n).cast("long")
    is_tie = ((t200 % n) == 0) & ((q % 2) == 1)
    return F.when(is_tie, F.get(tie_strs, ((q - 1) / 2).cast("int"))).otherwise(
        F.format_string("%.2f", m.cast("double") / n.cast("double")))


def unsafe_pattern(words=UNSAFE_PATTERNS, boundary: str = "python") -> str:
    b = WORD_BOUNDARY if boundary == "python" else WORD_BOUNDARY_UNICODE
    return "(?iu)" + b + "(?:" + "|".join(words) + ")" + b


def unsafe_match(text, words=UNSAFE_PATTERNS, boundary: str = "python") -> Column:
    """The matched unsafe text (first match, original case) or null."""
    m = F.regexp_extract(col_(text), unsafe_pattern(words, boundary), 0)
    return F.nullif(m, F.lit(""))


def _match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def no_space(text) -> Column:
    return F.regexp_replace(col_(text), r"(?U)\s", "")


def char_dominance(text, nospace=None) -> Column:
    """struct(n, top): count of non-space characters and the count of the most frequent one.
    Each distinct character is counted with a native ``replace`` (length drop), so the per-row work is
    distinct chars x one string pass, with no per-character lambda. Pass ``nospace`` as a column
    reference so the whitespace removal is not repeated inside the lambda."""
    t = col_(nospace) if nospace is not None else no_space(text)
    n = F.length(t)
    counts = F.transform(F.array_distinct(F.split(t, "")), lambda c: n - F.length(F.replace(t, c, F.lit(""))))
    return F.struct(n.alias("n"), F.when(n > 0, F.array_max(counts)).otherwise(F.lit(0)).alias("top"))


def _measures(t: Column, consonant_run: int) -> list[Column]:
    """Stage 1: every regex / count the rules need, evaluated once per row."""
    dom = char_dominance(t, F.col("_nsp"))
    return [
        t.rlike(SYMBOL_SPAM).alias("_m_sym"),
        _match(t, REPEATED_CHAR).alias("_m_rep"),
        _match(t, DEVANAGARI_SIGN_SPAM).alias("_m_sig"),
        _match(t, DEVANAGARI_BARE_CONSONANTS).alias("_m_dco"),
        _match(t, ENGLISH_CONSONANT_RUN % consonant_run).alias("_m_con"),
        dom["n"].alias("_m_n"), dom["top"].alias("_m_top"),
        F.length(F.regexp_replace(t, "[^A-Za-z]", "")).alias("_m_let"),
        F.length(F.regexp_replace(t, "[^AEIOUaeiou]", "")).alias("_m_vow"),
        F.length(F.regexp_replace(t, r"[^\u0900-\u097F]", "")).alias("_m_dev"),
        F.length(F.regexp_replace(t, "[^" + DEV_VOWEL_OR_SIGN[1:], "")).alias("_m_devv"),
    ]


def _decisions() -> dict[str, tuple[Column, Column]]:
    """Stage 2: rule -> (fires, detail text) from the stage-1 columns."""
    c = F.col
    ratio = lambda a, b: c(a).cast("double") / F.nullif(c(b), F.lit(0)).cast("double")
    txt = lambda rule, arg: F.format_string(RULE_TEXT[rule], arg)
    return {
        "symbol": (c("_m_sym"), F.lit(RULE_TEXT["symbol"])),
        "repeat": (c("_m_rep").isNotNull(), txt("repeat", c("_m_rep"))),
        "dev_signs": (c("_m_sig").isNotNull(), txt("dev_signs", c("_m_sig"))),
        "dev_consonants": (c("_m_dco").isNotNull(), txt("dev_consonants", c("_m_dco"))),
        "consonants": (c("_m_con").isNotNull(), txt("consonants", c("_m_con"))),
        "dominance": ((c("_m_n") >= DOMINANCE_MIN_CHARS) & (ratio("_m_top", "_m_n") > F.lit(DOMINANCE_MAX_SHARE)),
                      txt("dominance", _ratio_2dp(c("_m_top"), c("_m_n")))),
        "vowels": ((c("_m_let") >= VOWEL_MIN_LETTERS) & (ratio("_m_vow", "_m_let") < F.lit(VOWEL_MIN_SHARE)),
                   txt("vowels", _ratio_2dp(c("_m_vow"), c("_m_let")))),
        "dev_vowels": ((c("_m_dev") >= DEV_MIN_CHARS) & (ratio("_m_devv", "_m_dev") < F.lit(DEV_MIN_SIGN_SHARE)),
                       txt("dev_vowels", _ratio_2dp(c("_m_devv"), c("_m_dev")))),
    }


def with_rule_columns(df: DataFrame, text_col: str, consonant_run: int = 4) -> DataFrame:
    """Adds ``{rule}_f`` (fires) and ``{rule}_d`` (detail) for every gibberish rule, on the stripped text."""
    keep = [F.col(x) for x in df.columns]
    s0 = df.select(*keep, strip(text_col).alias("_st"))
    s0 = s0.select(*keep, "_st", no_space("_st").alias("_nsp"))
    m = s0.select(*keep, *_measures(F.col("_st"), consonant_run))
    dec = _decisions()
    out = m.select(*keep, *[e for name in ALL_RULES for e in (dec[name][0].alias(f"{name}_f"), dec[name][1].alias(f"{name}_d"))])
    return out


def _first_rule(rules) -> tuple[Column, Column]:
    rule = F.lit(None).cast("string")
    reason = F.lit(None).cast("string")
    for name in reversed([x for x in ALL_RULES if x in rules]):
        rule = F.when(F.col(f"{name}_f"), F.lit(name)).otherwise(rule)
        reason = F.when(F.col(f"{name}_f"), F.col(f"{name}_d")).otherwise(reason)
    return rule, reason


def with_gibberish(df: DataFrame, text_col: str, rules=ALL_RULES, consonant_run: int = 4,
                   prefix: str = "gib_") -> DataFrame:
    """Adds ``{prefix}rule`` and ``{prefix}reason``: the first rule of the cascade that fires, or nulls.
    Each rule is evaluated once (staged columns); the cascade then picks among attribute references."""
    keep = [F.col(x) for x in df.columns]
    d = with_rule_columns(df, text_col, consonant_run)
    rule, reason = _first_rule(rules)
    return d.select(*keep, rule.alias(prefix + "rule"), reason.alias(prefix + "reason"))


def with_classification(df: DataFrame, text_col: str, unsafe_words=UNSAFE_PATTERNS, rules=ALL_RULES,
                        consonant_run: int = 4, boundary: str = "python") -> DataFrame:
    """Adds verdict, verdict_reason, rule, unsafe_match: empty -> off_topic; unsafe -> unsafe;
    gibberish -> off_topic; else in_scope."""
    keep = [F.col(x) for x in df.columns]
    d = df.select(*keep, strip(text_col).alias("_ct"))
    d = d.select(*keep, "_ct", unsafe_match("_ct", unsafe_words, boundary).alias("unsafe_match"))
    d = with_gibberish(d, "_ct", rules, consonant_run, prefix="_gib_")
    empty = F.col("_ct") == ""
    um, gr = F.col("unsafe_match"), F.col("_gib_rule")
    verdict = (F.when(empty, F.lit(OFF_TOPIC)).when(um.isNotNull(), F.lit(UNSAFE))
               .when(gr.isNotNull(), F.lit(OFF_TOPIC)).otherwise(F.lit(IN_SCOPE)))
    reason = (F.when(empty, F.lit(REASON_EMPTY))
              .when(um.isNotNull(), F.format_string(REASON_UNSAFE, um))
              .when(gr.isNotNull(), F.format_string(REASON_GIBBERISH, F.col("_gib_reason")))
              .otherwise(F.lit(REASON_PASSED)))
    rule = F.when(empty, F.lit("empty")).when(um.isNotNull(), F.lit("unsafe")).otherwise(gr)
    return d.select(*keep, "unsafe_match", verdict.alias("verdict"), reason.alias("verdict_reason"), rule.alias("rule"))


def grounding_gate(questions: DataFrame, q_key: str, hits: DataFrame, threshold: float = 0.83) -> DataFrame:
    """questions LEFT JOIN rank-1 hits: (q_key, can_answer, top_score, reason). Equality passes."""
    top = hits.where(F.col("rank") == 1).select(q_key, F.col("score").alias("_s"))
    j = questions.select(q_key).join(top, q_key, "left")
    thr_s = f"{threshold:.2f}"
    s = F.coalesce(F.col("_s"), F.lit(0.0))
    s4 = F.format_string("%.4f", s)
    reason = (F.when(F.col("_s").isNull(), F.lit(REASON_NO_CHUNKS))
              .when(s < F.lit(threshold), F.format_string(REASON_BELOW, s4, F.lit(thr_s)))
              .otherwise(F.format_string(REASON_ABOVE, s4, F.lit(thr_s))))
    return j.select(q_key, (F.col("_s").isNotNull() & (s >= F.lit(threshold))).alias("can_answer"),
                    s.alias("top_score"), reason.alias("reason"))
