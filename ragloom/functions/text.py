"""Column helpers for text. Every function takes and returns a Column and stays JVM-side.

Regex notes (Java regex, as used by Spark):
* ``(?U)`` turns on Unicode classes so ``\\s`` and ``\\d`` agree with Python's ``str`` regexes.
* Python's ``\\b`` treats combining marks (Devanagari vowel signs) as non-word characters; Java's
  plain or Unicode ``\\b`` does not. ``WORD_BOUNDARY`` spells Python's rule out with look-arounds.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character in Python's sense: letters, numbers, underscore (marks excluded).
WORD_CHAR = r"[\p{L}\p{N}_]"
WORD_BOUNDARY = (
    r"(?:(?<!" + WORD_CHAR + r")(?=" + WORD_CHAR + r")|(?<=" + WORD_CHAR + r")(?!" + WORD_CHAR + r"))"
)
# Unicode-aware boundary variant (marks count as part of a word).
WORD_CHAR_UNICODE = r"[\p{L}\p{M}\p{N}_]"
WORD_BOUNDARY_UNICODE = (
    r"(?:(?<!" + WORD_CHAR_UNICODE + r")(?=" + WORD_CHAR_UNICODE + r")|(?<="
    + WORD_CHAR_UNICODE + r")(?!" + WORD_CHAR_UNICODE + r"))"
)

# Devanagari digits and their Latin equivalents, in order.
DEVANAGARI_DIGITS = "०१२३४५६७८९"
LATIN_DIGITS = "0123456789"

# Sentence enders used by the two sentence splitters.
CHUNK_SENTENCE_SPLIT = r"(?U)(?<=[.!?।॥])\s+"  # split on whitespace after an ender; ender kept
VERIFY_SENTENCE_SPLIT = r"[।.?!\n]+"  # split on runs of enders or newlines; enders dropped
VERIFY_SENTENCE_SPLIT_WS = r"(?U)\s*[।.?!\n]+\s*"

TERM_PATTERN = r"[\p{L}\p{M}\p{N}]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: trims any Unicode whitespace (``trim`` only trims spaces)."""
    return F.regexp_replace(col_(c), r"(?U)^\s+|\s+$", "")


def is_blank(c) -> Column:
    return F.coalesce(strip(c) == F.lit(""), F.lit(True))


def tokens(c) -> Column:
    """Python ``str.split()``: whitespace tokens, never empty strings."""
    return F.filter(F.split(col_(c), r"(?U)\s+"), lambda x: x != F.lit(""))


def terms(c) -> Column:
    """Lower-cased letter/number runs: the vocabulary of the lexical vectors."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(TERM_PATTERN), 0)


def is_hindi(c) -> Column:
    """Any Devanagari character (U+0900..U+097F)."""
    return col_(c).rlike(r"[\u0900-\u097F]")


def normalize_digits(c) -> Column:
    return F.translate(col_(c), DEVANAGARI_DIGITS, LATIN_DIGITS)


def chunk_sentences(c) -> Column:
    """Sentences for semantic chunking: split after ``. ! ? । ॥`` + whitespace, strip, drop empty.

    The text is stripped once; the split consumes the whitespace between sentences, so no piece has
    leading or trailing whitespace and no per-element strip is needed (all native expressions)."""
    return F.array_remove(F.split(strip(c), CHUNK_SENTENCE_SPLIT), "")


def verify_sentences(c) -> Column:
    """Sentences for claim checking: split on runs of enders/newlines, strip, drop empty.

    Whitespace next to a separator is consumed by the split itself, the ends by one strip of the
    whole text - the same pieces as splitting first and stripping each."""
    return F.array_remove(F.split(strip(c), VERIFY_SENTENCE_SPLIT_WS), "")


def clean_answer(c) -> Column:
    """Drop citation tags, spaces/commas before enders or the end, repeated commas, extra whitespace."""
    x = F.regexp_replace(col_(c), r"(?U)\[[\d,\s]+\]", "")
    x = F.regexp_replace(x, r"(?Ud)[\s,]+(?=[।.?!]|$)", "")
    x = F.regexp_replace(x, r"(?U),\s*,+", ",")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    return strip(x)


def spoken_text(c) -> Column:
    """Text for speech output: no citation tags, ``*``, ``#`` or backticks; one space between words."""
    x = F.regexp_replace(col_(c), r"(?U)\[[0-9,\s]+\]", "")
    x = F.regexp_replace(x, r"\*+", "")
    x = F.regexp_replace(x, r"#+", "")
    x = F.regexp_replace(x, r"`+", "")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    return strip(x)


def speech_lang(c) -> Column:
    return F.when(is_hindi(c), F.lit("hi-IN")).otherwise(F.lit("en-US"))
