"""Personal data: fixed-form matches, and bootstrapped contextual extraction of what they miss.

*Base* (per document, whole text): e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, leftmost
and non-overlapping within a kind, failing matches dropped without a retry. Matching is linear in the text.

*Bootstrapping*. The base entities are seeds. Their contexts give lexical patterns: the two words before (``l``), the
word before with the word after (``b``), and a word before that ends in ``:`` or ``=`` (``c``). Every other token with
an ``@`` or five digits, or of a shape that an identifier can have, is a mention; adjacent groups of digits with one space
between are one mention if the whole has such a shape. Patterns and mentions, by normalised spelling, form a bipartite
graph. A round

1. scores each pattern and kind: the summed scores of its instances over their number plus one, where every mention
   in that context counts, also those that look like no kind; it must be backed by ``MIN_SEEDS`` distinct instances
   (seeds, and from the second round on accepted mentions, which so induce new patterns), so copies of one text don't
   count twice;
2. scores each mention by its patterns of confidence ``CONFIDENT`` and more, for kinds its shape allows:
   1 - prod(1 - score); ``CONFIDENT`` makes it an instance of the next round.

Rounds go on until one accepts no mention that the round before hadn't (scores only grow, so accepted ones stay).
Accepted mentions are spans wherever they occur. Edges are distinct (pattern, spelling) pairs, combined before the
shuffle, and patterns, spellings and mentions with over a thousandth of the rows at hand (at most a thousand) are joined by
broadcast, so one held by a third of all rows isn't dealt to one task. Nothing is collected to the driver. The tables
of mentions are checkpointed and joined back by row.

Defined cases: null and empty texts have no spans; equal rows get equal spans; ties between kinds go to the kind
listed first; an empty table gives an empty result; columns other than id and text aren't read. A document's base
spans never change because of other documents.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import checkpoint, join_classes

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3
CONFIDENT = 0.7

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: a run of digits that fails from its start fails from within, so the look-behind changes no match
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
TOKEN = re.compile(r"\S+")
TRIM = ".,;!?\"'()[]{}<>«»“”"
MENTION_DIGITS = 5
#: what any identifier has
MARK = re.compile(r"[@0-9:]|[\[(](?:at|AT)[\])]")
#: groups of digits with one space between
SPACED = re.compile(r"(?<!\S)[+(]?[0-9]{1,6}\)?(?:[-.][0-9]{1,6})*(?: \(?[0-9]{1,6}\)?(?:[-.][0-9]{1,6})*)+(?=[.,;:!?]*(?:\s|\Z))")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        domain, start = DOMAIN.match(text, at + 1), at
        if domain:
            while start > end and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind as listed, then start; code points, end exclusive."""
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def shapes(token: str) -> list[int]:
    """Kinds that the spelling allows for an identifier which no base form matched."""
    digits, out = len(NOT_DIGIT.sub("", token)), []
    if re.fullmatch(r"[^@\s]+@[^@\s]+|\S+[\[(](?:at|AT)[\])]\S+", token):
        out.append(0)
    if re.fullmatch(r"\d{1,3}(?:[.:]\d{1,3}){3,}(?::\d+)?", token) or (token.count(":") >= 2 and re.fullmatch(r"[0-9A-Fa-f:.]{6,45}", token)):
        out.append(1)
    if 12 <= digits <= 19 and re.fullmatch(r"[0-9-]+", token):
        out.append(2)
    if 7 <= digits <= 15 and re.fullmatch(r"[+(]?[0-9][0-9().\-/]*", token):
        out.append(3)
    return out


def words_before(text: str, at: int, n: int) -> list[str]:
    """The last n whole words of text[:at]."""
    width = 64
    while True:
        found = text[max(0, at - width):at].split()
        if at <= width or len(found) > n:  # the first of more than n may be cut
            return found[-n:]
        width *= 4


def word_after(text: str, at: int) -> list[str]:
    """The first whole word of text[at:]."""
    width = 64
    while True:
        found = text[at:at + width].split(None, 1)
        if at + width >= len(text) or len(found) > 1:
            return found[:1]
        width *= 4


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span."""
    left = [w.lower() for w in words_before(text, start, 2)]
    right = [w.lower() for w in word_after(text, end)]
    out = []
    if len(left) >= 2:
        out.append(f"l {left[-2]} {left[-1]}")
    if left and right:
        out.append(f"b {left[-1]} _ {right[0]}")
    if left and left[-1][-1] in ":=":
        out.append(f"c {left[-1]}")
    return out


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[int], list[str]]]:
    """(seed kind or -1, start, end, spelling, allowed kinds, patterns) of the seeds and of every other mention."""
    out = [(k, s, e, text[s:e].lower(), [k], contexts(text, s, e)) for k, s, e in spans]
    taken = sorted((s, e) for _, s, e in spans)
    out += [(-1, i, j, text[i:j].lower(), shapes(text[i:j].replace(" ", "")), contexts(text, i, j)) for i, j in spaced(text, taken)]
    taken = sorted((s, e) for _, s, e, *_ in out)
    at = 0
    for m in TOKEN.finditer(text):
        token = m.group()
        if not MARK.search(token):
            continue
        s = m.start() + len(token) - len(token.lstrip(TRIM))
        e = m.end() - (len(token) - len(token.rstrip(TRIM + ":")))
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s >= e or (at < len(taken) and taken[at][0] < e):
            continue
        kinds = shapes(text[s:e])
        if kinds or "@" in token or sum(map(str.isdigit, token)) >= MENTION_DIGITS:
            out.append((-1, s, e, text[s:e].lower(), kinds, contexts(text, s, e)))
    return out


def spaced(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Numbers written in groups that have a shape as a whole and don't meet a span of ``taken``."""
    out, at = [], 0
    for m in SPACED.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if (at == len(taken) or taken[at][0] >= m.end()) and shapes(m.group().replace(" ", "")):
            out.append(m.span())
    return out


SPAN = "struct<kind int, start int, stop int>"
MENTION = "struct<seed int, start int, stop int, spelling string, kinds array<int>, patterns array<string>>"
SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "stop")]))
MENTIONS = pa.list_(pa.struct([("seed", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("spelling", pa.string()),
                               ("kinds", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string()))]))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        base, found = [], []
        for text in b.column("text").to_pylist():
            text = text or ""
            marked = MARK.search(text)
            spans = base_spans(text) if marked else []
            base.append([{"kind": k, "start": s, "stop": e} for k, s, e in spans])
            found.append([{"seed": k, "start": s, "stop": e, "spelling": w, "kinds": kinds, "patterns": p}
                          for k, s, e, w, kinds, p in (mentions(text, spans) if marked else [])])
        # ids stay Arrow columns: pandas would round long ids beside a null one
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row_key"), pa.array(base, SPANS), pa.array(found, MENTIONS)], ["id", "row_key", "base", "mentions"])


def accepted(mentions: DataFrame) -> DataFrame:
    """(spelling, kind) of the mentions that high-confidence patterns discover. ``mentions``: seed, spelling, kinds,
    patterns."""
    edges = checkpoint(mentions.select("seed", "spelling", "kinds", F.explode("patterns").alias("pattern"))
                       .groupBy("pattern", "spelling").agg(F.max("seed").alias("seed"), F.max("kinds").alias("kinds")))
    seeds = edges.filter("seed >= 0").select("spelling", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    sizes = checkpoint(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SEEDS))
    edges = checkpoint(join_classes(edges, sizes.withColumn("weight", F.col("n")), ["pattern"], "weight"))
    held_by = checkpoint(edges.groupBy("spelling").agg(F.count(F.lit(1)).alias("weight")))
    open_ = edges.filter("seed < 0 and size(kinds) > 0").drop("n")
    scores, n_accepted = seeds, 0
    while True:
        instances = checkpoint(scores.join(held_by, "spelling"))
        held = join_classes(edges, instances, ["spelling"], "weight").groupBy("pattern", "kind").agg(
            F.sum("score").alias("s"), F.count(F.lit(1)).alias("held"), F.first("n").alias("n"))
        patterns = checkpoint(held.filter(F.col("held") >= MIN_SEEDS)
                              .select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("confidence"), "n").filter(F.col("confidence") >= CONFIDENT))
        reached = (join_classes(open_, patterns, ["pattern"], "n").filter(F.array_contains("kinds", F.col("kind")))
                   .groupBy("spelling", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score")))
        found = checkpoint(reached.filter(F.col("score") >= CONFIDENT))
        n_found = found.count()
        if n_found <= n_accepted:
            break
        n_accepted = n_found
        scores = seeds.unionByName(found.select("spelling", "kind", F.least("score", F.lit(0.999)).alias("score")))
    return found.groupBy("spelling").agg(F.min(F.struct(-F.col("score"), "kind")).alias("m")).select("spelling", F.col("m.kind").alias("kind"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, row_key (hash of the text), base and added: arrays of (kind, start, stop)."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))
    kind = dict(df.dtypes)[id_col]
    docs = checkpoint(rows.mapInArrow(scan, f"id {kind}, row_key long, base array<{SPAN}>, mentions array<{MENTION}>"))
    found = docs.select("id", "row_key", F.explode("mentions").alias("m")).select("id", "row_key", "m.*")
    open_ = found.filter("seed < 0 and size(kinds) > 0").drop("seed", "kinds", "patterns")
    often = open_.groupBy("spelling").agg(F.count(F.lit(1)).alias("weight"))
    new = join_classes(open_, checkpoint(accepted(found).join(often, "spelling")), ["spelling"], "weight")
    per_row = (new.groupBy("id", "row_key").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added"))  # a row's own spans
               .select(F.col("id").alias("_id"), F.col("row_key").alias("_row_key"), "added"))
    joined = docs.join(per_row, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_row_key")), "left")
    return joined.select(F.col("id").alias(id_col), "row_key", "base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"))


def spelled(spans) -> F.Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(names, x.getField("kind")), x.getField("start").cast("string"), x.getField("stop").cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base counts by kind, digest of the base spans, all spans spelled out."""
    found = find(df, id_col, text_col)
    def of_kind(k: int):  # not a default argument of the lambda: a second parameter is the element's index
        return F.filter("base", lambda x: x.getField("kind") == k)

    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
                        spelled(F.array_union("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become the first one's mark."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def masked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span in ``text_col`` replaced by its kind in brackets. Only rows with spans are joined."""
    found = find(df, id_col, text_col).filter("size(base) + size(added) > 0")
    spans = found.select(F.col(id_col).alias("_pii_id"), F.col("row_key").alias("_pii_key"), F.array_union("base", "added").alias("_pii")).dropDuplicates(["_pii_id", "_pii_key"])

    @F.pandas_udf("string")
    def apply(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or x is None or not len(x) else mask_text(t, [(m["kind"], m["start"], m["stop"]) for m in x])
                          for t, x in zip(texts, spans)], dtype=object)

    keyed = df.withColumn("_pii_own_key", F.xxhash64(text_col))
    joined = keyed.join(spans, (F.col("_pii_own_key") == F.col("_pii_key")) & F.col(id_col).eqNullSafe(F.col("_pii_id")), "left")
    return joined.withColumn(text_col, apply(F.col(text_col), F.col("_pii"))).select(*df.columns)
