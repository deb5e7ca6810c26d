"""Substring dedup by line hashing.

Units are the lines that hold a word, normalised (lower case, runs of white space as one space, trimmed) and hashed; 96 bits are
compared. Digests are grouped globally: the occurrence with the smallest rank (id, then row, then line) is kept, every
other one is repeated. Runs of adjacent repeated units within a document go if they have ``MIN_WORDS`` words together:
short lines are removed only as part of a longer repeated passage, since they also recur by chance. Removed runs keep
their original offsets in code points.

With ``below_lines`` the units are pieces of lines, so that a passage repeated inside a longer line is found as well. Lines
of ``MIN_WORDS`` words and more are cut after a sentence end or a word whose checksum divides by ``CUT_EVERY``, but not
before ``LEAST`` words, and at the latest after ``MOST``. Cuts depend on the words alone, so two copies of a passage are cut
alike from their first common cut on; up to a unit at either end of a passage can stay. Runs cross line ends. With
``short_lines`` a run goes as well if one of its units is a whole line, however short.

Units are stored as arrays, a row a document. Their occurrences are shuffled once by digest and sorted by rank, and a pass over the
sorted stream gives every one but the first of its digest. Digests with over a thousandth of all units (at most a thousand) don't go
that way: a count of units by a few bits of the digest narrows them down, their first occurrence is combined before the
shuffle, and the tasks look them up in the documents' arrays, so a line that a third of all documents share isn't dealt to one
task and its occurrences are no rows of a join. Runs are cut within a document.

Defined cases: null and empty texts have no units; null ids rank last; repeated rows are told apart by their place in
the stored table of units, so exactly one keeps its lines; an empty table gives an empty result; columns other than id
and text aren't read.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import HOT_SHARE, checkpoint, let, stored

MIN_WORDS = 10
#: buckets of digests for the search of very common ones
HOT_BUCKETS = 1 << 14


#: of units below the line: fewest and most words, and the mean number of words that a cut is waited for after the fewest
LEAST, MOST, CUT_EVERY = 4, 16, 4
WORD = re.compile(r"[^\s。！？।]*[。！？।]+|[^\s。！？।]+")
ENDS = frozenset(".!?。！？।")
KEPT_WORDS = 200_000


def pieces_of(line: str, cuts: dict[str, bool]) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of the units of a line, code points within it. ``cuts`` keeps which words end a unit."""
    found = list(WORD.finditer(line))
    words = [m.group().lower() for m in found]
    first = 0
    for i, w in enumerate(words):
        n = i + 1 - first
        if i + 1 < len(words):
            if n < LEAST or len(words) < MIN_WORDS:
                continue
            if n < MOST:
                cut = cuts.get(w)
                if cut is None:
                    if len(cuts) >= KEPT_WORDS:
                        cuts.clear()
                    cut = cuts[w] = w[-1] in ENDS or zlib.crc32(w.encode("utf-8", "surrogatepass")) % CUT_EVERY == 0
                if not cut:
                    continue
        yield found[first].start(), found[i].end(), words[first:i + 1]
        first = i + 1


def lines_of(line: str, cuts: dict[str, bool]) -> Iterator[tuple[int, int, list[str]]]:
    words = line.lower().split()
    if words:
        yield 0, len(line), words


UNITS = "row long, id {id}, row_key long, start array<int>, stop array<int>, words array<int>, whole array<boolean>, d1 array<long>, d2 array<long>"


def units_of(cut_line: Callable) -> Callable:
    """Arrow map from (row, id, row_key, text) to the columns of UNITS, texts without a unit left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cuts: dict[str, bool] = {}
        for b in batches:
            at, counts, units, digests = [], [0], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                start, before = 0, len(units)
                for line in (text or "").split("\n"):
                    found = list(cut_line(line, cuts))
                    for s, e, words in found:
                        units.append((start + s, start + e, len(words), len(found) == 1))
                        digests.append(xxhash.xxh128_digest(" ".join(words).encode("utf-8")))
                    start += len(line) + 1
                if len(units) > before:
                    at.append(i)
                    counts.append(len(units))
            offsets, numbers = pa.array(counts, pa.int32()), np.array(units, np.int32).reshape(-1, 4)
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            lists = [pa.array(numbers[:, 0]), pa.array(numbers[:, 1]), pa.array(numbers[:, 2]), pa.array(numbers[:, 3].astype(bool)), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            kept = [b.column(c).take(pa.array(at, pa.int64())) for c in ("row", "id", "row_key")]  # ids stay Arrow columns
            yield pa.RecordBatch.from_arrays([*kept, *(pa.ListArray.from_arrays(offsets, x) for x in lists)],
                                             ["row", "id", "row_key", "start", "stop", "words", "whole", "d1", "d2"])
    return run


def not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, then rank: all but the first of each digest, with the first one's id."""
    last, first_id = None, None
    for b in batches:
        if not b.num_rows:
            continue
        d1, rest, ids = b.column("d1").to_numpy(), b.column("rest").to_numpy(), b.column("id")
        d2 = rest >> 32
        new = np.ones(b.num_rows, bool)
        new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        new[0] = last != (d1[0], d2[0])
        opened = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), -1))  # -1: in an earlier batch
        known = pa.concat_arrays([first_id if first_id is not None else ids.slice(0, 1), ids])
        firsts = known.take(pa.array(opened + 1))
        later = pa.array(np.flatnonzero(~new))
        unit = pa.array((rest & 0xFFFFFFFF).astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column("row").take(later), unit.take(later), firsts.take(later)], ["row", "unit", "first_id"])
        last, first_id = (d1[-1], d2[-1]), firsts.slice(b.num_rows - 1, 1)


def hits_of(common: pa.Table) -> Callable:
    """Arrow map from (row, d1, d2) to (row, hits): the units of a document with one of the ``common`` digests (columns d1, d2, row, unit and
    id of its first occurrence), but the first itself. Documents without any are left out."""
    place = {digest: i for i, digest in enumerate(zip(common["d1"].to_pylist(), common["d2"].to_pylist()))}
    known, ids = np.array(sorted({d1 for d1, _ in place}), np.int64), common["id"].combine_chunks()
    first_row, first_unit = (common[c].to_numpy() for c in ("row", "unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("d1")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            d1, d2 = lists.flatten().to_numpy(), b.column("d2").flatten().to_numpy().astype(np.int32)  # the 96 bits that are compared
            at = np.flatnonzero(np.isin(d1, known))
            which = np.array([place.get(x, -1) for x in zip(d1[at].tolist(), d2[at].tolist())], np.int64)
            at, which = at[which >= 0], which[which >= 0]
            doc = np.repeat(np.arange(len(lists)), counts)[at]
            unit = at - (np.cumsum(counts) - counts)[doc]
            rows = b.column("row").to_numpy()
            later = (rows[doc] != first_row[which]) | (unit != first_unit[which])
            doc, unit, which = doc[later], unit[later], which[later]
            docs, n_hits = np.unique(doc, return_counts=True)
            hits = pa.StructArray.from_arrays([pa.array(unit.astype(np.int32)), ids.take(pa.array(which))], ["unit", "first_id"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_hits)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(rows[docs]), pa.ListArray.from_arrays(offsets, hits)], ["row", "hits"])
    return run


def later_occurrences(docs: DataFrame) -> DataFrame:
    """(row, hits) of the documents with units whose digest stands at a smaller rank as well: their numbers and the first ones' ids. What is
    shuffled of a unit is 96 bits of its digest (``d1``, and the upper half of ``rest``), its number (the lower half), row and id. Units of
    very common digests are found within their documents and never become rows."""
    bucket = lambda d: d.bitwiseAND(F.lit(HOT_BUCKETS - 1))
    sizes = docs.select(F.explode("d1").alias("d1")).groupBy(bucket(F.col("d1")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["b"]: r["n"] for r in sizes.collect()}  # HOT_BUCKETS rows at most
    limit = max(sum(counts.values()) // HOT_SHARE, 1)
    rest = F.transform("d2", lambda d, i: F.shiftleft(d, 32).bitwiseOR(i.cast("long")))
    units = docs.select("row", "id", F.explode(F.arrays_zip("d1", rest.alias("rest"))).alias("u")).select("u.d1", "u.rest", "row", "id")
    digest = [F.col("d1"), F.shiftright("rest", 32).alias("d2")]
    kind = docs.schema["id"].dataType.simpleString()
    suspects = [b for b, n in counts.items() if n > limit]  # under HOT_SHARE
    common = None
    if suspects:
        rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "rest")
        first = units.filter(bucket(F.col("d1")).isin(suspects)).groupBy(*digest).agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        unit = F.col("first.rest").bitwiseAND(F.lit(0xFFFFFFFF))
        first = checkpoint(first.filter(F.col("n") > limit).select("d1", "d2", "first.row", unit.alias("unit"), "first.id"))
        held = first.toArrow()  # under HOT_SHARE rows
        if held.num_rows:
            common = docs.select("row", "d1", "d2").mapInArrow(hits_of(held), f"row long, hits array<struct<unit:int,first_id:{kind}>>")
            units = units.withColumn("d2", digest[1]).join(F.broadcast(first.select("d1", "d2")), ["d1", "d2"], "left_anti").drop("d2")
    dealt = units.repartition(F.col("d1")).sortWithinPartitions("d1", F.shiftright("rest", 32), F.col("id").asc_nulls_last(), "row", "rest")
    found = dealt.mapInArrow(not_first, f"row long, unit int, first_id {kind}")
    found = found.groupBy("row").agg(F.collect_list(F.struct("unit", "first_id")).alias("hits"))  # a document's own units
    if common is None:
        return found
    none = F.array().cast(f"array<struct<unit:int,first_id:{kind}>>")
    both = found.join(common.withColumnRenamed("hits", "_common"), "row", "full_outer")
    return both.select("row", F.concat(F.coalesce("hits", none), F.coalesce("_common", none)).alias("hits"))


def document_runs(df: DataFrame, id_col: str, text_col: str, min_words: int, below_lines: bool, short_lines: bool) -> DataFrame:
    """(row, id, row_key, runs) of the documents with a removed run: start, stop, n_units, n_words and kept_in of each, in order. Runs are cut
    inside the row, from a document's own hits."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))
    docs = stored(rows.mapInArrow(units_of(pieces_of if below_lines else lines_of), UNITS.format(id=dict(df.dtypes)[id_col])), "units")
    own = later_occurrences(docs).join(docs.select("row", "id", "row_key", "start", "stop", "words", "whole"), "row")
    at = lambda c, h: F.get(F.col(c), h["unit"])

    def run(part: Column) -> Column:
        kept_in = F.filter(F.transform(part, lambda h: h["first_id"]), lambda x: x.isNotNull())
        return F.struct(
            F.array_min(F.transform(part, lambda h: at("start", h))).cast("long").alias("start"), F.array_max(F.transform(part, lambda h: at("stop", h))).cast("long").alias("stop"),
            F.size(part).cast("long").alias("n_units"), F.aggregate(part, F.lit(0).cast("long"), lambda n, h: n + at("words", h)).alias("n_words"),
            F.array_sort(F.array_distinct(kept_in)).alias("kept_in"), F.exists(part, lambda h: at("whole", h)).alias("whole"))

    def cut(hits: Column) -> Column:
        """Runs of hits in the order of their units: a run ends before a unit that doesn't follow on."""
        first = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: (i == 0) | (F.get(hits, i)["unit"] != F.get(hits, i - 1)["unit"] + 1))
        return let(first, lambda begin: F.transform(begin, lambda s, j: let(F.slice(hits, s + 1, F.coalesce(F.get(begin, j + 1), F.size(hits)) - s), run)))

    runs = F.filter(let(F.array_sort("hits"), cut), lambda r: (r["n_words"] >= min_words) | (r["whole"] & F.lit(short_lines)))
    return own.select("row", "id", "row_key", runs.alias("runs")).filter(F.size("runs") > 0)


def removed_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, below_lines: bool = False, short_lines: bool = False) -> DataFrame:
    """One row per removed run: id, row_key (hash of the text), row, start, stop (code points, end exclusive), n_units,
    n_words and kept_in (ids of the documents whose occurrences are kept)."""
    runs = document_runs(df, id_col, text_col, min_words, below_lines, short_lines)
    return runs.select(F.col("id").alias(id_col), "row_key", "row", F.inline("runs")).drop("whole")


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the runs and, for each, the white space character that follows it."""
    out, at = [], 0
    for s, e in sorted(runs):
        out.append(text[at:s])
        at = e + text[e:e + 1].isspace()
    return "".join(out) + text[at:]


def with_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, below_lines: bool = False, short_lines: bool = False) -> DataFrame:
    """``df`` with ``_ld_runs``: the (start, stop) of its removed runs in order, null if there are none. Equal rows are paired with their
    runs in order."""
    runs = document_runs(df, id_col, text_col, min_words, below_lines, short_lines)
    places = F.array_sort(F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"))))
    per_row = runs.select("row", F.col("id").alias("_ld_id"), F.col("row_key").alias("_ld_key"), places.alias("_ld_runs"))
    # of equal rows the later ones lose more, so the n-th by removed length belongs to the n-th of the equal rows
    per_row = checkpoint(per_row.withColumn("_ld_nth", F.row_number().over(Window.partitionBy("_ld_id", "_ld_key").orderBy(F.size("_ld_runs").desc(), "row"))).drop("row"))
    # texts are shuffled once, by their hash: the numbering and the join both find them there (the rest of the condition is no join key)
    own = df.withColumn("_ld_own", F.xxhash64(text_col)).repartition(F.col("_ld_own"))
    own = own.withColumn("_ld_n", F.row_number().over(Window.partitionBy(id_col, "_ld_own").orderBy(F.lit(0))))
    same_id = F.coalesce(F.col(id_col) == F.col("_ld_id"), F.col(id_col).isNull() & F.col("_ld_id").isNull())
    joined = own.join(per_row, (F.col("_ld_own") == F.col("_ld_key")) & same_id & (F.col("_ld_n") - F.col("_ld_nth") == 0), "left")
    return joined.select(*df.columns, "_ld_runs")


def cut_texts(texts: pd.Series, runs: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or x is None or not len(x) else without(t, [(r["start"], r["stop"]) for r in x]) for t, x in zip(texts, runs)], dtype=object)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, below_lines: bool = False, short_lines: bool = False) -> DataFrame:
    """``df`` with repeated runs cut from ``text_col``."""
    cut = F.pandas_udf(cut_texts, "string")
    return with_runs(df, id_col, text_col, min_words, below_lines, short_lines).withColumn(text_col, cut(F.col(text_col), F.col("_ld_runs"))).select(*df.columns)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, what is left of the text, its n_chars, whether any word is left (``kept``; a text without a word is
    kept as it is), and the removed runs as start:stop, comma-joined, in code points of the original."""
    cut = F.pandas_udf(cut_texts, "string")
    rows = with_runs(df.select(id_col, text_col), id_col, text_col, below_lines=True, short_lines=True)
    spelled = F.array_join(F.transform("_ld_runs", lambda r: F.concat_ws(":", r.getField("start").cast("string"), r.getField("stop").cast("string"))), ",")
    left = rows.withColumn("_left", cut(F.col(text_col), F.col("_ld_runs")))
    return left.select(id_col, F.col("_left").alias("text"), F.length("_left").cast("long").alias("n_chars"),
                       (F.col("_ld_runs").isNull() | F.coalesce(F.col("_left").rlike(r"\S"), F.lit(False))).alias("kept"), F.coalesce(spelled, F.lit("")).alias("removed"))


#: The removed runs of documents as DuckDB SQL (ids are distinct there).
SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
o AS (SELECT doc_id, pos, line, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS unit,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
u AS (SELECT *, start + length(line) AS stop, len(string_split(unit, ' ')) AS words FROM o WHERE unit <> ''),
f AS (SELECT *, first_value(doc_id) OVER w AS first_id, row_number() OVER w AS nth FROM u WINDOW w AS (PARTITION BY unit ORDER BY doc_id, pos)),
r AS (SELECT *, sum(CASE WHEN nth > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop, count(*) AS n_units, CAST(sum(words) AS BIGINT) AS n_words,
  array_to_string(list_sort(list_distinct(list(first_id))), ',') AS kept_in
FROM r WHERE nth > 1 GROUP BY doc_id, run HAVING sum(words) >= 10
"""
