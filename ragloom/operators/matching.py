"""Exact substring-containment join by a multi-pattern automaton.

All needles are compiled into one Aho-Corasick automaton, so one pass over a text finds every needle that it holds, short ones
and overlapping ones alike. The texts are scanned once, in the tasks that read them.

* A needle side of at most ``NEEDLE_BYTES`` and ``NEEDLE_ROWS`` (checked by an aggregate) is broadcast.
* A larger one is dealt in groups of about that size by a hash of the needle, the texts in groups of about ``TEXT_BYTES``; every
  pair of groups meets in one task, so neither side is ever whole in one place.

Defined cases: null needles and null texts match nothing; an empty needle is in every text; equal needles match under each of
their ids; a (needle, text) pair of ids comes once, however often the needle or either row occurs. Ids of any type.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEEDLE_ROWS = 1_000_000
NEEDLE_BYTES = 32 << 20
TEXT_BYTES = 128 << 20


def _automaton(texts: list[str]):
    """(automaton over the distinct non-empty needles, positions of each distinct needle, positions of empty ones)."""
    import ahocorasick

    found: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        found.setdefault(t, []).append(i)
    everywhere = found.pop("", [])
    made = ahocorasick.Automaton()
    positions = []
    for t, at in found.items():
        made.add_word(t, len(positions))
        positions.append(at)
    if positions:
        made.make_automaton()
    return made if positions else None, positions, everywhere


def _held(automaton, positions: list[list[int]], everywhere: list[int], texts: list[str | None]) -> tuple[list[int], list[int]]:
    """(needle positions, text positions) of all matches."""
    needle_at, text_at = [], []
    for i, text in enumerate(texts):
        if text is None:
            continue
        hits = everywhere
        if automaton is not None and text:
            numbers = {n for _, n in automaton.iter(text)}
            if numbers:
                hits = everywhere + [p for n in numbers for p in positions[n]]
        needle_at += hits
        text_at += [i] * len(hits)
    return needle_at, text_at


def contains_join(needles: DataFrame, hays: DataFrame, nid: str, ntext: str, hid: str, htext: str,
                  needle_bytes: int = NEEDLE_BYTES, needle_rows: int = NEEDLE_ROWS, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Distinct (nid, hid) of every needle contained in a text."""
    if nid == hid:
        raise ValueError("needle and text ids need different column names")
    n = needles.select(F.col(nid).alias(nid), F.col(ntext).alias("_n")).where(F.col("_n").isNotNull())
    h = hays.select(F.col(hid).alias(hid), F.col(htext).alias("_h")).where(F.col("_h").isNotNull())
    size = n.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("_n") + 16), F.lit(0)).alias("bytes")).first()
    groups = max(math.ceil(size["bytes"] / needle_bytes), math.ceil(size["rows"] / needle_rows), 1)
    schema = T.StructType([needles.schema[nid], hays.schema[hid]])
    found = _by_broadcast(n, h, nid, hid, schema) if groups == 1 else _dealt(n, h, nid, hid, schema, groups, text_bytes)
    return found.distinct()


def _by_broadcast(n: DataFrame, h: DataFrame, nid: str, hid: str, schema: T.StructType) -> DataFrame:
    held = n.distinct().toArrow()  # under the checked bound; Arrow keeps ids of any type
    shared = n.sparkSession.sparkContext.broadcast({"ids": held[nid].combine_chunks(), "texts": held["_n"].to_pylist()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        if "automaton" not in kept:
            kept["automaton"] = _automaton(kept["texts"])
        for b in batches:
            needle_at, text_at = _held(*kept["automaton"], b.column("_h").to_pylist())
            yield pa.RecordBatch.from_arrays([kept["ids"].take(pa.array(needle_at, pa.int64())), b.column(hid).take(pa.array(text_at, pa.int64()))], [nid, hid])

    return h.mapInArrow(run, schema)


def _dealt(n: DataFrame, h: DataFrame, nid: str, hid: str, schema: T.StructType, groups: int, text_bytes: int) -> DataFrame:
    total = h.agg(F.coalesce(F.sum(F.octet_length("_h")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / text_bytes))
    left = n.distinct().withColumn("_g", F.pmod(F.xxhash64("_n"), F.lit(groups)).cast("int")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = h.withColumn("_p", F.pmod(F.xxhash64("_h", hid), F.lit(parts)).cast("int")).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(needles: pa.Table, texts: pa.Table) -> pa.Table:
        needle_at, text_at = _held(*_automaton(needles["_n"].to_pylist()), texts["_h"].to_pylist())
        return pa.table({nid: needles[nid].take(pa.array(needle_at, pa.int64())), hid: texts[hid].take(pa.array(text_at, pa.int64()))})

    return left.groupBy("_g", "_p").cogroup(right.groupBy("_g", "_p")).applyInArrow(meet, schema)
