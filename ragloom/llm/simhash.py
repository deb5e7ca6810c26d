"""SimHash near-duplicates: Golay-code fuzzy hashing of 64-bit fingerprints.

1. *Fingerprint* (per document, narrow). ASCII lower-cased words, 4-word shingles with repeats, XXH64 with
   seed 42; a bit is set when it is set in over half of the hashes.
2. *Classes*. Equal fingerprints are one class; only distinct fingerprints go on, so a group of exact copies,
   however large, costs one row.
3. *Keys*. The 64 bits are cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary
   Golay code (23, 12, 7). A word's list holds every codeword within distance 4: one, or six when its nearest
   codeword is 3 away. Two words at distance 2 or less always share a listed codeword. (Distance of one word to
   its codeword c at most 2: the other is within 4 of c. Both 3 away: the five weight-7 codewords around the
   error split the other 20 positions into blocks of four, so the block of a flipped outside position has a
   codeword within 4 of both; with both flips inside the error, c itself is at distance 1.)
4. *Pigeonhole* for at most 4 differing bits. Either a segment is equal and one of the other two has at most 2
   differing bits: key = equal segment + codeword of the other (six ordered pairs). Or all three segments differ,
   then each has at most 2 differing bits: key = codewords of the first two + one of three 7-bit pieces of the
   third, one of which must be equal. Keys have 31 to 34 bits, so unrelated fingerprints rarely meet.
5. *Join and verify*. Rows are shuffled by key and sorted; each run of equal keys is searched breadth first with
   the exact bit distance and gives only tree edges (runs of two are compared in one vector step), so a dense
   group gives as many edges as it has members, never its pairs.
6. *Hot keys*. A key shared by over ``hot`` distinct fingerprints (found by counting on a hash sample, which only
   routes and decides nothing) isn't gathered: its members meet at every word within distance 2, where any two
   are linked by definition and no word gathers over 2,081 members. Exact and linear in the members.
7. *Components* by alternating large-star and small-star rounds, cut by reliable checkpoints. Documents are joined to
   their class; classes with over a thousandth of all rows (at most a thousand) by broadcast.

Defined cases: null or empty text has no words, fingerprint zero. Null ids are allowed: such rows belong to
their component, whose id is the smallest id that isn't null (null if none). Repeated rows and equal texts share
a fingerprint and so a component. An empty table gives an empty result. Only the id and text columns are read,
under names of our own, so other columns can't clash.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import checkpoint, join_classes

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, width)
GOLAY_POLY = 0xC75  # generator polynomial of the (23, 12, 7) code
HOT_KEY = 16384
HOT_SAMPLE = 16


def fingerprint_of(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], HASH_SEED) for s, e in zip(starts, ends[shingle_words - 1:])), dtype="<u8")
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * set_in > len(hashes)).tolist())


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    """Fingerprint as a signed 64-bit integer."""
    return pd.Series([f - (1 << 64) if f >> 63 else f for f in (fingerprint_of(t) for t in texts)], dtype="int64")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class Golay:
    """Tables of the perfect (23, 12, 7) code, built from its generator polynomial."""

    def __init__(self) -> None:
        def rest(word: int) -> int:
            for bit in range(22, 10, -1):
                if word >> bit & 1:
                    word ^= GOLAY_POLY << (bit - 11)
            return word

        self.syndrome_of_high = np.array([rest(h << 11) for h in range(4096)], dtype=np.int64)
        codewords = [(h << 11) | int(s) for h, s in enumerate(self.syndrome_of_high)]
        sevens = [c for c in codewords if c.bit_count() == 7]
        #: by syndrome: the error of the nearest codeword, and what to XOR to its index for each listed codeword
        self.error = np.zeros(2048, dtype=np.int64)
        self.deltas = np.full((2048, 6), -1, dtype=np.int64)
        for weight in range(4):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                s = rest(e)
                self.error[s] = e
                found = [0] + [c >> 11 for c in sevens if c & e == e] * (weight == 3)
                self.deltas[s, :len(found)] = found

    def lists(self, words: np.ndarray) -> np.ndarray:
        """For each 23-bit word the indices of the codewords within distance 4: (n, 6), -1 where there's none."""
        syndrome = self.syndrome_of_high[words >> 11] ^ (words & 2047)
        index = (words ^ self.error[syndrome]) >> 11
        deltas = self.deltas[syndrome]
        return np.where(deltas < 0, -1, index[:, None] ^ deltas)


def keys_of(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fps) of every key of every fingerprint (unsigned 64-bit)."""
    segments = [((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in SEGMENTS]
    lists = [golay.lists(s) for s in segments]
    keys, owners, tag = [], [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                at, col = np.nonzero(lists[j] >= 0)
                keys.append(np.int64(tag) << 40 | segments[i][at] << 12 | lists[j][at, col])
                owners.append(at)
                tag += 1
    both = np.where((lists[0][:, :, None] >= 0) & (lists[1][:, None, :] >= 0), lists[0][:, :, None] << 12 | lists[1][:, None, :], -1)
    at, a, b = np.nonzero(both >= 0)
    for piece in range(3):
        keys.append(np.int64(tag) << 40 | both[at, a, b] << 7 | (segments[2][at] >> (7 * piece)) & 127)
        owners.append(at)
        tag += 1
    return np.concatenate(keys), np.concatenate(owners)


def emit_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    golay = Golay()
    for b in batches:
        fps = b["fp"].to_numpy(np.int64)
        for at in range(0, len(fps), 4096):
            part = fps[at:at + 4096]
            key, owner = keys_of(part.view(np.uint64), golay)
            yield pd.DataFrame({"key": key, "fp": part[owner]})


def tree_edges(fps: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Breadth-first search over distinct fingerprints: edges (child, parent) of a spanning forest of all links."""
    left, children, parents = fps.view(np.uint64), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            head = queue.pop()
            near = np.bitwise_count(left ^ head) <= max_bits
            if near.any():
                found, left = left[near], left[~near]
                children.append(found.view(np.int64))
                parents.append(np.full(len(found), head, dtype=np.uint64).view(np.int64))
                queue.extend(found)
    return children, parents


def edges_of_runs(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def edges(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(key)])
            two = starts[sizes == 2]
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= max_bits
            children, parents = [a[near]], [b[near]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                c, p = tree_edges(np.unique(fp[s:s + n]), max_bits)
                children += c
                parents += p
            c, p = np.concatenate(children), np.concatenate(parents)
            out = pd.DataFrame({"u": np.maximum(c, p), "v": np.minimum(c, p)})
            return out[out.u != out.v].drop_duplicates()

        for batch in batches:
            key = np.r_[rest_key, batch["key"].to_numpy(np.int64)]
            fp = np.r_[rest_fp, batch["fp"].to_numpy(np.int64)]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            rest_key, rest_fp = key[last:], fp[last:]
            yield edges(key[:last], fp[:last])
        yield edges(rest_key, rest_fp)
    return run


def emit_ball(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    masks = np.array([sum(1 << b for b in bits) for n in range(3) for bits in combinations(range(64), n)], dtype=np.uint64)
    for b in batches:
        fps = b["fp"].to_numpy(np.int64)
        for at in range(0, len(fps), 64):
            part = fps[at:at + 64]
            yield pd.DataFrame({"mid": (part.view(np.uint64)[:, None] ^ masks).ravel().view(np.int64), "fp": np.repeat(part, len(masks))})


def links(classes: DataFrame, hot: int = HOT_KEY, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u > v) between distinct fingerprints (column ``fp``) whose components are those of all links."""
    if max_bits > MAX_BITS:
        raise ValueError("the keys are proved for at most 4 differing bits")
    rows = classes.select("fp").mapInPandas(emit_keys, "key long, fp long")
    seen = (classes.filter(F.pmod(F.xxhash64("fp"), F.lit(HOT_SAMPLE)) == 0).select("fp").mapInPandas(emit_keys, "key long, fp long")
            .groupBy("key").count().filter(F.col("count") > max(hot // HOT_SAMPLE, 1)).select("key"))
    seen = checkpoint(seen)
    found = None
    if not seen.isEmpty():
        if max_bits != MAX_BITS:
            raise ValueError("hot keys are met at distance 2 from both sides, which is exact for 4 bits only")
        members = rows.join(seen, "key", "left_semi").select("fp").distinct()
        balls = checkpoint(members.mapInPandas(emit_ball, "mid long, fp long"))
        least = balls.groupBy("mid").agg(F.min("fp").alias("v"))
        found = balls.join(least, "mid").select(F.col("fp").alias("u"), "v").filter("u != v").distinct()
        rows = rows.join(seen, "key", "left_anti")
    edges = rows.repartition("key").sortWithinPartitions("key").mapInPandas(edges_of_runs(max_bits), "u long, v long")
    return (edges if found is None else edges.unionByName(found)).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of its component.

    Alternating star contraction: large-star hangs a node's larger neighbours on its smallest neighbour, small-star
    the smaller ones. Both are a group minimum (combined before the shuffle) and an equi-join whose hub keys
    adaptive execution splits."""
    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = e.join(m, "u").filter("v > u" if large else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            hung = hung.unionByName(m.select("u", F.col("m").alias("v")))
        return hung.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = checkpoint(edges)
    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = checkpoint(stars(stars(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("star contraction didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_key: Column | None = None,
                   hot: int = HOT_KEY, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, row_key (null if none is given), fingerprint (16 hex digits), component (smallest
    fingerprint of the component, signed) and component_id (smallest id in it)."""
    docs = checkpoint(df.select(F.col(id_col).alias("id"), (F.lit(None).cast("long") if row_key is None else row_key).alias("row_key"),
                                fingerprint_udf(F.col(text_col)).alias("fp")))
    classes = checkpoint(docs.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    roots = components(links(classes, hot, max_bits))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    mapped = linked.select("fp", "root").join(least, "root")
    table = classes.join(mapped, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("component"),
        F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))
    return join_classes(docs, checkpoint(table), ["fp"], "n").select(F.col("id").alias(id_col), "row_key", hex16(F.col("fp")).alias("fingerprint"), "component", "component_id")
