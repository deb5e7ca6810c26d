"""Document fingerprints from prefix polynomial hashes.

A text's code points c_0, c_1, ... give prefix arrays P[i] = sum over j < i of c_j * b^j mod 2^31 - 1, for two bases. With
the powers of the inverse base, (P[j] - P[i]) * b^-i is the hash of the span [i, j) wherever it stands, so two spans of
equal length are compared in constant time, and the longest common extension of two positions is found by binary search
(both bases must agree: the chance of a false equality is about 2^-60 per comparison).

The fingerprint is the text's length and whole hash, and a bottom-``SKETCH`` sketch: the smallest distinct mixed hashes
of its spans of ``SPAN`` code points, read off the prefix array in one vector step. Equal texts have equal fingerprints.
The likeness of two fingerprints is the Dice coefficient of their span sets, estimated from the sketches (exact for
texts with no more spans than the sketch holds); 1 for equal texts, and 0 for an empty and a non-empty text.

``compare_next`` pairs each document with the next by descending id, without a global window: ids are cut at quantiles
into buckets, null ids by their text hash, rows are shuffled once by bucket and sorted, and the first row of each bucket is sent along to
the bucket before it as well. There are ``BUCKETS`` buckets, more where they would hold over ``BUCKET_BYTES`` of text; the
driver holds the bucket limits and one (id, hash) per bucket. Ids go to Python as text: pandas would round long ones
beside a null.

Defined cases: null texts are empty; a text shorter than a span is one span; null ids come last in the order, ties are
ordered by text hash; after the last document comes the first, so a table's only document is its own next; an empty
table gives an empty result; other columns are ignored. Memory is a few arrays per text, whatever its length.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULUS = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
SPAN = 8
SKETCH = 256
BUCKETS = 512
BUCKET_BYTES = 64 << 20
NULL_BUCKETS = 64


def reduced(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for values under 2^63."""
    p = np.uint64(MODULUS)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return np.where(x >= p, x - p, x)


class Powers:
    """Powers of the bases and their inverses, extended as longer texts come."""

    def __init__(self) -> None:
        self.rows = [np.ones(1, dtype=np.uint64) for _ in range(4)]
        self.steps = [*BASES, *(pow(b, -1, MODULUS) for b in BASES)]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.rows[0]) <= n:
            have = len(self.rows[0])
            self.rows = [np.concatenate([r, reduced(r * np.uint64(pow(s, have, MODULUS)))]) for r, s in zip(self.rows, self.steps)]
        return self.rows


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str, powers: Powers):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(self.codes)
        self.powers = powers.upto(self.n + 1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), reduced(np.cumsum(reduced(self.codes * self.powers[k][:self.n])))]) for k in range(2)]

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Hash of [i, j), the same wherever the span stands."""
        return tuple((int(self.sums[k][j]) - int(self.sums[k][i])) * int(self.powers[2 + k][i]) % MODULUS for k in range(2))

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common span that starts at i here and at j in ``other``."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def sketch(self) -> np.ndarray:
        """The smallest distinct mixed hashes of all spans of SPAN code points (of the whole text, if shorter)."""
        if not self.n:
            return np.empty(0, np.uint64)
        length = min(SPAN, self.n)
        count, best = self.n - length + 1, np.empty(0, np.uint64)
        for at in range(0, count, 1 << 20):
            end = min(count, at + (1 << 20))
            spans = reduced((self.sums[0][at + length:end + length] + np.uint64(MODULUS) - self.sums[0][at:end]) % np.uint64(MODULUS) * self.powers[2][at:end])
            mixed = (spans * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            few = 4 * SKETCH
            least = np.unique(np.partition(mixed, few)[:few] if len(mixed) > few else mixed)
            if len(least) < SKETCH and len(mixed) > few:
                least = np.unique(mixed)
            best = np.unique(np.concatenate([best, least[:SKETCH]]))[:SKETCH]
        return best

    def fingerprint(self) -> str:
        whole = self.span(0, self.n)
        return f"{self.n:x}.{whole[0]:08x}{whole[1]:08x}." + self.sketch().astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit(".", 1)[1]), dtype=">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)
    if len(x) == SKETCH or len(y) == SKETCH:
        union = union[:SKETCH]
    shared = len(np.intersect1d(np.intersect1d(x, y), union, assume_unique=True))
    j = shared / len(union)
    return 2 * j / (1 + j)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def fingerprint_udf():
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        powers = Powers()
        return pd.Series([PrefixHash(t or "", powers).fingerprint() for t in texts], dtype=object)
    return run


def bucket_limits(df: DataFrame, id_col: str, buckets: int) -> list[float]:
    if buckets < 2:
        return []
    found = df.select(F.col(id_col).cast("double").alias("v")).filter("v is not null").approxQuantile("v", [k / buckets for k in range(1, buckets)], 0.25 / buckets)
    return sorted(set(found))


def compare_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    common_next (length of the common prefix with the next text)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    if buckets is None:
        buckets = max(BUCKETS, -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    limits = bucket_limits(df, id_col, buckets)
    nulls = min(NULL_BUCKETS, buckets)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:  # descending ids; null ids behind, by descending hash
        return pd.Series([len(limits) - bisect_right(limits, int(i)) if i is not None else len(limits) + 1 + ((1 << 63) - 1 - int(h)) * nulls // (1 << 64)
                          for i, h in zip(ids, hashes)], dtype="int32")

    spelled = F.col("id").cast("string")
    heads = rows.select("id", "h", bucket_of(spelled, "h").alias("b")).groupBy("b").agg(F.max(F.struct("id", "h")).alias("m")).select("b", "m.id", "m.h").collect()
    heads.sort(key=lambda r: r["b"])
    before = {(r["id"], r["h"]): heads[k - 1]["b"] for k, r in enumerate(heads)}  # the bucket that a bucket's first row is sent to as well

    @F.pandas_udf("array<int>")
    def also(ids: pd.Series, hashes: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for i, h, b in zip(ids, hashes, own):
            extra = before.get((None if i is None else int(i), h))
            out.append([2 * b] if extra is None else [2 * b, 2 * extra + 1])
        return pd.Series(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, last = Powers(), None
        for batch in batches:
            out = []
            for i, text, spot in zip(batch["id"], batch["text"], batch["spot"]):
                b = spot // 2
                if last is not None and last[0] != b:
                    last = None
                if last is None and spot % 2:
                    continue  # a repeated copy of the next bucket's first row
                own = PrefixHash(text, powers)
                mark = own.fingerprint()
                if last is not None:
                    _, last_id, last_text, last_hash, last_mark = last
                    new = edited(last_text, text)
                    new_mark = PrefixHash(new, powers).fingerprint()
                    out.append((last_id, len(last_text), hashlib.sha256(new.encode("utf-8")).hexdigest(), last_mark, new_mark,
                                likeness(last_mark, new_mark), likeness(last_mark, mark), last_hash.common_extension(0, own, 0)))
                last = None if spot % 2 else (b, i, text, own, mark)
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_next"])

    spread = rows.withColumn("b", bucket_of(spelled, "h")).withColumn("spot", F.explode(also(spelled, "h", "b"))).select("id", "h", "text", "spot")
    spread = spread.withColumn("b", F.expr("spot div 2")).repartition("b").sortWithinPartitions("spot", F.col("id").desc_nulls_last(), F.col("h").desc())
    out = spread.select(spelled.alias("id"), "text", "spot").mapInPandas(run, "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_next long")
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)
