"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased, cut at white space and stripped of punctuation. A document's features are the hashes of its
distinct words, word stems (first letters), word pairs and pairs with one word between, into 2^``BITS`` places; places
of fewer than ``MIN_DOCS`` sampled documents aren't learned. The model is fitted by FTRL-proximal
with per-coordinate rates; its L1 term keeps places without evidence at exactly zero, so the fitted model is a short list
of (place, weight) that is broadcast (at most 2^``BITS`` entries of 12 bytes). Places beyond doubt are few, so scoring is
a look-up per feature; a place that occurs often in a text counts once.

Fitting uses a bounded sample of the labelled rows: at most about ``MAX_TRAIN`` documents, chosen by a hash of the id,
never by position. Only the ids and labels of the sample are broadcast to the scan of the documents; the sample is then
visited in hash order for ``EPOCHS`` passes in one task. Scoring reads whole texts of all rows in place, without a shuffle.

Defined cases: null and empty texts have no features and get the score of the bias; null ids are never sampled;
documents without a label are only scored; of a repeated id in the labels the larger label counts; without usable labels
the model is empty and every score is 0.5 to the bias 0, an empty table gives an empty result. Labels, lang, source and
id are never inputs of a score.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
STEMS = (4, 5)  # words are also counted by their first letters, whatever the ending
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
EPOCHS = 6
MIN_DOCS = 5
MAX_TRAIN = 20_000
THRESHOLD = 0.3
MAX_WORDS = 300_000
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_/\\«»“”…"
PAIR, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hasher:
    """Feature places of a text; keeps the hashes of words it has seen, up to MAX_WORDS."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, raw: str) -> tuple[int, ...]:
        import xxhash

        if len(self.known) >= MAX_WORDS:
            self.known.clear()
        word = raw.strip(PUNCTUATION)
        h = self.known[raw] = tuple(xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 7 + k) for k, w in enumerate((word, *(word[:n] for n in STEMS))))
        return h

    def places(self, text: str) -> np.ndarray:
        known, word = self.known, self.word
        raw = text.lower().split()
        hashes = np.array([known.get(w) or word(w) for w in raw], dtype=np.uint64).reshape(len(raw), 1 + len(STEMS))
        h = hashes[:, 0]
        mixed = [(hashes * PAIR).ravel(), (h[:-1] * SKIP + h[1:]) * PAIR, (h[:-2] * PAIR + (h[2:] ^ SKIP)) * SKIP]
        return (np.concatenate(mixed) >> np.uint64(64 - BITS)).astype(np.int64)


def logistic(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) of the nonzero weights. Place 2^BITS is the bias, which isn't shrunk by L1."""
    hasher = Hasher()
    rows = [np.unique(hasher.places(t)).astype(np.int32) for t in texts]
    docs = np.zeros(1 << BITS, dtype=np.int32)
    for at in rows:
        docs[at] += 1
    rows = [np.append(at[docs[at] >= MIN_DOCS], 1 << BITS) for at in rows]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    shrink = np.full(len(z), L1)
    shrink[-1] = 0.0

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= shrink[at], 0.0, -(zs - np.sign(zs) * shrink[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(rows, labels):
            w = weights(at)
            g = logistic(float(w.sum())) - y
            before = n[at]
            z[at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / ALPHA * w
            n[at] = before + g * g
    all_weights = weights(slice(None))
    places = np.flatnonzero(all_weights[:-1])
    return places, all_weights[places], float(all_weights[-1])


def score_text(hasher: Hasher, dense: np.ndarray, bias: float, text: str) -> float:
    places = hasher.places(text)
    hit = places[dense[places] != 0]
    return logistic(bias + float(dense[np.unique(hit)].sum()) if len(hit) else bias)


def remainder(id_col: Column, mod: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(mod))


def sample_labels(labels: DataFrame, label_col: str, usable: Column, max_train: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y, h) of at most about ``max_train`` usable labelled ids, chosen by the hash h of the id."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable).groupBy(F.col(id_col).alias("s_id")).agg(F.max(label_col).cast("int").alias("y"))
    share = min(1.0, max_train / max(rows.count(), 1))
    return rows.withColumn("h", F.pmod(F.xxhash64("s_id", F.lit(11)), F.lit(1 << 30))).filter(F.col("h") < int(share * (1 << 30)))


def training_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, y, text) of the sampled documents; of rows that share an id, one."""
    joined = docs.select(F.col(id_col).alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("d_id") == F.col("s_id"))
    return joined.dropDuplicates(["d_id"]).select("h", "y", "text")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", usable: Column | None = None, max_train: int = MAX_TRAIN,
          id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on the bounded sample, in one task of Spark; only the nonzero weights come to the driver."""
    rows = training_texts(docs, sample_labels(labels, label_col, F.lit(True) if usable is None else usable, max_train, id_col), id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat([pd.DataFrame({"h": [], "y": [], "text": []}), *batches]).sort_values(["h", "text"])
        if len(all_rows):
            places, weights, bias = fit(all_rows["text"].tolist(), all_rows["y"].astype(int).tolist())
            yield pd.DataFrame({"place": np.append(places, 1 << BITS), "weight": np.append(weights, bias)})

    model = rows.coalesce(1).mapInPandas(run, "place int, weight double").toPandas()
    bias = float(model.loc[model.place == 1 << BITS, "weight"].sum())
    model = model[model.place < 1 << BITS]
    return model["place"].to_numpy(np.int64), model["weight"].to_numpy(np.float64), bias


def score_column(spark, model: tuple[np.ndarray, np.ndarray, float]):
    shared = spark.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places, weights, bias = shared.value
        dense, hasher = np.zeros(1 << BITS, dtype=np.float64), Hasher()
        dense[places] = weights
        for texts in parts:
            yield pd.Series([score_text(hasher, dense, bias, t or "") for t in texts], dtype="float64")
    return run


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: id, held_out (crc32 of the id as text mod 4 is 2), score, predicted (score >= 0.3)."""
    model = train(docs, labels, "toxic", remainder(F.col("doc_id"), 4) != 2, max_train, id_col, text_col)
    score = score_column(docs.sparkSession, model)
    scored = docs.select(F.col(id_col), F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
