"""Quality classifier: supervised subword embeddings.

A document is three bags of hashed features: words and word pairs; the character n-grams of its words (with word
boundaries, case kept); and shape marks that tell for each word whether its 3-word window was seen before in the text,
whether it repeats the word before, and whether it is upper case. Every feature has a learned vector; a bag is the mean
of its vectors, the document the mean of its bags, and a softmax layer gives the class. All of it is trained by plain
stochastic gradient descent in numpy with a linearly falling rate.

Fitting uses a bounded sample of the labelled rows: at most about ``MAX_TRAIN`` documents, chosen by a hash of the id,
visited in an order shuffled by a fixed seed, in one task. The model is ``2^BITS`` vectors of ``DIM`` numbers (a fixed
size) and is broadcast. Scoring reads whole texts of all rows in place, without a shuffle; since the output is linear in
the vectors, a word's share of the output is computed once and kept by the worker.

Defined cases: null and empty texts have empty bags and get the score of the biases; null ids are never sampled;
documents without a label are only scored; of a repeated id in the labels the larger label counts; without usable labels
every score is 0.5; an empty table gives an empty result. Labels, lang, source and id are never inputs of a score.
"""
from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ragloom.llm.toxicity import remainder, sample_labels, training_texts

BITS = 17
DIM = 8
GRAMS = (3, 4)
RATE = 8.0
EPOCHS = 4
MAX_TRAIN = 12_000
THRESHOLD = 0.5
MAX_WORDS = 200_000
PAIR, TRIPLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MARKS = 8  # the first places of the table are the shape marks


def gram_places(word: str) -> list[int]:
    """Places of the character n-grams (over UTF-8 bytes) of a word with its boundaries."""
    bound = b"<" + word.encode("utf-8", "replace") + b">"
    size = (1 << BITS) - MARKS
    return [MARKS + crc32(bound[i:i + n]) % size for n in GRAMS for i in range(max(1, len(bound) - n + 1))]


class Features:
    """Hashed features of words; keeps what it has computed for a word, up to MAX_WORDS."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, list[int]]] = {}

    def word(self, w: str) -> tuple[int, list[int]]:
        """(64-bit hash, places of the character n-grams)."""
        if len(self.known) >= MAX_WORDS:
            self.known.clear()
        found = self.known[w] = (xxh64_intdigest(w.encode("utf-8", "replace")), gram_places(w))
        return found


def place(h: np.ndarray) -> np.ndarray:
    return (MARKS + h % np.uint64((1 << BITS) - MARKS)).astype(np.int64)


def pairs_of(h: np.ndarray) -> np.ndarray:
    return place((h[:-1] * PAIR + h[1:]) * TRIPLE >> np.uint64(20))


def marks_of(words: list[str], h: np.ndarray) -> np.ndarray:
    """Counts of the shape marks: window seen before or new, word repeats or changes, upper case or not."""
    windows = (h[:-2] * PAIR + h[1:-1]) * TRIPLE + h[2:]
    new = len(np.unique(windows))
    same = int((h[1:] == h[:-1]).sum())
    upper = sum(map(str.isupper, words))
    return np.array([len(windows) - new, new, same, max(len(h) - 1, 0) - same, upper, len(words) - upper, 0, 0], dtype=np.float64)


def bags(features: Features, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The three bags as (distinct places, shares that sum to 1); empty bags are left out."""
    known, word = features.known, features.word
    words = text.split()
    if not words:
        return []
    found = [known.get(w) or word(w) for w in words]
    h = np.array([f[0] for f in found], dtype=np.uint64)
    out = []
    for places in (np.concatenate([place(h), pairs_of(h)]), np.array([g for f in found for g in f[1]])):
        at, n = np.unique(places, return_counts=True)
        out.append((at, n / n.sum()))
    marks = marks_of(words, h)
    out.append((np.arange(MARKS), marks / marks.sum()))
    return out


class Model:
    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.vectors, self.output, self.bias = vectors, output, bias

    @staticmethod
    def blank() -> Model:
        rng = np.random.default_rng(5)
        return Model(rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)), rng.uniform(-0.5, 0.5, (2, DIM)), np.zeros(2))

    def hidden(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return sum((share @ self.vectors[at] for at, share in found), np.zeros(DIM)) / 3

    def probability(self, hidden: np.ndarray) -> np.ndarray:
        e = np.exp((o := self.output @ hidden + self.bias) - o.max())
        return e / e.sum()


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    model, features, rng = Model.blank(), Features(), np.random.default_rng(7)
    rows = [[(at.astype(np.int32), share) for at, share in bags(features, t)] for t in texts]
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = model.hidden(rows[k])
            error = model.probability(hidden)
            error[labels[k]] -= 1.0
            back = error @ model.output * (rate / 3)
            model.output -= 0.02 * rate * np.outer(error, hidden)
            model.bias -= 0.02 * rate * error
            for at, share in rows[k]:
                model.vectors[at] -= share[:, None] * back
    return model


class Scorer:
    """Scores texts with a fitted model. The output is linear in the vectors, so each place has one number: its part of
    the difference of the two outputs."""

    def __init__(self, model: Model):
        self.parts = model.vectors @ (model.output[1] - model.output[0]) / 3
        self.listed = self.parts.tolist()
        self.bias = float(model.bias[1] - model.bias[0])
        self.known: dict[str, tuple[int, float, int]] = {}

    def word(self, w: str) -> tuple[int, float, int]:
        """(64-bit hash, summed parts of the character n-grams, their number)."""
        if len(self.known) >= MAX_WORDS:
            self.known.clear()
        grams, listed = gram_places(w), self.listed
        found = self.known[w] = (xxh64_intdigest(w.encode("utf-8", "replace")), sum([listed[g] for g in grams]), len(grams))
        return found

    def score(self, text: str) -> float:
        words, out = text.split(), self.bias
        if words:
            known, word = self.known, self.word
            hashes, sums, counts = zip(*[known.get(w) or word(w) for w in words])
            h = np.array(hashes, dtype=np.uint64)
            first = self.parts[place(h)].sum() + self.parts[pairs_of(h)].sum()
            out += first / (2 * len(words) - 1) + sum(sums) / sum(counts)
            marks = marks_of(words, h)
            out += float(marks @ self.parts[:MARKS]) / marks.sum()
        return float(1 / (1 + np.exp(-np.clip(out, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", usable: Column | None = None, max_train: int = MAX_TRAIN,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the bounded sample, in one task of Spark; the model's numbers come to the driver."""
    rows = training_texts(docs, sample_labels(labels, label_col, F.lit(True) if usable is None else usable, max_train, id_col), id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat([pd.DataFrame({"h": [], "y": [], "text": []}), *batches]).sort_values(["h", "text"])
        if len(all_rows):
            m = fit(all_rows["text"].tolist(), all_rows["y"].astype(int).clip(0, 1).tolist())
            yield pd.DataFrame({"vectors": [m.vectors.astype("<f4").tobytes()], "rest": [np.vstack([m.output.T, m.bias]).astype("<f8").tobytes()]})

    found = rows.coalesce(1).mapInPandas(run, "vectors binary, rest binary").collect()
    if not found:
        return Model(np.zeros((1 << BITS, DIM)), np.zeros((2, DIM)), np.zeros(2))
    rest = np.frombuffer(bytes(found[0]["rest"]), "<f8").reshape(DIM + 1, 2)
    return Model(np.frombuffer(bytes(found[0]["vectors"]), "<f4").reshape(-1, DIM), rest[:DIM].T, rest[DIM])


def score_column(spark, model: Model):
    shared = spark.sparkContext.broadcast((model.vectors, model.output, model.bias))

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Model(*shared.value))
        for texts in parts:
            yield pd.Series([scorer.score(t or "") for t in texts], dtype="float64")
    return run


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: id, held_out (crc32 of the id as text mod 3 is 1), score, predicted (score >= 0.5)."""
    model = train(docs, labels, "quality", remainder(F.col("doc_id"), 3) != 1, max_train, id_col, text_col)
    score = score_column(docs.sparkSession, model)
    scored = docs.select(F.col(id_col), F.coalesce(remainder(F.col(id_col), 3) == 1, F.lit(False)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
