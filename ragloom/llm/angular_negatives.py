"""Hard-negative mining by angular triangle filtering.

Vectors are quantised to floor(scale * x); a score is an integer inner product. ``REFERENCES`` directions are fitted by
spherical k-means on a bounded sample; every row keeps its norm and its angles to all of them, and belongs to the cell of
the nearest. For two vectors the angles to a direction bound the angle between them by the triangle inequality:
|s - t| <= angle <= min(s + t, 2 pi - s - t). The cosines of both ends, times both norms and widened by more than any
rounding, hold the score. Within a cell the rows are sorted by their angle to its direction, so a wanted score gives a window by
binary search; inside the window all directions must agree; only what is left gets integer scoring.

Two passes over the stored rows, anchors and rows dealt in groups of bounded size:

1. *positives*: the rows of the anchor's label nearest in angle set the bar (their k-th best score); window and bounds
   leave the rows that can reach it. The groups' k best rows are merged.
2. *negatives*: every positive's score p gives the range [low * p, high * p] of its negatives' scores. The best rows of a few
   scored first set a bar per positive; a row is scored if its interval meets a range above its bar.

Bars only ever skip rows that can't be among the first, so the result is that of scoring all pairs. Anchors are a stated
query set against all rows, in blocks; a task holds ``vectors.GROUP_VALUES`` components and ``vectors.GROUP_QUERIES``
anchors, and a cell with more rows than that (copies of one vector, say) is spread over groups.

Defined cases: rows with a null id, label or vector, or a null or non-finite component (also after scaling) take no part.
Shorter vectors are filled up with zeros. Exact copies of a row (id, label and vector) count once; rows that share an id
and differ are rows each, and as an anchor the one with the smallest label, then vector, counts. An anchor's own id
is never its positive or negative. An empty table gives an empty result. Scores beyond 64 bits are computed exactly and
reported as the nearest long, from which the ranges then follow. Columns other than id, label and vector aren't read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragloom.llm import vectors
from ragloom.llm.common import checkpoint, stored

REFERENCES = 16
SAMPLE_ROWS = 4096
SLACK = 1e-5  # radians: more than the rounding of arc cosines kept as 32-bit floats
SEEDS = 256


def references(sample: np.ndarray, n: int, rounds: int = 15) -> np.ndarray:
    """Unit directions by spherical k-means, started from the sample's first rows."""
    norms = np.linalg.norm(sample, axis=1, keepdims=True)
    unit = (sample / np.where(norms > 0, norms, 1))[norms[:, 0] > 0]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    centres = unit[:n].copy()
    for _ in range(rounds):
        nearest = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def measured(ints: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles) of quantised vectors; a zero vector is at a right angle to everything."""
    most = np.abs(ints).max(axis=1, initial=0, keepdims=True)
    scaled = ints / np.where(most > 0, most, 1)  # no overflow in the squares
    norms = np.linalg.norm(scaled, axis=1)
    # summed row by row, so that copies of a row get equal angles whatever batch they stand in
    cosines = np.einsum("ij,kj->ik", scaled, directions) / np.where(norms > 0, norms, 1)[:, None]
    return norms * most[:, 0], np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


class Shape:
    """What every task needs to know: dimension, the directions, and how scores stay exact."""

    def __init__(self, dim: int, largest: float, scale: float, directions: np.ndarray):
        self.dim, self.scale, self.directions = dim, scale, directions
        bound = largest * scale + 1
        self.dtype = np.int16 if bound < 2 ** 15 else np.int32 if bound < 2 ** 31 else np.float64
        self.exact = max(dim, 1) * bound * bound < 2 ** 53  # then sums of doubles are exact in any order

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.exact:
            return rows.astype(np.float64) @ anchor.astype(np.float64)
        whole = [int(x) for x in anchor]
        return np.array([sum(int(x) * y for x, y in zip(r, whole)) for r in rows], dtype=object)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher scores first, ties by smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    if len(scores) > 4 * k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return among[np.lexsort((ids[among], -scores[among]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Cell:
    """The rows of a group, without exact copies, in the order of their angle to the cell's direction (with ``by_label``:
    within each label)."""

    def __init__(self, table: pa.Table, shape: Shape, by_label: bool):
        self.shape, self.ref = shape, table["cell"][0].as_py()
        ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
        ints = vectors.unpacked(table, "ints", shape.dtype, shape.dim)
        angles = vectors.unpacked(table, "angles", np.float32, len(shape.directions))
        order = np.lexsort((ids, angles[:, self.ref], labels) if by_label else (ids, angles[:, self.ref]))
        same = (ids[order][1:] == ids[order][:-1]) & (labels[order][1:] == labels[order][:-1])
        if same.any():  # copies have equal angles, so they are neighbours up to rows that share their id
            seen, single = set(), []
            for i in order.tolist():
                key = (ids[i], labels[i], ints[i].tobytes())
                if key not in seen:
                    seen.add(key)
                    single.append(i)
            order = np.array(single)
        self.ids, self.labels, self.ints, self.angles = ids[order], labels[order], ints[order], angles[order]
        self.norms = table["norm"].to_numpy()[order]
        self.own = np.ascontiguousarray(self.angles[:, self.ref])

    def window(self, start: int, stop: int, norm: float, angle: float, at_least: float) -> tuple[int, int]:
        """The part of start..stop whose angle to the cell's direction lets a score reach ``at_least``."""
        if stop <= start or not at_least > 0:
            return start, stop
        with np.errstate(over="ignore"):
            most = norm * self.norms[start:stop].max()
        share = at_least / most * (1 - 1e-9) if most > 0 else np.inf
        if share > 1:
            return start, start
        reach = np.arccos(share) + SLACK
        own = self.own[start:stop]
        return start + int(np.searchsorted(own, angle - reach)), start + int(np.searchsorted(own, angle + reach, "right"))

    def intervals(self, start: int, stop: int, norm: float, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores: cosine intervals by all directions, times the norms, widened past rounding."""
        rows = self.angles[start:stop]
        apart = np.abs(rows - angles).max(axis=1)
        together = (np.pi - np.abs(np.pi - (rows + angles))).min(axis=1)
        low, high = np.cos(np.minimum(together + SLACK, np.pi)), np.cos(np.maximum(apart - SLACK, 0))
        with np.errstate(over="ignore", invalid="ignore"):  # norms past the range of doubles: unbounded, nothing is skipped
            both = norm * self.norms[start:stop]
            return both * low - 1e-9 * both - 1, both * high + 1e-9 * both + 1

    def positives(self, anchor: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows of the anchor's label."""
        start, stop = np.searchsorted(self.labels, anchor["label"]), np.searchsorted(self.labels, anchor["label"], "right")
        at = start + np.searchsorted(self.own[start:stop], anchor["angles"][self.ref])
        near = np.arange(max(start, at - SEEDS // 8), min(stop, at + SEEDS // 8))
        near = near[self.ids[near] != anchor["id"]]
        bar = -np.inf
        if len(near) >= k:
            bar = np.sort(self.shape.scores(self.ints[near], anchor["ints"]))[len(near) - k]
        start, stop = self.window(start, stop, anchor["norm"], anchor["angles"][self.ref], bar)
        _, high = self.intervals(start, stop, anchor["norm"], anchor["angles"])
        left = start + np.flatnonzero(~(high < bar))  # an unbounded interval stays
        left = left[self.ids[left] != anchor["id"]]
        scores = self.shape.scores(self.ints[left], anchor["ints"])
        best = first(scores, self.ids[left], k)
        return self.ids[left][best], scores[best]

    def negatives(self, anchor: dict, ranges: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (lowest, highest) score the (ids, scores) of the k best rows of other labels within."""
        floor, ceiling = min(r[0] for r in ranges), max(r[1] for r in ranges)
        start, stop = self.window(0, len(self.ids), anchor["norm"], anchor["angles"][self.ref], floor)
        low, high = self.intervals(start, stop, anchor["norm"], anchor["angles"])
        left = start + np.flatnonzero(~(high < floor) & ~(low > ceiling) & (self.labels[start:stop] != anchor["label"]) & (self.ids[start:stop] != anchor["id"]))
        if len(left) > 2 * SEEDS:  # a few are scored first: their k-th best within a range is the bar of that range
            few = left[np.argsort(-high[left - start], kind="stable")[:SEEDS]]
            scores = self.shape.scores(self.ints[few], anchor["ints"])
            bars = []
            for lowest, highest in ranges:
                held = np.sort(scores[(scores >= lowest) & (scores <= highest)])
                bars.append(held[-k] if len(held) >= k else lowest)
            left = left[~(high[left - start] < min(bars))]
        scores = self.shape.scores(self.ints[left], anchor["ints"])
        out = []
        for lowest, highest in ranges:
            held = np.flatnonzero((scores >= lowest) & (scores <= highest))
            best = held[first(scores[held], self.ids[left][held], k)]
            out.append((self.ids[left][best], scores[best]))
        return out


def longs(values) -> pa.Array:
    return pa.array([max(-2 ** 63, min(2 ** 63 - 1, int(v))) for v in values], pa.int64())


class Mining:
    """Anchors, positives and negatives of a table; ``anchors`` and ``rows`` have the columns id, label and vector."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, id_col: str, label_col: str, vec_col: str, positives: int = 5, negatives: int = 10,
                 low_percent: int = 30, high_percent: int = 90, scale: float = 256.0):
        self.k, self.n, self.percent = positives, negatives, (low_percent, high_percent)

        def taking_part(df: DataFrame) -> DataFrame:
            named = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
            scaled = F.transform("vec", lambda x: x.cast("double") * scale)
            return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & vectors.usable(scaled))

        rows = taking_part(rows)
        s = rows.agg(F.max(F.size("vec")).alias("dim"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("most"), F.count(F.lit(1)).alias("n")).first()
        asked = taking_part(anchors).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("m")).select("id", "m.label", "m.vec")
        widest = asked.agg(F.max(F.size("vec")).alias("dim"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("most"), F.count(F.lit(1)).alias("n")).first()
        dim, most = max(s["dim"] or 0, widest["dim"] or 0, 1), max(s["most"] or 0.0, widest["most"] or 0.0)
        fitted = references(vectors.sample(rows, "id", "vec", dim, SAMPLE_ROWS), REFERENCES)
        self.shape = Shape(dim, most, scale, fitted)
        self.query_groups = vectors.query_groups(widest["n"])
        self.rows = stored(self.angles(rows), "angles")
        self.anchors = stored(self.angles(asked), "anchors")
        counts = {r["cell"]: r["count"] for r in self.rows.groupBy("cell").count().collect()}  # a row per direction
        self.plan, self.groups = vectors.group_plan(counts, dim, bundle=False)

    def angles(self, rows: DataFrame) -> DataFrame:
        """id, label, the quantised vector, norm, angles to all directions and the nearest of them."""
        shape = self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ints = np.floor(vectors.matrix(b.column("vec"), shape.dim) * shape.scale)
                norms, angles = measured(ints, shape.directions)
                cell = pa.array(np.argmin(angles, axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), vectors.packed(ints, shape.dtype), pa.array(norms), vectors.packed(angles, np.float32), cell],
                                                 ["id", "label", "ints", "norm", "angles", "cell"])

        return rows.mapInArrow(run, "id long, label long, ints binary, norm double, angles binary, cell int")

    def dealt(self, anchors: DataFrame, work, schema: str, by_label: bool) -> DataFrame:
        """``work(cell, anchor)`` gives rows for every anchor and every group of rows, side by side in a task."""
        shape = self.shape
        corpus = vectors.deal(self.rows, self.plan, "id", self.query_groups)
        asked = anchors.withColumn("qg", vectors.query_group("id", self.query_groups)).withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(max(self.groups, 1) - 1))))
        names = [f.split()[0] for f in schema.split(", ")]

        def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
            out = [[] for _ in names]
            if rows.num_rows and asked.num_rows:
                cell = Cell(rows, shape, by_label)
                ints = vectors.unpacked(asked, "ints", shape.dtype, shape.dim)
                angles = vectors.unpacked(asked, "angles", np.float32, len(shape.directions))
                rest = asked.drop_columns(["ints", "angles"]).to_pylist()
                for i, anchor in enumerate(rest):
                    for values in work(cell, anchor | {"ints": ints[i], "angles": angles[i]}):
                        for column, value in zip(out, values):
                            column.append(value)
            return pa.table([longs(c) if t == "long" else pa.array(c, pa.int32()) for c, t in zip(out, (f.split()[1] for f in schema.split(", ")))], names=names)

        return corpus.groupBy("qg", "cg").cogroup(asked.groupBy("qg", "cg")).applyInArrow(run, schema)

    def positive_rows(self) -> DataFrame:
        """anchor_id, place (from 1), positive_id, positive_score."""
        k = self.k

        def work(cell: Cell, anchor: dict):
            for other, score in zip(*cell.positives(anchor, k)):
                yield anchor["id"], other, score

        found = self.dealt(self.anchors, work, "anchor_id long, positive_id long, positive_score long", by_label=True)
        best = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)

    def negative_rows(self) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, place."""
        n, (low, high) = self.n, self.percent
        held = checkpoint(self.positive_rows())
        lists = held.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))  # k at most
        anchors = self.anchors.join(lists.withColumnRenamed("anchor_id", "id"), "id")

        def work(cell: Cell, anchor: dict):
            # the least and greatest integers within low..high percent of the positive's score
            ranges = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in anchor["positives"]]
            open_ = [(p, r) for p, r in zip(anchor["positives"], ranges) if r[0] <= r[1]]
            if open_:
                for (p, _), (ids, scores) in zip(open_, cell.negatives(anchor, [r for _, r in open_], n)):
                    for other, score in zip(ids, scores):
                        yield anchor["id"], p["place"], p["positive_id"], other, p["positive_score"], score

        found = self.dealt(anchors, work, "anchor_id long, place int, positive_id long, negative_id long, positive_score long, negative_score long", by_label=False)
        best = W.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "place")


def relabelled(rows: DataFrame) -> DataFrame:
    """Where vec_id is divisible by 7, the next of ten labels; null ids and labels stay."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def report(rows: DataFrame) -> DataFrame:
    """The negatives of all rows whose vec_id is divisible by 100."""
    rows = relabelled(rows.select("vec_id", "embedding", "label"))
    found = Mining(rows, rows.filter(F.col("vec_id") % 100 == 0), "vec_id", "label", "embedding").negative_rows()
    return found.drop("place")


SQL = """
WITH parts AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM parts a JOIN parts c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM scored WHERE same) t
  WHERE place <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS place
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id
  WHERE NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= 10
"""
