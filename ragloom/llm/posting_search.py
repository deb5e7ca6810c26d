"""Approximate nearest neighbours by balanced posting lists.

*Lists*. A bounded sample is halved again and again along its main spread (by two centres, at the median), so all lists get
about as many sample vectors; a list's centroid is their mean. The centroids, held in memory, form a graph: each is linked
to its ``LINKS`` nearest, and both halves of every cut keep their nearest pair as a link, so the graph is connected. It is searched best
first, from the leaf that the halving leads to; ``EXPLORE`` more centroids than needed are expanded before a search ends.

*Postings*. Every row goes to its nearest list, and boundary rows to further ones: all lists whose centroid is at most
``BOUNDARY`` times as far, unless the centroid of a list already taken is within ``NEAR`` of the row's distance to that centroid (a query
visits both or neither). A row so stands in ``COPIES`` lists at most, and always in its nearest.

*Search*. A query visits the lists whose centroid is at most ``ratio`` times as far as the nearest centroid. The ratio is
calibrated: for ``CALIBRATION`` queries the nearest rows are found by brute force over all rows, together with the
ratio at which each is met; the ``TARGET`` quantile of these ratios is used. Distances are exact, in doubles, on the original vectors.

Queries and postings are dealt in groups of bounded size (small lists next to each other share a group; a list with more
rows than a group may hold is spread over groups), so a hot list isn't one task. A task keeps the best rows of its group for each query;
replicas and the groups' results are merged by Spark. Centroids and graph are bounded by ``MOST_LISTS``, whatever the input.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, as query or row, nor do rows
with a null id. Shorter vectors are filled up with zeros. An id that stands in several rows counts once, at its least distance; a
query with several rows is the one with the smallest vector. A query's own id is never found. Ties go to the
smaller id. An empty table gives an empty result. Columns other than id and vector aren't read.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragloom.llm import vectors
from ragloom.llm.common import stored

SAMPLE_ROWS = 16384
LIST_ROWS = 128  # wanted rows a list, as long as MOST_LISTS isn't reached
MOST_LISTS = 2048
LINKS = 12
EXPLORE = 8
BOUNDARY = 1.1
NEAR = 0.5
COPIES = 4
CALIBRATION = 128
TARGET = 0.96


def halved(sample: np.ndarray, n_lists: int) -> tuple[np.ndarray, list]:
    """(centroids, cuts): the sample halved until there are ``n_lists`` parts. A cut is (direction, offset, left, right), a part
    -1 - its number; the first cut is the last one listed."""
    centroids, cuts = [], []

    def part(rows: np.ndarray, wanted: int) -> int:
        if wanted <= 1 or len(rows) < 2:
            centroids.append(rows.mean(axis=0))
            return -len(centroids)
        centre = rows.mean(axis=0)
        far = rows[np.argmax(((rows - centre) ** 2).sum(axis=1))]
        other = rows[np.argmax(((rows - far) ** 2).sum(axis=1))]
        for _ in range(4):  # two centres; the halves stay equal
            direction = other - far
            along = rows @ direction
            order = np.argsort(along, kind="stable")
            low, high = rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]
            far, other = low.mean(axis=0), high.mean(axis=0)
        offset = (along[order[len(rows) // 2 - 1]] + along[order[len(rows) // 2]]) / 2
        left, right = part(low, wanted // 2), part(high, wanted - wanted // 2)
        cuts.append((direction, offset, left, right))
        return len(cuts) - 1

    part(sample, n_lists)
    return np.array(centroids), cuts


def linked(centroids: np.ndarray, cuts: list) -> list[np.ndarray]:
    """Neighbours of every centroid, both ways."""
    n = len(centroids)
    squares = (centroids ** 2).sum(axis=1)
    apart = squares[:, None] + squares[None, :] - 2 * centroids @ centroids.T
    np.fill_diagonal(apart, np.inf)
    links = [set() for _ in range(n)]

    def tie(a: int, b: int) -> None:
        links[a].add(b)
        links[b].add(a)

    for i in range(n):
        for j in np.argsort(apart[i], kind="stable")[:min(LINKS, n - 1)]:
            tie(i, int(j))
    members: dict[int, list[int]] = {}
    for k, (_, _, left, right) in enumerate(cuts):
        sides = [[-1 - s] if s < 0 else members[s] for s in (left, right)]
        between = apart[np.ix_(*sides)]
        a, b = np.unravel_index(np.argmin(between), between.shape)
        tie(sides[0][a], sides[1][b])
        members[k] = sides[0] + sides[1]
    return [np.array(sorted(s), dtype=np.int64) for s in links]


class Lists:
    """Centroids, the halving that leads to an entry point, and the graph."""

    def __init__(self, sample: np.ndarray, n_lists: int):
        self.centroids, self.cuts = halved(sample, n_lists)
        self.links = linked(self.centroids, self.cuts)
        self.between = None

    def entries(self, rows: np.ndarray) -> np.ndarray:
        """The list that the halving leads each row to."""
        at = np.full(len(rows), len(self.cuts) - 1 if self.cuts else -1)
        while (at >= 0).any():
            for node in np.unique(at[at >= 0]):
                here = np.flatnonzero(at == node)
                direction, offset, left, right = self.cuts[node]
                at[here] = np.where(rows[here] @ direction <= offset, left, right)
        return -1 - at

    def search(self, row: np.ndarray, entry: int, ratio: float) -> list[tuple[float, int]]:
        """(distance, list), nearest first, of the centroids at most ``ratio`` times as far as the nearest: best-first search of the
        graph, over once ``EXPLORE`` centroids in a row were out of reach."""
        seen = np.zeros(len(self.centroids), bool)
        seen[entry] = True
        start = float(np.sqrt(((self.centroids[entry] - row) ** 2).sum()))
        waiting, found, nearest, beyond = [(start, entry)], [], start, 0
        while waiting and beyond < EXPLORE:
            distance, at = heapq.heappop(waiting)
            found.append((distance, at))
            beyond = 0 if distance <= ratio * nearest else beyond + 1
            new = self.links[at]
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                far = np.sqrt(((self.centroids[new] - row) ** 2).sum(axis=1))
                nearest = min(nearest, float(far.min()))
                for d, j in zip(far.tolist(), new.tolist()):
                    heapq.heappush(waiting, (d, j))
        return sorted(f for f in found if f[0] <= ratio * nearest)

    def places(self, row: np.ndarray, entry: int) -> list[int]:
        """The lists that a row stands in: the nearest, and further ones on its boundary."""
        near = self.search(row, entry, BOUNDARY)
        taken = [near[0][1]]
        for distance, at in near[1:]:
            if len(taken) == COPIES:
                break
            if (((self.centroids[taken] - self.centroids[at]) ** 2).sum(axis=1) > (NEAR * distance) ** 2).all():
                taken.append(at)
        return taken


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def nearest(ids: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest, ties by smaller id, each id once."""
    if len(far) > 4 * k * COPIES:
        among = np.flatnonzero(far <= np.partition(far, k * COPIES - 1)[k * COPIES - 1])
        if len(np.unique(ids[among])) >= k:
            order = among[np.lexsort((ids[among], far[among]))]
        else:
            order = np.lexsort((ids, far))
    else:
        order = np.lexsort((ids, far))
    _, at = np.unique(ids[order], return_index=True)
    return order[np.sort(at)][:k]


class Index:
    """Posting lists over a table, stored in the shared checkpoint folder."""

    def __init__(self, rows: DataFrame, id_col: str, vec_col: str, n_lists: int | None = None):
        rows = self.taking_part(rows, id_col, vec_col)
        s = rows.agg(F.max(F.size("vec")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
        self.n, self.dim = s["n"], max(s["dim"] or 0, 1)
        fitted = vectors.sample(rows, "id", "vec", self.dim, SAMPLE_ROWS)
        if not len(fitted):
            fitted = np.zeros((1, self.dim))
        wanted = n_lists or max(1, min(MOST_LISTS, self.n // LIST_ROWS))
        self.lists = Lists(fitted, min(wanted, len(fitted)))
        self.postings = stored(self.post(rows), "postings")
        counts = {r["cell"]: r["count"] for r in self.postings.groupBy("cell").count().collect()}  # a row per list
        self.plan, self.groups = vectors.group_plan(counts, self.dim, bundle=True)

    @staticmethod
    def taking_part(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return named.filter(F.col("id").isNotNull() & vectors.usable(F.col("vec")) & F.exists("vec", lambda x: x != 0))

    def post(self, rows: DataFrame) -> DataFrame:
        lists, dim = self.lists, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data = vectors.matrix(b.column("vec"), dim)
                places = [lists.places(x, e) for x, e in zip(data, lists.entries(data))]
                at = np.repeat(np.arange(len(places)), [len(p) for p in places])
                yield pa.RecordBatch.from_arrays([pa.array([c for p in places for c in p], pa.int32()), b.column("id").take(pa.array(at)), vectors.packed(data[at], np.float64)],
                                                 ["cell", "id", "vec"])

        return rows.mapInArrow(run, "cell int, id long, vec binary")

    def calibrated(self, queries: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[float, float]:
        """(ratio, recall): the ratio that finds TARGET of the true k nearest rows of the calibration queries, by brute force, and the
        share that it finds."""
        picked = self.taking_part(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
        picked = picked.orderBy(F.xxhash64("id")).limit(CALIBRATION).collect()
        asked = np.zeros((len(picked), self.dim))
        for i, r in enumerate(picked):
            asked[i, :len(r["vec"])] = r["vec"][:self.dim]
        own = np.array([r["id"] for r in picked], dtype=np.int64)
        if not len(picked):
            return 1.0, 1.0
        far = np.array([distances(self.lists.centroids, q) for q in asked])
        ratios = far / np.maximum(far.min(axis=1, keepdims=True), 1e-300)
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = [(np.empty(0, np.int64), np.empty(0), np.empty(0))] * len(asked)
            for b in batches:
                data = vectors.unpacked(pa.table([b.column("vec")], ["vec"]), "vec", np.float64, dim)
                ids, cells = b.column("id").to_numpy(), b.column("cell").to_numpy()
                for q, query in enumerate(asked):
                    near = np.flatnonzero(ids != own[q])
                    d = distances(data[near], query)
                    i, d, met = (np.concatenate(x) for x in zip(kept[q], (ids[near], d, ratios[q][cells[near]])))
                    best = np.isin(i, i[nearest(i, d, k)])  # with all replicas
                    kept[q] = (i[best], d[best], met[best])
            for q, (i, d, met) in enumerate(kept):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), q, np.int32)), pa.array(i), pa.array(d), pa.array(met)], ["q", "id", "d", "met"])

        found = self.postings.mapInArrow(run, "q int, id long, d double, met double").groupBy("q", "id").agg(F.min("d").alias("d"), F.min("met").alias("met"))
        first = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "id"))).filter(F.col("rank") <= k)
        met = np.sort([r["met"] for r in first.select("met").collect()])  # k per calibration query
        if not len(met):
            return 1.0, 1.0
        ratio = float(met[min(len(met) - 1, int(np.ceil(TARGET * len(met))) - 1)])
        return ratio, float((met <= ratio).mean())

    def search(self, queries: DataFrame, id_col: str, vec_col: str, k: int, ratio: float) -> DataFrame:
        """query_id, rank, vec_id, score: the nearest found rows of every query."""
        asked = self.taking_part(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
        s = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
        if (s["dim"] or 0) > self.dim:
            raise ValueError(f"a query has {s['dim']} numbers, the index {self.dim}")
        n_groups = vectors.query_groups(s["n"])
        lists, dim, plan = self.lists, self.dim, {cell: (first, pieces) for cell, first, pieces in self.plan}

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data = vectors.matrix(b.column("vec"), dim)
                at, groups, cells = [], [], []
                for i, (x, e) in enumerate(zip(data, lists.entries(data))):
                    held: dict[int, list[int]] = {}
                    for _, cell in lists.search(x, e, ratio):
                        first, pieces = plan.get(cell, (0, 0))
                        for g in range(first, first + pieces):
                            held.setdefault(g, []).append(cell)
                    for g, c in held.items():
                        at.append(i)
                        groups.append(g)
                        cells.append(c)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), vectors.packed(data[at], np.float64), pa.array(groups, pa.int32()),
                                                  pa.array(cells, pa.list_(pa.int32()))], ["id", "vec", "cg", "cells"])

        def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
            out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            if rows.num_rows and asked.num_rows:
                cells = rows["cell"].to_numpy()
                order = np.argsort(cells, kind="stable")
                cells, ids = cells[order], rows["id"].to_numpy()[order]
                data = vectors.unpacked(rows, "vec", np.float64, dim)[order]
                queries = vectors.unpacked(asked, "vec", np.float64, dim)
                for own, query, visited in zip(asked["id"].to_pylist(), queries, asked["cells"].to_pylist()):
                    spans = zip(np.searchsorted(cells, visited), np.searchsorted(cells, visited, "right"))
                    at = np.concatenate([np.arange(a, b) for a, b in spans])
                    at = at[ids[at] != own]
                    d = distances(data[at], query)
                    best = nearest(ids[at], d, k)
                    out.append((np.full(len(best), own, np.int64), ids[at][best], d[best]))
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

        kinds = "id long, vec binary, cg int, cells array<int>"
        visits = asked.mapInArrow(wanted, kinds).withColumn("qg", vectors.query_group("id", n_groups))
        corpus = vectors.deal(self.postings, self.plan, "id", n_groups)
        found = corpus.groupBy("qg", "cg").cogroup(visits.groupBy("qg", "cg")).applyInArrow(meet, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # replicas, and rows that share an id
        best = W.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest found rows of every row whose vec_id is divisible by 100."""
    asked = rows.filter(F.col("vec_id") % 100 == 0)
    index = Index(rows, "vec_id", "embedding")
    ratio, _ = index.calibrated(asked, "vec_id", "embedding", k)
    return index.search(asked, "vec_id", "embedding", k, ratio)
