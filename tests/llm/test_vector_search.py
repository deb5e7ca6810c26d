"""Hard negatives and posting lists against brute force, and their defined cases."""
import math
import random

import numpy as np
import pytest

from ragloom.llm import angular_negatives, posting_search, queries, vectors

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)


def brute_negatives(rows):
    """rows: (vec_id, embedding, label). Whole-number scores, one pair at a time."""
    parts = set()
    for i, v, label in rows:
        if i is None or label is None or not usable(v):
            continue
        parts.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(v)))
    anchors = {}
    for i, label, v in sorted(parts):
        if i % 100 == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for i, (label, v) in anchors.items():
        a = [math.floor(256 * x) for x in v]
        scored = sorted((-sum(x * math.floor(256 * y) for x, y in zip(a, w)), j, other) for j, other, w in parts if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(n, t) for t, n, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, rank, n, -s, -t) for rank, (n, t) in enumerate(fit, 1)]
    return sorted(out)


def odd_rows():
    rnd = random.Random(7)
    rows = [(i, [round(rnd.gauss(0.3 * (i % 3), 0.4), 3) for _ in range(6)], i % 4) for i in range(330)]
    rows += [(1000 + i, [0.5, 0.5, 0.0, 0.0, 0.25, 0.0], i % 3) for i in range(120)]  # one vector in a quarter of the rows
    rows += rows[:40]  # exact copies
    rows += [(200, [0.1] * 6, 0), (200, [0.1] * 6, 3), (5, [0.9] * 6, 1), (5, [0.9] * 6, 2)]  # ids with several rows
    rows += [(500, None, 1), (600, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1), (700, [0.1, NAN, 0.2, 0.0, 0.0, 0.0], 1), (800, [INF] * 6, 1), (900, [0.1] * 6, None),
             (None, [0.3] * 6, 1), (1300, [0.0] * 6, 1), (1400, [], 2), (1500, [0.5, 0.5], 1), (-100, [0.2] * 6, 3), (2**60 + 1, [0.4] * 6, 1), (2**60, [0.4] * 6, 1)]
    return rows


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("small_groups", [False, True])
def test_negatives_against_brute_force(spark, monkeypatch, small_groups):
    if small_groups:  # cells split over groups, anchors dealt in blocks
        monkeypatch.setattr(vectors, "GROUP_VALUES", 300)
        monkeypatch.setattr(vectors, "GROUP_QUERIES", 2)
        monkeypatch.setattr(angular_negatives, "SEEDS", 16)
    rows = odd_rows()
    for kind in ("array<double>", "array<float>"):
        df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], f"vec_id long, embedding {kind}, label int, cell string, id int").repartition(3)
        read = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
        got = angular_negatives.report(df)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert result(got) == brute_negatives(read)


def test_negatives_of_very_large_components_and_of_no_rows(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(0, 6) for _ in range(4)], i % 2) for i in range(120)]  # scores above 2^53
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(angular_negatives.report(df)) == brute_negatives(rows)
    huge = df.limit(20).unionByName(spark.createDataFrame([(100, [1e300] * 4, 0), (300, [1e290, 0.0, 1.0, 2.0], 0)], df.schema))
    assert angular_negatives.report(huge).count() >= 0  # no crash; scores end at the greatest long
    for none in (df.limit(0), df.filter("vec_id % 100 <> 0"), spark.createDataFrame([(0, None, 1), (100, [NAN], 1)], df.schema)):
        assert angular_negatives.report(none).collect() == []


def test_scores_stay_within_their_intervals():
    rng = np.random.default_rng(2)
    ints = np.floor(rng.normal(size=(400, 12)) * 10.0 ** rng.integers(0, 5, size=(400, 1)))
    directions = angular_negatives.references(ints, 8)
    norms, angles = angular_negatives.measured(ints, directions)
    cell = object.__new__(angular_negatives.Cell)
    cell.angles, cell.norms, cell.own = angles, norms, angles[:, 0]
    order = np.argsort(cell.own)
    for i in range(0, 400, 17):
        low, high = cell.intervals(0, 400, norms[i], angles[i])
        scores = ints @ ints[i]
        assert (low <= scores).all() and (scores <= high).all()
        cell.own, cell.norms = angles[order, 0], norms[order]
        bar = np.sort(scores)[-20]
        a, b = cell.window(0, 400, norms[i], angles[i, 0], bar)
        assert set(np.flatnonzero(scores >= bar)) <= set(order[a:b])
        cell.own, cell.norms = angles[:, 0], norms


def brute_nearest(rows, k):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            held.setdefault(i, []).append(np.array(v))
    out = {}
    for q in held:
        if q % 100 == 0:
            query = min(held[q], key=tuple)
            far = sorted((min(math.sqrt(((v - query) ** 2).sum()) for v in vs), i) for i, vs in held.items() if i != q)
            out[q] = far[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("small_groups", [False, True])
def test_posting_search_over_all_lists_is_exact(spark, monkeypatch, small_groups):
    if small_groups:
        monkeypatch.setattr(vectors, "GROUP_VALUES", 400)
        monkeypatch.setattr(vectors, "GROUP_QUERIES", 2)
    rows = [(i, v) for i, v, _ in odd_rows() if v is None or len(v) in (0, 6)]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, cell string, id int").repartition(3)
    index = posting_search.Index(df, "vec_id", "embedding", n_lists=16)
    got = found(index.search(df.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, ratio=1e9))
    assert got == brute_nearest(rows, 10)  # distances to the last bit


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1", "check_s"])
def test_recall_of_the_registered_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").collect()]
    data = np.array([v for _, v in rows], dtype=np.float64)
    ids = np.array([i for i, _ in rows])
    got = found(queries.QUERIES["op13_posting_search"](spark, f"/root/testdata/{folder}"))
    hits = wanted = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((data - data[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        assert all(s == far[ids == i][0] for s, i in got[q])
        hits += len({i for _, i in got[q]} & set(ids[order].tolist()))
        wanted += len(order)
    print(folder, "recall", hits / wanted)
    assert hits / wanted >= 0.9 and set(got) == set(ids[ids % 100 == 0].tolist())


def test_boundary_rows_stand_in_several_lists_and_the_graph_finds_the_nearest():
    rng = np.random.default_rng(5)
    data = rng.normal(size=(3000, 8))
    lists = posting_search.Lists(data, 64)
    assert len(lists.centroids) == 64
    assert np.bincount(lists.entries(data), minlength=64).max() <= 1.2 * 3000 / 64  # balanced
    reached, todo = {0}, [0]
    while todo:
        for j in lists.links[todo.pop()]:
            if int(j) not in reached:
                reached.add(int(j))
                todo.append(int(j))
    assert len(reached) == 64
    asked = rng.normal(size=(300, 8))
    right = several = 0
    for x, e in zip(asked, lists.entries(asked)):
        far = np.sqrt(((lists.centroids - x) ** 2).sum(axis=1))
        near = lists.search(x, e, 1.2)
        right += near[0][1] == int(np.argmin(far))
        assert all(d == far[i] and d <= 1.2 * near[0][0] for d, i in near)
        several += len(lists.places(x, e)) > 1
    assert right >= 0.97 * 300 and 0 < several < 300


def test_posting_search_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    none = spark.createDataFrame([], schema)
    assert posting_search.report(none).collect() == []
    unusable = spark.createDataFrame([(0, None, 1), (100, [0.0, 0.0], 1), (200, [NAN, 1.0], 1), (300, [1.0, None], 2)], schema)
    assert posting_search.report(unusable).collect() == []
    one = spark.createDataFrame([(0, [1.0, 0.0], 1)], schema)
    assert posting_search.report(one).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(300)], schema)
    got = found(posting_search.report(same))
    assert got == {q: [(0.0, i) for i in range(300) if i != q][:10] for q in (0, 100, 200)}
