"""Exact values at ranks against sorting, mergeable sketches against exact ranks, the threshold histogram."""
import random

import numpy as np
import pytest

from ragloom.operators import evaluation as E
from ragloom.operators import latency as L
from ragloom.operators import sketches as S

PS = (0.0, 0.1, 0.5, 0.7, 0.95, 1.0)


def rows():
    rnd = random.Random(3)
    out = [("a", rnd.gauss(100, 30)) for _ in range(6000)] + [("b", float(rnd.randint(1, 4))) for _ in range(5000)]
    out += [("c", 7.5)] * 3000 + [("d", 1.0)] + [(None, rnd.random()) for _ in range(50)] + [("e", None)] * 5 + [("a", None)] * 9
    out += [("f", rnd.choice([1e-9, 1.0, 1e12]) * rnd.random()) for _ in range(4000)]
    return out


@pytest.mark.parametrize("few", [4096, 40])
def test_percentiles_without_a_sort(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    data = rows()
    df = spark.createDataFrame(data, "stage string, ms double").repartition(5)
    names = [f"x{i}" for i in range(len(PS))]
    linear = {r.stage: r for r in L.percentiles(df, ["stage"], "ms", PS, names=names, with_n=True).collect()}
    nearest = {r.stage: r for r in L.percentiles(df, ["stage"], "ms", PS, method="nearest", names=names).collect()}
    assert set(linear) == set(nearest) == {"a", "b", "c", "d", "f", None}
    for g in linear:
        v = np.sort([x for s, x in data if s == g and x is not None])
        assert linear[g].n == len(v)
        assert [linear[g][n] for n in names] == pytest.approx(np.percentile(v, [100 * p for p in PS]).tolist(), rel=1e-12)
        assert [nearest[g][n] for n in names] == [v[min(len(v) - 1, round(p * (len(v) - 1)))] for p in PS]


def test_a_bracket_that_misses_its_rank_is_tried_again(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW", 10)
    monkeypatch.setattr(S, "RANK_ERROR", 1e-7)  # far less than the sketch's error
    monkeypatch.setattr(S, "SKETCH_K", 8)
    v = np.random.default_rng(1).permutation(20000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "ms double")
    from pyspark.sql import functions as F

    got = S.values_at_ranks(df, [], "ms", lambda n: F.array(F.lit(0), F.lit(777), F.lit(10000), n - 1, n)).collect()
    assert sorted((r["_rank"], r["value"]) for r in got) == [(0, 0.0), (777, 777.0), (10000, 10000.0), (19999, 19999.0)]


def test_no_rows_and_no_range_partitioning(spark):
    df = spark.createDataFrame([], "stage string, ms double")
    p = L.percentiles(df, ["stage"], "ms")
    assert p.collect() == []
    assert "rangepartitioning" not in L.percentiles(spark.createDataFrame(rows(), df.schema), ["stage"], "ms")._jdf.queryExecution().executedPlan().toString()


def test_merged_sketches_stay_within_their_rank_error(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").selectExpr("event_type as stage", "ts", "value as ms")
    fine = S.sketch_windows(e, ["stage"], "ts", "ms", "10 minutes")
    exact = {}
    for r in e.collect():
        exact.setdefault(r.stage, []).append(r.ms)
    for unit in ("hour", "day", None):
        merged = S.merge_windows(fine, ["stage"], unit)
        assert sum(r.n for r in merged.collect()) == sum(map(len, exact.values()))
    for r in S.sketch_percentiles(S.merge_windows(S.merge_windows(fine, ["stage"], "hour"), ["stage"]), (0.0, 0.25, 0.5, 0.9, 1.0)).collect():
        v = np.sort(exact[r.stage])
        for p, x in ((0.25, r.p25), (0.5, r.p50), (0.9, r.p90)):
            low, high = np.searchsorted(v, x) / len(v), np.searchsorted(v, x, "right") / len(v)
            assert low - 2 * S.RANK_ERROR <= p <= high + 2 * S.RANK_ERROR
        assert (r.p0, r.p100, r.n) == (v[0], v[-1], len(v))


def test_threshold_histogram_equals_counting_every_row(spark):
    rnd = random.Random(2)
    data = [(rnd.choice("xy"), rnd.choice([None, 0.05, 0.1, 0.35, rnd.random()])) for _ in range(500)]
    cuts = [0.0, 0.05, 0.1, 0.35, 0.9, 2.0]
    df = spark.createDataFrame(data, "grp string, score double")
    got = {(r.grp, r.threshold): (r.n_pass, r.pass_rate) for r in E.threshold_sweep(df, cuts).collect()}
    for g in "xy":
        own = [s for k, s in data if k == g]
        for t in cuts:
            n = sum(s is not None and s >= t for s in own)
            assert got[g, t] == (n, n / len(own))
    assert len(got) == 12 and E.threshold_sweep(df.limit(0), cuts).collect() == []


def test_separation_is_the_area_under_the_curve(spark):
    rnd = random.Random(4)
    data = [("in", min(1.0, rnd.random() + 0.2)) for _ in range(300)] + [("out", rnd.random()) for _ in range(400)]
    df = spark.createDataFrame(data, "grp string, score double")
    area = E.separation(E.threshold_sweep(df, [i / 200 for i in range(201)]), "in", "out").first().area
    yes, no = [s for g, s in data if g == "in"], [s for g, s in data if g == "out"]
    assert area == pytest.approx(np.mean([(y > n) + 0.5 * (y == n) for y in yes for n in no]), abs=0.01)
