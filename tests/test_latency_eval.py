"""Percentiles against numpy / the nearest-rank rule, warm exclusion, shares, stage status, recall@k."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import evaluation as E
from ragloom.operators import latency as L


def test_percentiles_hot_group(spark):
    rng = np.random.default_rng(1)
    vals = [("hot", float(x)) for x in rng.exponential(100, 3000)] + [("cold", float(x)) for x in rng.exponential(50, 7)]
    df = spark.createDataFrame(vals, "stage string, ms double").repartition(6)
    got = {r.stage: r for r in L.percentiles(df, ["stage"], "ms").collect()}
    for st in ("hot", "cold"):
        v = np.array([x for s, x in vals if s == st])
        assert np.allclose([got[st].p50, got[st].p70, got[st].p100], np.percentile(v, [50, 70, 100]))
    near = {r.stage: r for r in L.percentiles(df, ["stage"], "ms", method="nearest").collect()}
    for st in ("hot", "cold"):
        s = sorted(x for g, x in vals if g == st)
        assert [near[st].p50, near[st].p70, near[st].p100] == [s[min(len(s) - 1, int(round(p * (len(s) - 1))))] for p in (0.5, 0.7, 1.0)]


def test_requests_warm_share_status(spark):
    log = spark.createDataFrame([(1, 10, "view", 5.0, True), (2, 10, "error", 1.0, False), (3, 11, "view", 3.0, True),
                                 (4, 12, "click", 2.0, True)], "seq long, request_group long, stage string, ms double, ok boolean")
    r = {x.request_group: x for x in L.request_totals(log, retrieve_stage="view").collect()}
    assert r[10].stopped_at == "error" and r[11].stopped_at == "verify" and r[10].total_ms == 6.0
    assert sorted(x.request_group for x in L.warm_only(L.request_totals(log, retrieve_stage="view")).collect()) == [11, 12]
    sh = {(x.request_group, x.stage): x.share for x in L.stage_share(log).collect()}
    assert abs(sh[(10, "view")] - 100 * 5 / 6) < 1e-9 and abs(sh[(10, "error")] - 100 / 6) < 1e-9
    res = spark.createDataFrame([(1, "check_grounding"), (2, "verify")], "q long, stopped_at string")
    st = {(x.q, x.stage): x.status for x in L.stage_status(res, "q").collect()}
    assert st[(1, "retrieve")] == "completed" and st[(1, "check_grounding")] == "stopped" and st[(1, "generate")] == "disabled"
    assert st[(2, "verify")] == "completed"


def test_recall_monotone_and_overlap(spark):
    gt = spark.createDataFrame([(1, "a b c d"), (2, "x y")], "query_id long, gt_text string")
    hits = spark.createDataFrame([("s", 1, 1, "q r"), ("s", 1, 2, "a b z"), ("s", 2, 1, "nothing")],
                                 "strategy string, query_id long, rank int, text string")
    first = E.first_hit_rank(hits, gt, "query_id", ["strategy"])
    rec = {r.k: r.recall for r in E.recall_at_k(first, gt, "query_id", "strategy", ["s"], ks=(1, 2, 5)).collect()}
    assert rec == {1: 0.0, 2: 0.5, 5: 0.5}
    df = spark.createDataFrame([("a b b", "b c"), ("", "x")], "a string, b string")
    assert [r.o for r in df.select(E.overlap_ratio("a", "b").alias("o")).collect()] == [0.5, 0.0]


def test_report_sinks_and_observation(spark, tmpdir_path):
    import json
    import os

    from conftest import SF0001
    import __spark_entry__ as entry

    summary = entry.queries()["benchmark_summary"](spark, SF0001)
    reqs = L.request_totals(spark.createDataFrame([(1, 7, "view", 1.005, True)], "seq long, request_group long, stage string, ms double, ok boolean"), retrieve_stage="view")
    bd = L.warm_only(reqs).where(~F.col("completed")).groupBy("stopped_at").agg(F.count(F.lit(1)).alias("n"))
    rec = L.summary_record(summary, bd)
    out = os.path.join(tmpdir_path, "summary")
    L.write_summary_json(rec, out)
    row = json.loads(open([os.path.join(out, f) for f in os.listdir(out) if f.endswith(".json")][0]).readline())
    assert set(row["retrieval_only_latency_ms"]) == {"P50", "P70", "P100"}
    assert "short_circuit_breakdown" in row["full_pipeline_incl_short_circuits_latency_ms"]
    csv = os.path.join(tmpdir_path, "lat")
    L.write_request_latencies(reqs, csv)
    back = spark.read.option("header", True).csv(csv).collect()
    assert [(r.query, r.latency_ms) for r in back] == [("7", "1.0")]


def test_stage_timer_and_response_times(spark):
    import json

    import pytest

    from ragloom.plans.pipeline import result_json

    from ragloom.operators.common import checkpoint
    from ragloom.operators.telemetry import StageLog

    log = StageLog()
    with log.timed("retrieve"):
        checkpoint(log.watch(spark.range(10), "retrieve", stopped=F.col("id") > 6))
    with pytest.raises(Exception), log.timed("generate"):
        checkpoint(log.watch(spark.range(3).select(F.raise_error(F.lit("no model")).alias("id")), "generate"))
    rows = log.frame(spark).collect()
    assert [(r.stage, r.rows_in, r.rows_out, r.stopped, r.ok) for r in rows] == [("retrieve", 10, 7, 3, True), ("generate", None, None, None, False)]
    assert rows[0].ms > 0 and "no model" in rows[1].error
    timings = spark.createDataFrame([("classify_query", 1.0), ("retrieve", 2.5), ("check_grounding", 0.25)], "stage string, ms double")
    results = spark.createDataFrame([(1, "a", "t", [], True, [], "check_grounding")], "q long, answer string, transcript string, citations array<string>, "
                                    "is_fully_grounded boolean, flagged_claims array<struct<claim:string,citation_index:bigint,chunk_id:string,reason:string>>, stopped_at string")
    latency = json.loads(result_json(results, "q", timings).first().json)["latency_ms"]
    assert latency == {"total": 3.75, "stages": {"transcribe": None, "classify_query": 1.0, "retrieve": 2.5, "check_grounding": 0.25}}


def test_percentiles_of_a_repeated_value(spark):
    """A value that fills nine tenths of a group is one counted row, and the result stays exact."""
    rows = [("g", 5.0)] * 900 + [("g", float(x)) for x in range(100)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in L.percentiles(df, ["g"], "v", (0.0, 0.5, 0.99, 1.0), names=["a", "b", "c", "d"], with_n=True).collect()}
    v = sorted(x for g, x in rows if g)
    assert [got["g"].a, got["g"].b, got["g"].c, got["g"].d] == [float(x) for x in np.percentile(v, [0, 50, 99, 100])] and got["g"].n == 1000
    assert got[None].n == 1


def test_verification_options(spark):
    from ragloom.operators import verification as VER

    a = spark.createDataFrame([(1, "It weighs 3.5 kg [1, 2]. Cost 7 [1].")], "q long, t string")
    hits = spark.createDataFrame([(1, 1, "c1", "weight 3.5 cost 7"), (1, 2, "c2", "other 35")], "q long, rank int, chunk_id string, text string")
    plain = {(r.claim, r.citation_index) for r in VER.flagged_claims(a, "q", "t", hits).collect()}
    assert plain == {("2", None)} or ("3", None) not in plain
    both = {(r.claim, r.citation_index) for r in VER.flagged_claims(a, "q", "t", hits, decimals=True, grouped_tags=True).collect()}
    assert both == {("3.5", 2)}


def test_stt_error_classifier(spark):
    from ragloom.sources.readers import classify_stt_error

    rows = [(401, '{"error": {"message": "bad key"}}'), (422, '{"message": "bad audio"}'), (500, '{"message": "oops"}'),
            (503, "plain body"), (400, '{"detail": "missing file"}'), (400, '{"error": {"message": ""}, "detail": "next"}')]
    df = spark.createDataFrame(rows, "status int, body string")
    got = [(r.e.retryable, r.e.message) for r in df.select(classify_stt_error("status", "body").alias("e")).collect()]
    assert got == [(False, "bad key"), (False, "bad audio"), (True, '{"message": "oops"}'), (True, "plain body"), (False, "missing file"), (False, "next")]
