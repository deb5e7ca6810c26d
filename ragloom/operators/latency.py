"""Latency analytics over stage-timing rows: totals, exact percentiles (linear and nearest-rank), cold
request exclusion, short-circuit breakdown, per-stage share and the benchmark summary.

Exact percentiles come from the values at the ranks they need (see ``sketches.values_at_ranks``): passes with quantile sketches that
bracket the ranks, no sort. ``group_ranks`` gives every row its rank where all are wanted: rows are range-partitioned on (group,
value) and stored with their partition number (a reliable checkpoint: recomputed blocks can't shift between partitions); a row's rank is
its place in its partition plus the counts of the group in earlier partitions (a small table).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragloom.operators.common import checkpoint
from ragloom.operators.sketches import values_at_ranks

STAGES = ("transcribe", "classify_query", "retrieve", "check_grounding", "generate", "verify")


def group_ranks(df: DataFrame, group_cols: list[str], value_col: str, carry=()) -> DataFrame:
    """(group..., _v, carry..., _rank, _n): 0-based rank of each row's value in its group and the group size; ``carry``
    columns travel with their row and break ties."""
    order = ["_v", *carry]
    s = df.select(*group_cols, F.col(value_col).alias("_v"), *carry).where(F.col("_v").isNotNull())
    s = checkpoint(s.repartitionByRange(*group_cols, *order).withColumn("_pid", F.spark_partition_id()))
    pc = s.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*group_cols).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)  # <= a row per partition and group
    pc = pc.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_n", F.sum("_c").over(W.partitionBy(*group_cols)))
    inner = W.partitionBy("_pid", *group_cols).orderBy(*order)
    r = s.withColumn("_loc", F.row_number().over(inner) - 1)
    j = r.join(pc.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col("_pid").alias("_p"), "_off", "_n"),
               reduce(lambda x, y: x & y, [F.col("_pid") == F.col("_p")] + [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group_cols]))
    return j.withColumn("_rank", F.col("_off") + F.col("_loc")).drop("_pid", "_p", "_loc", "_off", *[f"_g_{c}" for c in group_cols])


def percentiles(df: DataFrame, group_cols: list[str], value_col: str, ps=(0.5, 0.7, 1.0),
                method: str = "linear", names=None, with_n: bool = False) -> DataFrame:
    """One row per group with a column per percentile.

    linear:   numpy's default - interpolate between ranks floor(p*(n-1)) and the next one.
    nearest:  sorted[min(n-1, round_half_even(p*(n-1)))].
    """
    names = names or [f"p{int(round(p * 100))}" for p in ps]
    share = lambda p, n: F.lit(float(p)) * (n - 1).cast("double")
    low = lambda p, n: F.floor(share(p, n)).cast("long")
    near = lambda p, n: F.least(F.bround(share(p, n), 0).cast("long"), n - 1)
    if method == "linear":
        found = values_at_ranks(df, group_cols, value_col, lambda n: F.array(*[x for p in ps for x in (low(p, n), F.least(low(p, n) + 1, n - 1))]))
    else:
        found = values_at_ranks(df, group_cols, value_col, lambda n: F.array(*[near(p, n) for p in ps]))
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("value")))
    n, aggs = F.col("_n"), [F.max("_n").alias("n")]
    for p, name in zip(ps, names):
        aggs += [at(low(p, n)).alias(f"_a_{name}"), at(F.least(low(p, n) + 1, n - 1)).alias(f"_b_{name}")] if method == "linear" else [at(near(p, n)).alias(name)]
    g = found.groupBy(*group_cols).agg(*aggs)  # a row per wanted rank
    if method == "linear":
        for p, name in zip(ps, names):
            g = g.withColumn(name, F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * (share(p, F.col("n")) - low(p, F.col("n"))))
    return g.select(*group_cols, *names, *(["n"] if with_n else []))


def request_totals(log: DataFrame, req: str = "request_group", ms: str = "ms", seq: str = "seq",
                   *, retrieve_stage: str) -> DataFrame:
    """(request, total_ms, retrieve_ms, n_stages, first_seq, completed, stopped_at)."""
    first_fail = F.min_by(F.col("stage"), F.when(~F.col("ok"), F.col(seq)))
    return log.groupBy(req).agg(
        F.sum(ms).alias("total_ms"),
        F.coalesce(F.sum(F.when(F.col("stage") == retrieve_stage, F.col(ms))), F.lit(0.0)).alias("retrieve_ms"),
        F.count(F.lit(1)).alias("n_stages"),
        F.min(seq).alias("first_seq"),
        F.bool_and("ok").alias("completed"),
        F.coalesce(first_fail, F.lit("verify")).alias("stopped_at"),
    )


def warm_only(requests: DataFrame, seq: str = "first_seq") -> DataFrame:
    """Drop the cold (first) request: one global min, broadcast as a 1-row table, anti join."""
    cold = requests.agg(F.min(seq).alias(seq))
    return requests.join(F.broadcast(cold), seq, "left_anti")


def stage_share(log: DataFrame, req: str = "request_group", ms: str = "ms") -> DataFrame:
    """(request, stage, ms, share): ms / request total * 100, clamped to 5..100."""
    per = log.groupBy(req, "stage").agg(F.sum(ms).alias("ms"))
    tot = F.sum("ms").over(W.partitionBy(req))
    return per.withColumn("share", F.greatest(F.lit(5.0), F.least(F.lit(100.0), F.col("ms") / F.nullif(tot, F.lit(0.0)) * 100)))


def stage_status(results: DataFrame, q_key: str, stopped_col: str = "stopped_at", stages=STAGES,
                 skip=("transcribe",)) -> DataFrame:
    """(q_key, stage, stage_no, status): completed before the stop, stopped at it (verify = completed),
    disabled after it. Each row meets the fixed stage list through a generator, not a join."""
    st = [s for s in stages if s not in skip]
    e = results.select(q_key, stopped_col, F.posexplode(F.array(*[F.lit(s) for s in st])).alias("stage_no", "stage"))
    stop_no = F.array_position(F.array(*[F.lit(s) for s in st]), F.col(stopped_col)) - 1
    status = (F.when(F.col("stage_no") < stop_no, F.lit("completed"))
              .when((F.col("stage_no") == stop_no) & (F.col(stopped_col) != "verify"), F.lit("stopped"))
              .when(F.col("stage_no") == stop_no, F.lit("completed"))
              .otherwise(F.lit("disabled")))
    return e.select(q_key, "stage", "stage_no", status.alias("status"))


# ---------------------------------------------------------------------------------------- sinks
def write_request_latencies(requests: DataFrame, path: str, query_col: str = "request_group",
                            ms_col: str = "total_ms") -> None:
    """Per-request CSV with header ``query,latency_ms`` (ms rounded to 2 places, half-even)."""
    (requests.select(F.col(query_col).cast("string").alias("query"), F.bround(ms_col, 2).alias("latency_ms"))
     .write.mode("overwrite").option("header", True).csv(path))


def summary_record(summary: DataFrame, breakdown: DataFrame) -> DataFrame:
    """Nest the flat benchmark summary row (see the ``benchmark_summary`` query) into the report shape:
    cold start, warm sample size, retrieval-only, completed-only and all-requests blocks; the
    short-circuit breakdown is a map stage -> count built from ``breakdown(stopped_at, n)``."""
    bd = breakdown.agg(F.map_from_entries(F.collect_list(F.struct("stopped_at", "n"))).alias("short_circuit_breakdown"))  # one entry per stage
    s = summary.withColumn("_k", F.lit(1)).join(F.broadcast(bd.withColumn("_k", F.lit(1))), "_k")
    pct = lambda p: F.struct(*[F.bround(F.col(f"{p}_{c}"), 2).alias(c.upper()) for c in ("p50", "p70", "p100")])
    return s.select(
        F.col("n_requests").alias("queries_attempted"),
        F.struct(F.bround("cold_total_ms", 2).alias("cold_start_first_request_total_ms"),
                 F.bround("cold_retrieve_ms", 2).alias("cold_start_first_request_retrieve_ms"),
                 F.lit("excluded_from_percentiles").alias("status")).alias("cold_start_query"),
        F.col("n_warm").alias("warm_benchmark_sample_size"),
        pct("retrieval").alias("retrieval_only_latency_ms"),
        F.struct(F.col("completed_n").alias("sample_size"),
                 *[F.bround(F.col(f"completed_{c}"), 2).alias(c.upper()) for c in ("p50", "p70", "p100")]
                 ).alias("full_pipeline_completed_only_latency_ms"),
        F.struct(F.col("n_warm").alias("sample_size"), F.col("short_circuit_breakdown"),
                 *[F.bround(F.col(f"all_{c}"), 2).alias(c.upper()) for c in ("p50", "p70", "p100")]
                 ).alias("full_pipeline_incl_short_circuits_latency_ms"),
    )


def write_summary_json(record: DataFrame, path: str) -> None:
    """The one-row report as JSON (a single small file)."""
    record.coalesce(1).write.mode("overwrite").json(path)


def completed_calls(log: DataFrame, status_col: str = "status", ok_status: int = 200) -> DataFrame:
    """Drop telemetry rows of failed calls (status other than ``ok_status``) before any percentile."""
    return log.where(F.col(status_col) == ok_status)
