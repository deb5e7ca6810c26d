"""Quantile sketches: mergeable percentiles of windows, and the exact values at given ranks without a sort.

*Mergeable sketches*. ``sketch_windows`` keeps one KLL sketch, count, least and greatest value per group and time window. Coarser
windows (hour, day) are merged from the finer ones by ``merge_windows``, without reading the rows again. The rank error of a sketch, merged
or not, is about ``RANK_ERROR`` of its rows (for k = ``SKETCH_K``, at 99 % confidence).

*Exact ranks* (``values_at_ranks``). A pass builds a sketch per group; it brackets each wanted rank between two values. The next
pass counts the rows below each bracket and sketches only those inside, and so on until the brackets hold at most ``FEW`` rows; the last pass
counts their values. Every pass is a scan with a combined aggregation: nothing is range-partitioned or sorted as a whole, and no
row passes through one task. Whether a bracket holds its rank is checked by the counts; one that doesn't is replaced by its
predecessor and tried again with a wider margin, so results are exact, whatever the sketch says.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragloom.operators.common import bounded_broadcast, checkpoint

SKETCH_K = 800
RANK_ERROR = 0.005
GRID = 400
FEW = 4096


# ------------------------------------------------------------------------------------ windows
def sketch_windows(rows: DataFrame, group_cols: list[str], ts_col: str, value_col: str, window: str = "5 minutes", k: int = SKETCH_K) -> DataFrame:
    """(group..., window_start, n, least, greatest, sketch); null values and null times are left out. Works on a stream with a
    watermark as well."""
    held = rows.where(F.col(value_col).isNotNull() & F.col(ts_col).isNotNull()).withColumn("_v", F.col(value_col).cast("double"))
    g = held.groupBy(*group_cols, F.window(ts_col, window).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("greatest"), F.kll_sketch_agg_double("_v", k).alias("sketch"))
    return g.select(*group_cols, F.col("_w.start").alias("window_start"), "n", "least", "greatest", "sketch")


def merge_windows(windows: DataFrame, group_cols: list[str], unit: str | None = None, k: int = SKETCH_K) -> DataFrame:
    """The same columns for whole ``unit``s such as hour or day (None: all time, without ``window_start``)."""
    keys = [*group_cols] + ([F.date_trunc(unit, "window_start").alias("window_start")] if unit else [])
    return windows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
                                      F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_percentiles(windows: DataFrame, ps=(0.5, 0.7, 1.0), names=None) -> DataFrame:
    """The sketches replaced by a column per percentile (0 and 1 are the exact least and greatest value)."""
    names = names or [f"p{int(round(p * 100))}" for p in ps]
    at = lambda p: F.col("least") if p <= 0 else F.col("greatest") if p >= 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))
    return windows.select(*[c for c in windows.columns if c not in ("sketch", "least", "greatest")], *[at(p).alias(n) for p, n in zip(ps, names)])


# ---------------------------------------------------------------------------------- exact ranks
def _same(left: DataFrame, right: DataFrame, cols: list[str]):
    return reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[f"_g_{c}"]) for c in cols], F.lit(True))


def _inside(data: DataFrame, brackets: DataFrame, group_cols: list[str]) -> DataFrame:
    """Rows up to each bracket's end, once per bracket of their group; ``_v`` is null for those below it."""
    b, _ = bounded_broadcast(brackets.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], "_rank", "_lo", "_hi", "_margin"))
    # a key that the optimizer can't fold: where the group is a constant, the range alone would be left and every row would meet every bracket
    data, b = data.withColumn("_one", F.when(F.col("_v").isNotNull(), F.lit(1))), b.withColumn("_one", F.when(F.col("_hi").isNotNull(), F.lit(1)))
    j = data.join(b, _same(data, b, group_cols) & (data["_one"] == b["_one"]) & (data["_v"] <= b["_hi"]))
    return j.select(*group_cols, "_rank", "_lo", "_hi", "_margin", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))


def _narrowed(brackets: DataFrame) -> DataFrame:
    """The bracket of each rank by its sketch of the rows inside, as wide as the margin says."""
    local = (F.col("_rank") - F.col("_below")).cast("double")
    low, high = local / F.col("_n_in") - F.col("_margin"), (local + 1) / F.col("_n_in") + F.col("_margin")
    grid = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))  # ranks must be constants
    return (brackets.withColumn("_old_lo", F.col("_lo")).withColumn("_old_hi", F.col("_hi")).withColumn("_grid", grid)
            .withColumn("_lo", F.when(low > 0, F.get("_grid", F.floor(low * GRID).cast("int"))).otherwise(F.col("_lo")))
            .withColumn("_hi", F.when(high < 1, F.get("_grid", F.ceil(high * GRID).cast("int"))).otherwise(F.col("_hi"))).drop("_grid"))


def values_at_ranks(data: DataFrame, group_cols: list[str], value_col: str, ranks) -> DataFrame:
    """(group..., _rank, _n, value): the value at each 0-based rank of its group. ``ranks`` maps the column of a group's row count to
    an array column of ranks; ranks outside the group are left out, nulls aren't counted."""
    data = data.select(*group_cols, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    groups = data.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                           F.kll_sketch_agg_double("_v", SKETCH_K).alias("_sketch"))
    wanted = groups.withColumn("_rank", F.explode(F.array_distinct(ranks(F.col("_n"))))).where((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_n")))
    now = checkpoint(wanted.select(*group_cols, "_n", F.col("_rank").cast("long").alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"),
                                   F.col("_n").alias("_n_in"), F.lit(RANK_ERROR).alias("_margin"), "_sketch"))
    while True:
        open_ = now.where((F.col("_n_in") > FEW) & (F.col("_lo") < F.col("_hi")))
        if open_.isEmpty():
            break
        tried = checkpoint(_narrowed(open_))
        met = _inside(data, tried, group_cols).groupBy(*group_cols, "_rank").agg(
            F.sum(F.col("_v").isNull().cast("long")).alias("_new_below"), F.count("_v").alias("_new_in"), F.kll_sketch_agg_double("_v", SKETCH_K).alias("_new_sketch"))
        met = met.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col("_rank").alias("_r"), "_new_below", "_new_in", "_new_sketch")
        j = tried.join(met, _same(tried, met, group_cols) & (tried["_rank"] == met["_r"]), "left")
        held = F.coalesce((F.col("_new_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_new_below") + F.col("_new_in")), F.lit(False))
        narrower = held & (F.col("_new_in") < F.col("_n_in"))
        pick = lambda new, old: F.when(held, F.col(new)).otherwise(F.col(old))
        done = j.select(*group_cols, "_n", "_rank", pick("_lo", "_old_lo").alias("_lo"), pick("_hi", "_old_hi").alias("_hi"), pick("_new_below", "_below").alias("_below"),
                        pick("_new_in", "_n_in").alias("_n_in"),
                        F.when(narrower, F.lit(RANK_ERROR)).when(held, F.col("_margin") / 4).otherwise(F.col("_margin") * 4).alias("_margin"), pick("_new_sketch", "_sketch").alias("_sketch"))
        now = checkpoint(now.where(~((F.col("_n_in") > FEW) & (F.col("_lo") < F.col("_hi")))).unionByName(done))
    counts = _inside(data, now.where("_lo < _hi"), group_cols).groupBy(*group_cols, "_rank", "_v").agg(F.count(F.lit(1)).alias("_w"))
    w = W.partitionBy(*group_cols, "_rank").orderBy(F.col("_v").asc_nulls_first())  # FEW rows at most, or copies of few values
    ends = counts.withColumn("_upto", F.sum("_w").over(w))
    value = ends.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_w") <= F.col("_rank"))).select(
        *[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col("_rank").alias("_r"), F.col("_v").alias("_found"))
    j = now.join(value, _same(now, value, group_cols) & (now["_rank"] == value["_r"]), "left")
    return j.select(*group_cols, "_rank", "_n", F.coalesce("_found", F.col("_lo")).alias("value"))
