"""Mixing sources to target weights, with DataFrame functions only.

1. *Sizes and targets*. A document's size is its words (runs of ``[^\\x20\\x09-\\x0D]``). Sources in code point order,
   null last, weigh 1, 2, 3, 1, 2, 3, ... and share all words: target = min(3 * size, level * weight), where the level
   is raised until the targets sum to all words (each step one aggregation over the sources, exact in integers).
2. *Blocks*. Each source's documents, by id, are one stream of words, packed into blocks of ``BLOCK_WORDS`` (the last
   may be shorter). A document's place is a prefix sum in two levels: rows are range partitioned by (source, id), so a
   source with a third of all rows is many partitions, and only one row per partition and source is summed in order.
3. *Draws*. A source needs target / mean block size slots. All slots of the mix are strata of the unit interval with
   one pseudorandom point each; a source draws the strata whose points fall into its share, and a pseudorandom
   permutation deals the strata to the slots of the output shards. Counts per shard are thus multinomial draws whose
   sum over the shards is within one slot of the source's quota (stratified inverse-CDF sampling).
4. *Blocks by index*. A source's k-th draw is round k div n of its n blocks, at index perm(k mod n), with a permutation
   for each source and round: no block is drawn again before all were, and none over three times.
5. Blocks are joined to the documents' segments by (source, block).

Permutations are swap-or-not shuffles of [0, n): in each round x and its partner (key - x) mod n change places when a
hash bit of the larger one says so. They need no sort and no table. Everything is a function of the rows and ``seed``.

Defined cases: null and empty texts have size 0 and are never taken; null sources are a source of their own; null ids
sort first; rows that agree in source, id and size are told apart by their order number, so repeated rows are taken
each on their own; an empty table gives an empty result. Other columns are ignored or kept (``mixed_rows``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
UNIT = 1 << 20  # fixed-point unit of a stratum
FAN_OUT = 4096
SALTS = 64
ROUNDS = 8
SEED = 20


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (source, id, size, ...) with part, number (together: the row), start (words before it in its source); and
    the sources: source, rank (0-based), size."""
    ranged = checkpoint(rows.repartitionByRange(F.col("source").asc_nulls_last(), F.col("id").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    order = [F.col("source").asc_nulls_last(), F.col("id").asc_nulls_first(), "size", *[c for c in rows.columns if c == "row_key"]]
    in_part = Window.partitionBy("part").orderBy(*order)
    in_source = Window.partitionBy("part", "source").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("number", F.row_number().over(in_part)).withColumn("before", F.coalesce(F.sum("size").over(in_source), F.lit(0)))
    sums = checkpoint(ranged.groupBy("part", "source").agg(F.sum("size").alias("part_size")))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("part").alias("o_part"), F.col("source").alias("o_source"), F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset"))
    located = own.join(offsets, (F.col("part") == F.col("o_part")) & F.col("source").eqNullSafe(F.col("o_source")))
    located = located.withColumn("start", F.col("before") + F.col("offset")).drop("before", "offset", "o_part", "o_source")
    sources = numbered(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    return located, sources


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with their 0-based rank in code point order, null last; ranked within range partitions, whose counts
    are summed in order."""
    ranged = checkpoint(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("r_part", F.spark_partition_id()))
    counts = ranged.groupBy("r_part").count().withColumn("base", F.coalesce(
        F.sum("count").over(Window.orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    inner = F.row_number().over(Window.partitionBy("r_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("inner", inner).join(counts.drop("count"), "r_part").withColumn("rank", (F.col("base") + F.col("inner")).cast("long")).drop("r_part", "base", "inner")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight and target. The level of each step comes from integer sums, so reruns give the same doubles."""
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int")).cast("long")
    weighed = checkpoint(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * MAX_REPEAT))
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / (all_weights or 1)
    while True:
        above = F.lit(level) * F.col("weight") > F.col("most")
        capped, free = weighed.agg(F.sum(F.when(above, F.col("most")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        raised = (total - capped) / free if free else level
        if raised <= level:
            break
        level = raised
    return weighed.withColumn("target", F.least(F.col("most").cast("double"), F.lit(float(level)) * F.col("weight"))).drop("most")


def permuted(df: DataFrame, x: str, n: Column, key: list[Column], rounds: int = ROUNDS) -> DataFrame:
    """``df`` with column ``x`` in [0, n) replaced by its image under the permutation chosen by ``key``. Each round is a
    projection of its own, so that expressions stay small."""
    names = df.columns
    for r in range(rounds):
        partner = F.pmod(F.pmod(F.xxhash64(*key, F.lit(r)), n) - F.col(x), n)
        df = df.select(*names, partner.alias("_partner"))
        bit = F.xxhash64(F.greatest(F.col(x), F.col("_partner")), *key, F.lit(-1 - r)).bitwiseAND(F.lit(1)) == 1
        df = df.select(*[F.when(bit, F.col("_partner")).otherwise(F.col(x)).alias(x) if c == x else F.col(c) for c in names])
    return df


def draws(sources: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """One row per filled slot: rank, source's round and block, shard and slot."""
    quota = sources.filter("target > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    quota = quota.withColumn("share", F.round(F.col("target") * F.col("blocks") / F.col("source_size") * UNIT).cast("long"))
    quota = checkpoint(quota.repartitionByRange("rank").withColumn("q_part", F.spark_partition_id()))
    sums = quota.groupBy("q_part").agg(F.sum("share").alias("part_share"))
    sums = sums.select("q_part", F.coalesce(F.sum("part_share").over(Window.orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("q_part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    quota = quota.withColumn("inner", F.coalesce(F.sum("share").over(inner), F.lit(0))).join(sums, "q_part").withColumn("low", F.col("base") + F.col("inner"))
    quota = checkpoint(quota.select("rank", "blocks", "low", (F.col("low") + F.col("share")).alias("high")))
    end = quota.agg(F.max("high")).first()[0] or 0
    slots = -(-end // UNIT)

    first, last = F.expr(f"low div {UNIT}"), F.expr(f"(high - 1) div {UNIT}")
    strata = quota.filter("high > low").select("rank", "blocks", "low", "high", first.alias("first"), last.alias("last"))
    wide = FAN_OUT * FAN_OUT  # a source's strata fan out in three steps, each of bounded size and dealt out anew
    strata = strata.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(last - first) div {wide}")))).repartition("rank", "a")
    strata = strata.withColumn("b", F.explode(F.sequence(F.col("a") * FAN_OUT, F.least(F.col("a") * FAN_OUT + FAN_OUT - 1, F.expr(f"(last - first) div {FAN_OUT}"))))).repartition("rank", "b")
    strata = strata.withColumn("k", F.explode(F.sequence(F.col("b") * FAN_OUT, F.least(F.col("b") * FAN_OUT + FAN_OUT - 1, F.col("last") - F.col("first")))))
    strata = strata.withColumn("stratum", F.col("first") + F.col("k"))
    point = F.col("stratum") * UNIT + F.pmod(F.xxhash64("stratum", F.lit(seed)), F.lit(UNIT))
    drawn = strata.filter((point >= F.col("low")) & (point < F.col("high")) & (F.col("k") < F.col("blocks") * MAX_REPEAT))
    drawn = drawn.select("rank", "blocks", F.expr("k div blocks").alias("round"), F.expr("k % blocks").alias("block"), F.col("stratum").alias("slot"))
    drawn = permuted(drawn, "block", F.col("blocks"), [F.col("rank"), F.col("round"), F.lit(seed + 1)])
    drawn = permuted(drawn, "slot", F.lit(max(slots, 1)).cast("long"), [F.lit(seed + 2)])
    # stored: filters that a later join infers would else be pushed through all rounds, whose expressions then explode
    return checkpoint(drawn.select("rank", "round", "block", F.expr(f"slot div {shard_slots}").alias("shard"), F.expr(f"slot % {shard_slots}").alias("slot")))


class Mix:
    """The mix of a table: ``rows`` (part, number, id, row_key, size, start, rank, source_size, target), ``draws``
    (rank, round, block, shard, slot) and what follows from them."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, row_key: Column | None = None):
        self.block_words, self.id_col = block_words, id_col
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        sized = checkpoint(df.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), size.alias("size"),
                                     (F.lit(0).cast("long") if row_key is None else row_key).alias("row_key")))
        located, sources = placed(sized)
        self.sources = checkpoint(targets(sources))
        salted = self.sources.select(F.col("source").alias("s_source"), "rank", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        keyed = located.withColumn("own_salt", F.pmod(F.xxhash64("id", "start"), F.lit(SALTS)).cast("int"))
        self.rows = checkpoint(keyed.join(salted, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("own_salt") == F.col("salt"))).drop("s_source", "salt", "own_salt"))
        self.draws = draws(self.sources, block_words, shard_slots, seed)

    def segments(self) -> DataFrame:
        """The rows' segments: one per block that a row reaches into, with the words' range within the row."""
        b = self.block_words
        found = self.rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}")))))
        return (found.withColumn("from", F.greatest(F.col("block") * b, F.col("start")) - F.col("start"))
                .withColumn("to", F.least(F.col("block") * b + b, F.col("start") + F.col("size")) - F.col("start")))

    def taken(self) -> DataFrame:
        """Per row: id, size, source_size, target, taken (words, repeats counted)."""
        times = self.draws.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
        joined = self.segments().join(times, ["rank", "block"], "left")
        out = joined.groupBy("part", "number", "id", "size", "source_size", "target").agg(
            F.coalesce(F.sum((F.col("to") - F.col("from")) * F.col("times")), F.lit(0)).cast("long").alias("taken"))
        return out.select(F.col("id").alias(self.id_col), "size", "source_size", "target", "taken")

    def placements(self) -> DataFrame:
        """The mix itself: shard, slot, round, and the row's segment that fills (part of) the slot."""
        return self.draws.join(self.segments().filter("size > 0"), ["rank", "block"]).select("shard", "slot", "round", "rank", "block", "id", "row_key", "part", "number", "size", "from", "to")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of ``df``: for every document and round in which words of it are taken, a row whose text is these
    words in order (the whole text if all are taken), with the other columns unchanged."""
    cols = df.columns
    row_key = F.xxhash64(*[F.col(c) for c in cols])
    mix = Mix(df, id_col, text_col, source_col, row_key=row_key, **options)
    parts = mix.placements().groupBy("id", "row_key", "part", "number", "size", "round").agg(
        F.sort_array(F.collect_list(F.struct("from", "to"))).alias("_mix_cut"), F.sum(F.col("to") - F.col("from")).alias("_mix_words"))  # one document's segments
    same = checkpoint(mix.rows.select("id", "row_key", "part", "number").withColumn("_mix_nth", F.row_number().over(Window.partitionBy("id", "row_key").orderBy("part", "number"))))
    parts = parts.join(same.select("part", "number", "_mix_nth"), ["part", "number"]).select(
        F.col("id").alias("_mix_id"), F.col("row_key").alias("_mix_key"), F.col("_mix_nth").alias("_mix_which"), F.col("size").alias("_mix_size"), "_mix_cut", "_mix_words")
    own = df.withColumn("_mix_own", row_key).withColumn("_mix_nth", F.row_number().over(Window.partitionBy(id_col, "_mix_own").orderBy(F.lit(0))))  # equal rows
    joined = own.join(parts, (F.col("_mix_own") == F.col("_mix_key")) & F.col(id_col).eqNullSafe(F.col("_mix_id")) & (F.col("_mix_nth") == F.col("_mix_which")))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.get(F.transform(F.array(pieces), lambda p: F.array_join(F.flatten(F.transform(
        F.col("_mix_cut"), lambda s: F.slice(p, s.getField("from").cast("int") + 1, (s.getField("to") - s.getField("from")).cast("int")))), "")), F.lit(0))
    return joined.withColumn(text_col, F.when(F.col("_mix_words") == F.col("_mix_size"), F.col(text_col)).otherwise(cut)).select(*cols)
