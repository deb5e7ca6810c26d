"""Host-level quality rules, with DataFrame functions only.

Every document is measured on its whole text (null: empty; words are runs of ``[^\\x20\\x09-\\x0D]``):

* base: fewer than 50 words, or over half of the words inside repeated 3-word windows (``base_failed``);
* symbols: over one ``#*$%&|<>`` per ten words;
* lines: over 30 % of the lines that hold a word repeat an earlier line;
* length: mean word length outside 3 to 10 characters.

Rule failures are aggregated by host (``source``; null is a host of its own). A host's rates are shrunk with a beta
prior fitted to all hosts by moments: with m the overall rate, N = sum n, S = sum n (k/n - m)^2 over H hosts, the
variance between hosts is (S - m(1-m)(H-1)) / (N - sum n^2 / N), the prior's strength m(1-m)/variance - 1 (not above
``MAX_STRENGTH``, which also stands for hosts that don't differ), and the shrunk rate (k + strength*m)/(n + strength).

Verdict (``kept``): never with ``base_failed``. Else a document goes if its host's shrunk rate of documents failing
any rule exceeds ``MAX_HOST_RATE``, if it fails the symbol rule itself, or if it fails the line or length rule and its
host's shrunk rate for that rule exceeds ``SUSPECT_RATE`` (one such failure on a good host is no evidence).

All word work is array functions inside the row; one aggregation per host (combined before the shuffle, so a host
with a third of the rows costs one row per task) and a table of totals. Host verdicts are joined back by broadcast where
the counted number of hosts is within a bound, else as an equi-join on a salted host key.

Defined cases: empty and null texts fail the base rules; repeated rows are measured row by row and count as often as
they occur; an empty table gives an empty result; other columns of the input are ignored or kept untouched.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import checkpoint, let

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
SUSPECT_RATE = 0.2
MAX_STRENGTH = 10_000.0
SALTS = 64
MAX_BROADCAST_HOSTS = 50_000
RULES = ("any", "base", "symbols", "lines", "length")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeated(pairs: Column) -> Column:
    """Of an array of (value, position): the entries whose value occurs twice or more."""
    return let(F.sort_array(pairs), lambda s: F.filter(
        s, lambda x, k: (F.get(s, k - 1).getField("v") == x.getField("v")) | (F.get(s, k + 1).getField("v") == x.getField("v"))))


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words inside windows that occur twice or more. Windows are first compared by hash; the few whose hash repeats
    are compared as text, so the count is exact."""
    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.struct(
            F.xxhash64(*[F.get(w, i + k) for k in range(window)]).alias("v"), i.alias("i")))

    def spelled(w: Column, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(
            F.concat_ws(" ", *[F.get(w, x.getField("i") + k) for k in range(window)]).alias("v"), x.getField("i").alias("i")))

    def covered(starts: Column) -> Column:
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(window + F.aggregate(  # never just one start
            F.sequence(F.lit(1), F.size(starts) - 1), F.lit(0),
            lambda acc, k: acc + F.least(F.lit(window), F.get(starts, k) - F.get(starts, k - 1))))

    many = F.size(words) > window
    starts = F.sort_array(F.transform(repeated(spelled(words, repeated(hashed(words)))), lambda x: x.getField("i")))
    return F.when(many, let(starts, covered)).otherwise(F.lit(0))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the struct column ``_hq_m``: the base measures, base_failed and one boolean per rule."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"))

    def ruled(c: Column) -> Column:
        n, lines = c.getField("n_words"), c.getField("lines")
        base = (n < MIN_WORDS) | (100 * c.getField("n_repeat_words") > MAX_REPEAT_PERCENT * n)
        symbols = 10 * c.getField("n_symbols") > n
        repeats = 10 * lines.getField("dup") > 3 * lines.getField("n")
        length = (c.getField("word_chars") < 3 * n) | (c.getField("word_chars") > 10 * n)
        return F.struct(
            n.alias("n_words"), c.getField("word_chars").alias("word_chars"), c.getField("n_symbols").alias("n_symbols"),
            lines.getField("dup").alias("n_dup_lines"), c.getField("n_repeat_words").alias("n_repeat_words"),
            (base | symbols | repeats | length).alias("any"), base.alias("base"), symbols.alias("symbols"), repeats.alias("lines"), length.alias("length"))

    return df.withColumn("_hq_m", let(let(words_of(F.col(text_col)), counted), ruled))


def host_rates(measured: DataFrame, host: Column) -> DataFrame:
    """One row per host: _hq_host, n and for every rule the shrunk failure rate (_hq_rate_any, _hq_rate_base, ...)."""
    counts = checkpoint(measured.groupBy(host.alias("_hq_host")).agg(  # read twice below: the texts are measured once
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"_hq_m.{r}").cast("long")).alias(f"k_{r}") for r in RULES]))
    totals = counts.agg(F.sum("n").alias("t_n"), F.count(F.lit(1)).alias("t_hosts"), F.sum(F.col("n") * F.col("n").cast("double")).alias("t_nn"),
                        *[F.sum(f"k_{r}").alias(f"t_k_{r}") for r in RULES],
                        *[F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"t_q_{r}") for r in RULES])
    prior = []
    for r in RULES:
        m = F.col(f"t_k_{r}") / F.col("t_n")
        s = F.col(f"t_q_{r}") - F.col("t_n") * m * m  # sum n (k/n - m)^2
        var = F.try_divide(s - m * (1 - m) * (F.col("t_hosts") - 1), F.col("t_n") - F.col("t_nn") / F.col("t_n"))
        strength = F.when(var > 0, F.greatest(F.lit(0.0), F.least(F.lit(MAX_STRENGTH), m * (1 - m) / var - 1))).otherwise(F.lit(MAX_STRENGTH))
        prior += [m.alias(f"m_{r}"), strength.alias(f"strength_{r}")]
    # one row of totals for each salt: an equi-join, no product
    prior_of_salt = totals.select(*prior).withColumn("_hq_p", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hosts = counts.withColumn("_hq_p", F.pmod(F.xxhash64("_hq_host"), F.lit(SALTS)).cast("int"))
    return hosts.join(prior_of_salt, "_hq_p").select("_hq_host", "n", *[
        ((F.col(f"k_{r}") + F.col(f"strength_{r}") * F.col(f"m_{r}")) / (F.col("n") + F.col(f"strength_{r}"))).alias(f"_hq_rate_{r}") for r in RULES])


def verdict() -> Column:
    bad = (F.col("_hq_rate_any") > MAX_HOST_RATE) | F.col("_hq_m.symbols")
    for r in ("lines", "length"):
        bad = bad | (F.col(f"_hq_m.{r}") & (F.col(f"_hq_rate_{r}") > SUSPECT_RATE))
    # one expression, not a conjunction: a filter on it isn't split and pushed below, where the texts would be measured anew
    return F.coalesce(~F.col("_hq_m.base") & ~F.coalesce(bad, F.lit(False)), F.lit(False))


def with_verdict(measured: DataFrame, rates: DataFrame, host_col: str) -> DataFrame:
    """``measured`` (with ``_hq_m`` and ``_hq_salt``) and the boolean ``_hq_kept``. Up to ``MAX_BROADCAST_HOSTS`` hosts (their
    number is counted; a row has a name and a few numbers) are broadcast; beyond that both sides are shuffled, each host
    row repeated once per salt."""
    rates = checkpoint(rates.drop("n"))
    same_host = F.col(host_col).eqNullSafe(F.col("_hq_host"))
    if rates.count() <= MAX_BROADCAST_HOSTS:
        joined = measured.join(F.broadcast(rates), same_host, "left")
    else:
        salted = rates.withColumn("_hq_rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.join(salted, same_host & (F.col("_hq_salt") == F.col("_hq_rate_salt")), "left")
    return joined.select(*measured.columns, verdict().alias("_hq_kept"))


def salt(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("_hq_salt")


def judge(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``df`` with the struct column ``_hq_m`` of measures and the boolean ``_hq_kept``. The texts are read and measured once
    for the hosts and once for the documents rather than stored in between."""
    rates = host_rates(measure(df.select(text_col, host_col), text_col).select(host_col, "_hq_m"), F.col(host_col))
    measured = measure(df, text_col).select(*df.columns, "_hq_m", salt(F.col(text_col)))
    return with_verdict(measured, rates, host_col).drop("_hq_salt")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, the base measures, base_failed and kept. Measures are stored once (without texts) and read twice."""
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    measured = checkpoint(measure(own, "text").select("doc_id", "host", "_hq_m", salt(F.col("text"))))
    judged = with_verdict(measured, host_rates(measured, F.col("host")), "host")
    return judged.select(F.col("doc_id").alias(id_col), *[F.col(f"_hq_m.{c}").alias(c) for c in MEASURES],
                         F.col("_hq_m.base").alias("base_failed"), F.col("_hq_kept").alias("kept"))


#: The same rows as DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM p),
cov AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM g WHERE c > 1) GROUP BY r),
m AS (SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base, 10 * n_symbols > n_words AS symbols,
  10 * n_dup_lines > 3 * n_lines AS lines, word_chars < 3 * n_words OR word_chars > 10 * n_words AS length FROM m),
a AS (SELECT source, count(*) AS n, rule, count(*) FILTER (failed) AS k FROM (
  SELECT source, unnest(['any', 'lines', 'length']) AS rule, unnest([base OR symbols OR lines OR length, lines, length]) AS failed FROM f) GROUP BY source, rule),
t AS (SELECT rule, sum(n) AS N_, count(*) AS H, sum(n::DOUBLE * n) AS nn, sum(k) / sum(n) AS mean, sum(k * k / n) - sum(n) * (sum(k) / sum(n)) ** 2 AS s FROM a GROUP BY rule),
v AS (SELECT rule, mean, (s - mean * (1 - mean) * (H - 1)) / nullif(N_ - nn / N_, 0) AS var FROM t),
st AS (SELECT rule, mean, CASE WHEN var > 0 THEN greatest(0.0, least(10000.0, mean * (1 - mean) / var - 1)) ELSE 10000.0 END AS strength FROM v),
h AS (SELECT source, max(CASE WHEN rule = 'any' THEN rate END) AS any_, max(CASE WHEN rule = 'lines' THEN rate END) AS lines_, max(CASE WHEN rule = 'length' THEN rate END) AS length_
  FROM (SELECT source, rule, (k + strength * mean) / (n + strength) AS rate FROM a JOIN st USING (rule)) GROUP BY source)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
  NOT base AND NOT (any_ > 0.5 OR symbols OR (lines AND lines_ > 0.2) OR (length AND length_ > 0.2)) AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source
"""
