"""Chunking strategies over whole texts (never prefixes).

Fixed chunking is narrow: each text row is cut in place with array expressions, no shuffle.
Semantic chunking is narrow as well: a task counts each sentence's terms and compares neighbours, and
array expressions cut the chunks inside the row. The relational form (sentence rows, numbered by a scan
over pieces of a text) serves injected embedders and texts of any length.

* fixed:      overlapping word windows (``window`` words, step ``max(1, int(window*(1-overlap)))``)
* semantic:   sentences grouped while the similarity of neighbours stays >= threshold, at most
              ``max_sentences`` per chunk. A chunk starts where a run starts (first sentence or
              sim < threshold) and every ``max_sentences`` inside a run - identical to the sequential walk.
* structured: one chunk per non-blank passage of a nested dataset row, original position kept.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ragloom.functions.text import chunk_sentences, col_, strip, terms, tokens
from ragloom.operators.common import bounded_broadcast, checkpoint, chunk_id_col, in_slices


def flatten_passages(passages) -> Column:
    """Space-join of the non-blank passages (passages themselves are not stripped)."""
    p = col_(passages)
    return F.array_join(F.filter(p, lambda x: x.isNotNull() & (strip(x) != F.lit(""))), " ")


def fixed_step(window: int, overlap: float) -> int:
    return max(1, int(window * (1 - overlap)))


def chunk_fixed(df: DataFrame, text_col: str, key_cols: list[str], window: int = 256, overlap: float = 0.15,
                keep_cols: list[str] | None = None) -> DataFrame:
    step = fixed_step(window, overlap)
    keep = list(key_cols) + list(keep_cols or [])
    w = df.select(*keep, tokens(text_col).alias("_w"))
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda s: F.slice(F.col("_w"), s + 1, window))
    out = w.select(*keep, F.posexplode(windows).alias("position", "_win"))
    return out.select(
        *keep,
        "position",
        F.array_join("_win", " ").alias("text"),
        F.size("_win").alias("n_words"),
        F.lit("fixed").alias("strategy"),
    )


def sentence_similarity(df: DataFrame, text_col: str, key_cols: list[str], embed=None) -> DataFrame:
    """Sentences of each text with ``sim`` = similarity to the previous sentence (null for the first).

    Default: cosine of term-count vectors, counted where the text is split, so no term is ever shuffled.
    ``embed`` (optional) maps a sentence column to a unit vector column (e.g. an iterator pandas_udf that
    loads its model once per worker); then sim = dot(v, lag(v)).
    """
    from ragloom.functions.vectors import dot

    if embed is None:
        s = with_sentence_sims(df, text_col, key_cols)
        z = F.arrays_zip(F.col("_sents").alias("sentence"), F.col("_sims").alias("sim"))
        return s.select(*key_cols, F.posexplode(z).alias("pos", "_z")).select(
            *key_cols, "pos", F.col("_z.sentence").alias("sentence"), F.col("_z.sim").alias("sim"))
    from ragloom.operators.common import cached

    # vectors once (cached), previous sentence by an equi-join on (key, pos - 1): no window per text
    s = sentences(df, text_col, key_cols)
    v = cached(s.withColumn("_v", embed(F.col("sentence"))))
    prev = v.select(*key_cols, (F.col("pos") + 1).alias("pos"), F.col("_v").alias("_pv"))
    j = v.join(prev, [*key_cols, "pos"], "left")
    return j.select(*key_cols, "pos", "sentence", F.when(F.col("pos") == 0, F.lit(None).cast("double"))
                    .otherwise(dot("_v", "_pv")).alias("sim"))


def _adjacent_cosines(it):
    """Task side (numpy): for each text row, cosine of term counts of every sentence with the previous
    one. Integer dot products and norms, then dot / (sqrt(na) * sqrt(nb)) - the same doubles as the
    relational plan. Runs once per Arrow batch; the first sentence of a text gets null."""
    import numpy as np
    import pandas as pd

    for pdf in it:
        st = pdf["_st"]
        per_doc = st.map(len).to_numpy(dtype=np.int64)
        sents = [np.asarray(x, dtype=object) for arr in st for x in arr]
        n_sent = len(sents)
        out = []
        if n_sent:
            lens = np.array([len(x) for x in sents], dtype=np.int64)
            sid = np.repeat(np.arange(n_sent, dtype=np.int64), lens)
            flat = np.concatenate(sents) if lens.sum() else np.array([], dtype=object)
            codes, uniq = pd.factorize(flat)
            v = max(len(uniq), 1)
            key, cnt = np.unique(sid * v + codes, return_counts=True)
            ks = key // v
            cntf = cnt.astype(np.float64)
            norm2 = np.bincount(ks, weights=cntf * cntf, minlength=n_sent)
            prev = key - v  # same term, previous sentence
            pos = np.searchsorted(key, prev)
            posc = np.minimum(pos, len(key) - 1)
            b = np.where((pos < len(key)) & (key[posc] == prev), cntf[posc], 0.0)
            dot = np.bincount(ks, weights=cntf * b, minlength=n_sent)
            pn = np.concatenate([[0.0], norm2[:-1]])
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = np.where((norm2 > 0) & (pn > 0), dot / (np.sqrt(norm2) * np.sqrt(pn)), 0.0)
        start = 0
        for k in per_doc:
            seg = sim[start:start + k].tolist() if k else []
            if seg:
                seg[0] = None
            out.append(seg)
            start += k
        res = pdf.drop(columns=["_st"]).copy()
        res["_sims"] = out
        yield res


def with_sentence_sims(df: DataFrame, text_col: str, key_cols: list[str]) -> DataFrame:
    """Adds ``_sents`` (array of sentences) and ``_sims`` (similarity to the previous sentence) per text
    row, without any shuffle: sentences and terms are extracted JVM-side, the counting is numpy per batch."""
    from pyspark.sql import types as T

    base = df.select(*key_cols, F.coalesce(chunk_sentences(text_col), F.array().cast("array<string>")).alias("_sents"))
    base = base.select(*key_cols, "_sents", F.transform("_sents", lambda x: terms(x)).alias("_st"))
    schema = T.StructType([base.schema[c] for c in key_cols] + [base.schema["_sents"],
                          T.StructField("_sims", T.ArrayType(T.DoubleType()))])
    return base.select(*key_cols, "_sents", "_st").mapInArrow(in_slices(_adjacent_cosines, schema), schema)


def semantic_boundaries(df: DataFrame, text_col: str, key_cols: list[str], threshold: float = 0.55,
                        embed=None, method: str = "arrays") -> DataFrame:
    """(key..., pos, sentence, sim, is_boundary) for every sentence. Both methods of ``chunk_semantic`` read these rows' similarity."""
    s = sentence_similarity(df, text_col, key_cols, embed)
    return s.withColumn("is_boundary", (F.col("pos") == 0) | (F.col("sim") < F.lit(threshold)))


def chunk_semantic(df: DataFrame, text_col: str, key_cols: list[str], threshold: float = 0.55,
                   max_sentences: int = 12, embed=None, method: str = "arrays") -> DataFrame:
    """A chunk starts at a run start (first sentence or sim < threshold) and every ``max_sentences``
    sentences inside a run.

    method="arrays" (default): per text row, no shuffle - similarities from ``with_sentence_sims``, then
    run starts and chunk pieces as array expressions over the row's own sentences.
    method="relational" (and any injected embedder): sentence rows; chunks are numbered by a scan over pieces of
    SCAN_PIECE sentences (see ``_numbered``), so a huge text spans many tasks."""
    if embed is None and method == "arrays":
        s = with_sentence_sims(df, text_col, key_cols)
        n = F.size("_sents")
        runs = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                        lambda i: (i == 0) | (F.get(F.col("_sims"), i) < F.lit(threshold)))
        s = s.withColumn("_runs", F.when(n > 0, runs).otherwise(F.array().cast("array<int>")))
        run_end = lambda j: F.coalesce(F.get(F.col("_runs"), j + 1), F.size("_sents"))
        # the chunk texts are built inside the row, so the sentence array isn't carried into the generated rows
        pieces = F.flatten(F.transform("_runs", lambda st, j: F.transform(
            F.sequence(st, run_end(j) - 1, F.lit(max_sentences)),
            lambda c: F.struct(F.array_join(F.slice("_sents", c + 1, F.least(F.lit(max_sentences), run_end(j) - c)), " ").alias("text"),
                               F.least(F.lit(max_sentences), run_end(j) - c).alias("n")))))
        e = s.select(*key_cols, pieces.alias("_pieces")).select(*key_cols, F.posexplode("_pieces").alias("position", "_p"))
        return e.select(*key_cols, "position", F.col("_p.text").alias("text"), F.col("_p.n").alias("n_sentences"),
                        F.lit("semantic").alias("strategy"))
    b = _numbered(semantic_boundaries(df, text_col, key_cols, threshold, embed), key_cols, max_sentences)
    g = b.groupBy(*key_cols, "position").agg(
        F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("_s"))  # at most max_sentences
    return g.select(
        *key_cols, "position",
        F.array_join(F.transform("_s", lambda x: x["sentence"]), " ").alias("text"),
        F.size("_s").alias("n_sentences"),
        F.lit("semantic").alias("strategy"),
    )


SCAN_PIECE = 4096


def _numbered(b: DataFrame, key_cols: list[str], max_sentences: int, piece: int | None = None) -> DataFrame:
    """``b`` (key..., pos, is_boundary, ...) with ``position``, the number of the chunk that a sentence belongs to.

    A segmented scan. The sentences of a text are cut into pieces. A piece reduces to its last run start; the greatest of the pieces
    before gives the run that is open where a piece begins (the maximum is associative, so pieces combine in any grouping). With it a piece
    finds its own chunk starts and reduces to their number; the sum of the pieces before gives its first chunk's number. Windows span a piece's
    sentences or a text's pieces, never a whole text."""
    piece = piece or SCAN_PIECE
    b = checkpoint(b.withColumn("_pc", F.floor(F.col("pos") / piece)))
    inside = W.partitionBy(*key_cols, "_pc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*key_cols).orderBy("_pc").rowsBetween(W.unboundedPreceding, -1)
    start = F.when(F.col("is_boundary"), F.col("pos"))

    def met(df: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
        """``df`` beside a side that is small unless most texts are huge (then both are shuffled); null keys meet null keys."""
        few, _ = bounded_broadcast(few.select(*[F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in few.columns]))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on])
        return df.join(few, same, how).drop(*[f"_k_{c}" for c in on])

    def carried(df: DataFrame, reduced, combine, name: str) -> DataFrame:
        """(key..., _pc, ``name``): the pieces before each piece, combined."""
        own = df.groupBy(*key_cols, "_pc").agg(reduced.alias("_r")).withColumn(name, combine("_r").over(before))
        return own.where(F.col("_pc") > 0).select(*key_cols, "_pc", name)

    def started(df: DataFrame) -> DataFrame:
        df = df.withColumn("_run", F.coalesce(F.max(start).over(inside), F.col("_open")))
        return df.withColumn("_cs", F.when((F.col("pos") - F.col("_run")) % F.lit(max_sentences) == 0, 1).otherwise(0))

    # nothing is carried into a text's first piece, so only the texts of several pieces are reduced
    piece_keys = [*key_cols, "_pc"]
    several = met(b.select(*piece_keys, "pos", "is_boundary"), b.where(F.col("_pc") > 0).select(*key_cols).distinct(), key_cols, "left_semi")
    opened = carried(several, F.max(start), F.max, "_open")
    done = carried(started(met(several, opened, piece_keys, "left")), F.sum("_cs"), F.sum, "_done")
    b = started(met(met(b, opened, piece_keys, "left"), done, piece_keys, "left"))
    return b.withColumn("position", F.coalesce("_done", F.lit(0)) + F.sum("_cs").over(inside) - 1).drop("_pc", "_open", "_run", "_cs", "_done")


def sentences(df: DataFrame, text_col: str, key_cols: list[str]) -> DataFrame:
    return df.select(*key_cols, F.posexplode(chunk_sentences(text_col)).alias("pos", "sentence"))


def nested_rows(rows: DataFrame, use_translated: bool = True) -> DataFrame:
    """Dataset rows (see ``readers.PASSAGES_SCHEMA``) in the form the chunkers read: query_id, query, query_type, answer,
    language, passages and is_selected, with the passages of the wanted language column."""
    field = "Translated_passages" if use_translated else "English_passages"
    return rows.select(
        "query_id", "query", "query_type", F.col("Answer").alias("answer"),
        F.col("target_lang" if use_translated else "source_lang").alias("language"),
        F.col(f"passages.{field}").alias("passages"), F.col("passages.is_selected").alias("is_selected"))


def row_key(nested: DataFrame) -> Column:
    """What tells dataset rows apart: query_id, or for rows without one a hash of the row's own content."""
    content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in nested.columns if c != "query_id"])), 256)
    return F.coalesce(F.col("query_id").cast("string"), F.concat(F.lit("row-"), F.substring(content, 1, 32)))


def chunk_structured(nested: DataFrame, use_translated: bool = True) -> DataFrame:
    """One chunk per non-blank passage of ``nested`` (see ``nested_rows``; dataset rows with the nested passages struct
    are accepted as well, and ``use_translated`` picks their language column). ``is_selected`` shorter than the passages
    counts as 0. ``passage_id`` is query id and position; ``chunk_id`` also covers strategy, language and text, so equal
    ids in two languages, rows without a query id and changed texts stay apart."""
    if nested.schema["passages"].dataType.typeName() == "struct":
        nested = nested_rows(nested, use_translated)
    have = set(nested.columns)
    optional = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    e = nested.select(
        row_key(nested).alias("doc_id"), F.coalesce(F.col("query_id").cast("string"), F.lit("unknown")).alias("query_id"),
        optional("query", "").alias("query_text"), optional("query_type", "unknown").alias("query_type"),
        optional("answer", "").alias("answer_text"), optional("language", "").alias("language"),
        F.coalesce(F.col("is_selected"), F.array().cast("array<int>")).alias("_sel"),
        F.posexplode(F.coalesce(F.col("passages"), F.array().cast("array<string>"))).alias("position", "_p"),
    ).where(F.col("_p").isNotNull() & (strip("_p") != ""))
    e = e.select(
        "doc_id", "position", strip("_p").alias("text"), "query_id", "query_text", "query_type", "answer_text", "language",
        F.concat("query_id", F.lit("_"), F.col("position").cast("string")).alias("passage_id"),
        F.coalesce(F.try_element_at("_sel", F.col("position") + 1), F.lit(0)).cast("int").alias("is_selected"),
        F.lit("structured").alias("strategy"))
    return e.withColumn("chunk_id", chunk_id_col("strategy", "doc_id", "position", "text", "language"))


def build_index_chunks(nested: DataFrame, threshold: float = 0.55, max_sentences: int = 12, window: int = 256,
                       overlap: float = 0.15, embed=None, use_translated: bool = True) -> DataFrame:
    """All three strategies from nested dataset rows, as one table (structured-only columns nullable)."""
    if nested.schema["passages"].dataType.typeName() == "struct":
        nested = nested_rows(nested, use_translated)
    language = F.coalesce(F.col("language"), F.lit("")) if "language" in nested.columns else F.lit("")
    flat = nested.select(row_key(nested).alias("doc_id"), language.alias("language"), flatten_passages("passages").alias("text"))
    keys = ["doc_id", "language"]
    fixed = chunk_fixed(flat, "text", keys, window, overlap)
    sem = chunk_semantic(flat, "text", keys, threshold, max_sentences, embed)
    both = fixed.drop("n_words").unionByName(sem.drop("n_sentences"))
    both = both.withColumn("chunk_id", chunk_id_col("strategy", "doc_id", "position", "text", "language"))
    return both.unionByName(chunk_structured(nested), allowMissingColumns=True)
