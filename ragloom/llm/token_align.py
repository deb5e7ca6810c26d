"""Cross-tokenizer alignment of two subword tokenizers, as Arrow columns from the token lists to the counts.

A text, with a space before it, is encoded by a byte-level BPE (A) and by a piece model (B, which adds that space
itself); both are sequences of byte strings. Where the joined bytes of either differ from the text's, the text counts as
having no tokens. A batch of texts is a pair of list columns:

1. Texts are split at single spaces between words, which no token of either side spans; the words of a batch are
   dictionary-encoded, each distinct one is encoded once by both libraries, and the lists are taken by word number.
   (Tokenizers that don't promise this, see ``by_words``, get whole texts.) Lists are flattened, with the parent index of every token. Byte lengths are taken from the vocabulary, and a
   cumulative sum less the sum before the parent gives every token's end within its text.
2. (parent, end) is one integer key. A full outer Acero hash join of both sides' keys gives the cuts of either side; those
   of both sides close a *group*.
3. Every cut ends exactly one byte range that lies in one token of A and one of B, so the cuts are the *links*: pairs of
   token occurrences with overlapping bytes. A cut of one side only lies in the other side's next token to end.
4. ``group_by`` counts the links of each (parent, A id, B id).

The rows, with the pairs of ids as arrays, are written once as Parquet in the shared checkpoint folder, so texts are
encoded once. From there ``group_by`` counts each batch's documents per pair, and Spark adds these partial counts up. Pairs in
more than a ``HOT``-th of all (document, pair) rows are fewer than ``HOT``: they are broadcast, and only the rarer ones are
joined by a shuffle on the pair, so no pair is hot there. Sums per document are combined before their shuffle.

Memory: a batch of at most ``BATCH_BYTES`` of text at a time, or one text; offsets are 64 bits wide where text is joined.

Defined cases: null and empty texts and those whose bytes can't be told from their tokens (B writes a space as U+2581, so
a text with that character) have zeros and an empty digest; repeated rows are documents each; null ids are kept; an empty
table gives an empty result; columns other than id and text aren't read.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import checkpoint, stored

BATCH_BYTES = 1 << 20
#: pairs held by more than a HOT-th of the (document, pair) rows are broadcast: fewer than HOT of them can exist
HOT = 1 << 19
#: distinct pairs a task counts at a time
COUNT_ROWS = 1 << 22


# fixed values: the byte-level alphabet writes printable bytes as themselves and the others, in order, from U+0100 on
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> dict[str, int]:
    letters = {chr(b): b for b in PRINTABLE}
    return letters | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}


class Pair:
    """Both tokenizers and their vocabularies' bytes, built once per worker from the files' contents."""

    def __init__(self, a_json: str, b_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        a_size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = pa.array([bytes(letters[c] for c in t) if (t := self.a.id_to_token(i)) is not None and all(c in letters for c in t) else (t or "").encode()
                                 for i in range(a_size)], pa.large_binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        self.names = pa.array([str(i) for i in range(max(a_size, len(pieces)))], pa.large_string())
        self.by_words = by_words(json.loads(a_json), pieces)

    def encode(self, texts: list[str]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """Token lists of either side, a list a text."""
        words = [BETWEEN_WORDS.split(t) if self.by_words else [t] for t in texts]
        offsets = np.cumsum([0, *map(len, words)], dtype=np.int64)
        coded = pa.array([w for ws in words for w in ws], pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        b = pa.array(self.b.encode(distinct, num_threads=1), pa.large_list(pa.int32()))
        return spread(self.encode_a(distinct), coded.indices, offsets), spread(b, coded.indices, offsets)

    def encode_a(self, words: list[str]) -> pa.LargeListArray:
        """A's tokens of each word with a space before it. Calls cost more than words: words without white space at
        either end are encoded in rows of ``ROW`` and told apart again by the tokens' byte lengths."""
        plain = [bool(w) and self.by_words and not (w[0].isspace() or w[-1].isspace()) for w in words]
        order = np.argsort(~np.array(plain, bool), kind="stable")
        n_plain = sum(plain)
        spaced = [" " + words[i] for i in order]
        rows = ["".join(spaced[i:min(i + ROW, n_plain)]) for i in range(0, n_plain, ROW)] + spaced[n_plain:]
        flat = pa.array([e.ids for e in self.a.encode_batch_fast(rows, add_special_tokens=False)], pa.large_list(pa.int32())).flatten()
        token_ends = np.cumsum(pc.binary_length(self.a_bytes).take(flat).to_numpy(), dtype=np.int64)
        word_ends = np.cumsum([len(w.encode()) for w in spaced], dtype=np.int64)
        cuts = np.concatenate([[0], np.searchsorted(token_ends, word_ends) + 1])
        return pa.LargeListArray.from_arrays(pa.array(cuts), flat).take(pa.array(np.argsort(order)))


ROW = 256
#: a space that stands alone between two other characters
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


def by_words(a: dict, pieces: list[str]) -> bool:
    """Whether both tokenizers treat the words between single spaces each on its own: A must cut by the byte-level pattern,
    where a space before a word starts a match, and no piece of B may hold a space behind another character."""
    cuts = a.get("pre_tokenizer") or {}
    return (a.get("normalizer") is None and a["model"]["type"] == "BPE" and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True)
            and not cuts.get("add_prefix_space") and not any(re.search("[^▁]▁", p) for p in pieces))


def spread(ids: pa.LargeListArray, words: pa.Array, offsets: np.ndarray) -> pa.LargeListArray:
    """Token lists by text from those by distinct word; text i has the words offsets[i] to offsets[i + 1]."""
    taken = ids.take(words)
    return pa.LargeListArray.from_arrays(pa.array(taken.offsets.to_numpy()[offsets]), taken.values)


def keep(ids: pa.LargeListArray, whole: pa.Array) -> pa.LargeListArray:
    """The lists, emptied where ``whole`` is false."""
    if whole.true_count == len(whole):
        return ids
    return pa.array([x if ok else [] for x, ok in zip(ids.to_pylist(), whole.to_pylist())], ids.type)


def joined(ids: pa.LargeListArray, vocabulary: pa.Array) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, vocabulary.take(ids.values)), pa.scalar(b"", pa.large_binary()))


def ends(ids: pa.LargeListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, parents, keys) of the flattened tokens; a key is parent << 40 | end of the token in its text."""
    flat, parents = pc.list_flatten(ids), pc.list_parent_indices(ids)
    running = pc.cumulative_sum(pc.cast(pc.binary_length(vocabulary).take(flat), pa.int64()))
    before = np.concatenate([[0], running.to_numpy()])[ids.offsets.to_numpy()[:-1]]
    end = pc.subtract(running, pa.array(before).take(parents))
    return flat.to_numpy(), parents.to_numpy(), pc.bit_wise_or(pc.shift_left(parents, pa.scalar(40, pa.int64())), end).to_numpy()


def spelled_groups(names: pa.Array, sides: list[tuple[np.ndarray, np.ndarray]], per_text: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every text: ``sides`` hold the ids of A and B with the positions of tokens that close a group."""
    spelled = []
    for ids, closing in sides:
        offsets = pa.array(np.concatenate([[0], closing + 1]).astype(np.int64))
        spelled.append(pc.binary_join(pa.LargeListArray.from_arrays(offsets, names.take(pa.array(ids))), pa.scalar(",", names.type)))
    groups = pc.binary_join_element_wise(*spelled, pa.scalar("|", names.type))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)), groups), pa.scalar(";", names.type)).to_pylist()


def align_texts(pair: Pair, texts: list[str | None]) -> dict[str, list]:
    """The columns of ``SCHEMA`` behind the id, a value a text."""
    n = len(texts)
    full = [t or "" for t in texts]
    a_lists, b_lists = pair.encode(full)
    wanted = pa.array([(" " + t).encode() if t else b"" for t in full], pa.large_binary())
    # an empty text's space belongs to no token: it has none on either side
    whole = pc.and_(pc.and_(pc.equal(joined(a_lists, pair.a_bytes), wanted), pc.equal(joined(b_lists, pair.b_bytes), wanted)),
                    pc.greater(pc.binary_length(wanted), 0))
    a_lists, b_lists = keep(a_lists, whole), keep(b_lists, whole)
    a_ids, a_text, a_keys = ends(a_lists, pair.a_bytes)
    b_ids, b_text, b_keys = ends(b_lists, pair.b_bytes)

    sides = [pa.table({"key": keys, at: np.arange(len(keys))}) for keys, at in ((a_keys, "at_a"), (b_keys, "at_b"))]
    cuts = sides[0].join(sides[1], "key", join_type="full outer", use_threads=False)
    at_a, at_b = cuts["at_a"].combine_chunks(), cuts["at_b"].combine_chunks()
    both = pc.and_(pc.is_valid(at_a), pc.is_valid(at_b))
    close_a, close_b = (np.sort(pc.filter(at, both).to_numpy()) for at in (at_a, at_b))
    # a cut of one side lies in the token of the other side that ends next
    keys = cuts["key"].to_numpy()
    link_a, link_b = at_a.fill_null(-1).to_numpy().copy(), at_b.fill_null(-1).to_numpy().copy()
    link_a[link_a < 0] = np.searchsorted(a_keys, keys[link_a < 0])
    link_b[link_b < 0] = np.searchsorted(b_keys, keys[link_b < 0])
    links = pa.table({"text": keys >> 40, "a": a_ids[link_a], "b": b_ids[link_b]})
    pairs = links.group_by(["text", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by([("text", "ascending"), ("a", "ascending"), ("b", "ascending")])

    count = lambda text: np.bincount(text, minlength=n)
    n_groups = count(a_text[close_a])
    spelled = spelled_groups(pair.names, [(a_ids, close_a), (b_ids, close_b)], n_groups)
    offsets = pa.array(np.concatenate([[0], np.cumsum(count(pairs["text"].to_numpy()))]).astype(np.int32))
    arrays = [pa.ListArray.from_arrays(offsets, pairs[c].combine_chunks().cast(pa.int32())) for c in ("a", "b", "count_all")]
    counts = [pa.array(x.astype(np.int64)) for x in (count(a_text), count(b_text), n_groups, count(links["text"].to_numpy()))]
    digests = pa.array([hashlib.sha256(s.encode()).hexdigest() if ok else "" for s, ok in zip(spelled, whole.to_pylist())], pa.string())
    return [*counts, digests, *arrays]


SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"
NAMES = [field.split()[0] for field in SCHEMA.split(", ")]


def small_batches(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of text, of one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def alignments(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``_row`` (a number of its own), the id and the columns of SCHEMA; ``a``, ``b`` and ``n`` are
    the distinct linked id pairs with their links. Stored in the shared checkpoint folder."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shared = df.sparkSession.sparkContext.broadcast({"a": f.read(), "b": g.read()})
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        if "pair" not in kept:
            kept["pair"] = Pair(kept["a"], kept["b"])
        for batch in batches:
            for part in small_batches(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *align_texts(kept["pair"], part.column(2).to_pylist())], ["_row", id_col, *NAMES])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"_row long, `{id_col}` {kind}, {SCHEMA}"), "alignments")


def pair_key(a: str = "a", b: str = "b") -> Column:
    return F.shiftleft(F.col(a).cast("long"), 32) + F.col(b)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, is_best): in how many documents a pair is linked, and whether that is its A id's highest. Batches
    are counted by ``group_by``, their partial counts added up by Spark. Checkpointed: some rows per vocabulary entry."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(parts).group_by(["a", "b"], use_threads=False).aggregate([("docs", "sum")])
        return summed.rename_columns(["a", "b", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            flat = pa.table({c: pc.list_flatten(batch.column(i)) for i, c in enumerate(("a", "b"))})
            parts.append(flat.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "docs"]))
            waiting += parts[-1].num_rows
            if waiting > COUNT_ROWS:
                parts = [merged(parts)]
                waiting = parts[0].num_rows
                if 2 * waiting > COUNT_ROWS:  # mostly distinct: hand them on, Spark adds up
                    yield from parts.pop().to_batches()
                    waiting = 0
        if parts:
            yield from merged(parts).to_batches()

    partial = aligned.select("a", "b").mapInArrow(run, "a int, b int, docs long")
    counts = checkpoint(partial.groupBy("a", "b").agg(F.sum("docs").alias("docs")))
    best = counts.groupBy("a").agg(F.max("docs").alias("_most"))  # a row per A id: bounded by the vocabulary
    return checkpoint(counts.join(F.broadcast(best), "a").select(pair_key().alias("pair"), "docs", (F.col("docs") == F.col("_most")).alias("is_best")))


def report(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = alignments(df, a_path, b_path, id_col, text_col)
    counts = pair_counts(aligned)
    total = counts.agg(F.sum("docs")).first()[0] or 0
    links = aligned.select("_row", F.explode(F.arrays_zip("a", "b", "n")).alias("l")).select("_row", pair_key("l.a", "l.b").alias("pair"), F.col("l.n").alias("n"))
    often = F.col("docs") > total // hot
    frequent, rare = F.broadcast(counts.filter(often)), counts.filter(~often)
    found = links.join(frequent, "pair").unionByName(links.join(F.broadcast(counts.filter(often).select("pair")), "pair", "left_anti").join(rare, "pair"))
    sums = found.groupBy("_row").agg(F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    rows = aligned.select("_row", id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    none = F.lit(0).cast("long")
    return rows.join(sums, "_row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
                                                  F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
