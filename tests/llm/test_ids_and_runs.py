"""Long ids beside null ones in one batch, op9's row per document, the transducer's settling, rounds that go on."""
import random

import pytest

from conftest import SF0001
from ragloom.llm import bpe, fingerprints, line_dedup, pii, queries, stages

BIG = 2**60 + 1


@pytest.fixture(scope="module")
def long_ids(spark):
    passage = "this passage of more than ten words stands in every one of these few documents"
    rows = [(BIG + 2 * i, f"write to user{i}@mail{i}.example.org now\n{passage}\nown words of number {i}", i) for i in range(6)]
    rows += [(None, f"the null one writes to null@example.org\n{passage}", 7), (None, "another null", 8), (None, None, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int").coalesce(1)


def test_fingerprints_keep_long_ids_beside_null_ones(long_ids):
    got = fingerprints.compare_next(long_ids).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in long_ids.collect())
    following = {BIG + 2 * i: BIG + 2 * (i - 1) for i in range(1, 6)}
    mark, text = {r.doc_id: r.fingerprint for r in got if r.doc_id}, {r.doc_id: r.text for r in long_ids.collect() if r.doc_id}
    for r in got:
        if r.doc_id in following:
            assert r.near_next == fingerprints.likeness(mark[r.doc_id], mark[following[r.doc_id]]) and r.n_chars == len(text[r.doc_id])


def test_null_ids_are_spread_and_paired_in_the_order_of_their_hashes(spark):
    df = spark.createDataFrame([(None, f"text number {i} " * (1 + i % 5)) for i in range(300)] + [(5, "the one with an id")], "doc_id long, text string")
    from pyspark.sql import functions as F

    order = [r.text for r in df.withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc()).collect()]
    got = {(r.fingerprint): r.common_next for r in fingerprints.compare_next(df, buckets=16).collect()}
    powers = fingerprints.Powers()
    marks = [fingerprints.PrefixHash(t, powers) for t in order]
    assert got == {m.fingerprint(): m.common_extension(0, marks[(i + 1) % len(marks)], 0) for i, m in enumerate(marks)}


def test_likeness_is_near_the_exact_dice_of_spans(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("text").collect()]
    spans = lambda t: {t[i:i + fingerprints.SPAN] for i in range(max(1, len(t) - fingerprints.SPAN + 1))}
    powers, off = fingerprints.Powers(), []
    for a, b in zip(docs, docs[1:]):
        new = fingerprints.edited(a, b)
        x, y = spans(a), spans(new)
        got = fingerprints.likeness(*(fingerprints.PrefixHash(t, powers).fingerprint() for t in (a, new)))
        off.append(abs(got - 2 * len(x & y) / (len(x) + len(y))))
    print("mean error", sum(off) / len(off), "largest", max(off))
    assert sum(off) / len(off) < 0.03 and max(off) < 0.15


def test_personal_data_keeps_long_ids_beside_null_ones(long_ids):
    got = {(r.doc_id, r.n_email) for r in pii.report(long_ids).collect()}
    assert got == {(BIG + 2 * i, 1) for i in range(6)} | {(None, 1), (None, 0)}
    for masked in (pii.masked(long_ids), stages.pii_masking(None, long_ids, "")):
        text = {(r.doc_id, r.n): r.text for r in masked.collect()}
        assert len(text) == 9 and not any("@" in (t or "") for t in text.values()) and sum("[EMAIL]" in (t or "") for t in text.values()) == 7


@pytest.mark.parametrize("kind", ["long", "string"])
def test_line_dedup_keeps_ids_of_any_kind(long_ids, kind):
    df = long_ids.withColumn("doc_id", long_ids.doc_id.cast(kind))
    got = {(None if r.doc_id is None else int(r.doc_id), r.n_chars): r for r in line_dedup.report(df).collect()}
    assert len(got) == 9
    holders = [r for r in got.values() if "passage of more" in (r.text or "")]
    assert [int(r.doc_id) for r in holders] == [BIG] and sum(r.removed != "" for r in got.values()) == 6
    assert sum("own words of number" in (r.text or "") for r in got.values()) == 6


def test_op9_has_one_row_per_document(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = queries.QUERIES["op9_line_dedup"](spark, SF0001).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        runs = [tuple(map(int, x.split(":"))) for x in r.removed.split(",") if x]
        assert r.text == line_dedup.without(text[r.doc_id], runs) and r.n_chars == len(r.text)
        assert r.kept == (not runs or r.text.strip() != "") and runs == sorted(runs)


def test_transducer_settles_long_matches_as_it_goes(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "LOOK", 7)
    made = bpe.Transducer(bpe.tables(ranks))
    rng = random.Random(8)
    for t in ["a" * 3000, "abcab" * 500, *("".join(rng.choice("abcde ") for _ in range(rng.randint(1, 200))) for _ in range(200))]:
        assert made.encode(t.encode()) == library.encode_ordinary(t)


def test_discovery_goes_on_until_nothing_new_is_found(spark):
    """A chain of contexts: ten seeds and three new identifiers confirm the first; any later one also needs the three that the
    context before it discovers."""
    steps, rows = 7, []
    names = [[f"id{s}x{i}@inner{s}" for i in range(3)] for s in range(steps)]
    for s in range(steps):
        held = [f"ada{s}x{i}@mail.example.org" for i in range(10)] + names[s] + (names[s - 1] if s else [])
        rows += [f"contact step{s} at {name} thanks{s}" for name in held]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {rows[r.doc_id].split()[3] for r in pii.find(df).collect() if len(r.added)}
    assert found == {n for step in names for n in step}


def test_contexts_take_whole_words():
    word = "w" * 500
    text = f"{word} {word}: someone@home {word}"
    at = text.index("someone@home")
    assert pii.contexts(text, at, at + 12) == [f"l {word} {word}:", f"b {word}: _ {word}", f"c {word}:"]


def test_rare_and_common_digests_give_the_same_runs(spark, monkeypatch):
    rng = random.Random(3)
    lines = ["a line that many texts share with each other word for word", "another one that is as common as it is long enough here", *(f"line number {i} of ten words or so that two texts share" for i in range(60))]
    rows = [(None if i % 17 == 0 else BIG + i, "\n".join(rng.choice(lines[:2] if rng.random() < 0.5 else lines) for _ in range(rng.randint(1, 9)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = lambda r: (str(r.doc_id), r.start, r.stop, r.n_words, str(r.kept_in))
    found = []
    for share in (1, 20, 1000):  # none, some, all of the repeated digests are common ones
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        found.append(sorted(map(key, line_dedup.removed_runs(df, below_lines=True, short_lines=True).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
