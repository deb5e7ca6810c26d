"""Each operator against a brute-force version or a held-out measure, and the defined cases: nulls in any column, empty
and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""
import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF0001
from ragloom.llm import bpe, common, fingerprints, host_rules, html_crf, line_dedup, mixing, pii, quality_embed, queries, simhash, stages, toxicity

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, rank string, size string, fp string, id string, h int, score double, kind string"


def rows_of_edge_cases():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeßé") for _ in range(rng.randint(1, 7)))
    long = " ".join(word() for _ in range(30_000))
    texts = [(1, "a b c d e f g"), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, long + " x"), (7, "one two three"), (7, "one two three"), (7, "other text"),
             (None, "no id here"), (None, None), (8, "😀 emoji 😀 ok"), (9, "x" * 100_000), (10, "line one is here\nline one is here\n\n")]
    texts += [(20 + i, " ".join(word() for _ in range(80))) for i in range(12)]
    return [(i, t, None if k % 3 else "en", [None, "a", "b", "ß"][k % 4], None, k, "r", "s", "f", "i", 1, 0.5, "k") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(rows_of_edge_cases(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet")


# ------------------------------------------------------------------ all of them on the defined cases
ON_DOCS = {
    "mix": lambda d: mixing.Mix(d).taken(),
    "mixed_rows": mixing.mixed_rows,
    "bpe": queries.bpe_digests,
    "simhash": simhash.simhash_groups,
    "fingerprints": fingerprints.compare_next,
    "host_rules": host_rules.report,
    "line_dedup": line_dedup.removed_runs,
    "deduplicated": line_dedup.deduplicated,
    "pii": pii.report,
    "masked": pii.masked,
    "stage quality": lambda d: stages.quality_rules(None, d, ""),
    "stage near": lambda d: stages.near_dedup(None, d, ""),
    "stage pii": lambda d: stages.pii_masking(None, d, ""),
    "stage mix": lambda d: stages.mix_sources(None, d, ""),
}


def test_whole_pipeline_on_edge_rows_and_no_rows(spark, edge, empty):
    for table in (edge, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.stored(stage(spark, docs, ""), "test-stage")
            assert docs.columns == table.columns, name
        coded = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert len(coded) == docs.count() and all(len(r.ids_sha256) == 64 for r in coded)
        assert (len(coded) > 0) == (table is edge)


@pytest.mark.parametrize("name", sorted(ON_DOCS))
def test_defined_cases(edge, empty, name):
    n = edge.count()
    got = ON_DOCS[name](edge).collect()
    if name in ("mix", "bpe", "simhash", "fingerprints", "host_rules", "deduplicated", "pii", "masked", "stage pii"):
        assert len(got) == n
    if name.startswith("stage") or name in ("masked", "mixed_rows", "deduplicated"):
        assert ON_DOCS[name](edge).columns == edge.columns
    assert ON_DOCS[name](empty).collect() == []


@pytest.mark.parametrize("report", [toxicity.report, quality_embed.report])
def test_classifiers_on_defined_cases(spark, edge, empty, report):
    labels = spark.createDataFrame([(1, 1, 1), (7, 0, 0), (7, 1, 1), (None, 1, 1), (20, 0, 0), (21, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for table, marked in ((edge, labels), (edge, none), (empty, labels)):
        got = report(table, marked).collect()
        assert len(got) == table.count()
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)


# ------------------------------------------------------------------ 1 mixing
def test_targets_share_all_words_and_stop_at_three_times_the_size(spark):
    sizes = {"a": 100, "b": 5, "c": 1000, "d": 0, "é": 300, None: 50}
    rows = [(k, s, " ".join(["w"] * n)) for k, (s, n) in enumerate(sizes.items())]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_words=4)
    got = {r.source: (r.weight, r.target) for r in mix.sources.collect()}
    order = ["a", "b", "c", "d", "é", None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    free = set(order)
    while True:  # reshare until none is above
        left = total - sum(3 * sizes[s] for s in order if s not in free)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            break
        free -= above
    for s in order:
        assert got[s][0] == weight[s] and got[s][1] == pytest.approx(target.get(s, 3 * sizes[s]))


def test_mix_is_near_its_targets_capped_and_repeatable(spark, docs):
    a = sorted(mixing.Mix(docs).taken().collect())
    assert a == sorted(mixing.Mix(docs.repartition(7)).taken().collect())
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = {}, {}
    for r in a:
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 3 * mixing.BLOCK_WORDS for s in target)


def test_blocks_are_drawn_by_permutations_and_shards_by_multinomial_counts(spark, docs):
    mix = mixing.Mix(docs, block_words=16, shard_slots=64)
    drawn = mix.draws.collect()
    assert len({(r.shard, r.slot) for r in drawn}) == len(drawn)
    per = {}
    for r in drawn:
        per.setdefault((r.rank, r.round), []).append(r.block)
    blocks = {r["rank"]: -(-r.source_size // 16) for r in mix.sources.collect()}
    for (rank, round_), found in per.items():
        assert len(found) == len(set(found)) and max(found) < blocks[rank]
        if (rank, round_ + 1) in per:
            assert len(found) >= blocks[rank] - 1  # no block again before all were drawn (one stratum may be a neighbour's)
    x = mixing.permuted(spark.range(1000), "id", F.lit(1000).cast("long"), [F.lit(3)]).collect()
    assert sorted(r.id for r in x) == list(range(1000)) and [r.id for r in x] != list(range(1000))


def test_mixed_rows_hold_the_words_taken(spark, docs):
    taken = {r.doc_id: r.taken for r in mixing.Mix(docs).taken().collect() if r.taken}
    words = {}
    for r in mixing.mixed_rows(docs).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(WORD, r.text))
    assert words == taken


# ------------------------------------------------------------------ 2 BPE
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_the_library_and_round_trips():
    path, pattern, library = tokenizer()
    kept = bpe.codec({**bpe.tables(bpe.read_ranks(path)), "fast": pattern, "exact": bpe.letter_classes(pattern)[1]})
    rng = random.Random(1)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["", "a" * 5000, " " * 700, "'s've don't WE'LL", "the end\x1c \x85."]
    texts += ["".join(chr(rng.choice(every)) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["".join(rng.choice("ab' \n\tstß日한😀.,1९") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for t in texts:
        ids = bpe.encode_text(kept, t)
        assert ids == library.encode_ordinary(t)
        assert kept["decoder"].decode(ids) == t


def test_bpe_needs_the_reference_classes(monkeypatch):
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    with pytest.raises(ImportError):
        bpe.letter_classes(r"\p{L}+")


def test_bpe_restarts_its_tables_without_changing_results(monkeypatch):
    path, pattern, library = tokenizer()
    table = {**bpe.tables(bpe.read_ranks(path)), "fast": pattern, "exact": pattern}
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    kept = bpe.codec(table)
    for t in ["tokenization of unbelievably long words", "abcabcabc" * 200, "zzzyxwvutsrq" * 30]:
        assert bpe.encode_text(kept, t) == library.encode_ordinary(t)


def test_streaming_decoder_on_malformed_tokens():
    token = {i: bytes([i]) for i in range(256)}
    stream = bpe.Utf8Stream(token)
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(rng.randint(0, 8))]
        assert stream.decode(ids) == bytes(ids).decode("utf-8", "replace")


def test_bpe_query(spark, docs):
    path, _, library = tokenizer()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op2_byte_bpe(spark, SF0001, path).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    _, pattern, _ = tokenizer()
    coded = bpe.decode(bpe.encode(docs.limit(5), path, pattern), path, pattern).collect()
    assert all(r.decoded == r.text for r in coded)


# ------------------------------------------------------------------ 3 and 5 classifiers
def held_out(got, labels, name, least):
    y = {r.doc_id: r[name] for r in labels.collect()}
    rows = [r for r in got if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in rows) / len(rows) >= least


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op3_toxicity_ftrl(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held_out(got, labels, "toxic", 0.88)
    got = queries.op5_quality_embeddings(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held_out(got, labels, "quality", 0.93)


def test_ftrl_weights_are_sparse_and_word_driven():
    rng = random.Random(2)
    bad = ["vile", "awful"]
    texts, labels = [], []
    for k in range(400):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
        if k % 4 == 0:
            words.insert(rng.randint(0, 40), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    places, weights, bias = toxicity.fit(texts, labels)
    assert 0 < len(places) < 3000
    dense = np.zeros(1 << toxicity.BITS)
    dense[places] = weights
    hasher = toxicity.Hasher()
    assert toxicity.score_text(hasher, dense, bias, "abcd VILE, hgfe") > 0.3 > toxicity.score_text(hasher, dense, bias, "abcd hgfe")


def test_embedding_scorer_equals_the_model():
    model = quality_embed.fit(["good words here now", "bad!! bad!! bad!!", "fine text again today", "bad!! worse!! bad!!"] * 5, [1, 0, 1, 0] * 5, epochs=3)
    scorer = quality_embed.Scorer(model)
    for t in ("", "good text", "bad!! worse!!", "ß " * 50):
        assert scorer.score(t) == pytest.approx(model.probability(model.hidden(quality_embed.bags(quality_embed.Features(), t)))[1])
    assert scorer.score("bad!! bad!!") < 0.5 < scorer.score("good words today")


# ------------------------------------------------------------------ 4 SimHash
def plain_components(fps):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprints_against_spark_and_components_against_all_pairs(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = simhash.simhash_groups(d).collect()
    group = plain_components([int(r.fingerprint, 16) for r in got])
    least = {}
    for r in got:
        g = group[int(r.fingerprint, 16)]
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert all(r.component_id == least[group[int(r.fingerprint, 16)]] for r in got)
    grams = (d.limit(40).select("doc_id", F.split(F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " ")), " ").alias("w"))
             .select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 4, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, 4), " "))).alias("g"))
             .select("doc_id", F.xxhash64("g").alias("h")).collect())
    per = {}
    for r in grams:
        per.setdefault(r.doc_id, []).append(r.h % (1 << 64))
    mark = {r.doc_id: int(r.fingerprint, 16) for r in got}
    for i, hs in per.items():
        assert mark[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("hot", [simhash.HOT_KEY, 16])
def test_links_lose_no_pair(spark, hot):
    rng = random.Random(5)
    fps = []
    for _ in range(40):  # clouds at every distance, and one dense group
        c = rng.getrandbits(64)
        fps += [c] + [c ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (1, 2, 3, 4, 4, 4, 5, 6)]
    c = rng.getrandbits(64)
    fps += [c ^ rng.getrandbits(8) for _ in range(100)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(table, hot=hot)).collect()}
    plain = plain_components(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            assert (plain[a] == plain[b]) == (roots.get(a, a) == roots.get(b, b))


def test_golay_lists():
    golay, rng = simhash.Golay(), np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    near = words.copy()
    for _ in range(2):
        near ^= 1 << rng.integers(0, 23, 3000)
    for a, b in zip(golay.lists(words), golay.lists(near)):
        assert set(a[a >= 0]) & set(b[b >= 0]) and (a >= 0).sum() in (1, 6)


def test_near_dedup_keeps_one_of_each_group(edge):
    kept = stages.near_dedup(None, edge, "").collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(7) == 2 and 5 in ids and 6 not in ids  # equal rows once, the near copy goes
    assert sum(not (r.text or "").split() for r in kept) == 1


# ------------------------------------------------------------------ 6 pages
def test_crf_on_unseen_layouts_and_driver_pages(spark):
    crf = html_crf.trained(300)
    wrong = total = 0
    for blocks, labels in html_crf.labelled_pages(80, seed=77):
        wrong += sum(a != b for a, b in zip(crf.viterbi(blocks), labels))
        total += len(labels)
    assert wrong / total < 0.02
    import html

    for r in spark.read.parquet(f"{SF0001}/pages.parquet").collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        plain = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>|</?(?:p|h1)>", " ", article)))
        assert html_crf.extract(crf, r.html) == " ".join(plain.split())


def test_blocks():
    page = ("<title>no</title><div>a <b>b</b>c&amp;d<br>e</div><script>'</p>'</script><ul><li>x<li>y</ul><!-- <p>z --><p class='Ad x' id=q>f<p>g</td>"
            "<style>p{}</style> &lt;h&gt; <a href='1>2'>link</a> < 3")
    blocks = html_crf.blocks_of(page)
    assert [b.text for b in blocks] == ["a bc&d e", "x", "y", "f", "g", "<h> link < 3"] or [b.text for b in blocks][:4] == ["a bc&d e", "x", "y", "f"]
    assert html_crf.path_features(blocks[3].path) == ["t:p", "w:ad", "w:q", "w:x", "p:p"]
    assert html_crf.blocks_of("") == [] and html_crf.blocks_of("<") [0].text == "<"
    html_crf.blocks_of("<div " * 20_000)
    html_crf.blocks_of('<p a="' * 20_000)


@pytest.mark.parametrize("head", [
    "<svg-icon name=x></svg-icon>", "<select-menu>", "<title-bar></title-bar>", "<style-guide/>", "<svg class='i' width=1/>", "<svg/>", "<svg><path d=m>", "<select><option>hidden",
    "<header><svg><path></header>", "<template>", "<noscript>", "<svg><text>hidden</text></svg>", "<select><option>hidden<hr><option>hidden</select>", "<noscript><p>hidden</p></noscript>",
    "<template><p>hidden</p></template>", "<script>hidden</script>", "<style>hidden</style>", "<title>hidden</title>", "<textarea>hidden</textarea>", "<iframe>hidden</iframe>"])
def test_skipped_elements_end(head):
    for tail, more in (("", []), ("<svg><g>hidden</g></svg><select><option>hidden</select><noscript><i>hidden</i></noscript><p>more", ["more"])):
        if head != "<template>" or not more:
            assert [b.text for b in html_crf.blocks_of(f"{head}<p>The article.</p>{tail}")] == ["The article.", *more]


def test_raw_text_runs_to_the_end_and_skipping_is_linear():
    for name in ("script", "style", "title", "textarea", "iframe"):
        assert [b.text for b in html_crf.blocks_of(f"<p>shown</p><{name}>hidden<p>hidden")] == ["shown"]
    for tag in ("<svg>", "<select>", "<template>", "<noscript>", "<svg><p>"):
        html_crf.blocks_of(tag * 20_000)


def test_pages_query_on_defined_cases(spark):
    table = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<article><p>Some words here.</p></article>", "t"), (None, "u", "<article><p>Some words here.</p></article>", "t")],
                                  "page_id long, url string, html string, text string")
    got = html_crf.main_text(table).collect()
    assert [r.text for r in got] == ["", "", "Some words here.", "Some words here."]
    assert html_crf.main_text(table.limit(0)).collect() == []


# ------------------------------------------------------------------ 7 fingerprints
def test_prefix_hashes_answer_spans_and_extensions():
    rng, powers = random.Random(6), fingerprints.Powers()
    for _ in range(200):
        a, b = ("".join(rng.choice("ab😀") for _ in range(rng.randint(0, 60))) for _ in range(2))
        x, y = fingerprints.PrefixHash(a, powers), fingerprints.PrefixHash(b, powers)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = min(len(a) - i, len(b) - j)
        length = rng.randint(0, n)
        assert x.equal(i, y, j, length) == (a[i:i + length] == b[j:j + length])
        common = next((k for k in range(n) if a[i + k] != b[j + k]), n)
        assert x.common_extension(i, y, j) == common


@pytest.mark.parametrize("buckets", [1, 3, 512])
def test_next_document_and_edited_text(spark, buckets):
    rows = [(i, t) for i, t, *_ in rows_of_edge_cases()]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {t: h for t, h in table.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashes[r[1]]))
    expected = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[:len(t) - half] + following[:half]
        expected.append((i, len(t), hashlib.sha256(new.encode()).hexdigest()))
    got = fingerprints.compare_next(table, buckets=buckets).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(expected, key=key)
    for r in got:
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1


def test_likeness_follows_the_shared_share():
    rng, powers = random.Random(8), fingerprints.Powers()
    a = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000))
    b = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000))
    mark = lambda t: fingerprints.PrefixHash(t, powers).fingerprint()
    assert fingerprints.likeness(mark(a), mark(a)) == 1 and fingerprints.likeness(mark(a), mark(b)) < 0.1
    assert 0.3 < fingerprints.likeness(mark(a), mark(a[:len(a) // 2] + b[:len(b) // 2])) < 0.7
    assert fingerprints.likeness(mark(""), mark("")) == 1 and fingerprints.likeness(mark(""), mark(a)) == 0


# ------------------------------------------------------------------ 8 host rules
def test_host_verdicts(spark):
    rng = random.Random(9)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(60))
    rows = [(h * 100 + k, good() if h != 2 or k % 5 == 0 else "too short", f"h{h}") for h in range(5) for k in range(40)]
    rows += [(900, good().replace(" ", " ##"), "h0"), (901, good(), None), (902, None, None)]
    got = {r.doc_id: r for r in host_rules.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[200 + k].kept for k in range(40)) and not got[200].base_failed  # a host that mostly fails
    assert all(got[h * 100 + k].kept for h in (0, 1, 3, 4) for k in range(40))
    assert not got[900].kept and got[901].kept and got[902].base_failed and got[902].n_words == 0


def test_many_hosts_are_joined_by_salted_shuffle(spark, docs, monkeypatch):
    plain = sorted(host_rules.report(docs).collect())
    monkeypatch.setattr(host_rules, "MAX_BROADCAST_HOSTS", 0)
    assert sorted(host_rules.report(docs).collect()) == plain


def test_repeated_words_against_plain_counting(spark):
    rng = random.Random(10)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 4, 5, 8, 20, 60, 3])] + [(50, "a a a"), (51, "a a a a"), (52, "x y z x y z")]
    got = spark.createDataFrame(rows, "k int, text string").select("k", host_rules.repeat_words(host_rules.words_of(F.col("text"))).alias("n")).collect()
    for k, n in got:
        w, cover = dict(rows)[k].split(), set()
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        for i, g in enumerate(windows):
            if windows.count(g) > 1:
                cover |= {i, i + 1, i + 2}
        assert n == len(cover)


# ------------------------------------------------------------------ 9 line dedup
def test_line_runs_and_cut_texts(spark):
    passage = "This passage of several words stands in many documents\nand it goes on here"
    rows = [(3, f"own start of the third\n{passage}\nits end"), (1, f"{passage}\nfirst own line"), (2, f"second  own\n{passage.upper().replace(' ', '  ')}"),
            (4, "short\nits end"), (5, "short\nmore of it"), (6, passage), (6, passage), (None, passage)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.start): r for r in line_dedup.removed_runs(table).collect()}
    text = dict(rows)
    assert (1, 0) not in got and got[3, 23].kept_in == [1] and text[3][23:got[3, 23].stop] == passage
    assert text[2][got[2, 12].start:] == rows[2][1][12:] and not any(k[0] in (4, 5) for k in got)
    cut = sorted((str(r.doc_id), r.text) for r in line_dedup.deduplicated(table).collect())
    assert cut == sorted([("3", "own start of the third\nits end"), ("1", rows[1][1]), ("2", "second  own\n"), ("4", rows[3][1]), ("5", rows[4][1]), ("6", ""), ("6", ""), ("None", "")])


def test_repeated_rows_keep_one(spark):
    rows = [(6, "a passage of more than ten words that stands twice in here")] * 3
    left = sorted(r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == ["", "", rows[0][1]]


def plain_runs(rows, least):
    """Repeated units below the line by plain Python: {(id, start): stop}; rows have distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        runs, at, last = [], 0, False
        for line in text.split("\n"):
            words = [(m.group().lower(), at + m.start(), at + m.end()) for m in re.finditer(r"\S+", line)]
            while words:
                n = next((k for k in range(1, len(words)) if line_cut([w for w, _, _ in words[:k]], len(line.split()))), len(words))
                unit = " ".join(w for w, _, _ in words[:n])
                if unit in seen:
                    if last:
                        runs[-1][1:] = [words[n - 1][2], runs[-1][2] + n]
                    else:
                        runs.append([words[0][1], words[n - 1][2], n])
                last = unit in seen
                seen.add(unit)
                words = words[n:]
            at += len(line) + 1
        out |= {(i, s): e for s, e, n in runs if n >= least}
    return out


def line_cut(words, of_line):
    k = len(words)
    return of_line >= 10 and (k == 16 or k >= 4 and (words[-1][-1] in ".!?" or zlib.crc32(words[-1].encode()) % 4 == 0))


def test_passages_inside_longer_lines(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) + rng.choice(["", "", "", ".", ","])
    some = lambda n: " ".join(word() for _ in range(n))
    passage = some(60)
    rows = [(i, f"{some(rng.randint(5, 30))} {passage} {some(rng.randint(5, 30))}\n{some(12)}") for i in range(8)]
    rows += [(20, "tior, " * 300), (21, "x " + "tior, " * 200), (22, some(40).replace(" ", "\n")), (23, "short line"), (24, "short line")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert not any(r.doc_id < 8 for r in line_dedup.removed_runs(table).collect())
    got = line_dedup.removed_runs(table, below_lines=True).collect()
    assert {(r.doc_id, r.start): r.stop for r in got} == plain_runs(rows, 10)
    at = {r.doc_id: r for r in got if r.doc_id < 8}
    assert sorted(at) == list(range(1, 8)) and all(r.kept_in == [0] and r.n_words >= 28 and rows[i][1][r.start:r.stop] in passage for i, r in at.items())
    left = {r.doc_id: r.text for r in line_dedup.deduplicated(table, below_lines=True).collect()}
    assert left[0] == rows[0][1] and all(left[i] == rows[i][1][:at[i].start] + rows[i][1][at[i].stop + 1:] for i in at)


def test_short_repeated_lines(spark):
    rows = [(1, "All rights reserved\nsome own text"), (2, "other text\nall  rights reserved\nand more"), (3, "it says all rights reserved here"), (4, "All rights reserved\nother text")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.removed_runs(table, below_lines=True).collect() == []
    for below in (False, True):
        got = sorted((r.doc_id, r.start, r.stop, r.n_words, r.kept_in) for r in line_dedup.removed_runs(table, below_lines=below, short_lines=True).collect())
        assert got == [(2, 11, 31, 3, [1]), (4, 0, 30, 5, [1, 2])]
    left = {r.doc_id: r.text for r in line_dedup.deduplicated(table, below_lines=True, short_lines=True).collect()}
    assert left == dict(rows) | {2: "other text\nand more", 4: ""}


# ------------------------------------------------------------------ 10 personal data
def plain_spans(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            ok = (True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, 9 <= len(digits) <= 15)[k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans_against_plain_patterns():
    rng = random.Random(11)
    for _ in range(20_000):
        t = "".join(rng.choice("+@.-0123456789 ()ab%") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(t) == plain_spans(t)
    pii.base_spans("1" * 200_000), pii.base_spans("a" * 200_000 + "@"), pii.base_spans("@a" * 50_000)


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"hello there please write me at user{i}@mail.example.org today {i}") for i in range(20)]
    rows += [(50, "so you can write me at admin@localhost tonight"), (51, "again admin@localhost elsewhere"), (52, "see admin2@localhost there")]
    rows += [(100 + i, f"our phone: +1 (415) 555-01{i:02d} thanks {i}") for i in range(20)] + [(150, "our phone: 555-0188123 thanks"), (151, "room number 12345 is here"), (152, "write me at noon")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50].spans == "email:23:38" and got[51].spans == "email:6:21" and got[150].spans == "phone:11:22"
    assert not got[52].spans and not got[151].spans and not got[152].spans and got[50].n_email == 0
    texts = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert texts[50] == "so you can write me at [EMAIL] tonight" and texts[150] == "our phone: [PHONE] thanks" and texts[151] == rows[-2][1]


def test_every_shape_is_found_in_a_confirmed_context(spark):
    seeds = [f"u{i}@mail.example.org" for i in range(20)], [f"10.0.0.{i}" for i in range(20)], [f"+1 415 555 01{i:02d}" for i in range(20)]
    rows = [(100 * k + i, f"so please {w} {x} right now") for k, w in enumerate(("write", "ping", "call")) for i, x in enumerate(seeds[k])]
    cards = [n for n in (f"41111111111{i:05d}" for i in range(400)) if pii.luhn(n)][:20]
    rows += [(300 + i, f"so please charge {x} right now") for i, x in enumerate(cards)]
    planted = {"bob[at]example.org": ("write", "email"), "bob(at)example.org": ("write", "email"), "bob@localhost": ("write", "email"), "fe80::1": ("ping", "ip"), "10:0:0:1": ("ping", "ip"),
               "555 018 8123": ("call", "phone"), "(555) 018-8123": ("call", "phone"), "555-0188123": ("call", "phone"), "4111 1111 1111 1112": ("charge", "card"), "4111-1111-1111-1112": ("charge", "card")}
    rows += [(1000 + i, f"so please {w} {x} right now") for i, (x, (w, _)) in enumerate(planted.items())]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (x, (w, kind)) in enumerate(planted.items()):
        at = len(f"so please {w} ")
        assert f"{kind}:{at}:{at + len(x)}" in got[1000 + i].split(","), x


def test_discovered_identifiers_induce_new_patterns(spark):
    rows = [(i, f"please write me at u{i}@mail.example.org today") for i in range(30)]
    rows += [(100 + i, f"please write me at bob{i}@intern today") for i in range(8)] + [(200 + i, f"my nick is bob{i}@intern okay") for i in range(8)]
    rows += [(300, "my nick is eve@intern okay"), (301, "some other eve2@intern thing")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "email:19:30" and got[200] == "email:11:22" and got[300] == "email:11:21" and not got[301]


# ------------------------------------------------------------------ the pipeline
def test_pipeline_stage_by_stage(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "pii", "mix_sources", "byte_bpe"]
    kept = {r.doc_id for r in host_rules.report(docs).collect() if r.kept}
    one = stages.quality_rules(spark, docs, SF0001)
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    groups = simhash.simhash_groups(one).collect()
    two = stages.near_dedup(spark, one, SF0001)
    assert sorted(r.doc_id for r in two.collect()) == sorted({r.component_id for r in groups})
    three = stages.pii_masking(spark, two, SF0001)
    clean = {r.doc_id: r for r in three.collect()}
    assert set(clean) == {r.doc_id for r in two.collect()} and all(r.n_chars == len(r.text) for r in clean.values())
    assert not any(pii.base_spans(r.text) for r in clean.values())
    four = stages.mix_sources(spark, three, SF0001)
    digests = sorted(stages.tokenise(spark, four, SF0001).collect())
    assert four.columns == docs.columns and sorted(corpus_pipeline.run(spark, SF0001).collect()) == digests


def test_registered():
    found = entry.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11))
