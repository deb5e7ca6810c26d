"""Chunkers: coverage, step, overlap, maximum size and boundary conditions."""
import random

from ragloom.operators import chunking as C


def docs(n=60, seed=1):
    rnd = random.Random(seed)
    vocab = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    out = []
    for i in range(n):
        sents = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 8))) + rnd.choice(".!?।") for _ in range(rnd.randint(0, 40))]
        out.append((i, "  ".join(sents)))
    return out


def test_fixed_properties(spark):
    rows = docs() + [(999, " ".join(f"w{i}" for i in range(500)))]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for size, overlap in [(256, 0.15), (8, 0.25), (3, 0.9)]:
        step = max(1, int(size * (1 - overlap)))
        got = {}
        for r in C.chunk_fixed(df, "text", ["doc_id"], size, overlap).orderBy("doc_id", "position").collect():
            got.setdefault(r.doc_id, []).append(r.text.split())
        for d, t in rows:
            words, chunks = t.split(), got.get(d, [])
            assert len(chunks) == -(-len(words) // step)  # a chunk starts at every step
            assert all(c == words[k * step:k * step + size] for k, c in enumerate(chunks))
    sizes = [r.n_words for r in C.chunk_fixed(df.where("doc_id = 999"), "text", ["doc_id"]).orderBy("position").collect()]
    assert sizes == [256, 256, 66]


def test_semantic_properties(spark):
    rows = docs(80, seed=3)
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for thr, mx in [(0.05, 12), (0.3, 3), (0.55, 12), (0.9, 1)]:
        sims = {(r.doc_id, r.pos): (r.sentence, r.sim) for r in C.semantic_boundaries(df, "text", ["doc_id"], thr).collect()}
        by_method = []
        for method in ("arrays", "relational"):
            chunks = {}
            for r in C.chunk_semantic(df, "text", ["doc_id"], thr, mx, method=method).orderBy("doc_id", "position").collect():
                chunks.setdefault(r.doc_id, []).append((r.text, r.n_sentences))
            by_method.append(chunks)
            for d, found in chunks.items():
                at = 0
                for text, n in found:
                    assert 1 <= n <= mx and text == " ".join(sims[d, at + k][0] for k in range(n))
                    assert all(sims[d, at + k][1] >= thr for k in range(1, n))  # no break inside a chunk
                    if at:  # a chunk ends at a dissimilar sentence or because it's full
                        assert sims[d, at][1] < thr or before == mx
                    at, before = at + n, n
                assert (d, at) not in sims  # every sentence is in one chunk
        assert by_method[0] == by_method[1]


def test_neighbour_similarity_values(spark):
    df = spark.createDataFrame([(1, "a b. a b. a c! x y? a b x y.")], "doc_id int, text string")
    for method in ("arrays", "relational"):
        got = [r.sim for r in C.semantic_boundaries(df, "text", ["doc_id"], 0.3, method=method).orderBy("pos").collect()]
        assert [round(s, 6) for s in got[1:]] == [1.0, 0.5, 0.0, 0.707107]


def test_structured_rules(spark):
    rows = [(7, "q", ["p0", "  ", None, " p3 "], [1]), (8, "q2", None, None), (None, "q3", ["x"], [1]), (None, "q4", ["x"], [1])]
    df = spark.createDataFrame(rows, "query_id long, query string, passages array<string>, is_selected array<int>")
    out = C.chunk_structured(df).orderBy("passage_id", "query_text").collect()
    assert [(r.passage_id, r.position, r.text, r.is_selected) for r in out] == [
        ("7_0", 0, "p0", 1), ("7_3", 3, "p3", 0), ("unknown_0", 0, "x", 1), ("unknown_0", 0, "x", 1)]
    assert len({r.chunk_id for r in out}) == len({r.doc_id for r in out}) + 1 == 4  # rows without a query id stay apart


def test_structured_reads_the_wanted_language(spark):
    from ragloom.sources.readers import PASSAGES_SCHEMA

    rows = [(1, "type", "question", "answer", "eq", "ea", ([0, 1], ["one", "two"], ["eins", "zwei"]), "en", "hi", {})]
    df = spark.createDataFrame(rows, PASSAGES_SCHEMA)
    for translated, texts, language in ((True, ["eins", "zwei"], "hi"), (False, ["one", "two"], "en")):
        got = C.chunk_structured(df, use_translated=translated).orderBy("position").collect()
        assert [r.text for r in got] == texts and {r.language for r in got} == {language}
        assert {(r.query_type, r.answer_text, r.query_text) for r in got} == {("type", "answer", "question")}


def test_flatten_passages(spark):
    df = spark.createDataFrame([(["a ", " ", None, "b"],)], "p array<string>")
    assert df.select(C.flatten_passages("p").alias("f")).first().f == "a  b"
