"""Cases of the findings of round 3. Tests build their own rows."""
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from ragloom.llm import pii
from ragloom.operators import retrieval as R


# ------------------------------------------------------------------------------ F1: counts by kind, long runs of zeros
def test_counts_are_of_their_own_kind(spark):
    text = {1: "a@b.com or c@d.org at 1.2.3.4", 2: "4111 1111 1111 1111", 3: "+1 (555) 123-4567, +1 (555) 123-4568 x@y.zz", 4: None}
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert {k: (r.n_email, r.n_ip, r.n_card, r.n_phone) for k, r in got.items()} == {1: (2, 1, 0, 0), 2: (0, 0, 1, 0), 3: (1, 0, 0, 2), 4: (0, 0, 0, 0)}
    assert got[2].base_sha256 == hashlib.sha256(b"card:0:19").hexdigest()


def test_parts_of_many_zeros_are_numbers():
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.{zeros}7.1.255") == [(1, 0, 10008)]
    assert pii.base_spans(f"{zeros}256.1.1.1") == []


# ------------------------------------------------------------------------------ F9-F12, F24: groups met as blocks of scores
def _vectors(n: int, dim: int = 8, seed: int = 3) -> list[tuple[int, list[float]]]:
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, dim)).round(2))]


def test_ivf_meets_cells_as_groups(spark, monkeypatch):
    rows = _vectors(400) + [(400, None), (None, [1.0] * 8), (7, [0.5] * 8)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.withColumnRenamed("vec_id", "q_id")
    exact = {tuple(r) for r in R.knn_dense(q, "q_id", "embedding", e, "vec_id", "embedding", 5, exclude_self=True).where("q_id is not null and vec_id is not null").collect()}
    monkeypatch.setattr(R, "GROUP_VALUES", 8 * 50)  # many parts of a cell
    h = R.knn_ivf(q, "q_id", "embedding", e, "vec_id", "embedding", 5, n_cells=4, nprobe=4, exclude_self=True)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan  # no row per pair of vectors
    got = {tuple(r) for r in h.collect()}
    keyless = {r.q_id for r in R.knn_dense(q, "q_id", "embedding", e, "vec_id", "embedding", 5, exclude_self=True).where("vec_id is null").collect()}
    near = lambda rows: {(a, n, c, round(s, 5)) for a, n, c, s in rows if a not in keyless}
    assert near(got) == near(exact) and len(got) == 400 * 5 and not any(r[0] is None or r[2] is None for r in got)


def test_dense_meeting_holds_one_block_of_scores():
    rng = np.random.default_rng(1)
    table = lambda key, vec, n: pa.table({key: pa.array(range(n)), vec: pa.array(list(rng.normal(size=(n, 4))), pa.list_(pa.float32()))})
    asked, held = table("q", "a", 1500), table("c", "h", 30_000)
    tracemalloc.start()
    out = R._dense_meeting("q", "a", "c", "h", 3, False)(asked, held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 4500 and peak < 150e6  # whole columns of scores took 30,000 x 512 doubles, several times over
    a, h = (np.array(t.to_pylist()) for t in (asked["a"], held["h"]))
    scores = (a[:40] / np.linalg.norm(a[:40], axis=1, keepdims=True)) @ (h / np.linalg.norm(h, axis=1, keepdims=True)).T
    best = {q: [] for q in range(40)}
    for r in out.to_pylist():
        if r["q"] < 40:
            best[r["q"]].append(r["c"])
    for q, found in best.items():
        assert sorted(found) == sorted(np.lexsort((np.arange(30_000), -scores[q].round(6)))[:3])


# ------------------------------------------------------------------------------ F2-F7, F13-F22: many questions, dealt
def test_many_questions_are_dealt(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(words[min(199, int(rng.paretovariate(0.5))) - 1] for _ in range(n))
    q = spark.createDataFrame([(i, text(rng.randint(0, 12)) if i % 11 else None) for i in range(400)], "qid long, q string")
    c = spark.createDataFrame([(i, ("a", "b")[i % 2], text(rng.randint(0, 40))) for i in range(900)] + [(900, "a", None)], "doc long, kind string, text string")
    got = {}
    for dealt in (False, True):
        if dealt:
            monkeypatch.setattr(R, "GROUP_BYTES", 4000)
            monkeypatch.setattr(R, "LEXICAL_ROWS", 16)
            monkeypatch.setattr(R, "QUESTION_BLOCK", 32)
        for group in (None, "kind"):
            h = R.knn_lexical(q, "qid", "q", c, ["doc", "kind"], "text", 4, max_questions=50 if dealt else 1000, group=group)
            if dealt:
                assert "Join" not in h._jdf.queryExecution().executedPlan().toString()  # no row per pair of texts
            got[dealt, group] = {(r.qid, r["rank"], r.doc, r.kind, round(r.score, 9)) for r in h.collect()}
    assert got[True, None] == got[False, None] and got[True, "kind"] == got[False, "kind"] and got[True, None]


# ------------------------------------------------------------------------------ F28-F32, F34, F35: batches in slices; F8: hash places
def test_batches_become_python_objects_in_slices(spark):
    from ragloom.operators.common import in_slices

    df = spark.createDataFrame([(i, [f"w{j}" for j in range(i % 5)]) for i in range(1000)], "k long, words array<string>").coalesce(1)

    def sizes(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"n": [len(f)], "words": [int(f["words"].map(len).sum())]})

    schema = spark.createDataFrame([], "n long, words long").schema
    got = df.mapInArrow(in_slices(sizes, schema, 64), schema).collect()
    assert sum(r.n for r in got) == 1000 and max(r.n for r in got) <= 64 and sum(r.words for r in got) == 2000


def test_hash_places_are_counted(spark):
    import re

    from ragloom.operators.embedding import hashed_terms

    texts = ["The cat. The dog, the THE!", "", None, "a b c a", "ünï १२ x"]
    got = [r.v for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(hashed_terms(16)("t").alias("v")).collect()]
    for t, v in zip(texts[:2] + texts[3:4], got[:2] + got[3:4]):
        want = [0.0] * 16
        for w in re.findall(r"[a-z]+", t.lower()):
            want[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 16] += 1
        assert v == want
    assert got[2] == [0.0] * 16 and sum(got[4]) == 3
