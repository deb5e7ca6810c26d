"""Cross-tokenizer alignment against a plain version that works token by token."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from ragloom.llm import token_align
from ragloom.llm.queries import QUERIES

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(docs):
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = token_align.byte_letters()
    coded = []
    for doc_id, text in docs:
        links, groups, ia, ib = Counter(), [], [], []
        if text:
            ia = a.encode(" " + text, add_special_tokens=False).ids
            ib = b.encode(text)
            sides = []
            for ids, spell in ((ia, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
                               (ib, lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
                at, spans, parts = 0, [], []
                for i in ids:
                    parts.append(spell(i))
                    spans.append((at, at + len(parts[-1]), i))
                    at += len(parts[-1])
                sides.append((b"".join(parts), spans))
            if all(joined == (" " + text).encode() for joined, _ in sides):
                (_, sa), (_, sb) = sides
                j = 0
                for s, e, i in sa:
                    while sb[j][1] <= s:
                        j += 1
                    for s2, e2, i2 in sb[j:]:
                        if s2 >= e:
                            break
                        links[i, i2] += 1
                common = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
                start = 0
                for end in common:
                    groups.append(",".join(str(i) for s, e, i in sa if start < e <= end) + "|" + ",".join(str(i) for s, e, i in sb if start < e <= end))
                    start = end
            else:
                ia = ib = []
        coded.append((doc_id, len(ia), len(ib), groups, links))
    held = Counter(p for *_, links in coded for p in links)
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [(doc_id, na, nb, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]),
             sum(n * held[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for doc_id, na, nb, groups, links in coded]


def texts(spark, n=70):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(n).collect()
    odd = ["", None, " ", "  a  b ", "a \n b\n\n c", "x▁y", "tab\there  \n  and  so　 on", "日本語 テキスト 🤖🤖", "<|endoftext|> and <s>",
           "\x00\x01 \x1c x", "é ﬁ", "same words same words", "same words same words", "don't  we'll I'm", "é" * 300, "word " * 400, " lead", "trail ", "\r\n\r\n",
           "​ ​", "a  b   c"]
    return [(r.doc_id, r.text[:3000]) for r in rows] + [(2**60 + 1 + i, t) for i, t in enumerate(odd)] + [(None, "a null id, same words")]


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("hot", [token_align.HOT, 3])
def test_alignment_against_plain_version(spark, hot):
    """Also with most pairs joined by the shuffle (hot = 3)."""
    docs = texts(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "body").selectExpr("*", "1 as n_a", "'x' as a", "2 as pair", "0 as _row").repartition(3)
    got = token_align.report(df, A_PATH, B_PATH, text_col="body", hot=hot)
    assert got.columns == COLUMNS
    assert sorted(map(key, got.collect())) == sorted(map(key, brute(docs)))


def test_small_batches_and_empty_table(spark, monkeypatch):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta,", "\n", "gamma", "δέλτα", ""]) for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    monkeypatch.setattr(token_align, "BATCH_BYTES", 200)
    monkeypatch.setattr(token_align, "COUNT_ROWS", 50)
    monkeypatch.setattr(token_align, "ROW", 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(key, token_align.report(df, A_PATH, B_PATH).collect())) == sorted(map(key, brute(docs)))
    empty = token_align.report(df.limit(0), A_PATH, B_PATH)
    assert empty.columns == COLUMNS and empty.collect() == []


def test_words_are_told_apart_as_whole_texts_are():
    with open(A_PATH, encoding="utf-8") as f, open(B_PATH, "rb") as g:
        pair = token_align.Pair(f.read(), g.read())
    assert pair.by_words
    rnd = random.Random(5)
    alphabet = [" ", " ", "\n", "\t", " ", " ", "\u0085", "\x1c", "a", "B", "é", "я", "9", "²", ".", "'s", "'", "_", "漢", "́", "‍", "🤖"]
    sample = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    a, b = pair.encode(sample)
    assert a.to_pylist() == [e.ids for e in pair.a.encode_batch([" " + t for t in sample], add_special_tokens=False)]
    assert b.to_pylist() == pair.b.encode(sample)


def test_registered_query_on_the_small_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001")
    assert sorted(map(key, got.select(*COLUMNS).collect())) == sorted(map(key, brute(docs)))


def test_byte_alphabet_is_the_vocabularys():
    letters = token_align.byte_letters()
    assert len(letters) == 256 and sorted(letters.values()) == list(range(256))
    with open(A_PATH, encoding="utf-8") as f:
        assert set(re.findall(r'"(.)": ?\d+[,}]', f.read())) - {'"', "\\"} <= set(letters)
