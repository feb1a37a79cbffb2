"""Prefix dynamic programming against the library's encoder; exact histogram."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    path, pattern = bpe._tokenizer()
    table = bpe.load_table(path)
    return table, tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=table.ranks, special_tokens={}), pattern


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_texts_like_the_library(both, small_docs):
    table, enc, pattern = both
    r = random.Random(1)
    texts = [x.text for x in small_docs.collect()]
    texts += ["".join(r.choice(" aethinrs'0123é漢\n\t \x1c²x_-!\U0001f600") for _ in range(r.randint(0, 30)))
              for _ in range(3000)]
    texts += ["<|endoftext|>", "a" * 3000, " " * 999, "ab" * 500 + "\n" * 40, "don't we'll I'm"]
    for chunks in (None, bpe.CHUNKS):
        one = bpe.TextEncoder(table, pattern, chunks)
        for t in texts:
            got = one(t)
            assert ids(got) == enc.encode_ordinary(t), repr(t[:80])
            assert table.decode(ids(got)) == t.encode()


def test_bounded_stores_change_nothing(both, small_docs):
    table, enc, _ = both
    store = bpe.PrefixStore(table, most=20)
    cache = bpe._Cache(lambda p: tuple(store.encode(p.encode())), 10)
    for t in [x.text for x in small_docs.limit(20).collect()]:
        for w in t.split():
            assert list(cache[w]) == enc._encode_single_piece(w.encode())
    assert len(cache) <= 10 and len(store.last) <= 20 + 64


def test_appends_and_edits_are_exact(both):
    table, enc, _ = both
    r = random.Random(2)

    def want(b):
        return enc._encode_single_piece(b) if b else []
    for _ in range(800):
        b = "".join(r.choice("aethinrs'é漢 x") for _ in range(r.randint(0, 60))).encode()
        e = bpe.PrefixEncoding(table)
        for at in range(0, len(b), 7):
            e.append(b[at:at + 7])
            assert e.ids() == want(b[:at + 7])
        i = r.randint(0, len(b))
        j = r.randint(i, min(len(b), i + 6))
        new = bytes(r.choice(b"abc eth") for _ in range(r.randint(0, 6)))
        e.replace(i, j, new)
        assert e.data == b[:i] + new + b[j:] and e.ids() == want(e.data)


def test_an_edit_recomputes_only_its_neighbourhood(both):
    table, enc, _ = both
    b = ("the quick brown fox jumps over " * 400).encode()
    e = bpe.PrefixEncoding(table, b)
    again = e.replace(6000, 6003, b"zzz")
    assert again < 3 * table.longest + 50
    assert e.ids() == enc._encode_single_piece(e.data)


def test_operator_and_edge_cases(docs_of, both):
    _, enc, pattern = both
    path, _ = bpe._tokenizer()
    texts = [None, "", " ", "hello world", "hello world", "é" * 10, "word " * 60000]
    df = docs_of(texts).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    got = {r.doc_id: r for r in bpe.encode_decode(df, path, pattern, chunks=bpe.CHUNKS).collect()}
    for i, t in enumerate(texts):
        want = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(want) and ids(got[i].ids) == want and got[i].decoded == (t or "").encode()
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, path, pattern).collect()}
    assert counts == {i: r.n_tokens for i, r in got.items()}
    assert bpe.encode_decode(df.limit(0), path, pattern).collect() == []


def test_query_digests(spark, sf_small, both):
    _, enc, _ = both
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in bpe.op6_bpe_encoding(spark, sf_small).collect():
        packed = np.array(enc.encode_ordinary(texts[r.doc_id]), dtype="<u4").tobytes()
        assert r.n_tokens == len(packed) // 4 and r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_histogram_answers_every_limit(spark):
    r = random.Random(3)
    lengths = [r.choice([0, 1, 5, 1023, 1024, 1025, 5000, r.randint(0, 9000)]) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in [*lengths, None]], "n_tokens long")
    h = bpe.length_histogram(df)
    rows = {x.n_tokens: x for x in h.collect()}
    assert {k: x.n_docs for k, x in rows.items()} == Counter(lengths)
    for k, x in rows.items():
        over = [n for n in lengths if n >= k]
        assert x.docs_at_least == len(over) and x.tokens_at_least == sum(over)
        assert x.truncated_total == sum(min(n, k) for n in lengths)
        assert x.docs_at_most == sum(n <= k for n in lengths) and x.quantile == x.docs_at_most / len(lengths)
    limits = [0, 1, 700, 1024, 10 ** 6]
    for x in bpe.context_limits(h, limits).collect():
        k = x.context_limit
        assert (x.documents, x.truncated_docs, x.total_tokens, x.kept_tokens) == (
            len(lengths), sum(n > k for n in lengths), sum(lengths), sum(min(n, k) for n in lengths))
    assert bpe.quantile(h, .5).first().n_tokens == sorted(lengths)[len(lengths) // 2 - 1]
    assert bpe.length_histogram(df.limit(0)).collect() == []


def test_token_count_query(spark, sf_small, both):
    _, enc, _ = both
    n = Counter(len(enc.encode_ordinary(r.text)) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect())
    assert {r.n_tokens: r.n_docs for r in bpe.op7_token_counts(spark, sf_small).collect()} == n
