"""Each stage of the pipeline on its own input, against brute force."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ticketlens.llm import bpe, paragraphs

from .test_mixing import plain_targets
from .test_paragraphs import plain as plain_repeats
from .test_passages import plain_words
from .test_simhash import brute, plain as plain_fp


@pytest.fixture(scope="module")
def staged(spark, sf_small, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    out, docs = {}, spark.read.parquet(f"{sf_small}/documents.parquet")
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf_small).write.parquet(path)
        new = spark.read.parquet(path)
        out[name] = (docs, docs.collect(), new, new.collect())
        docs = new
    return out


def test_stages_and_columns(staged, sf_small, spark):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "encoding"]
    want = spark.read.parquet(f"{sf_small}/documents.parquet").dtypes
    for name in [n for n, _ in cp.STAGES][:-1]:
        assert staged[name][2].dtypes == want, name


def test_quality_keeps_good_documents(staged, spark, sf_small):
    _, before, _, after = staged["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) / len(good) > .95
    assert set(map(tuple, after)) <= set(map(tuple, before))


def test_one_document_of_each_component_stays(staged):
    _, before, _, after = staged["near_duplicates"]
    fp = {r.doc_id: plain_fp(r.text) for r in before}
    root = brute(sorted(set(fp.values())))
    first = {}
    for d in sorted(fp):
        first.setdefault(root[fp[d]], d)
    assert sorted(r.doc_id for r in after) == sorted(first.values())
    assert set(map(tuple, after)) <= set(map(tuple, before))


def test_repeated_passages_are_cut(staged):
    df, before, _, after = staged["repeated_passages"]
    texts = {r.doc_id: r.text for r in before}
    kept = plain_repeats(list(texts.items()), paragraphs.MIN_WORDS)
    lines = {(o[0][1], o[1]) for o, k in kept.items() if o != k}
    whole = set()
    for d, t in texts.items():
        n = 0
        for i, line in enumerate(t.encode().split(b"\n")):
            whole |= {(d, n + j) for j in range(len(line.split()))} if (d, i) in lines else set()
            n += len(line.split())
    runs = plain_words(list(texts.items()), lines, paragraphs.MIN_WORDS)
    left, gone = {r.doc_id: r for r in after}, set()
    for d, t in texts.items():
        words, now = t.encode().split(), left[d].text.encode().split() if d in left else []
        i = 0
        for j, w in enumerate(words):  # what is left stands in order
            free = (d, j) not in whole and (d, j) not in runs
            if i < len(now) and now[i] == w and (free or len(now) - i > len([1 for x in range(j + 1, len(words))
                                                                               if (d, x) not in whole and (d, x) not in runs])):
                i += 1
            else:
                gone.add((d, j))
        assert i == len(now), d
        assert d not in left or left[d].n_chars == (len(left[d].text) if left[d].text != t else len(t))
    want = whole | runs
    more = gone - want  # of near copies: changed words, and the shorter equal runs beside them
    assert len(want) > 200 and len(want - gone) <= len(want) / 50 and len(more) <= len(want) / 10
    for d, j in more:
        a, b = j, j
        while (d, a) in more:
            a -= 1
        while (d, b) in more:
            b += 1
        assert (d, a) in want or (d, b) in want


def test_mix_takes_whole_documents_near_the_targets(staged):
    _, before, _, after = staged["mixing"]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before}
    source, sizes, taken, most = {r.doc_id: r.source for r in before}, Counter(), Counter(), Counter()
    for d, n in size.items():
        sizes[source[d]] += n
        most[source[d]] = max(most[source[d]], n)
    assert set(map(tuple, after)) <= set(map(tuple, before))
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    for r in after:
        taken[r.source] += size[r.doc_id]
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= 2 * most[s]


def test_encoding_is_that_of_the_library(staged):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe._tokenizer()
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.load_table(path).ranks, special_tokens={})
    _, before, _, after = staged["encoding"]
    want = Counter()
    for r in before:
        ids = np.array(enc.encode_ordinary(r.text), dtype="<u4").tobytes()
        want[(r.doc_id, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(),
              hashlib.sha256(r.text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in after) == want


def test_nulls_and_repeated_rows_pass_every_stage(spark, docs_of, sf_small):
    base = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60)
    odd = docs_of([(900, None, None, None), (901, "", "en", "x"), (None, "no id here at all", "en", "x"),
                   (902, "same row twice " * 9, "en", None), (902, "same row twice " * 9, "en", None),
                   (903, "very long " * 40000, "en", "y")])
    docs = base.unionByName(odd)
    for _, stage in cp.STAGES:
        n = docs.count()
        docs = stage(spark, docs, sf_small).persist()
        assert docs.count() <= 2 * n
    assert docs.where("doc_id = 902").select(F.countDistinct("n_tokens")).first()[0] <= 1
    empty = base.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, sf_small).persist()
        assert empty.count() == 0
